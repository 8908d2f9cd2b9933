"""Token counts by section from one encoding of the whole document (operator 5).

A document is encoded once, so that its tokens are those a model would see; counting sections apart would cut tokens
at their borders. Byte-level tokens carry their byte lengths, so offsets are a running sum, mapped to characters by the
text's UTF-8. Token spans are joined to section spans by sorted search. A token that crosses a border is counted once,
by an explicit rule: ``start`` (the section of its first character), ``end`` (of its last) or ``most`` (of most of its
characters, the earlier of equals).

Sections are lines with their line feed; the vocabulary is read on the driver and broadcast (a file of known size).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "most")
#: Vocabularies above this aren't broadcast.
MOST_BYTES = 64 << 20
_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def line_starts(text: str) -> np.ndarray:
    """Character positions where lines begin; empty for an empty text."""
    return np.array([m.start() for m in _LINE.finditer(text)], dtype=np.int64)


def attribute(text: str, lengths: np.ndarray, starts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, border-crossing tokens counted here) of each section; lengths: the tokens' bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    ends = np.cumsum(lengths)
    first, last = char[ends - lengths], char[ends - 1]
    a, b = (np.searchsorted(starts, x, side="right") - 1 for x in (first, last))
    if rule == "start":
        home = a
    elif rule == "end":
        home = b
    else:
        home = a.copy()
        for i in np.flatnonzero(a != b):
            edges = np.concatenate([[first[i]], starts[a[i] + 1 : b[i] + 1], [last[i] + 1]])
            home[i] = a[i] + int(np.argmax(np.diff(edges)))
    n = len(starts)
    return np.bincount(home, minlength=n), np.bincount(home[a != b], minlength=n)


_OUT = "doc_id long, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"


def section_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "start") -> DataFrame:
    """One row per section: doc_id, section (from 0), char_start, char_end (exclusive), n_tokens, n_crossing, doc_tokens.

    The sections' counts sum to the document's. A null or empty text gives one section of no characters and tokens.
    Repeated rows and null ids give rows of their own. An empty table gives an empty result. Other columns are neither
    read nor returned.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        size = np.zeros(max(ranks.value.values()) + 1, np.int64)
        for token, i in ranks.value.items():
            size[i] = len(token)
        names = [x.split()[0] for x in _OUT.split(", ")]

        def rows(parts: list[tuple]) -> pa.RecordBatch:
            counts = [len(p[1]) for p in parts]
            whole = [
                np.repeat(np.array([p[0] if p[0] is not None else 0 for p in parts]), counts), np.concatenate([np.arange(n) for n in counts]),
                *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4)), np.repeat([p[5] for p in parts], counts),
            ]
            absent = np.repeat([p[0] is None for p in parts], counts)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64(), mask=absent if i == 0 else None) for i, x in enumerate(whole)], names=names)

        for batch in batches:
            parts, held = [], 0
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py() or ""
                starts = line_starts(text)
                if not len(starts):
                    zero = np.zeros(1, np.int64)
                    parts.append((doc_id, zero, zero, zero, zero, 0))
                    continue
                lengths = size[np.array(coder.encode_ordinary(text), np.int64)]
                n, crossing = attribute(text, lengths, starts, rule)
                parts.append((doc_id, starts, np.append(starts[1:], len(text)), n, crossing, len(lengths)))
                held += len(starts)
                if held > 20_000:
                    yield rows(parts)
                    parts, held = [], 0
            if parts:
                yield rows(parts)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, _OUT)

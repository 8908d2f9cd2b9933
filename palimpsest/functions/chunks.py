"""Texts cut into chunks, sections and spans: one text in, rows out, batch-wise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_CHARS, OVERLAP, MIN_CHARS = 1000, 120, 1


def split_text(text: str | None, *, most: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS) -> list[str]:
    """Neighbouring paragraphs together up to ``most`` characters; a longer one in slices that share ``overlap``."""
    groups: list[list[str]] = []
    for paragraph in filter(None, (p.strip() for p in (text or "").split("\n\n"))):
        if len(paragraph) > most:
            step = most - overlap if overlap < most else most
            groups += [[paragraph[i : i + most]] for i in range(0, max(len(paragraph) - (most - step), 1), step)]
            groups.append([])  # nothing joins a slice
        elif groups and groups[-1] and sum(map(len, groups[-1])) + 2 * len(groups[-1]) + len(paragraph) <= most:
            groups[-1].append(paragraph)
        else:
            groups.append([paragraph])
    return [c for c in ("\n\n".join(g) for g in groups) if len(c.strip()) >= least]


def split_sections(text: str | None, *, most: int = MAX_CHARS) -> list[tuple[str, str, str]]:
    """(breadcrumb, kind, chunk) of a marked-up text: chunks stay within a heading's section, code fences and tables are
    whole, and the breadcrumb names the headings above."""
    out: list[tuple[str, str, str]] = []
    path: list[tuple[int, str]] = []
    held: list[str] = []

    def close() -> None:
        crumb = " > ".join(t for _, t in path)
        out.extend((crumb, "text", c) for c in split_text("\n".join(held), most=most))
        held.clear()

    blocks = re.split(r"(?ms)^(```.*?^```[^\n]*|(?:^\|[^\n]*\n?)+|\#{1,6} [^\n]*)", text or "")
    for block in blocks:
        heading = re.match(r"(#{1,6}) +(.*)", block)
        if heading:
            close()
            depth = len(heading[1])
            path = [*(p for p in path if p[0] < depth), (depth, heading[2].strip())]
        elif block.startswith(("```", "|")):
            close()
            out.append((" > ".join(t for _, t in path), "code" if block.startswith("`") else "table", block.rstrip("\n")))
        else:
            held.append(block)
    close()
    return out


def split_spans(text: str | None) -> list[str]:
    """Sentences: cut behind ``! ?``, line ends and full stops, but for those within numbers."""
    return [s for s in (x.strip() for x in re.findall(r"(?s)(?:[^.!?\n]|(?<=[0-9])\.(?=[0-9]))*[.!?\n]?", text or "")) if s]


def explode_text(df: DataFrame, id_col: str, text_col: str, cut: Callable[[str | None], list], fields: str) -> DataFrame:
    """(id, pos from 1, ``fields``) of what ``cut`` makes of each text."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):  # a text's rows at a time
                rows = [r if isinstance(r, tuple) else (r,) for r in cut(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(rows), batch.schema.field(0).type), pa.array(range(1, len(rows) + 1), pa.int64()), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], names=[id_col, "pos", *names])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, pos long, {fields}")

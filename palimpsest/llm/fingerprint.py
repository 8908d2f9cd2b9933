"""Document fingerprints by threshold-scaled sketches (operator 3).

Method: FracMinHash (Irber et al., "Lightweight compositional analysis of metagenomes", 2022). A sketch holds every
distinct shingle hash below a fixed fraction, ``1 / SCALE``, of the hash range. The fraction doesn't depend on the
document, so sketches merge by union and containment can be estimated between texts of very unequal sizes. Sets of up
to ``WHOLE`` shingles, of which a fraction would leave next to nothing, are kept whole, that is at a scale of 1; two
sketches are compared and merged at the larger of their scales, to which the other is thinned.

A fingerprint is a string ``<scale>.<distinct shingles>.<base64>``, where the last part holds the kept hashes in
ascending order, six bytes each. Should none of a larger set be kept, the digest of the set stands there instead,
after a ``!``, so that equal texts have equal fingerprints and others differ.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .grouping import partitions

SCALE, WHOLE, WORDS, _WIDTH = 8, 64, 5, 6


def _written(scale: int, n: int, kept: np.ndarray) -> str:
    """``kept``: the first six bytes of the hashes as numbers, ascending."""
    raw = np.ascontiguousarray(kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _WIDTH :]).tobytes()
    return f"{scale}.{n}.{base64.b64encode(raw).decode()}"


def encode(shingles: np.ndarray, scale: int = SCALE) -> str:
    """The fingerprint of sorted distinct shingle hashes."""
    scale = 1 if len(shingles) <= WHOLE else scale
    kept = shingles[: np.searchsorted(shingles, np.uint64((1 << 64) // scale - 1), side="right")]
    if len(shingles) and not len(kept):
        return f"{scale}.{len(shingles)}.!" + hashlib.blake2b(shingles.tobytes(), digest_size=12).hexdigest()
    return _written(scale, len(shingles), kept >> np.uint64(64 - 8 * _WIDTH))


def decode(fingerprint: str) -> tuple[int, int, np.ndarray]:
    """Scale, number of shingles and the kept hashes."""
    scale, n, body = fingerprint.split(".")
    raw = np.frombuffer(b"" if body.startswith("!") else base64.b64decode(body), np.uint8).reshape(-1, _WIDTH)
    return int(scale), int(n), np.pad(raw, ((0, 0), (8 - _WIDTH, 0))).view(">u8").ravel().astype(np.uint64)


def _thinned(a: str, b: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The common scale of two fingerprints and their distinct kept hashes at it."""
    (s, _, x), (t, _, y) = decode(a), decode(b)
    scale = max(s, t)
    most = np.uint64((1 << 8 * _WIDTH) // scale - 1)
    return scale, *(np.unique(z[z <= most]) for z in (x, y))


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprinted sets; exact for two sets of ``WHOLE`` shingles or fewer."""
    if a == b:
        return 1.0
    _, x, y = _thinned(a, b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def containment(a: str, b: str) -> float:
    """Estimated share of a's shingles that b has; 0 where nothing of a is left at the common scale."""
    if a == b:
        return 1.0
    _, x, y = _thinned(a, b)
    return len(np.intersect1d(x, y, assume_unique=True)) / max(len(x), 1)


def merge(a: str, b: str) -> str:
    """The fingerprint of the union, its count estimated where one of the two isn't whole."""
    scale, x, y = _thinned(a, b)
    both = np.union1d(x, y)
    if scale == 1 and len(both) > WHOLE:
        scale, n = SCALE, len(both)
        both = both[both <= np.uint64((1 << 8 * _WIDTH) // scale - 1)]
    else:
        n = len(both) * scale
    return _written(scale, n, both)


def fingerprints_of(texts: list[str], k: int, scale: int) -> list[str]:
    out: list[str] = []
    for a, b, hashes, at in textvec.shingle_sets(pa.array(texts, pa.large_string()), k):
        out += [encode(hashes[at[i] : at[i + 1]], scale) for i in range(b - a)]
    return out


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(k: int, scale: int, limit: int):
    """Rows sorted by (bucket, doc_id, text); a guest is the first row of the next bucket, seen but not answered."""

    def flush(ids: list, texts: list[str], last: str) -> pa.RecordBatch:
        nexts = [*texts[1:], last]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
        prints = fingerprints_of([*texts, last], k, scale)
        changed = fingerprints_of(edited, k, scale)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(prints[:-1]), pa.array(changed),
                pa.array(list(map(likeness, prints[:-1], changed)), pa.float64()), pa.array(list(map(likeness, prints[:-1], prints[1:])), pa.float64()),
            ],
            names=[x.split()[0] for x in _OUT.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        held, bucket, closed = 0, None, True
        for batch in batches:
            for b, guest, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                b, guest, doc_id, text = b.as_py(), guest.as_py(), doc_id.as_py(), text.as_py()
                if b != bucket:
                    bucket, closed = b, False
                if closed:
                    continue
                if guest or held >= limit:
                    if texts:
                        yield flush(ids, texts, text)
                    ids, texts, held = [], [], 0
                    if guest:
                        closed = True
                        continue
                ids.append(doc_id)
                texts.append(text)
                held += len(text)

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, scale: int = SCALE) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last ``n_chars // 2`` code points replaced by the first as many (or all) of
    the next document's, in ascending doc_id; the first follows the last. near_edited and near_next estimate the
    Jaccard similarity of the k-word shingle sets with those of the edited text and of the next document.

    A null text counts as empty; the empty set's fingerprint equals only itself. Null ids come first, rows that share
    an id follow each other by text. One row is its own next. An empty table gives an empty result. Other columns
    are neither read nor returned.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    cuts = sorted(set(slim.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = [int(c) for c in cuts]
    order = F.array(*(F.lit(c) for c in cuts)) if cuts else None
    # the number of cuts at or below the id, by SQL on a literal array
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(order, lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0))
    placed = slim.withColumn("bucket", bucket.cast("int"))
    found = [r["bucket"] for r in placed.select("bucket").distinct().collect()]  # at most one a partition
    used = sorted(found)
    before = {b: used[(i - 1) % len(used)] for i, b in enumerate(used)}
    firsts = placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("m")).select("bucket", F.col("m.doc_id").alias("doc_id"))
    firsts = {r["bucket"]: r["doc_id"] for r in firsts.collect()}
    pairs = [(b, firsts[b], before[b]) for b in used]
    if not pairs:
        return spark.createDataFrame([], _OUT)
    home = F.element_at(F.create_map(*(F.lit(x) for b, _, p in pairs for x in (b, p))), F.col("bucket"))
    lead = F.element_at(F.create_map(*(F.lit(x) for b, f, _ in pairs for x in (b, -(1 << 63) if f is None else f))), F.col("bucket"))
    is_first = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == lead
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest"))
    sent = F.explode(F.when(is_first, F.array(own, F.struct(home.alias("to"), F.lit(True).alias("guest")))).otherwise(F.array(own)))
    dealt = placed.withColumn("s", sent).select(F.col("s.to").alias("bucket"), F.col("s.guest").alias("guest"), "doc_id", "text")
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_walk(k, scale, 2 << 20), _OUT)

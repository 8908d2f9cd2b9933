"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort (operator 2).

Method: the string merge sort of Bingmann, Sanders and Schimek ("Communication-Efficient String Sorting", 2020)
with its duplicate detection in front, on a sparse suffix array.

* Sampling. A window is ``WINDOW`` bytes of one document. Its anchor is its least ``GRAM``-byte hash, so equal
  windows have equal anchors wherever they stand. Neighbouring windows with one anchor form one suffix, cut where
  the last of them ends; the suffixes hold every window once.
* Duplicate detection. Blocks exchange delta-coded sorted anchors only. Suffixes whose anchor no other document
  has go no further; that is most of them.
* Sorted runs. Each block sorts its other suffixes, keeps one of equal ones (those of larger doc_id are decided
  there) and sends front-coded runs: common prefix length and the rest.
* Merge. A loser tree merges the runs of one anchor range. It keeps the common prefix length of every loser with
  its winner, so it compares no byte of a known prefix again, and hands out the length with the string before.
* Decision. Equal suffixes of one anchor: all windows are the smallest document's. Different ones of one anchor:
  their windows are looked up one by one.

An anchor in ``HOT`` or more documents (a common line, say) would meet in one task with all its contexts. Its
windows are then anchored by their own hash, which spreads them and still brings equal ones together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .arrays import pack as _pack
from .arrays import unpack as _unpack
from .blocks import PARTS, blocks, in_blocks, unpack
from .grouping import partitions, sorted_groups
from .scratch import Phases

WINDOW, GRAM, SPAN, HOT = 50, 20, 64, 4096
_LAST = np.iinfo(np.int64).max
_TAG = 6
#: A row's address in its block: the part above, the row in the part below.
_ROW_BITS = 30
_ROW_MASK = (1 << _ROW_BITS) - 1
assert PARTS <= 4


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - (width - size)], g[width - size :]) if width > size else g


class _Windows:
    """The windows of a block's texts: anchors, documents, runs of one anchor."""

    def __init__(self, column: pa.Array, ids: np.ndarray) -> None:
        self.buf, self.offsets = textvec.string_buffer(column)
        self.ids = ids
        n, empty = len(self.buf), np.zeros(0, np.int64)
        self.lo = self.hi = self.row = empty
        self.key = np.zeros(0, np.uint64)
        if n < WINDOW:
            return
        least = _least(textvec.rolling_hash(self.buf, GRAM), WINDOW - GRAM + 1)
        lengths = np.diff(self.offsets)
        long_ = np.flatnonzero(lengths >= WINDOW)
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[self.offsets[long_]] += 1
        np.add.at(inside, self.offsets[long_] + lengths[long_] - WINDOW + 1, -1)
        valid = np.cumsum(inside[: len(least)], dtype=np.int8).astype(bool)
        fresh = valid.copy()
        fresh[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        fresh[self.offsets[long_]] = True
        lo = np.flatnonzero(fresh)
        stop = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1
        hi = np.append(lo[1:], n)
        hi = np.minimum(hi, stop[np.searchsorted(stop, lo, side="right")])
        parts = (hi - lo + SPAN - 1) // SPAN
        if parts.max(initial=1) > 1:
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            lo, hi = np.repeat(lo, parts) + nth * SPAN, np.repeat(hi, parts)
            hi = np.minimum(hi, lo + SPAN)
        self.lo, self.hi = lo, hi  # window starts lo..hi-1
        self.key = textvec.mix(least[lo]) >> np.uint64(64 - 8 * _TAG)
        self.row = np.searchsorted(self.offsets, lo, side="right") - 1


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(16)) * np.uint64(n) >> np.uint64(8 * _TAG - 16)).astype(np.int64)


def _ids(batch: pa.RecordBatch, id_col: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _anchors(id_col: str, text_col: str, n: int):
    """Phase 1, by block: (bucket, block, sorted anchors with the number of their documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in in_blocks(batches):
            keys, docs = [], []
            for body in parts:
                rows = unpack(body)
                w = _Windows(rows.column(rows.schema.get_field_index(text_col)), _ids(rows, id_col))
                order = np.lexsort((w.row, w.key))
                key, row = w.key[order], w.row[order]
                first = np.ones(len(key), dtype=bool)
                first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key, n_docs = np.unique(key[first], return_counts=True)
                keys.append(key)
                docs.append(n_docs)
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            docs = np.minimum(np.bincount(inverse, weights=np.concatenate(docs), minlength=len(key)), 65535).astype(np.uint16)
            cut = np.searchsorted(_bucket(key, n), np.arange(n + 1))
            some = np.flatnonzero(np.diff(cut)).tolist()
            data = [_pack(key=np.diff(key[cut[b] : cut[b + 1]], prepend=np.uint64(0)), docs=docs[cut[b] : cut[b + 1]]) for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), pa.array([block] * len(some), type=pa.int64()), pa.array(data, type=pa.binary())], names=["bucket", "block", "data"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 2, by bucket: (block, its anchors that other documents have too, which of them are hot)."""
    for _, table in sorted_groups(batches, ["bucket"]):
        from_ = table["block"].to_pylist()
        parts = [_unpack(x) for x in table["data"].to_pylist()]
        keys = [np.cumsum(p["key"], dtype=np.uint64) for p in parts]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([p["docs"] for p in parts]), minlength=len(every))
        at = 0
        for block, key in zip(from_, keys, strict=True):
            count = total[inverse[at : at + len(key)]]
            at += len(key)
            more = count > 1
            if more.any():
                data = _pack(key=np.diff(key[more], prepend=np.uint64(0)), hot=(count[more] >= HOT).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([block], type=pa.int64()), pa.array([data], type=pa.binary())], names=["block", "data"])


def front_code(records: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(common prefix lengths with the record before, lengths, the rest of each record) of sorted records."""
    lengths = np.array([len(r) for r in records], dtype=np.int64)
    at = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(records), dtype=np.uint8)
    known = np.zeros(len(records), dtype=np.int64)
    live = np.arange(1, len(records))
    depth = 0
    while len(live):
        live = live[(lengths[live] > depth) & (lengths[live - 1] > depth)]
        live = live[flat[at[live] + depth] == flat[at[live - 1] + depth]]
        depth += 1
        known[live] = depth
    keep = np.ones(len(flat), dtype=bool)
    inside = np.zeros(len(flat) + 1, dtype=np.int32)
    np.add.at(inside, at, (known > 0).astype(np.int32))
    np.add.at(inside, at + known, -(known > 0).astype(np.int32))
    keep = np.cumsum(inside[:-1]) == 0
    return known.astype(np.uint8), lengths.astype(np.uint8), flat[keep].tobytes()


def front_decode(known: np.ndarray, lengths: np.ndarray, rest: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for k, n in zip(known.tolist(), lengths.tolist(), strict=True):
        end = at + n - k
        before = before[:k] + rest[at:end]
        at = end
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, position, common prefix length with the string before) in sorted order, by a loser tree.

    ``runs``: sorted strings and their common prefix lengths with the one before. A player's ``have`` is the
    length of its common prefix with the last winner it met; the larger length wins unread, and only equal
    lengths are compared, from there on. Equal strings come in the order of their runs.
    """
    size = 1
    while size < len(runs):
        size *= 2
    strings = [r[0] for r in runs] + [[]] * (size - len(runs))
    known = [r[1] for r in runs] + [[]] * (size - len(runs))
    at, have = [0] * size, [0 if s else -1 for s in strings]
    current = [s[0] if s else b"" for s in strings]

    def beats(a: int, b: int) -> bool:
        """Whether a goes before b; the loser's length is then that with the winner."""
        ha, hb = have[a], have[b]
        if ha != hb:
            return ha > hb
        if ha < 0:
            return a < b
        x, y = current[a], current[b]
        if x == y:
            if a < b:
                have[b] = len(x)
                return True
            have[a] = len(x)
            return False
        n = min(len(x), len(y))
        apart = int.from_bytes(x[ha:n], "big") ^ int.from_bytes(y[ha:n], "big")
        same = n - (apart.bit_length() + 7) // 8
        if x < y:
            have[b] = same
            return True
        have[a] = same
        return False

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1]
    while have[top] >= 0:
        yield top, at[top], have[top]
        at[top] += 1
        if at[top] < len(strings[top]):
            current[top], have[top] = strings[top][at[top]], known[top][at[top]]
        else:
            current[top], have[top] = b"", -1
        node = (top + size) >> 1
        while node:
            rival = losers[node]
            if not beats(top, rival):
                losers[node], top = top, rival
            node >>= 1


def _suffixes(id_col: str, text_col: str, n: int):
    """Phase 3, by block: front-coded runs of shared suffixes by bucket, and what the block alone decides."""

    def shared_of(rows: pa.RecordBatch, keys: np.ndarray, hots: np.ndarray) -> tuple[list[bytes], np.ndarray, ...]:
        """The shared suffixes of one part: strings, keys, doc_ids, rows, first bytes and numbers of windows."""
        w = _Windows(rows.column(rows.schema.get_field_index(text_col)), _ids(rows, id_col))
        found = np.minimum(np.searchsorted(keys, w.key), len(keys) - 1)
        use = keys[found] == w.key
        hot = use & (hots[found] == 1)
        plain = use & ~hot
        lo, hi, key = w.lo[plain], w.hi[plain], w.key[plain]
        if hot.any():
            counts = w.hi[hot] - w.lo[hot]
            each = np.repeat(w.lo[hot] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            lo, hi = np.concatenate([lo, each]), np.concatenate([hi, each + 1])
            key = np.concatenate([key, textvec.mix(textvec.rolling_hash(w.buf, WINDOW)[each]) >> np.uint64(64 - 8 * _TAG)])
        raw = w.buf.tobytes()
        tags = key.astype(">u8").tobytes()
        records = [tags[8 * i + 2 : 8 * i + 8] + raw[a:b] for i, (a, b) in enumerate(zip(lo.tolist(), (hi + WINDOW - 1).tolist(), strict=True))]
        row = np.searchsorted(w.offsets, lo, side="right") - 1
        return records, key, w.ids[row], row, lo - w.offsets[row], hi - lo

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), table in sorted_groups(batches, ["block"]):
            told = [_unpack(x) for x in table["data"].to_pylist() if x is not None]
            if not told:
                continue
            keys = np.concatenate([np.cumsum(p["key"], dtype=np.uint64) for p in told])
            hots = np.concatenate([p["hot"] for p in told])
            order = np.argsort(keys)
            keys, hots = keys[order], hots[order]
            records, some = [], []
            for part, body in _bodies(table):
                own, key, ids, row, start, width = shared_of(unpack(body), keys, hots)
                records += own
                some.append((key, ids, row | part << _ROW_BITS, start, width))
            if not records:
                continue
            key, ids, row, start, width = (np.concatenate(x) for x in zip(*some, strict=True))
            # one suffix of equal ones goes on: those of larger doc_id hold nothing that the smallest has not
            order = sorted(range(len(records)), key=records.__getitem__)
            ranked = [records[i] for i in order]
            order = np.array(order)
            new = np.ones(len(order), dtype=bool)
            new[1:] = [a != b for a, b in zip(ranked, ranked[1:], strict=False)]
            group = np.cumsum(new) - 1
            least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
            later = ids[order] > least[group]
            row, start, width = row[order], start[order], width[order]
            done = _pack(row=row[later].astype(np.uint32), lo=start[later].astype(np.uint32), n=(width[later] + WINDOW - 1).astype(np.uint32))
            strings = [r for r, f in zip(ranked, new, strict=True) if f]
            keep = ~later
            owner, row, start = group[keep], row[keep], start[keep]
            cut = np.searchsorted(_bucket(key[order][new], n), np.arange(n + 1))
            out = [(-1, done)] if later.any() else []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                i, j = int(cut[b]), int(cut[b + 1])
                known, lengths, rest = front_code(strings[i:j])
                x, y = np.searchsorted(owner, [i, j])
                out.append((b, _pack(known=known, lengths=lengths, rest=rest, least=least[i:j], owner=np.diff(owner[x:y] - i, prepend=0).astype(np.uint32), row=row[x:y].astype(np.uint32), lo=start[x:y].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], type=pa.int32()), pa.array([block] * len(out), type=pa.int64()), pa.array([d for _, d in out], type=pa.binary())], names=["bucket", "block", "data"])

    return run


def _decide(strings: list[bytes], least: list[int], members: list[tuple[int, int, int]], out: list) -> None:
    """One anchor: appends (run, position in run, first window, windows) for what a smaller document has.

    members: (run, position, number of its string); least: the smallest doc_id by run and position, in order.
    """
    smallest: dict[int, int] = {}
    for (_, _, s), d in zip(members, least, strict=True):
        if d < smallest.get(s, _LAST + 1):
            smallest[s] = d
    windows: dict[bytes, int] = {}
    if len(strings) > 1:
        for s, text in enumerate(strings):
            d = smallest[s]
            for p in range(_TAG, len(text) - WINDOW + 1):
                x = text[p : p + WINDOW]
                if d < windows.get(x, _LAST + 1):
                    windows[x] = d
    for (run, at, s), d in zip(members, least, strict=True):
        text = strings[s]
        n = len(text) - WINDOW + 1 - _TAG
        if d > smallest[s]:
            out.append((run, at, 0, n))
        elif windows:
            begin = -1
            for p in range(n):
                if windows[text[p + _TAG : p + _TAG + WINDOW]] < d:
                    if begin < 0:
                        begin = p
                elif begin >= 0:
                    out.append((run, at, begin, p - begin))
                    begin = -1
            if begin >= 0:
                out.append((run, at, begin, n - begin))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 4, by bucket: merges the runs and answers each block with (row, first byte, bytes) to remove."""
    for (bucket,), table in sorted_groups(batches, ["bucket"]):
        blocks_ = table["block"].to_pylist()
        if bucket < 0:
            yield from (b for b in table.select(["block", "data"]).to_batches() if b.num_rows)
            continue
        parts = [_unpack(x) for x in table["data"].to_pylist()]
        runs = [(front_decode(p["known"], p["lengths"], p["rest"]), p["known"].tolist()) for p in parts]
        ids = [p["least"].tolist() for p in parts]
        found: list = []
        strings: list[bytes] = []
        members: list[tuple[int, int, int]] = []
        least: list[int] = []
        for run, at, same in merge_runs(runs):
            text = runs[run][0][at]
            if same < _TAG and members:
                if len(members) > 1:
                    _decide(strings, least, members, found)
                strings, members, least = [], [], []
            if not strings or same < len(text) or len(strings[-1]) != len(text):
                strings.append(text)
            members.append((run, at, len(strings) - 1))
            least.append(ids[run][at])
        if len(members) > 1:
            _decide(strings, least, members, found)
        if not found:
            continue
        found_ = np.array(found, dtype=np.int64)
        found_ = found_[np.argsort(found_[:, 0], kind="stable")]
        for run in np.unique(found_[:, 0]):
            own, p = found_[found_[:, 0] == run], parts[run]
            owner = np.cumsum(p["owner"].astype(np.int64))
            x = np.searchsorted(owner, own[:, 1])
            counts = np.searchsorted(owner, own[:, 1], side="right") - x
            which = np.repeat(x - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            first, n = np.repeat(own[:, 2], counts), np.repeat(own[:, 3], counts)
            data = _pack(row=p["row"][which], lo=(p["lo"][which] + first).astype(np.uint32), n=(n + WINDOW - 1).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([blocks_[run]], type=pa.int64()), pa.array([data], type=pa.binary())], names=["block", "data"])


#: The columns that a report adds.
REPORT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}


def _apply(columns: list[str], text_col: str, replace: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in sorted_groups(batches, ["block"]):
            told = [_unpack(x) for x in table["data"].to_pylist() if x is not None]
            for part, body in _bodies(table):
                yield answer(unpack(body), part, told)

    def answer(rows: pa.RecordBatch, part: int, told: list[dict]) -> pa.RecordBatch:
        buf, offsets = textvec.string_buffer(rows.column(rows.schema.get_field_index(text_col)))
        mark = np.zeros(len(buf) + 1, dtype=np.int32)
        for p in told:
            own = p["row"] >> _ROW_BITS == part
            at = offsets[p["row"][own] & _ROW_MASK] + p["lo"][own]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + p["n"][own], -1)
        gone = np.cumsum(mark[:-1]) > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < len(buf)]
        begin[heads] = gone[heads]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        kept = buf[~gone]
        cut = offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]
        raw = kept.tobytes()
        texts = [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        removed = sums(gone)
        arrays = [rows.column(rows.schema.get_field_index(c)) for c in columns]
        if replace:
            new = [x.decode("utf-8", "ignore") if r else o for x, r, o in zip(texts, removed.tolist(), arrays[columns.index(text_col)].to_pylist(), strict=True)]
            arrays[columns.index(text_col)] = pa.array(new, type=pa.string())
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(np.diff(offsets)), pa.array(removed), pa.array(sums(begin)), pa.array([hashlib.sha256(x).hexdigest() for x in texts])],
            names=[*columns, *REPORT],
        )

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, replace: bool = False) -> DataFrame:
    """Rows of ``docs`` with n_bytes, n_removed, n_spans and kept_sha256 (lowercase hex of what stays).

    A byte is removed if a 50-byte string that covers it, within its document, also starts in a document with a
    smaller doc_id. All strings are judged on the input. ``columns`` names the columns to return (all by default);
    with ``replace`` the text, which must be among them, becomes what stays, without bytes that no longer form UTF-8.

    A null text counts as empty and stays null. A null doc_id counts as larger than all others; rows with one
    doc_id don't remove from each other. An empty table gives an empty result. ``docs`` may have any other columns;
    those named like an added one give way to it.
    """
    spark = docs.sparkSession
    columns = [c for c in columns or docs.columns if c not in REPORT]
    phases = Phases(spark, "suffix")
    stored = blocks(docs.select(*dict.fromkeys([*columns, id_col, text_col])), text_col, phases)
    n = partitions(spark)
    # each phase is written and the exchanges before it dropped, so that they never lie on disk together
    anchors = stored.mapInArrow(_anchors(id_col, text_col, n), "bucket int, block long, data binary")
    shared = phases.write(anchors.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_shared, "block long, data binary"), opaque=True)
    phases.settle()
    runs = _with_bodies(stored, shared, n).mapInArrow(_suffixes(id_col, text_col, n), "bucket int, block long, data binary")
    runs = runs.withColumn("to", F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.col("bucket").cast("long")))
    runs = runs.repartition(n, "to").sortWithinPartitions("bucket", "block").select("bucket", "block", "data")
    answers = phases.write(runs.mapInArrow(_merge, "block long, data binary"), opaque=True)
    phases.drop(shared)
    phases.settle()
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"{c} {t}" for c, t in REPORT.items())])
    out = _with_bodies(stored, answers, n).mapInArrow(_apply(columns, text_col, replace), fields)
    if replace:
        return out  # whoever writes the texts can drop what they came from: scratch.release()
    out = phases.write(out)
    phases.drop(stored, answers)
    return out


def _with_bodies(stored: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    both = stored.selectExpr("block", "part", "body", "cast(null as binary) data").union(answers.selectExpr("block", "cast(null as int) part", "cast(null as binary) body", "data"))
    return both.repartition(n, "block").sortWithinPartitions("block", "part")


def _bodies(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    """(part, body) of a block's rows, one at a time."""
    for part, body in zip(table["part"], table["body"], strict=True):
        if body.is_valid:
            yield part.as_py(), body.as_py()

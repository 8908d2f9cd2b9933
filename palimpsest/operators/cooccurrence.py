"""Terms that share documents, counted as numbers: blocks of documents, each term's row by itself, no pair as a row of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed

#: Documents of a block, parts that a block's terms are dealt to, and numbers of terms (a power of two) that one row of partial sums spans.
BLOCK, PARTS, SPAN = 100_000, 8, 16


def _sums(lists: pa.Array, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(term, other terms, common documents) of each wanted term of a block's lists."""
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    places = np.flatnonzero(wanted[values])
    if not len(places):
        return
    places = places[np.argsort(values[places], kind="stable")]
    terms, starts = np.unique(values[places], return_index=True)
    doc = np.searchsorted(offsets, places, side="right") - 1
    for term, rows in zip(terms.tolist(), np.split(doc, starts[1:]), strict=True):
        n = sizes[rows]
        # the lists of these documents, end to end
        at = np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        found = values[at]
        if len(found) * 8 > len(wanted):
            sums = np.bincount(found, minlength=len(wanted))
            others = np.flatnonzero(sums)
            sums = sums[others]
        else:
            others, sums = np.unique(found, return_counts=True)
        keep = others != term
        yield term, others[keep].astype(np.int32), sums[keep].astype(np.int32)


def closest(lists: DataFrame, df: DataFrame, *, least_pairs: int, top: int, most: int) -> DataFrame:
    """(term, synonym, df_a, association_q16, co): the ``top`` synonyms of each of the ``most`` most frequent terms of ``df``
    (term, df) that have any, from (doc_id, terms).

    The vocabulary, which grows far slower than the texts, comes to the driver and goes to every task; lists become
    numbers in the order of the terms and are dealt into blocks. What a block has of a term's row is shuffled as arrays."""
    spark = lists.sparkSession
    sized = df.select("term", "df").toArrow().sort_by("term")
    vocabulary, size = sized["term"].combine_chunks(), sized["df"].to_numpy().astype(np.int64)
    order = np.lexsort((np.arange(len(size)), -size))
    shared = spark.sparkContext.broadcast((vocabulary, size))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value[0]
        for batch in batches:
            column = batch.column(1)
            found = pc.index_in(column.flatten(), value_set=terms)
            owner = pc.list_parent_indices(column)
            known = pc.is_valid(found)
            found, owner = found.filter(known), owner.filter(known).to_numpy()
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(column))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), found.cast(pa.int32()))], names=["block", "ids"])

    n_docs = lists.count() if len(size) else 0
    blocks = max(-(-n_docs // BLOCK), 1)
    dealt = lists.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "terms").mapInArrow(numbered, "block long, ids array<int>")
    n, done = min(len(size), most + most // 50 + 16), 0
    while True:
        chosen = order[:n]

        def partial(table: pa.Table) -> pa.Table:
            part, wanted = table["part"][0].as_py(), np.zeros(len(shared.value[1]), bool)
            wanted[chosen[chosen % PARTS == part]] = True
            out: list[tuple] = []
            for term, others, sums in _sums(table["ids"].combine_chunks(), wanted):
                span = others >> SPAN
                cuts = np.flatnonzero(np.diff(span)) + 1
                out += [(term, int(o[0]) >> SPAN, o.tobytes(), s.tobytes()) for o, s in zip(np.split(others, cuts), np.split(sums, cuts), strict=True) if len(o)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["a", "span", "ids", "sums"])

        def best(table: pa.Table) -> pa.Table:
            a, span, df_of = table["a"][0].as_py(), table["span"][0].as_py(), shared.value[1]
            co = np.zeros(1 << SPAN, np.int64)
            for ids, sums in zip(table["ids"], table["sums"], strict=True):
                co[np.frombuffer(ids.as_buffer(), np.int32) - (span << SPAN)] += np.frombuffer(sums.as_buffer(), np.int32)
            b = np.flatnonzero(co >= least_pairs)
            co, b = co[b], b + (span << SPAN)
            like = co * fixed.ONE // np.minimum(df_of[a], df_of[b])
            first = np.lexsort((b, -co, -like))[:top]
            return pa.Table.from_arrays([pa.array(np.full(len(first), a), pa.int32()), pa.array(b[first], pa.int32()), pa.array(like[first]), pa.array(co[first])], names=["a", "b", "association_q16", "co"])

        parts = dealt.withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS)))))
        sums = parts.groupBy("block", "part").applyInArrow(partial, "a int, span int, ids binary, sums binary")
        per = sums.groupBy("a", "span").applyInArrow(best, "a int, b int, association_q16 long, co long")
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("association_q16"), F.desc("co"), "b"))
        got = per.withColumn("rn", rank).filter(F.col("rn") <= top).drop("rn").toArrow()  # ``top`` rows a chosen term at most
        done = len(pc.unique(got["a"]))
        if done >= most or n >= len(size):
            break
        n = min(len(size), n * 2)
    a, b = got["a"].to_numpy(), got["b"].to_numpy()
    out = pa.table({"term": vocabulary.take(pa.array(a)), "synonym": vocabulary.take(pa.array(b)), "df_a": pa.array(size[a]), "association_q16": got["association_q16"], "co": got["co"]})
    return spark.createDataFrame(out, "term string, synonym string, df_a long, association_q16 long, co long")

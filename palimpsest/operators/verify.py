"""Verification of facts against evidence: support, contradiction, guards and verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import evidence as say
from palimpsest.functions import fixed
from palimpsest.functions.text import tokens

_MATCH = "fact_id long, cell_id long, trust_q16 int, cited boolean, support_kind string, support_q16 int, contradiction_kind string, contradiction_q16 int, guards array<string>"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _MATCH.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for fact_id, cell_id, trust, cited, fact, text, valid_from, valid_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fact = fact or ""
            held, apart = say.support(fact, text), say.numeric_mismatch(fact, text)
            asked = say.query_range(fact)
            stale = say.stale_reason(asked, valid_from, valid_to) if asked else None
            guards = ([] if cited or not held else ["missing_citation"]) + (["numeric_mismatch"] if apart else []) + (["stale_fact"] if stale else [])
            against = "numeric" if apart else "text" if say.contradicts(fact, text) else None
            kind, score = held if held and not against and not stale else (None, 0)
            out.append((fact_id, cell_id, trust, cited, kind, score, against, say.CONTRADICTED if against else 0, guards))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string())]
        columns = zip(*out, strict=True) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def matches(facts: DataFrame, evidence: DataFrame, on: str) -> DataFrame:
    """Each fact (fact_id, fact, ``on``) with each text of the evidence (cell_id, body_text, trust_q16, citation, valid_from,
    valid_to, ``on``) of the same key, as it supports or contradicts the fact; texts that do neither, and have no
    guard, are left out. Texts without their fact's key are never looked at."""
    key = facts["fact_id"] if on == "fact_id" else F.col("fact_id")
    # a join by shuffle: the judging costs more than the rows, and a broadcast would leave it to the tasks of the scan
    pairs = facts.hint("merge").join(evidence, on).select(key.alias("fact_id"), "cell_id", "trust_q16", F.coalesce(F.trim("citation") != "", F.lit(False)).alias("cited"), "fact", "body_text", "valid_from", "valid_to")
    return pairs.mapInArrow(_judge, _MATCH).filter("support_q16 > 0 or contradiction_q16 > 0 or size(guards) > 0")


def verdicts(facts: DataFrame, found: DataFrame) -> DataFrame:
    """(fact_id, supporting, contradicting, status, confidence_q16): a side's confidence is the best of the lesser of match
    and trust, that of mixed evidence the lesser of both sides'."""
    side = lambda score: (F.count(F.when(F.col(score) > 0, 1)), F.coalesce(F.max(F.when(F.col(score) > 0, F.least(score, "trust_q16"))), F.lit(0)))
    (n_for, best_for), (n_against, best_against) = side("support_q16"), side("contradiction_q16")
    summed = facts.select("fact_id").join(found, "fact_id", "left").groupBy("fact_id").agg(n_for.alias("supporting"), n_against.alias("contradicting"), best_for.alias("s_"), best_against.alias("c_"))
    both, some, against = (F.col("supporting") > 0) & (F.col("contradicting") > 0), F.col("supporting") > 0, F.col("contradicting") > 0
    status = F.when(both, "mixed_evidence").when(some, "supported").when(against, "contradicted").otherwise("insufficient")
    confidence = F.when(both, F.least("s_", "c_")).when(some, F.col("s_")).when(against, F.col("c_")).otherwise(0)
    return summed.select("fact_id", "supporting", "contradicting", status.alias("status"), confidence.cast("long").alias("confidence_q16"))


def evidence_order(found: DataFrame, most: int = 8) -> DataFrame:
    """The ``most`` best texts of each fact: score, trust, then id."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("fact_id").orderBy(F.desc("support_q16"), F.desc("trust_q16"), "cell_id"))
    return found.filter("support_q16 > 0").withColumn("rn", rank.cast("long")).filter(F.col("rn") <= most).select("fact_id", "rn", "cell_id", "support_kind")


#: Spellings of the relation between facts that contradict each other.
CONTRADICTS = ("fact_contradicts_fact", "contradicts_fact", "contradicts")


def graph_contradictions(facts: DataFrame, relations: DataFrame, on: str) -> DataFrame:
    """(fact_id, cell_id, matched_terms, match_q16, trust_q16, citation): relations (cell_id, subject, predicate, object,
    trust_q16, citation, ``on``) that say a fact contradicts another, for each fact of the same key.

    The other fact stands in words, so an object that only names a cell counts not at all. At least one term is taken to
    match; a relation without a citation cites the source that an end of it names."""
    said = F.regexp_replace(F.lower(F.trim("predicate")), r"[ -]", "_").isin(*CONTRADICTS) & ~F.rlike(F.trim("object"), F.lit(r"^cell:\d+$"))
    found = relations.filter(F.col("object").isNotNull() & said)
    end = lambda c: F.nullif(F.regexp_extract(F.trim(c), "^source:(.+)$", 1), F.lit(""))
    key = facts["fact_id"] if on == "fact_id" else F.col("fact_id")
    both = facts.join(found, on).withColumn("terms_", tokens(F.col("fact"))).withColumn("own_", tokens(F.col("object")))
    matched = F.greatest(F.size(F.filter("terms_", lambda t: F.array_contains(F.col("own_"), t))), F.lit(1))
    score = F.when(F.size("terms_") == 0, 0).otherwise(F.least(fixed.div(matched * fixed.ONE, F.size("terms_")), F.lit(fixed.ONE)))
    return both.select(key.alias("fact_id"), "cell_id", matched.cast("long").alias("matched_terms"), score.cast("long").alias("match_q16"), "trust_q16", F.coalesce(F.nullif(F.trim("citation"), F.lit("")), end("subject"), end("object")).alias("citation"))

"""Mixing sources to target weights, by weighted sampling without replacement (operator 4). Native SQL only.

Method: Efraimidis and Spirakis (2006). A document's key is ``-ln(u) / w``: ``u`` in (0, 1) from a hash of its id,
``w`` its quality weight. Ascending keys are a weighted sample without replacement, to any length.

Targets are filled like water: ``min(CAP * size of the source, level * weight of the source)`` with the one level at
which they sum to the budget; that is where handing the excess over again and again by weight ends. A source's complete
epochs come first; what is left of its target is taken from its documents in key order, the last one in part.

The prefix sum within a source is taken in two steps, over key ranges and within them, so a source with most of the
rows is spread over as many tasks as its rows ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Phases

CAP, WEIGHTS = 3, (1, 2, 3)
#: About as many documents of a source to a key range.
RANGE_ROWS = 2000
WORD = r"[^\x20\x09-\x0D]+"
#: Quality weights by label; documents without one weigh 1.
GOOD, POOR = 2.0, 0.5


def size_of(text: str) -> F.Column:
    """Number of words: the places where one begins."""
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " +"), lambda x: x != "")).cast("long")


def uniform_of(id_col: str) -> F.Column:
    """A number in (0, 1) from the MD5 of the id's text."""
    return (F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, *, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, all sources in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("weight", weight).withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    # sources are full in the order of most / weight; the level is right at the first that isn't, and falls from there on
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    fits = named.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(every))
    # a share is never above the cap: where no level fits, all sources are empty
    return fits.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted).

    ``quality``: (doc_id, quality) labels, 1 good and 0 poor; repeated labels count by their best. Null sources are one
    source, the last by name; null texts have size 0. Rows with one id have one key and follow each other; ties of equal
    keys go by size. Null ids are drawn as one id. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), docs[text_col].alias("text")).withColumn("size", size_of("text")).drop("text")
    if quality is not None:
        best = quality.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        rows = rows.join(best, "doc_id", "left").withColumn("w", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, POOR).otherwise(1.0)).drop("quality")
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    phases = Phases(docs.sparkSession, "mixing")
    # words are counted once; from here on only ids, sources, sizes and keys are read
    rows = phases.write(rows.select("doc_id", "source", "size", (-F.log(uniform_of("doc_id")) / F.col("w")).alias("key")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sums.select("source", "source_size"), cap=cap, weights=weights)
    plan = goal.join(sums.select(F.col("source").alias("s_"), "n"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("left_", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")).withColumnRenamed("source", "p_source")
    plan = phases.write(plan)
    # 1 - exp(-key) rises with the key and is about even, so its ranges are
    ranged = rows.join(F.broadcast(plan) if _few(plan) else plan, F.col("source").eqNullSafe(F.col("p_source")))
    ranged = ranged.withColumn("range_", F.floor((1 - F.exp(-F.col("key"))) * F.ceil(F.col("n") / RANGE_ROWS)).cast("long"))
    by_range = ranged.groupBy("p_source", "range_").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("p_source").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_range.select(F.col("p_source").alias("b_source"), F.col("range_").alias("b_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("begins"))
    placed = ranged.join(begins, F.col("p_source").eqNullSafe(F.col("b_source")) & (F.col("range_") == F.col("b_range")))
    inside = Window.partitionBy("p_source", "range_").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.col("begins") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_") - F.col("ahead")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"))


def _few(plan: DataFrame, most: int = 100_000) -> bool:
    """Whether the sources are few enough to broadcast; counted, not assumed."""
    return plan.select("p_source").limit(most + 1).count() <= most


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` rows that the mix takes, with ``taken``; what it leaves out is dropped. A column of that name gives way."""
    docs = docs.drop("taken")
    own = "chosen_id"
    while own in docs.columns:
        own += "_"
    chosen = mix(docs, quality, id_col=id_col, text_col=text_col, source_col=source_col).filter("taken > 0").groupBy(F.col("doc_id").alias(own)).agg(F.max("taken").alias("taken"))
    return docs.join(chosen, F.col(id_col).eqNullSafe(F.col(own))).drop(own)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' +'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS UBIGINT) AS h
  FROM documents),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
k AS (
  SELECT d.doc_id, source, size, -ln((CAST(h AS DOUBLE) + 0.5) / 281474976710656.0) / (CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END) AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
n AS (SELECT *, CAST(((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS most FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
t AS (SELECT source, source_size, least(most, coalesce((SELECT max(level) FROM l WHERE level <= most / weight) * weight, 0.0)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM e),
p AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, r.epochs, r.rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM p
"""

"""Scoring and ranking: lexical and vector scores, blends, fusion, de-duplication, and the retrieval of a bound statement.

Corpus statistics are one row; that row, one number a query term, is all that reaches the driver.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed, intent, requirements, scopes
from palimpsest.functions.questions import anchors
from palimpsest.functions.text import python_tokens, tokens
from palimpsest.operators.relational import memory_decay
from palimpsest.plans.aql import FIELDS, AgentView, Both, Bound, Comparison, Not
from palimpsest.sources.cells import DEFAULT_TRUST

#: Lexical, semantic, recency and trust shares of each mode, in hundredths; the last takes the rounding.
MODE_WEIGHTS = {"fast": (55, 10, 25, 10), "balanced": (30, 35, 20, 15), "hybrid": (35, 35, 15, 15), "semantic": (15, 55, 15, 15), "audit": (20, 20, 20, 40)}
RRF_K, RRF_UNIT, RRF_LEXICAL, RRF_VECTOR = 60, 1_000_000, 32768, 32767


def mode_weights(mode: str) -> tuple[int, ...]:
    parts = [fixed.ONE * p // 100 for p in MODE_WEIGHTS[mode][:3]]
    return (*parts, fixed.ONE - sum(parts))


def where(node) -> Column:
    """A checked condition as a two-valued predicate."""
    if node is None:
        return F.lit(True)
    if isinstance(node, Not):
        return ~where(node.child)
    if isinstance(node, Both):
        a, b = where(node.left), where(node.right)
        return a & b if node.op == "and" else a | b
    assert isinstance(node, Comparison)
    items = [x.value for x in node.literal.value] if node.op == "IN" else [node.literal.value]
    return F.coalesce(F.col(FIELDS[node.field.lower()]).isin(*items), F.lit(False))


def readable(cells: DataFrame, view: AgentView) -> DataFrame:
    """Every plan over cells starts here."""
    return cells.filter(F.col("scope").isin(*sorted(view.readable_scopes)))


_held: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors; the last few of a session are, older ones are computed again if they're asked for."""
    df = df.persist()
    _held.append(df)
    while len(_held) > 4:
        _held.pop(0).unpersist()
    return df


def counts(cells: DataFrame, terms: list[str], text: str = "body_text") -> DataFrame:
    """``cells`` without the text, with its number of words as ``len_`` and that of each term as ``tf{i}_``: the one pass
    over the texts that a search needs."""
    split = cells.withColumn("toks_", tokens(F.col(text)))
    tf = [(F.size("toks_") - F.size(F.array_remove("toks_", t))).alias(f"tf{i}_") for i, t in enumerate(terms)]
    return hold(split.select(*(c for c in cells.columns if c != text), F.size("toks_").alias("len_"), *tf))


def bm25(cells: DataFrame, terms: list[str], text: str = "body_text", *, rarest: int | None = None, scale: int = 1_000_000) -> DataFrame:
    """``cells`` without the text, with ``lexical``: BM25 over the given rows' own statistics, in millionths.

    ``rarest``: score only so many terms, by ascending document frequency, longer ones and then alphabetical first.
    """
    return scored(cells, terms, text, rarest=rarest, scale=scale)[0]


def scored(cells: DataFrame, terms: list[str], text: str = "body_text", *, rarest: int | None = None, scale: int = 1_000_000) -> tuple[DataFrame, bool]:
    """bm25, and whether any row has a score."""
    terms = list(dict.fromkeys(terms))
    counted = counts(cells, terms, text)
    row = counted.agg(F.count("*").alias("n"), F.avg(F.greatest("len_", F.lit(1))).alias("avg"), *(F.count(F.when(F.col(f"tf{i}_") > 0, 1)).alias(f"df{i}") for i in range(len(terms)))).first()
    used = [i for i in range(len(terms)) if row[f"df{i}"]]
    if rarest is not None:
        used = sorted(used, key=lambda i: (row[f"df{i}"], -len(terms[i]), terms[i]))[:rarest]
    length = F.greatest(F.col("len_"), F.lit(1)) / F.lit(float(row["avg"] or 1))
    part = lambda i: F.lit(fixed.idf_float(row["n"], row[f"df{i}"])) * (F.col(f"tf{i}_") * F.lit(2.2)) / (F.col(f"tf{i}_") + F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * length))
    total = reduce(lambda a, b: a + b, (part(i) for i in used), F.lit(0.0))
    return counted.withColumn("lexical", F.round(total * scale).cast("long")).drop("len_", *(f"tf{i}_" for i in range(len(terms)))), bool(used)


#: Weights of a cell's fields.
FIELD_WEIGHTS = {"title": 8, "table": 6, "path": 5, "entity": 4, "chunk": 2, "other": 1}


def bm25f(cells: DataFrame, fields: dict[str, str], terms: list[str], *, scale: int = 1_000_000) -> DataFrame:
    """(cell_id, lexical): BM25 by field, each with its own lengths and average and its weight, one document frequency a
    term over all fields. ``fields``: the kind of each column."""
    terms = list(dict.fromkeys(terms))
    split = cells.select("cell_id", *(tokens(F.col(c)).alias(f"{c}_t") for c in fields))
    tf = [(F.size(f"{c}_t") - F.size(F.array_remove(f"{c}_t", t))).alias(f"{c}_tf{i}") for c in fields for i, t in enumerate(terms)]
    counted = hold(split.select("cell_id", *(F.size(f"{c}_t").alias(f"{c}_len") for c in fields), *tf))
    found = lambda i: reduce(lambda a, b: a | b, (F.col(f"{c}_tf{i}") > 0 for c in fields))
    # averages run over the cells that have the field
    row = counted.agg(F.count("*").alias("n"), *(F.avg(F.when(F.col(f"{c}_len") > 0, F.col(f"{c}_len"))).alias(f"{c}_avg") for c in fields), *(F.count(F.when(found(i), 1)).alias(f"df{i}") for i in range(len(terms)))).first()

    def part(c: str, kind: str, i: int) -> Column:
        n = F.col(f"{c}_tf{i}")
        length = F.greatest(F.col(f"{c}_len"), F.lit(1)) / F.lit(float(max(row[f"{c}_avg"] or 1, 1)))
        return F.lit(fixed.idf_float(row["n"], row[f"df{i}"]) * FIELD_WEIGHTS[kind]) * (n * F.lit(2.2)) / (n + F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * length))

    total = reduce(lambda a, b: a + b, (part(c, kind, i) for c, kind in fields.items() for i in range(len(terms))), F.lit(0.0))
    return counted.select("cell_id", F.round(total * scale).cast("long").alias("lexical"))


def quantised(vector: Column) -> Column:
    """Floats as 16-bit components in thousandths."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1000).cast("smallint"))


def vector_top(vectors: DataFrame, query: list[int], metric: str, k: int, id_col: str = "cell_id") -> DataFrame:
    """Best ``k`` rows by similarity, ids break ties; vectors of another length are no candidates."""
    literal = F.array(*(F.lit(x).cast("smallint") for x in query))
    own = vectors.filter(F.size("vector") == len(query)).select(id_col, fixed.similarity(F.col("vector"), literal, metric).cast("long").alias("score"))
    return own.orderBy(F.desc("score"), id_col).limit(k)


def rrf(lexical: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two lists (cell_id, score), each of bounded length."""
    order = Window.orderBy(F.desc("score"), "cell_id")

    def shares(df: DataFrame, weight: int) -> DataFrame:
        return df.select("cell_id", fixed.div(fixed.div(RRF_UNIT, RRF_K + F.row_number().over(order)) * weight, fixed.ONE).alias("score"))

    both = shares(lexical, RRF_LEXICAL).unionByName(shares(vector, RRF_VECTOR))
    return both.groupBy("cell_id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "cell_id").limit(k)


def ranged(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    row = df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return {c: (row[f"{c}_lo"] or 0, row[f"{c}_hi"] or 0) for c in columns}


def blend(pool: DataFrame, mode: str, *, recency_window: int | None = None, now: int | None = None) -> DataFrame:
    """``pool`` with ``score``: lexical, semantic, recency and trust by min-max, weighted by mode; times what is left of a
    memory's time to live where ``now`` is given."""
    pool = pool.withColumn("semantic", F.coalesce("semantic", F.lit(0)).cast("long")).withColumn("trust", F.col("source_trust_q16").cast("long"))
    span = ranged(pool, ["lexical", "semantic", "trust", "created_unix_seconds"])
    scaled = {c: fixed.min_max(F.col(c), *(F.lit(x).cast("long") for x in span[c])) for c in ("lexical", "semantic", "trust")}
    low, high = span["created_unix_seconds"]
    recency = F.coalesce(fixed.min_max(F.col("created_unix_seconds"), F.lit(low), F.lit(high)), F.lit(0))
    if recency_window is not None:
        recency = F.when(F.col("created_unix_seconds") >= high - recency_window, fixed.ONE).otherwise(recency)
    w = mode_weights(mode)
    total = fixed.div(scaled["lexical"] * w[0] + scaled["semantic"] * w[1] + recency * w[2] + scaled["trust"] * w[3], fixed.ONE)
    if now is not None and "ttl_seconds" in pool.columns:
        total = fixed.div(total * memory_decay(F.col("created_unix_seconds"), F.col("ttl_seconds"), now), fixed.ONE)
    return pool.withColumn("score", total.cast("long"))


def two_stage(pool: DataFrame, weight: int) -> DataFrame:
    """A bounded ranked pool (cell_id, score, semantic) ordered anew by position and dense score."""
    n, row = Window.partitionBy(), Window.orderBy(F.desc("score"), "cell_id")
    placed = pool.withColumn("i", F.row_number().over(row) - 1).withColumn("n", F.count("*").over(n))
    dense = fixed.min_max(F.col("semantic"), F.min("semantic").over(n), F.max("semantic").over(n))
    position = fixed.div((F.col("n") - F.col("i")) * fixed.ONE, F.col("n"))
    return placed.select("cell_id", fixed.div(position * (fixed.ONE - weight) + dense * weight, fixed.ONE).cast("long").alias("score"))


def dedup_content(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each content_hash; rows without one all stay."""
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy(*order))
    return df.withColumn("rn_", F.when(F.col("content_hash").isNull(), 1).otherwise(first)).filter("rn_ = 1").drop("rn_")


def quality(confidence_q16: int, trust_q16: int, freshness: int | None, valid_at: str | None, now: int, columns: list[str]) -> Column:
    """REQUIRE thresholds; what is missing fails freshness and counts as 0 elsewhere."""
    out = F.lit(True)
    if confidence_q16:
        out &= F.coalesce("confidence_q16", F.lit(0)) >= confidence_q16 if "confidence_q16" in columns else F.coalesce("source_trust_q16", F.lit(0)) >= confidence_q16
    if trust_q16:
        out &= F.coalesce("source_trust_q16", F.lit(0)) >= trust_q16
    if freshness is not None:
        out &= F.coalesce(F.lit(now) - F.col("created_unix_seconds") <= freshness, F.lit(False))
    if valid_at:
        out &= F.coalesce(F.col("valid_from") <= valid_at, F.lit(True)) & F.coalesce(F.lit(valid_at) <= F.col("valid_to"), F.lit(True))
    return out


def alive(now: int, columns: list[str]) -> Column:
    """Whether a cell isn't a memory whose time to live is over."""
    if "ttl_seconds" not in columns:
        return F.lit(True)
    over = (F.col("cell_type") == "memory") & (F.col("ttl_seconds") > 0) & (F.col("created_unix_seconds") + F.col("ttl_seconds") <= now)
    return ~F.coalesce(over, F.lit(False))


def retrieve(cells: DataFrame, bound: Bound, terms: list[str], now: int, *, dense: DataFrame | None = None) -> DataFrame:
    """Cells of a bound retrieval, in this order: scope and conditions, validity and lifetime, candidate-local BM25 and the
    cheap-rank budget (taken only where a term is found), quality thresholds, blend with memory decay, dense rerank,
    supersession, content de-duplication, limit. Diversity and the pack take rows in turn: see ``packs``.

    ``dense``: (cell_id, semantic) where the query has a vector."""
    columns = cells.columns
    pool = readable(cells, bound.view).filter(where(bound.where)).filter(quality(0, 0, None, bound.valid_at, now, columns)).filter(alive(now, columns))
    ranked, any_score = scored(pool, terms)
    if bound.limit and any_score:
        ranked = ranked.orderBy(F.desc("lexical"), "cell_id").limit(max(2 * bound.limit, bound.limit + 2))
    ranked = ranked.filter(quality(bound.confidence_q16, bound.trust_q16, bound.freshness, None, now, columns))
    ranked = ranked.join(dense, "cell_id", "left") if dense is not None else ranked.withColumn("semantic", F.lit(0).cast("long"))
    out = blend(ranked, bound.mode, recency_window=bound.recency_window, now=now)
    if bound.rerank_q16 and dense is not None:
        out = out.withColumnRenamed("score", "first_score").join(two_stage(out, bound.rerank_q16), "cell_id").drop("first_score")
    if bound.suppress_superseded and {"entity", "topic", "as_of"} <= set(columns):
        newest = F.row_number().over(Window.partitionBy("entity", "topic").orderBy(F.col("as_of").desc_nulls_last(), F.desc("created_unix_seconds"), F.desc("cell_id")))
        out = out.withColumn("rn_", F.when(F.col("entity").isNull() | F.col("topic").isNull(), 1).otherwise(newest)).filter("rn_ = 1").drop("rn_")
    out = dedup_content(out, [F.desc("score"), F.asc("cell_id")])
    return out.orderBy(F.desc("score"), "cell_id").limit(bound.limit)


#: What a covered requirement and a term of the question add, evidence by kind, the least evidence.
REQUIREMENT_BONUS, TERM_BONUS, EVIDENCE, LEAST_EVIDENCE, METADATA_SCALE = 2_500, 1_000, 2, 2, 1024


def hybrid_rerank(pool: DataFrame, question: str, *, text: str = "body_text", rules: tuple = intent.RULES) -> DataFrame:
    """A bounded pool (base, lexical, semantic, source_trust_q16, created_unix_seconds, ``text`` and the fields that
    scopes look at) with ``score``: the weighted scores of the question's profile, what the text holds of its anchors,
    sources, requirements, conditions and terms, and the scope; less where the text shows no evidence; and trust and
    recency within the pool."""
    lexical_w, semantic_w, anchor_w, source_w, scope_w, condition_w, gate, _ = intent.PROFILES[intent.profile_type(question, rules)]
    named = [list(dict.fromkeys(python_tokens(t))) for _, t in anchors(question)]
    sources, terms = requirements.source_hints(question), python_tokens(question)
    required, asked, wanted = requirements.requirements(question), requirements.conditions(question), scopes.directives(question)
    low = F.col("low_")
    has = lambda t: F.contains(low, F.lit(t)).cast("long")
    add = lambda parts: reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))

    @F.pandas_udf("long")
    def met(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: requirements.condition_bonus(asked, t))

    held = pool.withColumn("low_", F.lower(F.coalesce(F.col(text), F.lit(""))))
    held = held.withColumn("covered_", F.size(requirements.covered(low, required)).cast("long")).withColumn("met_", met(low) if asked else F.lit(0).cast("long")).withColumn("scope_", scopes.bonus(wanted, pool.columns))
    worth = add(has(t) for anchor in named for t in anchor) * anchor_w + add(map(has, sources)) * source_w + F.col("covered_") * REQUIREMENT_BONUS + F.col("met_") * condition_w + add(map(has, terms)) * TERM_BONUS + F.col("scope_") * scope_w
    some = lambda words: F.least(add(map(has, words)), F.lit(1))
    shown = (add(some(a) for a in named) + some(sources) + (F.col("met_") > 0).cast("long") + F.when(F.col("covered_") >= 2, F.col("covered_")).otherwise(0)) * EVIDENCE + add(has(t) for t in terms if len(t.encode()) >= 3 and t not in requirements.NO_EVIDENCE)
    total = F.coalesce("base", F.lit(0)) + F.coalesce("lexical", F.lit(0)) * lexical_w + F.coalesce("semantic", F.lit(0)) * semantic_w + worth
    gated = F.when(F.col(text).isNull() | (shown >= LEAST_EVIDENCE), total).otherwise(fixed.div(total * gate, F.lit(fixed.ONE)))
    trust_w, fresh_w = intent.metadata_weights(question, asked.dates is not None, rules)
    every, made = Window.partitionBy(), F.col("created_unix_seconds")
    # the pool is a ranked list of bounded length, so one task may hold it
    recency = F.coalesce(fixed.min_max(made, F.min(made).over(every), F.max(made).over(every)), F.lit(0))
    recency = F.when(made.isNull(), 0).otherwise(recency)
    part = lambda value, weight: fixed.div(value * METADATA_SCALE * F.lit(weight).cast("long"), F.lit(fixed.ONE).cast("long"))
    scored = gated + part(F.coalesce("source_trust_q16", F.lit(DEFAULT_TRUST)).cast("long"), trust_w) + part(recency.cast("long"), fresh_w)
    return held.withColumn("score", scored.cast("long")).drop("low_", "covered_", "met_", "scope_")

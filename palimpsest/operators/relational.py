"""Versions, lifecycles, claims, graphs and reports over cells, as joins, windows and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.operators.cooccurrence import closest

DECAY_SECONDS, VOTE = 30 * 86400, 5000


def snapshot(versions: DataFrame, seq: int, key: str = "cell_id") -> DataFrame:
    """The newest version of each key at ``seq``, unless it is a tombstone."""
    newest = versions.filter(F.col("created_seq") <= seq).groupBy(key).agg(F.max(F.struct("created_seq", *(c for c in versions.columns if c not in (key, "created_seq")))).alias("v"))
    return newest.select(key, "v.*").filter("not tombstone").drop("tombstone")


def changes_since(versions: DataFrame, seq: int, key: str = "cell_id") -> DataFrame:
    """Keys written after ``seq``: number of writes, of tombstones, the last sequence."""
    return versions.filter(F.col("created_seq") > seq).groupBy(key).agg(F.count("*").alias("n_writes"), F.count(F.when(F.col("tombstone"), 1)).alias("n_tombstones"), F.max("created_seq").alias("last_seq"))


def version_gc(versions: DataFrame, horizon: int, key: str = "cell_id") -> DataFrame:
    """Versions that a reader at ``horizon`` or later can see."""
    after = F.lead("created_seq").over(Window.partitionBy(key).orderBy("created_seq"))
    kept = versions.withColumn("next_", after).filter(F.col("next_").isNull() | (F.col("next_") > horizon))
    return kept.filter(~(F.col("tombstone") & F.col("next_").isNull() & (F.col("created_seq") <= horizon))).drop("next_")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order; nulls are lowest."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order)))
    return df.withColumn("rn_", rank).filter("rn_ = 1").drop("rn_")


def fact_chain(df: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """Every record with ``latest`` or the id of the latest as ``superseded_by``."""
    last = F.max(F.struct(*order, id_col)).over(Window.partitionBy(*keys))[id_col]
    return df.withColumn("latest", F.col(id_col) == last).withColumn("superseded_by", F.when(F.col(id_col) != last, last))


def duplicate_groups(df: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """Groups of equal hashes. Sizes and extremes only: members are found by joining on the hash."""
    return df.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias("canonical_id"), F.count("*").alias("n"), F.max(id_col).alias("last_id")).filter("n > 1")


def decayed_votes(df: DataFrame, now: int, key: str) -> DataFrame:
    """Feedback (key, useful, created) summed with a linear decay over 30 days; untimed votes count whole."""
    left = F.greatest(F.lit(0), F.lit(DECAY_SECONDS) - (F.lit(now) - F.col("created")))
    vote = F.when(F.col("created").isNull(), VOTE).otherwise(fixed.div(left * VOTE + DECAY_SECONDS // 2, DECAY_SECONDS))
    return df.groupBy(key).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("useful"), 1)).alias("n_useful"),
        (F.count(F.when(F.col("useful"), 1)) - F.count(F.when(~F.col("useful"), 1))).alias("net"), F.sum(F.when(F.col("useful"), vote).otherwise(-vote)).cast("long").alias("decayed"),
    )


def memory_decay(created: Column, ttl: Column, now: int) -> Column:
    """What is left of a memory's time to live, 0..65535; without one, all."""
    left = F.greatest(F.lit(0), F.least(ttl, created + ttl - now))
    return F.when(ttl.isNull() | (ttl == 0), fixed.ONE).otherwise(fixed.div(left * fixed.ONE + fixed.div(ttl, 2), ttl)).cast("long")


def numeric_conflicts(claims: DataFrame, *, days: int = 128) -> DataFrame:
    """Pairs of claims (id, subject, metric, value, valid_from, valid_to) that overlap in time and differ in value.

    Claims meet by subject, metric and time bucket, in the bucket where the later of the two begins, so that a long
    history of one key is spread over its time and every pair is found once."""
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    a = claims.select("subject", "metric", *(F.col(c).alias(f"{c}_a") for c in ("id", "value", "valid_from", "valid_to")), F.explode(F.sequence(number(F.col("valid_from")), number(F.col("valid_to")))).alias("bucket"))
    b = claims.select("subject", "metric", *(F.col(c).alias(f"{c}_b") for c in ("id", "value", "valid_from", "valid_to")), F.explode(F.sequence(number(F.col("valid_from")), number(F.col("valid_to")))).alias("bucket"))
    overlap = (F.col("valid_from_a") <= F.col("valid_to_b")) & (F.col("valid_from_b") <= F.col("valid_to_a"))
    once = F.col("bucket") == number(F.greatest("valid_from_a", "valid_from_b"))
    return a.join(b, ["subject", "metric", "bucket"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("value_a") != F.col("value_b")) & overlap & once).drop("bucket")


def khop(edges: DataFrame, start: list[str], hops: int) -> DataFrame:
    """(node, depth, proximity_q16) within ``hops`` of the start nodes; each level keeps only unseen nodes."""
    seen = edges.sparkSession.createDataFrame([(s, 0) for s in start], "node string, depth int")
    front = seen
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    for d in range(1, hops + 1):
        front = both.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen.withColumn("proximity_q16", fixed.div(F.lit(fixed.ONE), F.col("depth") + 1).cast("long"))


def synonym_pairs(docs: DataFrame, *, abbreviations: DataFrame | None = None, first: int = 64, least_df: int = 3, least_pairs: int = 2, top: int = 8, most: int = 10_000) -> DataFrame:
    """(term, synonym, association_q16, rn) from (doc_id, terms): ``first`` distinct terms of a document count, the
    ``most`` entries of the most frequent terms are kept with the ``top`` synonyms of each. Pairs of ``abbreviations``
    (term, synonym, co) are sure, both ways, and of whatever frequency.

    Pairs are counted within a document's bounded list, for the most frequent terms only: see ``cooccurrence``."""
    # the two passes over the lists read the texts once
    lists = docs.select("doc_id", F.slice(F.array_distinct("terms"), 1, first).alias("terms")).persist(StorageLevel.DISK_ONLY)
    every = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = every.filter(F.col("df") >= least_df)
    ways = lambda x: x.unionByName(x.select(F.col("synonym").alias("term"), F.col("term").alias("synonym"), "co"))
    scored = closest(lists, df, least_pairs=least_pairs, top=top, most=most)
    if abbreviations is None:
        lists.unpersist()
    else:
        from palimpsest.operators.retrieval import hold

        hold(lists)
        sure = ways(abbreviations.select("term", "synonym", "co")).join(every.withColumnRenamed("df", "df_a"), "term").withColumn("association_q16", F.lit(fixed.ONE).cast("long"))
        shape = ["term", "synonym", "df_a"]
        best = F.max(F.struct("association_q16", "co")).alias("b")
        scored = scored.select(*shape, "association_q16", "co").unionByName(sure.select(*shape, "association_q16", "co")).groupBy(*shape).agg(best).select(*shape, "b.*")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("association_q16"), F.desc("co"), "synonym"))
    kept = scored.withColumn("rn", rank).filter(F.col("rn") <= top)
    entries = kept.filter("rn = 1").orderBy(F.desc("df_a"), "term").limit(most).select("term")
    return kept.join(entries, "term").select("term", "synonym", "association_q16", F.col("rn").cast("long").alias("rn"))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(question, hits, recall, reciprocal_rank, average_precision, ndcg) from (question, doc, pos from 1) and gold pairs."""
    sizes = gold.groupBy("question").agg(F.count("*").alias("n_gold"))
    found = ranked.filter(F.col("pos") <= k).join(gold.withColumn("rel", F.lit(1)), ["question", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    upto = Window.partitionBy("question").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("so_far", F.sum("rel").over(upto))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    per = found.groupBy("question").agg(F.sum("rel").alias("hits"), F.max(F.col("rel") / F.col("pos")).alias("rr"), F.sum(F.col("rel") * F.col("so_far") / F.col("pos")).alias("ap"), F.sum(F.col("rel") / F.log2(F.col("pos") + 1.0)).alias("dcg"))
    return per.join(sizes, "question").select(
        "question", "hits", F.round(F.col("hits") / F.col("n_gold"), 6).alias("recall"), F.round("rr", 6).alias("reciprocal_rank"),
        F.round(F.col("ap") / F.least("n_gold", F.lit(k)), 6).alias("average_precision"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


def coverage(expected: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """One row: documents, embedded, missing, unexpected, of another dimension, coverage in hundredths of a percent."""
    both = expected.select("id", F.lit(1).alias("e")).join(vectors.select("id", F.size("vector").alias("dim")), "id", "full")
    row = both.agg(
        F.count("e").alias("total"), F.count(F.when(F.col("e").isNotNull() & (F.col("dim") == dimension), 1)).alias("embedded"), F.count(F.when(F.col("e").isNotNull() & F.col("dim").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("e").isNull(), 1)).alias("unexpected"), F.count(F.when(F.col("dim") != dimension, 1)).alias("wrong_dimension"),
    )
    return row.withColumn("coverage_bps", fixed.div(F.col("embedded") * 10000, F.col("total")).cast("long"))


def idempotent(requests: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """Each request as ``applied`` (first of its key), ``replayed`` (same payload again) or ``conflict``."""
    first = Window.partitionBy(key).orderBy(order)
    same = F.col(payload).eqNullSafe(F.first(payload).over(first))
    return requests.withColumn("outcome", F.when(F.row_number().over(first) == 1, "applied").when(same, "replayed").otherwise("conflict"))


def coverage_of_lines(expected: DataFrame, lines: DataFrame, *, dimension: int | None = None, model: str | None = None, least_bps: int = 10_000) -> DataFrame:
    """One row of counts over JSON lines (pos, value) of vectors against ``expected`` (doc_id, text_hash or null).

    A line counts once, as the first of: invalid (no JSON, id or vector), an empty vector, another dimension (than given,
    else than the first line's with a vector), an unexpected id, stale (another model or text), embedded, a duplicate of
    an embedded one. Lines are summed by what they say before they meet the ids, so a repeated id is one row."""
    shape = "doc_id string, vector array<double>, model string, text_hash string"
    read = lines.filter(F.trim("value") != "").select("pos", F.from_json("value", shape).alias("r")).select("pos", F.nullif(F.trim("r.doc_id"), F.lit("")).alias("id"), F.col("r.doc_id").alias("doc_id"), F.size("r.vector").alias("n"), F.col("r.vector").isNull().alias("no_vector"), "r.model", F.col("r.text_hash").alias("told_hash"))
    invalid = F.col("id").isNull() | F.col("no_vector")
    if dimension is None:
        first = read.filter(~invalid & (F.col("n") > 0)).agg(F.min_by("n", "pos").alias("n")).first()
        dimension = first["n"] if first else None
    fault = F.when(invalid, "invalid").when(F.col("n") == 0, "empty").when(F.col("n") != F.lit(dimension), "wrong_dimension")
    told = read.withColumn("fault", fault).groupBy(F.when(F.col("fault").isNull(), F.col("doc_id")).alias("doc_id"), "fault", F.when(F.col("fault").isNull(), F.col("model")).alias("model"), F.when(F.col("fault").isNull(), F.col("told_hash")).alias("told_hash")).agg(F.count("*").alias("rows"))
    wanted = expected.filter(F.trim("doc_id") != "").groupBy("doc_id").agg(F.max("text_hash").alias("text_hash"), F.lit(True).alias("expected"))
    joined = told.join(wanted, "doc_id", "full")
    stale = F.lit(False) if model is None else ~F.col("model").eqNullSafe(F.lit(model))
    stale |= F.col("text_hash").isNotNull() & ~F.col("told_hash").eqNullSafe(F.col("text_hash"))
    kind = F.when(F.col("rows").isNull(), "none").otherwise(F.coalesce("fault", F.when(F.col("expected").isNull(), "unexpected").when(stale, "stale").otherwise("good")))
    rows = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rows"))), F.lit(0))
    # an id's rows of different models may all be good; it is embedded once
    per = joined.withColumn("kind", kind).groupBy("doc_id", "expected").agg(*(rows(k).alias(k) for k in ("invalid", "empty", "wrong_dimension", "unexpected", "stale", "good")))
    total = lambda k: F.coalesce(F.sum(k), F.lit(0)).cast("long")
    out = per.agg(F.count("expected").alias("total_items"), F.count(F.when(F.col("good") > 0, 1)).alias("embedded_items"), total(F.greatest(F.col("good") - 1, F.lit(0))).alias("duplicate_items"), total("unexpected").alias("unexpected_items"), total("invalid").alias("invalid_rows"), total("empty").alias("empty_vector_rows"), total("wrong_dimension").alias("dimension_mismatch_rows"), total("stale").alias("stale_items"))
    bps = F.when(F.col("total_items") == 0, 10_000).otherwise(fixed.div(F.col("embedded_items") * 10_000, F.col("total_items"))).cast("long")
    faults = [c for c in out.columns if c not in ("total_items", "embedded_items")]
    clean = reduce(lambda a, b: a & b, (F.col(c) == 0 for c in faults))
    return out.withColumn("missing_items", F.col("total_items") - F.col("embedded_items")).withColumn("coverage_bps", bps).withColumn("production_ready", (F.col("coverage_bps") >= least_bps) & clean)


def neighbourhood(edges: DataFrame, seed: str, hops: int, *, entities: DataFrame | None = None, budget: int = 10_000) -> tuple[DataFrame, dict[str, int | bool]]:
    """Hits (cell_id, matched_entity, depth, proximity_q16, path) around a named entity, and what the walk took.

    ``edges``: (relation_id, subject, object); ``entities``: (cell_id, name). Entities are visited in the order they
    were found, their edges by relation_id, at most ``budget`` edges in all; the rest of the walk is dropped and said so
    (``budget_exceeded``). A hop is one join with the entities just found, and no more than ``budget`` rows of it come
    to the driver, so neither grows with the graph."""
    spark, seed = edges.sparkSession, seed.strip()
    shape = "at long, name string"
    ends = edges.select("relation_id", F.explode(F.array_distinct(F.array(F.struct(F.col("subject").alias("name"), F.col("object").alias("other")), F.struct(F.col("object").alias("name"), F.col("subject").alias("other"))))).alias("e")).select("relation_id", "e.*")
    hits: dict[int, tuple] = {}
    seen: dict[str, list[int]] = {seed: []} if seed else {}
    depth_of, front, taken, over, visited = {seed: 0}, list(seen), 0, False, 0
    for depth in range(1, hops + 1):
        if not front or over:
            break
        here = spark.createDataFrame(list(enumerate(front)), shape)
        found = ends.join(F.broadcast(here), "name").groupBy("at", "relation_id").agg(F.min("name").alias("name"), F.min("other").alias("other"))
        rows = found.orderBy("at", "relation_id").limit(budget - taken + 1).collect()
        over = len(rows) > budget - taken
        new = []
        for r in rows[: budget - taken]:
            other = (r["other"] or "").strip()
            if not other:
                continue
            path = [*seen[r["name"]], r["relation_id"]]
            hits.setdefault(r["relation_id"], (r["relation_id"], other, depth, fixed.ONE // (depth + 1), path))
            if other not in seen:
                seen[other], depth_of[other] = path, depth
                new.append(other)
        # past the budget, the entity whose edge is refused is the last one visited
        visited += rows[-1]["at"] + 1 if over else len(front)
        taken, front = taken + min(len(rows), budget - taken), new
    out = spark.createDataFrame(list(hits.values()), "cell_id long, matched_entity string, depth int, proximity_q16 int, path array<long>")
    if entities is not None:
        named = spark.createDataFrame([(n, depth_of[n], fixed.ONE // (depth_of[n] + 1) if depth_of[n] else fixed.ONE, p) for n, p in seen.items()], "name string, depth int, proximity_q16 int, path array<long>")
        out = out.unionByName(entities.join(F.broadcast(named), "name").select("cell_id", F.col("name").alias("matched_entity"), "depth", "proximity_q16", "path"))
    return out, {"visited_edges": taken, "visited_entities": visited + (0 if over else len(front)), "budget_exceeded": over}


def whole_neighbourhood(edges: DataFrame, seed: str, hops: int, *, entities: DataFrame | None = None) -> DataFrame:
    """The hits of ``neighbourhood`` without a budget: every relation within ``hops``, each with the path that finds it first.

    Nothing comes to the driver. The paths to the entities of a level are of one length and in the order in which the walk
    finds the entities, so that the least path is the first one and takes the place of a number in a queue."""
    spark, seed = edges.sparkSession, seed.strip()
    front = spark.range(1 if seed else 0).select(F.lit(seed).alias("name"), F.array().cast("array<long>").alias("path"))
    seen = front.withColumn("depth", F.lit(0))
    each = edges.select("relation_id", F.explode(F.array_distinct(F.array(F.struct(F.col("subject").alias("name"), F.col("object").alias("other")), F.struct(F.col("object").alias("name"), F.col("subject").alias("other"))))).alias("e"))
    ends = each.select("relation_id", "e.*").groupBy("name", "relation_id").agg(F.min("other").alias("other"))
    levels = []
    for depth in range(1, hops + 1):
        near = front if depth > 1 else F.broadcast(front)
        found = ends.join(near, "name").select("relation_id", F.trim("other").alias("name"), F.concat("path", F.array("relation_id")).alias("path")).filter("name <> ''")
        levels.append(found.withColumn("depth", F.lit(depth)))
        front = found.groupBy("name").agg(F.min("path").alias("path")).join(seen.select("name"), "name", "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    shape = "relation_id long, name string, path array<long>, depth int"
    every = reduce(DataFrame.unionByName, levels, spark.createDataFrame([], shape))
    proximity = F.when(F.col("depth") == 0, fixed.ONE).otherwise(fixed.div(F.lit(fixed.ONE), F.col("depth") + 1)).cast("int").alias("proximity_q16")
    first = every.groupBy("relation_id").agg(F.min(F.struct("depth", "path", "name")).alias("f")).select(F.col("relation_id").alias("cell_id"), "f.*")
    if entities is not None:
        first = first.unionByName(entities.join(seen, "name").select("cell_id", "depth", "path", "name"))
    return first.select("cell_id", F.col("name").alias("matched_entity"), "depth", proximity, "path")

"""Registered queries of scans, writes, logs, maintenance and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.text import tokens
from palimpsest.operators import lifecycle, relational, retrieval
from palimpsest.plans.catalog import _EDGES, _SECONDS, _TOKENS, _VERSIONS, EVENT_NOW, NOW, VIEW, _edges, _timed, _versions, query
from palimpsest.sources.cells import CORPUS_SQL, corpus, table

_AT = f"WITH {_VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY created_seq DESC) AS rn FROM v WHERE created_seq <= 6000)"


@query("point_get", f"{_AT} SELECT cell_id, created_seq, payload FROM r WHERE rn = 1 AND NOT tombstone AND cell_id = 7")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.point_get(_versions(spark, sf_dir), 7, 6000)


@query("range_scan", f"{_AT} SELECT cell_id, created_seq, payload FROM r WHERE rn = 1 AND NOT tombstone AND cell_id BETWEEN 10 AND 60")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.range_scan(_versions(spark, sf_dir), 10, 60, 6000)


@query("deleted_ids", f"{_AT} SELECT cell_id, created_seq AS deleted_seq FROM r WHERE rn = 1 AND tombstone")
def deleted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.deleted_ids(_versions(spark, sf_dir), 6000)


@query("descriptor_scan", f"WITH {CORPUS_SQL} SELECT cell_id, scope, status, cell_type, created_unix_seconds, source_trust_q16 FROM cells")
def descriptor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without texts: the text column isn't read."""
    return corpus(spark, sf_dir).select("cell_id", "scope", "status", "cell_type", "created_unix_seconds", "source_trust_q16")


@query("version_stats", f"WITH {_VERSIONS}, p AS (SELECT cell_id, count(*) AS n, count(*) FILTER (tombstone) AS t, arg_max(tombstone, created_seq) AS gone FROM v GROUP BY 1) SELECT count(*) AS cells, count(*) FILTER (NOT gone) AS live, count(*) FILTER (gone) AS deleted, CAST(sum(n) AS BIGINT) AS versions, CAST(sum(t) AS BIGINT) AS tombstones, max(n) AS depth FROM p")
def version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.version_stats(_versions(spark, sf_dir))


# a batch: each of the newest 500 events writes to the cell of the user before its own
_WRITES = "w AS (SELECT user_id + 1 AS cell_id, event_id % 500 AS pos, CASE event_id % 3 WHEN 0 THEN 'put' WHEN 1 THEN 'patch' ELSE 'tombstone' END AS op, CASE WHEN event_id % 6 = 1 THEN NULL ELSE value END AS payload FROM events WHERE event_id < 500)"


@query("apply_batch", f"WITH {_VERSIONS}, m AS (SELECT max(created_seq) AS top FROM v), {_WRITES}, l AS (SELECT cell_id, arg_max(payload, created_seq) AS old, arg_max(tombstone, created_seq) AS gone FROM v GROUP BY 1), n AS (SELECT w.cell_id, top + 1 + pos AS created_seq, CASE op WHEN 'patch' THEN coalesce(payload, CASE WHEN gone THEN NULL ELSE old END) WHEN 'put' THEN payload END AS payload, op = 'tombstone' AS tombstone FROM w CROSS JOIN m LEFT JOIN l USING (cell_id)), u AS (SELECT * FROM v UNION ALL SELECT * FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY created_seq DESC) AS rn FROM u) SELECT cell_id, created_seq, payload FROM r WHERE rn = 1 AND NOT tombstone")
def apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    top = versions.agg(F.coalesce(F.max("created_seq"), F.lit(0)).alias("top")).first()["top"]
    e = table(spark, sf_dir, "events").filter("event_id < 500")
    kind = F.col("event_id") % 3
    writes = e.select((F.col("user_id") + 1).alias("cell_id"), (F.col("event_id") % 500).alias("pos"), F.when(kind == 0, "put").when(kind == 1, "patch").otherwise("tombstone").alias("op"), F.when(F.col("event_id") % 6 != 1, F.col("value")).alias("payload"))
    return relational.snapshot(lifecycle.apply_batch(versions, writes, top + 1), 1 << 62)


@query("transaction_conflicts", f"WITH {_VERSIONS}, q AS (SELECT event_id AS tx_id, event_id AS base_seq, user_id AS cell_id FROM events WHERE event_type = 'purchase'), j AS (SELECT tx_id, cell_id, arg_max(tombstone, created_seq) AS gone FROM q JOIN v USING (cell_id) WHERE created_seq > base_seq GROUP BY 1, 2) SELECT tx_id, cell_id, CASE WHEN gone THEN 'deleted_after_base' ELSE 'written_after_base' END AS reason FROM j")
def transaction_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("tx_id"), F.col("event_id").alias("base_seq"), F.col("user_id").alias("cell_id"))
    return lifecycle.transaction_conflicts(_versions(spark, sf_dir), reads)


for _strict in (True, False):
    _cut = "batch < bb" if _strict else "seq < bs"

    @query(f"replay_{'strict' if _strict else 'best_effort'}", f"WITH l AS (SELECT event_id // 16 AS batch, event_id AS seq, value < 1000 AND event_id <> 777 AS ok FROM events), b AS (SELECT min(seq) AS bs, min(batch) AS bb FROM l WHERE NOT ok) SELECT batch, seq FROM l, b WHERE bs IS NULL OR {_cut}")
    def replay(spark: SparkSession, sf_dir: str, strict: bool = _strict) -> DataFrame:
        log = table(spark, sf_dir, "events").select(fixed.div(F.col("event_id"), 16).alias("batch"), F.col("event_id").alias("seq"), ((F.col("value") < 1000) & (F.col("event_id") != 777)).alias("ok"))
        return lifecycle.replay(log, strict=strict).select("batch", "seq")


@query("restore_to_seq", f"WITH {_VERSIONS} SELECT cell_id, created_seq, payload, tombstone FROM v WHERE created_seq <= 5000")
def restore_to_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).filter(F.col("created_seq") <= 5000)


_MEMORY = f"m AS (SELECT event_id AS cell_id, event_type AS memory_type, {_SECONDS} AS created, CASE event_type WHEN 'click' THEN 864000 WHEN 'view' THEN 1728000 END AS ttl_seconds FROM events)"


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    ttl = F.when(F.col("event_type") == "click", 864000).when(F.col("event_type") == "view", 1728000)
    return _timed(spark, sf_dir).select(F.col("event_id").alias("cell_id"), F.col("event_type").alias("memory_type"), "created", ttl.alias("ttl_seconds"))


@query("expiry_sweep", f"WITH {_MEMORY} SELECT cell_id, created + ttl_seconds AS expired_at FROM m WHERE ttl_seconds > 0 AND created + ttl_seconds <= {EVENT_NOW}")
def expiry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memories(spark, sf_dir)
    return rows.filter(lifecycle.expired(rows, EVENT_NOW)).select("cell_id", (F.col("created") + F.col("ttl_seconds")).alias("expired_at"))


@query("compression_candidates", f"WITH {_MEMORY} SELECT memory_type, row_number() OVER (PARTITION BY memory_type ORDER BY created, cell_id) AS rn, cell_id FROM m WHERE {EVENT_NOW} - created >= 1209600 AND cell_id % 5 <> 0")
def compression_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth memory has a summary already."""
    memories = _memories(spark, sf_dir)
    return lifecycle.compression_candidates(memories, EVENT_NOW, older_than=1209600, summarised=memories.filter("cell_id % 5 = 0"))


@query("compaction_plan", "WITH s AS (SELECT user_id % 3 AS space, user_id AS segment, CAST(count(*) * 4194304 AS BIGINT) AS n_bytes FROM events GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY space) AS n, row_number() OVER w AS rn, sum(n_bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM s WINDOW w AS (PARTITION BY space ORDER BY n_bytes, segment)) SELECT space, segment, n_bytes FROM r WHERE n >= 6 AND rn <= 4 AND upto <= 67108864")
def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).alias("space"), F.col("user_id").alias("segment")).agg((F.count("*") * (4 << 20)).alias("n_bytes"))
    return lifecycle.compaction_plan(segments)


@query("rate_windows", f"WITH r AS (SELECT event_id AS id, user_id AS key, {_SECONDS} AS created FROM events) SELECT id, CASE WHEN row_number() OVER (PARTITION BY key, created // 86400 ORDER BY created, id) <= 2 THEN 'accepted' ELSE 'deferred' END AS outcome FROM r")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _timed(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "created")
    return lifecycle.rate_windows(requests, seconds=86400, most=2).select("id", "outcome")


@query("recall_samples", "WITH r AS (SELECT event_id, event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events) SELECT event_id FROM r WHERE pos < 32 OR pos % 8 = 0")
def recall_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    return lifecycle.sampled(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), pos.alias("pos"))).select("event_id")


@query("job_progress", "WITH s AS (SELECT user_id AS job, event_id AS pos, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'step' END AS kind FROM events) SELECT job, count(*) FILTER (kind = 'step') AS n_steps, coalesce(arg_min(kind, pos) FILTER (kind <> 'step'), 'running') AS state FROM s GROUP BY 1")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("step")
    return lifecycle.job_progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("pos"), kind.alias("kind")))


@query("handoff_visible", "SELECT event_id AS id, event_id + user_id <= 6000 AS visible FROM events")
def handoff_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") + F.col("user_id")).alias("require_seq"))
    return lifecycle.visible_at(asked, 6000).select("id", "visible")


# candidate sets

@query("allowed_cells", f"WITH {CORPUS_SQL} SELECT cell_id FROM cells WHERE scope IN ('lang:en', 'lang:de', 'lang:fr') AND cell_id IN (SELECT vec_id FROM embeddings WHERE label < 3)")
def allowed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "embeddings").filter("label < 3").select(F.col("vec_id").alias("cell_id"))
    return retrieval.readable(corpus(spark, sf_dir), VIEW).join(allowed, "cell_id", "left_semi").select("cell_id")


_ANY = f"SELECT cell_id FROM seen WHERE len(list_filter({_TOKENS}, lambda x: x IN ('haha', 'enst'))) > 0"
_SEEN = f"{CORPUS_SQL}, seen AS (SELECT * FROM cells WHERE scope IN ('lang:en', 'lang:de', 'lang:fr'))"


def _any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.readable(corpus(spark, sf_dir), VIEW).filter(F.arrays_overlap(tokens(F.col("body_text")), F.array(F.lit("haha"), F.lit("enst"))))


@query("lexical_candidates", f"WITH {_SEEN} {_ANY}")
def lexical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _any_term(spark, sf_dir).select("cell_id")


@query("bitmap_and_lexical", f"WITH {_SEEN} {_ANY} AND status = 'ready'")
def bitmap_and_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _any_term(spark, sf_dir).filter("status = 'ready'").select("cell_id")


@query("segment_sets", f"WITH {CORPUS_SQL}, g AS (SELECT DISTINCT cell_id // 100 AS segment, scope, status FROM cells) SELECT DISTINCT segment FROM g WHERE scope = 'lang:en' AND segment IN (SELECT segment FROM g WHERE status = 'draft') UNION SELECT DISTINCT segment FROM g WHERE scope = 'lang:de'")
def segment_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that (hold English and drafts) or German, as set algebra over a small table of segments."""
    g = corpus(spark, sf_dir).select(fixed.div(F.col("cell_id"), 100).alias("segment"), "scope", "status").distinct()
    of = lambda condition: g.filter(condition).select("segment")
    return of("scope = 'lang:en'").intersect(of("status = 'draft'")).union(of("scope = 'lang:de'")).distinct()


@query("record_union", "SELECT s_nationkey AS key, 'supplier' AS kind FROM supplier UNION SELECT c_nationkey, 'customer' FROM customer")
def record_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("supplier").alias("kind"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.lit("customer").alias("kind"))
    return a.unionByName(b).distinct()


@query("session_cells", f"SELECT event_id FROM (SELECT *, {_SECONDS} AS created FROM events) WHERE user_id = 3 AND created + 1728000 > {EVENT_NOW}")
def session_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).filter((F.col("user_id") == 3) & (F.col("created") + 1728000 > EVENT_NOW)).select("event_id")


@query("denial_report", f"WITH {CORPUS_SQL} SELECT sha256(CAST(cell_id AS VARCHAR)) AS hashed_id, scope FROM cells WHERE scope NOT IN ('lang:en', 'lang:de', 'lang:fr') ORDER BY cell_id LIMIT 64")
def denial_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 64 denied cells, by hashed ids."""
    denied = corpus(spark, sf_dir).filter(~F.col("scope").isin(*sorted(VIEW.readable_scopes))).select("cell_id", "scope").orderBy("cell_id").limit(64)
    return denied.select(F.sha2(F.col("cell_id").cast("string"), 256).alias("hashed_id"), "scope")


@query("cardinality_estimates", f"WITH {CORPUS_SQL}, c AS (SELECT count(*) AS live, count(*) FILTER (scope = 'lang:en') AS en, count(*) FILTER (scope = 'lang:de') AS de, count(*) FILTER (status = 'draft') AS draft FROM cells) SELECT 'and' AS kind, CAST(least(en, draft) AS BIGINT) AS estimate FROM c UNION ALL SELECT 'or', least(en + de, live) FROM c UNION ALL SELECT 'not', live - draft FROM c")
def cardinality_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = corpus(spark, sf_dir).agg(F.count("*").alias("live"), *(F.count(F.when(c, 1)).alias(n) for n, c in (("en", F.col("scope") == "lang:en"), ("de", F.col("scope") == "lang:de"), ("draft", F.col("status") == "draft")))).first()
    counts, leaf = row.asDict(), lambda n: ("leaf", n)
    made = {"and": ("and", leaf("en"), leaf("draft")), "or": ("or", leaf("en"), leaf("de")), "not": ("not", leaf("draft"))}
    return spark.createDataFrame([(k, lifecycle.cardinality(counts, row["live"], x)) for k, x in made.items()], "kind string, estimate long")


# reports

@query("latency_percentiles", "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), p AS (SELECT unnest([50, 95, 99]) AS percent) SELECT percent, min(value) AS value FROM v, p WHERE rn >= ceil(percent * n / 100.0) GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.nearest_rank(table(spark, sf_dir, "events"), "value", [50, 95, 99])


@query("mrr_q16", "WITH r AS (SELECT label AS question, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS pos FROM embeddings), f AS (SELECT question, min(pos) FILTER (vec_id % 3 = 0) AS first FROM r GROUP BY 1) SELECT CAST(sum(coalesce(65535 // first, 0)) // count(*) AS BIGINT) AS mrr_q16 FROM f")
def mrr_q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    ranked = df.withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id")))
    first = ranked.groupBy("label").agg(F.min(F.when(F.col("vec_id") % 3 == 0, F.col("pos"))).alias("first"))
    share = F.coalesce(fixed.div(F.lit(fixed.ONE), F.col("first")), F.lit(0))
    return first.agg(fixed.div(F.sum(share), F.count("*")).cast("long").alias("mrr_q16"))


@query("ingestion_report", "SELECT count(*) AS seen, count(*) FILTER (text IS NOT NULL AND length(trim(text)) > 0) AS processed, count(*) FILTER (text IS NOT NULL AND length(trim(text)) = 0) AS skipped, count(*) FILTER (text IS NULL) AS invalid, count(*) FILTER (length(text) > 100000) AS warnings FROM documents")
def ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.length(F.trim("text")) > 0
    count = lambda c: F.count(F.when(c, 1))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("seen"), count(some).alias("processed"), count(~some).alias("skipped"), count(F.col("text").isNull()).alias("invalid"), count(F.length("text") > 100_000).alias("warnings"))


@query("duplicate_members", f"WITH {CORPUS_SQL} SELECT content_hash, min(cell_id) AS canonical_id, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY cell_id) AS members, count(DISTINCT source) AS n_sources FROM cells WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group as one list: for groups that are known to be small, as a report's are."""
    cells = corpus(spark, sf_dir).filter("content_hash is not null")
    grouped = cells.groupBy("content_hash").agg(F.min("cell_id").alias("canonical_id"), F.sort_array(F.collect_list("cell_id")).alias("m"), F.countDistinct("source").alias("n_sources"))
    return grouped.filter(F.size("m") > 1).select("content_hash", "canonical_id", F.concat_ws(",", F.transform("m", lambda x: x.cast("string"))).alias("members"), "n_sources")


@query("segment_top_terms", f"WITH {CORPUS_SQL}, t AS (SELECT scope, unnest({_TOKENS}) AS term FROM cells), c AS (SELECT scope, term, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, term) AS rn FROM c) SELECT scope, term, n, rn FROM r WHERE rn <= 16")
def segment_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus(spark, sf_dir).select("scope", F.explode(tokens(F.col("body_text"))).alias("term")).groupBy("scope", "term").agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("n"), "term")).cast("long")).filter("rn <= 16")


@query("relation_cells", f"WITH {_EDGES} SELECT md5(src || '|' || kind || '|' || dst) AS cell_key, 'relation' AS cell_type, src AS subject, kind AS predicate, dst AS object FROM e UNION ALL SELECT DISTINCT md5(n), 'entity', n, NULL, NULL FROM (SELECT src AS n FROM e UNION SELECT dst FROM e)")
def relation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    relations = edges.select(F.md5(F.concat_ws("|", "src", "kind", "dst")).alias("cell_key"), F.lit("relation").alias("cell_type"), F.col("src").alias("subject"), F.col("kind").alias("predicate"), F.col("dst").alias("object"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    none = F.lit(None).cast("string")
    return relations.unionByName(nodes.select(F.md5("n").alias("cell_key"), F.lit("entity").alias("cell_type"), F.col("n").alias("subject"), none.alias("predicate"), none.alias("object")))


@query("relation_facets", f"WITH {_EDGES} SELECT e.src, e.kind, e.dst, n_name AS facet FROM e LEFT JOIN nation ON e.dst = 'nation:' || n_nationkey")
def relation_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("dst"), F.col("n_name").alias("facet"))
    return _edges(spark, sf_dir).join(facets, "dst", "left").select("src", "kind", "dst", "facet")


@query("interval_overlap", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-02-10' AND CAST(o_orderdate AS DATE) + 30 >= DATE '1997-01-20'")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts valid at some time of a range; a range of the raw timestamp, which reaches the scan."""
    orders = table(spark, sf_dir, "orders")
    at = lambda text: F.lit(text).cast("date").cast(orders.schema["o_orderdate"].dataType)
    return orders.filter((F.col("o_orderdate") < at("1997-02-11")) & (F.col("o_orderdate") >= at("1996-12-21"))).select("o_orderkey")


@query("ann_overlap", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS vec FROM embeddings), p AS (SELECT vec_id, list_sum(list_transform(list_zip(vec, (SELECT vec FROM v WHERE vec_id = 0)), lambda z: z[1] * z[2])) AS full_, list_sum(list_transform(list_zip(vec[1:32], (SELECT vec[1:32] FROM v WHERE vec_id = 0)), lambda z: z[1] * z[2])) AS half_ FROM v), a AS (SELECT vec_id FROM p ORDER BY full_ DESC, vec_id LIMIT 50), b AS (SELECT vec_id FROM p ORDER BY half_ DESC, vec_id LIMIT 50) SELECT count(*) AS found, CAST(count(*) * 65535 // 50 AS BIGINT) AS recall_q16 FROM a JOIN b USING (vec_id)")
def ann_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of an approximate search (half of the dimensions) against the exact one."""
    from palimpsest.plans.catalog import _vectors

    df, q = _vectors(spark, sf_dir)
    score = lambda n: fixed.dot(F.slice("vector", 1, n), F.array(*(F.lit(x).cast("smallint") for x in q[:n])))
    top = lambda n: df.select("cell_id", score(n).alias("s")).orderBy(F.desc("s"), "cell_id").limit(50).select("cell_id")
    return top(64).join(top(32), "cell_id").agg(F.count("*").alias("found"), fixed.div(F.count("*") * fixed.ONE, 50).cast("long").alias("recall_q16"))


@query("freshness_categories", f"WITH {CORPUS_SQL}, a AS (SELECT cell_id, created_unix_seconds AS c, min(created_unix_seconds) OVER () AS lo, max(created_unix_seconds) OVER () AS hi FROM cells), q AS (SELECT cell_id, CAST(CASE WHEN hi = lo THEN 65535 ELSE (c - lo) * 65535 // (hi - lo) END AS BIGINT) AS freshness_q16 FROM a) SELECT cell_id, freshness_q16, CASE WHEN freshness_q16 <= 16383 THEN 'stale' WHEN freshness_q16 <= 39321 THEN 'older' WHEN freshness_q16 <= 58981 THEN 'recent' ELSE 'current' END AS category, freshness_q16 // 2 AS bonus FROM q")
def freshness_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = corpus(spark, sf_dir).select("cell_id", "created_unix_seconds")
    span = cells.agg(F.min("created_unix_seconds").alias("lo"), F.max("created_unix_seconds").alias("hi"))
    scaled = cells.crossJoin(F.broadcast(span)).withColumn("freshness_q16", fixed.min_max(F.col("created_unix_seconds"), F.col("lo"), F.col("hi")).cast("long"))  # one row
    q = F.col("freshness_q16")
    return scaled.select("cell_id", "freshness_q16", F.when(q.isNull(), "unknown").when(q < 16384, "stale").when(q < 39322, "older").when(q < 58982, "recent").otherwise("current").alias("category"), fixed.div(q, 2).alias("bonus"))


@query("citation_anomalies", f"WITH {CORPUS_SQL} SELECT cell_id, CASE WHEN source IS NULL OR trim(source) = '' THEN 'missing_citation' ELSE 'cited' END AS anomaly, CASE WHEN source IS NULL OR trim(source) = '' THEN 8 ELSE 0 END AS overhead FROM cells")
def citation_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required citations don't filter: cells without one are marked, and cost eight tokens more."""
    missing = F.coalesce(F.trim("source") == "", F.lit(True))
    return corpus(spark, sf_dir).select("cell_id", F.when(missing, "missing_citation").otherwise("cited").alias("anomaly"), F.when(missing, 8).otherwise(0).alias("overhead"))


@query("cell_explain", f"WITH {CORPUS_SQL} SELECT cell_id, CASE WHEN scope NOT IN ('lang:en', 'lang:de', 'lang:fr') THEN 'excluded_permission' WHEN status <> 'ready' THEN 'excluded_condition' WHEN {NOW} - created_unix_seconds > 5400000 THEN 'excluded_freshness' ELSE 'selected' END AS outcome FROM cells")
def cell_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    readable = F.col("scope").isin(*sorted(VIEW.readable_scopes))
    fresh = F.lit(NOW) - F.col("created_unix_seconds") <= 5_400_000
    return corpus(spark, sf_dir).select("cell_id", F.when(~readable, "excluded_permission").when(F.col("status") != "ready", "excluded_condition").when(~fresh, "excluded_freshness").otherwise("selected").alias("outcome"))

"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.text import estimate_tokens, python_tokens, tokens
from palimpsest.operators import packs, relational, retrieval
from palimpsest.plans.aql import AgentView, bind, parse
from palimpsest.sources.cells import CORPUS_SQL, EPOCH, corpus, json_leaves, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NOW = EPOCH + 2_000 * 3600
TASK = "estion enst haha ention"
TERMS = python_tokens(TASK)
VIEW = AgentView(frozenset({"lang:en", "lang:de", "lang:fr"}))
EVENT_NOW = 1_706_700_000

# the SQL's own constants, so that a wrong value on one side shows
_STOP = "'a', 'an', 'and', 'the', 'or', 'of', 'to', 'in', 'и', 'в', 'на', 'для', 'мен', 'және', 'с', 'со', 'за', 'от', 'до', 'по', 'о', 'об', 'у', 'да', 'де', 'та', 'те', 'үшін'"
_TOKENS = rf"list_filter(regexp_split_to_array(lower(coalesce(body_text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({_STOP}))"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _bm25_sql(source: str, weight_of: str = "sum") -> str:
    """CTEs scored(…): the rows of ``source`` with lexical."""
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
    part = " + ".join(f"(CASE WHEN df{i} = 0 THEN 0.0 ELSE greatest(0.0, ln((n + 1) / (df{i} + 0.5))) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * (greatest(len_, 1) / avg_))) END)" for i in range(len(TERMS)))
    return f"""split_ AS (SELECT *, {_TOKENS} AS toks FROM {source}),
counted AS (SELECT * EXCLUDE (toks), len(toks) AS len_, {tf} FROM split_),
stats AS (SELECT count(*) AS n, avg(greatest(len_, 1)) AS avg_, {df} FROM counted),
scored AS (SELECT counted.*, CAST(round(({part}) * 1000000) AS BIGINT) AS lexical FROM counted, stats)"""


def _blend_sql(mode: str, source: str) -> str:
    """CTE blended: ``source`` with score."""
    a, b, c, d = {"fast": (36044, 6553, 16383, 6555), "balanced": (19660, 22937, 13107, 9831), "hybrid": (22937, 22937, 9830, 9831), "semantic": (9830, 36044, 9830, 9831), "audit": (13107, 13107, 13107, 26214)}[mode]
    scale = lambda x: f"CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 65535 ELSE ({x} - min({x}) OVER ()) * 65535 // (max({x}) OVER () - min({x}) OVER ()) END"
    return f"blended AS (SELECT *, CAST((({scale('lexical')}) * {a} + ({scale('semantic')}) * {b} + ({scale('created_unix_seconds')}) * {c} + ({scale('CAST(source_trust_q16 AS BIGINT)')}) * {d}) // 65535 AS BIGINT) AS score FROM {source})"


# retrieval and filters

_SLICE = f'RETRIEVE CONTEXT FOR TASK "{TASK}" IN BRAIN default USING MODE fast WHERE scope = "lang:en" AND status IN ["ready"] LIMIT 20 CANDIDATES;'


@query("retrieve_minimum_slice", f"""WITH {CORPUS_SQL}, cand AS (SELECT * FROM cells WHERE scope = 'lang:en' AND status = 'ready'), {_bm25_sql('cand')},
pool AS (SELECT *, 0 AS semantic FROM scored ORDER BY lexical DESC, cell_id LIMIT 40), {_blend_sql('fast', 'pool')},
u AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY score DESC, cell_id) AS rn FROM blended)
SELECT cell_id, lexical, score FROM u WHERE rn = 1 ORDER BY score DESC, cell_id LIMIT 20""")
def retrieve_minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = bind(parse(_SLICE), VIEW)
    return retrieval.retrieve(corpus(spark, sf_dir), bound, python_tokens(bound.task), NOW).select("cell_id", "lexical", "score")


@query("retrieve_where_scope_status", f"WITH {CORPUS_SQL} SELECT cell_id, scope, status FROM cells WHERE scope IN ('lang:en', 'lang:de', 'lang:fr') AND (scope IN ('lang:en', 'lang:fr') AND NOT coalesce(status = 'draft', false) OR scope = 'lang:de')")
def retrieve_where_scope_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'RETRIEVE CONTEXT FOR TASK "x" IN BRAIN default WHERE scope IN ["lang:en", "lang:fr"] AND NOT status = "draft" OR scope = "lang:de";'
    bound = bind(parse(text), VIEW)
    return retrieval.readable(corpus(spark, sf_dir), VIEW).filter(retrieval.where(bound.where)).select("cell_id", "scope", "status")


@query("permission_denials", f"WITH {CORPUS_SQL} SELECT md5(CAST(cell_id AS VARCHAR)) AS hashed_id, scope FROM cells WHERE scope NOT IN ('lang:en', 'lang:de', 'lang:fr')")
def permission_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).filter(~F.col("scope").isin(*sorted(VIEW.readable_scopes))).select(F.md5(F.col("cell_id").cast("string")).alias("hashed_id"), "scope")


@query("quality_filter", f"WITH {CORPUS_SQL} SELECT cell_id, source_trust_q16 FROM cells WHERE source_trust_q16 >= 26214 AND {NOW} - created_unix_seconds <= 5400000")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = corpus(spark, sf_dir)
    return cells.filter(retrieval.quality(0, 26214, 5_400_000, None, NOW, cells.columns)).select("cell_id", "source_trust_q16")


@query("valid_at_filter", "SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS valid_from FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-15' AND CAST(o_orderdate AS DATE) + 30 >= DATE '1997-06-15'")
def valid_at_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", day.cast("string").alias("valid_from"), F.date_add(day, 30).cast("string").alias("valid_to"))
    return facts.filter(retrieval.quality(0, 0, None, "1997-06-15", NOW, facts.columns)).select("o_orderkey", "valid_from")


def _lexical(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return retrieval.bm25(retrieval.readable(corpus(spark, sf_dir), VIEW), TERMS, **options)


_READABLE = f"{CORPUS_SQL}, seen AS (SELECT * FROM cells WHERE scope IN ('lang:en', 'lang:de', 'lang:fr')), {_bm25_sql('seen')}"


@query("bm25_topk", f"WITH {_READABLE} SELECT cell_id, lexical FROM scored ORDER BY lexical DESC, cell_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("cell_id", "lexical").orderBy(F.desc("lexical"), "cell_id").limit(20)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), retrieval.quantised(F.col("embedding")).alias("vector"))
    row = df.filter("cell_id = 0").first()
    return df, list(row["vector"]) if row else []


_VEC = "v AS (SELECT vec_id AS cell_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS vec FROM embeddings), q AS (SELECT vec AS qv FROM v WHERE cell_id = 0), p AS (SELECT cell_id, list_sum(list_transform(list_zip(vec, qv), lambda z: z[1] * z[2])) AS d, list_sum(list_transform(vec, lambda z: z * z)) AS n, list_sum(list_transform(qv, lambda z: z * z)) AS m FROM v, q)"
_SIMILAR = {"dot": "greatest(d, 0)", "l2": "64 * 4294967296 - (n + m - 2 * d)", "cosine": "least(greatest(d, 0) * 65535 // (CAST(floor(sqrt(n)) AS BIGINT) * CAST(floor(sqrt(m)) AS BIGINT)), 65535)"}
for _metric, _sql in _SIMILAR.items():

    @query(f"vector_topk_{_metric}", f"WITH {_VEC} SELECT cell_id, CAST({_sql} AS BIGINT) AS score FROM p ORDER BY score DESC, cell_id LIMIT 20")
    def vector_topk(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        df, q = _vectors(spark, sf_dir)
        return retrieval.vector_top(df, q, metric, 20)


@query("hybrid_rrf", f"""WITH {_READABLE}, {_VEC},
a AS (SELECT cell_id, lexical AS score FROM scored ORDER BY lexical DESC, cell_id LIMIT 50), b AS (SELECT cell_id, {_SIMILAR['cosine']} AS score FROM p ORDER BY score DESC, cell_id LIMIT 50),
r AS (SELECT cell_id, 1000000 // (60 + row_number() OVER (ORDER BY score DESC, cell_id)) * 32768 // 65535 AS s FROM a UNION ALL SELECT cell_id, 1000000 // (60 + row_number() OVER (ORDER BY score DESC, cell_id)) * 32767 // 65535 FROM b)
SELECT cell_id, CAST(sum(s) AS BIGINT) AS score FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = _lexical(spark, sf_dir).select("cell_id", F.col("lexical").alias("score")).orderBy(F.desc("score"), "cell_id").limit(50)
    df, q = _vectors(spark, sf_dir)
    return retrieval.rrf(lexical, retrieval.vector_top(df, q, "cosine", 50), 20)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best by words, with the vectors' dot products."""
    df, q = _vectors(spark, sf_dir)
    dots = df.select("cell_id", F.greatest(fixed.dot(F.col("vector"), F.array(*(F.lit(x).cast("smallint") for x in q))), F.lit(0)).alias("semantic"))
    top = _lexical(spark, sf_dir).orderBy(F.desc("lexical"), "cell_id").limit(100)
    return top.join(dots, "cell_id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0)))


_POOL = f"{_READABLE}, {_VEC}, top_ AS (SELECT * FROM scored ORDER BY lexical DESC, cell_id LIMIT 100), pool AS (SELECT top_.*, CAST(coalesce(greatest(p.d, 0), 0) AS BIGINT) AS semantic FROM top_ LEFT JOIN p USING (cell_id))"
for _mode in retrieval.MODE_WEIGHTS:

    @query(f"blend_rank_{_mode}", f"WITH {_POOL}, {_blend_sql(_mode, 'pool')} SELECT cell_id, score FROM blended")
    def blend_rank(spark: SparkSession, sf_dir: str, mode: str = _mode) -> DataFrame:
        return retrieval.blend(_pool(spark, sf_dir), mode).select("cell_id", "score")


@query("two_stage_rerank", f"""WITH {_POOL}, i AS (SELECT cell_id, semantic, row_number() OVER (ORDER BY lexical DESC, cell_id) - 1 AS i, count(*) OVER () AS n, min(semantic) OVER () AS lo, max(semantic) OVER () AS hi FROM pool)
SELECT cell_id, CAST(((n - i) * 65535 // n * 45535 + (CASE WHEN hi = lo THEN 65535 ELSE (semantic - lo) * 65535 // (hi - lo) END) * 20000) // 65535 AS BIGINT) AS score FROM i""")
def two_stage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.two_stage(_pool(spark, sf_dir).withColumn("score", F.col("lexical")), 20000)


@query("dedup_content_hash", f"WITH {CORPUS_SQL}, u AS (SELECT cell_id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY created_unix_seconds DESC, cell_id) AS rn FROM cells) SELECT cell_id FROM u WHERE content_hash IS NULL OR rn = 1")
def dedup_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dedup_content(corpus(spark, sf_dir), [F.desc("created_unix_seconds"), F.asc("cell_id")]).select("cell_id")


@query("duplicate_groups", f"WITH {CORPUS_SQL} SELECT content_hash, min(cell_id) AS canonical_id, count(*) AS n, max(cell_id) AS last_id FROM cells WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicate_groups(corpus(spark, sf_dir), "content_hash", "cell_id")


# statistics

@query("corpus_term_stats", f"WITH {CORPUS_SQL}, t AS (SELECT cell_id, unnest({_TOKENS}) AS term FROM cells) SELECT term, count(DISTINCT cell_id) AS df, count(*) AS tf FROM t GROUP BY 1")
def corpus_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's terms are sorted within its row, so that both counts are sums of one partial aggregation by term."""
    sorted_ = corpus(spark, sf_dir).select(F.sort_array(tokens(F.col("body_text"))).alias("t"))
    each = sorted_.select(F.explode(F.zip_with("t", F.concat(F.array(F.lit("")), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))), lambda x, y: F.struct(x.alias("term"), F.when(x != y, 1).otherwise(0).alias("first")))).alias("x")).filter("x.term is not null")
    return each.groupBy(F.col("x.term").alias("term")).agg(F.sum("x.first").alias("df"), F.count("*").alias("tf"))


@query("segment_stats", f"WITH {CORPUS_SQL} SELECT scope, status, count(*) AS n, min(created_unix_seconds) AS first_created, max(created_unix_seconds) AS last_created, CAST(sum(length(body_text)) AS BIGINT) AS chars FROM cells GROUP BY 1, 2")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("scope", "status").agg(F.count("*").alias("n"), F.min("created_unix_seconds").alias("first_created"), F.max("created_unix_seconds").alias("last_created"), F.sum(F.length("body_text")).alias("chars"))


@query("answerability", f"""WITH {CORPUS_SQL}, w AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS term FROM (SELECT item_id, text AS body_text FROM benchmark)),
k AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM cells), c AS (SELECT item_id, count(*) AS required, count(k.term) AS covered FROM w LEFT JOIN k USING (term) GROUP BY 1)
SELECT item_id, required, covered, CAST(covered * 65535 // required AS BIGINT) AS ratio_q16, covered * 65535 // required >= 45000 AS sufficient FROM c""")
def answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    known = corpus(spark, sf_dir).select(F.explode(tokens(F.col("body_text"))).alias("term")).distinct().withColumn("known", F.lit(1))
    per = wanted.join(known, "term", "left").groupBy("item_id").agg(F.count("*").alias("required"), F.count("known").alias("covered"))
    ratio = fixed.div(F.col("covered") * fixed.ONE, F.col("required"))
    return per.withColumn("ratio_q16", ratio.cast("long")).withColumn("sufficient", F.col("ratio_q16") >= 45000)


@query("synonym_pairs", f"""WITH a AS (SELECT doc_id, {_TOKENS.replace('body_text', 'text')} AS toks FROM documents), u AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM a),
f AS (SELECT doc_id, term, min(pos) AS pos FROM u GROUP BY 1, 2), t AS (SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM f) WHERE rn <= 64),
d AS (SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 3), o AS (SELECT * FROM t JOIN d USING (term)),
c AS (SELECT a.term, b.term AS synonym, count(*) AS co, min(a.df) AS x, min(b.df) AS y FROM o a JOIN o b USING (doc_id) WHERE a.term <> b.term GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT term, synonym, x, co, CAST(co * 65535 // least(x, y) AS BIGINT) AS association_q16 FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY association_q16 DESC, co DESC, synonym) AS rn FROM s),
k AS (SELECT term FROM (SELECT DISTINCT term, x FROM s) ORDER BY x DESC, term LIMIT 10000) SELECT term, synonym, association_q16, rn FROM r JOIN k USING (term) WHERE rn <= 8""")
def synonym_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.synonym_pairs(table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("terms")))


@query("coverage_report", "WITH j AS (SELECT doc_id, vec_id, len(embedding) AS dim FROM documents FULL JOIN embeddings ON doc_id = vec_id) SELECT count(doc_id) AS total, count(*) FILTER (doc_id IS NOT NULL AND dim = 64) AS embedded, count(*) FILTER (doc_id IS NOT NULL AND vec_id IS NULL) AS missing, count(*) FILTER (doc_id IS NULL) AS unexpected, count(*) FILTER (dim <> 64) AS wrong_dimension, CAST(count(*) FILTER (doc_id IS NOT NULL AND dim = 64) * 10000 // count(doc_id) AS BIGINT) AS coverage_bps FROM j")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.coverage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 64)


@query("retrieval_metrics", """WITH r AS (SELECT e1.label AS question, e1.vec_id AS doc, row_number() OVER (PARTITION BY e1.label ORDER BY md5(CAST(e1.vec_id AS VARCHAR)), e1.vec_id) AS pos FROM embeddings e1),
g AS (SELECT label AS question, vec_id AS doc FROM embeddings WHERE vec_id % 3 = 0), n AS (SELECT question, count(*) AS n_gold FROM g GROUP BY 1),
f AS (SELECT r.question, pos, CASE WHEN g.doc IS NULL THEN 0 ELSE 1 END AS rel FROM r LEFT JOIN g ON r.question = g.question AND r.doc = g.doc WHERE pos <= 10),
c AS (SELECT *, sum(rel) OVER (PARTITION BY question ORDER BY pos) AS so_far FROM f),
m AS (SELECT question, CAST(sum(rel) AS BIGINT) AS hits, max(rel / pos) AS rr, sum(rel * so_far / pos) AS ap, sum(rel / log2(pos + 1)) AS dcg FROM c GROUP BY 1)
SELECT question, hits, round(hits / n_gold, 6) AS recall, round(rr, 6) AS reciprocal_rank, round(ap / least(n_gold, 10), 6) AS average_precision, round(dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM m JOIN n USING (question)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = table(spark, sf_dir, "embeddings").select(F.col("label").alias("question"), F.col("vec_id").alias("doc"))
    ranked = df.withColumn("pos", F.row_number().over(Window.partitionBy("question").orderBy(F.md5(F.col("doc").cast("string")), "doc")))
    return relational.ranking_metrics(ranked, df.filter("doc % 3 = 0"), 10)


# versions and lifecycles: events as versions of a user's cell

def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id"), F.col("event_id").alias("created_seq"), F.col("value").alias("payload"), (F.col("event_type") == "error").alias("tombstone"))


_VERSIONS = "v AS (SELECT user_id AS cell_id, event_id AS created_seq, value AS payload, event_type = 'error' AS tombstone FROM events)"


@query("snapshot_as_of_seq", f"WITH {_VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY created_seq DESC) AS rn FROM v WHERE created_seq <= 6000) SELECT cell_id, created_seq, payload FROM r WHERE rn = 1 AND NOT tombstone")
def snapshot_as_of_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.snapshot(_versions(spark, sf_dir), 6000)


@query("changes_since_seq", f"WITH {_VERSIONS} SELECT cell_id, count(*) AS n_writes, count(*) FILTER (tombstone) AS n_tombstones, max(created_seq) AS last_seq FROM v WHERE created_seq > 6000 GROUP BY 1")
def changes_since_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.changes_since(_versions(spark, sf_dir), 6000)


@query("version_gc", f"WITH {_VERSIONS}, n AS (SELECT *, lead(created_seq) OVER (PARTITION BY cell_id ORDER BY created_seq) AS nxt FROM v) SELECT cell_id, created_seq, payload, tombstone FROM n WHERE (nxt IS NULL OR nxt > 6000) AND NOT (tombstone AND nxt IS NULL AND created_seq <= 6000)")
def version_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.version_gc(_versions(spark, sf_dir), 6000)


_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("created", F.unix_timestamp(F.col("ts").cast("timestamp")))


@query("feedback_decay", f"WITH f AS (SELECT user_id AS cell_id, event_type = 'purchase' AS useful, greatest(0, 2592000 - ({EVENT_NOW} - {_SECONDS})) AS left_ FROM events WHERE event_type IN ('purchase', 'error')), w AS (SELECT *, (left_ * 5000 + 1296000) // 2592000 AS vote FROM f) SELECT cell_id, count(*) AS total, count(*) FILTER (useful) AS n_useful, count(*) FILTER (useful) - count(*) FILTER (NOT useful) AS net, CAST(sum(CASE WHEN useful THEN vote ELSE -vote END) AS BIGINT) AS decayed FROM w GROUP BY 1")
def feedback_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _timed(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").alias("cell_id"), (F.col("event_type") == "purchase").alias("useful"), "created")
    return relational.decayed_votes(votes, EVENT_NOW, "cell_id")


_TTL = "CASE event_type WHEN 'click' THEN 864000 WHEN 'view' THEN 1728000 WHEN 'error' THEN 0 END"


@query("memory_decay_scores", f"WITH m AS (SELECT event_id, {_SECONDS} AS created, {_TTL} AS ttl FROM events) SELECT event_id, CAST(CASE WHEN ttl IS NULL OR ttl = 0 THEN 65535 ELSE (greatest(0, least(ttl, created + ttl - {EVENT_NOW})) * 65535 + ttl // 2) // ttl END AS BIGINT) AS decay_q16, ttl IS NULL OR created + ttl > {EVENT_NOW} AS active FROM m")
def memory_decay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).withColumn("ttl", F.expr(_TTL).cast("long"))
    return rows.select("event_id", relational.memory_decay(F.col("created"), F.col("ttl"), EVENT_NOW).alias("decay_q16"), (F.col("ttl").isNull() | (F.col("created") + F.col("ttl") > EVENT_NOW)).alias("active"))


@query("idempotent_replay", "WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER w AS rn, first_value(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, CASE WHEN rn = 1 THEN 'applied' WHEN event_type IS NOT DISTINCT FROM first_type THEN 'replayed' ELSE 'conflict' END AS outcome FROM r")
def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.idempotent(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("event_id", "outcome")


@query("supersede_latest", "WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderpriority, o_orderkey FROM r WHERE rn = 1")
def supersede_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest_by(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("temporal_fact_chain", "WITH r AS (SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS last FROM orders) SELECT o_orderkey, o_orderkey = last AS latest, CASE WHEN o_orderkey <> last THEN last ELSE -1 END AS superseded_by FROM r")
def temporal_fact_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.fact_chain(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate"], "o_orderkey").select("o_orderkey", "latest", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


# joins

@query("parent_expand", "SELECT c.conv_id, c.turn, p.text IS NOT NULL AS has_parent, md5(coalesce(p.text, '')) AS parent_hash FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = 0 WHERE c.turn > 0")
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    parents = turns.filter("turn = 0").select("conv_id", F.col("text").alias("parent"))
    return turns.filter("turn > 0").join(parents, "conv_id", "left").select("conv_id", "turn", F.col("parent").isNotNull().alias("has_parent"), F.md5(F.coalesce("parent", F.lit(""))).alias("parent_hash"))


_CLAIMS = "c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS subject, l_partkey AS metric, CAST(l_quantity AS BIGINT) AS value, CAST(l_shipdate AS DATE) AS valid_from, CAST(l_shipdate AS DATE) + 90 AS valid_to FROM lineitem)"
_PAIRS = "p AS (SELECT a.subject, a.metric, a.id AS id_a, b.id AS id_b, a.value AS value_a, b.value AS value_b FROM c a JOIN c b ON a.subject = b.subject AND a.metric = b.metric AND a.id < b.id AND a.value <> b.value AND a.valid_from <= b.valid_to AND b.valid_from <= a.valid_to)"


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("metric"), F.col("l_quantity").cast("long").alias("value"), day.alias("valid_from"), F.date_add(day, 90).alias("valid_to"))


@query("numeric_conflicts", f"WITH {_CLAIMS}, {_PAIRS} SELECT subject, metric, id_a, id_b, value_a, value_b FROM p")
def numeric_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.numeric_conflicts(_claims(spark, sf_dir)).select("subject", "metric", "id_a", "id_b", "value_a", "value_b")


@query("visible_conflicts", f"WITH {_CLAIMS}, {_PAIRS}, v AS (SELECT subject, metric, value_a AS v FROM p UNION ALL SELECT subject, metric, value_b FROM p) SELECT subject, metric, count(DISTINCT v) AS n_values, CAST(count(DISTINCT v) * 65535 // (count(DISTINCT v) + 1) AS BIGINT) AS intensity_q16 FROM v GROUP BY 1, 2")
def visible_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = relational.numeric_conflicts(_claims(spark, sf_dir))
    values = pairs.select("subject", "metric", F.explode(F.array("value_a", "value_b")).alias("v"))
    per = values.groupBy("subject", "metric").agg(F.countDistinct("v").alias("n_values"))
    return per.withColumn("intensity_q16", fixed.div(F.col("n_values") * fixed.ONE, F.col("n_values") + 1).cast("long"))


_EDGES = "e AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'part_of' AS kind FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in' FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in' FROM customer)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    made = [("nation", "n_nationkey", "region", "n_regionkey", "part_of"), ("supplier", "s_suppkey", "nation", "s_nationkey", "located_in"), ("customer", "c_custkey", "nation", "c_nationkey", "located_in")]
    parts = [table(spark, sf_dir, a).select(node(a, x).alias("src"), node(b, y).alias("dst"), F.lit(k).alias("kind")) for a, x, b, y, k in made]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("graph_khop", f"WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT 'region:0' AS node, 0 AS depth UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON r.node = b.src WHERE r.depth < 3) SELECT node, min(depth) AS depth, CAST(65535 // (min(depth) + 1) AS BIGINT) AS proximity_q16 FROM r GROUP BY 1")
def graph_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.khop(_edges(spark, sf_dir), ["region:0"], 3)


@query("graph_neighbors", f"WITH {_EDGES} SELECT kind, dst, count(*) AS n, min(src) AS first_src FROM e GROUP BY 1, 2")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("kind", "dst").agg(F.count("*").alias("n"), F.min("src").alias("first_src"))


@query("tool_recommendation", "WITH t AS (SELECT p_partkey, list_distinct(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+')) AS w FROM part) SELECT p_partkey, CAST(len(list_filter(w, lambda x: x IN ('red', 'ring', 'economy'))) AS BIGINT) AS score FROM t WHERE len(list_filter(w, lambda x: x IN ('red', 'ring', 'economy'))) > 0 ORDER BY score DESC, p_partkey LIMIT 50")
def tool_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(tokens(F.concat_ws(" ", "p_name", "p_type")))
    scored = table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(words, F.array(*map(F.lit, ("red", "ring", "economy"))))).cast("long").alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "p_partkey").limit(50)


@query("table_chunks", "SELECT (p_partkey - 1) // 20 AS chunk, string_agg('row-' || (p_partkey + 1) || ': p_name: ' || p_name || ' | p_size: ' || p_size, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1".replace("(p_partkey - 1)", "p_partkey"))
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("row-"), (F.col("p_partkey") + 1).cast("string"), F.lit(": p_name: "), "p_name", F.lit(" | p_size: "), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select(fixed.div(F.col("p_partkey"), 20).alias("chunk"), "p_partkey", line.alias("line"))
    listed = rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "line"))).alias("rows"))
    return listed.select("chunk", F.concat_ws("\n", F.transform("rows", lambda r: r["line"])).alias("text"))


@query("json_flatten", "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_leaves(table(spark, sf_dir, "events"), "event_id", "props")


@query("rarest_terms_topk", f"""WITH {_READABLE}, t AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {i})" for i, t in enumerate(TERMS))}) v(term, i)),
d AS (SELECT term, i, (SELECT [{", ".join(f"df{i}" for i in range(len(TERMS)))}] FROM stats)[i + 1] AS df FROM t),
k AS (SELECT i FROM d WHERE df > 0 ORDER BY df, length(term) DESC, term LIMIT 2),
e AS (SELECT cell_id, len_, unnest([{", ".join(f"tf{i}" for i in range(len(TERMS)))}]) AS tf, unnest(range({len(TERMS)})) AS i FROM counted),
x AS (SELECT cell_id, CAST(round(sum(greatest(0.0, ln((n + 1) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * (greatest(len_, 1) / avg_)))) * 1000000) AS BIGINT) AS lexical FROM e JOIN k USING (i) JOIN d USING (i), stats GROUP BY 1)
SELECT cell_id, lexical FROM x ORDER BY lexical DESC, cell_id LIMIT 20""")
def rarest_terms_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, rarest=2).select("cell_id", "lexical").orderBy(F.desc("lexical"), "cell_id").limit(20)


@query("interval_stabbing", f"WITH {_CLAIMS} SELECT subject, count(*) AS n_valid, min(id) AS first_id FROM c WHERE valid_from <= DATE '1997-03-01' AND DATE '1997-03-01' <= valid_to GROUP BY 1")
def interval_stabbing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims valid at a date, by subject; a range of the raw timestamp, which reaches the scan."""
    day, kind = F.lit("1997-03-01").cast("date"), table(spark, sf_dir, "lineitem").schema["l_shipdate"].dataType
    rows = table(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") < F.date_add(day, 1).cast(kind)) & (F.col("l_shipdate") >= F.date_sub(day, 90).cast(kind)))
    valid = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("subject"))
    return valid.groupBy("subject").agg(F.count("*").alias("n_valid"), F.min("id").alias("first_id"))


@query("source_support", "WITH s AS (SELECT l_orderkey, l_suppkey, CAST(round(l_discount * 65535) AS BIGINT) AS trust, l_linenumber AS relation FROM lineitem), b AS (SELECT l_orderkey, max(trust) AS trust_q16, count(*) AS n_edges FROM s GROUP BY 1), r AS (SELECT s.l_orderkey, min(relation) AS relation FROM s JOIN b ON s.l_orderkey = b.l_orderkey AND s.trust = b.trust_q16 GROUP BY 1) SELECT o_orderkey, coalesce(trust_q16, 0) AS trust_q16, coalesce(relation, 0) AS relation, coalesce(n_edges, 0) AS n_edges FROM orders LEFT JOIN b ON o_orderkey = b.l_orderkey LEFT JOIN r ON o_orderkey = r.l_orderkey")
def source_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a fact with its most trusted support edge (the smallest of equals); facts without one stay, with the relation 0."""
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_discount") * 65535).cast("long").alias("trust"), F.col("l_linenumber").alias("relation"))
    best = edges.groupBy("l_orderkey").agg(F.max("trust").alias("trust"), F.max(F.struct("trust", -F.col("relation"))).alias("b"), F.count("*").alias("n"))
    facts = table(spark, sf_dir, "orders").select("o_orderkey").join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return facts.select("o_orderkey", F.coalesce("trust", F.lit(0)).alias("trust_q16"), F.coalesce(-F.col("b.col2"), F.lit(0)).alias("relation"), F.coalesce("n", F.lit(0)).alias("n_edges"))


@query("embedding_debt", "WITH j AS (SELECT doc_id, embedding, label FROM documents LEFT JOIN embeddings ON doc_id = vec_id), d AS (SELECT doc_id, CASE WHEN embedding IS NULL THEN 'missing_vector' WHEN len(embedding) <> 64 THEN 'dimension_mismatch' WHEN label < 2 THEN 'stale_model' END AS reason FROM j) SELECT reason, count(*) AS n, min(doc_id) AS first_id FROM d WHERE reason IS NOT NULL GROUP BY 1")
def embedding_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first reason to embed them again; labels below 2 stand for an older model."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"), "label")
    both = table(spark, sf_dir, "documents").select("doc_id").join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    reason = F.when(F.col("vec_id").isNull(), "missing_vector").when(F.col("dim") != 64, "dimension_mismatch").when(F.col("label") < 2, "stale_model")
    return both.withColumn("reason", reason).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


# order-dependent selections over the best 64 rows; tests hold them against plain Python

def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 best; only their texts are fetched again, by id."""
    from pyspark.sql import Window

    top = _lexical(spark, sf_dir).orderBy(F.desc("lexical"), "cell_id").limit(64)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cell_id"), F.col("text").alias("body_text"))
    placed = top.withColumn("pos", (F.row_number().over(Window.orderBy(F.desc("lexical"), "cell_id")) - 1).cast("long"))
    return texts.join(F.broadcast(placed), "cell_id").withColumn("pack", F.lit("task"))  # 64 rows


@query("pack_budget")
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.pack_budget(_ranked(spark, sf_dir), 4000)


@query("mmr_diversify")
def mmr_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = _vectors(spark, sf_dir)
    return packs.mmr_by_vectors(_ranked(spark, sf_dir).join(df, "cell_id", "left"), 30000)


@query("search_mmr")
def search_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.diversify(_ranked(spark, sf_dir), 30000, 20)


@query("token_estimates")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("n_tokens"))

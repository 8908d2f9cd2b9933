"""Registered queries of verification, chunking, grounding, packs, field scores and retrieval clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import chunks, fixed
from palimpsest.functions.text import estimate_tokens, python_tokens, tokens
from palimpsest.operators import packs, retrieval, verify
from palimpsest.plans.aql import bind, parse
from palimpsest.plans.catalog import _TOKENS, _VEC, CORPUS_SQL, NOW, TASK, TERMS, VIEW, _blend_sql, _bm25_sql, _ranked, _vectors, query
from palimpsest.sources.cells import corpus, table

# facts about orders, told in words; the SQL knows only their numbers

_BEGUN = "CAST(o_orderdate AS DATE)"
_ORDERS = f"o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS price, {_BEGUN} AS d, o_orderkey % 4 AS told, o_orderkey % 7 AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 20000 ELSE 60000 END AS trust FROM orders)"


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(facts, evidence): every order's price, told right, or wrong by one (one in four), and by up to three notes an
    order: its price, a denial (two in seven) and one without a citation."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("price"), F.to_date("o_orderdate").alias("d"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    told = F.col("price") + F.when(F.col("k") % 4 == 0, 1).otherwise(0)
    facts = o.select(F.col("k").alias("fact_id"), "k", text("delivery ", F.col("k"), " has a price of ", told, " USD").alias("fact"))
    notes = F.array(
        F.struct(F.lit(0).alias("n"), text("Our delivery ", F.col("k"), " has of late a listed price of ", F.col("price"), " USD.").alias("body_text"), F.lit("ledger").alias("citation")),
        F.struct(F.lit(1).alias("n"), F.when(F.col("k") % 7 < 2, text("A delivery ", F.col("k"), " has a price of ", told, " USD is false.")).alias("body_text"), F.lit("letter").alias("citation")),
    )
    trust = F.when(F.col("k") % 3 == 0, 20000).otherwise(60000)
    cells = o.select("k", "d", trust.alias("trust_q16"), F.explode(notes).alias("x")).filter("x.body_text is not null and k % 5 <> 0")
    none = F.lit(None).cast("string")
    return facts, cells.select("k", (F.col("k") * 2 + F.col("x.n")).alias("cell_id"), "x.body_text", "trust_q16", F.when(F.col("k") % 11 != 0, F.col("x.citation")).alias("citation"), none.alias("valid_from"), none.alias("valid_to"))


_JUDGED = f"{_ORDERS}, j AS (SELECT *, k % 5 <> 0 AS seen, told = 0 AS wrong, kind < 2 AS denied FROM o)"


@query("verify_fact_status", f"""WITH {_JUDGED}, c AS (SELECT k AS fact_id, trust, CAST(CASE WHEN seen AND NOT wrong THEN 1 ELSE 0 END AS BIGINT) AS supporting, CAST(CASE WHEN seen THEN (CASE WHEN wrong THEN 1 ELSE 0 END) + (CASE WHEN denied THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS contradicting FROM j)
SELECT fact_id, supporting, contradicting, CASE WHEN supporting > 0 AND contradicting > 0 THEN 'mixed_evidence' WHEN supporting > 0 THEN 'supported' WHEN contradicting > 0 THEN 'contradicted' ELSE 'insufficient' END AS status,
  CAST(CASE WHEN supporting + contradicting > 0 THEN least(trust, 62000) ELSE 0 END AS BIGINT) AS confidence_q16 FROM c""")
def verify_fact_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, cells = _facts(spark, sf_dir)
    return verify.verdicts(facts, verify.matches(facts, cells, "k"))


@query("verify_guards", f"WITH {_JUDGED} SELECT k AS fact_id, k * 2 AS cell_id, 'numeric_mismatch' AS guard FROM j WHERE seen AND wrong UNION ALL SELECT k, k * 2, 'missing_citation' FROM j WHERE seen AND NOT wrong AND k % 11 = 0 UNION ALL SELECT k, k * 2 + 1, 'missing_citation' FROM j WHERE seen AND denied AND k % 11 = 0")
def verify_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, cells = _facts(spark, sf_dir)
    return verify.matches(facts, cells, "k").select("fact_id", "cell_id", F.explode("guards").alias("guard"))


@query("verify_evidence_order", f"WITH {_JUDGED} SELECT k AS fact_id, CAST(1 AS BIGINT) AS rn, k * 2 AS cell_id, 'numeric_entailment' AS support_kind FROM j WHERE seen AND NOT wrong")
def verify_evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, cells = _facts(spark, sf_dir)
    return verify.evidence_order(verify.matches(facts, cells, "k"))


@query("verify_stale", "SELECT o_orderkey AS fact_id FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-06-15' OR CAST(o_orderdate AS DATE) + 30 < DATE '1997-06-15'")
def verify_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about a day whose only evidence isn't valid on it."""
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.lit("status on 1997-06-15 is open").alias("fact"), day.cast("string").alias("valid_from"), F.date_add(day, 30).cast("string").alias("valid_to"))
    cells = o.select("fact_id", F.col("fact_id").alias("cell_id"), F.lit("the status is open").alias("body_text"), F.lit(60000).alias("trust_q16"), F.lit("ledger").alias("citation"), "valid_from", "valid_to")
    found = verify.matches(o.select("fact_id", "fact"), cells, "fact_id")
    return found.filter(F.array_contains("guards", "stale_fact")).select("fact_id")


# texts into rows

@query("text_chunks")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.explode_text(table(spark, sf_dir, "documents"), "doc_id", "text", chunks.split_text, "chunk string")
    return rows.withColumn("chunk_id", F.format_string("%d#chunk-%04d", "doc_id", "pos"))


@query("section_chunks")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.explode_text(table(spark, sf_dir, "documents"), "doc_id", "text", chunks.split_sections, "breadcrumb string, kind string, chunk string")


_SPANS = """sp AS (SELECT item_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([.!?\n])', '\\1' || chr(2), 'g'), chr(2)), lambda x: replace(trim(x, ' ' || chr(9) || chr(10) || chr(13)), chr(1), '.')), lambda x: x <> '')) AS span FROM benchmark)"""


@query("answer_spans", f"WITH {_SPANS} SELECT item_id, span FROM sp")
def answer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.explode_text(table(spark, sf_dir, "benchmark"), "item_id", "text", chunks.split_spans, "span string").select("item_id", "span")


@query("answer_grounding", f"""WITH {_SPANS}, {CORPUS_SQL}, k AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM cells WHERE status = 'draft'), w AS (SELECT item_id, span, unnest(list_distinct({_TOKENS.replace('body_text', 'span')})) AS term FROM (SELECT DISTINCT item_id, span FROM sp)),
s AS (SELECT item_id, span, count(*) AS n, count(k.term) AS covered FROM w LEFT JOIN k USING (term) GROUP BY 1, 2), q AS (SELECT item_id, covered * 65535 // n AS support FROM s)
SELECT item_id, count(*) AS n_spans, count(*) FILTER (support >= 45000) AS n_supported, CAST(sum(support) // count(*) AS BIGINT) AS support_q16 FROM q GROUP BY 1""")
def answer_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far drafts cover the distinct sentences of each item; sentences without a term count as nothing."""
    spans = answer_spans(spark, sf_dir).distinct().select("item_id", "span", F.explode(F.array_distinct(tokens(F.col("span")))).alias("term"))
    known = corpus(spark, sf_dir).filter("status = 'draft'").select(F.explode(tokens(F.col("body_text"))).alias("term")).distinct().withColumn("known", F.lit(1))
    per = spans.join(known, "term", "left").groupBy("item_id", "span").agg(fixed.div(F.count("known") * fixed.ONE, F.count("*")).alias("support"))
    return per.groupBy("item_id").agg(F.count("*").alias("n_spans"), F.count(F.when(F.col("support") >= 45000, 1)).alias("n_supported"), fixed.div(F.sum("support"), F.count("*")).cast("long").alias("support_q16"))


# field scores and vectors

_FIELDS = "f AS (SELECT conv_id * 1000 + turn AS cell_id, role AS title, text AS body_text FROM conversations)"


@query("bm25f_topk", f"""WITH {_FIELDS}, t AS (SELECT cell_id, {_TOKENS.replace('body_text', 'title')} AS a, {_TOKENS} AS b FROM f), c AS (SELECT cell_id, len(a) AS la, len(b) AS lb, len(list_filter(a, lambda x: x = 'user')) AS a0, len(list_filter(b, lambda x: x = 'user')) AS b0, len(list_filter(a, lambda x: x = 'haha')) AS a1, len(list_filter(b, lambda x: x = 'haha')) AS b1 FROM t),
s AS (SELECT count(*) AS n, greatest(avg(la) FILTER (la > 0), 1) AS aa, greatest(coalesce(avg(lb) FILTER (lb > 0), 1), 1) AS ab, count(*) FILTER (a0 + b0 > 0) AS d0, count(*) FILTER (a1 + b1 > 0) AS d1 FROM c),
i AS (SELECT *, CASE WHEN d0 = 0 THEN 0 ELSE greatest(0, ln((n + 1) / (d0 + 0.5))) END AS i0, CASE WHEN d1 = 0 THEN 0 ELSE greatest(0, ln((n + 1) / (d1 + 0.5))) END AS i1 FROM s)
SELECT cell_id, CAST(round((i0 * 8 * (a0 * 2.2) / (a0 + 1.2 * (0.25 + 0.75 * (greatest(la, 1) / aa))) + i1 * 8 * (a1 * 2.2) / (a1 + 1.2 * (0.25 + 0.75 * (greatest(la, 1) / aa))) + i0 * (b0 * 2.2) / (b0 + 1.2 * (0.25 + 0.75 * (greatest(lb, 1) / ab))) + i1 * (b1 * 2.2) / (b1 + 1.2 * (0.25 + 0.75 * (greatest(lb, 1) / ab)))) * 1000000) AS BIGINT) AS lexical FROM c, i ORDER BY lexical DESC, cell_id LIMIT 50""")
def bm25f_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by their role as a title and their text."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("cell_id"), F.col("role").alias("title"), F.col("text").alias("body_text"))
    return retrieval.bm25f(turns, {"title": "title", "body_text": "other"}, ["user", "haha"]).orderBy(F.desc("lexical"), "cell_id").limit(50)


@query("weighted_term_stats", f"""WITH {_FIELDS}, u AS (SELECT cell_id, unnest({_TOKENS.replace('body_text', 'title')}) AS term, 8 AS w FROM f UNION ALL SELECT cell_id, unnest({_TOKENS}), 1 FROM f), c AS (SELECT term, cell_id, sum(w) AS tf FROM u GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM c GROUP BY 1""")
def weighted_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("cell_id"), "role", "text")
    weigh = lambda c, w: F.transform(tokens(F.col(c)), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    each = turns.select("cell_id", F.explode(F.concat(weigh("role", retrieval.FIELD_WEIGHTS["title"]), weigh("text", retrieval.FIELD_WEIGHTS["other"]))).alias("x"))
    per = each.groupBy(F.col("x.term").alias("term"), "cell_id").agg(F.sum("x.w").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("cosine_by_candidate_norm", f"WITH {_VEC} SELECT cell_id, CAST(greatest(d, 0) * 1048576 // CAST(floor(sqrt(n)) AS BIGINT) AS BIGINT) AS score FROM p ORDER BY score DESC, cell_id LIMIT 20")
def cosine_by_candidate_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, q = _vectors(spark, sf_dir)
    literal = F.array(*(F.lit(x).cast("smallint") for x in q))
    score = fixed.div(F.greatest(fixed.dot(F.col("vector"), literal), F.lit(0)) * (1 << 20), fixed.isqrt(fixed.dot(F.col("vector"), F.col("vector"))))
    return df.select("cell_id", score.cast("long").alias("score")).orderBy(F.desc("score"), "cell_id").limit(20)


@query("jaccard_turns", f"WITH t AS (SELECT conv_id, turn, list_distinct({_TOKENS.replace('body_text', 'text')}) AS w FROM conversations), j AS (SELECT b.conv_id, b.turn, len(list_intersect(a.w, b.w)) AS both_, len(list_distinct(a.w || b.w)) AS all_ FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn) SELECT conv_id, turn, CAST(CASE WHEN all_ = 0 THEN 0 ELSE (both_ * 65535 + all_ // 2) // all_ END AS BIGINT) AS like_q16 FROM j")
def jaccard_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like each turn is to the one before."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(tokens(F.col("text"))).alias("w"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v"))
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", fixed.jaccard(F.col("w"), F.col("v")).alias("like_q16"))


# retrieval clauses

#: The default budget of 4000 tokens bounds the limit at 25.
_FULL = f'RETRIEVE CONTEXT FOR TASK "{TASK}" IN BRAIN default USING MODE balanced WHERE scope IN ["lang:en", "lang:fr"] REQUIRE source_trust >= 0.40 LIMIT 30 CANDIDATES;'


@query("retrieve_dense", f"""WITH {CORPUS_SQL}, cand AS (SELECT * FROM cells WHERE scope IN ('lang:en', 'lang:fr')), {_bm25_sql('cand')}, {_VEC},
cut_ AS (SELECT * FROM scored ORDER BY lexical DESC, cell_id LIMIT 50), pool AS (SELECT cut_.*, CAST(coalesce(greatest(p.d, 0), 0) AS BIGINT) AS semantic FROM cut_ LEFT JOIN p USING (cell_id) WHERE source_trust_q16 >= 26214), {_blend_sql('balanced', 'pool')},
u AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY score DESC, cell_id) AS rn FROM blended)
SELECT cell_id, lexical, semantic, score FROM u WHERE rn = 1 OR content_hash IS NULL ORDER BY score DESC, cell_id LIMIT 25""")
def retrieve_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = bind(parse(_FULL), VIEW)
    df, q = _vectors(spark, sf_dir)
    literal = F.array(*(F.lit(x).cast("smallint") for x in q))
    dense = df.select("cell_id", F.greatest(fixed.dot(F.col("vector"), literal), F.lit(0)).alias("semantic"))
    return retrieval.retrieve(corpus(spark, sf_dir), bound, python_tokens(bound.task), NOW, dense=dense).select("cell_id", "lexical", "semantic", "score")


@query("retrieve_no_terms", f"WITH {CORPUS_SQL}, u AS (SELECT cell_id, created_unix_seconds, row_number() OVER (PARTITION BY content_hash ORDER BY created_unix_seconds DESC, cell_id) AS rn, content_hash FROM cells WHERE scope = 'lang:en') SELECT count(*) AS n FROM (SELECT cell_id FROM u LIMIT 5)")
def retrieve_no_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a term that any cell has, no candidate is cut before the blend."""
    bound = bind(parse('RETRIEVE CONTEXT FOR TASK "qqqqzzzz" IN BRAIN default WHERE scope = "lang:en" LIMIT 5 CANDIDATES;'), VIEW)
    return retrieval.retrieve(corpus(spark, sf_dir), bound, python_tokens(bound.task), NOW).agg(F.count("*").alias("n"))


# packs over the 64 best; the tests hold them against worked cases

def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _ranked(spark, sf_dir)
    span = Window.partitionBy("pack")
    fresh = fixed.min_max(F.col("created_unix_seconds"), F.min("created_unix_seconds").over(span), F.max("created_unix_seconds").over(span))
    return top.select("pack", "cell_id", "pos", "body_text", F.col("source").alias("citation"), "lexical", F.col("source_trust_q16").alias("trust_q16"), fresh.alias("freshness_q16"), F.col("source").isNotNull().alias("cited"), F.lit(0).alias("feedback"), estimate_tokens(F.col("body_text")).alias("n_tokens"))


for _by in ("coverage", "value"):

    @query(f"pack_order_{_by}")
    def pack_order(spark: SparkSession, sf_dir: str, by: str = _by) -> DataFrame:
        return packs.pack_order(_pool(spark, sf_dir), TERMS, by=by)


for _policy in packs.POLICIES:

    @query(f"pack_{_policy}")
    def pack(spark: SparkSession, sf_dir: str, policy: str = _policy) -> DataFrame:
        return packs.pack_cells(_pool(spark, sf_dir), 4000, policy=policy, redundant=60000)


@query("pack_export")
def pack_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack as JSON, as Markdown and as a prompt, one row."""
    pool = _pool(spark, sf_dir)
    kept = packs.pack_cells(pool, 4000).filter("outcome = 'included'").select("cell_id", F.col("pos").alias("at")).join(pool, "cell_id")
    listed = kept.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("at", "cell_id", "citation", "body_text"))).alias("cells"))  # a pool of 64
    join = lambda f: F.concat_ws("\n\n", F.transform("cells", f))
    cite = lambda c: F.coalesce(c["citation"], F.lit("no citation"))
    return listed.select(
        "pack", F.to_json("cells").alias("json"), join(lambda c: F.concat(F.lit("## Cell "), c["cell_id"].cast("string"), F.lit("\n\n"), c["body_text"], F.lit("\n\nSource: "), cite(c))).alias("markdown"),
        join(lambda c: F.concat(F.lit("["), c["cell_id"].cast("string"), F.lit("] "), c["body_text"])).alias("prompt"),
    )


@query("explain_analyze")
def explain_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each stage of a retrieval lets through, in order."""
    bound = bind(parse(_FULL), VIEW)
    cells = corpus(spark, sf_dir)
    in_scope = F.col("scope").isin(*sorted(VIEW.readable_scopes))
    chosen = in_scope & retrieval.where(bound.where)
    trusted = chosen & retrieval.quality(bound.confidence_q16, bound.trust_q16, bound.freshness, bound.valid_at, NOW, cells.columns)
    row = cells.agg(F.count("*").alias("scan"), F.count(F.when(in_scope, 1)).alias("permission"), F.count(F.when(chosen, 1)).alias("condition"), F.count(F.when(trusted, 1)).alias("quality"))
    stages = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(n).alias("n_rows")) for i, n in enumerate(("scan", "permission", "condition", "quality"))))
    return row.select(F.inline(stages))

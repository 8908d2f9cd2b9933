"""Questions, scopes, abbreviations, embeddings, coverage and graph walks against worked cases and brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import abbreviations, embedding, intent, requirements, scopes
from palimpsest.functions.questions import anchors
from palimpsest.functions.text import fnv1a64, python_tokens
from palimpsest.operators import relational, retrieval

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("question", "kind"), [
    ("", "basic"), ("What is the name of it", "basic"), ("Is it due on 2024-01-02, or later", "constrained"), ("What ran in v1.2", "constrained"), ("What ran in v12", "basic"),
    ("During the call, who spoke", "intra_document_reasoning"), ("Who spoke during it", "basic"), ("LIST ALL owners", "completeness"), ("rollout of it", "basic"), ("rollout is blocked", "project_related"),
    ("latest jokes", "miscellaneous"), ("What exact quorum", "info_not_found"),
])
def test_types_alike_in_columns_and_on_the_driver(spark, question, kind):
    assert intent.question_type(question) == kind
    assert spark.createDataFrame([(question,)], "q string").select(intent.question_types(F.col("q"))["type"]).first()[0] == kind


def test_types_of_null_and_own_rules(spark):
    got = spark.createDataFrame([(None,), ("red",)], "q string").select(intent.question_types(F.col("q"), (("semantic", 2, ("red",), ()), ("high_level", 1, ("re",), ()))).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in got] == [("basic", 32768), ("semantic", 2 * 65535 // 3)]


def test_long_plain_questions_rerank_as_semantic():
    assert intent.profile_type("Why " + "so " * 15) == "semantic" and intent.profile_type("Why so") == "basic" and intent.profile_type("That " + "so " * 15) == "basic"


def test_metadata_weights():
    assert intent.metadata_weights("What conflict is there", False) == (18000, 24000)
    assert intent.metadata_weights("What is current", False) == (8000, 18000) == intent.metadata_weights("What", True)
    assert intent.metadata_weights("in v1.2 ", True) == (12000, 22000) and intent.metadata_weights("red", False) == (3000, 3000)


def test_conditions():
    c = requirements.conditions("What p95 latency threshold must be under 200 ms?")
    assert [(x.operator, x.values[0].scaled, x.values[0].unit) for x in c.numbers] == [("at_most", 200, "ms")] and "latency" in c.numbers[0].terms and not c.slots
    assert requirements.condition_bonus(c, "p95 latency is 180 ms") == 18000 and requirements.condition_bonus(c, "p95 latency is 280 ms") == 4000 and requirements.condition_bonus(c, None) == 0
    between = requirements.conditions("Which score range is between 40 and 60?")
    assert [(x.operator, [v.scaled for v in x.values]) for x in between.numbers] == [("between", [40, 60])]
    assert requirements.condition_bonus(between, "score 50") == 18000 and requirements.condition_bonus(between, "score 61") == 4000
    dated = requirements.conditions("What changed after 2026-04-01?")
    assert dated.dates == ("2026-04-01", "2026-04-01") and requirements.condition_bonus(dated, "on 2026-04-01") == 8000
    bounds = requirements.conditions("What minimum KV-cache hit-rate and max sequence length are required?")
    assert not bounds.numbers and any("sequence" in s.terms for s in bounds.slots) and requirements.condition_bonus(bounds, "sequence length") > 0 == requirements.condition_bonus(bounds, "general notes")
    assert not requirements.conditions("") and requirements.condition_bonus(requirements.conditions(""), "5") == 0


def test_requirements_and_what_covers_them(spark):
    got = requirements.requirements('Who owns "blue moon" in Project Apollo and when is docs/a.md due?')
    named = [r.text for r in got if r.kind == "anchor"]
    assert named[0] == "Project Apollo" and {"blue moon", "docs/a.md"} <= set(named)
    assert [r.text.split()[0] for r in got if r.kind == "slot"] == ["date", "role"] and "is docs/a.md due" in [r.text for r in got if r.kind == "subquestion"]
    assert [r.kind for r in requirements.requirements("why")] == ["question"]
    texts = [("see docs/a.md",), ("PROJECT   apollo!",), ("",), (None,)]
    at = {i for i, r in enumerate(got, 1) if r.text == "docs/a.md"}
    found = [set(r[0]) for r in spark.createDataFrame(texts, "t string").select(requirements.covered(F.col("t"), got)).collect()]
    assert at <= found[0] and found[1] and not found[2] and not found[3]


def test_directives():
    got = {(d.field, d.value, d.hard) for d in scopes.directives("Who in the SRE team has the jira ticket ABC-12 of the Apollo rollout for billing?")}
    # a ticket has the shape of a name too
    assert got == {("source", "jira", True), ("project", "ABC-12", False), ("scope", "billing", False), ("topic", "rollout", False), ("project", "Apollo", False), ("team", "SRE", False)}
    assert scopes.directives("") == []


def _by_hand(row, question):
    """The rerank of one row before trust and recency, in plain Python."""
    a, b, anchor_w, source_w, scope_w, cond_w, gate, _ = intent.PROFILES[intent.profile_type(question)]
    low = (row["body_text"] or "").lower()
    own = set(python_tokens(low))
    covered = 0
    for r in requirements.requirements(question):
        least = 1 if len(r.tokens) <= 2 else max(-(-len(r.tokens) * 45 // 100), 2)
        covered += bool(r.tokens) and (len(own & set(r.tokens)) >= least or r.kind == "anchor" and requirements._plain(r.text) in requirements._plain(low))
    met = requirements.condition_bonus(requirements.conditions(question), low)
    named = [list(dict.fromkeys(python_tokens(t))) for _, t in anchors(question)]
    sources = [s for s in requirements.source_hints(question) if s in low]
    terms = [t for t in python_tokens(question) if t in low]
    in_scope = sum(d.confidence_q16 // 6 for d in scopes.directives(question) if any(t in own for t in d.terms if len(t) >= 3) or " ".join(python_tokens(d.value)) in " ".join(python_tokens(low)))
    total = scope_w * in_scope + row["base"] + a * row["lexical"] + b * row["semantic"] + anchor_w * sum(t in low for n in named for t in n) + source_w * len(sources) + 2500 * covered + cond_w * met + 1000 * len(terms)
    shown = 2 * sum(any(t in low for t in n) for n in named) + 2 * bool(sources) + 2 * (met > 0) + (2 * covered if covered >= 2 else 0) + sum(len(t) >= 3 and t not in requirements.NO_EVIDENCE for t in terms)
    return total if row["body_text"] is None or shown >= 2 else total * gate // 65535


@pytest.mark.parametrize("question", ["zzz", 'the slack thread on "red green" costs at least 50 USD', "Why does the red v1.2 differ, and what is the cost"])
def test_rerank_equals_hand(spark, question):
    texts = ["red green", "It costs 60 USD", "It costs 40 USD in slack", None, "", "RED v1.2 differs; the cost is high", "red green"]
    rows = [(i, 100 * i, i, 7 * i, 40000, None, t) for i, t in enumerate(texts)]
    pool = spark.createDataFrame(rows, "cell_id long, base long, lexical long, semantic long, source_trust_q16 int, created_unix_seconds long, body_text string")
    got = {r["cell_id"]: r["score"] for r in retrieval.hybrid_rerank(pool, question).collect()}
    trust_w, _ = intent.metadata_weights(question, False)
    assert got == {r["cell_id"]: _by_hand(r, question) + 40000 * 1024 * trust_w // 65535 for r in pool.collect()}


def test_rerank_counts_recency_within_the_pool(spark):
    rows = [(1, 0, 0, 0, 0, 10, "a"), (2, 0, 0, 0, 0, 20, "a"), (3, 0, 0, 0, 0, None, "a")]
    pool = spark.createDataFrame(rows, "cell_id long, base long, lexical long, semantic long, source_trust_q16 int, created_unix_seconds long, body_text string")
    assert {r["cell_id"]: r["score"] for r in retrieval.hybrid_rerank(pool, "zzz").collect()} == {1: 0, 2: 1024 * 3000, 3: 0}
    assert retrieval.hybrid_rerank(pool.limit(0), "zzz").count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("the quality of service (QOS) rose", {("qos", "quality"), ("qos", "service")}), ("QOS (quality of service)", {("qos", "quality"), ("qos", "service")}), ("service (qos)", set()), ("a (B) c", set()),
    ("only service (QOS)", set()), ("title: QOS (quality of service)\n\nbody", set()), ("", set()), (None, set()), ("open (SLA", set()), ("service level agreement (SLA) and service level objective (SLO)", {("sla", "service"), ("sla", "level"), ("sla", "agreement"), ("slo", "service"), ("slo", "level"), ("slo", "objective")}),
])
def test_abbreviations(text, want):
    assert abbreviations.pairs(text) == want


def test_abbreviations_are_sure_synonyms(spark):
    docs = spark.createDataFrame([(1, "quality of service (QOS)"), (2, None), (3, "quality")], "doc_id long, text string")
    from palimpsest.functions.text import tokens

    got = relational.synonym_pairs(docs.select("doc_id", tokens(F.col("text")).alias("terms")), abbreviations=abbreviations.abbreviations(docs))
    assert {(r["term"], r["synonym"], r["association_q16"]) for r in got.collect()} == {("qos", "quality", 65535), ("qos", "service", 65535), ("quality", "qos", 65535), ("service", "qos", 65535)}


def test_hashes_and_vectors(spark):
    # published test vectors of the hash and of the generator
    assert [fnv1a64(x) for x in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert int(embedding.lanes(np.zeros(1, np.uint64), 1)[0, 0]) == int(np.uint16(0xE220).view(np.int16))
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "vector=1\na\n"), (6, "a\n\n")], "i int, t string")
    got = {r["i"]: (r["h"], r["v"]) for r in df.select("i", embedding.text_hash(F.col("t")).alias("h"), embedding.deterministic_vector(F.col("t"), 4).alias("v")).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1][0] == got[5][0] == "af63dc4c8601ec8c" != got[6][0] and len(got[1][1]) == 4


def test_no_pair_of_terms_is_a_row(spark, monkeypatch):
    import collections
    import itertools
    import random

    from palimpsest.operators import cooccurrence

    rng = random.Random(5)
    docs = [(i, [f"t{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(30))]) for i in range(150)] + [(150 + i, ["alone"]) for i in range(90)] + [(300, [])]
    df = collections.Counter(t for _, d in docs for t in set(d))
    co = collections.Counter(p for _, d in docs for p in itertools.permutations({t for t in d if df[t] >= 3}, 2))
    rows = collections.defaultdict(list)
    for (a, b), n in co.items():
        if n >= 2:
            rows[a].append((-(n * 65535 // min(df[a], df[b])), -n, b))
    monkeypatch.setattr(cooccurrence, "BLOCK", 40)
    monkeypatch.setattr(cooccurrence, "SPAN", 2)
    frame = spark.createDataFrame(docs, "doc_id long, terms array<string>")
    for most in (1, 5, 10_000):
        kept = sorted(rows, key=lambda t: (-df[t], t))[:most]
        want = {(a, b, -x, i + 1) for a in kept for i, (x, _, b) in enumerate(sorted(rows[a])[:8])}
        out = relational.synonym_pairs(frame, most=most)
        assert {tuple(r) for r in out.select("term", "synonym", "association_q16", "rn").collect()} == want
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_embedding_text_equals_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from palimpsest.plans.questions import QUERIES
    from palimpsest.plans.catalog import ORACLE

    odd = ["", " ", "\n", "\n\n", "a", "\na", "a\n\nb", "\n ", "a\n", "a\rb", "vector=1", "x_vector=1", None, "embedding_model=m", "a\n embedding_ref=b\nc", "a embedding_text_hash=1", "\u2028embedding_model=1", "\x0b\x0c", "a\x00", "\x85b", "\tembedding_model=m"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["embedding_text"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(ORACLE["embedding_text"]).fetchall())


def test_coverage_takes_the_first_dimension_and_counts_repeats(spark):
    lines = [json.dumps(x) for x in ({"doc_id": "a", "vector": [1, 2]}, {"doc_id": "a", "vector": [3, 4]}, {"doc_id": "b", "vector": [1]}, {"doc_id": " ", "vector": [1]}, {"doc_id": "z", "vector": [1, 1]})] + ["", "  ", "no json"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, value string")
    expected = spark.createDataFrame([("a", None), ("b", None), ("c", None), (None, None)], "doc_id string, text_hash string")
    got = relational.coverage_of_lines(expected, df).first().asDict()
    assert got == {"total_items": 3, "embedded_items": 1, "duplicate_items": 1, "unexpected_items": 1, "invalid_rows": 2, "empty_vector_rows": 0, "dimension_mismatch_rows": 1, "stale_items": 0, "missing_items": 2, "coverage_bps": 3333, "production_ready": False}
    empty = relational.coverage_of_lines(expected.limit(0), df.limit(0)).first()
    assert empty["coverage_bps"] == 10_000 and empty["production_ready"]


def test_walk_stops_at_its_budget(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "c", "a"), (3, "b", "d"), (4, "d", "c"), (5, "a", "a"), (6, "b", " "), (7, "x", "y")], "relation_id long, subject string, object string")
    hits, took = relational.neighbourhood(edges, " a ", 2)
    got = {r["cell_id"]: (r["matched_entity"], r["depth"], r["path"]) for r in hits.collect()}
    assert got == {1: ("b", 1, [1]), 2: ("c", 1, [2]), 5: ("a", 1, [5]), 3: ("d", 2, [1, 3]), 4: ("d", 2, [2, 4])}
    assert took == {"visited_edges": 8, "visited_entities": 4, "budget_exceeded": False}
    hits, took = relational.neighbourhood(edges, "a", 2, budget=4)
    assert {r["cell_id"] for r in hits.collect()} == {1, 2, 5} and took == {"visited_edges": 4, "visited_entities": 2, "budget_exceeded": True}
    hits, took = relational.neighbourhood(edges, "", 2)
    assert hits.count() == 0 and took == {"visited_edges": 0, "visited_entities": 0, "budget_exceeded": False}
    entities = spark.createDataFrame([(10, "a"), (11, "d"), (12, "y")], "cell_id long, name string")
    hits, _ = relational.neighbourhood(edges, "a", 2, entities=entities)
    assert {(r["cell_id"], r["depth"], r["proximity_q16"]) for r in hits.filter("cell_id >= 10").collect()} == {(10, 0, 65535), (11, 2, 21845)}


def test_whole_walk_equals_the_bounded_one(spark):
    import random

    rng = random.Random(3)
    name = lambda: rng.choice(["", " a", *"abcdefghijklmnopqrstuvwxyz"])
    rows = [(rng.randrange(40), name(), name()) for _ in range(45)]
    edges = spark.createDataFrame([*rows, (99, "a", None)], "relation_id long, subject string, object string")
    entities = spark.createDataFrame([(100, "a"), (101, "d"), (102, "zz")], "cell_id long, name string")
    for hops in (1, 3):
        want, took = relational.neighbourhood(edges, " a ", hops, entities=entities)
        got = relational.whole_neighbourhood(edges, " a ", hops, entities=entities)
        assert not took["budget_exceeded"] and got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert relational.whole_neighbourhood(edges, " ", 2).count() == 0


def test_graph_walk_has_no_budget(spark, tmp_path):
    from palimpsest.plans.questions import QUERIES

    spark.range(1).selectExpr("cast(7 as int) n_nationkey", "cast(0 as int) n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(100_005).selectExpr("id c_custkey", "cast(7 as int) c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    row = QUERIES["graph_walk"](spark, str(tmp_path)).selectExpr("count(*)", "count(distinct cell_id)", "max(path)").first()
    assert tuple(row) == (100_006, 100_006, "7,99999")


@pytest.mark.parametrize("name", ["hybrid_rerank", "embedding_text_hash", "deterministic_embeddings", "synonym_dictionary"])
def test_query_without_sql_runs(spark, name):
    from palimpsest.plans.questions import QUERIES

    assert QUERIES[name](spark, SF).count() > 0

"""Numbers, dates, negations, chunks, packs, and streams of writes, against worked cases and brute force."""

import pytest

from palimpsest.functions import chunks, evidence
from palimpsest.functions.evidence import Value
from palimpsest.functions.text import python_tokens
from palimpsest.operators import packs
from palimpsest.plans import evidence as queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("text", "want"), [
    ("$1,200 in cash", [Value(1200, "USD")]), ("3.5 million EUR", [Value(3_500_000, "EUR")]), ("KZT 40", [Value(40, "KZT")]), ("12.7 apples", [Value(12)]), ("10 km away", [Value(10, None, "km")]),
    ("5k users", [Value(5000)]), ("7% up", [Value(7, None, "%")]), ("2 млрд тенге", [Value(2 * 10**9)]), ("no number", []), (None, []), ("", []),
])
def test_numbers(text, want):
    assert evidence.numeric_values(text) == want


def test_comparison_and_display():
    assert evidence.compare(Value(1, None, "km"), Value(1000, None, "m")) == "equal"
    assert evidence.compare(Value(1, "USD"), Value(1, "EUR")) == "currency_mismatch"
    assert evidence.compare(Value(1, "USD"), Value(1)) == "incomparable" == evidence.compare(Value(1, None, "kg"), Value(1, None, "m"))
    assert evidence.compare(Value(1), Value(2)) == "value_conflict"
    assert [evidence.display(v) for v in (Value(1_200_000_000, "USD"), Value(3_000_000), Value(5000, None, "kg"), Value(1234))] == ["1.2B USD", "3M", "5K kg", "1234"]


def test_dates():
    assert evidence.date_bounds("2024-02") == ("2024-02-01", "2024-02-29") and evidence.date_bounds("2023-02-29") is None and evidence.date_bounds("1899") is None
    assert evidence.query_range("in 2021, or on 2020/03/05.") == ("2020-03-05", "2020-03-05") and evidence.query_range("in 2021,") == ("2021-01-01", "2021-12-31")
    assert evidence.stale_reason(("2021-01-01", "2021-12-31"), None, "2020") == "expired" and evidence.stale_reason(("2021-01-01", "2021-12-31"), "2022", None) == "not_yet_valid"
    assert evidence.stale_reason(("2021-01-01", "2021-12-31"), "2021-12", "2022") is None


@pytest.mark.parametrize(("text", "want"), [
    ("The budget was not approved", True), ("The budget was rejected.", True), ("budget approved is false", True), ("not only budget approved", False), ("The budget. It was not seen, approved?", False),
    ("contradicts=budget approved", True), ("budget approved", False), ("", False), (None, False),
])
def test_contradictions(text, want):
    assert evidence.contradicts("budget approved", text) is want


def test_support():
    assert evidence.support("price is 5 USD", "the  Price is 5 usd today") == ("exact_text", 65535)
    assert evidence.support("price is 5k USD", "is the price 5000 USD") == ("numeric_entailment", 62000)
    assert evidence.support("red car", "a car, quite red") == ("all_terms", 60000) and evidence.support("red car", "a car") is None


def brute_chunks(text, most, overlap):
    """By the rule's words: paragraphs join while they fit, long ones are cut into overlapping slices."""
    out, held = [], ""
    for p in [x.strip() for x in text.split("\n\n")]:
        if not p:
            continue
        if len(p) > most:
            if held:
                out.append(held)
            held, start = "", 0
            while True:
                out.append(p[start : start + most])
                if start + most >= len(p):
                    break
                start += most - overlap
        elif held and len(held) + 2 + len(p) <= most:
            held += "\n\n" + p
        else:
            if held:
                out.append(held)
            held = p
    return out + ([held] if held else [])


def test_chunks_are_brute_force(spark):
    import random

    draw = random.Random(1)
    for _ in range(300):
        text = "\n\n".join("x" * draw.choice((0, 3, 10, 19, 20, 21, 45, 60)) for _ in range(draw.randint(0, 8)))
        assert chunks.split_text(text, most=20, overlap=5) == brute_chunks(text, 20, 5), text
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict = {}
    for r in sorted(queries.text_chunks(spark, SF).collect(), key=lambda r: (r["doc_id"], r["pos"])):
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {i: c for i, t in texts.items() if (c := brute_chunks(t, 1000, 120))}


def test_sections_and_spans():
    text = "# A\nx\n## B\ntext\n```py\n# no heading\n```\n|a|b|\n|1|2|\nend\n# C\nz"
    assert [(c, k) for c, k, _ in chunks.split_sections(text)] == [("A", "text"), ("A > B", "text"), ("A > B", "code"), ("A > B", "table"), ("A > B", "text"), ("C", "text")]
    assert chunks.split_spans("Pi is 3.14. Yes! no\nend") == ["Pi is 3.14.", "Yes!", "no", "end"] and chunks.split_spans(None) == []


def test_pack_policies(spark):
    rows = [("p", 1, 0, "cite", "one two three. four five six seven"), ("p", 2, 1, "cite", "one two three. four five six seven"), ("p", 3, 2, None, "red"), ("p", 4, 3, "c", "green blue black white. " * 8)]
    pool = spark.createDataFrame(rows, "pack string, cell_id long, pos long, citation string, body_text string")
    run = lambda policy, budget=16: [(r["n_tokens"], r["outcome"]) for r in sorted(packs.pack_cells(pool, budget, policy=policy, redundant=60000).collect(), key=lambda r: r["pos"])]
    assert run("exclude") == [(9, "included"), (0, "redundant"), (1, "included"), (0, "excluded")]
    assert run("truncate") == [(9, "included"), (0, "redundant"), (1, "included"), (6, "truncated")]
    assert run("source_only_reference", 20)[3] == (7, "source_only_reference")
    assert run("preserve_first", 4)[:3] == [(9, "included"), (0, "redundant"), (0, "excluded")]
    with pytest.raises(ValueError):
        packs.pack_cells(pool, 4, policy="other")
    assert packs.best_lines("a\nb red\nc\nd", ["red"], 2) == "a\nb red" and packs.best_lines(None, [], 3) == ""


def test_orders(spark):
    rows = [("p", 1, 0, "x y", 0, 0, 0, False, 0, 1), ("p", 2, 1, "red", 0, 0, 0, False, 0, 10), ("p", 3, 2, "red green", 0, 0, 0, True, 0, 10), ("p", 4, 3, "blue", 0, 0, 0, False, 0, 1)]
    pool = spark.createDataFrame(rows, "pack string, cell_id long, pos long, body_text string, lexical long, trust_q16 int, freshness_q16 int, cited boolean, feedback int, n_tokens int")
    ids = lambda df: [r["cell_id"] for r in sorted(df.collect(), key=lambda r: r["rank"])]
    assert ids(packs.pack_order(pool, ["red", "green", "blue"], by="coverage")) == [3, 4, 2, 1]
    assert ids(packs.pack_order(pool, ["red", "green", "blue"], by="value")) == [4, 3, 1, 2]  # what the second adds, its likeness to the third takes away
    assert ids(packs.pack_order(pool, [], by="value")) == [1, 2, 3, 4]
    vectors = spark.createDataFrame([("p", 1, 0, [9, 0]), ("p", 2, 1, [9, 1]), ("p", 3, 2, [0, 9]), ("p", 4, 3, None)], "pack string, cell_id long, pos long, vector array<int>")
    assert ids(packs.mmr_by_vectors(vectors, 65535)) == [1, 2, 3, 4] and ids(packs.mmr_by_vectors(vectors, 20000)) == [1, 3, 4, 2]


def test_no_candidate_is_cut_without_a_score(spark):
    assert queries.retrieve_no_terms(spark, SF).first()["n"] == 5
    assert python_tokens("de la casa") == ["de", "la", "casa"]


def test_validity_comes_before_the_cut(spark):
    from palimpsest.operators import retrieval
    from palimpsest.plans.aql import bind, parse
    from palimpsest.plans.catalog import VIEW

    cells = spark.createDataFrame([(i, "lang:en", "ready", "memory" if i == 9 else "raw", 60 if i == 9 else None, 100, 5, f"h{i}", "word " * (10 - i), "1999-01-01", "1999-12-31" if i < 6 else None) for i in range(10)], "cell_id long, scope string, status string, cell_type string, ttl_seconds long, created_unix_seconds long, source_trust_q16 int, content_hash string, body_text string, valid_from string, valid_to string")
    bound = bind(parse('RETRIEVE CONTEXT FOR TASK "word" IN BRAIN default WHERE scope = "lang:en" REQUIRE valid at "2001-01-01" LIMIT 2 CANDIDATES;'), VIEW)
    got = [r["cell_id"] for r in retrieval.retrieve(cells, bound, ["word"], 1000).collect()]
    assert len(got) == 2 and set(got) <= {6, 7, 8}


def test_stream_of_writes(spark, tmp_path):
    from palimpsest.streaming import maintenance

    source, parts, check = (str(tmp_path / x) for x in ("in", "parts", "check"))
    send = lambda rows: spark.createDataFrame(rows, maintenance.WRITE).coalesce(1).write.mode("append").parquet(source)
    pour = lambda: maintenance.maintain(spark.readStream.schema(maintenance.WRITE).parquet(source), parts, check).awaitTermination()
    send([(1, 1, "a", False, 0, None, "k"), (1, 1, "a", False, 0, None, "k"), (2, 2, "b", False, 0, 50, None), (3, 3, "c", False, 0, None, None)])
    pour()
    send([(1, 4, "d", False, 0, None, None), (3, 5, None, True, 0, None, None)])
    pour()
    pour()  # nothing new: nothing changes
    live = lambda df: sorted((r["cell_id"], r["payload"]) for r in df.collect())
    assert live(maintenance.current(spark, parts)) == [(1, "d"), (2, "b")]
    assert live(maintenance.current(spark, parts, now=100)) == [(1, "d")]
    stored = spark.createDataFrame([(1, 9, "z", False, 0, None, None), (7, 0, "y", False, 0, None, None)], maintenance.WRITE)
    assert live(maintenance.current(spark, parts, stored)) == [(1, "z"), (2, "b"), (7, "y")]
    maintenance.compact(spark, parts, str(tmp_path / "all"), stored)
    assert live(spark.read.parquet(str(tmp_path / "all")).filter("not tombstone")) == [(1, "z"), (2, "b"), (7, "y")]


def test_file_sources(spark, tmp_path):
    from palimpsest.sources import cells

    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,\n")
    assert [tuple(r) for r in cells.read_text(spark, str(tmp_path / "a.txt")).collect()] == [("a.txt", "one\n\ntwo")]
    assert [r["text"] for r in cells.read_csv_rows(spark, str(tmp_path / "t.csv"), "a int, b string").collect()] == ["a: 1 | b: x", "a: 2 | b: "]
    payload = "scope=s\nsource_trust_class=primary\nsource=w\nvector=1, 2\n\nbody = text\nmore"
    got = cells.from_payloads(spark.createDataFrame([(1, payload), (2, "just text")], "cell_id long, payload string")).orderBy("cell_id").collect()
    assert (got[0]["scope"], got[0]["source_trust_q16"], got[0]["citation"], got[0]["vector"], got[0]["body_text"]) == ("s", 60000, "w", [1, 2], "body = text\nmore")
    assert (got[1]["scope"], got[1]["confidence_q16"], got[1]["body_text"]) == ("default", None, "just text")
    cells.write_checkpoint(spark.createDataFrame([(1, "s", 5), (2, "t", 4)], "cell_id long, scope string, created_unix_seconds long"), str(tmp_path / "ck"))
    assert cells.read_checkpoint(spark, str(tmp_path / "ck")).filter("scope = 't'").count() == 1


def test_json_leaves(spark):
    from palimpsest.sources.cells import json_leaves

    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": {"d": {"e": {"f": {"g": true}}}}}]}, "z": "t"}'), (2, "not json"), (3, None), (4, "{}")], "id long, j string")
    got = sorted((r["id"], r["path"], r["value"]) for r in json_leaves(df, "id", "j").collect())
    assert got == [(1, "a.b.0", "1"), (1, "a.b.1.c.d.e.f.g", "true"), (1, "z", "t"), (2, "", "not json"), (4, "", "{}")]


def test_questions():
    from palimpsest.functions import questions

    assert questions.anchors('see `old plan` in ABC-12, #7 and src/a.py v1.2 on 2024-01-02, for 5%!') == [("quoted_phrase", "old plan"), ("ticket_id", "ABC-12"), ("pull_request", "#7"), ("file_path", "src/a.py"), ("version", "v1.2"), ("date", "2024-01-02"), ("number", "5%")]
    assert questions.quoted_terms('FOR TASK "red car" IN "b') == ["red", "car"] and questions.quoted_terms("red") == []
    assert questions.expanded("red car", {"car": ["auto", "red", "van"], "red": ["auto", "scarlet"]}) == ["auto", "scarlet"]


def test_hashes():
    from palimpsest.functions.text import fnv1a64, scope_id

    assert fnv1a64(b"") == 0xCBF29CE484222325 and fnv1a64(b"a") == 0xAF63DC4C8601EC8C and scope_id("a") == 0xAF63DC4C8601EC8C & ((1 << 60) - 1)


def test_a_fact_and_a_text_are_read_once(monkeypatch):
    from palimpsest.functions import evidence as say

    read, own = [], say.python_tokens
    monkeypatch.setattr(say, "python_tokens", lambda t: read.append(t) or own(t))
    fact, text = "crate 9151 weighs 17 kg", "The crate 9151 now weighs 18 kg."
    assert say.support(fact, text) is None and say.numeric_mismatch(fact, text)[1].scaled == 18 and not say.contradicts(fact, text)
    assert sorted(read) == sorted([fact, text])

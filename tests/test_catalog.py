"""Every query of the catalogue against its SQL, and the order-dependent ones against plain Python."""

import os

import pytest

from palimpsest.plans import catalog, evidence, headers, lifecycle, questions  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_no_unreadable_scope(spark):
    got = catalog.retrieve_where_scope_status(spark, SF).select("scope").distinct().collect()
    assert {r["scope"] for r in got} <= set(catalog.VIEW.readable_scopes)


def test_pack_passes_over_large_rows(spark):
    from palimpsest.operators.packs import pack_budget

    pool = spark.createDataFrame([("p", i, i, "a" * n) for i, n in enumerate([40, 400, 20, 8])], "pack string, cell_id long, pos long, body_text string")
    got = {r["cell_id"]: (r["n_tokens"], r["taken"], r["used"]) for r in pack_budget(pool, 16).collect()}
    assert got == {0: (10, True, 10), 1: (100, False, 10), 2: (5, True, 15), 3: (2, False, 15)}
    assert [r["taken"] for r in pack_budget(pool.filter("cell_id = 1"), 16).collect()] == [True]


def test_diversify_prefers_new_terms(spark):
    from palimpsest.operators.packs import diversify

    pool = spark.createDataFrame([("p", 1, 0, "red green"), ("p", 2, 1, "red green"), ("p", 3, 2, "blue")], "pack string, cell_id long, pos long, body_text string")
    got = [r["cell_id"] for r in sorted(diversify(pool, 40000, 2).collect(), key=lambda r: r["rank"])]
    assert got == [1, 3]


def test_token_estimates_round_up_by_run(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions.text import estimate_tokens

    cases = [("", 0), (" ", 1), ("abcd", 1), ("abcde", 2), ("ab cd", 2), ("été", 3), ("!!!!!", 2), ("a\n\nb", 3), (None, 0)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r["n"] for r in df.select("i", estimate_tokens(F.col("t")).alias("n")).orderBy("i").collect()] == [n for _, n in cases]

"""Registered queries of payload headers, stems, hashes and question terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.functions.questions import MOST_PER_TERM, expanded, weights
from palimpsest.plans.catalog import ORACLE, TASK, query, synonym_pairs
from palimpsest.sources.cells import from_payloads, table

_CLASS = "CASE doc_id % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'verified' WHEN 2 THEN 'secondary' ELSE 'unknown' END"


@query("header_parse", f"""SELECT doc_id AS cell_id, 'lang:' || lang AS scope, 'ready' AS status, CAST(CASE doc_id % 4 WHEN 0 THEN 60000 WHEN 1 THEN 52000 WHEN 2 THEN 40000 ELSE 32768 END AS INTEGER) AS source_trust_q16,
  trim(source) AS citation, CAST(doc_id AS VARCHAR) AS document_id, md5(text) AS body_hash FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND trim(source) <> ''""")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made of the documents' columns and taken apart again: fields, aliases, trust by class, the body unchanged."""
    docs = table(spark, sf_dir, "documents").filter("text is not null and lang is not null and trim(source) <> ''")
    head = F.concat(F.lit("scope=lang:"), "lang", F.lit("\nsource_trust_class="), F.expr(_CLASS), F.lit("\nsource="), "source", F.lit("\ndoc_id="), F.col("doc_id").cast("string"), F.lit("\n\n"))
    cells = from_payloads(docs.select(F.col("doc_id").alias("cell_id"), F.concat(head, "text").alias("payload")))
    return cells.select("cell_id", "scope", "status", "source_trust_q16", "citation", "document_id", F.md5("body_text").alias("body_hash"))


@query("stemmed_terms", r"""WITH t AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'and', 'the', 'or', 'of', 'to', 'in', 'и', 'в', 'на', 'для', 'мен', 'және', 'с', 'со', 'за', 'от', 'до', 'по', 'о', 'об', 'у', 'да', 'де', 'та', 'те', 'үшін'))) AS term FROM conversations)
SELECT term, CASE WHEN strlen(term) > 6 AND suffix(term, 'ing') THEN term[:-4] WHEN strlen(term) > 5 AND suffix(term, 'ed') THEN term[:-3] WHEN strlen(term) > 5 AND suffix(term, 'es') THEN term[:-3] WHEN strlen(term) > 4 AND suffix(term, 's') THEN term[:-2] ELSE term END AS stem FROM t""")
def stemmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "conversations").select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", text.stem(F.col("term")).alias("stem"))


@query("enriched_fields", "SELECT p_partkey, p_name AS project, CAST(p_size AS VARCHAR) AS owner FROM part")
def enriched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields found in the first lines of a text, written with a colon or an equals sign."""
    line = F.concat(F.lit("some words\nProject : "), "p_name", F.lit("\n  owner="), F.col("p_size").cast("string"), F.lit("\nmore"))
    made = table(spark, sf_dir, "part").select("p_partkey", line.alias("text"))
    return made.select("p_partkey", text.enrichment(F.col("text"), "project").alias("project"), text.enrichment(F.col("text"), "owner").alias("owner"))


_QUESTION = f'{TASK} "haha enst" ABC-12 v1.2'


@query("question_terms", "SELECT * FROM (VALUES ('estion', 4), ('enst', 16), ('haha', 16), ('ention', 4), ('abc', 16), ('12', 16), ('v1', 10), ('2', 10)) v(term, weight)")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(weights(_QUESTION).items()), "term string, weight int")


@query("expanded_question", f"""WITH d AS ({ORACLE["synonym_pairs"]}), q AS (SELECT unnest(['enst', 'estion', 'haha', 'ention']) AS term),
a AS (SELECT synonym, min(term || chr(1) || rn) AS first FROM d JOIN q USING (term) WHERE rn <= 2 AND synonym NOT IN (SELECT term FROM q) GROUP BY 1) SELECT synonym FROM a ORDER BY first LIMIT 12""")
def expanded_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms that the corpus adds to a question; its few terms are all that is asked of the dictionary."""
    own = text.python_tokens(TASK)
    rows = synonym_pairs(spark, sf_dir).filter(F.col("term").isin(own) & (F.col("rn") <= MOST_PER_TERM)).collect()
    lists: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["term"], r["rn"])):
        lists.setdefault(r["term"], []).append(r["synonym"])
    return spark.createDataFrame([(s,) for s in expanded(TASK, lists)], "synonym string")

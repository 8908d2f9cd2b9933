"""The cells table: schema, header parsing, the corpus over the driver's tables, and file sources."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fixed base for times derived from ids; nothing reads the wall clock.
EPOCH = 1_700_000_000
SCHEMA = (
    "cell_id long, created_seq long, deleted_seq long, scope string, status string, cell_type string, memory_type string, ttl_seconds long, "
    "created_unix_seconds long, source_trust_q16 int, confidence_q16 int, source string, citation string, content_hash string, document_id string, "
    "parent_id string, chunk_role string, valid_from string, valid_to string, title string, project string, entity string, topic string, body_text string"
)
CELL_TYPES = ("raw", "document_block", "summary", "fact", "entity", "relation", "memory", "feedback", "tool", "session")
#: Header keys by column, with the spellings also read.
HEADER = {
    "scope": ("scope",), "status": ("status",), "cell_type": ("type", "cell_type"), "memory_type": ("memory_type",), "ttl_seconds": ("ttl_seconds",),
    "created_unix_seconds": ("created_unix_seconds",), "source_trust_q16": ("source_trust_q16",), "confidence_q16": ("confidence_q16",), "source": ("source",),
    "citation": ("citation",), "content_hash": ("content_hash",), "document_id": ("document_id", "doc_id"), "parent_id": ("parent_id", "parent_chunk_id"),
    "chunk_role": ("chunk_role", "chunk_kind"), "valid_from": ("valid_from",), "valid_to": ("valid_to",), "title": ("title",), "project": ("project",),
    "entity": ("entity",), "topic": ("topic",), "as_of": ("as_of",), "section": ("section",), "path": ("path",), "owner": ("owner",), "supersedes": ("supersedes",),
    "source_url": ("source_url", "url"), "row": ("row", "row_number"), "table_headers": ("table_headers", "columns"), "page": ("page",), "vector": ("vector",),
    "source_trust_class": ("source_trust_class",), "chunk_id": ("chunk_id",),
}
TRUST_CLASSES = {"primary": 60000, "verified": 52000, "secondary": 40000, "unverified": 20000}
DEFAULT_TRUST = 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` and ``labels`` as cells, deterministic."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    quality = F.col("quality")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("cell_id"), (F.col("doc_id") + 1).alias("created_seq"), F.lit(None).cast("long").alias("deleted_seq"),
        F.concat(F.lit("lang:"), "lang").alias("scope"), F.when(quality == 0, "draft").otherwise("ready").alias("status"),
        F.lit("document_block").alias("cell_type"), (F.lit(EPOCH) + F.col("doc_id") * 3600).alias("created_unix_seconds"), "source",
        F.when(quality == 1, 60000).when(quality == 0, 20000).otherwise(DEFAULT_TRUST).alias("source_trust_q16"),
        F.md5("text").alias("content_hash"), F.col("text").alias("body_text"), "n_chars",
    )


#: The same for DuckDB: a CTE named cells.
CORPUS_SQL = f"""cells AS (
  SELECT d.doc_id AS cell_id, d.doc_id + 1 AS created_seq, 'lang:' || lang AS scope, CASE WHEN quality = 0 THEN 'draft' ELSE 'ready' END AS status,
    'document_block' AS cell_type, {EPOCH} + d.doc_id * 3600 AS created_unix_seconds, source,
    CAST(CASE WHEN quality = 1 THEN 60000 WHEN quality = 0 THEN 20000 ELSE {DEFAULT_TRUST} END AS INTEGER) AS source_trust_q16,
    md5(text) AS content_hash, text AS body_text, n_chars
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"""


def parse_payload(payload: Column) -> Column:
    """A payload's header fields and body as a struct.

    The header is the leading ``key=value`` lines with known keys. An empty line or the first line with an unknown key
    ends it; the latter belongs to the body. The first of repeated keys counts.
    """
    known = {alias: name for name, aliases in HEADER.items() for alias in aliases}
    lines = F.split(payload, "\n")
    is_header = lambda x: F.trim(F.substring_index(x, "=", 1)).isin(*known) & F.contains(x, F.lit("="))
    # position of the first line that isn't a header line, from 0
    end = F.coalesce(
        F.aggregate(
            F.transform(lines, lambda x, i: F.when(~is_header(x), i)), F.lit(None).cast("int"), lambda a, i: F.coalesce(a, i)
        ),
        F.size(lines),
    )
    header = F.slice(lines, 1, end)
    pairs = F.transform(header, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, "=") + 1)).alias("v")))
    at_blank = F.trim(F.try_element_at(lines, end + 1)) == ""
    body = F.concat_ws("\n", F.slice(lines, end + F.when(at_blank, 2).otherwise(1), F.greatest(F.size(lines), F.lit(1))))
    field = lambda aliases: F.try_element_at(F.filter(pairs, lambda p: p["k"].isin(*aliases)), F.lit(1))["v"]
    return F.struct(*(field(aliases).alias(name) for name, aliases in HEADER.items()), body.alias("body_text"))


def from_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Cells of (cell_id, payload): defaults as a descriptor has them, trust by class, confidence by source."""
    parsed = df.withColumn("h", parse_payload(F.col(payload)))
    h = lambda c: F.col(f"h.{c}")
    trust = F.coalesce(h("source_trust_q16").try_cast("int"), F.element_at(F.create_map(*(F.lit(x) for kv in TRUST_CLASSES.items() for x in kv)), h("source_trust_class")), F.lit(DEFAULT_TRUST))
    has_source = F.coalesce(h("source"), h("citation")).isNotNull()
    return parsed.select(
        "cell_id", F.coalesce(h("scope"), F.lit("default")).alias("scope"), F.coalesce(h("status"), F.lit("ready")).alias("status"),
        F.coalesce(h("cell_type"), F.lit("raw")).alias("cell_type"), h("memory_type").alias("memory_type"), h("ttl_seconds").try_cast("long").alias("ttl_seconds"),
        h("created_unix_seconds").try_cast("long").alias("created_unix_seconds"), trust.alias("source_trust_q16"),
        F.coalesce(h("confidence_q16").try_cast("int"), F.when(has_source, trust)).alias("confidence_q16"),
        h("source").alias("source"), F.coalesce(h("citation"), h("source")).alias("citation"), h("document_id").alias("document_id"), h("parent_id").alias("parent_id"),
        h("chunk_id").alias("chunk_id"), h("chunk_role").alias("chunk_role"), h("valid_from").alias("valid_from"), h("valid_to").alias("valid_to"), h("as_of").alias("as_of"), h("title").alias("title"), h("project").alias("project"),
        h("entity").alias("entity"), h("topic").alias("topic"), vector_literal(h("vector")).alias("vector"), h("body_text").alias("body_text"),
    )


def vector_literal(text: Column) -> Column:
    """Comma- or space-separated 16-bit integers; null if any part isn't one."""
    parts = F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")
    values = F.transform(parts, lambda x: x.try_cast("smallint"))
    return F.when(F.exists(values, lambda x: x.isNull()), None).otherwise(values)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document_id"), F.col("value").alias("text"))


def read_csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows as ``column: value`` text; the schema is given, never inferred. The header is row 1."""
    df = spark.read.schema(schema).csv(path, header=True)
    text = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns))
    return df.select(F.col("_metadata.file_name").alias("document_id"), text.alias("text"), "*")


def json_leaves(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, value) of every leaf at any depth: dotted paths, arrays by index, numbers and booleans as text.

    The one scan of the input ends in a generator of paths; nothing is parsed again for a deeper level."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, path string, value string"

    def walk(value, path: str):
        if isinstance(value, dict) and value:
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list) and value:
            for i, v in enumerate(value):
                yield from walk(v, f"{path}.{i}" if path else str(i))
        else:
            yield path, value if isinstance(value, str) else json.dumps(value)

    def run(batches):
        for batch in batches:
            ids, paths, values = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                try:
                    parsed = json.loads(text)
                except ValueError:
                    parsed = text  # what isn't JSON is a leaf of its own
                for path, value in walk(parsed, ""):
                    ids.append(i)
                    paths.append(path)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[id_col, "path", "value"])

    return df.select(id_col, json_col).mapInArrow(run, schema)


def write_checkpoint(cells: DataFrame, path: str) -> None:
    """Cells partitioned by scope, sorted by time so that row groups prune by freshness."""
    cells.repartition("scope").sortWithinPartitions("scope", "created_unix_seconds").write.mode("overwrite").partitionBy("scope").parquet(path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

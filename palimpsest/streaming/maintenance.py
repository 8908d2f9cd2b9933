"""Derived tables kept up to date from a stream of writes, in parts by batch, and merged with the stored table at read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.lifecycle import expired

WRITE = "cell_id long, created_seq long, payload string, tombstone boolean, created long, ttl_seconds long, request_key string"


def newest(rows: DataFrame) -> DataFrame:
    """The newest version of each cell, tombstones included; of equal versions, one."""
    return rows.groupBy("cell_id").agg(F.max(F.struct(*(c for c in ["created_seq", *(c for c in rows.columns if c not in ("cell_id", "created_seq", "batch"))]))).alias("v")).select("cell_id", "v.*")


def maintain(writes: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Writes the newest version of each cell of a micro-batch under its batch number: a batch that is run again after a
    lost driver overwrites its own part, so each write counts once. Requests with a key that the batch repeats count
    once as well."""

    def store(batch: DataFrame, number: int) -> None:
        keyed = batch.filter("request_key is not null").dropDuplicates(["request_key"]).unionByName(batch.filter("request_key is null"))
        newest(keyed).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = writes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def current(spark: SparkSession, path: str, stored: DataFrame | None = None, *, now: int | None = None) -> DataFrame:
    """Live cells of the stored table and the batches since; memories whose time is over are left out where ``now`` is given."""
    delta = spark.read.schema(WRITE + ", batch int").parquet(path).drop("batch")
    rows = newest(delta if stored is None else stored.unionByName(delta)).filter("not tombstone")
    return rows if now is None else rows.filter(~expired(rows, now))


def compact(spark: SparkSession, path: str, to: str, stored: DataFrame | None = None) -> None:
    """The stored table and all batches as one table, the newest version of each cell; the batches can go then."""
    delta = spark.read.schema(WRITE + ", batch int").parquet(path).drop("batch")
    newest(delta if stored is None else stored.unionByName(delta)).write.mode("errorifexists").parquet(to)

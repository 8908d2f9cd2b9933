"""Tables written between the phases of one operator, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session names it.

    Unset: a temporary folder in local mode, where there is one machine, else the shared warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        named = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", named)
        return named
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_phases"


class Phases:
    """Writes phases as Parquet, so that a lost executor costs one phase at most, and drops those no longer read."""

    live: list[Phases] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        Phases.live.append(self)
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.paths = 0, {}

    def write(self, df: DataFrame, *, opaque: bool = False, by: str | None = None) -> DataFrame:
        """``opaque``: large binary values that are compressed already; ``by``: a column to write in parts."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        writer = df.write.option("compression", "uncompressed" if opaque else "zstd")
        if opaque:
            writer = writer.option("parquet.enable.dictionary", "false")
        if by:
            writer = writer.partitionBy(by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *dfs: DataFrame, part: str = "") -> None:
        """Removes written tables, or a part of them, that nothing reads any more; other DataFrames are passed over."""
        for df in dfs:
            path, _ = self.paths.get(id(df), (None, None)) if part else self.paths.pop(id(df), (None, None))
            if path:
                path += f"/{part}" if part else ""
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    @classmethod
    def release(cls, *keep: Phases) -> None:
        """Drops all phases but those of ``keep``: for a caller that has written what its operators returned."""
        for phases in cls.live:
            if phases not in keep:
                phases.drop(*(df for _, df in list(phases.paths.values())))
        cls.live = [phases for phases in cls.live if phases in keep]

    def settle(self) -> None:
        """Has Spark drop the exchanges of finished phases, which it else does when the driver next runs low.

        Its scheduler holds on to those of the last job until another one runs."""
        self.spark.range(1).collect()
        gc.collect()
        self.spark._jvm.System.gc()

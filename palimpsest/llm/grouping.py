"""Key groups streamed from sorted Arrow batches, and connected components by stored rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Phases


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of equal keys; the input is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        rows = list(zip(*columns, strict=True))
        for i, row in enumerate(rows):
            if key is not None and row != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield key, pa.Table.from_batches(held)
                held, start = [], i
            key = row
        held.append(batch.slice(start))
    if held:
        yield key, pa.Table.from_batches(held)


def hash_key(*columns: Column) -> Column:
    return F.xxhash64(*columns)


#: Rows of a hub that one task takes, at least, and the most hubs that are split: their table is broadcast.
HUB_ROWS, SPLIT_HUBS = 512, 100_000


def in_parts(links: DataFrame, phases: Phases) -> DataFrame:
    """Rows (node, hub, part, parts): a hub with many nodes is cut into parts by a hash of the node.

    The rows of a part grow with those of all hubs once ``SPLIT_HUBS`` would not do, so no more hubs than that are split."""
    rows = max(HUB_ROWS, -(-links.count() // SPLIT_HUBS))
    many = links.groupBy("hub").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")).filter("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    return phases.write(links.join(F.broadcast(many), "hub", "left").select("node", "hub", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), parts.alias("parts")))


def to_parts(hubs: DataFrame) -> DataFrame:
    """Rows of hubs (hub, parts, …), one for each part."""
    return hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def components(incidence: DataFrame, phases: Phases, *, stored: bool = False) -> DataFrame:
    """(node, component): the least node reachable through shared hubs, from rows (node, hub); ``stored`` if they are
    distinct and written already.

    Each round takes the least label of every hub (summed map-side, so a hub with most of the nodes costs one row
    a task), hands it to the hub's nodes, part by part, and then jumps to the label of the label. Rounds are written
    out and only the number of changed labels reaches the driver.
    """
    given = incidence if stored else phases.write(incidence.select("node", "hub").distinct())
    links = in_parts(given, phases)
    if not stored:
        phases.drop(given)
    labels = phases.write(links.groupBy("node").agg(F.min("node").alias("component")))
    while True:
        hubs = links.join(labels, "node").groupBy("hub").agg(F.min("component").alias("least"), F.max("parts").alias("parts"))
        told = links.join(to_parts(hubs), ["hub", "part"]).groupBy("node").agg(F.min("least").alias("component"))
        told = phases.write(told)
        jump = told.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = phases.write(told.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = moved.join(labels.withColumnRenamed("component", "before"), "node").filter("component <> before").limit(1).count()
        phases.drop(labels, told)
        labels = moved
        if not changed:
            phases.drop(links)
            return labels

"""Writes, deletions, transactions, logs and maintenance over versioned cells, as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.operators.relational import snapshot


def point_get(versions: DataFrame, cell_id, seq: int, key: str = "cell_id") -> DataFrame:
    """The visible version of one key at ``seq``; the key's filter reaches the scan."""
    return snapshot(versions.filter(F.col(key) == cell_id), seq, key)


def range_scan(versions: DataFrame, low, high, seq: int, key: str = "cell_id") -> DataFrame:
    """Visible versions of keys from ``low`` to ``high``, both included."""
    return snapshot(versions.filter(F.col(key).between(low, high)), seq, key)


def deleted_ids(versions: DataFrame, seq: int, key: str = "cell_id") -> DataFrame:
    """Keys whose newest version at ``seq`` is a tombstone, with its sequence."""
    newest = versions.filter(F.col("created_seq") <= seq).groupBy(key).agg(F.max(F.struct("created_seq", "tombstone")).alias("v"))
    return newest.filter("v.tombstone").select(key, F.col("v.created_seq").alias("deleted_seq"))


def version_stats(versions: DataFrame, key: str = "cell_id") -> DataFrame:
    """One row: cells, live, deleted, versions, tombstones, the deepest history."""
    per = versions.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(F.col("tombstone"), 1)).alias("t"), F.max(F.struct("created_seq", "tombstone")).alias("v"))
    return per.agg(
        F.count("*").alias("cells"), F.count(F.when(~F.col("v.tombstone"), 1)).alias("live"), F.count(F.when(F.col("v.tombstone"), 1)).alias("deleted"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.coalesce(F.sum("t"), F.lit(0)).alias("tombstones"), F.coalesce(F.max("n"), F.lit(0)).alias("depth"),
    )


def apply_batch(versions: DataFrame, writes: DataFrame, first_seq: int) -> DataFrame:
    """``versions`` with a batch of writes (op, cell_id, payload, pos) as one: put, patch (its payload where it has one,
    else the live one) and tombstone. The batch's sequences follow on from ``first_seq`` by position; of writes to
    one cell the last is the newest."""
    live = snapshot(versions, first_seq - 1).select("cell_id", F.col("payload").alias("old_"))
    made = writes.join(live, "cell_id", "left")
    payload = F.when(F.col("op") == "patch", F.coalesce("payload", "old_")).when(F.col("op") == "put", F.col("payload"))
    new = made.select("cell_id", (F.lit(first_seq) + F.col("pos")).alias("created_seq"), payload.alias("payload"), (F.col("op") == "tombstone").alias("tombstone"))
    return versions.unionByName(new)


def transaction_conflicts(versions: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads (tx_id, base_seq, cell_id) of cells that were written or deleted after the base: tx_id, cell_id, reason."""
    later = reads.join(versions, "cell_id").filter(F.col("created_seq") > F.col("base_seq"))
    return later.groupBy("tx_id", "cell_id").agg(F.max(F.struct("created_seq", "tombstone")).alias("v")).select("tx_id", "cell_id", F.when(F.col("v.tombstone"), "deleted_after_base").otherwise("written_after_base").alias("reason"))


def replay(log: DataFrame, *, strict: bool) -> DataFrame:
    """Records (batch, seq, ok) up to the first that is broken. Best effort keeps what comes before; strict keeps whole
    batches only, so that a batch is applied altogether or not at all."""
    broken = log.filter(~F.col("ok")).agg(F.min("seq").alias("broken_seq"), F.min("batch").alias("broken_batch"))
    kept = log.crossJoin(F.broadcast(broken))  # one row
    inside = F.col("batch") < F.col("broken_batch") if strict else F.col("seq") < F.col("broken_seq")
    return kept.filter(F.col("broken_seq").isNull() | inside).drop("broken_seq", "broken_batch")


def expired(memories: DataFrame, now: int) -> Column:
    """Whether a memory's time to live is over; without one it never is."""
    return F.coalesce(F.col("ttl_seconds") > 0, F.lit(False)) & F.coalesce(F.col("created") + F.col("ttl_seconds") <= now, F.lit(False))


def compaction_plan(segments: DataFrame, *, least: int = 6, most: int = 4, most_bytes: int = 64 << 20) -> DataFrame:
    """Segments (space, segment, n_bytes) to be merged: the smallest ``most`` of a space that has ``least`` or more, as
    long as they stay within ``most_bytes``."""
    space, by_size = Window.partitionBy("space"), Window.partitionBy("space").orderBy("n_bytes", "segment")
    ranked = segments.withColumn("n", F.count("*").over(space)).withColumn("rn", F.row_number().over(by_size)).withColumn("upto", F.sum("n_bytes").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter((F.col("n") >= least) & (F.col("rn") <= most) & (F.col("upto") <= most_bytes)).select("space", "segment", "n_bytes")


def rate_windows(requests: DataFrame, *, seconds: int, most: int) -> DataFrame:
    """Requests (id, key, created) as accepted or deferred: at most ``most`` of a key in each window of ``seconds``."""
    window = fixed.div(F.col("created"), seconds)
    rank = F.row_number().over(Window.partitionBy("key", window).orderBy("created", "id"))
    return requests.withColumn("outcome", F.when(rank <= most, "accepted").otherwise("deferred"))


def sampled(requests: DataFrame, *, one_in: int = 8, warm_up: int = 32) -> DataFrame:
    """Requests (key, pos from 0) whose recall is to be checked: all of the first ``warm_up`` of a key, then one in so many."""
    return requests.filter((F.col("pos") < warm_up) | (F.col("pos") % one_in == 0))


def job_progress(steps: DataFrame) -> DataFrame:
    """Jobs (job, pos, kind in step, failed, done) in their last state: the first failure or end decides."""
    first = F.min(F.when(F.col("kind").isin("failed", "done"), F.struct("pos", "kind")))
    per = steps.groupBy("job").agg(F.count(F.when(F.col("kind") == "step", 1)).alias("n_steps"), first.alias("end"))
    return per.select("job", "n_steps", F.coalesce("end.kind", F.lit("running")).alias("state"))


def visible_at(required: DataFrame, applied_seq: int) -> DataFrame:
    """Handoffs (id, require_seq) with whether a reader at ``applied_seq`` may go on."""
    return required.withColumn("visible", F.col("require_seq") <= applied_seq)


def compression_candidates(memories: DataFrame, now: int, *, older_than: int, summarised: DataFrame) -> DataFrame:
    """Stale memories (cell_id, memory_type, created) no summary has yet, oldest first within a type: memory_type, rn, cell_id."""
    stale = memories.filter(F.lit(now) - F.col("created") >= older_than).join(summarised.select("cell_id"), "cell_id", "left_anti")
    return stale.withColumn("rn", F.row_number().over(Window.partitionBy("memory_type").orderBy("created", "cell_id")).cast("long")).select("memory_type", "rn", "cell_id")


def cardinality(counts: dict[str, int], live: int, node) -> int:
    """Rows a condition may match: a leaf's count, the smaller for AND, the sum for OR, the rest for NOT; never above ``live``."""
    kind = node[0]
    if kind == "leaf":
        return min(counts.get(node[1], 0), live)
    if kind == "not":
        return live - cardinality(counts, live, node[1])
    sizes = [cardinality(counts, live, x) for x in node[1:]]
    return min(sizes) if kind == "and" else min(sum(sizes), live)


def nearest_rank(df: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """(percent, value) percentiles by nearest rank."""
    ranked = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    # counts of distinct values, summed; the window runs over distinct values only
    upto = ranked.withColumn("upto", F.sum("n").over(Window.orderBy(value))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    wanted = upto.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).filter(F.col("upto") >= F.ceil(F.col("percent") * F.col("all") / 100.0))
    return wanted.groupBy("percent").agg(F.min(value).alias("value"))

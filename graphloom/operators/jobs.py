"""Chunk leases as relations: dispatch, reclaim, cancel, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

LEASE_SECONDS = max(7200, 1800) + 300


def latest(events: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """The last event of each key: one map-side combined aggregation."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_e")).select(*keys, "_e.*")


def dispatched(chunks: DataFrame, limit: int, now: str) -> DataFrame:
    """Chunks after giving free slots of each job to its first pending ones: status and lease."""
    active = F.count_if(F.col("status") == "processing").over(Window.partitionBy("job_id"))
    turn = F.row_number().over(Window.partitionBy("job_id", "status").orderBy("chunk_index"))
    take = (F.col("status") == "pending") & (turn <= F.lit(limit) - active)
    rows = chunks.withColumn("_take", take)
    lease = F.to_timestamp(F.lit(now)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(LEASE_SECONDS))
    return rows.withColumn("status", F.when(F.col("_take"), "processing").otherwise(F.col("status"))).withColumn("lease_expires_at", F.when(F.col("_take"), lease).otherwise(F.col("lease_expires_at"))).drop("_take")


def reclaimed(chunks: DataFrame, now: str, cancelled: DataFrame | None = None) -> DataFrame:
    """Chunks after expired leases of jobs that aren't cancelled went back to pending."""
    rows = chunks if cancelled is None else chunks.join(cancelled.select("job_id").distinct().withColumn("_gone", F.lit(True)), "job_id", "left")
    gone = F.lit(False) if cancelled is None else F.coalesce("_gone", F.lit(False))
    stale = (F.col("status") == "processing") & (F.col("lease_expires_at") <= F.to_timestamp(F.lit(now)).cast("timestamp_ntz")) & ~gone
    free = F.lit(None).cast("timestamp_ntz")
    return rows.withColumn("_stale", F.coalesce(stale, F.lit(False))).select(*[c for c in chunks.columns if c not in ("status", "lease_expires_at")], F.when(F.col("_stale"), "pending").otherwise(F.col("status")).alias("status"), F.when(F.col("_stale"), free).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"))


def cancelled(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Chunks after the active ones of some jobs were cancelled."""
    hit = jobs.select("job_id").distinct().withColumn("_hit", F.lit(True))
    active = F.col("status").isin("pending", "processing") & F.col("_hit")
    return chunks.join(hit, "job_id", "left").withColumn("status", F.when(F.coalesce(active, F.lit(False)), "cancelled").otherwise(F.col("status"))).drop("_hit")


def fanned_out(existing: DataFrame, chunks: DataFrame) -> DataFrame:
    """Existing chunks with the texts of pending ones refreshed, and new (job, index) as pending: the same call twice changes nothing."""
    new = chunks.select("job_id", "chunk_index", F.col("text").alias("_text"))
    rows = existing.join(new, ["job_id", "chunk_index"], "full_outer")
    keep = F.col("status").isNotNull() & (F.col("status") != "pending")
    return rows.select("job_id", "chunk_index", F.when(keep, F.col("text")).otherwise(F.coalesce("_text", "text")).alias("text"), F.coalesce("status", F.lit("pending")).alias("status"))


def purged(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    return queue.join(jobs.select("job_id").distinct(), "job_id", "left_anti")

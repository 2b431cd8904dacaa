"""Job events as a stream: progress per job, leases that expire by event time, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.jobs import LEASE_SECONDS

PROGRESS = "job_id string, done int, failed int, percent int, status string"


def source(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Event files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def progress(events: DataFrame) -> DataFrame:
    """A row per job and batch from (job_id, chunk_index, state, n_chunks): each chunk counts once, its last state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, failed = (set(x) for x in state.get) if state.exists else (set(), set())
        total = 1
        for frame in frames:
            total = max(total, int(frame.n_chunks.max()))
            for chunk, what in zip(frame.chunk_index.tolist(), frame.state.tolist(), strict=True):
                (done.discard, failed.discard)[what == "completed"](chunk)
                if what in ("completed", "failed"):
                    (done if what == "completed" else failed).add(chunk)
        state.update((sorted(done), sorted(failed)))
        ended = len(done) + len(failed)
        status = "processing" if ended < total else "failed" if failed else "completed"
        yield pd.DataFrame([(key[0], len(done), len(failed), min(100, 100 * ended // total), status)], columns=["job_id", "done", "failed", "percent", "status"])

    return events.groupBy("job_id").applyInPandasWithState(step, PROGRESS, "done array<int>, failed array<int>", "update", GroupStateTimeout.NoTimeout)


def expired_leases(events: DataFrame, seconds: int = LEASE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """(job_id, chunk_index, lease_expires_at) of chunks that began and didn't end before their lease ran out, by event time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            until = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], key[1], pd.Timestamp(until, unit="ms"))], columns=["job_id", "chunk_index", "lease_expires_at"])
            return
        began = state.get[0] - 1000 * seconds if state.exists else None
        ended = None
        for frame in frames:
            for what, at in zip(frame.state.tolist(), frame.ts.tolist(), strict=True):
                ms = int(pd.Timestamp(at).timestamp() * 1000)
                if what == "processing":
                    began = ms if began is None else max(began, ms)
                else:
                    ended = ms if ended is None else max(ended, ms)
        if began is None or (ended is not None and ended >= began):
            if state.exists:
                state.remove()
            return
        until = began + 1000 * seconds
        state.update((until,))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("ts", delay).groupBy("job_id", "chunk_index")
    return keyed.applyInPandasWithState(step, "job_id string, chunk_index int, lease_expires_at timestamp", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value): tumbling counts with late events up to ``delay``; an extension of ours."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def run_once(rows: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a restart goes on where it ended."""
    return rows.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

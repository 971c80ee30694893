"""Micro-batches: work queues with leases, and windows over events.

The windows are an extension of this library; what it is modelled on polls its tables instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import states as st
from ..operators.relations import fair_queue


def claim(queue: DataFrame, server: str, now: Column, k: int = 20) -> DataFrame:
    """The next k open tasks, owners taking turns, marked as running."""
    return fair_queue(queue.where("progress = 0"), "study", ["id"], k).drop("turn").withColumns({"progress": F.lit(2), "job_server": F.lit(server), "created_at": now})


def recover(queue: DataFrame, now: Column, server: str, minutes: int = 10) -> DataFrame:
    """Expired leases go back to the queue with one more try; those without tries left fail."""
    c = F.col
    lost = st.lease_lost(c("progress"), c("counter"), c("created_at"), now, minutes)
    back = st.lease_expired(c("progress"), c("counter"), c("job_server"), c("created_at"), now, server, minutes)
    return queue.select(*[c(x) for x in queue.columns if x not in ("progress", "counter", "job_server")], F.when(lost, -1).when(back, 0).otherwise(c("progress")).alias("progress"), F.when(back, c("counter") + 1).otherwise(c("counter")).alias("counter"), F.when(back | lost, F.lit(None).cast("string")).otherwise(c("job_server")).alias("job_server"))


def reset_stuck(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status") == 2, 0).otherwise(F.col("status")))


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Hand each micro-batch to ``handle``; without ``seconds`` what is there is worked off once."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums for each window and type; works on streams and on tables."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size, slide or size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users") if not events.isStreaming else F.approx_count_distinct("user_id").alias("n_users"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "n_users")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("session_start"), "n")

"""Polled snapshots as streams.

Where every poll is judged alone there is no state and nothing to expire.  Two streams keep state, bounded by a
watermark: reservations that count once however often they are delivered, and alerts as episodes.  A
restart continues from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from runlens.functions.clock import SNAPSHOT_ZONE, snapshot_day
from runlens.plans.infra import TIME_ORIGIN, USAGE_LIMIT, alerting_samples, reservation_flatten, usage_percent


def snapshot_stream(spark: SparkSession, folder: str, schema: StructType, name_filter: str | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def append_available(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Start appending everything that has arrived; the query ends by itself."""
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).start(path)


def reservation_stream(raw: DataFrame, path: str, checkpoint: str, zone: str = SNAPSHOT_ZONE) -> StreamingQuery:
    """Flatten new reservation snapshots and append them by day."""
    flat = reservation_flatten(raw).withColumn("day", snapshot_day(F.col("poll_time"), zone))
    return append_available(flat, path, checkpoint, ["day"])


def host_alerts(samples: DataFrame, limit: int = USAGE_LIMIT) -> DataFrame:
    """Samples at or over the limit, per host and sample time; works on batch and streaming input."""
    pct = usage_percent(F.col("used"), F.col("total"))
    return samples.withColumn("pct", pct).filter(F.col("pct") >= limit).select("event_id", "host", "ts", "metric", "pct")


def host_alert_stream(samples: DataFrame, path: str, checkpoint: str, limit: int = USAGE_LIMIT) -> StreamingQuery:
    return append_available(host_alerts(samples, limit), path, checkpoint)


def _instant(at: Column) -> Column:
    """A time without zone as the instant of that UTC time, whatever the session's zone: watermarks need instants."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(TIME_ORIGIN).cast("timestamp_ntz"), at))


def _without_zone(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit(TIME_ORIGIN).cast("timestamp_ntz"))


RESERVATION_KEY = ["project", "zone", "reservation_name", "poll_time"]


def reservation_stream_distinct(
    raw: DataFrame, path: str, checkpoint: str, delay: str = "2 days", zone: str = SNAPSHOT_ZONE
) -> StreamingQuery:
    """As ``reservation_stream``, but a snapshot of one reservation at one poll time is stored once.

    Keys are kept in state until the watermark, the newest poll time less the delay, has passed them.  What arrives later
    than the delay is left out, first or again, so the delay must cover the latest first delivery.
    """
    timed = reservation_flatten(raw).withColumn("_at", _instant(F.col("poll_time"))).withWatermark("_at", delay)
    flat = timed.dropDuplicatesWithinWatermark(RESERVATION_KEY).drop("_at")
    return append_available(flat.withColumn("day", snapshot_day(F.col("poll_time"), zone)), path, checkpoint, ["day"])


def alert_episode_stream(
    samples: DataFrame, path: str, checkpoint: str, gap_minutes: int, delay: str, limit: int = USAGE_LIMIT
) -> StreamingQuery:
    """Append the episodes of ``plans.infra.alert_episodes`` that are over: the watermark has passed their gap.

    The watermark is the newest alert less the delay; samples may arrive out of order by that much.
    """
    alerts = alerting_samples(samples, limit).withColumn("_at", _instant(F.col("ts"))).withWatermark("_at", delay)
    session = F.session_window("_at", f"{gap_minutes} minutes")
    found = alerts.groupBy("host", "metric", "mount", session).agg(
        F.max("ts").alias("last_at"), F.max("pct").alias("peak"), F.count(F.lit(1)).alias("samples")
    )
    episodes = found.select("host", "metric", "mount", _without_zone(F.col("session_window.start")).alias("started_at"), "last_at", "peak", "samples")
    return append_available(episodes, path, checkpoint)

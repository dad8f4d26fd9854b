"""Streams over the snapshot tables, run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import PARTS, entry
from runlens.plans import infra
from runlens.plans.infra import USAGE_LIMIT
from runlens.sources.tables import work_dir
from runlens.sources.views import VIEWS
from runlens.streaming import polls


def streamed_view(v, name):
    """A derived view over the events as they arrive."""
    polls.snapshot_stream(v.spark, v.sf_dir, v.events.schema, "events.parquet").createOrReplaceTempView("arriving_events")
    return v.spark.sql(VIEWS[name].replace("FROM events", "FROM arriving_events"))


@entry(
    "reservation_stream",
    "SELECT *, CAST((poll_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) AS day FROM o_reservation",
)
def reservation_stream(v):
    raw = streamed_view(v, "reservation_raw")
    folder = work_dir(v.spark, "reservation-stream")
    polls.reservation_stream(raw, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{folder}/table")


@entry(
    "host_alert_stream",
    f"""
SELECT event_id, host, ts, metric, CAST(floor(100 * used / nullif(total, 0)) AS BIGINT) AS pct FROM host_metric WHERE floor(100 * used / nullif(total, 0)) >= {USAGE_LIMIT}""",
)
def host_alert_stream(v):
    samples = streamed_view(v, "host_metric")
    folder = work_dir(v.spark, "host-alert-stream")
    polls.host_alert_stream(samples, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{folder}/table")


def deliveries(v):
    """The raw snapshots in three deliveries by time; some arrive late by up to a day, some again."""
    at, key = F.dayofmonth("poll_time"), F.col("event_id")
    late = (at == 10) & (key % 11 == 0)
    wanted = [(at <= 10) & ~late, at.between(11, 20) | late | ((at <= 10) & (key % 5 == 0)), (at > 20) | (at.between(18, 20) & (key % 3 == 0))]
    return [v.reservation_raw.filter(w) for w in wanted]


@entry(
    "reservation_stream_distinct",
    "SELECT *, CAST((poll_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) AS day FROM o_reservation",
)
def reservation_stream_distinct(v):
    """Three deliveries, each met by a new start of the stream."""
    folder = work_dir(v.spark, "reservations-once")
    for delivery in deliveries(v):
        delivery.write.mode("append").parquet(f"{folder}/arriving")
        raw = polls.snapshot_stream(v.spark, f"{folder}/arriving", v.reservation_raw.schema)
        polls.reservation_stream_distinct(raw, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{folder}/table")


GAP, DELAY = 240, 6
PARTS["o_alerts"] = f"""
SELECT host, metric, mount, ts, CAST(floor(100 * used / nullif(total, 0)) AS BIGINT) AS pct FROM host_metric
WHERE floor(100 * used / nullif(total, 0)) >= {USAGE_LIMIT}"""
PARTS["o_episodes"] = f"""
SELECT host, metric, mount, min(ts) AS started_at, max(ts) AS last_at, max(pct) AS peak, count(*) AS samples
FROM (SELECT *, sum(begins) OVER (PARTITION BY host, metric, mount ORDER BY ts) AS episode
 FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY host, metric, mount ORDER BY ts) + INTERVAL '{GAP}' MINUTE THEN 0 ELSE 1 END AS begins
  FROM o_alerts) b) e
GROUP BY host, metric, mount, episode"""


@entry("host_alert_episodes", "SELECT * FROM o_episodes")
def host_alert_episodes(v):
    return infra.alert_episodes(v.host_metric, GAP)


@entry(
    "host_alert_episode_stream",
    f"SELECT * FROM o_episodes WHERE last_at + INTERVAL '{GAP}' MINUTE <= (SELECT max(ts) FROM o_alerts) - INTERVAL '{DELAY}' HOUR",
)
def host_alert_episode_stream(v):
    """Episodes that are over when everything has arrived."""
    samples = streamed_view(v, "host_metric")
    folder = work_dir(v.spark, "alert-episodes")
    polls.alert_episode_stream(samples, f"{folder}/table", f"{folder}/checkpoint", GAP, f"{DELAY} hours").awaitTermination()
    return v.spark.read.parquet(f"{folder}/table")

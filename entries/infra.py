"""Clusters, hosts, reservations, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import AS_OF, PARTS, entry
from entries.logs import DURATION
from runlens.functions import clock as C
from runlens.functions.predicates import name_not_like
from runlens.plans import infra
from runlens.sources import commits
from runlens.sources.tables import daily_partition_append, scan_table, work_dir

NOW = f"TIMESTAMP '{AS_OF}'"


# Tables


@entry("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_table_entry(v):
    return scan_table(v.spark, f"{v.sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@entry("scan_table_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def scan_table_where(v):
    where = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    return scan_table(v.spark, f"{v.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], where)


# Clusters

PARTS["o_clusters"] = f"""
SELECT *, CAST(floor(date_diff('second', state_start_time, {NOW}) / 60) AS BIGINT) AS minutes, date_diff('second', state_start_time, {NOW}) AS seconds
FROM cluster_state WHERE status = 'RUNNING' AND NOT contains(cluster_name, 'phs') AND NOT contains(cluster_name, 'persistent')"""


@entry("exclude_name_patterns", "SELECT project, cluster_name FROM cluster_state WHERE NOT regexp_matches(cluster_name, 'phs|persistent')")
def exclude_name_patterns(v):
    return v.cluster_state.filter(name_not_like("cluster_name", infra.KEPT_CLUSTERS)).select("project", "cluster_name")


@entry("elapsed_minutes", f"SELECT cluster_name, CAST(floor(date_diff('second', state_start_time, {NOW}) / 60) AS BIGINT) AS minutes FROM cluster_state")
def elapsed_minutes(v):
    return v.cluster_state.select("cluster_name", C.whole_minutes(F.col("state_start_time"), C.moment(AS_OF)).alias("minutes"))


@entry("long_running_clusters", "SELECT project, cluster_name, minutes FROM o_clusters WHERE minutes > 120")
def long_running_clusters(v):
    return infra.long_running_clusters(v.cluster_state, AS_OF, 120)


@entry("long_runner_count", "SELECT count(*) AS long_runners, count(*) = 0 AS none_found FROM o_clusters WHERE minutes > 120")
def long_runner_count(v):
    return infra.long_runner_count(v.cluster_state, AS_OF, 120)


PARTS["o_cluster_list"] = f"""
SELECT project, cluster_name, {DURATION.format(s='seconds')} AS elapsed,
 row_number() OVER (PARTITION BY project ORDER BY state_start_time, cluster_name) AS number FROM o_clusters"""


@entry("numbered_list", "SELECT project, number, cluster_name FROM o_cluster_list")
def numbered_list(v):
    return infra.cluster_uptime_list(v.cluster_state, AS_OF).select("project", "number", "cluster_name")


@entry(
    "cluster_uptime_list",
    "SELECT *, '[' || CAST(number AS VARCHAR) || '] ' || cluster_name || ' Cluster is running since last :- ' || elapsed AS text FROM o_cluster_list",
)
def cluster_uptime_list(v):
    return infra.cluster_uptime_list(v.cluster_state, AS_OF)


# Hosts


@entry("usage_percent", "SELECT event_id, host, metric, CAST(floor(100 * used / nullif(total, 0)) AS BIGINT) AS pct FROM host_metric")
def usage_percent(v):
    return v.host_metric.select("event_id", "host", "metric", infra.usage_percent(F.col("used"), F.col("total")).alias("pct"))


@entry("host_any_alert", "SELECT host, bool_or(coalesce(pct >= 60, false)) AS alert FROM o_usage GROUP BY 1")
def host_any_alert(v):
    return infra.host_any_alert(infra.latest_usage(v.host_metric), 60)


def top(metric: str, by: str, limit: int) -> str:
    return f"""
SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY {by} DESC, pid) AS INTEGER) AS place, pid, cmd, {by}
FROM (SELECT * FROM process_sample QUALIFY rank() OVER (PARTITION BY host ORDER BY ts DESC) = 1) p
WHERE host IN (SELECT host FROM o_usage WHERE metric = '{metric}' AND pct >= {limit}) QUALIFY place <= 20"""


PARTS["o_top_memory"] = top("memory", "pct_mem", 60)
PARTS["o_top_cpu"] = top("cpu", "pct_cpu", 60)


@entry("top20_memory", "SELECT * FROM o_top_memory")
def top20_memory(v):
    return infra.top20_memory(v.process_sample, infra.latest_usage(v.host_metric), 60)


@entry("top20_cpu", "SELECT * FROM o_top_cpu")
def top20_cpu(v):
    return infra.top20_cpu(v.process_sample, infra.latest_usage(v.host_metric), 60)


PARTS["o_top_disk"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY host, mount ORDER BY size_bytes DESC NULLS LAST, path) AS INTEGER) AS place FROM (
 SELECT *, CAST(floor(TRY_CAST(regexp_extract(size_text, '^([0-9.]+)', 1) AS DOUBLE) * CASE right(size_text, 1) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576
  WHEN 'G' THEN 1073741824 WHEN 'T' THEN 1099511627776 ELSE 1 END) AS BIGINT) AS size_bytes FROM dir_usage) s
WHERE (host, mount) IN (SELECT (host, mount) FROM o_usage WHERE metric IN ('disk', 'mount') AND pct >= 60) QUALIFY place <= 20"""


@entry("top20_disk", "SELECT * FROM o_top_disk")
def top20_disk(v):
    return infra.top20_disk(v.dir_usage, infra.latest_usage(v.host_metric), 60)


@entry("split_mount_list", "SELECT config_id, host, unnest(string_split(mounts, ',')) AS mount FROM host_config")
def split_mount_list(v):
    return infra.split_mount_list(v.host_config)


PARTS["o_hosts"] = f"""
SELECT host, {', '.join(f"max(pct) FILTER (WHERE metric = '{m}') AS {m}_pct" for m in ('memory', 'disk', 'cpu', 'mount'))},
 count(*) FILTER (WHERE pct >= 60) AS breached, bool_or(coalesce(pct >= 60, false)) AS alert,
 string_agg(mount || ' ' || coalesce(CAST(pct AS VARCHAR) || '%', 'NA'), chr(10) ORDER BY mount) FILTER (WHERE metric = 'mount') AS mounts
FROM o_usage GROUP BY 1"""


@entry(
    "host_health",
    """
SELECT h.*, m.pid AS mem_top_pid, c.pid AS cpu_top_pid FROM o_hosts h
LEFT JOIN o_top_memory m ON h.host = m.host AND m.place = 1 LEFT JOIN o_top_cpu c ON h.host = c.host AND c.place = 1""",
)
def host_health(v):
    return infra.host_health(v.host_metric, v.process_sample, 60)


def tasks(part: str) -> str:
    return f"(SELECT host, string_agg(CAST(pid AS VARCHAR) || ' ' || cmd, chr(10) ORDER BY place) AS tasks FROM {part} GROUP BY 1)"


@entry(
    "host_health_report",
    f"""
SELECT h.host, 'Alert from ' || h.host AS subject, h.host || ': a limit of 60% is reached' || chr(10) || 'disk ' || coalesce(CAST(disk_pct AS VARCHAR), 'NA')
 || '%, memory ' || coalesce(CAST(memory_pct AS VARCHAR), 'NA') || '%, cpu ' || coalesce(CAST(cpu_pct AS VARCHAR), 'NA') || '%' || chr(10)
 || 'mounts:' || chr(10) || coalesce(mounts, '') || chr(10) || 'most memory:' || chr(10) || coalesce(m.tasks, '') || chr(10)
 || 'most cpu:' || chr(10) || coalesce(c.tasks, '') || chr(10) || 'largest directories:' || chr(10) || coalesce(d.paths, '') AS message
FROM o_hosts h LEFT JOIN {tasks('o_top_memory')} m ON h.host = m.host LEFT JOIN {tasks('o_top_cpu')} c ON h.host = c.host
LEFT JOIN (SELECT host, string_agg(size_text || ' ' || path, chr(10) ORDER BY mount, place) AS paths FROM o_top_disk GROUP BY 1) d ON h.host = d.host
WHERE h.alert""",
)
def host_health_report(v):
    return infra.host_health_report(v.host_metric, v.process_sample, v.dir_usage, 60)


# Reservations

PARTS["o_reservation"] = """
SELECT event_id, poll_time, project, zone, json_extract_string(j, '$.name') AS reservation_name,
 json_extract_string(j, '$.specificReservation.instanceProperties.machineType') AS machine_type,
 CAST(json_extract_string(j, '$.specificReservation.count') AS BIGINT) AS res_cnt,
 CAST(json_extract_string(j, '$.specificReservation.inUseCount') AS BIGINT) AS in_use_count,
 CAST(json_extract_string(j, '$.specificReservation.assuredCount') AS BIGINT) AS assured_count,
 json_extract_string(j, '$.creationTimestamp') AS res_timestamp
FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM reservation_raw) r
WHERE json_extract(j, '$.specificReservation.instanceProperties') IS NOT NULL"""
PARTS["o_usage_rows"] = """
SELECT event_id, project AS teams_space,
 strftime((date_trunc('second', poll_time) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago', '%Y-%m-%d %H:%M:%S') AS curr_time_cst,
 res_timestamp, reservation_name, machine_type, zone AS zne, res_cnt, in_use_count, assured_count,
 CAST((poll_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) AS day FROM o_reservation"""


@entry("reservation_flatten", "SELECT * FROM o_reservation")
def reservation_flatten(v):
    return infra.reservation_flatten(v.reservation_raw)


@entry("reservation_rejects", "SELECT event_id, poll_time, project, zone, body FROM reservation_raw WHERE event_id NOT IN (SELECT event_id FROM o_reservation)")
def reservation_rejects(v):
    return infra.reservation_rejects(v.reservation_raw)


@entry("reservation_usage", "SELECT * FROM o_usage_rows")
def reservation_usage(v):
    return infra.reservation_usage(v.reservation_raw)


@entry(
    "csv_row_text",
    """
SELECT event_id, concat_ws(',', teams_space, curr_time_cst, res_timestamp, coalesce(reservation_name, 'None'), coalesce(machine_type, 'None'), zne, res_cnt,
 coalesce(CAST(in_use_count AS VARCHAR), 'None'), assured_count, teams_space) AS row
FROM o_usage_rows""",
)
def csv_row_text(v):
    return infra.csv_row_text(infra.reservation_usage(v.reservation_raw))


@entry("csv_row_split", "SELECT * EXCLUDE (day) FROM o_usage_rows")
def csv_row_split(v):
    return infra.csv_row_split(infra.csv_row_text(infra.reservation_usage(v.reservation_raw)))


@entry(
    "daily_partition_append",
    "SELECT *, CAST((poll_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) AS day FROM o_reservation",
)
def daily_partition_append_entry(v):
    """Two appends to one table, read back: the reservations of half the zones each."""
    flat = infra.reservation_flatten(v.reservation_raw)
    path = work_dir(v.spark, "reservations")
    daily_partition_append(flat.filter("zone = 'zone-0'"), F.col("poll_time"), path)
    daily_partition_append(flat.filter("zone <> 'zone-0'"), F.col("poll_time"), path)
    return v.spark.read.parquet(path)


@entry(
    "daily_append_once",
    "SELECT *, CAST((poll_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) AS day FROM o_reservation",
)
def daily_append_once(v):
    """Three batches, one given twice, one after an attempt that failed between writing and committing."""
    flat, at = infra.reservation_flatten(v.reservation_raw), F.col("poll_time")
    path = work_dir(v.spark, "reservations-once")
    batches = {f"poll-{zone}": flat.filter(F.col("zone") == f"zone-{zone}") for zone in range(3)}
    commits.write_batch(batches["poll-1"].limit(5).withColumn("day", F.to_date("poll_time")), path, "poll-1", ["day"])
    for name in ("poll-0", "poll-1", "poll-2", "poll-0"):
        commits.daily_append_once(batches[name], at, path, name)
    return commits.read_once(v.spark, path)


# Files

AGE = f"CAST(floor(date_diff('second', mtime, {NOW}) / 86400) AS BIGINT)"


@entry("age_days", f"SELECT path, {AGE} AS age_days FROM file_listing")
def age_days(v):
    return v.file_listing.select("path", C.whole_days(F.col("mtime"), C.moment(AS_OF)).alias("age_days"))


@entry("expired_files", f"SELECT *, {AGE} AS age_days FROM file_listing WHERE {AGE} > 30 AND owner LIKE 'svc%'")
def expired_files(v):
    return infra.expired_files(v.file_listing, AS_OF)


@entry("expired_files_any_owner", f"SELECT *, {AGE} AS age_days FROM file_listing WHERE {AGE} > 97")
def expired_files_any_owner(v):
    return infra.expired_files(v.file_listing, AS_OF, days=97, owner_prefix=None)

"""Clusters, hosts, reservations and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.clock import (
    SNAPSHOT_ZONE,
    duration_text,
    local_time,
    moment,
    seconds_between,
    snapshot_day,
    whole_days,
    whole_minutes,
)
from runlens.functions.predicates import name_not_like
from runlens.operators.latest import keep_first, keep_latest
from runlens.operators.spread import carried_forward, number_rows, previous_value

# Clusters that are meant to stay up, the usage limit and the list length.
KEPT_CLUSTERS = "phs|persistent"
USAGE_LIMIT = 80
TOP = 20


# Clusters


def running_clusters(states: DataFrame, ignore: str = KEPT_CLUSTERS) -> DataFrame:
    return states.filter(F.col("status") == "RUNNING").filter(name_not_like("cluster_name", ignore))


def long_running_clusters(
    states: DataFrame, as_of: str, limit_minutes: int, ignore: str = KEPT_CLUSTERS
) -> DataFrame:
    """Running clusters older than the limit, in whole minutes."""
    aged = running_clusters(states, ignore).withColumn(
        "minutes", whole_minutes(F.col("state_start_time"), moment(as_of))
    )
    return aged.filter(F.col("minutes") > limit_minutes).select("project", "cluster_name", "minutes")


def long_runner_count(states: DataFrame, as_of: str, limit_minutes: int, ignore: str = KEPT_CLUSTERS) -> DataFrame:
    """Number of long runners and whether there is none."""
    counted = long_running_clusters(states, as_of, limit_minutes, ignore).agg(F.count(F.lit(1)).alias("long_runners"))
    return counted.withColumn("none_found", F.col("long_runners") == 0)


def cluster_uptime_list(states: DataFrame, as_of: str, ignore: str = KEPT_CLUSTERS) -> DataFrame:
    """All running clusters with elapsed time, numbered per project from the oldest."""
    numbered = number_rows(
        running_clusters(states, ignore),
        ["project"],
        [F.asc("state_start_time"), F.asc("cluster_name")],
        "number",
    )
    elapsed = duration_text(seconds_between(F.col("state_start_time"), moment(as_of)))
    text = F.format_string("[%d] %s Cluster is running since last :- %s", "number", "cluster_name", elapsed)
    return numbered.select("project", "number", "cluster_name", elapsed.alias("elapsed"), text.alias("text"))


# Hosts


def usage_percent(used: Column, total: Column) -> Column:
    """Whole percent, cut off; NULL for a total of zero."""
    return F.floor(F.try_divide(100 * used, total))


def latest_usage(metrics: DataFrame) -> DataFrame:
    """Newest sample per host, metric and mount with its percentage; ``mount`` is NULL for metrics of the whole host."""
    latest = keep_latest(metrics, ["host", "metric", "mount"], [F.desc("ts"), F.desc("event_id")])
    return latest.select("host", "metric", "mount", "ts", usage_percent(F.col("used"), F.col("total")).alias("pct"))


def _over(limit: int) -> Column:
    return F.coalesce(F.col("pct") >= limit, F.lit(False))


def host_any_alert(usage: DataFrame, limit: int = USAGE_LIMIT) -> DataFrame:
    """Whether any metric or mount of a host has reached the limit."""
    return usage.groupBy("host").agg(F.bool_or(_over(limit)).alias("alert"))


def alerting_samples(samples: DataFrame, limit: int = USAGE_LIMIT) -> DataFrame:
    """Samples at or over the limit as host, metric, mount, ts and pct; works on batch and streaming input."""
    pct = usage_percent(F.col("used"), F.col("total"))
    return samples.select("host", "metric", "mount", "ts", pct.alias("pct")).filter(F.col("pct") >= limit)


# Fixed value: positions in time are counted from here.
TIME_ORIGIN = "1970-01-01 00:00:00"
SLICE_MICROSECONDS = 86_400_000_000


def alert_episodes(samples: DataFrame, gap_minutes: int, limit: int = USAGE_LIMIT) -> DataFrame:
    """Alerts as episodes: start, last sample, peak and number of samples per host, metric and mount.

    An episode goes on as long as the next sample at the limit comes within the gap.  Samples of one moment are combined
    first; then each is compared with the one before inside slices of a day, so a host with very many samples is shared out.
    """
    keys = ["host", "metric", "mount"]
    moments = alerting_samples(samples, limit).filter(F.col("ts").isNotNull()).groupBy(*keys, "ts")
    moments = moments.agg(F.max("pct").alias("pct"), F.count(F.lit(1)).alias("n"))
    micros = F.timestamp_diff("MICROSECOND", F.lit(TIME_ORIGIN).cast("timestamp_ntz"), F.col("ts"))
    placed = previous_value(moments.withColumn("_at", micros), keys, "_at", "_at", "_before", SLICE_MICROSECONDS)
    begins = F.col("_before").isNull() | (F.col("_at") - F.col("_before") > gap_minutes * 60_000_000)
    marked = placed.withColumn("_first", F.when(begins, F.col("ts")))
    known = carried_forward(marked, keys, "_at", "_first", "started_at", SLICE_MICROSECONDS)
    peak, count = F.max("pct").alias("peak"), F.sum("n").alias("samples")
    return known.groupBy(*keys, "started_at").agg(F.max("ts").alias("last_at"), peak, count)


def newest_poll(samples: DataFrame) -> DataFrame:
    """The processes of each host's newest poll."""
    return keep_latest(samples, ["host"], [F.desc("ts")], ties=True)


def top_processes(
    samples: DataFrame, usage: DataFrame, metric: str, by: str, limit: int = USAGE_LIMIT, count: int = TOP
) -> DataFrame:
    """Largest consumers in the newest poll of each host at or over the limit of the metric."""
    # Ranked before the hosts are chosen: the ranking then limits each host inside the map tasks.
    top = keep_first(newest_poll(samples), ["host"], [F.desc(by), F.asc("pid")], count, "place")
    over = usage.filter((F.col("metric") == metric) & _over(limit)).select("host").distinct()
    return top.join(over, ["host"], "left_semi").select("host", "place", "pid", "cmd", by)


def top20_memory(samples: DataFrame, usage: DataFrame, limit: int = USAGE_LIMIT) -> DataFrame:
    return top_processes(samples, usage, "memory", "pct_mem", limit)


def top20_cpu(samples: DataFrame, usage: DataFrame, limit: int = USAGE_LIMIT) -> DataFrame:
    return top_processes(samples, usage, "cpu", "pct_cpu", limit)


# Factors of the size suffixes.
SIZE_FACTORS = {"K": 1024, "M": 1024**2, "G": 1024**3, "T": 1024**4}


def size_in_bytes(text: str) -> Column:
    """Bytes of a size such as ``12K`` or ``3.5M``; NULL for a text that is none."""
    suffix = F.right(F.col(text), F.lit(1))
    factor = F.lit(1)
    for name, value in SIZE_FACTORS.items():
        factor = F.when(suffix == name, F.lit(value)).otherwise(factor)
    number = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double")
    return F.floor(number * factor).cast("bigint")


def top20_disk(directories: DataFrame, usage: DataFrame, limit: int = USAGE_LIMIT, count: int = TOP) -> DataFrame:
    """Largest directories of each host's mounts and disks at or over the limit; unreadable sizes come last."""
    sized = directories.withColumn("size_bytes", size_in_bytes("size_text"))
    order = [F.desc_nulls_last("size_bytes"), F.asc("path")]
    top = keep_first(sized, ["host", "mount"], order, count, "place")
    over = usage.filter(F.col("metric").isin("disk", "mount") & _over(limit)).select("host", "mount").distinct()
    return top.join(over, ["host", "mount"], "left_semi")


def split_mount_list(config: DataFrame) -> DataFrame:
    """One row per mount of a comma list."""
    return config.withColumn("mount", F.explode(F.split("mounts", ","))).drop("mounts")


def _listed(rows: DataFrame, keys: list[str], place: list[Column], line: Column, out: str) -> DataFrame:
    """Lines of a bounded list per key, joined in order."""
    entry = F.sort_array(F.collect_list(F.struct(*place, line.alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(entry, lambda t: t["line"]), "\n").alias(out))


def host_health(metrics: DataFrame, samples: DataFrame, limit: int = USAGE_LIMIT) -> DataFrame:
    """One row per host: newest percentages, its mounts, what has reached the limit, largest memory and CPU consumer.

    ``mount_pct`` is the fullest mount's, ``mounts`` lists each of them.  The consumer of a
    metric is named only while that metric is at or over the limit.
    """
    usage = latest_usage(metrics)
    pct = {m: F.max(F.when(F.col("metric") == m, F.col("pct"))) for m in ("memory", "disk", "cpu", "mount")}
    hosts = usage.groupBy("host").agg(
        *[value.alias(f"{m}_pct") for m, value in pct.items()],
        F.count_if(_over(limit)).alias("breached"),
        F.bool_or(_over(limit)).alias("alert"),
    )
    each = F.concat_ws(" ", "mount", F.coalesce(F.concat(F.col("pct").cast("string"), F.lit("%")), F.lit("NA")))
    mounts = usage.filter((F.col("metric") == "mount") & F.col("mount").isNotNull())
    hosts = hosts.join(_listed(mounts, ["host"], [F.col("mount")], each, "mounts"), ["host"], "left")
    for metric, by, prefix in (("memory", "pct_mem", "mem"), ("cpu", "pct_cpu", "cpu")):
        top = top_processes(samples, usage, metric, by, limit, count=1)
        hosts = hosts.join(top.select("host", F.col("pid").alias(f"{prefix}_top_pid")), ["host"], "left")
    return hosts


def host_health_report(metrics: DataFrame, samples: DataFrame, directories: DataFrame, limit: int = USAGE_LIMIT) -> DataFrame:
    """Message text per host in alert: its usage, largest consumers, and largest directories of its full mounts.

    The lists hold at most 20 lines each; the text grows with the number of mounts only.
    """
    usage = latest_usage(metrics)
    hosts = host_health(metrics, samples, limit).filter("alert")
    for metric, by, name in (("memory", "pct_mem", "memory_tasks"), ("cpu", "pct_cpu", "cpu_tasks")):
        line = F.format_string("%d %s", "pid", "cmd")
        lists = _listed(top_processes(samples, usage, metric, by, limit), ["host"], [F.col("place")], line, name)
        hosts = hosts.join(lists, ["host"], "left")
    line = F.concat_ws(" ", "size_text", "path")
    large = _listed(top20_disk(directories, usage, limit), ["host"], [F.col("mount"), F.col("place")], line, "directories")
    hosts = hosts.join(large, ["host"], "left")

    def shown(metric: str) -> Column:
        return F.coalesce(F.col(f"{metric}_pct").cast("string"), F.lit("NA"))

    def listed(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    message = F.format_string(
        f"%s: a limit of {limit}%% is reached\n"
        "disk %s%%, memory %s%%, cpu %s%%\nmounts:\n%s\n"
        "most memory:\n%s\nmost cpu:\n%s\nlargest directories:\n%s",
        "host", shown("disk"), shown("memory"), shown("cpu"), listed("mounts"),
        listed("memory_tasks"), listed("cpu_tasks"), listed("directories"),
    )
    return hosts.select("host", F.concat(F.lit("Alert from "), "host").alias("subject"), message.alias("message"))


# Reservations


RESERVATION_SCHEMA = (
    "name string, creationTimestamp string, specificReservation struct<count: bigint, inUseCount: bigint,"
    " assuredCount: bigint, instanceProperties: struct<machineType: string>>"
)
# The nine columns of a stored reservation row, in order.
RESERVATION_ROW = (
    "teams_space string, curr_time_cst string, res_timestamp string, reservation_name string, machine_type string,"
    " zne string, res_cnt bigint, in_use_count bigint, assured_count bigint"
)


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("_body", F.from_json("body", RESERVATION_SCHEMA))


def _is_reservation() -> Column:
    return F.col("_body.specificReservation.instanceProperties").isNotNull()


def reservation_flatten(raw: DataFrame) -> DataFrame:
    """Response bodies with the properties of a reservation as flat rows, other fields NULL where missing.

    Works on batch and streaming input.
    """
    body = F.col("_body")
    spec = body["specificReservation"]
    return _parsed(raw).filter(_is_reservation()).select(
        "event_id", "poll_time", "project", "zone",
        body["name"].alias("reservation_name"),
        spec["instanceProperties"]["machineType"].alias("machine_type"),
        spec["count"].alias("res_cnt"),
        spec["inUseCount"].alias("in_use_count"),
        spec["assuredCount"].alias("assured_count"),
        body["creationTimestamp"].alias("res_timestamp"),
    )


def reservation_rejects(raw: DataFrame) -> DataFrame:
    """Response bodies that are not a reservation: no JSON, or without its properties."""
    return _parsed(raw).filter(~_is_reservation()).drop("_body")


def reservation_usage(raw: DataFrame, zone: str = SNAPSHOT_ZONE) -> DataFrame:
    """Snapshots as stored: project, poll time and day in the zone, reservation, counts."""
    at = F.col("poll_time")
    return reservation_flatten(raw).select(
        "event_id",
        F.col("project").alias("teams_space"),
        F.date_format(local_time(F.date_trunc("second", at).cast("timestamp_ntz"), zone), "yyyy-MM-dd HH:mm:ss").alias("curr_time_cst"),
        "res_timestamp", "reservation_name", "machine_type", F.col("zone").alias("zne"), "res_cnt", "in_use_count",
        "assured_count", snapshot_day(at, zone).alias("day"),
    )


# Fixed value: the text of a missing cell.
MISSING_CELL = "None"


def csv_row_text(usage: DataFrame) -> DataFrame:
    """Snapshot rows as comma text, project repeated at the end; a cell with a comma is quoted, a missing one is a fixed text."""
    names = [field.split()[0] for field in RESERVATION_ROW.split(", ")]
    cells = [*names, F.col("teams_space").alias("again")]
    return usage.select("event_id", F.to_csv(F.struct(*cells), {"nullValue": MISSING_CELL}).alias("row"))


def csv_row_split(rows: DataFrame) -> DataFrame:
    """Nine columns of a comma row; what follows is dropped, and a cell that is missing or of another type is NULL."""
    names = [field.split() for field in RESERVATION_ROW.split(", ")]
    cells = F.from_csv("row", ", ".join(f"{name} string" for name, _ in names) + ", again string", {"nullValue": MISSING_CELL})
    return rows.select("event_id", cells.alias("c")).select(
        "event_id", *[F.col(f"c.{name}").try_cast(kind).alias(name) for name, kind in names]
    )


# Files


def expired_files(
    listing: DataFrame, as_of: str, days: int = 30, owner_prefix: str | None = "svc"
) -> DataFrame:
    """Files older than the given number of whole days, by default those of service owners.

    Candidates only: nothing is deleted.
    """
    aged = listing.withColumn("age_days", whole_days(F.col("mtime"), moment(as_of)))
    old = aged.filter(F.col("age_days") > days)
    return old if owner_prefix is None else old.filter(F.col("owner").startswith(owner_prefix))


def modified_within(as_of: str, days: int) -> Column:
    return whole_days(F.col("mtime"), moment(as_of)) < days

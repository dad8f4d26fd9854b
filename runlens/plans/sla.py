"""SLA health and imminent SLA misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.clock import minutes_until, moment, same_day
from runlens.functions.predicates import within_open_interval
from runlens.operators.latest import keep_latest
from runlens.plans.workflows import SLA_TYPES

# The domain left out of SLA health and the statuses listed for every domain.
EXCLUDED_DOMAIN = "DFS"
HEALTH_STATUSES = ("Job_Active_SLA_Not_Missed", "Met", "Missed", "RUNNING", "SUCCESS", "FAILED", "Total_Count")


def latest_sla_runs(runs: DataFrame, masters: DataFrame) -> DataFrame:
    """Newest started run per SLA workflow in the workflow master; ``regular`` unless the workflow is only weekly.

    Equal start times are settled by the higher run id.  The run is chosen before the master
    is joined: both go by workflow name, so the order does not matter to the result, and a
    workflow with very many runs is reduced inside the map tasks.
    """
    latest = keep_latest(
        runs.filter(F.col("sla_type").isin(*SLA_TYPES)),
        ["parent_job_name"],
        [F.desc("start_time"), F.desc("parent_run_id")],
    )
    scheduled = masters.groupBy(F.col("wrkflw_nm").alias("parent_job_name")).agg(
        F.coalesce(F.bool_or(F.col("job_frequency") != "Weekly"), F.lit(False)).alias("regular")
    )
    return latest.join(scheduled, ["parent_job_name"])


def _kind(name: str, status: Column) -> Column:
    return F.struct(F.lit(name).alias("kind"), status.alias("status"))


def _counts(latest: DataFrame, *kinds: Column) -> DataFrame:
    """Counts by domain, kind and status; each kind is a struct, or NULL for a run it does not count."""
    return (
        latest.select("domain_name", F.explode(F.array_compact(F.array(*kinds))).alias("counted"))
        .groupBy("domain_name", "counted.kind", "counted.status")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("domain_name", "status", "cnt")
    )


def _code() -> Column:
    return F.when(F.col("regular"), _kind("code", F.upper("return_code_text")))


def _today(as_of: str) -> Column:
    today = same_day(F.col("start_time"), moment(as_of))
    return F.when(F.col("regular") & today, _kind("sla", F.upper("hard_sla_status")))


def _total() -> Column:
    return F.when(F.col("bsns_sla_time_date").isNotNull(), _kind("total", F.lit("TOTAL_COUNT")))


def return_code_counts(runs: DataFrame, masters: DataFrame) -> DataFrame:
    return _counts(latest_sla_runs(runs, masters), _code())


def sla_status_counts_today(runs: DataFrame, masters: DataFrame, as_of: str) -> DataFrame:
    return _counts(latest_sla_runs(runs, masters), _today(as_of))


def sla_total_count(runs: DataFrame, masters: DataFrame) -> DataFrame:
    """Workflows with an SLA time by domain, weekly ones included."""
    return _counts(latest_sla_runs(runs, masters), _total()).drop("status")


def health_counts(runs: DataFrame, masters: DataFrame, as_of: str) -> DataFrame:
    """Return codes, today's SLA statuses and totals, counted in one pass over the latest runs.

    Equal rows collapse; differing counts for one status both stay.
    """
    return _counts(latest_sla_runs(runs, masters), _code(), _today(as_of), _total()).distinct()


def status_spine(runs: DataFrame) -> DataFrame:
    """Every domain but the excluded one with every listed status."""
    domains = runs.filter(F.col("domain_name") != EXCLUDED_DOMAIN).select("domain_name").distinct()
    statuses = F.array(*[F.lit(s.upper()) for s in HEALTH_STATUSES])
    return domains.withColumn("status", F.explode(statuses))


def zero_filled(spine: DataFrame, counts: DataFrame) -> DataFrame:
    joined = spine.join(counts, ["domain_name", "status"], "left")
    return joined.select("domain_name", "status", F.coalesce("cnt", F.lit(0)).alias("status_cnt"))


def sla_health(runs: DataFrame, masters: DataFrame, as_of: str) -> DataFrame:
    """Count per domain and status, zero where there is none, ordered by both."""
    filled = zero_filled(status_spine(runs), health_counts(runs, masters, as_of))
    return filled.orderBy("domain_name", "status")


def sla_health_map(health: DataFrame) -> DataFrame:
    """One row per domain with a column per listed status; repeated statuses are added up."""
    columns = [s.upper() for s in HEALTH_STATUSES]
    return health.groupBy("domain_name").agg(
        *[F.sum(F.when(F.col("status") == s, F.col("status_cnt"))).alias(s.lower()) for s in columns]
    )


def sla_candidates(runs: DataFrame, meta: DataFrame, assignment: DataFrame, as_of: str) -> DataFrame:
    """Latest unsuccessful business-SLA run per described workflow with its workflow-level incident.

    The run is chosen first, see ``latest_sla_runs``.  A workflow described more than once
    counts with its first description.
    """
    open_runs = runs.filter((F.col("return_code_text") != "SUCCESS") & (F.col("sla_type") == "B"))
    latest = keep_latest(open_runs, ["parent_job_name"], [F.desc("activation_time"), F.desc("parent_run_id")])
    described = keep_latest(meta, ["workflow_name"], [F.asc("application_name"), F.asc("bsns_impact_justification")])
    named = latest.drop("application_name", "created_dt").join(
        described, F.col("workflow_name") == F.col("parent_job_name")
    )
    columns = ["job_name", "jira", "created_dt", "service_now", "zoom_link", "close_code", "root_cause", "error"]
    records = assignment.select("parent_run_id", F.col("job_name").alias("parent_job_name"), *columns)
    joined = named.join(records, ["parent_run_id", "parent_job_name"], "left")
    return joined.withColumn("min_diff", minutes_until(F.col("bsns_sla_time_date"), moment(as_of)))


def potential_sla_miss(
    runs: DataFrame, meta: DataFrame, assignment: DataFrame, as_of: str, cc_list: str = "", to_list: str = ""
) -> DataFrame:
    """Runs less than an hour before or after their SLA time."""
    close = sla_candidates(runs, meta, assignment, as_of).filter(within_open_interval("min_diff", -60, 60))
    return close.select(
        "domain_name", "product_name", "application_name", "parent_job_name", "return_code_text",
        "bsns_sla_time_date", "bsns_impact_justification", "bsns_sla_diff_mins",
        F.lit(cc_list).alias("cc_list"), F.lit(to_list).alias("to_list"), "min_diff", "parent_run_id",
        "job_name", "jira", "created_dt", "service_now", "zoom_link", "close_code", "root_cause", "error",
    )

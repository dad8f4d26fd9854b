"""Workflow and job status marts.

All marts are lazy DataFrames with one row per run and flagged job.  ``nest_jobs`` turns them
into one row per run with an array of jobs; it writes the mart's rows to the shared work folder while it is called.

Assumptions: text keys compare as stored, and an incident record is unique per
(parent_run_id, job_name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.labels import alert_type, recorded_or
from runlens.functions.predicates import (
    any_alert,
    domain_scope,
    flagged_job,
    not_closed,
    unfinished,
    unfinished_or_missing,
)
from runlens.operators.latest import keep_latest
from runlens.operators.spread import PAGE_SIZE, left_join_spread, nest_rows

JOB_KEY = ["parent_run_id", "job_name"]

# SLA classes, and the columns of the nested result in order.
SLA_TYPES = ("B", "B&I")
MISSING_COLUMN = "KEY_NOT_FOUND"
WORKFLOW_COLUMNS = """
    parent_run_id parent_job_name ah_client last_refresh_dt domain_name product_name application_name
    return_code_text job_flow_priority assignment_status assigned_user activation_time start_time end_time
    conv_end_time ord_key ah_runtime ah_ert total_jobs running_jobs failed_jobs ert_exceeded_jobs run_hist_url
    bsns_sla_time bsns_sla_time_date bsns_sla_diff_mins bsns_sla_diff bsns_sla_status sla_type source_nm
    created_dt updated_dt jira_project_key jira_component xmatter_grp
""".split()
JOB_COLUMNS = """
    job_name job_run_id job_status assignment_status assigned_user user_role job_start_time job_end_time
    job_ah_runtime job_ah_ert job_run_url job_duration job_lvl job_ert_exceeded_ind job_fail_ind job_sla_ind
    jira service_now zoom_link close_code root_cause error
""".split()
RUN_RENAMES = {"dt_jira_component": "jira_component", "dt_xmatter_grp_nm": "xmatter_grp"}
JOB_RENAMES = {
    "return_code_text": "job_status",
    "start_time": "job_start_time",
    "end_time": "job_end_time",
    "ah_runtime": "job_ah_runtime",
    "ah_ert": "job_ah_ert",
    "run_hist_url": "job_run_url",
    "lvl": "job_lvl",
    "ert_exceeded_ind": "job_ert_exceeded_ind",
    "sla_ind": "job_sla_ind",
}


def run_columns(runs: DataFrame) -> DataFrame:
    return runs.withColumnsRenamed(RUN_RENAMES)


def job_columns(jobs: DataFrame) -> DataFrame:
    """Job columns under the names they carry beside run columns."""
    return jobs.withColumnsRenamed(JOB_RENAMES)


def column_or_notice(df: DataFrame, name: str) -> Column:
    """A column of the input, or the fixed notice where the input has no such column."""
    return F.col(name) if name in df.columns else F.lit(MISSING_COLUMN).alias(name)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Every run that shares the newest activation time of its workflow."""
    return keep_latest(runs, ["parent_job_name"], [F.desc("activation_time")], ties=True)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Every job run that shares the highest job run id of its (run, job)."""
    return keep_latest(jobs, JOB_KEY, [F.desc("job_run_id")], ties=True)


def latest_assignee(mapping: DataFrame) -> DataFrame:
    """Newest assignee per (run, job); equal surrogate keys are all kept."""
    known = mapping.dropna(subset=[*JOB_KEY, "assignment_mapping_skey"])
    latest = keep_latest(known, JOB_KEY, [F.desc("assignment_mapping_skey")], ties=True)
    return latest.select(*JOB_KEY, "assigned_user", "user_role")


def incidents(assignment: DataFrame, mapping: DataFrame) -> DataFrame:
    """Incident records with their assignee.

    The assignee hangs on the record: a mapped job without a record stays unassigned.
    """
    columns = ["jira", "service_now", "zoom_link", "close_code", "root_cause", "error"]
    records = assignment.select(*JOB_KEY, F.col("status").alias("incident_status"), *columns)
    return records.join(latest_assignee(mapping), JOB_KEY, "left")


def flagged_jobs(jobs: DataFrame) -> DataFrame:
    """Latest late or failed job run per (run, job)."""
    return latest_jobs(jobs.filter(flagged_job()))


def with_flagged_jobs(runs: DataFrame, jobs: DataFrame, assignment: DataFrame, mapping: DataFrame) -> DataFrame:
    """Runs LEFT JOIN their latest flagged jobs with incident record and assignee.

    Jobs are ranked and enriched on (run, job) before they meet the runs.  The rank does not
    depend on run columns, so this equals ranking after the join, and the three inputs keyed
    by (run, job) are shuffled once each.
    """
    enriched = job_columns(flagged_jobs(jobs)).join(incidents(assignment, mapping), JOB_KEY, "left")
    flagged = jobs.filter(flagged_job()).select("parent_run_id")
    return left_join_spread(run_columns(runs), enriched, ["parent_run_id"], keys_of=flagged)


def _latest_status(runs: DataFrame, jobs: DataFrame, assignment: DataFrame, mapping: DataFrame) -> DataFrame:
    flat = with_flagged_jobs(latest_runs(runs), jobs, assignment, mapping)
    return (
        flat.withColumn("assignment_status", recorded_or("incident_status", "OPEN"))
        .withColumn("assigned_user", recorded_or("assigned_user", "Not Assigned"))
        .drop("incident_status")
    )


def sla_workflows(
    runs: DataFrame, jobs: DataFrame, assignment: DataFrame, mapping: DataFrame, domains: list[str] | None = None
) -> DataFrame:
    """Latest run of every SLA workflow in scope with its flagged jobs.

    The scope is applied before the latest run is chosen.
    """
    scoped = runs.filter(F.col("sla_type").isin(*SLA_TYPES)).filter(domain_scope(domains))
    return _latest_status(scoped, jobs, assignment, mapping)


def all_workflows(
    runs: DataFrame, jobs: DataFrame, assignment: DataFrame, mapping: DataFrame, domains: list[str] | None = None
) -> DataFrame:
    """As ``sla_workflows`` for every workflow."""
    return _latest_status(runs.filter(domain_scope(domains)), jobs, assignment, mapping)


def actionable_workflows(
    runs: DataFrame, jobs: DataFrame, assignment: DataFrame, mapping: DataFrame, domains: list[str] | None = None
) -> DataFrame:
    """Unfinished runs with an alert and their unfinished flagged jobs whose incident is not closed.

    A run whose flagged jobs have all ended is left out; a run without flagged jobs stays.
    """
    open_runs = runs.filter(unfinished("return_code_text")).filter(any_alert()).filter(domain_scope(domains))
    flat = with_flagged_jobs(open_runs, jobs, assignment, mapping)
    return (
        flat.filter(unfinished_or_missing("job_status"))
        .filter(not_closed("incident_status"))
        .withColumn("assignment_status", F.coalesce("incident_status", F.lit("OPEN")))
        .withColumn("assigned_user", F.coalesce("assigned_user", F.lit("Not Assigned")))
        .withColumn("user_role", F.coalesce("user_role", F.lit("NA")))
        .withColumn("alert_type", alert_type())
        .drop("incident_status")
    )


def issues_pending_closure(
    runs: DataFrame, jobs: DataFrame, assignment: DataFrame, mapping: DataFrame, domains: list[str] | None = None
) -> DataFrame:
    """Incidents in work that have an assignee entry, with their run and latest job run."""
    columns = ["jira", "service_now", "zoom_link", "close_code", "root_cause", "error"]
    in_work = assignment.filter(F.col("status") == "WIP").select(
        *JOB_KEY, F.col("status").alias("assignment_status"), *columns
    )
    assignee = latest_assignee(mapping).withColumn(
        "assigned_user", F.coalesce("assigned_user", F.lit("Not Assigned"))
    )
    per_job = in_work.join(assignee, JOB_KEY).join(job_columns(latest_jobs(jobs)), JOB_KEY)
    scoped = run_columns(runs.filter(domain_scope(domains)))
    return per_job.join(scoped, ["parent_run_id"]).withColumn("alert_type", alert_type())


def nest_jobs(flat: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per run (and page, see ``nest_rows``) with the array ``jobs``.

    Run columns come from the run's first job.  Columns the input lacks carry a fixed notice.
    """
    extra = ["alert_type"] if "alert_type" in flat.columns else []
    header = [column_or_notice(flat, c) for c in WORKFLOW_COLUMNS if c != "parent_run_id"]
    item = [column_or_notice(flat, c) for c in JOB_COLUMNS]
    return nest_rows(flat, ["parent_run_id"], [*header, *[F.col(c) for c in extra]], item, "jobs", page_size)


def nest_jobs_by_alert(flat: DataFrame, page_size: int = PAGE_SIZE) -> dict[str, DataFrame]:
    """The nested runs as three lists by alert type; NA is kept apart should it ever occur."""
    nested = nest_jobs(flat, page_size)
    return {kind: nested.filter(F.col("alert_type") == kind) for kind in ("SLAMISSED", "FAILED", "ERT", "NA")}

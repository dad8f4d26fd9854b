"""Workflow marts, their joins, ranks, labels and nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import entry
from entries.counts import COMMERCE
from runlens.functions import labels as L
from runlens.functions import predicates as P
from runlens.operators.latest import keep_latest
from runlens.operators.spread import PAGE_SIZE, left_join_spread
from runlens.plans import workflows as W
from runlens.plans.incidents import JSON_OPTIONS

ALERT = "(failed_jobs > 0 OR ert_exceeded_jobs > 0 OR bsns_sla_status = 'Missed')"
FINISHED = "('SUCCESS', 'CANCELLED', 'ENDED_INACTIVE - Task has manually been set inactive.')"
ALERT_TYPE = "CASE WHEN bsns_sla_status = 'Missed' THEN 'SLAMISSED' WHEN failed_jobs > 0 THEN 'FAILED' WHEN ert_exceeded_jobs > 0 THEN 'ERT' ELSE 'NA' END"


def joined(runs: str) -> str:
    """Runs with latest flagged jobs, records and assignees, ranked after the join."""
    return f"""
SELECT w.* EXCLUDE (jb_rnk), i.status AS incident_status, i.jira, i.service_now, i.zoom_link, i.close_code, i.root_cause, i.error,
 a.assigned_user AS mapped_user, a.user_role AS mapped_role
FROM (SELECT r.*, j.* EXCLUDE (parent_run_id),
  rank() OVER (PARTITION BY r.parent_run_id, j.job_name ORDER BY j.job_run_id DESC) AS jb_rnk
 FROM ({runs}) r LEFT JOIN o_flagged j ON r.parent_run_id = j.parent_run_id) w
LEFT JOIN assignment i ON w.parent_run_id = i.parent_run_id AND w.job_name = i.job_name
LEFT JOIN o_assignee a ON i.parent_run_id = a.parent_run_id AND i.job_name = a.job_name
WHERE w.jb_rnk = 1"""


def status_mart(where: str) -> str:
    runs = f"SELECT * FROM o_runs {where} QUALIFY rank() OVER (PARTITION BY parent_job_name ORDER BY activation_time DESC) = 1"
    return f"""
SELECT * EXCLUDE (incident_status, mapped_user, mapped_role),
 CASE WHEN incident_status IS NOT NULL THEN incident_status WHEN {ALERT} THEN 'OPEN' ELSE 'NA' END AS assignment_status,
 CASE WHEN mapped_user IS NOT NULL THEN mapped_user WHEN {ALERT} THEN 'Not Assigned' ELSE 'NA' END AS assigned_user,
 mapped_role AS user_role
FROM ({joined(runs)}) f"""


def actionable(where: str = "") -> str:
    runs = f"SELECT * FROM o_runs WHERE return_code_text NOT IN {FINISHED} AND {ALERT} {where}"
    return f"""
SELECT * EXCLUDE (incident_status, mapped_user, mapped_role), coalesce(incident_status, 'OPEN') AS assignment_status,
 coalesce(mapped_user, 'Not Assigned') AS assigned_user, coalesce(mapped_role, 'NA') AS user_role, {ALERT_TYPE} AS alert_type
FROM ({joined(runs)}) f
WHERE (job_status NOT IN {FINISHED} OR job_status IS NULL) AND coalesce(incident_status, 'OPEN') != 'CLOSED'"""


PENDING = f"""
SELECT * EXCLUDE (jb_rnk) FROM (SELECT r.*, j.* EXCLUDE (parent_run_id), i.status AS assignment_status, i.jira, i.service_now, i.zoom_link,
 i.close_code, i.root_cause, i.error, coalesce(a.assigned_user, 'Not Assigned') AS assigned_user, a.user_role, {ALERT_TYPE} AS alert_type,
 rank() OVER (PARTITION BY r.parent_run_id, j.job_name ORDER BY j.job_run_id DESC) AS jb_rnk
FROM assignment i JOIN o_assignee a ON i.status = 'WIP' AND i.parent_run_id = a.parent_run_id AND i.job_name = a.job_name
JOIN o_runs r ON i.parent_run_id = r.parent_run_id
JOIN o_jobs j ON r.parent_run_id = j.parent_run_id AND i.job_name = j.job_name) t WHERE jb_rnk = 1"""

MISSING_RUN = {"last_refresh_dt", "conv_end_time", "bsns_sla_time", "bsns_sla_diff"}
MISSING_JOB = {"job_duration"}


def nested(flat: str, extra: tuple[str, ...] = ()) -> str:
    items = [c for c in W.JOB_COLUMNS]
    value = {c: "'KEY_NOT_FOUND'" if c in MISSING_JOB else c for c in items}
    order = ", ".join(f"{c} NULLS FIRST" for c in items if c not in MISSING_JOB)
    record = "{" + ", ".join(f"'{c}': {value[c]}" for c in items) + "}"
    header = [
        "'KEY_NOT_FOUND' AS " + c if c in MISSING_RUN else f"max(h_{c}) AS {c}"
        for c in (*W.WORKFLOW_COLUMNS, *extra)
        if c != "parent_run_id"
    ]
    firsts = [f"first_value({c}) OVER jobs_of AS h_{c}" for c in (*W.WORKFLOW_COLUMNS, *extra) if c not in MISSING_RUN and c != "parent_run_id"]
    return f"""
SELECT parent_run_id, CAST((rn - 1) // {PAGE_SIZE} AS BIGINT) AS page, {', '.join(header)}, '[' || string_agg(j, ',' ORDER BY rn) || ']' AS jobs
FROM (SELECT parent_run_id, row_number() OVER jobs_of AS rn, {', '.join(firsts)}, to_json({record})::VARCHAR AS j FROM ({flat}) f
 WINDOW jobs_of AS (PARTITION BY parent_run_id ORDER BY {order})) n
GROUP BY 1, 2"""


def tables(v):
    return v.wf_run, v.job_run, v.assignment, v.assignment_mapping


def as_text(nested_df):
    return nested_df.withColumn("jobs", F.to_json("jobs", JSON_OPTIONS))


# Marts

SLA_ONLY = "WHERE sla_type IN ('B', 'B&I')"


@entry("sla_workflows", nested(status_mart(SLA_ONLY)))
def sla_workflows(v):
    return as_text(W.nest_jobs(W.sla_workflows(*tables(v))))


@entry("sla_workflows_ecomm", nested(status_mart(f"{SLA_ONLY} AND {COMMERCE}")))
def sla_workflows_ecomm(v):
    return as_text(W.nest_jobs(W.sla_workflows(*tables(v), ["Ecomm"])))


@entry("all_workflows", nested(status_mart("")))
def all_workflows(v):
    return as_text(W.nest_jobs(W.all_workflows(*tables(v))))


@entry("all_workflows_list", nested(status_mart("WHERE domain_name IN ('ASIA', 'EUROPE')")))
def all_workflows_list(v):
    return as_text(W.nest_jobs(W.all_workflows(*tables(v), ["ASIA", "EUROPE"])))


@entry("actionable_workflows", nested(actionable(), ("alert_type",)))
def actionable_workflows(v):
    return as_text(W.nest_jobs(W.actionable_workflows(*tables(v))))


@entry("actionable_workflows_list", nested(actionable("AND domain_name IN ('ASIA')"), ("alert_type",)))
def actionable_workflows_list(v):
    return as_text(W.nest_jobs(W.actionable_workflows(*tables(v), ["ASIA"])))


@entry("issues_pending_closure", nested(PENDING, ("alert_type",)))
def issues_pending_closure(v):
    return as_text(W.nest_jobs(W.issues_pending_closure(*tables(v))))


@entry("nest_jobs", nested(status_mart("")))
def nest_jobs(v):
    return as_text(W.nest_jobs(W.all_workflows(*tables(v))))


@entry("all_workflows_flat", status_mart(""))
def all_workflows_flat(v):
    """The flat rows that nesting starts from, all columns."""
    return W.all_workflows(*tables(v))


@entry("nest_jobs_exploded", f"SELECT parent_run_id, job_name, job_run_id, job_status, error FROM ({status_mart('')}) f")
def nest_jobs_exploded(v):
    nested_df = W.nest_jobs(W.all_workflows(*tables(v)))
    jobs = nested_df.select("parent_run_id", F.explode("jobs").alias("job"))
    return jobs.select("parent_run_id", "job.job_name", "job.job_run_id", "job.job_status", "job.error")


@entry("nest_jobs_by_alert", f"SELECT alert_type, parent_run_id, count(*) AS n_jobs FROM ({actionable()}) f GROUP BY 1, 2")
def nest_jobs_by_alert(v):
    lists = W.nest_jobs_by_alert(W.actionable_workflows(*tables(v)))
    result = None
    for rows in lists.values():
        part = rows.select("alert_type", "parent_run_id", F.size("jobs").cast("bigint").alias("n_jobs"))
        result = part if result is None else result.unionByName(part)
    return result


@entry("actionable_flat", actionable())
def actionable_flat(v):
    return W.actionable_workflows(*tables(v))


@entry("pending_closure_flat", PENDING)
def pending_closure_flat(v):
    return W.issues_pending_closure(*tables(v))


# Predicates


@entry("not_in_statuses", f"SELECT parent_run_id, return_code_text FROM wf_run WHERE return_code_text NOT IN {FINISHED}")
def not_in_statuses(v):
    return v.wf_run.filter(P.unfinished("return_code_text")).select("parent_run_id", "return_code_text")


@entry(
    "not_in_or_null",
    f"""
SELECT r.parent_run_id, j.job_name, j.job_run_id, j.job_status FROM wf_run r LEFT JOIN o_flagged j ON r.parent_run_id = j.parent_run_id
WHERE j.job_status NOT IN {FINISHED} OR j.job_status IS NULL""",
)
def not_in_or_null(v):
    return flagged(v).filter(P.unfinished_or_missing("job_status"))


@entry("any_alert_filter", f"SELECT parent_run_id FROM wf_run WHERE {ALERT}")
def any_alert_filter(v):
    return v.wf_run.filter(P.any_alert()).select("parent_run_id")


@entry("not_closed", "SELECT parent_run_id, job_name, status FROM assignment WHERE coalesce(status, 'OPEN') != 'CLOSED'")
def not_closed(v):
    return v.assignment.filter(P.not_closed("status")).select("parent_run_id", "job_name", "status")


@entry(
    "job_prefix_check",
    """
SELECT DISTINCT job_name, upper(job_name) AS upper_name, regexp_matches(job_name, '^(JOBS|jobs|JB|jb|MDSE)') AS accepted FROM assignment""",
)
def job_prefix_check(v):
    names = v.assignment.select("job_name").distinct()
    return names.select(
        "job_name", F.upper("job_name").alias("upper_name"), P.accepted_job_name("job_name").alias("accepted")
    )


@entry("project_rename", "SELECT * FROM o_runs")
def project_rename(v):
    return W.run_columns(v.wf_run)


@entry("project_rename_jobs", "SELECT * FROM o_jobs")
def project_rename_jobs(v):
    return W.job_columns(v.job_run)


# Joins


def flagged(v):
    jobs = W.job_columns(v.job_run.filter(P.flagged_job())).select("parent_run_id", "job_name", "job_run_id", "job_status")
    return left_join_spread(v.wf_run.select("parent_run_id"), jobs, ["parent_run_id"])


@entry(
    "left_join_flagged_jobs",
    """
SELECT r.parent_run_id, j.job_name, j.job_run_id, j.return_code_text AS job_status FROM wf_run r
LEFT JOIN job_run j ON r.parent_run_id = j.parent_run_id AND (j.ert_exceeded_ind = 'Y' OR j.job_fail_ind = 'Y')""",
)
def left_join_flagged_jobs(v):
    return flagged(v)


@entry(
    "left_join_assignment",
    """
SELECT j.parent_run_id, j.job_name, j.job_run_id, i.status, i.jira FROM o_flagged j
LEFT JOIN assignment i ON j.parent_run_id = i.parent_run_id AND j.job_name = i.job_name""",
)
def left_join_assignment(v):
    jobs = v.job_run.filter(P.flagged_job()).select(*W.JOB_KEY, "job_run_id")
    return jobs.join(v.assignment.select(*W.JOB_KEY, "status", "jira"), W.JOB_KEY, "left")


@entry("latest_mapping", "SELECT * FROM o_assignee")
def latest_mapping(v):
    return W.latest_assignee(v.assignment_mapping)


@entry(
    "rn_via_assignment",
    """
SELECT j.parent_run_id, j.job_name, j.job_run_id, i.status AS incident_status, a.assigned_user FROM job_run j
LEFT JOIN assignment i ON j.parent_run_id = i.parent_run_id AND j.job_name = i.job_name
LEFT JOIN o_assignee a ON i.parent_run_id = a.parent_run_id AND i.job_name = a.job_name""",
)
def rn_via_assignment(v):
    jobs = v.job_run.select(*W.JOB_KEY, "job_run_id")
    records = W.incidents(v.assignment, v.assignment_mapping).select(*W.JOB_KEY, "incident_status", "assigned_user")
    return jobs.join(records, W.JOB_KEY, "left")


@entry(
    "inner_with_literal_on",
    """
SELECT i.parent_run_id, i.job_name, a.assigned_user FROM assignment i
JOIN o_assignee a ON i.status = 'WIP' AND i.parent_run_id = a.parent_run_id AND i.job_name = a.job_name""",
)
def inner_with_literal_on(v):
    in_work = v.assignment.filter(F.col("status") == "WIP").select(*W.JOB_KEY)
    return in_work.join(W.latest_assignee(v.assignment_mapping).drop("user_role"), W.JOB_KEY)


@entry(
    "four_way_inner",
    """
SELECT i.parent_run_id, i.job_name, a.assigned_user, r.parent_job_name, j.job_run_id
FROM assignment i JOIN o_assignee a ON i.parent_run_id = a.parent_run_id AND i.job_name = a.job_name
JOIN wf_run r ON i.parent_run_id = r.parent_run_id
JOIN job_run j ON r.parent_run_id = j.parent_run_id AND i.job_name = j.job_name""",
)
def four_way_inner(v):
    per_job = (
        v.assignment.select(*W.JOB_KEY)
        .join(W.latest_assignee(v.assignment_mapping).drop("user_role"), W.JOB_KEY)
        .join(v.job_run.select(*W.JOB_KEY, "job_run_id"), W.JOB_KEY)
    )
    return per_job.join(v.wf_run.select("parent_run_id", "parent_job_name"), ["parent_run_id"])


# Ranks


@entry("latest_run_per_workflow", "SELECT parent_job_name, parent_run_id, activation_time FROM o_latest_runs")
def latest_run_per_workflow(v):
    return W.latest_runs(v.wf_run).select("parent_job_name", "parent_run_id", "activation_time")


@entry(
    "latest_job_per_run",
    """
SELECT parent_run_id, job_name, job_run_id, lvl FROM job_run
QUALIFY rank() OVER (PARTITION BY parent_run_id, job_name ORDER BY job_run_id DESC) = 1""",
)
def latest_job_per_run(v):
    return W.latest_jobs(v.job_run).select(*W.JOB_KEY, "job_run_id", "lvl")


@entry(
    "loose_group_by",
    """
SELECT job_name, parent_run_id, status, error, created_dt FROM assignment
QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY created_dt DESC, parent_run_id DESC) = 1""",
)
def loose_group_by(v):
    newest = keep_latest(v.assignment, ["job_name"], [F.desc("created_dt"), F.desc("parent_run_id")])
    return newest.select("job_name", "parent_run_id", "status", "error", "created_dt")


# Labels


@entry(
    "assignment_status_case",
    f"""
SELECT r.parent_run_id, i.job_name, CASE WHEN i.status IS NOT NULL THEN i.status WHEN {ALERT} THEN 'OPEN' ELSE 'NA' END AS assignment_status
FROM wf_run r LEFT JOIN assignment i ON r.parent_run_id = i.parent_run_id""",
)
def assignment_status_case(v):
    rows = left_join_spread(v.wf_run, v.assignment.select("parent_run_id", "job_name", "status"), ["parent_run_id"])
    return rows.select("parent_run_id", "job_name", L.recorded_or("status", "OPEN").alias("assignment_status"))


@entry(
    "assigned_user_case",
    f"""
SELECT r.parent_run_id, a.job_name, CASE WHEN a.assigned_user IS NOT NULL THEN a.assigned_user WHEN {ALERT} THEN 'Not Assigned' ELSE 'NA' END AS assigned_user
FROM wf_run r LEFT JOIN o_assignee a ON r.parent_run_id = a.parent_run_id""",
)
def assigned_user_case(v):
    rows = left_join_spread(v.wf_run, W.latest_assignee(v.assignment_mapping), ["parent_run_id"])
    return rows.select("parent_run_id", "job_name", L.recorded_or("assigned_user", "Not Assigned").alias("assigned_user"))


@entry(
    "ifnull_defaults",
    """
SELECT i.parent_run_id, i.job_name, ifnull(i.status, 'OPEN') AS assignment_status, ifnull(a.assigned_user, 'Not Assigned') AS assigned_user,
 ifnull(a.user_role, 'NA') AS user_role
FROM assignment i LEFT JOIN o_assignee a ON i.parent_run_id = a.parent_run_id AND i.job_name = a.job_name""",
)
def ifnull_defaults(v):
    records = W.incidents(v.assignment, v.assignment_mapping)
    return records.select(
        *W.JOB_KEY,
        F.coalesce("incident_status", F.lit("OPEN")).alias("assignment_status"),
        F.coalesce("assigned_user", F.lit("Not Assigned")).alias("assigned_user"),
        F.coalesce("user_role", F.lit("NA")).alias("user_role"),
    )


@entry("alert_type", f"SELECT parent_run_id, {ALERT_TYPE} AS alert_type FROM wf_run")
def alert_type(v):
    return v.wf_run.select("parent_run_id", L.alert_type().alias("alert_type"))


@entry(
    "alert_category",
    """
SELECT j.parent_run_id, j.job_name, j.job_run_id,
 CASE WHEN r.bsns_sla_status = 'Missed' AND j.job_fail_ind = 'Y' AND j.ert_exceeded_ind = 'Y' THEN 'SLAMISSED_FAILED_ERT'
  WHEN r.bsns_sla_status = 'Missed' AND j.job_fail_ind = 'Y' THEN 'SLAMISSED_FAILED'
  WHEN r.bsns_sla_status = 'Missed' AND j.ert_exceeded_ind = 'Y' THEN 'SLAMISSED_ERT'
  WHEN r.bsns_sla_status = 'Missed' THEN 'SLAMISSED'
  WHEN j.job_fail_ind = 'Y' AND j.ert_exceeded_ind = 'Y' THEN 'FAILED_ERT'
  WHEN j.job_fail_ind = 'Y' THEN 'FAILED' WHEN j.ert_exceeded_ind = 'Y' THEN 'ERT' ELSE 'NA' END AS alert_category
FROM job_run j JOIN wf_run r ON j.parent_run_id = r.parent_run_id""",
)
def alert_category(v):
    rows = v.job_run.join(v.wf_run.select("parent_run_id", "bsns_sla_status"), ["parent_run_id"])
    label = L.alert_category("bsns_sla_status", "job_fail_ind", "ert_exceeded_ind")
    return rows.select(*W.JOB_KEY, "job_run_id", label.alias("alert_category"))


@entry(
    "alert_flags",
    """
SELECT request_id, CASE WHEN alert_type = 'ERT' THEN 1 ELSE 0 END AS ert_alert, CASE WHEN alert_type = 'FAILED' THEN 1 ELSE 0 END AS failure_alert,
 CASE WHEN alert_type = 'SLAMISSED' THEN 1 ELSE 0 END AS slamiss_alert FROM ticket_request""",
)
def alert_flags(v):
    flags = L.alert_flags(F.col("alert_type"))
    return v.ticket_request.select("request_id", *[f.alias(n) for n, f in flags.items()])


@entry("upper_status", "SELECT parent_run_id, upper(hard_sla_status) AS status FROM wf_run")
def upper_status(v):
    return v.wf_run.select("parent_run_id", F.upper("hard_sla_status").alias("status"))


@entry(
    "append_ticket",
    "SELECT parent_run_id, job_name, concat(coalesce(jira, ''), ',OPS-', CAST(parent_run_id AS VARCHAR)) AS jira FROM assignment",
)
def append_ticket(v):
    key = F.concat(F.lit("OPS-"), F.col("parent_run_id").cast("string"))
    return v.assignment.select(*W.JOB_KEY, L.appended_ticket(F.col("jira"), key).alias("jira"))


@entry(
    "ticket_payload",
    """
SELECT request_id, to_json({'fields': {'project': {'key': project_key}, 'summary': summary, 'description': description,
 'issuetype': {'name': issue_type}, 'labels': [label], 'priority': {'name': priority},
 'components': [{'name': component1}, {'name': component2}]}})::VARCHAR AS payload FROM ticket_request""",
)
def ticket_payload(v):
    body = L.issue_body(
        "project_key", "summary", "description", "issue_type", F.array("label"), "priority", F.array("component1", "component2")
    )
    return v.ticket_request.select("request_id", body.alias("payload"))

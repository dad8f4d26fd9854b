"""Registration of queries and of the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens.sources.views import AS_OF, VIEWS, Views, needed, portable, with_clause

__all__ = ["AS_OF", "CHECKS", "PARTS", "QUERIES", "check_sql", "entry"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# Named parts of checking SQL; a check may read them like views.
PARTS: dict[str, str] = {
    "o_runs": "SELECT * RENAME (dt_jira_component AS jira_component, dt_xmatter_grp_nm AS xmatter_grp) FROM wf_run",
    "o_jobs": """
SELECT parent_run_id, job_name, job_run_id, return_code_text AS job_status, start_time AS job_start_time,
 end_time AS job_end_time, ah_runtime AS job_ah_runtime, ah_ert AS job_ah_ert, run_hist_url AS job_run_url, lvl AS job_lvl,
 ert_exceeded_ind AS job_ert_exceeded_ind, job_fail_ind, sla_ind AS job_sla_ind
FROM job_run""",
    "o_flagged": "SELECT * FROM o_jobs WHERE job_ert_exceeded_ind = 'Y' OR job_fail_ind = 'Y'",
    "o_assignee": """
SELECT m.parent_run_id, m.job_name, m.assigned_user, m.user_role
FROM assignment_mapping m LEFT JOIN assignment_mapping later
 ON m.parent_run_id = later.parent_run_id AND m.job_name = later.job_name
 AND m.assignment_mapping_skey < later.assignment_mapping_skey
WHERE later.assignment_mapping_skey IS NULL""",
    "o_latest_runs": "SELECT * FROM o_runs QUALIFY rank() OVER (PARTITION BY parent_job_name ORDER BY activation_time DESC) = 1",
    "o_script": """
SELECT DISTINCT t.job_id, h.job_name, t.line_no, coalesce(t.line, chr(10)) AS line
FROM process_tab t JOIN run_header h ON t.job_id = h.job_id""",
    "o_header": """
SELECT *, string_split(login, '.')[-1] AS service_id FROM run_header
QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY last_modified DESC, run_id DESC) = 1""",
    "o_usage": """
SELECT host, metric, mount, ts, CAST(floor(100 * used / nullif(total, 0)) AS BIGINT) AS pct FROM host_metric
QUALIFY row_number() OVER (PARTITION BY host, metric, mount ORDER BY ts DESC, event_id DESC) = 1""",
}


def check_sql(text: str) -> str:
    """A check as one standalone statement over the base tables."""
    known = {**{name: portable(sql) for name, sql in VIEWS.items()}, **PARTS}
    # Views and parts refer to each other in any order, so sort by dependency.
    names = needed(text, known)
    ordered: list[str] = []

    def place(name: str) -> None:
        for other in needed(known[name], known):
            if other not in ordered and other != name:
                place(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        place(name)
    body = text.strip()
    if not ordered:
        return body
    clause = with_clause(ordered, known, "MATERIALIZED ")
    return f"WITH {clause}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {clause} {body}"


def entry(name: str, check: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name, with its checking SQL."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if check is not None:
            CHECKS[name] = check_sql(check)
        return fn

    return register

"""Counters, domain scopes, SLA health."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import AS_OF, PARTS, entry
from runlens.functions import predicates as P
from runlens.functions.clock import minutes_until, moment, same_day
from runlens.functions.labels import run_state
from runlens.plans import counts, sla
from runlens.sources.tables import work_dir

STATE = """CASE WHEN return_code_text IN ('CANCELLED', 'SUCCESS') THEN return_code_text
 WHEN hard_sla_status = 'Missed' THEN 'SLA_MISS' WHEN failed_jobs > 0 THEN 'FAILED' WHEN ert_exceeded_jobs > 0 THEN 'ERT' END"""
COMMERCE = "(regexp_matches(parent_job_name, '(?i).GEC|CEXP') OR product_name ILIKE '%ECOMM%' OR application_name ILIKE '%ECOMM%')"

PARTS["o_status"] = f"""
SELECT domain_name, rstatus, total_count FROM (
 SELECT domain_name, {STATE} AS rstatus, count(*) AS total_count FROM wf_run GROUP BY 1, 2
 UNION
 SELECT domain_name, 'RUNNING', count(*) FROM wf_run WHERE return_code_text = 'RUNNING' GROUP BY 1) both_arms
WHERE rstatus IS NOT NULL"""
PARTS["o_ecomm_status"] = f"""
SELECT 'EComm' AS domain_name, rstatus, total_count FROM (
 SELECT {STATE} AS rstatus, count(*) AS total_count FROM wf_run WHERE {COMMERCE} GROUP BY 1
 UNION
 SELECT 'RUNNING', count(*) FROM wf_run WHERE return_code_text = 'RUNNING' AND {COMMERCE}) both_arms
WHERE rstatus IS NOT NULL"""


@entry("status_counts", "SELECT * FROM o_status")
def status_counts(v):
    return counts.status_counts(v.wf_run)


@entry("status_counts_maintained", "SELECT * FROM o_status")
def status_counts_maintained(v):
    """Counts of an earlier state of the runs, kept up to date through two batches of changes, one of them given twice."""
    folder, key = work_dir(v.spark, "status-counts"), F.col("parent_run_id")
    earlier = F.when(key % 5 == 0, F.lit("RUNNING")).otherwise(F.col("return_code_text"))
    counts.start_maintained_counts(v.wf_run.filter(key % 3 != 0).withColumn("return_code_text", earlier), folder, 16)
    state = v.wf_run.select("parent_run_id", key.alias("seq"), "return_code_text").filter((key % 3 != 0) & (key % 5 == 0))
    new = v.wf_run.filter(key % 3 == 0).withColumn("seq", key)
    for changes, batch in ((state, "ended"), (new, "new"), (state, "ended")):
        counts.change_maintained_counts(v.spark, folder, changes, batch)
    return counts.maintained_counts(v.spark, folder)


@entry("ecomm_status_counts", "SELECT * FROM o_ecomm_status")
def ecomm_status_counts(v):
    return counts.ecomm_status_counts(v.wf_run)


SPINE = "(VALUES ('SUCCESS'), ('SLA_MISS'), ('RUNNING'), ('FAILED'), ('ERT'), ('CANCELLED')) s(rstatus)"


@entry(
    "status_counts_scoped",
    f"""
WITH chosen AS (SELECT rstatus, sum(total_count) AS n FROM o_status WHERE domain_name IN ('ASIA', 'EUROPE') GROUP BY 1)
SELECT coalesce(s.rstatus, c.rstatus) AS rstatus, CAST(coalesce(c.n, 0) AS BIGINT) AS total_count
FROM {SPINE} FULL OUTER JOIN chosen c ON s.rstatus = c.rstatus""",
)
def status_counts_scoped(v):
    return counts.status_counts_scoped(v.wf_run, ["ASIA", "EUROPE"])


@entry(
    "domain_status_counts",
    f"""
WITH chosen AS (SELECT rstatus, sum(total_count) AS n FROM o_status GROUP BY 1)
SELECT coalesce(s.rstatus, c.rstatus) AS rstatus, CAST(coalesce(c.n, 0) AS BIGINT) AS total_count
FROM {SPINE} FULL OUTER JOIN chosen c ON s.rstatus = c.rstatus""",
)
def domain_status_counts(v):
    return counts.status_counts_scoped(v.wf_run, ["All"])


@entry(
    "domain_status_counts_ecomm",
    f"""
SELECT coalesce(s.rstatus, c.rstatus) AS rstatus, CAST(coalesce(c.total_count, 0) AS BIGINT) AS total_count
FROM {SPINE} FULL OUTER JOIN o_ecomm_status c ON s.rstatus = c.rstatus""",
)
def domain_status_counts_ecomm(v):
    return counts.status_counts_scoped(v.wf_run, ["Ecomm"])


@entry("distinct_domains", "SELECT DISTINCT domain_name FROM wf_run")
def distinct_domains(v):
    return counts.distinct_domains(v.wf_run)


@entry("distinct_close_codes", "SELECT DISTINCT category_text FROM close_code")
def distinct_close_codes(v):
    return counts.distinct_close_codes(v.close_code)


@entry("union_distinct", "SELECT domain_name AS name FROM wf_run UNION SELECT product_name FROM wf_run")
def union_distinct(v):
    names = v.wf_run.select(F.explode(F.array("domain_name", "product_name")).alias("name"))
    return names.distinct()


@entry(
    "distinct_group",
    "SELECT DISTINCT rstatus, n FROM (SELECT domain_name, rstatus, sum(total_count)::BIGINT > 100 AS n FROM o_status GROUP BY 1, 2) g",
)
def distinct_group(v):
    grouped = counts.status_counts(v.wf_run)
    return grouped.select("rstatus", (F.col("total_count") > 100).alias("n")).distinct()


def scoped(v, domains):
    return v.wf_run.filter(P.domain_scope(domains)).select("parent_run_id", "domain_name", "product_name")


@entry("domain_scope_all", "SELECT parent_run_id, domain_name, product_name FROM wf_run")
def domain_scope_all(v):
    return scoped(v, ["All"])


@entry(
    "domain_scope_list",
    "SELECT parent_run_id, domain_name, product_name FROM wf_run WHERE domain_name IN ('ASIA', 'AFRICA')",
)
def domain_scope_list(v):
    return scoped(v, ["ASIA", "AFRICA"])


@entry("domain_scope_ecomm", f"SELECT parent_run_id, domain_name, product_name FROM wf_run WHERE {COMMERCE}")
def domain_scope_ecomm(v):
    return scoped(v, ["Ecomm"])


@entry("run_state", f"SELECT parent_run_id, {STATE} AS rstatus FROM wf_run")
def state_of_run(v):
    return v.wf_run.select("parent_run_id", run_state().alias("rstatus"))


# SLA

PARTS["o_sla"] = """
SELECT d.*, w.job_frequency FROM workflow_master w JOIN wf_run d ON w.wrkflw_nm = d.parent_job_name
WHERE d.sla_type IN ('B', 'B&I')"""
PARTS["o_sla_latest"] = """
SELECT * FROM o_sla WHERE job_frequency NOT IN ('Weekly')
QUALIFY row_number() OVER (PARTITION BY parent_job_name ORDER BY start_time DESC, parent_run_id DESC) = 1"""
PARTS["o_sla_latest_any"] = """
SELECT * FROM o_sla
QUALIFY row_number() OVER (PARTITION BY parent_job_name ORDER BY start_time DESC, parent_run_id DESC) = 1"""
PARTS["o_codes"] = "SELECT domain_name, upper(return_code_text) AS status, count(*) AS cnt FROM o_sla_latest GROUP BY 1, 2"
PARTS["o_today"] = f"""
SELECT domain_name, upper(hard_sla_status) AS status, count(*) AS cnt FROM o_sla_latest
WHERE CAST(start_time AS DATE) = DATE '{AS_OF[:10]}' GROUP BY 1, 2"""
PARTS["o_total"] = "SELECT domain_name, count(*) AS cnt FROM o_sla_latest_any WHERE bsns_sla_time_date IS NOT NULL GROUP BY 1"
PARTS["o_spine"] = """
SELECT d.domain_name, upper(s.status) AS status
FROM (SELECT DISTINCT domain_name FROM wf_run WHERE domain_name <> 'DFS') d,
 (VALUES ('Job_Active_SLA_Not_Missed'), ('Met'), ('Missed'), ('RUNNING'), ('SUCCESS'), ('FAILED'), ('Total_Count')) s(status)"""
PARTS["o_health"] = """
SELECT p.domain_name, p.status, CASE WHEN c.cnt IS NULL THEN 0 ELSE c.cnt END AS status_cnt
FROM o_spine p LEFT JOIN (SELECT * FROM o_codes UNION SELECT * FROM o_today
 UNION SELECT domain_name, 'TOTAL_COUNT', cnt FROM o_total) c ON p.domain_name = c.domain_name AND p.status = c.status"""


@entry("latest_by_start", "SELECT parent_job_name, parent_run_id, start_time FROM o_sla_latest")
def latest_by_start(v):
    latest = sla.latest_sla_runs(v.wf_run, v.workflow_master).filter("regular")
    return latest.select("parent_job_name", "parent_run_id", "start_time")


@entry("sla_return_code_counts", "SELECT * FROM o_codes")
def sla_return_code_counts(v):
    return sla.return_code_counts(v.wf_run, v.workflow_master)


@entry("sla_status_counts_today", "SELECT * FROM o_today")
def sla_status_counts_today(v):
    return sla.sla_status_counts_today(v.wf_run, v.workflow_master, AS_OF)


@entry("sla_total_count", "SELECT * FROM o_total")
def sla_total_count(v):
    return sla.sla_total_count(v.wf_run, v.workflow_master)


@entry("status_spine", "SELECT * FROM o_spine")
def status_spine(v):
    return sla.status_spine(v.wf_run)


@entry("zero_fill", "SELECT p.domain_name, p.status, coalesce(c.cnt, 0) AS status_cnt FROM o_spine p LEFT JOIN o_codes c USING (domain_name, status)")
def zero_fill(v):
    return sla.zero_filled(sla.status_spine(v.wf_run), sla.return_code_counts(v.wf_run, v.workflow_master))


@entry("sla_health", "SELECT * FROM o_health")
def sla_health(v):
    return sla.sla_health(v.wf_run, v.workflow_master, AS_OF)


@entry("order_domain_status", "SELECT domain_name, status, status_cnt FROM o_health ORDER BY domain_name, status")
def order_domain_status(v):
    return sla.sla_health(v.wf_run, v.workflow_master, AS_OF)


HEALTH_COLUMNS = ["job_active_sla_not_missed", "met", "missed", "running", "success", "failed", "total_count"]


@entry(
    "sla_health_map",
    "SELECT domain_name, "
    + ", ".join(f"sum(status_cnt) FILTER (WHERE status = '{c.upper()}')::BIGINT AS {c}" for c in HEALTH_COLUMNS)
    + " FROM o_health GROUP BY 1",
)
def sla_health_map(v):
    return sla.sla_health_map(sla.sla_health(v.wf_run, v.workflow_master, AS_OF))


PARTS["o_sla_candidates"] = f"""
SELECT r.domain_name, r.product_name, m.application_name, r.parent_job_name, r.return_code_text, r.bsns_sla_time_date,
 m.bsns_impact_justification, r.bsns_sla_diff_mins, 'cc@ops.invalid' AS cc_list, 'to@ops.invalid' AS to_list,
 date_diff('second', TIMESTAMP '{AS_OF}' - INTERVAL 5 HOUR, r.bsns_sla_time_date) / 60 AS min_diff,
 r.parent_run_id, i.job_name, i.jira, i.created_dt, i.service_now, i.zoom_link, i.close_code, i.root_cause, i.error
FROM wf_run r JOIN app_meta m ON m.workflow_name = r.parent_job_name
LEFT JOIN assignment i ON i.parent_run_id = r.parent_run_id AND i.job_name = r.parent_job_name
WHERE r.return_code_text != 'SUCCESS' AND r.sla_type = 'B'
QUALIFY row_number() OVER (PARTITION BY r.parent_job_name ORDER BY r.activation_time DESC, r.parent_run_id DESC) = 1"""


@entry("potential_sla_miss", "SELECT * FROM o_sla_candidates WHERE min_diff > -60 AND min_diff < 60")
def potential_sla_miss(v):
    return sla.potential_sla_miss(v.wf_run, v.app_meta, v.assignment, AS_OF, "cc@ops.invalid", "to@ops.invalid")


@entry("latest_by_activation", "SELECT parent_job_name, parent_run_id, job_name FROM o_sla_candidates")
def latest_by_activation(v):
    latest = sla.sla_candidates(v.wf_run, v.app_meta, v.assignment, AS_OF)
    return latest.select("parent_job_name", "parent_run_id", "job_name")


@entry("minutes_to_sla", f"SELECT parent_run_id, date_diff('second', TIMESTAMP '{AS_OF}' - INTERVAL 5 HOUR, bsns_sla_time_date) / 60 AS min_diff FROM wf_run")
def minutes_to_sla(v):
    return v.wf_run.select("parent_run_id", minutes_until(F.col("bsns_sla_time_date"), moment(AS_OF)).alias("min_diff"))


@entry(
    "open_interval_minutes",
    f"""
SELECT * FROM (SELECT parent_run_id, date_diff('second', TIMESTAMP '{AS_OF}' - INTERVAL 5 HOUR, bsns_sla_time_date) / 60 AS min_diff
 FROM wf_run) t WHERE min_diff > -60 AND min_diff < 60""",
)
def open_interval_minutes(v):
    return minutes_to_sla(v).filter(P.within_open_interval("min_diff", -60, 60))


@entry("today_filter", f"SELECT parent_run_id, start_time FROM wf_run WHERE CAST(start_time AS DATE) = DATE '{AS_OF[:10]}'")
def today_filter(v):
    return v.wf_run.filter(same_day(F.col("start_time"), moment(AS_OF))).select("parent_run_id", "start_time")


@entry(
    "inner_metadata",
    "SELECT r.parent_run_id, r.parent_job_name, m.bsns_impact_justification FROM wf_run r JOIN app_meta m ON m.workflow_name = r.parent_job_name",
)
def inner_metadata(v):
    joined = v.wf_run.join(v.app_meta.drop("application_name"), F.col("workflow_name") == F.col("parent_job_name"))
    return joined.select("parent_run_id", "parent_job_name", "bsns_impact_justification")


@entry(
    "left_workflow_level_assignment",
    """
SELECT r.parent_run_id, r.parent_job_name, i.status, i.jira FROM wf_run r
LEFT JOIN assignment i ON i.parent_run_id = r.parent_run_id AND i.job_name = r.parent_job_name""",
)
def left_workflow_level_assignment(v):
    records = v.assignment.select("parent_run_id", F.col("job_name").alias("parent_job_name"), "status", "jira")
    runs = v.wf_run.select("parent_run_id", "parent_job_name")
    return runs.join(records, ["parent_run_id", "parent_job_name"], "left")

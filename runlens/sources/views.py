"""Operations tables derived from the generic test tables.

Each view is one SQL text that both Spark and an independent checking engine can run, so a
test compares query results over equal inputs.  Every view reads whole tables: rows
are left out only where the business meaning asks for it (for example, an incident record
exists for jobs that failed).  Values are invented.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

AS_OF = "2024-01-15 17:00:00"

BASE_TABLES = (
    "region nation customer supplier part orders lineitem "
    "events documents embeddings pages benchmark labels conversations"
).split()

_WORKFLOW_NAME = (
    "'JOBP.' || CASE c_nationkey % 5 WHEN 0 THEN 'GEC' WHEN 1 THEN 'CEXP' ELSE 'CORE' END"
    " || '.' || CAST(c_custkey AS STRING)"
)
# A third of all runs fall into family 0, so job names are skewed on purpose.
_JOB_NAME = (
    "'JOBS.' || CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 40 END AS STRING)"
    " || '.' || CAST(l_linenumber % 3 AS STRING)"
)

VIEWS: dict[str, str] = {
    "job_run": f"""
SELECT l_orderkey AS parent_run_id, {_JOB_NAME} AS job_name,
 l_orderkey * 100000 + l_partkey AS job_run_id,
 CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'A' THEN 'SUCCESS' ELSE 'RUNNING' END AS return_code_text,
 CAST('2024-01-14 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' MINUTE * (l_orderkey % 2880) AS start_time,
 CAST('2024-01-14 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' MINUTE * (l_orderkey % 2880 + CAST(l_quantity AS BIGINT)) AS end_time,
 CAST(l_quantity * 60 AS BIGINT) AS ah_runtime, CAST(2400 AS BIGINT) AS ah_ert,
 CASE WHEN l_quantity > 40 THEN 'Y' ELSE 'N' END AS ert_exceeded_ind,
 CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS job_fail_ind,
 CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS sla_ind, l_linenumber AS lvl,
 'http://jobs.invalid/' || CAST(l_orderkey AS STRING) AS run_hist_url
FROM lineitem""",
    "wf_run": f"""
SELECT r.*,
 CASE WHEN sla_type IN ('B','B&I') THEN CASE WHEN return_code_text = 'RUNNING' THEN 'Job_Active_SLA_Not_Missed'
  WHEN end_time > bsns_sla_time_date THEN 'Missed' ELSE 'Met' END END AS bsns_sla_status,
 CASE WHEN sla_type IN ('B','B&I') THEN CASE WHEN return_code_text = 'RUNNING' AND end_time <= hard_sla_time THEN 'Job_Active_SLA_Not_Missed'
  WHEN end_time > hard_sla_time THEN 'Missed' ELSE 'Met' END END AS hard_sla_status
FROM (SELECT b.*, start_time + INTERVAL '1' SECOND * ah_runtime AS end_time,
  start_time + INTERVAL '1' MINUTE * bsns_sla_diff_mins AS bsns_sla_time_date,
  start_time + INTERVAL '1' MINUTE * (30 + custkey % 400) AS hard_sla_time,
  start_time - INTERVAL '1' MINUTE AS created_dt, start_time + INTERVAL '1' MINUTE AS updated_dt
 FROM (SELECT o_orderkey AS parent_run_id, o_custkey AS custkey,
   {_WORKFLOW_NAME} AS parent_job_name,
   CASE WHEN o_custkey % 50 = 0 THEN 'DFS' ELSE r_name END AS domain_name,
   CASE WHEN o_custkey % 17 = 0 THEN 'ECOMM ' || c_mktsegment ELSE c_mktsegment END AS product_name,
   n_name AS application_name,
   CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'P' THEN 'RUNNING'
    ELSE CASE o_orderkey % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'CANCELLED' ELSE 'BLOCKED' END END AS return_code_text,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'B' WHEN '2-HIGH' THEN 'B&I' WHEN '3-MEDIUM' THEN 'I' END AS sla_type,
   CAST('2024-01-14 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' HOUR * (o_orderkey % 48) AS activation_time,
   CAST('2024-01-14 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' MINUTE * (o_orderkey % 2880) AS start_time,
   CAST(floor(o_totalprice / 20) AS BIGINT) AS ah_runtime, 3600 + (o_custkey % 10) * 1200 AS ah_ert,
   60 + o_custkey % 600 AS bsns_sla_diff_mins,
   CAST(coalesce(j.total_jobs, 0) AS BIGINT) AS total_jobs, CAST(coalesce(j.running_jobs, 0) AS BIGINT) AS running_jobs,
   CAST(coalesce(j.failed_jobs, 0) AS BIGINT) AS failed_jobs, CAST(coalesce(j.ert_jobs, 0) AS BIGINT) AS ert_exceeded_jobs,
   'http://runs.invalid/' || CAST(o_orderkey AS STRING) AS run_hist_url,
   'CLIENT' || CAST(c_nationkey AS STRING) AS ah_client, o_orderpriority AS job_flow_priority,
   o_custkey % 100 AS ord_key, 'SRC' || CAST(c_nationkey % 3 AS STRING) AS source_nm,
   'OPS' || CAST(c_nationkey % 4 AS STRING) AS jira_project_key, c_mktsegment AS dt_jira_component,
   'GRP' || CAST(c_nationkey AS STRING) AS dt_xmatter_grp_nm
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT parent_run_id, count(*) AS total_jobs, sum(CASE WHEN return_code_text = 'RUNNING' THEN 1 ELSE 0 END) AS running_jobs,
    sum(CASE WHEN job_fail_ind = 'Y' THEN 1 ELSE 0 END) AS failed_jobs, sum(CASE WHEN ert_exceeded_ind = 'Y' THEN 1 ELSE 0 END) AS ert_jobs
   FROM job_run GROUP BY parent_run_id) j ON o_orderkey = j.parent_run_id) b) r""",
    "assignment": """
SELECT parent_run_id, job_name,
 CASE parent_run_id % 3 WHEN 0 THEN 'WIP' WHEN 1 THEN 'CLOSED' ELSE 'OPEN' END AS status,
 CASE WHEN parent_run_id % 5 = 0 THEN ',OPS-' || CAST(parent_run_id AS STRING) END AS jira,
 CASE WHEN parent_run_id % 10 = 0 THEN 'INC' || CAST(parent_run_id AS STRING) END AS service_now,
 CASE WHEN parent_run_id % 20 = 0 THEN 'http://call.invalid/' || CAST(parent_run_id AS STRING) END AS zoom_link,
 CASE WHEN parent_run_id % 3 = 1 THEN 'DATA' END AS close_code, CASE WHEN parent_run_id % 3 = 1 THEN 'late feed' END AS root_cause,
 CASE parent_run_id % 7 WHEN 0 THEN 'Error: file is not available' WHEN 1 THEN 'diagnostics: AM container killed' WHEN 2 THEN '3 rules failed!' END AS error,
 CASE WHEN parent_run_id % 2 = 0 THEN 1 ELSE 0 END AS ert_alert, CASE WHEN parent_run_id % 2 = 1 THEN 1 ELSE 0 END AS failure_alert, 0 AS slamiss_alert,
 'user1' AS created_user, 'user2' AS updated_user,
 CAST('2024-01-14 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' MINUTE * (parent_run_id % 2900) AS created_dt,
 CAST('2024-01-14 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' MINUTE * (parent_run_id % 3000) AS updated_dt
FROM (SELECT DISTINCT parent_run_id, job_name FROM job_run WHERE job_fail_ind = 'Y'
 UNION ALL SELECT parent_run_id, parent_job_name AS job_name FROM wf_run WHERE return_code_text IN ('FAILED', 'BLOCKED')) x""",
    "assignment_mapping": f"""
SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS assignment_mapping_skey, l_orderkey AS parent_run_id,
 {_JOB_NAME} AS job_name, 'user' || CAST(l_suppkey AS STRING) AS assigned_user,
 CASE WHEN l_suppkey % 2 = 0 THEN 'ENG' ELSE 'SUPPORT' END AS user_role
FROM lineitem WHERE l_linestatus = 'O'""",
    "notes": f"""
SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS notes_skey, l_orderkey AS parent_run_id,
 {_JOB_NAME} AS job_name, 'note ' || CAST(l_partkey AS STRING) AS notes,
 'user' || CAST(l_suppkey AS STRING) AS updated_user, l_shipdate AS updated_dt
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25""",
    "app_meta": f"""
SELECT {_WORKFLOW_NAME} AS workflow_name,
 c_mktsegment AS application_name, 'impact ' || CAST(c_custkey % 9 AS STRING) AS bsns_impact_justification
FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "workflow_master": f"""
SELECT {_WORKFLOW_NAME} AS wrkflw_nm,
 'JOBS.' || CAST(c_custkey % 3 AS STRING) AS sla_lst_job_nm,
 CASE c_custkey % 4 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Hourly' ELSE 'Daily' END AS job_frequency
FROM customer WHERE c_acctbal > 0""",
    "handover_note": """
SELECT CASE WHEN conv_id % 4 < 2 THEN 'HARBOUR' ELSE 'RIVER' END AS team,
 CASE conv_id % 4 WHEN 0 THEN 'HARBOUR_DESK_EARLY' WHEN 1 THEN 'HARBOUR_DESK_LATE' WHEN 2 THEN 'RIVER_DAY' ELSE 'RIVER_NIGHT' END AS shift,
 CASE WHEN conv_id % 2 = 0 THEN '20240114' ELSE '20240115' END AS shift_date, conv_id, turn, text AS oncall_summary,
 'user1' AS created_user, 'user1' AS updated_user
FROM conversations""",
    "close_code": """
SELECT p_type AS category_text FROM part""",
    "run_header": """
SELECT c_custkey AS run_id, c_custkey % 49 AS job_id, 'JOBS.' || CAST(c_custkey % 49 AS STRING) AS job_name,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'SUCCESS' WHEN 'HOUSEHOLD' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
 CAST(floor(abs(c_acctbal)) AS BIGINT) AS runtime, CAST(600 + c_nationkey * 300 AS BIGINT) AS ert,
 CAST('2024-01-15 17:00:00' AS TIMESTAMP_NTZ) - INTERVAL '1' MINUTE * c_custkey AS last_modified,
 CASE WHEN c_custkey % 6 = 0 THEN 'SHARED' ELSE 'NODE' END || CAST(c_custkey % 120 AS STRING) AS edge_node,
 'CLIENT.' || c_mktsegment || '.SVC' || CAST(c_nationkey AS STRING) AS login
FROM customer""",
    "job_log": """
SELECT event_id AS line_no, user_id AS run_id, ts,
 CASE event_type
  WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'WARN ' WHEN 1 THEN 'ERROR ' ELSE '' END || 'Error in step ' || CAST(event_id % 20 AS STRING)
  WHEN 'view' THEN 'diagnostics: ' || CASE WHEN event_id % 2 = 0 THEN 'N/A' ELSE 'container ' || CAST(event_id % 9 AS STRING) || ' killed' END
  WHEN 'click' THEN 'tracking URL: https://cl' || CAST(user_id % 7 AS STRING) || '-m.c.proj' || CAST(user_id % 3 AS STRING) || '.internal:8088/proxy/application_1_' || CAST(event_id % 2 AS STRING)
  WHEN 'purchase' THEN 'input part-' || CAST(event_id % 50 AS STRING) || ' is not available'
  ELSE CASE WHEN event_id % 5 = 0 THEN 'managed node is ready' ELSE CAST(event_id % 6 AS STRING) || ' rules failed!' END END AS line
FROM events""",
    "pattern_entry": """
SELECT CAST(p_partkey AS INT) AS pattern_no, 'pattern ' || CAST(p_partkey AS STRING) AS name,
 CASE WHEN p_partkey = 7 THEN '(?i).*warn.*step.*' WHEN p_partkey = 9 THEN '[0-9]+ rules' WHEN p_partkey = 11 THEN '^[A-Z]+ ' ELSE
 CASE p_partkey % 5 WHEN 0 THEN '(?i)error in step ' || CAST(p_partkey AS STRING) || '$'
  WHEN 1 THEN 'part-' || CAST(p_partkey AS STRING) || ' is not (available|ready)'
  WHEN 2 THEN 'cl[0-9]+-m[.]c[.]proj' || CAST(p_partkey AS STRING) || '[.]internal'
  WHEN 3 THEN '(?i)CONTAINER ' || CAST(p_partkey AS STRING) || ' (killed|lost)|node ' || CAST(p_partkey AS STRING) || ' is ready'
  ELSE '^' || CAST(p_partkey AS STRING) || ' rules failed!+$' END END AS pattern
FROM part""",
    "suggestion_entry": """
SELECT CAST(l_orderkey * 10 + l_linenumber AS INT) AS suggestion_no,
 CASE l_linenumber % 4 WHEN 0 THEN 'step ' || CAST(l_orderkey AS STRING) WHEN 1 THEN 'part-' || CAST(l_orderkey AS STRING) || ' is'
  WHEN 2 THEN 'container ' || CAST(l_orderkey AS STRING) || ' killed' ELSE CAST(l_orderkey AS STRING) || ' rules' END AS error_key,
 'see guide ' || CAST(l_orderkey % 50 AS STRING) AS suggestion
FROM lineitem""",
    "process_tab": """
SELECT p_partkey % 49 AS job_id, p_partkey AS line_no,
 CASE p_partkey % 8 WHEN 0 THEN 'source /u/&TEAM#/ien-&STEP#-env.sh' WHEN 1 THEN 'export REGION=us' || CAST(p_size AS STRING) WHEN 2 THEN 'cd /edge_data/&TEAM# &TEAM#'
  WHEN 3 THEN 'sh run.sh &STEP# &TEAM#' WHEN 4 THEN 'URL=''http://x.invalid/' || p_brand || '''' WHEN 5 THEN 'beeline -f q.sql'
  WHEN 6 THEN CASE WHEN p_size % 2 = 0 THEN 'source ~/.profile' ELSE 'sh /u/$USER/nightly.sh &UNKNOWN#' END END AS line
FROM part""",
    "object_value": """
SELECT p_partkey % 49 AS job_id, p_partkey AS seq,
 CASE p_partkey % 4 WHEN 0 THEN '&TEAM#|team' || CAST(p_size AS STRING) || '|x' WHEN 1 THEN '&STEP#|s' || CAST(p_size AS STRING)
  WHEN 2 THEN '&EMPTY#|' ELSE 'noise:' || CAST(p_size AS STRING) END AS raw
FROM part""",
    "edge_node": """
SELECT CASE WHEN s_suppkey % 6 = 0 THEN 'SHARED' ELSE 'NODE' END || CAST(s_suppkey AS STRING) AS node,
 '192.0.2.' || CAST(s_suppkey % 250 AS STRING) AS address FROM supplier""",
    "agent_file": """
SELECT 'OUT' || CAST(l_orderkey AS STRING) || '.TXT' AS path, CAST(l_linenumber AS BIGINT) AS line_no,
 CASE WHEN l_linenumber = 2 THEN 'U0001 JOB ' || CAST(l_orderkey * 10 AS STRING) || ' started'
  ELSE 'submitted application_1_' || CAST(l_partkey AS STRING) || ' to queue' END AS line
FROM lineitem""",
    "app_request": """
SELECT p_partkey AS line_no, CASE p_partkey % 10 WHEN 0 THEN '# application_1_' || CAST(p_partkey AS STRING)
  WHEN 1 THEN 'application_9_' || CAST(p_partkey AS STRING) WHEN 2 THEN '  ' WHEN 3 THEN 'application_1_' || CAST(p_partkey AS STRING) || '  application_8_' || CAST(p_partkey AS STRING)
  ELSE 'application_1_' || CAST(p_partkey AS STRING) END AS line
FROM part""",
    "cluster_state": """
SELECT CASE WHEN s_nationkey % 7 < 6 THEN 'proj' || CAST(s_nationkey % 5 AS STRING) END AS project,
 CASE s_suppkey % 10 WHEN 0 THEN 'phs-' WHEN 1 THEN 'fd-persistent-' ELSE 'eph-' END || CAST(s_suppkey AS STRING) AS cluster_name,
 CASE WHEN s_suppkey % 4 = 3 THEN 'STOPPED' ELSE 'RUNNING' END AS status,
 CAST('2024-01-15 17:00:00' AS TIMESTAMP_NTZ) - INTERVAL '1' SECOND * (s_suppkey * 421 % 24000) AS state_start_time
FROM supplier""",
    "host_metric": """
SELECT event_id, 'host' || CAST(user_id % 20 AS STRING) AS host, ts,
 CASE event_type WHEN 'view' THEN 'memory' WHEN 'click' THEN 'cpu' WHEN 'purchase' THEN 'disk' ELSE 'mount' END AS metric,
 CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN NULL WHEN 'purchase' THEN '/'
  ELSE CASE event_id % 3 WHEN 0 THEN '/nfs/en' WHEN 1 THEN '/nfs/fr' ELSE '/nfs/de' END END AS mount,
 least(value, CAST(100 AS DOUBLE)) AS used, CAST(CASE WHEN event_id % 37 = 0 THEN 0 ELSE 100 END AS DOUBLE) AS total
FROM events""",
    "process_sample": """
SELECT 'host' || CAST(user_id % 20 AS STRING) AS host, event_id % 997 AS pid, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS ts, value AS pct_mem,
 CAST(event_id * 7 % 1000 AS DOUBLE) / 10 AS pct_cpu, 'cmd' || CAST(event_id % 13 AS STRING) AS cmd FROM events""",
    "host_config": """
SELECT s_suppkey AS config_id, 'host' || CAST(s_suppkey % 20 AS STRING) AS host,
 '/nfs/' || CAST(s_nationkey AS STRING) || ',/nfs/home' || CAST(s_suppkey % 3 AS STRING) AS mounts FROM supplier""",
    "dir_usage": """
SELECT 'host' || CAST(doc_id % 20 AS STRING) AS host, CASE WHEN doc_id % 7 = 0 THEN '/' ELSE '/nfs/' || lang END AS mount,
 '/nfs/' || lang || '/' || source || '/' || CAST(doc_id AS STRING) AS path,
 CASE WHEN doc_id % 41 = 0 THEN '-' WHEN doc_id % 43 = 0 THEN '' ELSE CAST(n_chars AS STRING) END
 || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'K' WHEN 2 THEN '.5M' ELSE 'G' END AS size_text
FROM documents""",
    "reservation_raw": """
SELECT event_id, ts AS poll_time, 'project-' || CAST(user_id % 5 AS STRING) AS project, 'zone-' || CAST(user_id % 3 AS STRING) AS zone,
 CASE WHEN event_type = 'error' THEN 'gateway timeout' ELSE
 '{' || CASE WHEN event_id % 17 = 0 THEN '' ELSE '"name":"res-' || CAST(user_id % 16 AS STRING) || '",' END
 || '"creationTimestamp":"2024-01-01T00:00:00","specificReservation":{"count":100,'
 || CASE WHEN event_id % 23 = 0 THEN '' ELSE '"inUseCount":' || CAST(event_id % 101 AS STRING) || ',' END || '"assuredCount":100'
 || CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 19 = 0 THEN ',"instanceProperties":{}'
  ELSE ',"instanceProperties":{"machineType":"m' || CAST(user_id % 4 AS STRING) || '"}' END || '}}' END AS body
FROM events""",
    "file_listing": """
SELECT source || '/' || CAST(doc_id AS STRING) || '.log' AS path, CASE WHEN doc_id % 3 = 0 THEN 'svc' || source ELSE source END AS owner,
 CAST('2024-01-15 17:00:00' AS TIMESTAMP_NTZ) - INTERVAL '1' HOUR * (doc_id * 5 % 3000) AS mtime, n_chars AS bytes
FROM documents""",
    "file_content": """
SELECT source || '/' || CAST(doc_id AS STRING) || '.log' AS path, text FROM documents""",
    "ticket_request": """
SELECT o_orderkey AS request_id, o_orderkey AS parent_run_id, 'OPS' AS project_key, 'support-out' AS label,
 'requestor' || CAST(o_custkey % 10 AS STRING) AS requestor, 'component ' || CAST(o_custkey % 4 AS STRING) AS component1,
 'component ' || CAST(o_custkey % 6 AS STRING) AS component2, 'run ' || CAST(o_orderkey AS STRING) || ' needs support' AS summary,
 'priority of the order: ' || o_orderpriority AS description, 'Support Incident' AS issue_type,
 'P' || CAST(o_custkey % 4 AS STRING) AS priority,
 CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'ERT' ELSE 'SLAMISSED' END AS alert_type
FROM orders""",
}


def needed(text: str, known: dict[str, str]) -> list[str]:
    """Names of the known queries a SQL text reads, directly or through others, in definition order."""

    def mentioned(sql: str) -> set[str]:
        return set(re.findall(r"\w+", sql)) & known.keys()

    found: set[str] = set()
    todo = mentioned(text)
    while todo:
        name = todo.pop()
        found.add(name)
        todo |= mentioned(known[name]) - found
    return [name for name in known if name in found]


def with_clause(names: list[str], known: dict[str, str], hint: str = "") -> str:
    return ", ".join(f"{name} AS {hint}({known[name]})" for name in names)


def portable(text: str) -> str:
    """A view's text with the standard type names other engines use."""
    return text.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace(" AS STRING", " AS VARCHAR")


_SCHEMAS: dict[str, StructType] = {}


class Views:
    """The derived views of one data directory, each a DataFrame attribute: ``Views(spark, path).wf_run``.

    A view is built once per instance, from temporary views of the tables it reads.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            table = self._base(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            words = set(re.findall(r"\w+", VIEWS[name]))
            inputs = [n for n in (*BASE_TABLES, *VIEWS) if n in words and n != name]
            for other in inputs:
                getattr(self, other).createOrReplaceTempView(other)
            table = self.spark.sql(VIEWS[name])
        else:
            raise AttributeError(name)
        # Later look-ups find the attribute and do not come here again.
        setattr(self, name, table)
        return table

    def _base(self, path: str) -> DataFrame:
        """Base table; its schema is read from the file once per process."""
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

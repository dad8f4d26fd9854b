"""Hand-made edge rows for the workflow marts, counters and SLA health."""

import datetime as dt

from pyspark.sql import functions as F

from runlens.functions import labels as L
from runlens.functions import predicates as P
from runlens.plans import counts, sla
from runlens.plans import workflows as W

RUN = (
    "parent_run_id bigint, parent_job_name string, domain_name string, product_name string, application_name string,"
    " return_code_text string, sla_type string, activation_time timestamp_ntz, start_time timestamp_ntz,"
    " failed_jobs bigint, ert_exceeded_jobs bigint, bsns_sla_status string, hard_sla_status string,"
    " bsns_sla_time_date timestamp_ntz, bsns_sla_diff_mins bigint"
)
JOB = "parent_run_id bigint, job_name string, job_run_id bigint, return_code_text string, ert_exceeded_ind string, job_fail_ind string"
RECORD = (
    "parent_run_id bigint, job_name string, status string, jira string, service_now string, zoom_link string,"
    " close_code string, root_cause string, error string, created_dt timestamp_ntz"
)
MAPPING = "assignment_mapping_skey bigint, parent_run_id bigint, job_name string, assigned_user string, user_role string"
T0 = dt.datetime(2024, 1, 15, 8)


def run(i, workflow="w", code="RUNNING", domain="D1", failed=0, late=0, sla=None, at=T0, hard=None, product="p", kind="B", due=None):
    return (i, workflow, domain, product, "a", code, kind, at, at, failed, late, sla, hard, due, 60)


def record(i, job, status):
    return (i, job, status, None, None, None, None, None, None, T0)


def make(spark, runs, jobs=(), records=(), mapping=()):
    return (
        spark.createDataFrame(list(runs), RUN),
        spark.createDataFrame(list(jobs), JOB),
        spark.createDataFrame(list(records), RECORD),
        spark.createDataFrame(list(mapping), MAPPING),
    )


def test_ties_and_runs_without_flagged_jobs_survive(spark, rows):
    tables = make(
        spark,
        [run(1), run(2), run(3, at=T0 - dt.timedelta(hours=1))],
        [(1, "j", 10, "FAILED", "N", "Y"), (1, "j", 9, "FAILED", "N", "Y"), (2, "j", 5, "SUCCESS", "N", "N")],
    )
    flat = W.all_workflows(*tables)
    assert rows(flat, "parent_run_id", "job_name", "job_run_id") == [(1, "j", 10), (2, None, None)]


def test_scope_is_applied_before_the_latest_run(spark, rows):
    tables = make(spark, [run(1, domain="D1", at=T0), run(2, domain="D2", at=T0 + dt.timedelta(hours=1))])
    assert rows(W.all_workflows(*tables, ["D1"]), "parent_run_id") == [(1,)]


def test_assignee_needs_a_record(spark, rows):
    tables = make(
        spark,
        [run(1, failed=1)],
        [(1, "j", 1, "FAILED", "N", "Y"), (1, "k", 2, "FAILED", "N", "Y")],
        [record(1, "j", "WIP")],
        [(1, 1, "j", "old", "ENG"), (2, 1, "j", "new", "ENG"), (3, 1, "k", "nobody", "ENG")],
    )
    flat = W.sla_workflows(*tables)
    assert rows(flat, "job_name", "assignment_status", "assigned_user") == [("j", "WIP", "new"), ("k", "OPEN", "Not Assigned")]


def test_status_without_alert_is_na(spark, rows):
    tables = make(spark, [run(1)])
    assert rows(W.sla_workflows(*tables), "assignment_status", "assigned_user") == [("NA", "NA")]


def test_actionable_rules(spark, rows):
    tables = make(
        spark,
        [
            run(1, code="SUCCESS", failed=1),
            run(2, code=None, failed=1),
            run(3, code="FAILED", failed=1),
            run(4, code="FAILED", failed=None, late=2),
            run(5, code="RUNNING", sla="Missed", failed=None, late=None),
            run(6, code="RUNNING"),
            run(7, code="FAILED", failed=1),
        ],
        [
            (3, "done", 1, "SUCCESS", "Y", "N"),
            (4, "open", 1, "FAILED", "Y", "N"),
            (4, "closed", 2, "FAILED", "Y", "N"),
            (7, "latest done", 2, "SUCCESS", "Y", "N"),
            (7, "latest done", 1, "FAILED", "Y", "Y"),
        ],
        [record(4, "closed", "CLOSED")],
    )
    flat = W.actionable_workflows(*tables)
    assert rows(flat, "parent_run_id", "job_name", "alert_type") == [(4, "open", "ERT"), (5, None, "SLAMISSED")]
    lists = W.nest_jobs_by_alert(flat)
    assert [lists[k].count() for k in ("SLAMISSED", "FAILED", "ERT", "NA")] == [1, 0, 1, 0]


def test_nested_result_is_whole(spark):
    jobs = [(1, f"j{i:03}", i, "FAILED", "N", "Y") for i in range(300)]
    flat = W.sla_workflows(*make(spark, [run(1, failed=300), run(2, workflow="x")], jobs))
    nested = W.nest_jobs(flat, page_size=50).collect()
    assert sorted(j["job_name"] for r in nested if r["parent_run_id"] == 1 for j in r["jobs"]) == [j[1] for j in jobs]
    assert len([r for r in nested if r["parent_run_id"] == 1]) > 3
    (quiet,) = [r for r in nested if r["parent_run_id"] == 2]
    assert [j["job_name"] for j in quiet["jobs"]] == [None]
    assert quiet["conv_end_time"] == W.MISSING_COLUMN and quiet["jobs"][0]["job_duration"] == W.MISSING_COLUMN


def test_pending_closure(spark, rows):
    tables = make(
        spark,
        [run(1, failed=1)],
        [(1, "j", 1, "FAILED", "N", "N"), (1, "j", 2, "RUNNING", "N", "N"), (1, "k", 3, "FAILED", "N", "N")],
        [record(1, "j", "WIP"), record(1, "k", "OPEN")],
        [(1, 1, "j", None, None), (2, 1, "k", "u", None)],
    )
    found = W.issues_pending_closure(*tables)
    assert rows(found, "job_name", "job_run_id", "assigned_user", "alert_type") == [("j", 2, "Not Assigned", "FAILED")]


def test_counters(spark, rows):
    runs = make(
        spark,
        [
            run(1, code="RUNNING", late=1),
            run(2, code="SUCCESS", hard="Missed"),
            run(3, code="FAILED", hard="Missed", failed=1),
            run(4, code="BLOCKED"),
        ],
    )[0]
    assert rows(counts.status_counts(runs)) == [
        ("D1", "ERT", 1), ("D1", "RUNNING", 1), ("D1", "SLA_MISS", 1), ("D1", "SUCCESS", 1),
    ]
    assert dict(rows(counts.status_counts_scoped(runs, ["nowhere"]))) == dict.fromkeys(counts.COUNTED_STATES, 0)
    assert counts.status_counts_scoped(runs, ["D1", "all"]).filter("total_count > 0").count() == 4
    assert counts.status_counts_scoped(runs, ["nowhere", "all"]).filter("total_count > 0").count() == 0


def test_commerce_area(spark, rows):
    runs = make(
        spark,
        [
            run(1, workflow="JOBP.GEC.1", code="FAILED", failed=1),
            run(2, workflow="GEC", code="SUCCESS"),
            run(3, workflow="xcexpx", code="SUCCESS"),
            run(4, product="My Ecomm", code="SUCCESS"),
        ],
    )[0]
    assert rows(runs.filter(P.domain_scope(["Ecomm"])), "parent_run_id") == [(1,), (3,), (4,)]
    assert rows(counts.ecomm_status_counts(runs)) == [("EComm", "FAILED", 1), ("EComm", "RUNNING", 0), ("EComm", "SUCCESS", 2)]


def test_sla_health_keeps_both_counts_of_one_status(spark, rows):
    masters = spark.createDataFrame([("w1", "Daily"), ("w2", "Daily"), ("w3", "Weekly")], "wrkflw_nm string, job_frequency string")
    runs = make(
        spark,
        [
            run(1, workflow="w1", code="MET", hard="Met", due=T0),
            run(2, workflow="w2", code="FAILED", hard="Met", due=T0),
            run(3, workflow="w3", code="FAILED", hard="Met", due=T0),
            run(4, workflow="w9", code="FAILED", domain="DFS"),
        ],
    )[0]
    health = sla.sla_health(runs, masters, "2024-01-15 17:00:00")
    found = rows(health.filter("status_cnt > 0"))
    assert found == [("D1", "FAILED", 1), ("D1", "MET", 1), ("D1", "MET", 2), ("D1", "TOTAL_COUNT", 3)]
    assert health.count() == 8
    (summed,) = sla.sla_health_map(health).collect()
    assert (summed["met"], summed["missed"], summed["total_count"]) == (3, 0, 3)


def test_potential_miss_is_open_on_both_sides(spark, rows):
    meta = spark.createDataFrame(
        [(f"w{i}", "app", "high") for i in range(5)], "workflow_name string, application_name string, bsns_impact_justification string"
    )
    # 12:00 at the fixed offset; the ends 11:00 and 13:00 are outside.
    due = [dt.datetime(2024, 1, 15, 11), dt.datetime(2024, 1, 15, 11, 0, 1), dt.datetime(2024, 1, 15, 12, 30),
           dt.datetime(2024, 1, 15, 12, 59, 59), dt.datetime(2024, 1, 15, 13)]
    runs, _, records, _ = make(spark, [run(i, workflow=f"w{i}", due=d) for i, d in enumerate(due)], records=[record(2, "w2", "WIP")])
    found = sla.potential_sla_miss(runs, meta, records, "2024-01-15 17:00:00")
    assert rows(found, "parent_run_id", "job_name") == [(1, None), (2, "w2"), (3, None)]
    assert dict(rows(found, "parent_run_id", "min_diff"))[2] == 30.0


def test_alert_category_has_eight_values(spark):
    grid = [(s, f, e) for s in ("Missed", "Met") for f in "YN" for e in "YN"]
    df = spark.createDataFrame(grid + [(None, None, None)], "s string, f string, e string")
    found = {tuple(r)[:3]: r["c"] for r in df.withColumn("c", L.alert_category("s", "f", "e")).collect()}
    assert found["Missed", "Y", "Y"] == "SLAMISSED_FAILED_ERT" and found["Met", "Y", "Y"] == "FAILED_ERT"
    assert found["Missed", "N", "Y"] == "SLAMISSED_ERT" and found["Met", "N", "Y"] == "ERT"
    assert found["Met", "N", "N"] == "NA" and found[None, None, None] == "NA" and len(set(found.values())) == 8


def test_runtime_advice_is_strict(spark):
    cases = [("FAILED", 49, 100), ("FAILED", 50, 100), ("FAILED", 200, 100), ("FAILED", 201, 100), ("SUCCESS", 1, 100)]
    df = spark.createDataFrame(cases, "status string, runtime bigint, ert bigint")
    found = [r[0] for r in df.select(L.runtime_advice("status", "runtime", "ert")).collect()]
    assert found == [L.RESTART, L.READ_LOGS, L.READ_LOGS, L.RESTART, L.COMPLETED]


def test_job_names_are_accepted_by_raw_prefix(spark):
    names = ["JOBS.A", "jobs.a", "Jobs.a", "JB1", "jb1", "MDSE", "mdse", "JOBP"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(P.accepted_job_name("n")).collect()] == [True, True, False, True, True, True, False, False]


def test_missing_status_is_dropped_or_kept(spark, rows):
    df = spark.createDataFrame([("SUCCESS",), ("FAILED",), (None,)], "s string")
    assert rows(df.filter(P.unfinished("s"))) == [("FAILED",)]
    assert rows(df.filter(P.unfinished_or_missing("s"))) == [(None,), ("FAILED",)]
    assert rows(df.filter(P.not_closed("s"))) == [(None,), ("FAILED",), ("SUCCESS",)]


def test_flags_and_tickets(spark):
    df = spark.createDataFrame([("ERT", None), (None, ",A")], "alert string, jira string")
    flags = L.alert_flags(F.col("alert"))
    found = df.select(*flags.values(), L.appended_ticket(F.col("jira"), F.lit("B"))).collect()
    assert [tuple(r) for r in found] == [(1, 0, 0, ",B"), (0, 0, 0, ",A,B")]

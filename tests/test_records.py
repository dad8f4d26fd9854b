"""Changes to record tables, incident search and handover."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators.changes import explode_workflows, fold_changes, update, upsert
from runlens.functions.clock import Shift
from runlens.plans import handover as H
from runlens.plans import incidents as I
from runlens.plans import records as R

T0 = dt.datetime(2024, 1, 15, 8)
RECORD = (
    "parent_run_id bigint, job_name string, status string, jira string, service_now string, zoom_link string,"
    " close_code string, root_cause string, error string, ert_alert int, failure_alert int, slamiss_alert int,"
    " created_user string, updated_user string, created_dt timestamp_ntz, updated_dt timestamp_ntz"
)
NOTE = "notes_skey bigint, parent_run_id bigint, job_name string, notes string, updated_user string, updated_dt timestamp_ntz"
RUN = "parent_run_id bigint, parent_job_name string, sla_type string, domain_name string, run_hist_url string, return_code_text string"


def record(i, job, status="OPEN", jira=None, error=None, at=T0):
    return (i, job, status, jira, None, None, None, None, error, 0, 0, 0, "maker", "maker", at, at)


@pytest.fixture
def records(spark):
    return spark.createDataFrame([record(1, "a"), record(1, "b", "WIP", ",T-1"), record(2, "a")], RECORD)


def requests(spark, *values):
    """values: (seq, [(run, [jobs])], field dict)"""
    fields = ["root_cause", "close_code", "modified_by", "action", "error", "notes", "jira", "snow", "zoom"]
    schema = "seq bigint, workflows array<struct<parent_run_id: bigint, jobname: array<string>>>, " + ", ".join(
        f"{f} string" for f in fields
    )
    data = [(seq, workflows, *[given.get(f) for f in fields]) for seq, workflows, given in values]
    return spark.createDataFrame(data, schema)


def by_key(df, *columns):
    return {(r["parent_run_id"], r["job_name"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_fold_applies_changes_one_after_the_other(spark):
    pick = random.Random(3)
    changes = [(i, pick.choice("xyz"), pick.choice(["p", "q", None]), pick.choice([1, 2, None])) for i in range(500)]
    df = spark.createDataFrame(changes, "seq bigint, k string, a string, b int").repartition(5)
    expected = {}
    for _, k, a, b in changes:
        old = expected.get(k, (None, None))
        expected[k] = (a if a is not None else old[0], b if b is not None else old[1])
    assert {r["k"]: (r["a"], r["b"]) for r in fold_changes(df, ["k"]).collect()} == expected


def test_records_without_a_job_name_stay(spark, rows):
    """Numbered, searched and joined to their runs like those of a named job."""
    table = spark.createDataFrame([record(i, n, error="Error x", at=T0 + dt.timedelta(hours=i)) for i, n in ((1, None), (2, "a"), (3, None))], RECORD)
    assert rows(I.issue_number(table), "parent_run_id", "issue_number") == [(1, 2), (2, 1), (3, 1)]
    runs = spark.createDataFrame([(i, f"w{i}", "B", "d", "u", "FAILED") for i in (1, 2, 3)], RUN)
    history = I.numbered_issue_history(runs, table)
    assert rows(history, "parent_run_id", "job_name", "issue_number") == [(1, None, 2), (2, "a", 1), (3, None, 1)]
    notes = spark.createDataFrame([(7, 2, "a", "n", "u", T0)], NOTE)
    found = I.error_log_search(table, notes, "error").collect()
    assert [(r["job_name"], len(json.loads(r["notes"]))) for r in found] == [(None, 2), ("a", 1)]


def test_upsert_twice_is_upsert_once(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, n int, t string")
    changes = spark.createDataFrame([(1, "a", None, "y"), (2, "c", 3, None), (3, None, 9, "z")], "seq int, k string, n int, t string")
    once = upsert(old, changes, ["k"])
    assert rows(once) == [("a", 1, "y"), ("b", 2, None), ("c", 3, None)]
    assert rows(upsert(once, changes, ["k"])) == rows(once)
    assert rows(update(old, changes, ["k"])) == [("a", 1, "y"), ("b", 2, None)]


def test_close_inserts_and_closes(spark, records):
    asked = requests(
        spark,
        (1, [(1, ["a", "b"]), (9, ["new"])], {"root_cause": "late", "close_code": "", "action": "CLOSE", "modified_by": "u"}),
        (2, [(2, ["a"])], {"root_cause": "disk", "action": "note"}),
    )
    found = by_key(R.close_issues(records, asked), "status", "root_cause", "close_code", "updated_user", "created_user")
    assert found == {
        (1, "a"): ("CLOSED", "late", None, "u", "maker"),
        (1, "b"): ("CLOSED", "late", None, "u", "maker"),
        (2, "a"): ("OPEN", "disk", None, "maker", "maker"),
        (9, "new"): ("CLOSED", "late", None, "u", None),
    }


def test_bulk_update_changes_known_records_only(spark, records):
    asked = requests(
        spark,
        (1, [(1, ["a"]), (9, ["new"])], {"error": "boom", "zoom": "link", "modified_by": "u", "action": ""}),
        (2, [(2, ["a"])], {"notes": "seen", "modified_by": "u", "action": "keep"}),
    )
    found = by_key(R.bulk_update(records, asked), "error", "zoom_link", "updated_user")
    assert found == {(1, "a"): ("boom", "link", "u"), (1, "b"): (None, None, "maker"), (2, "a"): (None, None, "maker")}
    assert [tuple(r) for r in R.bulk_notes(asked).collect()] == [(2, 2, "a", "seen", "u")]


def test_tickets(spark, records):
    tickets = spark.createDataFrame(
        [(1, 1, "b", "r1", "T-2", "FAILED"), (2, 1, "b", "r2", "T-3", "ERT"), (3, 7, "z", "r3", "T-4", "SLAMISSED")],
        "seq bigint, parent_run_id bigint, job_name string, requestor string, ticket_key string, alert_type string",
    )
    found = by_key(R.upsert_tickets(records, tickets), "status", "jira", "created_user", "updated_user", "ert_alert", "failure_alert", "slamiss_alert")
    assert found[1, "b"] == ("WIP", ",T-1,T-2,T-3", "maker", "r2", 1, 0, 0)
    assert found[7, "z"] == ("WIP", ",T-4", "r3", "r3", 0, 0, 1)
    assert found[1, "a"] == ("OPEN", None, "maker", "maker", 0, 0, 0)


def test_assigned_tickets_replace_and_skip_empty_text(spark, records):
    asked = spark.createDataFrame(
        [(1, 1, "T-9", "", None)], "seq bigint, parent_run_id bigint, jira string, service_now string, zoom_link string"
    )
    found = by_key(R.assign_tickets(records, asked), "jira", "service_now")
    assert found == {(1, "a"): ("T-9", None), (1, "b"): ("T-9", None), (2, "a"): (None, None)}


def test_handover_note_needs_every_field(spark, rows):
    schema = "team string, shift string, shift_date string, oncall_summary string, created_user string, updated_user string"
    old = spark.createDataFrame([("t", "s", "20240115", "old", "u", "u")], schema)
    entries = spark.createDataFrame(
        [(1, "t", "s", "20240115", "u", "", "v"), (2, "t", "s", "20240115", "u", "new", "v"), (3, "t", "s", "20240116", None, "x", "v")],
        "seq int, team string, shift string, shift_date string, user string, oncall_summary string, updated_user string",
    )
    assert rows(R.set_handover_notes(old, entries)) == [("t", "s", "20240115", "new", "u", "v")]


def test_flattening_keeps_every_pair(spark):
    asked = requests(spark, (1, [(1, ["a", "b"]), (2, [])], {}), (2, [(1, ["a"])], {}))
    assert sorted((r["seq"], r["parent_run_id"], r["job_name"]) for r in explode_workflows(asked).collect()) == [
        (1, 1, "a"), (1, 1, "b"), (2, 1, "a"),
    ]


@pytest.fixture
def notes(spark):
    return spark.createDataFrame([(2, 1, "a", "second", "u", T0), (1, 1, "a", 'first "quoted"', None, T0), (3, 5, "x", "lost", "u", T0)], NOTE)


def test_search_keeps_null_objects_and_the_newest_incident(spark, notes):
    later = T0 + dt.timedelta(hours=1)
    incidents = spark.createDataFrame(
        [record(1, "a", error="Disk ERROR"), record(2, "a", "WIP", error="error 2", at=later), record(3, "b", error="fine")], RECORD
    )
    (found,) = I.error_log_search(incidents, notes, "error").collect()
    assert (found["job_name"], found["status"], found["error"]) == ("a", "WIP", "error 2")
    listed = json.loads(found["notes"])
    assert [n["NOTE"] for n in listed] == [None, 'first "quoted"', "second"]
    assert listed[0] == {"NOTE": None, "NOTES_SKEY": None, "UPDATED_DT": None, "UPDATED_USER": None}
    assert listed[1]["UPDATED_USER"] is None and listed[1]["UPDATED_DT"] == "2024-01-15 08:00:00"


def test_search_pages_of_a_large_job_are_whole(spark):
    incidents = spark.createDataFrame([record(i, "hot" if i % 3 else f"j{i % 7}", error="error") for i in range(600)], RECORD)
    notes = spark.createDataFrame([(i, i % 200, "hot", f"n{i}", "u", T0) for i in range(300)], NOTE)
    pages = I.error_log_search(incidents, notes, "error", page_size=100).collect()
    listed = [n for p in pages for n in json.loads(p["notes"])]
    expected = incidents.join(notes.select("parent_run_id", "job_name", "notes_skey"), ["parent_run_id", "job_name"], "left")
    assert len(listed) == expected.count()
    assert sorted(n["NOTES_SKEY"] for n in listed if n["NOTE"]) == sorted(r[0] for r in expected.select("notes_skey").dropna().collect())
    assert {p["page"] for p in pages if p["job_name"] != "hot"} == {0}
    assert len([p for p in pages if p["job_name"] == "hot"]) > 3


def test_numbering_keeps_records_without_a_time(spark):
    incidents = spark.createDataFrame([record(i, "j", at=T0 if i < 3 else None) for i in range(5)], RECORD)
    found = {r["parent_run_id"]: r["issue_number"] for r in I.issue_number(incidents).collect()}
    assert found == {2: 1, 1: 2, 0: 3, 4: 4, 3: 5}


def test_report_window_is_closed_and_joined_on_the_run_only(spark, rows):
    runs = spark.createDataFrame([(1, "w", "B", "D", "u", "FAILED")], RUN)
    at = [dt.datetime(2024, 1, 15, 6), dt.datetime(2024, 1, 15, 14), dt.datetime(2024, 1, 15, 14, 0, 1)]
    incidents = spark.createDataFrame(
        [record(1, "a", "WIP", at=at[0]), record(1, "b", "CLOSED", at=at[1]), record(1, "c", "WIP", at=at[2]), record(1, "d", "OPEN", at=at[0])], RECORD
    )
    window = H.report_window(Shift("EARLY", "06:00:00", "14:00:00"), "2024-01-15 17:00:00")
    report = H.oncall_report(runs, incidents, window, closed_issues=True)
    assert [tuple(r) for r in report["counters"].collect()] == [(3, 1, 1)]
    assert rows(report["pending_issues"], "job_name") == [("a",)] and rows(report["closed_issues"], "job_name") == [("b",)]
    assert "closed_issues" not in H.oncall_report(runs, incidents, window)
    with pytest.raises(ValueError):
        H.report_window(None, start="2024-01-15 00:00:00")


def test_message_without_note_or_issue(spark):
    empty = spark.createDataFrame([], "team string, shift string, shift_date string, oncall_summary string")
    runs = spark.createDataFrame([], RUN)
    incidents = spark.createDataFrame([], RECORD)
    pieces = H.handover_html(runs, incidents, empty, Shift("NIGHT & DAY", "19:00:00", "07:00:00", -1), "2024-01-15 17:00:00", "<me>").collect()
    assert [p["section"] for p in pieces] == [0, 1, 3]
    assert pieces[0]["html"] == "NIGHT & DAY, 2024-01-14: what is open"
    assert "<h1>NIGHT &amp; DAY, " in pieces[1]["html"] and "<p>nothing noted</p>" in pieces[1]["html"]
    assert "&lt;me&gt;" in pieces[2]["html"]


def test_notes_of_one_job(spark, notes):
    assert [r["notes_skey"] for r in I.user_notes(notes, 1, "a").collect()] == [2, 1]


def test_append_fills_missing_columns(spark, notes):
    from runlens.sources.tables import append_rows

    new = spark.createDataFrame([(9, "z", "text")], "parent_run_id bigint, job_name string, notes string")
    assert append_rows(notes, new).filter(F.col("notes_skey").isNull()).count() == 1

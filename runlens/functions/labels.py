"""Derived status, alert and text labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.predicates import any_alert


def run_state() -> Column:
    """State of a run for the dashboard counters: end state, then SLA miss, failure, late job; else NULL."""
    code = F.col("return_code_text")
    return (
        F.when(code.isin("CANCELLED", "SUCCESS"), code)
        .when(F.col("hard_sla_status") == "Missed", "SLA_MISS")
        .when(F.col("failed_jobs") > 0, "FAILED")
        .when(F.col("ert_exceeded_jobs") > 0, "ERT")
    )


def recorded_or(value: str, fallback: str) -> Column:
    """The recorded value, else the fallback for a run with an alert, else NA."""
    return F.when(F.col(value).isNotNull(), F.col(value)).when(any_alert(), fallback).otherwise("NA")


def alert_type() -> Column:
    """First of SLA missed, failed, late; a missing counter counts as zero."""
    return (
        F.when(F.col("bsns_sla_status") == "Missed", "SLAMISSED")
        .when(F.coalesce(F.col("failed_jobs"), F.lit(0)) > 0, "FAILED")
        .when(F.coalesce(F.col("ert_exceeded_jobs"), F.lit(0)) > 0, "ERT")
        .otherwise("NA")
    )


def alert_category(sla_status: str, fail_ind: str, ert_ind: str) -> Column:
    """All alerts that apply, joined by an underscore; NA when none does."""
    parts = F.concat_ws(
        "_",
        F.when(F.col(sla_status) == "Missed", "SLAMISSED"),
        F.when(F.col(fail_ind) == "Y", "FAILED"),
        F.when(F.col(ert_ind) == "Y", "ERT"),
    )
    return F.when(parts == "", "NA").otherwise(parts)


def alert_flags(alert: Column) -> dict[str, Column]:
    """One 0/1 flag per alert type."""
    return {
        "ert_alert": F.coalesce((alert == "ERT").cast("int"), F.lit(0)),
        "failure_alert": F.coalesce((alert == "FAILED").cast("int"), F.lit(0)),
        "slamiss_alert": F.coalesce((alert == "SLAMISSED").cast("int"), F.lit(0)),
    }


def appended_ticket(tickets: Column, key: Column) -> Column:
    """Ticket list with one more key; every key keeps its leading comma."""
    return F.concat(F.coalesce(tickets, F.lit("")), F.lit(","), key)


# The three pieces of advice.
RESTART = "Suggested to restart the job based on RT, Please refer below log output causing failuar."
READ_LOGS = "Suggested :- Please take a call based on logs."
COMPLETED = "Last Execution of the job has completed Successfully, please verify."


def runtime_advice(status: str, runtime: str, ert: str) -> Column:
    """Advice for a run: unusually short or long failures are restarted, other failures read."""
    run, estimate = F.col(runtime), F.col(ert)
    unusual = (run < estimate / 2) | (run > estimate * 2)
    return F.when((F.col(status) == "FAILED") & unusual, RESTART).when(
        F.col(status) == "FAILED", READ_LOGS
    ).otherwise(COMPLETED)


def last_name_part(column: str) -> Column:
    """Text after the last dot."""
    return F.element_at(F.split(F.col(column), r"\."), -1)


def split_shift_name(column: str) -> dict[str, Column]:
    """The last underscore separates the team from its shift."""
    return {
        "team_part": F.regexp_replace(column, "_[^_]*$", ""),
        "shift_part": F.substring_index(column, "_", -1),
    }


def issue_body(
    project: str, summary: str, description: str, issue_type: str, labels: Column, priority: str, components: Column
) -> Column:
    """Ticket body as JSON: named objects for project, type and priority, one object per component."""
    fields = F.struct(
        F.struct(F.col(project).alias("key")).alias("project"),
        F.col(summary).alias("summary"),
        F.col(description).alias("description"),
        F.struct(F.col(issue_type).alias("name")).alias("issuetype"),
        labels.alias("labels"),
        F.struct(F.col(priority).alias("name")).alias("priority"),
        F.transform(components, lambda name: F.struct(name.alias("name"))).alias("components"),
    )
    return F.to_json(F.struct(fields.alias("fields")), {"ignoreNullFields": "false"})

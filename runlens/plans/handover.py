"""On-call reports and shift handover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.clock import Shift, moment, shift_bounds, shift_start_date
from runlens.functions.predicates import matches_all, within_closed_interval

# The columns of a report row, in order.
REPORT_COLUMNS = """
    parent_job_name job_name sla_type domain_name error root_cause jira service_now status run_hist_url
""".split()
NOTE_COLUMNS = ["team", "shift", "shift_date", "oncall_summary"]


def select_where(df: DataFrame, conditions: dict[str, object], columns: list[str]) -> DataFrame:
    """Rows equal to every condition, chosen columns only."""
    return df.filter(matches_all(conditions)).select(*columns)


def report_window(
    shift: Shift | None, as_of: str | None = None, start: str | None = None, end: str | None = None, zone: str = "UTC"
) -> tuple[Column, Column]:
    """UTC bounds of a shift around ``as_of``, or without a shift the bounds given."""
    if shift is not None:
        return shift_bounds(shift, as_of, zone)
    if not (start and end):
        raise ValueError("a window without a shift needs start and end")
    return moment(start), moment(end)


def report_rows(runs: DataFrame, assignment: DataFrame, window: tuple[Column, Column]) -> DataFrame:
    """Incidents updated inside the window with their run; joined on the run id only."""
    touched = assignment.filter(within_closed_interval("updated_dt", *window))
    records = touched.select("parent_run_id", "job_name", "error", "root_cause", "jira", "service_now", "status")
    run = runs.select("parent_run_id", "parent_job_name", "sla_type", "domain_name", "run_hist_url")
    return records.join(run, ["parent_run_id"])


def report_counters(rows: DataFrame) -> DataFrame:
    """Total, pending and closed in one pass."""
    return rows.agg(
        F.count(F.lit(1)).alias("total_issue_count"),
        F.count_if(F.col("status") == "WIP").alias("pending_issue_count"),
        F.count_if(F.col("status") == "CLOSED").alias("closed_issue_count"),
    )


def oncall_report(
    runs: DataFrame, assignment: DataFrame, window: tuple[Column, Column], closed_issues: bool = False
) -> dict[str, DataFrame]:
    """Pending issues and counters of a window, closed issues on request."""
    rows = report_rows(runs, assignment, window)
    report = {
        "pending_issues": rows.filter(F.col("status") == "WIP").select(*REPORT_COLUMNS),
        "counters": report_counters(rows),
    }
    if closed_issues:
        report["closed_issues"] = rows.filter(F.col("status") == "CLOSED").select(*REPORT_COLUMNS)
    return report


def handover_notes(
    notes: DataFrame, shift: Shift, as_of: str, shift_date: str | None = None, zone: str = "UTC"
) -> DataFrame:
    """Notes of a shift on a date (``yyyyMMdd``), by default the start of the current shift."""
    if shift_date:
        day = F.lit(shift_date)
    else:
        day = F.date_format(shift_start_date(moment(as_of), F.lit(shift.day_offset), zone), "yyyyMMdd")
    return notes.filter((F.col("shift") == shift.name) & (F.col("shift_date") == day)).select(*NOTE_COLUMNS)


def escaped(text: Column) -> Column:
    """Text that is safe inside an HTML element or attribute."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def _issue_card(names: list[str]) -> Column:
    """A definition list of an issue's known fields, its run linked from the heading."""
    fields = [
        F.when(F.col(n).isNotNull(), F.concat(F.lit(f"<dt>{n.replace('_', ' ')}</dt><dd>"), escaped(F.col(n)), F.lit("</dd>"))) for n in names
    ]
    link = F.coalesce(F.concat(F.lit('<a href="'), escaped(F.col("run_hist_url")), F.lit('">run</a>')), F.lit("run"))
    return F.concat(F.lit("<section><h3>"), link, F.lit("</h3><dl>"), F.concat_ws("", *fields), F.lit("</dl></section>"))


def handover_html(
    runs: DataFrame,
    assignment: DataFrame,
    notes: DataFrame,
    shift: Shift,
    as_of: str,
    sender: str,
    zone: str = "UTC",
) -> DataFrame:
    """The handover message as ordered HTML pieces: subject, head, one card per pending issue, end.

    ``section`` 0 is the subject line, 1 the head, 2 an issue and 3 the end; issues are
    ordered by run and job.  Pieces stay separate so a report of any length is written in
    parallel.  Delivery is left to the caller.
    """
    rows = report_rows(runs, assignment, shift_bounds(shift, as_of, zone)).filter(F.col("status") == "WIP")
    card = _issue_card([c for c in REPORT_COLUMNS if c != "run_hist_url"])
    issues = rows.select(F.lit(2).alias("section"), "parent_run_id", "job_name", card.alias("html"))
    day = shift_start_date(moment(as_of), F.lit(shift.day_offset), zone).cast("string")
    written = handover_notes(notes, shift, as_of, zone=zone)
    note = written.agg(F.coalesce(F.min("oncall_summary"), F.lit("nothing noted")).alias("note"))
    subject = F.concat(F.lit(f"{shift.name}, "), day, F.lit(": what is open"))
    head = F.concat(F.lit("<article><h1>"), escaped(subject), F.lit("</h1><p>"), escaped(F.col("note")), F.lit("</p><h2>Open issues</h2>"))
    tail = F.concat(F.lit("<p>"), escaped(F.lit(sender)), F.lit("</p></article>"))
    pieces = F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(None).cast("bigint").alias("parent_run_id"),
                 F.lit(None).cast("string").alias("job_name"), html.alias("html"))
        for section, html in ((0, subject), (1, head), (3, tail))
    ])
    frame = note.select(F.explode(pieces).alias("piece")).select("piece.*")
    return frame.unionByName(issues).orderBy("section", "parent_run_id", "job_name")

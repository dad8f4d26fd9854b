"""Changes to incident records, notes and handover notes.

Each function takes the current table and a batch of requests and returns the next version
of the table.  Write the result to a new path or table version, never over the path being
read.  Requests carry ``seq``, their position in the batch; later ones win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.labels import alert_flags
from runlens.operators.changes import explode_workflows, next_version, supplied, update, upsert
from runlens.plans.workflows import JOB_KEY
from runlens.sources.tables import append_rows


def _closed_status():
    return F.when(F.lower("action") == "close", F.lit("CLOSED"))


def close_issues(assignment: DataFrame, requests: DataFrame) -> DataFrame:
    """Upsert root cause, close code and user for every job of the request; close them if asked to.

    Requests: seq, workflows, root_cause, close_code, modified_by, action.
    """
    changes = explode_workflows(requests).select(
        "seq",
        *JOB_KEY,
        supplied("root_cause").alias("root_cause"),
        supplied("close_code").alias("close_code"),
        supplied("modified_by").alias("updated_user"),
        _closed_status().alias("status"),
    )
    return upsert(assignment, changes, JOB_KEY)


# Request fields and the record columns they set.
BULK_FIELDS = {
    "error": "error",
    "root_cause": "root_cause",
    "close_code": "close_code",
    "jira": "jira",
    "snow": "service_now",
    "zoom": "zoom_link",
}


def bulk_update(assignment: DataFrame, requests: DataFrame) -> DataFrame:
    """Update known records only; a request that sets nothing but the user is skipped.

    Requests: seq, workflows, error, notes, root_cause, close_code, jira, snow, zoom, modified_by, action.
    """
    values = {column: supplied(field) for field, column in BULK_FIELDS.items()}
    values["status"] = _closed_status()
    changes = explode_workflows(requests).filter(F.coalesce(*values.values()).isNotNull())
    changes = changes.select(
        "seq", *JOB_KEY, F.col("modified_by").alias("updated_user"), *[v.alias(c) for c, v in values.items()]
    )
    return update(assignment, changes, JOB_KEY)


def bulk_notes(requests: DataFrame) -> DataFrame:
    """Notes to append for the bulk requests that carry one."""
    noted = explode_workflows(requests.filter(supplied("notes").isNotNull()))
    return noted.select("seq", *JOB_KEY, "notes", F.col("modified_by").alias("updated_user"))


def add_bulk_notes(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """The notes table after the bulk requests; new notes have no key yet, the store gives it."""
    return append_rows(notes, bulk_notes(requests).drop("seq"))


def capture_errors(assignment: DataFrame, errors: DataFrame) -> DataFrame:
    """Upsert error texts. Changes: seq, parent_run_id, job_name, error, updated_user."""
    return upsert(assignment, errors.select("seq", *JOB_KEY, "error", "updated_user"), JOB_KEY)


def assign_tickets(assignment: DataFrame, requests: DataFrame) -> DataFrame:
    """Set ticket, incident and call link on all jobs of the given runs, replacing earlier ones.

    Requests: seq, parent_run_id, jira, service_now, zoom_link; empty text changes nothing.
    """
    columns = ["jira", "service_now", "zoom_link"]
    changes = requests.select("seq", "parent_run_id", *[supplied(c).alias(c) for c in columns])
    return update(assignment, changes, ["parent_run_id"])


def upsert_tickets(assignment: DataFrame, tickets: DataFrame) -> DataFrame:
    """Record a created ticket: a new record starts as WIP, a known one gets the key appended.

    Tickets: seq, parent_run_id, job_name, requestor, ticket_key, alert_type.  Several tickets
    for one record are appended in batch order.  The status, creator and creation time of a
    known record stay.
    """
    in_order = F.sort_array(F.collect_list(F.struct("seq", F.concat(F.lit(","), "ticket_key").alias("key"))))
    folded = tickets.dropna(subset=JOB_KEY).groupBy(*JOB_KEY).agg(
        F.lit("WIP").alias("status"),
        F.array_join(F.transform(in_order, lambda t: t["key"]), "").alias("jira"),
        F.min_by("requestor", "seq").alias("created_user"),
        F.max_by("requestor", "seq").alias("updated_user"),
        *[F.max_by(flag, "seq").alias(name) for name, flag in alert_flags(F.col("alert_type")).items()],
    )
    special = {
        "status": F.when(F.col("old.known"), F.col("old.status")).otherwise(F.col("new.status")),
        "created_user": F.when(F.col("old.known"), F.col("old.created_user")).otherwise(F.col("new.created_user")),
        "jira": F.when(
            F.col("new.jira").isNotNull(), F.concat(F.coalesce("old.jira", F.lit("")), "new.jira")
        ).otherwise(F.col("old.jira")),
    }
    return next_version(assignment, folded, JOB_KEY, "full_outer", special)


def edit_notes(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Upsert notes by their key. Edits: seq, notes_skey, notes, updated_user."""
    return upsert(notes, edits.select("seq", "notes_skey", "notes", "updated_user"), ["notes_skey"])


HANDOVER_KEY = ["team", "shift", "shift_date"]


def set_handover_notes(handover: DataFrame, entries: DataFrame) -> DataFrame:
    """Upsert handover notes; an entry with an empty field is ignored.

    Entries: seq, team, shift, shift_date, user, oncall_summary, updated_user.
    """
    required = [*HANDOVER_KEY, "user", "oncall_summary", "updated_user"]
    complete = entries.filter(" AND ".join(f"`{c}` <> ''" for c in required))
    changes = complete.select("seq", *HANDOVER_KEY, "oncall_summary", F.col("user").alias("created_user"), "updated_user")
    return upsert(handover, changes, HANDOVER_KEY)

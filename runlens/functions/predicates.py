"""Row predicates.

Text comparisons against free names ignore case, as the source databases do; status and
flag values are compared as stored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The e-commerce scope, the end states and the accepted job-name prefixes.
COMMERCE_WORKFLOW = "(?i).GEC|CEXP"
COMMERCE_WORD = "ECOMM"
FINISHED_STATES = ("SUCCESS", "CANCELLED", "ENDED_INACTIVE - Task has manually been set inactive.")
JOB_PREFIXES = ("JOBS", "jobs", "JB", "jb", "MDSE")


def commerce_scope() -> Column:
    """Runs of the e-commerce area: by workflow name, product or application."""
    return (
        F.col("parent_job_name").rlike(COMMERCE_WORKFLOW)
        | F.upper("product_name").contains(COMMERCE_WORD)
        | F.upper("application_name").contains(COMMERCE_WORD)
    )


def domain_scope(domains: list[str] | None) -> Column:
    """No filter for None or "All", the e-commerce scope for "Ecomm", else the listed domains."""
    if domains is None or "All" in domains:
        return F.lit(True)
    if "Ecomm" in domains:
        return commerce_scope()
    return F.col("domain_name").isin(list(domains))


def matches_all(conditions: dict[str, object]) -> Column:
    """Equality on every given column."""
    return reduce(and_, [F.col(name) == value for name, value in conditions.items()], F.lit(True))


def unfinished(status: str) -> Column:
    """Status outside the end states; NULL is dropped."""
    return ~F.col(status).isin(*FINISHED_STATES)


def unfinished_or_missing(status: str) -> Column:
    """As ``unfinished``, but keeps NULL, so rows without a job survive."""
    return unfinished(status) | F.col(status).isNull()


def any_alert() -> Column:
    return (
        (F.col("ert_exceeded_jobs") > 0)
        | (F.col("failed_jobs") > 0)
        | (F.col("bsns_sla_status") == "Missed")
    )


def flagged_job() -> Column:
    """The job ran late or failed."""
    return (F.col("ert_exceeded_ind") == "Y") | (F.col("job_fail_ind") == "Y")


def not_closed(status: str) -> Column:
    return F.coalesce(F.col(status), F.lit("OPEN")) != "CLOSED"


def within_open_interval(column: str, low: float, high: float) -> Column:
    return (F.col(column) > low) & (F.col(column) < high)


def within_closed_interval(column: str, start: Column, end: Column) -> Column:
    return F.col(column).between(start, end)


def name_not_like(column: str, pattern: str) -> Column:
    return ~F.col(column).rlike(pattern)


def accepted_job_name(column: str) -> Column:
    """The raw name starts with an accepted prefix; mixed case such as ``Jobs`` does not."""
    name = F.col(column)
    return reduce(lambda left, right: left | right, [name.startswith(p) for p in JOB_PREFIXES])

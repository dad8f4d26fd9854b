"""Job-log analysis for all runs at once.

A log is a table (run_id, line_no, line); line numbers are unique within a run.  Scans are
filters over the lines; per-run results are combined in the map tasks or computed in slices
of a run, so one run may hold a large share of all lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.functions.clock import duration_text
from runlens.functions.labels import last_name_part, runtime_advice
from runlens.operators.latest import keep_latest
from runlens.operators.matching import Pattern, Suggestion, match_keys, match_patterns
from runlens.operators.spread import first_seen, join_groups, number_rows, previous_value
from runlens.sources.tables import packed, sized

PROJECT_SLOT = "$$$gcp"
CLUSTER_SLOT = "$$$CN"
LINES_PER_PART = 10_000


def latest_run_header(headers: DataFrame, job_name: str | None = None) -> DataFrame:
    """Latest run of one job name (or of each) with its service id, the last part of its login."""
    chosen = headers if job_name is None else headers.filter(F.col("job_name") == job_name)
    latest = keep_latest(chosen, ["job_name"], [F.desc("last_modified"), F.desc("run_id")])
    return latest.withColumn("service_id", last_name_part("login"))


def numbered_lines(raw: DataFrame) -> DataFrame:
    """(path, line_no, line) from the lines of raw files, numbered from 1 within each file.

    A file of any size is numbered in parts, not in one task.
    """
    numbered = number_rows(raw, ["path"], [F.asc("block"), F.asc("place")], "line_no")
    return numbered.select("path", "line_no", "line")


def job_log_text(log: DataFrame, lines_per_part: int = LINES_PER_PART, separator: str = "") -> DataFrame:
    """Log text per run, in numbered parts of a bounded line range; the parts in order are the whole text.

    Log chunks normally carry their own line ends; give a ``separator`` where they do not.
    """
    parts = log.withColumn("part_no", F.floor(F.col("line_no") / lines_per_part))
    lines = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(lines, lambda entry: entry["line"]), separator)
    return parts.groupBy("run_id", "part_no").agg(text.alias("text"))


def dq_rule_failures(log: DataFrame) -> DataFrame:
    return log.filter(F.col("line").rlike(T.RULES_FAILED))


def error_lines(log: DataFrame) -> DataFrame:
    return log.filter(F.col("line").rlike(T.ERROR))


def file_not_available(log: DataFrame) -> DataFrame:
    return log.filter(F.col("line").rlike(T.NOT_AVAILABLE))


def diagnostics(log: DataFrame) -> DataFrame:
    """Text from "diagnostics" to the end of the line, without the two harmless messages."""
    found = log.withColumn("diagnostic", F.explode(F.regexp_extract_all("line", F.lit(T.DIAGNOSTICS), F.lit(0))))
    return found.filter(~F.col("diagnostic").isin(*T.HARMLESS_DIAGNOSTICS))


def tracking_lines(log: DataFrame) -> DataFrame:
    """Tracking URL texts in line order."""
    urls = F.regexp_extract_all("line", F.lit(T.TRACKING_URL), F.lit(0))
    return log.select("run_id", "line_no", F.explode(urls).alias("url"))


def _named(urls: DataFrame) -> DataFrame:
    return urls.withColumn("cluster", T.cluster_of(F.col("url"))).withColumn("project", T.project_of(F.col("url")))


def _url_ends(log: DataFrame, banner: str) -> DataFrame:
    """Per run, from one pass: whether it is managed (its log has the banner), and its first and last tracking URL."""
    url = F.regexp_extract("line", T.TRACKING_URL, 0)
    place = F.when(url != "", F.struct(F.col("line_no"), url.alias("url")))
    noted = log.filter(F.col("line").rlike(T.TRACKING_URL) | F.col("line").contains(banner))
    managed = F.bool_or(F.col("line").contains(banner)).alias("managed")
    return noted.groupBy("run_id").agg(managed, F.min(place).alias("first"), F.max(place).alias("last"))


def managed_cluster(log: DataFrame, banner: str, url: str = "first") -> DataFrame:
    """Cluster and project of each managed run, from its first or last tracking URL.

    ``banner`` is the text by which the log of a managed run is known.
    """
    managed = _url_ends(log, banner).filter(F.col("managed") & F.col(url).isNotNull())
    return _named(managed.select("run_id", f"{url}.*"))


def cluster_details(log: DataFrame, project_marker: str, banner: str) -> DataFrame:
    """Cluster and project per run: the first URL of managed runs, every marked URL of the others."""
    runs = _url_ends(log, banner).select("run_id", "managed", F.col("first.line_no").alias("_first"))
    met = join_groups(tracking_lines(log), runs, ["run_id"])
    marked = F.col("url").contains(T.HOST_MARK + project_marker)
    wanted = F.when(F.col("managed"), F.col("line_no") == F.col("_first")).otherwise(marked)
    return _named(met.filter(wanted).select("run_id", "line_no", "url"))


def changed_lines(lines: DataFrame, text: str = "url") -> DataFrame:
    """Lines that differ from the line before them in the same run."""
    before = previous_value(lines, ["run_id"], "line_no", text, "_before")
    return before.filter(~F.col(text).eqNullSafe(F.col("_before"))).drop("_before")


def typed_matches(log: DataFrame, patterns: Sequence[Pattern] | DataFrame) -> DataFrame:
    """Pattern matches except those that mention WARN or INFO."""
    return match_patterns(log, patterns).filter(~F.col("hit").contains("WARN") & ~F.col("hit").contains("INFO"))


def distinct_errors(log: DataFrame, patterns: Sequence[Pattern] | DataFrame) -> DataFrame:
    """Distinct error texts per run with the place first seen, by pattern and then line."""
    matches = typed_matches(log.filter(F.col("run_id").isNotNull()), patterns)
    found = first_seen(matches, ["run_id", "hit"], ["pattern_no", "line_no"], "first")
    return found.select(
        "run_id",
        F.col("hit").alias("error_text"),
        F.col("first.pattern_no").alias("pattern_no"),
        F.col("first.line_no").alias("line_no"),
    )


def typed_errors(log: DataFrame, patterns: Sequence[Pattern] | DataFrame) -> DataFrame:
    """Distinct errors with ``match_count``, their number per run: the reports show the list only when it is above one.

    The errors are written to the shared work folder while this is called, so the matching runs once and they are not shuffled again
    unless the runs are too many to send to all tasks.
    """
    errors = packed(distinct_errors(log, patterns), "errors")
    sizes = packed(errors.groupBy("run_id").agg(F.count("line_no").alias("match_count")), "errors-per-run")
    return join_groups(errors, sized(sizes), ["run_id"])


def suggestions(errors: DataFrame, table: Sequence[Suggestion] | DataFrame, text: str = "error_text") -> DataFrame:
    """Distinct suggestions per run; ``suggestion_no`` is the first table entry that gave the text."""
    matches = match_keys(errors, table, text)
    return matches.groupBy("run_id", "suggestion").agg(F.min("suggestion_no").alias("suggestion_no"))


def suggestion_fill(suggested: DataFrame, log: DataFrame, banner: str) -> DataFrame:
    """Suggestions with a project slot, filled in for managed runs from their last tracking URL."""
    slots = suggested.filter(F.col("suggestion").contains(PROJECT_SLOT))
    filled = slots.join(managed_cluster(log, banner, "last").select("run_id", "cluster", "project"), ["run_id"])
    text = F.replace(F.replace("suggestion", F.lit(PROJECT_SLOT), F.col("project")), F.lit(CLUSTER_SLOT), F.col("cluster"))
    return filled.withColumn("suggestion", text)


def generic_suggestions(suggested: DataFrame) -> DataFrame:
    return suggested.filter(~F.col("suggestion").contains(PROJECT_SLOT))


def edge_addresses(
    headers: DataFrame, nodes: DataFrame, shared_prefix: str | None = None, shared_address: str | None = None
) -> DataFrame:
    """Address of each run's edge node; nodes with the shared prefix all use one given address.

    ``nodes`` has one address per name.
    """
    found = headers.join(nodes.withColumnRenamed("node", "edge_node"), ["edge_node"], "left")
    if shared_prefix is None:
        return found
    shared = F.col("edge_node").startswith(shared_prefix)
    return found.withColumn("address", F.when(shared, shared_address).otherwise(F.col("address")))


def run_status_card(
    headers: DataFrame,
    log: DataFrame,
    nodes: DataFrame,
    shared_prefix: str | None = None,
    shared_address: str | None = None,
) -> DataFrame:
    """Status card of the latest run of every job whose log is not empty."""
    logged = log.select("run_id").distinct()
    latest = latest_run_header(headers).join(logged, ["run_id"], "left_semi")
    located = edge_addresses(latest, nodes, shared_prefix, shared_address)
    return located.select(
        "job_name", "run_id", "status", duration_text(F.col("runtime")).alias("runtime_text"),
        duration_text(F.col("ert")).alias("ert_text"), "last_modified", "service_id", "edge_node", "address",
        runtime_advice("status", "runtime", "ert").alias("advice"),
    )


def first_match(log: DataFrame, test: Column) -> DataFrame:
    """First line of each run that passes the test."""
    first = log.filter(test).groupBy("run_id").agg(F.min(F.struct("line_no", "line")).alias("first"))
    return first.select("run_id", "first.*")


# An application id, and how far into a file its job line may stand.
APPLICATION_ID = r"application_\d+_\d+"
JOB_LINE_LIMIT = 10


def runs_of_applications(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Run id of each requested application: third word of the job line of the first file that mentions it.

    Every word of a request line is an id; lines with ``#`` are comments.  Files are ordered by
    path.  Ids are compared as whole ids.  An application without a file has NULL in ``path``
    and ``run_id``.
    """
    words = F.explode(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))).alias("app_id")
    wanted = requests.filter(~F.col("line").contains("#")).select(words).distinct()
    mentions = files.select("path", F.explode(F.regexp_extract_all("line", F.lit(APPLICATION_ID), F.lit(0))).alias("app_id"))
    asked = join_groups(mentions, wanted, ["app_id"], "left_semi")
    first_file = asked.groupBy("app_id").agg(F.min("path").alias("path"))
    job_lines = files.filter((F.col("line_no") <= JOB_LINE_LIMIT) & F.col("line").contains("JOB"))
    job_line = job_lines.groupBy("path").agg(F.min(F.struct("line_no", "line")).alias("first"))
    run_ids = job_line.select("path", T.part(F.col("first.line"), r"\s+", 3).alias("run_id"))
    return join_groups(wanted.join(first_file, ["app_id"], "left"), run_ids, ["path"], "left")


def files_mentioning(listing: DataFrame, content: DataFrame, text: str, recent: Column) -> DataFrame:
    """Recent files that contain a text."""
    mentioning = content.filter(F.col("text").contains(text)).select("path")
    return listing.filter(recent).join(mentioning, ["path"], "left_semi")

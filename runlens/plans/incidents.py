"""Incident records: search, history and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.changes import fold_changes, upsert
from runlens.operators.latest import keep_latest
from runlens.operators.literals import folded, required_texts
from runlens.operators.postings import grams
from runlens.operators.spread import PAGE_SIZE, left_join_spread, nest_rows, number_rows
from runlens.plans.workflows import JOB_KEY
from runlens.sources import bucketed
from runlens.sources.tables import write_append

JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}

# The incident columns of the two history results.
SEARCH_COLUMNS = """
    error jira service_now zoom_link root_cause close_code status ert_alert failure_alert slamiss_alert
    created_dt updated_dt
""".split()
HISTORY_COLUMNS = """
    status zoom_link root_cause error close_code ert_alert slamiss_alert failure_alert service_now jira
    created_dt updated_dt
""".split()


def _notes_as(prefix: str, notes: DataFrame) -> DataFrame:
    names = ["notes", "notes_skey", "updated_dt", "updated_user"]
    return notes.select(*JOB_KEY, *[F.col(n).alias(f"{prefix}{n}") for n in names])


def with_notes(records: DataFrame, notes: DataFrame) -> DataFrame:
    """Incident records LEFT JOIN their notes; note columns are prefixed ``n_``."""
    return left_join_spread(records, _notes_as("n_", notes), JOB_KEY)


def _note_item() -> list[Column]:
    return [F.col("n_notes_skey"), F.col("n_notes"), F.col("n_updated_dt"), F.col("n_updated_user")]


def _notes_text(notes: str) -> Column:
    """JSON array of note objects; keys with NULL are kept."""
    named = F.transform(
        notes,
        lambda n: F.struct(
            n["n_notes"].alias("NOTE"),
            n["n_notes_skey"].alias("NOTES_SKEY"),
            n["n_updated_dt"].alias("UPDATED_DT"),
            n["n_updated_user"].alias("UPDATED_USER"),
        ),
    )
    return F.to_json(named, JSON_OPTIONS)


def notes_json(
    noted: DataFrame, keys: list[str], header: list[str], first_by: list[Column], page_size: int = PAGE_SIZE
) -> DataFrame:
    """Notes per key as a JSON array in note order, with the header columns of the key's first row.

    An incident without notes contributes one object of NULLs.  Keys with very many notes
    are cut into pages; see ``nest_rows``.
    """
    nested = nest_rows(noted, keys, [F.col(c) for c in header], _note_item(), "notes", page_size, first_by)
    return nested.withColumn("notes", _notes_text("notes"))


def error_log_search(
    assignment: DataFrame, notes: DataFrame, pattern: str, page_size: int = PAGE_SIZE
) -> DataFrame:
    """Past incidents whose error matches a regular expression, one row per job name, newest first.

    The columns shown are those of the job's newest incident (highest run id among equals).
    """
    found = assignment.filter(F.col("error").rlike(f"(?i){pattern}"))
    noted = with_notes(found, notes)
    age = F.timestamp_diff("MICROSECOND", F.col("created_dt"), F.lit("9999-01-01").cast("timestamp_ntz"))
    newest = [F.coalesce(age, F.lit(2**63 - 1)), F.negative("parent_run_id")]
    rows = notes_json(noted, ["job_name"], SEARCH_COLUMNS, newest, page_size)
    return rows.orderBy(F.desc("created_dt"), "job_name", "page")


# Search with an index: incidents in buckets by key, and beside them the keys of the incidents that hold each trigram.

TRIGRAM = 3


def _postings(assignment: DataFrame) -> DataFrame:
    held = F.array_distinct(grams(folded(F.col("error")), TRIGRAM))
    return assignment.filter(F.col("error").isNotNull()).select(F.explode(held).alias("gram"), *JOB_KEY)


def store_searchable(assignment: DataFrame, path: str, buckets: int) -> None:
    """Store incidents with an index of the trigrams of their errors."""
    spark = assignment.sparkSession
    bucketed.write_bucketed(assignment, f"{path}/records", JOB_KEY, buckets)
    bucketed.write_bucketed(_postings(bucketed.read_bucketed(spark, f"{path}/records")), f"{path}/postings", ["gram"], buckets)
    _add_counts(bucketed.read_bucketed(spark, f"{path}/postings"), path)


def _add_counts(postings: DataFrame, path: str) -> None:
    write_append(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), f"{path}/counts")


def upsert_searchable(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """``upsert`` changes into stored incidents and add their trigrams.

    Trigrams of replaced errors stay in the index: a search tests what it finds, so they cost a look only.
    """
    keys = fold_changes(changes, JOB_KEY).select(*JOB_KEY)
    staged = bucketed.stage_touched(spark, f"{path}/records", JOB_KEY, keys, lambda records: upsert(records, changes, JOB_KEY))
    # The index first: a search between the two steps finds too much, never too little.
    added = _postings(staged.records.join(keys, JOB_KEY, "left_semi"))
    folder = next(c for c in spark.read.parquet(f"{path}/postings").columns if c.startswith("bucket_of_"))
    number = bucketed.bucket_number(["gram"], int(folder.removeprefix("bucket_of_")))
    write_append(added.withColumn(folder, number).hint("rebalance", folder), f"{path}/postings", [folder])
    _add_counts(added, path)
    bucketed.replace_buckets(staged)


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Stored incidents that may match a regular expression whatever its case; all where the index cannot tell.

    Each alternative of the expression is looked up by the rarest trigram of the texts it requires.  Only the
    buckets of these trigrams and of the incidents they lead to are read.
    """
    alternatives = spark.range(1).select(required_texts(F.lit(f"(?i){pattern}"))).first()[0]
    wanted = [{t[i : i + TRIGRAM] for t in texts for i in range(len(t) - TRIGRAM + 1)} for texts in alternatives]
    if not all(wanted):
        return bucketed.read_bucketed(spark, f"{path}/records")
    counts = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(sorted(set().union(*wanted))))
    known = {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    # A trigram that no incident holds rules its alternative out.
    chosen = sorted({min(held, key=lambda g: (known[g], g)) for held in wanted if all(g in known for g in held)})
    sought = spark.createDataFrame([(g,) for g in chosen], "gram string")
    lists = bucketed.read_touched(spark, f"{path}/postings", bucketed.touched_buckets(spark, f"{path}/postings", sought, ["gram"]))
    keys = lists.filter(F.col("gram").isin(chosen)).select(*JOB_KEY).distinct()
    records = bucketed.read_touched(spark, f"{path}/records", bucketed.touched_buckets(spark, f"{path}/records", keys, JOB_KEY))
    # As structs, so that keys with NULLs meet, too.
    met = keys.select(F.struct(*JOB_KEY).alias("_key"))
    return records.withColumn("_key", F.struct(*JOB_KEY)).join(met, "_key", "left_semi").drop("_key")


def error_log_search_indexed(
    spark: SparkSession, path: str, notes: DataFrame, pattern: str, page_size: int = PAGE_SIZE
) -> DataFrame:
    """``error_log_search`` over stored incidents, reading the index first."""
    return error_log_search(candidates(spark, path, pattern), notes, pattern, page_size)


def latest_mapping_per_job(mapping: DataFrame) -> DataFrame:
    """The newest assignee entry of each job name, over all runs."""
    order = [F.desc("assignment_mapping_skey"), F.desc("assigned_user"), F.desc("user_role")]
    return keep_latest(mapping, ["job_name"], order)


def assigned_history(runs: DataFrame, assignment: DataFrame, mapping: DataFrame) -> DataFrame:
    """Incidents that carry the newest assignee entry of their job name, with their run."""
    latest = latest_mapping_per_job(mapping).select(*JOB_KEY, "assigned_user")
    history = runs.select("parent_run_id", "parent_job_name", "return_code_text")
    return latest.join(assignment.select(*JOB_KEY, *HISTORY_COLUMNS), JOB_KEY).join(history, ["parent_run_id"])


def workflow_issue_history(
    runs: DataFrame,
    assignment: DataFrame,
    mapping: DataFrame,
    notes: DataFrame,
    workflow: str | None = None,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Assigned incidents of one workflow (or of all) with their notes."""
    chosen = runs if workflow is None else runs.filter(F.col("parent_job_name") == workflow)
    noted = with_notes(assigned_history(chosen, assignment, mapping), notes)
    keys = ["parent_run_id", "parent_job_name", "job_name"]
    header = ["return_code_text", *HISTORY_COLUMNS, "assigned_user"]
    return notes_json(noted, keys, header, _note_item(), page_size).distinct()


def issue_number(assignment: DataFrame) -> DataFrame:
    """Incidents numbered per job name, newest first (higher run id first among equals).

    Numbered inside ordered parts, so a job name with very many incidents is shared out.
    """
    return number_rows(
        assignment,
        ["job_name"],
        [F.desc("created_dt"), F.desc("parent_run_id")],
        "issue_number",
    )


def numbered_issue_history(runs: DataFrame, assignment: DataFrame, workflow: str | None = None) -> DataFrame:
    """Numbered incidents joined to the runs of one workflow (or of all)."""
    chosen = runs if workflow is None else runs.filter(F.col("parent_job_name") == workflow)
    history = chosen.select("parent_run_id", "parent_job_name", "return_code_text", "domain_name")
    return issue_number(assignment).join(history, ["parent_run_id"])


def user_notes(notes: DataFrame, parent_run_id: int, job_name: str) -> DataFrame:
    """Notes of one (run, job), newest first."""
    own = notes.filter((F.col("parent_run_id") == parent_run_id) & (F.col("job_name") == job_name))
    return own.select(
        "notes_skey", *JOB_KEY, "notes", "updated_user", "updated_dt"
    ).orderBy(F.desc("notes_skey"))

"""Dashboard counters of runs by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.labels import run_state
from runlens.functions.predicates import commerce_scope
from runlens.operators.changes import upsert
from runlens.sources import bucketed, commits

# The states a counter result always lists, and the label of the e-commerce area.
COUNTED_STATES = ("SUCCESS", "SLA_MISS", "RUNNING", "FAILED", "ERT", "CANCELLED")
COMMERCE_LABEL = "EComm"


def _states() -> Column:
    """The states one run counts under: its derived state, and RUNNING as well while it runs."""
    running = F.when(F.col("return_code_text") == "RUNNING", F.lit("RUNNING"))
    return F.array_compact(F.array(run_state(), running))


def status_counts(runs: DataFrame) -> DataFrame:
    """Runs by domain and state in one pass; a late run that still runs counts under both states."""
    states = runs.select("domain_name", F.explode(_states()).alias("rstatus"))
    return states.groupBy("domain_name", "rstatus").agg(F.count(F.lit(1)).alias("total_count"))


def ecomm_status_counts(runs: DataFrame) -> DataFrame:
    """Runs of the e-commerce area by state under one label; RUNNING is listed even when none runs."""
    states = runs.filter(commerce_scope()).select(F.explode(_states()).alias("rstatus"))
    counts = states.groupBy("rstatus").agg(F.count(F.lit(1)).alias("total_count"))
    return _with_zeros(counts, ("RUNNING",)).select(F.lit(COMMERCE_LABEL).alias("domain_name"), "rstatus", "total_count")


def _with_zeros(counts: DataFrame, states: tuple[str, ...]) -> DataFrame:
    names = F.array(*[F.lit(s) for s in states])
    zeros = counts.sparkSession.range(1).select(
        F.explode(names).alias("rstatus"), F.lit(0).cast("bigint").alias("total_count")
    )
    return counts.unionByName(zeros).groupBy("rstatus").agg(F.sum("total_count").alias("total_count"))


def status_counts_scoped(runs: DataFrame, domains: list[str]) -> DataFrame:
    """Runs by state over the chosen domains; the six usual states are always listed.

    "Ecomm" anywhere selects the e-commerce area; "all" selects everything only as the first entry.
    """
    if "Ecomm" in domains:
        counts = ecomm_status_counts(runs)
    else:
        counts = status_counts(runs)
        if domains[0] not in ("all", "All", "ALL"):
            counts = counts.filter(F.col("domain_name").isin(*domains))
    return _with_zeros(counts.select("rstatus", "total_count"), COUNTED_STATES)


def distinct_domains(runs: DataFrame) -> DataFrame:
    return runs.select("domain_name").distinct()


def distinct_close_codes(close_codes: DataFrame) -> DataFrame:
    return close_codes.select("category_text").distinct()


# Counts kept up to date: a table of runs in buckets, and beside it one small batch of signed counts per change.

RUN_KEY = ["parent_run_id"]


def _signed_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changes in ``status_counts`` when the old rows give way to the new ones: old states retracted, new ones added."""

    def counted(runs: DataFrame, sign: int) -> DataFrame:
        return status_counts(runs).withColumn("total_count", F.col("total_count") * sign)

    both = counted(old, -1).unionByName(counted(new, 1))
    return both.groupBy("domain_name", "rstatus").agg(F.sum("total_count").alias("total_count")).filter("total_count <> 0")


def start_maintained_counts(runs: DataFrame, path: str, buckets: int) -> None:
    """Store a table of runs and its counts by domain and state."""
    bucketed.write_bucketed(runs, f"{path}/runs", RUN_KEY, buckets)
    stored = bucketed.read_bucketed(runs.sparkSession, f"{path}/runs")
    commits.append_once(status_counts(stored), f"{path}/counts", "start")


def change_maintained_counts(spark: SparkSession, path: str, changes: DataFrame, batch: str) -> None:
    """Apply a batch of run changes (see ``operators.changes``) to the stored runs and their counts.

    Only the buckets of the changed runs are read.  A batch given again, whole or after a failure at any point,
    counts once: its signed counts are made before the runs change, and entered in the ledger after.
    """
    counts = f"{path}/counts"
    if commits.is_committed(spark, counts, batch):
        return
    keys = changes.select(*RUN_KEY).filter(" AND ".join(f"{k} IS NOT NULL" for k in RUN_KEY)).distinct()
    staged = bucketed.stage_touched(spark, f"{path}/runs", RUN_KEY, keys, lambda runs: upsert(runs, changes, RUN_KEY))
    if not commits.is_written(spark, counts, batch):
        old = bucketed.read_touched(spark, f"{path}/runs", staged.touched)
        commits.write_batch(_signed_counts(old, staged.records), counts, batch)
    bucketed.replace_buckets(staged)
    commits.commit_batch(spark, counts, batch)


def maintained_counts(spark: SparkSession, path: str) -> DataFrame:
    """``status_counts`` of the stored runs, added up from their signed counts."""
    found = commits.read_once(spark, f"{path}/counts")
    return found.groupBy("domain_name", "rstatus").agg(F.sum("total_count").alias("total_count")).filter("total_count <> 0")

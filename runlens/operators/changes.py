"""Next version of a record table from a batch of changes.

A change row carries the key, a position ``seq`` in the batch, and values for the columns it
wants to set; NULL means "not supplied".  Later changes win column by column, like applying
the rows one after the other.  Record keys are unique, so nothing here groups more than the
changes of one record, and those are combined in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the last supplied value of every column."""
    values = [c for c in changes.columns if c not in keys and c != "seq"]
    present = changes.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_changes"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in values],
    )


def next_version(
    records: DataFrame, folded: DataFrame, keys: list[str], how: str, special: dict[str, Column] | None
) -> DataFrame:
    """Join records with folded changes; ``special`` gives a column's value from ``old``/``new`` instead of "new, else old".

    ``old.known`` is true for a record that existed before.
    """
    old, new, on = records.withColumn("known", F.lit(True)), folded, keys
    if how == "left":
        # Many records may share a key here; see ``join_groups`` for why it is packed.
        old, new, on = old.withColumn("_key", F.struct(*keys)), new.withColumn("_key", F.struct(*keys)).drop(*keys), ["_key"]
    joined = old.alias("old").join(new.alias("new"), on, how)
    special = special or {}

    def value(column: str) -> Column:
        if column in keys:
            return F.col(column)
        if column in special:
            return special[column].alias(column)
        if column in folded.columns:
            return F.coalesce(F.col(f"new.{column}"), F.col(f"old.{column}")).alias(column)
        return F.col(f"old.{column}").alias(column)

    return joined.select(*[value(c) for c in records.columns])


def upsert(
    records: DataFrame, changes: DataFrame, keys: list[str], special: dict[str, Column] | None = None
) -> DataFrame:
    """Insert unknown keys, update the supplied columns of known ones."""
    return next_version(records, fold_changes(changes, keys), keys, "full_outer", special)


def update(
    records: DataFrame, changes: DataFrame, keys: list[str], special: dict[str, Column] | None = None
) -> DataFrame:
    """Update the supplied columns of known keys; unknown keys are ignored."""
    return next_version(records, fold_changes(changes, keys), keys, "left", special)


def explode_workflows(requests: DataFrame) -> DataFrame:
    """Flatten ``workflows: array<struct<parent_run_id, jobname: array>>`` to one row per run and job."""
    flat = requests.withColumn("_workflow", F.explode("workflows")).drop("workflows")
    return (
        flat.withColumn("job_name", F.explode("_workflow.jobname"))
        .withColumn("parent_run_id", F.col("_workflow.parent_run_id"))
        .drop("_workflow")
    )


def supplied(column: str) -> Column:
    """Empty text counts as not supplied."""
    return F.when(F.col(column) != "", F.col(column))

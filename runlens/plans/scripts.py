"""Job scripts: commands, variables and substitution for all jobs at once.

Script lines are (job_id, line_no, line) with (job_id, line_no) unique; variables are
(job_id, key, value) with (job_id, key) unique.  Values travel to the lines by an equi join
on (job, name), so neither a job with very many lines nor one with very many variables is
gathered in one place: a group never holds more than the names used on one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.operators.names import replace_names
from runlens.operators.spread import join_groups, left_join_spread

SKIPPED_ASSIGNMENT = "SA_AUTH_FILE"
USER_SLOT = "$USER"


def script_lines(scripts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Script lines of the given jobs by name; a missing line is an empty one."""
    named = scripts.join(jobs.select("job_id", "job_name").distinct(), ["job_id"])
    return named.select("job_id", "job_name", "line_no", F.coalesce("line", F.lit("\n")).alias("line"))


def command_lines(lines: DataFrame) -> DataFrame:
    """One row per line and command class it contains; a line may be in several."""
    return lines.withColumn("command", F.explode(T.command_classes(F.col("line"))))


def command_prefixes(lines: DataFrame) -> DataFrame:
    """One row per line and command class it starts with."""
    return lines.withColumn("command", F.explode(T.command_start_classes(F.col("line"))))


def variables_first_wins(raw: DataFrame) -> DataFrame:
    """``key|value`` and ``key:value`` lines; the first value of a key stays.

    A line with both separators gives two variables, the bar first.  ``raw`` is (job_id, seq, raw).
    """
    text = F.col("raw")
    pairs = [
        F.when(
            text.contains(separator),
            F.struct(
                F.lit(rank).alias("rank"), T.part(text, pattern, 1).alias("key"), T.part(text, pattern, 2).alias("value")
            ),
        )
        for rank, (separator, pattern) in enumerate((("|", r"\|"), (":", ":")))
    ]
    found = raw.withColumn("pair", F.explode(F.array_compact(F.array(*pairs)))).select("job_id", "seq", "pair.*")
    first = found.groupBy("job_id", "key").agg(F.min(F.struct("seq", "rank", "value")).alias("first"))
    return first.select("job_id", "key", F.col("first.value").alias("value"))


def script_assignments(lines: DataFrame, skipped: str = SKIPPED_ASSIGNMENT) -> DataFrame:
    """``name=value`` script lines without conditions and the authentication variable; quotes removed."""
    line = F.col("line")
    chosen = lines.filter(line.contains("=") & ~line.contains("if") & ~line.contains(skipped))
    plain = T.without_prefix(line, "export ")
    return chosen.select(
        "job_id", "line_no", T.part(plain, "=", 1).alias("key"), F.trim(T.part(plain, "=", 2), F.lit("'")).alias("value")
    )


def variables_last_wins(raw: DataFrame, lines: DataFrame, skipped: str = SKIPPED_ASSIGNMENT) -> DataFrame:
    """``&KEY|value`` messages, then script assignments; the last value of a key stays.

    An empty value is NA; a message without a bar is dropped.
    """
    text = F.col("raw")
    value = T.part(text, r"\|", 2)
    messages = raw.filter(text.startswith("&") & text.contains("|")).select(
        "job_id",
        T.part(text, r"\|", 1).alias("key"),
        F.lit(0).alias("rank"),
        "seq",
        F.when(value == "", "NA").otherwise(value).alias("value"),
    )
    assigned = script_assignments(lines, skipped).select(
        "job_id", "key", F.lit(1).alias("rank"), F.col("line_no").alias("seq"), "value"
    )
    last = messages.unionByName(assigned).groupBy("job_id", "key").agg(F.max(F.struct("rank", "seq", "value")).alias("last"))
    return last.select("job_id", "key", F.col("last.value").alias("value"))


def with_values(lines: DataFrame, variables: DataFrame, names: Column) -> DataFrame:
    """Lines with ``vals``, a map from the names used on the line to their values."""
    used = lines.withColumn("key", F.explode_outer(F.array_distinct(names)))
    valued = join_groups(used, variables.select("job_id", "key", "value"), ["job_id", "key"], "left")
    pair = F.when(F.col("value").isNotNull(), F.struct("key", "value"))
    return valued.groupBy(*lines.columns).agg(F.map_from_entries(F.collect_list(pair)).alias("vals"))


def substitute_regex(lines: DataFrame, variables: DataFrame) -> DataFrame:
    """Replace variable names wherever they stand in a line, in one pass from the left, longer names first."""
    return replace_names(lines, variables, "job_id", "line_no", "line", "replaced")


def substitute_tokens(lines: DataFrame, variables: DataFrame) -> DataFrame:
    """Replace the ``&`` words of a line; a line with an unknown word has no result."""
    line = F.col("line")
    valued = with_values(lines, variables, T.marked(T.words(line)))
    return valued.withColumn("replaced", T.replace_words(line, F.col("vals"))).drop("vals")


def substitute_source_path(lines: DataFrame, variables: DataFrame) -> DataFrame:
    """Source commands with the variables of their path filled in; unknown ones stay."""
    line = F.col("line")
    sources = command_prefixes(lines).filter("command = 'source'").drop("command")
    valued = with_values(sources, variables, T.segment_names(line))
    return valued.withColumn("replaced", T.replace_path(line, F.col("vals"))).drop("vals")


def shell_scripts_with_values(lines: DataFrame, variables: DataFrame) -> DataFrame:
    """Shell lines beside their substituted form; a job without shell lines has one NA row."""
    shell = command_lines(lines).filter("command = 'shell'").drop("command")
    replaced = substitute_regex(shell, variables).select("job_id", "line_no", "line", "replaced")
    listed = left_join_spread(lines.select("job_id").distinct(), replaced, ["job_id"])
    return listed.fillna("NA", ["line", "replaced"])


def script_path(lines: DataFrame, variables: DataFrame, headers: DataFrame) -> DataFrame:
    """Path of the script each job runs.

    The last ``sh`` line gives the script, the last ``cd`` line the directory; a script under
    ``/u`` or ``/edge_data`` is taken as it is.  NULL if a needed variable is unknown.  The
    user placeholder becomes the lower-case service id of the job's latest run
    (``headers``: job_id, service_id).
    """
    commands = command_prefixes(lines).filter(F.col("command").isin("sh", "cd"))
    text = substitute_tokens(commands, variables).withColumn("words", T.words(F.col("replaced")))
    word = (
        F.when(F.col("replaced").isNull(), F.lit(None))
        .when(F.col("command") == "sh", T.last_matching(F.col("words"), lambda w: w.endswith(".sh")))
        .otherwise(F.coalesce(F.try_element_at("words", F.lit(-1)), F.lit("")))
    )
    # The struct keeps a NULL result as "seen but unknown", apart from "no such line".
    last = text.withColumn("entry", F.struct("line_no", word.alias("word")))
    per_job = last.groupBy("job_id").agg(
        F.max(F.when(F.col("command") == "sh", F.col("entry"))).alias("sh"),
        F.max(F.when(F.col("command") == "cd", F.col("entry"))).alias("cd"),
    )
    script = F.when(F.col("sh").isNull(), "").otherwise(F.col("sh.word"))
    base = F.when(F.col("cd").isNull(), "").otherwise(F.col("cd.word"))
    joined = F.when(base.endswith("/") | script.startswith("/"), F.concat(base, script)).otherwise(
        F.concat(base, F.lit("/"), script)
    )
    path = (
        F.when(script.isNull() | base.isNull(), F.lit(None))
        .when(script.startswith("/u") | script.startswith("/edge_data"), script)
        .when((F.length(base) > 0) | (F.length(script) > 0), joined)
        .otherwise("")
    )
    found = per_job.select("job_id", path.alias("path")).join(headers.select("job_id", "service_id"), ["job_id"], "left")
    user = F.coalesce(F.lower("service_id"), F.lit(USER_SLOT))
    return found.select("job_id", F.replace("path", F.lit(USER_SLOT), user).alias("script_path"))

"""Tables of patterns, keys and names of any length against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from runlens.operators import names, postings
from runlens.operators.literals import required_texts
from runlens.operators.matching import Pattern, Suggestion, match_keys, match_patterns
from runlens.plans import logs

NO_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table_of(spark, patterns):
    rows = [(i, f"n{i}", p) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "pattern_no int, name string, pattern string")


def lines_of(spark, lines):
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "line_no int, line string").repartition(3)


def brute(lines, patterns):
    found = []
    for i, line in enumerate(lines):
        for j, pattern in enumerate(patterns):
            if line is not None and pattern is not None:
                found += [(i, j, m.group(0)) for m in re.finditer(pattern, line)]
    return sorted(found)


# What is understood, and what must not be taken for a required text.
REQUIRED = [
    ("error in step 7", [["error in step 7"]]),
    ("(?i)Error.*Done", [["error", "done"]]),
    ("abc?d", [["ab", "d"]]),
    ("ab+c", [["ab", "c"]]),
    ("ab*?c{2,3}d", [["a", "d"]]),
    (r"a\.b\d+\\c\(x\)", [["a.b", "\\c(x)"]]),
    ("[abc]def[^x]+g", [["def", "g"]]),
    ("(?:one) two (three|four)", [["one two "]]),
    ("(one)* two", [[" two"]]),
    ("x(?=yes)z", [["x", "z"]]),
    ("left|right side|", [["left"], ["right side"], []]),
    (r"\x41bcA\101z", [["bca", "z"]]),
    ("a{0}b", [["b"]]),
    (r"\Qa.b\E", [[]]),
    ("(?x) a b", [[]]),
    ("(?iu)kelvin", [[]]),
    (r"\d+", [[]]),
    ("a++b|c*+d", [["a", "b"], ["d"]]),
    ("((a|b)c)d", [["cd"]]),
    ("((ab)c)d", [["abcd"]]),
]


def test_required_texts(spark):
    df = spark.createDataFrame([(p,) for p, _ in REQUIRED], "p string").select("p", required_texts(F.col("p")).alias("r"))
    assert {r["p"]: r["r"] for r in df.collect()} == dict(REQUIRED)


def random_pattern(draw):
    """A random expression of literals, classes, groups, alternatives and counts."""

    def atom(depth):
        kind = draw.randrange(8)
        if kind < 4:
            return "".join(draw.choice("abcAB .") if draw.random() < 0.9 else r"\." for _ in range(draw.randint(1, 5)))
        if kind == 4:
            return draw.choice(["[ab]", "[^a]", r"\d", r"\w", "."])
        if kind == 5 and depth < 3:
            return f"({expression(depth + 1)})"
        if kind == 6 and depth < 3:
            return f"(?:{expression(depth + 1)}){draw.choice(['', '?', '*', '+', '{1,2}'])}"
        return draw.choice("abc") + draw.choice(["?", "*", "+", "{2}", "{0,2}", "*?", "+?"])

    def expression(depth):
        branches = ["".join(atom(depth) for _ in range(draw.randint(1, 3))) for _ in range(draw.choice([1, 1, 2, 3]))]
        return "|".join(branches)

    return draw.choice(["", "", "(?i)", "^"]) + expression(0)


def test_random_patterns_by_brute_force(spark, rows):
    draw = random.Random(11)
    patterns = [random_pattern(draw) for _ in range(250)]
    lines = ["".join(draw.choice("abcAB .1") for _ in range(draw.randint(0, 25))) for _ in range(60)]
    lines, table = lines_of(spark, lines), table_of(spark, patterns)
    # Engines differ in what they find next to an empty match, so every pair is tried by Spark's own.
    every = lines.crossJoin(table).withColumn("hit", F.explode(F.regexp_extract_all("line", F.col("pattern"), F.lit(0))))
    columns = ["line_no", "pattern_no", "hit"]
    assert rows(match_patterns(lines, table), *columns) == rows(every, *columns)


def test_pattern_rows_of_every_kind(spark, rows):
    """NULL lines and patterns, equal patterns, a pattern given twice, one without required text, one met by two alternatives."""
    patterns = ["gone|away", "gone|away", None, r"\d", "zz", "é+x"]
    lines = ["gone away", None, "", "away 7", "ééx zz", "gone away"]
    table = table_of(spark, patterns)
    found = match_patterns(lines_of(spark, lines), table.unionByName(table.filter("pattern_no = 4")))
    expected = sorted([*brute(lines, patterns), (4, 4, "zz")], key=lambda t: [(True, str(v)) for v in t])
    assert rows(found, "line_no", "pattern_no", "hit") == expected
    assert match_patterns(lines_of(spark, lines), table.filter("pattern_no < 0")).count() == 0
    assert match_patterns(lines_of(spark, lines).limit(0), table).count() == 0


def test_thousands_of_patterns_meet_few_lines(spark):
    """The plan pairs nothing, and the pairs tried follow the matches, not lines times patterns."""
    lines = lines_of(spark, [f"input part-{i} is not available at step {i % 7}" for i in range(400)])
    for count in (200, 20_000):
        table = spark.range(count).select(
            F.col("id").cast("int").alias("pattern_no"), F.lit("n").alias("name"), F.format_string("(?i)PART-%d is .*", "id").alias("pattern")
        )
        found = match_patterns(lines, table)
        assert not [word for word in NO_PAIRS if word in plan_of(found)]
        assert found.count() == min(count, 400)
        known = table.withColumnRenamed("pattern", "_pattern")
        assert postings.meet_entries(lines, "line", known, required_texts(F.col("_pattern"))).count() < 20 * 400


def test_keys_by_brute_force(spark, rows):
    draw = random.Random(5)
    keys = ["".join(draw.choice("abcé ") for _ in range(draw.randint(0, 7))) for _ in range(400)]
    lines = ["".join(draw.choice("abcé ") for _ in range(draw.randint(0, 40))) for _ in range(80)]
    entries = [Suggestion(i, k, f"s{i % 9}") for i, k in enumerate(keys)]
    table = spark.createDataFrame([tuple(e) for e in entries], "suggestion_no int, error_key string, suggestion string")
    found = match_keys(lines_of(spark, lines), table, "line")
    assert not [word for word in NO_PAIRS if word in plan_of(found)]
    expected = [(i, e.suggestion_no, e.suggestion) for i, line in enumerate(lines) for e in entries if e.error_key in line]
    assert rows(found, "line_no", "suggestion_no", "suggestion") == sorted(expected, key=lambda t: [(True, str(v)) for v in t])
    missing = spark.createDataFrame([(1, None, "x")], table.schema)
    assert match_keys(lines_of(spark, ["a", None]), missing, "line").count() == 0


def test_index_beyond_its_size_is_shuffled(spark, rows, monkeypatch):
    monkeypatch.setattr(postings, "sized", lambda df: df)
    lines, patterns = ["abcd efgh", "xabcdx", "efg"], ["abcd", "efgh", "ef."]
    found = match_patterns(lines_of(spark, lines), table_of(spark, patterns))
    assert rows(found, "line_no", "pattern_no", "hit") == sorted(brute(lines, patterns), key=lambda t: [(True, str(v)) for v in t])


def test_entries_that_no_row_can_match_are_left_out(spark, monkeypatch):
    """Of 20,000 patterns and keys, those with a gram that no line has reach neither the index nor a shuffle."""
    stored = {}
    keep = postings.written
    monkeypatch.setattr(postings, "written", lambda df, name: stored.setdefault(name, keep(df, name)))
    lines = lines_of(spark, [f"input part-{i} is not available" for i in range(10)])
    patterns = spark.range(20_000).selectExpr("cast(id as int) pattern_no", "'n' name", "concat('part-', id, ' is (not|now)|gone at ', id) pattern")
    assert match_patterns(lines, patterns).count() == 10
    assert stored["entry-index"].count() == 10
    stored.clear()
    keys = spark.range(20_000).selectExpr("cast(id as int) suggestion_no", "concat('part-', id, ' is') error_key", "'s' suggestion")
    assert match_keys(lines, keys, "line").count() == 10
    assert stored["entry-index"].count() == 10


@pytest.mark.parametrize("broadcast", [True, False])
def test_rows_are_shuffled_only_with_grams_of_the_index(spark, rows, monkeypatch, broadcast):
    """Rows carry no list of their grams, and only those with a gram of the index reach the join that may shuffle them."""
    if not broadcast:
        monkeypatch.setattr(postings, "sized", lambda df: df)
    lines = ["abcd efgh", "xabcdx", "efg", "gone away", "away", "", None, "abcd efgh"]
    patterns = ["abcd|efgh", "efgh|abcd", "ef.|gone|away", "abcd|efgh", r"\d|abcd|", "never seen|efg", "abcdefgh"]
    table = table_of(spark, patterns)
    found = match_patterns(lines_of(spark, lines), table.unionByName(table.filter("pattern_no = 2")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "_own" not in plan
    every = lines_of(spark, lines).crossJoin(table.unionByName(table.filter("pattern_no = 2")))
    every = every.withColumn("hit", F.explode(F.regexp_extract_all("line", F.col("pattern"), F.lit(0))))
    columns = ["line_no", "pattern_no", "name", "hit"]
    assert rows(found, *columns) == rows(every, *columns)


def test_typed_errors_of_a_long_table(spark, rows, monkeypatch):
    """The same errors as of the few patterns that match, given as a list; the index holds no others."""
    stored = {}
    keep = postings.written
    monkeypatch.setattr(postings, "written", lambda df, name: stored.setdefault(name, keep(df, name)))
    texts = ["Error in step 7", "WARN Error in step 7", None, "error in step 19", "part-3 is lost", "Error in step 7"]
    log = lines_of(spark, texts).withColumn("run_id", F.col("line_no") % 2)
    expected = logs.typed_errors(log, [Pattern(i, "n", f"(?i)error in step {i}$") for i in range(20)])
    table = spark.range(20_000).selectExpr("cast(id as int) pattern_no", "'n' name", "concat('(?i)error in step ', id, '$') pattern")
    columns = ["run_id", "error_text", "pattern_no", "line_no", "match_count"]
    assert rows(logs.typed_errors(log, table), *columns) == rows(expected, *columns)
    assert stored["entry-index"].count() < 20


def test_long_tables_are_stored_without_a_shuffle(spark, monkeypatch):
    """One partition of 50,000 patterns goes through files into several tasks; nothing is lost or given twice."""
    plans = {}
    keep = postings.packed

    def kept(df, name, *rows):
        plans[name] = plan_of(df)
        return keep(df, name, *rows)

    monkeypatch.setattr(postings, "packed", kept)
    table = spark.range(50_000).selectExpr("cast(id % 40000 as int) pattern_no", "concat('(?i)step ', id % 40000, '$') _pattern").coalesce(1)
    numbered = postings._numbered(table, required_texts(F.col("_pattern")))
    assert not [name for name, plan in plans.items() if "Exchange" in plan]
    spread = spark.read.parquet(*numbered.inputFiles())
    assert len(numbered.inputFiles()) > 1
    assert spread.select("_id").distinct().count() == spread.count() == 50_000
    assert spread.select("_entry").distinct().count() == 40_000


@pytest.mark.parametrize("text", ["abcd", "ab", "", "b a b a", "é"])
def test_entries_left_out_early_are_those_no_row_can_match(spark, rows, text):
    """Rarest grams with and without the first look at the last and middle gram; that leaves the most out before a shuffle."""
    draw = random.Random(text)
    lines = lines_of(spark, [text, None, *["".join(draw.choice("abé ") for _ in range(draw.randint(0, 12))) for _ in range(15)]])
    keys = [text, *["".join(draw.choice("abé ") for _ in range(draw.randint(0, 9))) for _ in range(150)]]
    table = spark.createDataFrame([(i, [[k for k in (keys[i], keys[-i]) if k], [k for k in [text] if k]]) for i in range(150)], "_id long, _required array<array<string>>")
    held = postings._with_gram(lines, "line", [0, 1, 2, 3, 4]).groupBy("_gram").agg(F.count(F.lit(1)).alias("_rows"))
    early, late = (postings._rarest_grams(table, F.broadcast(held), small) for small in (True, False))
    assert rows(early) == rows(late) and early.count() > 0
    plan = early._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2


@pytest.mark.parametrize("broadcast", [True, False])
def test_errors_of_many_runs_are_shuffled_once(spark, rows, monkeypatch, broadcast):
    """Distinct errors are stored and counted per run; with few runs the result needs no further shuffle. NULL runs and line numbers, too."""
    if not broadcast:
        monkeypatch.setattr(logs, "sized", lambda df: df.hint("merge"))
    given = [(i % 7 if i % 11 else None, i if i % 13 else None, f"{'WARN ' if i % 5 == 0 else ''}Error in step {i % 20}") for i in range(300)]
    given += [(1, 1, None), *given[:40]]
    log = spark.createDataFrame(given, "run_id long, line_no long, line string").repartition(3)
    table = spark.range(2_000).selectExpr("cast(id as int) pattern_no", "'n' name", "concat('(?i)(warn )?error in step ', id, '$') pattern")
    found = logs.typed_errors(log, table)
    assert ("hashpartitioning" in plan_of(found)) is not broadcast
    places = {}
    for run, line_no, line in given:
        if run is not None and line is not None and "WARN" not in line:
            places.setdefault((run, line), []).append((int(line.split()[-1]), line_no))
    first = {key: min(seen, key=lambda s: (s[0], s[1] is not None, s[1] or 0)) for key, seen in places.items()}
    sizes = {run: sum(r == run and n is not None for (r, _), (_, n) in first.items()) for run, _ in first}
    expected = [(run, line, no, line_no, sizes[run]) for (run, line), (no, line_no) in first.items()]
    columns = ["run_id", "error_text", "pattern_no", "line_no", "match_count"]
    assert rows(found, *columns) == sorted(expected, key=lambda t: [(v is not None, str(v)) for v in t])


def test_keys_of_several_lengths_given_twice(spark, rows, monkeypatch):
    """Short, empty, equal and unknown keys, shuffled: each pair as often as the key is given, unknown ones in no index."""
    stored = {}
    keep = postings.written
    monkeypatch.setattr(postings, "sized", lambda df: df)
    monkeypatch.setattr(postings, "written", lambda df, name: stored.setdefault(name, keep(df, name)))
    keys = ["", "a", "ab", "aaaaaa", "step 1", "step 1", "STEP 1", "step 123", None, "\ue000\ue000\ue000\ue000", "b\nc d"]
    lines = ["step 12", "aaaaaaaa", "Step 1", "", None, "x\ue000\ue000\ue000\ue000", "ab\nc d"]
    table = spark.createDataFrame([(i // 6, k, "s") for i, k in enumerate(keys)], "suggestion_no int, error_key string, suggestion string")
    table = table.unionByName(table.filter("error_key in ('ab', 'step 1')"))
    given = [tuple(r) for r in table.collect()]
    expected = [(i, no, s) for i, line in enumerate(lines) for no, k, s in given if line is not None and k is not None and k in line]
    found = match_keys(lines_of(spark, lines), table, "line")
    assert rows(found, "line_no", "suggestion_no", "suggestion") == sorted(expected, key=lambda t: [(True, str(v)) for v in t])
    assert "step 123" not in {r[0] for r in stored["entry-index"].select("_entry._key").collect()}


# Names


def one_pass(line, values):
    if not values:
        return line
    choices = "|".join(re.escape(k) for k in sorted(values, key=len, reverse=True))
    return re.sub(choices, lambda m: values[m.group(0)], line)


def test_random_names_by_brute_force(spark):
    draw = random.Random(3)
    jobs = {}
    for job in range(12):
        jobs[job] = {"".join(draw.choice("ab&é") for _ in range(draw.randint(1, 4))): draw.choice(["", "x", "a&", "long value"]) for _ in range(draw.randint(0, 8))}
    texts = [(job, n, "".join(draw.choice("ab&éc") for _ in range(draw.choice([0, 3, 30, 700])))) for job in jobs for n in range(6)]
    lines = spark.createDataFrame(texts, "job_id int, line_no int, line string").repartition(3)
    variables = spark.createDataFrame([(j, k, v) for j, values in jobs.items() for k, v in values.items()], "job_id int, key string, value string")
    found = names.replace_names(lines, variables, "job_id", "line_no", "line", "replaced")
    assert {(r["job_id"], r["line_no"]): r["replaced"] for r in found.collect()} == {(j, n): one_pass(t, jobs[j]) for j, n, t in texts}


def test_rows_of_every_kind(spark, rows):
    """NULL lines and jobs, NULL and empty names and values, a line given twice, two lines of one number."""
    lines = spark.createDataFrame([(1, 1, None), (None, 1, "k"), (1, 2, "k k"), (1, 2, "k k"), (1, 2, "kk"), (2, 1, "k")], "job_id int, line_no int, line string")
    variables = spark.createDataFrame([(1, "k", "v"), (1, "", "no"), (1, None, "no"), (2, "k", None)], "job_id int, key string, value string")
    found = names.replace_names(lines, variables, "job_id", "line_no", "line", "replaced")
    assert rows(found, "line", "replaced") == [(None, None), ("k", "k"), ("k", "k"), ("k k", "v v"), ("k k", "v v"), ("kk", "vv")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_long_line_meets_only_names_that_stand_in_it(spark, monkeypatch, broadcast):
    """3,000 names of one beginning and a line of 10,000 characters: as many rows as places."""
    if not broadcast:
        monkeypatch.setattr(names, "sized", lambda df: df)
    variables = spark.range(3000).select(F.lit(1).alias("job_id"), F.format_string("&T%04d#", "id").alias("key"), F.lit("v").alias("value"))
    text = ("&T0007# &T2999# &T3999# &T&T " * 400)[:10_000]
    lines = spark.createDataFrame([(1, 1, text)], "job_id int, line_no int, line string")
    places = names.name_places(lines, variables, "job_id", ["job_id", "line_no"], "line")
    assert not [word for word in NO_PAIRS if word in plan_of(places)]
    assert places.count() == text.count("&T0007#") + text.count("&T2999#")
    replaced = names.replace_names(lines, variables, "job_id", "line_no", "line", "replaced").first()["replaced"]
    assert replaced == text.replace("&T0007#", "v").replace("&T2999#", "v")

"""Log scans, matching and script substitution on hand-made lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from runlens.operators.matching import Pattern, Suggestion, match_keys, match_patterns
from runlens.plans import logs, scripts



def log_of(spark, *runs):
    return spark.createDataFrame([(i, n, line) for i, lines in enumerate(runs) for n, line in enumerate(lines)], "run_id bigint, line_no bigint, line string")


def script_of(spark, lines, job=1):
    return spark.createDataFrame([(job, n, line) for n, line in enumerate(lines)], "job_id bigint, line_no bigint, line string")


def variables_of(spark, values, job=1):
    return spark.createDataFrame([(job, k, v) for k, v in values.items()], "job_id bigint, key string, value string")


@pytest.fixture
def errors_log(spark):
    return log_of(spark, ["WARN error a", "Error b", "5 rules failed!!", "error b", "Error b", "INFO: Error c"], ["fine"], ["error only"])


PATTERNS = [Pattern(0, "generic", "(?i)error.*"), Pattern(1, "dq", "(?i).*rules failed!+.*")]
BANNER = "managed node is ready"


@pytest.mark.parametrize("more", [0, 300])
def test_matching_by_brute_force(errors_log, rows, more):
    """One program for tables of any size; numbers may be negative and need not follow each other."""
    table = [*PATTERNS, Pattern(-7, "b", "b"), *[Pattern(1000 + 3 * i, f"n{i}", f"nothing {i}") for i in range(more)]]
    found = match_patterns(errors_log, table)
    expected = [(r["run_id"], r["line_no"], p.pattern_no, h) for r in errors_log.collect() for p in table for h in re.findall(p.pattern, r["line"])]
    assert sorted(rows(found, "run_id", "line_no", "pattern_no", "hit")) == sorted(expected)
    assert dict(found.dtypes)["pattern_no"] == "int"


def test_no_patterns(errors_log):
    assert match_patterns(errors_log, []).count() == 0 and match_keys(errors_log, [], "line").count() == 0
    assert match_patterns(errors_log, []).dtypes == match_patterns(errors_log, PATTERNS).dtypes


def scans(df):
    return str(df._jdf.queryExecution().optimizedPlan()).count("LogicalRDD")


def test_the_log_is_read_once(errors_log):
    assert scans(logs.distinct_errors(errors_log, PATTERNS)) == 1
    assert scans(logs.suggestions(logs.distinct_errors(errors_log, PATTERNS), [Suggestion(0, "a", "b")])) == 1
    # Once for the runs and once for their lines.
    assert scans(logs.cluster_details(errors_log, "p", BANNER)) == 2


def test_errors_are_distinct_and_in_first_seen_order(errors_log, rows):
    found = rows(logs.typed_errors(errors_log, PATTERNS), "run_id", "pattern_no", "line_no", "error_text", "match_count")
    assert found == [
        (0, 0, 0, "error a", 5), (0, 0, 1, "Error b", 5), (0, 0, 3, "error b", 5), (0, 0, 5, "Error c", 5),
        (0, 1, 2, "5 rules failed!!", 5), (2, 0, 0, "error only", 1),
    ]


def test_matches_that_mention_warn_or_info_are_dropped(spark, rows):
    log = log_of(spark, ["WARN error", "warn error", "INFO error", "error"])
    whole = [Pattern(0, "generic", "(?i).*error.*")]
    assert rows(logs.typed_errors(log, whole), "error_text") == [("error",), ("warn error",)]


def test_suggestions_and_slots(spark, rows):
    log = log_of(
        spark,
        [BANNER, "tracking URL: https://c1-m.c.p1.x:80/a", "Tracking URL: https://c2-m.c.p2.x", "disk error"],
        ["tracking URL: https://c3-m.c.p3.x", "tracking URL: https://other", "disk error"],
    )
    errors = logs.typed_errors(log, [Pattern(0, "e", ".*error.*")])
    table = [Suggestion(0, "disk", "free $$$CN in $$$gcp"), Suggestion(1, "disk", "call"), Suggestion(2, "err", "call")]
    suggested = logs.suggestions(errors, table)
    assert rows(suggested, "run_id", "suggestion_no", "suggestion") == [
        (0, 0, "free $$$CN in $$$gcp"), (0, 1, "call"), (1, 0, "free $$$CN in $$$gcp"), (1, 1, "call"),
    ]
    assert rows(logs.suggestion_fill(suggested, log, BANNER), "run_id", "suggestion") == [(0, "free c2 in p2")]
    assert rows(logs.generic_suggestions(suggested), "run_id") == [(0,), (1,)]
    assert rows(logs.cluster_details(log, "p3", BANNER), "run_id", "cluster", "project") == [(0, "c1", "p1"), (1, "c3", "p3")]
    assert rows(match_keys(errors, table, "error_text"), "run_id", "suggestion_no") == [
        (r, n) for r in (0, 1) for n in (0, 1, 2)
    ]


def test_scans(spark, rows):
    log = log_of(spark, ["RULES FAILED!", "rules failed", "x diagnostics: N/A", "Diagnostics: killed", "File Is Not Available", "no errors"])
    assert rows(logs.dq_rule_failures(log), "line_no") == [(0,)]
    assert rows(logs.diagnostics(log), "diagnostic") == [("Diagnostics: killed",)]
    assert rows(logs.file_not_available(log), "line_no") == [(4,)]
    assert rows(logs.error_lines(log), "line_no") == [(5,)]


def test_repeated_lines_across_slices(spark):
    pick = random.Random(1)
    urls = [pick.choice("ab") for _ in range(300)]
    lines = spark.createDataFrame([(0, n, u) for n, u in enumerate(urls)], "run_id bigint, line_no bigint, url string")
    expected = [n for n, u in enumerate(urls) if n == 0 or urls[n - 1] != u]
    assert sorted(r["line_no"] for r in logs.changed_lines(lines).collect()) == expected


def test_log_parts_in_order_are_the_whole_text(spark):
    lines = [f"line {n}\n" for n in range(95)]
    parts = logs.job_log_text(log_of(spark, lines), lines_per_part=20).orderBy("part_no").collect()
    assert len(parts) == 5 and "".join(p["text"] for p in parts) == "".join(lines)


def test_latest_header_and_card(spark):
    import datetime as dt

    rows = [(1, 1, "j", "FAILED", 10, 100, dt.datetime(2024, 1, 1), "N1", "A.B.SVC"), (2, 1, "j", "SUCCESS", 90061, 100, dt.datetime(2024, 1, 2), "S9", "A.SVC2")]
    headers = spark.createDataFrame(
        rows, "run_id bigint, job_id bigint, job_name string, status string, runtime bigint, ert bigint, last_modified timestamp_ntz, edge_node string, login string"
    )
    nodes = spark.createDataFrame([("N1", "a1"), ("S9", "a9")], "node string, address string")
    log = spark.createDataFrame([(2, 0, "x")], "run_id bigint, line_no bigint, line string")
    (card,) = logs.run_status_card(headers, log, nodes, "S", "shared").collect()
    assert (card["run_id"], card["service_id"], card["runtime_text"], card["address"]) == (2, "SVC2", "1 day, 1:01:01", "shared")
    assert logs.run_status_card(headers, log.filter("run_id = 1"), nodes).count() == 0


def test_application_lookup(spark, rows):
    files = spark.createDataFrame(
        [("b.txt", 1, "ran application_1_5"), ("b.txt", 2, "U1 JOB 77 x"), ("a.txt", 1, "U1 JOB 66 x"), ("a.txt", 12, "application_1_5 application_1_6"),
         ("c.txt", 1, "application_1_55"), ("c.txt", 11, "U1 JOB 9")],
        "path string, line_no bigint, line string",
    )
    wanted = spark.createDataFrame([("application_1_5",), ("# application_1_6",), ("application_1_55",), ("application_2_1",)], "line string")
    assert rows(logs.runs_of_applications(wanted, files), "app_id", "path", "run_id") == [
        ("application_1_5", "a.txt", "66"), ("application_1_55", "c.txt", None), ("application_2_1", None, None),
    ]


# Scripts


def one_pass(line, values):
    return re.sub("|".join(map(re.escape, values)), lambda m: values[m.group()], line)


def test_names_stand_anywhere(spark):
    values = {"a.b": "1", "x-y": "2", "REGION": "east", "REG": "no", "q": "Q", "\\E": "e", "": "never", "none": None}
    lines = ["a.b x-y aXb", "MYREGION/REG", "$q \\E none"]
    found = scripts.substitute_regex(script_of(spark, lines), variables_of(spark, values)).orderBy("line_no").collect()
    assert [r["replaced"] for r in found] == ["1 2 aXb", "MYeast/no", "$Q e none"]


def test_request_words(spark, rows):
    wanted = spark.createDataFrame([(1, " application_1_1  application_1_2 "), (2, "   "), (3, "# application_1_3"), (4, "")], "line_no bigint, line string")
    files = spark.createDataFrame([("f", 1, "JOB x 77"), ("f", 2, "application_1_2")], "path string, line_no bigint, line string")
    assert rows(logs.runs_of_applications(wanted, files), "app_id", "run_id") == [("application_1_1", None), ("application_1_2", "77")]


def test_substitution_is_one_pass(spark):
    values = {"&A#": "&B#", "&B#": "two", "&AB#": "x&A#"}
    lines = ["run &A# &B#", "&A#&B#&AB#", "none", "", "&C# stays", "é &A# ü"]
    found = scripts.substitute_regex(script_of(spark, lines), variables_of(spark, values)).collect()
    assert {r["line"]: r["replaced"] for r in found} == {line: one_pass(line, values) for line in lines}


def test_variables_of_another_job_are_not_used(spark, rows):
    lines = script_of(spark, ["&A#"])
    assert rows(scripts.substitute_regex(lines, variables_of(spark, {"&A#": "x"}, job=2)), "replaced") == [("&A#",)]


def test_word_substitution_fails_as_a_whole(spark):
    values = {"&A#": "1", "&B#": ""}
    lines = ["cd  &A#  x", "cd &Z# &A#", "plain", "x&A#", "cd &B# y"]
    found = scripts.substitute_tokens(script_of(spark, lines), variables_of(spark, values)).collect()
    assert {r["line"]: r["replaced"] for r in found} == {
        "cd  &A#  x": "cd 1 x", "cd &Z# &A#": None, "plain": "plain", "x&A#": "x&A#", "cd &B# y": "cd  y",
    }


def test_source_paths(spark, rows):
    lines = ["source /u/&T#/ien-&S#-env.sh", "source /x/&Z#/plain.sh", "source ~/.profile", "echo source"]
    found = scripts.substitute_source_path(script_of(spark, lines), variables_of(spark, {"&T#": "team", "&S#": "s1"}))
    assert rows(found, "replaced") == [("source /u/team/ien-s1-env.sh",), ("source /x/&Z#/plain.sh",)]


@pytest.mark.parametrize(
    "lines, path",
    [
        (["cd /edge_data/x", "sh run.sh a"], "/edge_data/x/run.sh"),
        (["cd /edge_data/x/", "sh run.sh"], "/edge_data/x/run.sh"),
        (["cd /d", "sh /u/$USER/run.sh"], "/u/svc1/run.sh"),
        (["cd /d", "sh /opt/run.sh"], "/d/opt/run.sh"),
        (["cd /a", "cd /b &T#", "sh one.sh", "sh two.sh &T#"], "team/two.sh"),
        (["sh run.sh"], "/run.sh"),
        (["cd /d"], "/d/"),
        (["cd /d", "sh &Z# run.sh"], None),
        (["cd &Z#", "sh /u/run.sh"], None),
    ],
)
def test_script_path(spark, lines, path):
    headers = spark.createDataFrame([(1, "SVC1")], "job_id bigint, service_id string")
    found = scripts.script_path(script_of(spark, lines), variables_of(spark, {"&T#": "team"}), headers).collect()
    assert [r["script_path"] for r in found] == [path]


def test_variables(spark, rows):
    raw = spark.createDataFrame(
        [(1, 1, "&A#|one|rest"), (1, 2, "&A#|two"), (1, 3, "&B#|"), (1, 4, "k:v:w"), (1, 5, "&C#"), (1, 6, "x|y:z")], "job_id bigint, seq bigint, raw string"
    )
    assert rows(scripts.variables_first_wins(raw), "key", "value") == [
        ("&A#", "one"), ("&B#", ""), ("k", "v"), ("x", "y:z"), ("x|y", "z"),
    ]
    lines = script_of(spark, ["export &B#='set'", "if [ a=b ]", "SA_AUTH_FILE=secret", "N=1=2", "N=3"])
    assert rows(scripts.variables_last_wins(raw, lines), "key", "value") == [("&A#", "two"), ("&B#", "set"), ("N", "3")]


def test_command_classes(spark, rows):
    lines = script_of(spark, ["!source x.sh", "source ~/.profile", "sh run", "export sh", "kinit beeline", "URL=1", "cd /", "none"])
    assert rows(scripts.command_lines(lines), "line_no", "command") == [
        (0, "shell"), (0, "source"), (1, "source"), (2, "shell"), (3, "export"), (4, "beeline"), (4, "kinit"),
    ]
    assert rows(scripts.command_prefixes(lines), "line_no", "command") == [(2, "sh"), (3, "export"), (5, "URL"), (6, "cd")]


def test_shell_lines_or_notice(spark, rows):
    lines = script_of(spark, ["sh &A#.sh", "cd x"]).unionByName(script_of(spark, ["cd y"], job=2))
    found = scripts.shell_scripts_with_values(lines, variables_of(spark, {"&A#": "v"}))
    assert rows(found, "job_id", "line", "replaced") == [(1, "sh &A#.sh", "sh v.sh"), (2, "NA", "NA")]


def test_missing_script_lines_become_empty(spark, rows):
    table = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (2, 1, "y")], "job_id bigint, line_no bigint, line string")
    jobs = spark.createDataFrame([(1, "JOBS.A")], "job_id bigint, job_name string")
    assert rows(scripts.script_lines(table, jobs).select("line_no", F.col("line"))) == [(1, "\n"), (2, "x")]

"""Log scans, error and suggestion matching, job scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from entries.base import AS_OF, PARTS, entry
from runlens.functions import clock as C
from runlens.functions import labels as L
from runlens.operators.matching import Pattern, Suggestion, match_keys, match_patterns
from runlens.operators.spread import first_seen
from runlens.plans import infra, logs, scripts
from runlens.sources.tables import read_log_files, work_dir

# Parameter tables: invented patterns and suggestions.
PATTERNS = [("generic", "(?i).*error.*"), ("dq", "(?i).*rules failed!+.*"), ("file", "(?i).*is not available.*")]
SUGGESTIONS = [
    ("Error in step 1", "rerun step on $$$CN in $$$gcp"),
    ("is not available", "check upstream feed"),
    ("rules failed", "check data quality rules"),
]


BANNER = "managed node is ready"
TABLE = [Pattern(i, *p) for i, p in enumerate(PATTERNS)]
ADVICE_TABLE = [Suggestion(i, *s) for i, s in enumerate(SUGGESTIONS)]
# More patterns than one would write by hand; most match nothing.
MANY = [(f"part {i}", f"part-{i} .*") for i in range(250)]


def values(rows) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(rows)) + ")"


PARTS["o_matches"] = f"""
SELECT run_id, line_no, pattern_no, name, unnest(regexp_extract_all(line, pattern, 0)) AS hit
FROM job_log, {values(PATTERNS)} p(pattern_no, name, pattern)"""
PARTS["o_errors"] = """
SELECT t.run_id, t.hit AS error_text, t.pattern_no, t.line_no, c.match_count
FROM (SELECT * FROM o_matches WHERE NOT contains(hit, 'WARN') AND NOT contains(hit, 'INFO')
 QUALIFY row_number() OVER (PARTITION BY run_id, hit ORDER BY pattern_no, line_no) = 1) t
JOIN (SELECT run_id, count(DISTINCT hit) AS match_count FROM o_matches
 WHERE NOT contains(hit, 'WARN') AND NOT contains(hit, 'INFO') GROUP BY run_id) c ON t.run_id = c.run_id"""
PARTS["o_suggested"] = f"""
SELECT run_id, suggestion, min(suggestion_no) AS suggestion_no FROM o_errors, {values(SUGGESTIONS)} s(suggestion_no, error_key, suggestion)
WHERE contains(error_text, error_key) GROUP BY 1, 2"""
PARTS["o_urls"] = "SELECT run_id, line_no, unnest(regexp_extract_all(line, '(?i)tracking URL+.*', 0)) AS url FROM job_log"
PARTS["o_managed"] = "SELECT DISTINCT run_id FROM job_log WHERE contains(line, 'managed node is ready')"
NAMED = "string_split(string_split(url, '-m.c.')[1], '//')[-1] AS cluster, coalesce(string_split(string_split(url, '-m.c.')[2], '.')[1], '') AS project"
PARTS["o_managed_cluster"] = f"""
SELECT run_id, line_no, url, {NAMED} FROM o_urls WHERE run_id IN (SELECT run_id FROM o_managed)
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no) = 1"""
PARTS["o_last_cluster"] = f"""
SELECT run_id, line_no, url, {NAMED} FROM o_urls WHERE run_id IN (SELECT run_id FROM o_managed)
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) = 1"""


# Headers and text


@entry("latest_run_header", "SELECT job_name, run_id, service_id, last_modified FROM o_header")
def latest_run_header(v):
    return logs.latest_run_header(v.run_header).select("job_name", "run_id", "service_id", "last_modified")


@entry(
    "job_log_text",
    "SELECT run_id, CAST(floor(line_no / 10000) AS BIGINT) AS part_no, string_agg(line, chr(10) ORDER BY line_no) AS text FROM job_log GROUP BY 1, 2",
)
def job_log_text(v):
    return logs.job_log_text(v.job_log, separator="\n")


LOG = "SELECT run_id, line_no, line FROM job_log"


def log(v):
    return v.job_log.select("run_id", "line_no", "line")


@entry(
    "raw_file_lines",
    """
SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, nth) AS line_no, line
FROM (SELECT source, doc_id, generate_subscripts(parts, 1) AS nth, unnest(parts) AS line
 FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents) d) x""",
)
def raw_file_lines(v):
    """Documents written as one text file per source and read back as numbered lines."""
    folder = work_dir(v.spark, "raw-files")
    docs = v.documents.select("source", "doc_id", "text").repartition("source").sortWithinPartitions("source", "doc_id")
    docs.select("source", "text").write.partitionBy("source").text(folder)
    lines = logs.numbered_lines(read_log_files(v.spark, folder))
    source = F.regexp_extract("path", "source=([^/]*)", 1)
    return lines.select(source.alias("source"), F.col("line_no").cast("bigint").alias("line_no"), "line")


@entry("dq_rule_failures", f"{LOG} WHERE line ILIKE '%rules failed!%'")
def dq_rule_failures(v):
    return logs.dq_rule_failures(log(v))


@entry("error_lines", f"{LOG} WHERE line ILIKE '%error%'")
def error_lines(v):
    return logs.error_lines(log(v))


@entry("file_not_available", f"{LOG} WHERE line ILIKE '%is not available%'")
def file_not_available(v):
    return logs.file_not_available(log(v))


@entry(
    "diagnostics",
    """
SELECT run_id, line_no, diagnostic FROM (SELECT run_id, line_no, unnest(regexp_extract_all(line, '(?i)diagnostics+.*', 0)) AS diagnostic FROM job_log) d
WHERE diagnostic NOT IN ('diagnostics: N/A', 'diagnostics: AM container is launched, waiting for AM container to Register with RM')""",
)
def diagnostics(v):
    return logs.diagnostics(log(v)).select("run_id", "line_no", "diagnostic")


@entry(
    "cluster_details",
    f"""
SELECT * FROM o_managed_cluster UNION ALL
SELECT run_id, line_no, url, {NAMED} FROM o_urls WHERE run_id NOT IN (SELECT run_id FROM o_managed) AND contains(url, '-m.c.proj1')""",
)
def cluster_details(v):
    return logs.cluster_details(log(v), "proj1", BANNER)


@entry(
    "suppress_consecutive_duplicates",
    """
SELECT run_id, line_no, url FROM (SELECT *, lag(url) OVER (PARTITION BY run_id ORDER BY line_no) AS before FROM o_urls) t
WHERE before IS NULL OR before <> url""",
)
def suppress_consecutive_duplicates(v):
    return logs.changed_lines(logs.tracking_lines(log(v)))


@entry("first_match", f"{LOG} WHERE line ILIKE '%error%' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY line_no) = 1")
def first_match(v):
    return logs.first_match(log(v), F.col("line").rlike("(?i)error"))


# Patterns and suggestions


@entry("pattern_match_join", "SELECT run_id, line_no, pattern_no, name, hit FROM o_matches")
def pattern_match_join(v):
    return match_patterns(log(v), TABLE).drop("line")


@entry(
    "pattern_match_many",
    f"""
SELECT run_id, line_no, pattern_no, name, unnest(regexp_extract_all(line, pattern, 0)) AS hit FROM job_log, {values(MANY)} p(pattern_no, name, pattern)""",
)
def pattern_match_many(v):
    return match_patterns(log(v), [Pattern(i, *p) for i, p in enumerate(MANY)]).drop("line")


@entry(
    "suggestion_join",
    f"""
SELECT run_id, line_no, suggestion_no, suggestion FROM job_log, {values(SUGGESTIONS)} s(suggestion_no, error_key, suggestion) WHERE contains(line, error_key)""",
)
def suggestion_join(v):
    return match_keys(log(v), ADVICE_TABLE, "line").select("run_id", "line_no", "suggestion_no", "suggestion")


# Tables of any length; the checks try every pattern and key on every distinct line.

PARTS["o_table_matches"] = """
SELECT l.run_id, l.line_no, m.pattern_no, m.name, m.hit FROM job_log l
JOIN (SELECT line, pattern_no, name, unnest(regexp_extract_all(line, pattern, 0)) AS hit
 FROM (SELECT DISTINCT line FROM job_log) d, pattern_entry) m ON l.line = m.line"""


@entry("pattern_match_table", "SELECT run_id, line_no, pattern_no, name, hit FROM o_table_matches")
def pattern_match_table(v):
    return match_patterns(log(v), v.pattern_entry).drop("line")


@entry(
    "typed_errors_table",
    """
SELECT t.run_id, t.hit AS error_text, t.pattern_no, t.line_no, count(*) OVER (PARTITION BY t.run_id) AS match_count
FROM (SELECT * FROM o_table_matches WHERE NOT contains(hit, 'WARN') AND NOT contains(hit, 'INFO')
 QUALIFY row_number() OVER (PARTITION BY run_id, hit ORDER BY pattern_no, line_no) = 1) t""",
)
def typed_errors_table(v):
    return logs.typed_errors(log(v), v.pattern_entry)


@entry(
    "suggestion_table",
    """
SELECT l.run_id, l.line_no, m.suggestion_no, m.suggestion FROM job_log l
JOIN (SELECT line, suggestion_no, suggestion FROM (SELECT DISTINCT line FROM job_log) d, suggestion_entry WHERE contains(line, error_key)) m ON l.line = m.line""",
)
def suggestion_table(v):
    return match_keys(log(v), v.suggestion_entry, "line").select("run_id", "line_no", "suggestion_no", "suggestion")


@entry("dedup_keep_first", "SELECT run_id, line, min(line_no) AS line_no FROM job_log GROUP BY 1, 2")
def dedup_keep_first(v):
    return first_seen(log(v), ["run_id", "line"], ["line_no"], "first").select("run_id", "line", "first.line_no")


@entry("typed_errors", "SELECT * FROM o_errors")
def typed_errors(v):
    return logs.typed_errors(log(v), TABLE)


def suggested(v):
    return logs.suggestions(logs.distinct_errors(log(v), TABLE), ADVICE_TABLE)


@entry("suggestions", "SELECT * FROM o_suggested")
def suggestions(v):
    return suggested(v)


@entry(
    "suggestion_fill",
    """
SELECT s.run_id, s.suggestion_no, c.cluster, c.project, replace(replace(s.suggestion, '$$$gcp', c.project), '$$$CN', c.cluster) AS suggestion
FROM o_suggested s JOIN o_last_cluster c ON s.run_id = c.run_id WHERE contains(s.suggestion, '$$$gcp')""",
)
def suggestion_fill(v):
    return logs.suggestion_fill(suggested(v), log(v), BANNER)


@entry("generic_suggestions", "SELECT * FROM o_suggested WHERE NOT contains(suggestion, '$$$gcp')")
def generic_suggestions(v):
    return logs.generic_suggestions(suggested(v))


# Run cards

DURATION = """CASE WHEN {s} // 86400 = 0 THEN '' WHEN {s} // 86400 = 1 THEN '1 day, ' ELSE CAST({s} // 86400 AS VARCHAR) || ' days, ' END
 || CAST(({s} % 86400) // 3600 AS VARCHAR) || ':' || lpad(CAST({s} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0')"""
ADVICE = f"""CASE WHEN status = 'FAILED' AND (runtime < ert / 2 OR runtime > ert * 2) THEN '{L.RESTART}' WHEN status = 'FAILED' THEN '{L.READ_LOGS}' ELSE '{L.COMPLETED}' END"""


@entry("format_duration", f"SELECT parent_run_id, ah_runtime * 40 AS seconds, {DURATION.format(s='(ah_runtime * 40)')} AS text FROM wf_run")
def format_duration(v):
    seconds = F.col("ah_runtime") * 40
    return v.wf_run.select("parent_run_id", seconds.alias("seconds"), C.duration_text(seconds).alias("text"))


@entry("runtime_suggestion", f"SELECT run_id, {ADVICE} AS advice FROM run_header")
def runtime_suggestion(v):
    return v.run_header.select("run_id", L.runtime_advice("status", "runtime", "ert").alias("advice"))


LOOKUP = "CASE WHEN starts_with(h.edge_node, 'SHARED') THEN '192.0.2.254' ELSE n.address END AS address"


@entry(
    "edge_node_lookup",
    f"SELECT h.run_id, h.edge_node, {LOOKUP} FROM run_header h LEFT JOIN edge_node n ON n.node = h.edge_node",
)
def edge_node_lookup(v):
    located = logs.edge_addresses(v.run_header, v.edge_node, "SHARED", "192.0.2.254")
    return located.select("run_id", "edge_node", "address")


@entry(
    "run_status_card",
    f"""
SELECT h.job_name, h.run_id, h.status, {DURATION.format(s='h.runtime')} AS runtime_text, {DURATION.format(s='h.ert')} AS ert_text,
 h.last_modified, h.service_id, h.edge_node, {LOOKUP}, {ADVICE} AS advice
FROM o_header h LEFT JOIN edge_node n ON n.node = h.edge_node WHERE h.run_id IN (SELECT run_id FROM job_log)""",
)
def run_status_card(v):
    return logs.run_status_card(v.run_header, v.job_log, v.edge_node, "SHARED", "192.0.2.254")


# Files


@entry(
    "app_id_to_run",
    """
WITH wanted AS (SELECT DISTINCT unnest(regexp_extract_all(line, '\\S+')) AS app_id FROM app_request WHERE NOT contains(line, '#')),
 mention AS (SELECT path, unnest(regexp_extract_all(line, 'application_\\d+_\\d+', 0)) AS app_id FROM agent_file),
 first_file AS (SELECT app_id, min(path) AS path FROM mention GROUP BY 1),
 job_line AS (SELECT path, string_split(line, ' ')[3] AS run_id FROM agent_file WHERE line_no <= 10 AND contains(line, 'JOB')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no, line) = 1)
SELECT w.app_id, f.path, j.run_id FROM wanted w LEFT JOIN first_file f ON w.app_id = f.app_id LEFT JOIN job_line j ON f.path = j.path""",
)
def app_id_to_run(v):
    return logs.runs_of_applications(v.app_request, v.agent_file)


@entry(
    "files_mentioning",
    f"""
SELECT l.path, l.owner, l.mtime, l.bytes FROM file_listing l
WHERE floor(date_diff('second', l.mtime, TIMESTAMP '{AS_OF}') / 86400) < 2
 AND EXISTS (SELECT 1 FROM file_content c WHERE c.path = l.path AND contains(c.text, 'an'))""",
)
def files_mentioning(v):
    return logs.files_mentioning(v.file_listing, v.file_content, "an", infra.modified_within(AS_OF, 2))


# Scripts


def lines(v):
    return scripts.script_lines(v.process_tab, v.run_header)


@entry("process_tab_lines", "SELECT * FROM o_script")
def process_tab_lines(v):
    return lines(v)


CLASSES = {
    "source": "contains(line, 'source')",
    "export": "contains(line, 'export')",
    "kinit": "contains(line, 'kinit')",
    "shell": "(contains(line, '.sh') OR contains(line, 'sh '))",
    "beeline": "contains(line, 'beeline')",
}
STARTS = {
    "source": "starts_with(line, 'source') AND line <> 'source ~/.profile'",
    "export": "starts_with(line, 'export')",
    "URL": "starts_with(line, 'URL')",
    "sh": "starts_with(line, 'sh')",
    "cd": "starts_with(line, 'cd')",
}


def by_class(tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT job_id, job_name, line_no, line, '{n}' AS command FROM o_script WHERE {t}" for n, t in tests.items())


PARTS["o_class"] = by_class(CLASSES)
PARTS["o_start"] = by_class(STARTS)
PARTS["o_first"] = """
SELECT job_id, key, value FROM (
 SELECT job_id, seq, 0 AS sep, string_split(raw, '|')[1] AS key, string_split(raw, '|')[2] AS value FROM object_value WHERE contains(raw, '|')
 UNION ALL
 SELECT job_id, seq, 1, string_split(raw, ':')[1], string_split(raw, ':')[2] FROM object_value WHERE contains(raw, ':')) p
QUALIFY row_number() OVER (PARTITION BY job_id, key ORDER BY seq, sep) = 1"""
PARTS["o_assigned"] = """
SELECT DISTINCT job_id, line_no, string_split(plain, '=')[1] AS key, trim(string_split(plain, '=')[2], '''') AS value
FROM (SELECT job_id, line_no, CASE WHEN starts_with(line, 'export ') THEN substr(line, 8) ELSE line END AS plain FROM o_script
 WHERE contains(line, '=') AND NOT contains(line, 'if') AND NOT contains(line, 'SA_AUTH_FILE')) x"""
PARTS["o_last"] = """
SELECT job_id, key, value FROM (
 SELECT job_id, 0 AS source, seq, string_split(raw, '|')[1] AS key,
  CASE WHEN string_split(raw, '|')[2] = '' THEN 'NA' ELSE string_split(raw, '|')[2] END AS value
 FROM object_value WHERE starts_with(raw, '&') AND contains(raw, '|')
 UNION ALL SELECT job_id, 1, line_no, key, value FROM o_assigned) p
QUALIFY row_number() OVER (PARTITION BY job_id, key ORDER BY source DESC, seq DESC) = 1"""


@entry("command_lines", "SELECT * FROM o_class")
def command_lines(v):
    return scripts.command_lines(lines(v))


@entry("command_prefixes", "SELECT * FROM o_start")
def command_prefixes(v):
    return scripts.command_prefixes(lines(v))


@entry("variables_first_wins", "SELECT * FROM o_first")
def variables_first_wins(v):
    return scripts.variables_first_wins(v.object_value)


@entry("script_assignments", "SELECT * FROM o_assigned")
def script_assignments(v):
    return scripts.script_assignments(lines(v))


@entry("variables_last_wins", "SELECT * FROM o_last")
def variables_last_wins(v):
    return scripts.variables_last_wins(v.object_value, lines(v))


def pivoted(part: str, names: dict[str, str]) -> str:
    shown = ", ".join(f"max(value) FILTER (WHERE key = '{key}') AS {name}" for name, key in names.items())
    return f"SELECT job_id, {shown} FROM {part} GROUP BY job_id"


# No value contains a name, so replacing one name after the other gives the one-pass result.
FIRST = pivoted("o_first", {"team": "&TEAM#", "step": "&STEP#"})
LAST = pivoted("o_last", {"team": "&TEAM#", "step": "&STEP#"})
CHAINED = "replace(replace(s.line, '&TEAM#', coalesce(p.team, '&TEAM#')), '&STEP#', coalesce(p.step, '&STEP#'))"


@entry(
    "substitute_regex",
    f"SELECT s.*, {CHAINED} AS replaced FROM o_script s LEFT JOIN ({FIRST}) p ON s.job_id = p.job_id",
)
def substitute_regex(v):
    return scripts.substitute_regex(lines(v), scripts.variables_first_wins(v.object_value))


WORDS = "array_to_string(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''), ' ')"
PARTS["o_tokens"] = f"""
SELECT s.job_id, s.job_name, s.line_no, s.line, CASE WHEN contains(s.line, '&UNKNOWN#') AND regexp_matches(s.line, '(^|\\s)&UNKNOWN#') THEN NULL
 WHEN regexp_matches(s.line, '(^|\\s)&TEAM#(\\s|$)') AND p.team IS NULL THEN NULL
 WHEN regexp_matches(s.line, '(^|\\s)&STEP#(\\s|$)') AND p.step IS NULL THEN NULL
 ELSE {WORDS.format(t="regexp_replace(regexp_replace(s.line, '(^|\\s)&TEAM#(\\s|$)', '\\1' || coalesce(p.team, '') || '\\2', 'g'), '(^|\\s)&STEP#(\\s|$)', '\\1' || coalesce(p.step, '') || '\\2', 'g')")} END AS replaced
FROM o_script s LEFT JOIN ({LAST}) p ON s.job_id = p.job_id"""


@entry("substitute_tokens", "SELECT * FROM o_tokens")
def substitute_tokens(v):
    return scripts.substitute_tokens(lines(v), scripts.variables_last_wins(v.object_value, lines(v)))


@entry(
    "substitute_source_path",
    f"""
SELECT s.job_id, s.job_name, s.line_no, s.line, {CHAINED} AS replaced FROM o_start s LEFT JOIN ({LAST}) p ON s.job_id = p.job_id WHERE s.command = 'source'""",
)
def substitute_source_path(v):
    return scripts.substitute_source_path(lines(v), scripts.variables_last_wins(v.object_value, lines(v)))


@entry(
    "shell_scripts_with_values",
    f"""
WITH shell AS (SELECT s.job_id, s.line_no, s.line, {CHAINED} AS replaced FROM o_class s LEFT JOIN ({FIRST}) p ON s.job_id = p.job_id WHERE s.command = 'shell')
SELECT j.job_id, c.line_no, coalesce(c.line, 'NA') AS line, coalesce(c.replaced, 'NA') AS replaced
FROM (SELECT DISTINCT job_id FROM o_script) j LEFT JOIN shell c ON j.job_id = c.job_id""",
)
def shell_scripts_with_values(v):
    return scripts.shell_scripts_with_values(lines(v), scripts.variables_first_wins(v.object_value))


@entry(
    "script_path",
    """
WITH t AS (SELECT c.job_id, c.line_no, c.command, k.replaced FROM o_start c JOIN o_tokens k ON c.job_id = k.job_id AND c.job_name = k.job_name AND c.line_no = k.line_no
  WHERE c.command IN ('sh', 'cd') QUALIFY row_number() OVER (PARTITION BY c.job_id, c.command ORDER BY c.line_no DESC) = 1),
 w AS (SELECT job_id, command, CASE WHEN replaced IS NULL THEN NULL
   WHEN command = 'sh' THEN coalesce(list_filter(string_split(replaced, ' '), lambda x: x LIKE '%.sh')[-1], '')
   ELSE string_split(replaced, ' ')[-1] END AS word FROM t),
 p AS (SELECT job_id, bool_or(word IS NULL) AS failed, coalesce(max(word) FILTER (WHERE command = 'sh'), '') AS script,
   coalesce(max(word) FILTER (WHERE command = 'cd'), '') AS base FROM w GROUP BY job_id),
 path AS (SELECT job_id, CASE WHEN failed THEN NULL WHEN starts_with(script, '/u') OR starts_with(script, '/edge_data') THEN script
   WHEN length(base) > 0 OR length(script) > 0 THEN base || CASE WHEN base LIKE '%/' OR starts_with(script, '/') THEN '' ELSE '/' END || script
   ELSE '' END AS path FROM p)
SELECT path.job_id, replace(path.path, '$USER', coalesce(lower(h.service_id), '$USER')) AS script_path FROM path LEFT JOIN o_header h ON path.job_id = h.job_id""",
)
def script_path(v):
    headers = logs.latest_run_header(v.run_header)
    return scripts.script_path(lines(v), scripts.variables_last_wins(v.object_value, lines(v)), headers)

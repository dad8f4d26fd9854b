"""Text rules for logs and job scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the log scans look for (case is ignored) and the two harmless diagnostics.
RULES_FAILED = "(?i)rules failed!+"
ERROR = "(?i)error+"
NOT_AVAILABLE = "(?i)is not available+"
DIAGNOSTICS = "(?i)diagnostics+.*"
HARMLESS_DIAGNOSTICS = (
    "diagnostics: N/A",
    "diagnostics: AM container is launched, waiting for AM container to Register with RM",
)
TRACKING_URL = "(?i)tracking URL+.*"
HOST_MARK = "-m.c."

# Command classes by text a line contains, and by text it starts with.
COMMAND_TEXTS = {
    "source": ("source",),
    "export": ("export",),
    "kinit": ("kinit",),
    "shell": (".sh", "sh "),
    "beeline": ("beeline",),
}
COMMAND_STARTS = ("source", "export", "URL", "sh", "cd")
PROFILE_LINE = "source ~/.profile"


def cluster_of(url: Column) -> Column:
    """Cluster name: host text between ``//`` and the host mark."""
    return F.substring_index(F.substring_index(url, HOST_MARK, 1), "//", -1)


def project_of(url: Column) -> Column:
    """Project name: text from the host mark to the next dot; empty without the mark."""
    after = F.substring(url, F.locate(HOST_MARK, url) + len(HOST_MARK), F.length(url))
    return F.when(url.contains(HOST_MARK), F.substring_index(after, ".", 1)).otherwise("")


def command_classes(line: Column) -> Column:
    """Every class whose text the line contains."""
    found = []
    for name, texts in COMMAND_TEXTS.items():
        test = line.contains(texts[0])
        for text in texts[1:]:
            test = test | line.contains(text)
        found.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*found))


def command_start_classes(line: Column) -> Column:
    """Every class the line starts with; the profile line is not a source command."""
    found = []
    for name in COMMAND_STARTS:
        test = line.startswith(name)
        if name == "source":
            test = test & (line != PROFILE_LINE)
        found.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*found))


def part(text: Column, separator: str, number: int) -> Column:
    """The n-th part (from 1); NULL when there are fewer."""
    return F.try_element_at(F.split(text, separator), F.lit(number))


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def without_suffix(text: Column, suffix: str) -> Column:
    return F.when(
        text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))
    ).otherwise(text)


def value_of(values: Column, name: Column) -> Column:
    return F.try_element_at(values, name)


def words(text: Column) -> Column:
    """Whitespace-separated words without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def marked(names: Column) -> Column:
    """The names that are variable references."""
    return F.filter(names, lambda w: w.startswith("&"))


def replace_words(text: Column, values: Column) -> Column:
    """Replace every ``&`` word; NULL if one has no value."""
    new = F.transform(words(text), lambda w: F.when(w.startswith("&"), value_of(values, w)).otherwise(w))
    return F.when(~F.exists(new, lambda w: w.isNull()), F.array_join(new, " "))


def path_segments(line: Column) -> Column:
    """Path segments of a source command without its keyword and ending."""
    return F.split(without_suffix(without_prefix(line, "source "), ".sh"), "/")


def segment_names(line: Column) -> Column:
    """Variable names a source path may refer to: whole segments, and dash parts of ``ien`` segments."""
    inner = F.transform(path_segments(line), lambda s: F.when(s.startswith("ien"), F.split(s, "-")).otherwise(F.array(s)))
    return marked(F.flatten(inner))


def replace_path(line: Column, values: Column) -> Column:
    """The source command with known variables of its path filled in."""

    def known(name: Column) -> Column:
        return F.when(name.startswith("&"), F.coalesce(value_of(values, name), name)).otherwise(name)

    def segment(text: Column) -> Column:
        dashed = F.array_join(F.transform(F.split(text, "-"), known), "-")
        return F.when(text.startswith("ien"), dashed).otherwise(known(text))

    return F.concat(F.lit("source "), F.array_join(F.transform(path_segments(line), segment), "/"), F.lit(".sh"))


def last_matching(items: Column, test: Callable[[Column], Column]) -> Column:
    """Last array element that passes the test, else empty text."""
    return F.coalesce(F.try_element_at(F.filter(items, test), F.lit(-1)), F.lit(""))

"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed and holds no body.  Each is joined, by
canonical URL and time, to the latest earlier full response.  If their validators agree, the
revisit stands for that response's body under merged headers: of a not-modified answer only
the permitted headers replace those stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm.common import query, read
from runlens.operators.spread import ordered_parts

# Header fields a not-modified answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|sessionid)(=|$)"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """Host, path and sorted query: no scheme, default port, ``www.``, fragment, tracking parameter or last slash.

    What is no URL with a scheme is kept as it is; NULL stays NULL.
    """
    host = F.lower(F.regexp_extract(url, URL, 2))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, URL, 3), "/+$", "")
    parameters = F.split(F.regexp_replace(F.regexp_extract(url, URL, 4), r"^\?", ""), "&")
    kept = F.array_join(F.array_sort(F.filter(parameters, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    joined = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url.rlike(URL), joined).otherwise(url)


def merged_headers(stored: Column, answer: Column) -> Column:
    """The stored headers, with those of the answer that are permitted in their place."""
    updates = F.map_filter(answer, lambda k, _: k.isin(PERMITTED))
    rest = F.map_filter(stored, lambda k, _: ~F.map_contains_key(updates, k))
    return F.map_concat(rest, updates)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit record: ``record_id, url_key, response_id, verdict, headers``.

    ``records`` has ``record_id, kind`` ("response" or "revisit"), ``url, ts, status, headers``
    (a map with lower-case names) and ``digest`` of the payload.  A full response is one with
    status 200.  Earlier means smaller (ts, record_id).  The verdict is

    * ``no_response``: there is no earlier full response, or URL or time is NULL;
    * ``resolved``: the first validator both sides have agrees, of etag (weak marks aside),
      last-modified and payload digest; ``response_id`` and merged ``headers`` are given;
    * ``mismatch``: it does not agree;  ``no_validator``: there is none on both sides.

    Other columns are ignored.  Rows given twice are resolved twice, alike.  Bodies do not move:
    only keys, validators and headers do.  The as-of join runs in ordered parts, so the records
    of a very frequent URL are spread over tasks; each part then takes the last response of the
    parts before it.
    """
    nowhere = F.col("url").isNull() | F.col("ts").isNull()
    own = F.concat(F.lit("no url "), F.coalesce(F.col("record_id").cast("string"), F.lit("")))
    keyed = records.select(
        "record_id",
        F.col("kind").eqNullSafe("revisit").alias("revisit"),
        F.when(nowhere, own).otherwise(canonical_url(F.col("url"))).alias("url_key"),
        "ts",
        (F.col("kind").eqNullSafe("response") & F.col("status").eqNullSafe(200) & ~nowhere).alias("full"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "digest",
    ).filter("revisit OR full")
    order = [F.asc("ts"), F.asc("record_id"), F.asc("revisit")]
    parts = ordered_parts(keyed, ["url_key"], order)
    response = F.struct("record_id", "headers", "digest")
    inside = Window.partitionBy("url_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = parts.withColumn("_inside", F.last(F.when(F.col("full"), response), True).over(inside)).filter("revisit")
    ends = parts.filter("full").groupBy("url_key", "_part").agg(F.max_by(response, F.struct("ts", "record_id")).alias("_end"))
    places = parts.select("url_key", "_part").distinct().join(ends, ["url_key", "_part"], "left")
    before = Window.partitionBy("url_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("_carried", F.last("_end", True).over(before)).select("url_key", "_part", "_carried")
    met = seen.join(carried, ["url_key", "_part"]).withColumn("found", F.coalesce("_inside", "_carried"))

    def etag(headers: Column) -> Column:
        return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), a == b)

    stored = F.col("found.headers")
    since = F.lit("last-modified")
    agree = F.coalesce(
        both(etag(F.col("headers")), etag(stored)),
        both(F.try_element_at(F.col("headers"), since), F.try_element_at(stored, since)),
        both(F.col("digest"), F.col("found.digest")),
    )
    verdict = (
        F.when(F.col("found").isNull(), "no_response").when(agree, "resolved").when(~agree, "mismatch").otherwise("no_validator")
    )
    judged = met.withColumn("verdict", verdict)
    good = F.col("verdict") == "resolved"
    return judged.select(
        "record_id",
        "url_key",
        F.when(good, F.col("found.record_id")).alias("response_id"),
        "verdict",
        F.when(good, merged_headers(stored, F.col("headers"))).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Archive records derived from a table of pages: a response for each page, and a revisit a day later.

    The revisit asks for the page under another form of its URL.  Pages whose size is a multiple
    of seven were changed meanwhile, by their etag; of those by eleven the answer has no etag.
    """
    html = F.coalesce("html", F.lit(""))
    size = F.octet_length(html)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ts = start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("page_id").cast("int"), F.lit(0))
    later = ts + F.make_dt_interval(F.lit(1))
    tag = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"'))
    digest = F.concat(F.lit("sha1:"), F.sha1(html.cast("binary")))
    stored = F.create_map(
        *[F.lit("content-type"), F.lit("text/html; charset=utf-8"), F.lit("content-length"), size.cast("string")],
        *[F.lit("etag"), tag, F.lit("date"), ts.cast("string"), F.lit("cache-control"), F.lit("max-age=3600")],
    )
    common = [F.lit("content-length"), F.lit("0"), F.lit("date"), later.cast("string"), F.lit("cache-control"), F.lit("max-age=7200")]
    answered = (
        F.when(size % 7 == 0, F.create_map(*common, F.lit("etag"), F.lit('"changed"')))
        .when(size % 11 == 0, F.create_map(*common))
        .otherwise(F.create_map(*common, F.lit("etag"), F.concat(F.lit("W/"), tag)))
    )
    bare = F.regexp_replace("url", "#.*$", "")
    again = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("utm_campaign=again#top"))
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("url"), ts.alias("ts"),
        F.lit(200).alias("status"), stored.alias("headers"), digest.alias("digest"),
    )
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), again.alias("url"), later.alias("ts"),
        F.lit(304).alias("status"), answered.alias("headers"), digest.alias("digest"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


CHECK = r"""
WITH p AS (
 SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size, regexp_replace(url, '#.*$', '') AS bare,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS ts FROM pages
), tagged AS (SELECT *, '"' || md5(html) || '"' AS tag, sha1(html) AS digest, ts + INTERVAL 1 DAY AS later FROM p),
records AS (
 SELECT page_id * 2 AS record_id, true AS is_full, url, ts, tag, digest, size FROM tagged
 UNION ALL
 SELECT page_id * 2 + 1, false, bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_campaign=again#top', later,
  CASE WHEN size % 7 = 0 THEN '"changed"' WHEN size % 11 = 0 THEN NULL ELSE tag END, digest, size FROM tagged
), pieces AS (
 SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 2)), ':(80|443)$', ''), '^www\.', '') AS host,
  regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 4), '^\?', ''), '&'),
   lambda x : x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref|sessionid)(=|$)'))), '&') AS query FROM records
), keyed AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM pieces),
found AS (
 SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'tag': tag, 'digest': digest, 'size': size} END IGNORE NULLS)
  OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM keyed
), judged AS (
 SELECT *, CASE WHEN f IS NULL THEN 'no_response' WHEN coalesce(tag = f.tag, digest = f.digest) THEN 'resolved' ELSE 'mismatch' END AS verdict
 FROM found WHERE NOT is_full
)
SELECT record_id, url_key, CASE WHEN verdict = 'resolved' THEN f.id END AS response_id, verdict,
 CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=7200' || chr(10) || 'content-length: ' || f.size || chr(10) || 'content-type: text/html; charset=utf-8'
  || chr(10) || 'date: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: ' || CASE WHEN tag IS NULL THEN f.tag ELSE 'W/' || tag END END AS headers
FROM judged
"""


@query("op3_revisits", CHECK)
def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(read(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))

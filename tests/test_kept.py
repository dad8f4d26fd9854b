"""Tables kept up to date: buckets, batches, counts, the error index, streams with state."""

import datetime as dt
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runlens.operators.changes import upsert
from runlens.operators.spread import carried_forward
from runlens.plans import counts, infra
from runlens.plans import incidents as I
from runlens.sources import bucketed, commits
from runlens.streaming import polls

T0 = dt.datetime(2024, 1, 15, 8)


# Buckets

RECORD = "k bigint, name string, a string, b int"
KEY = ["k", "name"]


@pytest.fixture
def records(spark):
    rows = [(i, f"n{i % 3}", "old", i) for i in range(300)] + [(None, "x", "null key", 0), (None, None, "null key", 0)]
    return spark.createDataFrame(rows, RECORD).repartition(5)


def buckets_read(df):
    """How many bucket folders each scan of a plan reads; None for all."""
    found = []
    for scan in re.findall(r"PartitionFilters: (.*?), PushedFilters", plan_of(df)):
        numbers = re.search(r"bucket_of_\d+#\d+ IN \(([\d,]+)\)", scan)
        found.append(len(numbers.group(1).split(",")) if numbers else 1 if re.search(r"bucket_of_\d+#\d+ = \d+", scan) else None)
    return found


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


def test_a_change_rewrites_only_the_buckets_it_touches(spark, records, rows, tmp_path):
    path = str(tmp_path / "t")
    bucketed.write_bucketed(records, path, KEY, 40)
    assert rows(bucketed.read_bucketed(spark, path), *records.columns) == rows(records)
    before = files(path)
    changes = spark.createDataFrame([(1, 7, "n1", "new", None), (2, 7, "n1", None, 5), (3, 999, "n9", "added", 1), (4, None, "x", "lost", 1)], f"seq bigint, {RECORD}")
    staged = bucketed.rewrite_touched(spark, path, KEY, changes.select(*KEY), lambda old: upsert(old, changes, KEY))
    assert 1 <= len(staged.touched) <= 3
    assert rows(bucketed.read_bucketed(spark, path), *records.columns) == rows(upsert(records, changes, KEY))
    after = files(path)
    touched = tuple(f"bucket_of_40={n}/" for n in staged.touched)
    assert {f: t for f, t in before.items() if not f.startswith(touched)} == {f: t for f, t in after.items() if not f.startswith(touched)}
    assert not any(f in after for f in before if f.startswith(touched))
    # Doing the replacement again changes no row.
    bucketed.replace_buckets(staged)
    assert rows(bucketed.read_bucketed(spark, path), *records.columns) == rows(upsert(records, changes, KEY))


def test_only_touched_buckets_are_read(spark, records, tmp_path):
    path = str(tmp_path / "t")
    bucketed.write_bucketed(records, path, KEY, 40)
    keys = records.filter("k = 7").select(*KEY)
    found = bucketed.read_touched(spark, path, bucketed.touched_buckets(spark, path, keys, KEY))
    assert buckets_read(found) == [1] and found.filter("k = 7").count() == 1


def test_a_failure_before_the_replacement_leaves_the_table(spark, records, rows, tmp_path):
    path = str(tmp_path / "t")
    bucketed.write_bucketed(records, path, KEY, 8)
    before = files(path)
    keys = records.filter("k < 4").select(*KEY)
    bucketed.stage_touched(spark, path, KEY, keys, lambda old: old.withColumn("a", F.lit("new")))
    with pytest.raises(Exception, match="broken"):
        bucketed.rewrite_touched(spark, path, KEY, keys, lambda old: old.withColumn("a", F.raise_error(F.lit("broken")).cast("string")))
    with pytest.raises(ValueError, match="not given"):
        bucketed.rewrite_touched(spark, path, KEY, keys.limit(1), lambda old: records)
    assert files(path) == before


def test_emptied_buckets_and_empty_batches(spark, records, tmp_path):
    path = str(tmp_path / "t")
    bucketed.write_bucketed(records, path, KEY, 4)
    none = records.limit(0).select(*KEY)
    before = files(path)
    assert bucketed.rewrite_touched(spark, path, KEY, none, lambda old: old).touched == [] and files(path) == before
    bucketed.rewrite_touched(spark, path, KEY, records.filter("k = 3").select(*KEY), lambda old: old.filter("false"))
    left = bucketed.read_bucketed(spark, path)
    assert 0 < left.count() < records.count() and left.filter("k = 3").isEmpty()


# Batches


def poll(spark, *ids):
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=i)) for i in ids], "id bigint, at timestamp_ntz")


def test_a_batch_counts_once(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    at = F.col("at")
    assert commits.daily_append_once(poll(spark, 1, 2, 30), at, path, "1")
    assert not commits.daily_append_once(poll(spark, 1, 2, 30), at, path, "1")
    # Written, but its ledger entry is missing: readers do not see it, and the retry replaces it.
    commits.write_batch(poll(spark, 5, 6).withColumn("day", F.to_date("at")), path, "2", ["day"])
    assert rows(commits.read_once(spark, path), "id") == [(1,), (2,), (30,)]
    assert commits.daily_append_once(poll(spark, 7), at, path, "2")
    assert commits.daily_append_once(poll(spark), at, path, "none")
    found = commits.read_once(spark, path)
    assert rows(found, "id") == [(1,), (2,), (30,), (7,)]
    assert found.columns == ["id", "at", "day"] and dict(found.dtypes)["day"] == "date"


def test_batch_ids_and_missing_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    for bad in ("", "a/b", "a b", "é", "a="):
        with pytest.raises(ValueError):
            commits.append_once(poll(spark, 1), path, bad)
    assert commits.read_once(spark, path, "id bigint, at timestamp_ntz").count() == 0
    with pytest.raises(Exception, match="no batch"):
        commits.read_once(spark, path)


# Counts

RUN = (
    "parent_run_id bigint, domain_name string, return_code_text string, hard_sla_status string,"
    " failed_jobs bigint, ert_exceeded_jobs bigint, bsns_sla_status string"
)


def random_run(draw, i):
    state = draw.choice(["SUCCESS", "RUNNING", "FAILED", "CANCELLED"])
    return (i, draw.choice("xyz"), state, draw.choice(["Met", "Missed"]), draw.randint(0, 1), draw.randint(0, 1), draw.choice(["Met", "Missed"]))


def test_counts_follow_random_batches_through_failures(spark, rows, tmp_path, monkeypatch):
    draw = random.Random(8)
    path = str(tmp_path / "t")
    expected = {i: random_run(draw, i) for i in range(60)}
    counts.start_maintained_counts(spark.createDataFrame(list(expected.values()), RUN), path, 8)
    real = {name: getattr(module, name) for module, name in ((bucketed, "replace_buckets"), (commits, "commit_batch"), (commits, "write_batch"))}

    def fails(*_):
        raise RuntimeError("lost")

    for number, broken in enumerate([None, "replace_buckets", "commit_batch", "write_batch"]):
        batch = [random_run(draw, draw.randrange(90)) for _ in range(12)]
        changes = spark.createDataFrame([(seq, *r) for seq, r in enumerate(batch)], f"seq bigint, {RUN}")
        expected.update({r[0]: r for r in batch})
        if broken:
            module = commits if broken != "replace_buckets" else bucketed
            monkeypatch.setattr(module, broken, fails)
            with pytest.raises(RuntimeError):
                counts.change_maintained_counts(spark, path, changes, f"b{number}")
            monkeypatch.setattr(module, broken, real[broken])
        counts.change_maintained_counts(spark, path, changes, f"b{number}")
        counts.change_maintained_counts(spark, path, changes, f"b{number}")
        now = spark.createDataFrame(list(expected.values()), RUN)
        assert rows(counts.maintained_counts(spark, path)) == rows(counts.status_counts(now))


# The error index

INCIDENT = (
    "parent_run_id bigint, job_name string, status string, jira string, service_now string, zoom_link string,"
    " close_code string, root_cause string, error string, ert_alert int, failure_alert int, slamiss_alert int,"
    " created_user string, updated_user string, created_dt timestamp_ntz, updated_dt timestamp_ntz"
)
NOTE = "notes_skey bigint, parent_run_id bigint, job_name string, notes string, updated_user string, updated_dt timestamp_ntz"


def incident(i, error, job):
    return (i, job, "OPEN", None, None, None, None, None, error, 0, 0, 0, "u", "u", T0 + dt.timedelta(minutes=i or 0), T0)


PATTERNS = ["disk full", "Error 1[0-9]+", "time(out| out)", "no|such", "(?:lost) node", "x", "", "absent words|gone", "disk.*node 7$", "é", r"\d\d\d", "DISK|gone node"]


def test_search_with_the_index_equals_search(spark, rows, tmp_path):
    draw = random.Random(2)
    words = ["disk", "full", "Error 12", "error 7", "timeout", "time out", "no such", "lost", "node 7", "é x", "100"]
    data = [incident(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 4))), draw.choice(["a", "b", None])) for i in range(120)]
    data += [incident(200, None, "a"), incident(201, "", "b"), incident(None, "disk full", "c")]
    table = spark.createDataFrame(data, INCIDENT).repartition(4)
    notes = spark.createDataFrame([(1, 5, "a", "n", "u", T0)], NOTE)
    path = str(tmp_path / "t")
    I.store_searchable(table, path, 20)
    for pattern in PATTERNS:
        assert rows(I.error_log_search_indexed(spark, path, notes, pattern)) == rows(I.error_log_search(table, notes, pattern)), pattern
    changes = spark.createDataFrame([(1, 5, "a", "brand new words"), (2, 900, "z", "Error 19")], "seq bigint, parent_run_id bigint, job_name string, error string")
    I.upsert_searchable(spark, path, changes)
    changed = upsert(table, changes, ["parent_run_id", "job_name"])
    for pattern in ("new words", "error 1", "disk full"):
        assert rows(I.error_log_search_indexed(spark, path, notes, pattern)) == rows(I.error_log_search(changed, notes, pattern)), pattern


def test_a_selective_search_reads_few_files(spark, tmp_path):
    table = spark.createDataFrame([incident(i, f"common text {'rare thing' if i == 77 else ''} {i % 5}", "a") for i in range(400)], INCIDENT)
    path = str(tmp_path / "t")
    I.store_searchable(table, path, 25)
    found = {p: I.candidates(spark, path, p) for p in ("rare thing", "text [0-9]$", "not there", "")}
    # One bucket of the records, one of the postings; of a common text all records; of an expression without text no index.
    assert buckets_read(found["rare thing"]) == [1, 1] and found["rare thing"].count() == 1
    assert {None, 25} & set(buckets_read(found["text [0-9]$"])) and buckets_read(found[""]) == [None]
    assert found["not there"].count() == 0 and not [n for n in buckets_read(found["not there"]) if n]


# State


def test_carried_forward(spark):
    draw = random.Random(6)
    data = [(draw.choice(["hot", "hot", "k", None]), i, draw.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(data, "key string, at bigint, v bigint").repartition(5)
    last, expected = {}, {}
    for key, i, v in data:
        last[key] = v if v is not None else last.get(key)
        expected[i] = last[key]
    for width in (1, 30, 10**6):
        assert {r["at"]: r["o"] for r in carried_forward(df, ["key"], "at", "v", "o", width).collect()} == expected


def samples_of(spark, values):
    """values: (host, mount, minutes, used)"""
    rows = [(h, "mount", m, T0 + dt.timedelta(minutes=t) if t is not None else None, float(u), 100.0) for h, m, t, u in values]
    return spark.createDataFrame(rows, "host string, metric string, mount string, ts timestamp_ntz, used double, total double").repartition(3)


def episodes_of(values, gap):
    found = {}
    for h, m, t, u in sorted((v for v in values if v[3] >= 80 and v[2] is not None), key=lambda v: v[2]):
        own = found.setdefault((h, m), [])
        if own and t - own[-1][1] <= gap:
            own[-1] = (own[-1][0], t, max(own[-1][2], u), own[-1][3] + 1)
        else:
            own.append((t, t, u, 1))
    return sorted((h, str(m), s, e, p, n) for (h, m), own in found.items() for s, e, p, n in own)


def minutes(df):
    def at(t):
        return (t - T0).total_seconds() / 60

    return sorted((r["host"], str(r["mount"]), at(r["started_at"]), at(r["last_at"]), r["peak"], r["samples"]) for r in df.collect())


def random_samples(count, seed):
    draw = random.Random(seed)
    # A third of all on one host; moments repeat; some gaps are exactly the limit.
    return [("hot" if draw.random() < 0.34 else f"h{draw.randrange(4)}", draw.choice(["/a", None]), 5 * draw.randrange(3000), draw.randint(70, 99)) for _ in range(count)]


def test_episodes_by_brute_force(spark):
    values = random_samples(1500, 1) + [("h1", "/a", None, 99)]
    for gap in (5, 20, 4000):
        assert minutes(infra.alert_episodes(samples_of(spark, values), gap)) == episodes_of(values, gap)
    assert infra.alert_episodes(samples_of(spark, values).limit(0), 5).count() == 0


def test_episode_stream_out_of_order_and_after_a_restart(spark, tmp_path):
    """Samples up to two hours late and given out of order; episodes appear once, when their gap has passed."""
    source, target, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    values = sorted(random_samples(600, 3), key=lambda v: v[2] + random.Random(v[2]).randrange(120))
    schema = samples_of(spark, values[:1]).schema
    for part in (values[:200], values[200:400], values[400:], [("end", "/a", 20_000, 99)]):
        samples_of(spark, part).write.mode("append").parquet(source)
        polls.alert_episode_stream(polls.snapshot_stream(spark, source, schema), target, checkpoint, 20, "3 hours").awaitTermination()
    assert minutes(spark.read.parquet(target)) == episodes_of(values, 20)


RAW = "event_id bigint, poll_time timestamp_ntz, project string, zone string, body string"


def snapshots(spark, ids):
    body = '{"name":"r%d","specificReservation":{"count":1,"instanceProperties":{}}}'
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=i), "p", "z", body % (i % 3)) for i in ids], RAW)


def test_reservations_count_once_over_triggers_and_restarts(spark, rows, tmp_path):
    source, target, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    # Delivered again at once, in a later file, after a restart, and late but within the delay; 2 comes after the delay.
    for ids in ([0, 1, 1, 5], [5, 6, 3], [30, 4, 6], [90, 30], [2, 91, 90]):
        snapshots(spark, ids).write.mode("append").parquet(source)
        stream = polls.snapshot_stream(spark, source, snapshots(spark, []).schema)
        polls.reservation_stream_distinct(stream, target, checkpoint, "40 hours").awaitTermination()
    assert rows(spark.read.parquet(target), "event_id") == sorted([(i,) for i in (0, 1, 3, 4, 5, 6, 30, 90, 91)], key=lambda t: str(t[0]))

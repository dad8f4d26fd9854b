"""Readers, writers and streams."""

import datetime as dt
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from runlens.plans import logs
from runlens.plans.infra import reservation_flatten
from runlens.sources import tables
from runlens.streaming import polls

RAW = "event_id bigint, poll_time timestamp_ntz, project string, zone string, body string"


def raw(spark, *ids):
    rows = [
        (i, dt.datetime(2024, 1, 15, i % 24), "p", "z", "broken" if i % 5 == 0 else f'{{"name":"r{i}","specificReservation":{{"count":{i},"instanceProperties":{{}}}}}}')
        for i in ids
    ]
    return spark.createDataFrame(rows, RAW)


def test_jdbc_reader_rejects_unclear_input(spark):
    options = {"url": "jdbc:none:", "driver": "none"}
    with pytest.raises(ValueError):
        tables.jdbc_reader(spark, options)
    with pytest.raises(ValueError):
        tables.jdbc_reader(spark, options, table="t", query="SELECT 1")
    with pytest.raises(ValueError):
        tables.jdbc_reader(spark, options, query="SELECT 1", partition=("id", 0, 10, 2))
    assert tables.jdbc_reader(spark, options, table="t", partition=("id", 0, 10, 2)) is not None


class Cluster:
    """Just enough of a session on a cluster: its settings and its master."""

    def __init__(self, settings):
        self.conf = self.sparkContext = self
        self.settings, self.master = settings, "yarn"

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def getConf(self):
        return self


def test_work_dir_lies_in_the_shared_folder():
    cluster = Cluster({tables.WORK_DIR_SETTING: "hdfs://shared/checkpoints/"})
    first, second = tables.work_dir(cluster, "x"), tables.work_dir(cluster, "x")
    assert first.startswith("hdfs://shared/checkpoints/x-") and first != second


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        tables.work_dir(Cluster({}), "x")


def test_daily_append(spark, tmp_path, rows):
    path = f"{tmp_path}/table"
    for ids in ([1, 2, 7], [8, 9]):
        tables.daily_partition_append(reservation_flatten(raw(spark, *ids)), F.col("poll_time"), path)
    found = spark.read.parquet(path)
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("day")) == ["day=2024-01-14", "day=2024-01-15"]
    assert rows(found, "event_id") == [(1,), (2,), (7,), (8,), (9,)]
    plan = found.filter("day = '2024-01-14'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_log_files(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "4096")
    try:
        lines = logs.numbered_lines(tables.read_log_files(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set(setting, before)
    assert sorted((r["line_no"], r["line"]) for r in lines if r["path"].endswith("a.txt")) == [(1, "one"), (2, "two")]
    assert sorted((r["line_no"], r["line"]) for r in lines if r["path"].endswith("b.txt")) == [(i + 1, f"line {i}") for i in range(5000)]


def test_reservation_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path, rows):
    source, target, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    columns = ["event_id", "reservation_name", "res_cnt"]
    for ids in (range(0, 20), range(20, 30)):
        raw(spark, *ids).write.mode("append").parquet(source)
        stream = polls.snapshot_stream(spark, source, spark.read.parquet(source).schema)
        polls.reservation_stream(stream, target, checkpoint).awaitTermination()
        batch = reservation_flatten(spark.read.parquet(source))
        assert rows(spark.read.parquet(target), *columns) == rows(batch, *columns)


def test_alert_stream_equals_batch(spark, tmp_path, rows):
    source, target, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    samples = spark.createDataFrame(
        [(i, f"h{i % 3}", "cpu", dt.datetime(2024, 1, 15), float(i), 100.0) for i in range(100)],
        "event_id bigint, host string, metric string, ts timestamp_ntz, used double, total double",
    )
    samples.write.parquet(source)
    stream = polls.snapshot_stream(spark, source, samples.schema)
    polls.host_alert_stream(stream, target, checkpoint).awaitTermination()
    found = spark.read.parquet(target)
    assert found.count() == 20 and rows(found, "event_id", "pct") == rows(polls.host_alerts(samples), "event_id", "pct")


def test_scratch_drops_the_work_folders_made_inside(spark):
    outside = tables.work_dir(spark, "kept")
    spark.range(1).write.parquet(outside)
    with tables.scratch(spark) as made:
        inner = tables.written(spark.range(3), "inner")
        with tables.scratch(spark):
            tables.written(spark.range(3), "innermost")
        assert inner.count() == 3 and len(made) == 2
    assert Path(outside).exists() and not any(Path(folder).exists() for folder in made)


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        conf = SimpleNamespace(get=lambda *_: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            tables.work_dir(session(master), "x")
    for master in ("local", "local[*]", "local[8]"):
        assert tables.work_dir(session(master), "x")

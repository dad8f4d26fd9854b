"""Clusters, hosts, reservations, files: thresholds and parsing."""

import datetime as dt

from pyspark.sql import functions as F

from runlens.plans import infra

AS_OF = "2024-01-15 17:00:00"
NOW = dt.datetime(2024, 1, 15, 17)


def test_clusters(spark, rows):
    ages = [("eph-1", 7260), ("eph-2", 7259), ("eph-3", 90000), ("phs-1", 90000), ("x-persistent", 90000)]
    states = spark.createDataFrame(
        [("p", name, "RUNNING", NOW - dt.timedelta(seconds=s)) for name, s in ages] + [("p", "eph-9", "STOPPED", NOW - dt.timedelta(days=9))],
        "project string, cluster_name string, status string, state_start_time timestamp_ntz",
    )
    assert rows(infra.long_running_clusters(states, AS_OF, 120), "cluster_name", "minutes") == [("eph-1", 121), ("eph-3", 1500)]
    assert rows(infra.long_running_clusters(states, AS_OF, 121), "cluster_name") == [("eph-3",)]
    assert rows(infra.long_runner_count(states, AS_OF, 99999)) == [(0, True)]
    listed = infra.cluster_uptime_list(states, AS_OF).orderBy("number").collect()
    assert [r["text"] for r in listed] == [
        f"[{n}] {name} Cluster is running since last :- {dt.timedelta(seconds=s)}"
        for n, (name, s) in enumerate((ages[2], ages[0], ages[1]), 1)
    ]


def test_clusters_without_a_project_are_numbered(spark, rows):
    states = spark.createDataFrame(
        [(p, f"eph-{i}", "RUNNING", NOW - dt.timedelta(hours=i)) for i, p in enumerate([None, "p", None])],
        "project string, cluster_name string, status string, state_start_time timestamp_ntz",
    )
    found = infra.cluster_uptime_list(states, AS_OF)
    assert rows(found, "cluster_name", "project", "number") == [("eph-0", None, 2), ("eph-1", "p", 1), ("eph-2", None, 1)]


def metrics(spark, *values):
    rows = [(i, h, m, mount, NOW + dt.timedelta(minutes=t), float(u), 100.0) for i, (h, m, mount, t, u) in enumerate(values)]
    rows.append((99, "d", "disk", "/", NOW, 5.0, 0.0))
    return spark.createDataFrame(rows, "event_id bigint, host string, metric string, mount string, ts timestamp_ntz, used double, total double")


def test_hosts(spark, rows):
    table = metrics(
        spark,
        *[("a", "memory", None, 0, 99), ("a", "memory", None, 1, 79.99), ("a", "cpu", None, 0, 80), ("b", "disk", "/", 0, 79)],
        *[("c", "mount", "/x", 0, 95), ("c", "mount", "/y", 9, 5), ("c", "memory", None, 0, 85)],
    )
    old, new = NOW - dt.timedelta(hours=1), NOW
    polls = [(h, i, new, float(i), float(30 - i), f"cmd{i}") for h in "abc" for i in range(30)]
    # The same process was larger in earlier polls.
    polls += [(h, 3, old - dt.timedelta(hours=n), 99.0, 99.0, "cmd3") for h in "abc" for n in range(2)]
    samples = spark.createDataFrame(polls, "host string, pid bigint, ts timestamp_ntz, pct_mem double, pct_cpu double, cmd string")
    usage = infra.latest_usage(table)
    assert rows(usage.filter("host = 'a'"), "metric", "pct") == [("cpu", 80), ("memory", 79)]
    assert rows(usage.filter("host = 'd'"), "pct") == [(None,)]
    assert rows(usage.filter("metric = 'mount'"), "mount", "pct") == [("/x", 95), ("/y", 5)]
    assert rows(infra.host_any_alert(usage)) == [("a", True), ("b", False), ("c", True), ("d", False)]
    top = infra.top20_memory(samples, usage).orderBy("place").collect()
    assert [r["pid"] for r in top] == list(range(29, 9, -1)) and {r["host"] for r in top} == {"c"}
    assert {r["host"] for r in infra.top20_cpu(samples, usage).collect()} == {"a"}
    health = {r["host"]: r for r in infra.host_health(table, samples).collect()}
    assert (health["a"]["cpu_top_pid"], health["a"]["mem_top_pid"], health["a"]["breached"]) == (0, None, 1)
    assert health["b"]["alert"] is False and health["c"]["mount_pct"] == 95 and health["c"]["mounts"] == "/x 95%\n/y 5%"
    directories = spark.createDataFrame(
        [("c", "/x", "/x/a", "1K"), ("c", "/x", "/x/b", "2G"), ("c", "/y", "/y/a", "9G"), ("b", "/", "/z", "1G")], "host string, mount string, path string, size_text string"
    )
    messages = {r["host"]: r["message"] for r in infra.host_health_report(table, samples, directories).collect()}
    assert messages.keys() == {"a", "c"} and "disk NA%" in messages["a"] and "29 cmd29\n28 cmd28" in messages["c"]
    assert messages["c"].endswith("largest directories:\n2G /x/b\n1K /x/a")


def test_sizes(spark):
    texts = {"512": 512, "4.0K": 4096, "1.5M": 1572864, "2G": 2 * 1024**3, "1T": 1024**4, "-": None, "": None, "1.2.3K": None}
    df = spark.createDataFrame([("h", "m", t, t) for t in texts], "host string, mount string, path string, size_text string")
    assert {r["size_text"]: r["size_bytes"] for r in df.withColumn("size_bytes", infra.size_in_bytes("size_text")).collect()} == texts
    usage = spark.createDataFrame([("h", "mount", "m", 80)], "host string, metric string, mount string, pct bigint")
    assert [r["path"] for r in infra.top20_disk(df, usage, count=2).orderBy("place").collect()] == ["1T", "2G"]
    assert infra.top20_disk(df, usage, limit=81).count() == 0


def test_reservations(spark, rows):
    good = '{"name":"r,1","specificReservation":{"count":5,"instanceProperties":{}},"extra":[1]}'
    raw = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 15, 5, 59, 59, 999999), "p", "z", good), (2, NOW, "p", "z", "Some Error"), (3, NOW, "p", "z", None), (4, NOW, "p", "z", "{}"),
         (5, NOW, "p", "z", '{"name":"only a name"}'), (6, NOW, "p", "z", '{"specificReservation":{"instanceProperties":{"machineType":"m"}}}')],
        "event_id bigint, poll_time timestamp_ntz, project string, zone string, body string",
    )
    assert rows(infra.reservation_flatten(raw), "event_id", "reservation_name", "res_cnt", "in_use_count", "machine_type") == [
        (1, "r,1", 5, None, None), (6, None, None, None, "m"),
    ]
    assert rows(infra.reservation_rejects(raw), "event_id") == [(2,), (3,), (4,), (5,)]
    stored = infra.reservation_usage(raw)
    assert rows(infra.csv_row_split(infra.csv_row_text(stored))) == rows(stored.drop("day"))
    (usage,) = stored.filter("event_id = 1").collect()
    assert (usage["curr_time_cst"], str(usage["day"])) == ("2024-01-14 23:59:59", "2024-01-14")


def test_short_comma_rows(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, "t,c,r,n,m,z,1,x,3,p")], "event_id bigint, row string")
    found = {r["event_id"]: r for r in infra.csv_row_split(df).collect()}
    assert (found[2]["zne"], found[2]["res_cnt"], found[2]["in_use_count"], found[2]["assured_count"]) == ("z", 1, None, 3)
    assert (found[1]["teams_space"], found[1]["curr_time_cst"], found[1]["res_timestamp"], found[1]["res_cnt"]) == ("a", "b", None, None)


def test_files(spark, rows):
    day = 86400
    ages = [("svc1", 30 * day), ("svc2", 31 * day - 1), ("svc3", 31 * day), ("user", 400 * day)]
    listing = spark.createDataFrame(
        [(o, o, NOW - dt.timedelta(seconds=s), 1) for o, s in ages], "path string, owner string, mtime timestamp_ntz, bytes bigint"
    )
    assert rows(infra.expired_files(listing, AS_OF), "path") == [("svc3",)]
    assert rows(infra.expired_files(listing, AS_OF, 30, None), "path") == [("svc3",), ("user",)]
    assert rows(listing.filter(infra.modified_within(AS_OF, 31)), "path") == [("svc1",), ("svc2",)]


def test_percent_is_cut_off(spark):
    df = spark.createDataFrame([(7999.0, 10000.0), (8000.0, 10000.0), (1.0, 0.0)], "u double, t double")
    assert [r[0] for r in df.select(infra.usage_percent(F.col("u"), F.col("t"))).collect()] == [79, 80, None]

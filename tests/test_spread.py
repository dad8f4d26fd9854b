"""Operators that split large keys, against brute force on data where one key holds a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators.latest import keep_first, keep_latest
from runlens.operators.spread import (
    STAND_INS,
    first_seen,
    join_groups,
    left_join_spread,
    nest_rows,
    number_rows,
    ordered_parts,
    previous_value,
    with_group_size,
)


@pytest.fixture(scope="module")
def skewed():
    pick = random.Random(7)
    keys = ["hot" if pick.random() < 0.34 else f"k{pick.randrange(40)}" for _ in range(3000)]
    return [(key, i, pick.randrange(400) if pick.random() < 0.97 else None, pick.choice("abc")) for i, key in enumerate(keys)]


@pytest.fixture(scope="module")
def table(spark, skewed):
    return spark.createDataFrame(skewed, "key string, id bigint, at bigint, word string").repartition(7)


@pytest.mark.parametrize("descending", [False, True])
def test_number_rows(table, skewed, rows, descending):
    order = [F.desc("at") if descending else F.asc("at"), F.asc("id")]
    numbered = number_rows(table, ["key"], order, "n")
    expected = []
    for key in {r[0] for r in skewed}:
        own = [r for r in skewed if r[0] == key]
        if descending:
            own.sort(key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        else:
            own.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        expected += [(r[1], n) for n, r in enumerate(own, 1)]
    assert sorted(rows(numbered, "id", "n")) == sorted(expected)


@pytest.mark.parametrize("at", [5, None])
def test_number_rows_spreads_one_moment(spark, at):
    """A third of all rows in one key at one moment, or without a time, lie in several parts."""
    data = [("hot", at if i % 3 == 0 else i, i) for i in range(3000)]
    df = spark.createDataFrame(data, "key string, at bigint, id bigint").repartition(5)
    order = [F.asc("at"), F.asc("id")]
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # it joins parts as small as these
    spark.conf.set(setting, "false")
    try:
        sizes = [r["count"] for r in ordered_parts(df, ["key"], order).groupBy("_part").count().collect()]
        got = {r["id"]: r["n"] for r in number_rows(df, ["key"], order, "n").collect()}
    finally:
        spark.conf.set(setting, "true")
    assert len(sizes) > 1 and max(sizes) < 2000
    ordered = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert got == {r[2]: n for n, r in enumerate(ordered, 1)}


@pytest.mark.parametrize("width", [1, 50, 100_000])
def test_previous_value(table, skewed, width):
    found = {r["id"]: r["before"] for r in previous_value(table, ["key"], "id", "word", "before", width).collect()}
    last, expected = {}, {}
    for key, i, _, word in skewed:
        expected[i] = last.get(key)
        last[key] = word
    assert found == expected


def test_left_join_spread_equals_left_join(spark, table, rows):
    left = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k1", 3), ("absent", 4), (None, 5), ("k2", 6)], "key string, mark int"
    )
    plain = left.join(table, ["key"], "left")
    assert rows(left_join_spread(left, table, ["key"]), *plain.columns) == rows(plain)


def test_left_join_spread_counts_with_a_cheaper_input(spark, table, rows):
    left = spark.createDataFrame([("hot", 1), ("absent", 2)], "key string, mark int")
    newest = keep_latest(table, ["key", "word"], [F.desc("at"), F.desc("id")])
    joined = left_join_spread(left, newest, ["key"], "total", table)
    hot = table.filter("key = 'hot'").count()
    assert rows(joined.select("key", "word", "total")) == [
        ("absent", None, None), ("hot", "a", hot), ("hot", "b", hot), ("hot", "c", hot),
    ]


def test_left_join_spread_of_many_unmatched_rows(spark, rows):
    """Each stays once, whatever repeats in it; NULL keys match nothing; the right side may be empty."""
    left = spark.range(3 * STAND_INS).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("a"), (F.col("id") % 5).cast("string").alias("b"), F.lit(None).cast("int").alias("c"))
    left = left.unionByName(left)
    right = spark.createDataFrame([(0, "0", "x"), (0, "0", "y"), (None, "0", "z"), (3, None, "z"), (6, "1", None)], "a bigint, b string, word string")
    for other in (right, right.limit(0)):
        plain = left.join(other, ["a", "b"], "left")
        assert rows(left_join_spread(left, other, ["a", "b"]), *plain.columns) == rows(plain)
    assert left_join_spread(left.limit(0), right, ["a", "b"]).count() == 0


def test_left_join_spread_reads_its_left_side_once(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "left"))
    spark.range(5).write.parquet(str(tmp_path / "right"))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in ("left", "right"))
    plan = plan_of(left_join_spread(left, right, ["id"]))
    assert plan.count("FileScan parquet") == 3


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_groups_equals_plain_join(spark, table, rows, how):
    left = table.unionByName(spark.createDataFrame([(None, -1, None, "a")], table.schema))
    groups = spark.createDataFrame([("hot", 1), ("k3", 2), (None, 3)], "key string, mark int")
    plain = left.join(groups, ["key"], how)
    assert rows(join_groups(left, groups, ["key"], how), *plain.columns) == rows(plain)


@pytest.mark.parametrize("page_size", [7, 200, 20_000])
def test_nested_pages_follow_the_items(table, skewed, page_size):
    header, item = [F.col("word")], [F.col("id"), F.col("word")]
    nested = nest_rows(table, ["key"], header, item, "items", page_size, [F.negative("id")])
    by_key = {}
    for page in sorted(nested.collect(), key=lambda p: p["page"]):
        by_key.setdefault(page["key"], []).append(page)
    for key, pages in by_key.items():
        own = [r for r in skewed if r[0] == key]
        assert [p["page"] for p in pages] == list(range(-(-len(own) // page_size)))
        assert [i["id"] for p in pages for i in p["items"]] == [r[1] for r in own]
        assert all(len(p["items"]) == page_size for p in pages[:-1])
        # The header is the key's first row by the given order, here its newest.
        assert {p["word"] for p in pages} == {own[-1][3]}
    assert sum(len(p) for p in by_key.values()) >= len({r[0] for r in skewed})


def test_null_is_a_key_of_its_own(spark, rows):
    """Numbering, nesting and comparing keep the rows of NULL keys together."""
    data = [(None, "a", 1), (None, "a", 2), (None, None, 3), ("k", "a", 4), ("k", None, 5), ("k", None, 6)]
    df = spark.createDataFrame(data, "x string, y string, id bigint").repartition(3)
    numbered = number_rows(df, ["x", "y"], [F.asc("id")], "n")
    assert [r[0] for r in sorted(rows(numbered, "n", "id"), key=lambda r: r[1])] == [1, 2, 1, 1, 1, 2]
    before = previous_value(df, ["x", "y"], "id", "id", "before", 2)
    assert [r[1] for r in sorted(rows(before, "id", "before"))] == [None, 1, None, None, None, 5]
    for page_size in (1, 20):
        nested = nest_rows(df, ["x", "y"], [F.col("id")], [F.col("id").alias("i")], "items", page_size).collect()
        assert sorted(i["i"] for r in nested for i in r["items"]) == [1, 2, 3, 4, 5, 6]
        assert len(nested) == (6 if page_size == 1 else 4)


def test_large_and_small_keys_nest_alike(table, rows):
    """Keys of several pages and of one, in one table and apart."""
    item = [F.col("id"), F.col("word")]
    whole = nest_rows(table, ["key"], [F.col("word")], item, "items", 60)
    hot = nest_rows(table.filter("key = 'hot'"), ["key"], [F.col("word")], item, "items", 60)
    rest = nest_rows(table.filter("key <> 'hot'"), ["key"], [F.col("word")], item, "items", 60)
    assert whole.filter("page > 0").count() and rows(whole) == rows(hot.unionByName(rest))


def test_equal_items_are_cut_into_pages(spark):
    copies = spark.range(1000).select(F.lit("k").alias("key"), F.lit("same").alias("text"))
    nested = nest_rows(copies, ["key"], [F.col("text")], [F.col("text")], "items", 100)
    assert [len(r["items"]) for r in nested.collect()] == [100] * 10


def test_keep_latest_ties(spark, rows):
    table = spark.createDataFrame([("a", 2, 1), ("a", 2, 2), ("a", 1, 3), ("b", 5, 4)], "key string, at int, id int")
    assert rows(keep_latest(table, ["key"], [F.desc("at")], ties=True), "id") == [(1,), (2,), (4,)]
    assert rows(keep_latest(table, ["key"], [F.desc("at"), F.desc("id")]), "id") == [(2,), (4,)]


def test_keep_first(table, skewed):
    top = keep_first(table, ["key"], [F.desc("id")], 3, "place").collect()
    for key in {r[0] for r in skewed}:
        expected = sorted((r[1] for r in skewed if r[0] == key), reverse=True)[:3]
        assert sorted((r["id"] for r in top if r["key"] == key), reverse=True) == expected


def test_first_seen(table, skewed):
    found = {(r["key"], r["word"]): r["first"]["id"] for r in first_seen(table, ["key", "word"], ["id"], "first").collect()}
    expected = {}
    for key, i, _, word in skewed:
        expected.setdefault((key, word), i)
    assert found == expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_is_limited_before_the_shuffle(table):
    for ties in (True, False):
        plan = plan_of(keep_latest(table, ["key"], [F.desc("id")], ties))
        assert "1, Partial" in plan and "1, Final" in plan


def test_large_keys_are_split_in_joins(spark, rows):
    """With thresholds scaled down to this data, adaptive execution must find joins it can split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500))
        big = spark.range(0, 60_000, 1, 8).select(key.alias("key"), "id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
        big.write.mode("overwrite").format("noop").save()
        left = big.select("key").distinct().withColumn("mark", F.lit(1))

        def final_plan(df):
            count = df.count()
            df.collect()
            return count, df._jdf.queryExecution().executedPlan().toString()

        for joined in (left_join_spread(left, big, ["key"]), with_group_size(big, ["key"], "n")):
            count, plan = final_plan(joined)
            assert count == 60_000 and "skew=true" in plan
        nested = nest_rows(big, ["key"], [F.lit(1).alias("one")], [F.col("id"), F.col("text")], "items", 1000)
        assert max(len(r["items"]) for r in nested.collect()) == 1000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

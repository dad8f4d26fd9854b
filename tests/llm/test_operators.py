"""The text operators on edge rows and against brute force.

``ODD`` holds NULLs in every column, empty and long texts, equal and near-equal texts, a row given
twice, and columns whose names clash with those the operators add.
"""

import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import (
    components,
    decontamination,
    extraction,
    licences,
    linededup,
    mixing,
    quality_cnn,
    quality_rules,
    revisits,
    simhash,
    suffixdedup,
)
from runlens.llm.common import sized
from runlens.llm.queries import CHECKS, QUERIES
from runlens.llm.suffixsort import deep_shallow

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_lines string, copies int, place int"

_draw = random.Random(3)
VOCABULARY = ["".join(_draw.choice("abcdeé") for _ in range(_draw.randint(1, 7))) for _ in range(300)]


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(VOCABULARY) for _ in range(words))


LONG = prose(1, 20_000)
SHARED = prose(2, 60)
ODD = [
    (1, prose(3, 80) + "\nShared Line\n" + SHARED, "en", "a", 5, 0.5, "x", 1, 1),
    (2, prose(4, 90) + "\n shared line \n" + SHARED, "en", "a", 5, 0.5, "x", 1, 1),
    (3, prose(3, 80) + "\nShared Line\n" + SHARED, None, None, None, None, None, None, None),
    (4, None, "en", None, 5, 0.5, "x", 1, 1),
    (5, "", "en", "b", 5, 0.5, "x", 1, 1),
    (6, " \t\n\x0b ", "en", "b", 5, 0.5, "x", 1, 1),
    (7, LONG, "en", "c", 5, 0.5, "x", 1, 1),
    (8, LONG + " end", "en", "c", 5, 0.5, "x", 1, 1),
    (9, "One two\n\nSHARED LINE\none two", "en", "d", 5, 0.5, "x", 1, 1),
    (9, "One two\n\nSHARED LINE\none two", "en", "d", 5, 0.5, "x", 1, 1),
    (None, SHARED + " éß\U0001f600", None, "d", 5, 0.5, "x", 1, 1),
    (11, "ab" * 400 + "\x00", "en", "", 5, 0.5, "x", 1, 1),
]
TEXTS = {r[0]: r[1] or "" for r in ODD}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, sql):
    engine = duckdb.connect()
    for table in TABLES:
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = engine.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    found = sorted(str(tuple(r[n] for n in names)) for r in df.collect())
    assert found == sorted(str(r) for r in result.fetchall())


@pytest.mark.parametrize("name", CHECKS)
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), CHECKS[name])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_decontamination", "op7_line_dedup"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# 1 suffix-array dedup


def repeats(rows, length):
    """By brute force: (bytes, removed, spans, hash) for each id."""
    seen, result = {}, {}
    for doc, text in sorted(rows):
        for at in range(len(text) - length + 1):
            seen.setdefault(text[at : at + length], (doc, at))
    for doc, text in rows:
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            if seen[text[at : at + length]] < (doc, at):
                gone[at : at + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        result[doc] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return result


@pytest.mark.parametrize("settings", [{}, {"hot": 1, "chunk": 40}, {"hot": 2, "pieces": 5}])
def test_repeats_by_brute_force(spark, odd, settings):
    given = [(suffixdedup.NO_ID if r[0] is None else r[0], (r[1] or "").encode()) for r in dict((x[0], x) for x in ODD).values()]
    expected = repeats(given, 100)
    found = suffixdedup.drop_repeats(odd, **settings).collect()
    assert len(found) == len(ODD)
    for r in found:
        assert (r[1], r[2], r[3], r[4], bytes(r[5])) == expected[suffixdedup.NO_ID if r[0] is None else r[0]]


def test_repeats_of_short_strings(spark):
    pick = random.Random(5)
    rows = [(i, "".join(pick.choice("ab") for _ in range(pick.randint(0, 300)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r[0]: (r[1], r[2], r[3], r[4], bytes(r[5])) for r in suffixdedup.drop_repeats(df, length=12, gram=8, hot=20, chunk=100).collect()}
    assert found == repeats([(d, t.encode()) for d, t in rows], 12)


def test_repeats_of_nothing(nothing):
    assert suffixdedup.drop_repeats(nothing).count() == 0


@pytest.mark.parametrize("letters", [2, 250])
def test_deep_shallow_sorts(letters):
    draw = np.random.default_rng(letters)
    strings = draw.integers(0, letters, (400, 60)).astype(np.uint8)
    strings[50:200] = strings[0]
    strings[60:200, 55:] = draw.integers(0, letters, (140, 5))
    strings[100:150, 20:] = draw.integers(0, letters, (50, 40))
    group = np.sort(draw.integers(0, 5, 400))
    order, common = deep_shallow(group, strings, shallow=16)
    ordered = [(group[i], strings[i].tobytes()) for i in order]
    assert ordered == sorted(ordered) and sorted(order) == list(range(400))
    for i in range(1, 400):
        a, b = ordered[i - 1], ordered[i]
        shared = next((n for n, (x, y) in enumerate(zip(a[1], b[1], strict=True)) if x != y), 60)
        assert common[i] == (shared if a[0] == b[0] else -1)


# 2 benchmark decontamination

QUESTION = "Yesterday, John Smith had 12 apples and gave 5.5 kg of them to Mary, so how many apples does John have left now?"


def test_leaks(spark):
    docs = [
        (1, f"Before that. {QUESTION} And after."),
        (2, "Yesterday, Anna Miller had 30 apples and gave 7 kg of them to Tom, so how many apples does Anna have left now?"),
        (3, "Yesterday, Anna Miller had 30 apples and gave 7 kg of them to Tom, so how many apples does Bob have left now?"),
        (4, QUESTION.lower()),
        (5, "gave them to nobody so how many apples are there"),
        (6, None),
        (7, ""),
        (None, QUESTION.upper()),
        (1, f"Before that. {QUESTION} And after."),
        (8, LONG),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, QUESTION), (1, QUESTION), (2, None), (3, "too short"), (None, "")], "item_id bigint, text string")
    found = {r["doc_id"]: r for r in decontamination.leaks(df, items).collect()}
    assert found.keys() == {1, 2, 4, None}
    assert found[2]["reparameterised"] and not found[1]["reparameterised"]
    kept = decontamination.drop_leaks(df, items)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.collect()) == [3, 5, 6, 7, 8]
    assert decontamination.leaks(df.limit(0), items).count() == 0 and decontamination.leaks(df, items.limit(0)).count() == 0


def leaked(spark, docs, items):
    """(doc_id, item_id) -> the row of ``leaks``."""
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = decontamination.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in found}) == len(found)
    return {(r["doc_id"], r["item_id"]): r for r in found}


def test_leaks_of_items_with_few_ordinary_words(spark):
    sums = "12 plus 30 is 42 and 7 times 8 is 56 or 9 less 3 is 6"
    scores = "10 20 30 40 50 60 70 80 90 100"
    usable = "what is the sum of all these numbers here 1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    docs = [
        (1, f"Before. {sums} After."),
        (2, f"Table: {scores}."),
        (3, "10 20 30 40 50 60 70 80 90 101"),
        (4, "he asked what is the sum of all these numbers here 77 of them"),
        (5, usable),
    ]
    found = leaked(spark, docs, [(1, sums), (2, scores), (3, usable)])
    assert found.keys() == {(1, 1), (2, 2), (5, 3)}
    assert {k: (r["n_matched"], r["n_windows"]) for k, r in found.items()} == {(1, 1): (10, 10), (2, 2): (3, 3), (5, 3): (16, 16)}


def test_leaks_within_a_sentence(spark):
    asked = "Which planet has the most moons of all known ones"
    docs = [
        (1, f"and then, as they ask {asked}, nobody answers"),
        (2, f"they ask: {asked}?"),
        (3, "as they ask Which planet has the most rings of all known ones"),
        (4, "so they ask, Anna sold all 30 of her red apples to us"),
        (5, "so they ask, Anna sold all 30 of her red apples to Tom"),
        (6, "so they ask, Mary sold all 12 of her red apples to us"),
    ]
    found = leaked(spark, docs, [(1, asked), (2, "  Mary sold all 12 of her red apples to us")])
    assert {k: (r["n_matched"], r["reparameterised"]) for k, r in found.items()} == {
        (1, 1): (3, False),
        (2, 1): (3, False),
        (4, 2): (3, True),
        (6, 2): (3, False),
    }


def test_leaks_with_one_edited_value(spark):
    """By one of two mentions edited, a copy of the rest is still a leak; a rewritten one with two names for one is not."""
    asked = (
        "Long ago, John Smith had many apples and pears and plums in the big old house by the river and gave all of them away"
        " to the poor people of the town, so how much did John keep"
    )
    docs = [
        (1, asked.replace("John keep", "Bob keep")),
        (2, asked.replace("John", "Anna").replace("Anna keep", "Bob keep")),
        (3, asked.replace("John", "Anna")),
        (4, "x " + " ".join(asked.replace("John keep", "Bob keep").split()[-14:])),
    ]
    found = leaked(spark, docs, [(1, asked)])
    assert {k[0]: r["reparameterised"] for k, r in found.items()} == {1: False, 2: False, 3: True, 4: True}
    assert found[1, 1]["n_matched"] < found[3, 1]["n_matched"]


def test_marks(spark):
    df = spark.createDataFrame([("In 2024, the Greens ran 10km, not 5 miles. Then John said 3.5",)], "text string")
    marks = decontamination.with_marked(df).first()["marked"]
    assert marks == "in \x012024 the \x03greens ran \x0110 \x02km not \x015 \x02miles then \x03john said \x013_5"


# 3 revisits


def test_revisits(spark):
    head = {"etag": '"a"', "content-type": "text/html", "date": "1"}
    rows = [
        (1, "response", "http://www.A.com:80/x/?b=2&a=1&utm_source=q#f", 1, 200, head, "d1"),
        (2, "revisit", "https://a.com/x?a=1&b=2", 2, 304, {"etag": 'W/"a"', "date": "2", "content-length": "0"}, None),
        (3, "revisit", "https://a.com/x?a=1&b=2", 0, 304, {"etag": '"a"'}, None),
        (4, "revisit", "https://a.com/x?a=1&b=2", 3, 304, {"etag": '"b"'}, "d1"),
        (5, "revisit", "https://a.com/x?a=1&b=2", 3, 304, None, "d1"),
        (6, "revisit", "https://a.com/x?a=1&b=2", 3, 304, None, None),
        (7, "revisit", None, 3, 304, head, "d1"),
        (8, "response", "https://a.com/x?a=1&b=2", 2, 404, {"etag": '"z"'}, "d9"),
        (9, "revisit", "no url", None, 304, head, "d1"),
        (5, "revisit", "https://a.com/x?a=1&b=2", 3, 304, None, "d1"),
        (None, None, None, None, None, None, None),
    ]
    schema = "record_id bigint, kind string, url string, ts bigint, status int, headers map<string,string>, digest string"
    df = spark.createDataFrame(rows, schema).withColumn("_part", F.lit(1)).withColumn("url_key", F.lit("clash"))
    found = revisits.resolve_revisits(df).collect()
    verdicts = {r["record_id"]: r["verdict"] for r in found}
    assert len(found) == 8
    assert verdicts == {2: "resolved", 3: "no_response", 4: "mismatch", 5: "resolved", 6: "no_validator", 7: "no_response", 9: "no_response"}
    merged = next(r for r in found if r["record_id"] == 2)
    assert merged["response_id"] == 1 and merged["headers"] == {"etag": 'W/"a"', "content-type": "text/html", "date": "2"}
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_of_one_url(spark):
    """A URL with all rows, over many parts, against a loop."""
    pick = random.Random(9)
    rows = [(i, pick.choice(["response", "revisit"]), "http://h.com/", pick.randrange(300), 200, {"etag": str(i)}, "d") for i in range(2000)]
    schema = "record_id bigint, kind string, url string, ts bigint, status int, headers map<string,string>, digest string"
    df = spark.createDataFrame(rows, schema).withColumn("headers", F.lit(None).cast("map<string,string>")).repartition(6)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        found = {r["record_id"]: r["response_id"] for r in revisits.resolve_revisits(df).collect()}
    finally:
        spark.conf.set(setting, "true")
    last, expected = None, {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        if r[1] == "response":
            last = r[0]
        else:
            expected[r[0]] = last
    assert found == expected


# 4 mixing


def test_targets_by_resharing(spark):
    pick = random.Random(1)
    for trial in range(4):
        sizes = {f"s{i}": pick.choice([0, 1, 10, 500, 4000]) for i in range(pick.randint(1, 9))} | ({None: 7} if trial % 2 else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
        found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        capped, total = set(), sum(sizes.values())
        while True:
            free = [s for s in names if s not in capped]
            rest = total - sum(3 * sizes[s] for s in capped)
            target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
            above = {s for s in free if target[s] > 3 * sizes[s]}
            if not above:
                break
            capped |= above
        assert found == pytest.approx(target)


def test_mix(odd, nothing):
    plan = mixing.mix_plan(odd).collect()
    assert len(plan) == len(ODD)
    for r in plan:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
    emitted = mixing.mix(odd)
    assert emitted.columns == [*odd.columns, "copy_no"]
    assert emitted.count() == sum(r["copies"] for r in plan)
    assert sorted(map(str, mixing.mix_plan(odd).collect())) == sorted(map(str, plan))
    assert mixing.mix(nothing).count() == 0 and mixing.mix_plan(nothing).count() == 0


# 5 simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in TEXTS.values():
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_links_and_components(spark):
    pick = random.Random(4)
    prints = {0, 2**64 - 1}
    for _ in range(40):
        seed = pick.getrandbits(64)
        for _ in range(6):
            value = seed
            for _ in range(pick.randint(0, 5)):
                value ^= 1 << pick.randrange(64)
            prints.add(value)
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = simhash.links(df).collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_links_are_not_broadcast(spark):
    # Their index has 64 rows for each fingerprint, but Spark takes it to be about as large as these.
    pick = random.Random(5)
    seeds = [pick.getrandbits(63) for _ in range(500)]
    rows = spark.createDataFrame([(p,) for s in seeds for p in (s, s ^ 5 << pick.randrange(60))], "fp bigint")
    found = simhash.links(rows.groupBy("fp").agg(F.count("fp")).select("fp"))
    assert len(found.collect()) >= 500
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates(odd, nothing):
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert len(found) == len(TEXTS)
    assert found[3] == found[1] == 1 and found[8] == found[7] == 7 and found[4] == found[5] == found[6] == 4
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "4", "7", "9", "9", "11", "None"])
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_near_dedup_broadcasts_no_index(spark, monkeypatch):
    plans = []

    def noted(df):
        done = df.localCheckpoint()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(simhash, "checkpointed", noted)
    rows = [(i, prose(i // 2, 40), "en", "a", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(0, 300, 2))
    (pairs,) = [p for p in plans if "Generate explode" in p]
    assert "SortMergeJoin" in pairs and "Broadcast" not in pairs


def test_a_measured_table_is_not_broadcast_beyond_its_limit(spark):
    few, many = spark.range(50), spark.range(100).select("id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("n"))
    for limit, join in ((1 << 20, "BroadcastHashJoin"), (1 << 10, "SortMergeJoin")):
        met = few.join(sized(many, limit), "id", "left")
        assert len(met.collect()) == 2500
        assert join in met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


# 6 quality classifier

QUICK = quality_cnn.Training(max_docs=300, epochs=3, min_steps=250)


def test_chunks_cover_a_text():
    for size in (0, 1, 511, 512, 513, 896, 897, 5000):
        data = bytes(1 + i % 250 for i in range(size))
        rows = quality_cnn.chunks(data)
        rebuilt = b"".join(r[: quality_cnn.STEP].tobytes() for r in rows[:-1]) + rows[-1].tobytes()
        assert rebuilt[:size] == data and not any(rebuilt[size:])


def test_gradients():
    network = quality_cnn.Network(1)
    draw = np.random.default_rng(2)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    block = draw.integers(0, 256, (5, quality_cnn.CHUNK)).astype(np.uint8)
    doc, target = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1.0])

    def loss():
        pooled = network.pooled(block)[0]
        starts = [0, 2, 3]
        mean = np.add.reduceat(pooled, starts) / np.array([2, 1, 2])[:, None]
        p = network.probability(mean, np.maximum.reduceat(pooled, starts))
        return -np.mean(target * np.log(p) + (1 - target) * np.log(1 - p))

    grads = network.gradients(block, doc, target)
    for name, at in (("out", (3,)), ("hidden", (5, 2)), ("hidden_shift", (1,)), ("filter", (7, 11)), ("shift", (4,)), ("embed", (60, 1))):
        kept = network.weights[name][at]
        network.weights[name][at] = kept + 1e-5
        up = loss()
        network.weights[name][at] = kept - 1e-5
        down = loss()
        network.weights[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-5)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op6_quality_cnn"](spark, folder).join(labels, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    right = [r["predicted"] == r["quality"] for r in held]
    assert len(held) > 50 and sum(right) >= 0.95 * len(right)


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, 1), (9, 0), (None, 1), (2, None), (77, 0)], "doc_id bigint, quality int")
    scored = quality_cnn.with_scores(odd, labels, QUICK).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    twice = [r["score"] for r in scored if r["doc_id"] == 9]
    assert twice[0] == twice[1]
    assert quality_cnn.keep_good(odd, labels, settings=QUICK).columns == odd.columns
    assert quality_cnn.with_scores(nothing, labels, QUICK).count() == 0
    assert {r["score"] for r in quality_cnn.with_scores(odd, labels.limit(0), QUICK).collect()} == {0.5}


# 7 line dedup


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (6, 3)])
def test_lines_by_brute_force(spark, odd, batches, fanout):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    docs = {}
    for doc, text in TEXTS.items():
        for k in {key(x) for x in text.split("\n")}:
            docs.setdefault(k, set()).add(doc)
    found = linededup.drop_lines(odd, min_docs=3, batches=batches, fanout=fanout)
    rows = found.select("doc_id", "text", "n_dropped").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        lines = TEXTS[r["doc_id"]].split("\n")
        stay = [x for x in lines if not key(x) or len(docs[key(x)]) < 3]
        assert r["text"] == "\n".join(stay) and r["n_dropped"] == len(lines) - len(stay)


def test_lines_of_nothing(nothing):
    assert linededup.drop_lines(nothing).count() == 0


# 8 quality rules


def test_ledger(odd, nothing):
    rows = {r["doc_id"]: r for r in quality_rules.ledger(odd).collect()}
    for doc, text in TEXTS.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = list(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 5000 else None
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = rows[doc]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert covered is None or r["n_repeat_words"] == len(covered)
    assert quality_rules.apply_policy(quality_rules.ledger(nothing)).count() == 0


def test_policies_and_ablations(spark):
    rows = [(i, bits) for i, bits in enumerate([0, 1, 1, 3, 4, 5, 32, 0])]
    ledger = spark.createDataFrame(rows, "doc_id bigint, failed bigint")
    assert [r["kept"] for r in quality_rules.apply_policy(ledger, 1).orderBy("doc_id").collect()] == [True, False, False, False, True, False, True, True]
    found = {r["rule"]: (r["n_failing"], r["n_only"]) for r in quality_rules.ablations(ledger, 2).collect()}
    assert found["few_words"] == (4, 2) and found["symbols"] == (2, 1) and found["duplicate_lines"] == (1, 1) and found["short_words"] == (0, 0)


# 9 extraction


def test_extraction(spark):
    plain = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu one</a></nav>"
    body = "<article><header>by line</header><h1>A &amp; B</h1><p>First  <b>bo</b>ld\npart<p>second<br>line<aside>ad</aside><div class='comments'>no</div></article>"
    pages = [
        (1, plain + body + "<footer>&copy; foot</footer>"),
        (2, None),
        (3, ""),
        (4, "only words, no tags &lt;3"),
        (5, "<div class=cookie-notice>We use cookies<article><p>text that counts here</p></article>"),
        (6, "<p unclosed 'quote><p>" + "word " * 5000),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, html string").withColumn("text", F.lit("clash"))
    found = {r["page_id"]: r["text"] for r in extraction.extract_text(df).collect()}
    assert found[1] == "A & B First bold part second line"
    assert found[2] == found[3] == "" and found[4] == "only words, no tags <3" and found[5] == "text that counts here"
    assert extraction.extract_text(df.limit(0)).count() == 0


def test_best_region():
    pick = random.Random(6)
    for _ in range(200):
        scores = [pick.uniform(-2, 1.5) for _ in range(pick.randint(0, 25))]
        first, last = extraction.best_region(scores)
        best = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        assert sum(scores[first:last]) == pytest.approx(best)


def test_extraction_of_whole_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op9_extraction"](spark, SF).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        words = html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split()
        assert r["text"] == " ".join(words) and r["n_chars"] == len(r["text"])


# 10 licence scan


def test_automaton():
    pick = random.Random(8)
    sequences = [[bytes([pick.choice(b"abc")]) for _ in range(pick.randint(1, 15))] for _ in range(6)]
    machine = licences.Automaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [bytes([pick.choice(b"abcd")]) for _ in range(400)]
    found = {place: (length, state) for place, length, state in machine.statistics(text)}
    for place in range(400):
        longest = max((n for n in range(1, 16) if n <= place + 1 and tuple(text[place + 1 - n : place + 1]) in runs), default=0)
        assert found.get(place, (0, 0))[0] == longest
        if longest:
            run = text[place + 1 - longest : place + 1]
            for s, sequence in enumerate(sequences):
                every = [end for end in range(longest - 1, len(sequence)) if sequence[end + 1 - longest : end + 1] == run]
                assert machine.ends[found[place][1]].get(s, []) == every


def test_licences(spark, odd, nothing):
    mit = next(text for _, text in licences.TEMPLATES if text.startswith("Permission is hereby"))
    texts = [
        "x Under the MIT-License, and apache license/VERSION 2. under the mit license",
        mit.replace("charge", "cost"),
        "All rights\nreserved.",
        "cc by nc cc by nc",
        "éUnder the mit license",
        None,
        "",
        "under the mit under the mit license",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("labels", F.lit("clash"))
    found = {r["doc_id"]: r for r in licences.scan_licences(df).collect()}
    assert (found[0]["n_base"], found[0]["first_word"], found[0]["last_word"], found[0]["base_labels"]) == (3, 1, 10, "apache-2,mit")
    assert found[1]["base_labels"] == "" and found[1]["labels"] == "mit" and 0.9 < found[1]["score"] < 1
    assert found[2]["labels"] == "all-rights-reserved" and (found[3]["n_base"], found[3]["last_word"]) == (2, 3)
    assert found[4]["n_base"] == 0 and found[5]["n_words"] == found[6]["n_words"] == 0 and found[6]["first_word"] is None
    assert (found[7]["n_base"], found[7]["first_word"]) == (1, 3)
    assert licences.scan_licences(odd).count() == len(ODD) and licences.scan_licences(nothing).count() == 0


# The pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns and frame.schema["doc_id"] == docs.schema["doc_id"]
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == [*docs.columns, "copy_no"]
    kept = {r["doc_id"] for r in frame.select("doc_id").collect()}
    assert {r["doc_id"] for r in result.select("doc_id").collect()} <= kept


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, SHARED)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert not kept & {1, 2, 3, None}

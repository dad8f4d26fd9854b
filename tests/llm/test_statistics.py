"""Whitening, toxicity and periodic runs on edge rows, against brute force and held-out labels."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import periodic, toxicity, whitening
from runlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# Whitening


VECTORS = "vec_id bigint, embedding array<float>, label int, whitened string, deviation int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("spread", [1 << 20, 1 << 24, 1 << 41])
def test_square_sums_are_exact(spread):
    u = np.random.default_rng(spread).integers(-spread, spread, (whitening.BLOCK + 700, 4))
    wide = u.astype(object)
    found = whitening.square_sums(u)
    for i in range(4):
        for j in range(i, 4):
            v = wide[:, i] if i == j else wide[:, i] + wide[:, j]
            assert found[i, j] == (v * v).sum()


def test_whitening_by_brute_force(spark):
    """Every column of the query on its whole table, against exact integers and numpy."""
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r["embedding"]] for r in raw], object)
    n, total = len(x), x.sum(0)
    exact = [(int(((n * row - total) ** 2).sum())) for row in x]
    matrix = np.cov((x - 100_000).astype(float).T, bias=True)
    values, basis = np.linalg.eigh(matrix)
    values, basis = values[::-1], basis[:, ::-1]
    projected = ((x - 100_000).astype(float) - (x - 100_000).astype(float).mean(0)) @ basis[:, :8] / np.sqrt(values[:8])
    place = {r["vec_id"]: i for i, r in enumerate(raw)}
    found = QUERIES["op11_whitening"](spark, SF).collect()
    assert len(found) == 8 * n
    signs = {}
    for r in found:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == exact[i] and r["deviation_digits"] == str(exact[i])
        sign = signs.setdefault(c, math.copysign(1, r["whitened"] * projected[i, c]))
        assert r["whitened"] == pytest.approx(sign * projected[i, c], abs=1e-6)
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_vectors_of_every_kind(spark):
    """NULL and broken vectors, NULL ids, equal rows, other lengths, huge entries, clashing columns."""
    good = [(1, [1.0, 2.0]), (None, [3.0, -1.0]), (1, [1.0, 2.0]), (6, [1e30, -1e30])]
    bad = [(None, [3.0, None]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [5.0]), (7, [float("inf"), 0.0])]
    df = vectors_of(spark, good + bad)
    fit = whitening.fit_whitening(df)
    rows = whitening.whiten(df, fit)
    assert rows.columns == ["vec_id", "embedding", "label", "whitened", "deviation"]
    assert fit.n == 4 and fit.size == 2
    found = rows.collect()
    assert sorted(str(r["vec_id"]) for r in found) == ["1", "1", "6", "None"]
    x = np.array([[min(max(math.floor(1024 * c), -(1 << 40)), 1 << 40) + 100_000 for c in v] for _, v in good], object)
    exact = {str(i): str(int(((4 * row - x.sum(0)) ** 2).sum())) for (i, _), row in zip(good, x, strict=True)}
    assert {str(r["vec_id"]): r["deviation"] for r in found} == exact
    assert whitening.identity_error(rows, fit) < 1e-6


def test_no_vectors_or_no_spread(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        df = vectors_of(spark, rows)
        fit = whitening.fit_whitening(df)
        assert fit.n == 0 and whitening.whiten(df, fit).count() == 0 and whitening.identity_error(df, fit) == 0
    same = vectors_of(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])])
    fit = whitening.fit_whitening(same)
    rows = whitening.whiten(same, fit)
    assert [r["whitened"] for r in rows.collect()] == [[0.0] * 3] * 2 and whitening.identity_error(rows, fit) == 0
    assert fit.explained == [0.0] * 3


# Toxicity


INSULTS = ["scoundrel", "numbskull fool", "vile wretch"]


def labelled_docs(count, seed, longest=150):
    draw = random.Random(seed)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    docs = []
    for i in range(count):
        words = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(5, longest))]
        toxic = int(draw.random() < 0.2)
        for _ in range(draw.randint(1, 3) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        docs.append((i, " ".join(words), toxic))
    return docs


DOCS = labelled_docs(900, 4)
DOC_SCHEMA = "doc_id bigint, text string, score string, value int, part string"


@pytest.fixture(scope="module")
def labelled(spark):
    odd = [(None, None, 1), (5000, "", 1), (5001, " \t\n", 0), (3, DOCS[3][1], 1), (5002, DOCS[0][1] + " long" * 60_000 + " vile wretch", None)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t, _ in DOCS + odd], DOC_SCHEMA).repartition(4)
    labels = [(i, 0, t) for i, _, t in DOCS] + [(None, 1, 1), (7, None, None), (8, 0, 0), (9000, 1, 1)]
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").repartition(2)


def is_held_out(key):
    return zlib.crc32(str(key).encode()) % 5 == 0


@pytest.fixture(scope="module")
def toxic_scores(labelled):
    return toxicity.with_toxicity(*labelled).collect()


def test_toxicity_on_held_out_labels(toxic_scores):
    truth = {i: t for i, _, t in DOCS if is_held_out(i)}
    judged = [(truth[r["doc_id"]], r["score"] >= 0.5) for r in toxic_scores if r["doc_id"] in truth]
    assert len(judged) > 120
    assert sum(p for t, p in judged if t) >= 0.95 * sum(t for t, _ in judged)
    assert sum(p for t, p in judged if not t) <= 0.02 * sum(not t for t, _ in judged)


def test_toxicity_of_every_kind_of_row(toxic_scores, labelled):
    assert len(toxic_scores) == labelled[0].count()
    assert labelled[0].columns == ["doc_id", "text", "score", "value", "part"] and all(0 <= r["score"] <= 1 for r in toxic_scores)
    by_text = {}
    for r in toxic_scores:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(scores) == 1 for scores in by_text.values())
    # One expression at the end of a very long text is found.
    assert next(r["score"] for r in toxic_scores if r["doc_id"] == 5002) >= 0.5


def test_labels_of_held_out_rows_tell_nothing(labelled, toxic_scores):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    found = toxicity.with_toxicity(docs, flipped)
    assert {(r["doc_id"], r["text"], r["score"]) for r in found.collect()} == {(r["doc_id"], r["text"], r["score"]) for r in toxic_scores}


def test_pieces_of_the_model_give_the_same_scores(labelled, toxic_scores):
    found = toxicity.with_toxicity(*labelled, settings=toxicity.Settings(piece_entries=700, label_bytes=0)).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in found) == sorted((str(r["doc_id"]), r["score"]) for r in toxic_scores)


def test_toxicity_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    few = docs.filter("doc_id < 4")
    assert {r["score"] for r in toxicity.with_toxicity(few, labels.limit(0)).collect()} == {0.5}
    assert toxicity.with_toxicity(docs.limit(0), labels).count() == 0
    one = labels.filter("toxic = 0")
    assert all(r["score"] < 0.5 for r in toxicity.with_toxicity(few, one).collect())


def brute_model(texts):
    """Interpolated Kneser-Ney of the two classes, straight from the definition; texts are (text, class or None)."""
    windows = {n: {} for n in range(1, 6)}
    for text, part in texts:
        data = toxicity.PAD + (text or "").encode().translate(toxicity.FOLDED)
        for i in range(4, len(data)):
            entry = windows[5].setdefault(data[i - 4 : i + 1], [0, 0, 0])
            entry[0] += 1
            if part is not None:
                entry[1 + part] += 1
    for n in range(4, 0, -1):
        for gram, entry in windows[n + 1].items():
            shorter = windows[n].setdefault(gram[1:], [0, 0, 0])
            for c in range(3):
                shorter[c] += entry[c] > 0
    cut = {}
    for n in range(1, 6):
        for c in range(3):
            met = [sum(e[c] == k for e in windows[n].values()) for k in (1, 2)]
            cut[n, c] = toxicity.discount(*met)
    sums = {}
    for n in range(1, 6):
        for gram, entry in windows[n].items():
            held = sums.setdefault((n, gram[:-1]), [[0, 0, 0], [0, 0, 0]])
            for c in range(3):
                held[0][c] += entry[c]
                held[1][c] += entry[c] > 0

    def chance(gram, c):
        n = len(gram)
        if not n:
            return 1 / 256
        use = c if n >= toxicity.OWN else 0
        total, kinds = (x[use] for x in sums.get((n, gram[:-1]), [[0, 0, 0]] * 2))
        if not total:
            return chance(gram[1:], c)
        count = windows[n].get(gram, [0, 0, 0])[use]
        return max(count - cut[n, use], 0) / total + cut[n, use] * kinds / total * chance(gram[1:], c)

    return lambda gram: math.log(chance(gram, 1)) - math.log(chance(gram, 2))


def test_steps_by_brute_force(spark):
    """The places of texts, seen and new, against the models' definition."""
    texts = [(t, [1, 0, None][i % 3]) for i, (_, t, _) in enumerate(labelled_docs(12, 9, 25))] + [(None, 0), ("", 1)]
    parts = {1: toxicity.ORDINARY_A, 0: toxicity.TOXIC_A, None: toxicity.NEITHER}
    docs = spark.createDataFrame([(t, parts[p]) for t, p in texts], "text string, part int").repartition(3)
    counts = toxicity.count_windows(docs).select("code", "n", F.col("toxic_a").alias("toxic"), F.col("ordinary_a").alias("ordinary"))
    difference = brute_model([(t, p) for t, p in texts])
    (scorer,) = toxicity.pieces_of(toxicity.build_model(counts), 1 << 22)
    for text in [texts[0][0], texts[1][0], texts[2][0], "Something else, ÄÖ\U0001f600 entirely", "a"]:
        data = toxicity.PAD + text.encode().translate(toxicity.FOLDED)
        codes, starts, sizes = toxicity.packed([text])
        steps = scorer.steps(codes)[starts[0] : starts[0] + sizes[0]]
        expected = [toxicity.UNIT * difference(data[i - 4 : i + 1]) for i in range(4, len(data))]
        # Each of at most four whole-number terms is rounded.
        assert np.abs(steps - np.array(expected)).max() <= 3


def test_a_table_finds_its_keys():
    draw = np.random.default_rng(2)
    keys = np.unique(draw.integers(0, 1 << 40, 5000))
    table = toxicity.Table(keys, np.arange(len(keys)))
    known, values = table.get(np.r_[keys, keys + 1])
    assert (values[: len(keys)] == np.arange(len(keys))).all() and known[: len(keys)].all()
    assert (known[len(keys) :] == np.isin(keys + 1, keys)).all()
    assert not toxicity.Table(keys[:0], keys[:0]).get(keys)[0].any()


# Periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(draw):
    kinds, n = draw.choice([1, 2, 2, 3, 5, 40]), draw.choice([0, 1, 5, 12, 30, 60, 120, 250])
    words = [draw.randrange(kinds) for _ in range(n)]
    for _ in range(draw.randint(0, 3) if n > 5 else 0):
        a = draw.randrange(n)
        p = draw.randint(1, max(1, (n - a) // 2))
        for i in range(a, min(n, a + draw.randint(0, n - a))):
            words[i] = words[a + (i - a) % p]
    return words + words if draw.random() < 0.2 else words


@pytest.mark.parametrize("seed", range(4))
def test_runs_by_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(300):
        texts = [random_words(draw) for _ in range(draw.randint(1, 4))]
        ids = np.array([w for t in texts for w in t], np.int64)
        expected, at = [], 0
        for t in texts:
            expected += [(s + at, n, q) for s, n, q in brute_runs(t)]
            at += len(t)
        assert periodic.find_runs(ids, [len(t) for t in texts]) == sorted(expected)


@pytest.mark.parametrize("words", ["fibonacci", "nested", "blocks"])
def test_runs_in_self_similar_words(words):
    if words == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 300:
            a, b = b, b + a
        text = b
    elif words == "nested":
        text = ([0, 1] * 9 + [0]) * 5 + [2] + [0, 1] * 30
    else:
        text = [0] * 90 + [1] + [0] * 90 + [1] + [0] * 40
    assert periodic.find_runs(np.array(text), [len(text)]) == brute_runs(text)


def test_long_texts_are_quick():
    draw = np.random.default_rng(1)
    for text in (np.zeros(300_000, int), draw.integers(0, 300, 300_000), np.r_[np.tile(draw.integers(0, 999, 9000), 9), np.zeros(50_000, int)]):
        assert len(periodic.find_runs(text, [len(text)])) <= 2


def planted_words(key, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(data):
    return hashlib.sha256(data).hexdigest()


def expected_row(key, text):
    words = planted_words(key, text)
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (key, len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), digest(told), digest(kept))


ROWS = [
    (1, "la " * 30, "a"), (None, "x y " * 20, "a"), (3, None, "b"), (4, "", "b"), (5, " \t\n\x0b\x0c\r", "b"), (6, "one two three", "c"),
    (6, "no break " * 15, "c"), (6, "no break " * 15, "c"), (70, "é\x1cß " * 13 + "end", None), (8, "a b c d e f " * 4 + "g a b c " * 9, "d"),
]


def test_rows_with_runs_of_every_kind(spark):
    docs = spark.createDataFrame([(i, t, s, 5) for i, t, s in ROWS], "doc_id bigint, text string, runs string, collapsed int").repartition(3)
    rows = periodic.collapse_runs(docs)
    assert rows.columns == ["doc_id", "text", "runs", "collapsed"]
    for r in rows.collect():
        words = (r["text"] or "").encode().split()
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == brute_runs(words)
        dropped = {i for s, n, q in brute_runs(words) for i in range(s + q, s + n)}
        assert r["collapsed"] == b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()
    assert rows.count() == len(ROWS) and periodic.collapse_runs(docs.limit(0)).count() == 0


def test_periodic_query_by_brute_force(spark):
    """Every column of the query on its whole table."""
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(expected_row(r["doc_id"], r["text"]) for r in raw)
    found = QUERIES["op13_periodic_runs"](spark, SF).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert sum(r[1] > 0 for r in expected) > 10


def test_planting_keeps_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (1 << 40, "c d")], "doc_id bigint, text string")
    assert sorted(str(r["text"]) for r in periodic.with_planted_runs(docs).collect()) == ["None", "a b", "c d"]

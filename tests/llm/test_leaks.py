"""Decontamination of generated questions with numbers, units, names and broken slots, and the pipeline's stages, by brute force."""

import random

import regex
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import decontamination as D
from runlens.llm import simhash

DIGITS = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
AFTER = r"(?![\p{L}\p{N}])"


def marked(text):
    text = (text or "").translate({ord(c): " " for c in D.NUMBER + D.UNIT + D.NAME + "_"})
    text = regex.sub(r"(?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{Ll})", D.NAME, text).lower()
    text = regex.sub(rf"(?<![\p{{L}}\p{{N}}.,])(?={DIGITS}(?:{D.UNITS})?{AFTER})", D.NUMBER, text)
    text = regex.sub(rf"({D.NUMBER}{DIGITS}) ?{D.NAME}?({D.UNITS}){AFTER}", rf"\1 {D.UNIT}\2", text)
    text = regex.sub(r"(?<=\p{Nd})[.,](?=\p{Nd})", "_", text)
    return regex.sub("[^\\p{L}\\p{N}_\u0001-\u0003]+", " ", text).split()


def runs(text):
    """(words as compared, place, values or None, whether it is the form with its values) of each run of eight words."""
    words, found = marked(text), set()
    for place in range(len(words) - 7):
        run = words[place : place + 8]
        values = tuple(w for w in run if w < "\u0004")
        found.add((tuple(w[0] if w < "\u0004" else w for w in run), place, values or None, False))
        if values:
            found.add((tuple(w.lstrip(D.NUMBER + D.UNIT + D.NAME) for w in run), place, None, True))
    return found


def leaks(docs, items):
    """{(doc_id, text, item_id): (n_matched, n_windows, reparameterised)}, from the definition; documents by id and text."""
    index = {}
    for key, text in items:
        if text is None:
            continue
        own = runs(text) | runs(text.lower())
        own |= {(h, p, v, True) for h, p, v, _ in runs(", " + text.lstrip(" ")) if p == 0 and v}
        index[key] = index.get(key, set()) | own
    result = {}
    for doc, text in set(docs):
        of_doc = runs(text)
        for item, own in index.items():
            n_windows = len({p for _, p, _, _ in own})
            usable = [r for r in own if r[2] is None or 8 - len(r[2]) >= D.MIN_LITERALS]
            shifts = {}
            for h, place, found, more in of_doc:
                for g, at, asked, also in usable:
                    if h == g:
                        shifts.setdefault(place - at, []).append((at, asked, found, more or also))
            template, every, changed = set(), set(), False
            for met in shifts.values():
                values = {(a, f) for _, asked, found, _ in met if asked and found for a, f in zip(asked, found, strict=True)}
                broken = len(values) != len({a for a, _ in values})
                verbatim = {at for at, asked, _, _ in met if not asked}
                by_template = {at for at, _, _, more in met if not more}
                template |= by_template & verbatim if broken else by_template
                every |= verbatim if broken else {at for at, *_ in met}
                changed |= not broken and any(a != f for a, f in values)
            needed = min(D.MIN_MATCHED, n_windows)
            if n_windows and len(every) >= needed:
                result[doc, text, item] = (len(template) if len(template) >= needed else len(every), n_windows, changed)
    return result


NAMES = ["Anna", "Bob", "Clara", "David", "Eve", "Frank"]
FORMS = [
    "If {a} has {x} apples and gives {y} kg of them to {b}, how many apples does {a} still have after {z} days?",
    "A train leaves the old station at {x} kmh and after {y} hours it meets {a}, who walked {z} miles with {b} that day.",
    "{x} plus {y} is {z} and {y} times {x} is more than {a} and {b} could count.",
    "Which planet did {a} and {b} see on the night when the comet came near?",
]


def question(draw, form):
    a, b = draw.sample(NAMES, 2)
    x, y, z = (str(draw.choice([3, 12, 5.5, "1,000", 7])) for _ in range(3))
    return form.format(a=a, b=b, x=x, y=y, z=z)


def generated(seed, count):
    """Items, and documents that hold them as they are, with other values, in other case, cut short, or with one value changed."""
    draw = random.Random(seed)
    items = [(i, question(draw, form)) for i, form in enumerate(FORMS)] + [(9, None), (10, "too short")]
    docs = []
    for i in range(count):
        k = draw.randrange(len(FORMS))
        text = draw.choice([items[k][1], question(draw, FORMS[k]), question(draw, FORMS[k])])
        kind = draw.randrange(6)
        if kind == 0:
            text = draw.choice([text.lower(), text.upper()])
        elif kind == 1:
            words = text.split()
            text = " ".join(words[draw.randrange(5) : draw.randint(9, len(words))])
        elif kind == 2:
            # One mention of a value differs from the others.
            words = text.split()
            at = draw.choice([n for n, w in enumerate(words) if w.strip(",.?") in NAMES])
            words[at] = draw.choice(NAMES)
            text = " ".join(words)
        docs.append((draw.choice([i, i, None, 7]), draw.choice(["", "As they ask ", "So it was. ", "he said "]) + text + draw.choice(["", " and so on it went", " " + items[0][1]])))
    return items, docs


def test_leaks_of_generated_questions(spark):
    for seed in (1, 2):
        items, docs = generated(seed, 60)
        df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
        found = D._leaks(df, spark.createDataFrame(items, "item_id bigint, text string"), "doc_id").collect()
        expected = leaks(docs, items)
        rows = sorted((str(r["doc_id"]), r["item_id"], r["n_matched"], r["n_windows"], r["reparameterised"]) for r in found)
        assert rows == sorted((str(d), i, *values) for (d, _, i), values in expected.items())
        assert 20 < len(expected) < 100 and {v[2] for v in expected.values()} == {True, False}


# The pipeline's stages after the classifier, each on its own input


def distinct_rows(df):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def without_common_lines(docs):
    held = {}
    for i, text in docs:
        for key in {key_of(line) for line in (text or "").split("\n")}:
            held.setdefault(key, set()).add((i, text or ""))
    common = {k for k, of in held.items() if k and len(of) >= 10}
    return [(i, "\n".join(line for line in (t or "").split("\n") if key_of(line) not in common)) for i, t in docs]


def test_stages_by_brute_force(spark):
    items, leaking = generated(3, 24)
    draw = random.Random(5)
    words = ["".join(draw.choice("abcde") for _ in range(4)) for _ in range(200)]
    docs = [(i, " ".join(draw.choice(words) for _ in range(60)) + ("\n Shared LINE \t" if i % 2 else "") + "\nown " + str(i)) for i in range(50)]
    docs += [(100 + i, docs[i][1]) for i in range(10)] + [(200 + i, t) for i, (_, t) in enumerate(leaking)] + [(300, None), (301, "")]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)

    lines = corpus_pipeline.line_dedup(spark, df, "")
    expected = without_common_lines(docs)
    assert lines.columns == df.columns and distinct_rows(lines) == sorted((str(i), t) for i, t in expected)
    assert not any("Shared LINE" in t for _, t in expected)

    near = corpus_pipeline.near_dedup(spark, lines, "")
    prints = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.near_duplicates(lines).select("doc_id", "fp").collect()}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS:
                    root[a] = root[b] = min(root[a], root[b])
    kept = [(i, t) for i, t in expected if root[i] == i]
    assert near.columns == df.columns and distinct_rows(near) == sorted((str(i), t) for i, t in kept) and len(kept) < len(expected) - 9

    clean = D.drop_leaks(near, spark.createDataFrame(items, "item_id bigint, text string"))
    gone = {(d, t) for d, t, _ in leaks(kept, items)}
    left = [r for r in kept if r not in gone]
    assert clean.columns == df.columns and distinct_rows(clean) == sorted((str(i), t) for i, t in left) and gone

    mixed = corpus_pipeline.mixed(spark, clean, "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["doc_id"] for r in mixed} <= {i for i, _ in left} and max(r["n"] for r in mixed) <= 3



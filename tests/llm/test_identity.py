"""Rows that share an id, or have none, with texts of their own; texts of one character."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import decontamination, suffixdedup
from test_operators import LONG, QUESTION, SHARED, prose, repeats

MIXED = [
    (7, prose(21, 60) + " " + SHARED),
    (7, prose(22, 40) + " " + SHARED + " more"),
    (7, prose(22, 40) + " " + SHARED + " more"),
    (None, "short"),
    (None, SHARED + " of none"),
    (None, LONG),
    (None, None),
    (3, LONG + " end"),
    (9, "=" * 900),
    (9, None),
]


def test_repeats_among_rows_of_one_id(spark):
    """In order of id and the text's SHA-256, each text is a document of its own."""
    distinct = sorted({(suffixdedup.NO_ID if i is None else i, (t or "").encode()) for i, t in MIXED}, key=lambda r: (r[0], hashlib.sha256(r[1]).hexdigest()))
    by_number = repeats([(n, t) for n, (_, t) in enumerate(distinct)], 100)
    expected = {}
    for n, (i, t) in enumerate(distinct):
        expected.setdefault((i, len(t)), []).append(by_number[n])
    df = spark.createDataFrame(MIXED, "doc_id bigint, text string").repartition(3)
    found = suffixdedup.drop_repeats(df).collect()
    assert len(found) == len(MIXED)
    for r in found:
        key = (suffixdedup.NO_ID if r[0] is None else r[0], r[1])
        assert (r[1], r[2], r[3], r[4], bytes(r[5])) in expected[key]


@pytest.mark.parametrize("sign", ["=", "ab"])
def test_a_run_of_one_character_takes_little_memory(sign):
    """Two million bytes, every place an anchor: far less than 168 bytes a place; all but the first string goes."""
    text = sign * (2_000_000 // len(sign))
    places, _ = suffixdedup.anchors(np.frombuffer(text.encode(), np.uint8))
    assert len(places) > 900_000
    batch = pa.RecordBatch.from_pydict({"id": [5], "text": [text], "found": [places.tolist()]})
    tracemalloc.start()
    rows = 0
    covered = np.zeros(len(text), bool)
    for out in suffixdedup.bring_contexts(100, 32, 8)(iter([batch])):
        part, place = out["part"].to_numpy(), out["place"].to_numpy()
        for start, stop in zip(place[part < 0].tolist(), (-part[part < 0]).tolist(), strict=True):
            covered[start:stop] = True
        rows += int((part >= 0).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000 and rows < 400
    # The ends, which differ from the rest, are judged apart.
    assert covered[400:-400].all()


def test_leaks_among_rows_of_one_id(spark):
    """Windows of different texts do not add up, and only the row with the item goes."""
    words = QUESTION.split()
    half, rest = " ".join(words[:11]), " ".join(words[-11:])
    docs = [(None, QUESTION), (None, "a clean document about gardens"), (5, QUESTION.lower()), (5, "clean as well"), (6, half), (6, rest), (None, half), (None, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("extra", F.lit(1)).repartition(3)
    items = spark.createDataFrame([(1, QUESTION)], "item_id bigint, text string")
    assert sorted(str(r["doc_id"]) for r in decontamination.leaks(df, items).collect()) == ["5", "None"]
    kept = decontamination.drop_leaks(df, items)
    expected = [str((i, t)) for i, t in docs if t not in (QUESTION, QUESTION.lower())]
    assert kept.columns == df.columns and sorted(str((r[0], r[1])) for r in kept.collect()) == sorted(expected)


def test_pipeline_over_no_documents(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

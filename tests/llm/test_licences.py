"""Licence scans: phrases of a whole table by brute force, and notices with clauses put in."""

import random

import pytest

from runlens.llm import licences
from runlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MIT = next(text for _, text in licences.TEMPLATES if text.startswith("Permission is hereby"))


def expected_row(key, text):
    words = licences.words_of(text)
    places = []
    for phrase, label in licences.PHRASES:
        wanted = licences.words_of(phrase)
        places += [(i, label) for i in range(len(words) - len(wanted) + 1) if words[i : i + len(wanted)] == wanted]
    starts = [i for i, _ in places]
    return (key, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})))


def test_phrases_of_a_whole_table_by_brute_force(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op10_licences"](spark, SF).collect()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(expected_row(r["doc_id"], r["text"]) for r in raw)
    for r in found:
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert sum(r["n_base"] > 0 for r in found) >= 3


@pytest.mark.parametrize("length", [5, 15, 25, 60, 120, 200])
@pytest.mark.parametrize("after", [20, 35, 50])
def test_a_clause_put_into_a_notice_keeps_its_label(length, after):
    draw = random.Random(length)
    clause = " ".join("".join(draw.choice("bdfgklmnprstvw") + draw.choice("aeiou") for _ in range(3)) for _ in range(length))
    words = MIT.split()
    text = " ".join([*words[:after], clause, *words[after:]])
    (row,) = [licences._report(licences.Scanner(), f"Before this. {text} After it.")]
    assert row[5] == "mit" and row[6] > 0.9


def best_cover(matches, size):
    """The most words that chains laid one after the other can gain, by trying every choice."""
    gap = max(licences.LEAST_GAP, licences.GAP_TIMES * size)

    def after(i, end, reached):
        if i == len(matches):
            return 0
        place, length, places = matches[i]
        best = after(i + 1, end, reached)
        for at in places:
            if reached is not None and at > reached and place > end and place - length - end <= gap:
                best = max(best, min(length, at - reached, place - end) + after(i + 1, place, at))
            if place - length + 1 > end:
                best = max(best, length - licences.MIN_MATCH + 1 + after(i + 1, place, at))
        return best

    return after(0, -1, None)


def test_chains_by_brute_force():
    """Never more than the best, nearly always as much, and never far less."""
    draw, exact = random.Random(4), 0
    for _ in range(400):
        size, place, matches = draw.randint(10, 30), 7, []
        for _ in range(draw.randint(0, 6)):
            place += draw.choice([1, 2, 5, 12, 230])
            # Matches that cannot be made longer begin in the order in which they end.
            first = max(matches[-1][0] - matches[-1][1] + 2 if matches else 0, place - draw.randint(2, 7))
            length = place - first + 1
            matches.append((place, length, sorted(draw.sample(range(max(length, 1) - 1, size), draw.randint(1, 2)))))
        spans = licences.chain(matches, size)
        gained = sum(round(share * size) for _, _, share in spans) - (licences.MIN_MATCH - 1) * len(spans)
        most = best_cover(matches, size)
        exact += gained == most
        assert 0.8 * most <= gained <= most
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert exact >= 390


def test_repeated_and_mixed_notices():
    scanner = licences.Scanner()
    twice = licences._report(scanner, f"{MIT} and then {MIT}")
    assert twice[5] == "mit" and len(twice[7].split(";")) == 2
    both = licences._report(scanner, f"{MIT} {next(t for label, t in licences.TEMPLATES if label == 'isc')}")
    assert both[5] == "isc,mit"
    # Half a notice is none, however often it stands.
    half = " ".join(MIT.split()[:30])
    assert licences._report(scanner, " and so on ".join([half] * 50))[5] == ""
    assert licences._report(scanner, "the software and the software or the software " * 200)[5] == ""

"""Segments against brute force, and held-out accuracy of the score."""

import random
import zlib

import pytest

from thriftlens.llm import toxicity


def maximal(scores):
    """Maximal scoring segments by definition: recursively the best segment, then left and right of it."""
    found = []

    def search(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j)
        if best:
            found.append((best[1], best[2], round(best[0], 6)))
            search(a, best[1])
            search(best[2] + 1, b)

    search(0, len(scores))
    return sorted(found)


def test_segments_are_the_maximal_ones():
    rnd = random.Random(1)
    for _ in range(300):
        scores = [rnd.choice([0.0, 0.0, round(rnd.uniform(0.1, 3), 3), round(-rnd.uniform(0.1, 3), 3)]) for _ in range(rnd.randint(0, 25))]
        full = [s or -0.37 for s in scores]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores, -0.37) if s > 0]
        assert got == maximal(full), scores


def test_rate_solves_its_equation():
    import math

    scores = [(0.01, 5.0), (0.02, 2.0), (0.97, -0.5)]
    rate = toxicity.rate_of(scores)
    assert abs(sum(f * math.exp(rate * s) for f, s in scores) - 1) < 1e-6
    assert toxicity.rate_of([]) == 1.0 and toxicity.rate_of([(1.0, -1.0)]) == 1.0


@pytest.fixture(scope="module")
def corpus(spark, docs):
    rnd = random.Random(6)
    insults = ["fool", "dunce", "lout"]
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1200):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            at = rnd.randrange(len(text))
            text[at:at] = [rnd.choice(insults) + rnd.choice(["", "ish", "ery"]) if k % 3 == 0 else rnd.choice(words) for k in range(10)]
        rows.append((i, " ".join(text).capitalize()))
        if i % 2 == 0 or rnd.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5000, 0, 1), (7, None, None)]
    return rows, docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_passages(corpus):
    rows, documents, labels = corpus
    model = toxicity.fit(documents, labels)
    got = toxicity.passages(documents, model).collect()
    text = dict(rows)
    for r in got:
        score, toxic = r["_toxicity"]["score"], r["doc_id"] % 6 == 0
        assert 0 <= score <= 1
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1:
            assert (score >= toxicity.THRESHOLD) == toxic
        for s in r["_toxicity"]["segments"]:
            words = text[r["doc_id"]].lower().split()
            assert toxic and words[s["first_word"]][:4] in ("fool", "dunc", "lout") and s["expected"] < 0.01
    kept = toxicity.clean(documents, labels)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if i % 6}


def test_labels_of_the_held_out_fold_are_not_used(spark, corpus):
    rows, documents, labels = corpus
    held = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"
    wrong = labels.selectExpr("doc_id", "quality", f"if({held}, 1 - toxic, toxic) as toxic")
    assert toxicity.fit(documents, wrong) == toxicity.fit(documents, labels)


def test_odd_rows_and_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, none)
    assert [r[0] for r in toxicity.passages(odd, model).select("_toxicity.score").distinct().collect()] == [0.0]
    one = spark.createDataFrame([(1, 0, 1), (4, 1, 0)], none.schema)
    assert toxicity.clean(odd, one).count() == 10
    assert toxicity.clean(odd.limit(0), one).count() == 0

"""Ranked search against a score of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from thriftlens.llm import ranked


def terms_of(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in found]


def brute(documents, items, k):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms_of(x)) for i, x in documents) if t]
    n_docs, n_all = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_all
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
                for t in set(terms_of(text)) if counts[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(spark, documents, items, **options):
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in documents], "doc_id long, text string, n string, score int")
    asked = spark.createDataFrame([(i, t, "own") for i, t in items], "item_id long, text string, rank string")
    return sorted((tuple(r) for r in ranked.ranked(docs.repartition(3), asked, **options).collect()), key=repr)


@pytest.mark.parametrize("kind", ["prose", "ties", "common"])
def test_against_every_score(spark, kind):
    rnd = random.Random(kind)
    words = [f"w{k}" for k in range({"prose": 400, "ties": 6, "common": 30}[kind])]
    draw = lambda n: " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    size = lambda: rnd.choice([0, 1, 3, 30, 200]) if kind != "ties" else 2
    documents = [(k, draw(size())) for k in rnd.sample(range(10_000), 500)]
    items = [(k, draw(rnd.choice([1, 2, 12]))) for k in range(25)]
    want = brute(documents, items, 10)
    assert found(spark, documents, items, k=10) == want
    assert found(spark, documents, items, k=10, block_postings=300, chunk_terms=20) == want


def test_odd_rows(spark):
    documents = [(1, None), (2, ""), (3, " -- "), (4, "Word"), (4, "word"), (None, "WORD word"), (None, "other"),
                 (5, "Ünïcode 😀 text\x00with_a zero"), (6, "long " * 20_000), (7, "x" * 50_000)]
    items = [(1, "word"), (1, "Word other"), (None, "long zero"), (2, None), (3, ""), (4, "absent"), (5, "ünïcode Ünïcode a")]
    assert found(spark, documents, items, k=3) == brute(documents, items, 3)
    assert found(spark, documents, items, k=1) == brute(documents, items, 1)
    assert found(spark, [], items) == [] and found(spark, documents, []) == [] and found(spark, documents[:3], items) == []


def test_stops_before_the_ends_of_the_lists():
    """Best positions run ahead of the places read, and what is left unread cannot change the result."""
    rng = np.random.default_rng(4)
    n, n_terms = 4000, 3
    base = rng.pareto(1.5, n)
    impact = (np.stack([base * rng.uniform(0.8, 1.2, n) for _ in range(n_terms)], axis=1) * 1000).astype(np.int64) + 1
    owner, term = np.repeat(np.arange(n), n_terms), np.tile(np.arange(n_terms), n)
    block = ranked.Block(np.arange(n), owner, term, impact.ravel(), n_terms)
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop)
            return super().__getitem__(key)

    block.list_doc = block.list_doc.view(Watched)
    docs, scores = block.best(np.arange(n_terms), 10)
    total = impact.sum(axis=1)
    want = np.lexsort((np.arange(n), -total))[:10]
    assert (np.asarray(docs) == want).all() and (scores == total[want]).all()
    assert max(reads) < block.list_start[-1] - n * 3 // 4  # of the last list less than a quarter is read


def test_equal_scores_are_not_cut_off():
    """A document met late with the score of the kth goes first if its number is smaller."""
    n = 200
    owner, term = np.arange(n), np.zeros(n, dtype=np.int64)
    block = ranked.Block(np.arange(n), owner, term, np.full(n, 5), 1)
    docs, scores = block.best(np.array([0]), 7, first_step=1)
    assert docs.tolist() == list(range(7)) and scores.tolist() == [5] * 7
    both = ranked.Block(np.arange(4), np.array([0, 1, 2, 2]), np.array([0, 1, 0, 1]), np.array([6, 6, 3, 3]), 2)
    docs, scores = both.best(np.array([0, 1]), 3, first_step=1)
    assert docs.tolist() == [0, 1, 2] and scores.tolist() == [6, 6, 6]

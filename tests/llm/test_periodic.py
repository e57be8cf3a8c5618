"""Runs of repeated words against a plain search over all periods."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thriftlens.llm import periodic


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                s = words[i : i + length]
                if not any(s[d:] == s[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(i, j) + 1
    return sorted(found)


def brute_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("letters", [1, 2, 3, 60])
def test_runs(letters):
    """Texts of repeats within repeats, of periods on both sides of each scale."""
    rnd = random.Random(letters)
    for _ in range(500):
        words = []
        for _ in range(rnd.randint(1, 5)):
            part = [rnd.randrange(letters) for _ in range(rnd.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 33]))]
            if rnd.random() < 0.3:
                part = part * rnd.randint(2, 6) + [rnd.randrange(60)]
            words += part * rnd.randint(1, 6) + part[: rnd.randint(0, len(part))]
        assert periodic.runs_of(np.array(words, dtype=np.int64)) == brute_runs(words), words


def test_shapes_with_many_repetitions():
    """Fibonacci words and powers of powers, in which runs of many periods overlap."""
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    nested = [0, 1]
    for k in (4, 5, 4):
        nested = nested * k + [7 + k]
    for words in (b, nested * 4, [0] * 500, [0, 1] * 200 + [0] * 300, list(range(300)) * 5):
        assert periodic.runs_of(np.array(words, dtype=np.int64)) == brute_runs(words)


def test_picked_positions_are_consistent_and_dense():
    """Equal contexts are picked alike, and every tau positions without a highly periodic stretch hold a picked one."""
    rnd = np.random.default_rng(5)
    words = np.concatenate([rnd.integers(0, 2, 150), np.tile(rnd.integers(0, 2, 37), 6), np.zeros(60, dtype=np.int64)])
    tau = 8
    hashes = periodic._mixed(words.astype(np.uint64))
    for size in (1, 2, 4):
        hashes = periodic._doubled(hashes, size)
    omitted = np.zeros(len(hashes), dtype=bool)
    for start, length, period in brute_runs(words.tolist()):
        if 4 * period <= tau <= length:
            omitted[start : start + length - tau + 1] = True
    chosen = periodic.picked(hashes, omitted, tau)
    mark = np.zeros(len(words), dtype=bool)
    mark[chosen] = True
    contexts = {}
    for i in range(len(words) - 2 * tau + 1):
        assert contexts.setdefault(tuple(words[i : i + 2 * tau]), mark[i]) == mark[i]
        if i + 3 * tau <= len(words) and not omitted[i : i + 2 * tau].all():
            assert mark[i : i + tau].any()
    assert 0 < len(chosen) < len(words) / 2


def test_texts(spark, odd, docs):
    found = periodic.periodic_runs(odd)
    assert found.columns == [*odd.columns, "periodic"] and found.count() == odd.count()
    got = {(r["doc_id"], (r["text"] or "")[:5]): r["periodic"] for r in found.collect()}
    assert got[(6, "long ")]["runs"][0].asDict() == {"start": 0, "length": 20_000, "period": 1}
    assert got[(6, "long ")]["collapsed"] == "long" and got[(6, "long ")]["n_words"] == 20_000
    for key in [(1, ""), (2, ""), (3, " \t\n"), (None, "")]:
        assert got[key].asDict() == {"n_words": 0, "runs": [], "collapsed": ""}
    assert got[(5, "Ünïco")]["collapsed"] == "Ünïcode 😀 text\x00 with a zero and lines"
    assert periodic.periodic_runs(odd.limit(0)).count() == 0
    clash = spark.createDataFrame([("a a a a a a", "own")], "text string, periodic string")
    row = periodic.periodic_runs(clash).first()
    assert row["periodic"] == "own" and row["_periodic"]["collapsed"] == "a"


def test_long_text(docs):
    rnd = random.Random(2)
    block = [f"w{rnd.randrange(500)}" for _ in range(30_000)]
    text = " ".join([f"u{k}" for k in range(5_000)] + block * 5 + ["end"])
    found = periodic.periodic_runs(docs([(1, text)])).first()["periodic"]
    assert [tuple(r) for r in found["runs"]] == [(5_000, 150_000, 30_000)]
    assert found["collapsed"].split() == text.split()[:35_000] + ["end"]


def test_planted(spark, docs):
    import zlib

    rows = [(k, " ".join(f"v{j}" for j in range(k % 50))) for k in range(300)] + [(301, None)]
    for r in periodic.planted(docs(rows)).collect():
        words, h = (rows[r["doc_id"]][1] or "").split() if r["doc_id"] < 300 else [], zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert (r["text"] or "").split() == words


def test_query_against_plain_search(spark):
    import hashlib

    from thriftlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "") for r in periodic.planted(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in QUERIES["op13_periodic_runs"](spark, sf).collect():
        words = [w.decode() for w in texts[r["doc_id"]].encode().split()]
        if len(words) > 1_500:
            continue
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (best[1] and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()


def test_native_plan_of_planted(docs):
    plan = periodic.planted(docs([(1, "a")])).select(F.length("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan

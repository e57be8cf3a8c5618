"""Exact top-k against a full scan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thriftlens.llm import topk


def brute(vectors, queries, k):
    out = []
    for q in queries:
        found = []
        for i, v in vectors.items():
            if i != q:
                found.append((-sum(a * b for a, b in zip(vectors[q], v)), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def frame(spark, vectors):
    rows = [(row, i, v) for row, (i, v) in enumerate(vectors.items())]
    return spark.createDataFrame(rows, "row long, vec_id long, vector array<bigint>")


@pytest.mark.parametrize("kind", ["spread", "ties", "ragged", "huge", "same"])
def test_top_k(spark, kind):
    rnd = random.Random(kind)
    value = {"spread": lambda: rnd.randint(-99, 99), "ties": lambda: rnd.randint(-1, 1), "same": lambda: 3,
             "ragged": lambda: rnd.randint(-9, 9), "huge": lambda: rnd.randint(-(10**8), 10**8)}[kind]
    size = lambda: rnd.randint(0, 8) if kind == "ragged" else 8
    vectors = {i: [value() for _ in range(size())] for i in rnd.sample(range(5000), 300)}
    asked = [i for i in vectors if i % 4 == 0]
    df = frame(spark, vectors)
    got = topk.top_k(df, df.where("vec_id % 4 = 0"), k=5, block_vectors=70, block_queries=20)
    assert sorted(tuple(r) for r in got.collect()) == brute(vectors, asked, 5)


def test_few_or_no_candidates(spark):
    vectors = {50: [1, 2], 7: [3, 4]}
    df = frame(spark, vectors)
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id = 50")).collect()] == [(50, 1, 7, 11)]
    assert topk.top_k(df, df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df.limit(0)).count() == 0
    one = df.where("vec_id = 50")
    assert topk.top_k(one, one).count() == 0
    empty = frame(spark, {1: [], 2: []})
    assert sorted(tuple(r) for r in topk.top_k(empty, empty).collect()) == [(1, 1, 2, 0), (2, 1, 1, 0)]


def test_integer_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0]), (6, []),
            (7, [2.0]), (7, [1.0]), (7, [1.0])]
    df = spark.createDataFrame([(*r, 0, "v") for r in rows], "vec_id long, embedding array<float>, label int, vector string")
    got = topk.integer_vectors(df).collect()
    assert len({r["row"] for r in got}) == len(got)
    assert sorted(((r["vec_id"], r["vector"]) for r in got), key=repr) == sorted(
        [(1, [128, -1]), (6, []), (7, [512]), (7, [256]), (7, [256]), (None, [256])], key=repr
    )


def test_rows_that_share_an_id_or_have_none(spark):
    """Every row is a candidate of every other, also of one with its id; of equal scores the smaller id goes first, a null last."""
    rnd = random.Random(6)
    ids = [0, 0, 0, 1, 1, 2, None, None, 50, 50, 7, 8, 9]
    rows = [(k, i, [rnd.randint(-3, 3) for _ in range(4)]) for k, i in enumerate(ids)]
    rows[1] = (1, 0, [9, 9, 9, 9])  # the best of all stands on a second row of an id
    df = spark.createDataFrame(rows, "row long, vec_id long, vector array<bigint>")
    want = []
    for q, query_id, a in rows:
        if query_id is not None and query_id % 50 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for r, i, b in rows if r != q]
            want += [(query_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:4], 1)]
    for blocks in (3, 100):
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=4, block_vectors=blocks, block_queries=2)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_few_exact_vectors_are_read(spark):
    """The bounds leave a small part of all pairs, and the floor from the first block keeps other blocks from passing on theirs."""
    rng = np.random.default_rng(9)
    x = rng.integers(-256, 256, (2000, 16))
    grid = topk.Cells(x.min(axis=0), x.max(axis=0), 8)
    cells, rows = grid.numbers(x), np.arange(2000)
    floors = np.full(40, topk.NONE)
    first = topk.near_of_block(rows[:1000], cells[:1000], rows[:40], x[:40], floors, grid, 5)
    assert len(first[0]) < 40 * 20
    kth = np.array([np.sort(first[2][first[0] == q])[-5] for q in range(40)])
    alone = topk.near_of_block(rows[1000:], cells[1000:], rows[:40], x[:40], floors, grid, 5)
    after = topk.near_of_block(rows[1000:], cells[1000:], rows[:40], x[:40], kth, grid, 5)
    assert len(after[0]) < 0.8 * len(alone[0])


def test_cells_bound_the_products():
    rnd = np.random.default_rng(3)
    x = rnd.integers(-300, 300, (200, 16))
    q = rnd.integers(-300, 300, (20, 16))
    grid = topk.Cells(x.min(axis=0), x.max(axis=0), 4)
    corner = q @ grid.corners(grid.numbers(x)).T
    slack = grid.width - 1
    upper, lower = corner + (np.maximum(q, 0) @ slack)[:, None], corner + (np.minimum(q, 0) @ slack)[:, None]
    assert ((lower <= q @ x.T) & (q @ x.T <= upper)).all()


def test_recall_is_whole(spark):
    df = spark.range(400).select(
        F.col("id").alias("row"), F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.floor(F.rand(5) * 200)).alias("vector")
    )
    vectors = {r["vec_id"]: r["vector"] for r in df.collect()}
    found = topk.top_k(frame(spark, vectors), frame(spark, vectors), k=3, cell_bits=2, block_vectors=50, block_queries=50)
    assert sorted(tuple(r) for r in found.collect()) == brute(vectors, list(vectors), 3)

"""Exact top-k by inner product with vector-approximation files.

Vectors of integers are quantised: each dimension is cut into equal cells between its least and greatest value, and a vector is approximated by
the numbers of its cells, a byte each. For a query the cells give a lower and an upper bound of every inner product.

The file of cells is scanned first, and no exact vector is read for it. Cells are dealt into blocks, queries too, and each block of cells meets each block of queries
in one task. One block gives every query a first bound of its kth score, which all other blocks start from; a block passes on the rows whose upper bound reaches
the best bound known there. Exact vectors are then fetched by row, for each query first the k rows with the highest upper bounds. Their kth score is
certain to be reached, so only rows whose upper bound is as high are fetched after them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thriftlens.session import cut_lineage

#: Bits of a cell number.
CELL_BITS = 8
#: Vectors and queries in a block, about.
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 1024
#: Scores of less are exact in double precision.
EXACT = 1 << 53


def integer_vectors(embeddings: DataFrame, scale: int = 256, name: str = "embedding") -> DataFrame:
    """(row, vec_id, vector): each component x as floor(scale * x), x as double, and a number of the row, given when this table is written.

    Rows with a null vector, or with a component that is null or not finite, are left out. Rows that share an id, or have none, are rows like any other.
    """
    values = F.transform(F.col(name), lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = embeddings.where(F.col(name).isNotNull()).where(finite)
    vector = F.transform(values, lambda x: F.floor(x * scale).cast("bigint"))
    return cut_lineage(usable.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")))


def _bounds(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each dimension (0 counts for vectors without it): two numbers for each dimension."""
    size = vectors.agg(F.max(F.size("vector")).alias("n"), F.min(F.size("vector")).alias("least")).first()
    rows = (
        vectors.select(F.posexplode("vector").alias("d", "x"))
        .groupBy("d")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"))
        .orderBy("d")
        .collect()
    )
    low, high = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("low", "high"))
    if size["n"] != size["least"]:
        low, high = np.minimum(low, 0), np.maximum(high, 0)
    return low, high


class Cells:
    """Equal cells of each dimension, 2 ** bits of them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.low = low
        self.width = np.maximum(1, -(-(high - low + 1) // (1 << bits)))

    def numbers(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def corners(self, cells: np.ndarray) -> np.ndarray:
        """The least vector of each cell."""
        return self.low + cells.astype(np.int64) * self.width


def padded(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Ragged vectors as rows of ``size``, zeros behind the short ones."""
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == size).all():
        return values.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size), dtype=np.int64)
    at = np.arange(size)[None, :] < lengths[:, None]
    out[at] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, by floating point where no sum can pass its exact range."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


NEAR = "query bigint, row bigint, lower bigint, upper bigint"
#: Below every bound.
NONE = np.iinfo(np.int64).min


def near_of_block(rows, cells, query_rows, queries, floors, grid: Cells, k: int):
    """(query, row, lower, upper) of the rows of a block that may be among the k best of a query: their upper bound reaches ``floors``, a bound
    of the query's kth score, and the kth highest lower bound of the block. A query's own row is left out."""
    corner = products(queries, grid.corners(cells))
    slack = grid.width - 1
    upper = corner + (np.maximum(queries, 0) @ slack)[:, None]
    lower = corner + (np.minimum(queries, 0) @ slack)[:, None]
    own = query_rows[:, None] == rows[None, :]
    lower[own] = NONE
    least = floors
    if len(rows) > k:  # with the own row among them there are k others
        least = np.maximum(least, np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k])
    query, row = np.nonzero((upper >= least[:, None]) & ~own)
    return query_rows[query], rows[row], lower[query, row], upper[query, row]


def _ranked(near: DataFrame, order: list, k: int, name: str = "rank") -> DataFrame:
    window = Window.partitionBy("query").orderBy(*order)
    return near.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    cell_bits: int = CELL_BITS,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``vectors`` with the highest inner product.

    Both are (row, vec_id, vector of long) as ``integer_vectors`` makes them; ``queries`` are some of the rows of ``vectors``, or others with row numbers of their own. A
    query's own row is no candidate, another row with its id is; ties go to the smaller id, a null last; with fewer than k candidates all
    are returned. A vector that is shorter than another counts as filled up with zeros.
    Scores must fit 64 bits, cells a byte (``cell_bits`` of 8 at most). No queries, or no vectors, give no rows.
    """
    queries = cut_lineage(queries)
    n, m = vectors.count(), queries.count()
    low, high = _bounds(vectors)
    if not n or not m:
        return queries.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score")
        ).limit(0)
    grid, dimensions = Cells(low, high, cell_bits), len(low)

    def approximate(batches):
        for batch in batches:
            lists = batch.column(1)
            rows = padded(lists.values.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), dimensions)
            cells = [c.tobytes() for c in grid.numbers(rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["row", "cells"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left["row"].to_numpy()
        cells = np.frombuffer(b"".join(left["cells"].to_pylist()), dtype=np.uint8).reshape(len(rows), dimensions)
        lists = right["vector"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        cut = np.minimum(np.diff(offsets), dimensions)
        values = lists.values.to_numpy()
        if (np.diff(offsets) > dimensions).any():  # what the vectors do not have scores nothing
            values = np.concatenate([values[a : a + c] for a, c in zip(offsets, cut)])
            offsets = np.r_[0, np.cumsum(cut)]
        asked = padded(values[offsets[0] : offsets[-1]], offsets - offsets[0], dimensions)
        floors = right["floor"].to_numpy()
        columns = near_of_block(rows, cells, right["row"].to_numpy(), asked, floors, grid, k)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "row", "lower", "upper"])

    blocks, query_blocks = -(-n // block_vectors), -(-m // block_queries)
    dealt = lambda name, of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int").alias(name)
    file = vectors.select("row", "vector").mapInArrow(approximate, "row bigint, cells binary").select("*", dealt("block", blocks))
    file = cut_lineage(file)

    def scanned(first: int, last: int, asked: DataFrame) -> DataFrame:
        """What the blocks from ``first`` to ``last`` pass on; ``asked`` has a floor for each query."""
        every = lambda name, low, high: F.explode(F.sequence(F.lit(low), F.lit(high))).alias(name)
        there = file.where(F.col("block").between(first, last)).select("row", "cells", "block", every("query_block", 0, query_blocks - 1))
        here = asked.select("row", "vector", "floor", dealt("query_block", query_blocks), every("block", first, last))
        pair = ["block", "query_block"]
        return there.groupBy(*pair).cogroup(here.groupBy(*pair)).applyInArrow(search, NEAR)

    near = cut_lineage(scanned(0, 0, queries.withColumn("floor", F.lit(int(NONE)).cast("bigint"))))
    if blocks > 1:
        kth = _ranked(near, [F.desc("lower"), "row"], k).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("lower").alias("floor"))
        asked = queries.join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(int(NONE)).cast("bigint")))
        near = cut_lineage(near.unionByName(scanned(1, blocks - 1, cut_lineage(asked))))
    vector = lambda name, of: of.select(F.col("row").alias(name), F.col("vector").alias(f"{name}_vector"))

    def exact(pairs: DataFrame) -> DataFrame:
        """Their scores, from the vectors of the rows that they name."""
        both = pairs.join(vector("row", vectors), "row").join(vector("query", queries), "query")
        product = F.zip_with("row_vector", "query_vector", lambda x, y: F.coalesce(x * y, F.lit(0).cast("bigint")))
        return both.select("query", "row", F.aggregate(product, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("score"))

    highest = cut_lineage(exact(_ranked(near, [F.desc("upper"), "row"], k).select("query", "row")))
    certain = highest.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("certain"))
    rest = near.join(certain, "query").where(F.col("certain").isNull() | (F.col("upper") >= F.col("certain"))).select("query", "row")
    found = highest.unionByName(exact(rest.join(highest, ["query", "row"], "left_anti")))
    named = found.join(vectors.select("row", "vec_id"), "row")
    best = _ranked(named, [F.desc("score"), F.asc_nulls_last("vec_id")], k)
    ids = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query").select("query_id", "rank", "vec_id", "score")

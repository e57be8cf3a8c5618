"""De-duplication, caps, pages, samples and disjoint strata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thriftlens.operators.spread import null_safe_join, pick_first, with_row
from thriftlens.session import cut_lineage


def latest_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in ``order``."""
    return pick_first(df, key, [F.col(c).desc_nulls_last() for c in order])


def first_by_key(sources: Sequence[DataFrame], key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union in which the first source that has a key supplies its row. ``order`` settles repeats
    within one source."""
    ranked = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return pick_first(union, key, [F.col("_source"), *[F.col(c) for c in order]]).drop("_source")


def dedupe(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return pick_first(df, key, [F.col(c) for c in order])


def work_list(parts: Sequence[DataFrame], done: DataFrame, key: str) -> DataFrame:
    """Keys of all parts, each once, less those already done."""
    union = reduce(lambda a, b: a.union(b), [p.select(key) for p in parts]).distinct()
    return union.join(done.select(key), key, "left_anti")


def cap_per_key(df: DataFrame, key: str, n: int, order: Sequence[Column]) -> DataFrame:
    return pick_first(df, [key], order, n)


def top_n(df: DataFrame, n: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows with their rank. Only those ``n`` rows meet in one task."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def shortlist(scored: DataFrame, n: int = 500, per_brand: int = 15, key: str = "item_id") -> DataFrame:
    """Flagged rows: largest discount first, at most ``per_brand`` of a brand, ``n`` in all."""
    order = [F.col("discount_pct").desc(), F.col(key)]
    return top_n(cap_per_key(scored, "brand", per_brand, order), n, order)


def keyset_page(df: DataFrame, key: str, after: str | None, n: int) -> DataFrame:
    rest = df if after is None else df.where(F.col(key) > after)
    return rest.orderBy(key).limit(n)


def page(df: DataFrame, predicates: Sequence[Column], sort: Sequence[Column], n: int = 60, offset: int = 0, key: str = "item_id") -> DataFrame:
    """One page of the filtered rows, with the exact number of them on the first page."""
    hits = reduce(lambda a, p: a.where(p), predicates, df)
    rows = hits.orderBy(*sort, F.col(key)).offset(offset).limit(n)
    if offset:
        return rows.withColumn("total", F.lit(None).cast("long"))
    return with_row(rows, hits.agg(F.count(F.lit(1)).alias("total")))


def next_bucket(spark: SparkSession, pool: DataFrame, buckets: int = 24) -> DataFrame:
    """The bucket swept longest ago; one never swept comes first."""
    swept = pool.groupBy("bucket").agg(F.max("swept_on").alias("swept_on"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return (
        every.join(swept, "bucket", "left")
        .orderBy(F.col("swept_on").asc_nulls_first(), "bucket")
        .limit(1)
    )


def hash_order(key: Column, seed: str | int = "") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


# Cells per doubling of a hash. The cell that holds position n holds about an eleventh of the rows before it.
HASH_CELLS_PER_OCTAVE = 8


def hash_cell(hashed: Column) -> Column:
    """A cell number that never falls as the hex digits rise: 416 cells, each an eighth of a doubling. The first
    52 bits decide, so cells are narrow where the order begins and a few hundred say where any position lies."""
    head = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double")
    return F.floor(F.log2(head + 1) * HASH_CELLS_PER_OCTAVE).cast("int")


def smallest_cells(df: DataFrame, n: int | Column, cell: Column, keys: Sequence[str] = (), few: bool = False) -> DataFrame:
    """The rows in the cells up to the one that holds position ``n``, of the whole table or of each group of ``keys`` (``n`` may be a column
    of them): all of the first ``n`` rows of any order along which ``cell`` never falls, and the rest of one cell.

    A first read counts rows by cell, which combines before the shuffle; in the second read the filter needs no shuffle. What follows, a limit or a row number, then moves
    about ``n`` rows of a group, however many rows and tasks there are. ``df`` is read twice, so it must give the same rows twice. Where the caller knows that groups are
    ``few``, their last cells are broadcast, and no row is shuffled by its group to meet them.
    """
    keys, position = list(keys), F.lit(n) if isinstance(n, int) else n
    marked = df.withColumn("_cell", cell)
    counts = marked.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(upto), F.lit(0))
    ends = counts.withColumn("_before", before).where(F.col("_before") < position)
    ends = ends.groupBy(*keys).agg(F.max("_cell").alias("_last"))
    bounded = null_safe_join(marked, F.broadcast(ends) if few else ends, keys) if keys else with_row(marked, ends)
    return bounded.where(F.col("_cell") <= F.col("_last")).drop("_cell", "_last")


def first_by_hash(df: DataFrame, n: int, seed: str | int, key: str = "item_id") -> DataFrame:
    """The first ``n`` rows in hash order, also for an ``n`` too large for one task: rows in the cells before the one that holds position ``n`` are taken as
    they are, and only that cell is put in order. About ``n`` rows are written on the way."""
    marked = df.withColumn("_h", hash_order(F.col(key), seed))
    near = cut_lineage(smallest_cells(marked, n, hash_cell(F.col("_h"))).withColumn("_cell", hash_cell(F.col("_h"))))
    last = near.agg(F.max("_cell").alias("_last"))
    inside = with_row(near, last)
    whole = inside.where(F.col("_cell") < F.col("_last"))
    rest = with_row(inside.where(F.col("_cell") == F.col("_last")), whole.agg(F.count(F.lit(1)).alias("_whole")))
    nth = F.row_number().over(Window.orderBy("_h", key))
    edge = rest.withColumn("_nth", nth).where(F.col("_nth") + F.col("_whole") <= n)
    return whole.drop("_h", "_cell", "_last").unionByName(edge.drop("_h", "_cell", "_last", "_nth", "_whole"))


def first_per_group(df: DataFrame, keys: Sequence[str], n: int | Column, seed: str | int, key: str = "item_id", name: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in hash order; ``name`` keeps their number in a column of that name."""
    marked = df.withColumn("_h", hash_order(F.col(key), seed))
    near = smallest_cells(marked, n, hash_cell(F.col("_h")), keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", key))
    taken = near.withColumn(name or "_nth", nth).where(F.col(name or "_nth") <= n)
    return taken.drop("_h") if name else taken.drop("_h", "_nth")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows that depend on the keys and the seed only. Rows beyond the cell of the hash that holds position ``n`` are
    left out where they are read."""
    hashed = hash_order(F.col(key), seed)
    return smallest_cells(df, n, hash_cell(hashed)).orderBy(hashed, key).limit(n)


def assign_strata(df: DataFrame, strata: Mapping[str, Column], quotas: Mapping[str, int], key: str = "item_id", seed: str = "cohort") -> DataFrame:
    """(key, stratum): strata claim items in order, each up to its quota, hash order within one.

    At most the quotas of the earlier strata can be claimed before a stratum's turn, so its picks
    lie among the first (own + earlier quotas) of its candidates. One read spreads every row over the strata it
    fits and counts them by cells of the hash, a second one keeps those first candidates and the rest of one cell, and the claiming runs on that small table.
    """
    fits = F.array(*[F.when(predicate, F.lit(i)) for i, predicate in enumerate(strata.values())])
    each = df.select(key, hash_order(F.col(key), seed).alias("_h"), F.explode(fits).alias("_s")).where(F.col("_s").isNotNull())
    reach = list(accumulate(quotas[name] for name in strata))
    mine = F.element_at(F.array(*[F.lit(r) for r in reach]), F.col("_s") + 1)
    near = smallest_cells(each, mine, hash_cell(F.col("_h")), ["_s"], few=True)
    order = Window.partitionBy("_s").orderBy("_h", key)
    first = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= mine)
    candidates = cut_lineage(first.drop("_rank"))
    return _claimed(candidates, list(strata), quotas, key)


def _claimed(candidates: DataFrame, names: Sequence[str], quotas: Mapping[str, int], key: str) -> DataFrame:
    """What the strata, numbered in ``_s``, claim of the first candidates of each."""
    claimed = None
    for i, name in enumerate(names):
        mine = candidates.where(F.col("_s") == i).drop("_s")
        if claimed is not None:
            mine = mine.join(claimed.select(key), key, "left_anti")
        picked = mine.orderBy("_h", key).limit(quotas[name]).select(key, F.lit(name).alias("stratum"))
        claimed = picked if claimed is None else cut_lineage(claimed.unionByName(picked))
    return claimed

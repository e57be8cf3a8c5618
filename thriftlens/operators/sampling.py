"""Enrolment strata with known weights, and the censuses they rest on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.selecting import cap_per_key, first_by_hash, first_per_group, hash_order
from thriftlens.operators.spread import null_safe_join, with_row

# Fixed values of the sampling design.
BRAND_FLOOR = 500
BRAND_CAP = 700
NEW_DAYS = 3
NEW_PER_BRAND = 25
# Price cells of the tail walk, in kronor.
TAIL_EDGES_KR = [100, 125, 150, 175, 200, 250, 300, 350, 400, 500, 600, 800, 1000, 1500, 2500]


def not_enrolled(hits: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Hits not held yet. An enrolled item keeps its stratum and weight."""
    return hits.join(items.select(key), key, "left_anti")


def brand_band_population(hits: DataFrame, edges: Sequence[int] = s.PRICE_BAND_EDGES_ORE) -> DataFrame:
    return (
        hits.where(F.col("brand").isNotNull())
        .groupBy("brand", s.price_band(F.col("price_ore"), edges).alias("price_band"))
        .agg(F.count(F.lit(1)).alias("population"))
    )


def big_brands(hits: DataFrame, floor: int = BRAND_FLOOR) -> DataFrame:
    named = hits.where(F.col("brand").isNotNull())
    return named.groupBy("brand").agg(F.count(F.lit(1)).alias("population")).where(F.col("population") >= floor)


def stratum_a(hits: DataFrame, floor: int = BRAND_FLOOR, cap: int = BRAND_CAP, edges: Sequence[int] = s.PRICE_BAND_EDGES_ORE, key: str = "item_id") -> DataFrame:
    """Brands with ``floor`` listings, an equal quota from each price band, by hash. The weight is
    the cell's population over the rows taken from it."""
    quota = cap // (len(edges) + 1)
    banded = hits.withColumn("price_band", s.price_band(F.col("price_ore"), edges))
    banded = banded.join(big_brands(hits, floor).select("brand"), "brand", "left_semi")
    cell = ["brand", "price_band"]
    taken = first_per_group(banded, cell, quota, "A", key)
    weight = F.col("population") / F.least(F.col("population"), F.lit(quota))
    return (
        taken.join(brand_band_population(hits, edges), cell)
        .withColumn("sample_weight", weight)
        .withColumn("stratum", F.lit("A"))
        .drop("population")
    )


def sample_weights(items: DataFrame, population: DataFrame) -> DataFrame:
    """Weight of each (brand, price band) cell: population over sampled rows."""
    cell = ["brand", "price_band"]
    held = items.groupBy(*cell).agg(F.count(F.lit(1)).alias("sampled"))
    return population.join(held, cell).select(
        *cell, "population", "sampled", s.ratio(F.col("population"), F.col("sampled")).alias("sample_weight")
    )


def reweigh(items: DataFrame, population: DataFrame) -> DataFrame:
    """``items`` with the weight of their cell; rows of unknown cells keep theirs."""
    cell = ["brand", "price_band"]
    fresh = sample_weights(items, population).select(*cell, F.col("sample_weight").alias("_w"))
    joined = items.join(fresh, cell, "left")
    return joined.withColumn("sample_weight", F.coalesce("_w", "sample_weight")).drop("_w")


def tail_cell(price: Column, edges_kr: Sequence[int] = TAIL_EDGES_KR) -> Column:
    """Number of the price cell; prices under the first edge are in none."""
    edges = [e * 100 for e in edges_kr]
    chain = F.when(price < edges[0], F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        chain = chain.when(price < upper, F.lit(i))
    return chain.when(price.isNotNull(), F.lit(len(edges) - 1))


def stratum_b(hits: DataFrame, big: DataFrame, target: int, edges_kr: Sequence[int] = TAIL_EDGES_KR, key: str = "item_id") -> DataFrame:
    """Tail brands by (price cell, category). Whole cells are examined, and ``target`` is spread over them by their
    size, one row of each at least, in hash order. A kept row weighs the cell's tail population over the rows kept of it, so the weights
    sum to the tail. Prices under the first edge are a cell of their own."""
    cell = ["price_cell", "category"]
    tail = hits.where(F.col("brand").isNotNull()).join(big.select("brand"), "brand", "left_anti")
    tail = tail.withColumn("price_cell", F.coalesce(tail_cell(F.col("price_ore"), edges_kr), F.lit(-1)))
    population = tail.groupBy(*cell).agg(F.count(F.lit(1)).alias("population"))
    total = population.agg(F.sum("population").alias("_total"))
    share = F.floor(F.col("population") * target / F.col("_total")).cast("long")
    quotas = with_row(population, total).withColumn("_quota", F.greatest(share, F.lit(1).cast("long"))).drop("_total")
    return (
        first_per_group(null_safe_join(tail, quotas, cell), [*cell, "_quota"], F.col("_quota"), "B", key)
        .withColumn("sample_weight", F.col("population") / F.least("population", "_quota"))
        .withColumn("stratum", F.lit("B"))
        .withColumn("price_band", s.price_band(F.col("price_ore")))
        .drop("price_cell", "_quota", "population")
    )


def stratum_n(hits: DataFrame, items: DataFrame, today: Column, days: int = NEW_DAYS, per_brand: int = NEW_PER_BRAND, target: int = 20000, key: str = "item_id") -> DataFrame:
    """Listings first offered within ``days``, at most ``per_brand`` of a brand, not held yet. The
    weight is the number of new listings over the rows kept."""
    new = hits.where((F.col("first_offered") >= F.date_sub(today, days)) & (F.col("first_offered") <= today))
    order = [hash_order(F.col(key), "N"), F.col(key)]
    capped = cap_per_key(new.where(F.col("brand").isNotNull()), "brand", per_brand, order)
    free = not_enrolled(capped, items, key)
    kept = first_by_hash(free, target, "N", key)
    total = new.agg(F.count(F.lit(1)).alias("_new"))
    number = free.agg(F.least(F.count(F.lit(1)), F.lit(target)).alias("_kept"))
    return (
        with_row(with_row(kept, total), number)
        .withColumn("sample_weight", s.ratio(F.col("_new"), F.col("_kept")))
        .withColumn("stratum", F.lit("N"))
        .withColumn("price_band", s.price_band(F.col("price_ore")))
        .drop("_new", "_kept")
    )


def stratum_c(hits: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Census of resale listings: all of them, weight one."""
    return (
        not_enrolled(hits.where("p2p"), items, key)
        .withColumn("sample_weight", F.lit(1.0))
        .withColumn("stratum", F.lit("C"))
        .withColumn("price_band", s.price_band(F.col("price_ore")))
    )


def census_shortfall(items: DataFrame, population: DataFrame) -> DataFrame:
    """Resale rows held against the number that exists; a shortfall makes weight one wrong."""
    held = items.where("p2p").agg(F.count(F.lit(1)).alias("held"))
    total = population.where("p2p").agg(F.count(F.lit(1)).alias("population"))
    short = F.greatest(F.col("population") - F.col("held"), F.lit(0))
    return with_row(held, total).withColumn("shortfall", short).withColumn("warning", short > 0)


def cell_census(items: DataFrame, categories: DataFrame, edges_kr: Sequence[int] = TAIL_EDGES_KR) -> DataFrame:
    """Population of every (price cell, category) of the table of ``categories``, empty cells included. Prices under the first edge
    and missing ones are in cell -1, as in ``stratum_b``; categories that only ``items`` has follow with the cells they fill, so the
    populations sum to the number of items."""
    cells = F.explode(F.sequence(F.lit(-1), F.lit(len(edges_kr) - 1)))
    grid = categories.select(cells.alias("cell"), "category")
    counts = (
        items.withColumn("_cell", F.coalesce(tail_cell(F.col("price_ore"), edges_kr), F.lit(-1)))
        .groupBy("_cell", F.col("category").alias("_category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    same = (F.col("cell") == F.col("_cell")) & F.col("category").eqNullSafe(F.col("_category"))
    # A counted row has its own cell and category, a grid row without one keeps the grid's.
    category = F.when(F.col("_cell").isNull(), F.col("category")).otherwise(F.col("_category"))
    return grid.join(counts, same, "full").select(
        F.coalesce("cell", "_cell").alias("cell"), category.alias("category"), F.coalesce("n", F.lit(0)).alias("n")
    )


def target_size_counts(items: DataFrame, target_sizes: DataFrame, key: str = "item_id") -> DataFrame:
    """Listings per size bucket, and per demography shape. An item with several sizes counts once
    in every bucket it fits, so counts overlap. A bucket is held to a demography where its sizes
    name exactly one; a shape is the sizes of one demography."""
    who = F.col("demography")
    named = target_sizes.groupBy("bucket").agg(F.min(who).alias("_lo"), F.max(who).alias("_hi"))
    buckets = target_sizes.join(
        named.select("bucket", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_who")), "bucket"
    ).select("size_code", F.lit("bucket").alias("kind"), F.col("bucket").alias("name"), "_who")
    shape = F.coalesce(who, F.lit("size implies wearer"))
    shapes = target_sizes.select("size_code", F.lit("shape").alias("kind"), shape.alias("name"), who.alias("_who"))
    on = (F.col("_size") == F.col("size_code")) & (F.col("_who").isNull() | (F.col("_who") == F.col("demography")))
    sizes = items.select(key, "demography", F.explode(F.array_distinct("sizes")).alias("_size"))
    once = sizes.join(buckets.unionByName(shapes), on).select(key, "kind", "name").distinct()
    return once.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))

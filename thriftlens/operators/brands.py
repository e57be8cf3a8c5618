"""Brand snapshots, attention for the mix a brand lists, inflow, trends and demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.spread import null_safe_join, pick_first, positions_median, positions_of_counts, with_quantiles, with_row
from thriftlens.session import cut_lineage


def attention_index(live: DataFrame, as_of: Column, min_cell: int = 30, band_edges: Sequence[int] = s.PRICE_BAND_EDGES_ORE) -> DataFrame:
    """Likes of a brand over the likes the market gives the same basket of garment, price band and
    age. A thin cell falls back to the mean of its (band, age).

    The rows are first reduced to sums per (brand, garment, band, age), a small table that is written; cell means come from those
    sums, so the listings are read and shuffled once and no cell table is joined to single listings.
    """
    age = s.age_bucket(F.greatest(F.datediff(as_of, F.col("first_offered")), F.lit(0)))
    basket = (
        live.select(
            "brand",
            "item_type",
            s.price_band(F.col("price_ore"), band_edges).alias("band"),
            age.alias("age"),
            "favourites",
        )
        .groupBy("brand", "item_type", "band", "age")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("favourites").alias("likes"))
    )
    basket = cut_lineage(basket)
    cell = basket.groupBy("item_type", "band", "age").agg(
        F.sum("n").alias("cell_n"), F.sum("likes").alias("cell_likes")
    )
    wide = cell.groupBy("band", "age").agg(
        F.sum("cell_n").alias("wide_n"), F.sum("cell_likes").alias("wide_likes")
    )
    cell = cell.join(wide, ["band", "age"])
    mean = F.when(
        F.col("cell_n") >= min_cell, F.col("cell_likes") / F.col("cell_n")
    ).otherwise(F.col("wide_likes") / F.col("wide_n"))
    expected = cell.select("item_type", "band", "age", mean.alias("mean"))
    sums = (
        basket.join(expected, ["item_type", "band", "age"])
        .groupBy("brand")
        .agg(
            F.sum("n").alias("listings"),
            F.sum("likes").alias("likes"),
            F.sum(F.col("n") * F.col("mean")).alias("expected_likes"),
        )
    )
    return sums.select(
        "brand",
        "listings",
        (F.col("likes") / F.col("listings")).alias("avg_favourites"),
        (F.col("expected_likes") / F.col("listings")).alias("expected_favourites"),
        s.ratio(F.col("likes"), F.col("expected_likes")).alias("attention_index"),
    )


def inflow(items: DataFrame, as_of: Column, days: int = 7, key: str = "brand") -> DataFrame:
    """Listings first offered in the ``days`` before a date, and their share of the key's shelf."""
    fresh = (F.col("first_offered") >= F.date_sub(as_of, days)) & (F.col("first_offered") < as_of)
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if(fresh).alias("inflow"),
        s.ratio(F.count_if(fresh), F.count(F.lit(1))).alias("inflow_share"),
    )


def brand_snapshot(items: DataFrame, as_of: Column, min_live: int = 25, since: Column | None = None) -> DataFrame:
    """One row per brand with ``min_live`` live listings: asks, likes, and the share sold per day
    since the previous pass."""
    since = F.date_sub(as_of, 1) if since is None else since
    live = F.col("outcome").isNull()
    just_sold = (F.col("outcome") == s.SOLD) & (F.col("resolved_on") > since) & (F.col("resolved_on") <= as_of)
    rows = items.where(live | F.coalesce(just_sold, F.lit(False)))
    summary = (
        rows.groupBy("brand")
        .agg(
            F.count_if(live).alias("listings"),
            F.avg(F.when(live, F.col("favourites"))).alias("avg_favourites"),
            F.count_if(just_sold).alias("sold"),
        )
        .where(F.col("listings") >= min_live)
    )
    days = F.datediff(as_of, since)
    out = with_quantiles(summary, rows.where(live), ["brand"], {"ask_ore": "price_ore"})
    rate = F.col("sold") / (F.col("listings") + F.col("sold")) / days * 100
    return out.withColumn("sold_pct_day", rate).withColumn("as_of", as_of)


SHELF_SUMS = ["n", "n_likes", "likes"]


def shelf_counts(live: DataFrame) -> DataFrame:
    """(brand, price_ore, n, n_likes, likes): how many live listings of a brand ask which price, and their likes. The counts of different listings add up."""
    return live.groupBy("brand", "price_ore").agg(
        F.count(F.lit(1)).alias("n"), F.count("favourites").alias("n_likes"), F.coalesce(F.sum("favourites"), F.lit(0)).alias("likes")
    )


def merged_counts(counts: DataFrame, went: DataFrame, came: DataFrame) -> DataFrame:
    """``shelf_counts`` of a shelf after a day: those of the day before, less the listings that ``went`` as they were, with those that ``came`` as they
    are. A listing whose price or likes moved is in both. No listing that stayed as it was is read."""
    gone = shelf_counts(went).withColumns({c: -F.col(c) for c in SHELF_SUMS})
    every = counts.unionByName(gone).unionByName(shelf_counts(came))
    summed = every.groupBy("brand", "price_ore").agg(*[F.sum(c).alias(c) for c in SHELF_SUMS])
    return summed.where(F.col("n") != 0)


def snapshot_of_counts(counts: DataFrame, sold: DataFrame, as_of: Column, days: int = 1, min_live: int = 25) -> DataFrame:
    """``brand_snapshot`` from ``shelf_counts`` and the number of listings of a brand that sold in the last ``days`` (brand, sold). Exact, medians too."""
    summary = (
        counts.groupBy("brand")
        .agg(F.sum("n").alias("listings"), s.ratio(F.sum("likes"), F.sum("n_likes")).alias("avg_favourites"))
        .where(F.col("listings") >= min_live)
    )
    # No key of positions may be null, so a missing brand is told by a key of its own.
    keys = [F.coalesce("brand", F.lit("")).alias("_brand"), F.col("brand").isNotNull().alias("_named")]
    equal = counts.where(F.col("price_ore").isNotNull()).select(*keys, "price_ore", F.col("n").alias("n_equal"))
    medians = positions_median(positions_of_counts(equal, ["_brand", "_named"], "price_ore"), ["_brand", "_named"], "price_ore")
    asks = medians.select(F.when(F.col("_named"), F.col("_brand")).alias("brand"), F.col("median").alias("med_ask_ore"))
    joined = null_safe_join(null_safe_join(summary, asks, ["brand"], "left"), sold, ["brand"], "left").withColumn("sold", F.coalesce("sold", F.lit(0).cast("long")))
    rate = F.col("sold") / (F.col("listings") + F.col("sold")) / days * 100
    return joined.select("brand", "listings", "avg_favourites", "sold", "med_ask_ore", rate.alias("sold_pct_day"), as_of.alias("as_of"))


def brand_trend(brand_daily: DataFrame, days: int = 7, min_listings: int = 100) -> DataFrame:
    """Newest snapshot of each brand against the newest one at least ``days`` older. No rows while
    no two snapshots lie that far apart; ``days_apart`` is the real gap."""
    newest = brand_daily.agg(F.max("as_of").alias("new_on"))
    dated = with_row(brand_daily, newest)
    base = dated.where(F.datediff("new_on", "as_of") >= days).agg(F.max("as_of").alias("base_on"))
    now = dated.where((F.col("as_of") == F.col("new_on")) & (F.col("listings") >= min_listings))
    old = with_row(brand_daily, base).where(F.col("as_of") == F.col("base_on"))
    old = old.select("brand", "base_on", *[F.col(c).alias(f"{c}_then") for c in ("listings", "attention_index")])
    return now.join(old, "brand").select(
        "brand",
        "new_on",
        "base_on",
        F.datediff("new_on", "base_on").alias("days_apart"),
        "listings",
        (F.col("listings") - F.col("listings_then")).alias("listings_change"),
        (F.col("attention_index") - F.col("attention_index_then")).alias("attention_change"),
    )


def brand_demand(items: DataFrame, prior: int = 10) -> DataFrame:
    """Mean likes of a brand over the market mean, drawn toward 1 by ``prior`` average listings."""
    sums = items.where(F.col("brand").isNotNull()).groupBy("brand").agg(
        F.count("favourites").alias("n"), F.sum("favourites").alias("likes")
    )
    market = sums.agg((F.sum("likes") / F.sum("n")).alias("market_mean"))
    raw = s.ratio(F.col("likes") / F.nullif(F.col("n"), F.lit(0)), F.col("market_mean"))
    index = (F.col("n") * F.coalesce(raw, F.lit(1.0)) + prior) / (F.col("n") + prior)
    return with_row(sums, market).select("brand", "n", index.alias("demand_index"))


def brand_history(ladders: DataFrame, min_n: int = 5) -> DataFrame:
    """Resolved history per brand: aggregated once, to be joined by brand."""
    summary = (
        ladders.where(F.col("brand").isNotNull())
        .groupBy("brand")
        .agg(F.count(F.lit(1)).alias("resolved"), s.ratio(F.count_if("sold"), F.count(F.lit(1))).alias("sell_through"))
        .where(F.col("resolved") >= min_n)
    )
    kept = s.ratio(F.col("final_price_ore"), F.col("opening_ask_ore"))
    return with_quantiles(summary, ladders, ["brand"], {"days": "days_on_market", "kept": kept})


def brand_sample(items: DataFrame, brands: DataFrame, k: int = 3, only_missing: bool = True) -> DataFrame:
    """``k`` live listings per brand, by hash, optionally only of brands without a tier."""
    rows = items.where(F.col("outcome").isNull() & F.col("brand").isNotNull())
    if only_missing:
        rows = rows.join(brands.where(F.col("price_point").isNull()).select("brand"), "brand", "left_semi")
    return pick_first(rows, ["brand"], [F.md5("item_id"), F.col("item_id")], k)


def lagged_effect(observations: DataFrame, change: Column, outcome: Column) -> DataFrame:
    """Rate of an outcome in pass N by whether a change was seen in pass N-1. A listing is in a
    pass at most once, so a listing's rows are as many as there are passes.

    ``change`` is evaluated on a row and its predecessor (``prev_*`` columns of price and likes);
    ``outcome`` on the row of the pass itself.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("item_id").orderBy("pass_on")
    seen = observations.select(
        "*",
        F.lag("price_ore").over(w).alias("prev_price_ore"),
        F.lag("favourites").over(w).alias("prev_favourites"),
    ).withColumn("_change", change)
    seen = seen.withColumn("changed_before", F.lag("_change").over(w))
    return (
        seen.where(F.col("changed_before").isNotNull())
        .groupBy("changed_before")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(outcome).alias("hits"), s.ratio(F.count_if(outcome), F.count(F.lit(1))).alias("rate"))
    )

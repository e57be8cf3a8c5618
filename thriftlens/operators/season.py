"""Seasonality, clearing ratios and reference values of resolved listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.ladders import kept_share
from thriftlens.operators.spread import group_quantiles, with_quantiles

SEASONS = ["Vinter", "Sommar"]


def season_curve(ladders: DataFrame, min_cell: int = 8) -> DataFrame:
    """For sold items of exactly one season: count, median price, share of the ask kept, and days,
    by month of sale."""
    rows = ladders.where(F.col("sold") & F.col("season").isin(*SEASONS))
    rows = rows.withColumn("month", F.month("ended_on"))
    summary = rows.groupBy("season", "month").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cell)
    measures = {"price_ore": "final_price_ore", "kept": kept_share(), "days": "days_on_market"}
    return with_quantiles(summary, rows, ["season", "month"], measures)


def season_spread(curve: DataFrame, keep_share: float = s.KEEP_SHARE) -> DataFrame:
    """Best over worst month of a season, gross and after the venue's share."""
    order = F.struct("med_kept", "month")
    ends = curve.groupBy("season").agg(
        F.max_by("month", order).alias("best_month"),
        F.max("med_kept").alias("best_kept"),
        F.min_by("month", order).alias("worst_month"),
        F.min("med_kept").alias("worst_kept"),
    )
    gross = s.ratio(F.col("best_kept"), F.col("worst_kept"))
    return ends.withColumn("gross", gross).withColumn("net", gross * keep_share)


def clearing_ratio(ladders: DataFrame) -> DataFrame:
    """Median of clearing over landing price by brand, category and month of sale; sold items."""
    sold = ladders.where("sold").withColumn("month", F.month("ended_on"))
    keys = ["brand", "category", "month"]
    summary = sold.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return with_quantiles(summary, sold, keys, {"ratio": kept_share()}).withColumnRenamed(
        "med_ratio", "clearing_ratio"
    )


def buy_rule(items: DataFrame, ratios: DataFrame, month: int, p_sell: Column | float = 1.0, share: float = 0.8, costs_ore: int = 0) -> DataFrame:
    """Live items whose expected clearing price in the target month, after the share kept and the
    chance to sell, exceeds the price now plus costs."""
    target = ratios.where(F.col("month") == month).select("brand", "category", "clearing_ratio")
    chance = p_sell if isinstance(p_sell, Column) else F.lit(p_sell)
    est = F.col("first_price_ore") * F.col("clearing_ratio")
    return (
        items.join(target, ["brand", "category"])
        .withColumn("est_clearing_ore", est)
        .withColumn("edge_ore", share * est * chance - F.col("price_ore") - costs_ore)
        .where(F.col("edge_ore") > 0)
    )


REFERENCE_KEYS = ("brand", "category", "condition", "size_band")


def reference_value(ladders: DataFrame, keys: Sequence[str] = REFERENCE_KEYS) -> DataFrame:
    """Median clearing price of sold items per kind."""
    values = group_quantiles(ladders.where("sold"), list(keys), {"value_ore": "final_price_ore"})
    return values.withColumnRenamed("med_value_ore", "value_ore")


def value_edge(items: DataFrame, values: DataFrame, keys: Sequence[str] = REFERENCE_KEYS) -> DataFrame:
    """Live items with the reference value of their kind over their ask."""
    joined = items.join(values, list(keys))
    return joined.withColumn("edge", s.ratio(F.col("value_ore"), F.col("price_ore")))


def season_history(offers: DataFrame, details: DataFrame) -> DataFrame:
    """Ladder summary of every season-tagged listing that has ended: the history behind the curve.

    ``offers`` may come from several scans; ``details`` carry status, season and attributes.
    """
    from thriftlens.operators.ladders import ladder_rows

    tagged = details.where(F.col("season").isNotNull())
    mine = offers.join(tagged.select("item_id"), "item_id", "left_semi")
    return ladder_rows(mine, tagged).where(F.col("ended_on").isNotNull())

"""Buy-and-resell trades: both ladders of a resale, its origin, and whether it paid.

Money is in öre throughout; ``ladders`` are rows of ``ladder_summary``, or a function that makes them of the listings that
a filter by ``item_id`` keeps: where listings are joined to get their ladders, the filter then stands before that join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.cohort import final_outcomes
from thriftlens.operators.spread import nearly_among, with_quantiles
from thriftlens.session import cut_lineage


def _bought(ladders: DataFrame) -> DataFrame:
    """The last price an original ever carried is what the reseller paid for it."""
    return ladders.select(
        F.col("item_id").alias("original_id"),
        F.col("opening_ask_ore").alias("original_opening_ore"),
        F.col("rungs").alias("original_rungs"),
        F.col("final_price_ore").alias("bought_price_ore"),
        F.col("ended_on").alias("bought_on"),
        s.decay(F.col("opening_ask_ore"), F.col("final_price_ore")).alias("bought_discount"),
    )


def _linked(resales: DataFrame) -> DataFrame:
    """The resales with a pointer, as a table: few of all listings, they filter the ladders before these are shuffled, and are joined then."""
    return cut_lineage(resales.where(F.col("original_id").isNotNull()).select("item_id", "original_id"))


Ladders = DataFrame | Callable[[Callable[[DataFrame], DataFrame]], DataFrame]


def _near(ladders: Ladders, linked: DataFrame, named: str) -> DataFrame:
    """The ladders of the listings that the column ``named`` of ``linked`` names, and a few others."""

    def near(rows: DataFrame) -> DataFrame:
        return nearly_among(rows, "item_id", linked, named)

    return ladders(near) if callable(ladders) else near(ladders)


def origins(resales: DataFrame, ladders: Ladders) -> DataFrame:
    """Purchase side of each resale. No pointer drops the row; a pointer whose original has no
    ladder keeps it with nulls."""
    linked = _linked(resales)
    return linked.join(_bought(_near(ladders, linked, "original_id")), "original_id", "left")


def round_trips(resales: DataFrame, ladders: Ladders, keep_share: float = s.KEEP_SHARE) -> DataFrame:
    """Complete trips: resales whose own ladder and whose original's ladder are both known."""
    linked = _linked(resales)
    mine = _near(ladders, linked, "item_id").select(
        "item_id",
        F.col("opening_ask_ore").alias("ask_ore"),
        F.col("final_price_ore").alias("final_ore"),
        F.col("rungs").alias("resale_rungs"),
        "listed_on",
        "ended_on",
        "status",
    )
    sold = s.outcome_of(F.col("status")) == "sold"
    paid, final = F.col("bought_price_ore"), F.col("final_ore")
    profit_kr = s.trade_profit(s.to_kr(paid), s.to_kr(final), F.col("sold"), keep_share)
    return (
        linked.join(mine, "item_id")
        .join(_bought(_near(ladders, linked, "original_id")), "original_id")
        .withColumn("sold", sold)
        .withColumn("multiple", s.multiple(paid, final))
        .withColumn("profit_kr", profit_kr)
        .withColumn("days_held", s.day_gap(F.col("bought_on"), F.col("listed_on")))
        .withColumn("days_listed", s.day_gap(F.col("listed_on"), F.col("ended_on")))
    )


def tracked_round_trips(items: DataFrame, origins: DataFrame, keep_share: float = s.KEEP_SHARE) -> DataFrame:
    """Tracked resales with a known origin. A final price on an expired listing is an ask nobody
    paid, so profit and realised multiple are null unless it sold."""
    paid, sold = F.col("bought_price_ore"), F.coalesce(F.col("outcome") == s.SOLD, F.lit(False))
    final = F.col("final_price_ore")
    return items.join(origins, "item_id").select(
        "item_id",
        "original_id",
        "outcome",
        s.multiple(paid, F.col("first_price_ore")).alias("asking_multiple"),
        F.when(sold, s.multiple(paid, final)).alias("realised_multiple"),
        F.when(sold, F.bround(final * keep_share - paid).cast("long")).alias("profit_ore"),
        F.when(sold, s.day_gap(F.col("bought_on"), F.col("resolved_on"))).alias("days_paid_to_sold"),
    )


def _sold_only(column: str) -> Column:
    return F.when(F.col("sold"), F.col(column))


def payoff_summary(trips: DataFrame, keep_share: float = s.KEEP_SHARE) -> DataFrame:
    # A multiple of zero is no multiple: nothing was paid for the resale.
    sold = trips.where("sold").withColumn("multiple", F.nullif("multiple", F.lit(0.0)))
    summary = sold.agg(
        F.count(F.lit(1)).alias("sold"),
        s.ratio(F.count_if(F.col("profit_kr") > 0), F.count("profit_kr")).alias("win_rate"),
        s.ratio(F.count_if(F.col("multiple") < 1 / keep_share), F.count("multiple")).alias("under_break_even"),
    )
    measures = {
        "multiple": "multiple",
        "profit_kr": "profit_kr",
        "paid_ore": "bought_price_ore",
        "days_held": "days_held",
        "days_listed": "days_listed",
    }
    return with_quantiles(summary, sold, [], measures)


def _payoff(trips: DataFrame, key: str, measures: dict) -> DataFrame:
    rows = trips.where(F.col(key).isNotNull())
    summary = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), s.ratio(F.count_if("sold"), F.count(F.lit(1))).alias("sold_share"))
    return with_quantiles(summary, rows, [key], measures) if measures else summary


def payoff_by_discount(trips: DataFrame) -> DataFrame:
    labels = ["barely <20%", "moderate 20-50%", "deep 50-75%", "bottom >75%"]
    discount = s.band(F.col("bought_discount"), [0.0, 0.2, 0.5, 0.75, 1.01], labels)
    measures = {"multiple": _sold_only("multiple"), "paid_ore": "bought_price_ore"}
    return _payoff(trips.withColumn("discount_band", discount), "discount_band", measures)


def payoff_by_paid(trips: DataFrame, edges_kr: tuple = (100, 300, 800)) -> DataFrame:
    a, b, c = edges_kr
    labels = [f"under {a}", f"{a}-{b - 1}", f"{b}-{c - 1}", f"{c}+"]
    paid = s.band(s.to_kr(F.col("bought_price_ore")), [0, a, b, c, None], labels)
    measures = {"multiple": _sold_only("multiple"), "profit_kr": _sold_only("profit_kr")}
    return _payoff(trips.withColumn("paid_band", paid), "paid_band", measures)


def sold_by_markup(trips: DataFrame) -> DataFrame:
    markup = s.ratio(F.col("ask_ore"), F.col("bought_price_ore"))
    labels = ["<2x", "2-4x", "4-8x", "8x+"]
    banded = trips.withColumn("markup_band", s.band(markup, [0, 2, 4, 8, None], labels))
    return _payoff(banded, "markup_band", {})


def payoff_by_repriced(trips: DataFrame) -> DataFrame:
    rows = trips.withColumn("repriced", F.col("resale_rungs") > 1)
    return _payoff(rows, "repriced", {"multiple": _sold_only("multiple")})


def resale_status(trips: DataFrame) -> DataFrame:
    """Trips by status: median ask over paid, and average days listed."""
    ask = s.ratio(F.col("ask_ore"), F.col("bought_price_ore"))
    summary = trips.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("days_listed").alias("avg_days"))
    return with_quantiles(summary, trips, ["status"], {"ask_multiple": ask})


def resale_outcomes(cohort: DataFrame, checks: DataFrame, origins: DataFrame, stratum: str = "resale") -> DataFrame:
    """Cohort resales with their outcome, origin and multiple."""
    latest = final_outcomes(checks, "final_price_ore")
    sold = F.col("outcome") == "sold"
    multiple = s.multiple(F.col("bought_price_ore"), F.col("final_price_ore"))
    return (
        cohort.where(F.col("stratum") == stratum)
        .select("item_id")
        .join(latest, "item_id", "left")
        .join(origins, "item_id", "left")
        .select("item_id", "outcome", "bought_price_ore", "final_price_ore", F.when(sold, multiple).alias("multiple"))
    )

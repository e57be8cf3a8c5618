"""Price ladders: steps of one listing, their summary, and what resolved listings say.

Offers carry ``item_id``, ``offer_id``, ``created_at``, ``price_ore`` and optionally ``ended_at``.
Ladder rows carry ``opening_ask_ore``, ``final_price_ore``, ``rungs``, ``decay``, ``listed_on``,
``ended_on``, ``days_on_market`` and ``sold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.spread import with_neighbours, with_quantiles


def rungs(offers: DataFrame, key: str = "item_id") -> DataFrame:
    """Steps with their number, ``first`` and ``latest`` flags, and an end: the given one, or else
    the start of the next step."""
    has_end = "ended_at" in offers.columns
    steps = with_neighbours(
        offers, [key], ["created_at", "offer_id"], F.date_trunc("hour", "created_at"), ["price_ore"]
    )
    given = F.col("ended_at") if has_end else F.lit(None).cast("timestamp")
    return (
        steps.withColumn("ended_at", F.coalesce(given, F.col("next.created_at")))
        .withColumn("previous_ore", F.col("prev.price_ore"))
        .withColumn("first", F.col("prev").isNull())
        .withColumn("latest", F.col("next").isNull())
        .withColumnRenamed("n", "rung")
        .drop("prev", "next")
    )


def ladder_summary(offers: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per listing. ``listed_on`` is the day of the first rung and not of the last. All
    aggregates combine before the shuffle, so a ladder may have any number of rungs."""
    order = F.struct("created_at", "offer_id")
    ended = F.col("ended_at") if "ended_at" in offers.columns else F.lit(None).cast("timestamp")
    return (
        offers.withColumn("_ended", ended)
        .groupBy(key)
        .agg(
            F.min_by("price_ore", order).alias("opening_ask_ore"),
            F.max_by("price_ore", order).alias("final_price_ore"),
            F.count(F.lit(1)).alias("rungs"),
            F.to_date(F.min("created_at")).alias("listed_on"),
            F.to_date(F.max_by("_ended", order)).alias("ended_on"),
        )
        .withColumn("decay", s.decay(F.col("opening_ask_ore"), F.col("final_price_ore")))
        .withColumn("days_on_market", s.day_gap(F.col("listed_on"), F.col("ended_on")))
    )


def _step() -> Column:
    return F.struct(
        "rung",
        "price_ore",
        F.to_date("created_at").alias("from"),
        F.to_date("ended_at").alias("to"),
    )


def nested_ladder(offers: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per listing with its whole ladder as an array of (rung, price, from, to): the form in which a listing's
    document holds it."""
    return rungs(offers, key).groupBy(key).agg(F.array_sort(F.collect_list(_step())).alias("ladder"))


def ladder_parts(offers: DataFrame, size: int, key: str = "item_id") -> DataFrame:
    """The nested ladder in parts of ``size`` steps, for readers that want rows of bounded size."""
    return (
        rungs(offers, key)
        .groupBy(key, F.floor((F.col("rung") - 1) / size).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(_step())).alias("ladder"))
    )


def price_as_of(offers: DataFrame, day: Column, key: str = "item_id") -> DataFrame:
    """Price of each listing as of a day, from its steps; null before the first one. One value per listing combines
    before the shuffle, so a ladder may have any number of steps."""
    at = F.when(F.to_date("created_at") <= day, F.struct("created_at", "offer_id"))
    return offers.groupBy(key).agg(F.max_by("price_ore", at).alias("price_ore"))


def monotonicity(offers: DataFrame, key: str = "item_id") -> DataFrame:
    """Transitions, how many went up, and how many listings have one that did."""
    steps = rungs(offers, key).where(F.col("previous_ore").isNotNull())
    per_item = steps.groupBy(key).agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("price_ore") > F.col("previous_ore")).alias("up")
    )
    return per_item.agg(
        F.sum("t").alias("transitions"),
        F.sum("up").alias("increases"),
        s.ratio(F.sum("up"), F.sum("t")).alias("increase_share"),
        F.count_if(F.col("up") > 0).alias("items_affected"),
        F.count(F.lit(1)).alias("items"),
    )


def _kr(column: str) -> Column:
    return s.to_kr(F.col(column))


def sell_through_by_ask(ladders: DataFrame, low: int = 400, high: int = 1500) -> DataFrame:
    done = ladders.where(F.col("ended_on").isNotNull()).withColumn(
        "ask_band", s.ask_band(_kr("opening_ask_ore"), low, high)
    )
    summary = done.groupBy("ask_band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("sold").alias("sold"), s.ratio(F.count_if("sold"), F.count(F.lit(1))).alias("rate")
    )
    measures = {"rungs": "rungs", "days": "days_on_market", "decay": "decay"}
    return with_quantiles(summary, done, ["ask_band"], measures)


def underpricing_fingerprint(ladders: DataFrame, max_days: int = 21, max_rungs: int = 2, slow_rungs: int = 5) -> DataFrame:
    """Sold fast with little markdown, against sold only after many markdowns."""
    sold = ladders.where(F.col("ended_on").isNotNull() & F.col("sold"))
    # A zero-day sale counts with the missing ones, as an unknown length.
    days = F.coalesce(F.nullif(F.col("days_on_market"), F.lit(0)), F.lit(999))
    quick = (days <= max_days) & (F.col("rungs") <= max_rungs)
    slow = F.col("rungs") >= slow_rungs
    summary = sold.agg(
        F.count(F.lit(1)).alias("sold"),
        F.count_if(quick).alias("quick"),
        F.count_if(slow).alias("slow"),
        s.ratio(F.count_if(quick), F.count(F.lit(1))).alias("quick_share"),
        s.ratio(F.count_if(slow), F.count(F.lit(1))).alias("slow_share"),
    )
    asks = {
        "quick_ask": F.when(quick, F.col("opening_ask_ore")),
        "slow_ask": F.when(slow, F.col("opening_ask_ore")),
    }
    return with_quantiles(summary, sold, [], asks)


def score_gap(ladders: DataFrame, threshold: float = 0.03) -> DataFrame:
    """Mean model score of sold and unsold listings; a small gap is no signal."""
    done = ladders.where(F.col("ended_on").isNotNull() & F.col("score").isNotNull())
    sums = done.agg(
        F.count_if("sold").alias("n_sold"),
        F.count_if(~F.col("sold")).alias("n_unsold"),
        F.avg(F.when(F.col("sold"), F.col("score"))).alias("mean_sold"),
        F.avg(F.when(~F.col("sold"), F.col("score"))).alias("mean_unsold"),
    )
    gap = F.col("mean_sold") - F.col("mean_unsold")
    verdict = F.when(F.abs(gap) < threshold, "no signal").when(gap.isNotNull(), "signal")
    return sums.withColumn("gap", gap).withColumn("verdict", verdict)


def defect_split(ladders: DataFrame) -> DataFrame:
    done = ladders.where(F.col("ended_on").isNotNull())
    summary = done.groupBy("has_defect").agg(
        F.count(F.lit(1)).alias("n"), s.ratio(F.count_if("sold"), F.count(F.lit(1))).alias("sold_share")
    )
    return with_quantiles(summary, done, ["has_defect"], {"decay": "decay"})


def dwell_split(ladders: DataFrame, days: int = 30) -> DataFrame:
    known = ladders.where(F.col("ended_on").isNotNull() & F.col("dwell_days").isNotNull())
    known = known.withColumn("long_dwell", F.col("dwell_days") >= days)
    summary = known.groupBy("long_dwell").agg(
        F.count(F.lit(1)).alias("n"), s.ratio(F.count_if("sold"), F.count(F.lit(1))).alias("sold_share")
    )
    return with_quantiles(summary, known, ["long_dwell"], {"opening_ore": "opening_ask_ore"})


def cleared_fact(ladders: DataFrame) -> DataFrame:
    """The thin durable row of a resolved listing."""
    return ladders.where(F.col("ended_on").isNotNull()).select(
        "item_id",
        "brand",
        "category",
        F.trunc("listed_on", "month").alias("listed_month"),
        F.trunc("ended_on", "month").alias("cleared_month"),
        F.col("opening_ask_ore").alias("landing_price_ore"),
        F.col("final_price_ore").alias("clearing_price_ore"),
        F.col("days_on_market").alias("days_to_clear"),
        "score",
        "sold",
    )


def kept_share() -> Column:
    """Share of the opening ask that the final price kept."""
    return s.ratio(F.col("final_price_ore"), F.col("opening_ask_ore"))


def clearing_retention(ladders: DataFrame) -> DataFrame:
    """How much of the opening ask sold and unsold listings kept, and how long they sat."""
    done = ladders.where(F.col("ended_on").isNotNull())
    summary = done.groupBy("sold").agg(
        F.count(F.lit(1)).alias("n"), s.ratio(F.count_if(kept_share() < 0.5), F.count(F.lit(1))).alias("over_half_off")
    )
    return with_quantiles(summary, done, ["sold"], {"kept": kept_share(), "days": "days_on_market"})


def floor_truncation(ladders: DataFrame, floor_ore: int) -> DataFrame:
    """Of the listings that opened at or above a floor: the share that ended below it."""
    opened = ladders.where(F.col("ended_on").isNotNull() & (F.col("opening_ask_ore") >= floor_ore))
    summary = opened.groupBy("sold").agg(
        F.count(F.lit(1)).alias("n"),
        s.ratio(F.count_if(F.col("final_price_ore") < floor_ore), F.count(F.lit(1))).alias("ended_below"),
    )
    return with_quantiles(summary, opened, ["sold"], {"final_ore": "final_price_ore"})


def decode_history(items: DataFrame, key: str = "item_id") -> DataFrame:
    """Packed ``[day, price, day, price, ...]`` as one row per step with a date."""
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("history") / 2).cast("int") - 1),
        lambda i: F.struct(
            F.get("history", i * 2).alias("day"), F.get("history", i * 2 + 1).alias("price_ore")
        ),
    )
    packed = items.where(F.size("history") >= 2)
    return packed.select(key, "first_seen", F.explode(pairs).alias("p")).select(
        key,
        F.date_add("first_seen", F.col("p.day").cast("int")).alias("from"),
        F.col("p.price_ore").alias("price_ore"),
    )


def price_on(items: DataFrame, day: Column, key: str = "item_id") -> DataFrame:
    """Price of each listing as of a day; null before it was first seen."""
    age = F.datediff(day, F.col("first_seen"))
    places = F.sequence(F.lit(0), F.greatest((F.size("history") / 2).cast("int") - 1, F.lit(0)))
    known = F.filter(places, lambda i: F.get("history", i * 2) <= age)
    last = F.get(known, F.size(known) - 1)
    return items.select(key, F.get("history", last * 2 + 1).alias("price_ore"))


def stragglers(items: DataFrame, offers: DataFrame, floor_ore: int, key: str = "item_id") -> DataFrame:
    """Follow-up of listings that left the sweep below the price floor (outcome 4).

    ``offers`` carry the item's ``status``. One that has ended is promoted to sold or expired with
    its ladder summary, one still listed below the floor stays at 4, and one back above it is live.
    """
    waiting = items.where(F.col("outcome") == s.BELOW_FLOOR).select(key)
    mine = offers.join(waiting, key, "left_semi")
    status = mine.groupBy(key).agg(
        F.max_by("status", F.struct("created_at", "offer_id")).alias("status")
    )
    code = s.outcome_code(s.outcome_of(F.col("status")))
    still = F.when(F.col("final_price_ore") < floor_ore, F.lit(s.BELOW_FLOOR))
    return (
        ladder_summary(mine, key)
        .join(status, key)
        .withColumn("outcome", F.when(code.isin(s.SOLD, s.EXPIRED), code).otherwise(still))
    )


def payout_lag(sales: DataFrame) -> DataFrame:
    """Days from the end of the last rung to the payout, by channel."""
    lag = s.day_gap(F.col("sold_on"), F.col("paid_on"))
    rows = sales.where(lag.isNotNull()).withColumn("lag_days", lag)
    summary = rows.groupBy("p2p").agg(
        F.count(F.lit(1)).alias("n"), F.min("lag_days").alias("min_days"), F.max("lag_days").alias("max_days")
    )
    return with_quantiles(summary, rows, ["p2p"], {"days": "lag_days"})


def ladder_rows(offers: DataFrame, details: DataFrame, key: str = "item_id") -> DataFrame:
    """Ladder summary with the listing's own attributes, status and sold flag."""
    sold = s.outcome_of(F.col("status")) == "sold"
    return ladder_summary(offers, key).join(details, key, "left").withColumn("sold", sold)

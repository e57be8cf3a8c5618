"""Market screens that the resale data was collected for: lift, crowding, momentum, backtest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.spread import (
    group_quantiles,
    positions_median,
    positions_of_counts,
    value_positions,
    with_quantiles,
    with_row,
)
from thriftlens.session import cut_lineage


def _features(items: DataFrame, features: Mapping[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), c.cast("string").alias("value")) for f, c in features.items()])
    return (
        items.select("item_id", (F.col("outcome") == s.SOLD).alias("sold"), F.col("outcome").isNull().alias("live"), F.explode(pairs).alias("p"))
        .select("item_id", "sold", "live", "p.*")
        .where(F.col("value").isNotNull())
    )


def wilson_low(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of a share."""
    p = hits / n
    centre = p + z * z / (2 * n)
    width = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - width) / (1 + z * z / n)


def feature_lift(items: DataFrame, features: Mapping[str, Column], min_n: int = 30) -> DataFrame:
    """Share of a feature among sold over its share among live listings, with base rate and the
    lower bound of its share among sold."""
    known = items.where(F.col("outcome").isNull() | (F.col("outcome") == s.SOLD))
    cells = _features(known, features).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("sold").alias("sold"), F.count_if("live").alias("live")
    )
    totals = known.agg(
        F.count_if(F.col("outcome") == s.SOLD).alias("S"), F.count_if(F.col("outcome").isNull()).alias("L")
    )
    sold_share, live_share = F.col("sold") / F.col("S"), F.col("live") / F.col("L")
    return with_row(cells.where(F.col("n") >= min_n), totals).select(
        "feature",
        "value",
        "n",
        sold_share.alias("sold_share"),
        live_share.alias("base_rate"),
        s.ratio(sold_share, live_share).alias("lift"),
        wilson_low(F.col("sold"), F.col("S")).alias("sold_share_low"),
    )


def pair_lift(items: DataFrame, features: Mapping[str, Column], min_n: int = 30) -> DataFrame:
    """Sale rate of each feature pair over what its two rates predict if independent.

    The pairs of one row are built from the fixed list of features, so a row gives as many pairs
    as the list has and no row is joined with another.
    """
    known = items.where(F.col("outcome").isNull() | (F.col("outcome") == s.SOLD))
    names = list(features)
    sold = (F.col("outcome") == s.SOLD) & F.col("outcome").isNotNull()
    pairs = [
        F.struct(
            F.lit(a).alias("feature_a"),
            features[a].cast("string").alias("value_a"),
            F.lit(b).alias("feature_b"),
            features[b].cast("string").alias("value_b"),
        )
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    both = (
        known.select(sold.alias("sold"), F.explode(F.array(*pairs)).alias("p"))
        .select("sold", "p.*")
        .where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull())
        .groupBy("feature_a", "value_a", "feature_b", "value_b")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("sold").alias("k"))
        .where(F.col("n") >= min_n)
    )
    singles = _features(known, features).groupBy("feature", "value").agg(
        (F.count_if("sold") / F.count(F.lit(1))).alias("rate")
    )
    base = known.agg((F.count_if(sold) / F.count(F.lit(1))).alias("base"))

    def side(x: str) -> DataFrame:
        return singles.withColumnsRenamed({"feature": f"feature_{x}", "value": f"value_{x}", "rate": f"rate_{x}"})

    joined = both.join(side("a"), ["feature_a", "value_a"]).join(side("b"), ["feature_b", "value_b"])
    joined = with_row(joined, base)
    rate = F.col("k") / F.col("n")
    expected = s.ratio(F.col("rate_a") * F.col("rate_b"), F.col("base"))
    return joined.select(
        "feature_a", "value_a", "feature_b", "value_b", "n", rate.alias("rate"),
        expected.alias("expected_rate"), s.ratio(rate, expected).alias("lift"),
    )


def sales_by_day(ladders: DataFrame) -> DataFrame:
    """Sales, median price, days and markdown depth per day of sale."""
    sold = ladders.where("sold")
    summary = sold.groupBy("ended_on").agg(F.count(F.lit(1)).alias("sales"), F.sum("final_price_ore").alias("revenue_ore"))
    depth = 1 - s.ratio(F.col("final_price_ore"), F.col("opening_ask_ore"))
    measures = {"price_ore": "final_price_ore", "days": "days_on_market", "markdown": depth}
    return with_quantiles(summary, sold, ["ended_on"], measures)


def top_sellers(ladders: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Keys by units sold, with revenue, mean and median price; medians are made for the ``k`` keys only."""
    sold = ladders.where("sold")
    best = (
        sold.groupBy(key)
        .agg(F.count(F.lit(1)).alias("units"), F.sum("final_price_ore").alias("revenue_ore"))
        .orderBy(F.col("units").desc(), key)
        .limit(k)
    )
    best = cut_lineage(best)
    names = F.broadcast(best.select(F.col(key).alias("_key")))  # ``k`` rows
    mine = sold.join(names, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return with_quantiles(best, mine, [key], {"price_ore": "final_price_ore"})


def sold_after_cut(steps: DataFrame, sales: DataFrame, days: int = 7) -> DataFrame:
    """Share of sales within ``days`` of a price cut. ``steps`` are rows of ``rungs``; only the
    newest cut of a listing can be the nearest before its end."""
    cuts = steps.where(F.col("price_ore") < F.col("previous_ore")).groupBy("item_id").agg(
        F.max(F.to_date("created_at")).alias("cut_on")
    )
    near = F.datediff("sold_on", "cut_on").between(0, days)
    return sales.join(cuts, "item_id", "left").agg(
        F.count(F.lit(1)).alias("sales"), F.count_if(near).alias("after_cut"), s.ratio(F.count_if(near), F.count(F.lit(1))).alias("share")
    )


def crowding(items: DataFrame, keys: Sequence[str], as_of: Column, recent_days: int = 30) -> DataFrame:
    """Live listings of a kind, its recent sales, supply over sales, and how much is stale."""
    live = F.col("outcome").isNull()
    recent = (F.col("outcome") == s.SOLD) & (F.col("resolved_on") > F.date_sub(as_of, recent_days)) & (F.col("resolved_on") <= as_of)
    age = F.datediff(as_of, F.col("first_offered"))
    return items.groupBy(*keys).agg(
        F.count_if(live).alias("live"),
        F.count_if(recent).alias("recent_sales"),
        s.ratio(F.count_if(live), F.count_if(recent)).alias("supply_per_sale"),
        s.ratio(F.count_if(live & (age > 120)), F.count_if(live)).alias("stale_share"),
    )


def momentum(observations: DataFrame, first_days: int = 7) -> DataFrame:
    """Likes per day since listing, likes gathered in the first days, and regional split, from
    dated observations. All aggregates combine before the shuffle."""
    age = F.datediff("pass_on", "first_offered")
    early = F.when(age <= first_days, F.col("favourites"))
    last = F.struct("pass_on", "favourites")
    return (
        observations.groupBy("item_id")
        .agg(
            F.max(last).alias("_last"),
            F.max(early).alias("early_favourites"),
            F.min("first_offered").alias("first_offered"),
            F.max_by("fav_nordic", "pass_on").alias("fav_nordic"),
            F.max_by("fav_eu", "pass_on").alias("fav_eu"),
            F.max_by("fav_dach", "pass_on").alias("fav_dach"),
        )
        .select(
            "item_id",
            F.col("_last.favourites").alias("favourites"),
            (
                F.col("_last.favourites")
                / F.greatest(F.datediff("_last.pass_on", "first_offered"), F.lit(1))
            ).alias("likes_per_day"),
            "early_favourites",
            "fav_nordic",
            "fav_eu",
            "fav_dach",
        )
    )


def sold_peer_median(live: DataFrame, ladders: DataFrame, keys: Sequence[str], min_n: int = 8) -> DataFrame:
    """Live items with the median clearing price of sold items of their kind."""
    positions = value_positions(ladders.where("sold"), keys, "final_price_ore").where(F.col("n_group") >= min_n)
    medians = positions_median(positions, keys, "final_price_ore").withColumnRenamed("median", "peer_sold_median_ore")
    sizes = positions.groupBy(*keys).agg(F.max("n_group").alias("peer_sold_n"))
    kinds = medians.join(sizes, list(keys))
    return live.join(kinds, list(keys)).withColumn(
        "edge", s.ratio(F.col("peer_sold_median_ore"), F.col("price_ore"))
    )


def season_buy_list(scored: DataFrame, curve: DataFrame, month: int, n: int = 200) -> DataFrame:
    """Discounted live items whose season peaks within the three months after ``month``."""
    best = curve.groupBy("season").agg(F.max_by("month", F.struct("med_kept", "month")).alias("peak"))
    ahead = best.where(((F.col("peak") - month + 12) % 12).between(1, 3)).select("season", "peak")
    order = [F.col("discount_pct").desc(), F.col("item_id")]
    return scored.join(ahead, "season").where(F.col("discount_pct") > 0).orderBy(*order).limit(n)


def state_on(steps: DataFrame, cutoff: Column) -> DataFrame:
    """What was knowable on a day: for every listing open then, its ask, opening ask and markdowns
    so far. ``steps`` are rows of ``rungs``; a row is cut by its own interval, so nothing later
    than the cutoff is read."""
    past = steps.where(F.to_date("created_at") <= cutoff)
    open_now = past.where(F.col("ended_at").isNull() | (F.to_date("ended_at") > cutoff))
    known = past.groupBy("item_id").agg(
        F.min_by("price_ore", "rung").alias("opening_ask_ore"), (F.max("rung") - 1).alias("markdowns")
    )
    asks = open_now.groupBy("item_id").agg(F.max_by("price_ore", "rung").alias("ask_ore"))
    return asks.join(known, "item_id")


def _scored(state: DataFrame, outcomes: DataFrame, rule: Column, keys: Sequence[str]) -> DataFrame:
    """What happened later to the listings that ``rule`` picks, and to the others."""
    state = state.withColumn("picked", F.coalesce(rule, F.lit(False)))
    later = outcomes.select("item_id", "sold", "final_price_ore", "ended_on")
    rows = state.join(later, "item_id").withColumn("days", F.datediff("ended_on", "cutoff"))
    groups = [*keys, "picked"]
    summary = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), s.ratio(F.count_if("sold"), F.count(F.lit(1))).alias("sell_through"))
    kept = s.ratio(F.col("final_price_ore"), F.col("ask_ore"))
    return with_quantiles(summary, rows, groups, {"kept": kept, "days": "days"})


def backtest(steps: DataFrame, outcomes: DataFrame, rule: Column, cutoff: Column) -> DataFrame:
    """A buy rule on the state of a past day, scored on what happened later."""
    return _scored(state_on(steps, cutoff).withColumn("cutoff", cutoff), outcomes, rule, [])


# Days of a cell in which steps and cutoffs meet.
CELL_DAYS = 28


def states_on(steps: DataFrame, cutoffs: DataFrame, cell_days: int = CELL_DAYS) -> DataFrame:
    """``state_on`` for every day of ``cutoffs`` (a column ``cutoff``) at once: (cutoff, item_id, ask, opening ask, markdowns).

    A step holds from its day up to the day of the next one. It is spread over the cells of ``cell_days`` days that it touches between the first and
    the last cutoff, meets the cutoffs of these cells in an equi-join, and its own days decide there. So the steps are read once for all cutoffs, and
    a step meets the cutoffs near it only. A step without a time is no part of any state.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    marks = cutoffs.select("cutoff", day("cutoff").alias("_on")).distinct()
    timed = steps.where(F.col("created_at").isNotNull())
    first = timed.groupBy("item_id").agg(F.min_by("price_ore", "rung").alias("opening_ask_ore"))
    bounds = marks.agg(F.min("_on").alias("_low"), F.max("_on").alias("_high"))
    open_ones = with_row(
        timed.select("item_id", "rung", F.col("price_ore").alias("ask_ore"), day("created_at").alias("_from"), day("ended_at").alias("_to")), bounds
    )
    # Up to, and not with, the day of the next step; the last step holds on.
    to = F.least(F.coalesce("_to", F.col("_high") + 1), F.col("_high") + 1)
    since = F.greatest("_from", "_low")
    cell = lambda c: F.floor(c / cell_days)
    spread = open_ones.withColumn("_to", to).withColumn("_since", since).where(F.col("_since") < F.col("_to"))
    spread = spread.withColumn("_cell", F.explode(F.sequence(cell(F.col("_since")), cell(F.col("_to") - 1))))
    met = spread.join(marks.withColumn("_cell", cell(F.col("_on"))), "_cell").where((F.col("_from") <= F.col("_on")) & (F.col("_on") < F.col("_to")))
    states = met.select("cutoff", "item_id", "ask_ore", (F.col("rung") - 1).alias("markdowns"))
    return states.join(first, "item_id")


def backtest_many(steps: DataFrame, outcomes: DataFrame, rule: Column, cutoffs: DataFrame, cell_days: int = CELL_DAYS) -> DataFrame:
    """``backtest`` of one rule at many cutoffs in one pass: a row for each cutoff and for what the rule picked and did not."""
    return _scored(states_on(steps, cutoffs, cell_days), outcomes, rule, ["cutoff"])


def daily_aggregate(ladders: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(date, dimension, value) with units, median price and median days of that day's sales."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    long = (
        ladders.where("sold")
        .select("ended_on", "final_price_ore", "days_on_market", F.explode(pairs).alias("p"))
        .select("ended_on", "final_price_ore", "days_on_market", "p.*")
        .where(F.col("value").isNotNull())
    )
    keys = ["ended_on", "dimension", "value"]
    summary = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"))
    return with_quantiles(summary, long, keys, {"price_ore": "final_price_ore", "days": "days_on_market"})


# Measures of a sale that are kept as counts of their values.
SALE_MEASURES = {"price_ore": "final_price_ore", "days": "days_on_market"}


def sale_counts(ladders: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(ended_on, dimension, value, measure, x, n): how many sales of a day and value have which price and took how many days.

    The counts of different sales add up, so those of new days, or of late sales of an old day, are added to a table without reading the listings
    it was made of. A null measure is counted under a null ``x``."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("x")) for m, c in SALE_MEASURES.items()])
    sold = ladders.where(F.col("sold") & F.col("ended_on").isNotNull()).select("ended_on", F.explode(pairs).alias("p"), measures.alias("_m"))
    each = sold.where(F.col("p.value").isNotNull()).select("ended_on", "p.*", F.explode("_m").alias("m"))
    return each.select("ended_on", "dimension", "value", "m.*").groupBy("ended_on", "dimension", "value", "measure", "x").agg(F.count(F.lit(1)).alias("n"))


def aggregate_of_counts(counts: DataFrame, period: Column, name: str = "period") -> DataFrame:
    """(period, dimension, value) with units, median price and median days, exact, from rows of ``sale_counts``. ``period`` is a column of
    ``ended_on``: the day itself, its month, or a literal for all days."""
    keys = [name, "dimension", "value", "measure"]
    added = counts.withColumn(name, period).groupBy(*keys, "x").agg(F.sum("n").alias("n_equal"))
    positions = positions_of_counts(added.where(F.col("x").isNotNull()), keys, "x")
    medians = positions_median(positions, keys, "x")
    units = added.groupBy(*keys).agg(F.sum("n_equal").alias("units"))
    at = lambda m: F.max(F.when(F.col("measure") == m, F.col("median")))
    return (
        units.join(medians, keys, "left")
        .groupBy(*keys[:-1])
        .agg(F.max("units").alias("units"), *[at(m).alias(f"med_{m}") for m in SALE_MEASURES])
    )


def cutoff_drift(rows: DataFrame) -> DataFrame:
    """Accept cutoff by category and month, kept apart per model version."""
    keys = ["score_version", "category", "month"]
    dated = rows.where(F.col("cutoff").isNotNull()).withColumn("month", F.trunc("listed_on", "month"))
    summary = dated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("cutoff").alias("mean_cutoff"),
        F.count_if(F.col("score") < F.col("cutoff")).alias("below_cutoff"),
    )
    medians = group_quantiles(dated, keys, {"cutoff": "cutoff"})
    return summary.join(medians, keys)

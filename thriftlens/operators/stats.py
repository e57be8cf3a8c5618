"""Population shape, concentration, regressions, hold-out tests and weighted estimates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.ladders import kept_share
from thriftlens.operators.spread import with_quantiles, with_row


def offer_shape(offers: DataFrame, floor_ore: int) -> DataFrame:
    """Live and ended offers, price quantiles taken at ``floor(n * q)``, maximum, share above."""
    summary = offers.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ended_at").isNull()).alias("live"),
        F.count("ended_at").alias("ended"),
        F.max("price_ore").alias("max_ore"),
        s.ratio(F.count_if(F.col("price_ore") >= floor_ore), F.count(F.lit(1))).alias("share_above"),
    )
    quantiles = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    return with_quantiles(summary, offers, [], {"ore": "price_ore"}, quantiles=quantiles, discrete=True)


def field_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows carry each field: one scan, one row per field."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    rows = [
        F.struct(
            F.lit(c).alias("field"),
            F.col(c).alias("present"),
            F.col("_n").alias("n"),
            s.ratio(F.col(c), F.col("_n")).alias("share"),
        )
        for c in columns
    ]
    return counts.select(F.inline(F.array(*rows)))


def top_values(df: DataFrame, column: str, k: int, watch: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent values, and every watched one with its count, zero included."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = counts.orderBy(F.col("n").desc(), "value").limit(k).withColumn("watched", F.lit(False))
    if not watch:
        return top
    names = F.explode(F.array(*[F.lit(w) for w in watch]))
    wanted = df.sparkSession.range(1).select(names.alias("value"))
    listed = wanted.join(counts, "value", "left").select(
        "value", F.coalesce("n", F.lit(0)).alias("n"), F.lit(True).alias("watched")
    )
    return top.unionByName(listed)


def concentration(items: DataFrame, key: str = "brand", top: int = 1000, min_n: int = 5) -> DataFrame:
    """Distinct keys, the share the ``top`` largest hold, keys with ``min_n`` rows, singletons."""
    counts = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.orderBy(F.col("n").desc(), key).limit(top).agg(F.sum("n").alias("top_rows"))
    summary = counts.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").alias("rows"),
        F.count_if(F.col("n") >= min_n).alias("with_min"),
        F.count_if(F.col("n") == 1).alias("singletons"),
    )
    return with_row(summary, largest).withColumn(
        "top_share", s.ratio(F.col("top_rows"), F.col("rows"))
    )


def price_regressions(ladders: DataFrame) -> DataFrame:
    """Final on opening (raw and log-log), kept share, and decay on price and on days; sold only."""
    sold = ladders.where(F.col("sold") & (F.col("opening_ask_ore") > 0) & (F.col("final_price_ore") > 0))
    y, x = F.col("final_price_ore").cast("double"), F.col("opening_ask_ore").cast("double")
    days = F.col("days_on_market").cast("double")
    return sold.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_r2(y, x).alias("final_on_opening_r2"),
        F.regr_slope(y, x).alias("final_on_opening_slope"),
        F.regr_r2(F.log(y), F.log(x)).alias("log_r2"),
        F.regr_slope(F.log(y), F.log(x)).alias("log_slope"),
        F.avg(kept_share()).alias("mean_kept"),
        F.stddev(kept_share()).alias("sd_kept"),
        F.regr_r2(F.col("decay"), x).alias("decay_on_price_r2"),
        F.regr_r2(F.col("decay"), days).alias("decay_on_days_r2"),
    )


def hash_split(key: Column, test_share: float) -> Column:
    """True for the test rows: the first eight hex digits of the key's hash, as a share of their
    range, fall under ``test_share``."""
    draw = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return draw < int(test_share * 2**32)


def holdout_r2(ladders: DataFrame, features: Sequence[str], target: str = "final_price_ore", test_share: float = 0.2, key: str = "item_id") -> DataFrame:
    """R² of group means on held-out rows, per feature. A level the training rows lack gets the
    training mean, as it would in use. Training rows are reduced to one sum per level before any
    join, so only the level table meets the test rows."""
    rows = ladders.withColumn("_test", hash_split(F.col(key), test_share))
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features]
    )
    long = rows.select("_test", F.col(target).alias("y"), F.explode(pairs).alias("p")).select(
        "_test", "y", "p.feature", F.coalesce("p.level", F.lit("")).alias("level")
    )
    y = F.col("y")
    cells = long.groupBy("feature", "level").agg(
        F.sum(F.when(~F.col("_test"), y)).alias("train_sum"),
        F.count(F.when(~F.col("_test"), y)).alias("train_n"),
        F.sum(F.when(F.col("_test"), y)).alias("test_sum"),
        F.sum(F.when(F.col("_test"), y.cast("decimal(38,0)") * y)).alias("test_sq"),
        F.count(F.when(F.col("_test"), y)).alias("test_n"),
    )
    overall = cells.groupBy("feature").agg(
        (F.sum("train_sum") / F.sum("train_n")).alias("mean"),
        F.sum("test_sum").alias("ts"),
        F.sum("test_sq").cast("double").alias("tq"),
        F.sum("test_n").alias("tn"),
    )
    guess = F.when(F.col("train_n") > 0, F.col("train_sum") / F.col("train_n")).otherwise(F.col("mean"))
    # Sum of squared errors of a level from its sums: q - 2 g s + g² n.
    error = (
        F.coalesce(F.col("test_sq").cast("double"), F.lit(0.0))
        - 2 * guess * F.coalesce("test_sum", F.lit(0))
        + guess * guess * F.col("test_n")
    )
    total = F.col("tq") - F.col("ts").cast("double") * F.col("ts") / F.col("tn")
    return (
        cells.join(overall, "feature")
        .groupBy("feature")
        .agg(
            (1 - F.sum(error) / F.first(total)).alias("r2"),
            F.max("tn").alias("test_rows"),
            F.sum(F.when(F.col("train_n") == 0, F.col("test_n")).otherwise(0)).alias("unseen_rows"),
        )
    )


def weighted_rate(items: DataFrame, predicate: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rate in the sample, and rate and size in the market the sample stands for."""
    hit = F.coalesce(predicate, F.lit(False))
    w = F.col("sample_weight")
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("estimated_items"),
        F.sum(F.when(hit, w).otherwise(0.0)).alias("estimated_hits"),
        s.ratio(F.count_if(hit), F.count(F.lit(1))).alias("unweighted_rate"),
        s.ratio(F.sum(F.when(hit, w).otherwise(0.0)), F.sum(w)).alias("weighted_rate"),
    )


def shelf_composition(items: DataFrame, kr_thresholds: Sequence[int] = (200, 400), likes: Sequence[int] = (1, 21)) -> DataFrame:
    """Count and share per top category segment, price threshold, tier and likes threshold. One
    scan: each row is counted in its segments, and the totals come from the same counts."""
    cut = [("category", F.col("category")), ("tier", F.col("brand_tier").cast("string"))]
    cut += [(f"price>={t}", F.when(F.col("price_ore") >= t * 100, F.lit("yes"))) for t in kr_thresholds]
    cut += [(f"likes>={t}", F.when(F.col("favourites") >= t, F.lit("yes"))) for t in likes]
    everything = F.struct(F.lit("all").alias("cut"), F.lit("all").alias("value"))
    pairs = F.array(
        everything, *[F.struct(F.lit(c).alias("cut"), v.alias("value")) for c, v in cut]
    )
    counts = (
        items.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where(F.col("value").isNotNull())
        .groupBy("cut", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.where(F.col("cut") == "all").select(F.col("n").alias("_all"))
    return with_row(counts.where(F.col("cut") != "all"), total).select(
        "cut", "value", "n", s.ratio(F.col("n"), F.col("_all")).alias("share")
    )


def outcome_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def overview(items: DataFrame) -> DataFrame:
    """One row: rows and estimated market by state."""
    live, w = F.col("outcome").isNull(), F.col("sample_weight")
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(live).alias("live"),
        F.count_if(F.col("outcome") == s.SOLD).alias("sold"),
        F.count_if(F.col("outcome") == s.EXPIRED).alias("expired"),
        F.sum(F.when(live, w).otherwise(0.0)).alias("estimated_live"),
    )


def source_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Share of A found in B and of B found in A."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return left.join(right, key, "full").agg(
        F.count_if(in_a).alias("n_a"),
        F.count_if(in_b).alias("n_b"),
        F.count_if(in_a & in_b).alias("n_both"),
        s.ratio(F.count_if(in_a & in_b), F.count_if(in_a)).alias("a_in_b"),
        s.ratio(F.count_if(in_a & in_b), F.count_if(in_b)).alias("b_in_a"),
    )


def brand_consensus(samples: DataFrame, fields: Sequence[str], key: str = "brand") -> DataFrame:
    """Classification of a brand, kept only where all its sampled items that carry one agree. The
    smallest and largest answer are equal exactly when all are, so no set is collected."""
    answer = F.when(F.col(fields[0]).isNotNull(), F.struct(*fields))
    agg = samples.groupBy(key).agg(
        F.count(answer).alias("answers"), F.min(answer).alias("_lo"), F.max(answer).alias("_hi")
    )
    same = reduce(
        lambda x, y: x & y, [F.col(f"_lo.{f}").eqNullSafe(F.col(f"_hi.{f}")) for f in fields]
    )
    state = F.when(F.col("answers") == 0, "unresolved").when(same, "resolved").otherwise("disagreed")
    kept = [F.when(state == "resolved", F.col(f"_lo.{f}")).alias(f) for f in fields]
    return agg.select(key, "answers", state.alias("state"), *kept)

"""Predicates and row filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The wearable part of the catalogue, and strata that form the analysis sample.
WEARABLE = [
    "Man > Kläder",
    "Kvinna > Kläder",
    "Barn > Kläder",
    "Man > Skor",
    "Kvinna > Skor",
    "Barn > Skor",
]
ANALYSIS_STRATA = ["A", "B", "N"]


def wearable(df: DataFrame, min_kr: int = 100, category: str = "category", price: str = "price_ore", categories: Sequence[str] = WEARABLE) -> DataFrame:
    return df.where(F.col(category).isin(*categories) & (F.col(price) >= min_kr * 100))


def facet_predicate(schema: T.StructType, groups: Sequence[Sequence[tuple[str, str]]]) -> Column:
    """AND over groups, OR within a group, of ``field equals value`` or ``array holds value``."""

    def one(field: str, value: str) -> Column:
        if isinstance(schema[field].dataType, T.ArrayType):
            return F.array_contains(field, value)
        return F.col(field) == value

    return reduce(
        lambda a, b: a & b,
        [reduce(lambda a, b: a | b, [one(*pair) for pair in group]) for group in groups],
    )


def facet_filter(df: DataFrame, groups: Sequence[Sequence[tuple[str, str]]]) -> DataFrame:
    return df.where(facet_predicate(df.schema, groups))


def fits_profile(df: DataFrame, target_sizes: DataFrame, key: str = "item_id", sizes: str = "sizes", demography: str = "demography") -> DataFrame:
    """Items of which any fitting size is a target. A target that names a demography only matches
    items of it; one without matches all."""
    targets = target_sizes.select(
        F.col("size_code").alias("_size"), F.col("demography").alias("_who")
    ).distinct()
    spread = df.withColumn("_size", F.explode(F.array_distinct(sizes)))
    on = (spread["_size"] == targets["_size"]) & (
        targets["_who"].isNull() | (targets["_who"] == spread[demography])
    )
    return spread.join(targets, on, "left_semi").drop("_size").dropDuplicates([key])


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("outcome").isNull())


def analysis_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("stratum").isin(*ANALYSIS_STRATA))


# The gate's position among peers where no other is asked for.
MAX_PCT = 0.25


def gate_predicates(min_price_ore: int = 20000, min_peer_n: int = 12, max_level: int = 2, max_pct: float = MAX_PCT, min_favourites: int = 0, unreserved: bool = False) -> list[tuple[str, Column]]:
    steps = [
        ("price_floor", F.col("price_ore") >= min_price_ore),
        ("peer_group", (F.col("peer_n") >= min_peer_n) & (F.col("peer_level") <= max_level)),
        ("cheapest_quarter", F.col("peer_pct") <= max_pct),
    ]
    if min_favourites:
        steps.append(("favourites", F.col("favourites") >= min_favourites))
    if unreserved:
        steps.append(("unreserved", ~F.coalesce(F.col("is_reserved"), F.lit(False))))
    return steps


def shortlist_gate(df: DataFrame, **gates) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [p for _, p in gate_predicates(**gates)]))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Survivors after each successive predicate and the share that passed it, in one scan."""
    passed, sums = F.lit(True), [F.count(F.lit(1)).alias("_0")]
    for i, (_, predicate) in enumerate(steps, 1):
        passed = passed & F.coalesce(predicate, F.lit(False))
        sums.append(F.count_if(passed).alias(f"_{i}"))
    names = ["all", *[name for name, _ in steps]]
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(name).alias("gate"),
            F.col(f"_{i}").alias("survivors"),
            (F.col(f"_{i}") / F.nullif(F.col(f"_{max(i - 1, 0)}"), F.lit(0))).alias("rate"),
        )
        for i, name in enumerate(names)
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def exclude_categories(df: DataFrame, excluded: DataFrame, category: str = "category", separator: str = " > ") -> DataFrame:
    """Drops rows whose category path is an excluded path or lies under one. The prefixes of each
    distinct path are matched by equality, so no row is compared with the whole exclusion table."""
    parts = F.split(F.col(category), separator)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator),
    )
    hit = (
        df.select(category)
        .where(F.col(category).isNotNull())
        .distinct()
        .select(category, F.explode(prefixes).alias("_path"))
        .join(excluded.select(F.col("path").alias("_path")), "_path", "left_semi")
        .select(category)
        .distinct()
    )
    return df.join(hit, category, "left_anti")


def mark_ineligible(df: DataFrame, price: str = "price_kr") -> DataFrame:
    """Keeps every row and says why one cannot be measured."""
    return df.withColumn("ineligible_reason", F.when(F.col(price).isNull(), F.lit("no price")))


def stratum_predicates(on_shelf: Column | None = None) -> dict[str, Column]:
    """The rules of the frozen cohort strata, in claiming order. Names, order and bounds are fixed values."""
    shelf = F.col("on_shelf") if on_shelf is None else on_shelf
    cheap, wanted = F.col("price_to_estimate") < 0.6, F.col("favourites") >= 5
    return {
        "resale": F.col("p2p") & shelf,
        "screen": shelf & cheap & wanted,
        "control_unwanted": shelf & cheap & (F.col("favourites") == 0),
        "control_wanted_pricey": shelf & (F.col("price_to_estimate") > 1.0) & wanted,
        "premium": shelf & (F.col("price_ore") >= 150000),
        "baseline": shelf,
    }


# Quota of each stratum.
STRATUM_QUOTA = {
    "resale": 500,
    "screen": 150,
    "control_unwanted": 150,
    "control_wanted_pricey": 150,
    "premium": 100,
    "baseline": 250,
}

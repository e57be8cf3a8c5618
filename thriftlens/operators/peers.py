"""Where a live listing stands among listings of its kind."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.operators.spread import left_join_near, null_safe_join, positions_median, positions_of_counts, value_positions
from thriftlens.session import cut_lineage

# Level 1 brand + garment + condition, level 2 brand + category, level 3 tier + garment.
PEER_LEVELS = [
    ["brand", "item_type", "condition"],
    ["brand", "category"],
    ["brand_tier", "item_type"],
]


def peer_table(shelf: DataFrame, keys: Sequence[str], price: str = "price_ore", min_group: int = 1) -> DataFrame:
    """Per group and distinct price: ``peer_n``, ``peer_median_ore`` and ``peer_pct`` (0 is the
    cheapest). A group with a missing key is no group."""
    positions = value_positions(shelf, keys, price).where(F.col("n_group") >= min_group)
    medians = positions_median(positions, keys, price).withColumnRenamed("median", "peer_median_ore")
    pct = F.when(F.col("n_group") > 1, F.col("n_below") / (F.col("n_group") - 1)).otherwise(F.lit(0.0))
    placed = positions.select(*keys, price, F.col("n_group").alias("peer_n"), pct.alias("peer_pct"))
    return placed.join(medians, list(keys))


def peer_score(shelf: DataFrame, keys: Sequence[str], price: str = "price_ore", min_group: int = 1) -> DataFrame:
    """Every row of the shelf with its place in its group; rows of no group keep nulls."""
    return shelf.join(peer_table(shelf, keys, price, min_group), [*keys, price], "left")


def _all_named(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _group(keys: Sequence[str]) -> Column:
    """A group of a level as one value."""
    return F.array(*[F.col(c).cast("string") for c in keys])


GROUP = ["peer_level", "peer_group"]


def _fits(levels: Sequence[Sequence[str]]) -> Column:
    """The groups a row is in, one entry for each level; null where a key is missing."""
    entries = [F.struct(F.lit(i).alias("peer_level"), _group(keys).alias("peer_group")) for i, keys in enumerate(levels, 1)]
    return F.array(*[F.when(_all_named(keys), entry) for keys, entry in zip(levels, entries)])


def group_places(rows: DataFrame, levels: Sequence[Sequence[str]], min_group: int) -> DataFrame:
    """The groups of each combination of keys: the number ``_group`` of the first of its groups that has ``min_group`` rows, with ``peer_level`` and ``peer_n``,
    and in ``_counted`` all of its groups that are the first of any combination. A table of one row per combination, written once.

    Groups come from counts by combination, so the rows are read once, and are known by a number from here on."""
    names = list(dict.fromkeys(c for keys in levels for c in keys))
    combinations = cut_lineage(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    fits = combinations.select(*names, "_n", F.explode(_fits(levels)).alias("_fit")).where("_fit is not null").select(*names, "_n", "_fit.*")
    sized = fits.groupBy(*GROUP).agg(F.sum("_n").alias("peer_n")).where(F.col("peer_n") >= min_group)
    first = F.min(F.struct(*GROUP, "peer_n")).alias("_at")
    used = fits.join(sized, GROUP).groupBy(*names).agg(first).select("_at.*").distinct()
    used = cut_lineage(used.withColumn("_group", F.monotonically_increasing_id()))
    # What is the first of a combination is used, so the first used one is the first.
    own = F.min(F.struct("peer_level", "_group", "peer_n")).alias("_own")
    found = fits.join(used, GROUP).groupBy(*names).agg(own, F.collect_list("_group").alias("_counted"))
    return cut_lineage(found.select(*names, "_own.*", "_counted"))


def peer_cascade(shelf: DataFrame, levels: Sequence[Sequence[str]] = PEER_LEVELS, min_group: int = 8, key: str = "item_id", price: str = "price_ore", keep: Sequence[str] = (), staged: bool = False, max_pct: float | None = None) -> DataFrame:
    """Peer position from the first level whose group has ``min_group`` members.

    Each level compares with the whole shelf of its key, also with items an earlier level placed.
    Items no level can place are left out, a group with a missing key is no group. ``keep`` names columns to carry along. The shelf is written once in its few columns, or
    read as it is where it is ``staged``, a filter on a written table. With ``max_pct`` only rows at that position or below come out: a group's price there is found first, so the
    others are left out before the shuffle.

    The level of every combination of keys comes from a table much smaller than the shelf. Prices are counted in the groups that place a row, mostly one
    for each, and positions come from these counts. The shelf's rows are shuffled to meet the position of their price, and nothing else of their size is.
    """
    names = list(dict.fromkeys(c for keys in levels for c in keys))
    rows = shelf.select(key, price, *dict.fromkeys([*keep, *names])).where(F.col(price).isNotNull())
    rows = rows if staged else cut_lineage(rows)
    places = group_places(rows, levels, min_group)
    each = null_safe_join(rows.select(price, *names), places.select(*names, "_counted"), names).select(F.explode("_counted").alias("_group"), price)
    counts = each.groupBy("_group", price).agg(F.count(F.lit(1)).alias("n_equal"))
    pct = F.when(F.col("n_group") > 1, F.col("n_below") / (F.col("n_group") - 1)).otherwise(F.lit(0.0))
    positions = cut_lineage(positions_of_counts(counts, ["_group"], price).withColumn("peer_pct", pct))
    within = F.lit(True) if max_pct is None else F.col("peer_pct") <= max_pct
    # Positions never fall as the price rises, so the dearest price within the bound tells who is.
    bounded = positions.withColumn("_upto", F.when(within, F.col(price)))
    groups = positions_median(bounded, ["_group"], price, "_upto").withColumnRenamed("median", "peer_median_ore")
    # Written, so that its size is known and rows are not shuffled to meet a small table.
    found = cut_lineage(places.drop("_counted").join(groups, "_group"))
    placed = null_safe_join(rows, found, names)
    if max_pct is not None:
        placed, positions = placed.where(F.col(price) <= F.col("_upto")), positions.where(within)
    return placed.join(positions.select("_group", price, "peer_pct"), ["_group", price]).select(
        key, price, *keep, "peer_level", "peer_n", "peer_median_ore", "peer_pct"
    )


FROZEN = ["peer_pct", "peer_median_ore", "peer_n", "peer_level"]


def freeze_peers(items: DataFrame, peers: DataFrame, as_of: Column, key: str = "item_id") -> DataFrame:
    """Copies the peer position onto items that have resolved, once: a row that already holds a
    frozen position keeps it, and live rows stay as they are. Only items that may have a position are shuffled."""
    frozen = left_join_near(items, peers.select(key, *FROZEN), key)
    take = (
        F.col("outcome").isNotNull()
        & F.col("peer_frozen_on").isNull()
        & F.col("peer_n").isNotNull()
    )
    out = frozen.withColumn("_take", take)
    for c in FROZEN:
        out = out.withColumn(f"{c}_frozen", F.when(F.col("_take"), F.col(c)).otherwise(F.col(f"{c}_frozen")))
    out = out.withColumn("peer_frozen_on", F.when(F.col("_take"), as_of).otherwise(F.col("peer_frozen_on")))
    return out.drop("_take", *FROZEN)


def unfrozen(items: DataFrame) -> DataFrame:
    """``items`` with empty frozen columns, as they are when first enrolled."""
    return items.select(
        "*",
        F.lit(None).cast("double").alias("peer_pct_frozen"),
        F.lit(None).cast("double").alias("peer_median_ore_frozen"),
        F.lit(None).cast("long").alias("peer_n_frozen"),
        F.lit(None).cast("int").alias("peer_level_frozen"),
        F.lit(None).cast("date").alias("peer_frozen_on"),
    )

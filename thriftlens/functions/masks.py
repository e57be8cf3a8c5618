"""Dictionary ids and bitmasks for categorical values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.operators.spread import numbered, pick_first, with_row
from thriftlens.session import cut_lineage

# Mask widths: the last bit of each is shared by every value past the width. Fixed values.
MASK_WIDTH = {"material": 62, "colour": 31, "season": 15}


def assign_bits(values: DataFrame, known: DataFrame, kind: str, width: int) -> DataFrame:
    """``known`` (kind, bit, value) plus a bit for every new value, in value order. Values that do
    not fit share the top bit, so the table is keyed by (kind, value) and not by bit."""
    mine = known.where(F.col("kind") == kind)
    fresh = values.select("value").where(F.col("value").isNotNull()).distinct()
    fresh = fresh.join(mine.select("value"), "value", "left_anti").withColumn("kind", F.lit(kind))
    # Only the first ``width`` new values can get a bit of their own.
    leading = pick_first(fresh, ["kind"], [F.col("value")], width)
    placed = numbered(leading, ["kind"], ["value"], F.lit(0), "_n")
    used = mine.agg(F.count(F.lit(1)).alias("_used"))
    bits = with_row(placed, used).select(
        "value", F.least(F.col("_used") + F.col("_n") - 1, F.lit(width - 1)).cast("int").alias("bit")
    )
    added = fresh.join(bits, "value", "left").select(
        "kind", F.coalesce("bit", F.lit(width - 1)).alias("bit"), "value"
    )
    return known.select("kind", "bit", "value").unionByName(added)


def encode_mask(df: DataFrame, values: str, meanings: DataFrame, kind: str, name: str) -> DataFrame:
    """Adds ``name``: one bit set per known value of the array column. Unknown values are ignored;
    no known value gives 0.

    The same few value lists occur again and again, so each distinct list is encoded once and the
    rows are never spread over their values.
    """
    table = meanings.where(F.col("kind") == kind).select(F.col("value").alias("_v"), "bit")
    masks = (
        df.select(values)
        .where(F.col(values).isNotNull())
        .distinct()
        .select(values, F.explode(values).alias("_v"))
        .join(table, "_v")
        .groupBy(values)
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_mask"))
    )
    masks = cut_lineage(masks)  # a small table of known size: the rows are not shuffled to meet it
    joined = df.join(masks, values, "left")
    return joined.withColumn(name, F.coalesce("_mask", F.lit(0).cast("long"))).drop("_mask")


def has_bit(mask: Column, bit: int) -> Column:
    return F.bit_get(mask.cast("long"), F.lit(bit)) == 1


def decode_mask(df: DataFrame, mask: str, meanings: DataFrame, kind: str, name: str) -> DataFrame:
    """Adds ``name``: the sorted values of the set bits. Each distinct mask is decoded once, and a
    mask has at most 63 bits."""
    table = meanings.where(F.col("kind") == kind).select(F.col("bit").alias("_bit"), "value")
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.bit_get(F.col(mask).cast("long"), b) == 1)
    decoded = (
        df.select(mask)
        .where(F.col(mask).isNotNull())
        .distinct()
        .select(mask, F.explode(bits).alias("_bit"))
        .join(table, "_bit")
        .groupBy(mask)
        .agg(F.array_sort(F.collect_set("value")).alias(name))
    )
    return df.join(decoded, mask, "left")


def ensure_lookup(values: DataFrame, lookup: DataFrame) -> DataFrame:
    """``lookup`` (kind, value, id) extended by the (kind, value) pairs it lacks. Old ids stay; new
    ones follow the largest id in (kind, value) order."""
    fresh = values.select("kind", "value").where(F.col("value").isNotNull()).distinct()
    fresh = fresh.join(lookup, ["kind", "value"], "left_anti").withColumn("_all", F.lit(0))
    cell = F.concat_ws("\u0000", F.col("kind"), F.substring("value", 1, 2))
    placed = numbered(fresh, ["_all"], ["kind", "value"], cell, "_n")
    top = lookup.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    added = with_row(placed, top).select(
        "kind", "value", (F.col("_top") + F.col("_n")).cast("long").alias("id")
    )
    return lookup.select("kind", "value", F.col("id").cast("long")).unionByName(added)


def lookup_ids(df: DataFrame, lookup: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Adds ``{kind}_id`` for each ``kind: column``. The dictionary is joined as an ordinary table,
    so it is broadcast only while its size allows."""
    for kind, column in kinds.items():
        table = lookup.where(F.col("kind") == kind).select(
            F.col("value").alias(column), F.col("id").alias(f"{kind}_id")
        )
        df = df.join(table, column, "left")
    return df

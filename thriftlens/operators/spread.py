"""Order-dependent results over groups of any size.

A window over ``partitionBy(brand)`` sorts a whole brand in one task, and an exact percentile
aggregate keeps every distinct value of a group in one buffer. Both break when one group holds a
third of the rows. The operators here first split each group into ordered cells, do the ordered
work inside (group, cell), and carry only one summary row per cell across the group. The results
are exact: cells are consecutive ranges of the order, so a position in the group is the number of
rows in earlier cells plus the position in the cell.

Groups of a null key, and rows whose order is null, which come first, are treated like all others; only
``value_positions`` leaves them out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftlens.session import cut_lineage

# Cells per doubling of a value (of one more than it, so that ratios are cut as finely as prices). Shares between a half and one
# fall in 3,400 cells, prices up to 10^8 in at most 220,000, of which a cell at a million holds 85 integers.
CELLS_PER_OCTAVE = 8192


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row result on every row, as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_one")).scalar()
    return df.select("*", packed.alias("_one")).select(*df.columns, "_one.*")


def value_cell(value: Column) -> Column:
    """A cell number that never falls as the value rises."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * CELLS_PER_OCTAVE).cast("long")


def _before(order: str, keys: Sequence[str], count: str) -> Column:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(window), F.lit(0))


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per group and distinct value: ``n_equal`` rows at it, ``n_below`` rows under it,
    ``n_group`` rows in the group. Null values and null keys take no part."""
    named = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, value]]))
    return positions_of_counts(named.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal")), keys, value)


def positions_of_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``value_positions`` from one row per group and distinct value with ``n_equal``; no key is null."""
    keys = list(keys)
    # Both sides of the join read the counts as they are dealt here: the filter that the join would put on one side stands
    # before, so Spark sees the same rows and shuffles them once.
    counts = counts.withColumn("_cell", value_cell(F.col(value))).where(F.col("_cell").isNotNull()).repartition(*keys, "_cell")
    # The sum names the value too, or the shuffled columns would differ.
    cells = (
        counts.groupBy(*keys, "_cell")
        .agg(F.sum(F.when(F.col(value).isNotNull(), F.col("n_equal"))).alias("_n"))
        .withColumn("_skip", _before("_cell", keys, "_n"))
        .withColumn("n_group", F.sum("_n").over(Window.partitionBy(*keys)))
        .drop("_n")
    )
    inside = counts.withColumn("_in", _before(value, [*keys, "_cell"], "n_equal"))
    return inside.join(cells, [*keys, "_cell"]).select(
        *keys, value, "n_equal", (F.col("_skip") + F.col("_in")).alias("n_below"), "n_group"
    )


def positions_median(positions: DataFrame, keys: Sequence[str], value: str, *carry: str) -> DataFrame:
    """Exact median per group, ``median``, from the rows of ``value_positions``; ``carry`` names columns that are the same all over a group."""
    low = F.floor((F.col("n_group") - 1) / 2)
    high = F.floor(F.col("n_group") / 2)

    def at(position: Column) -> Column:
        hit = (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n_equal"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    return positions.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"), *[F.max(c).alias(c) for c in carry])


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str | Column],
    quantiles: Mapping[str, float] | None = None,
    discrete: bool = False,
) -> DataFrame:
    """Exact quantiles per group of several measures at once.

    Columns come out as ``{quantile}_{measure}``; the default is the median, ``med_{measure}``.
    Null values are left out, and a group in which every value of a measure is null gets null. A
    group without any value is absent, so callers left-join the result to their counts.
    Interpolates linearly; ``discrete`` takes the row at ``floor(n * q)`` of the sorted values.

    The first read counts rows by cell, which combines before the shuffle. The few cells that hold a wanted position are written
    as a small table, and in the second read only rows of those cells go on to the shuffle.
    """
    keys, quantiles = list(keys), dict(quantiles or {"med": 0.5})
    wide = {m: (F.col(c) if isinstance(c, str) else c).cast("double") for m, c in measures.items()}
    pairs = F.array(*[F.struct(F.lit(m).alias("m"), c.alias("v")) for m, c in wide.items()])
    values = (
        df.select(*keys, F.explode(pairs).alias("p"))
        .select(*keys, F.col("p.m").alias("_m"), F.col("p.v").alias("_v"))
        .where(F.col("_v").isNotNull())
        .withColumn("_cell", value_cell(F.col("_v")))
    )
    group = [*keys, "_m"]
    cells = (
        values.groupBy(*group, "_cell")
        .agg(F.count(F.lit(1)).alias("_nc"))
        .withColumn("_skip", _before("_cell", group, "_nc"))
        .withColumn("_total", F.sum("_nc").over(Window.partitionBy(*group)))
    )

    def wanted(q: float) -> tuple[Column, Column, Column]:
        if discrete:
            exact = F.least(F.floor(F.col("_total") * q), F.col("_total") - 1)
        else:
            exact = (F.col("_total") - 1) * q
        low = F.floor(exact)
        return low, F.ceil(exact), exact - low

    def holds(skip: str, size: str, position: Column) -> Column:
        return (F.col(skip) <= position) & (position < F.col(skip) + F.col(size))

    needed = F.lit(False)
    for q in quantiles.values():
        low, high, _ = wanted(q)
        needed = needed | holds("_skip", "_nc", low) | holds("_skip", "_nc", high)
    kept = cut_lineage(cells.where(needed).drop("_nc"))
    counts = (
        null_safe_join(values, kept, [*group, "_cell"])
        .groupBy(*group, "_cell", "_skip", "_total", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    found = counts.withColumn("_below", F.col("_skip") + _before("_v", [*group, "_cell"], "_n"))

    def pick(measure: str, q: float) -> Column:
        low, high, fraction = wanted(q)
        mine = F.col("_m") == measure

        def at(position: Column) -> Column:
            return F.max(F.when(mine & holds("_below", "_n", position), F.col("_v")))

        return at(low) + (at(high) - at(low)) * F.max(F.when(mine, fraction))

    return found.groupBy(*keys).agg(
        *[pick(m, q).alias(f"{name}_{m}") for m in wide for name, q in quantiles.items()]
    )


def with_quantiles(
    summary: DataFrame,
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str | Column],
    **options,
) -> DataFrame:
    """A grouped summary with the quantile columns of the same groups added."""
    if not keys:
        return with_row(summary, group_quantiles(df, [], measures, **options))
    return null_safe_join(summary, group_quantiles(df, keys, measures, **options), keys, "left")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column, name: str = "n") -> DataFrame:
    """Row number from 1 within each group. ``cell`` must never fall as ``order`` rises."""
    keys = list(keys)
    split = df.withColumn("_cell", cell)
    cells = (
        split.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_nc"))
        .withColumn("_skip", _before("_cell", keys, "_nc"))
        .drop("_nc")
    )
    # Where an order column is null the cell is null too, and comes first, as nulls do in the order.
    inside = split.withColumn(
        "_in", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order))
    )
    joined = null_safe_join(inside, cells, [*keys, "_cell"])
    return joined.withColumn(name, F.col("_skip") + F.col("_in")).drop("_cell", "_skip", "_in")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column,
    carry: Sequence[str],
) -> DataFrame:
    """Adds structs ``prev`` and ``next`` with the ``carry`` columns of the adjoining rows, and
    ``n``, the row number from 1. ``order`` must be a total order within the group."""
    keys, order = list(keys), list(order)
    split = df.withColumn("_cell", cell).withColumn("_row", F.struct(*order, *[c for c in carry if c not in order]))
    cells = (
        split.groupBy(*keys, "_cell")
        .agg(
            F.min("_row").alias("_first"),
            F.max("_row").alias("_last"),
            F.count(F.lit(1)).alias("_nc"),
        )
        .withColumn("_skip", _before("_cell", keys, "_nc"))
        .withColumn("_back", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_cell")))
        .withColumn("_ahead", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_cell")))
        .drop("_first", "_last", "_nc")
    )
    inner = Window.partitionBy(*keys, "_cell").orderBy(*order)
    inside = (
        split.withColumn("_lag", F.lag("_row").over(inner))
        .withColumn("_lead", F.lead("_row").over(inner))
        .withColumn("_in", F.row_number().over(inner))
    )
    return (
        null_safe_join(inside, cells, [*keys, "_cell"])
        .withColumn("prev", F.coalesce("_lag", "_back"))
        .withColumn("next", F.coalesce("_lead", "_ahead"))
        .withColumn("n", F.col("_skip") + F.col("_in"))
        .drop("_cell", "_row", "_skip", "_back", "_ahead", "_lag", "_lead", "_in")
    )


def with_last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column,
    value: str | Column,
    name: str,
    only: Column | None = None,
) -> DataFrame:
    """Adds ``name``: the newest non-null ``value`` of an earlier row in the group. With ``only``, rows that it does not hold for offer their value and are left out.

    The rows are shuffled once, by group and cell packed into one struct, in which nulls are equal: cells are counted and joined where the rows
    lie. Across the group goes a row per cell, and back only those of cells that ask."""
    keys, order = list(keys), list(order)
    at = F.struct(F.struct(*keys).alias("g"), cell.alias("c"))
    offer, asked = value if isinstance(value, Column) else F.col(value), F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    split = df.repartition(at).withColumn("_at", at).withColumn("_offer", offer).withColumn("_asked", asked)
    offered = F.when(F.col("_offer").isNotNull(), F.struct(*order, F.col("_offer").alias("_v")))
    over_cells = (
        Window.partitionBy("_at.g").orderBy("_at.c").rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = (
        split.groupBy("_at")
        .agg(F.max(offered)["_v"].alias("_newest"), F.max("_asked").alias("_asks"))
        .where(F.col("_newest").isNotNull() | F.col("_asks"))
        .withColumn("_back", F.last("_newest", ignorenulls=True).over(over_cells))
        .where(F.col("_asks") & F.col("_back").isNotNull())
        .select(F.col("_at").alias("_cell"), "_back")
    )
    inner = (
        Window.partitionBy("_at")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = split.withColumn("_near", F.last("_offer", ignorenulls=True).over(inner)).where("_asked")
    joined = inside.join(cells, inside["_at"] == cells["_cell"], "left")
    return joined.withColumn(name, F.coalesce("_near", "_back")).select(*[c for c in df.columns if c != name], name)


# Bits of the filter of ``nearly_among``, in rows of 32,768: 32 MB at most, however many keys there are.
FILTER_BITS = 2**28


def nearly_among(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str | None = None) -> DataFrame:
    """The rows of ``df`` whose ``key`` is one of ``wanted``, and a few others: for a join that shuffles both sides and finds a match for few rows.

    The hashes of the wanted keys are bits of small tables, so no wanted row is lost; the join that follows drops the others. Beyond some
    hundred millions of keys the filter lets more and more through. ``wanted`` is read here and again by that join, so it should be a table."""
    return _by_filter(df, key, wanted, wanted_key or key, "left_semi")


def left_join_near(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """What ``df.join(few, key, "left")`` gives, where many rows find no match: those that the filter of ``nearly_among`` tells are not shuffled.
    Both are read twice, so they should be tables."""
    if df.schema[key].dataType != few.schema[key].dataType:  # equal keys of two types have two hashes
        return df.join(few, key, "left")
    found = _by_filter(df, key, few, key, "left_semi").join(few, key, "left")
    none = [F.lit(None).cast(field.dataType).alias(field.name) for field in few.schema if field.name != key]
    rest = _by_filter(df, key, few, key, "left_anti")
    return found.union(rest.select(key, *[c for c in df.columns if c != key], *none))


def _by_filter(df: DataFrame, key: str, wanted: DataFrame, name: str, how: str) -> DataFrame:
    """The rows that the filter of ``nearly_among`` lets through (``left_semi``), or all others (``left_anti``)."""

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    bits = (
        wanted.where(F.col(name).isNotNull())
        .select(F.shiftright(place(name), 15).alias("_bucket"), place(name).bitwiseAND(32767).alias("_place"))
        .repartition("_bucket")
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_place").alias("_bits"))
    )
    spot = place(key).bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    held = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(8)]), (spot.bitwiseAND(7) + 1).cast("int"))) != 0
    here = F.col(key).isNotNull() & (F.shiftright(place(key), 15) == F.col("_bucket"))
    return df.join(F.broadcast(bits), here & held, how)


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group. The limit on the row number is pushed below the shuffle,
    so each task sends at most ``n`` rows of a group however large the group is; where ``n`` itself is large, use ``numbered``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.where(F.col("_rank") <= n).drop("_rank")

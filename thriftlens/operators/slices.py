"""Aggregates by a chosen dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.spread import pick_first, with_quantiles


def peer_rate_pivot(items: DataFrame, peers: DataFrame, edges: Sequence[int] = s.PRICE_BAND_EDGES_ORE, key: str = "item_id") -> DataFrame:
    """Sale rate by peer quartile (rows) and price band (columns ``band_0`` and on)."""
    cells = items.select(key, "outcome", s.price_band(F.col("price_ore"), edges).alias("b")).join(
        peers.select(key, s.peer_quartile(F.col("peer_pct")).alias("peer_quartile")), key
    )
    sold = F.col("outcome") == s.SOLD
    return cells.groupBy("peer_quartile").agg(
        *[
            s.ratio(F.count_if(sold & (F.col("b") == b)), F.count_if(F.col("b") == b)).alias(f"band_{b}")
            for b in range(len(edges) + 1)
        ]
    )


DIMENSIONS = {
    "brand": F.col,
    "brand_tier": F.col,
    "item_type": F.col,
    "category": F.col,
    "condition": F.col,
    "demography": F.col,
    "season": F.col,
    "material": F.col,
    "size": F.col,
    "price_band": F.col,
}


def _sliced(df: DataFrame, dim: str) -> DataFrame:
    """Adds ``value``, the text of the dimension. An array counts a row once per value."""
    if dim not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dim!r}; known are {sorted(DIMENSIONS)}")
    column: Column = DIMENSIONS[dim](dim)
    if dict(df.dtypes)[dim].startswith("array"):
        column = F.explode_outer(F.array_distinct(column))
    return df.withColumn("value", column).withColumn("value", F.col("value").cast("string"))


def market_slice(items: DataFrame, dim: str, min_n: int = 1) -> DataFrame:
    """Live listings by a dimension."""
    rows = _sliced(items, dim)
    summary = (
        rows.groupBy("value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("favourites").alias("avg_favourites"),
            s.ratio(F.count_if("has_defect"), F.count(F.lit(1))).alias("defect_rate"),
        )
        .where(F.col("n") >= min_n)
    )
    return with_quantiles(summary, rows, ["value"], {"price_ore": "price_ore"})


def outcome_slice(ladders: DataFrame, dim: str, min_n: int = 30) -> DataFrame:
    """Resolved listings by a dimension. Never pooled with live ones."""
    rows = _sliced(ladders, dim)
    summary = (
        rows.groupBy("value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            s.ratio(F.count_if("sold"), F.count(F.lit(1))).alias("sell_through"),
        )
        .where(F.col("n") >= min_n)
    )
    measures = {
        "days": "days_on_market",
        "kept": s.ratio(F.col("final_price_ore"), F.col("opening_ask_ore")),
    }
    return with_quantiles(summary, rows, ["value"], measures)


def facet_values(pool: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n): every value of every filter column with its rows, a row each. The table to read where a column has
    many values; counts combine before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    values = pool.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull())
    return values.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


# Values that a column of the facet document may have.
MOST_FACET_VALUES = 10_000


def facet_document(pool: DataFrame, columns: Sequence[str], most: int = MOST_FACET_VALUES) -> DataFrame:
    """The values of every filter column as one JSON row, for columns with a dictionary: each column's list is made in a task of its
    own, and the document is put together from one row per column. A column with more than ``most`` values is an error, and no more than one value
    beyond that is ever gathered; ``facet_values`` is the table for such a column."""
    few = pick_first(facet_values(pool, columns), ["facet"], [F.col("value")], most + 1)
    too_many = F.raise_error(F.concat(F.col("facet"), F.lit(f" has over {most} values: read facet_values"))).cast("array<string>")
    values = F.array_sort(F.collect_list("value"))
    lists = few.groupBy("facet").agg(values.alias("values")).withColumn("values", F.when(F.size("values") > most, too_many).otherwise(F.col("values")))
    each = [F.coalesce(F.max(F.when(F.col("facet") == c, F.col("values"))), F.array().cast("array<string>")).alias(c) for c in columns]
    return lists.agg(*each).select(F.to_json(F.struct(*columns)).alias("facets"))


def score_band(score: Column) -> Column:
    return s.band(score, [0, 0.4, 0.6, 0.8, None], ["0.00-0.40", "0.40-0.60", "0.60-0.80", "0.80+"])


def sellability_check(rows: DataFrame) -> DataFrame:
    """Sold rate per score band, kept apart per model version."""
    banded = rows.where(F.col("score").isNotNull()).withColumn("score_band", score_band(F.col("score")))
    return banded.groupBy("score_version", "score_band").agg(
        F.count(F.lit(1)).alias("n"), s.ratio(F.count_if("sold"), F.count(F.lit(1))).alias("sold_rate")
    )


def ratio_outcome(rows: DataFrame, edges: Sequence[float] = (0, 0.6, 0.84, 1.0, None)) -> DataFrame:
    """Sell-through and realised price over the estimate, by price-to-estimate band."""
    labels = ["under 0.60", "0.60-0.84", "0.84-1.00", "1.00+"]
    banded = rows.withColumn("ratio_band", s.band(F.col("price_to_estimate"), list(edges), labels))
    estimate = s.ratio(F.col("price_ore"), F.col("price_to_estimate"))
    summary = banded.groupBy("ratio_band").agg(
        F.count(F.lit(1)).alias("n"), s.ratio(F.count_if("sold"), F.count(F.lit(1))).alias("sell_through")
    )
    realised = {"realised": F.when(F.col("sold"), s.ratio(F.col("final_price_ore"), estimate))}
    return with_quantiles(summary, banded, ["ratio_band"], realised)

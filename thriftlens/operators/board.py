"""The predictor board: which columns separate what sells, and which explain the asking price."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.session import cut_lineage

# Functions of price themselves; on the price target they would explain it trivially.
NOT_FOR_PRICE = ["price_band", "peer_quartile"]


def listing_features(as_of: Column, band_edges=s.PRICE_BAND_EDGES_ORE) -> dict[str, Column]:
    """Feature buckets of a listing in the state read at the start of a pass."""
    age = F.datediff(as_of, F.col("first_offered"))
    months = F.greatest(age, F.lit(1)) / 30
    return {
        "favourites": s.favourites_bucket(F.col("favourites")),
        "favs_per_month": s.favs_per_month_bucket(F.col("favourites") / months),
        "age_days": s.age_bucket(age),
        "weight_g": s.weight_bucket(F.col("weight_g")),
        "price_band": s.price_band(F.col("price_ore"), band_edges).cast("string"),
        "brand": F.col("brand"),
        "brand_tier": F.col("brand_tier").cast("string"),
        "brand_origin": F.col("brand_origin"),
        "brand_ethos": F.col("brand_ethos"),
        "item_type": F.col("item_type"),
        "category": F.col("category"),
        "size": F.col("size_code"),
        "condition": F.col("condition"),
        "season": F.col("season"),
        "is_reserved": F.col("is_reserved").cast("string"),
        "last_chance": F.col("last_chance").cast("string"),
        "p2p": F.when(F.col("p2p"), "resale").otherwise("consignment"),
        "has_defect": F.col("has_defect").cast("string"),
    }


def _buckets(items: DataFrame, features: Mapping[str, Column], *values: Column) -> DataFrame:
    """Rows unpivoted to (feature, bucket). One scan; the counts combine before the shuffle."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), c.alias("bucket")) for f, c in features.items()]
    )
    return (
        items.select(*values, F.explode(pairs).alias("_p"))
        .select("*", "_p.feature", "_p.bucket")
        .drop("_p")
        .where(F.col("bucket").isNotNull())
    )


# The columns of a board, after its day and target.
BOARD = ["feature", "buckets", "n", "lift", "strength", "best_bucket", "best_rate", "worst_bucket", "worst_rate"]


def board_counts(items: DataFrame, features: Mapping[str, Column], sold: Column, price: str = "price_ore") -> DataFrame:
    """All that both boards need of the listings, one row per (feature, bucket): rows and sold rows, and of those with a price
    their number, sum and sum of squares."""
    long = _buckets(items, features, F.coalesce(sold, F.lit(False)).alias("_sold"), F.col(price).alias("_y"))
    y = F.col("_y").cast("decimal(19,0)")
    return long.groupBy("feature", "bucket").agg(
        F.count(F.lit(1)).alias("n_sale"),
        F.count_if("_sold").alias("k"),
        F.count("_y").alias("n_price"),
        F.sum("_y").alias("y"),
        F.sum(y * y).alias("yy"),
    )


def _board(kept: DataFrame, strength: Column, target: str, as_of: Column) -> DataFrame:
    """One row per feature of the buckets ``kept``, (feature, bucket, n, rate and what ``strength`` aggregates), in one aggregate.

    The percentiles over buckets are exact; their state is one number for each rate that a feature's buckets have, and
    a bucket stands for ``min_bucket`` listings."""
    order = F.struct("rate", "bucket")
    found = kept.groupBy("feature").agg(
        F.count(F.lit(1)).alias("buckets"),
        F.sum("n").alias("n"),
        s.ratio(F.percentile("rate", F.lit(0.9)), F.percentile("rate", F.lit(0.1))).alias("lift"),
        strength.alias("strength"),
        F.max_by("bucket", order).alias("best_bucket"),
        F.max("rate").alias("best_rate"),
        F.min_by("bucket", order).alias("worst_bucket"),
        F.min("rate").alias("worst_rate"),
    )
    return found.select(as_of.alias("as_of"), F.lit(target).alias("target"), *BOARD)


def sale_board(counts: DataFrame, as_of: Column, min_bucket: int = 200) -> DataFrame:
    """Sale rate per bucket: lift, Cramér's V and the extreme buckets. Thin buckets are dropped,
    not merged."""
    n, k = F.col("n"), F.col("k")
    kept = counts.withColumn("n", F.col("n_sale")).where(n >= min_bucket).withColumn("rate", k / n)
    # With two outcomes, chi square is sum((k - n p)^2 / (n p (1 - p))), p the overall rate, and
    # the smaller side of the table has two columns, so V = sqrt(chi2 / total).
    p = F.sum(k) / F.sum(n)
    chi2 = s.ratio(F.sum(k * k / n) - F.sum(k) * p, p * (1 - p))
    v = F.sqrt(F.greatest(chi2 / F.sum(n), F.lit(0.0)))
    return _board(kept, F.when(F.count(F.lit(1)) > 1, v).otherwise(0.0), "sale", as_of)


def price_board(counts: DataFrame, as_of: Column, min_bucket: int = 200) -> DataFrame:
    """Mean ask per bucket: ratio of the 90th to the 10th percentile bucket, and eta squared. Features that are functions of price are left out."""
    used = counts.where(~F.col("feature").isin(NOT_FOR_PRICE))
    n, y = F.col("n"), F.col("y")
    kept = used.withColumn("n", F.col("n_price")).where(n >= min_bucket).withColumn("rate", y / n)
    centre = F.sum(y).cast("double") * F.sum(y) / F.sum(n)
    eta2 = s.ratio(F.sum(y * F.col("rate")) - centre, F.sum("yy").cast("double") - centre)
    return _board(kept, F.greatest(F.coalesce(eta2, F.lit(0.0)), F.lit(0.0)), "price", as_of)


BOARDS = {"sale": sale_board, "price": price_board}


def predictor_board(items: DataFrame, features: Mapping[str, Column], as_of: Column, target: str = "sale", min_bucket: int = 200, sold: Column | None = None) -> DataFrame:
    """The board of one target: one read, one shuffle of bucket counts."""
    if target not in BOARDS:
        raise ValueError(f"unknown target {target!r}")
    sale = F.col("outcome") == s.SOLD if sold is None else sold
    return BOARDS[target](board_counts(items, features, sale), as_of, min_bucket)


def predictor_boards(items: DataFrame, features: Mapping[str, Column], as_of: Column, min_bucket: int = 200, sold: Column | None = None) -> DataFrame:
    """The boards of both targets from the same bucket counts, which are written once."""
    sale = F.col("outcome") == s.SOLD if sold is None else sold
    counts = cut_lineage(board_counts(items, features, sale))
    return sale_board(counts, as_of, min_bucket).unionByName(price_board(counts, as_of, min_bucket))

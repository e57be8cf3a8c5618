"""The candidate pool: rotation, daily refresh, retention, and the rows it stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.functions.masks import MASK_WIDTH, decode_mask
from thriftlens.operators import filters
from thriftlens.operators.brands import attention_index, brand_snapshot
from thriftlens.operators.peers import PEER_LEVELS, peer_cascade
from thriftlens.operators.selecting import top_n
from thriftlens.operators.spread import null_safe_join, numbered, value_cell
from thriftlens.operators.track import once
from thriftlens.session import cut_lineage
from thriftlens.sources.tables import delete_where

MIN_BRAND_ITEMS = 8


def score_bucket(market: DataFrame, min_brand: int = MIN_BRAND_ITEMS, min_group: int = 8, **gates) -> DataFrame:
    """The cheap quarter of a bucket's whole brands. Levels 1 and 2 lie inside a brand, so groups
    are complete; level 3 spans brands and is not computed."""
    thick = market.groupBy("brand").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_brand)
    rows = market.join(thick.select("brand"), "brand", "left_semi")
    keep = [c for c in rows.columns if c not in ("item_id", "price_ore")]
    placed = peer_cascade(rows, PEER_LEVELS[:2], min_group, keep=keep)
    discount = s.discount_pct(F.col("price_ore"), F.col("peer_median_ore"))
    scored = placed.withColumn("discount_pct", discount)
    return filters.shortlist_gate(scored, **gates)


def refresh_bucket(pool: DataFrame, market: DataFrame, bucket: int, as_of: Column, **options) -> DataFrame:
    """The pool with one bucket swept again: its old rows and rows of no bucket go, an item swept
    here goes from wherever else it was, and the new survivors come in."""
    swept = once(market.where(F.col("bucket") == bucket))
    kept = score_bucket(swept, **options).withColumn("swept_on", as_of).withColumn("as_of", as_of)
    rest = delete_where(pool, (F.col("bucket") == bucket) | F.col("bucket").isNull())
    rest = rest.join(swept.select("item_id"), "item_id", "left_anti")
    return rest.unionByName(kept.select(*pool.columns))


def reprice_pool(pool: DataFrame, observed: DataFrame, today: Column) -> DataFrame:
    """Today's price and liveness on every pool row. The peer median stays the one of the sweep, so
    ``swept_on`` does not move; ``as_of`` does. A missing or zero price keeps the old one."""
    new = once(observed).select(
        "item_id", F.nullif(F.col("price_ore"), F.lit(0)).alias("_ore"), F.lit(True).alias("_live")
    )
    price = F.coalesce(s.to_kr_floor(F.col("_ore")), F.col("price_kr"))
    return (
        pool.join(new, "item_id", "left")
        .withColumn("repriced", ~price.eqNullSafe(F.col("price_kr")))
        .withColumn("price_kr", price)
        .withColumn("discount_pct", s.discount_pct(F.col("price_kr"), F.col("peer_median_kr")))
        .withColumn("still_listed", F.coalesce("_live", F.lit(False)))
        .withColumn("as_of", today)
        .drop("_ore", "_live")
    )


def retain(df: DataFrame, date_col: str, today: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days; on a table partitioned by the date only those are read."""
    return df.where((F.col(date_col) > F.date_sub(today, days)) & (F.col(date_col) <= today))


# What the gate and the stored rows need of a listing.
SHORTLISTED = (
    "brand", "brand_tier", "item_type", "category", "condition", "demography", "size_code", "first_price_ore", "favourites",
    "first_favourites", "weight_g", "has_defect", "p2p", "first_offered", "is_reserved",
)


def build_shortlist(items: DataFrame, as_of: Column, band_edges: Sequence[int] = s.PRICE_BAND_EDGES_ORE, min_live: int = 25, min_group: int = 8, peers: DataFrame | None = None, meanings: DataFrame | None = None, staged: bool = False, **gates) -> DataFrame:
    """Every eligible live item with all the grid sorts on: peer position, markdown, size columns, decoded masks,
    brand-level columns and its rank by discount, stored so that no reader computes them.

    The shelf is written once, or read as it is where ``items`` are ``staged``, a written table or a filter on one; the cascade carries its columns along, and both brand aggregates
    read it. ``peers`` is a stored peer table to use in place of the cascade. ``meanings`` (kind, bit, value) decodes the ``<kind>_mask`` columns there are.
    """
    rows = filters.analysis_rows(items)
    rows = rows if staged else cut_lineage(rows)
    live = filters.live(rows)
    if peers is None:
        keep = [c for c in live.columns if c in SHORTLISTED or c.endswith("_mask")]
        placed = peer_cascade(live, min_group=min_group, keep=keep, staged=True, max_pct=gates.get("max_pct", filters.MAX_PCT))
    else:
        placed = live.join(peers.drop("price_ore"), "item_id")
    discount = s.discount_pct(F.col("price_ore"), F.col("peer_median_ore"))
    gated = cut_lineage(filters.shortlist_gate(placed, **gates).withColumn("discount_pct", discount))
    order = [F.col("discount_pct").desc(), F.col("item_id")]
    # The same few size codes and categories occur again and again; each pair is taken apart once.
    code, path = F.col("size_code"), F.col("category")
    group, system, value = s.size_parts(code)
    sizes = gated.select("size_code", "category").distinct().select(
        "size_code",
        "category",
        group.alias("size_group"),
        system.alias("size_system"),
        value.alias("size_value"),
        s.size_area(code, path).alias("size_area"),
        s.size_key(code, path).alias("size_key"),
    )
    gated = null_safe_join(gated, sizes, ["size_code", "category"])
    gated = numbered(gated, [], order, -value_cell(F.coalesce("discount_pct", F.lit(-1e9))), "rank")
    kinds = [k for k in MASK_WIDTH if meanings is not None and f"{k}_mask" in rows.columns]
    for kind in kinds:
        gated = decode_mask(gated, f"{kind}_mask", meanings, kind, f"{kind}s")
    # A row per brand, written so that whoever reads the result again does not read the shelf for them.
    attention = cut_lineage(attention_index(live, as_of, band_edges=band_edges).select("brand", "attention_index"))
    brand = cut_lineage(
        brand_snapshot(rows, as_of, min_live).select(
            "brand", F.col("sold_pct_day").alias("brand_sell_pct_day"), F.col("med_ask_ore").alias("brand_ask_ore")
        )
    )
    return (
        gated.join(attention, "brand", "left")
        .join(brand, "brand", "left")
        .select(
            as_of.alias("as_of"),
            "item_id",
            "brand",
            "brand_tier",
            "item_type",
            "category",
            "condition",
            "demography",
            "size_group",
            "size_system",
            "size_value",
            "size_area",
            "size_key",
            s.to_kr_floor(F.col("price_ore")).alias("price_kr"),
            s.to_kr(F.col("peer_median_ore")).alias("peer_median_kr"),
            "peer_n",
            "peer_level",
            (F.col("peer_pct") * 100).alias("peer_pct"),
            "discount_pct",
            F.col("rank").cast("int").alias("rank"),
            *[f"{kind}s" for kind in kinds],
            s.markdown_pct(F.col("first_price_ore"), F.col("price_ore")).alias("markdown_pct"),
            s.momentum(F.col("favourites"), F.col("first_favourites")).alias("momentum"),
            F.datediff(as_of, F.col("first_offered")).alias("age_days"),
            "favourites",
            "weight_g",
            "has_defect",
            "p2p",
            F.col("attention_index").alias("brand_attention_index"),
            "brand_sell_pct_day",
            "brand_ask_ore",
        )
    )


def flagged(shortlist: DataFrame, n: int = 500, per_brand: int = 15) -> DataFrame:
    """The thin record of what was recommended: item, day, rank and price."""
    from thriftlens.operators.selecting import cap_per_key

    order = [F.col("discount_pct").desc(), F.col("item_id")]
    best = top_n(cap_per_key(shortlist, "brand", per_brand, order), n, order)
    return best.select("as_of", "item_id", "rank", "price_kr", "discount_pct")


def attach_documents(pool: DataFrame, documents: DataFrame, today: Column, hosts: Sequence[str]) -> DataFrame:
    """Image paths and liveness on the day's rows: an item without a document is gone."""
    paths = s.image_paths(F.col("images"), hosts)
    docs = once(documents).select("item_id", F.when(F.size(paths) > 0, paths).alias("_paths"), F.lit(True).alias("_live"))
    return (
        pool.join(docs, "item_id", "left")
        .withColumn("image_paths", F.col("_paths"))
        .withColumn("still_listed", F.coalesce("_live", F.lit(False)))
        .withColumn("image_checked_on", today)
        .drop("_paths", "_live")
    )


def refresh_pool(pool: DataFrame, observed: DataFrame, today: Column, hosts: Sequence[str] = ()) -> DataFrame:
    """The daily refresh of the whole pool: price and liveness, and images where observed."""
    fresh = reprice_pool(pool, observed, today)
    return attach_documents(fresh, observed, today, hosts) if "images" in observed.columns else fresh


def score_table(items: DataFrame, demand: DataFrame, excluded: DataFrame, today: Column, floor_ore: int = 10000) -> DataFrame:
    """Stored scores of the eligible items: live, consignment, priced at the floor or above, not in
    an excluded category. A brand without demand counts as neutral."""
    eligible = filters.live(items).where(~F.coalesce("p2p", F.lit(False)) & (F.col("price_ore") >= floor_ore))
    eligible = filters.exclude_categories(eligible, excluded)
    price, ratio = s.to_kr(F.col("price_ore")), F.col("price_to_estimate")
    profit = s.expected_profit(price, ratio)
    joined = eligible.join(demand.select("brand", "demand_index"), "brand", "left")
    index = F.coalesce("demand_index", F.lit(1.0))
    return joined.select(
        "item_id",
        s.candidate_score(profit, index, F.col("has_defect")).alias("score"),
        profit.alias("expected_profit"),
        s.worth_x(ratio).alias("worth_x"),
        s.cap_binds(ratio).alias("cap_binds"),
        s.premium_fibre(F.col("materials")).alias("premium_fibre"),
        s.out_of_season(F.col("season_mask"), today).alias("out_of_season"),
    )

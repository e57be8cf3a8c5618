"""Nested source documents to flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.functions.masks import encode_mask, lookup_ids

# kind of dictionary: column of the flattened document
LOOKUP_KINDS = {
    "category": "category",
    "item_type": "item_type",
    "size": "size",
    "condition": "condition",
    "demography": "demography",
    "fabric": "fabric",
    "pattern": "pattern",
}
STAGING_COLUMNS = [
    "item_id", "brand", "category_id", "item_type_id", "size_id", "condition_id", "demography_id",
    "pattern_id", "season_mask", "material_mask", "colour_mask", "weight_g", "has_defect",
    "first_price_ore", "price_ore", "favourites", "fav_nordic", "fav_eu", "fav_dach",
    "first_offered", "is_reserved", "p2p", "last_chance",
]


def _has_any(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def flat_listings(docs: DataFrame) -> DataFrame:
    """One flat row per listing document, values still spelled out. A missing branch gives null."""
    m, price = F.col("metadata"), F.col("price_SE.amount")
    weight = F.nullif(F.col("weight"), F.lit(0.0))
    return docs.select(
        F.col("objectID").alias("item_id"),
        m["brand"].alias("brand"),
        s.listing_category(F.col("categories")).alias("category"),
        m["type"].alias("item_type"),
        m["size"].alias("size"),
        m["condition"].alias("condition"),
        m["demography"].alias("demography"),
        m["fabric"].alias("fabric"),
        m["pattern"].alias("pattern"),
        m["season"].alias("seasons"),
        m["material"].alias("materials"),
        m["color"].alias("colours"),
        (weight * 1000).cast("int").alias("weight_g"),
        _has_any(m["defects"]).alias("has_defect"),
        price.alias("price_ore"),
        F.col("priceDrop_SE.oldPrice.amount").alias("old_price_ore"),
        F.col("favouriteCount").alias("favourites"),
        F.col("favoriteCountBucket_NORDIC").alias("fav_nordic"),
        F.col("favoriteCountBucket_EU").alias("fav_eu"),
        F.col("favoriteCountBucket_DACH").alias("fav_dach"),
        F.col("lastChance").alias("last_chance"),
        F.col("isReserved").alias("is_reserved"),
        F.col("p2p"),
        s.epoch_date(F.col("firstOfferedAt_SE")).alias("first_offered"),
        s.epoch_date(F.col("saleStartedAt")).alias("sale_started"),
        F.col("sizes"),
        F.col("images"),
    )


def lookup_values(flat: DataFrame) -> DataFrame:
    """The distinct (kind, value) pairs that flat listings need in the dictionary."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in LOOKUP_KINDS.items()]
    )
    return flat.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()


def listing_rows(docs: DataFrame, lookup: DataFrame, meanings: DataFrame, stratum: str, weight: Column, today: Column) -> DataFrame:
    """Rows of the items table: dictionary ids, bitmasks, grams, öre and the sampling columns."""
    rows = lookup_ids(flat_listings(docs), lookup, LOOKUP_KINDS)
    for kind, column in (("season", "seasons"), ("material", "materials"), ("colour", "colours")):
        rows = encode_mask(rows, column, meanings, kind, f"{kind}_mask")
    price = F.col("price_ore")
    first = F.when(F.coalesce(price, F.lit(0)) != 0, F.array(F.lit(0).cast("long"), price))
    return rows.select(
        "*",
        price.alias("first_price_ore"),
        F.col("favourites").alias("first_favourites"),
        today.alias("first_seen"),
        today.alias("last_seen"),
        first.alias("history"),
        F.lit(stratum).alias("stratum"),
        weight.alias("sample_weight"),
    ).drop("seasons", "materials", "colours", *LOOKUP_KINDS.values())


def staging_rows(rows: DataFrame, hosts: Sequence[str], buckets: int = 24) -> DataFrame:
    """The allow-listed columns of swept rows, their rotation bucket and image paths."""
    paths = s.image_paths(F.col("images"), hosts)
    return rows.select(
        *[c for c in STAGING_COLUMNS if c in rows.columns],
        s.bucket_of(F.col("brand"), buckets).alias("bucket"),
        F.when(F.size(paths) > 0, paths).alias("image_paths"),
    )


def cohort_rows(docs: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """Search documents to cohort rows; prices in kronor as the cohort keeps them."""
    t = F.col("translatedMetadata_sv")
    return docs.select(
        F.col("id").alias("item_id"),
        F.col("sharedMetadata.brand").alias("brand"),
        t["type"].alias("item_type"),
        t["season"].alias("season"),
        F.when(_has_any(t["material"]), t["material"]).otherwise(F.col("materials_sv")).alias("materials"),
        s.deepest_category(F.col("categories_sv")).alias("category"),
        F.col("sizes"),
        s.image_paths(F.col("images"), hosts).alias("image_paths"),
        t["demography"].alias("demography"),
        t["condition"].alias("condition"),
        _has_any(t["defects"]).alias("has_defect"),
        s.to_kr(F.col("price_SE.amount")).alias("price_kr"),
        F.col("price_SE.amount").alias("price_ore"),
        F.col("priceToEstimateRatio").alias("price_to_estimate"),
        F.col("favouriteCount").alias("favourites"),
        F.col("brandClassification.pricePoint").alias("brand_tier"),
        F.col("lastChance").alias("last_chance"),
        F.col("p2p"),
        F.col("isOnShelf").alias("on_shelf"),
        F.col("isReserved").alias("is_reserved"),
        F.col("saleStartedAt").alias("sale_started_at"),
    )


def offer_steps(docs: DataFrame, region: str = "SE") -> DataFrame:
    """Offer documents of one region as price steps in öre."""

    def moment(text: Column) -> Column:
        iso = F.coalesce(F.get_json_object(text, "$.iso"), text)
        return F.try_to_timestamp(F.regexp_replace(iso, "Z$", "+00:00"))

    return docs.where(F.col("region") == region).select(
        F.col("item.objectId").alias("item_id"),
        F.col("objectId").alias("offer_id"),
        moment(F.col("createdAt")).alias("created_at"),
        moment(F.col("endedAt")).alias("ended_at"),
        s.to_ore(F.col("pricing.amount")).alias("price_ore"),
        F.col("item.itemStatus").alias("status"),
    )


def offer_details(docs: DataFrame) -> DataFrame:
    """Attributes of the listings that offers belong to, one row per listing."""
    m, e = F.col("item.metadata"), F.col("item.sellabilityEstimate")
    rows = docs.select(
        F.col("item.objectId").alias("item_id"),
        F.struct(
            F.col("createdAt").alias("_at"),
            m["brand"].alias("brand"),
            m["type"].alias("item_type"),
            m["condition"].alias("condition"),
            m["demography"].alias("demography"),
            F.array_join(m["season"], ",").alias("season"),
            _has_any(m["defects"]).alias("has_defect"),
            m["productId"].alias("product_id"),
            F.col("item.itemStatus").alias("status"),
            e["score"].alias("score"),
            e["version"].alias("score_version"),
            e["cutoff"].alias("cutoff"),
            F.col("item.preceding.objectId").alias("original_id"),
            s.dwell_days(
                s.iso_day(F.col("item.assortedAt")), s.iso_day(F.col("item.putOnShelfAt"))
            ).alias("dwell_days"),
        ).alias("d"),
    )
    newest = rows.where("item_id is not null").groupBy("item_id").agg(F.max("d").alias("d"))
    return newest.select("item_id", "d.*").drop("_at")


def brand_classes(docs: DataFrame) -> DataFrame:
    """(brand, item_id, classification) of each document; a classification without a tier is none."""
    c = F.col("brandClassification")
    known = {
        "price_point": "pricePoint",
        "styles": "styles",
        "age_groups": "ageGroups",
        "origin_vibe": "originVibe",
        "ethos": "ethos",
        "aesthetic_tone": "aestheticTone",
    }
    return docs.select(
        F.col("metadata.brand").alias("brand"),
        F.col("objectID").alias("item_id"),
        *[F.when(c["pricePoint"].isNotNull(), c[src]).alias(col) for col, src in known.items()],
    )


def mask_values(flat: DataFrame, column: str) -> DataFrame:
    return flat.select(F.explode(column).alias("value")).distinct()

"""Fixed schemas of the source documents. Nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_SS = T.ArrayType(_S)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LEVELS = {f"lvl{i}": _SS for i in range(4)}
_AMOUNT = struct(amount=_L)
_CLASSES = struct(
    pricePoint=T.IntegerType(), styles=_SS, ageGroups=_SS, originVibe=_S, ethos=_S, aestheticTone=_S
)

LISTING = struct(
    objectID=_S,
    metadata=struct(
        brand=_S, type=_S, size=_S, condition=_S, demography=_S, fabric=_S, pattern=_S,
        material=_SS, color=_SS, season=_SS, defects=_SS,
    ),
    categories=struct(**_LEVELS),
    price_SE=_AMOUNT,
    priceDrop_SE=struct(oldPrice=_AMOUNT),
    weight=_D,
    favouriteCount=_L,
    favoriteCountBucket_NORDIC=_L,
    favoriteCountBucket_EU=_L,
    favoriteCountBucket_DACH=_L,
    firstOfferedAt_SE=_L,
    saleStartedAt=_L,
    isReserved=_B,
    lastChance=_B,
    p2p=_B,
    sizes=_SS,
    images=_SS,
    brandClassification=_CLASSES,
)

SEARCH_DOCUMENT = struct(
    id=_S,
    sharedMetadata=struct(brand=_S),
    translatedMetadata_sv=struct(
        type=_S, season=_SS, material=_SS, demography=_S, condition=_S, defects=_SS
    ),
    materials_sv=_SS,
    categories_sv=struct(**_LEVELS),
    brandClassification=_CLASSES,
    sizes=_SS,
    images=_SS,
    price_SE=_AMOUNT,
    priceToEstimateRatio=_D,
    favouriteCount=_L,
    lastChance=_B,
    p2p=_B,
    isOnShelf=_B,
    isReserved=_B,
    saleStartedAt=_L,
)

# Dates of an item may be plain text or an object; as a string column the reader keeps either.
OFFER = struct(
    objectId=_S,
    item=struct(
        objectId=_S,
        itemStatus=_S,
        metadata=struct(
            brand=_S, type=_S, condition=_S, demography=_S, productId=_S, size=_S,
            season=_SS, defects=_SS, material=_SS,
        ),
        assortedAt=_S,
        putOnShelfAt=_S,
        preceding=struct(objectId=_S),
        sellabilityEstimate=struct(score=_D, cutoff=_D, isReliable=_B, version=_S),
        images=_SS,
    ),
    pricing=struct(amount=_D, currency=_S),
    region=_S,
    first=_B,
    latest=_B,
    createdAt=_S,
    endedAt=_S,
)

_LADDER = T.ArrayType(struct(**{"price": _D, "from": T.DateType(), "to": T.DateType()}))
LADDER_FILE = struct(
    item_id=_S, brand=_S, type=_S, condition=_S, demography=_S, season=_SS, has_defect=_B,
    product_id=_S, status=_S, sold=_B, score=_D, score_version=_S, cutoff=_D,
    dwell_days=T.IntegerType(), opening_ask=_D, final_price=_D, rungs=T.IntegerType(), decay=_D,
    listed_on=T.DateType(), ended_on=T.DateType(), days_on_market=T.IntegerType(), ladder=_LADDER,
)
# Field names of the collected files, as their source writes them.
COHORT_FILE = struct(
    item_id=_S, stratum=_S, enrolled_on=T.DateType(), url=_S, brand=_S, type=_S, condition=_S,
    has_defect=_B, price_kr=_D, price_to_estimate=_D, favourites=_L, brand_tier=T.IntegerType(),
    last_chance=_B, is_circle=_B, on_shelf=_B, reserved=_B, sale_started_at=_L,
)
CHECK_FILE = struct(
    item_id=_S, checked_on=T.DateType(), outcome=_S, status=_S, final_price=_D, rungs=T.IntegerType()
)
TRIP_FILE = struct(
    circle_id=_S, original_id=_S, brand=_S, type=_S, condition=_S, has_defect=_B, season=_SS,
    score=_D, original_opening=_D, original_rungs=T.IntegerType(), bought_price=_D,
    bought_discount=_D, bought_on=T.DateType(), circle_ask=_D, circle_final=_D,
    circle_rungs=T.IntegerType(), listed_on=T.DateType(), ended_on=T.DateType(), sold=_B,
    status=_S, multiple=_D, profit=_D, days_held=T.IntegerType(), days_on_circle=T.IntegerType(),
)

"""Queries on filters, sets, pages, sampling strata and dictionaries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from thriftlens import schemas
from thriftlens.functions import masks
from thriftlens.functions import scalars as s
from thriftlens.operators import filters, sampling, selecting
from thriftlens.plans.binding import AS_OF, BAND_EDGES, Market, r6, crc32_sql
from thriftlens.plans.jobs import load_local
from thriftlens.plans.registry import query, rounded
from thriftlens.plans.scalar_queries import BAND
from thriftlens.session import cut_lineage, shared_dir, staging
from thriftlens.sources import documents
from thriftlens.sources.io import read_jsonl, write_lines

DAY = f"DATE '{AS_OF}'"
LIVE = "l_linestatus = 'O'"

# --- filters ------------------------------------------------------------------------------------


@query("wearable", "items", """
    SELECT item_id, category, price_ore FROM items WHERE category IN ('bolt', 'gear', 'ring') AND price_ore >= 5000000""")
def wearable(m: Market):
    rows = m.items("item_id", "category", "price_ore")
    return filters.wearable(rows, 50000, categories=["bolt", "gear", "ring"])


@query("facet_filter", "items", """
    SELECT item_id, colour, category, condition FROM items
    WHERE (colour = 'red' OR category = 'gear') AND condition IN ('1-URGENT', '5-LOW')""")
def facet_filter(m: Market):
    rows = m.items("item_id", "colour", "category", "condition").withColumn("materials", F.array("colour", "category"))
    groups = [[("materials", "red"), ("materials", "gear")], [("condition", "1-URGENT"), ("condition", "5-LOW")]]
    return filters.facet_filter(rows, groups).drop("materials")


# A listing fits its label, and one size code ending in zero also the next size.
SIZES = "CASE WHEN size_code LIKE '%0' THEN [size_code, concat(left(size_code, length(size_code) - 1), '1')] ELSE [size_code] END"
TARGETS = """
targets AS (SELECT DISTINCT size_code, CASE WHEN size_code LIKE 'SHOES%' THEN 'BUILDING' END AS who,
    CASE WHEN size_code LIKE 'SHOES%' THEN 'shoes' ELSE 'clothes' END AS bucket
  FROM items WHERE weight_g <= 300)
"""


def fitting(m: Market):
    size = F.col("size_code")
    wider = F.array(size, F.concat(F.substring(size, F.lit(1), F.length(size) - 1), F.lit("1")))
    rows = m.items("item_id", "size_code", "demography")
    return rows.withColumn("sizes", F.when(size.endswith("0"), wider).otherwise(F.array(size)))


def targets(m: Market):
    """Sizes up to a weight are wanted; shoes of one demography only."""
    code = F.col("size_code")
    shoes = code.startswith("SHOES")
    light = m.items("size_code", "weight_g").where("weight_g <= 300").select("size_code").distinct()
    return light.select(
        code,
        F.when(shoes, "BUILDING").alias("demography"),
        F.when(shoes, "shoes").otherwise("clothes").alias("bucket"),
    )


@query("fits_profile", "items", f"""WITH {TARGETS}
    SELECT item_id, size_code, demography FROM items i WHERE EXISTS (SELECT 1 FROM targets t
      WHERE list_contains({SIZES.replace("size_code", "i.size_code")}, t.size_code) AND (who IS NULL OR who = demography))""")
def fits_profile(m: Market):
    return filters.fits_profile(fitting(m), targets(m)).drop("sizes")


@query("target_size_counts", "items", f"""WITH {TARGETS},
    x AS (SELECT item_id, demography, unnest({SIZES}) AS z FROM items),
    f AS (SELECT x.item_id, bucket, coalesce(who, 'size implies wearer') AS shape FROM x JOIN targets t ON z = t.size_code AND (who IS NULL OR who = demography))
    SELECT 'bucket' AS kind, bucket AS name, count(DISTINCT item_id) AS n FROM f GROUP BY 2
    UNION ALL SELECT 'shape', shape, count(DISTINCT item_id) FROM f GROUP BY 2""")
def target_size_counts(m: Market):
    return sampling.target_size_counts(fitting(m), targets(m))


@query("exclude_categories", "items", """
    SELECT item_id, concat(category, ' > ', item_type, ' > ', colour) AS path FROM items
    WHERE NOT (category = 'gear' OR (category = 'ring' AND item_type = 'PROMO'))""")
def exclude_categories(m: Market):
    """Paths under an excluded one go; the exclusions are the gear branch and one leaf."""
    rows = m.items("item_id", "category", "item_type", "colour")
    rows = rows.select("item_id", F.concat_ws(" > ", "category", "item_type", "colour").alias("path"))
    dropped = F.when(F.col("c") == "gear", F.col("c")).when(
        (F.col("c") == "ring") & (F.col("p_type") == "PROMO"), F.concat_ws(" > ", "c", "p_type")
    )
    part = m.table("part").withColumn("c", F.split_part("p_name", F.lit(" "), F.lit(2)))
    excluded = part.select(dropped.alias("path")).where("path is not null").distinct()
    return filters.exclude_categories(rows, excluded, "path")


# --- sets and pages -----------------------------------------------------------------------------


@query("latest_by_key", None, """
    SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_by_key(m: Market):
    return selecting.latest_by_key(m.table("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("first_source_wins", None, """
    SELECT user_id, any_value(source) AS source, min(event_id) AS event_id FROM (
      SELECT user_id, 'purchase' AS source, event_id FROM events WHERE event_type = 'purchase' AND value > 90
      UNION ALL SELECT user_id, 'view', event_id FROM events WHERE event_type = 'view'
        AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)) GROUP BY 1""")
def first_source_wins(m: Market):
    events = m.table("events").select("user_id", "event_id", "event_type", "value", F.col("event_type").alias("source"))
    dear = events.where("event_type = 'purchase' and value > 90")
    views = events.where("event_type = 'view'")
    return selecting.first_by_key([dear, views], ["user_id"], ["event_id"]).select("user_id", "source", "event_id")


@query("dedupe_listings", None, """
    SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2""")
def dedupe_listings(m: Market):
    """An order and line number come more than once; the lowest product stays."""
    key = ["l_orderkey", "l_linenumber"]
    rows = m.table("lineitem").select(*key, "l_partkey", "l_suppkey", "l_shipdate")
    return selecting.dedupe(rows, key, ["l_partkey", "l_suppkey", "l_shipdate"]).select(*key, "l_partkey")


@query("work_list", "items", """
    SELECT DISTINCT product_id FROM items WHERE (outcome IS NULL OR has_defect)
    AND product_id NOT IN (SELECT product_id FROM items WHERE p2p AND outcome = 1)""")
def work_list(m: Market):
    rows = m.items("product_id", "outcome", "has_defect", "p2p")
    parts = [rows.where("outcome is null"), rows.where("has_defect")]
    done = rows.where("p2p and outcome = 1").select("product_id").distinct()
    return selecting.work_list(parts, done, "product_id")


@query("cap_per_brand", "items", """
    SELECT item_id, brand, price_ore FROM items WHERE outcome IS NULL
    QUALIFY row_number() OVER (PARTITION BY brand ORDER BY price_ore, item_id) <= 25""")
def cap_per_brand(m: Market):
    rows = m.items("item_id", "brand", "price_ore", only=LIVE)
    return selecting.cap_per_key(rows, "brand", 25, [F.col("price_ore"), F.col("item_id")])


@query("keyset_page", "items", """
    SELECT item_id, price_ore FROM items WHERE outcome IS NULL AND item_id > '5' ORDER BY item_id LIMIT 1000""")
def keyset_page(m: Market):
    return selecting.keyset_page(m.items("item_id", "price_ore", only=LIVE), "item_id", "5", 1000)


@query("pool_page", "shelf", """
    SELECT item_id, price_ore, favourites, count(*) OVER () AS total FROM shelf
    WHERE condition = '1-URGENT' AND price_ore >= 3000000 ORDER BY favourites DESC, item_id LIMIT 60""")
def pool_page(m: Market):
    rows = m.shelf("item_id", "price_ore", "favourites", "condition")
    hits = [F.col("condition") == "1-URGENT", F.col("price_ore") >= 3000000]
    return selecting.page(rows, hits, [F.col("favourites").desc()]).drop("condition")


@query("next_bucket", None, """
    SELECT cast(b AS int) AS bucket, cast(max(ts) AS date) AS swept_on FROM range(24) r(b)
    LEFT JOIN events ON user_id % 20 = b GROUP BY 1 ORDER BY swept_on ASC NULLS FIRST, bucket LIMIT 1""")
def next_bucket(m: Market):
    """Four buckets were never swept; the first of them is next."""
    pool = m.table("events").select((F.col("user_id") % 20).cast("int").alias("bucket"), F.to_date("ts").alias("swept_on"))
    return selecting.next_bucket(m.spark, pool)


@query("oldest_bucket", None, """
    WITH p AS (SELECT CAST(user_id % 24 AS int) AS bucket, cast(ts AS date) - cast(user_id % 24 * 7 % 11 AS int) AS swept_on FROM events)
    SELECT cast(b AS int) AS bucket, max(swept_on) AS swept_on FROM range(24) r(b) LEFT JOIN p ON bucket = b
    GROUP BY 1 ORDER BY swept_on NULLS FIRST, bucket LIMIT 1""")
def oldest_bucket(m: Market):
    """Every bucket was swept, on different days; the one swept longest ago is next."""
    bucket = (F.col("user_id") % 24).cast("int")
    pool = m.table("events").select(bucket.alias("bucket"), F.date_sub(F.to_date("ts"), bucket * 7 % 11).alias("swept_on"))
    return selecting.next_bucket(m.spark, pool)


@query("seeded_sample", "items", """
    SELECT item_id FROM items ORDER BY md5(concat('20260804:', item_id)), item_id LIMIT 500""")
def seeded_sample(m: Market):
    return selecting.seeded_sample(m.items("item_id"), "item_id", 500, 20260804)


# --- enrolment ----------------------------------------------------------------------------------

HIT = ("item_id", "brand", "category", "price_ore", "p2p", "first_offered")


def hits(m: Market):
    return m.items(*HIT, only=LIVE)


# Live listings that make a product line a big one.
FLOOR = 18


def lines(m: Market):
    """Live listings with the product as the brand: some products are big, many are a tail, at any size of the tables."""
    rows = m.items(*HIT, "product_id", only=LIVE)
    return rows.withColumn("brand", F.concat(F.lit("P"), F.col("product_id").cast("string"))).drop("product_id")


HITS = f"hits AS (SELECT *, {BAND} AS price_band FROM items WHERE outcome IS NULL)"
LINES = f"""hits AS (SELECT * REPLACE (concat('P', cast(product_id AS varchar)) AS brand), {BAND} AS price_band FROM items WHERE outcome IS NULL),
    big AS (SELECT brand FROM hits GROUP BY 1 HAVING count(*) >= {FLOOR})"""


@query("stratum_a", "items", f"""WITH {LINES},
    p AS (SELECT *, count(*) OVER (PARTITION BY brand, price_band) AS population,
      row_number() OVER (PARTITION BY brand, price_band ORDER BY md5(concat('A:', item_id)), item_id) AS k FROM hits WHERE brand IN (FROM big))
    SELECT item_id, brand, price_band, {r6("population / least(population, 5)")} AS sample_weight, 'A' AS stratum FROM p WHERE k <= 5""")
def stratum_a(m: Market):
    taken = sampling.stratum_a(lines(m), FLOOR, 25, BAND_EDGES)
    return rounded(taken.select("item_id", "brand", "price_band", "sample_weight", "stratum"))


TAIL = [9000, 20000, 40000, 60000, 80000, 95000]
CELL = f"CASE WHEN price_ore < {TAIL[0] * 100} THEN -1 " + " ".join(
    f"WHEN price_ore < {e * 100} THEN {i}" for i, e in enumerate(TAIL[1:])
) + f" ELSE {len(TAIL) - 1} END"


TAIL_SQL = f"""{LINES},
    c AS (SELECT *, {CELL} AS cell FROM hits WHERE brand NOT IN (FROM big)),
    p AS (SELECT *, count(*) OVER (PARTITION BY cell, category) AS population, greatest(1, cast(floor(
        count(*) OVER (PARTITION BY cell, category) * 2000 / (SELECT count(*) FROM c)) AS bigint)) AS quota,
      row_number() OVER (PARTITION BY cell, category ORDER BY md5(concat('B:', item_id)), item_id) AS k FROM c)"""


def tail_sample(m: Market):
    rows = lines(m)
    return sampling.stratum_b(rows, sampling.big_brands(rows, FLOOR), 2000, TAIL)


@query("stratum_b", "items", f"""WITH {TAIL_SQL}
    SELECT item_id, brand, category, {r6("population / least(population, quota)")} AS sample_weight, 'B' AS stratum FROM p WHERE k <= quota""")
def stratum_b(m: Market):
    return rounded(tail_sample(m).select("item_id", "brand", "category", "sample_weight", "stratum"))


@query("stratum_b_weights", "items", f"""WITH {TAIL_SQL} SELECT category, {r6("count(*)::double")} AS weight FROM c GROUP BY 1""")
def stratum_b_weights(m: Market):
    """The weights of the sample sum to the tail population, category by category."""
    return rounded(tail_sample(m).groupBy("category").agg(F.sum("sample_weight").alias("weight")))


@query("stratum_n", "items", f"""WITH {HITS},
    new AS (SELECT * FROM hits WHERE first_offered >= {DAY} - 30 AND first_offered <= {DAY}),
    capped AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY brand ORDER BY md5(concat('N:', item_id)), item_id) <= 10),
    kept AS (SELECT * FROM capped WHERE item_id NOT IN (SELECT item_id FROM items WHERE p2p)
      ORDER BY md5(concat('N:', item_id)), item_id LIMIT 150)
    SELECT item_id, brand, {r6("(SELECT count(*) FROM new) / (SELECT count(*) FROM kept)")} AS sample_weight, 'N' AS stratum FROM kept""")
def stratum_n(m: Market):
    held = m.items("item_id", "p2p").where("p2p")
    taken = sampling.stratum_n(hits(m), held, F.lit(AS_OF).cast("date"), 30, 10, 150)
    return rounded(taken.select("item_id", "brand", "sample_weight", "stratum"))


@query("stratum_c", "items", """
    SELECT item_id, brand, 1.0::double AS sample_weight, 'C' AS stratum FROM items
    WHERE outcome IS NULL AND p2p AND item_id NOT IN (SELECT item_id FROM items WHERE has_defect)""")
def stratum_c(m: Market):
    held = m.items("item_id", "has_defect").where("has_defect")
    return sampling.stratum_c(hits(m), held).select("item_id", "brand", "sample_weight", "stratum")


@query("sample_weights", "items", f"""WITH {HITS},
    pop AS (SELECT brand, price_band, count(*) AS population FROM hits GROUP BY 1, 2),
    held AS (SELECT brand, price_band, count(*) AS sampled FROM hits WHERE NOT has_defect GROUP BY 1, 2)
    SELECT brand, price_band, population, sampled, {r6("population / sampled")} AS sample_weight FROM pop JOIN held USING (brand, price_band)""")
def sample_weights(m: Market):
    rows = m.items("brand", "price_ore", "has_defect", only=LIVE)
    held = rows.where(~F.col("has_defect")).withColumn("price_band", s.price_band(F.col("price_ore"), BAND_EDGES))
    return rounded(sampling.sample_weights(held, sampling.brand_band_population(rows, BAND_EDGES)))


@query("census_shortfall", "items", """
    SELECT count(*) FILTER (NOT has_defect) AS held, count(*) AS population,
      count(*) - count(*) FILTER (NOT has_defect) AS shortfall, count(*) > count(*) FILTER (NOT has_defect) AS warning
    FROM items WHERE outcome IS NULL AND p2p""")
def census_shortfall(m: Market):
    rows = m.items("p2p", "has_defect", only=LIVE)
    return sampling.census_shortfall(rows.where(~F.col("has_defect")), rows)


@query("cell_census", "items", f"""
    WITH v AS (SELECT split_part(p_name, ' ', 2) AS category FROM part UNION SELECT 'unknown'),
    c AS (SELECT cast(a AS int) AS cell, category FROM range({len(TAIL)}) r(a), v),
    n AS (SELECT {CELL} AS cell, category, count(*) AS n FROM items WHERE outcome IS NULL GROUP BY 1, 2)
    SELECT cell, category, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (cell, category)""")
def cell_census(m: Market):
    named = m.table("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("category"))
    every = named.union(m.spark.sql("SELECT 'unknown'")).distinct()
    # The query asks for the cells from the first edge up; the operator also has cell -1 under it.
    return sampling.cell_census(m.items("category", "price_ore", only=LIVE), every, TAIL).where("cell >= 0")


# --- dictionaries and documents -----------------------------------------------------------------


def known_lookup(m: Market):
    """The conditions, already numbered by their leading digit."""
    value = m.table("orders").select(F.col("o_orderpriority").alias("value")).distinct()
    return value.select(F.lit("condition").alias("kind"), "value", F.substring("value", 1, 1).cast("long").alias("id"))


LOOKUP = """
pairs AS (SELECT DISTINCT 'category' AS kind, category AS value FROM items UNION SELECT DISTINCT 'item_type', item_type FROM items
  UNION SELECT DISTINCT 'size', size_code FROM items UNION SELECT DISTINCT 'demography', demography FROM items
  UNION SELECT DISTINCT 'condition', condition FROM items),
lookup AS (SELECT kind, value, CASE WHEN kind = 'condition' THEN cast(left(value, 1) AS bigint)
    ELSE 5 + row_number() OVER (PARTITION BY kind = 'condition' ORDER BY encode(kind), encode(value)) END AS id FROM pairs)
"""


def lookup(m: Market, flat):
    return masks.ensure_lookup(documents.lookup_values(flat), known_lookup(m))


@query("lookup_dictionary", "items", f"WITH {LOOKUP} SELECT * FROM lookup")
def lookup_dictionary(m: Market):
    return lookup(m, documents.flat_listings(listing_documents(m)))


MASKS = """
bits AS (SELECT value, least(row_number() OVER (ORDER BY value) - 1, 5) AS bit FROM (SELECT DISTINCT colour AS value FROM items))
"""


def meanings(m: Market, flat, kinds=(("colour", 6), ("material", 62), ("season", 15))):
    """A table of bits per kind, each starting from no known value."""
    empty = m.spark.createDataFrame([], "kind string, bit int, value string")
    tables = [masks.assign_bits(documents.mask_values(flat, f"{kind}s"), empty, kind, width) for kind, width in kinds]
    return cut_lineage(reduce(lambda a, b: a.unionByName(b), tables))


@query("mask_bits", "items", f"WITH {MASKS} SELECT 'colour' AS kind, cast(bit AS int) AS bit, value FROM bits")
def mask_bits(m: Market):
    """Eight colours in six bits: the last three share the top one."""
    return meanings(m, documents.flat_listings(listing_documents(m)), (("colour", 6),))


@query("mask_round_trip", "items", f"""WITH {MASKS}
    SELECT item_id, 1::bigint << cast(b.bit AS bigint) AS colour_mask, b.bit = 5 AS other,
      (SELECT list(value ORDER BY value) FROM bits x WHERE x.bit = b.bit) AS decoded FROM items JOIN bits b ON colour = b.value""")
def mask_round_trip(m: Market):
    flat = documents.flat_listings(listing_documents(m))
    table = meanings(m, flat, (("colour", 6),))
    rows = flat.select("item_id", "colours")
    encoded = masks.encode_mask(rows, "colours", table, "colour", "colour_mask").drop("colours")
    decoded = masks.decode_mask(encoded, "colour_mask", table, "colour", "decoded")
    return decoded.withColumn("other", masks.has_bit(F.col("colour_mask"), 5))


def listing_documents(m: Market):
    """The listings as nested JSON documents, written as lines and read with their fixed schema."""
    with staging(m.spark):  # a table, so that the shuffles of its joins go before the documents are written
        rows = cut_lineage(m.items("item_id", "brand", "item_type", "size_code", "condition", "demography", "colour", "category", "season",
                                   "weight_g", "price_ore", "first_price_ore", "favourites", "first_offered", "is_reserved", "last_chance", "p2p", "has_defect"))
        return landed(listing_lines(rows), schemas.LISTING)


def listing_lines(rows):
    """Listings as nested JSON documents."""
    millis = F.unix_millis(F.col("first_offered").cast("timestamp"))
    return rows.select(F.to_json(
        F.struct(
            F.col("item_id").alias("objectID"),
            F.struct(
                "brand",
                F.col("item_type").alias("type"),
                F.col("size_code").alias("size"),
                "condition",
                "demography",
                F.array("category").alias("material"),
                F.array("colour").alias("color"),
                F.split("season", ",").alias("season"),
                F.when(F.col("has_defect"), F.array(F.lit("Fläck"))).alias("defects"),
            ).alias("metadata"),
            F.struct(F.array("category").alias("lvl2")).alias("categories"),
            F.struct(F.col("price_ore").alias("amount")).alias("price_SE"),
            F.struct(F.struct(F.col("first_price_ore").alias("amount")).alias("oldPrice")).alias("priceDrop_SE"),
            (F.col("weight_g") / 1000).alias("weight"),
            F.col("favourites").alias("favouriteCount"),
            F.when(F.col("is_reserved"), millis).otherwise(F.floor(millis / 1000)).alias("firstOfferedAt_SE"),
            F.col("is_reserved").alias("isReserved"),
            F.col("last_chance").alias("lastChance"),
            "p2p",
            F.array("size_code").alias("sizes"),
            F.array(F.concat(F.lit("https://img.example.net/"), "item_id", F.lit(".jpg"))).alias("images"),
        )
    ))


def landed(lines, schema):
    """Lines written to the shared folder as a source would land them, read back."""
    path = f"{shared_dir(lines.sparkSession)}/landed-{uuid.uuid4().hex}"
    write_lines(lines, path)
    return read_jsonl(lines.sparkSession, f"{path}/*", schema, newest_only=False)


@query("listing_documents", "items", """
    SELECT item_id, brand, category, item_type, size_code AS size, condition, demography, weight_g, has_defect, price_ore,
      first_price_ore AS old_price_ore, cast(favourites AS bigint) AS favourites, last_chance, is_reserved, p2p, first_offered FROM items""")
def flat_documents(m: Market):
    return documents.flat_listings(listing_documents(m)).select(
        "item_id", "brand", "category", "item_type", "size", "condition", "demography", "weight_g", "has_defect",
        "price_ore", "old_price_ore", "favourites", "last_chance", "is_reserved", "p2p", "first_offered",
    )


@query("listing_rows", "items", f"""WITH {LOOKUP}, {MASKS},
    mats AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS bit FROM (SELECT DISTINCT category AS value FROM items))
    SELECT item_id, brand, c.id AS category_id, t.id AS item_type_id, z.id AS size_id, d.id AS demography_id,
      k.id AS condition_id, 1::bigint << cast(b.bit AS bigint) AS colour_mask, 1::bigint << cast(mats.bit AS bigint) AS material_mask,
      cast(CASE season WHEN 'Sommar' THEN 1 WHEN 'Vinter' THEN 2 WHEN 'Vinter,Sommar' THEN 3 ELSE 0 END AS bigint) AS season_mask,
      price_ore, price_ore AS first_price_ore, [0, price_ore] AS history, 'P' AS stratum, {DAY} AS first_seen
    FROM items JOIN lookup c ON c.kind = 'category' AND c.value = category JOIN lookup t ON t.kind = 'item_type' AND t.value = item_type
    JOIN lookup z ON z.kind = 'size' AND z.value = size_code JOIN lookup d ON d.kind = 'demography' AND d.value = demography
    JOIN lookup k ON k.kind = 'condition' AND k.value = condition JOIN bits b ON b.value = colour JOIN mats ON mats.value = category""")
def listing_rows(m: Market):
    with staging(m.spark):
        docs = cut_lineage(listing_documents(m), lasting=True)
    flat = documents.flat_listings(docs)
    # The dictionary is a table, so that its size is known: without that, seven joins in a row shuffled all listings.
    rows = documents.listing_rows(
        docs, cut_lineage(lookup(m, flat)), meanings(m, flat), "P", F.lit(1.0), F.lit(AS_OF).cast("date")
    )
    return rows.select(
        "item_id", "brand", "category_id", "item_type_id", "size_id", "demography_id", "condition_id", "colour_mask",
        "material_mask", "season_mask", "price_ore", "first_price_ore", "history", "stratum", "first_seen",
    )


@query("staging_rows", "items", """
    SELECT item_id, brand, price_ore, p2p, [concat(item_id, '.jpg')] AS image_paths, bucket FROM items
    JOIN (SELECT brand, cast(""" + crc32_sql("brand") + """ % 24 AS int) AS bucket FROM (SELECT DISTINCT brand FROM items)) USING (brand)""")
def staging_rows(m: Market):
    """The staging projection with the rotation bucket."""
    staged = documents.staging_rows(documents.flat_listings(listing_documents(m)), ["https://img.example.net/"])
    return staged.select("item_id", "brand", "price_ore", "p2p", "image_paths", "bucket")


@query("cohort_documents", "items", f"""
    SELECT item_id, brand, item_type, coalesce(category, colour) AS category, {r6("price_ore / 100")} AS price_kr, price_to_estimate,
      cast(favourites AS bigint) AS favourites, brand_tier, has_defect, p2p, outcome IS NULL AS on_shelf, is_reserved FROM items""")
def cohort_documents(m: Market):
    """Search documents as cohort rows."""
    rows = m.items("item_id", "brand", "item_type", "category", "colour", "price_ore", "price_to_estimate", "favourites",
                   "brand_tier", "has_defect", "p2p", "outcome", "is_reserved")
    text = F.to_json(
        F.struct(
            F.col("item_id").alias("id"),
            F.struct("brand").alias("sharedMetadata"),
            F.struct(
                F.col("item_type").alias("type"), F.when(F.col("has_defect"), F.array(F.lit("Fläck"))).alias("defects")
            ).alias("translatedMetadata_sv"),
            F.struct(F.array("colour").alias("lvl0"), F.array("category").alias("lvl3")).alias("categories_sv"),
            F.struct(F.col("brand_tier").alias("pricePoint")).alias("brandClassification"),
            F.struct(F.col("price_ore").alias("amount")).alias("price_SE"),
            F.col("price_to_estimate").alias("priceToEstimateRatio"),
            F.col("favourites").alias("favouriteCount"),
            "p2p",
            F.col("outcome").isNull().alias("isOnShelf"),
            F.col("is_reserved").alias("isReserved"),
        )
    )
    docs = landed(rows.select(text), schemas.SEARCH_DOCUMENT)
    return rounded(
        documents.cohort_rows(docs, []).select(
            "item_id", "brand", "item_type", "category", "price_kr", "price_to_estimate", "favourites", "brand_tier",
            "has_defect", "p2p", "on_shelf", "is_reserved",
        )
    )


@query("loaded_ladders", "ladders", f"""
    SELECT item_id, brand, item_type, condition, status, sold, {r6("opening_ask_ore / 100")} AS opening_ask,
      {r6("final_price_ore / 100")} AS final_price, rungs, decay + 0.0 AS decay, listed_on, ended_on, days_on_market FROM ladders""")
def loaded_ladders(m: Market):
    """Ladder files of two days landed and loaded; the newer one counts."""
    folder = f"{shared_dir(m.spark)}/collected-{uuid.uuid4().hex}"
    rows = m.ladders("item_id", "brand", "item_type", "condition", "status", "sold", "opening_ask_ore", "final_price_ore",
                     "rungs", "decay", "listed_on", "ended_on", "days_on_market")
    lines = rows.select(
        F.to_json(
            F.struct(
                "item_id", "brand", F.col("item_type").alias("type"), "condition", "status", "sold",
                s.to_kr(F.col("opening_ask_ore")).alias("opening_ask"), s.to_kr(F.col("final_price_ore")).alias("final_price"),
                "rungs", "decay", "listed_on", "ended_on", "days_on_market",
            )
        )
    )
    write_lines(lines, f"{folder}/ladders_20260802.jsonl")
    write_lines(lines.where(F.lit(False)), f"{folder}/ladders_20260801.jsonl")
    loaded = load_local(m.spark, folder, {})["item_ladders"]
    return rounded(
        loaded.select("item_id", "brand", "item_type", "condition", "status", "sold", "opening_ask", "final_price", "rungs",
                      "decay", "listed_on", "ended_on", "days_on_market")
    )

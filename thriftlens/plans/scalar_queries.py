"""Queries on scalar expressions: money, bands, outcomes, sizes, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.functions import sql_udfs
from thriftlens.plans.binding import AS_OF, BAND_EDGES, Market, crc32_sql, r6
from thriftlens.plans.registry import query, rounded

BAND = "CASE WHEN price_ore < 2000000 THEN 0 WHEN price_ore < 4000000 THEN 1 WHEN price_ore < 6000000 THEN 2 WHEN price_ore < 8000000 THEN 3 ELSE 4 END"


@query("money_units", None, f"""
    SELECT l_orderkey, l_linenumber, l_extendedprice AS kr,
      cast(round_even(l_extendedprice * 100, 0) AS bigint) AS ore,
      cast(trunc(l_extendedprice * 100) AS bigint) AS ore_trunc,
      {r6("cast(round_even(l_extendedprice * 100, 0) AS bigint) / 100")} AS kr_back,
      cast(floor(cast(round_even(l_extendedprice * 100, 0) AS bigint) / 100) AS bigint) AS kr_floor
    FROM lineitem""")
def money_units(m: Market):
    kr = F.col("l_extendedprice")
    ore = s.to_ore(kr)
    return rounded(
        m.table("lineitem").select(
            "l_orderkey",
            "l_linenumber",
            kr.alias("kr"),
            ore.alias("ore"),
            s.to_ore_trunc(kr).alias("ore_trunc"),
            s.to_kr(ore).alias("kr_back"),
            s.to_kr_floor(ore).alias("kr_floor"),
        )
    )


@query("source_dates", None, """
    SELECT event_id, cast(ts AS date) AS from_millis, cast(ts AS date) AS from_seconds,
      cast(ts AS date) AS from_iso, cast(ts AS date) AS from_object,
      cast(date_diff('day', cast(ts AS date), DATE '2024-02-01') AS int) AS gap FROM events""")
def source_dates(m: Market):
    """The event time as the epochs and texts a source may give it in."""
    ts = F.col("ts").cast("timestamp")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    day = s.iso_day(text)
    return m.table("events").select(
        "event_id",
        s.epoch_date(F.unix_millis(ts)).alias("from_millis"),
        s.epoch_date(F.unix_seconds(ts)).alias("from_seconds"),
        day.alias("from_iso"),
        s.iso_day(F.to_json(F.struct(text.alias("iso")))).alias("from_object"),
        s.day_gap(day, F.lit("2024-02-01").cast("date")).alias("gap"),
    )


@query("price_bands", "items", f"""
    SELECT item_id, {BAND} AS price_band,
      CASE WHEN price_ore < 20000 THEN 0 WHEN price_ore < 30000 THEN 1 WHEN price_ore < 50000 THEN 2
        WHEN price_ore < 100000 THEN 3 ELSE 4 END AS standard_band,
      CASE WHEN price_ore / 100 < 40000 THEN 'low (<40000)' WHEN price_ore / 100 < 80000
        THEN 'mid (40000-79999)' ELSE 'high (>=80000)' END AS ask_band,
      CASE WHEN favourites < 1 THEN '0' WHEN favourites < 3 THEN '1-2' WHEN favourites < 6 THEN '3-5'
        WHEN favourites < 11 THEN '6-10' WHEN favourites < 21 THEN '11-20' ELSE '21+' END AS favourites,
      CASE WHEN weight_g < 151 THEN '0-150' WHEN weight_g < 301 THEN '151-300' WHEN weight_g < 501
        THEN '301-500' WHEN weight_g < 800 THEN '501-799' ELSE '800+' END AS weight,
      CASE WHEN first_offered > DATE '{AS_OF}' THEN NULL
        WHEN date_diff('day', first_offered, DATE '{AS_OF}') < 15 THEN '0-14'
        WHEN date_diff('day', first_offered, DATE '{AS_OF}') < 31 THEN '15-30'
        WHEN date_diff('day', first_offered, DATE '{AS_OF}') < 61 THEN '31-60'
        WHEN date_diff('day', first_offered, DATE '{AS_OF}') < 121 THEN '61-120' ELSE '121+' END AS age
    FROM items""")
def price_bands(m: Market):
    rows = m.items("item_id", "price_ore", "favourites", "weight_g", "first_offered")
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("first_offered"))
    return rows.select(
        "item_id",
        s.price_band(F.col("price_ore"), BAND_EDGES).alias("price_band"),
        s.price_band(F.col("price_ore")).alias("standard_band"),
        s.ask_band(s.to_kr(F.col("price_ore")), 40000, 80000).alias("ask_band"),
        s.favourites_bucket(F.col("favourites")).alias("favourites"),
        s.weight_bucket(F.col("weight_g")).alias("weight"),
        s.age_bucket(age).alias("age"),
    )


@query("item_outcomes", "items", """
    SELECT item_id, status, CASE status WHEN 'utlagd' THEN 'still_listed' WHEN 'såld' THEN 'sold'
      WHEN 'betald' THEN 'sold' WHEN 'vilande' THEN 'expired' WHEN 'skänkt' THEN 'expired' END AS outcome,
      outcome AS code FROM items""")
def item_outcomes(m: Market):
    outcome = s.outcome_of(F.col("status"))
    rows = m.items("item_id", "status")
    return rows.select("item_id", "status", outcome.alias("outcome"), s.outcome_code(outcome).alias("code"))


@query("size_columns", "items", """
    WITH parts AS (SELECT *, split_part(size_code, '-', 1) AS g,
      nullif(split_part(size_code, '-', 2), '') AS y, nullif(split_part(size_code, '-', 3), '') AS v FROM items),
    areas AS (SELECT *, CASE g WHEN 'SHOES' THEN 'feet' WHEN 'CHILD' THEN 'child' WHEN 'ONE SIZE'
      THEN 'unsized' ELSE 'other' END AS a FROM parts)
    SELECT item_id, size_code, g AS size_group, y AS size_system, v AS size_value, a AS size_area,
      concat(a, '|', coalesce(y, ''), '|', coalesce(v, '')) AS size_key FROM areas""")
def size_columns(m: Market):
    code, category = F.col("size_code"), F.col("category")
    group, system, value = s.size_parts(code)
    return m.items("item_id", "size_code", "category").select(
        "item_id",
        "size_code",
        group.alias("size_group"),
        system.alias("size_system"),
        value.alias("size_value"),
        s.size_area(code, category).alias("size_area"),
        s.size_key(code, category).alias("size_key"),
    )


@query("trade_scores", "items", f"""
    WITH p AS (SELECT *, price_ore / 100 AS kr,
      CASE WHEN price_to_estimate > 0 THEN 0.84 * least((price_ore / 100) / price_to_estimate, price_ore / 100 * 5)
        - price_ore / 100 END AS profit FROM items)
    SELECT item_id, {r6("profit")} AS expected_profit, price_to_estimate <= 0.2 AS cap_binds,
      {r6("1 / price_to_estimate")} AS worth_x,
      {r6("greatest(profit, 0) * (1 + favourites / 50) * CASE WHEN has_defect THEN 0.85 ELSE 1 END")} AS score,
      round_even(1 - price_ore / nullif(first_price_ore, 0), 3) + 0.0 AS decay,
      round_even((1 - price_ore / nullif(first_price_ore, 0)) * 100, 2) + 0.0 AS markdown_pct,
      favourites - first_favourites AS momentum,
      {r6("1 / (0.84 * (1 / price_to_estimate))")} AS break_even,
      {r6("1.4 / (0.84 * (1 / price_to_estimate))")} AS break_even_40,
      season_mask > 0 AND (season_mask & 2) = 0 AS out_of_season,
      list_has_any([colour], ['red', 'blue']) AS premium
    FROM p""")
def trade_scores(m: Market):
    rows = m.items("item_id", "price_ore", "first_price_ore", "price_to_estimate", "favourites", "first_favourites", "has_defect", "season_mask", "colour")
    price, ratio = s.to_kr(F.col("price_ore")), F.col("price_to_estimate")
    profit, worth = s.expected_profit(price, ratio), s.worth_x(ratio)
    first, last = F.col("first_price_ore"), F.col("price_ore")
    return rounded(
        rows.select(
            "item_id",
            profit.alias("expected_profit"),
            s.cap_binds(ratio).alias("cap_binds"),
            worth.alias("worth_x"),
            s.candidate_score(profit, 1 + F.col("favourites") / 50, F.col("has_defect")).alias("score"),
            s.decay(first, last).alias("decay"),
            s.markdown_pct(first, last).alias("markdown_pct"),
            s.momentum(F.col("favourites"), F.col("first_favourites")).alias("momentum"),
            s.break_even(worth).alias("break_even"),
            s.break_even(worth, gain=0.4).alias("break_even_40"),
            s.out_of_season(F.col("season_mask"), F.lit(AS_OF).cast("date")).alias("out_of_season"),
            s.premium_fibre(F.array("colour"), ["red", "blue"]).alias("premium"),
        )
    )


@query("image_paths", None, """
    SELECT page_id, [regexp_replace(url, '^https://[a-z]*\\.example\\.(com|org|net)/', '')] AS paths
    FROM pages WHERE url LIKE 'https://%' AND regexp_matches(url, '^https://[a-z]+\\.example\\.(com|org|net)/')
      AND split_part(split_part(url, '/', 3), '.', 1) IN ('m')
    UNION ALL SELECT page_id, [url] FROM pages
    WHERE NOT (url LIKE 'https://m.example.com/%' OR url LIKE 'https://m.example.org/%' OR url LIKE 'https://m.example.net/%')""")
def image_paths(m: Market):
    hosts = [f"https://m.example.{end}/" for end in ("com", "org", "net")]
    return m.table("pages").select("page_id", s.image_paths(F.array("url"), hosts).alias("paths"))


@query("rotation_buckets", "items", f"""
    WITH b AS (SELECT brand, count(*) AS n FROM items GROUP BY 1)
    SELECT cast({crc32_sql("brand")} % 24 AS int) AS bucket, cast(sum(n) AS bigint) AS listings, count(*) AS brands FROM b GROUP BY 1""")
def rotation_buckets(m: Market):
    """Listings and brands per rotation bucket."""
    rows = m.items("brand", "item_id").withColumn("bucket", s.bucket_of(F.col("brand")))
    per_brand = rows.groupBy("bucket", "brand").agg(F.count(F.lit(1)).alias("n"))
    return per_brand.groupBy("bucket").agg(F.sum("n").alias("listings"), F.count(F.lit(1)).alias("brands"))


@query("sql_functions", "items", f"""
    SELECT item_id, CASE WHEN price_ore < 20000 THEN 0 WHEN price_ore < 30000 THEN 1 WHEN price_ore < 50000
        THEN 2 WHEN price_ore < 100000 THEN 3 ELSE 4 END AS band,
      CASE WHEN outcome IS NULL THEN 'still_listed' WHEN outcome = 1 THEN 'sold' ELSE 'expired' END AS outcome,
      {r6("0.84 * least((price_ore / 100) / price_to_estimate, price_ore / 100 * 5) - price_ore / 100")} AS profit,
      CASE split_part(size_code, '-', 1) WHEN 'SHOES' THEN 'feet' WHEN 'CHILD' THEN 'child'
        WHEN 'ONE SIZE' THEN 'unsized' ELSE 'other' END AS area
    FROM items""")
def sql_functions(m: Market):
    """The scalar surface as SQL functions."""
    sql_udfs.register(m.spark)
    return rounded(
        m.items("item_id", "price_ore", "status", "price_to_estimate", "size_code", "category").selectExpr(
            "item_id",
            "price_band(price_ore) AS band",
            "outcome_of(status) AS outcome",
            "expected_profit(price_ore / 100, price_to_estimate) AS profit",
            "size_area(size_code, category) AS area",
        )
    )

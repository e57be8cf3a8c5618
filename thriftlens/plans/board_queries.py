"""Queries on the predictor boards, brands and slices."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.functions.sql_tables import register_tables
from thriftlens.operators import board, brands, filters, slices
from thriftlens.operators.peers import peer_cascade, unfrozen
from thriftlens.plans import jobs
from thriftlens.plans.binding import AS_OF, BAND_EDGES, Market, r6
from thriftlens.plans.peer_queries import MIN_GROUP, PLACED, SHELF
from thriftlens.plans.registry import query, rounded
from thriftlens.plans.scalar_queries import BAND
from thriftlens.session import cut_lineage, shared_dir, staging
from thriftlens.sources.tables import write_snapshot

DAY = f"DATE '{AS_OF}'"
AGE = f"date_diff('day', first_offered, {DAY})"
FAV_RATE = f"favourites / (greatest({AGE}, 1) / 30)"


def _cut(expr: str, edges: list, labels: list) -> str:
    arms = " ".join(f"WHEN {expr} < {e} THEN '{label}'" for e, label in zip(edges[1:], labels))
    return f"CASE WHEN {expr} < {edges[0]} THEN NULL {arms} ELSE '{labels[-1]}' END"


FEATURES = {
    "favourites": _cut("favourites", [0, 1, 3, 6, 11, 21], ["0", "1-2", "3-5", "6-10", "11-20", "21+"]),
    "favs_per_month": _cut(FAV_RATE, [0, 1, 3, 6, 12], ["0-1", "1-3", "3-6", "6-12", "12+"]),
    "age_days": _cut(AGE, [0, 15, 31, 61, 121], ["0-14", "15-30", "31-60", "61-120", "121+"]),
    "weight_g": _cut("weight_g", [0, 151, 301, 501, 800], ["0-150", "151-300", "301-500", "501-799", "800+"]),
    "price_band": f"cast({BAND} AS varchar)",
    "brand": "brand",
    "brand_tier": "cast(brand_tier AS varchar)",
    "brand_origin": "brand_origin",
    "brand_ethos": "brand_ethos",
    "item_type": "item_type",
    "category": "category",
    "size": "size_code",
    "condition": "condition",
    "season": "season",
    "is_reserved": "cast(is_reserved AS varchar)",
    "last_chance": "cast(last_chance AS varchar)",
    "p2p": "CASE WHEN p2p THEN 'resale' ELSE 'consignment' END",
    "has_defect": "cast(has_defect AS varchar)",
}
BOARD_COLUMNS = (
    "favourites", "first_offered", "weight_g", "price_ore", "brand", "brand_tier", "brand_origin", "brand_ethos", "item_type",
    "category", "size_code", "condition", "season", "is_reserved", "last_chance", "p2p",
    "has_defect", "outcome", "stratum",
)


def _board_sql(target: str, features: dict = FEATURES, source: str = "items", lead: str = "") -> str:
    used = {f: e for f, e in features.items() if target == "sale" or f not in board.NOT_FOR_PRICE}
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {e} AS bucket, outcome, price_ore FROM a" for f, e in used.items()
    )
    value = "count(*) FILTER (outcome = 1)" if target == "sale" else "sum(price_ore)"
    square = "0" if target == "sale" else "sum(price_ore::hugeint * price_ore)::double"
    if target == "sale":
        # Chi square from the expected counts of both columns of the table.
        strength = (
            "CASE WHEN count(*) > 1 THEN coalesce(sqrt((sum((y - n * p) ** 2 / nullif(n * p, 0)) + "
            "sum((n - y - n * (1 - p)) ** 2 / nullif(n * (1 - p), 0))) / sum(n)), 0) ELSE 0 END"
        )
    else:
        strength = (
            "coalesce((sum(n * (rate - p) ** 2)) / nullif(sum(yy) - sum(y) * (sum(y) / sum(n)), 0), 0)"
        )
    return f"""WITH {lead} a AS (SELECT * FROM {source} WHERE stratum IN ('A', 'B', 'N')),
    long AS ({long}),
    cells AS (SELECT feature, bucket, count(*) AS n, {value} AS y, {square} AS yy, {value} / count(*) AS rate
      FROM long WHERE bucket IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 200),
    c AS (SELECT *, (sum(y) OVER (PARTITION BY feature)) / (sum(n) OVER (PARTITION BY feature)) AS p FROM cells)
    SELECT {DAY} AS as_of, '{target}' AS target, feature, count(*) AS buckets, cast(sum(n) AS bigint) AS n,
      {r6("quantile_cont(rate, 0.9) / nullif(quantile_cont(rate, 0.1), 0)")} AS lift, {r6(strength)} AS strength,
      last(bucket ORDER BY rate, bucket) AS best_bucket, {r6("max(rate)")} AS best_rate,
      first(bucket ORDER BY rate, bucket) AS worst_bucket, {r6("min(rate)")} AS worst_rate
    FROM c GROUP BY feature"""


def _board(m: Market, target: str):
    rows = filters.analysis_rows(m.items(*BOARD_COLUMNS))
    day = F.lit(AS_OF).cast("date")
    return rounded(board.predictor_board(rows, board.listing_features(day, BAND_EDGES), day, target))


@query("predictor_board_sale", "items", _board_sql("sale"))
def predictor_board_sale(m: Market):
    return _board(m, "sale")


@query("predictor_board_price", "items", _board_sql("price"))
def predictor_board_price(m: Market):
    return _board(m, "price")


# --- brands -------------------------------------------------------------------------------------

AGE_BUCKET = _cut(f"greatest({AGE}, 0)", [0, 15, 31, 61, 121], ["0-14", "15-30", "31-60", "61-120", "121+"])
ATTENTION = f"""
base AS (SELECT *, {BAND} AS band, {AGE_BUCKET} AS age FROM shelf),
cell AS (SELECT item_type, band, age, count(*) AS cn, sum(favourites) AS cl FROM base GROUP BY ALL),
wide AS (SELECT band, age, count(*) AS wn, sum(favourites) AS wl FROM base GROUP BY ALL),
att AS (SELECT brand, count(*) AS listings, sum(favourites) AS likes,
    sum(CASE WHEN cn >= 300 THEN cl / cn ELSE wl / wn END) AS expected
  FROM base JOIN cell USING (item_type, band, age) JOIN wide USING (band, age) GROUP BY brand)
"""


@query("attention_index", "shelf", f"""WITH {ATTENTION}
    SELECT brand, listings, {r6("likes / listings")} AS avg_favourites,
      {r6("expected / listings")} AS expected_favourites, {r6("likes / expected")} AS attention_index FROM att""")
def attention_index(m: Market):
    live = m.shelf("brand", "item_type", "price_ore", "favourites", "first_offered")
    return rounded(brands.attention_index(live, F.lit(AS_OF).cast("date"), 300, BAND_EDGES))


@query("brand_inflow", "shelf", f"""
    SELECT brand, count(*) AS listings,
      count(*) FILTER (first_offered >= {DAY} - 7 AND first_offered < {DAY}) AS inflow,
      {r6(f"count(*) FILTER (first_offered >= {DAY} - 7 AND first_offered < {DAY}) / count(*)")} AS inflow_share
    FROM shelf GROUP BY 1""")
def brand_inflow(m: Market):
    return rounded(brands.inflow(m.shelf("brand", "first_offered"), F.lit(AS_OF).cast("date")))


def _just_sold(days: int) -> str:
    return f"(outcome = 1 AND resolved_on > {DAY} - {days} AND resolved_on <= {DAY})"


SNAPSHOT_SQL = f"""
    WITH a AS (SELECT * FROM items WHERE stratum IN ('A', 'B', 'N')),
    g AS (SELECT brand, count(*) FILTER (outcome IS NULL) AS listings,
      avg(favourites) FILTER (outcome IS NULL) AS af, count(*) FILTER {_just_sold(7).replace("(outcome", "(WHERE outcome")} AS sold,
      median(price_ore) FILTER (outcome IS NULL) AS ask FROM a GROUP BY 1)
    SELECT brand, listings, {r6("af")} AS avg_favourites, sold, {r6("ask")} AS med_ask_ore,
      {r6("sold / (listings + sold) / 7 * 100")} AS sold_pct_day, {DAY} AS as_of FROM g WHERE listings >= 25"""


@query("brand_snapshot", "items", SNAPSHOT_SQL)
def brand_snapshot(m: Market):
    rows = filters.analysis_rows(m.items("brand", "outcome", "resolved_on", "favourites", "price_ore", "stratum"))
    day = F.lit(AS_OF).cast("date")
    return rounded(brands.brand_snapshot(rows, day, since=F.date_sub(day, 7)))


@query("brand_snapshot_merged", "items", SNAPSHOT_SQL)
def brand_snapshot_merged(m: Market):
    """The same from counts: those of the day before, changed by the listings that came, went or moved since. The day before, one in seven was not there
    yet, another asked its first price, and the resales that are resolved were live."""
    rows = cut_lineage(filters.analysis_rows(m.items("item_id", "brand", "outcome", "resolved_on", "favourites", "price_ore", "first_price_ore", "rungs", "p2p", "stratum")))
    before = rows.where(F.col("rungs") != 1).where(F.col("outcome").isNull() | F.col("p2p"))
    before = before.withColumn("price_ore", F.when(F.col("rungs") == 2, F.col("first_price_ore")).otherwise(F.col("price_ore")))
    stayed = ~F.col("rungs").isin(1, 2) & F.col("outcome").isNull()
    counts = cut_lineage(brands.shelf_counts(before))
    counts = brands.merged_counts(counts, before.where(~stayed), filters.live(rows).where(~stayed))
    day = F.lit(AS_OF).cast("date")
    just_sold = (F.col("outcome") == 1) & (F.col("resolved_on") > F.date_sub(day, 7)) & (F.col("resolved_on") <= day)
    sold = rows.where(just_sold).groupBy("brand").agg(F.count(F.lit(1)).alias("sold"))
    return rounded(brands.snapshot_of_counts(counts, sold, day, 7))


BRAND_DAILY_SQL = f"""
    WITH shelf AS (SELECT * FROM items WHERE outcome IS NULL AND stratum IN ('A', 'B', 'N')),
    {ATTENTION.replace("cn >= 300", "cn >= 30")},
    a AS (SELECT * FROM items WHERE stratum IN ('A', 'B', 'N')),
    g AS (SELECT brand, count(*) FILTER (outcome IS NULL) AS listings, avg(favourites) FILTER (outcome IS NULL) AS af,
      count(*) FILTER (WHERE outcome = 1 AND resolved_on = {DAY}) AS sold, median(price_ore) FILTER (outcome IS NULL) AS ask,
      count(*) FILTER (outcome IS NULL AND first_offered >= {DAY} - 7 AND first_offered < {DAY}) AS inflow FROM a GROUP BY 1)
    SELECT g.brand, g.listings, {r6("af")} AS avg_favourites, sold, {r6("ask")} AS med_ask_ore,
      {r6("sold / (g.listings + sold) * 100")} AS sold_pct_day, {DAY} AS as_of,
      {r6("expected / g.listings")} AS expected_favourites, {r6("likes / expected")} AS attention_index,
      inflow, {r6("inflow / g.listings")} AS inflow_share
    FROM g JOIN att USING (brand) WHERE g.listings >= 25"""


@query("brand_daily", "items", BRAND_DAILY_SQL)
def brand_daily(m: Market):
    rows = m.items("brand", "item_type", "outcome", "resolved_on", "first_offered", "favourites", "price_ore", "stratum")
    return rounded(jobs.brand_daily(rows, F.lit(AS_OF).cast("date"), band_edges=BAND_EDGES))


@query("brand_trend", None, f"""
    WITH d AS (SELECT event_type AS brand, cast(ts AS date) AS as_of, count(*) AS listings, avg(value) AS a FROM events GROUP BY 1, 2),
    n AS (SELECT max(as_of) AS new_on FROM d),
    b AS (SELECT max(as_of) AS base_on FROM d, n WHERE date_diff('day', as_of, new_on) >= 7)
    SELECT x.brand, new_on, base_on, cast(date_diff('day', base_on, new_on) AS int) AS days_apart, x.listings,
      x.listings - y.listings AS listings_change, {r6("x.a - y.a")} AS attention_change
    FROM d x, d y, n, b WHERE x.as_of = new_on AND y.as_of = base_on AND x.brand = y.brand AND x.listings >= 10""")
def brand_trend(m: Market):
    """Events per day and type as dated snapshots."""
    daily = m.table("events").groupBy(F.col("event_type").alias("brand"), F.to_date("ts").alias("as_of")).agg(
        F.count(F.lit(1)).alias("listings"), F.avg("value").alias("attention_index")
    )
    return rounded(brands.brand_trend(daily, 7, 10))


@query("brand_demand", "items", f"""
    WITH g AS (SELECT brand, count(favourites) AS n, sum(favourites) AS l FROM items WHERE outcome IS NULL GROUP BY 1),
    k AS (SELECT sum(l) / sum(n) AS mm FROM g)
    SELECT brand, n, {r6("(n * (l / n / mm) + 10) / (n + 10)")} AS demand_index FROM g, k""")
def brand_demand(m: Market):
    return rounded(brands.brand_demand(m.items("brand", "favourites", only="l_linestatus = 'O'")))


@query("brand_history", "ladders", f"""
    SELECT brand, count(*) AS resolved, {r6("count(*) FILTER (sold) / count(*)")} AS sell_through,
      {r6("median(days_on_market)")} AS med_days, {r6("median(final_price_ore / nullif(opening_ask_ore, 0))")} AS med_kept
    FROM ladders GROUP BY 1 HAVING count(*) >= 5""")
def brand_history(m: Market):
    rows = m.ladders("brand", "sold", "days_on_market", "final_price_ore", "opening_ask_ore")
    return rounded(brands.brand_history(rows))


@query("brand_sample", "items", """
    SELECT item_id, brand FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY md5(item_id), item_id) AS k
      FROM items WHERE outcome IS NULL AND brand_tier > 2) WHERE k <= 3""")
def brand_sample(m: Market):
    """Three live listings of every brand whose tier is not known; tiers 1 and 2 are."""
    known = m.table("part").select(F.col("p_brand").alias("brand")).distinct()
    tier = F.substring("brand", 7, 4).cast("int") % 6 + 1
    classes = known.select("brand", F.when(tier <= 2, tier).alias("price_point"))
    live = m.items("item_id", "brand", "outcome", only="l_linestatus = 'O'")
    return brands.brand_sample(live, classes).select("item_id", "brand")


@query("lagged_effect", None, f"""
    WITH o AS (SELECT user_id, cast(ts AS date) AS pass_on, arg_max(cast(round(value * 100) AS bigint), event_id) AS price,
        arg_max(event_type, event_id) AS t FROM events GROUP BY 1, 2),
    p AS (SELECT *, price < lag(price) OVER w AS cut FROM o WINDOW w AS (PARTITION BY user_id ORDER BY pass_on)),
    q AS (SELECT *, lag(cut) OVER w AS before FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pass_on))
    SELECT before AS changed_before, count(*) AS n, count(*) FILTER (t = 'purchase') AS hits,
      {r6("count(*) FILTER (t = 'purchase') / count(*)")} AS rate FROM q WHERE before IS NOT NULL GROUP BY 1""")
def lagged_effect(m: Market):
    """Whether a price cut in one pass is followed by a purchase in the next."""
    seen = m.table("events").groupBy(F.col("user_id").alias("item_id"), F.to_date("ts").alias("pass_on")).agg(
        F.max_by(F.round(F.col("value") * 100).cast("long"), "event_id").alias("price_ore"),
        F.max_by("event_type", "event_id").alias("state"),
        F.count(F.lit(1)).alias("favourites"),
    )
    cut = F.col("price_ore") < F.col("prev_price_ore")
    return rounded(brands.lagged_effect(seen, cut, F.col("state") == "purchase"))


# --- slices -------------------------------------------------------------------------------------


def _market_slice(dim: str, source: str, min_n: int) -> str:
    return f"""
    WITH x AS (SELECT {dim} AS value, * FROM {source})
    SELECT value, count(*) AS n, {r6("avg(favourites)")} AS avg_favourites,
      {r6("count(*) FILTER (has_defect) / count(*)")} AS defect_rate, {r6("median(price_ore)")} AS med_price_ore
    FROM x GROUP BY 1 HAVING count(*) >= {min_n}"""


SLICE = ("favourites", "has_defect", "price_ore")


@query("market_slice_category", "shelf", _market_slice("category", "shelf", 100))
def market_slice_category(m: Market):
    return rounded(slices.market_slice(m.shelf("category", *SLICE), "category", 100))


@query("market_slice_material", "shelf", _market_slice(
    "material", "(SELECT *, unnest(list_distinct([colour, category])) AS material FROM shelf)", 1))
def market_slice_material(m: Market):
    """An array dimension: a listing counts once per value."""
    rows = m.shelf("colour", "category", *SLICE).withColumn("material", F.array("colour", "category"))
    return rounded(slices.market_slice(rows, "material"))


def _outcome_slice(dim: str) -> str:
    return f"""
    SELECT cast({dim} AS varchar) AS value, count(*) AS n, {r6("count(*) FILTER (sold) / count(*)")} AS sell_through,
      {r6("median(days_on_market)")} AS med_days, {r6("median(final_price_ore / nullif(opening_ask_ore, 0))")} AS med_kept
    FROM ladders GROUP BY 1 HAVING count(*) >= 30"""


def _slice_outcomes(m: Market, dim: str):
    rows = m.ladders(dim, "sold", "days_on_market", "final_price_ore", "opening_ask_ore")
    return rounded(slices.outcome_slice(rows, dim))


@query("outcome_slice_brand_tier", "ladders", _outcome_slice("brand_tier"))
def outcome_slice_brand_tier(m: Market):
    return _slice_outcomes(m, "brand_tier")


@query("outcome_slice_season", "ladders", _outcome_slice("season"))
def outcome_slice_season(m: Market):
    return _slice_outcomes(m, "season")


@query("facet_document", "shelf", """
    WITH q AS (SELECT concat('[', string_agg(concat('"', v, '"'), ',' ORDER BY v), ']') AS l, 1 AS k FROM (SELECT DISTINCT brand AS v FROM shelf)
      UNION ALL SELECT concat('[', string_agg(concat('"', v, '"'), ',' ORDER BY v), ']'), 2 FROM (SELECT DISTINCT category AS v FROM shelf)
      UNION ALL SELECT concat('[', string_agg(concat('"', v, '"'), ',' ORDER BY v), ']'), 3 FROM (SELECT DISTINCT size_code AS v FROM shelf))
    SELECT concat('{"brand":', max(l) FILTER (k = 1), ',"category":', max(l) FILTER (k = 2), ',"size_code":', max(l) FILTER (k = 3), '}') AS facets FROM q""")
def facet_document(m: Market):
    return slices.facet_document(m.shelf("brand", "category", "size_code"), ["brand", "category", "size_code"])


@query("facet_values", "items", """
    SELECT 'product_id' AS facet, cast(product_id AS varchar) AS value, count(*) AS n FROM items GROUP BY 2
    UNION ALL SELECT 'size_code', size_code, count(*) FROM items GROUP BY 2""")
def facet_values(m: Market):
    """A column with a dictionary and one with a value for every product."""
    return slices.facet_values(m.items("product_id", "size_code"), ["product_id", "size_code"])


@query("table_functions", "ladders shelf", f"""
    WITH w AS (SELECT *, unnest(list_distinct([colour, category])) AS material FROM shelf),
    days AS (SELECT event_type AS brand, cast(ts AS date) AS as_of, count(*) AS listings, avg(value) AS a FROM events GROUP BY 1, 2),
    new AS (SELECT max(as_of) AS new_on FROM days), base AS (SELECT max(as_of) AS base_on FROM days, new WHERE date_diff('day', as_of, new_on) >= 7)
    SELECT 'market_slice' AS f, material AS value, count(*) AS n, {r6("median(price_ore)")} AS x, {r6("avg(favourites)")} AS y FROM w GROUP BY 2 HAVING count(*) >= 100
    UNION ALL SELECT 'outcome_slice', season, count(*), {r6("median(days_on_market)")}, {r6("count(*) FILTER (sold) / count(*)")}
      FROM ladders GROUP BY 2 HAVING count(*) >= 30
    UNION ALL SELECT 'dash_slice live', cast(brand_tier AS varchar), count(*), {r6("median(price_ore)")}, NULL FROM shelf GROUP BY 2
    UNION ALL SELECT 'dash_slice resolved', cast(brand_tier AS varchar), count(*), {r6("median(days_on_market)")}, {r6("count(*) FILTER (sold) / count(*)")} FROM ladders GROUP BY 2
    UNION ALL SELECT 'brand_trend', x.brand, x.listings, cast(x.listings - y.listings AS double), {r6("x.a - y.a")} FROM days x, days y, new, base
      WHERE x.as_of = new_on AND y.as_of = base_on AND x.brand = y.brand AND x.listings >= 10""")
def table_functions(m: Market):
    """The four parameterised functions, called from one SQL text."""
    columns = ("brand_tier", "favourites", "has_defect", "price_ore", "colour", "category")
    views = {
        "live_listings": m.shelf(*columns).withColumn("material", F.array("colour", "category")),
        "brand_days": m.table("events").groupBy(F.col("event_type").alias("brand"), F.to_date("ts").alias("as_of")).agg(
            F.count(F.lit(1)).alias("listings"), F.avg("value").alias("attention_index")
        ),
    }
    rows = m.items("brand_tier", "season", "outcome", "resolved_on", "first_offered", "first_price_ore", "final_price_ore", only="l_linestatus <> 'O'")
    views["resolved_listings"] = rows.select(
        "brand_tier", "season", (F.col("outcome") == 1).alias("sold"), s.day_gap(F.col("first_offered"), F.col("resolved_on")).alias("days_on_market"),
        "final_price_ore", F.col("first_price_ore").alias("opening_ask_ore"),
    )
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    register_tables(m.spark, "live_listings", "resolved_listings", "brand_days")
    return rounded(m.spark.sql("""
        SELECT 'market_slice' AS f, value, n, med_price_ore AS x, avg_favourites AS y FROM market_slice('material', 100)
        UNION ALL SELECT 'outcome_slice', value, n, med_days, sell_through FROM outcome_slice('season', 30)
        UNION ALL SELECT concat('dash_slice ', population), value, n, coalesce(med_price_ore, med_days), sell_through FROM dash_slice('brand_tier')
        UNION ALL SELECT 'brand_trend', brand, listings, cast(listings_change AS double), attention_change FROM brand_trend(7, 10)"""))


@query("sellability_check", "ladders", f"""
    SELECT score_version, CASE WHEN score < 0.4 THEN '0.00-0.40' WHEN score < 0.6 THEN '0.40-0.60' WHEN score < 0.8
      THEN '0.60-0.80' ELSE '0.80+' END AS score_band, count(*) AS n, {r6("count(*) FILTER (sold) / count(*)")} AS sold_rate
    FROM ladders GROUP BY 1, 2""")
def sellability_check(m: Market):
    return rounded(slices.sellability_check(m.ladders("score", "score_version", "sold")))


@query("ratio_outcome", "ladders", f"""
    SELECT CASE WHEN price_to_estimate < 0.6 THEN 'under 0.60' WHEN price_to_estimate < 0.84 THEN '0.60-0.84'
      WHEN price_to_estimate < 1 THEN '0.84-1.00' ELSE '1.00+' END AS ratio_band, count(*) AS n,
      {r6("count(*) FILTER (sold) / count(*)")} AS sell_through,
      {r6("median(final_price_ore / (price_ore / price_to_estimate)) FILTER (sold)")} AS med_realised
    FROM ladders GROUP BY 1""")
def ratio_outcome(m: Market):
    return rounded(slices.ratio_outcome(m.ladders("price_to_estimate", "price_ore", "sold", "final_price_ore")))


QUARTILE = (
    "CASE WHEN peer_pct <= 0.25 THEN 'cheapest quarter' WHEN peer_pct <= 0.5 THEN 'below median' "
    "WHEN peer_pct <= 0.75 THEN 'above median' ELSE 'priciest quarter' END"
)


@query("predictor_board_peers", "items", _board_sql(
    "sale", {"peer_quartile": QUARTILE}, "peers",
    f"shelf AS (SELECT * FROM items WHERE stratum IN ('A', 'B', 'N')), {PLACED},"))
def predictor_board_peers(m: Market):
    """The sale board's peer feature: rate by quartile of the peer position."""
    rows = filters.analysis_rows(m.items(*SHELF, "outcome", "stratum"))
    placed = peer_cascade(rows, min_group=MIN_GROUP, keep=["outcome"])
    features = {"peer_quartile": s.peer_quartile(F.col("peer_pct"))}
    return rounded(board.predictor_board(placed, features, F.lit(AS_OF).cast("date")))


@query("snapshot_rewritten", None, """
    SELECT event_type AS brand, cast(ts AS date) AS as_of, count(*) AS n FROM events GROUP BY 1, 2""")
def snapshot_rewritten(m: Market):
    """All days written as snapshots, every third one twice: every day holds its own rows once."""
    path = f"{shared_dir(m.spark)}/snapshot-{uuid.uuid4().hex}"
    daily = m.table("events").groupBy(F.col("event_type").alias("brand"), F.to_date("ts").alias("as_of")).agg(F.count(F.lit(1)).alias("n"))
    daily = cut_lineage(daily)
    days = sorted(str(r["as_of"]) for r in daily.select("as_of").distinct().collect())
    for day in [*days, *days[::3]]:
        write_snapshot(daily.where(F.col("as_of") == day), path, day)
    return m.spark.read.parquet(path).select("brand", "as_of", "n")


@query("snapshot_emptied", None, """
    SELECT event_type AS brand, cast(ts AS date) AS as_of, count(*) AS n FROM events
    WHERE cast(ts AS date) <> (SELECT min(cast(ts AS date)) FROM events) GROUP BY 1, 2""")
def snapshot_emptied(m: Market):
    """The first and the last day written, and the first again when it has no rows: its old ones go."""
    path = f"{shared_dir(m.spark)}/snapshot-{uuid.uuid4().hex}"
    daily = m.table("events").groupBy(F.col("event_type").alias("brand"), F.to_date("ts").alias("as_of")).agg(F.count(F.lit(1)).alias("n"))
    daily = cut_lineage(daily)
    days = sorted(str(r["as_of"]) for r in daily.select("as_of").distinct().collect())
    for day in days:
        write_snapshot(daily.where(F.col("as_of") == day), path, day)
    write_snapshot(daily.limit(0), path, days[0])
    return m.spark.read.parquet(path).select("brand", "as_of", "n")


_FIRST = re.sub(r"\b(shelf|placed|peers|scored)\b", r"\1_before", PLACED)
_ONCE = lambda sql: re.sub(r"\b(placed|peers)(_before)? AS \(", r"\1\2 AS MATERIALIZED (", sql)
_BETWEEN = "outcome IS NULL AND is_reserved"
TWO_DAYS = f"""WITH
    shelf_before AS (SELECT * FROM items WHERE outcome IS NULL AND stratum IN ('A', 'B', 'N')), {_FIRST},
    today AS (SELECT * REPLACE (CASE WHEN {_BETWEEN} THEN 1 ELSE outcome END AS outcome, CASE WHEN {_BETWEEN} THEN {DAY} ELSE resolved_on END AS resolved_on),
      {_BETWEEN} AS sold_now FROM items),
    frozen AS (SELECT t.*, CASE WHEN sold_now THEN p.peer_pct END AS peer_pct, CASE WHEN sold_now THEN p.peer_level END AS peer_level,
      CASE WHEN sold_now THEN p.peer_n END AS peer_n, CASE WHEN sold_now THEN p.peer_median_ore END AS peer_median_ore
      FROM today t LEFT JOIN (SELECT item_id, peer_pct, peer_level, peer_n, peer_median_ore FROM peers_before) p USING (item_id)),
    shelf AS (SELECT * FROM today WHERE outcome IS NULL AND stratum IN ('A', 'B', 'N')), {PLACED}
    SELECT 'peer_prices' AS t, item_id AS k, cast(peer_level AS bigint) AS a, peer_n AS n, {r6("peer_pct")} AS x, {r6("peer_median_ore")} AS y FROM peers
    UNION ALL SELECT 'items', item_id, cast(peer_level AS bigint), peer_n, {r6("peer_pct")}, {r6("peer_median_ore")} FROM frozen WHERE peer_level IS NOT NULL
    UNION ALL SELECT 'predictor_daily', concat(target, ' ', feature), buckets, n, lift, strength FROM ({{sale}})
    UNION ALL SELECT 'predictor_daily', concat(target, ' ', feature), buckets, n, lift, strength FROM ({{price}})
    UNION ALL SELECT 'brand_daily', brand, sold, listings, med_ask_ore, attention_index FROM ({{daily}})""".format(
    sale=_board_sql("sale", FEATURES | {"peer_quartile": f"CASE WHEN peer_pct IS NOT NULL THEN {QUARTILE} END"}, "frozen"),
    price=_board_sql("price", FEATURES, "frozen"),
    daily=BRAND_DAILY_SQL.replace("FROM items", "FROM today"),
)


@query("analytics_pass", "items", _ONCE(TWO_DAYS))
def analytics_pass(m: Market):
    """The daily pass on two days, between which the reserved listings sell: the second pass freezes the place that the first one gave them. Rows of
    all four tables as they are then written."""
    out = f"{shared_dir(m.spark)}/pass-{uuid.uuid4().hex}"
    nothing = m.spark.createDataFrame([], "item_id string, price_ore long, peer_level int, peer_n long, peer_median_ore double, peer_pct double")
    options = {"min_group": MIN_GROUP, "band_edges": BAND_EDGES}
    with staging(m.spark):  # the second day begins from the items that the first one wrote
        rows = cut_lineage(unfrozen(m.items(*dict.fromkeys([*SHELF, *BOARD_COLUMNS, "resolved_on"]))))
        done = jobs.analytics_pass(rows, nothing, out, "2000-06-30", **options)
    now = m.spark.read.parquet(f"{out}/items/as_of=2000-06-30")
    sold = F.col("outcome").isNull() & F.col("is_reserved")
    now = now.withColumn("resolved_on", F.when(sold, F.lit(AS_OF).cast("date")).otherwise(F.col("resolved_on")))
    now = now.withColumn("outcome", F.when(sold, 1).otherwise(F.col("outcome")))
    done += jobs.analytics_pass(now, m.spark.read.parquet(f"{out}/peer_prices/as_of=2000-06-30"), out, AS_OF, **options)
    if [state for _, state in done] != ["ok"] * 8:
        raise RuntimeError(f"analytics pass failed: {done}")

    def written(table: str, key, a: str, n: str, x: str, y: str):
        rows = m.spark.read.parquet(f"{out}/{table}/as_of={AS_OF}")
        return rows.select(F.lit(table).alias("t"), key.alias("k"), F.col(a).cast("long").alias("a"), F.col(n).alias("n"), F.col(x).alias("x"), F.col(y).alias("y"))

    parts = [
        written("peer_prices", F.col("item_id"), "peer_level", "peer_n", "peer_pct", "peer_median_ore"),
        written("items", F.col("item_id"), "peer_level_frozen", "peer_n_frozen", "peer_pct_frozen", "peer_median_ore_frozen").where("a is not null"),
        written("predictor_daily", F.concat_ws(" ", "target", "feature"), "buckets", "n", "lift", "strength"),
        written("brand_daily", F.col("brand"), "sold", "listings", "med_ask_ore", "attention_index"),
    ]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))

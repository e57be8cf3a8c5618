"""Queries on the market screens: lift, selling now, crowding, momentum, backtest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from thriftlens.operators import ladders, market
from thriftlens.plans import jobs
from thriftlens.plans.binding import AS_OF, Market, r6
from thriftlens.plans.ladder_queries import CURVE, curve
from thriftlens.plans.peer_queries import PLACED, scored
from thriftlens.plans.registry import query, rounded
from thriftlens.session import cut_lineage, shared_dir

DAY = f"DATE '{AS_OF}'"
LIFT = ["colour", "condition", "has_defect", "season"]


def _lift_features() -> dict:
    return {f: F.col(f) for f in LIFT}


def _known(m: Market):
    rows = m.items("item_id", "outcome", *LIFT)
    return rows.where("outcome is null or outcome = 1")


KNOWN = "k AS (SELECT * FROM items WHERE outcome IS NULL OR outcome = 1)"
LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, cast({f} AS varchar) AS value, outcome = 1 AS sold FROM k WHERE {f} IS NOT NULL"
    for f in LIFT
)


@query("feature_lift", "items", f"""WITH {KNOWN}, long AS ({LONG}),
    t AS (SELECT count(*) FILTER (outcome = 1) AS s, count(*) FILTER (outcome IS NULL) AS l FROM k),
    c AS (SELECT feature, value, count(*) AS n, count(*) FILTER (sold) AS y FROM long GROUP BY 1, 2 HAVING count(*) >= 30),
    d AS (SELECT *, y / s AS ps, (n - y) / l AS pl FROM c, t)
    SELECT feature, value, n, {r6("ps")} AS sold_share, {r6("pl")} AS base_rate, {r6("ps / nullif(pl, 0)")} AS lift,
      {r6("(ps + 1.96 ** 2 / (2 * s) - 1.96 * sqrt(ps * (1 - ps) / s + 1.96 ** 2 / (4 * s * s))) / (1 + 1.96 ** 2 / s)")}
        AS sold_share_low FROM d""")
def feature_lift(m: Market):
    return rounded(market.feature_lift(_known(m), _lift_features()))


PAIRS = [(a, b) for i, a in enumerate(LIFT) for b in LIFT[i + 1 :]]


@query("feature_pair_lift", "items", f"""WITH {KNOWN}, long AS ({LONG}),
    one AS (SELECT feature, value, count(*) FILTER (sold) / count(*) AS rate FROM long GROUP BY 1, 2),
    b AS (SELECT count(*) FILTER (outcome = 1) / count(*) AS base FROM k),
    two AS ({" UNION ALL ".join(f"SELECT '{x}' AS fa, cast({x} AS varchar) AS va, '{y}' AS fb, cast({y} AS varchar) AS vb, outcome = 1 AS sold FROM k WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in PAIRS)}),
    g AS (SELECT fa, va, fb, vb, count(*) AS n, count(*) FILTER (sold) / count(*) AS rate FROM two GROUP BY ALL HAVING count(*) >= 30)
    SELECT fa AS feature_a, va AS value_a, fb AS feature_b, vb AS value_b, n, {r6("g.rate")} AS rate,
      {r6("p.rate * q.rate / base")} AS expected_rate, {r6("g.rate / (p.rate * q.rate / base)")} AS lift
    FROM g JOIN one p ON p.feature = fa AND p.value = va JOIN one q ON q.feature = fb AND q.value = vb, b""")
def feature_pair_lift(m: Market):
    return rounded(market.pair_lift(_known(m), _lift_features()))


@query("sales_by_day", "ladders", f"""
    SELECT ended_on, count(*) AS sales, cast(sum(final_price_ore) AS bigint) AS revenue_ore,
      {r6("median(final_price_ore)")} AS med_price_ore, {r6("median(days_on_market)")} AS med_days,
      {r6("median(1 - final_price_ore / nullif(opening_ask_ore, 0))")} AS med_markdown FROM ladders WHERE sold GROUP BY 1""")
def sales_by_day(m: Market):
    rows = m.ladders("sold", "ended_on", "final_price_ore", "days_on_market", "opening_ask_ore")
    return rounded(market.sales_by_day(rows))


@query("top_sellers", "ladders", f"""
    SELECT brand, count(*) AS units, cast(sum(final_price_ore) AS bigint) AS revenue_ore,
      {r6("median(final_price_ore)")} AS med_price_ore FROM ladders WHERE sold GROUP BY 1 ORDER BY units DESC, brand LIMIT 10""")
def top_sellers(m: Market):
    return rounded(market.top_sellers(m.ladders("sold", "brand", "final_price_ore"), "brand", 10))


@query("sold_after_cut", "steps", f"""
    WITH l AS (SELECT item_id, arg_max(event_type, n) AS t, cast(max(created_at) AS date) AS sold_on,
      cast(max(created_at) FILTER (price_ore < prev_price) AS date) AS cut_on FROM steps GROUP BY 1)
    SELECT count(*) AS sales, count(*) FILTER (date_diff('day', cut_on, sold_on) BETWEEN 0 AND 7) AS after_cut,
      {r6("count(*) FILTER (date_diff('day', cut_on, sold_on) BETWEEN 0 AND 7) / count(*)")} AS share
    FROM l WHERE t = 'purchase'""")
def sold_after_cut(m: Market):
    steps = ladders.rungs(m.offers())
    sales = steps.where("latest and event_type = 'purchase'")
    return rounded(market.sold_after_cut(steps, sales.select("item_id", F.to_date("created_at").alias("sold_on"))))


@query("crowding", "items", f"""
    WITH c AS (SELECT brand, category, count(*) FILTER (outcome IS NULL) AS live,
      count(*) FILTER (outcome = 1 AND resolved_on > {DAY} - 90 AND resolved_on <= {DAY}) AS recent_sales,
      count(*) FILTER (outcome IS NULL AND date_diff('day', first_offered, {DAY}) > 120) AS stale FROM items GROUP BY 1, 2)
    SELECT brand, category, live, recent_sales, {r6("live / nullif(recent_sales, 0)")} AS supply_per_sale,
      {r6("stale / nullif(live, 0)")} AS stale_share FROM c""")
def crowding(m: Market):
    rows = m.items("brand", "category", "outcome", "resolved_on", "first_offered")
    return rounded(market.crowding(rows, ["brand", "category"], F.lit(AS_OF).cast("date"), 90))


@query("like_momentum", None, f"""
    WITH d AS (SELECT user_id AS item_id, cast(ts AS date) AS pass_on, count(*) AS c,
        sum(value >= 40) AS n, sum(value >= 20) AS e, sum(value < 20) AS a FROM events GROUP BY 1, 2),
    o AS (SELECT *, sum(c) OVER (PARTITION BY item_id ORDER BY pass_on) AS favs, min(pass_on) OVER (PARTITION BY item_id) AS first FROM d)
    SELECT item_id, cast(max(favs) AS bigint) AS favourites,
      {r6("max(favs) / greatest(date_diff('day', min(pass_on), max(pass_on)), 1)")} AS likes_per_day,
      cast(max(favs) FILTER (date_diff('day', first, pass_on) <= 7) AS bigint) AS early_favourites,
      cast(arg_max(n, pass_on) AS bigint) AS fav_nordic, cast(arg_max(e, pass_on) AS bigint) AS fav_eu,
      cast(arg_max(a, pass_on) AS bigint) AS fav_dach FROM o GROUP BY 1""")
def like_momentum(m: Market):
    """Events of a user as the likes of a listing; a listing's days are bounded by the calendar."""
    from pyspark.sql import Window

    daily = m.table("events").groupBy(F.col("user_id").alias("item_id"), F.to_date("ts").alias("pass_on")).agg(
        F.count(F.lit(1)).alias("_c"),
        F.count_if(F.col("value") >= 40).alias("fav_nordic"),
        F.count_if(F.col("value") >= 20).alias("fav_eu"),
        F.count_if(F.col("value") < 20).alias("fav_dach"),
    )
    w = Window.partitionBy("item_id").orderBy("pass_on")
    seen = daily.withColumn("favourites", F.sum("_c").over(w)).withColumn(
        "first_offered", F.min("pass_on").over(Window.partitionBy("item_id"))
    )
    return rounded(market.momentum(seen))


@query("sold_peer_median", "ladders", f"""
    WITH v AS (SELECT brand, item_type, condition, median(final_price_ore) AS v, count(*) AS n FROM ladders WHERE sold
      GROUP BY ALL HAVING count(*) >= 8)
    SELECT item_id, {r6("v")} AS peer_sold_median_ore, n AS peer_sold_n, {r6("v / price_ore")} AS edge
    FROM shelf JOIN v USING (brand, item_type, condition)""".replace("FROM shelf", "FROM (SELECT * FROM items WHERE outcome IS NULL AND stratum IN ('A', 'B', 'N'))"))
def sold_peer_median(m: Market):
    keys = ["brand", "item_type", "condition"]
    live = m.shelf("item_id", "price_ore", *keys)
    out = market.sold_peer_median(live, m.ladders("sold", "final_price_ore", *keys), keys)
    return rounded(out.select("item_id", "peer_sold_median_ore", "peer_sold_n", "edge"))


@query("season_buy_list", "ladders shelf", f"""WITH {CURVE}, {PLACED},
    best AS (SELECT season, arg_max(month, med_kept * 1000 + month / 1e9) AS peak FROM curve GROUP BY 1)
    SELECT item_id, season, discount_pct, peak FROM scored JOIN best USING (season)
    WHERE (peak - 9 + 12) % 12 BETWEEN 1 AND 3 AND discount_pct > 0 ORDER BY discount_pct DESC, item_id LIMIT 200""")
def season_buy_list(m: Market):
    best = market.season_buy_list(scored(m, "season"), curve(m), 9)
    return rounded(best.select("item_id", "season", "discount_pct", "peak"))


STEPS_BY_USER = """o AS (SELECT cast(user_id AS varchar) AS item_id, event_id AS offer_id, ts AS created_at, cast(round(value * 100) AS bigint) AS price_ore,
      event_type FROM events),
    s AS (SELECT *, row_number() OVER w AS n, lead(created_at) OVER w AS next_at FROM o WINDOW w AS (PARTITION BY item_id ORDER BY created_at, offer_id)),
    fin AS (SELECT item_id, arg_max(event_type, n) = 'purchase' AS sold, arg_max(price_ore, n) AS final_price,
      cast(max(created_at) AS date) AS ended_on FROM s GROUP BY 1)"""


def _backtest_sql(cutoffs: str, key: str) -> str:
    """By brute force: the steps of the past, for every cutoff."""
    return f"""WITH {STEPS_BY_USER}, cut AS ({cutoffs}),
    past AS (SELECT * FROM s JOIN cut ON cast(created_at AS date) <= cutoff),
    known AS (SELECT cutoff, item_id, arg_min(price_ore, n) AS opening, max(n) - 1 AS markdowns FROM past GROUP BY 1, 2),
    op AS (SELECT cutoff, item_id, arg_max(price_ore, n) AS ask FROM past WHERE next_at IS NULL OR cast(next_at AS date) > cutoff GROUP BY 1, 2),
    st AS (SELECT *, ask < opening * 0.5 AND markdowns < 3 AS picked FROM op JOIN known USING (cutoff, item_id) JOIN fin USING (item_id))
    SELECT {key} picked, count(*) AS n, {r6("count(*) FILTER (sold) / count(*)")} AS sell_through,
      {r6("median(final_price / nullif(ask, 0))")} AS med_kept,
      {r6("median(date_diff('day', cutoff, ended_on))")} AS med_days FROM st GROUP BY ALL"""


def _past(m: Market):
    """One ladder per user, what became of it, and a rule to buy by."""
    offers = m.offers().withColumn("item_id", F.split_part("item_id", F.lit("-"), F.lit(1)))
    steps = ladders.rungs(offers)
    outcomes = steps.where("latest").select(
        "item_id",
        (F.col("event_type") == "purchase").alias("sold"),
        F.col("price_ore").alias("final_price_ore"),
        F.to_date("created_at").alias("ended_on"),
    )
    return steps, outcomes, (F.col("ask_ore") < F.col("opening_ask_ore") * 0.5) & (F.col("markdowns") < 3)


@query("backtest", None, _backtest_sql("SELECT DATE '2024-01-15' AS cutoff", ""))
def backtest(m: Market):
    """A rule on the state of 15 January, scored on the rest of the month."""
    return rounded(market.backtest(*_past(m), F.lit("2024-01-15").cast("date")))


@query("backtest_many", None, _backtest_sql("SELECT DATE '2024-01-04' + cast(2 * k AS int) AS cutoff FROM range(12) r(k)", "cutoff,"))
def backtest_many(m: Market):
    """The same rule at twelve cutoffs, two days apart, in one pass over the steps."""
    days = m.spark.range(12).select(F.date_add(F.lit("2024-01-04").cast("date"), (2 * F.col("id")).cast("int")).alias("cutoff"))
    return rounded(market.backtest_many(*_past(m), days, cell_days=5))


@query("daily_aggregate", "ladders", "WITH long AS (" + " UNION ALL ".join(
    f"SELECT ended_on, '{d}' AS dimension, cast({d} AS varchar) AS value, final_price_ore, days_on_market FROM ladders WHERE sold"
    for d in ("brand_tier", "condition")) + f""")
    SELECT ended_on, dimension, value, count(*) AS units, {r6("median(final_price_ore)")} AS med_price_ore,
      {r6("median(days_on_market)")} AS med_days FROM long GROUP BY 1, 2, 3""")
def daily_aggregate(m: Market):
    dims = ["brand_tier", "condition"]
    rows = m.ladders("sold", "ended_on", "final_price_ore", "days_on_market", *dims)
    return rounded(market.daily_aggregate(rows, dims))


@query("sales_by_month", "ladders", "WITH long AS (" + " UNION ALL ".join(
    f"SELECT ended_on, '{d}' AS dimension, cast({d} AS varchar) AS value, final_price_ore, days_on_market FROM ladders WHERE sold"
    for d in ("brand_tier", "condition")) + f""")
    SELECT cast(date_trunc('month', ended_on) AS date) AS period, dimension, value, count(*) AS units, {r6("median(final_price_ore)")} AS med_price_ore,
      {r6("median(days_on_market)")} AS med_days FROM long GROUP BY 1, 2, 3""")
def sales_by_month(m: Market):
    """Sales counted in three goes, late ones of old days among them, and summed up by month from the counts alone."""
    home, dims = f"{shared_dir(m.spark)}/home-{uuid.uuid4().hex}", ["brand_tier", "condition"]
    rows = cut_lineage(m.ladders("sold", "ended_on", "final_price_ore", "days_on_market", "rungs", *dims))
    for part in ("rungs <> 3 and ended_on < '1996-01-01'", "rungs <> 3 and ended_on >= '1996-01-01'", "rungs = 3"):
        jobs.sales_job(rows.where(part), home, dims, "year")
    counts = m.spark.read.parquet(f"{home}/sale_counts")
    return rounded(market.aggregate_of_counts(counts, F.trunc("ended_on", "month")))


@query("cutoff_drift", "ladders", f"""
    SELECT score_version, category, cast(date_trunc('month', listed_on) AS date) AS month, count(*) AS n,
      {r6("avg(dwell_days / 97)")} AS mean_cutoff, count(*) FILTER (score < dwell_days / 97) AS below_cutoff,
      {r6("median(dwell_days / 97)")} AS med_cutoff FROM ladders GROUP BY 1, 2, 3""")
def cutoff_drift(m: Market):
    rows = m.ladders("score", "score_version", "category", "listed_on", "dwell_days")
    return rounded(market.cutoff_drift(rows.withColumn("cutoff", F.col("dwell_days") / 97)))

"""Queries on price ladders and resolved listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators import ladders, season, stats
from thriftlens.plans.binding import Market, r6
from thriftlens.plans.registry import query, rounded

SUMMARY = """
sums AS (SELECT item_id, arg_min(price_ore, n) AS opening_ask_ore, arg_max(price_ore, n) AS final_price_ore,
    count(*) AS rungs, cast(min(created_at) AS date) AS listed_on,
    cast(max(created_at) AS date) AS last_on, arg_max(event_type, n) AS last_type FROM steps GROUP BY item_id)
"""


def ladder_items(m: Market):
    """Ladders of the price steps; one that ends in a purchase or an error has ended."""
    offers = m.offers()
    ended = F.when(F.col("event_type").isin("purchase", "error"), F.col("created_at"))
    return offers.withColumn("ended_at", ended)


@query("ladder_summary", "steps", f"""WITH {SUMMARY},
    e AS (SELECT *, CASE WHEN last_type IN ('purchase', 'error') THEN last_on END AS ended_on FROM sums)
    SELECT item_id, opening_ask_ore, final_price_ore, rungs, listed_on, ended_on,
      round_even(1 - final_price_ore / nullif(opening_ask_ore, 0), 3) + 0.0 AS decay,
      cast(date_diff('day', listed_on, ended_on) AS int) AS days_on_market FROM e""")
def ladder_summary(m: Market):
    return rounded(ladders.ladder_summary(ladder_items(m)))


@query("ladder_rungs", "steps", """
    SELECT item_id, offer_id, price_ore, n AS rung, prev_price AS previous_ore, prev_price IS NULL AS first,
      next_at IS NULL AS latest, next_at IS NOT NULL AS ended FROM steps""")
def ladder_rungs(m: Market):
    steps = ladders.rungs(m.offers())
    return steps.select(
        "item_id", "offer_id", "price_ore", "rung", "previous_ore", "first", "latest",
        F.col("ended_at").isNotNull().alias("ended"),
    )


@query("ladder_parts", "steps", """
    SELECT item_id, cast(floor((n - 1) / 3) AS int) AS part, list(price_ore ORDER BY n) AS prices FROM steps GROUP BY 1, 2""")
def ladder_parts(m: Market):
    parts = ladders.ladder_parts(m.offers(), 3)
    return parts.select("item_id", "part", F.col("ladder.price_ore").alias("prices"))


@query("ladder_monotonicity", "steps", f"""
    WITH t AS (SELECT item_id, price_ore > prev_price AS up FROM steps WHERE prev_price IS NOT NULL)
    SELECT count(*) AS transitions, count(*) FILTER (up) AS increases,
      {r6("count(*) FILTER (up) / count(*)")} AS increase_share,
      count(DISTINCT item_id) FILTER (up) AS items_affected, count(DISTINCT item_id) AS items FROM t""")
def ladder_monotonicity(m: Market):
    return rounded(ladders.monotonicity(m.offers()))


def packed_ladders(m: Market):
    """Ladders packed as ``[day, price, day, price, ...]`` from the first day."""
    whole = ladders.nested_ladder(m.offers())
    first = F.get("ladder", F.lit(0))["from"]
    pairs = F.transform("ladder", lambda x: F.array(F.datediff(x["from"], first).cast("long"), x["price_ore"]))
    return whole.select("item_id", first.alias("first_seen"), F.flatten(pairs).alias("history"))


@query("packed_history", "steps", """
    WITH f AS (SELECT *, min(cast(created_at AS date)) OVER (PARTITION BY item_id) AS d0 FROM steps)
    SELECT item_id, cast(created_at AS date) AS "from", price_ore FROM f""")
def packed_history(m: Market):
    """Steps packed as day and price from the first day, then decoded again."""
    packed = packed_ladders(m)
    return ladders.decode_history(packed)


@query("price_as_of", "steps", """
    SELECT item_id, arg_max(price_ore, n) FILTER (cast(created_at AS date) <= DATE '2024-01-15') AS price_ore FROM steps GROUP BY item_id""")
def price_as_of(m: Market):
    return ladders.price_as_of(m.offers(), F.lit("2024-01-15").cast("date"))


@query("nested_ladder", "steps", """
    SELECT item_id, list(n ORDER BY n) AS rungs, list(price_ore ORDER BY n) AS prices FROM steps GROUP BY 1""")
def nested_ladder(m: Market):
    whole = ladders.nested_ladder(m.offers())
    return whole.select("item_id", F.col("ladder.rung").alias("rungs"), F.col("ladder.price_ore").alias("prices"))


@query("price_on_packed", "steps", """
    SELECT item_id, arg_max(price_ore, n) AS price_ore FROM steps GROUP BY item_id""")
def price_on_packed(m: Market):
    """The price read from the packed history of the item's own row."""
    return ladders.price_on(packed_ladders(m), F.lit("2024-12-31").cast("date"))


@query("sell_through_by_ask", "ladders", f"""
    SELECT CASE WHEN opening_ask_ore / 100 < 40000 THEN 'low (<40000)' WHEN opening_ask_ore / 100 < 80000
        THEN 'mid (40000-79999)' ELSE 'high (>=80000)' END AS ask_band,
      count(*) AS n, count(*) FILTER (sold) AS sold, {r6("count(*) FILTER (sold) / count(*)")} AS rate,
      {r6("median(rungs)")} AS med_rungs, {r6("median(days_on_market)")} AS med_days,
      {r6("median(decay)")} AS med_decay FROM ladders GROUP BY 1""")
def sell_through_by_ask(m: Market):
    rows = m.ladders("ended_on", "opening_ask_ore", "sold", "rungs", "days_on_market", "decay")
    return rounded(ladders.sell_through_by_ask(rows, 40000, 80000))


@query("underpricing_fingerprint", "ladders", f"""
    WITH f AS (SELECT *, coalesce(nullif(days_on_market, 0), 999) <= 90 AND rungs <= 2 AS quick,
      rungs >= 5 AS slow FROM ladders WHERE sold)
    SELECT count(*) AS sold, count(*) FILTER (quick) AS quick, count(*) FILTER (slow) AS slow,
      {r6("count(*) FILTER (quick) / count(*)")} AS quick_share,
      {r6("count(*) FILTER (slow) / count(*)")} AS slow_share,
      {r6("median(opening_ask_ore) FILTER (quick)")} AS med_quick_ask,
      {r6("median(opening_ask_ore) FILTER (slow)")} AS med_slow_ask FROM f""")
def underpricing_fingerprint(m: Market):
    rows = m.ladders("ended_on", "opening_ask_ore", "sold", "rungs", "days_on_market")
    return rounded(ladders.underpricing_fingerprint(rows, max_days=90))


@query("score_gap", "ladders", f"""
    WITH a AS (SELECT count(*) FILTER (sold) AS n_sold, count(*) FILTER (NOT sold) AS n_unsold,
      avg(score) FILTER (sold) AS mean_sold, avg(score) FILTER (NOT sold) AS mean_unsold FROM ladders)
    SELECT n_sold, n_unsold, {r6("mean_sold")} AS mean_sold, {r6("mean_unsold")} AS mean_unsold,
      {r6("mean_sold - mean_unsold")} AS gap,
      CASE WHEN abs(mean_sold - mean_unsold) < 0.03 THEN 'no signal' ELSE 'signal' END AS verdict FROM a""")
def score_gap(m: Market):
    return rounded(ladders.score_gap(m.ladders("ended_on", "sold", "score")))


@query("defect_split", "ladders", f"""
    SELECT has_defect, count(*) AS n, {r6("count(*) FILTER (sold) / count(*)")} AS sold_share,
      {r6("median(decay)")} AS med_decay FROM ladders GROUP BY 1""")
def defect_split(m: Market):
    return rounded(ladders.defect_split(m.ladders("ended_on", "has_defect", "sold", "decay")))


@query("dwell_split", "ladders", f"""
    SELECT dwell_days >= 30 AS long_dwell, count(*) AS n,
      {r6("count(*) FILTER (sold) / count(*)")} AS sold_share,
      {r6("median(opening_ask_ore)")} AS med_opening_ore FROM ladders GROUP BY 1""")
def dwell_split(m: Market):
    return rounded(ladders.dwell_split(m.ladders("ended_on", "dwell_days", "sold", "opening_ask_ore")))


@query("cleared_fact", "ladders", f"""
    SELECT item_id, brand, category, cast(date_trunc('month', listed_on) AS date) AS listed_month,
      cast(date_trunc('month', ended_on) AS date) AS cleared_month, opening_ask_ore AS landing_price_ore,
      final_price_ore AS clearing_price_ore, days_on_market AS days_to_clear, {r6("score")} AS score, sold
    FROM ladders""")
def cleared_fact(m: Market):
    return rounded(ladders.cleared_fact(m.ladders()))


@query("clearing_retention", "ladders", f"""
    SELECT sold, count(*) AS n,
      {r6("count(*) FILTER (final_price_ore / nullif(opening_ask_ore, 0) < 0.5) / count(*)")} AS over_half_off,
      {r6("median(final_price_ore / nullif(opening_ask_ore, 0))")} AS med_kept,
      {r6("median(days_on_market)")} AS med_days FROM ladders GROUP BY 1""")
def clearing_retention(m: Market):
    rows = m.ladders("ended_on", "sold", "final_price_ore", "opening_ask_ore", "days_on_market")
    return rounded(ladders.clearing_retention(rows))


@query("floor_truncation", "ladders", f"""
    SELECT sold, count(*) AS n, {r6("count(*) FILTER (final_price_ore < 3000000) / count(*)")} AS ended_below,
      {r6("median(final_price_ore)")} AS med_final_ore
    FROM ladders WHERE opening_ask_ore >= 3000000 GROUP BY 1""")
def floor_truncation(m: Market):
    rows = m.ladders("ended_on", "sold", "final_price_ore", "opening_ask_ore")
    return rounded(ladders.floor_truncation(rows, 3000000))


@query("below_floor_stragglers", "steps", f"""WITH {SUMMARY},
    e AS (SELECT *, CASE last_type WHEN 'purchase' THEN 'betald' WHEN 'error' THEN 'vilande' ELSE 'utlagd' END
        AS status, CASE WHEN last_type IN ('purchase', 'error') THEN last_on END AS ended_on
      FROM sums WHERE last_type <> 'signup')
    SELECT item_id, opening_ask_ore, final_price_ore, rungs, listed_on, ended_on, status,
      round_even(1 - final_price_ore / nullif(opening_ask_ore, 0), 3) + 0.0 AS decay,
      cast(date_diff('day', listed_on, ended_on) AS int) AS days_on_market,
      CASE status WHEN 'betald' THEN 1 WHEN 'vilande' THEN 2
        ELSE CASE WHEN final_price_ore < 4000 THEN 4 END END AS outcome FROM e""")
def below_floor_stragglers(m: Market):
    """All ladders but those that end in a signup wait below the floor."""
    offers = ladder_items(m)
    status = (
        F.when(F.col("event_type") == "purchase", "betald")
        .when(F.col("event_type") == "error", "vilande")
        .otherwise("utlagd")
    )
    last = offers.groupBy("item_id").agg(F.max_by("event_type", F.struct("created_at", "offer_id")).alias("t"))
    items = last.select("item_id", F.when(F.col("t") != "signup", F.lit(4)).alias("outcome"))
    return rounded(ladders.stragglers(items, offers.withColumn("status", status), 4000))


@query("payout_lag", "items", f"""
    WITH l AS (SELECT p2p, CASE WHEN p2p THEN 21 + product_id % 4 ELSE 0 END AS lag FROM items WHERE outcome = 1)
    SELECT p2p, count(*) AS n, cast(min(lag) AS int) AS min_days, cast(max(lag) AS int) AS max_days,
      {r6("median(lag)")} AS med_days FROM l GROUP BY 1""")
def payout_lag(m: Market):
    rows = m.items("p2p", "product_id", "resolved_on", "outcome").where("outcome = 1")
    wait = F.when(F.col("p2p"), 21 + F.col("product_id") % 4).otherwise(0).cast("int")
    sales = rows.select("p2p", F.col("resolved_on").alias("sold_on"), F.date_add("resolved_on", wait).alias("paid_on"))
    return rounded(ladders.payout_lag(sales))


# --- season and value ---------------------------------------------------------------------------

CURVE = f"""
curve AS (SELECT season, cast(month(ended_on) AS int) AS month, count(*) AS n,
    {r6("median(final_price_ore)")} AS med_price_ore,
    {r6("median(final_price_ore / nullif(opening_ask_ore, 0))")} AS med_kept,
    {r6("median(days_on_market)")} AS med_days
  FROM ladders WHERE sold AND season IN ('Vinter', 'Sommar') GROUP BY 1, 2 HAVING count(*) >= 8)
"""


def curve(m: Market):
    rows = m.ladders("season", "sold", "ended_on", "final_price_ore", "opening_ask_ore", "days_on_market")
    return rounded(season.season_curve(rows))


@query("season_curve", "ladders", f"WITH {CURVE} SELECT * FROM curve")
def season_curve(m: Market):
    return curve(m)


@query("season_spread", "ladders", f"""WITH {CURVE}
    SELECT season, arg_max(month, med_kept * 1000 + month / 1e9) AS best_month, max(med_kept) AS best_kept,
      arg_min(month, med_kept * 1000 + month / 1e9) AS worst_month, min(med_kept) AS worst_kept,
      {r6("max(med_kept) / min(med_kept)")} AS gross, {r6("max(med_kept) / min(med_kept) * 0.84")} AS net
    FROM curve GROUP BY 1""")
def season_spread(m: Market):
    return rounded(season.season_spread(curve(m)))


RATIOS = """
ratios AS (SELECT brand, category, cast(month(ended_on) AS int) AS month, count(*) AS n,
    median(final_price_ore / nullif(opening_ask_ore, 0)) AS clearing_ratio
  FROM ladders WHERE sold GROUP BY 1, 2, 3)
"""


@query("clearing_ratio", "ladders", f"""WITH {RATIOS}
    SELECT brand, category, month, n, {r6("clearing_ratio")} AS clearing_ratio FROM ratios""")
def clearing_ratio(m: Market):
    rows = m.ladders("brand", "category", "sold", "ended_on", "final_price_ore", "opening_ask_ore")
    return rounded(season.clearing_ratio(rows))


@query("buy_rule", "ladders", f"""WITH {RATIOS},
    e AS (SELECT item_id, price_ore, first_price_ore * clearing_ratio AS est FROM items
      JOIN ratios USING (brand, category) WHERE outcome IS NULL AND month = 11)
    SELECT item_id, price_ore, {r6("est")} AS est_clearing_ore,
      {r6("0.8 * est * 0.95 - price_ore - 100")} AS edge_ore FROM e WHERE 0.8 * est * 0.95 - price_ore - 100 > 0""")
def buy_rule(m: Market):
    rows = m.ladders("brand", "category", "sold", "ended_on", "final_price_ore", "opening_ask_ore")
    live = m.items("item_id", "brand", "category", "price_ore", "first_price_ore", only="l_linestatus = 'O'")
    out = season.buy_rule(live, season.clearing_ratio(rows), 11, p_sell=0.95, costs_ore=100)
    return rounded(out.select("item_id", "price_ore", "est_clearing_ore", "edge_ore"))


@query("reference_value", "ladders", f"""
    WITH v AS (SELECT brand, category, condition, split_part(size_code, '-', 1) AS size_band,
        median(final_price_ore) AS value_ore FROM ladders WHERE sold GROUP BY ALL)
    SELECT item_id, {r6("value_ore")} AS value_ore, {r6("value_ore / nullif(price_ore, 0)")} AS edge
    FROM (SELECT *, split_part(size_code, '-', 1) AS size_band FROM items WHERE outcome IS NULL)
    JOIN v USING (brand, category, condition, size_band)""")
def reference_value(m: Market):
    band = s.size_parts(F.col("size_code"))[0]
    sold = m.ladders("brand", "category", "condition", "size_code", "sold", "final_price_ore")
    live = m.items("item_id", "brand", "category", "condition", "size_code", "price_ore", only="l_linestatus = 'O'")
    values = season.reference_value(sold.withColumn("size_band", band))
    return rounded(season.value_edge(live.withColumn("size_band", band), values).select("item_id", "value_ore", "edge"))


# --- population statistics ----------------------------------------------------------------------


@query("offer_shape", "offers", f"""
    WITH r AS (SELECT *, row_number() OVER (ORDER BY price_ore) - 1 AS i, count(*) OVER () AS n FROM offers)
    SELECT max(n) AS n, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS live,
      count(*) FILTER (event_type IN ('purchase', 'error')) AS ended, max(price_ore) AS max_ore,
      {r6("count(*) FILTER (price_ore >= 5000) / count(*)")} AS share_above,
      {", ".join(f"(max(price_ore) FILTER (i = floor(n * {q})))::double AS {p}_ore" for p, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))}
    FROM r""")
def offer_shape(m: Market):
    return rounded(stats.offer_shape(ladder_items(m), 5000))


@query("field_coverage", "items", f"""
    SELECT 'season' AS field, count(season) AS present, count(*) AS n, {r6("count(season) / count(*)")} AS share FROM items
    UNION ALL SELECT 'resolved_on', count(resolved_on), count(*), {r6("count(resolved_on) / count(*)")} FROM items
    UNION ALL SELECT 'brand', count(brand), count(*), {r6("count(brand) / count(*)")} FROM items""")
def field_coverage(m: Market):
    rows = m.items("season", "resolved_on", "brand")
    return rounded(stats.field_coverage(rows, ["season", "resolved_on", "brand"]))


@query("top_brands", "items", """
    WITH c AS (SELECT brand AS value, count(*) AS n FROM items WHERE outcome IS NULL GROUP BY 1)
    SELECT * FROM (SELECT value, n, false AS watched FROM c ORDER BY n DESC, value LIMIT 10)
    UNION ALL SELECT w.value, coalesce(n, 0), true FROM (VALUES ('Brand#1'), ('Brand#99')) w(value)
    LEFT JOIN c ON c.value = w.value""")
def top_brands(m: Market):
    live = m.items("brand", only="l_linestatus = 'O'")
    return stats.top_values(live, "brand", 10, watch=["Brand#1", "Brand#99"])


@query("concentration", "items", f"""
    WITH c AS (SELECT brand, category, count(*) AS n FROM items GROUP BY 1, 2),
    k AS (SELECT concat(brand, ' ', category) AS kind, n FROM c)
    SELECT count(*) AS keys, cast(sum(n) AS bigint) AS rows, count(*) FILTER (n >= 30) AS with_min,
      count(*) FILTER (n = 1) AS singletons,
      (SELECT cast(sum(n) AS bigint) FROM (SELECT n FROM k ORDER BY n DESC, kind LIMIT 20)) AS top_rows,
      {r6("(SELECT sum(n) FROM (SELECT n FROM k ORDER BY n DESC, kind LIMIT 20)) / sum(n)")} AS top_share
    FROM k""")
def concentration(m: Market):
    rows = m.items("brand", "category")
    kinds = rows.withColumn("kind", F.concat_ws(" ", "brand", "category"))
    return rounded(stats.concentration(kinds, "kind", top=20, min_n=30))


@query("price_regressions", "ladders", """
    WITH q AS (SELECT final_price_ore::double AS y, opening_ask_ore::double AS x, decay,
      days_on_market::double AS d, final_price_ore / opening_ask_ore AS kept FROM ladders WHERE sold)
    SELECT count(*) AS n, round(regr_r2(y, x), 6) AS final_on_opening_r2,
      round(regr_slope(y, x), 6) AS final_on_opening_slope, round(regr_r2(ln(y), ln(x)), 6) AS log_r2,
      round(regr_slope(ln(y), ln(x)), 6) AS log_slope, round(avg(kept), 6) AS mean_kept,
      round(stddev_samp(kept), 6) AS sd_kept, round(regr_r2(decay, x), 6) + 0.0 AS decay_on_price_r2,
      round(regr_r2(decay, d), 6) + 0.0 AS decay_on_days_r2 FROM q""")
def price_regressions(m: Market):
    rows = m.ladders("sold", "final_price_ore", "opening_ask_ore", "decay", "days_on_market")
    return rounded(stats.price_regressions(rows))


@query("holdout_r2", "ladders", "WITH " + ", ".join(f"""
    {f}_t AS (SELECT coalesce(cast({f} AS varchar), '') AS level, final_price_ore AS y,
      ('0x' || substr(md5(item_id), 1, 8))::bigint < 858993459 AS test FROM ladders),
    {f}_m AS (SELECT level, avg(y) AS g FROM {f}_t WHERE NOT test GROUP BY 1),
    {f}_r AS (SELECT y, level, m.g, (SELECT avg(y) FROM {f}_t WHERE NOT test) AS mu,
      (SELECT avg(y) FROM {f}_t WHERE test) AS ybar FROM {f}_t LEFT JOIN {f}_m m USING (level) WHERE test)"""
    for f in ("brand", "item_type", "product_id")) + " " + " UNION ALL ".join(f"""
    SELECT '{f}' AS feature, round(1 - sum((y - coalesce(g, mu)) ** 2) / sum((y - ybar) ** 2), 6) + 0.0 AS r2,
      count(*) AS test_rows, count(*) FILTER (g IS NULL) AS unseen_rows FROM {f}_r"""
    for f in ("brand", "item_type", "product_id")))
def holdout_r2(m: Market):
    features = ["brand", "item_type", "product_id"]
    return rounded(stats.holdout_r2(m.ladders("item_id", "final_price_ore", *features), features))


@query("weighted_rate", "items", f"""
    SELECT stratum, count(*) AS n, sum(sample_weight) AS estimated_items,
      coalesce(sum(sample_weight) FILTER (has_defect), 0) AS estimated_hits,
      {r6("count(*) FILTER (has_defect) / count(*)")} AS unweighted_rate,
      {r6("coalesce(sum(sample_weight) FILTER (has_defect), 0) / sum(sample_weight)")} AS weighted_rate
    FROM items GROUP BY 1""")
def weighted_rate(m: Market):
    rows = m.items("stratum", "sample_weight", "has_defect")
    return rounded(stats.weighted_rate(rows, F.col("has_defect"), ["stratum"]))


@query("shelf_composition", "items", f"""
    WITH l AS (SELECT * FROM items WHERE outcome IS NULL),
    c AS (SELECT 'category' AS cut, category AS value, count(*) AS n FROM l GROUP BY 2
      UNION ALL SELECT 'tier', cast(brand_tier AS varchar), count(*) FROM l GROUP BY 2
      UNION ALL SELECT 'price>=20000', 'yes', count(*) FROM l WHERE price_ore >= 2000000
      UNION ALL SELECT 'price>=80000', 'yes', count(*) FROM l WHERE price_ore >= 8000000
      UNION ALL SELECT 'likes>=1', 'yes', count(*) FROM l WHERE favourites >= 1
      UNION ALL SELECT 'likes>=21', 'yes', count(*) FROM l WHERE favourites >= 21)
    SELECT cut, value, n, {r6("n / (SELECT count(*) FROM l)")} AS share FROM c""")
def shelf_composition(m: Market):
    live = m.items("category", "brand_tier", "price_ore", "favourites", only="l_linestatus = 'O'")
    return rounded(stats.shelf_composition(live, (20000, 80000)))


@query("outcome_counts", "items", "SELECT outcome, count(*) AS n FROM items GROUP BY 1")
def outcome_counts(m: Market):
    return stats.outcome_counts(m.items("outcome"))


@query("overview", "items", """
    SELECT count(*) AS items, count(*) FILTER (outcome IS NULL) AS live, count(*) FILTER (outcome = 1) AS sold,
      count(*) FILTER (outcome = 2) AS expired, sum(sample_weight) FILTER (outcome IS NULL) AS estimated_live
    FROM items""")
def overview(m: Market):
    return rounded(stats.overview(m.items("outcome", "sample_weight")))


@query("source_overlap", None, """
    WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 10),
    b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'F' AND l_tax < 0.02)
    SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
      (SELECT count(*) FROM a JOIN b USING (k)) AS n_both,
      round((SELECT count(*) FROM a JOIN b USING (k)) / (SELECT count(*) FROM a), 6) AS a_in_b,
      round((SELECT count(*) FROM a JOIN b USING (k)) / (SELECT count(*) FROM b), 6) AS b_in_a""")
def source_overlap(m: Market):
    a = m.items("product_id", only="l_linestatus = 'O' and l_quantity < 10")
    b = m.items("product_id", only="l_linestatus = 'F' and l_tax < 0.02")
    return rounded(stats.source_overlap(a, b, "product_id"))


@query("brand_consensus", "items", """
    WITH a AS (SELECT product_id, CASE WHEN NOT is_reserved THEN brand_tier END AS price_point,
      CASE WHEN is_reserved THEN NULL WHEN p2p AND has_defect THEN 'other' ELSE item_type END AS ethos
      FROM items WHERE outcome IS NULL)
    SELECT product_id, count(price_point) AS answers, CASE WHEN count(price_point) = 0 THEN 'unresolved'
        WHEN min(ethos) = max(ethos) THEN 'resolved' ELSE 'disagreed' END AS state,
      CASE WHEN min(ethos) = max(ethos) THEN min(price_point) END AS price_point,
      CASE WHEN min(ethos) = max(ethos) THEN min(ethos) END AS ethos FROM a GROUP BY 1""")
def brand_consensus(m: Market):
    """Classification per product line; a reserved listing carries none."""
    rows = m.items("product_id", "brand_tier", "item_type", "p2p", "has_defect", "is_reserved", only="l_linestatus = 'O'")
    known = ~F.col("is_reserved")
    kind = F.when(F.col("p2p") & F.col("has_defect"), "other").otherwise(F.col("item_type"))
    samples = rows.select(
        "product_id", F.when(known, F.col("brand_tier")).alias("price_point"), F.when(known, kind).alias("ethos")
    )
    return stats.brand_consensus(samples, ["price_point", "ethos"], "product_id")

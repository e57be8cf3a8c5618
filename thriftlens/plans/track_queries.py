"""Queries on tracking passes, the candidate pool, keyed writes and guards.

The second pass is read off the first: defective listings have vanished, much-repriced ones are cut
by a tenth, much-liked ones gain a like, and some of those come without a price.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators import brands, filters, guards, pool, sampling, track
from thriftlens.operators.cohort import refresh_sellability
from thriftlens.operators.peers import unfrozen
from thriftlens.operators.season import season_history as build_season_history
from thriftlens.plans import jobs
from thriftlens.plans.binding import AS_OF, BAND_EDGES, Market, crc32_sql, r6
from thriftlens.plans.board_queries import ATTENTION
from thriftlens.plans.ladder_queries import SUMMARY, ladder_items
from thriftlens.plans.peer_queries import MIN_GROUP, PLACED, SHELF
from thriftlens.plans.registry import query, rounded
from thriftlens.session import cut_lineage, shared_dir
from thriftlens.sources import tables
from thriftlens.sources.io import write_checks, write_lines

DAY = f"DATE '{AS_OF}'"
LIVE = "l_linestatus = 'O'"


def today():
    return F.lit(AS_OF).cast("date")


TRACKED = (
    "item_id", "price_ore", "favourites", "is_reserved", "last_chance", "outcome", "final_price_ore",
    "resolved_on", "first_offered", "has_defect", "rungs", "p2p",
)


def tracked(m: Market):
    rows = m.items(*TRACKED)
    return rows.select(
        "*",
        F.lit(None).cast("long").alias("old_price_ore"),
        F.col("first_offered").alias("first_seen"),
        F.col("first_offered").alias("last_seen"),
        F.array(F.lit(0).cast("long"), F.col("price_ore")).alias("history"),
    )


# The live listings that a sweep does not find; and the few, under a twentieth, that are gone in a market a job may believe.
GONE = "has_defect"
FEW_GONE = "(has_defect and favourites % 8 = 0)"


def _live(m: Market, kept: DataFrame | None):
    """The live listings, of the given tables or of the columns ``TRACKED`` as a table already keeps them."""
    return m.items(*TRACKED, only=LIVE) if kept is None else filters.live(kept)


def observed(m: Market, gone: str = GONE, kept: DataFrame | None = None):
    rows = _live(m, kept).where(f"not {gone}")
    cut = F.when(F.col("rungs") >= 5, F.floor(F.col("price_ore") * 0.9).cast("long")).otherwise(F.col("price_ore"))
    missing = (F.col("favourites") >= 45) & (F.col("rungs") == 1)
    return rows.select(
        "item_id",
        F.when(~missing, cut).alias("price_ore"),
        F.col("price_ore").alias("old_price_ore"),
        F.when(F.col("favourites") >= 40, F.col("favourites") + 1).otherwise(F.col("favourites")).alias("favourites"),
        "is_reserved",
        "last_chance",
    )


def verdicts(m: Market, gone: str = GONE, kept: DataFrame | None = None):
    """What the vanished listings' status says; one rung count gets no answer."""
    gone = _live(m, kept).where(f"{gone} and rungs <> 3")
    status = (
        F.when(F.col("p2p"), "utlagd")
        .when(F.col("rungs") == 1, "vilande")
        .when(F.col("rungs") == 2, "skänkt")
        .when(F.col("rungs") == 5, "never seen before")
        .otherwise("betald")
    )
    final = F.when(F.col("rungs") == 4, 0.0).otherwise(s.to_kr(F.col("price_ore")) - 1)
    return gone.select("item_id", status.alias("status"), final.alias("final_kr"))


PASS = """
live AS (SELECT * FROM items WHERE outcome IS NULL),
obs AS (SELECT item_id, CASE WHEN favourites >= 45 AND rungs = 1 THEN NULL
      WHEN rungs >= 5 THEN cast(floor(price_ore * 0.9) AS bigint) ELSE price_ore END AS p,
    CASE WHEN favourites >= 40 THEN favourites + 1 ELSE favourites END AS f FROM live WHERE NOT has_defect),
moved AS (SELECT l.item_id, coalesce(p, price_ore) AS price_ore, price_ore AS old_price_ore, f AS favourites, is_reserved, last_chance,
    p IS NOT NULL AND p <> price_ore AS price_moved FROM live l JOIN obs USING (item_id)
  WHERE (p IS NOT NULL AND p <> price_ore) OR f <> favourites),
gone AS (SELECT item_id, CASE WHEN rungs = 3 THEN 'unaccounted' WHEN p2p THEN 'still_live' ELSE 'resolved' END AS verdict,
    CASE WHEN rungs = 3 OR p2p THEN NULL WHEN rungs IN (1, 2) THEN 2 WHEN rungs = 5 THEN 3 ELSE 1 END AS outcome,
    CASE WHEN rungs = 3 OR p2p THEN NULL WHEN rungs = 4 THEN price_ore
      ELSE cast(trunc((price_ore / 100 - 1) * 100) AS bigint) END AS final_price_ore,
    CASE WHEN rungs <> 3 AND NOT p2p THEN """ + DAY + """ END AS resolved_on FROM live WHERE has_defect)
"""


@query("tracked_changes", "items", f"WITH {PASS} SELECT * FROM moved")
def tracked_changes(m: Market):
    return track.changes(filters.live(tracked(m)), observed(m))


@query("appended_history", "items", f"""WITH {PASS}
    SELECT m.item_id, [0, m.old_price_ore, cast(date_diff('day', first_offered, {DAY}) AS bigint), m.price_ore] AS history
    FROM moved m JOIN live USING (item_id) WHERE price_moved""")
def appended_history(m: Market):
    rows = filters.live(tracked(m))
    return track.append_history(rows, track.changes(rows, observed(m)), today())


@query("presence_split", "items", """
    SELECT item_id, NOT has_defect AS present FROM items WHERE outcome IS NULL""")
def presence_split(m: Market):
    present, gone = track.split_presence(filters.live(tracked(m)), observed(m))
    return present.select("item_id", F.lit(True).alias("present")).union(gone.select("item_id", F.lit(False)))


@query("adjudicated", "items", f"WITH {PASS} SELECT * FROM gone")
def adjudicated(m: Market):
    gone = track.split_presence(filters.live(tracked(m)), observed(m))[1]
    return track.adjudicate(gone, verdicts(m), today())


@query("stamped_seen", "items", f"""
    SELECT item_id, CASE WHEN outcome IS NULL AND NOT has_defect THEN greatest(first_offered, {DAY}) ELSE first_offered END AS last_seen,
      outcome IS NULL AND NOT has_defect AND first_offered < {DAY} AS stamped FROM items""")
def stamped_seen(m: Market):
    return track.stamp_seen(tracked(m), observed(m), today()).select("item_id", "last_seen", "stamped")


@query("track_pass", "items", f"""WITH {PASS}
    SELECT i.item_id, coalesce(m.price_ore, i.price_ore) AS price_ore, m.old_price_ore, coalesce(m.favourites, i.favourites) AS favourites,
      coalesce(i.outcome, g.outcome) AS outcome, coalesce(g.final_price_ore, i.final_price_ore) AS final_price_ore,
      coalesce(i.resolved_on, g.resolved_on) AS resolved_on,
      CASE WHEN o.item_id IS NOT NULL THEN greatest(first_offered, {DAY}) ELSE first_offered END AS last_seen,
      CASE WHEN price_moved THEN [0, i.price_ore, cast(date_diff('day', first_offered, {DAY}) AS bigint), m.price_ore]
        ELSE [0, i.price_ore] END AS history
    FROM items i LEFT JOIN moved m USING (item_id) LEFT JOIN gone g USING (item_id) LEFT JOIN obs o USING (item_id)""")
def track_pass(m: Market):
    rows = track.track_pass(tracked(m), observed(m), verdicts(m), today())
    return rows.select("item_id", "price_ore", "old_price_ore", "favourites", "outcome", "final_price_ore", "resolved_on", "last_seen", "history")


@query("resume_rest", "items", """
    SELECT item_id FROM items WHERE outcome IS NULL
    AND item_id > (SELECT max(item_id) FROM items WHERE outcome IS NULL AND rungs = 1 AND favourites = 0 AND NOT has_defect)""")
def resume_rest(m: Market):
    """Live rows after the key at which an interrupted pass of the day stopped."""
    rows = m.items("item_id", "rungs", "favourites", "has_defect", only=LIVE)
    done = rows.where("rungs = 1 and favourites = 0 and not has_defect")
    marker = done.agg(F.max("item_id").alias("last_item_id"), F.count(F.lit(1)).alias("items_done")).withColumn("run_date", today())
    old = marker.withColumn("run_date", F.date_sub(today(), 2)).withColumn("last_item_id", F.lit("~"))
    return track.remaining(rows.select("item_id"), track.resume_point(marker.union(old.select(marker.columns)), today()))


@query("not_enrolled", "items", """
    SELECT item_id FROM items WHERE outcome IS NULL AND item_id NOT IN (SELECT item_id FROM items WHERE stratum = 'A')""")
def not_enrolled(m: Market):
    rows = m.items("item_id", "outcome", "stratum")
    return sampling.not_enrolled(rows.where("outcome is null").select("item_id"), rows.where("stratum = 'A'"))


@query("origin_targets", "items", """
    SELECT item_id, outcome IS NULL AS live FROM items WHERE p2p AND NOT is_reserved""")
def origin_targets(m: Market):
    rows = m.items("item_id", "p2p", "outcome", "is_reserved")
    return track.origin_targets(rows, rows.where("is_reserved"))


@query("reconciled", "items", "SELECT item_id FROM items WHERE p2p AND outcome IS NOT NULL AND NOT has_defect")
def reconciled(m: Market):
    """Cached resales that are wanted (resolved) and have not landed (defective ones have)."""
    rows = m.items("item_id", "p2p", "outcome", "has_defect")
    cache, wanted = rows.where("p2p").select("item_id"), rows.where("outcome is not null")
    return track.reconcile(cache, wanted, rows.where("has_defect"))


@query("decoded_items", "items", "SELECT item_id, brand, item_type, condition, price_ore FROM items")
def decoded_items(m: Market):
    """Items by id joined back to brand and dictionary."""
    from thriftlens.functions.masks import ensure_lookup, lookup_ids

    rows = m.items("item_id", "brand", "item_type", "condition", "price_ore")
    empty = m.spark.createDataFrame([], "kind string, value string, id long")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("brand", "item_type", "condition")])
    lookup = ensure_lookup(rows.select(F.explode(pairs).alias("p")).select("p.*"), empty)
    coded = lookup_ids(rows, lookup, {k: k for k in ("brand", "item_type", "condition")}).drop("brand", "item_type", "condition")
    names = lookup.where("kind = 'brand'").select("id", F.col("value").alias("name"))
    decoded = track.decode_items(coded, names, lookup, ("item_type", "condition"))
    return decoded.select("item_id", "brand", "item_type", "condition", "price_ore")


# --- keyed writes -------------------------------------------------------------------------------


@query("upserted", "items", """
    SELECT item_id, CASE WHEN has_defect THEN price_ore + 1 ELSE price_ore END AS price_ore,
      CASE WHEN outcome IS NULL THEN favourites END AS favourites
    FROM items WHERE outcome IS NULL OR has_defect""")
def upserted(m: Market):
    """A partial payload on the live rows: defective rows get a price and keep their likes; the
    resolved ones among them are new."""
    rows = m.items("item_id", "price_ore", "favourites", "outcome", "has_defect")
    target = rows.where("outcome is null").select("item_id", "price_ore", "favourites")
    change = rows.where("has_defect").select("item_id", (F.col("price_ore") + 1).alias("price_ore"))
    return tables.upsert(target, change, ["item_id"])


@query("updated_existing", "items", """
    SELECT item_id, CASE WHEN has_defect THEN price_ore + 1 ELSE price_ore END AS price_ore FROM items WHERE outcome IS NULL""")
def updated_existing(m: Market):
    rows = m.items("item_id", "price_ore", "outcome", "has_defect")
    change = rows.where("has_defect").select("item_id", (F.col("price_ore") + 1).alias("price_ore"))
    return tables.update_existing(rows.where("outcome is null").select("item_id", "price_ore"), change, ["item_id"])


@query("deleted_where", "items", """
    SELECT item_id, season FROM items WHERE season IS NULL OR season <> 'Vinter'""")
def deleted_where(m: Market):
    return tables.delete_where(m.items("item_id", "season"), F.col("season") == "Vinter")


@query("exact_count", "items", "SELECT count(*) AS n FROM items WHERE outcome IS NULL AND price_ore >= 5000000")
def exact_count(m: Market):
    return tables.exact_count(m.items("price_ore", only=LIVE), F.col("price_ore") >= 5000000)


@query("filled_missing", "items", """
    SELECT item_id, coalesce(season, colour) AS season FROM items""")
def filled_missing(m: Market):
    rows = m.items("item_id", "season", "colour")
    source = rows.select("item_id", F.col("colour").alias("season"))
    return tables.fill_missing(rows.select("item_id", "season"), source, ["item_id"], ["season"])


@query("repaired_attributes", "items", """
    SELECT item_id, CASE WHEN NOT has_defect THEN price_ore WHEN p2p THEN price_ore + 2 WHEN is_reserved THEN price_ore + 1 END AS price_ore FROM items""")
def repaired_attributes(m: Market):
    """Prices of defective rows are lost; two sources offer some of them, the second one stands."""
    rows = m.items("item_id", "price_ore", "has_defect", "p2p", "is_reserved")
    broken = rows.select("item_id", F.when(~F.col("has_defect"), F.col("price_ore")).alias("price_ore"))
    index = rows.where("is_reserved").select("item_id", (F.col("price_ore") + 1).alias("price_ore"))
    offers = rows.where("p2p").select("item_id", (F.col("price_ore") + 2).alias("price_ore"))
    return tables.repair_attributes(broken, index, offers, ["item_id"], ["price_ore"])


# --- pool ---------------------------------------------------------------------------------------

BUCKET_SQL = f"cast({crc32_sql('brand')} % 4 AS int)"


def bucket():
    return s.bucket_of(F.col("brand"), 4)


POOL = f"""
pool AS (SELECT item_id, brand, CASE WHEN is_reserved THEN NULL ELSE b END AS bucket, 0.0::double AS discount_pct, {DAY} - 4 AS swept_on
  FROM (SELECT *, {BUCKET_SQL} AS b FROM items WHERE outcome IS NULL AND favourites >= 30))
"""


def old_pool(m: Market):
    rows = m.items("item_id", "brand", "is_reserved", "favourites", only=LIVE).where("favourites >= 30")
    return rows.select(
        "item_id",
        "brand",
        F.when(~F.col("is_reserved"), bucket()).alias("bucket"),
        F.lit(0.0).alias("discount_pct"),
        F.date_sub(today(), 4).alias("swept_on"),
    )


@query("refreshed_bucket", "items", f"""WITH {POOL},
    shelf AS (SELECT *, {BUCKET_SQL} AS bucket FROM items WHERE outcome IS NULL AND {BUCKET_SQL} = 2),
    {PLACED.replace(f"WHEN n3 >= {MIN_GROUP} THEN 3", "")},
    kept AS (SELECT item_id, brand, bucket, discount_pct, {DAY} AS swept_on FROM scored WHERE price_ore >= 20000 AND peer_n >= 12 AND peer_pct <= 0.25)
    SELECT item_id, brand, cast(bucket AS int) AS bucket, discount_pct, swept_on FROM (
      SELECT * FROM kept UNION ALL SELECT * FROM pool WHERE bucket IS NOT NULL AND bucket <> 2 AND item_id NOT IN (SELECT item_id FROM shelf))""")
def refreshed_bucket(m: Market):
    market = m.items(*SHELF, only=LIVE).withColumn("bucket", bucket())
    out = pool.refresh_bucket(old_pool(m), market, 2, today(), min_group=MIN_GROUP)
    return rounded(out)


@query("repriced_pool", "items", f"""WITH {PASS},
    pool AS (SELECT item_id, cast(floor(price_ore / 100) AS bigint) AS price_kr, first_price_ore / 100 AS med FROM live WHERE favourites >= 30),
    n AS (SELECT pool.*, coalesce(cast(floor(nullif(p, 0) / 100) AS bigint), price_kr) AS k, o.item_id IS NOT NULL AS still FROM pool LEFT JOIN obs o USING (item_id))
    SELECT item_id, k AS price_kr, med AS peer_median_kr, k <> price_kr AS repriced, round_even((1 - k / med) * 100, 2) + 0.0 AS discount_pct,
      still AS still_listed, {DAY} AS as_of FROM n""")
def repriced_pool(m: Market):
    rows = m.items("item_id", "price_ore", "first_price_ore", "favourites", only=LIVE).where("favourites >= 30")
    held = rows.select(
        "item_id", s.to_kr_floor(F.col("price_ore")).alias("price_kr"), s.to_kr(F.col("first_price_ore")).alias("peer_median_kr")
    )
    return rounded(pool.reprice_pool(held, observed(m), today()))


@query("retention_job", None, """
    SELECT event_type AS brand, cast(ts AS date) AS as_of, count(*) AS n FROM events
    WHERE cast(ts AS date) > (SELECT max(cast(ts AS date)) FROM events) - 10 GROUP BY 1, 2""")
def retention_job(m: Market):
    """A record of every day, of which the last ten stay."""
    home = _home(m)
    daily = m.table("events").groupBy(F.col("event_type").alias("brand"), F.to_date("ts").alias("as_of")).agg(F.count(F.lit(1)).alias("n"))
    daily.repartition("as_of").write.partitionBy("as_of").parquet(f"{home}/shortlist_flagged")
    last = daily.agg(F.max("as_of").cast("string").alias("d")).first()["d"]
    jobs.retention_job(m.spark, home, last, days=10)
    return m.spark.read.parquet(f"{home}/shortlist_flagged").select("brand", "as_of", "n")


@query("retained", None, """
    SELECT event_id FROM events WHERE cast(ts AS date) > DATE '2024-01-20' - 10 AND cast(ts AS date) <= DATE '2024-01-20'""")
def retained(m: Market):
    rows = m.table("events").select("event_id", F.to_date("ts").alias("as_of"))
    return pool.retain(rows, "as_of", F.lit("2024-01-20").cast("date"), 10).select("event_id")


SNAPSHOT = f"""
snap AS (SELECT brand, count(*) FILTER (outcome IS NULL) AS listings, median(price_ore) FILTER (outcome IS NULL) AS ask,
    count(*) FILTER (WHERE outcome = 1 AND resolved_on = {DAY}) AS sold FROM items WHERE stratum IN ('A', 'B', 'N') GROUP BY 1)
"""
POOLED = (
    "item_id", "brand", "brand_tier", "item_type", "category", "condition", "demography", "size_code", "price_ore",
    "first_price_ore", "favourites", "first_favourites", "weight_g", "has_defect", "p2p", "first_offered",
    "outcome", "resolved_on", "stratum",
)
SHORTLIST = f"""{PLACED}, {ATTENTION.replace("cn >= 300", "cn >= 30")}, {SNAPSHOT},
short AS (SELECT s.*, round_even((1 - price_ore / nullif(first_price_ore, 0)) * 100, 2) + 0.0 AS markdown_pct,
    likes / expected AS attention, CASE WHEN n.listings >= 25 THEN n.sold / (n.listings + n.sold) * 100 END AS sell_pct,
    CASE WHEN n.listings >= 25 THEN n.ask END AS brand_ask
  FROM scored s LEFT JOIN att USING (brand) LEFT JOIN snap n USING (brand)
  WHERE price_ore >= 20000 AND peer_n >= 12 AND peer_level <= 2 AND peer_pct <= 0.25)
"""


def shortlist(m: Market):
    seasons = m.spark.createDataFrame([("season", 1, "Sommar"), ("season", 3, "Vinter")], "kind string, bit int, value string")
    return pool.build_shortlist(m.items(*POOLED, "season_mask"), today(), BAND_EDGES, min_group=MIN_GROUP, meanings=seasons)


@query("shortlist_pool", "shelf", f"""WITH {SHORTLIST}
    SELECT item_id, brand, cast(floor(price_ore / 100) AS bigint) AS price_kr, {r6("peer_median_ore / 100")} AS peer_median_kr, peer_n, peer_level,
      {r6("peer_pct * 100")} AS peer_pct, discount_pct + 0.0 AS discount_pct, markdown_pct, favourites - first_favourites AS momentum,
      cast(date_diff('day', first_offered, {DAY}) AS int) AS age_days, {r6("attention")} AS brand_attention_index,
      {r6("sell_pct")} AS brand_sell_pct_day, {r6("brand_ask")} AS brand_ask_ore, split_part(size_code, '-', 1) AS size_group,
      cast(row_number() OVER (ORDER BY discount_pct DESC, item_id) AS int) AS rank,
      CASE season_mask WHEN 2 THEN ['Sommar'] WHEN 8 THEN ['Vinter'] WHEN 10 THEN ['Sommar', 'Vinter'] END AS seasons FROM short""")
def shortlist_pool(m: Market):
    return rounded(
        shortlist(m).select(
            "item_id", "brand", "price_kr", "peer_median_kr", "peer_n", "peer_level", "peer_pct", "discount_pct", "markdown_pct",
            "momentum", "age_days", "brand_attention_index", "brand_sell_pct_day", "brand_ask_ore", "size_group",
            "rank", "seasons",
        )
    )


FLAGGED_SQL = f"""WITH {SHORTLIST},
    k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY discount_pct DESC, item_id) AS k FROM short)
    SELECT {DAY} AS as_of, item_id, cast(row_number() OVER (ORDER BY discount_pct DESC, item_id) AS int) AS rank,
      cast(floor(price_ore / 100) AS bigint) AS price_kr, discount_pct + 0.0 AS discount_pct
    FROM k WHERE k <= 15 ORDER BY discount_pct DESC, item_id LIMIT 500"""


@query("flagged", "shelf", FLAGGED_SQL)
def flagged(m: Market):
    return rounded(pool.flagged(shortlist(m)))


@query("shortlist_job", "shelf", FLAGGED_SQL)
def shortlist_job(m: Market):
    """The day's shortlist written twice, an older day before it; the flagged record that is left."""
    home, rows = _home(m), cut_lineage(m.items(*POOLED, "season_mask"))
    for day in ("2000-06-30", AS_OF, AS_OF):
        jobs.shortlist_job(rows, home, day, band_edges=BAND_EDGES, min_group=MIN_GROUP, staged=True)
    jobs.retention_job(m.spark, home, AS_OF, days=1)
    full = m.spark.read.parquet(f"{home}/shortlist_daily")
    if full.select("as_of").distinct().count() != 1:
        raise RuntimeError("the shortlist of an older day is still there")
    return rounded(m.spark.read.parquet(f"{home}/shortlist_flagged").select("as_of", "item_id", "rank", "price_kr", "discount_pct"))


@query("attached_images", "items", f"""
    SELECT item_id, CASE WHEN NOT has_defect AND rungs > 1 THEN [concat(item_id, '.jpg')] END AS image_paths, NOT has_defect AS still_listed,
      {DAY} AS image_checked_on FROM items WHERE outcome IS NULL""")
def attached_images(m: Market):
    rows = m.items("item_id", "has_defect", "rungs", only=LIVE)
    host = "https://img.example.net/"
    urls = F.when(F.col("rungs") > 1, F.array(F.concat(F.lit(host), "item_id", F.lit(".jpg"))))
    docs = rows.where(~F.col("has_defect")).select("item_id", urls.alias("images"))
    return pool.attach_documents(rows.select("item_id"), docs, today(), [host])


SCORE_SQL = f"""
    WITH d AS (SELECT brand, (count(*) * (avg(favourites) / (SELECT avg(favourites) FROM items WHERE outcome IS NULL)) + 10) / (count(*) + 10) AS di
      FROM items WHERE outcome IS NULL GROUP BY 1),
    e AS (SELECT *, 0.84 * least((price_ore / 100) / price_to_estimate, price_ore / 100 * 5) - price_ore / 100 AS profit
      FROM items JOIN d USING (brand) WHERE outcome IS NULL AND NOT p2p AND price_ore >= 3000000 AND category <> 'gear')
    SELECT item_id, {r6("greatest(profit, 0) * di * CASE WHEN has_defect THEN 0.85 ELSE 1 END")} AS score, {r6("profit")} AS expected_profit,
      {r6("1 / price_to_estimate")} AS worth_x, price_to_estimate <= 0.2 AS cap_binds, false AS premium_fibre,
      season_mask > 0 AND (season_mask & 2) = 0 AS out_of_season FROM e"""


@query("score_table", "items", SCORE_SQL)
def score_table(m: Market):
    live, gear = _scored(m)
    return rounded(pool.score_table(live, brands.brand_demand(live), gear, today(), 3000000))


@query("score_job", "items", SCORE_SQL)
def score_job(m: Market):
    """The scores as the job writes them."""
    home = _home(m)
    jobs.score_job(*_scored(m), home, AS_OF, 3000000)
    return rounded(m.spark.read.parquet(f"{home}/item_scores").drop("as_of"))


def _scored(m: Market):
    rows = m.items("item_id", "brand", "category", "colour", "price_ore", "price_to_estimate", "favourites", "has_defect", "p2p", "season_mask", "outcome")
    live = filters.live(rows).withColumn("materials", F.array("colour"))
    gear = m.table("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("path")).where("path = 'gear'").distinct()
    return live, gear


# --- jobs with their guards -----------------------------------------------------------------------


def _home(m: Market) -> str:
    return f"{shared_dir(m.spark)}/home-{uuid.uuid4().hex}"


def _followed(m: Market, home: str):
    rows = m.spark.read.parquet(f"{home}/items")
    return rows.select("item_id", "price_ore", "favourites", "outcome", "final_price_ore", "resolved_on", "last_seen", "history")


TWICE = f"""WITH {PASS}
    SELECT i.item_id, coalesce(m.price_ore, i.price_ore) AS price_ore, coalesce(m.favourites, i.favourites) AS favourites,
      coalesce(i.outcome, g.outcome) AS outcome, coalesce(g.final_price_ore, i.final_price_ore) AS final_price_ore,
      coalesce(i.resolved_on, g.resolved_on) AS resolved_on,
      CASE WHEN o.item_id IS NOT NULL THEN greatest(first_offered, {DAY}) ELSE first_offered END AS last_seen,
      CASE WHEN price_moved THEN [0, i.price_ore, cast(date_diff('day', first_offered, {DAY} - 1) AS bigint), m.price_ore]
        ELSE [0, i.price_ore] END AS history
    FROM items i LEFT JOIN moved m USING (item_id) LEFT JOIN gone g USING (item_id) LEFT JOIN obs o USING (item_id)"""


@query("tracking_job", "items", TWICE.replace("has_defect", FEW_GONE))
def tracking_job(m: Market):
    """Enrolled, then two days tracked: the first has no run behind it and resolves nothing, the second does, since few listings are gone. A listing is
    delivered twice now and then."""
    home = _home(m)
    jobs.enrol(tracked(m), home, 8)
    # From the table just enrolled, which is the same listings with their orders joined, and before the job changes it.
    enrolled = m.spark.read.parquet(f"{home}/items")
    seen, answers = cut_lineage(observed(m, FEW_GONE, enrolled)), cut_lineage(verdicts(m, FEW_GONE, enrolled))
    seen = seen.unionByName(seen.where("favourites % 10 = 0"))
    for day in (F.date_sub(today(), 1), today()):
        name = m.spark.range(1).select(day.cast("string").alias("d")).first()["d"]
        verdict = jobs.tracking_job(m.spark, home, seen, answers, name, 8, 3)
        if verdict != "ok":
            raise RuntimeError(verdict)
    return _followed(m, home)


@query("tracking_resumed", "items", f"""
    SELECT count(*) AS items, count(*) FILTER (outcome IS NULL AND NOT has_defect AND first_offered < {DAY}) AS stamped FROM items""")
def tracking_resumed(m: Market):
    """A pass that was stopped behind its fourth partition goes on from there: every item is stamped once."""
    home = _home(m)
    jobs.enrol(tracked(m), home, 8)
    seen, path = cut_lineage(observed(m)), f"{home}/items"
    first = m.spark.read.parquet(path).where(F.col(tables.PART) < 4).drop(tables.PART)
    done = track.track_pass(first, seen.where(tables.part_of(["item_id"], 8) < 4), verdicts(m).limit(0), today())
    tables.replace_parts(done, path, ["item_id"], 8)
    m.spark.createDataFrame([(False,)], "may_resolve boolean").write.parquet(f"{home}/resolve/day={AS_OF}")
    mark = m.spark.range(1).select(today().alias("run_date"), F.lit("3").alias("last_item_id"), F.lit(4).cast("long").alias("items_done"))
    mark.write.parquet(f"{home}/marker")
    jobs.tracking_job(m.spark, home, seen, verdicts(m), AS_OF, 8, 2)
    rows = m.spark.read.parquet(path)
    stamped = (F.col("last_seen") == today()) & (F.col("first_seen") < today())
    return rows.agg(F.count(F.lit(1)).alias("items"), F.count_if(stamped).alias("stamped"))


UPSERTED_SQL = """
    SELECT item_id, CASE WHEN rungs = 2 THEN price_ore + 100 ELSE price_ore END AS price_ore, favourites FROM items
    UNION ALL SELECT concat(item_id, '-new'), price_ore, NULL FROM items WHERE rungs = 7"""


@query("upserted_partition", "items", UPSERTED_SQL)
def upserted_partition(m: Market):
    """Changed and new rows applied to a table in hash partitions; a second application changes nothing."""
    rows = m.items("item_id", "price_ore", "favourites", "rungs")
    path = f"{_home(m)}/table"
    tables.write_partitioned(rows.drop("rungs"), path, ["item_id"], 16)
    moved = rows.where("rungs = 2").select("item_id", (F.col("price_ore") + 100).alias("price_ore"))
    fresh = rows.where("rungs = 7").select(F.concat("item_id", F.lit("-new")).alias("item_id"), "price_ore")
    for _ in range(2):
        tables.upsert_partitioned(m.spark, path, moved.union(fresh), ["item_id"], 16)
    return m.spark.read.parquet(path).select("item_id", "price_ore", "favourites")


@query("upserted_bucketed", "items", UPSERTED_SQL)
def upserted_bucketed(m: Market):
    """The same on a table in buckets, of which every application writes a version."""
    rows = m.items("item_id", "price_ore", "favourites", "rungs")
    path = f"{_home(m)}/table"
    moved = rows.where("rungs = 2").select("item_id", (F.col("price_ore") + 100).alias("price_ore"))
    fresh = rows.where("rungs = 7").select(F.concat("item_id", F.lit("-new")).alias("item_id"), "price_ore")
    for changes in (rows.drop("rungs"), moved.union(fresh), moved.union(fresh)):
        version = tables.upsert_bucketed(m.spark, path, changes, ["item_id"], 16)
    return tables.read_bucketed(m.spark, path, version, ["item_id"], 16).select("item_id", "price_ore", "favourites")


@query("checks_round_trip", "items", f"""
    SELECT item_id, {DAY} - 7 AS checked_on, 'still_listed' AS outcome, status, NULL::double AS final_price, NULL::int AS rungs FROM items WHERE outcome IS NULL
    UNION ALL SELECT item_id, {DAY}, 'error', status, {r6("price_ore / 100")}, cast(rungs AS int) FROM items WHERE outcome IS NULL AND has_defect""")
def checks_round_trip(m: Market):
    """Two days' observations written as dated files, and both read back by the loader."""
    home, rows = _home(m), m.items("item_id", "status", "price_ore", "rungs", "has_defect", only=LIVE)
    early = rows.select("item_id", F.date_sub(today(), 7).alias("checked_on"), F.lit("still_listed").alias("outcome"), "status")
    late = rows.where("has_defect").select(
        "item_id", today().alias("checked_on"), F.lit("error:TimeoutError").alias("outcome"), "status",
        s.to_kr(F.col("price_ore")).alias("final_price"), F.col("rungs").cast("int").alias("rungs"),
    )
    write_checks(early, f"{home}/cohort_checks", "2000-06-24")
    write_checks(late, f"{home}/cohort_checks", AS_OF)
    loaded = jobs.load_local(m.spark, home, {})["cohort_checks"]
    return rounded(loaded.select("item_id", "checked_on", "outcome", "status", "final_price", "rungs"))


@query("loaded_cohort", "items", f"""
    SELECT item_id, stratum, item_type, brand, {r6("price_ore / 100")} AS price_kr, p2p AS is_resale, cast(favourites AS bigint) AS favourites FROM items""")
def loaded_cohort(m: Market):
    """The cohort file landed with an older line for every listing; the later line counts."""
    home, rows = _home(m), m.items("item_id", "stratum", "item_type", "brand", "price_ore", "p2p", "favourites")
    line = F.struct(
        "item_id", "stratum", F.col("item_type").alias("type"), "brand", s.to_kr(F.col("price_ore")).alias("price_kr"),
        F.col("p2p").alias("is_circle"), "favourites",
    )
    old = F.struct("item_id", F.lit("old").alias("stratum"))
    lines = rows.select(F.explode(F.array(F.to_json(old), F.to_json(line))).alias("value"))
    write_lines(lines, f"{home}/cohort_baseline.jsonl")
    loaded = jobs.load_local(m.spark, home, {})["cohort_items"]
    return rounded(loaded.select("item_id", "stratum", "item_type", "brand", "price_kr", "is_resale", "favourites"))


@query("loaded_trips", "items", f"""
    SELECT item_id AS resale_id, CASE WHEN rungs <= 4 THEN {r6("price_ore / 100")} END AS resale_ask, cast(rungs AS int) AS days_listed,
      rungs <= 4 AS sold FROM items WHERE p2p""")
def loaded_trips(m: Market):
    """Trips from two sources: the first has the sold ones, the second all; the first one's line stands."""
    home, rows = _home(m), m.items("item_id", "price_ore", "rungs", "p2p").where("p2p")
    days = F.col("rungs").cast("int").alias("days_on_circle")
    sold = F.struct(F.col("item_id").alias("circle_id"), s.to_kr(F.col("price_ore")).alias("circle_ask"), days, F.lit(True).alias("sold"))
    every = F.struct(F.col("item_id").alias("circle_id"), days, F.lit(False).alias("sold"))
    write_lines(rows.where("rungs <= 4").select(F.to_json(sold)), f"{home}/roundtrips_2.jsonl")
    write_lines(rows.select(F.to_json(every)), f"{home}/dormant_circle_1.jsonl")
    loaded = jobs.load_local(m.spark, home, {})["round_trips"]
    return rounded(loaded.select("resale_id", "resale_ask", "days_listed", "sold"))


OLDEST = """o AS (SELECT bucket FROM (SELECT b, (b * 7) % 5 AS late, b AS bucket FROM range(4) r(b)) ORDER BY late DESC, bucket LIMIT 1)"""


@query("rotation_job", "items", f"""WITH {POOL.replace(f"{DAY} - 4 AS swept_on", f"{DAY} - 4 - cast(b * 7 % 5 AS int) AS swept_on")}, {OLDEST},
    shelf AS (SELECT *, {BUCKET_SQL} AS bucket FROM items WHERE outcome IS NULL AND {BUCKET_SQL} = (SELECT bucket FROM o)),
    {PLACED.replace(f"WHEN n3 >= {MIN_GROUP} THEN 3", "")},
    kept AS (SELECT item_id, brand, bucket, discount_pct, {DAY} AS swept_on FROM scored WHERE price_ore >= 20000 AND peer_n >= 12 AND peer_pct <= 0.25)
    SELECT item_id, brand, cast(bucket AS int) AS bucket, discount_pct, swept_on FROM (
      SELECT * FROM kept UNION ALL SELECT * FROM pool WHERE bucket IS NOT NULL AND bucket <> (SELECT bucket FROM o) AND item_id NOT IN (SELECT item_id FROM shelf))""")
def rotation_job(m: Market):
    """The job finds the bucket that was swept longest ago, sweeps it and writes the pool's next version."""
    home = _home(m)
    held = old_pool(m).withColumn("swept_on", F.date_sub(F.col("swept_on"), bucket() * 7 % 5))
    tables.write_version(held, f"{home}/pool", 1)
    jobs.rotation_job(m.spark, home, m.items(*SHELF, only=LIVE), AS_OF, 4, min_group=MIN_GROUP)
    return rounded(tables.read_version(m.spark, f"{home}/pool", 2))


@query("refresh_job", "items", f"""WITH {PASS},
    pool AS (SELECT item_id, cast(floor(price_ore / 100) AS bigint) AS price_kr, first_price_ore / 100 AS med FROM live WHERE favourites >= 30),
    n AS (SELECT pool.*, coalesce(cast(floor(nullif(p, 0) / 100) AS bigint), price_kr) AS k, o.item_id IS NOT NULL AS still FROM pool LEFT JOIN obs o USING (item_id))
    SELECT item_id, k AS price_kr, med AS peer_median_kr, round_even((1 - k / med) * 100, 2) + 0.0 AS discount_pct,
      CASE WHEN still THEN [concat(item_id, '.jpg')] END AS image_paths, still AS still_listed, {DAY} AS as_of FROM n""")
def refresh_job(m: Market):
    """Prices, liveness and images on the pool's next version; every tenth listing is delivered twice."""
    home, host = _home(m), "https://img.example.net/"
    rows = m.items("item_id", "price_ore", "first_price_ore", "favourites", only=LIVE).where("favourites >= 30")
    held = rows.select(
        "item_id", s.to_kr_floor(F.col("price_ore")).alias("price_kr"), s.to_kr(F.col("first_price_ore")).alias("peer_median_kr")
    )
    tables.write_version(held, f"{home}/pool", 1)
    seen = observed(m).withColumn("images", F.array(F.concat(F.lit(host), "item_id", F.lit(".jpg"))))
    jobs.refresh_job(m.spark, home, seen.unionByName(seen.where("favourites % 10 = 0")), AS_OF, hosts=[host])
    fresh = tables.read_version(m.spark, f"{home}/pool", 2)
    return rounded(fresh.drop("repriced", "image_checked_on"))


@query("jobs_refused", "items", """
    WITH n AS (SELECT count(*) AS n FROM items WHERE outcome IS NULL AND NOT has_defect)
    SELECT 'half a sweep' AS tried, 'refused: dropped by more than half' AS answer, 0::bigint AS resolved FROM n
    UNION ALL SELECT 'no sweep', 'refused: nothing expected', 0
    UNION ALL SELECT 'churn', 'ok', 0
    UNION ALL SELECT 'stale staging', 'staging is stale', 0
    UNION ALL SELECT 'unfrozen', concat((SELECT count(*) FROM items WHERE outcome IS NOT NULL AND has_defect), ' resolved items are not frozen'), 0""")
def jobs_refused(m: Market):
    """What the guards inside the jobs answer; none of it resolves an item or replaces a table."""
    home, said = _home(m), []
    jobs.enrol(tracked(m).where("outcome is null"), home, 8)
    seen = cut_lineage(observed(m))
    later = m.spark.range(1).select(F.date_add(today(), 1).cast("string").alias("d")).first()["d"]
    first = jobs.tracking_job(m.spark, home, seen, verdicts(m), AS_OF, 8, 8)
    few = seen.where(F.pmod(F.xxhash64("item_id"), F.lit(10)) == 0)
    for name, part in (("half a sweep", few), ("no sweep", seen.limit(0)), ("churn", seen)):
        try:
            said.append((name, jobs.tracking_job(m.spark, home, part, verdicts(m), later, 8, 8) if first == "ok" else first))
        except jobs.Refused as no:
            said.append((name, str(no)))
        if name == "no sweep":  # a good run in between, so that only the churn speaks against resolving
            jobs._record(m.spark, home, "track", later, first and seen.count(), seen.count(), "ok")
    resolved = m.spark.read.parquet(f"{home}/items").where("outcome is not null").count()
    rows = cut_lineage(unfrozen(m.items("item_id", "outcome", "has_defect", "price_ore")))
    peers = rows.where(F.col("outcome").isNotNull() & F.col("has_defect")).select("item_id")
    marker = m.spark.range(1).select(F.lit("2000-07-01 10:00:00").cast("timestamp").alias("staged_at"))
    for name, now in (("stale staging", "2000-07-01 10:50:00"), ("unfrozen", "2000-07-01 10:10:00")):
        try:
            jobs.check_staging(marker, rows, peers, F.lit(now).cast("timestamp"))
            said.append((name, "ok"))
        except jobs.Refused as no:
            said.append((name, str(no)))
    return m.spark.createDataFrame([(a, b, resolved) for a, b in said], "tried string, answer string, resolved long")


# --- guards ----------------------------------------------------------------------------


@query("staging_guard", "items", """
    SELECT TIMESTAMP '2000-07-01 10:00:00' AS staged_at, count(*) AS unfrozen, 'staging is stale' AS score_verdict, false AS may_score,
      count(*) = 0 AS may_replace FROM items WHERE outcome IS NOT NULL AND has_defect""")
def staging_guard(m: Market):
    """A marker of 50 minutes ago, and resolved defective items whose position is not frozen."""
    rows = m.items("item_id", "outcome", "has_defect")
    frozen = F.when(~F.col("has_defect"), today())
    items = rows.withColumn("peer_frozen_on", frozen)
    now = F.lit("2000-07-01 10:50:00").cast("timestamp")
    marker = rows.agg(F.count(F.lit(1))).select(F.lit("2000-07-01 10:00:00").cast("timestamp").alias("staged_at"))
    guard = guards.staging_guard(marker, items, rows, now)
    return guard.withColumn("staged_at", F.col("staged_at").cast("timestamp_ntz"))


LEDGER = """
ledger AS (SELECT cast(ts AS date) AS started_at, count(*) AS expected, CASE WHEN count(*) % 2 = 0 THEN 'ok' ELSE 'failed' END AS status
  FROM events GROUP BY 1)
"""


def ledger(m: Market):
    runs = m.table("events").groupBy(F.to_date("ts").alias("started_at")).agg(F.count(F.lit(1)).alias("expected"))
    return runs.withColumn("status", F.when(F.col("expected") % 2 == 0, "ok").otherwise("failed"))


@query("run_verdict", None, f"""WITH {LEDGER},
    now AS (SELECT max(cast(ts AS date)) AS d FROM events),
    run AS (SELECT count(*) AS e, count(*) FILTER (event_type <> 'error') AS w FROM events, now WHERE cast(ts AS date) = d),
    l AS (SELECT arg_max(expected, started_at) AS last FROM ledger, now WHERE status = 'ok' AND started_at < d)
    SELECT last AS last_expected, e AS expected, w AS written,
      CASE WHEN e < last * 0.5 THEN 'refused: dropped by more than half' WHEN w >= e * 0.9 THEN 'ok' ELSE 'failed' END AS verdict FROM l, run""")
def run_verdict(m: Market):
    """The newest day as a run that expected all its events and wrote those without an error, against the last good day before it."""
    days = m.table("events").select(F.to_date("ts").alias("day"), "event_type")
    run = days.groupBy("day").agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("event_type") != "error").alias("w")).orderBy(F.desc("day")).first()
    return guards.run_verdict(ledger(m).where(F.col("started_at") < F.lit(run["day"])), run["e"], run["w"])


@query("outcome_precheck", "items", f"""WITH {LEDGER},
    c AS (SELECT count(*) AS tracked, count(*) FILTER (has_defect) AS gone FROM items WHERE outcome IS NULL),
    l AS (SELECT arg_max(status, started_at) AS st FROM ledger)
    SELECT st AS last_status, tracked, gone, {r6("gone / tracked")} AS churn, st = 'ok' AND gone / tracked < 0.05 AS may_resolve FROM c, l""")
def outcome_precheck(m: Market):
    return rounded(guards.outcome_precheck(ledger(m), filters.live(tracked(m)), observed(m)))


SEASON_SQL = f"""WITH {SUMMARY},
    e AS (SELECT *, split_part(item_id, '-', 1)::int AS u FROM sums WHERE last_type IN ('purchase', 'error')),
    t AS (SELECT *, CASE WHEN u % 3 = 0 THEN 'Vinter' WHEN u % 3 = 1 THEN 'Sommar' END AS season FROM e)
    SELECT item_id, opening_ask_ore, final_price_ore, rungs, listed_on, last_on AS ended_on,
      round_even(1 - final_price_ore / nullif(opening_ask_ore, 0), 3) + 0.0 AS decay,
      cast(date_diff('day', listed_on, last_on) AS int) AS days_on_market, season,
      CASE last_type WHEN 'purchase' THEN 'såld' ELSE 'vilande' END AS status, last_type = 'purchase' AS sold FROM t WHERE season IS NOT NULL"""


@query("season_history", "steps", SEASON_SQL)
def season_history(m: Market):
    """Ladders of the season-tagged listings; a user's listings share a season, a third have none."""
    return rounded(build_season_history(*_tagged(m)))


def _tagged(m: Market):
    offers = ladder_items(m)
    last = offers.groupBy("item_id").agg(F.max_by("event_type", F.struct("created_at", "offer_id")).alias("t"))
    third = F.split_part("item_id", F.lit("-"), F.lit(1)).cast("int") % 3
    status = F.when(F.col("t") == "purchase", "såld").when(F.col("t") == "error", "vilande").otherwise("utlagd")
    details = last.select(
        "item_id", F.when(third == 0, "Vinter").when(third == 1, "Sommar").alias("season"), status.alias("status")
    )
    return offers, details


@query("season_job", "steps", SEASON_SQL)
def season_job(m: Market):
    """Two scans that overlap, added one after the other: every listing is in the history once."""
    home = _home(m)
    offers, details = _tagged(m)
    user = F.split_part("item_id", F.lit("-"), F.lit(1)).cast("int")
    for scan in (user % 5 < 3, user % 5 > 1):
        jobs.season_job(offers.where(scan), details.where(scan), home, 8)
    return rounded(m.spark.read.parquet(f"{home}/season_history").drop(tables.PART))


@query("refreshed_sellability", "items", f"""
    SELECT item_id, {r6("score")} AS sellability_score, 0.44::double AS sellability_cutoff, score >= 0.44 AS sellability_reliable,
      score_version AS sellability_version, {DAY} AS sellability_seen_on FROM items WHERE outcome IS NULL AND p2p AND NOT has_defect""")
def refreshed_sellability(m: Market):
    """Estimates on live offers; a defective listing carries none. The cohort is the resales."""
    rows = m.items("item_id", "score", "score_version", "outcome", "p2p", "has_defect")
    estimate = F.struct(
        "score", F.lit(0.44).alias("cutoff"), (F.col("score") >= 0.44).alias("isReliable"), F.col("score_version").alias("version")
    )
    item = F.struct(F.col("item_id").alias("objectId"), F.when(~F.col("has_defect"), estimate).alias("sellabilityEstimate"))
    offers = rows.select(item.alias("item"), F.col("outcome").isNull().alias("latest"))
    return rounded(refresh_sellability(rows.where("p2p"), offers, today()))

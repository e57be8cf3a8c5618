"""Queries on resale trades and the frozen cohort."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from thriftlens import schemas
from thriftlens.functions import scalars as s
from thriftlens.operators import cohort, filters, ladders, trades
from thriftlens.operators.spread import left_join_near, nearly_among
from thriftlens.plans.binding import AS_OF, Market, r6
from thriftlens.plans.registry import query, rounded
from thriftlens.session import cut_lineage, shared_dir, staging
from thriftlens.sources import documents
from thriftlens.sources.io import read_jsonl, write_lines

# Every listing as a ladder summary; one still listed has no end.
ALL_LADDERS = """
l AS (SELECT item_id, first_price_ore AS opening_ask_ore, price_ore AS final_price_ore, rungs,
    first_offered AS listed_on, resolved_on AS ended_on, status FROM items)
"""
BOUGHT = """
b AS (SELECT item_id AS original_id, opening_ask_ore AS original_opening_ore, rungs AS original_rungs,
    final_price_ore AS bought_price_ore, ended_on AS bought_on,
    round_even(1 - final_price_ore / nullif(opening_ask_ore, 0), 3) + 0.0 AS bought_discount FROM l)
"""
TRIPS = f"""{ALL_LADDERS}, {BOUGHT},
trips AS (SELECT r.item_id, original_id, l.opening_ask_ore AS ask_ore, l.final_price_ore AS final_ore,
    l.rungs AS resale_rungs, l.listed_on, l.ended_on, l.status, b.* EXCLUDE (original_id),
    l.status IN ('såld', 'betald') AS sold,
    round_even(l.final_price_ore / nullif(bought_price_ore, 0), 2) AS multiple,
    CASE WHEN l.status IN ('såld', 'betald')
      THEN round_even((l.final_price_ore / 100) * 0.84 - bought_price_ore / 100, 1) + 0.0 END AS profit_kr,
    cast(date_diff('day', bought_on, l.listed_on) AS int) AS days_held,
    cast(date_diff('day', l.listed_on, l.ended_on) AS int) AS days_listed
  FROM resales r JOIN l USING (item_id) JOIN b USING (original_id))
"""


def all_ladders(m: Market, near=None):
    """With ``near``, a filter by id, of the listings that it keeps."""
    rows = m.items("item_id", "first_price_ore", "price_ore", "rungs", "first_offered", "resolved_on", "status", near=near)
    return rows.select(
        "item_id",
        F.col("first_price_ore").alias("opening_ask_ore"),
        F.col("price_ore").alias("final_price_ore"),
        "rungs",
        F.col("first_offered").alias("listed_on"),
        F.col("resolved_on").alias("ended_on"),
        "status",
    )


def trips(m: Market):
    """The round trips as a table: the payoff queries read it more than once."""
    return cut_lineage(rounded(trades.round_trips(m.resales(), partial(all_ladders, m))))


@query("resale_pointers", "resales", "SELECT * FROM resales")
def resale_pointers(m: Market):
    """Each resale with the newest earlier listing of its product."""
    return m.resales()


@query("round_trips", "resales", f"WITH {TRIPS} SELECT * FROM trips")
def round_trips(m: Market):
    return rounded(trades.round_trips(m.resales(), partial(all_ladders, m)))


def offer_documents(m: Market):
    """The listings' price steps as landed offer documents: one when it is listed, one at its last price if it has ended."""
    folder = f"{shared_dir(m.spark)}/offers-{uuid.uuid4().hex}"
    # Listings and pointers are tables until the documents have landed: the shuffles of each go before the next step begins.
    with staging(m.spark):
        resales = cut_lineage(m.resales())
        rows = cut_lineage(m.items("item_id", "first_price_ore", "price_ore", "first_offered", "resolved_on", "status", "dwell_days", "brand"))
        write_lines(offer_lines(left_join_near(rows, resales, "item_id")), f"{folder}/offers_1.jsonl")
        return read_jsonl(m.spark, f"{folder}/offers_*.jsonl", schemas.OFFER)


def offer_lines(rows):
    """Listings with their pointers as offer documents."""
    iso = lambda day: F.date_format(day, "yyyy-MM-dd'T'00:00:00.000'Z'")
    item = F.struct(
        F.col("item_id").alias("objectId"),
        F.col("status").alias("itemStatus"),
        F.struct("brand").alias("metadata"),
        iso(F.date_sub("first_offered", F.col("dwell_days"))).alias("assortedAt"),
        F.to_json(F.struct(iso(F.col("first_offered")).alias("iso"))).alias("putOnShelfAt"),
        F.when(F.col("original_id").isNotNull(), F.struct(F.col("original_id").alias("objectId"))).alias("preceding"),
    )

    def offer(n: int, price: str, start: str, end: str):
        return F.struct(
            F.concat_ws("-", "item_id", F.lit(n)).alias("objectId"),
            item.alias("item"),
            F.struct((F.col(price) / 100).alias("amount")).alias("pricing"),
            F.lit("SE").alias("region"),
            iso(F.col(start)).alias("createdAt"),
            iso(F.col(end)).alias("endedAt"),
        )

    first = offer(1, "first_price_ore", "first_offered", "resolved_on")
    last = F.when(F.col("resolved_on").isNotNull(), offer(2, "price_ore", "resolved_on", "resolved_on"))
    return rows.select(F.explode(F.array(first, last)).alias("o")).where("o is not null").select(F.to_json("o"))


OFFERED = f"""
l AS (SELECT item_id, first_price_ore AS opening_ask_ore, CASE WHEN resolved_on IS NULL THEN first_price_ore ELSE price_ore END AS final_price_ore,
    CASE WHEN resolved_on IS NULL THEN 1 ELSE 2 END AS rungs, first_offered AS listed_on, resolved_on AS ended_on, status FROM items),
{BOUGHT}, {TRIPS[TRIPS.index("trips AS"):]}"""


@query("document_trips", "resales", f"""WITH {OFFERED}
    SELECT item_id, original_id, ask_ore, final_ore, bought_price_ore, sold, multiple, profit_kr, days_held, days_listed FROM trips""")
def document_trips(m: Market):
    """From landed offer documents to round trips: steps, details, ladders, pointers, trips."""
    docs = offer_documents(m)
    # Tables: the trips read details and ladders more than once, and each read would parse the documents again.
    with staging(m.spark):
        details = cut_lineage(documents.offer_details(docs).select("item_id", "original_id", "status"), lasting=True)
        linked = details.where(F.col("original_id").isNotNull())
        named = cut_lineage(linked.select(F.explode(F.array("item_id", "original_id")).alias("item_id")))

        def near(rows):
            return nearly_among(rows, "item_id", named)

        # Ladders of what the trips name; the filter stands before the steps are shuffled.
        rows = cut_lineage(ladders.ladder_rows(near(documents.offer_steps(docs)), near(details)), lasting=True)
    found = trades.round_trips(details.select("item_id", "original_id"), rows)
    return rounded(
        found.select("item_id", "original_id", "ask_ore", "final_ore", "bought_price_ore", "sold", "multiple", "profit_kr", "days_held", "days_listed")
    )


@query("document_dwell", "items", "SELECT item_id, brand, status, dwell_days FROM items")
def document_dwell(m: Market):
    """Days between sorting and shelf, from the documents' two dates."""
    return documents.offer_details(offer_documents(m)).select("item_id", "brand", "status", "dwell_days")


@query("resale_origins", "resales", f"""WITH {ALL_LADDERS}, {BOUGHT}
    SELECT r.item_id, r.original_id, b.* EXCLUDE (original_id) FROM resales r
    LEFT JOIN (SELECT * FROM b WHERE bought_on IS NOT NULL) b USING (original_id) WHERE r.original_id IS NOT NULL""")
def resale_origins(m: Market):
    """Origins; the ladder of an original that is still listed is not there to read."""

    def ended(near):
        return all_ladders(m, near).where(F.col("ended_on").isNotNull())

    return rounded(trades.origins(m.resales(), ended))


@query("tracked_round_trips", "resales", f"""WITH {ALL_LADDERS}, {BOUGHT}
    SELECT i.item_id, r.original_id, i.outcome, round_even(first_price_ore / nullif(bought_price_ore, 0), 2) AS asking_multiple,
      CASE WHEN outcome = 1 THEN round_even(i.final_price_ore / nullif(bought_price_ore, 0), 2) END AS realised_multiple,
      CASE WHEN outcome = 1 THEN cast(round_even(i.final_price_ore * 0.84 - bought_price_ore, 0) AS bigint) END AS profit_ore,
      CASE WHEN outcome = 1 THEN cast(date_diff('day', bought_on, resolved_on) AS int) END AS days_paid_to_sold
    FROM items i JOIN resales r USING (item_id) LEFT JOIN b USING (original_id) WHERE r.original_id IS NOT NULL""")
def tracked_round_trips(m: Market):
    items = m.items("item_id", "outcome", "first_price_ore", "final_price_ore", "resolved_on")
    return rounded(trades.tracked_round_trips(items, trades.origins(m.resales(), partial(all_ladders, m))))


@query("payoff_summary", "resales", f"""WITH {TRIPS}
    SELECT count(*) AS sold, {r6("count(*) FILTER (profit_kr > 0) / count(profit_kr)")} AS win_rate,
      {r6("count(*) FILTER (multiple < 1 / 0.84) / count(multiple)")} AS under_break_even,
      {r6("median(multiple)")} AS med_multiple, {r6("median(profit_kr)")} AS med_profit_kr,
      {r6("median(bought_price_ore)")} AS med_paid_ore, {r6("median(days_held)")} AS med_days_held,
      {r6("median(days_listed)")} AS med_days_listed FROM trips WHERE sold""")
def payoff_summary(m: Market):
    return rounded(trades.payoff_summary(trips(m)))


@query("payoff_by_discount", "resales", f"""WITH {TRIPS}
    SELECT CASE WHEN bought_discount < 0.2 THEN 'barely <20%' WHEN bought_discount < 0.5 THEN 'moderate 20-50%'
      WHEN bought_discount < 0.75 THEN 'deep 50-75%' ELSE 'bottom >75%' END AS discount_band, count(*) AS n,
      {r6("count(*) FILTER (sold) / count(*)")} AS sold_share, {r6("median(multiple) FILTER (sold)")} AS med_multiple,
      {r6("median(bought_price_ore)")} AS med_paid_ore FROM trips WHERE bought_discount >= 0 AND bought_discount < 1.01 GROUP BY 1""")
def payoff_by_discount(m: Market):
    return rounded(trades.payoff_by_discount(trips(m)))


@query("payoff_by_paid", "resales", f"""WITH {TRIPS}
    SELECT CASE WHEN bought_price_ore / 100 < 20000 THEN 'under 20000' WHEN bought_price_ore / 100 < 50000 THEN '20000-49999'
      WHEN bought_price_ore / 100 < 80000 THEN '50000-79999' ELSE '80000+' END AS paid_band, count(*) AS n,
      {r6("count(*) FILTER (sold) / count(*)")} AS sold_share, {r6("median(multiple) FILTER (sold)")} AS med_multiple,
      {r6("median(profit_kr) FILTER (sold)")} AS med_profit_kr FROM trips GROUP BY 1""")
def payoff_by_paid(m: Market):
    return rounded(trades.payoff_by_paid(trips(m), (20000, 50000, 80000)))


@query("sold_by_markup", "resales", f"""WITH {TRIPS}
    SELECT CASE WHEN ask_ore / bought_price_ore < 2 THEN '<2x' WHEN ask_ore / bought_price_ore < 4 THEN '2-4x'
      WHEN ask_ore / bought_price_ore < 8 THEN '4-8x' ELSE '8x+' END AS markup_band, count(*) AS n,
      {r6("count(*) FILTER (sold) / count(*)")} AS sold_share FROM trips GROUP BY 1""")
def sold_by_markup(m: Market):
    return rounded(trades.sold_by_markup(trips(m)))


@query("payoff_by_repriced", "resales", f"""WITH {TRIPS}
    SELECT resale_rungs > 1 AS repriced, count(*) AS n, {r6("count(*) FILTER (sold) / count(*)")} AS sold_share,
      {r6("median(multiple) FILTER (sold)")} AS med_multiple FROM trips GROUP BY 1""")
def payoff_by_repriced(m: Market):
    return rounded(trades.payoff_by_repriced(trips(m)))


@query("resale_status", "resales", f"""WITH {TRIPS}
    SELECT status, count(*) AS n, {r6("avg(days_listed)")} AS avg_days,
      {r6("median(ask_ore / bought_price_ore)")} AS med_ask_multiple FROM trips GROUP BY 1""")
def resale_status(m: Market):
    return rounded(trades.resale_status(trips(m)))


# --- cohort -------------------------------------------------------------------------------------

COHORT_COLUMNS = ("item_id", "p2p", "price_to_estimate", "favourites", "price_ore")
H = "md5(concat('cohort:', item_id))"
QUOTAS = filters.STRATUM_QUOTA
RULES = {
    "resale": "p2p",
    "screen": "price_to_estimate < 0.6 AND favourites >= 5",
    "control_unwanted": "price_to_estimate < 0.6 AND favourites = 0",
    "control_wanted_pricey": "price_to_estimate > 1.0 AND favourites >= 5",
    "premium": "price_ore >= 150000",
    "baseline": "true",
}


def _cohort_sql() -> str:
    parts, done = [], []
    for name, rule in RULES.items():
        earlier = " ".join(f"AND item_id NOT IN (SELECT item_id FROM c_{d})" for d in done)
        parts.append(
            f"c_{name} AS MATERIALIZED (SELECT item_id, '{name}' AS stratum FROM items WHERE outcome IS NULL "
            f"AND {rule} {earlier} ORDER BY {H}, item_id LIMIT {QUOTAS[name]})"
        )
        done.append(name)
    union = " UNION ALL ".join(f"SELECT * FROM c_{d}" for d in done)
    return ", ".join(parts) + f", cohort AS ({union})"


COHORT = _cohort_sql()


def on_shelf(m: Market, *columns: str):
    rows = m.items(*(columns or COHORT_COLUMNS), only="l_linestatus = 'O'")
    return rows.withColumn("on_shelf", F.lit(True))


# What is noted with each stratum here: how many rows it may take, and its part of all.
EXPECT = {name: f"{quota} rows at most, {quota / sum(filters.STRATUM_QUOTA.values()):.3f} of the cohort" for name, quota in filters.STRATUM_QUOTA.items()}


@query("cohort_snapshot", "items", f"""WITH {COHORT}
    SELECT item_id, stratum, CASE stratum {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXPECT.items())} END
      AS expect, DATE '{AS_OF}' AS enrolled_on FROM cohort""")
def cohort_snapshot(m: Market):
    taken = cohort.cohort_snapshot(on_shelf(m), F.lit(AS_OF).cast("date"), EXPECT)
    return taken.select("item_id", "stratum", "expect", "enrolled_on")


def wide_cohort(m: Market):
    """Every listing in a cohort, strata by rule, for the checks that follow."""
    rows = m.items(*COHORT_COLUMNS, "stratum", "status", "first_price_ore", "resolved_on", "first_offered", "has_defect", "is_reserved", "rungs")
    name = F.when(F.col("p2p"), "resale").when(F.col("favourites") >= 25, "screen").otherwise("baseline")
    price = F.when(~F.col("has_defect"), s.to_kr(F.col("price_ore")))
    return rows.withColumn("stratum", name).withColumn("price_kr", price)


CHECKS = """
w AS (SELECT *, CASE WHEN p2p THEN 'resale' WHEN favourites >= 25 THEN 'screen' ELSE 'baseline' END AS s FROM items),
checks AS (SELECT item_id, DATE '2000-01-01' AS checked_on, CASE WHEN rungs <= 3 AND outcome IS NOT NULL THEN
      CASE outcome WHEN 1 THEN 'sold' ELSE 'expired' END ELSE 'still_listed' END AS outcome FROM w
  UNION ALL SELECT item_id, DATE '2000-01-08', 'still_listed' FROM w WHERE is_reserved)
"""


def first_checks(m: Market, rows):
    """One early check of all, and a later one of the reserved listings."""
    known = F.when((F.col("rungs") <= 3) & (F.col("status") != "utlagd"), s.outcome_of(F.col("status")))
    early = rows.select("item_id", F.lit("2000-01-01").cast("date").alias("checked_on"), F.coalesce(known, F.lit("still_listed")).alias("outcome"))
    late = rows.where("is_reserved").select("item_id", F.lit("2000-01-08").cast("date"), F.lit("still_listed"))
    return early.union(late)


@query("cohort_summary", "items", f"""WITH {CHECKS},
    o AS (SELECT item_id, coalesce(max(CASE WHEN outcome IN ('sold', 'expired') THEN outcome END),
      arg_max(outcome, checked_on)) AS o FROM checks GROUP BY 1)
    SELECT s AS stratum, count(*) AS enrolled, count(*) FILTER (NOT has_defect) AS eligible,
      count(*) FILTER (o = 'still_listed') AS listed, count(*) FILTER (o = 'sold') AS sold,
      count(*) FILTER (o = 'expired') AS expired,
      {r6("count(*) FILTER (o = 'sold') / count(*) FILTER (o IN ('sold', 'expired'))")} AS sold_share
    FROM w JOIN o USING (item_id) GROUP BY 1""")
def cohort_summary(m: Market):
    rows = filters.mark_ineligible(wide_cohort(m))
    return rounded(cohort.cohort_summary(rows, first_checks(m, rows)))


@query("cohort_check", "items", f"""WITH {CHECKS},
    open AS (SELECT * FROM w WHERE NOT (rungs <= 3 AND outcome IS NOT NULL)),
    x AS (SELECT *, outcome IS NOT NULL AS gone, outcome IS NOT NULL AND NOT is_reserved AS known FROM open)
    SELECT item_id, CASE WHEN known THEN status END AS status, CASE WHEN NOT gone THEN 'still_listed'
        WHEN NOT known THEN 'error' WHEN outcome = 1 THEN 'sold' ELSE 'expired' END AS outcome,
      CASE WHEN known THEN first_price_ore END AS opening_ask_ore, CASE WHEN known THEN price_ore END AS final_price_ore,
      CASE WHEN known THEN 2::bigint END AS rungs, CASE WHEN known THEN first_offered END AS listed_on,
      CASE WHEN known THEN resolved_on END AS ended_on,
      CASE WHEN known THEN round_even(1 - price_ore / nullif(first_price_ore, 0), 3) + 0.0 END AS decay,
      CASE WHEN known THEN cast(date_diff('day', first_offered, resolved_on) AS int) END AS days_on_market,
      CASE WHEN known THEN [first_price_ore, price_ore] END AS ladder_prices, s AS stratum, DATE '{AS_OF}' AS checked_on FROM x""")
def cohort_check(m: Market):
    """The open cohort items are looked up: gone ones by their status, which reserved ones lack."""
    # Read once and dealt out by the key of every join that follows.
    rows = cut_lineage(wide_cohort(m), by=["item_id"])
    gone = F.col("status") != "utlagd"
    observed = rows.where(~gone)
    status = rows.where(gone & ~F.col("is_reserved")).select("item_id", "status")
    step = F.explode(
        F.array(
            F.struct(F.lit(1).alias("offer_id"), F.col("first_offered").cast("timestamp").alias("created_at"), F.col("first_price_ore").alias("price_ore"), F.lit(None).cast("timestamp").alias("ended_at")),
            F.struct(F.lit(2).alias("offer_id"), F.col("resolved_on").cast("timestamp").alias("created_at"), F.col("price_ore"), F.col("resolved_on").cast("timestamp").alias("ended_at")),
        )
    )
    offers = rows.where(gone).select("item_id", step.alias("o")).select("item_id", "o.*")
    checked = cohort.cohort_check(rows, first_checks(m, rows), observed, offers, status, F.lit(AS_OF).cast("date"))
    return rounded(checked.withColumn("ladder_prices", F.col("ladder.price_ore")).drop("ladder"))


@query("resale_outcomes", "resales", f"""WITH {CHECKS}, {ALL_LADDERS}, {BOUGHT}
    SELECT w.item_id, coalesce(max(CASE WHEN checks.outcome IN ('sold', 'expired') THEN checks.outcome END), 'still_listed') AS outcome,
      any_value(bought_price_ore) AS bought_price_ore, any_value(price_ore) AS final_price_ore,
      CASE WHEN any_value(w.outcome) = 1 AND any_value(rungs_) <= 3 THEN round_even(any_value(price_ore) / nullif(any_value(bought_price_ore), 0), 2) END AS multiple
    FROM (SELECT *, rungs AS rungs_ FROM w) w JOIN checks USING (item_id) JOIN resales r USING (item_id)
    LEFT JOIN b USING (original_id) WHERE s = 'resale' GROUP BY 1""")
def resale_outcomes(m: Market):
    rows = wide_cohort(m)
    checks = first_checks(m, rows).join(rows.select("item_id", F.col("price_ore").alias("final_price_ore")), "item_id")
    return rounded(trades.resale_outcomes(rows, checks, trades.origins(m.resales(), partial(all_ladders, m))))

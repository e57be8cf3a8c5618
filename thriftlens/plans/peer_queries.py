"""Queries on peer position, the gate and the shortlist."""

from __future__ import annotations

from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators import filters, peers, selecting
from thriftlens.operators.slices import peer_rate_pivot
from thriftlens.plans.binding import AS_OF, BAND_EDGES, Market, r6
from thriftlens.plans.registry import query, rounded

MIN_GROUP = 45

# Peer position by window functions, one view per level and the level used.
PLACED = f"""
placed AS (
  SELECT *,
    count(*) OVER (PARTITION BY brand, item_type, condition) AS n1,
    median(price_ore) OVER (PARTITION BY brand, item_type, condition) AS m1,
    percent_rank() OVER (PARTITION BY brand, item_type, condition ORDER BY price_ore) AS p1,
    count(*) OVER (PARTITION BY brand, category) AS n2,
    median(price_ore) OVER (PARTITION BY brand, category) AS m2,
    percent_rank() OVER (PARTITION BY brand, category ORDER BY price_ore) AS p2,
    count(*) OVER (PARTITION BY brand_tier, item_type) AS n3,
    median(price_ore) OVER (PARTITION BY brand_tier, item_type) AS m3,
    percent_rank() OVER (PARTITION BY brand_tier, item_type ORDER BY price_ore) AS p3
  FROM shelf),
peers AS (
  SELECT *, CASE peer_level WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END AS peer_n,
    CASE peer_level WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END AS peer_median_ore,
    CASE peer_level WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS peer_pct
  FROM (SELECT *, CASE WHEN n1 >= {MIN_GROUP} THEN 1 WHEN n2 >= {MIN_GROUP} THEN 2
                       WHEN n3 >= {MIN_GROUP} THEN 3 END AS peer_level FROM placed)
  WHERE peer_level IS NOT NULL),
scored AS (
  SELECT *, CASE WHEN peer_median_ore > 0
    THEN round_even((1 - price_ore / peer_median_ore) * 100, 2) END AS discount_pct FROM peers)
"""

SHELF = ("item_id", "brand", "brand_tier", "item_type", "category", "condition", "price_ore")


def cascade(m: Market, *extra: str):
    shelf = m.shelf(*dict.fromkeys([*SHELF, *extra]))
    return peers.peer_cascade(shelf, min_group=MIN_GROUP, keep=extra)


def scored(m: Market, *extra: str):
    rows = cascade(m, "brand", *extra)
    return rows.withColumn("discount_pct", s.discount_pct(F.col("price_ore"), F.col("peer_median_ore")))


@query("peer_score_level1", "shelf", f"""
    SELECT item_id, price_ore, count(*) OVER w AS peer_n,
      {r6("median(price_ore) OVER w")} AS peer_median_ore,
      {r6("percent_rank() OVER (PARTITION BY brand, item_type, condition ORDER BY price_ore)")}
        AS peer_pct
    FROM shelf WINDOW w AS (PARTITION BY brand, item_type, condition)""")
def peer_score_level1(m: Market):
    shelf = m.shelf("item_id", "brand", "item_type", "condition", "price_ore")
    placed = peers.peer_score(shelf, peers.PEER_LEVELS[0])
    return rounded(placed.select("item_id", "price_ore", "peer_n", "peer_median_ore", "peer_pct"))


@query("peer_cascade", "shelf", f"""WITH {PLACED}
    SELECT item_id, price_ore, peer_level, peer_n, {r6("peer_median_ore")} AS peer_median_ore,
      {r6("peer_pct")} AS peer_pct FROM peers""")
def peer_cascade(m: Market):
    return rounded(cascade(m))


@query("undervalued_shortlist", "shelf", f"""WITH {PLACED},
    gated AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY discount_pct DESC, item_id) AS k
      FROM scored WHERE price_ore >= 20000 AND peer_n >= 12 AND peer_level <= 2 AND peer_pct <= 0.25)
    SELECT item_id, brand, price_ore, peer_level, peer_n, {r6("peer_median_ore")} AS peer_median_ore,
      {r6("peer_pct")} AS peer_pct, discount_pct,
      cast(row_number() OVER (ORDER BY discount_pct DESC, item_id) AS int) AS rank
    FROM gated WHERE k <= 15 ORDER BY discount_pct DESC, item_id LIMIT 500""")
def undervalued_shortlist(m: Market):
    best = selecting.shortlist(filters.shortlist_gate(scored(m)))
    return rounded(best)


@query("gate_funnel", "shelf", f"""WITH {PLACED}, c AS (
      SELECT count(*) AS a0, count(*) FILTER (price_ore >= 4000000) AS a1,
        count(*) FILTER (price_ore >= 4000000 AND peer_n >= 12 AND peer_level <= 2) AS a2,
        count(*) FILTER (price_ore >= 4000000 AND peer_n >= 12 AND peer_level <= 2
          AND peer_pct <= 0.25) AS a3 FROM peers)
    SELECT 0 AS step, 'all' AS gate, a0 AS survivors, 1.0::double AS rate FROM c
    UNION ALL SELECT 1, 'price_floor', a1, {r6("a1 / a0")} FROM c
    UNION ALL SELECT 2, 'peer_group', a2, {r6("a2 / a1")} FROM c
    UNION ALL SELECT 3, 'cheapest_quarter', a3, {r6("a3 / a2")} FROM c""")
def gate_funnel(m: Market):
    return rounded(filters.funnel(cascade(m), filters.gate_predicates(min_price_ore=4000000)))


@query("peer_freeze", "items", f"""WITH
    gone AS (SELECT item_id FROM items WHERE is_reserved),
    shelf AS (SELECT * FROM items WHERE outcome IS NULL AND stratum IN ('A', 'B', 'N')), {PLACED}
    SELECT i.item_id, CASE WHEN i.outcome IS NULL AND g.item_id IS NOT NULL THEN 1 ELSE i.outcome END
        AS outcome,
      CASE WHEN g.item_id IS NOT NULL THEN {r6("peer_pct")} END AS peer_pct_frozen,
      CASE WHEN g.item_id IS NOT NULL THEN {r6("peer_median_ore")} END AS peer_median_ore_frozen,
      CASE WHEN g.item_id IS NOT NULL THEN p.peer_n END AS peer_n_frozen,
      CASE WHEN g.item_id IS NOT NULL THEN p.peer_level END AS peer_level_frozen,
      CASE WHEN g.item_id IS NOT NULL AND p.peer_n IS NOT NULL THEN DATE '{AS_OF}' END AS peer_frozen_on
    FROM items i LEFT JOIN gone g USING (item_id) LEFT JOIN peers p USING (item_id)""")
def peer_freeze(m: Market):
    """The reserved listings sell between two passes; they keep the place they had on the shelf."""
    rows = peers.unfrozen(m.items("item_id", "outcome", "is_reserved"))
    sold = F.when(F.col("outcome").isNull() & F.col("is_reserved"), 1)
    resolved = rows.withColumn("outcome", F.coalesce("outcome", sold)).drop("is_reserved")
    return rounded(peers.freeze_peers(resolved, cascade(m), F.lit(AS_OF).cast("date")))


@query("peer_quartile_pivot", "items", f"""WITH
    shelf AS (SELECT * FROM items WHERE stratum IN ('A', 'B', 'N')), {PLACED},
    cells AS (SELECT CASE WHEN peer_pct <= 0.25 THEN 'cheapest quarter' WHEN peer_pct <= 0.5 THEN
        'below median' WHEN peer_pct <= 0.75 THEN 'above median' ELSE 'priciest quarter' END AS q,
      CASE WHEN price_ore < 2000000 THEN 0 WHEN price_ore < 4000000 THEN 1 WHEN price_ore < 6000000
        THEN 2 WHEN price_ore < 8000000 THEN 3 ELSE 4 END AS b, outcome FROM peers)
    SELECT q AS peer_quartile,
      {", ".join(r6(f"count(*) FILTER (b = {b} AND outcome = 1) / nullif(count(*) FILTER (b = {b}), 0)")
                 + f" AS band_{b}" for b in range(5))}
    FROM cells GROUP BY q""")
def peer_quartile_pivot(m: Market):
    rows = filters.analysis_rows(m.items(*SHELF, "outcome", "stratum"))
    placed = peers.peer_cascade(rows.select(*SHELF), min_group=MIN_GROUP)
    return rounded(peer_rate_pivot(rows, placed, BAND_EDGES))

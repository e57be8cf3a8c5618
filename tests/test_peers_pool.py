import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from thriftlens.operators import filters, peers, pool, selecting
from thriftlens.session import cut_lineage

random.seed(3)
BRANDS = ["hot"] * 6 + ["a", "b", "rare"]
SHELF = [
    (f"i{n:04d}", b, {"hot": 1, "a": 2}.get(b), random.choice("xy"), random.choice("pq"), random.choice("mn"), random.randrange(1, 400) * 500)
    for n, b in enumerate(random.choice(BRANDS) for _ in range(900))
]
SCHEMA = "item_id string, brand string, brand_tier int, item_type string, category string, condition string, price_ore long"
# Positions of the keys of each level in a row.
KEYS = {1: (1, 3, 5), 2: (1, 4), 3: (2, 3)}


@pytest.fixture(scope="module")
def shelf(spark):
    return spark.createDataFrame(SHELF, SCHEMA)


def place(row, min_group):
    for level, keys in KEYS.items():
        key = [row[i] for i in keys]
        if None in key:
            continue
        prices = sorted(r[6] for r in SHELF if [r[i] for i in keys] == key)
        if len(prices) >= min_group:
            n = len(prices)
            median = (prices[(n - 1) // 2] + prices[n // 2]) / 2
            below = sum(p < row[6] for p in prices)
            return level, n, median, below / (n - 1)
    return None


@pytest.mark.parametrize("min_group", [8, 90, 10**6])
def test_cascade_is_brute_force(shelf, min_group):
    got = {r.item_id: (r.peer_level, r.peer_n, r.peer_median_ore, r.peer_pct) for r in peers.peer_cascade(shelf, min_group=min_group).collect()}
    want = {r[0]: p for r in SHELF if (p := place(r, min_group))}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w)


def test_lone_item_is_the_cheapest_of_its_kind(spark):
    row = spark.createDataFrame([("i", "b", 1, "t", "c", "m", 5)], SCHEMA)
    r = peers.peer_cascade(row, min_group=1).first()
    assert (r.peer_n, r.peer_median_ore, r.peer_pct) == (1, 5.0, 0.0)


def test_freeze_is_written_once(spark):
    items = peers.unfrozen(spark.createDataFrame([("live", None), ("sold", 1)], "item_id string, outcome int"))
    schema = "item_id string, peer_level int, peer_n long, peer_median_ore double, peer_pct double"
    first = spark.createDataFrame([("live", 1, 20, 100.0, 0.1), ("sold", 2, 30, 200.0, 0.2)], schema)
    later = spark.createDataFrame([("live", 1, 21, 101.0, 0.5), ("sold", 1, 99, 999.0, 0.9)], schema)
    day = F.lit("2026-08-08").cast("date")
    once = peers.freeze_peers(items, first, day)
    twice = peers.freeze_peers(once, later, F.lit("2026-08-10").cast("date"))
    got = {r.item_id: r for r in twice.collect()}
    assert got["sold"].peer_pct_frozen == 0.2 and got["sold"].peer_frozen_on == dt.date(2026, 8, 8)
    assert got["live"].peer_pct_frozen is None and got["live"].peer_frozen_on is None


def test_funnel_is_monotone(shelf):
    placed = peers.peer_cascade(shelf, min_group=8)
    steps = filters.funnel(placed, filters.gate_predicates()).orderBy("step").collect()
    counts = [r.survivors for r in steps]
    assert counts == sorted(counts, reverse=True)
    assert counts[-1] == filters.shortlist_gate(placed).count()


def test_shortlist_caps_brands(shelf):
    placed = peers.peer_cascade(shelf, min_group=8).join(shelf.select("item_id", "brand"), "item_id")
    scored = placed.withColumn("discount_pct", 100 - F.col("peer_pct") * 100)
    best = selecting.shortlist(scored, 20, 9).collect()
    per = {}
    for r in best:
        per[r.brand] = per.get(r.brand, 0) + 1
    assert max(per.values()) <= 9 and sorted(r["rank"] for r in best) == list(range(1, len(best) + 1))


def test_bucket_refresh_reclaims_rows_without_a_bucket(spark, shelf):
    market = shelf.withColumn("bucket", F.when(F.col("brand") == "hot", 0).otherwise(1))
    day = F.lit("2026-08-13").cast("date")
    schema = "item_id string, brand string, bucket int, discount_pct double, swept_on date"
    old = dt.date(2026, 8, 11)
    hot = next(r[0] for r in SHELF if r[1] == "hot")
    held = spark.createDataFrame([("orphan", "z", None, 1.0, old), ("kept", "a", 1, 2.0, old), (hot, "hot", 1, 3.0, old), ("stale", "hot", 0, 4.0, old)], schema)
    out = pool.refresh_bucket(held, market, 0, day, min_price_ore=0).collect()
    ids = [r.item_id for r in out]
    assert len(ids) == len(set(ids))
    assert "kept" in ids and "orphan" not in ids and "stale" not in ids
    fresh = [r for r in out if r.bucket == 0]
    assert fresh and all(r.swept_on == dt.date(2026, 8, 13) for r in fresh)
    again = pool.refresh_bucket(spark.createDataFrame(out, schema), market, 0, day, min_price_ore=0).collect()
    assert sorted(again) == sorted(out)


def test_bucket_invariants(shelf):
    kept = pool.score_bucket(shelf, min_price_ore=0).collect()
    assert kept and all(r.peer_n >= 12 and r.peer_pct <= 0.25 and r.peer_level <= 2 for r in kept)


def test_thin_brand_makes_no_group(spark):
    few = spark.createDataFrame([(f"i{i}", "thin", 1, "t", "c", "m", i + 1) for i in range(7)], SCHEMA)
    assert pool.score_bucket(few, min_group=1, min_price_ore=0, min_peer_n=1).count() == 0


def test_reprice_keeps_the_sweep(spark):
    schema = "item_id string, price_kr long, peer_median_kr double, swept_on date"
    d = dt.date(2026, 8, 9)
    held = spark.createDataFrame([("moved", 300, 400.0, d), ("gone", 300, 400.0, d), ("zero", 300, 0.0, d), ("unpriced", 300, 400.0, d)], schema)
    seen = spark.createDataFrame([("moved", 19999), ("zero", 30000), ("unpriced", None)], "item_id string, price_ore long")
    got = {r.item_id: r for r in pool.reprice_pool(held, seen, F.lit("2026-08-12").cast("date")).collect()}
    assert (got["moved"].price_kr, got["moved"].discount_pct, got["moved"].repriced) == (199, 50.25, True)
    assert not got["gone"].still_listed and got["gone"].price_kr == 300
    assert got["zero"].discount_pct is None and got["unpriced"].price_kr == 300
    assert {r.swept_on for r in got.values()} == {d} and {r.as_of for r in got.values()} == {dt.date(2026, 8, 12)}


def test_daily_refresh_takes_images_where_observed(spark):
    held = spark.createDataFrame([("a", 300, 400.0), ("b", 300, 400.0)], "item_id string, price_kr long, peer_median_kr double")
    seen = spark.createDataFrame([("a", 30000, ["https://img.example.net/x.jpg"])], "item_id string, price_ore long, images array<string>")
    got = {r.item_id: r for r in pool.refresh_pool(held, seen, F.lit("2026-08-12").cast("date"), ["https://img.example.net/"]).collect()}
    assert got["a"].image_paths == ["x.jpg"] and got["a"].still_listed and not got["a"].repriced
    assert got["b"].image_paths is None and not got["b"].still_listed


def test_only_the_groups_that_place_rows_are_counted(shelf):
    """What no row is placed in needs no positions; what a thin group falls back to is counted with all its rows."""
    levels = peers.PEER_LEVELS
    found = {r[:5]: r for r in peers.group_places(shelf, levels, 20).collect()}
    names = ("brand", "item_type", "condition", "category", "brand_tier")
    first = {}
    for row in SHELF:
        at = dict(zip(("item_id", "brand", "brand_tier", "item_type", "category", "condition"), row))
        first[tuple(at[n] for n in names)] = place(row, 20)[:2] if place(row, 20) else None
    assert {k: (r.peer_level, r.peer_n) for k, r in found.items()} == {k: v for k, v in first.items() if v}
    assert {len(r["_counted"]) for k, r in found.items() if k[0] == "hot"} == {1}


@pytest.mark.parametrize(("min_group", "max_pct"), [(8, 0.25), (90, 0.25), (8, 0.0), (8, 1.0), (8, -1.0)])
def test_rows_beyond_the_bound_are_left_out_and_no_others(shelf, min_group, max_pct):
    bounded = peers.peer_cascade(shelf, min_group=min_group, keep=["brand"], max_pct=max_pct)
    whole = peers.peer_cascade(shelf, min_group=min_group, keep=["brand"]).where(F.col("peer_pct") <= max_pct)
    assert sorted(map(tuple, bounded.collect())) == sorted(map(tuple, whole.collect()))


def test_a_staged_shelf_is_not_written_again(shelf, monkeypatch):
    def shortlisted(**options):
        written = []
        for module in (peers, pool):
            monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
        rows = pool.build_shortlist(full, F.lit("2026-08-11").cast("date"), min_live=1, min_price_ore=0, **options)
        return sorted(map(tuple, rows.collect()), key=repr), ["stratum" in columns for columns in written]

    full = shelf.selectExpr(
        "*", "'x' AS demography", "concat('WMN-EU-', price_ore % 3) AS size_code", "price_ore AS first_price_ore", "1 AS favourites", "0 AS first_favourites",
        "1 AS weight_g", "false AS has_defect", "false AS p2p", "DATE '2026-08-01' AS first_offered", "cast(null AS int) AS outcome",
        "cast(null AS date) AS resolved_on", "'A' AS stratum",
    )
    (rows, once), (same, never) = shortlisted(), shortlisted(staged=True)
    assert rows == same and len(rows) > 20
    assert sum(once) == 1 and not any(never)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thriftlens.operators import board, brands

random.seed(5)
ROWS = [(f"i{n}", random.choice(["u", "v", "w"]), random.choice("pq"), None, random.randrange(100, 900)) for n in range(1500)]
ROWS = [(i, a, b, 1 if random.random() < {"u": 0.1, "v": 0.3, "w": 0.6}[a] else None, p + 500 * (b == "p")) for i, a, b, _, p in ROWS]
DAY = "2026-08-08"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, "item_id string, a string, b string, outcome int, price_ore long")


def features():
    return {"a": F.col("a"), "b": F.col("b"), "price_band": F.lit("0"), "one": F.lit("x")}


def test_cramers_v(items):
    got = {r.feature: r for r in board.predictor_board(items, features(), F.lit(DAY).cast("date"), "sale", 50).collect()}
    for name, pos in (("a", 1), ("b", 2)):
        table = np.array([[sum(r[pos] == x and (r[3] == 1) == s for r in ROWS) for s in (True, False)] for x in sorted({r[pos] for r in ROWS})])
        expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
        chi2 = ((table - expected) ** 2 / expected).sum()
        assert got[name].strength == pytest.approx(np.sqrt(chi2 / table.sum()))
    rates = [np.mean([r[3] == 1 for r in ROWS if r[1] == x]) for x in "uvw"]
    assert got["a"].lift == pytest.approx(np.quantile(rates, 0.9) / np.quantile(rates, 0.1))
    assert (got["a"].best_bucket, got["a"].worst_bucket) == ("w", "u")
    assert (got["one"].strength, got["one"].lift, got["one"].buckets) == (0.0, 1.0, 1)


def test_eta_squared(items):
    got = {r.feature: r for r in board.predictor_board(items, features(), F.lit(DAY).cast("date"), "price", 50).collect()}
    assert "price_band" not in got
    y = np.array([r[4] for r in ROWS], float)
    for name, pos in (("a", 1), ("b", 2)):
        between = sum(len(g) * (g.mean() - y.mean()) ** 2 for x in {r[pos] for r in ROWS} for g in [np.array([r[4] for r in ROWS if r[pos] == x])])
        assert got[name].strength == pytest.approx(between / ((y - y.mean()) ** 2).sum())


def test_thin_buckets_are_dropped(items):
    out = board.predictor_board(items, {"id": F.col("item_id"), "a": F.col("a")}, F.lit(DAY).cast("date"), "sale", 50)
    assert [r.feature for r in out.collect()] == ["a"]


def test_unknown_target(items):
    with pytest.raises(ValueError):
        board.predictor_board(items, features(), F.lit(DAY), "likes")


def test_attention_of_an_average_brand_is_one(spark):
    rows = [(b, "t", 10000, likes, "2026-08-01") for b, likes in (("x", 10), ("y", 10)) for _ in range(40)]
    rows += [("thin", "odd", 10000, 30, "2026-08-01")] * 5
    live = spark.createDataFrame(rows, "brand string, item_type string, price_ore long, favourites int, first_offered string")
    live = live.withColumn("first_offered", F.col("first_offered").cast("date"))
    got = {r.brand: r for r in brands.attention_index(live, F.lit(DAY).cast("date")).collect()}
    assert got["x"].attention_index == pytest.approx(1.0)
    # The thin garment is compared with its price band and age: (800 + 150) likes over 85 listings.
    assert got["thin"].expected_favourites == pytest.approx(950 / 85)


def test_trend_needs_two_snapshots_far_enough_apart(spark):
    schema = "brand string, as_of string, listings long, attention_index double"
    near = spark.createDataFrame([("x", "2026-08-08", 200, 1.0), ("x", "2026-08-06", 200, 1.0)], schema)
    near = near.withColumn("as_of", F.col("as_of").cast("date"))
    assert brands.brand_trend(near).count() == 0
    far = near.unionByName(spark.createDataFrame([("x", "2026-07-30", 150, 0.5)], schema).withColumn("as_of", F.col("as_of").cast("date")))
    r = brands.brand_trend(far).first()
    assert (r.days_apart, r.listings_change, r.attention_change) == (9, 50, 0.5)


def test_demand_is_drawn_toward_one(spark):
    rows = [("big", 10)] * 200 + [("tiny", 1000)] * 2
    df = spark.createDataFrame(rows, "brand string, favourites int")
    got = {r.brand: r.demand_index for r in brands.brand_demand(df).collect()}
    mean = (200 * 10 + 2000) / 202
    assert got["tiny"] == pytest.approx((2 * 1000 / mean + 10) / 12)


def test_change_and_outcome_are_never_of_the_same_pass(spark):
    rows = [("a", 1, 100, 0), ("a", 2, 90, 0), ("a", 3, 90, 1), ("b", 1, 100, 0), ("b", 2, 100, 0), ("b", 3, 80, 0)]
    seen = spark.createDataFrame(rows, "item_id string, pass_on int, price_ore long, sold int").withColumn("favourites", F.lit(0))
    out = brands.lagged_effect(seen, F.col("price_ore") < F.col("prev_price_ore"), F.col("sold") == 1)
    assert {r.changed_before: (r.n, r.hits) for r in out.collect()} == {True: (1, 1), False: (1, 0)}

"""The order primitives against brute force, on groups of which one holds most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from thriftlens.operators import spread

random.seed(7)
ROWS = [("hot" if random.random() < 0.6 else f"k{random.randrange(5)}", i, random.choice([-5, 0, 3, 3, 3, random.randrange(-9000, 90000)])) for i in range(3000)]
ROWS += [("single", 9001, 42), ("nulls", 9002, None), ("hot", 9003, None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k string, id long, v long").repartition(7)


def groups():
    out = {}
    for k, _, v in ROWS:
        if v is not None:
            out.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in out.items()}


def test_value_positions(df):
    got = {(r.k, r.v): (r.n_equal, r.n_below, r.n_group) for r in spread.value_positions(df, ["k"], "v").collect()}
    want = {(k, v): (vs.count(v), sum(x < v for x in vs), len(vs)) for k, vs in groups().items() for v in set(vs)}
    assert got == want


def test_positions_median(df):
    medians = spread.positions_median(spread.value_positions(df, ["k"], "v"), ["k"], "v")
    assert {r.k: r.median for r in medians.collect()} == {k: statistics.median(v) for k, v in groups().items()}


def test_group_quantiles(df):
    out = spread.group_quantiles(df, ["k"], {"v": "v", "half": F.col("v") / 2}, {"p10": 0.1, "med": 0.5, "p90": 0.9})
    for r in out.collect():
        vs = groups()[r.k]
        for name, q in (("p10", 0.1), ("med", 0.5), ("p90", 0.9)):
            at = (len(vs) - 1) * q
            low = int(at)
            want = vs[low] + (vs[min(low + 1, len(vs) - 1)] - vs[low]) * (at - low)
            assert r[f"{name}_v"] == pytest.approx(want)
            assert r[f"{name}_half"] == pytest.approx(want / 2)


def test_group_quantiles_with_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 5)], "k string, v long")
    assert {r.k: r.med_v for r in spread.group_quantiles(df, ["k"], {"v": "v"}).collect()} == {None: 2.0, "a": 5.0}


def test_discrete_quantiles(df):
    out = spread.group_quantiles(df, ["k"], {"v": "v"}, {"p90": 0.9, "top": 1.0}, discrete=True)
    for r in out.collect():
        vs = groups()[r.k]
        assert (r.p90_v, r.top_v) == (vs[int(len(vs) * 0.9)], vs[-1])


def test_value_cell_never_falls(spark):
    values = sorted({random.randrange(-(10**9), 10**9) for _ in range(2000)} | {-1, 0, 1}) + [10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long").orderBy("v")
    cells = [r.c for r in df.select("v", spread.value_cell(F.col("v")).alias("c")).orderBy("v").collect()]
    assert cells == sorted(cells)


def test_numbered_and_neighbours(df):
    cell = F.floor(F.col("id") / 100)
    out = spread.with_neighbours(df, ["k"], ["id"], cell, ["v"]).collect()
    want = {}
    for k, i, v in sorted(ROWS, key=lambda r: r[1]):
        want.setdefault(k, []).append((i, v))
    for r in out:
        chain = want[r.k]
        assert chain[r.n - 1][0] == r.id
        before = chain[r.n - 2] if r.n > 1 else None
        after = chain[r.n] if r.n < len(chain) else None
        assert (r.prev and (r.prev.id, r.prev.v)) == before
        assert (r.next and (r.next.id, r.next.v)) == after
    again = spread.numbered(df, ["k"], ["id"], cell, "pos").collect()
    assert {(r.k, r.id): r.pos for r in again} == {(r.k, r.id): r.n for r in out}


def test_last_before(df):
    cell = F.floor(F.col("id") / 100)
    marked = df.withColumn("m", F.when(F.col("v") == 3, F.col("id")))
    got = {(r.k, r.id): r.last for r in spread.with_last_before(marked, ["k"], ["id"], cell, "m", "last").collect()}
    last = {}
    for k, i, v in sorted(ROWS, key=lambda r: r[1]):
        assert got[(k, i)] == last.get(k)
        if v == 3:
            last[k] = i


def test_pick_first_limits_before_the_shuffle(df):
    picked = spread.pick_first(df, ["k"], [F.col("id")], 3)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted(r.id for r in picked.where("k = 'hot'").collect()) == sorted(i for k, i, _ in ROWS if k == "hot")[:3]


def test_with_row_is_a_scalar_subquery(df):
    out = spread.with_row(df, df.agg(F.max("id").alias("top")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert {r.top for r in out.collect()} == {9003}


def test_last_before_for_some_rows_only(spark):
    """Rows that do not ask offer their value and are left out; a null key is a group, a null cell the first."""
    random.seed(5)
    rows = [(random.choice(["a", "b", None]), i if i > 3 else None, i, f"v{i}" if i % 3 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v string")
    cell = F.floor(F.col("o") / 7)
    found = spread.with_last_before(df, ["k"], ["o", "i"], cell, F.upper("v"), "last", only=F.col("i") % 5 == 0)
    assert found.columns == ["k", "o", "i", "v", "last"]
    want = {}
    for k in ("a", "b", None):
        last = None
        for _, _, i, v in (r for r in rows if r[0] == k):
            if i % 5 == 0:
                want[i] = last
            last = v.upper() if v else last
    assert {r.i: r.last for r in found.collect()} == want


def test_last_before_shuffles_its_rows_once(spark):
    """Cells are made and joined where the rows lie: before, six shuffles stood in this plan."""
    df = spark.range(100).selectExpr("id % 7 AS k", "id", "id AS v")
    found = spread.with_last_before(df, ["k"], ["id"], F.floor(F.col("id") / 9), "v", "last")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(struct(") + plan.count("Exchange hashpartitioning(_at") <= 3


def test_nearly_among_loses_no_key(spark):
    """Every wanted row passes, and of the others hardly any."""
    df = spark.range(20000).selectExpr("cast(id AS string) AS a", "id").union(spark.sql("SELECT cast(null AS string), -1L"))
    wanted = spark.range(0, 40000, 8).selectExpr("cast(id AS string) AS w").union(spark.sql("SELECT cast(null AS string)"))
    got = [r.id for r in spread.nearly_among(df, "a", wanted, "w").collect()]
    assert len(got) == len(set(got)) <= 2510 and set(range(0, 20000, 8)) <= set(got) and -1 not in got

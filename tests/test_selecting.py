"""The first rows of an order, found by counting cells of the hash."""

import hashlib

import pytest
from pyspark.sql import functions as F

from thriftlens.operators import selecting


def md5(x, seed):
    return hashlib.md5(f"{seed}:{x}".encode()).hexdigest()


def in_order(keys, seed):
    return sorted(keys, key=lambda x: (md5(x, seed), x))


def test_second_read_keeps_few_rows(spark):
    """Of a million rows the filter lets hardly more pass than the thousand that are wanted."""
    rows = spark.range(1_000_000).select(F.col("id").cast("string").alias("item_id"))
    cell = selecting.hash_cell(selecting.hash_order(F.col("item_id"), 7))
    near = selecting.smallest_cells(rows, 1_000, cell)
    assert 1_000 <= near.count() < 1_300
    sample = selecting.seeded_sample(rows, "item_id", 1_000, 7)
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 1000" in plan and "_cell" in plan
    assert [r.item_id for r in sample.collect()] == in_order(map(str, range(1_000_000)), 7)[:1_000]


@pytest.mark.parametrize("n", [1, 17, 999, 1_000, 5_000])
def test_first_by_hash_is_exact(spark, n):
    keys = [f"k{i}" for i in range(1_000)]
    df = spark.createDataFrame([(k,) for k in keys], "item_id string").repartition(5)
    got = selecting.first_by_hash(df, n, "N").collect()
    assert sorted(r.item_id for r in got) == sorted(in_order(keys, "N")[:n])
    assert selecting.first_by_hash(df.limit(0), n, "N").count() == 0


def test_repeated_keys_share_a_cell(spark):
    df = spark.createDataFrame([("same",)] * 50 + [(f"k{i}",) for i in range(50)], "item_id string")
    for n in (3, 40, 60, 99, 100):
        got = sorted(r.item_id for r in selecting.first_by_hash(df, n, "x").collect())
        assert got == sorted(in_order(["same"] * 50 + [f"k{i}" for i in range(50)], "x")[:n])


def test_first_per_group(spark):
    """Groups of very different size, a null among them, each with a quota of its own."""
    rows = [("hot", f"h{i}", 40) for i in range(4_000)] + [(None, f"n{i}", 7) for i in range(30)] + [("thin", f"t{i}", 5) for i in range(3)]
    df = spark.createDataFrame(rows, "brand string, item_id string, quota int").repartition(6)
    got = selecting.first_per_group(df, ["brand", "quota"], F.col("quota"), "s", name="nth").collect()
    for brand, quota in (("hot", 40), (None, 7), ("thin", 5)):
        want = in_order([k for b, k, _ in rows if b == brand], "s")[:quota]
        assert [r.item_id for r in sorted(got, key=lambda r: r.nth) if r.brand == brand] == want


def test_cells_follow_the_hash(spark):
    hashes = sorted(md5(i, "") for i in range(3_000)) + ["f" * 32]
    df = spark.createDataFrame([("0" * 32,)] + [(h,) for h in hashes], "h string")
    cells = [r.c for r in df.orderBy("h").select(selecting.hash_cell(F.col("h")).alias("c")).collect()]
    assert cells == sorted(cells) and cells[0] == 0 and cells[-1] <= 52 * selecting.HASH_CELLS_PER_OCTAVE


def test_strata_are_not_shuffled_by_stratum(spark, monkeypatch):
    """The rows meet the last cells of the few strata where they are read: no stratum's rows go to one task."""
    rows = spark.range(3_000).select(F.col("id").cast("string").alias("item_id"), (F.col("id") % 3).alias("k"))
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = selecting.cut_lineage
    monkeypatch.setattr(selecting, "cut_lineage", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = selecting.assign_strata(rows, {"a": F.col("k") == 0, "b": F.lit(True)}, {"a": 5, "b": 7}).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]
    order = sorted((hashlib.md5(f"cohort:{i}".encode()).hexdigest(), i) for i in range(3_000))
    first = [str(i) for _, i in order if i % 3 == 0][:5]
    rest = [str(i) for _, i in order if str(i) not in first][:7]
    assert {(r.item_id, r.stratum) for r in got} == {(i, "a") for i in first} | {(i, "b") for i in rest}

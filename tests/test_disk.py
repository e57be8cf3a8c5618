"""What stays on disk between the steps of a query, and what is shuffled to find few matches."""

import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from thriftlens.operators import ladders, spread
from thriftlens.plans import board_queries, sample_queries, trade_queries
from thriftlens.plans.binding import Market
from thriftlens.session import cut_lineage, shared_dir

DAY = dt.datetime(1996, 1, 1)


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Eighty line items of ten products and some that come twice, lack a key, or have no order."""
    d = tmp_path_factory.mktemp("market")
    line = [
        (i // 4, i % 10, 10 * (i % 3) + (i % 40 < 30), i % 7 + 1, float(i % 50 + 1), 1000.0 + i, i % 11 / 100, i % 9 / 100, "NAR"[i % 3], "OF"[i % 2], DAY + dt.timedelta(3 * i))
        for i in range(80)
    ]
    line += [line[0], line[12], line[12], (5, None, 20, 1, 1.0, 9.0, 0.0, 0.0, "N", "O", DAY), (999, 3, 20, 1, 1.0, 9.0, 0.0, 0.0, "N", "O", DAY)]
    names = "orderkey long, partkey long, suppkey long, linenumber int, quantity double, extendedprice double, discount double, tax double, returnflag string, linestatus string, shipdate timestamp"
    orders = [(i, i % 5, f"{i % 5 + 1}-X", DAY + dt.timedelta(10 * i)) for i in range(20)]
    parts = [(i, f"colour{i % 3} kind{i % 4} x", f"Brand#{11 + i}", f"TYPE {i % 2}", i, 900.0 + i / 100) for i in range(10)]
    tables = {
        "lineitem": (line, ", ".join(f"l_{n}" for n in names.split(", "))),
        "orders": ([*orders, orders[3]], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp"),
        "part": ([*parts, parts[2]], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "customer": ([(i, f"SEGMENT {i}") for i in range(5)], "c_custkey long, c_mktsegment string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return Market(spark, str(d))


def on_disk(spark):
    """Names of Spark's shuffle files, and of what stands in the shared folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    shuffles = {f for f in files if "/shuffle_" in f}
    return shuffles, {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}


def left_by(spark, step):
    """What ``step`` leaves: shuffle files, which go a moment after their query, and tables."""
    shuffles, tables = on_disk(spark)
    step()
    until = time.time() + 10
    while (left := on_disk(spark)[0] - shuffles) and time.time() < until:
        time.sleep(0.2)
    return left, on_disk(spark)[1] - tables


def test_offer_documents_leave_nothing_but_documents(spark, market, rows):
    """Before, the shuffles of all joins lay there while the documents were read."""
    found = []
    left, tables = left_by(spark, lambda: found.append(trade_queries.offer_documents(market)))
    assert not left and [t.split("-")[0] for t in tables] == ["offers"]
    items = market.items("item_id", "first_price_ore", "price_ore", "first_offered", "resolved_on", "status", "dwell_days", "brand")
    whole = trade_queries.offer_lines(items.join(market.resales(), "item_id", "left")).toDF("line")
    want = spark.read.schema(found[0].schema).json(whole.rdd.map(lambda r: r.line))
    assert rows(found[0]) == rows(want) and len(rows(want)) > 100


def test_trips_shuffle_the_steps_they_name(spark, market, monkeypatch):
    """Before, the ladders of all listings were made to join those of a few."""
    seen = []
    whole = ladders.ladder_rows
    monkeypatch.setattr(ladders, "ladder_rows", lambda steps, details, *a: seen.append({r.item_id for r in steps.collect()}) or whole(steps, details, *a))
    trips = trade_queries.document_trips(market).collect()
    named = {i for r in trips for i in (r.item_id, r.original_id)}
    every = {r.item_id for r in market.items("item_id", "brand", "first_offered").collect()}
    assert named and named <= seen[0] and len(seen[0]) < len(every)


def test_listing_rows_are_not_shuffled_to_meet_small_tables(spark, market):
    """Before, each of three masks and seven kinds of the dictionary shuffled all listings once."""
    found = []
    left, _ = left_by(spark, lambda: found.append(sample_queries.listing_documents(market)))
    assert not left
    plan = sample_queries.listing_rows(market)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 10


def test_analytics_pass_leaves_its_result_only(spark, market):
    """Before, the first day's items stayed as a table beside the result, and the shuffles that made it."""
    left, tables = left_by(spark, lambda: board_queries.analytics_pass(market))
    assert not left and [t.split("-")[0] for t in tables] == ["pass"]


@pytest.mark.parametrize("few", ["k string, v long, w date", "k string, v long, w date, x array<int>"])
def test_left_join_near_is_a_left_join(spark, rows, few):
    df = spark.createDataFrame([(i, f"k{i % 40}" if i % 9 else None, i) for i in range(200)] + [(1, "k1", 1)], "i int, k string, n long")
    hits = spark.createDataFrame([(f"k{i}", i, None, [i])[: few.count(",") + 1] for i in (3, 3, 5, 77)] + [(None, 9, None, None)[: few.count(",") + 1]], few)
    joined = spread.left_join_near(df, hits, "k")
    want = df.join(hits, "k", "left")
    assert joined.columns == want.columns and joined.dtypes == want.dtypes and rows(joined) == rows(want)
    nothing = hits.limit(0)
    assert rows(spread.left_join_near(df, nothing, "k")) == rows(df.join(nothing, "k", "left"))


def test_left_join_near_of_two_types_of_key(spark, rows):
    df, hits = spark.range(20).select(F.col("id").cast("int").alias("k")), spark.createDataFrame([(4, "x")], "k long, v string")
    assert rows(spread.left_join_near(df, hits, "k")) == rows(df.join(hits, "k", "left"))


def test_left_join_near_shuffles_few_rows(spark):
    df = cut_lineage(spark.range(100_000).select(F.col("id").cast("string").alias("k"), "id"))
    hits = cut_lineage(df.where("id % 1000 = 0").select("k", F.lit(1).alias("v")))
    near = spread._by_filter(df, "k", hits, "k", "left_semi").count()
    assert 100 <= near < 400 and spread._by_filter(df, "k", hits, "k", "left_anti").count() == 100_000 - near


def test_parts_are_joined_last_and_customers_to_orders(spark, market):
    """The widest columns are shuffled by no later join, and line items meet no customer."""
    plan = market.items("item_id", "brand", "demography")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert ["p_partkey" in j for j in joins] == [True, False, False] and "l_orderkey" in joins[1] and "c_custkey" in joins[2]


def test_staged_tables_are_packed_tightly(spark):
    path = cut_lineage(spark.range(10)).inputFiles()[0]
    assert path.endswith(".zstd.parquet")

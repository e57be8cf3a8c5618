"""How the market's queries read the given tables: what is shuffled, and that it changes no row."""

import datetime as dt

from pyspark.sql import functions as F

from thriftlens.operators import cohort, track
from thriftlens.plans import binding, track_queries, trade_queries
from thriftlens.plans.binding import Market


def _market(spark, path):
    day = dt.datetime(2000, 1, 1)
    lines = [
        (o, n, o % 7 if o % 11 else None, o * 3 % 20, 10.0 + n, 1000.0 + o, 0.05, 0.02, "N" if o % 2 else "R", "F" if o % 3 else "O", day + dt.timedelta(o * 5 % 90))
        for o in range(300) for n in (1, 2)
    ]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, columns).write.parquet(f"{path}/lineitem.parquet")
    orders = [(o, day + dt.timedelta(o * 3 % 80)) for o in range(290)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    return Market(spark, str(path))


def test_cells_of_much_sold_products_only(spark, tmp_path, monkeypatch):
    """The origin of a resale is the same whether its product is one cell or many, products of a null key too; an ordinary product is one cell."""
    m = _market(spark, tmp_path)
    seen = []
    find = binding.with_last_before

    def found(df, keys, order, cell, *rest, **options):
        seen.append(df.select(*keys, cell.alias("c")).distinct().count())
        return find(df, keys, order, cell, *rest, **options)

    monkeypatch.setattr(binding, "with_last_before", found)
    whole = sorted(m.resales().collect())
    monkeypatch.setattr(binding, "MUCH_SOLD", 60)
    cut = sorted(m.resales().collect())
    listed = m.items("item_id", "product_id", "first_offered", "p2p").collect()
    want = []
    for r in listed:
        if r.p2p:
            mine = (r.first_offered, r.item_id)
            earlier = [(x.first_offered, x.item_id) for x in listed if x.product_id == r.product_id and not x.p2p and (x.first_offered, x.item_id) < mine]
            want.append((r.item_id, max(earlier)[1] if earlier else None))
    assert [tuple(r) for r in whole] == [tuple(r) for r in cut] == sorted(want)
    assert seen[0] == 8 and seen[1] > 8


def test_ladders_are_filtered_below_the_join_with_orders(spark, tmp_path, monkeypatch):
    """Only the listings that a trade names are joined with their orders, and the trades are those of all ladders."""
    m = _market(spark, tmp_path)
    found, seen = trade_queries.all_ladders, []

    def ladders(m, near=None):
        seen.append(found(m, near))
        return seen[-1]

    monkeypatch.setattr(trade_queries, "all_ladders", ladders)
    got = trade_queries.round_trips(m)
    assert len(seen) == 2
    for rows in seen:
        text = rows._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= text.index("Join Inner") < text.index("Join LeftSemi")
    whole = trade_queries.rounded(trade_queries.trades.round_trips(m.resales(), found(m)))
    assert sorted(got.collect(), key=repr) == sorted(whole.collect(), key=repr) and got.where(F.col("bought_price_ore") > 0).count() > 0


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_cohort_check_joins_where_the_rows_lie(spark, monkeypatch):
    """The cohort is dealt out by its key once; no join of the check shuffles it, the status or the offers."""
    seen, find = [], cohort.cohort_check

    def found(rows, checks, observed, offers, status, today):
        seen.extend([cohort.unresolved(rows, checks), rows.join(status, "item_id", "left"), offers.join(rows, "item_id", "left_semi")])
        return find(rows, checks, observed, offers, status, today)

    monkeypatch.setattr(cohort, "cohort_check", found)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert trade_queries.cohort_check(Market(spark, "/root/testdata/sf0.001")).count() > 0
        assert [_shuffles(df) for df in seen] == [0, 0, 0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tracking_reads_observations_where_they_lie(spark, monkeypatch):
    """A chunk of the pass takes its observations and verdicts, each once, without another shuffle of them."""
    seen, follow = [], track.track_pass

    def followed(items, observed, verdicts, today):
        seen.extend([_shuffles(track.once(observed)), _shuffles(track.once(verdicts))])
        return follow(items, observed, verdicts, today)

    monkeypatch.setattr(track, "track_pass", followed)
    assert track_queries.tracking_job(Market(spark, "/root/testdata/sf0.001")).count() > 0
    assert len(seen) == 12 and not any(seen[:2])
    assert sum(seen[0::2]) == 0

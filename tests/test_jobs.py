"""Jobs that write and drop tables, and what they read: states of past days, counts that add up, functions of SQL text."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from thriftlens.functions.sql_tables import register_tables
from thriftlens.operators import brands, market, peers, slices
from thriftlens.plans import jobs
from thriftlens.session import DROP_SHUFFLES, cut_lineage, staging
from thriftlens.sources import tables

D = dt.date


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_retention_of_120_days_rewrites_no_file(spark, tmp_path):
    last = D(2026, 8, 11)
    days = [(last - dt.timedelta(k), f"i{k}") for k in range(120)]
    rows = spark.createDataFrame(days, "as_of date, item_id string")
    for table in ("shortlist_daily", "shortlist_flagged"):
        rows.repartition("as_of").write.partitionBy("as_of").parquet(str(tmp_path / table))
    for version in range(5):
        tables.write_version(rows.limit(3), str(tmp_path / "pool"), version)
    before = files(tmp_path)
    dropped = jobs.retention_job(spark, str(tmp_path), last.isoformat(), days=90, versions=2)
    assert {k: len(v) for k, v in dropped.items()} == {"shortlist_daily": 119, "shortlist_flagged": 30, "pool": 3}
    left = files(tmp_path)
    assert left and all(before[f] == at for f, at in left.items())
    kept = spark.read.parquet(str(tmp_path / "shortlist_flagged")).agg(F.min("as_of"), F.count("*")).first()
    assert tuple(kept) == (last - dt.timedelta(89), 90)
    assert spark.read.parquet(str(tmp_path / "shortlist_daily")).count() == 1 and tables.versions_of(spark, str(tmp_path / "pool")) == [3, 4]
    assert all(not v for v in jobs.retention_job(spark, str(tmp_path), last.isoformat()).values())
    assert all(not v for v in jobs.retention_job(spark, str(tmp_path / "nowhere"), last.isoformat()).values())


def test_upsert_of_buckets_shuffles_the_changes_only(spark, tmp_path, rows):
    path, before = str(tmp_path / "t"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    target = [(f"k{n}", n) for n in range(500)]
    assert tables.upsert_bucketed(spark, path, spark.createDataFrame(target, "k string, v int"), ["k"], 8) == 0
    changes = spark.createDataFrame([(f"k{n}", -n) for n in range(490, 510)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = tables.upserted_buckets(spark, path, changes, ["k"], 8)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The one shuffle stands over the changes, none over the files of the table.
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        below = plan[plan.index("Exchange") :]
        assert "ExistingRDD" in below and "FileScan" not in below[: below.index("ExistingRDD")]
        assert tables.upsert_bucketed(spark, path, changes, ["k"], 8) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted(({k: v for k, v in target} | {f"k{n}": -n for n in range(490, 510)}).items())
    assert rows(tables.read_bucketed(spark, path, 1, ["k"], 8), "k", "v") == want
    assert rows(tables.read_bucketed(spark, path, 0, ["k"], 8), "k", "v") == sorted(target)  # the version before stands
    assert len(list((tmp_path / "t" / "version=1").glob("*.parquet"))) <= 8
    with pytest.raises(PySparkException, match="key twice"):
        tables.upsert_bucketed(spark, path, changes.union(changes), ["k"], 8)


def test_states_of_many_days(spark):
    """Against a walk over every ladder, with steps that last long, several on a day, and listings that begin after a cutoff."""
    rnd = random.Random(12)
    steps, start = [], dt.datetime(2026, 1, 1)
    for item in range(60):
        at = start + dt.timedelta(hours=rnd.randrange(24 * 200))
        times = sorted(at + dt.timedelta(hours=rnd.choice([1, 5, 30, 24 * 40, 24 * 90]) * k) for k in range(rnd.randint(1, 6)))
        for n, t in enumerate(times, 1):
            steps.append((f"i{item}", n, rnd.randrange(100, 999), t, times[n] if n < len(times) else None))
    df = spark.createDataFrame(steps, "item_id string, rung int, price_ore long, created_at timestamp, ended_at timestamp")
    cutoffs = [D(2026, 1, 1) + dt.timedelta(days=17 * k) for k in range(24)]
    marks = spark.createDataFrame([(c,) for c in [*cutoffs, cutoffs[3]]], "cutoff date")
    want = set()
    for c in cutoffs:
        for item in {s[0] for s in steps}:
            past = [s for s in steps if s[0] == item and s[3].date() <= c]
            if past:
                want.add((c, item, past[-1][2], past[0][2], len(past) - 1))
    for cell_days in (1, 28, 1000):
        got = market.states_on(df, marks, cell_days).select("cutoff", "item_id", "ask_ore", "opening_ask_ore", "markdowns").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    one = market.state_on(df, F.lit(cutoffs[7].isoformat()).cast("date")).collect()
    assert {(r.item_id, r.ask_ore) for r in one} == {(i, a) for c, i, a, *_ in want if c == cutoffs[7]}


def test_counts_of_two_days_are_the_counts_of_both(spark, tmp_path):
    rnd = random.Random(2)
    rows = [
        (D(2026, 7 + k % 2, 1 + rnd.randrange(9)), rnd.random() < 0.8, rnd.choice([None, 100, 200, 300]), rnd.randrange(50), rnd.choice("ab"), rnd.choice([1, 2, None]))
        for k in range(400)
    ]
    df = spark.createDataFrame(rows, "ended_on date, sold boolean, final_price_ore long, days_on_market int, brand string, tier int")
    for part in ("days_on_market < 20", "days_on_market >= 20 and ended_on < '2026-08-01'", "days_on_market >= 20 and ended_on >= '2026-08-01'"):
        before = files(tmp_path)
        jobs.sales_job(df.where(part), str(tmp_path), ["brand", "tier"])
    kept = {f.parent.name for f, at in files(tmp_path).items() if before.get(f) == at}
    assert kept == {"part=2026-07-01"}  # the last sales were of August
    counts = spark.read.parquet(str(tmp_path / "sale_counts"))
    daily = market.aggregate_of_counts(counts, F.col("ended_on"), "ended_on").collect()
    want = {(r.ended_on, r.dimension, r.value): tuple(r)[3:] for r in market.daily_aggregate(df, ["brand", "tier"]).collect()}
    assert {(r.ended_on, r.dimension, r.value): (r.units, r.med_price_ore, r.med_days) for r in daily} == want
    whole = {(r.dimension, r.value): r.units for r in market.aggregate_of_counts(counts, F.lit("all")).collect()}
    assert whole["brand", "a"] + whole["brand", "b"] == sum(sold for _, sold, *_ in rows)


def test_merged_shelf_counts_are_those_of_the_new_shelf(spark, rows):
    """Over three days of listings that come, go and move, some without price, likes or brand."""
    rnd = random.Random(8)
    listing = lambda: (rnd.choice(["a", "b", None]), rnd.choice([None, 100, 200, 300]), rnd.choice([None, 0, 3]))
    frame = lambda shelf: spark.createDataFrame([(k, *v) for k, v in shelf.items()], "item_id int, brand string, price_ore long, favourites int")
    shelf = {k: listing() for k in range(300)}
    counts = brands.shelf_counts(frame(shelf))
    for day in range(3):
        after = {k: (listing() if rnd.random() < 0.2 else v) for k, v in shelf.items() if rnd.random() < 0.9}
        after |= {1000 * (day + 1) + k: listing() for k in range(40)}
        went = {k: v for k, v in shelf.items() if after.get(k) != v}
        came = {k: v for k, v in after.items() if shelf.get(k) != v}
        counts, shelf = cut_lineage(brands.merged_counts(counts, frame(went), frame(came))), after
        columns = ["brand", "price_ore", "n", "n_likes", "likes"]
        assert rows(counts, *columns) == rows(brands.shelf_counts(frame(shelf)), *columns)
    live = frame(shelf).withColumn("outcome", F.lit(None).cast("int")).withColumn("resolved_on", F.lit(None).cast("date"))
    day = F.lit("2026-08-11").cast("date")
    columns = ["brand", "listings", "avg_favourites", "sold", "med_ask_ore", "sold_pct_day"]
    nothing = spark.createDataFrame([], "brand string, sold long")
    got = brands.snapshot_of_counts(counts, nothing, day, min_live=1)
    want = brands.brand_snapshot(live, day, 1)
    near = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(df, *columns)]
    assert near(got) == near(want)


def test_functions_of_sql_text(spark):
    live = spark.createDataFrame([("x", ["wool", "wool", "silk"], 3, True, 100), ("y", None, 5, False, 300), (None, [], 1, False, 200)],
                                 "brand string, material array<string>, favourites int, has_defect boolean, price_ore long")
    resolved = spark.createDataFrame([("x", True, 10, 50, 100), ("x", False, 20, 80, 100)], "brand string, sold boolean, days_on_market int, final_price_ore long, opening_ask_ore long")
    daily = spark.createDataFrame([("x", D(2026, 8, 1), 5, 1.0), ("x", D(2026, 8, 9), 9, 1.5)], "brand string, as_of date, listings long, attention_index double")
    for name, df in (("t_live", live), ("t_resolved", resolved), ("t_daily", daily)):
        df.createOrReplaceTempView(name)
    register_tables(spark, "t_live", "t_resolved", "t_daily")
    ask = lambda sql: sorted(map(tuple, spark.sql(sql).collect()), key=repr)
    assert ask("SELECT value, n, med_price_ore FROM market_slice('material', 1)") == [("silk", 1, 100.0), ("wool", 1, 100.0), (None, 2, 250.0)]
    assert ask("SELECT value, n FROM market_slice('brand', 2)") == []
    assert ask("SELECT * FROM outcome_slice('brand', 2)") == [("x", 2, 0.5, 15.0, 0.65)]
    assert ask("SELECT population, value, n FROM dash_slice('brand') WHERE value = 'x'") == [("live", "x", 1), ("resolved", "x", 2)]
    assert ask("SELECT brand, days_apart, listings_change, attention_change FROM brand_trend(7, 1)") == [("x", 8, 4, 0.5)]
    assert ask("SELECT * FROM brand_trend(9, 1)") == [] and ask("SELECT * FROM brand_trend(7, 10)") == []
    by_frame = {r.value: r.n for r in slices.market_slice(live, "material").collect()}
    assert {v: n for v, n, *_ in ask("SELECT * FROM market_slice('material', 1)")} == by_frame
    for sql in ("market_slice('1; DROP TABLE t', 1)", "outcome_slice('material', 1)", "dash_slice('price')", "market_slice(NULL, 1)"):
        with pytest.raises(PySparkException, match="unknown dimension"):
            spark.sql(f"SELECT * FROM {sql}").collect()


def test_a_facet_with_too_many_values_is_an_error(spark):
    df = spark.range(50).select(F.concat(F.lit("v"), F.col("id")).alias("many"), (F.col("id") % 2).alias("few"))
    assert slices.facet_document(df, ["few"], 2).first()["facets"] == '{"few":["0","1"]}'
    with pytest.raises(PySparkException, match="many has over 49 values"):
        slices.facet_document(df, ["few", "many"], 49).collect()


def test_shortlist_job_refuses_an_empty_day(spark, tmp_path):
    columns = "item_id string, brand string, brand_tier int, item_type string, category string, condition string, demography string, size_code string, price_ore long"
    columns += ", first_price_ore long, favourites int, first_favourites int, weight_g int, has_defect boolean, p2p boolean, first_offered date, outcome int"
    columns += ", resolved_on date, stratum string"
    with pytest.raises(jobs.Refused):
        jobs.shortlist_job(spark.createDataFrame([], columns), str(tmp_path), "2026-08-11")
    assert not files(tmp_path)


def test_nested_staging(spark, tmp_path, monkeypatch):
    """A lasting table outlives the innermost staging and goes with the outer one; shuffle files are dropped inside only."""
    monkeypatch.setattr("thriftlens.session.shared_dir", lambda _: str(tmp_path))
    with staging(spark):
        with staging(spark):
            short, kept = cut_lineage(spark.range(3)), cut_lineage(spark.range(4), lasting=True)
            assert short.count() == 3 and spark.conf.get(DROP_SHUFFLES) == "true"
        assert kept.count() == 4 and len(list(tmp_path.rglob("staged-*"))) == 1
        outer = cut_lineage(spark.range(5), lasting=True)
        # Queries that follow one another on the same frame still find what they need.
        counted = spark.range(100).groupBy(F.col("id") % 7).count()
        assert counted.count() == 7 and len(counted.collect()) == 7
    assert outer.count() == 5 and len(list(tmp_path.rglob("staged-*"))) == 1
    assert spark.conf.get(DROP_SHUFFLES) == "false"


def test_a_pass_writes_its_items_once_and_may_read_what_it_replaces(spark, tmp_path, monkeypatch):
    """The frozen items lie where they stay; a pass over the very day that it writes, read by its folder or by the table's, goes aside first."""
    staged = []
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: staged.append(df.columns) or cut_lineage(df))
    out, schema = str(tmp_path), "item_id string, peer_level int, peer_n long, peer_median_ore double, peer_pct double"
    items = peers.unfrozen(spark.createDataFrame([("live", None), ("sold", 1)], "item_id string, outcome int"))
    places = [spark.createDataFrame([("sold", 1, 20, 100.0, x), ("live", 1, 20, 100.0, x)], schema) for x in (0.2, 0.9)]

    def frozen_by_pass(rows, before):
        report = jobs.analytics_pass(rows, before, out, "2026-08-11")
        assert report[0] == ("freeze", "ok")
        written = spark.read.parquet(f"{out}/items/as_of=2026-08-11")
        return sorted((r.item_id, r.peer_pct_frozen) for r in written.collect())

    want = [("live", None), ("sold", 0.2)]
    assert frozen_by_pass(items, places[0]) == want
    assert not any("peer_frozen_on" in columns for columns in staged)
    assert frozen_by_pass(spark.read.parquet(f"{out}/items/as_of=2026-08-11"), places[1]) == want
    assert frozen_by_pass(spark.read.parquet(f"{out}/items").drop("as_of"), places[1]) == want
    assert sum("peer_frozen_on" in columns for columns in staged) == 2

"""Enrol, track, resolve and freeze over hand-built rows; keyed writes; guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from thriftlens.operators import cohort, filters, guards, ladders, peers, sampling, selecting, track
from thriftlens.session import cut_lineage, removes_staged
from thriftlens.sources import tables

D = dt.date
ITEMS = (
    "item_id string, price_ore long, old_price_ore long, favourites int, is_reserved boolean, last_chance boolean, "
    "outcome int, final_price_ore long, resolved_on date, first_seen date, last_seen date, history array<bigint>"
)
SEEN = "item_id string, price_ore long, old_price_ore long, favourites int, is_reserved boolean, last_chance boolean"


def day(text):
    return F.lit(text).cast("date")


def live(item, price=10000, favs=3):
    return (item, price, None, favs, False, None, None, None, None, D(2026, 8, 1), D(2026, 8, 1), [0, price])


@pytest.fixture(scope="module")
def items(spark):
    names = ["still", "cut", "liked", "unpriced", "sold", "zero", "dormant", "moved_away", "silent", "odd"]
    return spark.createDataFrame([live(n) for n in names], ITEMS)


@pytest.fixture(scope="module")
def seen(spark):
    return spark.createDataFrame(
        [
            ("still", 10000, None, 3, False, None),
            ("cut", 9000, 10000, 3, False, None),
            ("liked", 10000, None, 4, True, None),
            ("unpriced", None, None, 5, False, None),
        ],
        SEEN,
    )


@pytest.fixture(scope="module")
def verdicts(spark):
    return spark.createDataFrame(
        [("sold", "såld", 95.5), ("zero", "betald", 0.0), ("dormant", "skänkt", None), ("moved_away", "utlagd", 80.0), ("odd", "new status", 10.0)],
        "item_id string, status string, final_kr double",
    )


def test_changes(items, seen):
    got = {r.item_id: r for r in track.changes(items, seen).collect()}
    assert got.keys() == {"cut", "liked", "unpriced"}
    assert got["cut"].price_moved and not got["liked"].price_moved
    # Likes moved and the price is missing: the old price stays and the history does not grow.
    assert got["unpriced"].price_ore == 10000 and not got["unpriced"].price_moved


def test_track_pass(items, seen, verdicts):
    got = {r.item_id: r for r in track.track_pass(items, seen, verdicts, day("2026-08-11")).collect()}
    assert got["cut"].history == [0, 10000, 10, 9000] and got["cut"].old_price_ore == 10000
    assert got["still"].history == [0, 10000] and got["still"].last_seen == D(2026, 8, 11)
    assert got["liked"].favourites == 4 and got["liked"].is_reserved
    assert got["unpriced"].price_ore == 10000 and got["unpriced"].favourites == 5
    assert (got["sold"].outcome, got["sold"].final_price_ore, got["sold"].resolved_on) == (1, 9550, D(2026, 8, 11))
    assert (got["zero"].outcome, got["zero"].final_price_ore) == (1, 10000)
    assert (got["dormant"].outcome, got["dormant"].final_price_ore) == (2, 10000)
    assert got["odd"].outcome == 3
    for item in ("moved_away", "silent"):
        assert got[item].outcome is None and got[item].last_seen == D(2026, 8, 1)


def test_repeated_observations_count_once(items, seen, verdicts, rows):
    today = day("2026-08-11")
    want = track.track_pass(items, seen, verdicts, today)
    twice = track.track_pass(items, seen.unionByName(seen), verdicts.unionByName(verdicts), today)
    assert rows(twice) == rows(want)


def test_pass_equals_its_parts(items, seen, verdicts):
    today = day("2026-08-11")
    whole = {r.item_id: r for r in track.track_pass(items, seen, verdicts, today).collect()}
    gone = track.split_presence(items, seen)[1]
    for r in track.adjudicate(gone, verdicts, today).where("verdict = 'resolved'").collect():
        assert (whole[r.item_id].outcome, whole[r.item_id].final_price_ore) == (r.outcome, r.final_price_ore)
    for r in track.append_history(items, track.changes(items, seen), today).collect():
        assert whole[r.item_id].history == r.history
    for r in track.stamp_seen(items, seen, today).collect():
        assert whole[r.item_id].last_seen == r.last_seen and r.stamped == (r.item_id in {"still", "cut", "liked", "unpriced"})


def test_second_pass_leaves_resolved_rows(items, seen, verdicts):
    first = cut_lineage(track.track_pass(items, seen, verdicts, day("2026-08-11")))
    out = track.track_pass(first, seen, verdicts, day("2026-08-13"))
    got = {r.item_id: r for r in out.collect()}
    assert got["sold"].resolved_on == D(2026, 8, 11)
    assert got["cut"].history == [0, 10000, 10, 9000]
    # The later pass knows the price history of any day.
    prices = {r.item_id: r.price_ore for r in ladders.price_on(out, day("2026-08-10")).collect()}
    assert prices["cut"] == 10000
    prices = {r.item_id: r.price_ore for r in ladders.price_on(out, day("2026-07-01")).collect()}
    assert prices["cut"] is None


def test_resume_only_from_a_marker_of_today(spark):
    schema = "run_date date, last_item_id string, items_done long"
    old = spark.createDataFrame([(D(2026, 8, 9), "m", 5)], schema)
    new = spark.createDataFrame([(D(2026, 8, 11), "m", 5)], schema)
    rows = spark.createDataFrame([("a",), ("m",), ("z",)], "item_id string")
    rest = lambda marker: sorted(r.item_id for r in track.remaining(rows, track.resume_point(marker, day("2026-08-11"))).collect())
    assert rest(old) == ["a", "m", "z"] and rest(new) == ["z"]
    assert track.resume_point(old, day("2026-08-11")).first().items_done == 0


def test_upsert_is_idempotent_and_partial(spark, rows):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    change = spark.createDataFrame([("b", 9), ("c", 3)], "k string, n int")
    once = tables.upsert(target, change, ["k"])
    want = [("a", 1, "x"), ("b", 9, "y"), ("c", 3, None)]
    assert rows(once) == want and rows(tables.upsert(once, change, ["k"])) == want
    nulled = tables.upsert(target, spark.createDataFrame([("a", None)], "k string, s string"), ["k"])
    assert rows(nulled) == [("a", 1, None), ("b", 2, "y")]
    assert rows(tables.update_existing(target, change, ["k"])) == [("a", 1, "x"), ("b", 9, "y")]


def test_a_key_twice_in_the_changes_is_an_error(spark):
    target = spark.createDataFrame([("a", 1)], "k string, n int")
    change = spark.createDataFrame([("a", 2), ("a", 3)], "k string, n int")
    for apply in (tables.upsert, tables.update_existing):
        with pytest.raises(Exception, match="hold a key twice"):
            apply(target, change, ["k"]).collect()


def test_only_touched_partitions_are_replaced(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).selectExpr("concat('k', id) as k", "cast(id as int) as n")
    tables.write_partitioned(df, path, ["k"], 8)
    before = {p: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "t").glob("key_part=*")}
    change = spark.createDataFrame([("k7", -7)], "k string, n int")
    tables.upsert_partitioned(spark, path, change, ["k"], 8)
    after = {p: sorted(f.name for f in p.glob("*.parquet")) for p in before}
    assert sum(before[p] != after[p] for p in before) == 1
    got = rows(spark.read.parquet(path), "k", "n")
    assert got == sorted([(f"k{i}", -7 if i == 7 else i) for i in range(100)], key=repr)
    tables.upsert_partitioned(spark, path, spark.createDataFrame([("new", 1)], "k string, n int"), ["k"], 8)
    assert spark.read.parquet(path).count() == 101


def test_a_day_without_rows_is_emptied(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    tables.write_snapshot(df, path, "2026-08-01")
    tables.write_snapshot(df, path, "2026-08-02")
    tables.write_snapshot(df.limit(0), path, "2026-08-01")
    assert rows(spark.read.parquet(path), "k", "as_of") == [("a", D(2026, 8, 2)), ("b", D(2026, 8, 2))]


def test_price_of_a_ladder_of_many_steps(spark):
    steps = [("long", k, dt.datetime(2026, 1, 1) + dt.timedelta(hours=k), 10000 + k) for k in range(1500)]
    offers = spark.createDataFrame(steps, "item_id string, offer_id int, created_at timestamp, price_ore long")
    assert [r.price_ore for r in ladders.price_as_of(offers, day("2026-12-31")).collect()] == [11499]
    assert [r.price_ore for r in ladders.price_as_of(offers, day("2026-01-01")).collect()] == [10023]
    assert [r.price_ore for r in ladders.price_as_of(offers, day("2025-01-01")).collect()] == [None]
    assert ladders.nested_ladder(offers).selectExpr("size(ladder) as n").first().n == 1500


def test_a_step_without_a_time_stays(spark):
    rows = [("a", 1, None, 10000), ("a", 2, dt.datetime(2026, 1, 2), 9000)]
    offers = spark.createDataFrame(rows, "item_id string, offer_id int, created_at timestamp, price_ore long")
    got = sorted((r.rung, r.price_ore, r.previous_ore) for r in ladders.rungs(offers).collect())
    assert got == [(1, 10000, None), (2, 9000, 10000)]
    assert ladders.ladder_summary(offers).first().rungs == 2


def test_a_job_removes_what_it_staged(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr("thriftlens.session.shared_dir", lambda spark: str(tmp_path / "shared"))

    @removes_staged
    def job(df):
        staged = cut_lineage(df)
        assert len(list((tmp_path / "shared").glob("job-*/staged-*"))) == 1
        staged.write.parquet(str(tmp_path / "out"))

    job(spark.createDataFrame([("a", 1)], "k string, n int"))
    assert not list((tmp_path / "shared").glob("job-*")) and rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", 1)]


def test_versions_leave_the_read_one_alone(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    tables.write_version(spark.createDataFrame([("a", 1)], "k string, n int"), path, 1)
    first = tables.read_version(spark, path, 1)
    change = spark.createDataFrame([("a", 2)], "k string, n int")
    tables.write_version(tables.upsert(first, change, ["k"]), path, 2)
    assert rows(first) == [("a", 1)] and rows(tables.read_version(spark, path, 2)) == [("a", 2)]


def test_unknown_predicate_keeps_the_row(spark, rows):
    df = spark.createDataFrame([(1,), (None,), (2,)], "bucket int")
    assert rows(tables.delete_where(df, F.col("bucket") == 1)) == [(2,), (None,)]
    with_null = tables.delete_where(df, (F.col("bucket") == 1) | F.col("bucket").isNull())
    assert rows(with_null) == [(2,)]


def test_strata_claim_in_order_up_to_their_quota(spark):
    df = spark.createDataFrame([(f"i{n:03d}", n) for n in range(200)], "item_id string, n int")
    strata = {"low": F.col("n") < 50, "even": F.col("n") % 2 == 0, "all": F.col("n") >= 0}
    got = selecting.assign_strata(df, strata, {"low": 30, "even": 60, "all": 70}).join(df, "item_id").collect()
    assert len({r.item_id for r in got}) == len(got) == 160
    by = {s: [r.n for r in got if r.stratum == s] for s in strata}
    assert {s: len(v) for s, v in by.items()} == {"low": 30, "even": 60, "all": 70}
    assert max(by["low"]) < 50 and all(n % 2 == 0 for n in by["even"])
    again = selecting.assign_strata(df.repartition(5), strata, {"low": 30, "even": 60, "all": 70}).collect()
    assert {(r.item_id, r.stratum) for r in again} == {(r.item_id, r.stratum) for r in got}


def test_cohort_is_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "cohort")
    df = spark.createDataFrame([("a",)], "item_id string")
    df.write.mode("errorifexists").parquet(path)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        df.write.mode("errorifexists").parquet(path)


def test_cohort_check_and_summary(spark):
    members = spark.createDataFrame(
        [("listed", "s"), ("sold", "s"), ("gone", "s"), ("lost", "s"), ("old", "s"), ("odd", "s")], "item_id string, stratum string"
    ).withColumn("price_kr", F.when(F.col("item_id") != "odd", 1.0))
    checks = spark.createDataFrame([("old", D(2026, 8, 1), "expired"), ("sold", D(2026, 8, 1), "still_listed")], "item_id string, checked_on date, outcome string")
    observed = spark.createDataFrame([("listed",)], "item_id string")
    status = spark.createDataFrame([("sold", "betald"), ("gone", "skänkt"), ("odd", "nytt")], "item_id string, status string")
    ts = dt.datetime
    offers = spark.createDataFrame(
        [("sold", 1, ts(2026, 7, 1), 10000, ts(2026, 7, 5)), ("sold", 2, ts(2026, 7, 5), 8000, ts(2026, 7, 9)), ("gone", 3, ts(2026, 7, 1), 5000, None)],
        "item_id string, offer_id int, created_at timestamp, price_ore long, ended_at timestamp",
    )
    got = cohort.cohort_check(members, checks, observed, offers, status, day("2026-08-08"))
    out = {r.item_id: r for r in got.collect()}
    assert {k: v.outcome for k, v in out.items()} == {"listed": "still_listed", "sold": "sold", "gone": "expired", "lost": "error", "odd": "unknown"}
    assert (out["sold"].opening_ask_ore, out["sold"].final_price_ore, out["sold"].decay, out["sold"].days_on_market) == (10000, 8000, 0.2, 8)
    assert out["gone"].days_on_market is None and out["gone"].decay == 0.0
    every = checks.unionByName(got.select("item_id", "checked_on", "outcome"))
    r = cohort.cohort_summary(filters.mark_ineligible(members), every).first()
    assert (r.enrolled, r.eligible, r.listed, r.sold, r.expired) == (6, 5, 1, 1, 2)
    assert r.sold_share == pytest.approx(1 / 3)
    # Items that are not resolved are asked for again, unknown ones too.
    assert {x.item_id for x in cohort.unresolved(members, every).collect()} == {"listed", "lost", "odd"}


def test_new_listings_never_reclassify(spark):
    hits = spark.createDataFrame([(f"n{i}", "b", 30000, D(2026, 8, 10)) for i in range(30)], "item_id string, brand string, price_ore long, first_offered date")
    held = spark.createDataFrame([("n0",), ("n1",)], "item_id string")
    out = sampling.stratum_n(hits, held, day("2026-08-11"), per_brand=25).collect()
    assert not {"n0", "n1"} & {r.item_id for r in out} and len(out) <= 25
    assert all(r.sample_weight == pytest.approx(30 / len(out)) and r.price_band == 2 for r in out)


def test_staging_guard(spark):
    items = spark.createDataFrame([("a", 1, None), ("b", None, None)], "item_id string, outcome int, peer_frozen_on date")
    table = spark.createDataFrame([("a",), ("b",)], "item_id string")
    now = F.lit("2026-08-11 10:00:00").cast("timestamp")
    marker = lambda *at: spark.createDataFrame([(x,) for x in at], "staged_at timestamp")
    ask = lambda m, t=table: guards.staging_guard(m, items, t, now).first()
    never = ask(marker())
    assert (never.score_verdict, never.may_score, never.may_replace) == ("never staged", False, False)
    assert ask(marker(dt.datetime(2026, 8, 11, 9, 29))).score_verdict == "staging is stale"
    fresh = ask(marker(dt.datetime(2026, 8, 11, 9, 31)), table.where("item_id = 'b'"))
    assert fresh.may_score and fresh.may_replace


def test_run_verdict(spark):
    ledger = spark.createDataFrame([(D(2026, 8, 1), 1000, "ok"), (D(2026, 8, 2), 10, "failed")], "started_at date, expected long, status string")
    ask = lambda e, w=None: guards.run_verdict(ledger, e, w).first().verdict
    assert ask(None).startswith("refused") and ask(0).startswith("refused") and ask(499).startswith("refused")
    assert ask(500) == "running" and ask(1000, 900) == "ok" and ask(1000, 899) == "failed"


def test_precheck_without_a_run_says_no(spark):
    ledger = spark.createDataFrame([], "started_at date, status string")
    rows = spark.createDataFrame([("a",), ("b",)], "item_id string")
    assert guards.outcome_precheck(ledger, rows, rows).first().may_resolve is False
    good = spark.createDataFrame([(D(2026, 8, 1), "ok")], "started_at date, status string")
    assert guards.outcome_precheck(good, rows, rows).first().may_resolve is True
    assert guards.outcome_precheck(good, rows, rows.where("item_id = 'a'")).first().may_resolve is False


def test_resolve_then_freeze(spark, items, seen, verdicts):
    after = peers.unfrozen(track.track_pass(items, seen, verdicts, day("2026-08-11")))
    table = spark.createDataFrame([("sold", 1, 20, 100.0, 0.1), ("still", 1, 20, 100.0, 0.3)], "item_id string, peer_level int, peer_n long, peer_median_ore double, peer_pct double")
    got = {r.item_id: r.peer_pct_frozen for r in peers.freeze_peers(after, table, day("2026-08-11")).collect()}
    assert got["sold"] == 0.1 and got["still"] is None


def test_census_cells_sum_to_the_items(spark):
    prices = [("dress", 500), ("dress", 9999), ("dress", 10000), ("dress", None), ("coat", 999_999), (None, 700), ("new", 30000)]
    items = spark.createDataFrame(prices, "category string, price_ore long")
    every = spark.createDataFrame([("dress",), ("coat",), ("shoe",)], "category string")
    got = {(r.cell, r.category): r.n for r in sampling.cell_census(items, every).collect()}
    assert sum(got.values()) == len(prices)
    assert got[-1, "dress"] == 3 and got[0, "dress"] == 1 and got[14, "coat"] == 1 and got[-1, None] == 1 and got[6, "new"] == 1
    assert got[-1, "shoe"] == 0 and len(got) == 3 * 16 + 2

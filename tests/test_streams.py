import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from thriftlens.streaming import streams

random.seed(11)
START = dt.datetime(2026, 8, 1)
# A third of all sightings are of one listing.
ROWS = [
    (random.choice(["hot", "hot", "a", "b", "c", "d"]), n, START + dt.timedelta(hours=n), random.choice([100, 200, 300]), random.choice("xy"))
    for n in range(240)
]
SCHEMA = "item_id string, offer_id long, created_at timestamp, price_ore long, brand string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Six files in time order, one micro-batch each."""
    path = tmp_path_factory.mktemp("sightings")
    for i in range(6):
        part = spark.createDataFrame(ROWS[i * 40 : i * 40 + 40], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(path))
    return str(path)


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def steps():
    last, out = {}, []
    for item, n, _, price, _ in ROWS:
        if last.get(item) != price:
            out.append(n)
        last[item] = price
    return out


def test_price_steps_across_batches(spark, folder, tmp_path):
    out = streams.to_table(streams.price_steps(read(spark, folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.offer_id for r in out.collect()) == steps()


def test_price_steps_go_on_after_a_stop(spark, folder, tmp_path):
    """A later run goes on from the state that Spark kept; late and repeated sightings are no step."""
    landed = tmp_path / "landed"
    rows = spark.createDataFrame(ROWS, SCHEMA)
    late = [("hot", 999, START - dt.timedelta(days=9), 777, "x"), ("new", 1000, START, None, "x"), ROWS[-1]]
    for part in (rows.where("offer_id < 120"), rows.where("offer_id >= 120"), spark.createDataFrame(late, SCHEMA)):
        part.coalesce(1).write.mode("append").parquet(str(landed))
        stream = streams.price_steps(read(spark, str(landed)))
        out = streams.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.offer_id for r in out.collect()) == steps()


def newest():
    want = {}
    for item, n, _, price, _ in ROWS:
        want[item] = (n, price)
    return want


def held(spark, path):
    rows = spark.read.parquet(path).collect()
    assert len({r.item_id for r in rows}) == len(rows)
    return {r.item_id: (r.offer_id, r.price_ore) for r in rows}


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_kept_table(spark, folder, tmp_path):
    """One row per listing after every batch; a replayed epoch changes no file, and one that was broken off is applied again."""
    path = tmp_path / "state"
    keep = streams.keep_newest(str(path), parts=4)
    streams.run_available(read(spark, folder).writeStream.foreachBatch(keep), str(tmp_path / "cp"))
    assert held(spark, str(path)) == newest() and streams.applied_epoch(spark, str(path)) == 5
    before = files(path)
    keep(spark.createDataFrame([ROWS[0], ("hot", 10**6, START + dt.timedelta(days=99), 1, "x")], SCHEMA), 5)
    assert files(path) == before and held(spark, str(path)) == newest()
    # An epoch that was not put down: older rows, and rows that are there, leave the table as it is.
    keep(spark.createDataFrame(ROWS[-40:] + [("a", -1, START - dt.timedelta(days=1), 7, "x")], SCHEMA), 6)
    assert held(spark, str(path)) == newest() and streams.applied_epoch(spark, str(path)) == 6


def test_kept_table_replaces_touched_partitions_only(spark, tmp_path):
    path = tmp_path / "state"
    keep = streams.keep_newest(str(path), parts=16)
    many = [(f"i{n}", n, START, 100, "x") for n in range(200)]
    keep(spark.createDataFrame(many, SCHEMA), 0)
    before = files(path)
    keep(spark.createDataFrame([("i7", 900, START + dt.timedelta(hours=1), 50, "x")], SCHEMA), 1)
    kept = {f for f, at in files(path).items() if before.get(f) == at}
    assert len({f.parent for f in before} - {f.parent for f in kept}) == 1
    assert held(spark, str(path)) == {i: (n, 100) for i, n, *_ in many} | {"i7": (900, 50)}


def test_inflow_counts_a_listing_once(spark, folder, tmp_path):
    first = spark.read.parquet(folder).groupBy("item_id").agg(F.min("created_at").alias("first_offered"))
    twice = read(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy").join(first, "item_id")
    seen = streams.to_table(streams.inflow_stream(twice, delay="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    by_day = {}
    for r in seen.collect():
        by_day[r["from"]] = by_day.get(r["from"], 0) + r.inflow
    assert all(n <= 5 for n in by_day.values())


def test_dedupe(spark, folder, tmp_path):
    twice = read(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = streams.to_table(streams.dedupe_stream(twice, "offer_id", "2 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.offer_id for r in out.collect()) == list(range(240))


def closed(end):
    return end <= ROWS[-1][2] - dt.timedelta(days=1)


def test_daily_is_the_batch_count_of_closed_days(spark, folder, tmp_path):
    out = streams.to_table(streams.daily_stream(read(spark, folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = {}
    for _, _, at, price, brand in ROWS:
        day = dt.datetime(at.year, at.month, at.day)
        if closed(day + dt.timedelta(days=1)):
            n, total = want.get((day.date(), brand), (0, 0))
            want[(day.date(), brand)] = (n + 1, total + price)
    assert {(r.as_of, r.brand): (r.n, r.price_sum_ore) for r in out.collect()} == want


def test_vanished_once_per_spell(spark, folder, tmp_path):
    out = streams.to_table(streams.vanished_stream(read(spark, folder), "6 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want, last = [], {}
    gap = dt.timedelta(hours=6)
    for item, _, at, _, _ in ROWS:
        if item in last and at - last[item] > gap and closed(last[item] + gap):
            want.append((item, last[item]))
        last[item] = at
    want += [(i, at) for i, at in last.items() if closed(at + gap)]
    assert sorted((r.item_id, r.last_seen) for r in out.collect()) == sorted(want)


def vanish(spark, tmp_path, parts, after="6 hours"):
    landed = tmp_path / "landed"
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(landed))
        stream = streams.vanished_by_timer(read(spark, str(landed)), after)
        out = streams.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    return sorted((r.item_id, r.last_seen, r.vanished_at) for r in out.collect())


def test_vanished_by_timer_is_the_end_of_every_spell(spark, folder, tmp_path):
    streams_out = streams.to_table(streams.vanished_by_timer(read(spark, folder), "6 hours"), str(tmp_path / "t"), str(tmp_path / "tc"))
    sessions = streams.to_table(streams.vanished_stream(read(spark, folder), "6 hours"), str(tmp_path / "s"), str(tmp_path / "sc"))
    assert sorted(map(tuple, streams_out.collect())) == sorted(map(tuple, sessions.collect()))


def test_a_listing_that_returns_vanishes_again(spark, tmp_path):
    """Once for each spell, once in all for a spell that late sightings make longer, and not while the listing may still be there."""
    hour = lambda h: START + dt.timedelta(hours=h)
    row = lambda item, h: (item, h, hour(h), 100, "x")
    got = vanish(
        spark,
        tmp_path,
        [
            [row("back", 0), row("back", 2), row("clock", 20)],
            [row("joined", 40), row("clock", 60)],  # "back" is over and its state gone
            [row("back", 50), row("joined", 50), row("joined", 45), row("joined", 38), row("clock", 90)],  # within the delay of a day
            [row("back", 70), row("clock", 140)],
        ],
    )
    end = lambda item, h: (item, hour(h), hour(h + 6))
    assert got == sorted(
        [end("back", 2), end("back", 50), end("back", 70), end("clock", 20), end("clock", 60), end("clock", 90), end("joined", 50)]
    )


def test_price_steps_of_a_hot_listing_in_several_arrow_batches(spark, tmp_path):
    """The rows of a listing arrive in any order and in several frames."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = [("hot", n, START + dt.timedelta(seconds=n), 100 * (n // 7 % 3), "x") for n in range(1_000)]
        shuffled = random.sample(rows[:600], 600), random.sample(rows[600:], 400)
        for part in shuffled:
            spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(str(tmp_path / "landed"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "landed"))
        out = streams.to_table(streams.price_steps(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert sorted(r.offer_id for r in out.collect()) == [n for n in range(1_000) if n == 0 or n % 7 == 0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_timer_for_all_spells_of_a_listing():
    """Thirty spells that the watermark passes at once: one timer set and fired (before, one for each spell)."""
    import pandas as pd

    class Held:
        rows: list = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

    class Handle:
        def __init__(self):
            self.timers, self.calls = set(), 0

        getListState = lambda self, *_: Held()

        def registerTimer(self, at):
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers.discard(at)

        def listTimers(self):
            self.calls += 1
            return list(self.timers)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    handle, processor = Handle(), streams.Disappearance(6 * 3600 * 10**6)
    processor.init(handle)
    days = [START + dt.timedelta(days=n) for n in range(31)]
    list(processor.handleInputRows(("a",), iter([pd.DataFrame({"created_at": days})]), None))
    assert len(handle.timers) == 1 and handle.calls == 1
    fired = handle.timers.pop()
    watermark = int((days[30] - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    out = pd.concat(processor.handleExpiredTimer(("a",), At(watermark), At(fired)))
    assert list(out.last_seen) == days[:30]
    assert handle.timers == {watermark + 6 * 3600 * 1000} and len(processor.open.rows) == 1

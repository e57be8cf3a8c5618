"""Streaming queries: the events read as a stream until nothing is left, into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftlens.plans.binding import Market
from thriftlens.plans.registry import query
from thriftlens.session import shared_dir
from thriftlens.streaming import streams

# Windows the watermark has closed: their end lies a delay before the newest event.
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 DAY"


# Slices of time that the events land in, and files of each: a slice is a micro-batch.
SLICES = 4
FILES = 4
SLICE_ROWS = 50_000_000


def sightings(m: Market) -> DataFrame:
    """The events as a stream of sightings of listings: landed slice by slice, each of some whole days and about as many rows, written by ``FILES`` tasks or more."""
    rows = m.table("events")
    folder = f"{_folder(m)}/landed"
    days = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()  # a row for each day
    total = sum(d["n"] for d in days)
    slices = max(SLICES, -(-total // SLICE_ROWS))
    files = max(FILES, int(m.spark.conf.get("spark.sql.shuffle.partitions")))
    seen, bounds = 0, []
    for d in days:
        if seen * slices >= len(bounds) * total:
            bounds.append(d["day"])
        seen += d["n"]
    for part, (low, high) in enumerate(zip(bounds, [*bounds[1:], None])):
        mine = rows.where(F.col("ts") >= F.lit(low)) if high is None else rows.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
        mine.repartition(files).write.parquet(f"{folder}/part={part:06d}")
    # Files are read in the order in which they landed, so a trigger takes one slice.
    stream = m.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/part=*")
    return stream.select(
        F.col("user_id").cast("string").alias("item_id"),
        F.col("event_id").alias("offer_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.round(F.col("value") * 100).cast("long").alias("price_ore"),
        F.col("event_type").alias("brand"),
    )


def _folder(m: Market) -> str:
    return f"{shared_dir(m.spark)}/stream-{uuid.uuid4().hex}"


def _table(m: Market, stream: DataFrame) -> DataFrame:
    folder = _folder(m)
    return streams.to_table(stream, f"{folder}/out", f"{folder}/checkpoint")


@query("stream_price_steps", None, """
    WITH e AS (SELECT *, cast(floor(round(value * 100) / 2000) * 2000 AS bigint) AS price_ore FROM events)
    SELECT item_id, offer_id, price_ore FROM (SELECT cast(user_id AS varchar) AS item_id, event_id AS offer_id, price_ore,
      lag(price_ore) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e) WHERE p IS NULL OR p <> price_ore""")
def stream_price_steps(m: Market):
    """Steps of a price that moves on a grid of 20 kronor, so that many sightings repeat it."""
    grid = (F.floor(F.col("price_ore") / 2000) * 2000).cast("long")
    steps = streams.price_steps(sightings(m).withColumn("price_ore", grid))
    return _table(m, steps).select("item_id", "offer_id", "price_ore")


@query("stream_dedupe", None, """
    SELECT event_id AS offer_id, cast(user_id AS varchar) AS item_id FROM events""")
def stream_dedupe(m: Market):
    """Every sighting is delivered twice and kept once."""
    twice = sightings(m).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return _table(m, streams.dedupe_stream(twice, "offer_id", "1 day")).select("offer_id", "item_id")


@query("stream_inflow", None, f"""
    WITH f AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY ts, event_id) = 1),
    w AS (SELECT cast(ts AS date) - cast(k AS int) AS d, event_type FROM f, range(7) r(k))
    SELECT cast(d AS timestamp) AS "from", cast(d + 7 AS timestamp) AS "to", event_type AS brand, count(*) AS inflow FROM w
    WHERE cast(d + 7 AS timestamp) <= (SELECT max(ts) FROM f) - INTERVAL 1 DAY GROUP BY ALL""")
def stream_inflow(m: Market):
    """A listing is what a user offers in a day: it is seen some times and is new once."""
    listing = lambda user, at: F.concat_ws("-", F.col(user).cast("string"), F.to_date(at).cast("string")).alias("item_id")
    first = m.table("events").groupBy(listing("user_id", "ts")).agg(F.min("ts").cast("timestamp").alias("first_offered"))
    seen = sightings(m).withColumn("item_id", listing("item_id", "created_at"))
    out = _table(m, streams.inflow_stream(seen.join(first, "item_id")))
    return out.select(F.col("from").cast("timestamp_ntz").alias("from"), F.col("to").cast("timestamp_ntz").alias("to"), "brand", "inflow")


@query("stream_daily", None, f"""
    SELECT cast(ts AS date) AS as_of, event_type AS brand, count(*) AS n, cast(sum(cast(round(value * 100) AS bigint)) AS bigint) AS price_sum_ore
    FROM events WHERE cast(cast(ts AS date) + 1 AS timestamp) <= {CLOSED} GROUP BY 1, 2""")
def stream_daily(m: Market):
    return _table(m, streams.daily_stream(sightings(m)))


SPELLS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
  spells AS (SELECT cast(user_id AS varchar) AS item_id, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) + INTERVAL 12 HOUR AS closed_at,
    count(*) AS sightings FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= """ + CLOSED + ")"


@query("stream_presence_spells", None, f"{SPELLS} SELECT item_id, first_seen, last_seen, sightings FROM spells")
def stream_presence_spells(m: Market):
    out = _table(m, streams.presence_spells(sightings(m), "12 hours"))
    return out.select(
        "item_id", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "sightings",
    )


@query("stream_vanished", None, f"{SPELLS} SELECT item_id, last_seen, closed_at AS vanished_at FROM spells")
def stream_vanished(m: Market):
    out = _table(m, streams.vanished_stream(sightings(m), "12 hours"))
    return out.select(
        "item_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
        F.col("vanished_at").cast("timestamp_ntz").alias("vanished_at"),
    )


@query("stream_listing_state", None, """
    SELECT cast(user_id AS varchar) AS item_id, event_id AS offer_id, event_type AS brand FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_listing_state(m: Market):
    """The newest row of every listing, from the table that the micro-batches keep."""
    folder = _folder(m)
    writer = sightings(m).drop("price_ore").writeStream.foreachBatch(streams.keep_newest(f"{folder}/out", parts=8))
    streams.run_available(writer, f"{folder}/checkpoint")
    return m.spark.read.parquet(f"{folder}/out").select("item_id", "offer_id", "brand")


@query("stream_vanished_by_timer", None, f"{SPELLS} SELECT item_id, last_seen, closed_at AS vanished_at FROM spells")
def stream_vanished_by_timer(m: Market):
    out = _table(m, streams.vanished_by_timer(sightings(m), "12 hours"))
    return out.select(
        "item_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
        F.col("vanished_at").cast("timestamp_ntz").alias("vanished_at"),
    )

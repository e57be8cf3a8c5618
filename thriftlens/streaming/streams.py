"""Structured Streaming forms of the dated passes.

Streams of sightings carry ``item_id``, ``created_at`` (event time), ``offer_id``, ``price_ore`` and
what an operator names besides. Spark keeps all state: its aggregates, windows and de-duplication where they can say it, and typed state per
listing in RocksDB, with event-time timers, where they cannot. The table of newest rows is kept by key; a replayed micro-batch changes nothing there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from thriftlens.session import cut_lineage, staging
from thriftlens.sources.tables import PART, exists, part_of, replace_parts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(query_writer, checkpoint: str) -> StreamingQuery:
    """Runs a stream over everything there is now and waits for the end."""
    query = (
        query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Appends a stream to a parquet table until the source is read, and returns the table."""
    run_available(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


STEP = "item_id string, created_at timestamp, offer_id long, price_ore long"


def _keyed(stream: DataFrame, processor: StatefulProcessor, out: str, time_mode: str) -> DataFrame:
    """The rows of a listing, and its state, through ``processor``. State lies in RocksDB, beside the heap of the executors."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy("item_id").transformWithStateInPandas(processor, out, "Append", time_mode)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _times(micros: np.ndarray) -> pd.Series:
    return pd.Series(np.asarray(micros, dtype=np.int64).astype("datetime64[us]"))


class PriceSteps(StatefulProcessor):
    """The rows of one listing at which its price differs from the one before. The state is its newest row so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, offer_id long, price_ore long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Three numbers are held of each row, the frames go.
        parts = [np.stack([_micros(r.created_at), r.offer_id.to_numpy(), r.price_ore.to_numpy()]) for r in rows]
        at, offer, price = np.concatenate(parts, axis=1)
        order = np.lexsort((offer, at))
        last = self.last.get() if self.last.exists() else None
        if last is not None:  # rows not newer than the state are late
            order = order[(at[order] > last[0]) | ((at[order] == last[0]) & (offer[order] > last[1]))]
        if not len(order):
            return
        at, offer, price = at[order], offer[order], price[order]
        moved = np.r_[last is None or price[0] != last[2], price[1:] != price[:-1]]
        self.last.update((int(at[-1]), int(offer[-1]), int(price[-1])))
        if moved.any():
            yield pd.DataFrame({"item_id": key[0], "created_at": _times(at[moved]), "offer_id": offer[moved], "price_ore": price[moved]})

    def close(self) -> None:
        pass


def price_steps(stream: DataFrame) -> DataFrame:
    """A row only where the price of a listing differs from its last: change-only steps of rows with a price.

    Spark's state holds one row per listing. A task holds 24 bytes for each row of a listing in one micro-batch, so the trigger's limit on
    files or bytes bounds it; a row not newer than the state is late and is dropped."""
    rows = stream.select("item_id", "created_at", "offer_id", "price_ore").where("price_ore is not null")
    return _keyed(rows, PriceSteps(), STEP, "None")


class Disappearance(StatefulProcessor):
    """The ends of a listing's spells of presence. The state holds the spells that late sightings can still change, and there is one timer, for the end of the
    first of them: when it fires, all spells that the watermark has passed are over, and it is set anew for the next."""

    def __init__(self, after_us: int):
        self.after = after_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int]] = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        ends = list(held)
        for frame in rows:
            seen = np.sort(_micros(frame.created_at))
            cuts = np.flatnonzero(np.diff(seen) > self.after) + 1
            ends += [(int(part[0]), int(part[-1])) for part in np.split(seen, cuts)]
        was = min((self._due(last) for _, last in held), default=None)
        spells: list[tuple[int, int]] = []
        for first, last in sorted(ends):
            if spells and first - spells[-1][1] <= self.after:
                spells[-1] = (spells[-1][0], max(last, spells[-1][1]))
            else:
                spells.append((first, last))
        if spells != held:
            self.open.put(spells)
        first = min((self._due(last) for _, last in spells), default=None)
        if first != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        spells = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        over = np.array([last for _, last in spells if self._due(last) <= now], dtype=np.int64)
        rest = [s for s in spells if self._due(s[1]) > now]
        if rest:
            self.open.put(rest)
            self.handle.registerTimer(min(self._due(last) for _, last in rest))
        elif spells:
            self.open.clear()
        if len(over):
            yield pd.DataFrame({"item_id": key[0], "last_seen": _times(over), "vanished_at": _times(over + self.after)})

    def _due(self, last: int) -> int:
        """The millisecond by whose end the spell is over."""
        return -(-(last + self.after) // 1000)

    def close(self) -> None:
        pass


def vanished_by_timer(stream: DataFrame, after: str, delay: str = "1 day", time: str = "created_at") -> DataFrame:
    """One row when a listing has not been sighted for ``after``, once the watermark has passed that moment: the listing's timer
    fires then, and the state of the spell goes. A listing that returns begins a new spell."""
    seconds = pd.Timedelta(after).total_seconds()
    rows = stream.withWatermark(time, delay).select("item_id", F.col(time).alias("created_at"))
    out = "item_id string, last_seen timestamp, vanished_at timestamp"
    return _keyed(rows, Disappearance(int(seconds * 1_000_000)), out, "EventTime")


def applied_epoch(spark: SparkSession, path: str) -> int:
    """The last epoch that ``keep_newest`` wrote whole, or -1."""
    try:
        return spark.read.schema("epoch long").parquet(f"{path}.epoch").agg(F.max("epoch").alias("e")).first()["e"]
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def keep_newest(path: str, keys: Sequence[str] = ("item_id",), order: Sequence[str] = ("created_at", "offer_id"), parts: int = 64) -> Callable[[DataFrame, int], None]:
    """Micro-batch function that keeps one row per key, the last in ``order``, as a table in ``parts`` partitions by a hash of the key.

    Only partitions that a batch has keys of are read and replaced. The epoch is put down when its rows are in; a batch of an epoch put
    down before changes nothing, and one that was broken off is applied again with the same result, since the newest row stays the newest.
    """
    keys = list(keys)

    def newest(rows: DataFrame) -> DataFrame:
        row = F.struct(*[c for c in rows.columns if c not in keys])
        return rows.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(*keys, "_row.*")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = applied_epoch(spark, path)
        if epoch <= done:
            return
        with staging(spark):
            changes = cut_lineage(newest(batch).withColumn(PART, part_of(keys, parts)))
            touched = [r[PART] for r in changes.select(PART).distinct().collect()]  # ``parts`` numbers at most
            fresh = changes.drop(PART)
            if done >= 0 or exists(spark, path):
                held = spark.read.parquet(path).where(F.col(PART).isin(touched)).drop(PART)
                fresh = newest(fresh.unionByName(held))
            replace_parts(fresh, path, keys, parts)
        spark.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("append").parquet(f"{path}.epoch")

    return write


def dedupe_stream(stream: DataFrame, key: str, delay: str, time: str = "created_at") -> DataFrame:
    """Each key once within the watermark delay, however often it is delivered."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def inflow_stream(stream: DataFrame, key: str = "brand", delay: str = "1 day", time: str = "created_at", item: str = "item_id") -> DataFrame:
    """New listings of the last seven days per key, every day. A listing is new at its first offer (``first_offered``): later sightings
    do not count, and repeated ones of that moment count once. Rows behind the watermark are late."""
    new = stream.where(F.col(time) == F.col("first_offered"))
    return (
        new.withWatermark(time, delay)
        .dropDuplicatesWithinWatermark([item])
        .groupBy(F.window(time, "7 days", "1 day"), key)
        .agg(F.count(F.lit(1)).alias("inflow"))
        .select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), key, "inflow")
    )


def daily_stream(stream: DataFrame, key: str = "brand", delay: str = "1 day", time: str = "created_at") -> DataFrame:
    """Daily rows per key, the feed of a dated snapshot."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("price_ore").alias("price_sum_ore"))
        .select(F.to_date("window.start").alias("as_of"), key, "n", "price_sum_ore")
    )


def presence_spells(stream: DataFrame, gap: str, delay: str = "1 day", time: str = "created_at") -> DataFrame:
    """Spells of presence per listing: a gap longer than ``gap`` splits one. Sessions are merged in
    each task before the shuffle, so a much-seen listing sends few rows."""
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("spell"), "item_id")
        .agg(F.count(F.lit(1)).alias("sightings"), F.max(time).alias("last_seen"))
        .select(
            "item_id",
            F.col("spell.start").alias("first_seen"),
            "last_seen",
            F.col("spell.end").alias("closed_at"),
            "sightings",
        )
    )


def vanished_stream(stream: DataFrame, after: str, delay: str = "1 day", time: str = "created_at") -> DataFrame:
    """One row when a listing has not been sighted for ``after``: the end of its spell."""
    return presence_spells(stream, after, delay, time).select(
        "item_id", "last_seen", F.col("closed_at").alias("vanished_at")
    )

"""The daily jobs: ordered steps over tables, each step a DataFrame operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftlens import schemas
from thriftlens.functions import scalars as s
from thriftlens.operators import board, brands, filters, guards, market, peers, pool, season, track
from thriftlens.operators.cohort import cohort_check
from thriftlens.operators.pool import refresh_bucket, refresh_pool
from thriftlens.operators.selecting import first_by_key, latest_by_key, next_bucket
from thriftlens.operators.track import once
from thriftlens.session import STAGED_CODEC, cut_lineage, removes_staged
from thriftlens.sources.io import pick, read_jsonl
from thriftlens.sources.tables import (
    PART,
    drop_partitions,
    exists,
    part_of,
    read_version,
    replace_parts,
    upsert,
    upsert_partitioned,
    write_partitioned,
    write_snapshot,
    write_version,
)

# Column with the place of a line among the files, while they are loaded.
AT = "_at"


def run_steps(steps: Sequence[tuple[str, str, Callable[[], None]]]) -> list[tuple[str, str]]:
    """Runs (name, chain, action) in order. A failed step skips the rest of its chain and no other;
    returns (name, ok / failed / skipped)."""
    broken: set[str] = set()
    report = []
    for name, chain, action in steps:
        if chain in broken:
            report.append((name, "skipped"))
            continue
        try:
            action()
            report.append((name, "ok"))
        except Exception as exc:  # one step must not take the others with it
            broken.add(chain)
            report.append((name, f"failed: {type(exc).__name__}: {exc}"))
    return report


class Refused(RuntimeError):
    """A guard said no. Nothing was replaced."""


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that jobs append to; before the first entry it is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


LEDGER = "job string, started_at date, expected long, written long, status string"
MARKER = "run_date date, last_item_id string, items_done long"


def ledger_of(spark: SparkSession, home: str, job: str) -> DataFrame:
    return _rows(spark, f"{home}/ledger", LEDGER).where(F.col("job") == job)


def _record(spark: SparkSession, home: str, *entry) -> None:
    row = spark.createDataFrame([entry], "job string, started_at string, expected long, written long, status string")
    row.withColumn("started_at", F.col("started_at").cast("date")).write.mode("append").parquet(f"{home}/ledger")


def enrol(items: DataFrame, home: str, parts: int = 64) -> None:
    """The items table of a tracked market, in partitions by a hash of the key."""
    write_partitioned(items, f"{home}/items", ["item_id"], parts)


@removes_staged
def tracking_job(spark: SparkSession, home: str, observed: DataFrame, verdicts: DataFrame, day: str, parts: int = 64, chunk: int = 16, max_churn: float = 0.05) -> str:
    """A day's pass over the items table of ``home``, with its guards inside; returns the verdict put on the ledger.

    A sweep that finds nothing, or less than half of the last good one, is refused and changes nothing. Disappearances are
    believed only if the last run was good and few items are gone; if not, the pass goes on without resolving anything. The
    table is replaced ``chunk`` partitions at a time, with a marker after each, so an interrupted pass goes on the same day
    where it stopped; a marker of another day is void.
    """
    path, today = f"{home}/items", F.lit(day).cast("date")
    # Dealt out by the key: the guards and every chunk of the pass join them where they lie.
    observed, verdicts = (cut_lineage(once(rows), by=["item_id"], dealt=True) for rows in (observed, verdicts))
    ledger = ledger_of(spark, home, "track")
    tracked = filters.live(spark.read.parquet(path))
    expected = tracked.join(observed, "item_id", "left_semi").count()
    first = guards.run_verdict(ledger, expected).first()["verdict"]
    if first.startswith("refused"):
        _record(spark, home, "track", day, expected, 0, first)
        raise Refused(first)
    resume = track.resume_point(_rows(spark, f"{home}/marker", MARKER), today).first()
    done = -1 if resume["resume_after"] is None else int(resume["resume_after"])
    if done < 0:
        may_resolve = guards.outcome_precheck(ledger, tracked, observed, max_churn).first()["may_resolve"]
        spark.createDataFrame([(may_resolve,)], "may_resolve boolean").write.mode("overwrite").parquet(f"{home}/resolve/day={day}")
    # An interrupted pass goes on under the answer it began with.
    may_resolve = spark.read.parquet(f"{home}/resolve/day={day}").first()["may_resolve"]
    answers = verdicts if may_resolve else verdicts.limit(0)
    for start in range(done + 1, parts, chunk):
        last = min(start + chunk, parts) - 1
        mine = spark.read.parquet(path).where(F.col(PART).between(start, last))
        here = part_of(["item_id"], parts).between(start, last)
        fresh = track.track_pass(mine.drop(PART), observed.where(here), answers.where(here), today)
        replace_parts(fresh, path, ["item_id"], parts)
        mark = spark.createDataFrame([(day, str(last), last + 1)], "run_date string, last_item_id string, items_done long")
        mark.withColumn("run_date", F.col("run_date").cast("date")).write.mode("append").parquet(f"{home}/marker")
    followed = spark.read.parquet(path)
    written = followed.where(F.col("last_seen") >= today).join(observed, "item_id", "left_semi").count()
    verdict = guards.run_verdict(ledger, expected, written).first()["verdict"]
    _record(spark, home, "track", day, expected, written, verdict)
    return verdict


@removes_staged
def rotation_job(spark: SparkSession, home: str, market: DataFrame, day: str, buckets: int = 24, **options) -> int:
    """Sweeps the bucket that waits longest into the pool table of ``home``; returns its number. A sweep that finds no
    listing is refused: the old rows of the bucket stay."""
    pool = read_version(spark, f"{home}/pool", version := _newest(spark, f"{home}/pool"))
    bucket = next_bucket(spark, pool, buckets).first()["bucket"]
    swept = market.withColumn("bucket", s.bucket_of(F.col("brand"), buckets)).where(F.col("bucket") == bucket)
    if swept.isEmpty():
        raise Refused(f"bucket {bucket}: nothing swept")
    fresh = refresh_bucket(pool, swept, bucket, F.lit(day).cast("date"), **options)
    write_version(fresh, f"{home}/pool", version + 1)
    return bucket


@removes_staged
def refresh_job(spark: SparkSession, home: str, observed: DataFrame, day: str, max_churn: float = 0.5, hosts: Sequence[str] = ()) -> None:
    """Today's prices, liveness and images on the pool table of ``home``. Refused if more than ``max_churn`` of the pool is not
    seen: then the sweep is the likelier fault."""
    pool = read_version(spark, f"{home}/pool", version := _newest(spark, f"{home}/pool"))
    fresh = cut_lineage(refresh_pool(pool, observed, F.lit(day).cast("date"), hosts))
    seen = fresh.agg(F.count_if("still_listed").alias("seen"), F.count(F.lit(1)).alias("n")).first()
    if seen["n"] - seen["seen"] > max_churn * seen["n"]:
        raise Refused(f"{seen['n'] - seen['seen']} of {seen['n']} not seen")
    write_version(fresh, f"{home}/pool", version + 1)


@removes_staged
def cohort_job(spark: SparkSession, home: str, cohort: DataFrame, observed: DataFrame, offers: DataFrame, status: DataFrame, day: str) -> None:
    """One check of the cohort: its rows go to the day's snapshot, from which later checks know what is settled."""
    path = f"{home}/checks"
    checks = _rows(spark, path, "item_id string, outcome string, as_of date").where(F.col("as_of") < F.lit(day).cast("date"))
    earlier = checks.select("item_id", F.col("as_of").alias("checked_on"), "outcome")
    found = cohort_check(cohort, earlier, observed, offers, status, F.lit(day).cast("date"))
    write_snapshot(cut_lineage(found), path, day)


@removes_staged
def shortlist_job(items: DataFrame, home: str, day: str, n: int = 500, per_brand: int = 15, **options) -> int:
    """The day's shortlist in full, and the thin record of what was recommended, each a day of its own table; returns the number of rows.
    A day on which nothing is listed is refused: then the peers are the likelier fault. A re-run of a day replaces its rows. The full rows are written once,
    and the record is read from them."""
    as_of, spark = F.lit(day).cast("date"), items.sparkSession
    listed = pool.build_shortlist(items, as_of, **options)
    if listed.select("item_id").isEmpty():
        raise Refused(f"{day}: nothing shortlisted")
    write_snapshot(listed, f"{home}/shortlist_daily", day)
    written = spark.read.parquet(f"{home}/shortlist_daily/as_of={day}").withColumn("as_of", as_of)
    write_snapshot(pool.flagged(written, n, per_brand), f"{home}/shortlist_flagged", day)
    return written.count()


@removes_staged
def season_job(offers: DataFrame, details: DataFrame, home: str, parts: int = 64) -> None:
    """Adds the ended listings of a scan to the season history of ``home``, by key: a listing that several scans hold is there once, as
    the last one says."""
    history = cut_lineage(season.season_history(offers, details))
    upsert_partitioned(offers.sparkSession, f"{home}/season_history", history, ["item_id"], parts)


@removes_staged
def score_job(items: DataFrame, excluded: DataFrame, home: str, day: str, floor_ore: int = 10000) -> None:
    """The scores of the eligible items, from the demand for their brands on the same day, as the day's snapshot."""
    rows = cut_lineage(filters.live(items))
    scores = pool.score_table(rows, brands.brand_demand(rows), excluded, F.lit(day).cast("date"), floor_ore)
    write_snapshot(scores, f"{home}/item_scores", day)


@removes_staged
def sales_job(ladders: DataFrame, home: str, dimensions: Sequence[str], unit: str = "month") -> None:
    """Adds sales to the table of their counts, in partitions by the ``unit`` of their day. Partitions that new sales fall in are read and
    replaced, no listing of before is. The sales must be new: each is counted once."""
    spark, path = ladders.sparkSession, f"{home}/sale_counts"
    keys = ["ended_on", "dimension", "value", "measure", "x"]
    fresh = cut_lineage(market.sale_counts(ladders, dimensions).withColumn("part", F.trunc("ended_on", unit).cast("string")))
    touched = [r["part"] for r in fresh.select("part").distinct().collect()]  # a row for each month of the new sales
    if exists(spark, path):
        held = spark.read.parquet(path).withColumn("part", F.col("part").cast("string")).where(F.col("part").isin(touched))
        fresh = fresh.unionByName(held).groupBy("part", *keys).agg(F.sum("n").alias("n"))
    added = cut_lineage(fresh.repartition("part", F.pmod(F.xxhash64(*keys), F.lit(4))))
    added.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def retention_job(spark: SparkSession, home: str, day: str, days: int = 90, versions: int = 2) -> dict[str, list[str]]:
    """What has outlived its use goes, folder by folder, and no file is rewritten: of the full shortlist all days but this one, of the flagged record the days that lie
    ``days`` or more back, of the pool all but the last ``versions``. Returns what was dropped of each table."""
    oldest = (dt.date.fromisoformat(day) - dt.timedelta(days)).isoformat()
    last = _newest(spark, f"{home}/pool") if exists(spark, f"{home}/pool") else None
    return {
        "shortlist_daily": drop_partitions(spark, f"{home}/shortlist_daily", "as_of", lambda v: v < day),
        "shortlist_flagged": drop_partitions(spark, f"{home}/shortlist_flagged", "as_of", lambda v: v <= oldest),
        "pool": drop_partitions(spark, f"{home}/pool", "version", lambda v: int(v) <= last - versions),
    }


def _newest(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).agg(F.max("version").alias("v")).first()["v"]


def check_staging(marker: DataFrame, items: DataFrame, peers: DataFrame, now: Column) -> None:
    """Refuses a shelf that is not freshly staged, and a peer table that resolved items still wait for."""
    guard = guards.staging_guard(marker, items, peers, now).first()
    if not guard["may_score"]:
        raise Refused(guard["score_verdict"])
    if not guard["may_replace"]:
        raise Refused(f"{guard['unfrozen']} resolved items are not frozen")


@removes_staged
def analytics_pass(items: DataFrame, previous_peers: DataFrame, out: str, as_of: str, min_group: int = 8, min_bucket: int = 200, min_live: int = 25, band_edges: Sequence[int] = s.PRICE_BAND_EDGES_ORE, marker: DataFrame | None = None, now: Column | None = None) -> list[tuple[str, str]]:
    """Freeze, then peers, then both boards and the brand snapshot, all for one day.

    Freezing comes first: it reads the peer table that the next step replaces, and that step refuses while a resolved
    item of the old table still waits to be frozen. With ``marker`` (rows of ``staged_at``) and ``now`` it also refuses a shelf that was never
    staged, or too long ago. Every write replaces its own day, so a re-run gives the same tables.
    """
    day = F.lit(as_of).cast("date")
    state: dict[str, DataFrame] = {}

    def freeze() -> None:
        # Written once, where it stays, and read from there; aside first only where the pass reads what it replaces.
        path, frozen = f"{out}/items/as_of={as_of}", peers.freeze_peers(items, previous_peers, day)
        aside = any(f"/items/as_of={as_of}/" in file for read in (items, previous_peers) for file in read.inputFiles())
        rows = cut_lineage(frozen) if aside else frozen
        rows.write.mode("overwrite").option("compression", STAGED_CODEC).parquet(path)
        state["items"] = rows if aside else items.sparkSession.read.schema(frozen.schema).parquet(path)

    def score() -> None:
        staged = marker
        if staged is None:
            staged = items.sparkSession.range(1).select(F.current_timestamp().alias("staged_at"))
        at = F.current_timestamp() if now is None else now
        check_staging(staged, state["items"], previous_peers, at)
        shelf = filters.live(filters.analysis_rows(state["items"]))
        write_snapshot(peers.peer_cascade(shelf, min_group=min_group, staged=True), f"{out}/peer_prices", as_of)

    def predictors() -> None:
        rows = filters.analysis_rows(state.get("items", items)).withColumn("peer_quartile", s.peer_quartile(F.col("peer_pct_frozen")))
        features = board.listing_features(day, band_edges) | {"peer_quartile": F.col("peer_quartile")}
        write_snapshot(board.predictor_boards(rows, features, day, min_bucket), f"{out}/predictor_daily", as_of)

    def snapshot() -> None:
        write_snapshot(brand_daily(items, day, min_live, band_edges), f"{out}/brand_daily", as_of)

    return run_steps(
        [
            ("freeze", "peer", freeze),
            ("score", "peer", score),
            ("predictors", "predictors", predictors),
            ("brands", "brands", snapshot),
        ]
    )


def brand_daily(items: DataFrame, day: Column, min_live: int = 25, band_edges: Sequence[int] = s.PRICE_BAND_EDGES_ORE) -> DataFrame:
    """The brand snapshot with attention index and inflow."""
    used = ("brand", "item_type", "price_ore", "first_offered", "favourites", "outcome", "resolved_on")
    rows = cut_lineage(filters.analysis_rows(items).select(*used))  # read by all three aggregates
    live = filters.live(rows)
    attention = brands.attention_index(live, day, band_edges=band_edges)
    return (
        brands.brand_snapshot(rows, day, min_live)
        .join(attention.select("brand", "expected_favourites", "attention_index"), "brand")
        .join(brands.inflow(live, day).select("brand", "inflow", "inflow_share"), "brand")
    )


def load_local(spark: SparkSession, data_dir: str, targets: Mapping[str, DataFrame | None]) -> dict[str, DataFrame]:
    """Collected JSON-line files to the four tables, applied by key onto what the tables hold.

    The cohort, ladders and round trips come from their newest file; every check ever made is
    read, because the series is the result. Error outcomes become ``error``. Where a file holds a key
    again, the later line counts, and the later file; of round trips the first source that has one, and its first line.
    """

    def newest(pattern: str, schema) -> DataFrame:
        return read_jsonl(spark, f"{data_dir}/{pattern}", schema, place=AT)

    def renamed(schema, **changed: str) -> dict[str, str]:
        names = {f: f for f in schema.fieldNames() if f not in changed.values()}
        return names | changed | {AT: AT}

    cohort = newest("cohort_baseline.jsonl", schemas.COHORT_FILE)
    cohort = pick(cohort, renamed(schemas.COHORT_FILE, item_type="type", is_resale="is_circle"))
    checks = read_jsonl(spark, f"{data_dir}/cohort_checks/check_*.jsonl", schemas.CHECK_FILE, newest_only=False, place=AT)
    failed = F.col("outcome").startswith("error")
    checks = checks.withColumn("outcome", F.when(failed, "error").otherwise(F.col("outcome")))
    trips = first_by_key(
        [newest(p, schemas.TRIP_FILE) for p in ("roundtrips_*.jsonl", "dormant_circle_*.jsonl")], ["circle_id"], [AT]
    )
    trips = pick(
        trips,
        renamed(
            schemas.TRIP_FILE, item_type="type", resale_id="circle_id", resale_ask="circle_ask", resale_final="circle_final",
            resale_rungs="circle_rungs", days_listed="days_on_circle",
        ),
    )
    ladders = pick(newest("ladders_*.jsonl", schemas.LADDER_FILE), renamed(schemas.LADDER_FILE, item_type="type"))
    loaded = {
        "cohort_items": (cohort, ["item_id"]),
        "cohort_checks": (checks, ["item_id", "checked_on"]),
        "round_trips": (trips, ["resale_id"]),
        "item_ladders": (ladders, ["item_id"]),
    }
    out = {}
    for name, (rows, keys) in loaded.items():
        rows = latest_by_key(rows, keys, [AT]).drop(AT)
        held = targets.get(name)
        out[name] = rows if held is None else upsert(held, rows, keys)
    return out

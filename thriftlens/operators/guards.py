"""Checks that must pass before a step may replace data. Each returns one verdict row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.operators.spread import with_row


def staging_guard(marker: DataFrame, items: DataFrame, peers: DataFrame, now: Column, max_age: str = "30 minutes", key: str = "item_id") -> DataFrame:
    """Whether the shelf may be scored (staged, and recently) and whether the peer table may be
    replaced (no resolved item still waits for its position to be frozen)."""
    staged = marker.agg(F.max("staged_at").alias("staged_at"))
    waiting = (
        items.where(F.col("outcome").isNotNull() & F.col("peer_frozen_on").isNull())
        .join(peers.select(key), key, "left_semi")
        .agg(F.count(F.lit(1)).alias("unfrozen"))
    )
    fresh = F.col("staged_at") >= now - F.expr(f"INTERVAL {max_age}")
    reason = (
        F.when(F.col("staged_at").isNull(), "never staged")
        .when(~fresh, "staging is stale")
        .otherwise("ok")
    )
    return with_row(staged, waiting).select(
        "staged_at",
        "unfrozen",
        reason.alias("score_verdict"),
        F.coalesce(fresh, F.lit(False)).alias("may_score"),
        (F.col("unfrozen") == 0).alias("may_replace"),
    )


def run_verdict(ledger: DataFrame, expected: int | None, written: int | None = None, max_drop: float = 0.5, min_written: float = 0.9) -> DataFrame:
    """Verdict on a run: something was expected, not less than half of the last good run, and nine
    tenths of it were written."""
    last = ledger.where(F.col("status") == "ok").agg(
        F.max_by("expected", "started_at").alias("last_expected")
    )
    e, w = F.lit(expected).cast("long"), F.lit(written).cast("long")
    verdict = (
        F.when(e.isNull() | (e <= 0), "refused: nothing expected")
        .when(e < F.col("last_expected") * max_drop, "refused: dropped by more than half")
        .when(w.isNull(), "running")
        .when(w >= e * min_written, "ok")
        .otherwise("failed")
    )
    return last.select("last_expected", e.alias("expected"), w.alias("written"), verdict.alias("verdict"))


def outcome_precheck(ledger: DataFrame, tracked: DataFrame, observed: DataFrame, max_churn: float = 0.05, key: str = "item_id") -> DataFrame:
    """Whether disappearances may be trusted: the last run is ok and few items are gone. Without a
    run on record the answer is no."""
    last = ledger.agg(F.max_by("status", "started_at").alias("last_status"))
    seen = observed.select(key, F.lit(True).alias("_seen"))
    churn = tracked.select(key).join(seen, key, "left").agg(
        F.count(F.lit(1)).alias("tracked"), F.count_if(F.col("_seen").isNull()).alias("gone")
    )
    rate = F.col("gone") / F.nullif(F.col("tracked"), F.lit(0))
    ok = (F.col("last_status") == "ok") & (rate < max_churn)
    return with_row(last, churn).select(
        "last_status", "tracked", "gone", rate.alias("churn"), F.coalesce(ok, F.lit(False)).alias("may_resolve")
    )

"""A frozen cohort, its dated checks and what they sum up to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.filters import STRATUM_QUOTA, stratum_predicates
from thriftlens.operators.ladders import ladder_summary, nested_ladder
from thriftlens.operators.selecting import assign_strata


def cohort_snapshot(hits: DataFrame, today: Column, expect: Mapping[str, str], strata: Mapping[str, Column] | None = None, quotas: Mapping[str, int] = STRATUM_QUOTA, key: str = "item_id") -> DataFrame:
    """Enrolled items with their stratum, enrolment day and the prediction of ``expect`` frozen with it. Write it
    with mode ``errorifexists``: a cohort is never overwritten."""
    strata = stratum_predicates() if strata is None else strata
    claimed = assign_strata(hits, strata, quotas, key)
    frozen = F.create_map(*[F.lit(x) for pair in expect.items() for x in pair])
    return (
        hits.join(claimed, key)
        .withColumn("enrolled_on", today)
        .withColumn("expect", frozen[F.col("stratum")])
    )


def unresolved(cohort: DataFrame, checks: DataFrame, terminal: Sequence[str] = tuple(s.TERMINAL_OUTCOMES)) -> DataFrame:
    """Cohort items without a terminal outcome in any check."""
    done = checks.where(F.col("outcome").isin(*terminal)).select("item_id")
    return cohort.join(done, "item_id", "left_anti")


def cohort_check(cohort: DataFrame, checks: DataFrame, observed: DataFrame, offers: DataFrame, status: DataFrame, today: Column) -> DataFrame:
    """One check: open items still seen are listed; for the rest the status decides and the ladder
    is summed up and kept whole, as it can be read only then. The stratum goes with the check. An item whose status is not
    known at all is recorded as ``error``."""
    open_items = unresolved(cohort, checks).select("item_id", "stratum")
    present = open_items.join(observed.select("item_id"), "item_id", "left_semi")
    vanished = open_items.join(observed.select("item_id"), "item_id", "left_anti")
    listed = present.select("item_id", "stratum", F.lit("still_listed").alias("outcome"))
    outcome = F.when(F.col("_known"), s.outcome_of(F.col("status"))).otherwise("error")
    verdicts = (
        vanished.join(status.select("item_id", "status", F.lit(True).alias("_known")), "item_id", "left")
        .select("item_id", "stratum", "status", F.coalesce(outcome, F.lit("error")).alias("outcome"))
    )
    mine = offers.join(verdicts.where(F.col("outcome") != "error"), "item_id", "left_semi")
    resolved = verdicts.join(ladder_summary(mine), "item_id", "left").join(nested_ladder(mine), "item_id", "left")
    return resolved.unionByName(listed, allowMissingColumns=True).withColumn("checked_on", today)


def final_outcomes(checks: DataFrame, *columns: str) -> DataFrame:
    """(item_id, outcome and ``columns``) per item: its terminal check, or else its latest one."""
    rank = F.struct(F.col("outcome").isin(*s.TERMINAL_OUTCOMES), F.col("checked_on"))
    return checks.groupBy("item_id").agg(
        *[F.max_by(c, rank).alias(c) for c in ["outcome", *columns]]
    )


def cohort_summary(cohort: DataFrame, checks: DataFrame) -> DataFrame:
    """Per stratum: enrolled, eligible, listed, sold, expired, and sold as a share of the finished.
    A terminal outcome stands whatever a later check says; otherwise the latest check counts."""
    latest = final_outcomes(checks)
    is_ = {o: F.count_if(F.col("outcome") == o) for o in ("still_listed", "sold", "expired")}
    return (
        cohort.select("item_id", "stratum", "ineligible_reason")
        .join(latest, "item_id", "left")
        .groupBy("stratum")
        .agg(
            F.count(F.lit(1)).alias("enrolled"),
            F.count_if(F.col("ineligible_reason").isNull()).alias("eligible"),
            is_["still_listed"].alias("listed"),
            is_["sold"].alias("sold"),
            is_["expired"].alias("expired"),
            s.ratio(is_["sold"], is_["sold"] + is_["expired"]).alias("sold_share"),
        )
    )


def refresh_sellability(cohort: DataFrame, offers: DataFrame, today: Column) -> DataFrame:
    """(item_id, score, cutoff, reliable, version, seen_on) for cohort items whose live offer
    carries an estimate; to be applied with ``update_existing``."""
    estimate = F.col("item.sellabilityEstimate")
    return (
        offers.where(F.col("latest") & estimate.isNotNull())
        .select(
            F.col("item.objectId").alias("item_id"),
            estimate["score"].alias("sellability_score"),
            estimate["cutoff"].alias("sellability_cutoff"),
            estimate["isReliable"].alias("sellability_reliable"),
            estimate["version"].alias("sellability_version"),
            today.alias("sellability_seen_on"),
        )
        .join(cohort.select("item_id"), "item_id", "left_semi")
    )

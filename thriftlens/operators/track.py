"""A tracking pass: who is still there, what moved, who left and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.selecting import dedupe
from thriftlens.operators.spread import with_row

WATCHED = ["favourites", "is_reserved", "last_chance"]


def split_presence(tracked: DataFrame, observed: DataFrame, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(present, vanished) rows of ``tracked`` against today's observations."""
    seen = observed.select(key)
    return tracked.join(seen, key, "left_semi"), tracked.join(seen, key, "left_anti")


def once(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per key, the first in the order of all other columns: a landed file may hold a listing again."""
    plain = [c for c, kind in rows.dtypes if c != key and not kind.startswith("map")]
    return dedupe(rows, [key], plain)


def changes(tracked: DataFrame, observed: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows whose price, likes, reserved or last-chance flag moved, with their new values.

    An observation without a price is no price move and keeps the old price. ``price_moved`` says
    whether the history grows.
    """
    new = observed.select(
        key, "price_ore", "old_price_ore", *WATCHED
    ).withColumnsRenamed({c: f"_o_{c}" for c in ["price_ore", "old_price_ore", *WATCHED]})
    old = tracked.select(key, "price_ore", *WATCHED)
    price_moved = F.col("_o_price_ore").isNotNull() & ~F.col("_o_price_ore").eqNullSafe(F.col("price_ore"))
    moved = price_moved
    for c in WATCHED:
        moved = moved | ~F.col(f"_o_{c}").eqNullSafe(F.col(c))
    return old.join(new, key).where(moved).select(
        key,
        F.coalesce("_o_price_ore", "price_ore").alias("price_ore"),
        F.col("_o_old_price_ore").alias("old_price_ore"),
        *[F.col(f"_o_{c}").alias(c) for c in WATCHED],
        price_moved.alias("price_moved"),
    )


def append_history(rows: DataFrame, changed: DataFrame, today: Column, key: str = "item_id") -> DataFrame:
    """(key, history) of the rows whose price moved, with ``[day, price]`` appended. History is read
    for those rows only."""
    movers = changed.where("price_moved").select(key, F.col("price_ore").alias("_price"))
    day = F.datediff(today, F.col("first_seen")).cast("long")
    empty = F.array().cast("array<bigint>")
    return rows.select(key, "first_seen", "history").join(movers, key).select(
        key,
        F.concat(F.coalesce("history", empty), F.array(day, F.col("_price"))).alias("history"),
    )


def stamp_seen(items: DataFrame, seen: DataFrame, day: Column, key: str = "item_id") -> DataFrame:
    """``items`` with ``last_seen`` set for every item seen, moving or not. ``stamped`` marks the
    rows whose value moved."""
    marked = items.join(seen.select(key, F.lit(True).alias("_seen")), key, "left")
    fresh = F.when(F.col("_seen"), F.greatest(F.col("last_seen"), day)).otherwise(F.col("last_seen"))
    return (
        marked.withColumn("_fresh", fresh)
        .withColumn("stamped", ~F.col("_fresh").eqNullSafe(F.col("last_seen")))
        .withColumn("last_seen", F.col("_fresh"))
        .drop("_seen", "_fresh")
    )


def adjudicate(vanished: DataFrame, verdicts: DataFrame, today: Column, key: str = "item_id") -> DataFrame:
    """Vanished items with what their status says happened.

    ``verdict`` is ``resolved``, ``still_live`` (it left the slice, not the market) or
    ``unaccounted`` (no answer). A missing or zero final price falls back to the last ask.
    """
    answer = verdicts.select(key, "status", F.col("final_kr").alias("_final"), F.lit(True).alias("_ok"))
    outcome = s.outcome_of(F.col("status"))
    joined = vanished.select(key, "price_ore").join(answer, key, "left")
    verdict = (
        F.when(F.col("_ok").isNull(), "unaccounted")
        .when(outcome == "still_listed", "still_live")
        .otherwise("resolved")
    )
    resolved = F.col("verdict") == "resolved"
    return joined.withColumn("verdict", verdict).select(
        key,
        "verdict",
        F.when(resolved, s.outcome_code(outcome)).alias("outcome"),
        F.when(resolved, F.coalesce(s.to_ore_trunc(F.col("_final")), F.col("price_ore"))).alias("final_price_ore"),
        F.when(resolved, today).alias("resolved_on"),
    )


def track_pass(items: DataFrame, observed: DataFrame, verdicts: DataFrame, today: Column, key: str = "item_id") -> DataFrame:
    """``items`` after one pass. Every row meets its observation and its verdict once; what moved,
    who vanished and how it ended are then expressions on that one row. A listing delivered twice counts
    once. Resolved rows pass by: only live ones are joined."""
    observed = once(observed, key)
    verdicts = once(verdicts, key)
    resolved = items.where(F.col("outcome").isNotNull())
    new = observed.select(
        key,
        F.lit(True).alias("_seen"),
        *[F.col(c).alias(f"_o_{c}") for c in ["price_ore", "old_price_ore", *WATCHED]],
    )
    answers = verdicts.select(
        key, s.outcome_of(F.col("status")).alias("_outcome"), s.to_ore_trunc(F.col("final_kr")).alias("_final")
    )
    live = F.col("outcome").isNull()
    seen = live & F.coalesce(F.col("_seen"), F.lit(False))
    price_moved = seen & F.col("_o_price_ore").isNotNull() & ~F.col("_o_price_ore").eqNullSafe(F.col("price_ore"))
    moved = price_moved
    for c in WATCHED:
        moved = moved | (seen & ~F.col(f"_o_{c}").eqNullSafe(F.col(c)))
    ended = live & F.col("_seen").isNull() & F.col("_outcome").isNotNull() & (F.col("_outcome") != "still_listed")
    day = F.datediff(today, F.col("first_seen")).cast("long")
    grown = F.concat(
        F.coalesce("history", F.array().cast("array<bigint>")), F.array(day, F.col("_o_price_ore"))
    )
    rows = (
        items.where(F.col("outcome").isNull())
        .join(new, key, "left")
        .join(answers, key, "left")
        .withColumns({"_is_seen": seen, "_price_moved": price_moved, "_moved": moved, "_ended": ended})
    )
    fresh = {
        "price_ore": F.when(F.col("_price_moved"), F.col("_o_price_ore")),
        "history": F.when(F.col("_price_moved"), grown),
        "last_seen": F.when(F.col("_is_seen"), F.greatest(F.col("last_seen"), today)),
        "outcome": F.when(F.col("_ended"), s.outcome_code(F.col("_outcome"))),
        "final_price_ore": F.when(F.col("_ended"), F.coalesce("_final", "price_ore")),
        "resolved_on": F.when(F.col("_ended"), today),
    }
    taken = {c: F.when(F.col("_moved"), F.col(f"_o_{c}")).otherwise(F.col(c)) for c in ["old_price_ore", *WATCHED]}
    kept = {c: F.coalesce(value, F.col(c)) for c, value in fresh.items()} | taken
    followed = rows.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in items.columns])
    return followed.unionByName(resolved)


def resume_point(marker: DataFrame, today: Column) -> DataFrame:
    """One row: the key to resume after and the items done, null and 0 unless a marker of today is
    there. An older marker is void: resuming it would date sightings wrongly."""
    mine = marker.where(F.col("run_date") == today)
    return mine.agg(
        F.max_by("last_item_id", "items_done").alias("resume_after"),
        F.coalesce(F.max("items_done"), F.lit(0)).cast("long").alias("items_done"),
    )


def remaining(live: DataFrame, resume: DataFrame, key: str = "item_id") -> DataFrame:
    """The live rows still ahead of an interrupted pass."""
    joined = with_row(live, resume.select("resume_after"))
    return joined.where(F.col("resume_after").isNull() | (F.col(key) > F.col("resume_after"))).drop("resume_after")


def origin_targets(items: DataFrame, origins: DataFrame, key: str = "item_id") -> DataFrame:
    """Resale items without an origin, resolved ones first."""
    todo = items.where("p2p").join(origins.select(key), key, "left_anti")
    live = F.col("outcome").isNull()
    return todo.select(key, live.alias("live")).orderBy("live", key)


def reconcile(cache: DataFrame, wanted: DataFrame, landed: DataFrame, key: str = "item_id") -> DataFrame:
    """Cached rows that are wanted and have not landed."""
    return cache.join(wanted.select(key), key, "left_semi").join(landed.select(key), key, "left_anti")


def decode_items(items: DataFrame, brands: DataFrame, lookup: DataFrame, kinds: Sequence[str] = ("item_type", "size", "condition")) -> DataFrame:
    """Items with their brand name and dictionary values spelled out."""
    out = items.join(brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand")), "brand_id", "left")
    for kind in kinds:
        table = lookup.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("value").alias(kind))
        out = out.join(table, f"{kind}_id", "left")
    return out


"""The scalar surface as SQL functions. Catalyst inlines them, so they cost nothing over columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

from thriftlens.functions import scalars as s


def _case(column: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def register(spark: SparkSession) -> None:
    """Create the temporary functions ``price_band``, ``outcome_of``, ``bucket_of``,
    ``expected_profit`` and ``size_area`` on a session."""
    bands = " ".join(
        f"WHEN coalesce(ore, 0) < {edge} THEN {i}" for i, edge in enumerate(s.PRICE_BAND_EDGES_ORE)
    )
    words = " ".join(
        f"WHEN category RLIKE '(?i){'|'.join(w)}' THEN '{area}'" for area, w in s.CATEGORY_AREA
    )
    systems = " ".join(
        f"WHEN split_part(code, '-', 2) = '{k}' THEN '{v}'" for k, v in s.SYSTEM_AREA.items()
    )
    groups = " ".join(
        f"WHEN split_part(code, '-', 1) = '{k}' THEN '{v}'" for k, v in s.GROUP_AREA.items()
    )
    bodies = {
        "price_band(ore BIGINT) RETURNS INT":
            f"CASE {bands} ELSE {len(s.PRICE_BAND_EDGES_ORE)} END",
        "outcome_of(status STRING) RETURNS STRING":
            _case("status", s.STATUS_OUTCOME, "'unknown'"),
        "bucket_of(brand STRING, buckets INT) RETURNS INT":
            "cast(crc32(encode(brand, 'UTF-8')) % buckets AS INT)",
        "expected_profit(price DOUBLE, estimate_ratio DOUBLE) RETURNS DOUBLE":
            f"CASE WHEN estimate_ratio <> 0 THEN {s.KEEP_SHARE}D "
            f"* least(price / estimate_ratio, price * {s.ASK_CAP}) - price END",
        "size_area(code STRING, category STRING) RETURNS STRING":
            f"CASE {systems} {groups} {words} ELSE 'other' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

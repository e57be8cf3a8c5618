"""Parameterised table functions for SQL text: ``SELECT * FROM market_slice('brand', 100)``.

A dimension is a value that chooses a branch; it never becomes part of the SQL, and one that is not known raises an error. The branch is
chosen while Spark plans the query, so only the columns of that dimension are read. Medians are exact: their state is one
count for each different price or number of days of a group, which combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from thriftlens.operators.slices import DIMENSIONS


def _value(spark: SparkSession, view: str, function: str) -> str:
    """The values of a row in the dimension that the function's ``dim`` names, as an array: an array dimension counts a row once per value."""
    kinds = dict(spark.table(view).dtypes)
    known = [d for d in DIMENSIONS if d in kinds]
    arms = " ".join(
        f"WHEN '{d}' THEN {f'cast(array_distinct({d}) AS ARRAY<STRING>)' if kinds[d].startswith('array') else f'array(cast({d} AS STRING))'}" for d in known
    )
    raised = f"raise_error(concat('unknown dimension ', coalesce({function}.dim, 'null'), '; known are {', '.join(known)}'))"
    return f"CASE {function}.dim {arms} ELSE cast({raised} AS ARRAY<STRING>) END"


def _rows(spark: SparkSession, view: str, function: str, *columns: str) -> str:
    return f"(SELECT explode_outer({_value(spark, view, function)}) AS value, {', '.join(columns)} FROM {view})"


def register_tables(spark: SparkSession, live: str, resolved: str, daily: str) -> None:
    """Creates the temporary functions ``market_slice(dim, min_n)``, ``outcome_slice(dim, min_n)``, ``dash_slice(dim)`` and ``brand_trend(days, min_listings)``.

    ``live`` names a view of the live listings, ``resolved`` one of the ladders of resolved listings and ``daily`` one of dated brand snapshots; the columns are
    those of ``slices`` and ``brands.brand_trend``. Live and resolved listings are never pooled: ``dash_slice`` has a row for each population.
    """
    market = """SELECT value, count(1) AS n, avg(favourites) AS avg_favourites, count_if(has_defect) / count(1) AS defect_rate,
      percentile(price_ore, 0.5) AS med_price_ore FROM {rows} GROUP BY value"""
    outcome = """SELECT value, count(1) AS n, count_if(sold) / count(1) AS sell_through, percentile(days_on_market, 0.5) AS med_days,
      percentile(final_price_ore / nullif(opening_ask_ore, 0), 0.5) AS med_kept FROM {rows} GROUP BY value"""
    live_columns = ("favourites", "has_defect", "price_ore")
    resolved_columns = ("sold", "days_on_market", "final_price_ore", "opening_ask_ore")

    def market_of(function: str) -> str:
        return market.format(rows=_rows(spark, live, function, *live_columns))

    def outcome_of(function: str) -> str:
        return outcome.format(rows=_rows(spark, resolved, function, *resolved_columns))

    functions = {
        "market_slice(dim STRING, min_n INT) RETURNS TABLE(value STRING, n BIGINT, avg_favourites DOUBLE, defect_rate DOUBLE, med_price_ore DOUBLE)":
            f"SELECT * FROM ({market_of('market_slice')}) WHERE n >= market_slice.min_n",
        "outcome_slice(dim STRING, min_n INT) RETURNS TABLE(value STRING, n BIGINT, sell_through DOUBLE, med_days DOUBLE, med_kept DOUBLE)":
            f"SELECT * FROM ({outcome_of('outcome_slice')}) WHERE n >= outcome_slice.min_n",
        "dash_slice(dim STRING) RETURNS TABLE(population STRING, value STRING, n BIGINT, med_price_ore DOUBLE, sell_through DOUBLE, med_days DOUBLE)":
            f"SELECT 'live', value, n, med_price_ore, cast(NULL AS DOUBLE), cast(NULL AS DOUBLE) FROM ({market_of('dash_slice')}) "
            f"UNION ALL SELECT 'resolved', value, n, cast(NULL AS DOUBLE), sell_through, med_days FROM ({outcome_of('dash_slice')})",
        "brand_trend(days INT, min_listings INT) RETURNS TABLE(brand STRING, new_on DATE, base_on DATE, days_apart INT, listings BIGINT, "
        "listings_change BIGINT, attention_change DOUBLE)":
            f"""WITH new AS (SELECT max(as_of) AS new_on FROM {daily}),
              base AS (SELECT max(as_of) AS base_on FROM {daily} WHERE datediff((SELECT new_on FROM new), as_of) >= brand_trend.days)
            SELECT n.brand, n.as_of, b.as_of, datediff(n.as_of, b.as_of), n.listings, n.listings - b.listings, n.attention_index - b.attention_index
            FROM {daily} n JOIN {daily} b ON n.brand = b.brand
            WHERE n.as_of = (SELECT new_on FROM new) AND b.as_of = (SELECT base_on FROM base) AND n.listings >= brand_trend.min_listings""",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

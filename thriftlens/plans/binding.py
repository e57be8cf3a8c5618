"""The given tables read as a resale market.

A line item is one listing, its part the garment, its order and customer the listing's setting.
Every column of ``items`` is one SQL expression that means the same in Spark and in the SQL used
to check results, so both sides read the same market. Only the tables that the asked-for columns
need are joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.operators.spread import null_safe_join, with_last_before
from thriftlens.session import configure

PRICE = "cast(round(l_extendedprice * 100) as bigint)"
OPENING = f"cast(floor({PRICE} * (100 + 4 * round(l_discount * 100)) / 100e0) as bigint)"
LISTED = "least(cast(o_orderdate as date), cast(l_shipdate as date))"
ENDED = "greatest(cast(o_orderdate as date), cast(l_shipdate as date))"
LIVE = "l_linestatus = 'O'"
BRAND_NO = "cast(substr(p_brand, 7) as int)"

# column: (expression, tables besides lineitem)
ITEM_COLUMNS = {
    "item_id": (
        "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
        "cast(l_partkey as string), cast(l_suppkey as string), "
        "cast(cast(l_shipdate as date) as string))",
        "",
    ),
    "order_key": ("l_orderkey", ""),
    "product_id": ("l_partkey", ""),
    "brand": ("p_brand", "p"),
    "brand_tier": (f"{BRAND_NO} % 6 + 1", "p"),
    "brand_origin": (
        f"case {BRAND_NO} % 5 when 0 then 'Northern' when 1 then 'Southern' when 2 then 'Eastern' when 3 then 'Western' end", "p",
    ),
    "brand_ethos": (f"case when {BRAND_NO} % 10 >= 7 then 'slow' when {BRAND_NO} % 10 >= 3 then 'fast' else 'heritage' end", "p"),
    "item_type": ("p_type", "p"),
    "category": ("split_part(p_name, ' ', 2)", "p"),
    "colour": ("split_part(p_name, ' ', 1)", "p"),
    "condition": ("o_orderpriority", "o"),
    "demography": ("c_mktsegment", "oc"),
    "size_code": (
        "case when p_size % 10 = 9 then 'ONE SIZE' else concat(case p_size % 4 when 0 then 'WMN' "
        "when 1 then 'MEN' when 2 then 'SHOES' else 'CHILD' end, '-EU-', cast(p_size as string)) end",
        "p",
    ),
    "weight_g": ("p_size * 20", "p"),
    "season": (
        "case p_size % 4 when 0 then 'Vinter' when 1 then 'Sommar' when 2 then 'Vinter,Sommar' end",
        "p",
    ),
    "season_mask": ("case p_size % 4 when 0 then 8 when 1 then 2 when 2 then 10 else 0 end", "p"),
    "score": ("cast(cast(round(p_retailprice * 100) as bigint) % 100 as double) / 100", "p"),
    "score_version": ("case when p_size % 2 = 0 then '3' else '3-mla' end", "p"),
    "price_ore": (PRICE, ""),
    "first_price_ore": (OPENING, ""),
    "final_price_ore": (f"case when {LIVE} then null else {PRICE} end", ""),
    "rungs": ("l_linenumber", ""),
    "favourites": ("cast(l_quantity as int) - 1", ""),
    "first_favourites": ("cast(floor((l_quantity - 1) / 2) as int)", ""),
    "price_to_estimate": ("cast(1 + (l_orderkey * 7 + l_linenumber) % 200 as double) / 100", ""),
    "outcome": (f"case when {LIVE} then null when l_returnflag = 'R' then 2 else 1 end", ""),
    "status": (
        f"case when {LIVE} then 'utlagd' when l_returnflag = 'R' then "
        "case when l_linenumber % 2 = 0 then 'vilande' else 'skänkt' end "
        "when l_linenumber % 2 = 0 then 'såld' else 'betald' end",
        "",
    ),
    "first_offered": (LISTED, "o"),
    "resolved_on": (f"case when {LIVE} then null else {ENDED} end", "o"),
    "dwell_days": ("cast(l_partkey % 60 as int)", ""),
    "is_reserved": ("l_linenumber = 7", ""),
    "last_chance": ("l_linenumber = 6 and l_quantity >= 40", ""),
    "p2p": ("l_suppkey % 10 = 0", ""),
    "has_defect": ("l_tax >= 0.07", ""),
    "stratum": (
        f"case when l_linenumber = 6 then 'L' when {BRAND_NO} <= 15 then 'A' "
        f"when {BRAND_NO} <= 20 then 'B' when {BRAND_NO} <= 23 then 'N' else 'C' end",
        "p",
    ),
    "sample_weight": ("cast(1 + l_partkey % 5 as double)", ""),
}
CUSTOMER_OF = "o_custkey = c_custkey"
# Prices in the given tables run far above those of clothes, so the bands are set wider.
BAND_EDGES = [2000000, 4000000, 6000000, 8000000]
AS_OF = "2000-07-01"
# Listings of a product beyond which it is cut into cells; up to here a task puts it in order as a whole.
MUCH_SOLD = 100_000


class Market:
    """The given tables of one folder, with the views that the queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def items(self, *columns: str, only: str = "true", near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Listings in the asked-for columns. ``only`` is a predicate on the line items, put where
        the scan can use it; ``near`` a filter by ``item_id``, which Spark does not put below the joins by itself."""
        columns = columns or tuple(ITEM_COLUMNS)
        needed = "".join(ITEM_COLUMNS[c][1] for c in columns)
        out = self.table("lineitem").where(only)
        if near is not None:
            out = near(out.withColumn("item_id", F.expr(ITEM_COLUMNS["item_id"][0]))).drop("item_id")
        # Beyond the broadcast threshold every join shuffles what the ones before it made: orders meet their customers by themselves,
        # and parts, whose names are the widest columns, come last.
        if "o" in needed:
            orders = self.table("orders")
            if "c" in needed:
                orders = orders.join(self.table("customer"), F.expr(CUSTOMER_OF))
            out = out.join(orders, F.expr("l_orderkey = o_orderkey"))
        if "p" in needed:
            out = out.join(self.table("part"), F.expr("l_partkey = p_partkey"))
        return out.select(*[F.expr(ITEM_COLUMNS[c][0]).alias(c) for c in columns])

    def shelf(self, *columns: str) -> DataFrame:
        """Live listings of the analysis sample."""
        rows = self.items(*dict.fromkeys([*columns, "stratum"]), only=LIVE)
        return rows.where("stratum in ('A', 'B', 'N')").select(*columns)

    def ladders(self, *columns: str) -> DataFrame:
        """One row per resolved listing with its opening and final price."""
        if not columns:
            columns = LADDER_COLUMNS
        source = {
            "opening_ask_ore": "first_price_ore",
            "listed_on": "first_offered",
            "ended_on": "resolved_on",
        }
        derived = {
            "sold": ("outcome",),
            "decay": ("first_price_ore", "final_price_ore"),
            "days_on_market": ("first_offered", "resolved_on"),
        }
        needed = ["outcome"]
        for c in columns:
            needed += derived.get(c, (source.get(c, c),))
        rows = self.items(*dict.fromkeys(needed), only=f"not {LIVE}")
        made = {
            "sold": F.col("outcome") == 1,
            "decay": s.decay(F.col("first_price_ore"), F.col("final_price_ore")),
            "days_on_market": s.day_gap(F.col("first_offered"), F.col("resolved_on")),
        }
        return rows.select(
            *[(made[c] if c in made else F.col(source.get(c, c))).alias(c) for c in columns]
        )

    def offers(self) -> DataFrame:
        """Price steps: one event is one step of the ladder of its user and day."""
        return self.table("events").select(
            F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("item_id"),
            F.col("event_id").alias("offer_id"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.round(F.col("value") * 100).cast("long").alias("price_ore"),
            "event_type",
        )

    def resales(self) -> DataFrame:
        """Resale listings with ``original_id``, the newest earlier listing of the same product."""
        rows = self.items("item_id", "product_id", "first_offered", "p2p")
        counts = self.table("lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.count(F.lit(1)).alias("_n"))
        # At most one row for each MUCH_SOLD line items, so it may be broadcast.
        much_sold = F.broadcast(counts.where(F.col("_n") > MUCH_SOLD))
        linked = with_last_before(
            null_safe_join(rows, much_sold, ["product_id"], "left"),
            ["product_id"],
            ["first_offered", "item_id"],
            # Day and head of the id: it rises with the order, and cuts a much-sold product finely. Any other product is one cell.
            F.when(F.col("_n").isNotNull(), F.concat(F.col("first_offered").cast("string"), F.substring("item_id", 1, 2))),
            F.when(~F.col("p2p"), F.col("item_id")),
            "original_id",
            only=F.col("p2p"),
        )
        return linked.select("item_id", "original_id")


LADDER_COLUMNS = (
    "item_id", "brand", "category", "item_type", "condition", "demography", "season", "has_defect",
    "product_id", "status", "sold", "score", "score_version", "dwell_days", "opening_ask_ore",
    "final_price_ore", "rungs", "decay", "listed_on", "ended_on", "days_on_market",
)

_ITEMS_BODY = (
    "SELECT " + ", ".join(f"{expr} AS {name}" for name, (expr, _) in ITEM_COLUMNS.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
    + " JOIN customer ON o_custkey = c_custkey"
)
VIEWS = {
    "items": ((), _ITEMS_BODY),
    "shelf": (
        ("items",),
        "SELECT * FROM items WHERE outcome IS NULL AND stratum IN ('A', 'B', 'N')",
    ),
    "ladders": (
        ("items",),
        "SELECT *, first_price_ore AS opening_ask_ore, first_offered AS listed_on, "
        "resolved_on AS ended_on, outcome = 1 AS sold, "
        "round_even(1 - cast(final_price_ore AS double) / nullif(first_price_ore, 0), 3) AS decay, "
        "cast(date_diff('day', first_offered, resolved_on) AS int) AS days_on_market "
        "FROM items WHERE outcome IS NOT NULL",
    ),
    "offers": (
        (),
        "SELECT concat_ws('-', cast(user_id AS string), cast(cast(ts AS date) AS string)) AS item_id,"
        " event_id AS offer_id, ts AS created_at, cast(round(value * 100) AS bigint) AS price_ore,"
        " event_type FROM events",
    ),
    "steps": (
        ("offers",),
        "SELECT *, row_number() OVER w AS n, lag(price_ore) OVER w AS prev_price, "
        "lead(created_at) OVER w AS next_at, lag(created_at) OVER w AS prev_at FROM offers "
        "WINDOW w AS (PARTITION BY item_id ORDER BY created_at, offer_id)",
    ),
    "resales": (
        ("items",),
        "SELECT item_id, original_id FROM (SELECT item_id, p2p, last_value(CASE WHEN NOT p2p THEN "
        "item_id END IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY first_offered, item_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS original_id FROM items) WHERE p2p",
    ),
}


def checked(view: str, body: str) -> str:
    """SQL with the named views (space separated) put in front of ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in view.split():
        add(name)
    ctes = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes}, {body[4:]}"
    return f"WITH {ctes} {body}"


def crc32_sql(text: str) -> str:
    """The checksum of an ASCII string, bit by bit, in the checking engine's SQL."""
    bits = "[xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0]"
    byte = f"list_reduce({bits}, lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, {byte})), 4294967295)"


def r6(expr: str) -> str:
    """Six places; adding zero turns a negative zero into zero."""
    return f"(round({expr}, 6) + 0.0)"

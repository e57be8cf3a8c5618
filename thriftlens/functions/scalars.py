"""Scalar expressions of the resale data model. Everything here is a Column to Column function."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
PRICE_BAND_EDGES_ORE = [20000, 30000, 50000, 100000]
STATUS_OUTCOME = {
    "utlagd": "still_listed",
    "såld": "sold",
    "betald": "sold",
    "vilande": "expired",
    "skänkt": "expired",
}
TERMINAL_OUTCOMES = ["sold", "expired"]
OUTCOME_CODE = {"sold": 1, "expired": 2, "unknown": 3}
SOLD, EXPIRED, UNKNOWN, BELOW_FLOOR = 1, 2, 3, 4
KEEP_SHARE = 0.84
ASK_CAP = 5
MILLIS_FROM = 1e11
SEASON_BITS = {"Vår": 1, "Sommar": 2, "Höst": 4, "Vinter": 8}
PREMIUM_FIBRES = ["Ull", "Kashmir", "Silke", "Linne", "Läder", "Mohair", "Alpacka", "Merinoull"]
# Size group to the part of the body it fits.
GROUP_AREA = {
    "SHOES": "feet",
    "SOCKS": "feet",
    "PANTS": "lower body",
    "BELTS": "waist",
    "HATS": "head",
    "GLOVES": "hands",
    "RINGS": "fingers",
    "CHILD": "child",
    "ONE SIZE": "unsized",
    "NO SIZE": "unsized",
}
# Size system to area; it decides before group and category do.
SYSTEM_AREA = {"EU_BRA": "bust", "EU_COLLAR": "neck"}
# Words of the category path to area, first match wins.
CATEGORY_AREA = [
    ("underwear", ["Underkläder"]),
    ("sportswear", ["Sportkläder", "Träningskläder"]),
    ("full body", ["Klänningar", "Byxdressar", "Badkläder", "Sovplagg", "Mammakläder"]),
    ("lower body", ["Byxor", "Jeans", "Shorts", "Kjolar"]),
    ("upper body", ["Tröjor", "T-shirts", "Skjortor", "Blusar", "Toppar", "Jackor", "Kavajer"]),
]
# ----------------------------------------------------------------------------------------------


def _choose(pairs: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """``CASE`` over (condition, value) pairs, first match wins."""
    if not pairs:
        return default
    head, *rest = pairs
    chain = reduce(lambda acc, pair: acc.when(*pair), rest, F.when(*head))
    return chain.otherwise(default)


def _lookup(key: Column, table: dict, default: Column) -> Column:
    return _choose([(key == k, F.lit(v)) for k, v in table.items()], default)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is null when the bottom is null or zero."""
    return top / F.nullif(bottom, F.lit(0))


# --- money ------------------------------------------------------------------------------------


def to_ore(kr: Column) -> Column:
    return F.bround(kr * 100).cast("long")


def to_ore_trunc(kr: Column) -> Column:
    """Truncating form used on verdict prices; a zero price counts as no price."""
    return F.nullif(kr * 100, F.lit(0.0)).cast("long")


def to_kr(ore: Column) -> Column:
    return ore / 100


def to_kr_floor(ore: Column) -> Column:
    return F.floor(ore / 100).cast("long")


# --- dates ------------------------------------------------------------------------------------


def epoch_date(epoch: Column) -> Column:
    """UTC day of an epoch in seconds or milliseconds; zero means missing."""
    seconds = F.when(epoch > MILLIS_FROM, epoch / 1000).otherwise(epoch)
    day = F.floor(seconds / 86400).cast("int")
    return F.when(epoch != 0, F.date_from_unix_date(day))


def iso_day(text: Column) -> Column:
    """Day of an ISO string, or of the ``iso`` field of a JSON object kept as text."""
    return F.try_to_date(F.substring(F.coalesce(F.get_json_object(text, "$.iso"), text), 1, 10))


def day_gap(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


dwell_days = day_gap

# --- bands ------------------------------------------------------------------------------------


def price_band(ore: Column, edges: Sequence[int] = PRICE_BAND_EDGES_ORE) -> Column:
    """Band number of a price; a missing price falls in band 0."""
    value = F.coalesce(ore, F.lit(0))
    return _choose([(value < e, F.lit(i)) for i, e in enumerate(edges)], F.lit(len(edges)))


def band(value: Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """Half-open bands ``edges[i] <= value < edges[i+1]``; ``None`` as last edge is open."""
    if len(edges) != len(labels) + 1:
        raise ValueError("band needs one more edge than labels")

    def inside(i: int) -> Column:
        low = value >= edges[i]
        return low if edges[i + 1] is None else low & (value < edges[i + 1])

    pairs = [(inside(i), F.lit(label)) for i, label in enumerate(labels)]
    return _choose(pairs, F.lit(None).cast("string"))


def ask_band(kr: Column, low: int = 400, high: int = 1500) -> Column:
    labels = [f"low (<{low})", f"mid ({low}-{high - 1})", f"high (>={high})"]
    return _choose(
        [(kr.isNull(), F.lit("?")), (kr < low, F.lit(labels[0])), (kr < high, F.lit(labels[1]))],
        F.lit(labels[2]),
    )


def favourites_bucket(n: Column) -> Column:
    return band(n, [0, 1, 3, 6, 11, 21, None], ["0", "1-2", "3-5", "6-10", "11-20", "21+"])


def favs_per_month_bucket(rate: Column) -> Column:
    return band(rate, [0, 1, 3, 6, 12, None], ["0-1", "1-3", "3-6", "6-12", "12+"])


def age_bucket(days: Column) -> Column:
    return band(days, [0, 15, 31, 61, 121, None], ["0-14", "15-30", "31-60", "61-120", "121+"])


def weight_bucket(grams: Column) -> Column:
    return band(grams, [0, 151, 301, 501, 800, None], ["0-150", "151-300", "301-500", "501-799", "800+"])


def peer_quartile(pct: Column) -> Column:
    """Label of a peer percentile (0 is the cheapest of its kind)."""
    labels = ["cheapest quarter", "below median", "above median", "priciest quarter"]
    edges = [0.25, 0.5, 0.75]
    pairs = [(pct.isNull(), F.lit(None).cast("string"))]
    pairs += [(pct <= e, F.lit(label)) for e, label in zip(edges, labels)]
    return _choose(pairs, F.lit(labels[3]))


# --- outcome ----------------------------------------------------------------------------------


def outcome_of(status: Column) -> Column:
    """Outcome of a status; one never seen before is ``unknown`` and so not terminal."""
    return _lookup(status, STATUS_OUTCOME, F.lit("unknown"))


def outcome_code(outcome: Column) -> Column:
    """1 sold, 2 expired, null still listed, 3 for everything else."""
    return F.when(outcome == "still_listed", F.lit(None).cast("int")).otherwise(
        _lookup(outcome, OUTCOME_CODE, F.lit(UNKNOWN))
    )


# --- documents --------------------------------------------------------------------------------


def image_paths(urls: Column, hosts: Sequence[str]) -> Column:
    """Paths of image URLs: a known host prefix is removed, other values stay as they are."""

    def strip(url: Column) -> Column:
        return _choose(
            [(url.startswith(h), F.substring(url, len(h) + 1, 1 << 30)) for h in hosts], url
        )

    return F.transform(F.coalesce(urls, F.array().cast("array<string>")), strip)


def deepest_category(levels: Column, names: Sequence[str] = ("lvl3", "lvl2", "lvl1", "lvl0")) -> Column:
    """First entry of the deepest category level that has one."""
    return F.coalesce(*[F.get(levels[name], F.lit(0)) for name in names])


def listing_category(levels: Column) -> Column:
    return deepest_category(levels, ("lvl2", "lvl1"))


# --- sizes ------------------------------------------------------------------------------------


def size_parts(code: Column) -> tuple[Column, Column, Column]:
    """(group, system, value) of ``GROUP-SYSTEM-VALUE``; an unhyphenated code is all group."""

    def part(n: int) -> Column:
        return F.nullif(F.split_part(code, F.lit("-"), F.lit(n)), F.lit(""))

    return part(1), part(2), part(3)


def size_area(code: Column, category: Column) -> Column:
    """Part of the body an item fits, from its size code and category path."""
    group, system, _ = size_parts(code)
    by_word = [
        (category.rlike("(?i)" + "|".join(words)), F.lit(area)) for area, words in CATEGORY_AREA
    ]
    by_system = [(system == s, F.lit(area)) for s, area in SYSTEM_AREA.items()]
    by_group = [(group == g, F.lit(area)) for g, area in GROUP_AREA.items()]
    return _choose(by_system + by_group + by_word, F.lit("other"))


def size_key(code: Column, category: Column) -> Column:
    _, system, value = size_parts(code)
    blank = F.lit("")
    return F.concat_ws(
        "|", size_area(code, category), F.coalesce(system, blank), F.coalesce(value, blank)
    )


# --- rotation, trades, scores -----------------------------------------------------------------


def bucket_of(brand: Column, buckets: int = 24) -> Column:
    return (F.crc32(F.encode(brand, "UTF-8")) % buckets).cast("int")


def decay(first: Column, last: Column) -> Column:
    return F.bround(1 - ratio(last, first), 3)


def multiple(paid: Column, final: Column) -> Column:
    return F.bround(ratio(final, paid), 2)


def trade_profit(paid: Column, final: Column, sold: Column, keep_share: float = KEEP_SHARE) -> Column:
    """Profit after the venue's cut; null unless the trade sold."""
    return F.when(sold, F.bround(final * keep_share - paid, 1))


def trade_value(sell_through: Column, price: Column, paid: Column, keep_share: float = KEEP_SHARE) -> Column:
    return sell_through * keep_share * price - paid


def break_even(gross_multiple: Column, keep_share: float = KEEP_SHARE, gain: float = 0.0) -> Column:
    """Sell-through needed to earn ``gain`` on capital at a gross multiple."""
    return (1 + gain) / (keep_share * gross_multiple)


def expected_profit(price: Column, estimate_ratio: Column, keep_share: float = KEEP_SHARE, cap: int = ASK_CAP) -> Column:
    """Profit ceiling: the ask is the estimated value, at most ``cap`` times the price paid."""
    value = ratio(price, estimate_ratio)
    return F.when(value.isNotNull(), keep_share * F.least(value, price * cap) - price)


def cap_binds(estimate_ratio: Column, cap: int = ASK_CAP) -> Column:
    return estimate_ratio <= 1 / cap


def worth_x(estimate_ratio: Column) -> Column:
    return ratio(F.lit(1.0), estimate_ratio)


def candidate_score(profit: Column, demand_index: Column, has_defect: Column) -> Column:
    penalty = F.when(has_defect, 0.85).otherwise(1.0)
    return F.greatest(profit, F.lit(0.0)) * demand_index * penalty


def discount_pct(price: Column, median: Column) -> Column:
    return F.when(median > 0, F.bround((1 - ratio(price, median)) * 100, 2))


def markdown_pct(opening: Column, current: Column) -> Column:
    return F.when(opening > 0, F.bround((1 - ratio(current, opening)) * 100, 2))


def momentum(now: Column, at_first: Column) -> Column:
    return now - at_first


def season_bit(day: Column) -> Column:
    """Bit of the meteorological season a day lies in."""
    quarter = F.floor((F.month(day) % 12) / 3)
    bits = [SEASON_BITS[s] for s in ("Vinter", "Vår", "Sommar", "Höst")]
    return _lookup(quarter, dict(enumerate(bits)), F.lit(None).cast("int"))


def out_of_season(mask: Column, day: Column) -> Column:
    """True where an item carries season bits and none of them is the day's season."""
    return (mask > 0) & (mask.bitwiseAND(season_bit(day).cast("long")) == 0)


def premium_fibre(materials: Column, fibres: Sequence[str] = PREMIUM_FIBRES) -> Column:
    return F.coalesce(
        F.arrays_overlap(materials, F.array(*[F.lit(f) for f in fibres])), F.lit(False)
    )

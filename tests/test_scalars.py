import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from thriftlens.functions import scalars as s
from thriftlens.functions import sql_udfs


def one(spark, column, schema=None, values=()):
    df = spark.createDataFrame([values], schema) if schema else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_money(spark):
    kr = F.col("kr")
    out = [one(spark, f(kr), "kr double", (19.995,)) for f in (s.to_ore, s.to_ore_trunc)]
    assert out == [2000, 1999]
    assert one(spark, s.to_ore_trunc(kr), "kr double", (0.0,)) is None
    assert one(spark, s.to_kr_floor(F.lit(19999))) == 199


@pytest.mark.parametrize("epoch", [1700000000, 1700000000000])
def test_epoch_in_seconds_and_milliseconds(spark, epoch):
    assert one(spark, s.epoch_date(F.lit(epoch))) == dt.date(2023, 11, 14)


def test_missing_epoch(spark):
    assert one(spark, s.epoch_date(F.lit(0))) is None


@pytest.mark.parametrize("text", ["2026-08-04T10:00:00.000Z", '{"__type":"Date","iso":"2026-08-04T10:00:00.000Z"}'])
def test_iso_day_of_text_and_object(spark, text):
    assert one(spark, s.iso_day(F.lit(text))) == dt.date(2026, 8, 4)


def test_iso_day_of_nothing(spark):
    assert one(spark, s.iso_day(F.lit(None).cast("string"))) is None
    assert one(spark, s.iso_day(F.lit("not a date"))) is None


@pytest.mark.parametrize("ore, band", [(None, 0), (19999, 0), (19950, 0), (20000, 1), (30000, 2), (99999, 3), (100000, 4)])
def test_price_band_has_no_gap(spark, ore, band):
    assert one(spark, s.price_band(F.col("p")), "p long", (ore,)) == band


def test_ask_band(spark):
    got = [one(spark, s.ask_band(F.col("k")), "k double", (k,)) for k in (None, 399.0, 400.0, 1500.0)]
    assert got == ["?", "low (<400)", "mid (400-1499)", "high (>=1500)"]


def test_band_needs_matching_edges():
    with pytest.raises(ValueError):
        s.band(None, [0, 1], ["a", "b"])


@pytest.mark.parametrize(
    "status, outcome, code",
    [("utlagd", "still_listed", None), ("såld", "sold", 1), ("betald", "sold", 1), ("vilande", "expired", 2), ("skänkt", "expired", 2), ("nytt", "unknown", 3), (None, "unknown", 3)],
)
def test_status(spark, status, outcome, code):
    col = s.outcome_of(F.col("x"))
    assert one(spark, col, "x string", (status,)) == outcome
    assert one(spark, s.outcome_code(col), "x string", (status,)) == code


def test_image_paths_strip_known_hosts_only(spark):
    hosts = ["https://a.example/", "https://b.example/files/"]
    urls = F.array(F.lit("https://a.example/x/1.jpg"), F.lit("https://b.example/files/2.jpg"), F.lit("https://c.example/3.jpg"))
    assert one(spark, s.image_paths(urls, hosts)) == ["x/1.jpg", "2.jpg", "https://c.example/3.jpg"]
    assert one(spark, s.image_paths(F.lit(None).cast("array<string>"), hosts)) == []


@pytest.mark.parametrize(
    "code, category, parts, area",
    [
        ("ONE SIZE", None, ("ONE SIZE", None, None), "unsized"),
        ("NO SIZE", "Kvinna > Kläder > Klänningar", ("NO SIZE", None, None), "unsized"),
        ("WMN-EU_BRA-80I", "Kvinna > Kläder > Underkläder", ("WMN", "EU_BRA", "80I"), "bust"),
        ("MEN-EU_COLLAR-41", "Man > Kläder > Skjortor", ("MEN", "EU_COLLAR", "41"), "neck"),
        ("SHOES-EU-38", "Kvinna > Skor", ("SHOES", "EU", "38"), "feet"),
        ("WMN-EU-38", "Kvinna > Kläder > Klänningar", ("WMN", "EU", "38"), "full body"),
        ("WMN-EU-38", "Kvinna > Kläder > Byxor & Jeans", ("WMN", "EU", "38"), "lower body"),
        ("WMN-EU-38", "Kvinna > Kläder > Byxdressar", ("WMN", "EU", "38"), "full body"),
        ("MEN-INT-L", "Man > Kläder > T-shirts", ("MEN", "INT", "L"), "upper body"),
        ("CHILD-CM-74/80", "Barn > Kläder > Byxor", ("CHILD", "CM", "74/80"), "child"),
        ("MEN-INT-L", "Man > Kläder > Annat", ("MEN", "INT", "L"), "other"),
    ],
)
def test_size(spark, code, category, parts, area):
    schema, values = "c string, k string", (code, category)
    assert tuple(one(spark, p, schema, values) for p in s.size_parts(F.col("c"))) == parts
    assert one(spark, s.size_area(F.col("c"), F.col("k")), schema, values) == area
    key = one(spark, s.size_key(F.col("c"), F.col("k")), schema, values)
    assert key == f"{area}|{parts[1] or ''}|{parts[2] or ''}"


@pytest.mark.parametrize("brand", ["COS", "Zara", "& Other Stories", "Märta Ö", "日本", ""])
def test_bucket_is_crc32_of_utf8(spark, brand):
    assert one(spark, s.bucket_of(F.col("b")), "b string", (brand,)) == zlib.crc32(brand.encode()) % 24


def test_trades(spark):
    """Paid, sold for, multiple, profit at a keep share of 0.84."""
    trades = [(420.0, 600.0, 1.43, 84.0), (370.0, 749.0, 2.02, 259.2), (120.0, 600.0, 5.0, 384.0), (50.0, 250.0, 5.0, 160.0)]
    df = spark.createDataFrame([t[:2] for t in trades], "paid double, final double")
    out = df.select(s.multiple(F.col("paid"), F.col("final")), s.trade_profit(F.col("paid"), F.col("final"), F.lit(True)))
    assert [tuple(r) for r in out.collect()] == [t[2:] for t in trades]
    done = df.where("paid <> 370").agg(F.sum(s.trade_profit(F.col("paid"), F.col("final"), F.lit(True)))).first()[0]
    assert done == 628.0
    assert one(spark, s.trade_profit(F.lit(1.0), F.lit(2.0), F.lit(False))) is None


def test_break_even_table(spark):
    table = {1.4: (0.85, 1.19), 2.0: (0.60, 0.83), 3.0: (0.40, 0.56), 4.0: (0.30, 0.42), 5.0: (0.24, 0.33), 6.0: (0.20, 0.28)}
    for m, want in table.items():
        got = one(spark, s.break_even(F.lit(m))), one(spark, s.break_even(F.lit(m), gain=0.4))
        assert tuple(round(x, 2) for x in got) == want


def test_profit_ceiling(spark):
    at = lambda r: one(spark, s.expected_profit(F.lit(100.0), F.lit(r)))
    assert at(0.1) == pytest.approx(320.0) and at(0.2) == pytest.approx(320.0)
    assert at(0.5) == pytest.approx(68.0) and at(1.0) == pytest.approx(-16.0)
    assert one(spark, s.cap_binds(F.lit(0.2))) and not one(spark, s.cap_binds(F.lit(0.21)))
    # A negative profit scores zero, so a defect cannot raise it.
    assert one(spark, s.candidate_score(F.lit(-10.0), F.lit(2.0), F.lit(True))) == 0.0


def test_decay_and_discount_of_nothing(spark):
    zero, null = F.lit(0), F.lit(None).cast("long")
    assert one(spark, s.decay(zero, F.lit(5))) is None and one(spark, s.decay(null, F.lit(5))) is None
    assert one(spark, s.discount_pct(F.lit(5), zero)) is None and one(spark, s.discount_pct(null, F.lit(5))) is None
    assert one(spark, s.discount_pct(F.lit(75), F.lit(100))) == 25.0


@pytest.mark.parametrize("month, bit", [(1, 8), (3, 1), (6, 2), (8, 2), (9, 4), (12, 8)])
def test_season_bit(spark, month, bit):
    day = F.lit(f"2026-{month:02d}-15").cast("date")
    assert one(spark, s.season_bit(day)) == bit
    assert one(spark, s.out_of_season(F.lit(bit), day)) is False
    assert one(spark, s.out_of_season(F.lit(15 - bit), day)) is True
    assert one(spark, s.out_of_season(F.lit(0), day)) is False


def test_sql_functions_equal_columns(spark):
    sql_udfs.register(spark)
    df = spark.createDataFrame(
        [(15000, "såld", "Märta", 0.3, "WMN-EU-38", "Kvinna > Kläder > Kjolar"), (99999, "ny", "COS", 1.2, "ONE SIZE", "x")],
        "p long, st string, b string, r double, c string, k string",
    )
    sql = df.selectExpr("price_band(p)", "outcome_of(st)", "bucket_of(b, 24)", "expected_profit(p / 100, r)", "size_area(c, k)")
    cols = df.select(
        s.price_band(F.col("p")), s.outcome_of(F.col("st")), s.bucket_of(F.col("b")),
        s.expected_profit(F.col("p") / 100, F.col("r")), s.size_area(F.col("c"), F.col("k")),
    )
    assert [tuple(r) for r in sql.collect()] == [tuple(r) for r in cols.collect()]

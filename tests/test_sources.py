import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from thriftlens import schemas
from thriftlens.functions import masks
from thriftlens.operators import filters, ladders, sampling, season, stats, trades
from thriftlens.plans import jobs
from thriftlens.sources import documents, io

D = dt.date


def write(path, docs):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(d, ensure_ascii=False) + "\n" for d in docs), encoding="utf-8")


def offer(oid, item, amount, created, ended=None, status="betald", region="SE", **extra):
    body = {"objectId": item, "itemStatus": status, "metadata": {"brand": "COS", "season": ["Vinter"]}, **extra}
    end = {"__type": "Date", "iso": ended} if ended else None
    return {"objectId": oid, "item": body, "pricing": {"amount": amount, "currency": "SEK"}, "region": region, "createdAt": created, "endedAt": end}


def test_read_newest_or_all(spark, tmp_path):
    for day, n in (("2026-08-01", 1), ("2026-08-03", 2)):
        write(tmp_path / f"check_{day}.jsonl", [{"item_id": f"{day}-{i}", "outcome": "sold"} for i in range(n)])
    pattern = str(tmp_path / "check_*.jsonl")
    assert io.read_jsonl(spark, pattern, schemas.CHECK_FILE).count() == 2
    assert io.read_jsonl(spark, pattern, schemas.CHECK_FILE, newest_only=False).count() == 3


def test_pick_absent_fields_are_null(spark, rows):
    df = spark.createDataFrame([("a", 1)], "type string, n int")
    assert rows(io.pick(df, {"item_type": "type", "gone": "missing"})) == [("a", None)]


def test_checks_file_is_replaced(spark, tmp_path):
    df = spark.createDataFrame([("a", "sold")], "item_id string, outcome string")
    for _ in range(2):
        io.write_checks(df, str(tmp_path), "2026-08-04")
    assert spark.read.json(str(tmp_path / "check_2026-08-04.jsonl")).count() == 1


@pytest.fixture(scope="module")
def listings(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs") / "listings.jsonl"
    write(
        path,
        [
            {
                "objectID": "full",
                "metadata": {"brand": "COS", "type": "Kappa", "size": "WMN-EU-38", "condition": "Bra", "material": ["Ull", "Silke"], "color": ["Blå"], "season": ["Höst", "Vinter"], "defects": ["Fläck"]},
                "categories": {"lvl1": ["Kvinna > Kläder"], "lvl2": ["Kvinna > Kläder > Jackor"]},
                "price_SE": {"amount": 19950},
                "priceDrop_SE": {"oldPrice": {"amount": 25000}},
                "weight": 0.75,
                "favouriteCount": 7,
                "firstOfferedAt_SE": 1785801600000,
                "saleStartedAt": 1785888000,
                "p2p": False,
                "images": ["https://img.example.net/a.jpg"],
                "brandClassification": {"pricePoint": 4, "styles": ["minimal"], "ethos": "Premium"},
            },
            {"objectID": "bare", "metadata": {"brand": "COS"}, "categories": {"lvl1": ["Man > Skor"]}},
            {"objectID": "naked"},
        ],
    )
    return io.read_jsonl(spark, str(path), schemas.LISTING)


def test_flat_listings(listings):
    got = {r.item_id: r for r in documents.flat_listings(listings).collect()}
    full = got["full"]
    assert (full.category, full.weight_g, full.has_defect, full.old_price_ore) == ("Kvinna > Kläder > Jackor", 750, True, 25000)
    assert (full.first_offered, full.sale_started) == (D(2026, 8, 4), D(2026, 8, 5))
    assert got["bare"].category == "Man > Skor" and got["bare"].price_ore is None and not got["bare"].has_defect
    assert got["naked"].brand is None and got["naked"].weight_g is None


def test_listing_rows(spark, listings):
    flat = documents.flat_listings(listings)
    lookup = masks.ensure_lookup(documents.lookup_values(flat), spark.createDataFrame([("condition", "Bra", 9)], "kind string, value string, id long"))
    bits = spark.createDataFrame([("season", 0, "Höst"), ("season", 3, "Vinter"), ("material", 2, "Ull")], "kind string, bit int, value string")
    out = documents.listing_rows(listings, lookup, bits, "A", F.lit(1.0), F.lit("2026-08-06").cast("date"))
    got = {r.item_id: r for r in out.collect()}
    full = got["full"]
    assert (full.season_mask, full.material_mask, full.colour_mask) == (9, 4, 0)
    assert full.condition_id == 9 and full.history == [0, 19950] and full.first_price_ore == 19950
    assert got["naked"].history is None and got["naked"].condition_id is None and got["naked"].season_mask == 0
    assert {r.id for r in lookup.where("kind <> 'condition'").collect()} == {10, 11, 12, 13}


def test_bits_past_the_width_share_the_top_one(spark):
    values = spark.createDataFrame([(f"v{i:02d}",) for i in range(20)], "value string")
    known = spark.createDataFrame([("season", 0, "old"), ("season", 1, "v05"), ("colour", 7, "v01")], "kind string, bit int, value string")
    got = {r.value: r.bit for r in masks.assign_bits(values, known, "season", 15).where("kind = 'season'").collect()}
    assert got["old"] == 0 and got["v05"] == 1 and got["v00"] == 2 and got["v04"] == 6 and got["v06"] == 7
    assert max(got.values()) == 14 and sum(b == 14 for b in got.values()) == 7
    again = masks.assign_bits(values, masks.assign_bits(values, known, "season", 15), "season", 15)
    assert again.count() == len(got) + 1


def test_brand_consensus(spark, listings):
    classes = documents.brand_classes(listings).where("brand is not null")
    r = stats.brand_consensus(classes, ["price_point", "styles", "ethos"]).first()
    assert (r.brand, r.answers, r.state, r.price_point, r.ethos) == ("COS", 1, "resolved", 4, "Premium")
    clash = spark.createDataFrame([("x", 1, "a"), ("x", 1, "b"), ("y", None, None), ("z", 2, None), ("z", 2, None)], "brand string, price_point int, ethos string")
    got = {r.brand: (r.state, r.price_point) for r in stats.brand_consensus(clash, ["price_point", "ethos"]).collect()}
    assert got == {"x": ("disagreed", None), "y": ("unresolved", None), "z": ("resolved", 2)}


@pytest.fixture(scope="module")
def offers(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("offers") / "scan_1.jsonl"
    write(
        path,
        [
            offer("o1", "orig", 1000.0, "2025-01-01T00:00:00Z", "2025-01-10T00:00:00Z"),
            offer("o2", "orig", 420.0, "2025-01-10T00:00:00Z", "2025-02-01T00:00:00Z"),
            offer("o2x", "orig", 42.0, "2025-01-10T00:00:00Z", "2025-02-01T00:00:00Z", region="DE"),
            offer("o3", "re", 800.0, "2025-03-01T00:00:00Z", "2025-04-01T00:00:00Z", "såld", preceding={"objectId": "orig"}),
            offer("o4", "re", 600.0, "2025-04-01T00:00:00Z", "2025-05-01T00:00:00Z", "såld", preceding={"objectId": "orig"}),
            offer("o5", "lost", 300.0, "2025-03-01T00:00:00Z", None, "utlagd", preceding={"objectId": "nowhere"}),
            offer("o6", "plain", 300.0, "2025-03-01T00:00:00Z", "2025-03-09T00:00:00Z", "vilande"),
            offer("o7", "plain", 350.0, "2025-03-09T00:00:00Z", None, "vilande"),
        ],
    )
    return io.read_jsonl(spark, str(path), schemas.OFFER)


def test_offers_to_round_trips(offers):
    steps, details = documents.offer_steps(offers), documents.offer_details(offers)
    assert steps.count() == 7
    rows = ladders.ladder_rows(steps, details)
    got = {r.item_id: r for r in rows.collect()}
    assert (got["orig"].opening_ask_ore, got["orig"].final_price_ore, got["orig"].decay, got["orig"].ended_on) == (100000, 42000, 0.58, D(2025, 2, 1))
    assert got["re"].sold and not got["plain"].sold and got["plain"].decay == -0.167
    resales = details.select("item_id", "original_id")
    trips = trades.round_trips(resales, rows).collect()
    assert [(t.item_id, t.multiple, t.profit_kr, t.days_held, t.days_listed) for t in trips] == [("re", 1.43, 84.0, 28, 61)]
    origins = {r.item_id: r for r in trades.origins(resales, rows).collect()}
    assert origins.keys() == {"re", "lost"}
    assert origins["re"].bought_price_ore == 42000 and origins["lost"].bought_price_ore is None


def test_monotonicity_counts_the_increase(offers):
    r = ladders.monotonicity(documents.offer_steps(offers)).first()
    assert (r.transitions, r.increases, r.items_affected) == (3, 1, 1)


def test_season_history_keeps_ended_listings(offers):
    out = season.season_history(documents.offer_steps(offers), documents.offer_details(offers))
    assert {r.item_id for r in out.collect()} == {"orig", "re"}


def test_stragglers(spark, offers):
    items = spark.createDataFrame([("re", 4), ("lost", 4), ("plain", 4), ("orig", 1)], "item_id string, outcome int")
    got = {r.item_id: r.outcome for r in ladders.stragglers(items, documents.offer_steps(offers), 50000).collect()}
    assert got == {"re": 1, "plain": 2, "lost": 4}
    back = {r.item_id: r.outcome for r in ladders.stragglers(items, documents.offer_steps(offers), 10000).collect()}
    assert back["lost"] is None


def test_load_local_twice_gives_the_same(spark, tmp_path):
    again = {"item_id": "a", "stratum": "screen", "type": "Kappa", "is_circle": True}
    write(tmp_path / "cohort_baseline.jsonl", [{"item_id": "a", "stratum": "baseline"}, again])
    for day, outcome in (("2026-08-01", "still_listed"), ("2026-08-08", "error:TimeoutError")):
        write(tmp_path / "cohort_checks" / f"check_{day}.jsonl", [{"item_id": "a", "checked_on": day, "outcome": outcome}])
    write(tmp_path / "roundtrips_1.jsonl", [{"circle_id": "r", "ended_on": "2026-08-01", "multiple": 1.5, "type": "Kappa", "days_on_circle": 4}])
    write(tmp_path / "dormant_circle_1.jsonl", [{"circle_id": "r", "multiple": 9.0}, {"circle_id": "q"}])
    write(tmp_path / "ladders_1.jsonl", [{"item_id": "old"}])
    write(tmp_path / "ladders_2.jsonl", [{"item_id": "l", "ladder": [{"price": 1.0, "from": "2026-08-01", "to": None}]}])
    once = jobs.load_local(spark, str(tmp_path), {})
    twice = jobs.load_local(spark, str(tmp_path), once)
    for name, df in once.items():
        assert sorted(df.collect(), key=repr) == sorted(twice[name].collect(), key=repr)
    assert {r.outcome for r in once["cohort_checks"].collect()} == {"still_listed", "error"}
    assert {r.resale_id: r.multiple for r in once["round_trips"].collect()} == {"r": 1.5, "q": None}
    assert [r.item_id for r in once["item_ladders"].collect()] == ["l"]
    first = once["cohort_items"].first()
    assert (first.item_type, first.stratum, first.is_resale) == ("Kappa", "screen", True)
    assert {r.resale_id: r.days_listed for r in once["round_trips"].collect()} == {"r": 4, "q": None}


def test_checks_written_are_checks_loaded(spark, tmp_path):
    rows = spark.createDataFrame([("a", D(2026, 8, 9), "sold", "betald", 95.0, 2)], schemas.CHECK_FILE)
    io.write_checks(rows, str(tmp_path / "cohort_checks"), "2026-08-09")
    loaded = jobs.load_local(spark, str(tmp_path), {})["cohort_checks"]
    assert [tuple(r) for r in loaded.collect()] == [tuple(r) for r in rows.collect()]


def test_failed_step_skips_only_its_chain():
    done = []

    def fail():
        raise RuntimeError("no file")

    report = jobs.run_steps([("a", "x", fail), ("b", "x", lambda: done.append("b")), ("c", "y", lambda: done.append("c"))])
    assert [s for _, s in report] == ["failed: RuntimeError: no file", "skipped", "ok"] and done == ["c"]


def test_fits_profile(spark):
    rows = spark.createDataFrame(
        [
            ("straddle", ["MEN-INT-L", "MEN-INT-XL"], "Man"),
            ("suit", ["WMN-EU-34", "WMN-EU-38"], "Kvinna"),
            ("her_shoe", ["SHOES-EU-40"], "Kvinna"),
            ("his_shoe", ["SHOES-EU-40"], "Man"),
            ("none", None, "Man"),
        ],
        "item_id string, sizes array<string>, demography string",
    )
    targets = spark.createDataFrame([("MEN-INT-L", None), ("MEN-INT-XL", None), ("WMN-EU-38", None), ("SHOES-EU-40", "Kvinna")], "size_code string, demography string")
    assert sorted(r.item_id for r in filters.fits_profile(rows, targets).collect()) == ["her_shoe", "straddle", "suit"]


def test_bucket_counts_overlap(spark):
    rows = spark.createDataFrame(
        [("a", ["S", "M"], "Man"), ("b", ["M"], "Kvinna"), ("c", ["40"], "Man"), ("d", ["40", "41"], "Kvinna")],
        "item_id string, sizes array<string>, demography string",
    )
    targets = spark.createDataFrame(
        [("S", None, "top"), ("M", None, "top"), ("40", "Kvinna", "shoes"), ("41", None, "shoes")],
        "size_code string, demography string, bucket string",
    )
    got = {(r.kind, r.name): r.n for r in sampling.target_size_counts(rows, targets).collect()}
    assert got == {("bucket", "top"): 2, ("bucket", "shoes"): 1, ("shape", "size implies wearer"): 3, ("shape", "Kvinna"): 1}


def test_category_exclusion_is_by_path(spark):
    rows = spark.createDataFrame([("Prylar > Hemelektronik",), ("Prylar > Hemelektronik > TV",), ("Prylar > Hemelektronikbok",), (None,)], "category string")
    gone = spark.createDataFrame([("Prylar > Hemelektronik",)], "path string")
    assert {r.category for r in filters.exclude_categories(rows, gone).collect()} == {"Prylar > Hemelektronikbok", None}


def test_unknown_dimension_raises(spark):
    from thriftlens.operators import slices

    with pytest.raises(ValueError):
        slices.market_slice(spark.range(1), "id; drop table")


def test_landed_lines_are_compressed_files_of_bounded_length(spark, tmp_path, monkeypatch):
    """Names repeat in every line: the files hold a fraction of the text, and each a bounded number of lines."""
    monkeypatch.setattr(io, "FILE_LINES", 400)
    lines = spark.range(1000).coalesce(1).select(F.to_json(F.struct(F.col("id").alias("objectID"), F.lit("a brand").alias("brand"))))
    io.write_lines(lines, str(tmp_path / "landed"))
    files = list((tmp_path / "landed").glob("part-*.gz"))
    assert len(files) == 3 and sum(f.stat().st_size for f in files) < 15_000
    rows = spark.read.json(str(tmp_path / "landed")).collect()
    assert sorted(r.objectID for r in rows) == list(range(1000))

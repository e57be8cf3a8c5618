"""Every registered query on the smallest given tables, next to its SQL or a plain reading."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check import compare, connect
from tests.llm.test_lines import brute as brute_runs
from tests.llm.test_private import seeds
from tests.llm.test_resemblance import brute_kept
from tests.llm.test_simhash import brute_components, plain_fingerprint
from tests.llm.test_texts import words
from thriftlens.llm import licences, lines
from thriftlens.llm.queries import ORACLES, QUERIES
from thriftlens.session import cut_lineage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_all_operators_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(contract.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    ok, note = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert ok, note


def test_op1(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op1_personal_data"](spark, SF).collect()}
    for doc_id, text in documents:
        want, r = seeds(text), got[doc_id]
        kinds = Counter(k for k, *_ in want)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds[k] for k in ("email", "ip", "card", "phone")]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


def test_op3(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op3_simhash_near_dedup"](spark, SF).collect()}
    prints = [plain_fingerprint(t) for _, t in documents]
    for (doc_id, _), p, c in zip(documents, prints, brute_components([i for i, _ in documents], prints)):
        assert (got[doc_id]["fingerprint"], got[doc_id]["component_id"]) == (f"{p:016x}", c)


def test_op4(spark, documents):
    rows = QUERIES["op4_sharding"](spark, SF).collect()
    text = dict(documents)
    for r in rows:
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    counts = Counter(r["shard"] for r in rows)
    assert sorted(r["doc_id"] for r in rows) == sorted(text) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((s, k) for s, n in counts.items() for k in range(n))


def test_op6(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op6_license_notices"](spark, SF).collect()}
    for doc_id, text in documents:
        w, r = words(text), got[doc_id]
        places = sorted(
            (k, label) for p, label in licences.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()
        )
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op7(spark, documents):
    want = brute_runs(documents, lines.LEAST_WORDS)
    for r in QUERIES["op7_repeated_passages"](spark, SF).collect():
        assert r["spans"] == ",".join(f"{a}:{b}" for a, b in want[r["doc_id"]])


def test_op8(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    pairs = [(a["score"], b["score"]) for a in held for b in held if toxic[a["doc_id"]] and not toxic[b["doc_id"]]]
    assert sum(a > b for a, b in pairs) / len(pairs) > 0.75
    assert not any(r["predicted"] and not toxic[r["doc_id"]] for r in held)


def test_pipeline_stages(spark, con, documents):
    """Each stage on what the one before it kept, held against its operator's own result or a plain reading."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    text = dict(documents)
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.columns == (columns if k < 4 else [*columns, "shard", "slot"])
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:]))
    left = [(i, text[i]) for i in sorted(kept[0])]
    assert kept[1] == {left[x][0] for x in brute_kept(left)}
    dirty = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op5_decontamination']}) WHERE contaminated").fetchall()}
    assert kept[2] == kept[1] - dirty and kept[4] == kept[3]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept[4]

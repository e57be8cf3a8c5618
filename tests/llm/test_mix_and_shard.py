"""Raking against its targets and DuckDB, and the laws of the shuffle."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thriftlens.llm import mixing, sharding


@pytest.fixture(scope="module")
def many(docs):
    rnd = random.Random(8)
    rows = []
    for i in range(3000):
        text = " ".join(["w"] * rnd.randint(1, 90)) + rnd.choice([" | a", "!! b", " License", "", ""])
        rows.append((i, text, rnd.choice(["en", "en", "de", None]), rnd.choice(["a"] * 6 + ["b", "c", None])))
    return docs(rows)


def test_weights_meet_the_targets(many):
    found = mixing.mixed(many, rounds=40).select("source", "lang", "_mix.*").toPandas()
    found["t"] = found.n_tokens * found.probability * found.weight
    for name, power in mixing.POWERS.items():
        tokens = found.groupby(name, dropna=False)[["n_tokens", "t"]].sum()
        target = tokens.n_tokens**power / (tokens.n_tokens**power).sum()
        assert ((tokens.t / tokens.t.sum() - target).abs() < 1e-6).all()
    assert found.probability.between(0, 1).all() and (found.weight >= 1 - 1e-12).all()
    assert abs(found.t.sum() / found.n_tokens.sum() - mixing.FRACTION) < 1e-6


def test_sample_follows_the_probabilities(many):
    found = mixing.mixed(many).select("_mix.*")
    expected, got = found.agg(F.sum("probability"), F.sum(F.col("sampled").cast("int"))).first()
    assert abs(expected - got) < 4 * expected**0.5
    kept = mixing.sample(many, within=False)
    assert kept.columns == many.columns and kept.count() == got
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in mixing.sample(many, within=False).collect())


def test_sampled_documents_meet_the_targets(spark):
    """Without weights: the tokens of what is kept, source by source, language by language, topic by topic."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").drop("mix")
    found = mixing.mixed(docs, within=True, rounds=40).select("source", "lang", "mix.*").toPandas()
    assert found.weight.between(1 - 1e-9, 1 + 1e-9).all() and found.probability.max() > 1 - 1e-9
    for name, power in mixing.POWERS.items():
        tokens = found.groupby(name)[["n_tokens"]].sum().n_tokens
        target = tokens**power / (tokens**power).sum()
        kept = found[found.sampled]
        got = kept.groupby(name).n_tokens.sum() / kept.n_tokens.sum()
        expected = (found.n_tokens * found.probability).groupby(found[name]).sum() / (found.n_tokens * found.probability).sum()
        assert ((expected - target).abs() < 1e-4).all()
        spread = ((found.n_tokens**2 * found.probability * (1 - found.probability)).groupby(found[name]).sum() ** 0.5) / kept.n_tokens.sum()
        assert ((got - target).abs() < 5 * spread + 0.01).all()


def test_odd_rows_mix(odd):
    got = {r["text"]: r["_mix"] for r in mixing.mixed(odd).collect()}
    assert len(mixing.mixed(odd).collect()) == 10 and got[""]["n_tokens"] == 0
    assert mixing.mixed(odd.limit(0)).count() == 0
    blank = odd.where("text is null")
    assert {(r["_mix"]["probability"], r["_mix"]["weight"]) for r in mixing.mixed(blank).collect()} == {(0.7, 1.0)}


@pytest.mark.parametrize("shards,size", [(16, 1 << 26), (3, 1000)])
def test_shuffle_laws(many, shards, size):
    out = sharding.shuffled(many, shards=shards, bucket_bytes=size)
    assert out.columns == [*many.columns, "_shard", "_slot"]
    rows = out.select("doc_id", "text", "_shard", "_slot").collect()
    source = {r["doc_id"]: r["text"] for r in many.collect()}
    assert len(rows) == len(source) and all(source[r["doc_id"]] == r["text"] for r in rows)
    counts = Counter(r["_shard"] for r in rows)
    assert set(counts) == set(range(shards)) and max(counts.values()) - min(counts.values()) <= 1
    assert Counter((r["_shard"], r["_slot"]) for r in rows) == Counter((s, k) for s, n in counts.items() for k in range(n))
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["_shard"], r["_slot"]))]
    rising = sum(a < b for a, b in zip(order, order[1:]))
    assert 0.45 < rising / len(order) < 0.55  # neither the order of the table nor of a hash of few buckets


def test_the_order_does_not_depend_on_the_partitions(many):
    columns = ["doc_id", "_shard", "_slot"]
    place = lambda df, **o: sorted(map(tuple, sharding.shuffled(df, bucket_bytes=1000, **o).select(*columns).collect()))
    once = place(many)
    assert place(many.repartition(7)) == once and place(many.orderBy("text").coalesce(2)) == once
    assert place(many, seed=43) != once


def test_odd_rows_shuffle(odd, docs):
    rows = sharding.shuffled(odd).select("*", sharding.size_of(F.col("text")).alias("size"), sharding.crc_of(F.col("text")).alias("crc")).collect()
    assert len(rows) == 10 and sorted(r["_shard"] for r in rows) == list(range(10)) and {r["_slot"] for r in rows} == {0}
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["crc"]) == (len(data) + 1, zlib.crc32(data))
    assert sharding.shuffled(odd.limit(0)).count() == 0
    same = docs([(1, "same")] * 100)
    assert Counter(r["_shard"] for r in sharding.shuffled(same, shards=4).collect()) == {0: 25, 1: 25, 2: 25, 3: 25}

"""Language prediction: held-out accuracy, calibration, rejection and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thriftlens.llm import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.col("doc_id") % 3 != 1)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 1")
    rows = language.predicted(docs, model).select("lang", "language").collect()
    right = [r["language"]["lang"] == r["lang"] for r in rows]
    assert np.mean(right) > 0.99
    sure = np.array([r["language"]["score"] for r in rows])
    # Calibrated: the probabilities say how often the predictions are right.
    assert abs(sure.mean() - np.mean(right)) < 0.03 and (sure > 0).all() and (sure <= 1).all()


def test_short_texts(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 1")
    short = docs.withColumn("text", F.array_join(F.slice(F.split("text", " "), 3, 8), " ")).where(language.has_letter(F.col("text")))
    got = language.predicted(short, model).agg(F.avg((F.col("language.lang") == F.col("lang")).cast("int"))).first()[0]
    assert got > 0.9


def test_same_model_from_any_partitioning(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7, "n_chars")
    again = language.fit(docs, F.col("doc_id") % 3 != 1)
    assert (again.embeddings == model.embeddings).all() and again.temperature == model.temperature and again.accept == model.accept


def test_labels_of_other_rows_are_not_read(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    assert (language.fit(wrong, F.col("doc_id") % 3 != 1).embeddings == model.embeddings).all()


def test_odd_rows(spark, odd, model):
    found = language.predicted(odd, model)
    assert found.columns == [*odd.columns, "language"] and found.count() == odd.count()
    for r in found.collect():
        lang, score, accepted = r["language"]
        if not (r["text"] or "").strip():
            assert (lang, score, accepted) == ("und", 0.0, False)
        else:
            assert lang in model.languages and 0 < score <= 1
    digits = spark.createDataFrame([("12 345 -- 😀", "own")], "text string, language string")
    row = language.predicted(digits, model).first()
    assert row["language"] == "own" and row["_language"]["lang"] == "und"
    assert language.predicted(odd.limit(0), model).count() == 0


def test_no_labels(odd):
    none = language.fit(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert none.languages == [] and {r["language"]["lang"] for r in language.predicted(odd, none).collect()} == {"und"}
    one = language.fit(odd, F.lit(True))
    assert one.languages == ["en"] and {r["language"]["lang"] for r in language.predicted(odd, one).collect()} == {"en", "und"}


def test_parts_of_long_texts():
    rng = np.random.default_rng(0)
    text = b" ".join(bytes(rng.integers(97, 123, rng.integers(1, 9)).tolist()) for _ in range(5000))
    whole = np.sort(language.pieces(text))
    old, language.PART_BYTES = language.PART_BYTES, 1000
    try:
        parts = list(language._parts(text))
    finally:
        language.PART_BYTES = old
    assert len(parts) > 5 and b"".join(parts) == text
    assert (np.sort(np.concatenate([language.pieces(p) for p in parts])) == whole).all() or len(
        np.concatenate([language.pieces(p) for p in parts])
    ) == len(whole)


def test_rejection():
    """The threshold lets pass what is wrong no more often than stated, and everything if nothing is wrong."""
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 4000)
    means = (labels * 2 - 1)[:, None] * 1.0 + rng.normal(0, 1, (4000, 1))
    model = language.Model(["a", "b"], np.zeros((1, 1)), np.array([[-4.0, 4.0]]), np.zeros(2))
    language.calibrate(model, means, labels)
    sure = language.softmax(model.logits(means) / model.temperature)
    accepted = sure.max(axis=1) >= model.accept
    wrong = (sure.argmax(axis=1) != labels)[accepted].mean()
    assert 0.1 < accepted.mean() < 1 and wrong <= language.MOST_WRONG
    assert abs(sure.max(axis=1).mean() - (sure.argmax(axis=1) == labels).mean()) < 0.03 and 3 < model.temperature < 5
    clear = language.calibrate(language.Model(["a", "b"], np.zeros((1, 1)), np.array([[-4.0, 4.0]]), np.zeros(2)), labels[:, None] * 2.0 - 1, labels)
    assert clear.accept == 0.0

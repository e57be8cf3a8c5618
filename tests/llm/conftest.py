import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""

    def make(rows, extra=()):
        full = [(r[0], r[1], *(r[2:] or ("en", "web")), None if r[1] is None else len(r[1])) for r in rows]
        names = ["overlap", "license", "toxicity", "mix", "topic", "n_tokens", "fingerprint", "shard", "slot", "bucket", "record", "place", "runs_found", "rank_of_row"]
        names = names if extra == () else list(extra)
        schema = ", ".join([DOCUMENT, *(f"{n} string" for n in names)])
        return spark.createDataFrame([(*r, *(f"own {n}" for n in names)) for r in full], schema)

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "word"),
    (4, "word"),
    (None, "no id here, no id at all"),
    (None, None),
    (5, "Ünïcode 😀 text\x00 with a zero\r\nand lines"),
    (6, "long " * 20_000),
    (7, "x" * 50_000),
]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)

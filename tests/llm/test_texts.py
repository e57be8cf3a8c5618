"""Contamination, license notices and the helpers they share, against brute force."""

import random
import re

import pytest

from thriftlens.llm import decontaminate, licences
from thriftlens.llm.texts import words_of


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def test_words():
    text = "A-b, É9 ß\x00z 😀x_y"
    assert [w.decode() for w in words_of(text.encode())] == words(text)


def brute_overlap(text, items, window=13):
    w = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        i = words(item)
        k = min(window, len(i))
        for s in range(len(i) - k + 1 if k else 0):
            for at in range(len(w) - k + 1):
                if w[at : at + k] == i[s : s + k]:
                    hit |= set(range(at, at + k))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def overlapping(spark, docs):
    rnd = random.Random(7)
    vocabulary = ["the", "of", "cat", "dog", "É", "run", "x9"]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, prose(rnd.choice([1, 3, 12, 13, 14, 30]))) for k in range(14)] + [(3, prose(5)), (20, None), (21, " ")]
    items += [(None, "alpha beta gamma delta")]
    texts = [prose(rnd.choice([0, 1, 5, 40])) for _ in range(25)]
    texts += [f"{prose(20)} {item}, {prose(9)}" for _, item in items[:14]]
    texts += ["so alpha, BETA gamma delta it is", None, ""]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    return items, rows, spark.createDataFrame(items, "item_id long, text string"), docs(rows)


@pytest.mark.parametrize("chunk", [2_000_000, 20])
def test_overlaps(overlapping, chunk):
    items, rows, benchmark, documents = overlapping
    found = decontaminate.overlaps(documents, benchmark, chunk_words=chunk)
    assert found.columns[-1] == "_overlap" and "overlap" in found.columns
    got = sorted(
        ((r["doc_id"], r["_overlap"]) for r in found.collect()), key=lambda x: (x[0], x[1]["n_words"])
    )
    for (doc_id, text), (got_id, x) in zip(sorted(rows, key=lambda r: (r[0], len(words(r[1])))), got):
        hits = sum(r["end"] - r["start"] for r in x["runs"])
        assert (got_id, (x["n_words"], hits, x["items"])) == (doc_id, brute_overlap(text, items))


def test_decontaminated_keeps_clean_rows_and_columns(overlapping):
    items, rows, benchmark, documents = overlapping
    kept = decontaminate.decontaminated(documents, benchmark)
    assert kept.columns == documents.columns
    bad = {k for k, (n, h, _) in ((k, brute_overlap(t, items)) for k, t in rows) if h and 20 * h >= n}
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in rows} - bad


def test_odd_documents_and_empty_benchmark(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(odd, none).count() == 10
    some = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert sorted(r["text"] for r in odd.exceptAll(decontaminate.decontaminated(odd, some)).collect()) == ["word"] * 2
    assert decontaminate.decontaminated(odd.limit(0), some).count() == 0


def edits(pattern, text):
    """The smallest edit distance of ``pattern`` to a part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def bent(text, n, rnd):
    for _ in range(n):
        k = rnd.randrange(len(text))
        text = rnd.choice([text[:k] + "q" + text[k:], text[:k] + text[k + 1 :], text[:k] + "q" + text[k + 1 :]])
    return text


def test_license_places(docs):
    rnd = random.Random(5)
    texts = [f"so it is {bent(w, n, rnd)} and more" for w in licences.NOTICES for n in range(7)]
    texts += ["CC BY cc-by, Cc\nBY", "cc bye", "All rights reserved. all rights RESERVED", None, "", "GNU General Public License"]
    notices = licences.notices_of(licences.PHRASES, licences.NOTICES, 0.1)
    found = licences.license_places(docs(list(enumerate(texts))))
    for r in found.collect():
        text, got = texts[r["doc_id"]] or "", r["_license"]
        w = words(text)
        assert got["n_words"] == len(w)
        base = [
            (k, label) for p, label in licences.PHRASES.items() for k in range(len(w))
            if w[k : k + len(p.split())] == p.split()
        ]
        assert sorted((p["first_word"], p["label"]) for p in got["places"] if p["kind"] == "base") == sorted(base)
        joined = " ".join(w)
        want = {n.label for n in notices if n.kind == "fuzzy" and edits(n.words, joined) <= n.errors}
        assert {p["label"] for p in got["places"] if p["kind"] == "fuzzy"} == want, text
        for p in got["places"]:
            assert words(text[p["start"] : p["end"]]) == w[p["first_word"] : p["last_word"] + 1]
            assert 0 <= p["score"] <= 1


def test_license_odd(odd):
    assert licences.license_places(odd).where("size(_license.places) > 0").count() == 0
    assert licences.license_places(odd.limit(0)).count() == 0


def edits_within(notice, text):
    """The least number of edits between the notice and any part of the text, by Sellers' rows."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        ahead = [0]
        for k, n in enumerate(notice, 1):
            ahead.append(min(row[k] + 1, ahead[k - 1] + 1, row[k - 1] + (c != n)))
        row = ahead
        best = min(best, row[-1])
    return best


def test_fuzzy_labels_are_the_notices_within_their_errors():
    rnd = random.Random(21)
    notices = licences.notices_of(licences.PHRASES, licences.NOTICES, 0.1)
    of_text = licences._places(notices)()
    for _ in range(250):
        notice = rnd.choice(notices)
        letters = list(notice.words)
        for _ in range(rnd.randint(0, notice.errors + 2)):
            at = rnd.randrange(len(letters) + 1)
            letters[at : at + rnd.randint(0, 1)] = rnd.choice(["", "q", "zz"[: rnd.randint(1, 2)]])
        text = f"some words before {''.join(letters)} and some behind"
        joined = " " + " ".join(text.split()) + " "
        got = {(p["kind"], p["label"]) for p in of_text(text.encode())["places"] if p["kind"] == "fuzzy"}
        want = {("fuzzy", n.label) for n in notices if n.kind == "fuzzy" and edits_within(n.words, joined) <= n.errors}
        assert got == want, text


def test_very_many_places_take_time_in_proportion():
    import time

    of_text = licences._places(licences.notices_of(licences.PHRASES, licences.NOTICES, 0.1))()
    start = time.time()
    places = of_text(b"all rights reserved " * 16_000)["places"]
    assert sum(p["kind"] == "base" for p in places) == 16_000 and time.time() - start < 3
    assert places[-1]["last_word"] == 47_999


def test_tables_of_a_benchmark_chunk_stay_small():
    """The tables of a chunk at its bound, as a share of it that is quick to make."""
    import tracemalloc

    rnd = random.Random(1)
    share = 20
    words = decontaminate.CHUNK_WORDS // share
    items = [(k, " ".join(f"w{rnd.randrange(50_000)}" for _ in range(500)).encode()) for k in range(words // 500)]
    tracemalloc.start()
    made = decontaminate._finder(items, 13, 3)()
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert made(items[3][1])["items"] == ["3"] and size * share < 200e6


def test_chunks_are_fetched_one_at_a_time(spark):
    bench = spark.createDataFrame([(k, f"word{k} " * 60) for k in range(40)], "item_id long, text string")
    chunks = decontaminate.benchmark_chunks(bench, 300)
    assert next(chunks) is not None and not isinstance(chunks, list)
    assert sorted(i for c in decontaminate.benchmark_chunks(bench, 300) for i, _ in c) == list(range(40))

"""Personal data against the plain forms, and contexts that lead to more."""

import random
import re

from thriftlens.llm import private

# The plain forms.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def seeds(text):
    return [
        (kind, m.start(), m.end(), m[0])
        for kind, form in FORMS.items()
        for m in re.finditer(form, text or "")
        if valid(kind, m[0])
    ]


def found(df):
    return [
        (r["doc_id"], [(s["kind"], s["start"], s["end"], s["match"]) for s in r["spans"]])
        for r in private.identifiers(df).collect()
    ]


PIECES = ["a", "@", ".", "b.c", "%x@d.e", "1", "256.1.2.3", "00.0.010.255", "+1", " ", "-", "(555) 010-2345", "é", "😀",
          "4539 1488 0343 6467", "4539148803436467", "x@y", "\n", "+", "12345678"]


def test_seeds_match_the_plain_forms(docs):
    rnd = random.Random(11)
    texts = ["".join(rnd.choices(PIECES, k=rnd.randrange(13))) for _ in range(3000)]
    got = dict(found(docs(list(enumerate(texts)))))
    for k, text in enumerate(texts):
        assert [s for s in got[k] if s[0] in FORMS] == seeds(text), text


def test_odd_rows(odd):
    got = found(odd)
    assert len(got) == 10 and all(spans == [] for _, spans in got)


def test_long_runs_stay_linear(docs):
    texts = ["a" * 200_000, "1." * 100_000, "a.b" * 60_000 + "@", "7" * 200_000, "+" * 200_000, "1 2-" * 50_000]
    got = dict(found(docs(list(enumerate(texts)))))
    assert [len([s for s in got[k] if s[0] in FORMS]) for k in range(6)] == [0, 25_000, 0, 0, 0, 0]
    assert all(s[0] in FORMS or s[0] == "context" for spans in got.values() for s in spans)


def test_no_rows(docs):
    assert found(docs([]).limit(0)) == []


def test_contexts_discover_what_the_forms_miss(docs):
    known = [(k, f"Please write to mailbox: user{k}@host{k}.example.org today or call again") for k in range(12)]
    unseen = [(100, "Please write to mailbox: user77@intranet today"), (101, "the mailbox: 77 was empty")]
    clean = [(200 + k, f"the invoice total 1000{k}00 was paid to the clerk of the town") for k in range(5)]
    got = dict(found(docs(known + unseen + clean)))
    assert ("context", 25, 40, "user77@intranet") in got[100]
    assert all(s[0] != "context" for k, spans in got.items() for s in spans if k != 100)


def test_common_words_are_no_pattern(docs):
    """Seeds behind a word that stands before everything do not make a pattern."""
    known = [(k, f"the the the user{k}@host{k}.example.org the old house and the sea") for k in range(12)]
    got = dict(found(docs([*known, (100, "the 123456789 stones")])))
    assert got[100] == []


def test_random_strings_lead_to_other_values_behind_their_words(docs):
    """Long strings of digits and letters are seeds of their own kind, and the words before them a pattern that finds shorter values."""
    rnd = random.Random(5)
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    known = [(k, f'and then token = "{key(40)}" was left in the text') for k in range(9)]
    unseen = [(100, 'here token = "k3y-0042x" was left'), (101, "a price of 100042x was paid")]
    clean = [(200, "Donaudampfschifffahrtsgesellschaftskapitaen " + "-" * 60), (201, "1" * 31 + " " + "2" * 40), (202, "x" * 50)]
    got = dict(found(docs(known + unseen + clean)))
    for k, text in known:
        assert [s for s in got[k] if s[0] == "secret"] == [("secret", 18, 58, text[18:58])]
    assert got[100] == [("context", 14, 23, "k3y-0042x")]
    assert all(not [s for s in got[k] if s[0] in ("secret", "context")] for k in (101, 200, 201, 202))


def test_every_secret_of_the_given_documents_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = {r["doc_id"]: r["text"] for r in docs.where(r"""text rlike 'token = "[0-9a-f]{40}"'""").collect()}
    got = {d: spans for d, spans in found(docs)}
    assert len(hidden) > 5
    for doc_id, text in hidden.items():
        for m in re.finditer('token = "([0-9a-f]{40})"', text):
            assert ("secret", m.start(1), m.end(1), m[1]) in got[doc_id]

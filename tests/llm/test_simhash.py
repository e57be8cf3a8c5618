"""Fingerprints, anchors, components and near duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from thriftlens.llm import covering, simhash
from thriftlens.llm.components import components


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_every_word_is_near_one_codeword():
    by_byte, leader, steps = covering.tables(2)
    assert sorted({int(x).bit_count() for x in leader}) == [0, 1, 2, 3] and len(set(leader.tolist())) == 2048


@pytest.mark.parametrize("threshold,blocks", [(4, 2), (4, 1), (3, 2), (0, 2)])
def test_near_fingerprints_share_an_anchor(threshold, blocks):
    rnd = random.Random(threshold)
    a = np.array([rnd.getrandbits(64) for _ in range(3000)], dtype=np.uint64)
    flips = [rnd.sample(range(64), rnd.randint(0, threshold)) for _ in a]
    b = np.array([int(x) ^ sum(1 << k for k in f) for x, f in zip(a, flips)], dtype=np.uint64)
    sets = []
    for values in (a, b):
        of = [set() for _ in values]
        for at, found in covering.anchors(values, threshold, blocks):
            for k, anchor in zip(at.tolist(), found.tolist()):
                assert anchor not in of[k]
                of[k].add(anchor)
        sets.append(of)
    assert all(x & y for x, y in zip(*sets))


def brute_components(ids, prints):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= 4:
                root[find(x)] = find(y)
    named = {}
    for x in range(len(ids)):
        named.setdefault(find(x), []).append(ids[x])
    return [min((i for i in named[find(x)] if i is not None), default=None) for x in range(len(ids))]


def test_near_duplicates(docs):
    rnd = random.Random(4)
    prose = lambda n: [rnd.choice("abcdefgh") * rnd.randint(1, 3) + rnd.choice(["", "é"]) for _ in range(n)]
    texts = []
    for _ in range(12):
        words = prose(rnd.choice([5, 60, 300]))
        for _ in range(rnd.choice([1, 2, 9])):
            changed = list(words)
            for _ in range(rnd.randint(0, 3)):
                changed[rnd.randrange(len(changed))] = "other"
            texts.append(" ".join(changed))
    texts += [None, "", " \n", "one", "One", "two words", "a b c d", "x " * 5000]
    ids = rnd.sample(range(1000), len(texts))
    rows = [*zip(ids, texts), (None, texts[0]), (None, "alone and unnamed is this one"), (ids[3], texts[3])]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints)
    got = simhash.near_duplicates(docs(rows)).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    seen = [(r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got]
    assert sorted(seen, key=key) == sorted(((i, p, c) for (i, _), p, c in zip(rows, prints, want)), key=key)


def test_dense_group_is_one_component(spark):
    """Thousands of fingerprints around one, far more than a small bucket, are one component."""
    rnd = random.Random(9)
    center = rnd.getrandbits(62)
    near = {center} | {center ^ sum(1 << k for k in rnd.sample(range(62), 2)) for _ in range(1500)}
    far = {rnd.getrandbits(62) for _ in range(500)}
    classes = spark.createDataFrame([(x,) for x in near | far], "fingerprint long")
    found = simhash.links(classes)
    assert found.count() < 40 * len(near)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    assert {roots[x] for x in near} == {min(near)}


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(200) if k != 120] + [(7, 7), (None, 3)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {k: 0 if k <= 120 else 121 for k in range(201)}


def test_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10 and {r["component_id"] for r in got if r["fingerprint"] == 0} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0

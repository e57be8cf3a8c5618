"""Repeated passages against a plain reading of the units."""

import random

from thriftlens.llm import lines


def plain_units(text):
    """(words, start, end) of the units, word by word."""
    ends, found, held = lines.EndsUnit(lines.ENDS), [], []
    least, most = lines.UNIT_WORDS
    word, start = "", 0

    def close():
        if held:
            found.append((" ".join(w for w, _, _ in held), held[0][1], held[-1][2], len(held)))
            held.clear()

    for k, c in enumerate(text + "\n"):
        if c in " \t\n\x0b\x0c\r":
            if word:
                low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in word)
                held.append((low, start, k))
                if len(held) == most or len(held) >= least and ends[low.encode()]:
                    close()
            word = ""
            if c == "\n":
                close()
        else:
            start = k if not word else start
            word += c
    return found


def brute(rows, least_words):
    """Runs (start, end) by row, from all units of all rows; ``rows`` have distinct ids."""
    all_units = {i: plain_units(t or "") for i, t in rows}
    first = {}
    for i in sorted(all_units):
        for k, u in enumerate(all_units[i]):
            first.setdefault(u[0], (i, k))
    out = {}
    for i, found in all_units.items():
        done, last = [], None
        for k, (words, start, end, n) in enumerate(found):
            if first[words] == (i, k):
                continue
            if last == k - 1 and done:
                done[-1] = (done[-1][0], end, done[-1][2] + n)
            else:
                done.append((start, end, n))
            last = k
        out[i] = [(a, b) for a, b, n in done if n >= least_words]
    return out


def test_runs_match_brute_force(docs):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeÉß😀XY") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: "".join(word() + rnd.choice([" "] * 12 + ["\n", "  ", "\t", "\r\n"]) for _ in range(n))
    passages = [prose(n) for n in (8, 20, 60, 120)]
    texts = [prose(30) + rnd.choice(passages) + prose(20) + rnd.choice([*passages, ""]) for _ in range(40)]
    rows = list(enumerate([*texts, texts[0], None, "", " \n", "One line\n" * 30]))
    got = {r["doc_id"]: r for r in lines.repeated(docs(rows)).collect()}
    want = brute(rows, lines.LEAST_WORDS)
    for i, text in rows:
        assert [(r["start"], r["end"]) for r in got[i]["runs"]] == want[i]
        assert got[i]["n_units"] == len(plain_units(text or "")) and got[i]["n_words"] == len((text or "").split())
        assert all(k <= i for r in got[i]["runs"] for k in r["kept_in"])
    cut = {r["doc_id"]: r["text"] for r in lines.deduplicated(docs(rows)).collect()}
    for i, text in rows:
        left, at = "", 0
        for a, b in want[i]:
            left, at = left + text[at:a], b
        assert cut[i] == (None if text is None else left + text[at:])


def test_passages_inside_other_lines_are_found(docs):
    """Passages of 52 words between the words of other texts: every copy but the first is found, and most of it."""
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows, clean = [], []
    for k in range(60):
        passage = prose(52)
        rows += [(2 * k, f"{prose(30)} {passage} {prose(30)}"), (2 * k + 1, f"{prose(9)} {passage} {prose(70)}")]
        clean.append((1000 + k, prose(100)))
    got = {r["doc_id"]: sum(x["words"] for x in r["runs"]) for r in lines.repeated(docs(rows + clean)).collect()}
    assert all(got[2 * k] == 0 and 16 <= got[2 * k + 1] <= 52 for k in range(60))
    assert sum(got[2 * k + 1] for k in range(60)) > 0.7 * 52 * 60
    assert not any(got[i] for i, _ in clean)


def test_odd_rows(odd):
    got = lines.repeated(odd).collect()
    assert len(got) == 10
    assert sorted((r["doc_id"], len(r["runs"])) for r in got if r["runs"]) == [(6, 1)]  # one word over and over
    assert lines.repeated(odd.limit(0)).count() == 0

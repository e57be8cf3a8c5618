"""License notices found with a bounded number of errors.

Texts are compared as words (letters, digits, characters beyond ASCII; A-Z in lower case) joined by one space. A notice that
may hold ``k`` errors is cut into ``k + 1`` pieces: k errors cannot touch them all, so at least one piece stands unchanged, at most k
characters away from its place. One automaton finds the pieces of all notices; around every piece the regex library matches the whole notice
with at most k insertions, deletions or substitutions. A phrase with no errors is one piece and must stand on
whole words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import regex
from pyspark.sql import DataFrame

from thriftlens.llm.texts import free_name, text_column, words_of

SPACE = re.compile(" ")
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

# Exact phrases with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Short notices with their labels, as words.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}

PLACES = """n_words bigint, places array<struct<kind: string, label: string, start: bigint, end: bigint,
 first_word: bigint, last_word: bigint, edits: int, score: double>>"""


@dataclass(frozen=True)
class Notice:
    words: str
    label: str
    kind: str  # base or fuzzy
    errors: int

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): errors + 1 parts of nearly equal length; a phrase without errors is one with its bounds."""
        if self.kind == "base":
            return [(-1, f" {self.words} ")]
        n, length = self.errors + 1, len(self.words)
        cuts = [length * i // n for i in range(n + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:])]

    def pattern(self):
        if self.kind == "base":
            return regex.compile(f"(?<= ){regex.escape(self.words)}(?= )")
        return regex.compile(f"(?b)(?:{regex.escape(self.words)}){{e<={self.errors}}}")


def notices_of(phrases: dict[str, str], notices: dict[str, str], share: float) -> list[Notice]:
    base = [Notice(w, label, "base", 0) for w, label in phrases.items()]
    return base + [
        Notice(w, label, "fuzzy", max(1, int(len(w) * share))) for w, label in notices.items()
    ]


class Scanner:
    def __init__(self, notices: list[Notice]):
        self.notices = notices
        self.patterns = [n.pattern() for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                seeds.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def windows(self, joined: str) -> dict[int, list[list[int]]]:
        """By notice: the parts of ``joined`` that a match can lie in, by start, overlapping ones made one."""
        found: dict[int, list[list[int]]] = {}
        for last, (length, uses) in self.automaton.iter(joined):
            for k, offset in uses:
                notice = self.notices[k]
                at = last + 1 - length - offset
                start = max(0, at - notice.errors - (notice.kind == "base"))
                end = min(len(joined), at + len(notice.words) + notice.errors + (notice.kind == "base"))
                found.setdefault(k, []).append([start, end])
        for k, parts in found.items():
            parts.sort()
            done = [parts[0]]
            for start, end in parts[1:]:
                if start <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], end)
                else:
                    done.append([start, end])
            found[k] = done
        return found

    def matches(self, joined: str):
        """(notice, start, end, edits) in ``joined``: every place of a phrase; of a notice the best ones from the
        left that do not overlap."""
        for k, parts in self.windows(joined).items():
            notice, pattern = self.notices[k], self.patterns[k]
            for start, end in parts:
                for m in pattern.finditer(joined, start, end, overlapped=notice.kind == "base"):
                    if m.end() > m.start():
                        yield notice, m.start(), m.end(), sum(m.fuzzy_counts)


def _places(notices: list[Notice]):
    def make():
        scanner = Scanner(notices)

        def of_text(text):
            words = words_of(text)
            places: list[dict] = []
            if words:
                joined = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
                found = list(scanner.matches(joined))
                if found:
                    spans = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
                    spaces = [m.start() for m in SPACE.finditer(joined)]
                for notice, start, end, edits in found:
                    while start < end and joined[start] == " ":
                        start += 1
                    while end > start and joined[end - 1] == " ":
                        end -= 1
                    # A word has as many spaces before it as its number from 1.
                    first, last = bisect_left(spaces, start) - 1, bisect_left(spaces, end) - 1
                    places.append(
                        {
                            "kind": notice.kind, "label": notice.label, "start": spans[first][0], "end": spans[last][1],
                            "first_word": first, "last_word": last, "edits": edits,
                            "score": max(0.0, 1 - edits / len(notice.words)),
                        }
                    )
            places.sort(key=lambda p: (p["first_word"], p["last_word"], p["kind"], p["label"]))
            return {"n_words": len(words), "places": places}

        return of_text

    return make


def license_places(
    documents: DataFrame,
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
    share: float = 0.1,
    as_column: str = "license",
) -> DataFrame:
    """``documents`` with a struct column of n_words and places: every place of a phrase (kind base) and of a notice
    with at most ``share`` of its characters in error, one at least (kind fuzzy), with its label, its start and end in code
    points of the text, its first and last word, the number of edits and a score of 1 - edits / length.

    A null or empty text has no words and no places. Rows that repeat give the same result each. Texts are scanned whole; a
    very long one costs a task some times its own size. The new column is the last and gets underscores before its name where the
    documents have such a column.
    """
    as_column = free_name(documents, as_column)
    places = text_column(_places(notices_of(phrases, notices, share)), PLACES)
    return documents.withColumn(as_column, places("text"))

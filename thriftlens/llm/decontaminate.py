"""Benchmark decontamination by Wu-Manber search over words.

The symbols of the search are words. Test strings are windows of ``window`` words of each benchmark item (an item
with fewer is one test string). A shift table over blocks of words says how far the search may move without passing the end of a
test string; a block with shift 0 leads to the test strings that end with it, and a direct comparison confirms
the occurrence. Test strings of one length share a table, so that short items do not shorten the moves of the others.

Benchmark items are searched in chunks of at most ``chunk_words`` words of benchmark text, one pass over the documents for each,
so what a task holds is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftlens.llm.texts import free_name, text_column, words_of
from thriftlens.session import cut_lineage

WINDOW = 13
BLOCK = 3
#: Words of a chunk, about. Its tables take a task some 850 bytes a word: under 200 MB.
CHUNK_WORDS = 200_000


class Searcher:
    """Tables for test strings of one length: window (a tuple of words) to item numbers."""

    def __init__(self, windows: dict[tuple, set[int]], length: int, block: int):
        self.length, self.block = length, min(block, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.ends: dict[tuple, dict[tuple, set[int]]] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                part = window[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.most), length - end)
            self.ends[window[-self.block :]][window] = items

    def occurrences(self, words: list[bytes]):
        """(start, items) of every test string in ``words``, by start."""
        n, length, block, most = len(words), self.length, self.block, self.most
        shift, ends = self.shift.get, self.ends
        end = length
        while end <= n:
            part = tuple(words[end - block : end])
            move = shift(part, most)
            if move:
                end += move
                continue
            items = ends[part].get(tuple(words[end - length : end])) if part in ends else None
            if items is not None:
                yield end - length, items
            end += 1


def test_strings(items: list[tuple[object, bytes]], window: int) -> dict[int, dict[tuple, set[int]]]:
    """By length: each test string with the positions in ``items`` of those that hold it."""
    found: dict[int, dict[tuple, set[int]]] = defaultdict(lambda: defaultdict(set))
    for at, (_, text) in enumerate(items):
        words = words_of(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            found[length][tuple(words[start : start + length])].add(at)
    return found


def _finder(items: list[tuple[object, bytes]], window: int, block: int):
    """The function of a text: words, hit runs (start, end in words) and ids of the items found."""

    def make():
        searchers = [Searcher(w, length, block) for length, w in test_strings(items, window).items()]

        def of_text(text):
            words = words_of(text)
            runs, ids = [], set()
            for searcher in searchers:
                for start, at in searcher.occurrences(words):
                    ids |= at
                    runs.append((start, start + searcher.length))
            return {
                "n_words": len(words),
                "runs": merged(runs),
                "items": sorted({str(items[i][0]) for i in ids if items[i][0] is not None}),
            }

        return of_text

    return make


FOUND = "n_words bigint, runs array<struct<start: bigint, end: bigint>>, items array<string>"


def merged(runs: list[tuple[int, int]]) -> list[dict]:
    """Runs by start, overlapping and touching ones made one."""
    done: list[dict] = []
    for start, end in sorted(runs):
        if done and start <= done[-1]["end"]:
            done[-1]["end"] = max(done[-1]["end"], end)
        else:
            done.append({"start": start, "end": end})
    return done


def _merge_runs(runs):
    def each(runs: pa.Array) -> pa.Array:
        return pa.array([merged([(r["start"], r["end"]) for r in x]) for x in runs.to_pylist()], type=runs.type)

    each.__annotations__ = {"runs": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<struct<start: bigint, end: bigint>>")(runs)


def benchmark_chunks(benchmark: DataFrame, chunk_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's distinct items in chunks of bounded size, each fetched by a query of its own when it is asked for, so the driver holds one."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    weight = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    total = items.agg(weight.alias("n")).first()["n"] // 6  # bytes a word, about
    n = max(1, -(-total // chunk_words))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for k in range(n):
        yield [(r["item_id"], bytes(r["text"] or b"")) for r in items.where(part == k).collect()]


def overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block: int = BLOCK,
    chunk_words: int = CHUNK_WORDS,
    as_column: str = "overlap",
) -> DataFrame:
    """``documents`` with a struct column of n_words, runs (hit words, merged, end exclusive) and items (ids as
    sorted strings) found in the text.

    A null or empty text, or one without words, has no words and no hits. Items that are null or without words
    have no test strings; an item with a null id hits but is not named; items with the same id count once. Rows
    that repeat give the same result each. An empty benchmark hits nothing. All other columns stay; the new one is
    the last and gets underscores before its name where the documents have such a column.
    """
    as_column = free_name(documents, as_column)
    found, part = documents, free_name(documents, "overlap_part")
    for k, items in enumerate(benchmark_chunks(benchmark, chunk_words)):
        if k == 0:
            found = found.withColumn(as_column, text_column(_finder(items, window, block), FOUND)("text"))
            continue
        found = cut_lineage(found)  # one chunk's tables in a task at a time
        found = found.withColumn(part, text_column(_finder(items, window, block), FOUND)("text"))
        both = [F.col(as_column), F.col(part)]
        found = found.withColumn(
            as_column,
            F.struct(
                both[0]["n_words"].alias("n_words"),
                _merge_runs(F.concat(*[c["runs"] for c in both])).alias("runs"),
                F.array_sort(F.array_union(*[c["items"] for c in both])).alias("items"),
            ),
        ).drop(part)
    return found


def n_hit(overlap):
    return F.aggregate(overlap["runs"], F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])


def contaminated(overlap):
    """At least a twentieth of the words are inside occurrences of test strings."""
    return (n_hit(overlap) > 0) & (20 * n_hit(overlap) >= overlap["n_words"])


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = free_name(documents, "overlap")
    found = overlaps(documents, benchmark, as_column=name, **options)
    return found.where(~contaminated(F.col(name))).select(*[F.col(f"`{c}`") for c in documents.columns])

"""Runs of repeated words by string synchronising sets.

A run is a stretch of words with smallest period q that holds at least four periods (and ``LEAST_LENGTH`` words) and cannot be made
longer. For each power of two, tau, a synchronising set picks positions by the hashes of the tau words that start there: a position
is picked if the least hash among its own and the next tau positions stands at either end of that range. Whether a position is
picked depends on its next 2 tau words alone, so equal stretches are picked alike, and every tau positions hold one unless they are highly periodic.

Such regions, of periods up to a quarter of tau, take no part in the choice. Their runs are known before: periods under ``FIRST_SCALE`` by
direct comparison of words that far apart, the others from the scales below.

A run of period q, with tau <= q < 2 tau, holds a picked position p in its first tau words, and p + q is picked with the same 2 tau
words behind it. No picked position between the two has these words, or the run had a smaller period (both follow from the
theorem of Fine and Wilf). So pairs of neighbours with equal contexts propose every period, and a comparison of the words gives the run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftlens.llm.texts import free_name, text_column

#: Periods that a run holds at least, and its words.
EXPONENT = 4
LEAST_LENGTH = 6
#: The first tau; periods below it are found by direct comparison.
FIRST_SCALE = 4

RUNS = "n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_NEVER = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def _doubled(hashes: np.ndarray, tau: int) -> np.ndarray:
    """Hashes of 2 tau words from those of tau words."""
    return _mixed(hashes[:-tau] * _ODD + hashes[tau:]) if len(hashes) > tau else hashes[:0]


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values, from running minima of blocks in both directions."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    blocks = np.full(-(-len(values) // size) * size, _NEVER, dtype=np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def picked(hashes: np.ndarray, omitted: np.ndarray, tau: int) -> np.ndarray:
    """The synchronising set of ``tau``, given the hashes of tau words and where a highly periodic stretch of tau words starts."""
    shown = np.where(omitted, _NEVER, hashes)
    least = np.minimum(_least(shown, tau)[: len(shown) - tau], shown[tau:])
    chosen = (least == shown[: len(least)]) | (least == shown[tau:])
    return np.flatnonzero(chosen & (least != _NEVER))


def _stretch(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """First and last + 1 of the words around ``at`` that keep ``period``; ``at`` and ``at + period`` are equal."""

    def same(low: int, high: int) -> np.ndarray:
        return words[low:high] == words[low + period : high + period]

    end, step, most = at + 1, 64, len(words) - period
    while end < most:
        part = same(end, min(most, end + step))
        if not part.all():
            end += int(np.argmin(part))
            break
        end, step = end + len(part), 2 * step
    start, step = at, 64
    while start > 0:
        part = same(max(0, start - step), start)[::-1]
        if not part.all():
            start -= int(np.argmin(part))
            break
        start, step = start - len(part), 2 * step
    return start, end + period


def _short_periods(words: np.ndarray, below: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches with at least ``EXPONENT`` periods of a length under ``below``."""
    found: list[tuple[int, int, int]] = []
    for period in range(1, min(below, len(words) // EXPONENT + 1)):
        same = np.zeros(len(words) - period + 2, dtype=np.int8)
        same[1:-1] = words[:-period] == words[period:]
        edges = np.diff(same)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        for k in np.flatnonzero(ends - starts >= (EXPONENT - 1) * period).tolist():
            start, length = int(starts[k]), int(ends[k] - starts[k]) + period
            first = words[start : start + period]
            if not any((first == words[start + d : start + d + period]).all() for d in range(1, period) if period % d == 0):
                found.append((start, length, period))
    return found


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a text of word numbers, by start, then period."""
    found = _short_periods(words, FIRST_SCALE)
    hashes, tau = _mixed(words.astype(np.uint64) + _ODD), 1
    while tau < FIRST_SCALE and len(hashes):
        hashes, tau = _doubled(hashes, tau), 2 * tau
    while EXPONENT * tau <= len(words):
        if len(np.unique(hashes)) == len(hashes):
            break  # no stretch of tau words occurs twice, so no longer one does
        contexts = _doubled(hashes, tau)
        omitted = np.zeros(len(hashes) + 1, dtype=np.int64)
        for start, length, period in found:
            if EXPONENT * period <= tau <= length:
                omitted[start] += 1
                omitted[start + length - tau + 1] -= 1
        chosen = picked(hashes, np.cumsum(omitted[:-1]) > 0, tau)
        chosen = chosen[chosen < len(contexts)]
        # Neighbours among the positions of one context.
        order = np.argsort(contexts[chosen], kind="stable")
        at, context = chosen[order], contexts[chosen[order]]
        gap = np.diff(at)
        near = (context[1:] == context[:-1]) & (gap >= tau) & (gap < 2 * tau)
        proposed = sorted(zip(gap[near].tolist(), at[:-1][near].tolist()))
        period, end = 0, 0
        for step, start in proposed:
            if step == period and start + step < end:
                continue  # inside the stretch just found
            if words[start] != words[start + step]:
                continue  # two contexts that only share a hash
            period = step
            first, end = _stretch(words, start, step)
            if end - first >= EXPONENT * step:
                found.append((first, end - first, step))
        hashes, tau = contexts, 2 * tau
    return sorted((s, n, p) for s, n, p in found if n >= LEAST_LENGTH)


def _runs():
    def of_text(text: bytes | None) -> dict:
        parts = text.split() if text else []
        numbers: dict[bytes, int] = {}
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for w in parts), dtype=np.int64, count=len(parts))
        runs = runs_of(words) if len(numbers) < len(parts) else []
        kept = parts
        if runs:
            dropped = np.zeros(len(parts) + 1, dtype=np.int64)
            for start, length, period in runs:
                dropped[start + period] += 1
                dropped[start + length] -= 1
            kept = [parts[k] for k in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]
        return {
            "n_words": len(parts),
            "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs],
            "collapsed": b" ".join(kept).decode("utf-8", "replace"),
        }

    return of_text


def periodic_runs(documents: DataFrame, text: str = "text", name: str = "periodic") -> DataFrame:
    """The documents with a struct: ``n_words``, ``runs`` (start and length in words, period; by start, then period) and ``collapsed``, the
    words that are left with one space between them when each run keeps its first period.

    Words are what white space in ASCII leaves. A null or empty text has no words, no runs and an empty ``collapsed``. Each row is worked on by itself, so repeated rows
    and ids make no difference; an empty table gives no rows. A column called as the struct keeps its name, and the struct
    takes an underscore before it. Two stretches of words are taken for equal by 64-bit hashes only to propose a period; every run is compared word by word.
    """
    column = text_column(_runs, f"struct<{RUNS}>")
    return documents.withColumn(free_name(documents, name), column(F.col(f"`{text}`")))


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text), where for one id in ten, as its checksum says, the words from one position on repeat with a period."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    touched = (checksum % 10 == 0) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    split = documents.select("doc_id", "text", F.floor(checksum / 10).alias("g"), F.when(touched, words).alias("w"))
    n = F.size("w").cast("bigint")
    cut = split.select("*", n.alias("n"), (F.col("g") % F.when(n > 0, n)).cast("int").alias("a"))
    rest = F.col("n") - F.col("a")
    block = cut.select("*", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int").alias("p"))
    blocks = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    repeated = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), blocks), F.lit(1), F.col("n").cast("int"))
    return block.select("doc_id", F.coalesce(F.array_join(repeated, " "), F.col("text")).alias("text"))

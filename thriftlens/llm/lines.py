"""Repeated passages found by hashing normalised units.

A line is cut into units: behind a word whose hash says so, and at the line's end. Where a unit ends depends on its own words
only, so a passage that lies inside other lines is cut like the same passage elsewhere, but for the units at its two ends. Units are
normalised (words joined by one space, A-Z in lower case) and hashed to 96 bits; digests are grouped over all documents, the occurrence in the
smallest doc_id, first in the text, is kept, and the others are removed if they add up to ``least_words`` words in one run. Offsets are those
of the original text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from thriftlens.llm.texts import free_name, lean_batches
from thriftlens.session import cut_lineage

#: One word in so many ends a unit.
ENDS = 4
#: Words of a unit, at least (but at the end of a line) and at most.
UNIT_WORDS = (4, 48)
#: Words of a run of repeated units that is removed.
LEAST_WORDS = 16
#: Words whose hash a task keeps at hand.
KEPT_HASHES = 500_000

UNIT = "struct<h1: bigint, h2: int, start: int, length: int, words: int>"
UNITS = f"n_words bigint, units array<{UNIT}>"


class EndsUnit(dict):
    """Whether a word ends a unit, by its hash."""

    def __init__(self, ends: int):
        super().__init__()
        self.ends = ends

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= KEPT_HASHES:
            self.clear()
        self[word] = found = not zlib.crc32(word) % self.ends
        return found


def _cuts(words: list[bytes], ends_unit: dict, least: int, most: int) -> list[int]:
    """Where the units of a line end, in words."""
    cuts, start = [], 0
    for at in [k for k, word in enumerate(words, 1) if ends_unit[word]] + [len(words)]:
        while at - start > most:
            start += most
            cuts.append(start)
        if at - start >= least or at == len(words) and at > start:
            start = at
            cuts.append(at)
    return cuts


def units(text: bytes | None, ends_unit: dict, size: tuple[int, int]) -> tuple[int, list[tuple[int, ...]]]:
    """The number of words, and of each unit a digest as two integers (64 and 32 bits), its start and length in bytes and its words."""
    found, n, begin = [], 0, 0
    for line in (text or b"").lower().split(b"\n"):
        words = line.split()
        n += len(words)
        start = at = 0
        for cut in _cuts(words, ends_unit, *size):
            joined = b" ".join(words[start:cut])
            first = line.index(words[start], at)
            at = first + len(joined)
            if line[first:at] != joined:  # other white space between the words
                at = first
                for word in words[start:cut]:
                    at = line.index(word, at) + len(word)
            digest = xxhash.xxh3_128_digest(joined)
            h1, h2 = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:12], "little", signed=True)
            found.append((h1, h2, begin + first, at - first, cut - start))
            start = cut
        begin += len(line) + 1
    return n, found


def _in_code_points(text: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if text.isascii():
        return starts, lengths
    before = np.r_[0, np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) == 0x80)]
    stops = starts + lengths
    first, last = starts - before[starts], stops - before[stops]
    return first, last - first


def units_column(text: str, ends: int, size: tuple[int, int]):
    """Struct column of the number of words and the units of a text, offsets in code points."""
    lean_batches()
    kind = T._parse_datatype_string(UNITS)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ends_unit = EndsUnit(ends)
        for batch in batches:
            counts, rows = [], []
            for value in batch:
                data = value.as_py() or b""
                n, found = units(data, ends_unit, size)
                table = np.array(found, dtype=np.int64).reshape(-1, 5)
                table[:, 2], table[:, 3] = _in_code_points(data, table[:, 2], table[:, 3])
                counts.append(n)
                rows.append(table)
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros((0, 5), dtype=np.int64)
            of_list = arrow.field("units").type
            fields = [of_list.value_type.field(k) for k in range(5)]
            columns = [pa.array(flat[:, k], type=f.type) for k, f in enumerate(fields)]
            values = pa.StructArray.from_arrays(columns, fields=fields)
            lists = pa.ListArray.from_arrays(pa.array(offsets), values, type=of_list)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists], fields=list(arrow))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(F.col(text).cast("binary"))


def runs(occurrences: list[dict], doc_id, least_words: int) -> list[dict]:
    """What to remove of a text: runs of adjacent repeated units, and the documents whose occurrence is kept.

    ``occurrences`` are the text's repeated units with ``place`` (number of the unit and its words), ``span`` (start and length), digest and
    ``kept_in``. Where the text's own document holds the kept occurrence, the first one in the text stays."""
    done: list[dict] = []
    seen = set()
    last = None
    for u in sorted(occurrences, key=lambda u: u["place"]):
        at, words = divmod(u["place"], PLACE)
        start, length = divmod(u["span"], SPAN)
        key = (u["h1"], u["h2"])
        first = u["kept_in"] == doc_id and key not in seen
        seen.add(key)
        if first:
            continue
        if last is not None and at == last + 1:
            done[-1]["end"] = start + length
            done[-1]["words"] += words
            done[-1]["kept_in"].add(u["kept_in"])
        else:
            done.append({"start": start, "end": start + length, "words": words, "kept_in": {u["kept_in"]}})
        last = at
    return [
        r | {"kept_in": sorted(k for k in r["kept_in"] if k is not None)} for r in done if r["words"] >= least_words
    ]


RUNS = "array<struct<start: bigint, end: bigint, words: bigint, kept_in: array<bigint>>>"
#: Two numbers in one: unit and words, start and length.
PLACE, SPAN = 1 << 20, 1 << 31


def _runs_column(occurrences, doc_id, least_words: int):
    kind = T._parse_datatype_string(RUNS)
    arrow = to_arrow_type(kind)

    def each(rows: pa.Array, ids: pa.Array) -> pa.Array:
        found = zip(rows, ids.to_pylist())
        return pa.array([runs(r.as_py() or [], i, least_words) for r, i in found], type=arrow)

    each.__annotations__ = {"rows": pa.Array, "ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, kind)(occurrences, doc_id)


def repeated(
    documents: DataFrame,
    least_words: int = LEAST_WORDS,
    ends: int = ENDS,
    size: tuple[int, int] = UNIT_WORDS,
) -> DataFrame:
    """(doc_id, n_words, n_units, runs): one row for each row of ``documents`` with the runs (start, end, words, kept_in) that repeat what a
    document of smaller id, or the same text further up, holds.

    A null or empty text has no units. A null doc_id ranks behind all others; rows that share a doc_id rank alike and each keep their own. Rows
    are told apart by a number given when the units are written, so equal rows give equal results. An empty table gives no rows.

    Units are written once and read for the groups and for the occurrences. A digest that a third of all units share is a count and a
    minimum before the shuffle, and a key that Spark splits in the join. Only the repeated units of one row come together.
    """
    made = units_column("text", ends, size).alias("u")
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), made)
    written = cut_lineage(rows.select("row", F.col("doc_id").cast("bigint").alias("doc_id"), "u.n_words", "u.units"))
    digest = [F.col("unit.h1").alias("h1"), F.col("unit.h2").alias("h2")]
    groups = (
        written.select("doc_id", F.explode("units").alias("unit"))
        .groupBy(*digest)
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("kept_in"))
    )
    # As a table of its own: Spark splits a hot key only where both sides of the join are shuffled for it.
    shared = cut_lineage(groups.where("n > 1").drop("n"))
    place = (F.col("at").cast("bigint") * PLACE + F.col("unit.words")).alias("place")
    span = (F.col("unit.start").cast("bigint") * F.lit(SPAN) + F.col("unit.length")).alias("span")
    each = written.select("row", F.posexplode("units").alias("at", "unit"))
    occurrences = each.select(*digest, "row", place, span).join(shared, ["h1", "h2"])
    of_row = occurrences.groupBy("row").agg(
        F.collect_list(F.struct("place", "span", "h1", "h2", "kept_in")).alias("occurrences")
    )
    counts = written.select("row", "doc_id", "n_words", F.size("units").cast("bigint").alias("n_units"))
    return counts.join(of_row, "row", "left").select(
        "doc_id", "n_words", "n_units", _runs_column(F.col("occurrences"), F.col("doc_id"), least_words).alias("runs")
    )


def deduplicated(documents: DataFrame, **options) -> DataFrame:
    """The documents with repeated runs cut out of their texts; ``doc_id`` must name each row once."""
    name = free_name(documents, "runs_found")
    found = repeated(documents, **options).select("doc_id", F.col("runs").alias(name))
    part = lambda start, end: F.col("text").substr(start + 1, end - start)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.col(name), lambda r: r["end"]))
    stops = F.concat(F.transform(F.col(name), lambda r: r["start"]), F.array(F.length("text").cast("bigint")))
    pieces = F.zip_with(starts, stops, lambda a, b: part(a.cast("int"), b.cast("int")))
    cut = F.when(F.size(name) > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    columns = [cut.alias(c) if c == "text" else F.col(f"`{c}`") for c in documents.columns]
    return documents.join(found, "doc_id", "left").select(*columns)

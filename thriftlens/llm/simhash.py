"""Near duplicates by SimHash fingerprints that meet at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftlens.llm.components import components
from thriftlens.llm.covering import anchors
from thriftlens.llm.texts import free_name, text_column
from thriftlens.session import cut_lineage

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: Shingles hashed at a time.
SLICE = 1 << 18
#: Buckets with more fingerprints are searched one fingerprint after another.
SMALL = 8

_BITS = np.array([[byte >> k & 1 for k in range(8)] for byte in range(256)], dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A signed 64-bit integer. A bit is set if over half the shingles' hashes have it; no words: zero.

    Words are what space, tab and the line ends leave, A-Z in lower case; fewer words than a shingle are one shingle.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[shingle - 1 :] or [len(joined) + 1]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(ends), SLICE):
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts[k : k + SLICE], ends[k : k + SLICE])]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for place in range(8):
            counts[8 * place : 8 * place + 8] += np.bincount(octets[:, place], minlength=256) @ _BITS
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, as_column: str = "fingerprint") -> DataFrame:
    """``documents`` with the fingerprint of the text (null: no words) as a long, under a name they do not have."""
    as_column = free_name(documents, as_column)
    return documents.withColumn(as_column, text_column(lambda: fingerprint, "bigint")("text"))


def _links_in_bucket(members: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all members connected within ``threshold`` bits: a tree for each component.

    A member that is reached leaves the rest, so a dense bucket is searched in few passes."""
    links, rest = [], members
    while len(rest):
        ahead, rest = [rest[0]], rest[1:]
        while ahead and len(rest):
            at = ahead.pop()
            near = np.bitwise_count(rest ^ at) <= threshold
            if near.any():
                found, rest = rest[near], rest[~near]
                links.append((np.full(len(found), at), found))
                ahead.extend(found)
    return links


def _compare(threshold: int):
    """Arrow batches of (anchor, fingerprint) sorted by anchor to batches of links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(anchor, member):
            cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
            sizes = np.diff(cuts)
            found = []
            for k in np.flatnonzero(sizes > SMALL):
                found += _links_in_bucket(member[cuts[k] : cuts[k + 1]], threshold)
            small = np.repeat(sizes <= SMALL, sizes)
            anchor, member = anchor[small], member[small]
            for step in range(1, SMALL):
                a, b = member[:-step], member[step:]
                near = (anchor[:-step] == anchor[step:]) & (np.bitwise_count(a ^ b) <= threshold)
                found.append((a[near], b[near]))
            a = np.concatenate([f[0] for f in found])
            b = np.concatenate([f[1] for f in found])
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1).view(np.int64), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)]
            columns = [np.concatenate(x) for x in zip(held, columns)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on in the next batch
            if cut:
                yield links_of(columns[0][:cut], columns[1][:cut])
            held = [c[cut:] for c in columns]
        if len(held[0]):
            yield links_of(*held)

    return compare


def links(classes: DataFrame, threshold: int = THRESHOLD, blocks: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fingerprint``) that connect all those within ``threshold`` bits.

    Every fingerprint goes to all its anchors and is compared there with the others. What a task holds is the fingerprints
    of one anchor, eight bytes each; documents never come together, only distinct fingerprints do.
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at, found in anchors(values.view(np.uint64), threshold, blocks):
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(values[at])], ["anchor", "member"])

    replicas = classes.select("fingerprint").mapInArrow(replicate, "anchor bigint, member bigint")
    buckets = replicas.repartition("anchor").sortWithinPartitions("anchor")
    return buckets.mapInArrow(_compare(threshold), "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD, blocks: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``documents``.

    Fingerprints with at most ``threshold`` different bits are linked, equal ones too; the component is the smallest doc_id that links
    lead to. A null or empty text has fingerprint zero and is linked like any other. A row without doc_id is in a component and cannot name it; a
    component without any doc_id has a null id. Rows that share a doc_id each get the row of their own text. An empty
    table gives no rows; other columns are not read.
    """
    marked = cut_lineage(fingerprints(documents.select("doc_id", "text")).select("doc_id", "fingerprint"))
    classes = cut_lineage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes, threshold, blocks))
    linked = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    of_linked = linked.join(smallest, "root").select("fingerprint", "least_id", F.lit(True).alias("is_linked"))
    of_all = classes.join(of_linked, "fingerprint", "left").select(
        "fingerprint", F.when(F.col("is_linked"), F.col("least_id")).otherwise(F.col("first_id")).alias("component_id")
    )
    # As a table of its own: Spark splits a hot key only where both sides of the join are shuffled for it.
    return marked.join(cut_lineage(of_all), "fingerprint").select("doc_id", "fingerprint", "component_id")

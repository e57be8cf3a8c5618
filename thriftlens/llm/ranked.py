"""Ranked lexical search by the Best Position Algorithm.

Every query term has an impact list: the documents that hold the term, by falling impact on the score. The lists of a query are read in step.
A document met in one list is looked up in all others at once, which gives its score and marks its place in every list as seen. The best
position of a list is the end of its unbroken run of seen places. What has not been met stands behind it in every list, so its score is at most the sum of the
impacts at the best positions. The search stops once that sum lies strictly below the kth score, since a document with an equal score could still go first.

Documents are taken in blocks of a bounded number of postings, as they lie in the partitions, and each block is searched for
all queries; the best of all blocks meet in a last choice of k. Nothing is shuffled but the k best of each block. Queries are taken in chunks of a bounded number of terms, a pass
over the documents for each, so that neither the driver nor a task holds more of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thriftlens.llm.texts import lean_batches, words_of
from thriftlens.session import cut_lineage

#: Results for each query.
TOP = 50
#: Postings in a block, about (one document may have more), and terms of the queries of a chunk, repeats included.
BLOCK_POSTINGS = 1 << 20
CHUNK_TERMS = 200_000
#: Places read of each list at first; the next step is twice as long.
FIRST_STEP = 16

MATCHES = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"


@dataclass
class Query:
    number: int
    item_id: int | None
    terms: list[bytes]


def query_chunks(items: DataFrame, chunk_terms: int) -> Iterator[list[Query]]:
    """The items that have a term, with their distinct terms, so many at a time that a chunk has ``chunk_terms`` terms (or one item)."""
    chunk, size, number = [], 0, 0
    for row in items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary")).toLocalIterator():
        terms = sorted(set(words_of(row[1])))
        if not terms:
            continue
        if chunk and size + len(terms) > chunk_terms:
            yield chunk
            chunk, size = [], 0
        chunk.append(Query(number, row[0], terms))
        number, size = number + 1, size + len(terms)
    if chunk:
        yield chunk


def matches(documents: DataFrame, terms: list[bytes]) -> DataFrame:
    """Each document that has a term at all: its number of terms, and which of ``terms`` (their numbers) it holds how often."""
    lean_batches()
    known = {t: k for k, t in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, held, often = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if not words:
                    continue
                found = Counter(known[w] for w in words if w in known)
                ids.append(doc_id)
                sizes.append(len(words))
                held.append(list(found))
                often.append(list(found.values()))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    plain = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(count, MATCHES)


class Block:
    """Impact lists of some documents, and of each document its place in each of its lists."""

    def __init__(self, doc_ids: np.ndarray, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        """Postings: ``owner`` (number of the document, never falling), ``term`` and ``impact``; ``doc_ids`` is never falling."""
        self.doc_ids = doc_ids
        order = np.lexsort((owner, -impact, term))
        self.list_doc, self.list_impact = owner[order], impact[order]
        self.list_start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.term, self.impact = term, impact
        self.doc_start = np.searchsorted(owner, np.arange(len(doc_ids) + 1))
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))

    def best(self, terms: np.ndarray, k: int, first_step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k documents with the highest scores above 0, equal ones by number."""
        starts, ends = self.list_start[terms], self.list_start[terms + 1]
        wanted = np.zeros(len(self.list_start) - 1, dtype=bool)
        wanted[terms] = True
        met = np.zeros(len(self.doc_ids), dtype=bool)
        seen = np.zeros(len(self.list_doc) + 1, dtype=bool)
        bests, read, step = starts.copy(), starts.copy(), first_step
        docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        while True:
            # Sorted access: the next places of every list.
            upto = np.minimum(read + step, ends)
            fresh = np.concatenate([self.list_doc[a:b] for a, b in zip(read, upto)]) if len(terms) else docs
            read, step = upto, 2 * step
            fresh = np.unique(fresh[~met[fresh]])
            met[fresh] = True
            # Direct access: the places and impacts of these documents in all lists of the query.
            first, sizes = self.doc_start[fresh], self.doc_start[fresh + 1] - self.doc_start[fresh]
            at = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else first, sizes) + np.arange(sizes.sum())
            whose = np.repeat(np.arange(len(fresh)), sizes)
            mine = wanted[self.term[at]]
            at, whose = at[mine], whose[mine]
            seen[self.place[at]] = True
            # Each of them was found in one of the lists, so it has a posting here.
            gained = np.add.reduceat(self.impact[at], np.searchsorted(whose, np.arange(len(fresh)))) if len(fresh) else self.impact[:0]
            docs, scores = np.concatenate([docs, fresh[gained > 0]]), np.concatenate([scores, gained[gained > 0]])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            # Best positions: all before them is seen.
            limit = 0
            for j, end in enumerate(ends):
                while bests[j] < end:
                    part = seen[bests[j] : min(end, bests[j] + 4096)]
                    gap = int(np.argmin(part)) if not part.all() else len(part)
                    bests[j] += gap
                    if gap < len(part):
                        # The place of the last one seen, or the first place if none is.
                        limit += int(self.list_impact[max(bests[j] - 1, starts[j])])
                        break
            if (bests >= ends).all() or (len(docs) == k and limit < scores[-1]):
                return docs, scores


def _search(queries: list[Query], numbers: dict[bytes, int], weights: np.ndarray, n_docs: int, n_all: int, k: int, block_postings: int):
    """The function of a partition's matches: (query, doc_id, score) of the k best of each of its blocks."""

    def blocks(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            # A batch may hold more than a block: it is cut by documents.
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // block_postings)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                held.append(batch.slice(a, b - a))
                size += int(lengths[a:b].sum())
                if size >= block_postings:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            # Documents without an id come last among equals.
            ids = table["doc_id"].combine_chunks()
            nameless = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            order = np.lexsort((ids, nameless))
            table, ids, nameless = table.take(pa.array(order)), ids[order], nameless[order]
            held, counts = table["terms"].combine_chunks(), table["counts"].combine_chunks()
            owner = np.repeat(np.arange(len(ids)), np.diff(held.offsets.to_numpy()))
            term, often = held.flatten().to_numpy(), counts.flatten().to_numpy()
            m = 50 + 50 * table["n"].to_numpy() * n_docs // n_all
            impact = weights[term] * (1_000_000_000 * often // (1_000 * often + 20 * m[owner]))
            block = Block(ids, owner, term, impact, len(weights))
            found = []
            for query in queries:
                docs, scores = block.best(np.array([numbers[t] for t in query.terms], dtype=np.int64), k)
                if len(docs):
                    found.append((np.full(len(docs), query.number), docs, scores))
            if found:
                number, docs, scores = (np.concatenate(x) for x in zip(*found))
                doc_ids = pa.array(ids[docs], pa.int64(), mask=nameless[docs])
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), doc_ids, pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return run


def ranked(documents: DataFrame, items: DataFrame, k: int = TOP, chunk_terms: int = CHUNK_TERMS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the ``k`` documents with the highest scores above 0, equal scores by doc_id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case, of whole texts. A document's score sums over an item's terms, once each,
    the term's weight, floor(1000 ln((2N + 2) / (2 df + 1))), times (10^9 tf) div (1000 tf + 20 m), where m is 50 + (50 n N) div L: N documents
    have a term, L is their number of terms, df of them hold this one, and the document has n terms, this one tf times.

    A null or empty text has no terms: such documents are not counted and such items have no rows. Rows are documents and items, also where ids repeat or are
    null; documents without an id come last among equals. Empty tables give no rows. Columns but doc_id, item_id and text are not read.
    """
    spark = documents.sparkSession
    parts = []
    for chunk in query_chunks(items, chunk_terms):
        terms = sorted({t for q in chunk for t in q.terms})
        found = cut_lineage(matches(documents, terms))
        total = found.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("all")).first()
        if not total["n"]:
            continue
        df = F.col("df")
        weight = F.floor(1000 * F.log((2 * F.lit(total["n"]) + 2).cast("double") / (2 * df + 1).cast("double")))
        held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = np.zeros(len(terms), dtype=np.int64)
        for row in held.select("term", weight.alias("weight")).toLocalIterator():
            weights[row["term"]] = row["weight"]
        numbers = {t: n for n, t in enumerate(terms)}
        search = _search(chunk, numbers, weights, total["n"], total["all"], k, block_postings)
        best = found.mapInArrow(search, "query bigint, doc_id bigint, score bigint")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q.number, q.item_id) for q in chunk], "query bigint, item_id bigint")
        parts.append(best.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(lambda a, b: a.unionByName(b), parts)

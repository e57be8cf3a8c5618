"""Toxic passages as maximum-scoring segments.

1. Tokens are words and the first three to seven characters of words, so that stems count whatever ending they take. Labelled documents
   are counted by class (a token once per document), words of all documents as the background. The log-odds of a token between
   toxic and other documents takes the background as its Dirichlet prior; tokens whose split between the classes is far from chance
   make the lexicon. A word scores as its best token.
2. A text is a sequence of scores: the log-odds of words in the lexicon, and for every other word the (negative) log-ratio of meeting
   one inside a toxic passage. One linear scan finds all maximal segments; no segment is lost between others.
3. Extreme-value theory gives the chance of such a segment in a text of this length: with lambda solving
   sum(f * exp(lambda * s)) = 1 over the corpus frequencies f, the expected number of segments of score S or more in n words is at
   most n * exp(-lambda * S). Passages with an expected number under ``expected`` are significant. The best one, lambda * S - ln n, is mapped
   to a score by a logistic curve fitted on the labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftlens.llm.texts import free_name, lean_batches, text_column, words_of
from thriftlens.session import cut_lineage, staging

#: Labelled rows that the model is fitted on, at most; chosen by the hash of their id.
LABELLED = 20_000
#: Share of toxic words that a toxic passage is taken to have.
PASSAGE_SHARE = 0.05
#: Words a task counts before it hands the counts on.
HELD_WORDS = 200_000
#: Lengths of the beginnings of words that are tokens.
STEMS = (3, 4, 5, 6, 7)
#: Words whose score a task keeps at hand.
KEPT_SCORES = 200_000
#: Texts with fewer words count as this long.
SHORTEST = 50
#: Predicted toxic from this score on.
THRESHOLD = 0.7

FOUND = "n_words bigint, best double, segments array<struct<first_word: bigint, last_word: bigint, score: double, expected: double>>"


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    other: float = -1.0  # score of a word outside the lexicon
    rate: float = 1.0  # lambda
    slope: float = 1.0
    offset: float = 0.0

    def score(self, best):
        """Column of 0 to 1 from lambda * S - ln n; without a lexicon 0."""
        if not self.lexicon:
            return F.lit(0.0)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * best + F.lit(self.offset))))


def tokens_of(word: bytes) -> list[str]:
    """The word, marked by a closing space, and its beginnings."""
    text = word.decode("utf-8", "replace")
    return [text + " ", *[text[:k] for k in STEMS if k <= len(text)]]


class WordScores(dict):
    """The best score of a word's tokens, 0 for a word outside the lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KEPT_SCORES:
            self.clear()
        found = max((self.lexicon.get(t, 0.0) for t in tokens_of(word)), default=0.0)
        self[word] = found
        return found


def segments(scores: list[float], other: float) -> list[list]:
    """All maximal scoring segments [first, last, score] by position; a word of score 0 stands for ``other``.

    Each hit is a segment of its own at first. It joins the nearest earlier segment that starts from a lower running sum,
    if that one ends at a lower sum than the hit does; segments between them become part of it. Every segment is
    pushed and popped at most once and the look-back follows links, so the scan is linear in the hits.
    """
    stack: list[list] = []  # first, last, sum before, sum after, index of the nearest lower start
    total, last = 0.0, -1
    for at, value in enumerate(scores):
        if not value:
            continue
        total += (at - last - 1) * other
        last = at
        new = [at, at, total, total + value, -1]
        total += value
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= new[2]:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= new[3]:
                new[4] = k
                stack.append(new)
                break
            new = [stack[k][0], new[1], stack[k][2], new[3], -1]
            del stack[k:]
    return [[a, b, after - before] for a, b, before, after, _ in stack]


def training(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic) of labelled rows whose crc32(doc_id) mod 3 is not 1: a bounded sample, by hash of the id.

    Rows without id or label are left out, and labels other than 0 and 1; an id with several labels is toxic if one of them says so.
    """
    of_fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    usable = labels.where(of_fold & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    by_id = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def token_counts(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """(token, n, d0, d1): words with it in all documents, and documents with it among the sample's other and toxic ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        labelled: tuple[Counter, Counter] = Counter(), Counter()

        def handed_on():
            rows = defaultdict(lambda: [0, 0, 0])
            for word, n in words.items():
                for token in tokens_of(word):
                    rows[token][0] += n
            for k, counter in enumerate(labelled):
                for token, n in counter.items():
                    rows[token][1 + k] += n
                counter.clear()
            words.clear()
            columns = list(zip(*rows.values())) or [(), (), ()]
            arrays = [pa.array(list(rows), pa.string()), *[pa.array(c, pa.int64()) for c in columns]]
            return pa.RecordBatch.from_arrays(arrays, ["token", "n", "d0", "d1"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = words_of(text.as_py())
                words.update(found)
                if toxic is not None:
                    labelled[toxic].update({t for word in set(found) for t in tokens_of(word)})
                if len(words) + sum(map(len, labelled)) > HELD_WORDS:
                    yield handed_on()
        yield handed_on()

    lean_batches()
    # The sample has a bounded number of rows, so it may go to every task.
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(sample), "doc_id", "left"
    )
    parts = rows.select("text", "toxic").mapInArrow(count, "token string, n bigint, d0 bigint, d1 bigint")
    return parts.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "d0", "d1")])


def rate_of(scores: list[tuple[float, float]]) -> float:
    """The positive lambda of sum(f * exp(lambda * s)) = 1 for (f, s) over all words; 1 where there is none."""
    if not any(s > 0 for _, s in scores) or sum(f * s for f, s in scores) >= 0:
        return 1.0
    of = lambda x: sum(f * math.exp(min(700.0, x * s)) for f, s in scores) - 1
    low, high = 0.0, 1e-3
    while of(high) < 0:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if of(mid) < 0 else (low, mid)
    return high


def lexicon_of(documents: DataFrame, sample: DataFrame, prior: float, least_odds: float) -> Model:
    """The model without its curve.

    A token is in the lexicon if the likelihood ratio of its split between the classes passes 2 ln V + 6 (V tokens are tried) and its
    log-odds is at least ``least_odds``, and higher by that than of a shorter beginning that is in. Its prior is ``prior``
    documents spread as the words of all documents. The lexicon comes to the driver: its tokens are among those of the bounded sample and need a
    number of toxic documents each.
    """
    counts = cut_lineage(token_counts(documents, sample))
    whole = F.col("token").endswith(" ")
    in_words = [F.coalesce(F.sum(F.when(whole, F.col(c))), F.lit(0)).alias(c) for c in ("n", "d0", "d1")]
    sums = counts.agg(*in_words, F.count_if(F.col("d1") > 0).alias("v")).first()
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sums["d0"] or not sums["d1"]:
        return Model({})
    share = F.lit(float(prior)) * F.col("n") / float(sums["n"])
    odds = lambda y, n: F.log((F.col(y) + share) / (float(n) + prior - F.col(y) - share))
    toxic = sizes[1] / (sizes[0] + sizes[1])
    both = F.col("d0") + F.col("d1")
    part = lambda y, p: F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) / (both * p))).otherwise(0.0)
    ratio = 2 * (part("d1", toxic) + part("d0", 1 - toxic))
    s = odds("d1", sums["d1"]) - odds("d0", sums["d0"])
    rows = (
        counts.where("d1 > 0")
        .select("token", s.alias("s"), ratio.alias("ratio"))
        .where((F.col("ratio") >= 2 * math.log(sums["v"]) + 6) & (F.col("s") >= least_odds))
        .orderBy(F.length("token"), "token")
        .collect()
    )
    lexicon: dict[str, float] = {}
    for r in rows:
        known = max((lexicon.get(r["token"][:k], 0.0) for k in STEMS if k <= len(r["token"])), default=0.0)
        if r["s"] >= known + least_odds:
            lexicon[r["token"]] = r["s"]
    if not lexicon:
        return Model({})

    def make():
        known = WordScores(lexicon)
        return lambda token: round(known[token[:-1]], 2)

    score = text_column(make, "double")("token")
    by_score = counts.where(whole).groupBy(score.alias("s")).agg(F.sum("n").alias("n")).collect()
    mass = sum(r["n"] for r in by_score if r["s"] > 0) / sums["n"]
    other = math.log((1 - PASSAGE_SHARE) / (1 - min(mass, PASSAGE_SHARE / 2)))
    return Model(lexicon, other, rate_of([(r["n"] / sums["n"], r["s"] or other) for r in by_score]))


def _finder(model: Model, expected: float):
    def make():
        known = WordScores(model.lexicon)

        def of_text(text):
            words = words_of(text)
            n = max(SHORTEST, len(words))
            # A word that follows itself adds nothing: stuttering is no insult.
            scores = [known[w] if w != before else 0.0 for before, w in zip([None, *words], words)]
            found = segments(scores, model.other)
            best = max((s for *_, s in found), default=0.0)
            significant = [
                {"first_word": a, "last_word": b, "score": s, "expected": n * math.exp(-model.rate * s)}
                for a, b, s in found
                if n * math.exp(-model.rate * s) < expected
            ]
            return {"n_words": len(words), "best": model.rate * best - math.log(n), "segments": significant}

        return of_text

    return make


def curve(found: DataFrame, sample: DataFrame, best) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps over a histogram of the sample with a ridge penalty."""
    rows = (
        found.join(F.broadcast(sample), "doc_id")
        .groupBy(F.round(best, 1).alias("x"))
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("n1"))
        .orderBy("x")
        .collect()
    )
    points = [(r["x"], r["n"], r["n1"]) for r in rows]
    if not points:
        return 1.0, 0.0
    center = sum(x * n for x, n, _ in points) / sum(n for _, n, _ in points)
    a, b, ridge = 0.0, 0.0, 1.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = -ridge * a, 0.0, ridge, 0.0, 1e-9
        for x, n, n1 in points:
            x -= center
            p = 1 / (1 + math.exp(-max(-500, min(500, a * x + b))))
            ga, gb, w = ga + (n1 - n * p) * x, gb + n1 - n * p, n * p * (1 - p)
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5 / max(1e-9, abs(da), abs(db)))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b - a * center


def fit(
    documents: DataFrame,
    labels: DataFrame,
    rows: int = LABELLED,
    prior: float = 100.0,
    least_odds: float = 3.0,
) -> Model:
    """The model learned from at most ``rows`` labelled rows outside the held-out fold (crc32(doc_id) mod 3 = 1).

    Labels without id or value, and labels of ids without a document, count for nothing. If one class has no words, or no token is
    far from chance, the lexicon is empty and every text scores 0.
    """
    sample = cut_lineage(training(labels, rows))
    model = lexicon_of(documents, sample, prior, least_odds)
    if not model.lexicon:
        return model
    seen = documents.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    found = seen.select("doc_id", text_column(_finder(model, 0.0), FOUND)("text").alias("found"))
    slope, offset = curve(found, sample, F.col("found")["best"])
    return replace(model, slope=slope, offset=offset)


def passages(documents: DataFrame, model: Model, expected: float = 0.01, as_column: str = "toxicity") -> DataFrame:
    """``documents`` with a struct column: score (0 to 1), n_words, best (lambda * S - ln n) and the significant segments (first and last
    word, score, expected number of such segments in a text of this length by chance).

    A word that equals the word before it counts as one outside the lexicon, so an insult that a text repeats without a break counts once.
    A null or empty text has no segments and the score of the curve at 0. Rows that repeat give the same result each, texts are
    scanned whole, and only ``text`` is read. The new column is the last and gets underscores before its name where the documents
    have such a column.
    """
    as_column = free_name(documents, as_column)
    found = documents.withColumn(as_column, text_column(_finder(model, expected), FOUND)("text"))
    return found.withColumn(
        as_column, F.col(as_column).withField("score", model.score(F.col(as_column)["best"]))
    )


def clean(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    name = free_name(documents, "toxicity")
    with staging(documents.sparkSession):
        model = fit(documents, labels, **options)
    found = passages(documents, model, as_column=name)
    return found.where(F.col(name)["score"] < THRESHOLD).select(*[F.col(f"`{c}`") for c in documents.columns])

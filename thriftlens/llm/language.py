"""Language of texts by averaged embeddings of hashed subwords and a linear softmax, with calibrated rejection.

A text's features are the hashed pieces of two to four bytes of its words, a space before and after each word being part of it. Each hash
bucket has an embedding; a text is the mean of its pieces' embeddings, and a linear layer with softmax gives the languages' probabilities. Embeddings and layer
are trained together in numpy by stochastic gradient descent on a sample of labelled rows.

A part of the sample takes no part in the descent. On it one temperature is fitted, so that the probability of the predicted language says how
often it is right, and the least probability at which the accepted predictions are wrong no more often than ``MOST_WRONG``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.llm.texts import free_name, text_column

#: Labelled rows that the model is fitted on, about, an equal share for each language, and the pieces taken of each at random.
SAMPLE_ROWS = 3_000
SAMPLE_PIECES = 1_024
#: Hash buckets, and the numbers of an embedding.
BUCKETS = 1 << 16
DIMENSIONS = 16
PIECE_BYTES = (2, 3, 4)
#: Steps of the descent, and the rows of each.
STEPS = 2_400
BATCH = 16
RATE = 4.0
#: Every so many rows of the sample, one serves calibration alone.
CALIBRATION = 5
#: Share of wrong predictions among those accepted, at most, as far as the calibration rows tell.
MOST_WRONG = 0.01
SEED = 42
#: The language of texts without letters.
NONE = "und"
#: Bytes of a text whose features are made at a time, about; a cut falls between words.
PART_BYTES = 1 << 20

LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() and not chr(b).isupper() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))


def pieces(text: bytes) -> np.ndarray:
    """Bucket numbers of the pieces of a text, in no particular order, repeats included."""
    data = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", dtype=np.uint8).astype(np.uint32)
    found = []
    for size in PIECE_BYTES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, dtype=np.uint32)
        for k in range(size):
            code = code * np.uint32(0x01000193) ^ data[k : k + n]
        if size > 2:
            # A piece lies within one word: no space but at its ends.
            inside = np.zeros(n, dtype=bool)
            for k in range(1, size - 1):
                inside |= data[k : k + n] == 32
            code = code[~inside]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        found.append((code ^ code >> np.uint32(13)) & np.uint32(BUCKETS - 1))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def _parts(text: bytes):
    """The text in parts that end between words."""
    at = 0
    while len(text) - at > PART_BYTES:
        end = text.find(b" ", at + PART_BYTES)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: Predictions of less probability are rejected.
    accept: float = 0.0

    def mean(self, text: bytes) -> np.ndarray | None:
        total, n = np.zeros(self.embeddings.shape[1]), 0
        for part in _parts(text):
            at = pieces(part)
            total += self.embeddings[at].sum(axis=0, dtype=np.float64)
            n += len(at)
        return total / n if n else None

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return mean @ self.layer + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[np.ndarray], labels: np.ndarray, languages: list[str], seed: int = SEED) -> Model:
    """Embeddings and layer by stochastic gradient descent on mean cross-entropy.

    Each time a bag comes up a random part of random size of it is taken, so short texts are learned too."""
    rng = np.random.default_rng(seed)
    model = Model(
        languages,
        rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32),
        np.zeros((DIMENSIONS, len(languages)), dtype=np.float32),
        np.zeros(len(languages), dtype=np.float32),
    )
    order = np.zeros(0, dtype=np.int64)
    for done in range(STEPS if len(bags) else 0):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(bags))])
        batch, order = order[:BATCH], order[BATCH:]
        rate = RATE * (1 - done / STEPS)
        taken = []
        for k in batch:
            size = int(min(len(bags[k]), np.exp(rng.uniform(np.log(4), np.log(SAMPLE_PIECES)))))
            first = int(rng.integers(0, len(bags[k]) - size + 1))
            taken.append(bags[k][first : first + size])
        sizes = np.array([len(b) for b in taken])
        flat = np.concatenate(taken)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        means = np.add.reduceat(model.embeddings[flat], starts, axis=0) / sizes[:, None]
        slope = softmax(model.logits(means))
        slope[np.arange(len(batch)), labels[batch]] -= 1
        slope /= len(batch)
        back = (slope @ model.layer.T) / sizes[:, None]
        model.layer -= (rate * means.T @ slope).astype(np.float32)
        model.bias -= (rate * slope.sum(axis=0)).astype(np.float32)
        np.subtract.at(model.embeddings, flat, np.repeat(rate * back, sizes, axis=0).astype(np.float32))
    return model


def calibrate(model: Model, means: np.ndarray, labels: np.ndarray) -> Model:
    """Fits ``temperature`` by the likelihood of the labels, on a grid, and ``accept`` by the errors among what it lets pass.

    A label counts as certain only as far as the number of rows allows, (n + 1) / (n + 2), so rows that are all right do not make the model sure of everything."""
    if not len(labels):
        return model
    certain = (len(labels) + 1) / (len(labels) + 2)
    goal = np.full((len(labels), len(model.languages)), (1 - certain) / max(1, len(model.languages) - 1))
    goal[np.arange(len(labels)), labels] = certain
    logits = model.logits(means)
    grid = np.exp(np.linspace(np.log(0.1), np.log(20), 81))
    loss = [-(goal * np.log(np.maximum(softmax(logits / t), 1e-300))).sum() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    sure = softmax(logits / model.temperature)
    best, right = sure.max(axis=1), sure.argmax(axis=1) == labels
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= MOST_WRONG)
    model.accept = float(best[order[fine[-1]]]) if len(fine) and fine[-1] < len(order) - 1 else 0.0 if len(fine) else 1.0
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(documents: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> Model:
    """A model of ``lang`` from the text of the rows that ``usable`` names.

    Rows without a language or without letters are left out. Of each language about ``sample_rows`` divided by the number of languages are taken, which
    ones a hash of doc_id and text decides, so the sample does not depend on how the table is stored. Without such rows the model has no languages.
    """
    labelled = documents.where(usable & F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32), np.zeros((DIMENSIONS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))
    languages = sorted(counts)
    share = sample_rows / len(languages)
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, share / counts[lang]))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < F.element_at(rates, F.col("lang")))

    def make() -> Callable[[bytes | None], bytes]:
        def of_text(text: bytes | None) -> bytes:
            bag = np.concatenate([pieces(part) for part in _parts(text or b"")])
            rng = np.random.default_rng(seed + len(bag))
            kept = rng.permutation(len(bag))[:SAMPLE_PIECES]
            return bag[kept].astype(np.uint32).tobytes()

        return of_text

    bag = text_column(make, "binary")
    table = sample.select("lang", draw.alias("draw"), "doc_id", bag("text").alias("bag")).toArrow()
    rows = sorted(zip(table["lang"].to_pylist(), table["draw"].to_pylist(), table["bag"].to_pylist()))
    rows = [(languages.index(lang), np.frombuffer(data, dtype=np.uint32)) for lang, _, data in rows if data]
    # Sorted by language and draw, so each language has its share in both parts.
    held = [r for k, r in enumerate(rows) if k % CALIBRATION == CALIBRATION - 1]
    used = [r for k, r in enumerate(rows) if k % CALIBRATION != CALIBRATION - 1]
    model = train([b for _, b in used], np.array([y for y, _ in used]), languages, seed)
    means = np.array([model.embeddings[b].mean(axis=0) for _, b in held]).reshape(len(held), DIMENSIONS)
    return calibrate(model, means, np.array([y for y, _ in held], dtype=np.int64))


PREDICTION = "lang: string, score: double, accepted: boolean"


def predicted(documents: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """The documents with a struct: ``lang``, the likeliest language, ``score``, its calibrated probability, and whether it is ``accepted``.

    Whole texts are read, in parts. A text that is null, empty or without a letter is ``und``, with score 0 and not accepted; so is every text where the model has no
    language. Rows are worked on one by one, so repeated rows and ids make no difference, and an empty table gives no rows. No other
    column is read; one called as the struct keeps its name, and the struct takes an underscore before it.
    """
    nothing = {"lang": NONE, "score": 0.0, "accepted": False}

    def make():
        def of_text(data: bytes | None) -> dict:
            mean = model.mean(data) if data and model.languages else None
            if mean is None:
                return nothing
            sure = softmax(model.logits(mean) / model.temperature)
            best = int(sure.argmax())
            return {"lang": model.languages[best], "score": float(sure[best]), "accepted": bool(sure[best] >= model.accept)}

        return of_text

    column = text_column(make, f"struct<{PREDICTION}>")
    whole = F.col(f"`{text}`")
    return documents.withColumn(free_name(documents, name), column(F.when(has_letter(whole), whole)))

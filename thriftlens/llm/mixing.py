"""Mixing of sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic). Raking scales the cells' weights to the target share of each source, then of each
language, then of each topic, round after round, until all three hold. A document is kept with a probability
in proportion to the weight of its cell over the cell's own share; what the probability cannot give beyond 1 is left as the
document's weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftlens.llm.texts import free_name
from thriftlens.session import cut_lineage

# Topic of a text: the first pattern that it has, else the last name.
TOPICS = {
    "table": r" \| ",
    "shouting": r"!! ",
    "markup": r"[#$%&*]{3}",
    "notice": r"(?i)license|rights reserved",
}
OTHER_TOPIC = "prose"
WORDS = r"[^\x20\x09-\x0D]+"
#: Powers of the observed shares that are the targets: below 1 they favour what is rare.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS = 12
#: Share of all tokens that the sample aims at.
FRACTION = 0.7
SEED = 42


def topic_of(text: Column, topics: dict[str, str] = TOPICS) -> Column:
    topic = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(topics.items()):
        topic = F.when(text.rlike(pattern), name).otherwise(topic)
    return topic


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets_of(cells: DataFrame, powers: dict[str, float]) -> DataFrame:
    """``cells`` with a target share for the value of each marginal: the observed share to a power, made to sum to 1."""
    everything = Window.partitionBy(F.lit(1))
    for name, power in powers.items():
        values = cells.groupBy(name).agg(F.sum("tokens").alias("t"))
        share = F.pow(F.col("t").cast("double"), F.lit(power))
        values = values.select(F.col(name).alias("value"), (share / F.sum(share).over(everything)).alias(f"{name}_target"))
        cells = cells.join(values, F.col(name).eqNullSafe(F.col("value"))).drop("value")
    return cells


def raked(cells: DataFrame, targets: list[str], rounds: int) -> DataFrame:
    """``cells`` with ``weight``: shares of 1 in all, scaled ``rounds`` times to ``<name>_target`` over each of ``targets``."""
    now = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    for _ in range(rounds):
        for name in targets:
            total = F.sum("weight").over(Window.partitionBy(name))
            now = now.withColumn("weight", F.col("weight") * F.col(f"{name}_target") / total)
    return now


def mixed(
    documents: DataFrame,
    powers: dict[str, float] = POWERS,
    fraction: float = FRACTION,
    rounds: int = ROUNDS,
    topics: dict[str, str] = TOPICS,
    seed: int = SEED,
    as_column: str = "mix",
    within: bool = False,
) -> DataFrame:
    """``documents`` with a struct column: topic, n_tokens, probability, weight, sampled.

    ``powers`` gives for each marginal (columns of the input, or ``topic``) the power of its observed token shares that is its
    target. ``probability`` is ``fraction`` times the raked share over the observed share of the cell, 1 at most; ``weight`` is the rest, so that
    tokens times probability times weight meet the targets. ``sampled`` compares the probability with a number drawn from a
    seeded hash of doc_id, so rows that share an id share the decision, and every run makes the same one. A null source or
    language is a value of its own. Texts without words have no tokens: cells of such alone, and an empty table, have probability
    ``fraction`` and weight 1. ``within`` lowers the fraction until no cell needs a probability over 1: then every weight is 1, and the
    sampled documents themselves meet the targets, as far as chance allows. The new column is the last and gets underscores before its name where the documents have such a column.

    Cells number sources times languages times topics at most. They stay in Spark; the join with the documents is a broadcast
    only where Spark finds their file small.
    """
    as_column = free_name(documents, as_column)
    topic, tokens = free_name(documents, "topic"), free_name(documents, "n_tokens")
    names = {name: topic if name == "topic" else name for name in powers}
    text = F.col("text")
    marked = documents.withColumn(topic, topic_of(text, topics)).withColumn(tokens, tokens_of(text))
    cells = marked.groupBy(*[F.col(column).alias(name) for name, column in names.items()])
    cells = cut_lineage(cells.agg(F.sum(tokens).alias("tokens")).where("tokens > 0"))
    fitted = raked(cut_lineage(targets_of(cells, powers)), list(powers), rounds)
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    rate = fraction * F.col("weight") * total / F.col("tokens")
    key = [F.col(name).alias(f"cell_{name}") for name in powers]
    rates = fitted.select(*key, rate.alias("cell_rate"))
    if within:
        most = F.max("cell_rate").over(Window.partitionBy(F.lit(1)))
        rates = rates.withColumn("cell_rate", F.col("cell_rate") / F.greatest(most, F.lit(1.0)))
    rates = cut_lineage(rates)
    same = [marked[column].eqNullSafe(rates[f"cell_{name}"]) for name, column in names.items()]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), marked["doc_id"].cast("string")))
    drawn = F.conv(F.substring(digest, 1, 13), 16, 10)
    rate = F.coalesce(rates["cell_rate"], F.lit(float(fraction)))
    probability = F.least(rate, F.lit(1.0))
    return marked.join(rates, same, "left").select(
        *[marked[f"`{c}`"] for c in documents.columns],
        F.struct(
            marked[topic].alias("topic"),
            marked[tokens].alias("n_tokens"),
            probability.alias("probability"),
            (rate / probability).alias("weight"),
            (drawn.cast("double") / float(1 << 52) < probability).alias("sampled"),
        ).alias(as_column),
    )


def sample(documents: DataFrame, **options) -> DataFrame:
    """The sampled documents, with their own columns. They carry no weights, so the fraction is lowered until none is needed (``within``)."""
    name = free_name(documents, "mix")
    found = mixed(documents, as_column=name, **{"within": True, **options})
    return found.where(F.col(name)["sampled"]).select(*[F.col(f"`{c}`") for c in documents.columns])

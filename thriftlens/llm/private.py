"""Personal data: exact identifiers as seeds, and more found by the contexts that the seeds share.

Seeds are e-mail addresses, IP addresses, card and phone numbers found by their form, and long random strings (kind ``secret``), which stand for keys and tokens. Tokens that look like identifiers and are in no seed are
candidates. The words before seeds and candidates are lexical patterns, and patterns and what they extract make a graph. Its scores are found in rounds:
a pattern scores by the known share of all that follows its words anywhere in the texts, with the seeds known from the start; a candidate
scores by its patterns together. So words that stand before anything are no patterns, however many seeds they precede. Candidates that
pass at the end are spans of kind ``context``.

Everything is DataFrame functions. Positions come from the gaps between the matches: a row for each match, and a
running sum over the rows of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftlens.llm.texts import write_small
from thriftlens.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
CONTEXT = "context"

# The forms of the seeds. They match what the plain forms match; possessive repeats and a look at the character before only keep the
# search linear on long runs of one class.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    SECRET: r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+",
}
#: Digits and letters that a secret has, at least: a long word of prose has no digits, a line of dashes neither.
SECRET_DIGITS, SECRET_LETTERS = 4, 4
# What may be an identifier: a token of six or more characters with an @, or with three digits.
CANDIDATE = r"(?<!\S)(?=[^\s@]*+@|[^\s0-9]*+[0-9][^\s0-9]*+[0-9][^\s0-9]*+[0-9])\S{6,}+"
#: What may stand right before an identifier and is no word of its context.
OPENING = r"""["'(\[{<]+"""
#: Characters kept of the gap before a match, to take its last words from.
BEFORE = 80

ROUNDS = 3
#: Different seeds that a pattern must extract.
LEAST_SEEDS = 3
#: Score from which a pattern is trusted, and from which a candidate is taken.
TRUSTED, TAKEN = 0.5, 0.8


def _at_most_255() -> str:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return rf"^(?:{part}|0++)(?:\.(?:{part}|0++)){{3}}$"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled and 9 taken off beyond 9, ends in 0."""
    reverse = F.reverse(digits)
    places = F.sequence(F.lit(1), F.length(digits))

    def value(place):
        digit = F.substring(reverse, place, 1).cast("int")
        twice = 2 * digit
        return F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of the form is one of the kind."""
    digits = _digits(match)
    n = F.length(digits)
    card = F.when(n.between(16, 19), _luhn(digits)).otherwise(False)
    letters = F.length(F.regexp_replace(match, "[^A-Za-z]", ""))
    return (
        F.when(kind == "ip", match.rlike(_at_most_255()))
        .when(kind == "card", card)
        .when(kind == "phone", n.between(8, 15))
        .when(kind == SECRET, (n >= SECRET_DIGITS) & (letters >= SECRET_LETTERS))
        .otherwise(True)
    )


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, at, gap, before, match): the matches by position, with the length and the end of the text between."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    each = F.zip_with(
        F.slice(gaps, 1, F.size(matches)),
        matches,
        lambda gap, match: F.struct(
            F.lit(kind).alias("kind"),
            F.length(gap).alias("gap"),
            F.when(F.length(gap) > BEFORE, F.substring(gap, -BEFORE, BEFORE)).otherwise(gap).alias("before"),
            match.alias("match"),
        ),
    )
    numbered = F.transform(
        each, lambda x, at: F.struct(x["kind"].alias("kind"), at.alias("at"), x["gap"], x["before"], x["match"])
    )
    none = F.array().cast("array<struct<kind:string,at:int,gap:int,before:string,match:string>>")
    return F.when(text.rlike(pattern), numbered).otherwise(none)


def matches_of(documents: DataFrame) -> DataFrame:
    """(record, doc_id, kind, start, end, match, before): matches of all forms and candidates, one row each.

    ``record`` numbers the rows of ``documents``; every row has one row more, with a null kind.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    forms = [*PATTERNS.items(), (CONTEXT, CANDIDATE)]
    mark = F.array(F.lit(None).cast("struct<kind:string,at:int,gap:int,before:string,match:string>"))
    found = documents.select(
        F.monotonically_increasing_id().alias("record"),
        "doc_id",
        F.concat(mark, *[_found(text, kind, pattern) for kind, pattern in forms]).alias("found"),
    )
    each = cut_lineage(found.select("record", "doc_id", F.explode("found").alias("m")).select("record", "doc_id", "m.*"))
    length = F.length("match")
    rows = Window.partitionBy("record", "kind").orderBy("at")
    until = F.sum(F.col("gap") + length).over(rows)
    placed = each.repartition("record").withColumn("end", until.cast("bigint"))
    return placed.select(
        "record", "doc_id", "kind", (F.col("end") - length).alias("start"), "end", "match", "before"
    )


def spans_of(matches: DataFrame) -> DataFrame:
    """``matches`` without what fails its kind, and without candidates that touch a seed; candidates lose opening and closing punctuation."""
    checked = matches.where(F.col("kind").isNull() | valid(F.col("kind"), F.col("match")))
    is_seed = F.col("kind") != CONTEXT
    order = Window.partitionBy("record").orderBy("start", "end")
    seeds_before = F.max(F.when(is_seed, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seeds_behind = F.min(F.when(is_seed, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    touches = (F.coalesce(seeds_before, F.lit(0)) > F.col("start")) | (
        F.coalesce(seeds_behind, F.col("end")) < F.col("end")
    )
    kept = checked.withColumn("touches", touches).where(F.col("kind").isNull() | is_seed | ~F.col("touches"))
    is_candidate = F.col("kind") == CONTEXT
    opened = F.when(is_candidate, F.regexp_replace("match", rf"^{OPENING}", "")).otherwise(F.col("match"))
    start = F.col("start") + F.length("match") - F.length(opened)
    token = F.when(is_candidate, F.regexp_replace(opened, r"[.,;:!?)\]}'\"]+$", "")).otherwise(F.col("match"))
    return kept.select(
        "record", "doc_id", "kind", start.alias("start"), (start + F.length(token)).alias("end"), token.alias("match"), "before"
    )


def patterns_of(spans: DataFrame) -> DataFrame:
    """(pattern, instance, seed, n): how often each pattern extracts each instance.

    A pattern is the last word before a match, or the last two, in lower case, without quotes and brackets that open right before it. Matches with no word before them have none.
    """
    last = r"(\S+)\s*$"
    two = r"(\S+\s+\S+)\s*$"
    before = F.lower(F.regexp_replace("before", rf"{OPENING}$", ""))
    words = F.array(
        F.concat(F.lit("1 "), F.regexp_extract(before, last, 1)),
        F.concat(F.lit("2 "), F.regexp_replace(F.regexp_extract(before, two, 1), r"\s+", " ")),
    )
    each = spans.where("kind is not null").select(
        F.explode(words).alias("pattern"), F.col("match").alias("instance"), (F.col("kind") != CONTEXT).alias("seed")
    )
    return each.where(F.length("pattern") > 2).groupBy("pattern", "instance", "seed").agg(F.count("*").alias("n"))


def support_of(graph: DataFrame, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """(pattern, extracted, known) of the patterns with ``least_seeds`` different seeds or more."""
    sums = graph.groupBy("pattern").agg(
        F.sum("n").alias("extracted"),
        F.count_if("seed").alias("seeds"),
        F.sum(F.when(F.col("seed"), F.col("n")).otherwise(0)).alias("known"),
    )
    return sums.where(F.col("seeds") >= least_seeds).drop("seeds")


def occurrences_of(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, seen): how often the words of each of ``patterns`` stand before another token, over all texts.

    The patterns' table joins the words of the texts where they are; only counts are shuffled unless it is too large to broadcast.
    """
    words = F.split(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))), " ")
    ahead = F.slice("w", 1, F.size("w") - 1)
    ones = F.transform(ahead, lambda w: F.concat(F.lit("1 "), w))
    twos = F.transform(F.arrays_zip(F.slice("w", 1, F.size("w") - 2), F.slice("w", 2, F.size("w") - 2)), lambda p: F.concat(F.lit("2 "), p["0"], F.lit(" "), p["1"]))
    texts = documents.select(words.alias("w")).where(F.size("w") > 2)
    each = texts.select(F.explode(F.concat(ones, twos)).alias("pattern"))
    return each.join(patterns.select("pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("seen"))


def bootstrap(
    graph: DataFrame, support: DataFrame, seen: DataFrame, rounds: int = ROUNDS, trusted: float = TRUSTED
) -> DataFrame:
    """(instance, score): candidates with the chance that one of their trusted patterns is right, after ``rounds`` rounds.

    A pattern's score is the sum of its extractions' scores (seeds 1, candidates what the round before gave them) over the number of
    all that follows its words, plus one. Sums combine before the shuffle, so a pattern with a third of all extractions is one sum.
    """
    followed = F.greatest("extracted", F.coalesce("seen", F.lit(0)))
    patterns = write_small(support.join(seen, "pattern", "left").select("pattern", "known", followed.alias("all")))
    edges = graph.where(~F.col("seed")).join(patterns.select("pattern"), "pattern", "left_semi")
    edges = write_small(edges.select("pattern", "instance", "n"))
    score = edges.select("instance").distinct().withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        gained = (
            edges.join(score, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("gained"))
        )
        share = (F.col("known") + F.coalesce("gained", F.lit(0.0))) / (F.col("all") + 1)
        worth = patterns.join(gained, "pattern", "left").select("pattern", F.round(share, 6).alias("worth"))
        doubt = F.exp(F.sum(F.log(1 - F.least("worth", F.lit(0.999)))))
        score = (
            edges.select("pattern", "instance")
            .join(worth.where(F.col("worth") >= trusted), "pattern")
            .groupBy("instance")
            .agg(F.round(1 - doubt, 6).alias("score"))
        )
    return score


def identifiers(documents: DataFrame, rounds: int = ROUNDS, trusted: float = TRUSTED, taken: float = TAKEN) -> DataFrame:
    """(doc_id, spans): one row for each row of ``documents``, spans (kind, start, end, match, score) by kind as in ``KINDS``, then ``secret``
    and ``context``, then start; offsets in code points, end exclusive.

    A null text counts as empty and has no spans. Rows that share a doc_id, or have none, each get a row. Texts are searched whole. An
    empty table gives no rows; other columns are not read. Only the matches of one row come together.
    """
    spans = spans_of(matches_of(documents))  # the matches are written; the rest is little work on them
    graph = patterns_of(spans)
    support = write_small(support_of(graph))
    scores = bootstrap(graph, support, occurrences_of(documents, support), rounds, trusted)
    accepted = scores.where(F.col("score") >= taken).select(F.col("instance").alias("match"), "score")
    seeds = spans.where(F.col("kind").isNull() | (F.col("kind") != CONTEXT)).withColumn("score", F.lit(1.0))
    more = spans.where(F.col("kind") == CONTEXT).join(accepted, "match")
    order = F.array(*[F.lit(k) for k in (*KINDS, SECRET, CONTEXT)])
    span = F.struct(
        F.array_position(order, F.col("kind")).alias("place"), "start", "end", "kind", "match", "score"
    )
    return (
        seeds.unionByName(more.select(*seeds.columns))
        .groupBy("record")
        .agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"))
        .select("record", "doc_id", "spans")
    )

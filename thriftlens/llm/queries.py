"""The registered queries of this package and the SQL they are checked with."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftlens.llm import (
    chat,
    decontaminate,
    language,
    licences,
    lines,
    mixing,
    periodic,
    private,
    ranked,
    sharding,
    simhash,
    topk,
    toxicity,
)
from thriftlens.plans.binding import crc32_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the vocabulary of the public tokenizer lies.
TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.json")

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
WORDS_SQL = (
    f"regexp_extract_all(translate(coalesce(text, ''), {UPPER}, lower({UPPER})), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OVERLAP_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, {WORDS_SQL} AS w FROM documents
), items AS (
  SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark)
), tests AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS x
  FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS s FROM items WHERE k > 0)
), places AS (
  SELECT row_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS x
  FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS s
        FROM docs, (SELECT DISTINCT k FROM tests) WHERE len(w) >= k)
), hits AS (
  SELECT row_id, item_id, s, p.k FROM places p JOIN tests t USING (k, x)
), words_hit AS (
  SELECT row_id, count(DISTINCT i) AS n_hit
  FROM (SELECT row_id, unnest(generate_series(s, s + k - 1)) AS i FROM hits) GROUP BY 1
), named AS (
  SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words_hit USING (row_id) LEFT JOIN named USING (row_id)
"""


def held_out():
    """Whether a document is kept from every fit."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def sha256(text):
    return F.sha2(text.cast("binary"), 256)


@query("op1_personal_data")
def op1(spark, sf_dir):
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda of: F.array_join(
        F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    found = private.identifiers(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in private.KINDS],
        *[count(kind).alias(f"n_{kind}") for kind in (private.SECRET, private.CONTEXT)],
        sha256(joined(F.filter(spans, lambda s: s["kind"].isin(*private.KINDS)))).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def _mixing_sql() -> str:
    topic = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for t, p in mixing.TOPICS.items())
    steps = ["rake0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM goals)"]
    for k in range(mixing.ROUNDS):
        for j, name in enumerate(mixing.POWERS):
            at = len(mixing.POWERS) * k + j
            steps.append(
                f"rake{at + 1} AS (SELECT * REPLACE (weight * {name}_target / sum(weight) OVER (PARTITION BY {name}) "
                f"AS weight) FROM rake{at})"
            )
    goals = ", ".join(
        f"(SELECT pow(g, {p}) FROM (SELECT sum(tokens) AS g FROM cells x WHERE x.{n} IS NOT DISTINCT FROM c.{n})) "
        f"/ (SELECT sum(pow(g, {p})) FROM (SELECT sum(tokens) AS g FROM cells GROUP BY {n})) AS {n}_target"
        for n, p in mixing.POWERS.items()
    )
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, source, lang, CASE {topic} ELSE '{mixing.OTHER_TOPIC}' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    CAST('0x' || substr(md5('{mixing.SEED}' || coalesce(':' || CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / pow(2, 52) AS u
  FROM documents
), cells AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM docs GROUP BY 1, 2, 3 HAVING sum(n_tokens) > 0
), goals AS MATERIALIZED (
  SELECT c.*, {goals} FROM cells c
), {", ".join(steps)},
rates AS MATERIALIZED (
  SELECT source, lang, topic, {mixing.FRACTION} * weight * sum(tokens) OVER () / tokens AS rate
  FROM rake{mixing.ROUNDS * len(mixing.POWERS)}
)
SELECT doc_id, d.source, d.lang, d.topic, CAST(n_tokens AS BIGINT) AS n_tokens,
  round(least(coalesce(rate, {mixing.FRACTION}), 1.0), 6) + 0.0 AS probability,
  round(coalesce(rate, {mixing.FRACTION}) / least(coalesce(rate, {mixing.FRACTION}), 1.0), 6) + 0.0 AS weight,
  u < least(coalesce(rate, {mixing.FRACTION}), 1.0) AS sampled
FROM docs d LEFT JOIN rates r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang
  AND d.topic = r.topic
"""


@query("op2_mixing", _mixing_sql())
def op2(spark, sf_dir):
    mix = F.col("mix")
    found = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return found.select(
        "doc_id",
        "source",
        "lang",
        mix["topic"].alias("topic"),
        mix["n_tokens"].alias("n_tokens"),
        (F.round(mix["probability"], 6) + 0.0).alias("probability"),
        (F.round(mix["weight"], 6) + 0.0).alias("weight"),
        mix["sampled"].alias("sampled"),
    )


@query("op3_simhash_near_dedup")
def op3(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op4_sharding")
def op4(spark, sf_dir):
    found = sharding.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        sharding.crc_of(F.col("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_decontamination", OVERLAP_SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"))
    overlap = F.col("overlap")
    return found.select(
        "doc_id",
        overlap["n_words"].alias("n_words"),
        decontaminate.n_hit(overlap).alias("n_hit"),
        F.size(overlap["items"]).cast("bigint").alias("n_items"),
        sha256(F.array_join(overlap["items"], ",")).alias("items_sha256"),
        decontaminate.contaminated(overlap).alias("contaminated"),
    )


@query("op6_license_notices")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    places = F.col("license")["places"]
    base = F.filter(places, lambda p: p["kind"] == "base")
    starts = F.transform(base, lambda p: p["first_word"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    return licences.license_places(docs).select(
        "doc_id",
        F.col("license")["n_words"].alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(places).alias("labels"),
        F.coalesce(F.array_max(F.transform(places, lambda p: p["score"])), F.lit(0.0)).alias("score"),
        F.array_join(
            F.transform(places, lambda p: F.concat_ws(":", p["kind"], p["label"], p["start"], p["end"])), ","
        ).alias("spans"),
    )


@query("op7_repeated_passages")
def op7(spark, sf_dir):
    runs = F.col("runs")
    total = lambda of: F.aggregate(of, F.lit(0).cast("bigint"), lambda n, x: n + x)
    return lines.repeated(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "n_units",
        F.size(runs).cast("bigint").alias("n_runs"),
        total(F.transform(runs, lambda r: r["words"])).alias("words_removed"),
        total(F.transform(runs, lambda r: r["end"] - r["start"])).alias("chars_removed"),
        F.array_join(F.transform(runs, lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(runs, lambda r: r["kept_in"])))).alias("kept_in"),
    )


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found, score = F.col("toxicity"), F.col("toxicity")["score"]
    return toxicity.passages(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        score.alias("score"),
        (score >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size(found["segments"]).alias("n_passages"),
        F.array_join(
            F.transform(found["segments"], lambda s: F.concat_ws(":", s["first_word"], s["last_word"])), ","
        ).alias("passages"),
    )


PROBE = (-7, [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")])


TURNS_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), sized AS (
  SELECT *, length('<turn>' || '<text>' || '</turn>') + length(role) + length(
    replace(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<text>', '<\text>'),
      '</turn>', '<\/turn>'), '<|endoftext|>', '<\|endoftext|>')) AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op9_chat_format", TURNS_SQL)
def op9(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(PROBE[0], k, role, text) for k, (role, text) in enumerate(PROBE[1])]
    rows = rows.unionByName(spark.createDataFrame(probe, rows.schema))
    read = chat.read_back(chat.formatted(rows, TOKENIZER))
    return read.drop("n_tokens", "n_loss_tokens")


TOP_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(list_zip(q.vector, v.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.r <> v.r
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op10_exact_top_k", TOP_SQL)
def op10(spark, sf_dir):
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


RANKED_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, w, len(w) AS n
  FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents) WHERE len(w) > 0
), total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM docs),
asked AS MATERIALIZED (
  SELECT query, item_id, unnest(list_distinct(w)) AS t
  FROM (SELECT row_number() OVER () AS query, item_id, {WORDS_SQL} AS w FROM benchmark)
), postings AS MATERIALIZED (
  SELECT row_id, t, count(*) AS tf FROM (SELECT row_id, unnest(w) AS t FROM docs)
  WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2
), weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM postings GROUP BY 1), total
), impacts AS (
  SELECT row_id, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_all))) AS impact
  FROM postings JOIN docs USING (row_id) JOIN weights USING (t), total
), scored AS (
  SELECT query, item_id, row_id, doc_id, CAST(sum(impact) AS BIGINT) AS score
  FROM asked JOIN impacts USING (t) GROUP BY ALL
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {ranked.TOP}
"""


@query("op11_ranked_search", RANKED_SQL)
def op11(spark, sf_dir):
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_language")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, ~held_out())
    found = F.col("language")
    return language.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        found["lang"].alias("lang_pred"),
        found["score"].alias("score"),
        found["accepted"].alias("accepted"),
    )


RUNS_SQL = r"""
WITH marked AS (
  SELECT row_number() OVER () AS row_id, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p
  FROM (SELECT doc_id, CHECKSUM AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), docs AS MATERIALIZED (
  SELECT row_id, doc_id, n, CASE WHEN planted THEN w[:a] || list_transform(generate_series(a, n - 1), lambda i: w[a + (i - a) % p + 1]) ELSE w END AS w
  FROM marked
), words AS MATERIALIZED (
  SELECT row_id, unnest(generate_series(0, n - 1)) AS i, unnest(w) AS word FROM docs WHERE n > 0
), fives AS MATERIALIZED (
  SELECT row_id, i, x FROM (
    SELECT row_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS x, lead(i, 4) OVER o AS last
    FROM words WINDOW o AS (PARTITION BY row_id ORDER BY i)) WHERE last IS NOT NULL
), pairs AS (
  SELECT row_id, a.i, b.i - a.i AS d FROM fives a JOIN fives b USING (row_id, x) JOIN docs USING (row_id) WHERE b.i > a.i AND 4 * (b.i - a.i) <= n
), stretches AS MATERIALIZED (
  SELECT row_id, d, min(i) AS start, count(*) + 4 + d AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row_id, d ORDER BY i) AS island FROM pairs)
  GROUP BY row_id, d, island HAVING count(*) + 4 + d >= greatest(6, 4 * d)
), runs AS MATERIALIZED (
  SELECT row_id, start, length, d AS period FROM stretches s
  WHERE NOT EXISTS (SELECT 1 FROM stretches t WHERE t.row_id = s.row_id AND t.d < s.d
    AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), longest AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY length DESC, start, period) AS nth FROM runs
), listed AS (
  SELECT row_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS x
  FROM runs GROUP BY 1
), dropped AS (
  SELECT DISTINCT row_id, unnest(generate_series(start + period, start + length - 1)) AS i FROM runs
), collapsed AS (
  SELECT row_id, string_agg(word, ' ' ORDER BY i) AS x FROM words ANTI JOIN dropped USING (row_id, i) GROUP BY 1
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
  CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed.x, '')) AS runs_sha256, sha256(coalesce(collapsed.x, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (row_id) LEFT JOIN collapsed USING (row_id)
  LEFT JOIN (SELECT * FROM longest WHERE nth = 1) USING (row_id)
"""


@query("op13_periodic_runs", RUNS_SQL.replace("CHECKSUM", crc32_sql("CAST(doc_id AS VARCHAR)")))
def op13(spark, sf_dir):
    docs = periodic.planted(table(spark, sf_dir, "documents"))
    found = F.col("periodic")
    runs = found["runs"]
    # The longest run; of those the first, then the one with the smallest period.
    longest = F.array_max(
        F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small")))
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic.periodic_runs(docs).select(
        "doc_id",
        F.size(runs).cast("bigint").alias("n_runs"),
        (-longest["back"]).alias("start"),
        longest["length"].alias("length"),
        (-longest["small"]).alias("period"),
        F.floor(1000 * longest["length"] / -longest["small"]).alias("exponent_milli"),
        sha256(F.array_join(lines, "")).alias("runs_sha256"),
        sha256(found["collapsed"]).alias("collapsed_sha256"),
    )

"""Sharding by a two-pass external shuffle.

First pass: a seeded hash scatters the records uniformly into buckets that fit in memory, each a partition of its own. Second pass: each bucket is put in
order, shuffled with Fisher-Yates from a seed of its own and written. The buckets one after another are a random order of all records, which is cut into shards of
nearly equal numbers of rows, so a shard is made of whole buckets but for the two at its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thriftlens.llm.texts import free_name
from thriftlens.session import cut_lineage

SHARDS = 16
SEED = 42
#: Bytes of text that a bucket holds, about.
BUCKET_BYTES = 64 << 20
#: Buckets for each shard, at least, so that the tasks are even on small inputs too.
BUCKETS_PER_SHARD = 4


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shuffled(
    documents: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``documents`` with columns ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard), in random order.

    The numbers of rows of two shards differ by at most one. The scatter is by a hash of the seed, doc_id and text, and a bucket's order depends on
    the seed and its records alone, so the result is the same however the input is stored and whatever tasks run where. Only
    rows that repeat both doc_id and text, or share a null id and a text, are told apart by their place in the input: they spread like all others, and the
    order of a table with such rows depends on its partitions. A null text counts as empty in sizes. An empty table gives no rows. Columns keep their names; the
    new ones get underscores before theirs where the input has such columns.

    ``documents`` is read four times (sizes, repeats, counts of buckets, records) and must be read in the same partitions each time: a table
    of files, or what ``cut_lineage`` returns.
    """
    shard, slot = free_name(documents, "shard"), free_name(documents, "slot")
    columns = documents.columns
    text = F.col("text")
    total = documents.agg(F.count("*").alias("n"), F.sum(size_of(text)).alias("bytes")).first()
    n = total["n"]
    buckets = max(BUCKETS_PER_SHARD * shards, -(-(total["bytes"] or 0) // bucket_bytes))
    bucket, row, place, own = (free_name(documents, x) for x in ("bucket", "record", "place", "own_hash"))
    hash_of = F.xxhash64(F.lit(seed), F.col("doc_id"), text)
    # Hashes of rows that repeat: none where doc_id is a key, and then the join costs nothing.
    twice = cut_lineage(documents.groupBy(hash_of.alias(own)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(own))
    hashed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row), hash_of.alias(own), F.monotonically_increasing_id().alias(place)
    )
    told_apart = hashed.where(F.lit(False)) if twice.isEmpty() else hashed.join(twice, own, "left_semi")
    hashed = hashed if twice.isEmpty() else hashed.join(twice, own, "left_anti")
    hashed = hashed.unionByName(told_apart.withColumn(own, F.xxhash64(own, place)))
    scattered = hashed.select(
        F.struct(F.col(own).alias("hash"), F.col(row).alias("row")).alias(row), F.pmod(own, F.lit(buckets)).cast("int").alias(bucket)
    )

    # Rows before each bucket: the buckets are few, so one task may add their counts up.
    before = cut_lineage(
        scattered.groupBy(bucket)
        .count()
        .select(
            bucket,
            (F.sum("count").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
        )
    )
    orders = scattered.repartitionById(buckets, F.col(bucket)).groupBy(bucket).agg(F.array_sort(F.collect_list(row)).alias(row))
    at = (
        orders.join(before, bucket)
        .select(F.coalesce("before", F.lit(0)).alias("before"), F.posexplode(F.shuffle(row, seed)).alias(place, row))
        .select((F.col("before") + F.col(place)).alias(place), F.col(row)["row"].alias(row))
    )
    size, more = divmod(n, shards)  # the first ``more`` shards have one row more
    in_first = F.col(place) < more * (size + 1)
    rest = F.col(place) - more * (size + 1)
    whole = max(size, 1)
    return at.select(
        *[F.col(row)[c].alias(c) for c in columns],
        F.when(in_first, F.floor(F.col(place) / (size + 1)))
        .otherwise(more + F.floor(rest / whole))
        .cast("int")
        .alias(shard),
        F.when(in_first, F.pmod(F.col(place), F.lit(size + 1)))
        .otherwise(F.pmod(rest, F.lit(whole)))
        .cast("bigint")
        .alias(slot),
    )

"""Keyed writes on plain parquet: a changed table is a new version, never an edit in place."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thriftlens.session import cut_lineage

# Partition column of tables that are changed by key.
PART = "key_part"


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` with ``changes`` applied by key. Columns that ``changes`` lacks stay untouched;
    columns it has are taken as they are, null included. A key that ``changes`` holds twice is an error."""
    return _applied(target, changes, list(keys), "full")


def update_existing(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``upsert``, but a key that the target lacks is ignored."""
    return _applied(target, changes, list(keys), "left")


def _once(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``changes``, failing where a key occurs twice. The rows are dealt by key, as the join that follows needs them."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    twice = F.raise_error(F.lit(f"changes hold a key twice: {', '.join(keys)}")).cast("boolean")
    return changes.withColumn("_nth", nth).where(F.when(F.col("_nth") > 1, twice).otherwise(F.lit(True))).drop("_nth")


def _applied(target: DataFrame, changes: DataFrame, keys: list[str], how: str) -> DataFrame:
    supplied = [c for c in changes.columns if c not in keys]
    extra = [c for c in supplied if c not in target.columns]
    marked = _once(changes, keys).select(*keys, *[F.col(c).alias(f"_n_{c}") for c in supplied], F.lit(True).alias("_hit"))
    joined = target.join(marked, keys, how)

    def value(c: str) -> Column:
        if c in keys or c not in supplied:
            return F.col(c)
        kept = F.col(c) if c in target.columns else F.lit(None)
        return F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(kept).alias(c)

    return joined.select(*[value(c) for c in [*target.columns, *extra]])


def fill_missing(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fills nulls of ``columns`` from ``source``; values that are there are never overwritten."""
    offered = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns])
    joined = target.join(offered, list(keys), "left")
    return joined.select(
        *[F.coalesce(c, f"_s_{c}").alias(c) if c in columns else F.col(c) for c in target.columns]
    )


def repair_attributes(rows: DataFrame, index_rows: DataFrame, offer_rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Missing attributes from two sources. Where both supply one, the offer's value stands."""
    first = fill_missing(offer_rows.select(*keys, *columns), index_rows, keys, columns)
    only_index = index_rows.select(*keys, *columns).join(offer_rows.select(*keys), list(keys), "left_anti")
    return fill_missing(rows, first.unionByName(only_index), keys, columns)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true; an unknown predicate keeps the row."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def exact_count(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Exact number of rows under a filter; the scan reads the filter's columns only."""
    rows = df if predicate is None else df.where(predicate)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def write_snapshot(df: DataFrame, path: str, as_of: str) -> None:
    """Replaces the rows of one day and no other: a re-run gives the same table, also one that finds no rows."""
    df.drop("as_of").write.mode("overwrite").parquet(f"{path}/as_of={as_of}")


def part_of(keys: Sequence[str], parts: int) -> Column:
    """The hash partition of a row of a partitioned table."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], parts: int) -> None:
    """Writes a table in ``parts`` partitions by a hash of its keys, for ``upsert_partitioned``."""
    df.withColumn(PART, part_of(keys, parts)).write.mode("overwrite").partitionBy(PART).parquet(path)


def upsert_partitioned(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], parts: int) -> None:
    """Applies ``changes`` by key to a table of ``write_partitioned``, or begins it with them. Only partitions that hold a changed key are read and
    replaced; their new rows are written aside first, so a lost task never leaves half a partition."""
    if not exists(spark, path):
        return write_partitioned(_once(changes, keys), path, keys, parts)
    marked = changes.withColumn(PART, part_of(keys, parts))
    touched = [r[PART] for r in marked.select(PART).distinct().collect()]  # ``parts`` numbers at most
    held = spark.read.parquet(path).where(F.col(PART).isin(touched))
    replace_parts(upsert(held.drop(PART), changes, keys), path, keys, parts)


def replace_parts(fresh: DataFrame, path: str, keys: Sequence[str], parts: int) -> None:
    """Replaces the partitions that ``fresh`` has rows of. ``fresh`` may be read from the same table: it is written aside first."""
    staged = cut_lineage(fresh.withColumn(PART, part_of(keys, parts)))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Writes the whole table as one version. The folder of a version is replaced as a whole, so a
    failed or repeated write leaves the earlier versions as they are."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return files.exists(at)


def drop_partitions(spark: SparkSession, path: str, column: str, gone: Callable[[str], bool]) -> list[str]:
    """Removes the folders ``column=value`` of a table for whose value ``gone`` holds, and returns these values. Only
    the names of the folders are read, no file is read or written. A table that is not there has none."""
    files, at = _folder(spark, path)
    if not files.exists(at):
        return []
    names = [entry.getPath() for entry in files.listStatus(at) if entry.isDirectory()]
    values = {str(p.getName()).removeprefix(f"{column}="): p for p in names if str(p.getName()).startswith(f"{column}=")}
    dropped = sorted(v for v in values if gone(v))
    for value in dropped:
        files.delete(values[value], True)
    return dropped


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def versions_of(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that a table has."""
    files, at = _folder(spark, path)
    names = [str(entry.getPath().getName()) for entry in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def write_bucketed(df: DataFrame, path: str, version: int, keys: Sequence[str], buckets: int) -> None:
    """Writes a version of a table whose files are the hash buckets of its keys, each in order of the keys. ``df`` should be dealt out by
    the keys into ``buckets`` partitions already, as ``upsert_bucketed`` leaves it; then every bucket is one file."""
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", f"{path}/version={version}").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay, the catalogue is only told how they lie


def read_bucketed(spark: SparkSession, path: str, version: int, keys: Sequence[str], buckets: int) -> DataFrame:
    """A version of ``write_bucketed``, with what Spark has to know to join it by its keys without a shuffle."""
    name, at = f"bucketed_{uuid.uuid4().hex}", f"{path}/version={version}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(at).schema)
    listed = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({listed}) SORTED BY ({listed}) INTO {buckets} BUCKETS LOCATION '{at}'")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def upserted_buckets(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """The newest version with ``changes`` applied by key: only the changes are shuffled, to the buckets that the table lies in. Where ``buckets`` is
    less than the session's shuffle partitions, Spark may choose to shuffle both."""
    target = read_bucketed(spark, path, versions_of(spark, path)[-1], keys, buckets)
    return upsert(target, changes.repartition(buckets, *keys), keys)


def upsert_bucketed(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], buckets: int) -> int:
    """Applies ``changes`` by key as a new version, or begins the table with them; returns its number. For tables of which most rows change: they are
    read and written whole and never shuffled. A failed write leaves the versions before it as they are."""
    before = versions_of(spark, path)
    version = before[-1] + 1 if before else 0
    rows = upserted_buckets(spark, path, changes, keys, buckets) if before else _once(changes, keys).repartition(buckets, *keys)
    write_bucketed(rows, path, version, keys, buckets)
    return version

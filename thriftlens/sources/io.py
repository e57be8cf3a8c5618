"""JSON lines in, dated JSON lines out."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type of the place of a line among the files read.
PLACE = "struct<file_path: string, file_block_start: bigint, line: bigint>"


def _newest(spark: SparkSession, pattern: str) -> str | None:
    """The matching file or folder whose name sorts last; only names are read, not contents."""
    name = pattern.rstrip("/").rsplit("/", 1)[-1]
    parts = {"*": "[^/]*", "?": "[^/]"}
    matcher = "".join(parts.get(ch, re.escape(ch)) for ch in name)
    entry = F.regexp_extract("path", f"^(.*/{matcher})(/.*)?$", 1)
    return spark.read.format("binaryFile").load(pattern).agg(F.max(entry)).first()[0]


def read_jsonl(spark: SparkSession, pattern: str, schema: T.StructType, newest_only: bool = True, place: str | None = None) -> DataFrame:
    """All files of a glob, or only the one whose name sorts last: the names carry the dates. A glob
    that matches nothing gives no rows. ``place`` names a column that rises with file name and line."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    try:
        path = _newest(spark, pattern) if newest_only else pattern
        rows = spark.read.schema(schema).json(path)
        return rows if place is None else rows.select("*", at.alias(place))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        none = spark.createDataFrame([], schema)
        return none if place is None else none.withColumn(place, F.lit(None).cast(PLACE))


# Lines of a landed file: a compressed file is read by one task.
FILE_LINES = 500_000


def write_lines(lines: DataFrame, path: str) -> None:
    """A column of JSON texts as landed files. Names repeat in every line, so the files are compressed; each holds ``FILE_LINES`` lines at most."""
    lines.write.options(**{"compression": "gzip", "zlib.compress.level": "FIVE", "maxRecordsPerFile": FILE_LINES}).text(path)


def pick(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Renames and keeps the mapped fields (``column: source field``); absent ones become null."""
    return df.select(
        *[
            (F.col(src) if src in df.columns else F.lit(None)).alias(col)
            for col, src in mapping.items()
        ]
    )


def write_checks(df: DataFrame, folder: str, day: str) -> None:
    """The day's observations as JSON lines, one folder per day, under the name that ``check_*.jsonl`` finds."""
    df.write.mode("overwrite").json(f"{folder}/check_{day}.jsonl")

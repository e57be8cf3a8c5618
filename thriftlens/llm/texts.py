"""Words of whole texts, and columns that Python computes on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from thriftlens.session import cut_lineage

# Bytes of a word are digits, letters in lower case and all of a character beyond ASCII.
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else ord(chr(b).lower()) if chr(b).isupper() else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case; a null has none."""
    return text.translate(WORD_BYTES).split() if text else []


#: Bytes of an Arrow batch, about: what a task and its Python worker hold of a table at a time.
BATCH_BYTES = "8m"


def lean_batches() -> None:
    """Sets the session's Arrow batches to ``BATCH_BYTES``; Spark's own limit is eight times as much."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_column(make: Callable[[], Callable[[bytes | None], object]], ddl: str) -> Callable[..., Column]:
    """A column function of a text: ``make()`` runs once per task and gives the function of one text.

    Texts arrive as UTF-8 bytes in Arrow batches that Spark limits by bytes, the other columns stay
    in the JVM. Results are dicts for a struct type.
    """
    lean_batches()
    kind = T._parse_datatype_string(ddl)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_text = make()
        for batch in batches:
            yield pa.array([of_text(x.as_py()) for x in batch], type=arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    column = F.arrow_udf(run, kind)
    return lambda text: column(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def write_small(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for a table that is a small part of the corpus: an eighth of the shuffle's tasks write it, and so many fewer files."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.coalesce(max(1, tasks // 8)))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it where the input has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def asciified(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())

"""Conversations as training texts with loss masks aligned to tokens.

A conversation is rendered as ``<turn>role<text>text</turn>`` for each of its turns. Where a role or text holds one of the control
strings, a backslash goes behind its first character, and every backslash is doubled; both are undone on reading. The rendered text is
encoded once, with the offsets of its tokens; control strings are tokens of their own, so no token reaches over the end of a turn. The spans of
the turns that count for the loss, sorted, meet the sorted token spans by binary search.

A running sum over the turns' lengths cuts a conversation into segments of whole turns, about ``segment_chars`` long. Segments are dealt to the tasks one by
one, so a conversation of any size is rendered, encoded and masked by many tasks with one segment in memory each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thriftlens.llm.texts import lean_batches
from thriftlens.session import cut_lineage

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
CONTROL = (TURN, TEXT, END, "<|endoftext|>")
TRAINED_ROLES = ("assistant",)
SEGMENT_CHARS = 1 << 22
#: Turn numbers of a cell of the running sum.
TURNS_OF_CELL = 4096

_TO_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{TURN}(.*?){TEXT}(.*?){END}", re.DOTALL)


def escaped(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rendered(turns: list[tuple[str, str]], trained=TRAINED_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns and the spans in it, by start, that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escaped(text)
        head = f"{TURN}{escaped(role)}{TEXT}"
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def turns_of(text: str) -> list[tuple[str, str]]:
    """The turns that ``rendered`` made the text of."""
    return [(unescaped(role), unescaped(body)) for role, body in _TURN.findall(text)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, by position, lie in one of the spans; both are sorted."""
    mask = np.zeros(len(starts), dtype=bool)
    full = [s for s in spans if s[1] > s[0]]
    if not len(starts) or not full:
        return mask
    first, last = np.array(full).T
    at = np.searchsorted(last, starts, side="right")  # the first span that ends after the token starts
    found = at < len(last)
    mask[found] = ends[found] > first[at[found]]
    return mask


def loss_text(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The pieces of ``text`` under the mask, tokens that touch or overlap made one piece, unescaped."""
    pieces, at, until = [], -1, -1
    for start, end in zip(starts[mask].tolist(), ends[mask].tolist()):
        if start > until:
            if until > at:
                pieces.append(text[at:until])
            at = start
        until = max(until, end)
    if until > at:
        pieces.append(text[at:until])
    return [unescaped(p) for p in pieces]


def encoder(path: str):
    """A public tokenizer with the control strings as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
    return tokenizer


SEGMENT = """conv_id bigint, segment int, n_turns bigint, text string, token_ids array<int>,
 token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"""


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.array([])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def formatted(
    conversations: DataFrame,
    tokenizer_path: str,
    trained=TRAINED_ROLES,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """(conv_id, segment, n_turns, text, token_ids, token_starts, token_ends, loss_mask), offsets in code points of the text.

    Rows are turns in the order of ``turn``; a missing turn number comes first, equal ones go by role, then text. A null role or
    text counts as empty, and rows without conv_id make one conversation. Rows that repeat are turns that repeat. A segment begins where the turns before it
    pass a multiple of ``segment_chars``; segments are numbered by these multiples, so the number of one that a longer turn skips is missing. A
    conversation shorter than that is segment 0. An empty table gives no rows. Other columns of the input are not read.

    The sum runs over cells of ``TURNS_OF_CELL`` turn numbers first and inside a cell then, so no task puts a whole conversation in order.
    """
    lean_batches()
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = _in_segments(turns, segment_chars)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(tokenizer_path)
        done: list[tuple] = []
        at = {"key": None, "turns": [], "held": 0}

        def close():
            if at["turns"]:
                text, spans = rendered(at["turns"], trained)
                code = tokenizer.encode(text, add_special_tokens=False)
                offsets = np.array(code.offsets, dtype=np.int32).reshape(-1, 2)
                mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
                ids = np.array(code.ids, dtype=np.int32)
                done.append((*at["key"], len(at["turns"]), text, ids, offsets, mask))
                at.update(turns=[], held=at["held"] + len(text))

        def handed_on():
            columns = list(zip(*done)) or [()] * 7
            arrays = [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.int32()),
                pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.string()),
                _lists(list(columns[4]), pa.int32()),
                _lists([o[:, 0] for o in columns[5]], pa.int32()),
                _lists([o[:, 1] for o in columns[5]], pa.int32()),
                _lists(list(columns[6]), pa.bool_()),
            ]
            done.clear()
            at["held"] = 0
            names = "conv_id segment n_turns text token_ids token_starts token_ends loss_mask".split()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for conv, segment, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, segment) != at["key"]:
                    close()
                    at["key"] = (conv, segment)
                at["turns"].append((role, text))
                if at["held"] > segment_chars:
                    yield handed_on()
        close()
        if done:
            yield handed_on()

    ordered = turns.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text")
    return ordered.select("conv_id", "segment", "role", "text").mapInArrow(render, SEGMENT)


def _in_segments(turns: DataFrame, segment_chars: int) -> DataFrame:
    """``turns`` with ``segment``: how many times ``segment_chars`` the turns before one have passed.

    A conversation that could not fill a segment is not put in order for it."""
    length = F.length("role") + F.length("text")
    sized = turns.withColumn("_cell", F.coalesce(F.floor(F.col("turn") / TURNS_OF_CELL), F.lit(-1)))
    cells = sized.groupBy("conv_id", "_cell").agg(F.sum(length).alias("_n"))
    in_order = Window.partitionBy("conv_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(in_order), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("conv_id")))
    long = cut_lineage(cells.where(F.col("_all") > segment_chars).select("conv_id", "_cell", "_before"))
    if long.isEmpty():
        return turns.withColumn("segment", F.lit(0))
    same = sized["conv_id"].eqNullSafe(long["conv_id"]) & (sized["_cell"] == long["_cell"])
    short = sized.join(long, same, "left_anti").drop("_cell").withColumn("segment", F.lit(0))
    placed = sized.join(long, same).select(*[sized[c] for c in sized.columns], "_before")
    inside = Window.partitionBy("conv_id", "_cell").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum(length).over(inside), F.lit(0))
    return short.unionByName(placed.withColumn("segment", F.floor(before / segment_chars).cast("int")).drop("_cell", "_before"))


READ_BACK = """conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,
 formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint"""


def read_back(segments: DataFrame) -> DataFrame:
    """What ``formatted`` wrote, read from its texts, token spans and masks: one row per conversation with digests of its turns and of
    the text under the mask. A digest runs over the segments of a conversation in order, so these meet in one task, one at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh(conv):
            return {
                "conv_id": conv, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(),
                "formatted_chars": 0, "n_tokens": 0, "n_loss_tokens": 0,
            }

        def row(x):
            return x | {"turns_sha256": x["turns"].hexdigest(), "loss_sha256": x["loss"].hexdigest()}

        schema = pa.schema(
            [(n, pa.string() if "sha" in n else pa.int64()) for n in [d.split()[0] for d in READ_BACK.split(",")]]
        )
        now = None
        for batch in batches:
            rows = []
            starts, ends, masks = (batch.column(k) for k in (2, 3, 4))
            for k, (conv, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if now is None or conv != now["conv_id"]:
                    if now is not None:
                        rows.append(row(now))
                    now = fresh(conv)
                for role, body in turns_of(text):
                    now["n_turns"] += 1
                    now["turns"].update(f"{role}\n{body}\n".encode())
                mask = masks[k].values.to_numpy(zero_copy_only=False)
                under = loss_text(text, starts[k].values.to_numpy(), ends[k].values.to_numpy(), mask)
                for piece in under:
                    now["loss_chars"] += len(piece)
                    now["loss"].update(piece.encode())
                now["formatted_chars"] += len(text)
                now["n_tokens"] += len(mask)
                now["n_loss_tokens"] += int(mask.sum())
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names} for r in rows], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{n: row(now)[n] for n in schema.names}], schema=schema)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.select("conv_id", "text", "token_starts", "token_ends", "loss_mask").mapInArrow(read, READ_BACK)

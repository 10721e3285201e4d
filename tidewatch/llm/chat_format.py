r"""Chat formatting by token-level assembly.

Each turn is a row. Its text is escaped and encoded by itself; reserved ids, which no text can produce, mark where it begins and ends; the places of its ids in the conversation are prefix sums of the segments' lengths; and the loss mask is the interval of each assistant text.

The template, with its control strings and reserved ids after the vocabulary's own:

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <s>text</s>
    any other  [ROLE]role[/ROLE]text</s>

Escaping breaks every control string inside a text by a backslash after its first character, and adds one to any that stand there already: <s> becomes <\s>, <\s> becomes <\\s>. Taking one away gives the text back.

Defined results: a null text counts as empty, a null role is the other role with an empty name, and so reads back as an empty name. Turns are put in order of turn (null first), then role, then text; repeated rows stay. Rows with a null conversation id form one conversation. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import vocabulary

# The control strings; their places here, after the vocabulary's ids, are their reserved ids.
CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]"]
FRAMES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}

_ESCAPE = re.compile("|".join(rf"({re.escape(c[0])}\\*)(?={re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"({re.escape(c[0])}\\*)\\(?={re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


def segments(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per turn: its columns conv_id, turn, role and text, ids (with the marks), n (of ids), and lead and trail, the marks before and after what the loss would cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        mark = {c: np.array([len(v.bytes_of) + k], dtype="<u4") for k, c in enumerate(CONTROLS)}
        for b in batches:
            ids, lead = [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                body = v.encode(escape(text))
                if role in FRAMES:
                    start, end = FRAMES[role]
                    head = mark[start]
                else:
                    head, end = np.concatenate((mark["[ROLE]"], v.encode(escape(role)), mark["[/ROLE]"])), "</s>"
                ids.append(np.concatenate((head, body, mark[end])).tobytes())
                lead.append(len(head))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary()), pa.array(lead, pa.int32())], [*b.schema.names, "ids", "lead"])

    kinds = dict(turns.dtypes)
    return turns.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids binary, lead int").withColumn("n", (F.length("ids") / 4).cast("int"))


def format_conversations(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """From rows conv_id, turn, role, text: one row per conversation with conv_id, ids (binaries in turn order, 32-bit little-endian) and loss, an array of (start, end) over its ids."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = segments(clean, path, pattern)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = rows.select("conv_id", F.row_number().over(order).alias("place"), before.alias("at"), "role", "ids", "lead", "n")
    masked = F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.col("lead")).alias("start"), (F.col("at") + F.col("n") - 1).alias("end")))
    one = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("s"), F.sort_array(F.collect_list(masked)).alias("loss"))
    return one.select("conv_id", F.col("s.ids").alias("ids"), "loss")


def pieces(ids: np.ndarray, own: int) -> list[tuple[str, str, np.ndarray, np.ndarray]]:
    """(closing mark, opening mark, ids of the name, ids of the text) of the turns, read from the marks alone."""
    at = np.flatnonzero(ids >= own)
    out, k = [], 0
    name = CONTROLS
    while k < len(at):
        opening = name[int(ids[at[k]]) - own]
        if opening == "[ROLE]":
            label, body, k = ids[at[k] + 1 : at[k + 1]], ids[at[k + 1] + 1 : at[k + 2]], k + 3
        else:
            label, body, k = ids[:0], ids[at[k] + 1 : at[k + 1]], k + 2
        out.append((name[int(ids[at[k - 1]]) - own], opening, label, body))
    return out


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_ids and n_loss_ids, all read from the ids and the mask."""
    role_of = {frame[0]: role for role, frame in FRAMES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        own = len(v.bytes_of)
        text_of = lambda ids: v.decode(ids).decode()
        for b in batches:
            rows = []
            for conv, parts, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(parts), dtype="<u4")
                turns = [(role_of.get(opening) or unescape(text_of(label)), unescape(text_of(body))) for _, opening, label, body in pieces(ids, own)]
                shown = sum(len(CONTROLS[int(i) - own]) for i in ids[ids >= own]) + len(text_of(ids[ids < own]))
                under = "".join(unescape(text_of(ids[m["start"] : m["end"]])) for m in loss)
                rows.append({
                    "conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), "loss_chars": len(under),
                    "loss_sha256": hashlib.sha256(under.encode()).hexdigest(), "formatted_chars": shown, "n_ids": len(ids), "n_loss_ids": sum(m["end"] - m["start"] for m in loss),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    kind = dict(formatted.dtypes)["conv_id"]
    schema = pa.schema([("conv_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_ids", pa.int64()), ("n_loss_ids", pa.int64())])
    return formatted.select("conv_id", "ids", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, n_loss_ids long")

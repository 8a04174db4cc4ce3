"""Chat formatting with loss masks that align with token offsets."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import releasing
from tidemark.llm.tokenizers_ import BYTE_BPE, fast_tokenizer, vocabulary_path

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings with a meaning to this template or to common ones; none stays whole inside a text.
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """A backslash is doubled; a control string gets one after its first character."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the span of each turn's escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role or '')}{TEXT}", escape(text or "")
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Inverse of render, up to null roles and texts, which come back empty."""
    return [(unescape(role), unescape(text)) for role, text in _PARSE.findall(formatted)]


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that overlap one of the sorted spans, found by binary search."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask = np.zeros(len(offsets), dtype=bool)
    for begin, end in spans:
        if begin < end:
            mask[bisect_right(ends, begin) : bisect_left(starts, end)] = True
    return mask


def format_conversations(turns: DataFrame, trained_role: str = "assistant", folder: str | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, ids, loss_mask, turn_spans``.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn,
    then role and text, so ties and repeated rows have one order and all are kept. A null role or
    text is empty; a null conv_id is a conversation of its own. The template's three control
    strings are tokens by themselves, so no token lies on both sides of a span's end.

    Rows of a conversation meet in one task, sorted by Spark (which spills); a task holds one
    conversation at a time, as it has to be encoded whole.
    """
    path = vocabulary_path(BYTE_BPE, folder)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def encode(done: list[tuple[int | None, list]]) -> pa.RecordBatch:
        tokenizer = fast_tokenizer(path, (TURN, TEXT, END))
        rendered = [render(own) for _, own in done]
        ids, masks, spans = [], [], []
        for (_, own), (formatted, at) in zip(done, rendered, strict=True):
            e = tokenizer.encode(formatted, add_special_tokens=False)
            ids.append(np.array(e.ids, dtype=np.int32))
            masks.append(loss_mask(e.offsets, [s for s, (role, _) in zip(at, own, strict=True) if role == trained_role]))
            spans.append(at)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in done], pa.int64()),
                pa.array([f for f, _ in rendered], pa.string()),
                pa.array(ids, pa.list_(pa.int32())),
                pa.array(masks, pa.list_(pa.bool_())),
                pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            ],
            ["conv_id", "formatted", "ids", "loss_mask", "turn_spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, own, current, begun, held = [], [], None, False, 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv != current:
                    done.append((current, own))
                    own = []
                    if held > 1 << 20:
                        yield encode(done)
                        done, held = [], 0
                current, begun = conv, True
                own.append((role, text))
                held += len(text or "")
        if begun:
            yield encode([*done, (current, own)])

    schema = "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>, turn_spans array<struct<begin:int,end:int>>"
    return rows.mapInArrow(releasing(run), schema)


def digests(formatted: DataFrame, folder: str | None = None) -> DataFrame:
    """What formatted conversations hold, read back from their strings, ids and masks alone."""
    path = vocabulary_path(BYTE_BPE, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = fast_tokenizer(path, (TURN, TEXT, END)).decode
        for batch in batches:
            out = []
            for conv, text, ids, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                turns = parse(text)
                under = np.asarray(ids.values)[np.asarray(mask.values.to_numpy(zero_copy_only=False), dtype=bool)].tolist()
                loss = unescape(decode(under, skip_special_tokens=False)) if under else ""
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, len(turns), _sha(whole), len(loss), _sha(loss), len(text)))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), r, strict=True)) for r in out],
                schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]),
            )

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "ids", "loss_mask").mapInArrow(releasing(run), schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

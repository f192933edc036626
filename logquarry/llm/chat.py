"""Chat formatting: conversations as one marked text each, with a mask over what the assistant says.

A turn becomes ``<|turn|>role\\ntext<|end|>\\n``.  Role and text are escaped, so that no control string of this or
another common template survives in them: a backslash is doubled, and one is put after the first character of
every control string and before a line feed of a role.  Dropping the backslash before any character undoes it.

Texts stay Arrow buffers throughout.  Segment lengths and their running sums give the place of every byte, and one
scatter fills one buffer for a whole batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import records

# The marks of the template, and the control strings of common templates that texts must not hold.
TURN, NEXT, END = "<|turn|>", "\n", "<|end|>\n"
CONTROL = (
    "<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<unk>", "<pad>",
)
ASSISTANT = "assistant"
# A conversation goes out in pieces of about this many bytes, so that one of any length fits into memory.
PIECE_BYTES = 8 << 20

_PIECES = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("piece", pa.int64()),
        ("n_turns", pa.int64()),
        ("formatted", pa.large_string()),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
PIECE_COLUMNS = (
    "conv_id bigint, piece bigint, n_turns bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"
)
_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
DIGEST_COLUMNS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint"
)


def _buffer(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each string starts, with the end behind."""
    strings = strings.cast(pa.large_string())
    if len(strings) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _inserts(data: np.ndarray, starts: np.ndarray, line_feeds: bool = False) -> np.ndarray:
    """Before which bytes a backslash goes; sorted."""
    found = [np.flatnonzero((data == 0x5C) | (data == 0x0A) if line_feeds else data == 0x5C)]
    ends = starts[1:]
    opening = np.flatnonzero((data == ord("<")) | (data == ord("[")))
    room = ends[np.searchsorted(ends, opening, "right")] - opening if len(opening) else opening
    for control in CONTROL:
        code = control.encode()
        at = opening[room >= len(code)]
        for k, byte in enumerate(code):
            at = at[data[at + k] == byte]
        found.append(at + 1)
    return np.sort(np.concatenate(found))


def _scatter(out: np.ndarray, data: np.ndarray, starts: np.ndarray, inserts: np.ndarray, to: np.ndarray) -> None:
    """Copies segments, with a backslash before the bytes ``inserts``, to the places ``to`` in ``out``."""
    before = np.searchsorted(inserts, starts[:-1])  # of the inserts, those in earlier segments
    shift = np.repeat(to - starts[:-1] - before, np.diff(starts))
    place = np.arange(len(data)) + shift
    if len(inserts):
        extra = np.zeros(len(data), np.int64)
        extra[inserts] = 1
        place += np.cumsum(extra)
        out[place[inserts] - 1] = 0x5C
    out[place] = data


def _escaped_sizes(starts: np.ndarray, inserts: np.ndarray) -> np.ndarray:
    return np.diff(starts) + np.diff(np.searchsorted(inserts, starts))


def assemble(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The turns of a batch, marked and escaped, in one buffer; where each turn starts, with the end behind; and
    where the text of each turn starts and ends."""
    roles, role_starts = _buffer(batch.column("role"))
    texts, text_starts = _buffer(batch.column("text"))
    role_marks, text_marks = _inserts(roles, role_starts, line_feeds=True), _inserts(texts, text_starts)
    role_sizes, text_sizes = _escaped_sizes(role_starts, role_marks), _escaped_sizes(text_starts, text_marks)
    turn, gap, end = (np.frombuffer(x.encode(), np.uint8) for x in (TURN, NEXT, END))
    sizes = len(turn) + role_sizes + len(gap) + text_sizes + len(end)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(starts[-1], np.uint8)
    role_at = starts[:-1] + len(turn)
    text_at = role_at + role_sizes + len(gap)
    for mark, at in ((turn, starts[:-1]), (gap, text_at - len(gap)), (end, text_at + text_sizes)):
        out[at[:, None] + np.arange(len(mark))] = mark
    _scatter(out, roles, role_starts, role_marks, role_at)
    _scatter(out, texts, text_starts, text_marks, text_at)
    return out, starts, text_at, text_at + text_sizes


def _format(batch: pa.RecordBatch, next_piece: dict) -> pa.RecordBatch:
    """One row per run of a conversation in the batch.  ``next_piece`` holds the last conversation so far and the
    number of its next piece."""
    out, starts, loss_from, loss_to = assemble(batch)
    ids = batch.column("conv_id")
    known = np.asarray(ids.is_valid())
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero((values[1:] != values[:-1]) | (known[1:] != known[:-1])) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [batch.num_rows]))
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))  # code points before each byte
    masked = np.asarray(batch.column("role").to_numpy(zero_copy_only=False) == ASSISTANT)
    of = np.repeat(starts[first], last - first)  # of each turn, the start of its run
    origin = points[of]
    spans = pa.StructArray.from_arrays(
        [pa.array((points[at] - origin)[masked]) for at in (loss_from, loss_to)], ["start", "end"]
    )
    span_starts = np.concatenate(([0], np.cumsum(masked)))[np.concatenate((first, [batch.num_rows]))]
    pieces = np.zeros(len(first), np.int64)
    convs = ids.take(pa.array(first))
    if next_piece.get("conv", ...) == convs[0].as_py():
        pieces[0] = next_piece["piece"]
    next_piece |= {"conv": convs[-1].as_py(), "piece": int(pieces[-1]) + 1}
    offsets = pa.py_buffer(np.concatenate((starts[first], starts[-1:])).astype(np.int64))
    formatted = pa.LargeStringArray.from_buffers(len(first), offsets, pa.py_buffer(out))
    return pa.RecordBatch.from_arrays(
        [
            convs, pa.array(pieces), pa.array((last - first).astype(np.int64)), formatted,
            pa.ListArray.from_arrays(pa.array(span_starts.astype(np.int32)), spans),
        ],
        schema=_PIECES,
    )


def _bounded(batches: Iterable[pa.RecordBatch], piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined at the limits of conversations where these allow about ``piece_bytes``."""
    held: list[pa.RecordBatch] = []

    def joined(rows: pa.Table) -> pa.RecordBatch:
        return rows.combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        size = rows.nbytes
        if size < piece_bytes:
            continue
        rows = joined(rows)
        ids = rows.column("conv_id").to_pylist()
        step = max(1, rows.num_rows * piece_bytes // size)
        start = 0
        while start < rows.num_rows:
            end = min(rows.num_rows, start + step)
            whole = end
            while whole > start and whole < len(ids) and ids[whole - 1] == ids[whole]:
                whole -= 1
            if end == rows.num_rows:
                while whole > start and ids[whole - 1] == ids[-1]:
                    whole -= 1  # the last conversation may go on in the next batch
                if whole == start and (rows.num_rows - start) < step:
                    break
            end = whole if whole > start else end
            yield rows.slice(start, end - start)
            start = end
        held = [rows.slice(start)] if start < rows.num_rows else []
    if held:
        yield joined(pa.Table.from_batches(held))


def format_conversations(turns: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as formatted text: conv_id, piece, n_turns, formatted, loss_spans.

    Turns go in the order of ``turn``; equal ones by role, then text, and repeated rows stay; a null turn comes
    first.  Null role or text counts as empty, any role but ``assistant`` is outside the mask, and null ids form one
    conversation.  Other columns are not read.

    Nearly every conversation is one piece.  Only one of more than ``piece_bytes`` is cut, between turns, and its
    pieces numbered from 0 add up to the whole; ``loss_spans`` count code points from the start of the piece.  A task
    holds one piece at a time.  The turns of a conversation are in one task, because its text is one sequence.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_piece: dict = {}
        for batch in _bounded(batches, piece_bytes):
            yield _format(batch, next_piece)

    return ordered.drop("turn").mapInArrow(work, PIECE_COLUMNS)


def unescape(text: str) -> str:
    """Undoes the escapes."""
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\", "") for p in parts)


_TURN = re.compile(r"((?:\\.|[^\\\n])*)\n(.*)", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, as role and text."""
    if not formatted:
        return []
    if not (formatted.startswith(TURN) and formatted.endswith(END)):
        raise ValueError("not a formatted conversation")
    found = []
    for turn in formatted[len(TURN) : -len(END)].split(END + TURN):
        role, text = _TURN.fullmatch(turn).groups()
        found.append((unescape(role), unescape(text)))
    return found


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, taken from formatted text and mask alone: conv_id, n_turns, turns_sha256 (role, line
    feed, text, line feed per turn), loss_chars, loss_sha256 (the masked text, unescaped), formatted_chars.

    Expects the pieces of a conversation behind one another in one task, as ``format_conversations`` returns them.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, piece, _, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if piece == 0:
                    if state:
                        done.append(_row(state))
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                for role, said in parse(text):
                    state["turns"].update(f"{role}\n{said}\n".encode())
                    state["n"] += 1
                for span in spans:
                    said = unescape(text[span["start"] : span["end"]])
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
                state["all"] += len(text)
            yield records(done, _DIGESTS)
        if state:
            yield records([_row(state)], _DIGESTS)

    return formatted.select("conv_id", "piece", "n_turns", "formatted", "loss_spans").mapInArrow(work, DIGEST_COLUMNS)


def _row(s: dict) -> tuple:
    return s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"]

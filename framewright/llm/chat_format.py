"""Chat formatting by columnar byte assembly.

The turns of whole conversations come as columns.  Segment lengths, cumulative offsets and scatter indices are computed in
numpy, and headers and contents are copied into one preallocated buffer that becomes the Arrow column.  No turn is
formatted as a Python string.

Template: each turn is ``<|turn|>role\\ntext<|end|>\\n``.  A control string inside a text gets a backslash after its first
character; a text that already has ``<\\|end|>`` gets one more, so taking one away everywhere gives the text back.

Defined results: null text and null role are empty; rows are in order of turn (nulls first), then role, then text, so ties
and repeated rows keep one order and all stay; rows with a null conversation id form one conversation; an empty table
gives an empty table; further columns are not looked at; a very long text is copied whole.  A conversation is a row of the
result, so it must fit the memory of a task; one of 2 GB or more raises.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Escaped inside texts: the template's own strings, and those of common templates, so that no tokenizer sees them there.
CONTROL = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
#: Bytes of texts in one buffer, unless a conversation has more.
PART = 1 << 28
_REST = "|".join(re.escape(x[1:]) for x in CONTROL)
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_REST})")
_SCHEMA = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def escaped(texts: pa.Array) -> pa.Array:
    """One backslash more in each control string; texts without one stay as they are."""
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2\3")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role(texts: pa.Array) -> pa.Array:
    """Roles have no line feed of their own, as it ends the header."""
    return pc.replace_substring(pc.replace_substring(escaped(texts), "\\", "\\\\"), "\n", "\\n")


def _role_back(text: str) -> str:
    return unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text))


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a binary or string column without nulls."""
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def assemble(columns: list[tuple[np.ndarray, np.ndarray]], lengths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the segments of all columns one after another in one buffer; and where each segment begins.

    ``columns``: data and start of each row's segment; ``lengths``: the segments' lengths.
    """
    n, k = len(lengths[0]), len(columns)
    size = np.empty((n, k), np.int64)
    for j, x in enumerate(lengths):
        size[:, j] = x
    ends = np.cumsum(size.ravel())
    begin = (ends - size.ravel()).reshape(n, k)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for j, (data, start) in enumerate(columns):
        m = size[:, j]
        inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(begin[:, j], m) + inside] = data[np.repeat(start, m) + inside]
    return out, begin


def _starts(conv: pa.Array) -> np.ndarray:
    """Whether a row's conversation is another than that of the row before."""
    n = len(conv)
    new = np.ones(n, bool)
    if n > 1:
        a, b = conv.slice(0, n - 1), conv.slice(1)
        same = pc.or_kleene(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] = ~np.asarray(same.to_numpy(zero_copy_only=False), bool)
    return new


def format_rows(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """The conversations of rows that are sorted by conversation and turn."""
    n, new = len(conv), _starts(conv)
    first = np.flatnonzero(new)
    role, text = pc.fill_null(role, ""), pc.fill_null(text, "")
    is_loss = np.asarray(pc.equal(role, "assistant").to_numpy(zero_copy_only=False), bool)
    role, text = _role(role), escaped(text)
    parts = [TURN.encode(), b"\n", f"{END}\n".encode()]
    fixed = [np.frombuffer(p, np.uint8) for p in parts]
    zero = np.zeros(n, np.int64)
    (rd, ro), (td, to) = _bytes(role), _bytes(text)
    columns = [(fixed[0], zero), (rd, ro[:-1]), (fixed[1], zero), (td, to[:-1]), (fixed[2], zero)]
    lengths = [zero + len(parts[0]), np.diff(ro), zero + 1, np.diff(to), zero + len(parts[2])]
    out, begin = assemble(columns, lengths)
    # code points before each byte, from the bytes that continue none
    points = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    edge = np.append(begin[first, 0], len(out))
    owner = np.cumsum(new) - 1
    start = points[begin[:, 3]] - points[edge[owner]]
    end = points[begin[:, 3] + np.diff(to)] - points[edge[owner]]
    counts = np.bincount(owner[is_loss], minlength=len(first)) if n else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(start[is_loss]), pa.array(end[is_loss])], names=["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
    if np.diff(edge).max(initial=0) >= 1 << 31:
        raise ValueError("a conversation has 2 GB or more: no column of strings can hold it")
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(out)).cast(pa.string())
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(np.diff(np.append(first, n)), pa.int64()), formatted, loss], names=["conv_id", "n_turns", "formatted", "loss"])


def chat_format(turns: DataFrame, most: int = PART) -> DataFrame:
    """``conv_id, n_turns, formatted, loss`` of the conversations in ``turns(conv_id, turn, role, text)``.

    ``loss`` has the code-point spans of the assistant texts inside ``formatted``.  Rows are dealt by conversation and
    sorted on disk; a task holds the conversations of one batch and the one that continues into the next.  ``most`` bytes of
    conversations are formatted at once, or one that has more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # parts of the conversation that may go on; joined once, when it ends
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, last = batch.column("conv_id"), batch.column("conv_id")[-1]
            other = pc.is_valid(ids) if not last.is_valid else pc.fill_null(pc.not_equal(ids, last), True)
            at = np.flatnonzero(np.asarray(other.to_numpy(zero_copy_only=False), bool))
            cut = int(at[-1]) + 1 if len(at) else 0
            if cut or (held and held[0].column("conv_id")[-1].as_py() != last.as_py()):
                yield from out([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from out(held)

    def out(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        conv, role, text = (rows[c].combine_chunks() for c in ("conv_id", "role", "text"))
        # as many conversations at once as keep a column below its limit of 2 GB
        size = np.cumsum(np.asarray(pc.add(pc.binary_length(role), pc.binary_length(text)).to_numpy(zero_copy_only=False), np.int64))
        first = np.flatnonzero(_starts(conv))
        group = np.concatenate([[0], size])[first] // most
        cuts = [*first[np.flatnonzero(np.diff(group, prepend=-1))].tolist(), len(conv)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield format_rows(conv.slice(a, b - a), role.slice(a, b - a), text.slice(a, b - a))

    cols = turns.select(F.col("conv_id").cast("long"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, _SCHEMA)


def read_back(formatted: str, loss: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns (role, text) and the texts under the loss mask, from the output alone."""
    turns, at = [], 0
    while at < len(formatted):
        head = formatted.index("\n", at)
        end = formatted.index(f"{END}\n", head)
        turns.append((_role_back(formatted[at + len(TURN) : head]), unescaped(formatted[head + 1 : end])))
        at = end + len(END) + 1
    return turns, [unescaped(formatted[a:b]) for a, b in loss]


def digests(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from ``formatted`` and ``loss``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c in batch.to_pylist():
                turns, under = read_back(c["formatted"], [(s["start"], s["end"]) for s in c["loss"]])
                every, masked = hashlib.sha256(), "".join(under)
                for role, text in turns:
                    every.update(f"{role}\n{text}\n".encode())
                rows.append({"conv_id": c["conv_id"], "n_turns": len(turns), "turns_sha256": every.hexdigest(), "loss_chars": len(masked), "loss_sha256": hashlib.sha256(masked.encode()).hexdigest(), "formatted_chars": len(c["formatted"])})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Operator 8: chat formatting by columnar byte assembly.

Turns are ordered within their conversation. For a whole Arrow batch the lengths of all
segments (markers, roles, texts) are computed, summed to offsets, and their bytes copied
by scatter indices into one preallocated buffer that becomes the Arrow column. Texts are
escaped so that ``<|`` stands in no text: between ``<``, any backslashes and ``|`` one
backslash more is put, and reading takes one away. Roles also escape backslash and line end.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import as_binary, mapped

START, END = b"<|im_start|>", b"<|im_end|>\n"
ASSISTANT = b"assistant"
#: Turns are assembled in slices of about so many bytes; a text longer than COPIED_BYTES is copied without scatter indices.
ASSEMBLE_BYTES, COPIED_BYTES = 4 << 20, 1 << 16


def escape_texts(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def escape_roles(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n")
    return escape_texts(column)


def unescape_text(text: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", text) if b"<\\" in text else text


def unescape_role(role: bytes) -> bytes:
    role = unescape_text(role)
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], role) if b"\\" in role else role


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths)."""
    array = as_binary(column)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs[:-1], np.diff(offs)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, offsets of turns, starts and lengths of texts in the buffer) of already escaped columns."""
    n = len(roles)
    fixed = np.frombuffer(START + b"\n" + END, np.uint8)
    role_bytes, role_at, role_len = _parts(roles)
    text_bytes, text_at, text_len = _parts(texts)
    pieces = [  # source, start in it, length
        (fixed, np.zeros(n, np.int64), np.full(n, len(START))),
        (role_bytes, role_at, role_len),
        (fixed, np.full(n, len(START)), np.ones(n, np.int64)),
        (text_bytes, text_at, text_len),
        (fixed, np.full(n, len(START) + 1), np.full(n, len(END))),
    ]
    lengths = np.stack([length for *_, length in pieces], 1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (source, at, length) in enumerate(pieces):
        for i in np.flatnonzero(length > COPIED_BYTES):  # a long text is copied as one run, without an index for each byte
            out[starts[i, k] : starts[i, k] + length[i]] = source[at[i] : at[i] + length[i]]
        length = np.where(length > COPIED_BYTES, 0, length)
        run = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(starts[:, k], length) + run] = source[np.repeat(at, length) + run]
    return out, np.concatenate([[0], ends[:, -1]]) if n else np.zeros(1, np.int64), starts[:, 3], text_len


SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.large_binary()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
FIELDS = "conv_id long, part long, formatted binary, loss_starts array<long>, loss_ends array<long>"


def _format(batches):
    last, part = object(), 0
    for whole in batches:
        sizes = pc.add(pc.binary_length(whole.column("text")), 64).to_numpy(zero_copy_only=False)
        steps = np.cumsum(sizes) // ASSEMBLE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), whole.num_rows] if whole.num_rows else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            batch = whole.slice(lo, hi - lo)
            roles, texts = escape_roles(batch.column("role")), escape_texts(batch.column("text"))
            buffer, turn, text_at, text_len = assemble(roles, texts)
            ids = batch.column("conv_id").to_pylist()
            begin = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
            rows, parts = [], []
            for i in begin[:-1]:
                part = part + 1 if ids[i] == last else 0
                last = ids[i]
                rows.append(ids[i])
                parts.append(part)
            bounds = turn[begin]
            under_loss = np.flatnonzero(pc.equal(batch.column("role"), "assistant").to_numpy(zero_copy_only=False))
            of = np.searchsorted(np.array(begin), under_loss, "right") - 1
            starts = text_at[under_loss] - bounds[of]
            counts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(rows)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(counts), pa.array(x.astype(np.int64))) for x in (starts, starts + text_len[under_loss])]
            formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(buffer)])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(parts, pa.int64()), formatted, *lists], schema=SCHEMA)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Return (conv_id, part, formatted, loss_starts, loss_ends) of rows (conv_id, turn, role, text).

    Turns follow by turn (null last), ties by role, then text; null roles and texts are
    empty, null conv_ids one conversation. A conversation's output is its parts in order,
    each within one slice of turns, so one of any length is streamed turn by turn (a turn is
    one row and held whole); parts of one conversation stand together in one partition. The loss mask has the byte ranges of
    the texts of role ``assistant``. An empty table gives no row; extra columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return mapped(rows.select("conv_id", "role", "text"), _format, FIELDS)


def parse_turns(formatted: bytes):
    """(role, text) of every turn of a formatted part, one after another."""
    at = 0
    while at < len(formatted):
        role_end, end = formatted.find(b"\n", at), formatted.find(END, at)
        if not formatted.startswith(START, at) or not 0 <= role_end < end:
            raise ValueError("a turn is not closed")
        yield unescape_role(formatted[at + len(START) : role_end]), unescape_text(formatted[role_end + 1 : end])
        at = end + len(END)


def code_points(text: bytes) -> int:
    """Characters of UTF-8 bytes."""
    data = np.frombuffer(text, np.uint8)
    return sum(int(((data[lo : lo + ASSEMBLE_BYTES] & 0xC0) != 0x80).sum()) for lo in range(0, len(data), ASSEMBLE_BYTES))


def _digests(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def closed(state):
        turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
        return [state["conv_id"], state["n"], turns, state["loss_chars"], loss, state["chars"]]

    state, done = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            conv_id, part = batch.column("conv_id")[i].as_py(), batch.column("part")[i].as_py()
            if part == 0:
                if state:
                    done.append(closed(state))
                state = {"conv_id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            formatted = batch.column("formatted")[i].as_buffer().to_pybytes()
            state["chars"] += code_points(formatted)
            for role, text in parse_turns(formatted):
                state["n"] += 1
                state["turns"].update(role + b"\n" + text + b"\n")
            for a, b in zip(batch.column("loss_starts")[i].as_py(), batch.column("loss_ends")[i].as_py(), strict=True):
                text = unescape_text(formatted[a:b])
                state["loss"].update(text)
                state["loss_chars"] += code_points(text)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], schema=schema)
            done = []
    if state:
        done.append(closed(state))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], schema=schema)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output of ``format_conversations`` (its rows in their order), one row a conversation; no rows give none."""
    return mapped(formatted, _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

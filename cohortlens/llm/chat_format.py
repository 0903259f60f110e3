r"""op10: chat formatting by columnar byte assembly.

Turns are dealt by range of (conversation, turn), so that one conversation may
span many tasks.  For every Arrow batch NumPy computes the lengths of headers,
escaped texts and footers, their cumulative offsets, and the places where each
byte goes; everything is copied into one buffer that becomes the Arrow column.

Template of a turn: ``### Role: text</turn>`` and a newline.  Inside role and
text a backslash stands before every backslash and before the first character
of the control strings ``###`` and ``</turn>`` (in roles also before colons),
so that the formatted text parses back without loss.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.hashing import text_bytes

HEAD, MID, END = b"### ", b": ", b" </turn>\n"
#: Roles with a printed form of their own; other roles are printed escaped after "=".
ROLES = {"system": b"System", "user": b"User", "assistant": b"Assistant"}
LOSS_ROLE = "assistant"
PARTS = "conv_id long, part_task int, part_no long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"


def _starts_of(data: np.ndarray, row_end: np.ndarray, offsets: np.ndarray, what: bytes) -> np.ndarray:
    """Places where ``what`` occurs inside one row."""
    n = len(data) - len(what) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:n] == what[0])
    for k in range(1, len(what)):
        at = at[data[at + k] == what[k]]
    row = np.searchsorted(offsets, at, "right") - 1
    return at[at + len(what) <= row_end[row]]


def _printed(role: str) -> bytes:
    return ROLES.get(role) or b"=" + re.sub(rb"([\\:#<])", rb"\\\1", role.encode())


def assemble(texts: pa.Array, roles: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all rows (roles without nulls), the rows' n + 1 offsets, and start and end of each row's content."""
    data, offsets = text_bytes(texts)
    starts, ends = offsets[:-1], offsets[1:]
    marks = np.concatenate([np.flatnonzero(data == 92), _starts_of(data, ends, offsets, b"###"), _starts_of(data, ends, offsets, b"</turn>")])
    marks.sort()
    names = roles.dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = [np.frombuffer(HEAD + _printed(role) + MID, np.uint8) for role in names.dictionary.to_pylist()]
    head_len = np.array([len(h) for h in kinds], np.int64)[codes] if kinds else np.zeros(0, np.int64)
    n_marks = np.searchsorted(marks, ends) - np.searchsorted(marks, starts)
    content = ends - starts + n_marks
    out_offsets = np.concatenate([[0], np.cumsum(head_len + content + len(END))])
    first, last = out_offsets[:-1] + head_len, out_offsets[:-1] + head_len + content
    out = np.empty(out_offsets[-1], np.uint8)
    # content: every byte moves by its row's shift and by the escapes up to it
    shift = np.repeat(first - starts - np.searchsorted(marks, starts), ends - starts)
    escapes = np.zeros(len(data) + 1, np.int64)
    escapes[marks] = 1
    place = np.arange(len(data)) + shift + np.cumsum(escapes[:-1])
    out[place] = data
    out[place[marks] - 1] = 92
    for k, head in enumerate(kinds):
        rows = np.flatnonzero(codes == k)
        out[(out_offsets[rows][:, None] + np.arange(len(head))).ravel()] = np.tile(head, len(rows))
    end = np.frombuffer(END, np.uint8)
    out[(last[:, None] + np.arange(len(end))).ravel()] = np.tile(end, len(last))
    return out, out_offsets, first, last


def _format_batches(batches):
    from pyspark import TaskContext
    task, no = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        out, offsets, first, last = assemble(batch.column("text"), batch.column("role"))
        conv = batch.column("conv_id")
        key = conv.fill_null(0).to_numpy(zero_copy_only=False)
        null = conv.is_null().to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))
        bounds = np.concatenate([new, [batch.num_rows]])
        # code points before each byte: loss spans count characters
        points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        loss = np.flatnonzero(np.array([r == LOSS_ROLE for r in batch.column("role").to_pylist()]))
        part = np.searchsorted(new, loss, "right") - 1
        base = points[offsets[new]]
        lists = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(new)))]).astype(np.int32)
        text = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(offsets[bounds].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([
            conv.take(pa.array(new)), pa.array(np.full(len(new), task, np.int32)), pa.array(no + np.arange(len(new))),
            pa.array(np.diff(bounds)), text,
            pa.ListArray.from_arrays(lists, pa.array(points[first[loss]] - base[part])),
            pa.ListArray.from_arrays(lists, pa.array(points[last[loss]] - base[part]))],
            ["conv_id", "part_task", "part_no", "n_turns", "formatted", "loss_starts", "loss_ends"])
        no += len(new)


def format_chat(conversations: DataFrame) -> DataFrame:
    """Formatted parts of all conversations.

    Expects conv_id, turn, role, text.  Returns conv_id, part_task, part_no
    (parts of a conversation, in this order, make up its text), n_turns,
    formatted, loss_starts, loss_ends (character ranges of the assistant texts
    in the part).  Rows go by turn; ties by role, then by a hash of the text; a null turn comes
    first; a null text is empty, a null role is an empty role without loss; a
    null conv_id is a conversation of its own; repeated rows are repeated
    turns; other columns are not read.  A conversation of any length is cut
    into parts of one Arrow batch at most, so none is held whole.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    # a hash of the text deals equal turns of one conversation to several tasks
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions(
        "conv_id", "turn", "role", F.xxhash64("text"), "text")
    return rows.select(*order).mapInArrow(_format_batches, PARTS)


_TURN = re.compile(rb"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)
_ESCAPE = re.compile(rb"\\(.)", re.S)
_BY_NAME = {v: k for k, v in ROLES.items()}


def _plain(escaped: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1", escaped) if b"\\" in escaped else escaped


def parse_chat(formatted: bytes) -> list[tuple[str, bytes]]:
    """(role, text) of every turn of a formatted text; raises if it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at byte {at}")
        name = m[1]
        turns.append((_BY_NAME[name] if name in _BY_NAME else _plain(name[1:]).decode(), _plain(m[2])))
        at = m.end()
    return turns


def _digest_batches(batches):
    """Streams sorted parts; one conversation's hashes are open at a time."""
    open_, key = None, None

    def closed():
        n, turns, loss_chars, loss, chars = open_
        return key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def table(rows):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        done = []
        for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
            if open_ is None or conv != key:
                if open_ is not None:
                    done.append(closed())
                key, open_ = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse_chat(text.encode())
            open_[0] += len(turns)
            open_[4] += len(text)
            for role, content in turns:
                for x in (role.encode(), b"\n", content, b"\n"):
                    open_[1].update(x)
            for a, b in zip(starts, ends):
                content = _plain(text[a:b].encode())
                open_[2] += len(content.decode())
                open_[3].update(content)
        if done:
            yield table(done)
    if open_ is not None:
        yield table([closed()])


def read_back(parts: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted parts alone.

    A digest over a whole conversation is sequential, so a conversation's
    parts stream through one task, one part in memory at a time.
    """
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part_task", "part_no")
    return rows.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(
        _digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

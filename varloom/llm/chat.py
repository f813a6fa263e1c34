"""Chat formatting by columnar byte assembly.

The pieces of a batch of conversations (headers, escaped texts, footers) are measured first;
cumulative lengths give every piece its place, and the bytes are scattered into one buffer that
becomes the Arrow column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.words import groups, texts

# The template. Every control string starts with < or [ and holds no backslash.
USER, ASSISTANT, SYSTEM = ("<s>[INST] ", " [/INST]"), (" ", "</s>"), ("<<SYS>> ", " <</SYS>>")
#: Other roles carry their name.
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
CONTROLS = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", *OTHER)
MARKS = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}
LOSS_ROLE = "assistant"
#: A batch of whole conversations is assembled when it holds so many bytes of text.
ASSEMBLE = 1 << 22

_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))


def escape(column: pa.Array) -> pa.Array:
    """Double each backslash, and put one behind the first character of each control string."""
    column = pc.replace_substring(column, "\\", "\\\\")
    return pc.replace_substring_regex(column, f"([<\\[])({_TAILS})", r"\1\\\2")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _scatter(out: np.ndarray, places: np.ndarray, column: pa.Array) -> None:
    """Copy row k of the column to out[places[k]:]."""
    data, at = texts(column)
    for lo, hi in groups(at, 1 << 20):
        size = np.diff(at[lo : hi + 1])
        part = data[at[lo] : at[hi]]
        if hi - lo == 1:
            out[places[lo] : places[lo] + len(part)] = part
        else:
            out[np.repeat(places[lo:hi] - (at[lo:hi] - at[lo]), size) + np.arange(len(part))] = part


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Rows of whole conversations, in order, to one row each."""
    conv_ids = conv.to_numpy()
    first = np.flatnonzero(np.r_[True, conv_ids[1:] != conv_ids[:-1]])
    role, body = role.fill_null(""), escape(text.fill_null(""))
    kinds = role.dictionary_encode()
    names = kinds.dictionary
    named = escape(names).to_pylist()
    head = [MARKS[n][0] if n in MARKS else OTHER[0] + e + OTHER[1] for n, e in zip(names.to_pylist(), named)]
    foot = [MARKS[n][1] if n in MARKS else OTHER[2] for n in names.to_pylist()]
    pieces = [pa.array(head, pa.string()).take(kinds.indices), body, pa.array(foot, pa.string()).take(kinds.indices)]
    size = np.stack([pc.binary_length(p).to_numpy() for p in pieces], axis=1).astype(np.int64)
    chars = np.stack([pc.utf8_length(p).to_numpy() for p in pieces], axis=1).astype(np.int64)
    place = np.cumsum(np.r_[0, size.ravel()])
    out = np.empty(place[-1], np.uint8)
    for k, p in enumerate(pieces):
        _scatter(out, place[k:-1:3], p)
    bounds = np.r_[place[:-1:3][first], place[-1]]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))
    # loss spans in characters, from the start of their conversation
    upto = np.cumsum(np.r_[0, chars.ravel()])
    own = np.searchsorted(first, np.arange(len(conv_ids)), "right") - 1
    begin = upto[:-1:3] + chars[:, 0] - upto[:-1:3][first][own]
    loss = np.flatnonzero(np.asarray(pc.equal(role, LOSS_ROLE)))
    spans = pa.StructArray.from_arrays([pa.array(begin[loss]), pa.array(begin[loss] + chars[loss, 1])], ["start", "end"])
    cuts = np.searchsorted(loss, np.r_[first, len(conv_ids)]).astype(np.int32)
    turns = np.diff(np.r_[first, len(conv_ids)])
    return pa.RecordBatch.from_arrays(
        [pa.array(conv_ids[first]), pa.array(turns), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(cuts), spans)],
        ["conv", "n_turns", "formatted", "loss"],
    )


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by conversation; a conversation may span batches."""
    held, size = [], 0

    def ready(last: bool):
        nonlocal held, size
        table = pa.Table.from_batches(held).combine_chunks()
        conv = table["conv"].to_numpy()
        done = len(conv) if last else int(np.searchsorted(conv == conv[-1], True))
        if done:
            yield assemble(*(table[c].slice(0, done).combine_chunks() for c in ("conv", "role", "text")))
        held = table.slice(done).to_batches()
        size = sum(b.nbytes for b in held)

    limit = ASSEMBLE
    for b in batches:
        for piece in (b.slice(k, 2000) for k in range(0, b.num_rows, 2000)):
            held.append(piece)
            size += piece.nbytes
            if size > limit:
                yield from ready(False)
                limit = ASSEMBLE + 2 * size  # a long conversation is not copied again for each piece
    if held:
        yield from ready(True)


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv, n_turns, formatted, loss): one row per conversation.

    Turns are in order of their number (nulls first; ties by role, then text), marked by the
    template, with control strings inside texts and role names escaped. `loss` lists the spans of
    assistant texts in characters of `formatted`. A null text or role is empty. Rows without a
    conversation id belong to no conversation and are left out. Extra columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    ).filter("conv is not null")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return rows.mapInArrow(_format, "conv long, n_turns long, formatted string, loss array<struct<start: long, end: long>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    at, out = 0, []
    while at < len(formatted):
        for role, (head, foot) in (("user", USER), ("system", SYSTEM), (None, (OTHER[0], OTHER[2])), ("assistant", ASSISTANT)):
            if formatted.startswith(head, at):
                break
        else:
            raise ValueError(f"no turn starts at {at}")
        begin = at + len(head)
        if role is None:
            end = formatted.index(OTHER[1], begin)
            role, begin = unescape(formatted[begin:end]), end + len(OTHER[1])
        end = formatted.index(foot, begin)
        out.append((role, unescape(formatted[begin:end])))
        at = end + len(foot)
    return out

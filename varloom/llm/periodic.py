"""Runs of repeating words by string synchronising sets.

At scale t = 1, 2, 4, ... a position belongs to the set if the smallest hash of the t + 1 windows of
t words that start there or up to t words later is that of the first or the last of them. This
depends on the 2t words from the position only, so equal contexts are chosen alike; and every t
positions in a row hold a chosen one, unless all their windows have a period of at most t / 4.
A run of period p, t <= p < 2t, with at least 4p words so holds two chosen positions p apart with
equal contexts, and no chosen one of that context between them: neighbours of equal context
propose periods, and each proposal is extended over the words themselves. Windows of a period of
at most t / 4 lie in runs that the smaller scales have found; their positions are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.words import groups, mix, texts

#: A run has at least so many periods, and at least so many words.
POWER, SHORTEST = 4, 6
_NONE = np.uint64((1 << 64) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every `size` neighbouring values."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many values at the start of both are equal."""
    at, width, n = 0, 64, len(a)
    while at < n:
        differ = a[at : at + width] != b[at : at + width]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at += width
        width *= 2
    return n


def _proposals(h: np.ndarray, context: np.ndarray, room: np.ndarray, skip: np.ndarray, t: int) -> Iterator[tuple[int, int]]:
    """(start, period) of stretches whose words repeat after t to 2t - 1 words; one for each chain."""
    ids = np.where(skip, _NONE, h)
    low = window_min(ids, t + 1)
    m = len(low)
    chosen = (low != _NONE) & ((low == ids[:m]) | (low == ids[t : t + m])) & (room[:m] >= 2 * t)
    at = np.flatnonzero(chosen)
    key = context[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    gap = at[1:] - at[:-1]
    hit = np.flatnonzero((key[1:] == key[:-1]) & (gap >= t) & (gap < 2 * t))
    start, period = at[hit], gap[hit]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    first = np.r_[True, (period[1:] != period[:-1]) | (start[1:] > start[:-1] + 2 * t)][: len(start)]
    return zip(start[first].tolist(), period[first].tolist())


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per document its runs (start, length, period), sorted by start and period.

    `codes` holds the word numbers of all documents one after the other, `sizes` their lengths.
    A run has its smallest period p, at least POWER * p words, and can't be extended.
    """
    runs: list[set[tuple[int, int, int]]] = [set() for _ in sizes]
    live = np.arange(len(sizes))
    sizes = np.asarray(sizes, np.int64)
    h = mix(codes.astype(np.uint64) * _STEP + np.uint64(1))
    t = 1
    while True:
        stay = sizes >= POWER * t
        if not stay.all():
            rows = np.repeat(stay, sizes)
            codes, h, live, sizes = codes[rows], h[rows], live[stay], sizes[stay]
        if not len(live):
            break
        ends = np.cumsum(sizes)
        begins = ends - sizes
        room = np.repeat(ends, sizes) - np.arange(len(codes))
        edge = np.zeros(len(codes) + 1, np.int32)
        for k, d in enumerate(live.tolist()):
            for s, n, p in runs[d]:
                if POWER * p <= t <= n:
                    edge[begins[k] + s] += 1
                    edge[begins[k] + s + n - t + 1] -= 1
        skip = np.cumsum(edge[:-1]) > 0
        context = h.copy()  # hash of 2t words; the last t places are never asked for
        context[:-t] = mix(h[:-t] * _STEP + h[t:])
        for at, p in _proposals(h, context, room, skip, t):
            k = int(np.searchsorted(ends, at, "right"))
            lo, hi = int(begins[k]), int(ends[k])
            stop = at + p + _agree(codes[at : hi - p], codes[at + p : hi])
            start = at - _agree(codes[lo:at][::-1], codes[lo + p : at + p][::-1])
            if stop - start >= POWER * p:
                runs[live[k]].add((start - lo, stop - start, p))
        h = context
        t *= 2
    return [sorted(((s, n, p) for s, n, p in r if n >= SHORTEST), key=lambda x: (x[0], x[2])) for r in runs]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if every run is cut to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _scan(digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts(b.column(1))
            valid = np.asarray(b.column(1).is_valid())
            for lo, hi in groups(offsets):
                parts = [data[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(lo, hi)]
                sizes = np.array([len(p) for p in parts])
                codes = pa.array([w for p in parts for w in p], pa.large_binary()).dictionary_encode().indices.to_numpy()
                found = find_runs(codes, sizes)
                value = []
                for k, (words, runs) in enumerate(zip(parts, found), lo):
                    if runs:
                        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                    if digest:
                        value.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    else:
                        value.append((b" ".join(words) if runs else data[offsets[k] : offsets[k + 1]].tobytes()) if valid[k] else None)
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
                at = np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), rows),
                        pa.array(value) if digest else pa.array(value, pa.binary()).cast(pa.string()), *part.columns[2:],
                    ],
                    ["doc", "n_words", "runs", "value", *b.schema.names[2:]],
                )

    return run


def collapse(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), digest: bool = False,
) -> DataFrame:
    """(doc, n_words, runs, value, *keep) for every row of `docs`.

    `runs` is an array of (start, length, period), sorted by start and period: the stretches of
    words with smallest period p and at least max(SHORTEST, POWER * p) words that no neighbour
    extends. `value` is the text with every run cut to its first period, its words joined by one
    space (a text without runs stays as it is), or with `digest` the SHA-256 of the kept words
    joined by one space. Every row is judged by itself, without a shuffle: repeated rows get equal
    results and a null id stays null. A null text has no words, no runs and stays null; an empty one
    has none either. A text of any length is one piece of work, in memory in proportion to it, and
    is handled in n log^2 n steps. Columns in `keep` pass through, whatever their names; no rows give none.
    """
    extra = {c: f"_keep{k}" for k, c in enumerate(keep)}
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"),
        *[F.col(f"`{c}`").alias(n) for c, n in extra.items()],
    )
    kinds = dict(rows.dtypes)
    schema = ", ".join(
        [
            f"doc {kinds['doc']}, n_words long, runs array<struct<start:long,length:long,period:long>>, value string",
            *[f"{n} {kinds[n]}" for n in extra.values()],
        ]
    )
    out = rows.mapInArrow(_scan(digest), schema)
    return out.select("doc", "n_words", "runs", "value", *[F.col(n).alias(c) for c, n in extra.items()])

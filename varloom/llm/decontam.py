"""Benchmark passages in documents, by counting shared q-grams in diagonal bands.

A region that equals a pattern of m characters but for k edits shares at least m - q + 1 - k*q of
its q-grams, on diagonals (text position less pattern position) at most k apart. Shared q-grams
are counted in overlapping diagonal bands; bands that reach the bound are aligned.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
#: A pattern is a stretch of so many characters of an item, or a shorter item as a whole. Any
#: excerpt of PATTERN + STRIDE - 1 characters, wherever it starts, holds a whole pattern.
PATTERN, STRIDE = 40, 10
EDIT_RATE = 0.08
#: Items of fewer characters match nothing; those under 2 * Q are counted by shorter grams.
SHORTEST, SHORT_Q = 12, 6
#: Diagonals per band, besides the overlap.
BAND = 16
#: Characters of patterns that one pass over the documents carries to every task.
PASS_CHARS = 1 << 20
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_GAP = "\0" * (math.floor(EDIT_RATE * PATTERN) + 4)
_TABLE_BITS = 22


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space, no zero characters."""
    return " ".join(text.lower().replace("\0", " ").split())


def patterns(text: str) -> list[str]:
    """Overlapping stretches of an item; the last one ends with it."""
    t = normalise(text)
    if len(t) <= PATTERN:
        return [t] if len(t) >= SHORTEST else []
    starts = [*range(0, len(t) - PATTERN, STRIDE), len(t) - PATTERN]
    return [t[s : s + PATTERN] for s in starts]


def edits(m: int) -> int:
    return max(1, math.floor(EDIT_RATE * m))


def need(m: int, q: int = Q) -> int:
    """Shared q-grams that the lemma guarantees."""
    return m - q + 1 - edits(m) * q


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, width, step = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, done = None, 0
    while done < q:
        if q & width:
            part = h[done : done + n] * np.uint64(pow(_BASE, done, 1 << 64))
            out, done = part if out is None else out + part, done + width
        h = h[:-width] + h[width:] * np.uint64(step)
        step, width = step * step % (1 << 64), width * 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


@dataclass
class Index:
    """q-grams of the patterns: sorted hashes, and (pattern, offset) of each."""

    item: np.ndarray
    text: list[np.ndarray]
    q: int = Q

    def __post_init__(self) -> None:
        grams = [_grams(t, self.q) for t in self.text]
        h = np.concatenate(grams)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.pattern = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.length = np.array([len(t) for t in self.text])
        self.edits = np.array([edits(m) for m in self.length])
        self.need = np.maximum([need(m, self.q) for m in self.length], 1)
        self.reach = int((self.length + self.edits).max())
        self.fewest = int(self.need.min())
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[h >> np.uint64(64 - _TABLE_BITS)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of shared q-grams with enough others near by."""
        h = _grams(codes, self.q)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
        found = np.searchsorted(self.hash, h[at])
        at = at[self.hash[np.minimum(found, len(self.hash) - 1)] == h[at]]
        around = np.searchsorted(at, at + self.reach) - np.searchsorted(at, at - self.reach)
        at = at[around >= self.fewest]
        return at, h[at]

    def bands(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, first diagonal of the band) of the bands that reach the bound."""
        at, h = self.hits(codes)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        found, start = [], 0
        total = np.cumsum(hi - lo)
        while start < len(at):  # postings of so many hits at a time as fit into memory
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + (1 << 20), "right")))
            if stop < len(at):  # cut where no region goes on
                far = np.flatnonzero(np.diff(at[:stop]) > self.reach)
                stop = int(far[-1]) + 1 if len(far) and far[-1] + 1 > start else stop
            n = (hi - lo)[start:stop]
            post = np.repeat(lo[start:stop] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            diagonal = np.repeat(at[start:stop], n) - self.offset[post] + (1 << 20)
            pattern = self.pattern[post]
            band = diagonal // BAND
            again = diagonal % BAND < self.edits[pattern]
            key = np.r_[pattern * (1 << 40) + band, pattern[again] * (1 << 40) + band[again] - 1]
            key, count = np.unique(key, return_counts=True)
            found.append((key, count))
            start = stop
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        key, count = map(np.concatenate, zip(*found))
        key, inverse = np.unique(key, return_inverse=True)
        count = np.bincount(inverse, count)
        pattern, band = key >> 40, key & ((1 << 40) - 1)
        use = count >= self.need[pattern]
        return pattern[use], band[use] * BAND - (1 << 20)

    def regions(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(pattern, end, edits) of every band with an alignment within the edit budget."""
        pattern, diagonal = self.bands(codes)
        for m in np.unique(self.length[pattern]):
            for some in np.array_split(np.flatnonzero(self.length[pattern] == m), max(1, len(pattern) // 2000)):
                if len(some):
                    cost, end = align(np.stack([self.text[k] for k in pattern[some]]), codes, diagonal[some], edits(int(m)))
                    for k in np.flatnonzero(cost <= edits(int(m))):
                        yield int(pattern[some[k]]), int(end[k]), int(cost[k])


def align(wanted: np.ndarray, codes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fewest edits, end in the text) of each pattern along diagonals first - k .. first + BAND + 2k.

    Only cells of the band are filled; the alignment may start and end anywhere in the text.
    """
    m, width = wanted.shape[1], BAND + 3 * k + 1
    start = first - k
    pos = start[:, None] + np.arange(m + width)
    text = np.where((pos >= 0) & (pos < len(codes)), codes[np.clip(pos, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
    ramp = np.arange(width)
    cost = np.zeros((len(first), width), np.int32)
    for i in range(m):
        new = cost + (text[:, i : i + width] != wanted[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - ramp, axis=1) + ramp
    best = cost.argmin(1)
    return cost[np.arange(len(first)), best], start + m + best


def _search(segments: list[tuple[int, str]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = [s for s in segments if len(s[1]) < 2 * Q]
        long = [s for s in segments if len(s[1]) >= 2 * Q]
        indexes = [Index(np.array([s[0] for s in part]), [_codes(s[1]) for s in part], q) for part, q in ((short, SHORT_Q), (long, Q)) if part]
        overlap = max(index.reach for index in indexes) + 4 * BAND
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            texts, rows, size = [], [], 0

            def scan():
                codes = _codes(_GAP.join(texts))
                begin = np.cumsum([0, *[len(t) + len(_GAP) for t in texts[:-1]]])
                for at in range(0, len(codes), _BLOCK):
                    piece = codes[max(0, at - overlap) : at + _BLOCK]
                    for index in indexes:
                        for p, end, cost in index.regions(piece):
                            end += max(0, at - overlap)
                            k = int(np.searchsorted(begin, end - 1, "right")) - 1
                            end = int(end - begin[k])
                            out.append((ids[rows[k]], int(index.item[p]), max(0, end - int(index.length[p])), end, cost))

            for k, t in enumerate(b.column(1).to_pylist()):
                if t and ids[k] is not None:
                    texts.append(normalise(t))
                    rows.append(k)
                    size += len(t)
                    if size > _BLOCK:
                        scan()
                        texts, rows, size = [], [], 0
            if texts:
                scan()
            cols = list(zip(*set(out))) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                ["doc", "item", "start", "end", "edits"],
            )

    return run


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None for p in patterns(t or "")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["item", "segment"]
        )


def passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """(doc, item, start, end, edits): regions of documents that hold a stretch of an item.

    A stretch of PATTERN characters (a shorter item as a whole) is found with up to EDIT_RATE of
    its length in edits (at least one), after lower-casing and joining white space; positions are in
    that form. An excerpt of PATTERN + STRIDE - 1 characters is found wherever it starts in the item.
    The patterns are carried to all tasks `pass_chars` characters at a time; a larger benchmark
    takes more passes over the documents. Items under SHORTEST characters or without text or id match
    nothing, nor do documents without text or id. Repeated rows give equal regions once a task.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    segments = items.mapInArrow(_segments, "item long, segment string").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = "doc long, item long, start long, end long, edits int"
    total = segments.agg(F.sum(F.length("segment"))).first()[0] or 0
    n = max(1, math.ceil(total / pass_chars))
    parts = None
    for k in range(n if total else 0):
        part = [tuple(r) for r in segments.filter(F.pmod(F.xxhash64("item", "segment"), F.lit(n)) == k).orderBy("item", "segment").collect()]
        if part:
            found = rows.mapInArrow(_search(part), schema)
            parts = found if parts is None else parts.unionByName(found)
    return spark.createDataFrame([], schema) if parts is None else parts


def contaminated(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """(doc, item, n_regions, edits): items that documents hold, with the fewest edits."""
    return passages(docs, benchmark, **columns).groupBy("doc", "item").agg(
        F.countDistinct("start", "end").alias("n_regions"), F.min("edits").alias("edits")
    )

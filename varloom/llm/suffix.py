"""Removal of byte strings that also occur in earlier documents, by suffix sorting.

Blocks between content-defined cuts that a smaller document holds in full are found by their
hashes. Every other window of `window` bytes is filed under its smallest hashed gram, so equal
windows of two documents lie in slices with one gram. Slices whose gram occurs once are out. The
different slices of the others are concatenated and suffix-sorted, and neighbours in that order
that agree on `window` bytes are equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.repeats import anchor_batch, release, repeated
from varloom.llm.words import BASE, groups, mix, powers, texts
from varloom.sources.sinks import settle

WINDOW, GRAM = 50, 20
#: Different slices of one gram that a task sorts together; beyond, they are filed window by window.
BUCKET = 20_000
#: One slice in so many, on average, starts a block.
BLOCK_SLICES = 4
#: Bytes of slices per suffix array.
SORT_BYTES = 1 << 18
_PIECE = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_BYTE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64)


def suffix_order(x: list[int]) -> list[int]:
    """Suffix array of x, whose last symbol is its smallest and occurs once.

    Suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending order:
    for each member the previous smaller suffix is found along known pointers, and that one's
    prefix grows by as many copies of the group's prefix as it has members there; so it moves to
    a group just above its old one. Then, from the smallest suffix on, each places the suffixes
    whose prefix ends where it starts into the next slots of their groups.
    """
    n = len(x)
    members: list[list[int]] = []
    number = {c: k for k, c in enumerate(sorted(set(x)))}
    group = [number[c] for c in x]
    members.extend([] for _ in number)
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    done, previous, descending = [False] * len(members), [-1] * n, []
    g = len(members) - 1
    while g >= 0:
        done[g] = True
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        descending.append(g)
        moved: dict[tuple[int, int], list[int]] = {}
        last, copies = -1, 0
        for s in own:
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[s] = p
            if p == last:
                copies += 1
            else:
                if last >= 0:
                    moved.setdefault((group[last], copies), []).append(last)
                last, copies = p, 1
        if last >= 0:
            moved.setdefault((group[last], copies), []).append(last)
        # more copies make a larger prefix: of one old group, insert those with most copies first
        for (old, _), rows in sorted(moved.items(), key=lambda m: -m[0][1]) if len(moved) > 1 else moved.items():
            new, up = len(members), above[old]
            members.append(rows)
            done.append(False)
            below.append(old)
            above.append(up)
            above[old] = new
            below[up] = new
            for p in rows:
                group[p] = new
        g = below[g]
    slot, at = [0] * len(members), 0
    for g in reversed(descending):
        slot[g] = at
        at += len(members[g])
    order = [n - 1] * n
    for i in range(n):
        s = order[i]
        j, stop = s - 1, previous[s]
        while j != stop:
            g = group[j]
            order[slot[g]] = j
            slot[g] += 1
            j = previous[j]
    return order


def sharing(slices: list[bytes], docs: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, first, last): of the slices with windows whose hash another doc has too, the first and last such window."""
    raw = np.frombuffer(b"".join(slices), np.uint8)
    size = np.array([len(s) for s in slices])
    of = np.repeat(np.arange(len(slices)), size)
    at = np.flatnonzero(np.cumsum(size)[of] - np.arange(len(raw)) >= window)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
    h = (total[at + window] - total[at]) * down[at]
    order = np.argsort(h)
    h, at = h[order], at[order]
    same = h[1:] == h[:-1]
    again = np.r_[False, same] | np.r_[same, False]
    h, at = h[again], at[again]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    doc = np.array(docs, np.int64)[of[at]]
    lead = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    several = np.minimum.reduceat(doc, lead) < np.maximum.reduceat(doc, lead)
    at = np.sort(at[np.repeat(several, np.diff(np.r_[lead, len(h)]))])
    new = np.r_[True, of[at[1:]] != of[at[:-1]]] if len(at) else np.zeros(0, bool)
    begin, last = np.cumsum(size) - size, np.r_[new[1:], True] if len(at) else new
    found = of[at[new]]
    return found, at[new] - begin[found], at[last] - begin[found]


def equal_windows(slices: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, offset, class) of every window: equal windows have one class."""
    raw = np.frombuffer(b"\0".join([*slices, b""]), np.uint8)
    data = raw.astype(np.int64) + 2
    size = np.array([len(s) for s in slices])
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]
    data[begin + size] = 1
    order = np.array(suffix_order([*data.tolist(), 0]), np.int64)[1:]
    of = np.repeat(np.arange(len(slices)), size + 1)
    offset = np.arange(len(data)) - begin[of]
    order = order[(size[of] - offset >= window)[order]]
    # neighbours are compared eight bytes at a time; a window holds no separator
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view(np.uint64).ravel()
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in [*range(0, window - 8, 8), window - 8]:
        at = np.flatnonzero(same)
        same[at] = eight[order[at + 1] + k] == eight[order[at] + k]
    cls = np.cumsum(np.r_[False, ~same]) if len(order) else np.zeros(0, np.int64)
    return of[order], offset[order], cls


def _slices(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, windows) of the runs of windows with one smallest gram."""
    found, step = [], max(_PIECE, 4 * window)
    for at in range(0, len(data) - window + 1, step):
        part = data[at : at + step + window - 1]
        found.append(_slices_of_piece(part, window, at))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)


def _gram_hash(part: np.ndarray) -> np.ndarray:
    n = len(part) - GRAM + 1
    h, width, step, out, done = _BYTE[part], 1, BASE, None, 0
    while done < GRAM:
        if GRAM & width:
            block = h[done : done + n] * np.uint64(pow(BASE, done, 1 << 64))
            out, done = block if out is None else out + block, done + width
        h = h[:-width] + h[width:] * np.uint64(step)
        step, width = step * step % (1 << 64), width * 2
    return mix(out)


def _slices_of_piece(part: np.ndarray, window: int, at: int):
    h = _gram_hash(part)
    span = window - GRAM + 1
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # the first of equal grams is smallest
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return h[place[first]], first + at, np.diff(np.r_[first, len(place)])


def _runs(b: pa.RecordBatch, window: int):
    """(row, gram hash, first window, windows) of all rows of a batch, as arrays over groups of rows."""
    data, at = texts(b.column(1))
    for lo, hi in groups(at):
        if hi - lo == 1:
            h, first, n = _slices(data[at[lo] : at[hi]], window)
            yield np.full(len(h), lo), h, first, n, data[at[lo] : at[hi]], np.zeros(len(h), np.int64)
            continue
        chunk, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        parts = [(k, *_slices(chunk[own[k] : own[k + 1]], window)) for k in range(hi - lo) if own[k + 1] - own[k] >= window]
        if parts:
            sizes = [len(p[1]) for p in parts]
            row = np.repeat([p[0] for p in parts], sizes)
            h, first, n = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
            yield row + lo, h, first, n, chunk, own[row]


def stretch_hash(data: np.ndarray, begin: np.ndarray, size: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hash of each stretch of `data`: a polynomial in the values that `letters` gives its bytes."""
    out = np.zeros(len(begin), np.uint64)
    for lo in range(0, len(data), _PIECE):  # powers are kept for one piece
        x = data[lo : lo + _PIECE]
        up, down = powers(len(x) + 1)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(letters[x] * up[:-1], out=total[1:])
        left, right = np.clip(begin - lo, 0, len(x)), np.clip(begin + size - lo, 0, len(x))
        late = (begin < lo) & (right > left)
        value = (total[right] - total[left]) * down[np.where(late, 0, left)]
        for k in np.flatnonzero(late):  # began in an earlier piece
            value[k] *= np.uint64(pow(BASE, int(lo - begin[k]), 1 << 64))
        out += value
    return mix(out ^ size.astype(np.uint64))


def _blocks(window: int):
    """(b1, b2, doc, start, n): the blocks of each text with two hashes of their bytes.

    A further equal block of a batch is certain: it gets a key of its own and n < 0.
    """
    other = mix(_BYTE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = b.column(0).to_numpy(), []
            for row, h, first, n, data, base in _runs(b, window):
                if not len(row):
                    continue
                cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] % np.uint64(BLOCK_SLICES) == 0)])
                begin = base[cut] + first[cut]
                count = np.add.reduceat(n, cut)
                size = count + window - 1
                hashes = [stretch_hash(data, begin, size, letters) for letters in (_BYTE, other)]
                found.append((*hashes, ids[row[cut]], first[cut], count))
            if found:
                b1, b2, doc, start, n = map(np.concatenate, zip(*found))
                order = np.lexsort((doc, b2, b1))
                b1, b2, doc, start, n = b1[order], b2[order], doc[order], start[order], n[order]
                same = np.r_[False, (b1[1:] == b1[:-1]) & (b2[1:] == b2[:-1])]
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(b1))))
                sure = doc > doc[lead]
                own = mix(doc.view(np.uint64) * np.uint64(BASE) + start.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(sure, own, b1).view(np.int64)), pa.array(b2.view(np.int64)), pa.array(doc),
                        pa.array(start.astype(np.int32)), pa.array(np.where(sure, -n, n).astype(np.int32)),
                    ],
                    ["b1", "b2", "doc", "start", "n"],
                )

    return run


def _later_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks sorted by (hashes, doc): those of larger docs than the first, and certain ones."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        b1, b2, doc, start, n = (c.to_numpy() for c in b.columns)
        p = last or (b1[0] ^ 1, 0, 0)
        same = (b1 == np.r_[p[0], b1[:-1]]) & (b2 == np.r_[p[1], b2[:-1]])
        lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(b1))))
        first = np.where(lead < 0, p[2], doc[np.maximum(lead, 0)])
        last = (b1[-1], b2[-1], first[-1])
        out = (doc > first) | (n < 0)
        yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(start[out]), pa.array(np.abs(n[out]))], ["doc", "start", "n"])


def _anchors(window: int):
    """Gram hashes of the slices of (doc, text, cuts) that no cut covers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = b.column(0).to_numpy(), []
            cuts = b.column(2)
            pairs, sizes = cuts.flatten(), cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            begin = np.repeat(np.arange(len(ids)), sizes) << 32 | pairs.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(begin)
            begin, end = begin[order], (begin + pairs.field("n").to_numpy(zero_copy_only=False))[order]
            for row, h, first, _, _, _ in _runs(b, window):
                at = row << 32 | first
                k = np.searchsorted(begin, at, "right") - 1
                open_ = (k < 0) | (at >= end[np.maximum(k, 0)]) if len(end) else np.ones(len(at), bool)
                found.append((h[open_], ids[row[open_]], first[open_]))
            if found:
                yield anchor_batch(*map(np.concatenate, zip(*found)))

    return run


_ROW = "h long, s long, doc long, start int, n int, slice binary"
_NAMES = ["h", "s", "doc", "start", "n", "slice"]


def _batch(h, s, doc, start, n, slices) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(h, np.uint64).view(np.int64)), pa.array(np.asarray(s, np.uint64).view(np.int64)),
            pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(n, np.int32)), slices,
        ],
        _NAMES,
    )


def _take(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of `data` as a binary column."""
    bounds = np.r_[0, np.cumsum(size)]
    flat = data[np.repeat(begin - bounds[:-1], size) + np.arange(bounds[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _slice_rows(window: int):
    """Of (doc, text, at): slices that start at `at`; equal slices of a batch go out once.

    Further equal slices of larger ids are certain (no slice, n windows).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            anchors = b.column(2)
            flat, ends = anchors.flatten().to_numpy(), np.cumsum(anchors.value_lengths().to_numpy())
            wanted = np.repeat(np.arange(len(ids)), np.diff(np.r_[0, ends])) << 32 | flat
            for row, h, first, n, data, base in _runs(b, window):
                at = row << 32 | first
                near = np.minimum(np.searchsorted(wanted, at), max(len(wanted) - 1, 0))
                use = np.flatnonzero(wanted[near] == at) if len(wanted) else np.zeros(0, int)
                row, h, first, n, begin = row[use], h[use], first[use], n[use], base[use] + first[use]
                s = stretch_hash(data, begin, n + window - 1, _BYTE)
                doc = ids[row]
                order = np.lexsort((doc, s, h))
                again = np.zeros(len(order), bool)
                ho, so, do = h[order], s[order], doc[order]
                same = np.r_[False, (ho[1:] == ho[:-1]) & (so[1:] == so[:-1])] if len(order) else again
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                again[order] = do > do[lead]
                key = np.where(again, mix(doc.view(np.uint64) * np.uint64(BASE) + first.astype(np.uint64)), h)
                full = _take(data, begin, n + window - 1)
                full = pc.if_else(pa.array(again), pa.scalar(None, pa.binary()), full) if again.any() else full
                yield _batch(key, np.where(again, key, s), doc, first, n, full)

    return run


def _search(window: int):
    """Over rows sorted by (gram, slice, doc): cuts (n windows at start), and windows of large buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[bytes, int, list[int]]] = []  # slice, smallest doc, its starts; of whole buckets
        waiting_bytes = 0
        bucket: list[tuple[bytes, int, list[int]]] = []
        h_now = s_now = None
        large = False

        def cuts(doc, start, n):
            zero = np.zeros(len(doc), np.uint64)
            return _batch(zero, zero, doc, start, n, pa.nulls(len(doc), pa.binary()))

        def windows(rows):
            parts = []
            for text, doc, starts in rows:
                x = np.frombuffer(text, np.uint8)
                for start in starts:
                    for k in range(len(x) - window + 1):
                        parts.append((int.from_bytes(hashlib.blake2b(text[k : k + window], digest_size=8).digest(), "little"), doc, start + k, text[k : k + window]))
            key, doc, start, text = zip(*parts)
            return _batch(key, key, doc, start, np.ones(len(key)), pa.array(text, pa.binary()))

        def sort():
            nonlocal waiting, waiting_bytes
            if waiting:  # most grams repeat without a window that does: only what others share needs a place in the order
                shared = zip(*(x.tolist() for x in sharing([w[0] for w in waiting], [w[1] for w in waiting], window)))
                waiting = [(waiting[k][0][a : b + window], waiting[k][1], [x + a for x in waiting[k][2]]) for k, a, b in shared]
            if waiting:
                # cut so, slices are often equal: each text is sorted once, and its windows are those of all its slices
                place: dict[bytes, int] = {}
                text = np.array([place.setdefault(w[0], len(place)) for w in waiting])
                of, offset, cls = equal_windows(list(place), window)
                order = np.argsort(of, kind="stable")
                size = np.bincount(of, minlength=len(place))
                begin, size = (np.cumsum(size) - size)[text], size[text]
                at = order[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                of, offset, cls = np.repeat(np.arange(len(waiting)), size), offset[at], cls[at]
                least = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
                docs = np.array([w[1] for w in waiting], np.int64)
                np.minimum.at(least, cls, docs[of])
                hit = np.flatnonzero(least[cls] < docs[of])
                if len(hit):
                    order = hit[np.lexsort((offset[hit], of[hit]))]
                    o, k = of[order], offset[order]
                    new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1] + 1)])
                    n = np.diff(np.r_[new, len(o)])
                    rows = [(waiting[a][1], start + b, c) for a, b, c in zip(o[new].tolist(), k[new].tolist(), n.tolist()) for start in waiting[a][2]]
                    yield cuts(*zip(*rows))
            waiting, waiting_bytes = [], 0

        def close():
            """The bucket is complete: one slice needs no comparison."""
            nonlocal bucket, waiting_bytes
            if large:
                if bucket:
                    yield windows(bucket)
            elif len(bucket) > 1:
                waiting.extend(bucket)
                waiting_bytes += sum(len(x[0]) for x in bucket)
                if waiting_bytes >= SORT_BYTES:
                    yield from sort()
            bucket = []

        for b in batches:
            if not b.num_rows:
                continue
            h, s, doc, start, n = (c.to_numpy() for c in b.columns[:5])
            sure = np.asarray(b.column(5).is_null())
            slices = b.column(5)
            if sure.any():
                yield cuts(doc[sure], start[sure], n[sure])
            at = np.flatnonzero(~sure)
            later = []
            for i, hi, si, di, st in zip(at.tolist(), h[at].tolist(), s[at].tolist(), doc[at].tolist(), start[at].tolist()):
                if hi != h_now:
                    yield from close()
                    h_now, s_now, large = hi, None, False
                if si != s_now:
                    if len(bucket) >= BUCKET and int(n[i]) > 1:
                        large = True
                    if large and len(bucket) >= BUCKET:
                        yield windows(bucket)
                        bucket = []
                    s_now = si
                    bucket.append((slices[i].as_py(), di, [st]))
                elif di > bucket[-1][1]:
                    later.append(i)
                else:
                    bucket[-1][2].append(st)
            if later:
                later = np.array(later)
                yield cuts(doc[later], start[later], n[later])
        yield from close()
        yield from sort()

    return run


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, cuts): per document the ranges (start, n) of windows that smaller docs also hold."""
    if window < 2 * GRAM:
        raise ValueError(f"a window has at least {2 * GRAM} bytes")
    spark = docs.sparkSession
    docs = docs.filter("doc is not null and text is not null")
    blocks = docs.mapInArrow(_blocks(window), "b1 long, b2 long, doc long, start int, n int")
    blocks = blocks.repartition("b1").sortWithinPartitions("b1", "b2", "doc").mapInArrow(_later_blocks, "doc long, start int, n int")
    done = settle(blocks)
    of_doc = done.groupBy(F.col("doc").alias("doc_")).agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    rest = docs.join(of_doc, F.col("doc") == F.col("doc_"), "left").select("doc", "text", "cuts")
    at = settle(repeated(rest.mapInArrow(_anchors(window), "h long, doc long, pos int"))).withColumnRenamed("doc", "doc_")
    release(spark)
    rows = docs.join(at, F.col("doc") == F.col("doc_")).select("doc", "text", "at").mapInArrow(_slice_rows(window), _ROW)
    found = done
    while True:
        step = settle(rows.repartition("h").sortWithinPartitions("h", "s", "doc").mapInArrow(_search(window), _ROW))
        found = found.unionByName(step.filter("slice is null").select("doc", "start", "n"))
        rows = step.filter("slice is not null")
        if rows.isEmpty():
            break
    return settle(found.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("cuts")))


def _apply(window: int, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts(b.column(1))
            cuts = b.column(2)
            pairs = cuts.flatten()
            starts, counts = (pairs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n"))
            sizes = cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            n_removed, n_spans, out = [], [], []
            for k in range(b.num_rows):
                text, lo, hi = data[at[k] : at[k + 1]], ends[k] - sizes[k], ends[k]
                gone = spans = 0
                if hi > lo:
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, np.minimum(starts[lo:hi], len(text)), 1)
                    np.add.at(edge, np.minimum(starts[lo:hi] + counts[lo:hi] + window - 1, len(text)), -1)
                    cut = np.cumsum(edge[:-1]) > 0
                    gone, spans = int(cut.sum()), int((np.diff(np.r_[False, cut].astype(np.int8)) == 1).sum())
                    text = text[~cut]
                n_removed.append(gone)
                n_spans.append(spans)
                out.append(hashlib.sha256(text).hexdigest() if digest else text.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                    pa.array(out, pa.string() if digest else pa.binary()),
                ],
                ["doc", "n_bytes", "n_removed", "n_spans", "value"],
            )

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, value) for every row of `docs`.

    A byte goes if it is covered by a string of `window` bytes that also starts in a document with
    a smaller id; strings are judged on the input and do not cross documents. `value` is the bytes
    left (a cut may split a character), or with `digest` their SHA-256. A null text is empty;
    shorter texts and rows with a null id keep all bytes and remove nothing elsewhere. Rows that
    share an id are one document. Extra columns are ignored; no rows give none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    cuts = removals(rows, window).withColumnRenamed("doc", "doc_")
    release(docs.sparkSession)
    joined = rows.join(cuts, F.col("doc") == F.col("doc_"), "left").select("doc", "text", "cuts")
    kind = "string" if digest else "binary"
    return joined.mapInArrow(_apply(window, digest), f"doc long, n_bytes long, n_removed long, n_spans long, value {kind}")

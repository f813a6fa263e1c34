"""Byte-level BPE in Spark: distinct words are merged by a fold over arrays, texts look them up.

The rank map is a literal in the plan. It is laid out as a table of id pairs in which every pair
has one place, so the fold looks a pair up in constant time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.repeats import release
from varloom.llm.words import BYTE, PIECE, groups, mix, powers, texts
from varloom.sources.sinks import settle

_ID_BITS = 17
_ID_MASK = (1 << _ID_BITS) - 1
# an entry of the fold: rank, first byte, id; ids have _ID_BITS bits, and so has the byte
_RANK_AT = 2 * _ID_BITS
_NONE = 1 << _ID_BITS
_REST_MASK = (1 << _RANK_AT) - 1
_BYTE_MASK = _REST_MASK - _ID_MASK
_LONGEST = 1 << _ID_BITS
_TRIES = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(shifts, slots): the pair of ids (a, b) lies at slots[shifts[a] + b].

    A slot holds a << 17 | merged id, or -1. Rows of pairs with one left id are laid over each
    other, the longest first, each at the first shift that finds its slots free.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    ids = max(ranks.values()) + 1
    if ids >> _ID_BITS:
        raise ValueError(f"ids have at most {_ID_BITS} bits")
    pairs, used = sum(map(len, rows.values())), 0
    shifts, slots = np.zeros(ids, np.int64), np.full(2 * (pairs + ids) + _TRIES, -1, np.int64)
    free = np.ones(len(slots), bool)
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b, merged = map(np.array, zip(*row))
        shift = 0
        while True:  # so many shifts at a time
            fits = free[shift + b[0] : shift + b[0] + _TRIES].copy()
            for k in b[1:]:
                fits &= free[shift + k : shift + k + _TRIES]
            if fits.any():
                break
            shift += _TRIES
        shift += int(fits.argmax())
        shifts[a] = shift
        slots[shift + b] = a << _ID_BITS | merged
        free[shift + b] = False
        used = max(used, shift + int(b.max()) + 1)
    return shifts, slots[:used]  # a slot past the end is no pair


def _literal(values: np.ndarray | list, kind: str) -> Column:
    """An array literal; the optimizer folds the parsing away."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bound(value: Column, f) -> Column:
    """f(value), with the value evaluated once."""
    return F.transform(F.array(value), f)[0]


class Merges:
    """Column expressions of one rank file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        shifts, slots = pair_table(ranks)
        self.shifts, self.slots = _literal(shifts.tolist(), "int"), _literal(slots.tolist(), "bigint")
        self.bytes = _literal([ranks[bytes([b])] for b in range(256)], "int")

    @staticmethod
    def rank(shifts: Column, slots: Column, a: Column, b: Column) -> Column:
        """Merged id of a pair, which is also its rank; _NONE if it doesn't merge."""
        slot = F.get(slots, F.get(shifts, a) + b)
        return bound(slot, lambda v: F.when(F.shiftright(v, _ID_BITS) == a, v.bitwiseAND(_ID_MASK)).otherwise(F.lit(_NONE).cast("long")))

    def encode(self, word: Column) -> Column:
        """array<int>: the ids of a non-empty word, merged lowest rank first, leftmost first.

        The fold's state is one array of longs, rank of the pair that starts here << 34 | first byte << 17 | id,
        so that its least entry is the first pair of the lowest rank. A step merges that and looks up
        its two new neighbours. The tables are bound, so that the plan holds each of them once.
        """
        return bound(self.shifts, lambda shifts: bound(self.slots, lambda slots: self._encode(word, shifts, slots)))

    def _encode(self, word: Column, shifts: Column, slots: Column) -> Column:
        none = F.lit(_NONE << _RANK_AT)

        def id_of(x: Column) -> Column:
            return x.bitwiseAND(_ID_MASK).cast("int")

        def ranked(rest: Column, a: Column, b: Column) -> Column:
            """The entry with byte and id `rest` whose id `a` is before the id `b`; no pair if `b` is null."""
            return F.shiftleft(self.rank(shifts, slots, a, b), _RANK_AT).bitwiseOR(rest)

        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")

        def start(ids: Column) -> Column:
            return F.transform(ids, lambda a, k: ranked(F.shiftleft(k.cast("long"), _ID_BITS).bitwiseOR(a.cast("long")), a, F.get(ids, k + 1)))

        def merge(s: Column, p: Column, least: Column) -> Column:
            low = F.shiftright(least, _RANK_AT)
            rest = least.bitwiseAND(_BYTE_MASK).bitwiseOR(low)
            here = ranked(rest, low.cast("int"), id_of(F.get(s, p + 1)))
            left = bound(F.get(s, p - 2), lambda x: ranked(x.bitwiseAND(_REST_MASK), id_of(x), low.cast("int")))
            changed = F.when(p > 1, F.array(left, here)).otherwise(F.array(here))
            return F.concat(F.slice(s, 1, F.greatest(p - 2, F.lit(0))), changed, F.slice(s, p + 2, _LONGEST))

        def step(s: Column, _: Column) -> Column:
            def on(least: Column) -> Column:
                place = F.array_position(s, least).cast("int")
                return F.when(least < none, bound(place, lambda p: merge(s, p, least))).otherwise(s)

            return bound(F.array_min(s), on)

        def fold(ids: Column) -> Column:
            steps = F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1)))
            return F.aggregate(steps, start(ids), step, lambda s: F.transform(s, id_of))

        return bound(F.transform(chars, lambda c: F.get(self.bytes, F.ascii(c))), fold)


#: Frequent words whose ids are carried to every task, and their longest in bytes.
HOT_WORDS, HOT_BYTES = 1 << 19, 64
#: Longer words would cost the fold time that grows with their square.
FOLD_BYTES = 1024
#: Words hashed, and documents looked up, at a time.
_SLICE, _DOCS = 1 << 13, 1024


def split_words(text: Column, pattern: str) -> Column:
    """The matches of `pattern` in order; classes are Unicode's. None for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)), F.array().cast("array<string>"))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What the fold gives, in time n log n: pairs wait in a heap by (rank, place)."""
    start, end = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))  # neighbours
    stop = end[:]
    heap = []

    def push(k: int) -> None:
        nxt = end[k]
        if nxt < len(word):
            rank = ranks.get(word[k : stop[nxt]])
            if rank is not None:
                heappush(heap, (rank, k, stop[nxt]))

    alive = [True] * len(word)
    for k in range(len(word)):
        push(k)
    while heap:
        _, k, until = heappop(heap)
        nxt = end[k]
        if not alive[k] or nxt >= len(word) or stop[nxt] != until:
            continue
        alive[nxt] = False
        stop[k] = until
        end[k] = end[nxt]
        if end[k] < len(word):
            start[end[k]] = k
        push(k)
        if start[k] >= 0:
            push(start[k])
    return [ranks[word[k : stop[k]]] for k in range(len(word)) if alive[k]]


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings, a polynomial in their bytes."""
    data, at = texts(words)
    lo, hi = int(at[0]), int(at[-1])
    up, down = powers(hi - lo + 1)
    total = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(BYTE[data[lo:hi]] * up[:-1], out=total[1:])
    start, end = at[:-1] - lo, at[1:] - lo
    return mix((total[end] - total[start]) * down[start] ^ (end - start).astype(np.uint64))


class WordTable:
    """Ids of known words, in the order of the words' hashes. A find is confirmed on the word itself."""

    def __init__(self, words: pa.Array, ids: pa.Array) -> None:
        # words of at most HOT_BYTES bytes
        pieces = [hash_words(words.slice(k, _SLICE)) for k in range(0, len(words), _SLICE)]
        h = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hash, self.words = h[order], words.take(pa.array(order))
        ids = ids.take(pa.array(order))
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
        self.at = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        self.ids = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, known) for every word; row is 0 where a word is not known. Each different word is looked up once."""
        if not len(self.hash) or not len(words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        coded = words.dictionary_encode()
        different, index = coded.dictionary, coded.indices.to_numpy()
        row, known = np.zeros(len(different), np.int64), np.zeros(len(different), bool)
        at = texts(different)[1]
        for lo, hi in groups(at):
            if at[hi] - at[lo] > PIECE:
                continue  # one word longer than any that is known
            part = different.slice(lo, hi - lo)
            h = hash_words(part)
            k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            k[self.hash[k] != h] = 0
            same = pc.equal(part, self.words.take(pa.array(k))).to_numpy(zero_copy_only=False)
            row[lo:hi], known[lo:hi] = np.where(same, k, 0), same
        return row[index], known[index]


def hot_words(words: DataFrame, merges: Merges, most: int = HOT_WORDS) -> WordTable:
    """The most frequent words and their ids: all that occur at least c times, c as small as allowed.

    `words` is (w) with a row per occurrence.
    """
    short = words.filter(F.octet_length("w") <= HOT_BYTES)
    counts = settle(short.groupBy("w").agg(F.count("*").alias("n")))
    room, least = most, None
    # as many rows as there are different counts
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        room -= r["count"]
        if room < 0:
            break
        least = r["n"]
    if least is None:
        return WordTable(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))
    # at most `most` words of at most HOT_BYTES bytes
    folded = settle(counts.filter(F.col("n") >= least).repartition("w").select("w", merges.encode(F.col("w")).alias("ids")))
    table = folded.toArrow()
    return WordTable(table["w"].combine_chunks(), table["ids"].combine_chunks())


def _look_up(hot: WordTable, ranks: dict[bytes, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = hot.at, hot.ids
        for b in batches:
            for piece in (b.slice(k, _DOCS) for k in range(0, b.num_rows, _DOCS)):
                lists = piece.column(0)
                words = lists.flatten()
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                code, known = hot.find(words)
                missing = np.flatnonzero(~known)
                n_ids = (at[code + 1] - at[code]) if len(at) > 1 else np.zeros(len(code), np.int64)
                n_ids[missing] = 0
                begin = np.r_[0, np.cumsum(n_ids)]
                flat = values[np.repeat(at[code] - begin[:-1], n_ids) + np.arange(begin[-1])] if len(values) else values
                # a list is cut after each word that is not known
                last = np.cumsum(size)
                row = np.searchsorted(last, missing, "right")
                cuts = np.sort(np.r_[begin[missing], begin[last]])
                n_cuts = np.bincount(row, minlength=len(size)) + 1
                pieces = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(n_cuts)].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, cuts].astype(np.int32)), pa.array(flat, pa.int32())),
                )
                text = words.take(pa.array(missing))
                long = pc.greater(pc.binary_length(text), FOLD_BYTES).to_numpy(zero_copy_only=False)
                ids = [merge_long(w.as_py().encode(), ranks) if x else None for w, x in zip(text, long)] if long.any() else [None] * len(text)
                bounds = pa.array(np.r_[0, np.cumsum(n_cuts - 1)].astype(np.int32))
                short = pa.array([None if x else w for w, x in zip(text.to_pylist(), long)], pa.string()) if long.any() else text
                yield pa.RecordBatch.from_arrays(
                    [
                        *piece.columns[1:], pieces, pa.ListArray.from_arrays(bounds, short),
                        pa.ListArray.from_arrays(bounds, pa.array(ids, pa.list_(pa.int32()))),
                    ],
                    [*piece.schema.names[1:], "pieces", "missing", "ready"],
                )
        pa.default_memory_pool().release_unused()

    return run


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids", hot: int = HOT_WORDS,
) -> DataFrame:
    """`docs` with the column `into` (array<int>): each match of `pattern` encoded by itself.

    Different words of up to HOT_BYTES bytes are counted over all texts; the ids of the `hot` most
    frequent are folded once and carried to the tasks, and other words are folded in their
    document. Words over FOLD_BYTES bytes are merged with a heap, to the same ids. Null and empty
    texts give no ids. All columns but one named `into` are kept; equal rows get equal ids.
    """
    ranks = read_ranks(path)
    merges = Merges(ranks)
    words = split_words(F.col(text_col).cast("string"), pattern)
    table = hot_words(docs.select(F.explode(words).alias("w")), merges, hot)
    release(docs.sparkSession)
    kept = [c for c in docs.columns if c != into]
    names = [f"_c{k}" for k in range(len(kept))]
    rows = docs.select(words.alias("_w"), *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "pieces array<array<int>>, missing array<string>, ready array<array<int>>"])
    parts = rows.mapInArrow(_look_up(table, ranks), schema)
    folded = F.transform("missing", lambda w, k: F.coalesce(F.get("ready", k), F.when(w.isNotNull(), merges.encode(w))))
    none = F.array().cast("array<int>")
    # bound: the fold of each missing word runs once, not once for every piece
    ids = bound(folded, lambda f: F.flatten(F.transform("pieces", lambda p, k: F.concat(p, F.coalesce(F.get(f, k), none)))))
    return parts.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], ids.alias(into))


def decode(ids: Column, path: str) -> Column:
    """Binary: the pieces of the ids, concatenated. Ids without a piece give nothing; null gives null."""
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda k: F.get(table, k)), ""))

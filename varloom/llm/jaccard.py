"""Near-duplicate classes by exact Jaccard similarity of word shingles.

Candidates share a band of min-hashes; the classes that candidates form are too wide, but small.
Within each, all pairs are compared by their shingle sets, and only verified pairs link.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm import words
from varloom.llm.graph import components, merge_labels
from varloom.sources.sinks import settle

#: Min-hashes per band, and the share of pairs at the very threshold that no band may find.
BAND_ROWS, MISS = 8, 1e-4
#: A wide class is compared in blocks of about so many documents, or so many shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 20
_CELLS = 1 << 22
_BASE = 0x5851F42D4C957F2D
_C = np.uint64(0xA0761D6478BD642F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bands(least: float) -> int:
    """Bands that miss at most MISS of the pairs at similarity `least`."""
    return math.ceil(math.log(MISS) / math.log1p(-(least**BAND_ROWS)))


def shingles(text: bytes | np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; fewer words form one run."""
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    if not len(data):
        return np.zeros(0, np.uint64)
    _, h = words.hashes(_LOWER[data])
    return np.unique(words.windows(h, min(size, len(h)), _BASE)) if len(h) else np.zeros(0, np.uint64)


def band_keys(s: np.ndarray, n: int) -> np.ndarray:
    """A key per band: its number and the min-hashes of the set."""
    rng = np.random.default_rng(805)
    seed = rng.integers(0, 1 << 32, (n * BAND_ROWS, 1), dtype=np.uint32)
    odd = rng.integers(0, 1 << 31, (n * BAND_ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(n * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, ((x[at : at + 512] ^ seed) * odd).min(1), out=low)
    pairs = low.view(np.uint64).reshape(n, -1)
    key = words.mix(np.arange(n, dtype=np.uint64) + _C)
    for k in range(pairs.shape[1]):
        key = words.mix(key * np.uint64(_BASE) + pairs[:, k])
    return key


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    data, at = words.texts(column)
    return (data[at[k] : at[k + 1]] for k in range(len(at) - 1))


def _sketches(size: int, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, size) for t in _rows(b.column(1))]
            keys = [band_keys(s, n).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            first = np.array([words.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            second = np.array([words.mix(s ^ _C).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists],
                ["doc", "n", "h1", "h2", "keys"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, size).view(np.int64) for t in _rows(b.column(3))]
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], ["doc", "class", "blocks", "shingles"])

    return run


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of `left` x `right` whose sets have at least this Jaccard similarity."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count[col] > 1  # a shingle of one document is in no intersection
    row, col = row[use], (np.cumsum(count > 1) - 1)[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both, width = np.zeros((len(left), len(right)), np.float64), max(1, _CELLS // len(sets))
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        dense = np.zeros((len(sets), min(width, int(col[-1]) + 1 - at)), np.float32)
        dense[row[lo:hi], col[lo:hi] - at] = 1
        both += dense[left] @ dense[right].T
    either = size[left][:, None] + size[right][None, :] - both
    i, j = np.nonzero(both * least.denominator >= either * least.numerator)
    return left[i], right[j]


def _verify(least: Fraction):
    def links(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        doc, block, sets = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows]
        lo, hi = rows[0][3][1:]
        i, j = similar(sets, np.flatnonzero(block == lo), np.flatnonzero(block == hi), least)
        label = merge_labels(np.arange(len(doc)), i, j)
        some = np.flatnonzero(label != np.arange(len(doc)))
        return doc[some], doc[label[some]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(found):
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([f[0] for f in found], [f[1] for f in found]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            found = []
            doc, kind, lo, hi, block = (batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(5))
            lists = batch.column(5)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, key in enumerate(zip(kind, lo, hi)):
                if held and held[0][3] != key:
                    found.append(links(held))
                    held = []
                held.append((doc[k], block[k], values[at[k] : at[k + 1]], key))
            yield out(found)
        if held:
            yield out([links(held)])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """(doc, component): documents with a copy, and the smallest id reachable by links.

    A link is a pair of texts whose sets of `shingle`-word runs have a Jaccard similarity of at least
    `least`; ASCII case and white space do not count. A pair at `least` is missed with probability
    MISS, a closer one far more seldom; no pair below it links. Fewer words form one run; texts
    without words are copies of each other. Rows without id are left out, rows that share an id are
    one document, equal sets cost one row. `candidates` (a, b) are ids found by another method, which
    are compared like those of the bands.
    """
    share = Fraction(least).limit_denominator(1000)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null")
    schema = "doc long, n long, h1 long, h2 long, keys array<long>"
    made = settle(rows.mapInArrow(_sketches(shingle, bands(least)), schema))
    first = settle(made.groupBy("n", "h1", "h2").agg(F.min("doc").alias("b")))
    copies = made.select("n", "h1", "h2", F.col("doc").alias("a")).join(first, ["n", "h1", "h2"]).filter("a <> b").select("a", "b")

    one = made.join(first.select("n", "h1", "h2", F.col("b").alias("doc")), ["n", "h1", "h2", "doc"], "left_semi")
    keyed = one.select("doc", F.explode("keys").alias("key")).withColumn("low", F.min("doc").over(Window.partitionBy("key")))
    near = keyed.filter("doc <> low").select("doc", "low")
    if candidates is not None:
        near = near.union(candidates.select("a", "b").filter("a <> b"))
    wide = settle(components(near, "doc", "low"))
    of = wide.join(one.select(F.col("doc").alias("node"), "n"), "node").groupBy("node", "component").agg(F.max("n").alias("n"))
    of = settle(of)
    size = of.groupBy("component").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    members = of.join(size, "component").select(F.col("node").alias("doc"), F.col("component").alias("class"), "blocks")
    texts = rows.join(members, "doc").select("doc", "class", "blocks", "text")
    sets = texts.mapInArrow(_sets(shingle), "doc long, class long, blocks int, shingles array<long>")
    block = sets.withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    cells = (
        block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("doc", "class", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "shingles")
        .repartition("class", "lo", "hi")
        .sortWithinPartitions("class", "lo", "hi")
    )
    verified = cells.mapInArrow(_verify(share), "a long, b long")
    linked = components(copies.unionByName(verified))
    return linked.select(F.col("node").alias("doc"), "component")

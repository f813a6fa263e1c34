"""SimHash fingerprints of word shingles and near-duplicate classes.

Two 64-bit fingerprints at 4 or fewer differing bits share at least 4 of their 8 bytes, each in
its position. An inverted index over positional bytes finds them; how many bytes a pair shares
is tallied, pairs under the guaranteed minimum are dropped, and the bits of the rest are counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.graph import components, merge_labels
from varloom.sources.sinks import settle

SEED = 42
MAX_BITS = 4
MIN_SHARED_BYTES = 8 - MAX_BITS
#: A longer posting list is split by one more matching unit instead of being compared.
LIST_ROWS = 2048
#: From so many fixed bits on, a list has at most 2^16 fingerprints and is always compared.
FINE_BITS = 48
_BLOCK = 1 << 16
_ROWS = 1 << 17


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of one text: ASCII lower case, words between ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        take = min(_BLOCK, n - at)
        spans = zip(starts[:take].tolist(), ends[-take:].tolist())
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = [signed(fingerprint(t.as_py(), shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc, fp) per row; fp is the fingerprint as a signed long, 0 for null and empty texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc long, fp long")


def _unit(k: int, bits: int) -> int:
    return ((1 << bits) - 1) << (k * bits)


#: Of any 7 positions at least 3 bytes match, so these 35 lists hold every linked pair.
BYTE_MASKS = [signed(sum(_unit(k, 8) for k in c)) for c in combinations(range(7), MIN_SHARED_BYTES - 1)]


def finer(mask: int) -> list[int]:
    """Masks with one more matching unit: bytes first, then half bytes.

    A pair that agrees on `mask` differs in at most MAX_BITS of the units left, so among any
    MAX_BITS + 1 of them one matches.
    """
    mask &= (1 << 64) - 1
    bits = 8 if mask.bit_count() < 8 * MIN_SHARED_BYTES else 4
    free = [u for u in (_unit(k, bits) for k in range(64 // bits)) if not mask & u]
    return [signed(mask | u) for u in free[: MAX_BITS + 1]]


def _links_in_lists(mask: np.ndarray, fp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints in each run of equal (mask, fp & mask)."""
    val = fp & mask
    new = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])])
    end = np.repeat(np.r_[new[1:], len(fp)], np.diff(np.r_[new, len(fp)]))
    label, at, lag = np.arange(len(fp)), np.arange(len(fp)), 1
    left, right, held = [], [], 0
    while True:
        at = at[at + lag < end[at]]
        if len(at):
            x = fp[at] ^ fp[at + lag]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            some = at[shared >= MIN_SHARED_BYTES]
            x = x[shared >= MIN_SHARED_BYTES]
            some = some[np.bitwise_count(x.view(np.uint64)) <= MAX_BITS]
            left.append(some)
            right.append(some + lag)
            held += len(some)
        if held > 1 << 20 or not len(at):
            if held:
                label = merge_labels(label, np.concatenate(left), np.concatenate(right))
            left, right, held = [], [], 0
        if not len(at):
            break
        lag += 1
    linked = np.flatnonzero(label != np.arange(len(label)))
    return doc[linked], doc[label[linked]]


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (mask, fp & mask): links of short lists, finer rows of long ones."""
    held: list[tuple[np.ndarray, ...]] = []
    long_list: tuple[int, int] | None = None

    def out(mask, a, b):
        return pa.RecordBatch.from_arrays(
            [pa.array(mask, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["mask", "a", "b"]
        )

    def links(rows):
        a, b = _links_in_lists(*rows)
        return out(np.zeros(len(a), np.int64), a, b)

    def split(rows):
        for m in finer(int(rows[0][0])):
            yield out(np.full(len(rows[0]), m, np.int64), rows[1], rows[2])

    def ready(rows, last):
        nonlocal held, long_list
        mask, fp, _ = rows
        val = fp & mask
        starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])])
        ends = np.r_[starts[1:], len(fp)]
        done = len(fp) if last else int(starts[-1])
        sizes = ends - starts
        fine = np.bitwise_count(mask[starts].view(np.uint64)) >= FINE_BITS
        big = (sizes > LIST_ROWS) & ~fine
        if long_list is not None and long_list == (int(mask[0]), int(val[0])):
            big[0] = True
        if big[-1] and not last:
            done, long_list = len(fp), (int(mask[-1]), int(val[-1]))
        elif last or len(starts) > 1:
            long_list = None
        use = np.repeat(~big, sizes)
        use[done:] = False
        if use.any():
            yield links(tuple(x[use] for x in rows))
        for k in np.flatnonzero(big):
            if starts[k] < done:
                yield from split(tuple(x[starts[k] : ends[k]] for x in rows))
        held = [tuple(x[done:] for x in rows)] if done < len(fp) else []

    for b in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
        if sum(len(h[0]) for h in held) >= _ROWS:
            yield from ready(tuple(map(np.concatenate, zip(*held))), False)
    if held:
        yield from ready(tuple(map(np.concatenate, zip(*held))), True)


def _in_lists(rows: DataFrame) -> DataFrame:
    val = F.col("fp").bitwiseAND(F.col("mask"))
    return (
        rows.withColumn("val", val)
        .repartition("mask", "val")
        .sortWithinPartitions("mask", "val")
        .select("mask", "fp", "doc")
        .mapInArrow(_search, "mask long, a long, b long")
    )


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints `fps` (fp, doc) as all links would.

    A posting list is compared in its task and sends on a spanning forest, so a group of n near
    copies gives under n links a list. Lists over LIST_ROWS are split by one more matching unit
    until they are short, or until FINE_BITS bits are fixed; no list or pair is dropped.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in BYTE_MASKS])
    rows = fps.select(F.explode(masks).alias("mask"), "fp", "doc")
    found = None
    while True:
        step = settle(_in_lists(rows))
        got = step.filter("mask = 0").select("a", "b")
        found = got if found is None else found.unionByName(got)
        rows = step.filter("mask <> 0").select("mask", F.col("a").alias("fp"), F.col("b").alias("doc"))
        if rows.isEmpty():
            return found


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc, fp, component): each row's fingerprint and the smallest id reachable by links.

    Null and empty texts have fingerprint 0 and link like any other; fewer words than `shingle`
    form one shingle. Equal fingerprints are one node, so copies cost one row. Rows with a null
    id keep their row and get the component of their fingerprint. Extra columns are ignored.
    An empty table gives no rows.
    """
    fps = settle(fingerprints(docs, id_col, text_col, shingle))
    nodes = settle(fps.groupBy("fp").agg(F.min("doc").alias("doc")))
    comp = components(links(nodes.filter("doc is not null")))
    known = (
        nodes.join(comp, F.col("doc") == F.col("node"), "left")
        .select(F.col("fp").alias("fp_"), F.coalesce("component", "doc").alias("component"))
    )
    return fps.join(known, F.col("fp") == F.col("fp_")).select("doc", "fp", "component")

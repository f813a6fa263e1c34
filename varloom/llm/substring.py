"""Removal of repeated runs of words, found through difference-cover anchors.

D = {0, 1, 3, 9} covers the differences modulo 13: for any two positions some shift under 13
brings both onto D. Two equal windows of `window` words so share an anchor of window - 12 words
that starts on D in both documents. Anchors on D that occur twice are extended to all windows
that hold them, and only those windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import words
from varloom.llm.repeats import anchor_batch, release, repeated
from varloom.sources.sinks import settle

# A perfect difference set and its modulus.
COVER, PERIOD = (0, 1, 3, 9), 13
WINDOW = 20
_BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, bytes of its text) of a batch whose second column is the text."""
    data, at = words.texts(b.column(1))
    for k in range(b.num_rows):
        yield k, data[at[k] : at[k + 1]]


def _word_rows(b: pa.RecordBatch):
    """(hash, row, position) of all words of groups of rows, as arrays over each group."""
    data, at = words.texts(b.column(1))
    for lo, hi in words.groups(at):
        own = at[lo : hi + 1] - at[lo]
        chunk = data[at[lo] : at[hi]]
        if hi - lo > 1:  # a space between documents
            chunk = np.insert(chunk, own[1:-1], 32)
            own = own + np.r_[np.arange(hi - lo), hi - lo - 1]
        start, h = words.hashes(chunk)
        row = np.searchsorted(own[:-1], start, "right") - 1
        first = np.searchsorted(start, own[:-1])
        yield h, row + lo, np.arange(len(h)) - first[row]


def _anchors(window: int):
    size = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            found = []
            for h, row, pos in _word_rows(b):
                n = len(h) - size + 1
                if n > 0:
                    use = np.flatnonzero(cover[pos[:n] % PERIOD] & (row[:n] == row[size - 1 :]))
                    found.append((words.windows(h, size, _BASES[0])[use], ids[row[use]], pos[use]))
            if found:
                yield anchor_batch(*map(np.concatenate, zip(*found)))

    return run


def _window_rows(window: int):
    size = window - PERIOD + 1

    def ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.zeros(0, int)
        return doc[cut], start[cut], np.diff(np.r_[cut, len(doc)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = b.column(0).to_numpy(), []
            copy = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            whole = np.zeros(len(ids), np.int64)
            anchors = b.column(2)
            flat = anchors.flatten().to_numpy()
            ends = np.cumsum(anchors.value_lengths().to_numpy())
            for h, row, pos in _word_rows(b):
                n = len(h) - window + 1
                if n <= 0:
                    continue
                # windows that start up to PERIOD - 1 words before an anchor hold it
                lo, hi = int(row[0]), int(row[-1]) + 1
                first = np.searchsorted(row, np.arange(lo, hi))
                begin = ends[lo] - len(anchors[lo])
                of = np.repeat(np.arange(lo, hi), np.diff(np.r_[begin, ends[lo:hi]]))
                at = first[of - lo] + flat[begin : ends[hi - 1]]
                near = np.zeros(len(h) + 1, np.int32)
                np.add.at(near, np.maximum(at - (PERIOD - 1), first[of - lo]), 1)
                np.add.at(near, at + 1, -1)
                np.maximum.at(whole, row, pos + 2 - window)
                use = np.flatnonzero((np.cumsum(near)[:n] > 0) & (row[:n] == row[window - 1 :]) & ~copy[row[:n]])
                w = [words.windows(h, window, base)[use] for base in _BASES]
                found.append((w[0], w[1], ids[row[use]], pos[use]))
            if not found:
                continue
            w1, w2, doc, start = map(np.concatenate, zip(*found))
            w2 = (w2 >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((start, doc, w2, w1))
            w1, w2, doc, start = w1[order], w2[order], doc[order], start[order]
            again = np.r_[False, (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1]) & ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))]
            # an equal row (a repeated id) inherits what its equal got
            equal = np.r_[False, (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])] & ~again
            for k in np.flatnonzero(equal):
                again[k] = again[k - 1]
            d, s, n = ranges(doc[again], start[again])
            copies = np.flatnonzero(copy & (whole > 0))
            d, s, n = np.r_[d, ids[copies]], np.r_[s, np.zeros(len(copies), int)], np.r_[n, whole[copies]]
            key = words.mix(d.view(np.uint64) * np.uint64(_BASES[1]) + s.astype(np.uint64))
            one = ~again
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[w1[one], key].view(np.int64)), pa.array(np.r_[w2[one], np.zeros(len(key), np.int64)].astype(np.uint32).view(np.int32)),
                    pa.array(np.r_[doc[one], d]), pa.array(np.r_[start[one], s].astype(np.int32)),
                    pa.array(np.r_[np.zeros(one.sum(), np.int32), n.astype(np.int32)]),
                ],
                ["w1", "w2", "doc", "start", "n"],
            )

    return run


def _later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (hash, doc, start): all but the first of each hash, and certain ranges."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        w1, w2, doc, start, n = (c.to_numpy() for c in b.columns)
        p = last or (w1[0] ^ 1, 0, 0, 0)
        same = (w1 == np.r_[p[0], w1[:-1]]) & (w2 == np.r_[p[1], w2[:-1]])
        # compare with the first of the run, so that a repeated row of it is not later than itself
        head = np.flatnonzero(~same)
        at = np.searchsorted(head, np.arange(len(w1)), "right") - 1
        lead = np.where(at < 0, -1, head[np.maximum(at, 0)] if len(head) else 0)
        d0 = np.where(lead < 0, p[2], doc[np.maximum(lead, 0)])
        s0 = np.where(lead < 0, p[3], start[np.maximum(lead, 0)])
        later = ((doc != d0) | (start != s0)) & (n == 0)
        last = (w1[-1], w2[-1], d0[-1], s0[-1])
        out = later | (n > 0)
        yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(start[out]), pa.array(np.maximum(n[out], 1))], ["doc", "start", "n"])


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, cuts): per document the ranges (start, n) of windows that also start earlier.

    `docs` is (doc, text). Earlier means a smaller doc, or the same doc and a smaller start.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    docs = docs.filter("doc is not null and text is not null")
    anchors = docs.mapInArrow(_anchors(window), "h long, doc long, pos int")
    at = settle(repeated(anchors)).withColumnRenamed("doc", "doc_")
    release(spark)
    # a text that a smaller id has in full goes in full; its windows need not be compared
    text_key = docs.select("doc", F.md5("text").alias("m"), F.length("text").alias("n"))
    first = text_key.groupBy("m", "n").agg(F.min("doc").alias("lead"))
    lead = settle(text_key.join(first, ["m", "n"]).filter("doc > lead").select(F.col("doc").alias("doc_c")).distinct())
    rows = docs.join(at, F.col("doc") == F.col("doc_")).join(lead, F.col("doc") == F.col("doc_c"), "left")
    rows = rows.select("doc", "text", "at", F.col("doc_c").isNotNull().alias("copy")).mapInArrow(_window_rows(window), "w1 long, w2 int, doc long, start int, n int")
    rows = rows.repartition("w1").sortWithinPartitions("w1", "w2", "doc", "start")
    rows = rows.mapInArrow(_later, "doc long, start int, n int")
    return settle(rows.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("cuts")))


def keep_mask(n_words: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which words stay, given ranges of removed windows."""
    ends = np.minimum(starts + counts + window - 1, n_words)
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, np.minimum(starts, n_words), 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) == 0


def _apply(window: int, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = b.column(2)
            pairs = cuts.flatten()
            starts, counts = (pairs.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n"))
            sizes = cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            n_words, n_removed, out = [], [], []
            for k, data in _rows(b):
                lo, hi = ends[k] - sizes[k], ends[k]
                text = data.tobytes()
                parts = text.split()
                n, gone = len(parts), 0
                if hi > lo:
                    keep = keep_mask(n, starts[lo:hi], counts[lo:hi], window)
                    gone = n - int(keep.sum())
                    if gone:
                        parts = [parts[i] for i in np.flatnonzero(keep).tolist()]
                        text = b" ".join(parts)
                n_words.append(n)
                n_removed.append(gone)
                out.append(hashlib.sha256(b" ".join(parts)).hexdigest() if digest else text if b.column(1)[k].is_valid else None)
            value = pa.array(out) if digest else pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), value, *b.columns[3:]],
                ["doc", "n_words", "n_removed", "value", *b.schema.names[3:]],
            )

    return run


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    keep: tuple[str, ...] = (), digest: bool = False,
) -> DataFrame:
    """(doc, n_words, n_removed, value, *keep) for every row of `docs`.

    A word goes if a window of `window` words that covers it also starts earlier: in a document
    with a smaller id, or earlier in its own. Windows are judged on the input. `value` is the text
    without these words, joined by one space (an untouched text stays as it is), or with `digest`
    the SHA-256 of the kept words joined by one space. A null text has no words and stays null;
    texts under `window` words and rows with a null id keep all words and remove nothing
    elsewhere. Rows that share an id are one document: equal rows get the same result and are not
    earlier than each other. Columns in `keep` pass through; no rows give none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    cuts = removals(rows, window).withColumnRenamed("doc", "doc_")
    release(docs.sparkSession)
    extra = {c: f"_keep{k}" for k, c in enumerate(keep)}
    wide = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"),
        *[F.col(c).alias(n) for c, n in extra.items()],
    )
    wide = wide.join(cuts, F.col("doc") == F.col("doc_"), "left").select("doc", "text", "cuts", *extra.values())
    kinds = dict(wide.dtypes)
    schema = ", ".join(["doc long, n_words long, n_removed long, value string", *[f"{n} {kinds[n]}" for n in extra.values()]])
    return wide.mapInArrow(_apply(window, digest), schema).withColumnsRenamed({n: c for c, n in extra.items()})

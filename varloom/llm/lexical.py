"""Ranked lexical search over posting lists with range-maximum tables.

An index segment holds some thousand documents in the order of their ids, and for each term a posting
list of (document, occurrences). A search turns a list into impacts (what the term adds to a document's
score) and lays a sparse table of range maxima over them. Intervals of documents wait in a heap by the
sum of their lists' maxima, which bounds every score inside. The best interval is split at a document
of maximum impact, which is scored; it ends when no interval can reach the k best.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.words import groups, texts
from varloom.sources.sinks import settle

# A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only
# A-Z are lower-cased.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Postings and documents after which a segment is closed.
SEGMENT_POSTINGS, SEGMENT_DOCS = 1 << 19, 1 << 17
#: Characters of items that one pass over the documents carries to every task.
PASS_CHARS = 1 << 20
#: Intervals split at a time.
_AT_ONCE = 32
_PIECE = 1 << 20
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; pieces end between terms."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + _PIECE < end and (gap := _GAP.search(text, at + _PIECE)):
            end = gap.start()
        yield TERM.findall(text[at:end].translate(LOWER))
        at = end


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


SEGMENT = (
    "n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<int>, lengths array<int>, "
    "docs array<int>, counts array<int>"
)


def _segment(n_docs: int, n_terms: int, ids: pa.Array, size: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """One row: documents in the order of their ids (null last), postings by term and document."""
    used = np.zeros(len(size), bool)
    used[doc] = True
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    order = order[used[order]]
    place = np.zeros(len(size), np.int32)
    place[order] = np.arange(len(order))
    doc = place[doc]
    by = np.lexsort((doc, term))
    doc, term, count = doc[by], term[by], count[by]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[first, len(term)])

    def row(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    lists = [ids.take(pa.array(order)), pa.array(size[order]), *[pa.array(x.astype(np.int32)) for x in (term[first], lengths, doc, count)]]
    return pa.RecordBatch.from_arrays(
        [pa.array([n_docs]), pa.array([n_terms]), *map(row, lists)], ["n_docs", "n_terms", "ids", "sizes", "terms", "lengths", "docs", "counts"]
    )


def _index(vocabulary: list[bytes], most_postings: int, most_docs: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(vocabulary)}
        kept: list[tuple] = []  # (ids, sizes, documents, terms, counts) of groups of texts
        n_docs = n_terms = rows = postings = 0

        def close() -> pa.RecordBatch:
            ids = pa.concat_arrays([k[0] for k in kept]) if kept else pa.array([], pa.int64())
            size, doc, term, count = (np.concatenate([k[c] for k in kept]) if kept else np.zeros(0, np.int64) for c in range(1, 5))
            return _segment(n_docs, n_terms, ids, size, doc, term, count)

        for b in batches:
            data, offsets = texts(b.column(1))
            for lo, hi in groups(offsets):
                size, codes, owner = np.zeros(hi - lo, np.int64), [], []
                words: list[bytes] = []
                per: list[tuple[int, int]] = []

                def look_up():
                    coded = pa.array(words, pa.large_binary()).dictionary_encode()
                    known = np.array([number.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
                    code = known[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
                    codes.append(code[code >= 0])
                    owner.append(np.repeat([k for k, _ in per], [n for _, n in per])[code >= 0].astype(np.int64))

                for k in range(lo, hi):
                    for found in terms(data[offsets[k] : offsets[k + 1]].tobytes()):
                        size[k - lo] += len(found)
                        words += found
                        per.append((k - lo, len(found)))
                        if len(words) > _PIECE:
                            look_up()
                            words, per = [], []
                if per:
                    look_up()
                key = np.concatenate(owner) * len(vocabulary) + np.concatenate(codes) if owner else np.zeros(0, np.int64)
                key, count = np.unique(key, return_counts=True)
                n_docs += int((size > 0).sum())
                n_terms += int(size.sum())
                if len(key):
                    doc, term = np.divmod(key, len(vocabulary))
                    used, doc = np.unique(doc, return_inverse=True)
                    kept.append((b.column(0).slice(lo, hi - lo).take(pa.array(used)), size[used], doc + rows, term, count))
                    rows += len(used)
                    postings += len(key)
                if postings >= most_postings or rows >= most_docs:
                    yield close()
                    kept, n_docs, n_terms, rows, postings = [], 0, 0, 0, 0
        if n_docs:
            yield close()

    return run


class Lists:
    """The posting lists of a segment as impacts, with the places of range maxima."""

    def __init__(self, doc: np.ndarray, impact: np.ndarray, starts: np.ndarray, n_docs: int) -> None:
        self.doc, self.impact, self.starts, self.n_docs = doc, impact, starts, n_docs
        lengths = np.diff(starts)
        term = np.repeat(np.arange(len(lengths)), lengths)
        self.key = term * n_docs + doc
        place, tables, width = np.arange(len(doc), dtype=np.int32), [], 1
        while True:  # level k: place of the maximum of 2^k neighbours
            tables.append(place)
            if 2 * width > (lengths.max() if len(lengths) else 0):
                break
            a, b = place[:-width], place[width:]
            place = np.r_[np.where(impact[a] >= impact[b], a, b), place[-width:]]
            width *= 2
        self.table = np.concatenate(tables)

    def highest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, impact) of the maximum of every range; impact 0 for an empty one."""
        size = hi - lo
        some = size > 0
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        at = level * len(self.doc)
        a = self.table[np.where(some, at + lo, 0)]
        b = self.table[np.where(some, at + hi - (1 << level), 0)]
        va, vb = self.impact[a], self.impact[b]
        return np.where(va >= vb, a, b), np.where(some, np.maximum(va, vb), 0)

    def best(self, rows: np.ndarray, repeats: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """The (score, document) of the k best of at least `least`; equal scores by document.

        `rows` are lists of this segment and `repeats` how often each counts.
        """
        lo, hi = self.starts[rows][None, :], self.starts[rows + 1][None, :]
        bounds = (self.highest(lo, hi)[1] * repeats).sum(1)
        waiting, pool_lo, pool_hi = [(-int(bounds[0]), 0, 0)], [lo[0]], [hi[0]]
        best: list[tuple[int, int]] = []  # heap of (score, -document)
        base = rows * self.n_docs
        while waiting:
            floor, until = (best[0][0], -best[0][1]) if len(best) == k else (least, self.n_docs)
            taken = []
            while waiting and len(taken) < _AT_ONCE:
                bound, first, at = heappop(waiting)
                if -bound < floor:
                    waiting = []
                    break
                if -bound > floor or first < until:
                    taken.append(at)
            if not taken:
                break
            lo, hi = np.array([pool_lo[x] for x in taken]), np.array([pool_hi[x] for x in taken])
            for x in taken:
                pool_lo[x] = pool_hi[x] = None
            place, high = self.highest(lo, hi)
            lead = (high * repeats).argmax(1)
            doc = self.doc[place[np.arange(len(taken)), lead]]
            mid = np.searchsorted(self.key, base[None, :] + doc[:, None])
            here = np.minimum(mid, len(self.doc) - 1)
            has = (mid < hi) & (self.doc[here] == doc[:, None])
            score = (np.where(has, self.impact[here], 0) * repeats).sum(1)
            for s, d in zip(score.tolist(), doc.tolist()):
                if s >= least:
                    if len(best) < k:
                        heappush(best, (s, -d))
                    elif (s, -d) > best[0]:
                        heapreplace(best, (s, -d))
            floor = best[0][0] if len(best) == k else least
            lo, hi = np.concatenate([lo, mid + has]), np.concatenate([mid, hi])
            bounds = (self.highest(lo, hi)[1] * repeats).sum(1)
            for x in np.flatnonzero(bounds >= floor).tolist():
                a, z = lo[x], hi[x]
                first = int(self.doc[a[a < z]].min())
                heappush(waiting, (-int(bounds[x]), first, len(pool_lo)))
                pool_lo.append(a)
                pool_hi.append(z)
        return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))


def _search(items: list[tuple[int, int | None, list[int], list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(np.array(t, np.int64), np.array(r, np.int64)) for _, _, t, r in items]
        found: list[list[tuple[int, int | None]]] = [[] for _ in items]  # (score, id), best first
        for b in batches:
            for row in range(b.num_rows):
                ids, sizes, known, lengths, doc, count = (b.column(c)[row].values for c in range(6))
                sizes, known, lengths, doc, count = (x.to_numpy() for x in (sizes, known, lengths, doc, count))
                m = 25 + 75 * sizes * n_docs // n_terms
                impact = weights[np.repeat(known, lengths)] * (1000000000 * count.astype(np.int64) // (1000 * count.astype(np.int64) + 8 * m[doc]))
                lists = Lists(doc, impact, np.r_[0, np.cumsum(lengths)].astype(np.int64), len(sizes))
                for q, (term, repeats) in enumerate(queries):
                    at = np.searchsorted(known, term)
                    here = known[np.minimum(at, len(known) - 1)] == term if len(known) else np.zeros(len(term), bool)
                    if not here.any():
                        continue
                    least = found[q][-1][0] if len(found[q]) == k else 1
                    new = lists.best(at[here], repeats[here], k, max(least, 1))
                    if new:
                        new = [(s, ids[d].as_py()) for s, d in new]
                        found[q] = sorted(found[q] + new, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out = [(*items[q][:2], i, s) for q, rows in enumerate(found) for s, i in rows]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query", "item", "doc", "score"])

    return run


def _top(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", pass_chars: int = PASS_CHARS,
    segment_postings: int = SEGMENT_POSTINGS, segment_docs: int = SEGMENT_DOCS,
) -> DataFrame:
    """(item, rank, doc, score): the k documents of the highest score above 0 for every item.

    Scores are integers: with N documents that have a term, L their terms and n one document's, a
    term in df documents weighs w = floor(1000 ln((2N + 2) / (2 df + 1))) and adds
    w * (10^9 tf div (1000 tf + 8 m)), m = 25 + 75 n N div L, for each time it is in the item. Equal
    scores go by id, null ids last. The result is exact: intervals are left out only if their bound
    shows that they hold none of the k best.

    Segments of at most `segment_postings` postings (or one group of texts more) are built where the
    texts lie and written once; no document is shuffled. Items are carried to the tasks
    `pass_chars` characters at a time, with a pass over the documents each. Every row of `docs` is a
    document: repeated rows are ranked each. Equal item rows are one item; rows with one item id and
    different texts are ranked each under that id. Null and empty texts have no terms: such documents
    aren't counted or found and such items give no rows, nor do empty tables. A very long text is read in
    pieces. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    asked = asked.filter("length(text) > 0").distinct()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / pass_chars))
    parts = None
    for p in range(passes if total else 0):
        part = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p).orderBy("item", "text").collect()
        words = [[w for some in terms(r["text"].encode()) for w in some] for r in part]
        vocabulary = sorted({w for some in words for w in some})
        if not vocabulary:
            continue
        number = {w: n for n, w in enumerate(vocabulary)}
        index = settle(rows.mapInArrow(_index(vocabulary, segment_postings, segment_docs), SEGMENT))
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        # as many rows as there are terms in the items of this pass
        held = index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("t")).groupBy("t.terms").agg(F.sum("t.lengths").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for r in held.collect():
            weights[r["terms"]] = term_weight(n_docs, r["df"])
        queries = []
        for r, some in zip(part, words):
            codes, repeats = np.unique([number[w] for w in some], return_counts=True) if some else ([], [])
            if len(codes):
                queries.append((len(queries), r["item"], codes.tolist(), repeats.tolist()))
        found = index.select("ids", "sizes", "terms", "lengths", "docs", "counts").mapInArrow(
            _search(queries, weights, n_docs, n_terms, k), "query long, item long, doc long, score long"
        )
        found = found.withColumn("pass", F.lit(p))
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], "item long, rank int, doc long, score long")
    # in two steps, so that no task gets the finds of all tasks for an item
    parts = _top(parts.withColumn("deal", F.pmod(F.xxhash64("doc"), F.lit(64))), k, "pass", "query", "deal").drop("rank", "deal")
    return _top(parts, k, "pass", "query").select("item", "rank", "doc", "score")

"""Toxicity from a learned lexicon that also catches misspelled terms.

Terms and word stems that mark the toxic class are learned from labelled texts and kept in a
trie. A word is matched by running its Levenshtein automaton along the trie. A window around
each match decides whether the term is quoted; a logistic model weighs the counts.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.labelled import bounded, fold, logistic, sigmoid, training_labels
from varloom.sources.sinks import settle

#: Bound of the fit: labelled rows it reads. All else, the number of terms too, follows from them.
TRAIN_ROWS = 20_000
MIN_DOCS, MIN_LOG_ODDS, COVER = 4, 3.0, 3
STEMS = range(4, 8)
WINDOW = 8
THRESHOLD = 0.3
_MEMO = 1 << 17

# Marks that open or close a quotation, and words that report speech.
QUOTES = "\"“”„«»‹›"
REPORTING = {
    "said", "says", "wrote", "writes", "quoted", "quote", "called", "term", "word", "slur",
    "sagte", "schrieb", "zitat", "wort", "dit", "écrit", "citation", "mot",
    "dijo", "escribió", "cita", "palabra",
}
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~" + QUOTES + "‘’…—–¡¿"


def allowance(term: str) -> int:
    """Edits that a misspelling of the term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Trie:
    next: dict[str, Trie] = field(default_factory=dict)
    term: str | None = None
    stem: str | None = None
    edits: int = 0  # the largest allowance below


def lexicon_trie(terms: Iterable[str]) -> Trie:
    """Trie of terms; a term that ends in * is a stem and matches every word that starts so."""
    root = Trie()
    for t in terms:
        body, node = t.rstrip("*"), root
        node.edits = max(node.edits, allowance(body))
        for c in body:
            node = node.next.setdefault(c, Trie())
            node.edits = max(node.edits, allowance(body))
        if t.endswith("*"):
            node.stem = body
        else:
            node.term = body
    return root


def match(word: str, root: Trie) -> tuple[str, int] | None:
    """(term, edits) of the nearest term within its allowance, or None.

    The automaton's state is one bit set of word positions per number of edits spent; a branch
    of the trie is left when its set for the largest allowance below is empty.
    """
    at: dict[str, int] = {}
    for k, c in enumerate(word):
        at[c] = at.get(c, 0) | 1 << k
    full, best = 1 << len(word), None
    start = [1]
    for _ in range(root.edits):
        start.append(start[-1] | start[-1] << 1)
    todo = [(root, start)]
    while todo:
        node, state = todo.pop()
        for body, whole in ((node.term, True), (node.stem, False)):
            if body is not None:
                for e in range(min(allowance(body) + 1, len(state))):
                    # a stem must be read in full; a word may go on after it
                    if state[e] & full if whole else state[e] & (2 * full - 1):
                        if best is None or (e, len(body), body) < (best[1], len(best[0]), best[0]):
                            best = (body, e)
                        break
        for c, child in node.next.items():
            hit = at.get(c, 0)
            new = [(state[0] & hit) << 1]
            for e in range(1, min(child.edits + 1, len(state))):
                step = ((state[e] & hit) << 1) | state[e - 1] | (state[e - 1] << 1) | (new[-1] << 1)
                new.append(step & (2 * full - 1))
            if new[-1]:
                todo.append((child, new))
    return best


def pieces(term: str) -> list[tuple[str, int]]:
    """(part, its offset) of parts of which a misspelling within the allowance keeps one."""
    body = term.rstrip("*")
    n = allowance(body) + 1
    cuts = [round(k * len(body) / n) for k in range(n + 1)]
    return [(body[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Matcher:
    """Terms of whole texts. Clean words near a term are not misspellings of it.

    A word can only match if it holds a part of a term within its allowance of the part's place,
    so one scan for the parts picks the words that the automata see.
    """

    def __init__(self, terms: list[str], clean: Iterable[str] = ()) -> None:
        self.root, self.clean, self.memo = lexicon_trie(terms), frozenset(clean), {}
        places: dict[str, tuple[int, int, int, float]] = {}
        for t in terms:
            body = t.rstrip("*")
            slack = allowance(body)
            longest = math.inf if t.endswith("*") else len(body) + slack
            for part, at in pieces(t):
                old = places.get(part, (at - slack, at + slack, len(body) - slack, longest))
                places[part] = (min(old[0], at - slack), max(old[1], at + slack), min(old[2], len(body) - slack), max(old[3], longest))
        # a word is read as far as the longest term and its edits go
        self.reach = max((len(t.rstrip("*")) for t in terms), default=0) + 3
        self.finder = ahocorasick.Automaton()
        for part, (low, high, short, longest) in places.items():
            self.finder.add_word(part, (low + len(part) - 1, high + len(part) - 1, short, longest))
        if terms:
            self.finder.make_automaton()
        self.any = bool(terms)

    def word(self, token: str) -> tuple[str, int] | None:
        """Match of a word that is free of marks at its ends."""
        if token not in self.memo:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            m = match(token[: self.reach], self.root)
            self.memo[token] = None if m and m[1] and token in self.clean else m
        return self.memo[token]

    def hits(self, text: str) -> tuple[list[tuple[str, int, bool]], int]:
        """([(term, edits, quoted)], words) of a text."""
        tokens = text.lower().split()
        if not self.any or not tokens:
            return [], len(tokens)
        flat, found = " ".join(tokens), []
        begin = end = 0
        for at, (low, high, short, longest) in self.finder.iter(flat):
            if at >= end:
                begin = flat.rfind(" ", 0, at) + 1
                while begin < at and flat[begin] in _EDGE:
                    begin += 1
                end, seen = at, False
            elif seen:
                continue
            if not low <= at - begin <= high:
                continue
            stop = flat.find(" ", at)
            end = stop = len(flat) if stop < 0 else stop
            token = flat[begin:stop].rstrip(_EDGE)
            if short <= len(token) <= longest:
                seen = True
                m = self.word(token)
                if m:
                    found.append((*m, self.quoted(flat, begin, stop)))
        return found, len(tokens)

    @staticmethod
    def quoted(flat: str, start: int, end: int) -> bool:
        """Whether a window around the match opens and closes a quotation, or reports speech."""
        reach = 12 * WINDOW
        before = flat[max(0, start - reach) : start].split()[-WINDOW:]
        after = flat[end : end + reach].split()[:WINDOW]
        own = flat[start:end]
        opened = sum(c in QUOTES for w in before for c in w)
        closed = sum(c in QUOTES for w in (own, *after) for c in w)
        return bool(opened % 2 and closed) or any(w.strip(_EDGE) in REPORTING for w in before[-4:])


def features(hits: list[tuple[str, int, bool]], words: int) -> list[float]:
    exact = sum(1 for _, e, q in hits if not e and not q)
    near = sum(1 for _, e, q in hits if e and not q)
    quoted = sum(1 for _, _, q in hits if q)
    # a quotation counts for less than half of plain use
    plain = exact + 0.6 * near + 0.3 * quoted
    return [math.log1p(8 * plain), float(plain > 0.25), 100 * plain / (words + 20), math.log1p(quoted) if exact + near == 0 else 0.0]


def _units(text: str) -> set[str]:
    out = set()
    for w in set(text.lower().split()):
        w = w.strip(_EDGE)
        if w:
            out.add(w)
            out.update(w[:k] + "*" for k in STEMS if k < len(w))
    return out


def _count_units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = (Counter(), Counter())
        for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            counts[y].update(_units(t or ""))
        units = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(units, pa.string()), *[pa.array([c[u] for u in units], pa.int64()) for c in counts]], ["unit", "neg", "pos"]
        )


def learn_lexicon(rows: DataFrame, counts: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """Terms and stems that mark toxic texts, by greedy covering.

    Candidates have the log-odds; each step takes the one that most toxic texts still need,
    until no candidate adds MIN_DOCS texts that have fewer than COVER of them. Of equal ones a word
    goes before a stem, and a longer stem before a shorter. What a term covers, or is covered
    by, is no candidate any more. Words of any length are candidates; those under five letters are
    matched exactly. The candidates are those of at most TRAIN_ROWS texts.
    """
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    units = [r["unit"] for r in counts.filter((F.col("pos") >= MIN_DOCS) & (odds >= MIN_LOG_ODDS)).orderBy("unit").collect()]
    index = {u: k for k, u in enumerate(units)}

    def held(batches):
        for b in batches:
            got = [sorted(index[u] for u in _units(t) if u in index) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32()))], ["units"])

    # the toxic ones of TRAIN_ROWS texts
    return cover(units, [r[0] for r in rows.filter("y = 1").select("text").mapInArrow(held, "units array<int>").collect()])


def cover(units: list[str], texts: list[list[int]]) -> list[str]:
    """The greedy cover of `texts`, which list numbers of their units."""
    in_text: dict[int, list[int]] = {}
    for k, got in enumerate(texts):
        for u in got:
            in_text.setdefault(u, []).append(k)
    gain = {u: len(v) for u, v in in_text.items()}
    bodies = sorted((units[u].rstrip("*"), u) for u in gain)
    by_body: dict[str, list[int]] = {}
    for body, u in bodies:
        by_body.setdefault(body, []).append(u)

    def entry(u: int) -> tuple:
        return -gain[u], units[u].endswith("*"), -len(units[u]), units[u], u

    wanted, kept, heap = [COVER] * len(texts), [], [entry(u) for u in gain]
    heapify(heap)
    while heap:
        known, *_, best = heappop(heap)
        if best not in gain:
            continue
        if -known != gain[best]:  # it has lost texts since; gains only fall
            heappush(heap, entry(best))
            continue
        if gain[best] < MIN_DOCS:
            break
        body = units[best].rstrip("*")
        kept.append(units[best])
        for k in in_text[best]:
            wanted[k] -= 1
            if not wanted[k]:
                for u in texts[k]:
                    if u in gain:
                        gain[u] -= 1
        at = bisect_left(bodies, (body, -1))
        while at < len(bodies) and bodies[at][0].startswith(body):
            gain.pop(bodies[at][1], None)
            at += 1
        for k in range(1, len(body)):
            for u in by_body.get(body[:k], ()):
                gain.pop(u, None)
    return kept


@dataclass
class Model:
    terms: list[str]
    clean: list[str]
    weights: list[float]

    def scorer(self):
        """text -> score, with the trie built once per task."""
        m, w = Matcher(self.terms, self.clean), np.array(self.weights)

        def score(text: str | None) -> tuple[float, int]:
            hits, words = m.hits(text or "")
            return float(sigmoid(np.dot(w[:-1], features(hits, words)) + w[-1])), len(hits)

        return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, held: int, label_col: str = "toxic") -> Model:
    """Learn terms, clean neighbours of terms, and weights from at most TRAIN_ROWS rows.

    Without both classes among the labelled rows there are no terms, and the score is the share
    of toxic rows (0 without any).
    """
    train = settle(bounded(training_labels(labels, id_col, label_col, folds, held), TRAIN_ROWS))
    # TRAIN_ROWS keys and labels at most
    known = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = settle(known.join(F.broadcast(train), F.col("doc") == F.col("key")).select("text", "y"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        share = (n_pos + 1e-6) / (n_pos + n_neg + 1)
        return Model([], [], [0.0, 0.0, 0.0, 0.0, math.log(share / (1 - share))])
    counts = rows.mapInArrow(_count_units, "unit string, neg long, pos long")
    counts = settle(counts.groupBy("unit").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    terms = learn_lexicon(rows, counts, n_pos, n_neg)

    def near(batches):
        m = Matcher(terms)
        for b in batches:
            found = [m.hits(w)[0] for w in b.column(0).to_pylist()]
            keep = [bool(h and h[0][1]) for h in found]
            yield b.filter(pa.array(keep, pa.bool_()))

    # words of clean texts that an automaton accepts: as many as the TRAIN_ROWS texts hold
    known = counts.filter("neg > 0 and pos * 4 <= neg and not endswith(unit, '*')").select("unit")
    clean = sorted(r[0] for r in known.mapInArrow(near, "unit string").collect())

    def table(batches):
        m = Matcher(terms, clean)
        for b in batches:
            x = [features(*m.hits(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    # TRAIN_ROWS rows of four numbers; in one order, so that sums repeat to the last bit
    xy = rows.mapInArrow(table, "x array<double>, y int").toArrow()
    both = np.c_[np.array(xy["x"].to_pylist()).reshape(-1, 4), xy["y"].to_numpy()]
    both = both[np.lexsort(both.T)]
    return Model(terms, clean, logistic(both[:, :4], both[:, 4]).tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, score, n_hits, *keep) for every row: 0 to 1, higher if toxic is likelier.

    Null and empty texts have no hits and get the score of a text without any.
    """
    extra = {c: f"_keep{k}" for k, c in enumerate(keep)}
    rows = docs.select(
        F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("_t"), *[F.col(c).alias(n) for c, n in extra.items()]
    )

    def run(batches):
        f = model.scorer()
        for b in batches:
            got = [f(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32()), *b.columns[2:]],
                ["doc", "score", "n_hits", *b.schema.names[2:]],
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"doc {kinds['doc']}, score double, n_hits int", *[f"{n} {kinds[n]}" for n in extra.values()]])
    return rows.mapInArrow(run, schema).withColumnsRenamed({n: c for c, n in extra.items()})


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2) -> DataFrame:
    """(doc, held_out, score, predicted, n_hits): fit on the labels, score every row of `docs`.

    Labels of the held-out fold are not read. Rows with a null label, a label other than 0 and 1,
    or a null id do not train; every row of `docs` gets a score: repeated rows the same, null and empty texts
    that of a text without hits, a very long text by all its words. Extra columns are ignored; an
    empty table gives no rows, and without labels every score is 0 or nearly so.
    """
    model = fit(docs, labels, id_col, text_col, folds, held)
    return score(docs, model, id_col, text_col).select(
        "doc", F.coalesce(fold("doc", folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits",
    )

"""Lexical search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from varloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_search(rows, items, k):
    docs = [(i, Counter(t)) for i, t in ((i, plain_terms(t)) for i, t in rows) if t]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(r * weight[w] * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w, r in Counter(plain_terms(text)).items() if w in c)
            if score > 0:
                found.append((i, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, r, i, s) for r, (i, s) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)

    def text(n):
        return " ".join(rng.choice(["Wort", "w", "É", "é", "x-", "_y", "7z"]) + str(int(rng.paretovariate(0.6)) % 300) for _ in range(n))

    base = [text(rng.randrange(1, 90)) for _ in range(220)]
    texts = [*base, *base[:40] * 3, None, "", " .,;!", "É" * 50, "Ünïcode " * 9, text(30000)]
    out = list(enumerate(texts))
    rng.shuffle(out)
    return [*out, out[3], out[3], (None, base[0]), (None, base[1])]


@pytest.fixture(scope="module")
def items(rows):
    some = [t for _, t in rows if t and len(t) < 900]
    return [(k, " ".join(some[7 * k].split()[:12] + some[k].split()[:9])) for k in range(25)] + [
        (30, None), (31, ""), (32, "nowhere"), (33, "w1 W1 w1, é1"), (33, "w1 W1 w1, é1"), (34, "?!"), (None, "w2 w3")
    ]


@pytest.mark.parametrize("size", [(1 << 19, 1 << 17), (300, 40), (1, 1)])
def test_search(spark, rows, items, size):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, score string, rank int").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc string")
    got = lexical.search(docs, bench, k=7, segment_postings=size[0], segment_docs=size[1])
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, items, 7)


def test_items_in_several_passes(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(docs, bench, k=3, pass_chars=400)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, items, 3)


def test_empty_tables(spark, rows, items):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(none, bench).collect() == []
    assert lexical.search(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).collect() == []


def test_terms_of_a_text_in_pieces(monkeypatch):
    text = ("Aé9 --b_c É" * 40).encode()
    want = [w.encode() for w in plain_terms(text.decode())]
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(lexical, "_PIECE", piece)
        assert [w for some in lexical.terms(text) for w in some] == want


def test_few_documents_are_scored():
    """Intervals under the k-th score are left out without a look at their documents."""
    rng = np.random.default_rng(3)
    n = 5000
    lists = [np.sort(rng.choice(n, 1500, replace=False)) for _ in range(3)]
    impact = [rng.integers(1, 50, 1500) for _ in lists]
    for k in range(12):  # some documents stand out
        for doc, value in zip(lists, impact):
            value[np.searchsorted(doc, doc[100 * k])] = 1000 + k
    starts = np.r_[0, np.cumsum([len(x) for x in lists])]
    table = lexical.Lists(np.concatenate(lists), np.concatenate(impact), starts, n)
    calls = []
    highest = table.highest
    table.highest = lambda lo, hi: calls.append(lo.shape[0]) or highest(lo, hi)
    total = np.zeros(n, np.int64)
    for doc, value in zip(lists, impact):
        total[doc] += value
    want = sorted(((int(total[d]), d) for d in range(n) if total[d]), key=lambda x: (-x[0], x[1]))[:10]
    assert table.best(np.arange(3), np.ones(3, np.int64), 10, 1) == want
    assert sum(calls) < n

"""Periodic runs against a plain scan over all periods."""

import hashlib
import random
import zlib

import numpy as np

from varloom.llm import periodic, queries


def plain_runs(w):
    out = []
    for p in range(1, len(w) // 4 + 1):
        at = 0
        while at < len(w) - p:
            end = at
            while end < len(w) - p and w[end] == w[end + p]:
                end += 1
            n = end + p - at
            if n >= max(6, 4 * p) and not any(w[at : at + n - q] == w[at + q : at + n] for q in range(1, p)):
                out.append((at, n, p))
            at = max(end, at + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs)]


def repeating(rng, kinds):
    w = []
    for _ in range(rng.randrange(1, 8)):
        if rng.random() < 0.6:
            unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 20))]
            w += [unit[i % len(unit)] for i in range(rng.randrange(1, 7 * len(unit)))]
        else:
            w += [rng.randrange(kinds) for _ in range(rng.randrange(1, 30))]
    return w


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(300):
        docs = [repeating(rng, rng.randrange(1, 6)) for _ in range(rng.randrange(1, 6))] + [[]]
        got = periodic.find_runs(np.array([x for d in docs for x in d], np.int32), np.array([len(d) for d in docs]))
        assert got == [plain_runs(d) for d in docs]


def test_runs_of_words_with_many_periods():
    a, b = [0], [0, 1]
    while len(b) < 400:  # Fibonacci words hold runs at every scale
        a, b = b, b + a
    nested = ([0, 0, 0, 0, 1] * 5 + [2]) * 6
    for w in (b, nested, [7] * 500, [1, 2] * 300 + [1, 2, 3] * 200, list(range(300)) * 5):
        assert periodic.find_runs(np.array(w), np.array([len(w)])) == [plain_runs(w)]


def test_collapse_of_awkward_rows(spark):
    rng = random.Random(8)
    texts = [" ".join(f"é{x}" for x in repeating(rng, 3)) for _ in range(20)]
    texts += [None, "", " \t\n", "one", "a " * 5, "a\n" * 6, "x y " * 4, "ha " * 40000, " ".join(str(i % 9000) for i in range(40000))]
    rows = [(k, t, f"v{k}", k) for k, t in enumerate(texts)] + [(3, texts[3], "again", 0), (None, texts[0], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string, runs int").repartition(3)
    got = periodic.collapse(docs, keep=("value", "runs")).collect()
    assert len(got) == len(rows)
    want = {(i, v): t for i, t, v, _ in rows}
    for r in got:
        text = want[r[0], r[4]]
        w = (text or "").split()
        if len(w) < 5000:
            runs = plain_runs(w)
        else:  # these two are one run
            runs = [(0, 40000, 1 if w[0] == "ha" else 9000)]
        assert r[1] == len(w) and [tuple(x) for x in r[2]] == runs
        assert r[3] == (" ".join(plain_kept(w, runs) if len(w) < 5000 else w[: runs[0][2]]) if runs else text)
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.collapse(nothing).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(2)
    texts = ["  ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 300))) for _ in range(150)] + [None, "", "b " * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect():
        w = (texts[r["doc_id"]] or "").split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        assert tuple(r) == (
            r["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(plain_kept(w, runs)).encode()).hexdigest(),
        )
    assert planted > 5

"""The quality score of every row against plain formulas: statistics by loops, densities by determinants and solves."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from varloom.llm import quality

STOPS, SPACES = ".,;:?'\"-()", " \t\x0b\x0c\r"


def plain_statistics(text):
    data = (text or "").encode()
    n, kinds = len(data), Counter()
    symbols = Counter()
    for b in data:
        c = chr(b)
        if b < 128 and c.islower():
            k = "lower"
        elif b < 128 and c.isupper():
            k = "upper"
        elif b < 128 and c.isdigit():
            k = "digit"
        elif c in SPACES:
            k = "space"
        elif c == "\n":
            k = "line"
        elif c in STOPS:
            k = "stop"
        elif 33 <= b < 127:
            k = "symbol"
            symbols[c] += 1
        else:
            k = "other"
        kinds[k] += 1
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    root = lambda k: math.sqrt(k / (n + 1))
    repeated = lambda some: math.asin(math.sqrt((len(some) - len(set(some))) / len(some))) if some else 0.0
    return [
        math.log(n + 1), math.log(len(words) + 1), math.log((n + 1) / (len(words) + 1)), root(kinds["upper"]), root(kinds["digit"]), root(kinds["other"]),
        root(kinds["stop"]), root(kinds["symbol"]), root(kinds["line"]), math.log(1 + len(words) / (len(lines) + 1)),
        repeated(lines), repeated(words), root(max(symbols.values(), default=0)),
    ]


def plain_scores(rows, labels):
    x = np.array([plain_statistics(t) for _, t in rows])
    best = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5 != 0:
            best[i] = max(best.get(i, 0), y)
    at = [(k, best[i]) for k, (i, _) in enumerate(rows) if i in best]
    part = {c: x[[k for k, y in at if y == c]] for c in (0, 1)}
    total = sum(len(p) for p in part.values())
    within = {c: sum(np.outer(r - p.mean(0), r - p.mean(0)) for r in p) for c, p in part.items()}
    pooled = np.diag(np.maximum(np.diag(within[0] + within[1]) / total, 1e-4))
    density = {}
    for c, p in part.items():
        cov = (within[c] + 200 * pooled) / (len(p) + 200) + 1e-6 * np.eye(x.shape[1])
        gap = x - p.mean(0)
        density[c] = -0.5 * (gap * np.linalg.solve(cov, gap.T).T).sum(1) - 0.5 * np.linalg.slogdet(cov)[1]
    d = density[1] - density[0]
    d = np.sign(d) * np.log1p(np.abs(d))
    a, b = 0.0, 0.0
    for _ in range(100):  # Newton on two numbers, a ridge of 1 on the slope
        g, h = np.array([a, 1e-6 * b]), np.diag([1.0, 1e-6])
        for k, y in at:
            p = 1 / (1 + math.exp(-(a * d[k] + b)))
            v = np.array([d[k], 1.0])
            g, h = g + (p - y) * v, h + p * (1 - p) * np.outer(v, v)
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return 1 / (1 + np.exp(-(a * d + b)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for k in range(160):
        words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(3, 60))]
        text = " ".join(words).capitalize() + "."
        if k % 2:
            text = "\n".join([rng.choice(["$$$ BUY 99", "click!! >>>", text[:30]]) for _ in range(rng.randrange(1, 12))])
        out.append((k, text))
    return [*out, (500, None), (501, ""), (502, "x" * 200_000), (503, "é y\n" * 20_000), (None, out[3][1]), out[7], out[7]]


def test_statistics(rows):
    for _, t in rows:
        assert quality.statistics(np.frombuffer((t or "").encode(), np.uint8)) == pytest.approx(plain_statistics(t))


def test_scores(spark, rows):
    labels = [(i, int(i % 2 == 0) if i % 11 else int(i % 2)) for i, _ in rows[:160]] + [(500, 0), (7, 1), (None, 1), (9, None), (12, 5)]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in rows], "doc_id long, text string, x string, score double").repartition(3)
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = sorted(zip([i for i, _ in rows], plain_scores(rows, labels)), key=str)
    assert len(got) == len(rows)
    for r, (i, s) in zip(sorted(got, key=lambda r: str((r.doc, r.score))), want):
        assert r.doc == i and r.score == pytest.approx(s, abs=1e-6) and r.predicted == (r.score >= 0.3)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)

"""Source mixing against plain Python: water-filling by rounds, sorted draws."""

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import cycle

import pytest
from pyspark.sql import functions as F

from varloom.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = dict(zip(order, cycle(weights)))
    target, left = dict.fromkeys(order, 0.0), share * sum(sizes.values())
    open_ = set(order)
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in list(open_):
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def plain_mix(rows):
    """rows of (id, text, source, weight) -> {(id, source, size): taken} for unequal rows."""
    sized = []
    for i, t, s, w in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        name = str(i) if i is not None else t or ""
        u = (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        w = 1.0 if w is None else w
        sized.append((-math.log(u) / w if w > 0 else math.inf, i is not None, i or 0, n, s))
    sizes = defaultdict(int)
    for r in sized:
        sizes[r[4]] += r[3]
    target, out = plain_targets(sizes), defaultdict(list)
    for s, size in sizes.items():
        words = math.floor(target[s] + 1e-6)
        epochs = min(words // size, 2) if size else 0
        rest = words - epochs * size
        groups = defaultdict(int)
        for r in sized:
            if r[4] == s:
                groups[r[:4]] += 1
        for r in sorted(groups):
            own = r[3] * groups[r]
            part = r[3] if own <= rest else rest // groups[r]
            rest = max(0, rest - own)
            out[r[2] if r[1] else None, s, r[3]] = [epochs * r[3] + part] * groups[r]
    return target, out


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    hot = sources[0]
    out = []
    for k in range(n):
        t = " ".join(["w"] * rng.randrange(0, 60))
        out.append((k, rng.choice(["", "\n"]) + t, hot if rng.random() < 0.4 else rng.choice(sources), rng.choice([None, 0.5, 1.0, 4.0, 0.0])))
    return out


@pytest.mark.parametrize("sources", [["a"], ["é", "b", None, "B"], [f"s{k}" for k in range(9)]])
def test_mix(spark, sources):
    rows = rows_of(len(sources), 300, sources)
    rows += [(900, None, sources[0], 1.0), (901, "x " * 30000, sources[-1], 1.0), (None, "only text here", sources[0], 2.0), rows[5], rows[5]]
    docs = spark.createDataFrame([(*r, "k", "t") for r in rows], "doc_id long, text string, source string, w double, size string, taken string")
    measured = mixing.measure(docs.repartition(4), keep=("size", "taken", "w"))
    got = mixing.mix(measured, F.col("kept.w"), tiles=16)
    target, want = plain_mix(rows)
    seen = defaultdict(list)
    total = defaultdict(int)
    for r in got.collect():
        assert r[4] == pytest.approx(target[r[1]]) and r[8] == "k" and r[9] == "t"
        assert 0 <= r[7] <= 2 * r[2]
        seen[r[0], r[1], r[2]].append(r[7])
        total[r[1]] += r[7]
    assert seen == want
    assert all(abs(total[s] - target[s]) < 4 for s in total)


def test_reruns_tiles_and_partitions_agree(spark):
    rows = rows_of(4, 200, ["a", "b", "c"])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double")
    runs = [
        sorted(map(tuple, mixing.mix(mixing.measure(docs.repartition(p), keep=("w",)), F.col("kept.w"), tiles=t, levels=n).select("doc", "taken").collect()))
        for p, t, n in ((1, 4, 3), (7, 1024, 2), (3, 2, 0))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_heavier_documents_are_taken_sooner(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'a b c' AS text", "CASE WHEN id < 100 THEN 'a' ELSE 'b' END AS source", "IF(id % 2 = 0, 4.0, 1.0) AS w")
    out = mixing.mix(mixing.measure(docs, keep=("w",)), F.col("kept.w")).filter("source = 'b'").groupBy(F.col("doc") % 2).agg(F.avg("taken")).collect()
    odds = dict(map(tuple, out))
    assert odds[0] > odds[1] + 0.5


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(mixing.measure(spark.createDataFrame([], schema))).collect() == []
    out = mixing.mix(mixing.measure(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema))).select("doc", "size", "target", "taken").collect()
    assert sorted(map(tuple, out)) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_emit(spark):
    docs = spark.createDataFrame([(k, f"a{k} b{k}  c{k}", "s" if k < 3 else "t") for k in range(40)], "doc_id long, text string, source string")
    mixed = mixing.mix(mixing.measure(docs, keep=("text",)))
    want = {r["doc"]: r["taken"] for r in mixed.collect()}
    got = defaultdict(int)
    for r in mixing.emit(mixed).collect():
        assert f"a{r['doc']}" == r["text"].split()[0]
        got[r["doc"]] += len(r["text"].split())
    assert got == {k: v for k, v in want.items() if v}

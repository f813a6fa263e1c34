"""The EM with shared variances and its choice of groups and regions, against plain loops."""

import math
import random
from collections import defaultdict

import pytest

from varloom.operators import finemap

SCHEMA = "grp string, type string, context string, region_id string, z double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    groups = [("SNP", "SNP", "SNP")] + [(f"{c}|{t}", t, c) for c in ("liver", "lung") for t in ("expression", "splicing")]
    out = []
    for r in range(60):
        for g in groups:
            for _ in range(rng.randrange(0, 12) if g[0] == "SNP" else rng.randrange(0, 3)):
                out.append((*g, f"r{r}", rng.gauss(0, 1) * (4 if rng.random() < 0.1 else 1)))
    out += [("rare|expression", "expression", "rare", "r1", 2.0)] * 3 + [("SNP", "SNP", "SNP", "r0", None)]
    out += [("SNP", "SNP", "SNP", "alone", 3.0), ("SNP", "SNP", "SNP", "no gene", 3.0), ("SNP", "SNP", "SNP", "no gene", 1.0)]
    # many strong signals at once: not a region of one effect
    out += [("liver|expression", "expression", "liver", "crowd", 9.0 + k % 2) for k in range(40)]
    out += [("lung|splicing", "splicing", "lung", "crowd", -9.0) for _ in range(40)]
    return out


def plain(rows, tie, prefit, iters, size, least, tol):
    count = defaultdict(int)
    for r in rows:
        if r[4] is not None:
            count[r[0]] += 1
    rows = [r for r in rows if r[4] is not None and count[r[0]] >= size]
    regions = defaultdict(list)
    for r in rows:
        regions[r[3]].append(r)
    regions = {k: v for k, v in regions.items() if len(v) >= 2 and any(r[0] != "SNP" for r in v)}
    now = {r[0]: (0.01, 10.0) for v in regions.values() for r in v}
    tied = {r[0]: tie(r) for v in regions.values() for r in v}

    def step(now, regions):
        n, s, ts, tv = defaultdict(int), defaultdict(float), defaultdict(float), defaultdict(float)
        for v in regions.values():
            w = [now[r[0]][0] * math.exp(-0.5 * math.log(1 + now[r[0]][1]) + 0.5 * r[4] ** 2 * now[r[0]][1] / (1 + now[r[0]][1])) for r in v]
            for r, x in zip(v, w):
                sh, pip = now[r[0]][1] / (1 + now[r[0]][1]), x / (1 + sum(w))
                n[r[0]] += 1
                s[r[0]] += pip
                ts[tied[r[0]]] += pip
                tv[tied[r[0]]] += pip * ((r[4] * sh) ** 2 + sh)
        return {g: (s[g] / n[g] if n[g] else now[g][0], tv[tied[g]] / ts[tied[g]] if ts[tied[g]] else now[g][1]) for g in now}

    for _ in range(prefit):
        now = step(now, regions)
    chosen = {}
    for k, v in regions.items():
        pis = [now[r[0]][0] for r in v]
        if math.prod(1 - p for p in pis) * (1 + sum(p / (1 - p) for p in pis)) >= least:
            chosen[k] = v
    assert 0 < len(chosen) < len(regions)
    for _ in range(iters):
        new = step(now, chosen)
        still = all(abs(a - b) <= tol * b for g in now for a, b in zip(new[g], now[g]))
        now = new
        if still:
            break
    return now


TIES = {
    "shared_all": lambda r: "all", "shared_type": lambda r: r[1], "shared_context": lambda r: r[2],
    "shared_nonSNP": lambda r: "SNP" if r[0] == "SNP" else "gene", "independent": lambda r: r[0],
}


@pytest.mark.parametrize("structure", finemap.STRUCTURES)
def test_structures(spark, rows, structure):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = finemap.est_group_prior(df, structure, iters=12, min_group_size=20, min_p_single=0.8)
    want = plain(rows, TIES[structure], 3, 12, 20, 0.8, 1e-4)
    assert {r.grp: (r.pi, r["var"]) for r in got.collect()} == {g: pytest.approx(v, rel=1e-8) for g, v in want.items()}
    assert "rare|expression" not in want


def test_nothing_to_fit(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert finemap.est_group_prior(df, min_group_size=10**6).collect() == []
    assert finemap.est_group_prior(df.limit(0)).columns == ["grp", "pi", "var"]
    with pytest.raises(ValueError):
        finemap.est_group_prior(df, "shared")

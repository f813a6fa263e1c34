"""Gene z-scores of repeated, null and one-sided rows, and what their plan carries."""

import math
import random
import re

import pytest

from varloom.operators import finemap

W = "gene string, type string, context string, id string, weight double"
Z = "dataset string, id string, z double"
LD = "id1 string, id2 string, r double"


def rows(seed=3):
    rng = random.Random(seed)
    ids = [*"abcdefgh", None]
    w = [(rng.choice(["g", "h", "i", None]), rng.choice(["t", "t", None]), rng.choice("cd"), rng.choice(ids), rng.choice([None, 1.0, -0.5, 2.0])) for _ in range(60)]
    z = [(rng.choice(["s1", "s2", "s3", None]), rng.choice(ids), rng.choice([None, 1.0, 2.5, -3.0])) for _ in range(40)]
    ld = [(x, x, 1.0) for x in "abcdefg"] + [(rng.choice(ids), rng.choice(ids), rng.choice([0.1, -0.2, None])) for _ in range(40)]
    return w + w[:10], z + z[:5], ld + ld[:3]


def plain(w, z, ld):
    out, den = {}, {}
    for g, t, c, i, x in w:
        for s, k, v in z:
            if None not in (g, t, c, s, i, v) and i == k:
                old = out.get((s, g, t, c), (0, None))
                out[s, g, t, c] = (old[0] + 1, old[1] if x is None else (old[1] or 0.0) + x * v)
    has = {(s, k) for s, k, v in z if None not in (s, k, v)}
    for a, b, r in ld:
        for g, t, c, i, x in w:
            for g2, t2, c2, j, y in w:
                if None not in (a, b, g, t, c) and (i, j) == (a, b) and (g, t, c) == (g2, t2, c2):
                    for s in ("s1", "s2", "s3"):
                        if (s, a) in has and (s, b) in has:
                            term = 0.0 if None in (x, y, r) else (1 if a == b else 2) * x * r * y
                            den[s, g, t, c] = den.get((s, g, t, c), 0.0) + term
    return {k: (n, v / math.sqrt(den[k]) if v is not None and den[k] > 1e-9 else None) for k, (n, v) in out.items() if k in den}


@pytest.mark.parametrize("seed", [3, 4])
def test_rows_are_those_of_all_pairs(spark, seed):
    w, z, ld = rows(seed)
    got = finemap.gene_z(spark.createDataFrame(w, W), spark.createDataFrame(z, Z), spark.createDataFrame(ld, LD)).collect()
    got = {(r.dataset, r.gene, r.type, r.context): (r.n_snps, r.z) for r in got}
    want = plain(w, z, ld)
    assert got.keys() == want.keys() and len(want) > 5
    for k, (n, v) in want.items():
        assert got[k][0] == n
        assert got[k][1] is None if v is None else got[k][1] == pytest.approx(v)


def test_pairs_are_not_dealt_with_their_genes(spark):
    w, z, ld = rows()
    out = finemap.gene_z(spark.createDataFrame(w, W), spark.createDataFrame(z, Z), spark.createDataFrame(ld, LD))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # weights meet pairs that share a gene, and each weight is dealt by gene before its studies fan out
    assert re.search(r"RepartitionByExpression \[gene#\d+, type#\d+, context#\d+\]", plan), plan
    joins = re.findall(r"Join Inner, .*", plan)
    assert not [j for j in joins if "id2#" in j and "gene#" in j and "_h#" not in j], joins

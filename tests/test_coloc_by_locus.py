"""Pairs of two traits are made by locus; nothing that is summed over a pair moves its variants."""

import re

from varloom.operators import coloc

A = "dataset1 string, Feature1 string, Chromosome string, Position long, SNPID string, P double, BETA double, SE double, varbeta double"
B = "dataset2 string, Feature2 string, Chromosome string, Position long, SNPID string, P double, BETA double, SE double, varbeta double, AF double"


def sides(spark):
    a = [("s1", "1:0-9", "1", p, f"v{p}", 0.1 * p, 0.5, 0.1, 0.01) for p in (1, 2, 3)]
    a += [("s2", "1:0-9", "1", 2, "v2", 0.2, 0.4, 0.1, 0.01), ("s2", "1:2-20", "1", 2, "v2", 0.2, 0.4, 0.1, 0.01)]
    a += [(None, None, "1", 3, "v3", 0.3, 0.4, 0.1, 0.01), ("s1", "1:0-9", "1", 4, None, 0.3, 0.4, 0.1, 0.01), a[0]]
    b = [("c", f"g{g}", "1", p, f"v{p}", 0.1 * p, 0.3, 0.1, 0.01 * p, 0.2) for g in (1, 2) for p in (2, 3, 7)]
    b += [(None, "g1", "1", 3, "v3", 0.1, 0.3, 0.1, 0.01, 0.2), ("c", "g1", "1", 2, "other", 0.1, 0.3, 0.1, 0.01, 0.2), b[0]]
    return a, b


def test_pairs_by_locus_are_those_of_the_variants(spark):
    a, b = sides(spark)
    got = coloc.coloc_intersect(spark.createDataFrame(a, A), spark.createDataFrame(b, B))
    want = {(x[0], y[0], x[1], y[1], x[4], x[5], y[5]) for x in a for y in b if x[4] is not None and x[2:5] == y[2:5]}
    rows = [tuple(r) for r in got.select(*coloc.KEYS, "SNPID", "F1_P", "F2_P").collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_variants_of_a_pair_stay_in_their_task(spark):
    a, b = sides(spark)
    pairs = coloc.coloc_intersect(spark.createDataFrame(a, A), spark.createDataFrame(b, B))
    lbf = coloc.abf_lbf(pairs, n=(None, 500.0))
    full = coloc.coloc_full(lbf, coloc.coloc_abf(lbf))
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(dataset1#\w+, dataset2#", plan)
    # pairs without a name are left out of the full table
    named = {(*k, v) for *k, v in ((r.dataset1, r.dataset2, r.Feature1, r.Feature2, r.SNPID) for r in pairs.collect()) if None not in k}
    assert {(r.dataset1, r.dataset2, r.Feature1, r.Feature2, r.SNPID) for r in full.collect()} == named

"""Genotype words and pairs: no more rows than the donors need, pairs computed in place."""

import numpy as np
import pytest

from varloom.operators import ld

SCHEMA = "donor long, population string, Chromosome string, Position long, SNPID string, dosage int"


def _rows(g, site, populations=("P",)):
    out = []
    for v in range(g.shape[0]):
        for d in range(g.shape[1]):
            c, p, name = site(v)
            out.append((d, populations[d % len(populations)], c, p, name, None if np.isnan(g[v, d]) else int(g[v, d])))
    return out


def test_a_variant_of_few_donors_is_one_row_a_population(spark):
    g = np.random.default_rng(2).integers(0, 3, size=(5, 60)).astype(float)
    df = spark.createDataFrame(_rows(g, lambda v: ("1", 10 * v, f"v{v}"), ("A", "B")), SCHEMA)
    assert ld.genotype_words(df).count() == 10


def test_pairs_are_not_shuffled(spark):
    g = np.random.default_rng(3).integers(0, 3, size=(4, 20)).astype(float)
    df = spark.createDataFrame(_rows(g, lambda v: ("1", 10 * v, f"v{v}")), SCHEMA)
    plan = ld.ld_pairs(df, df.select("SNPID"), 50)._jdf.queryExecution().optimizedPlan().toString()
    # the only aggregates tell the leads apart
    assert "sxy" not in "".join(x for x in plan.splitlines() if "Aggregate" in x)


def test_an_id_at_several_sites_sums_over_them(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 3, size=(4, 130)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    # v1 and v2 share an id, as do variants without one
    sites = [("1", 10, "a"), ("1", 20, "b"), ("1", 30, "b"), ("1", 40, None)]
    rows = _rows(g, lambda v: sites[v]) + [(d, "P", "2", 5, None, d % 3) for d in range(130)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.Lead, r.LD): (r.r2, r.n) for r in ld.ld_pairs(df, df.select("SNPID"), 100).collect()}
    of = {"a": [0], "b": [1, 2], None: [3]}

    def plain(x, y):
        a = np.concatenate([g[i] for i in of[x] for _ in of[y]])
        b = np.concatenate([g[j] for _ in of[x] for j in of[y]])
        ok = ~np.isnan(a) & ~np.isnan(b)
        return np.corrcoef(a[ok], b[ok])[0, 1] ** 2, ok.sum()

    assert set(got) == {(x, y) for x in ("a", "b") for y in ("a", "b", None)}
    for (x, y), v in got.items():
        assert v == pytest.approx(plain(x, y))


def test_info_of_repeated_rows_is_told_once(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "b", 0.9), ("a", "z", 0.9)], "Lead string, LD string, AFR double")
    g = spark.createDataFrame([("a", 0.1, 1.0), ("a", 0.1, 1.0), ("b", 0.2, None), ("b", 0.3, 2.0)], "SNPID string, P double, BETA double")
    got = sorted(tuple(r) for r in ld.ld_add_info(pairs, g).select("Lead", "SNPID", "GWAS_P", "GWAS_Lead_P").collect() if r.SNPID == "b")
    assert got == [("a", "b", 0.2, 0.1), ("a", "b", 0.3, 0.1)]
    assert ld.ld_add_info(pairs, g).count() == 3

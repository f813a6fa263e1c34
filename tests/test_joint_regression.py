"""The joint regression deals its rows once for all cells, and gives what a regression per cell gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import heritability

CELLS, BINS = ["a", "b", "c"], 2


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    n = 60
    rows = []
    for d in ("S1", "S2"):
        for i in range(n):
            z = 20.0 if i == 7 else float(rng.normal())  # over the limit of chi-squares
            rows.append((f"v{i}", "D", d, f"rs{i}", "1" if i < 40 else "2", 500_000 * (i % 40), z, 90.0 + i % 3, float(rng.uniform(1, 9)), float(rng.uniform(0, 3))))
    rows.append(("v3", "D", "S1", None, "1", 5, 0.1, 90.0, 1.0, 1.0))  # without an id
    own = []
    for i in range(n):
        sets = rng.uniform(0, 5, (len(CELLS), BINS)).tolist()
        if i % 9 == 4:
            sets[1][0] = None
        if i % 11 == 5:
            sets[2][1] = float("nan")
        own.append((f"v{i}", sets))
    df = spark.createDataFrame(rows, "Lead string, disease string, dataset string, SNP string, Chromosome string, Position long, Z double, N double, base double, w double")
    return df, spark.createDataFrame(own, "Lead string, sets array<array<double>>")


def test_equals_a_regression_per_cell(tables):
    df, own = tables
    by = ["disease", "dataset"]
    per = [F.struct(F.lit(c).alias("CELL"), *[F.get(F.get("sets", i), b).alias(f"x{b}") for b in range(BINS)]) for i, c in enumerate(CELLS)]
    long = df.join(own.select("Lead", F.inline(F.array(*per))), "Lead")
    for blocks in (10, 53):  # cells with fewer rows than blocks give none
        want = heritability.coefficients(long, ["base", "x0", "x1"], [*by, "CELL"], blocks, 50.0, "w", chi_limit=True)
        got = heritability.joint_coefficients(df, ["base"], own, CELLS, BINS, by, blocks, 50.0, "w", chi_limit=True)
        a, b = ({(r.disease, r.dataset, r.CELL, r.block): r.coef for r in x.collect()} for x in (want, got))
        assert set(a) == set(b) and {k[2] for k in a} == (set(CELLS) if blocks == 10 else {"a", "c"})
        for key, coef in a.items():
            assert b[key] == pytest.approx(coef, rel=1e-7)


def test_rows_are_dealt_before_they_are_taken_apart(tables, monkeypatch):
    df, own = tables
    dealt = []
    whole = heritability.tiled_running
    monkeypatch.setattr(heritability, "tiled_running", lambda rows, *a, **k: dealt.append(rows.count()) or whole(rows, *a, **k))
    heritability.joint_coefficients(df, ["base"], own, CELLS, BINS, ["disease", "dataset"], 10, 50.0, "w", chi_limit=True).collect()
    assert dealt == [120]  # a row a variant and study, not one for each cell

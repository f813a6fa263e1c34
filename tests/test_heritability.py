"""Heritability: scores, regressions and their errors against numpy, and the oracles on tables large enough for 200 blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.compare import compare, connect
from varloom.functions import linear
from varloom.operators import heritability, ld

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["enrichment_matrix", "report_heritability"])
def test_oracles_with_all_blocks(spark, name):
    df = entry.queries()[name](spark, LARGER)
    rows = [tuple(r) for r in df.collect()]
    cur = connect(LARGER).execute(entry.oracle_sql()[name])
    assert rows and compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) == "ok"


def test_solve(spark):
    rng = np.random.default_rng(1)
    for k in (1, 2, 7):
        a = rng.normal(size=(k, k + 5))
        a, b = a @ a.T, rng.normal(size=k)
        df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<double>")
        assert df.select(linear.solve(F.col("a"), F.col("b"), k)).first()[0] == pytest.approx(np.linalg.solve(a, b), rel=1e-7)
    none = spark.createDataFrame([([[0.0]], [1.0])], "a array<array<double>>, b array<double>")
    assert none.select(linear.solve(F.col("a"), F.col("b"), 1)).first()[0] == [None]


def test_genetic_position(spark):
    gmap = [("1", 100, 0.5), ("1", 2_000_000, 2.5), ("1", 2_000_100, 2.5), ("1", 5_000_000, 4.0), ("2", 10, 1.0), ("1", 100, 0.25)]
    at = [1, 100, 101, 1_999_999, 2_000_050, 3_333_333, 5_000_000, 9_000_000]
    rows = [("1", p) for p in at] + [("2", 7), ("X", 5)]
    out = ld.genetic_position(spark.createDataFrame(rows, "Chromosome string, Position long"), spark.createDataFrame(gmap, "Chromosome string, Position long, cM double"))
    got = {(r.Chromosome, r.Position): r.cM for r in out.collect()}
    assert len(got) == len(rows) and got["X", 5] is None and got["2", 7] == 1.0
    want = np.interp(at, [100, 2_000_000, 2_000_100, 5_000_000], [0.5, 2.5, 2.5, 4.0])
    assert [got["1", p] for p in at] == pytest.approx(list(want))


@pytest.mark.parametrize("donors,shards", [(40, 1), (40, 5), (900, 1)])
def test_windowed_scores(spark, donors, shards):
    """Donors in one word, in several, and in more than are written out; missing calls; missing rows."""
    rng = np.random.default_rng(donors)
    n = 24
    g = rng.integers(0, 3, (n, donors)).astype(float)
    g[1::3] = np.where(rng.random((len(g[1::3]), donors)) < 0.3, g[0::3][: len(g[1::3])], g[1::3])
    g[rng.random(g.shape) < 0.05] = np.nan
    g[5] = 1.0  # constant
    if donors > 63:
        g[7, :400] = np.nan  # no row at all for these
    rows = [("P", f"d{j:04d}", "1" if i < 18 else "2", 1000 * i, f"v{i}", None if np.isnan(g[i, j]) else int(g[i, j]))
            for i in range(n) for j in range(donors) if not (i == 7 and j < 400 and donors > 63)]
    rows += [("Q", "d0000", "1", 0, "v0", 2)]
    schema = "population string, donor string, Chromosome string, Position long, SNPID string, dosage int"
    packed = ld.pack_variants(spark.createDataFrame(rows, schema), "P", shards).withColumn("cM", F.col("Position") / 4000)
    values = {"a": rng.normal(size=n), "b": np.where(np.arange(n) % 3, 0.0, 1.0)}
    annot = spark.createDataFrame([(f"v{i}", k, float(x[i])) for k, x in values.items() for i in range(n) if x[i]], "LD string, label string, value double")
    got = {r.Lead: (r.l2_a, r.l2_b) for r in ld.windowed_scores(packed, annot, ["a", "b"], 1.0).collect()}
    plain = {r.Lead: r.l2_a for r in ld.windowed_scores(packed, annot, ["a"], 1.0, correct=False).collect()}
    af = {r.SNPID: r.AF for r in packed.collect()}
    for i in range(n):
        assert af[f"v{i}"] == pytest.approx(np.nanmean(g[i]) / 2)
        total, raw = np.zeros(2), 0.0
        for j in range(n):
            if (i < 18) != (j < 18) or abs(i - j) > 4:
                continue
            ok = ~np.isnan(g[i]) & ~np.isnan(g[j])
            if g[i][ok].std() == 0 or g[j][ok].std() == 0:
                continue
            r2 = np.corrcoef(g[i][ok], g[j][ok])[0, 1] ** 2
            raw += r2 * values["a"][j]
            total += (r2 - (1 - r2) / (ok.sum() - 2)) * np.array([values["a"][j], values["b"][j]])
        if i == 5:
            assert "v5" not in got
        else:
            assert got[f"v{i}"] == pytest.approx(tuple(total), rel=1e-9, abs=1e-12) and plain[f"v{i}"] == pytest.approx(raw)


def _fit(x, y, w, keep):
    return np.linalg.solve((x[keep] * w[keep, None]).T @ x[keep], (x[keep] * w[keep, None]).T @ y[keep])


def _jack(f, block, blocks):
    left = np.array([f(block != b) for b in range(blocks)])
    return (blocks - 1) * left.std(axis=0, ddof=1) / np.sqrt(blocks)


def test_partitioned_and_mediated_h2(spark):
    rng = np.random.default_rng(4)
    n, blocks = 400, 20
    base, own, exp, reg = rng.uniform(1, 30, n), rng.uniform(0, 9, n), rng.uniform(0, 3, n), rng.uniform(0.2, 6, n)
    size = rng.choice([800.0, 1000.0], n)
    z = rng.normal(size=n) * np.sqrt(1 + 0.02 * base + 0.3 * own + 0.2 * exp)
    z[3] = 40.0  # over the limit of chi-square
    rows = [("s", "m", "1", i * 1000, f"r{i}", *map(float, x)) for i, x in enumerate(zip(z, size, base, own, exp, reg))]
    df = spark.createDataFrame(rows, "dataset string, model string, Chromosome string, Position long, SNP string, Z double, N double, base double, own double, e double, w double")
    m, overlap, total = np.array([900.0, 300.0]), np.array([[900.0, 250.0], [250.0, 300.0]]), 1000.0
    counts = spark.createDataFrame([("m", m.tolist(), overlap.tolist(), total)], "model string, M array<double>, overlap array<array<double>>, M_total double")
    keep = np.delete(np.arange(n), 3)
    chi, size, reg = (z * z)[keep], size[keep], reg[keep]
    block = np.arange(n - 1) * blocks // (n - 1)

    def design(scores, m_sum):
        l2 = scores.sum(1)
        h2 = min(max((chi.mean() - 1) * m_sum / (l2 * size).mean(), 0), 1)
        w = 1 / (np.maximum(reg, 1) * (1 + size * h2 * np.maximum(l2, 1) / m_sum) ** 2)
        return np.c_[np.ones(n - 1), scores * (size / size.mean())[:, None]], w

    by = ["dataset", "model"]
    coef = heritability.coefficients(df, ["base", "own"], by, blocks, m.sum(), "w", chi_limit=True)
    got = {r.Category: r for r in heritability.partitioned_h2(coef, counts, ["base", "own"], by).collect()}
    x, w = design(np.c_[base, own][keep], m.sum())

    def parts(rows):
        c = _fit(x, chi, w, rows)
        tau = c[1:] / size.mean()
        h2 = tau @ m
        gap = [overlap[i] @ tau / m[i] - (m - overlap[i]) @ tau / (total - m[i]) for i in (0, 1)]
        return np.array([h2, c[0], *(overlap @ tau / h2), *tau, *gap])

    est, se = parts(np.ones(n - 1, bool)), _jack(parts, block, blocks)
    assert (got["h2"].Estimate, got["h2"].SE) == pytest.approx((est[0], se[0]))
    assert (got["intercept"].Estimate, got["intercept"].SE) == pytest.approx((est[1], se[1]))
    for i, name in enumerate(["base", "own"]):
        r = got[name]
        assert r.Prop_SNPs == m[i] / total
        assert (r.Prop_h2, r.Prop_h2_SE, r.Coefficient, r.Coefficient_SE) == pytest.approx((est[2 + i], se[2 + i], est[4 + i], se[4 + i]))
        assert (r.Enrichment, r.Enrichment_SE) == pytest.approx((est[2 + i] * total / m[i], se[2 + i] * total / m[i]))
        t = np.abs(rng.standard_t(blocks, 400_000)) > abs(est[6 + i] / se[6 + i])
        assert r.Enrichment_p == pytest.approx(t.mean(), abs=0.004)

    joint = heritability.coefficients(df.withColumnRenamed("model", "CELL"), ["base", "own", "e"], ["dataset", "CELL"], blocks, 500.0, "w", chi_limit=True)
    cis = spark.createDataFrame([("m", [12.5])], "CELL string, H array<double>")
    got = {r.Quantity: r for r in heritability.mediated_h2(joint, [900, 300], cis, ["dataset", "CELL"]).collect()}
    x, w = design(np.c_[base, own, exp][keep], 500.0)

    def mediated(rows):
        tau = _fit(x, chi, w, rows)[1:] / size.mean()
        med, rest = 12.5 * tau[2], m @ tau[:2]
        return np.array([med, rest, med + rest, med / (med + rest), rest / (med + rest), 1.0])

    est, se = mediated(np.ones(n - 1, bool)), _jack(mediated, block, blocks)
    for i, q in enumerate(["h2med", "h2nonmed", "h2"]):
        r = got[q]
        assert (r.Estimate, r.SE_Estimate, r.Estimate_over_h2) == pytest.approx((est[i], se[i], est[3 + i]))
        assert r.SE_over_h2 == pytest.approx(se[3 + i], abs=1e-9)


def test_too_few_rows_and_collinear_scores(spark):
    schema = "dataset string, Chromosome string, Position long, Z double, N double, a double, b double"
    few = spark.createDataFrame([("s", "1", k, 1.0 + k, 10.0, 2.0 + k, 1.0) for k in range(15)], schema)
    assert heritability.coefficients(few, ["a"], ["dataset"], 20).count() == 0
    same = spark.createDataFrame([("s", "1", k, 1.0 + k % 7, 10.0, 2.0, 2.0) for k in range(60)], schema)
    assert heritability.jackknife(
        heritability.coefficients(same, ["a", "b"], ["dataset"], 10).select("dataset", "block", F.lit("q").alias("Quantity"), F.get("coef", 1).alias("value")), ["dataset"]
    ).count() == 0

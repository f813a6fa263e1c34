"""Operators without an SQL oracle against plain loops on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions.frames import islands, point_in_interval, tiled_running
from varloom.operators import cells, expression, finemap, heritability, ld, loci, signatures


@pytest.fixture(scope="module")
def signals():
    rnd = random.Random(5)
    out = []
    for study in ("s1", "s2"):
        for chrom in ("1", "2", "10"):
            for i in range(120):
                pos = rnd.randrange(0, 4000) + (0 if rnd.random() < 0.6 else 50_000)
                out.append((study, chrom, pos, f"{chrom}:{pos}:{i}", 10 ** -rnd.uniform(1, 14)))
    return out


SCHEMA = "dataset string, Chromosome string, Position long, SNPID string, P double"


def greedy(rows, window):
    """Best P first, blank what is strictly inside, repeat."""
    left, tops = sorted(rows, key=lambda r: (r[4], r[2], r[3])), []
    while left:
        top = left[0]
        tops.append(top)
        lo, hi = max(top[2] - window // 2, 0), top[2] + window // 2
        left = [r for r in left if r[2] <= lo or r[2] >= hi]
        # the top itself sits at 0 when lo is cut there
        left = [r for r in left if r[3] != top[3]]
    return tops


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[1]), []).append(r)
    return out


def test_clump_top(spark, signals):
    sig = [r for r in signals if r[4] <= 5e-8]
    got = {(r.dataset, r.Chromosome, r.Position) for r in loci.clump_top(spark.createDataFrame(sig, SCHEMA), 400).collect()}
    want = {(t[0], t[1], t[2]) for rows in by_key(sig).values() for t in greedy(rows, 400)}
    assert got == want


@pytest.mark.parametrize("shrink", [False, True])
def test_identify_loci(spark, signals, shrink):
    window, want = 400, set()
    counts = {}
    order = {"1": 1, "2": 2, "10": 10}
    for (study, chrom), rows in sorted(by_key(signals).items(), key=lambda kv: (kv[0][0], order[kv[0][1]])):
        spans = []
        for top in greedy([r for r in rows if r[4] <= 5e-8], window):
            member = [r for r in rows if abs(r[2] - top[2]) <= window // 2]
            if shrink:
                sig = [r[2] for r in member if r[4] <= 5e-8]
                member = [r for r in member if min(sig) <= r[2] <= max(sig)]
            spans.append((min(r[2] for r in member), max(r[2] for r in member), member))
        merged = []
        for s, e, member in sorted(spans, key=lambda x: x[:2]):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], e), merged[-1][2] | set(member))
            else:
                merged.append((s, e, set(member)))
        for s, e, member in merged:
            counts[study] = counts.get(study, 0) + 1
            want |= {(study, chrom, r[3], counts[study], s, e) for r in member}
    df = spark.createDataFrame(signals, SCHEMA)
    got = {(r.dataset, r.Chromosome, r.SNPID, r.Loci, r.Start, r.End_) for r in loci.identify_loci(df, window=window, shrink=shrink).collect()}
    assert got == want
    # the single operators chained give the same
    tops = loci.clump_top(df.filter("P <= 5e-8"), window)
    chained = loci.number_loci(loci.merge_loci(loci.define_loci(df, tops, window, shrink)))
    assert {(r.dataset, r.Chromosome, r.SNPID, r.Loci, r.Start, r.End_) for r in chained.collect()} == want


def test_islands_across_tiles(spark):
    rnd = random.Random(2)
    spans = sorted({(s, s + rnd.randrange(1, 300)) for s in rnd.sample(range(20_000), 300)})
    df = spark.createDataFrame([("k", s, e) for s, e in spans], "k string, s long, e long")
    got = {(r.s, r.e): r._island for r in islands(df, ["k"], "s", "e", gap=5, tile=1000).collect()}
    n, end, want = 0, None, {}
    for s, e in spans:
        if end is None or s > end + 5:
            n += 1
        end = e if end is None else max(end, e)
        want[(s, e)] = n
    assert got == want


def test_tiled_running(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.random()) for k in "ab" for i in rnd.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    out = tiled_running(df, ["k"], F.floor(F.col("i") / 37), ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    got = {(r.k, r.i): (r.s, r.m) for r in out.collect()}
    for k in "ab":
        s, m = 0.0, -1.0
        for _, i, v in sorted(r for r in rows if r[0] == k):
            s, m = s + v, max(m, v)
            assert got[(k, i)] == pytest.approx((s, m))


def test_point_in_interval_kinds(spark):
    pts = spark.createDataFrame([("1", p) for p in (0, 10, 25, 99)], "Chromosome string, Position long")
    iv = spark.createDataFrame([("1", 10, 25), ("1", 20, 60)], "Chromosome string, Start long, End_ long")
    assert sorted(r.Position for r in point_in_interval(pts, iv, 7).collect()) == [10, 25, 25]
    assert sorted(r.Position for r in point_in_interval(pts, iv, 7, how="left_semi").collect()) == [10, 25]
    assert sorted(r.Position for r in point_in_interval(pts, iv, 7, how="left_anti").collect()) == [0, 99]
    assert point_in_interval(pts, iv, 7, how="left").count() == 5


def test_ld_with_many_donors_and_missing_calls(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, size=(6, 300)).astype(float)
    g[1] = g[0]
    g[rng.random(g.shape) < 0.1] = np.nan
    rows = [
        (int(d), "P", "1", 100 * v, f"v{v}", None if np.isnan(g[v, d]) else int(g[v, d])) for v in range(6) for d in range(300)
    ]
    df = spark.createDataFrame(rows, "donor long, population string, Chromosome string, Position long, SNPID string, dosage int")
    out = ld.ld_pairs(df, df.select("SNPID").distinct(), window=200, shards=3)
    got = {(r.Lead, r.LD): r.r2 for r in out.collect()}
    assert set(got) == {(f"v{a}", f"v{b}") for a in range(6) for b in range(6) if abs(a - b) <= 2}
    for (a, b), r2 in got.items():
        x, y = g[int(a[1])], g[int(b[1])]
        ok = ~np.isnan(x) & ~np.isnan(y)
        assert r2 == pytest.approx(np.corrcoef(x[ok], y[ok])[0, 1] ** 2, abs=1e-12)
        assert 0 <= r2 <= 1 + 1e-12


def test_est_group_prior(spark):
    rng = np.random.default_rng(4)
    rows = [("g%d" % (i % 2), f"r{i % 17}", float(rng.normal() * (3 if i % 9 == 0 else 1))) for i in range(400)]
    got = finemap.est_group_prior(spark.createDataFrame(rows, "grp string, region_id string, z double"), "independent", 2, 3, 1, 1, 0, 0.0, tol=0.0)
    pi, var = {"g0": 0.01, "g1": 0.01}, {"g0": 10.0, "g1": 10.0}
    for _ in range(5):
        pip = {}
        for reg in {r[1] for r in rows}:
            idx = [i for i, r in enumerate(rows) if r[1] == reg]
            w = [pi[rows[i][0]] * math.exp(-0.5 * math.log(1 + var[rows[i][0]]) + 0.5 * rows[i][2] ** 2 * var[rows[i][0]] / (1 + var[rows[i][0]])) for i in idx]
            for i, x in zip(idx, w):
                pip[i] = x / (1 + sum(w))
        new_pi, new_var = {}, {}
        for g in pi:
            idx = [i for i, r in enumerate(rows) if r[0] == g]
            s = sum(pip[i] for i in idx)
            sh = var[g] / (1 + var[g])
            new_pi[g] = s / len(idx)
            new_var[g] = sum(pip[i] * ((rows[i][2] * sh) ** 2 + sh) for i in idx) / s
        pi, var = new_pi, new_var
    for r in got.collect():
        assert (r.pi, r["var"]) == pytest.approx((pi[r.grp], var[r.grp]), rel=1e-9)


def test_h2_regression(spark):
    rng = np.random.default_rng(6)
    n, blocks = 500, 10
    pos = np.arange(n) * 1000
    l2 = rng.uniform(1, 30, n)
    z = rng.normal(size=n) * np.sqrt(1 + 0.05 * l2)
    df = spark.createDataFrame(
        [("s", "1", int(p), float(a), 1000.0, float(b)) for p, a, b in zip(pos, z, l2)],
        "dataset string, Chromosome string, Position long, Z double, N double, l2 double",
    )
    got = {r.Quantity: (r.Estimate, r.SE) for r in heritability.h2_regression(df, ["l2"], blocks).collect()}
    chi = z * z
    h2 = min(max((chi.mean() - 1) * n / (1000 * l2.mean()), 0), 1)
    w = 1 / (l2 * (1 + 1000 * h2 * l2 / n) ** 2)
    x = np.stack([np.ones(n), l2], 1)

    def fit(keep):
        return np.linalg.solve((x[keep] * w[keep, None]).T @ x[keep], (x[keep] * w[keep, None]).T @ chi[keep])

    full = fit(np.ones(n, bool))
    block = np.arange(n) * blocks // n
    pseudo = np.stack([blocks * full - (blocks - 1) * fit(block != b) for b in range(blocks)])
    se = np.sqrt(pseudo.var(axis=0, ddof=1) / blocks)
    assert got["intercept"] == pytest.approx((full[0], se[0]), rel=1e-8)
    assert got["l2"] == pytest.approx((full[1], se[1]), rel=1e-8)


def test_h2_regression_with_too_few_rows(spark):
    df = spark.createDataFrame([("s", "1", 1, 1.0, 10.0, 2.0)], "dataset string, Chromosome string, Position long, Z double, N double, l2 double")
    assert heritability.h2_regression(df, ["l2"]).count() == 0


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(8)
    return rng.poisson(0.7, size=(60, 12)).astype(float)


def long_table(spark, m):
    rows = [(c, f"g{j:02d}", float(m[c, j])) for c in range(m.shape[0]) for j in range(m.shape[1]) if m[c, j] > 0]
    return spark.createDataFrame(rows, "cell long, gene string, value double")


def test_regress_out(spark, matrix):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=60), rng.normal(size=60)
    meta = spark.createDataFrame([(i, float(a[i]), float(b[i])) for i in range(60)], "cell long, n_counts double, percent_mt double")
    genes = spark.createDataFrame([(f"g{j:02d}",) for j in range(5)], "gene string")
    out = expression.regress_out(long_table(spark, matrix), meta, genes, clip=None)
    x = np.stack([np.ones(60), a, b], 1)
    for r in out.collect():
        y = matrix[:, int(r.gene[1:])]
        res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert r.residual == pytest.approx((res / res.std(ddof=1))[r.cell], abs=1e-9)


def test_module_score(spark, matrix):
    sets = spark.createDataFrame([("s", "g00"), ("s", "g05"), ("t", "g07")], "signature string, gene string")
    cells_df = spark.createDataFrame([(i,) for i in range(60)], "cell long")
    values = long_table(spark, matrix)
    # one bin and every gene as control: signature mean minus overall mean
    out = signatures.module_score(values, sets, cells_df, bins=1, controls=100)
    for r in out.collect():
        hit = [0, 5] if r.signature == "s" else [7]
        assert r.score == pytest.approx(matrix[r.cell, hit].mean() - matrix[r.cell].mean())


def test_rank_metrics(spark, matrix):
    tag = ["a" if i % 3 == 0 else "b" for i in range(60)]
    cells_df = spark.createDataFrame([(i, tag[i]) for i in range(60)], "cell long, cluster string")
    ref = np.array([t == "a" for t in tag])

    def stats(m):
        mean, sd = m.mean(0), m.std(0, ddof=1)
        return mean, np.maximum(sd, 0.2 * np.abs(np.where(mean == 0, 1, mean)))

    (m1, d1), (m2, d2) = stats(matrix[ref]), stats(matrix[~ref])
    want = {
        "signal.to.noise": (m1 - m2) / (d1 + d2),
        "t.test": (m1 - m2) / np.sqrt(d1**2 / ref.sum() + d2**2 / (~ref).sum()),
        "diff.of.classes": m1 - m2,
        "ratio.of.classes": m1 / m2,
        "log.ratio.of.classes": np.log2(m1 / m2),
    }
    for metric, w in want.items():
        out = signatures.rank_metric(cells_df, long_table(spark, matrix), "cluster", metric, value="value").filter("cluster = 'a'")
        assert {r.gene: r.metric for r in out.collect()} == pytest.approx({f"g{j:02d}": w[j] for j in range(12)})
    with pytest.raises(ValueError):
        signatures.rank_metric(cells_df, cells_df, metric="signal.to.choice")


def test_gsea_test_is_repeatable_and_bounded(spark):
    rng = np.random.default_rng(11)
    ranks = sorted(rng.normal(size=100), reverse=True)
    rk = spark.createDataFrame([("x", f"g{i}", float(v), i + 1) for i, v in enumerate(ranks)], "cluster string, gene string, metric double, rank int")
    sets = spark.createDataFrame(
        [("top", f"g{i}") for i in range(12)] + [("mix", f"g{i}") for i in range(0, 100, 7)] + [("tiny", "g1")], "signature string, gene string"
    )
    a = {r.signature: r for r in signatures.gsea_test(rk, sets, nperm=200).collect()}
    b = {r.signature: r for r in signatures.gsea_test(rk, sets, nperm=200).collect()}
    assert set(a) == {"top", "mix"} and a["top"] == b["top"]
    assert a["top"].ES > 0.9 and a["top"].pval < 0.05 < a["mix"].pval
    assert all(0 < r.pval <= 1 and r.pval <= r.padj <= 1 for r in a.values())


def test_spearman_p(spark):
    rng = np.random.default_rng(12)
    v = rng.integers(0, 9, size=(11, 3)).astype(float)
    long = spark.createDataFrame([(f"d{i}", f"s{j}", float(v[i, j])) for i in range(11) for j in range(3)], "donor string, subset string, value double")
    got = {(r.subset_1, r.subset_2): (r.r, r.p) for r in signatures.spearman_matrix(long, ["s0", "s1", "s2"]).collect()}

    def rank(x):
        return np.array([(x < a).sum() + ((x == a).sum() - 1) / 2 for a in x])

    for i in range(3):
        for j in range(3):
            r, p = got[(f"s{i}", f"s{j}")]
            assert r == pytest.approx(np.corrcoef(rank(v[:, i]), rank(v[:, j]))[0, 1])
            assert (p is None) == (i == j)


def test_downsample(spark):
    df = spark.range(1000).select(F.col("id").alias("cell"), (F.col("id") % 3).cast("string").alias("cluster"))
    a = {r.cell for r in cells.downsample_group(df, "cluster", 20).collect()}
    b = {r.cell for r in cells.downsample_group(df.repartition(7), "cluster", 20).collect()}
    assert a == b and len(a) == 60
    assert cells.downsample_group(df, "cluster", 10_000).count() == 1000
    assert cells.downsample_group(df, None, 33).count() == 33
    assert 20 < cells.sample_share(df, 0.05).count() < 90


def test_pca_and_clusters(spark):
    rng = np.random.default_rng(13)
    m = np.abs(np.concatenate([rng.normal(1, 0.1, (20, 6)), rng.normal(5, 0.1, (20, 6))]))
    genes = spark.createDataFrame([(f"g{j:02d}", j + 1) for j in range(6)], "gene string, rank int")
    emb = expression.pca_embed(expression.cell_vectors(long_table(spark, m), genes), 2)
    got = {r.cell: r.cluster for r in expression.cluster_cells(emb, 2).collect()}
    assert len({got[i] for i in range(20)}) == 1 and len({got[i] for i in range(20, 40)}) == 1 and got[0] != got[39]


def test_residual_components(spark, matrix):
    """Against the singular values of the dense residuals, some of which are clipped; one gene never varies."""
    rng = np.random.default_rng(21)
    m = matrix.copy()
    n, g = m.shape
    m[3, 2], m[:, 4] = 400.0, 0.0
    a, b = rng.normal(size=n), rng.normal(size=n)
    meta = spark.createDataFrame([(i, float(a[i]), float(b[i])) for i in range(n)], "cell long, n_counts double, percent_mt double")
    genes = spark.createDataFrame([(f"g{j:02d}",) for j in range(g)], "gene string")
    emb, variances = expression.residual_components(long_table(spark, m), meta, genes, 3, clip=5.0)
    x = np.stack([np.ones(n), a, b], 1)
    keep = [j for j in range(g) if m[:, j].any()]
    res = m - x @ np.linalg.lstsq(x, m, rcond=None)[0]
    res = (res / np.where(res.std(0, ddof=1) > 0, res.std(0, ddof=1), 1))[:, keep]
    res = np.where(m[:, keep] > 0, np.clip(res, -5, 5), res)
    assert (res == 5).any()
    u, s, _ = np.linalg.svd(res, full_matrices=False)
    assert variances == pytest.approx(list(s**2 / (n - 1)), abs=1e-9)
    got = np.array([r.pca for r in emb.orderBy("cell").collect()])
    want = (u * s)[:, :3]
    want = want * np.sign((got * want).sum(0))
    assert got == pytest.approx(want, abs=1e-7)
    empty = expression.residual_components(long_table(spark, m), meta, genes.limit(0), 3)
    assert empty[1] == [] and empty[0].columns == ["cell", "pca"]

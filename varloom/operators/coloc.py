"""Colocalisation by approximate Bayes factors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.frames import first_by
from varloom.functions.logsum import ln_diff, log_sum_exp
from varloom.functions.scalars import upper_quantile_sql
from varloom.operators.intervals import locus_filter_any, partition_by_block
from varloom.sources.sinks import settle

# Prior standard deviations of effects.
PRIOR_SD = {"quant": 0.15, "cc": 0.2}
STAT_COLS = ["P", "BETA", "SE", "AF", "varbeta", "N"]


def _finite(c: str) -> Column:
    v = F.col(c)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def coloc_case1(df: DataFrame, kind: str) -> DataFrame:
    """BETA + SE rows: finite core columns, varbeta = SE**2 > 0, quant also 0 < AF < 1."""
    core = ["BETA", "SE"] + (["AF"] if kind == "quant" else [])
    missing = [c for c in core if c not in df.columns]
    if missing:
        raise ValueError(f"case 1 needs {missing}")
    df = df.filter("Chromosome IS NOT NULL AND Position IS NOT NULL")
    for c in core:
        df = df.filter(_finite(c))
    df = df.withColumn("varbeta", F.col("SE") * F.col("SE")).filter("varbeta <> 0")
    return df.filter("AF > 0 AND AF < 1") if kind == "quant" else df


def coloc_case2(df: DataFrame, kind: str, n: float | None, s: float | None = None) -> DataFrame:
    """P + AF rows: needs the sample size, and the case share for case-control."""
    if n is None or (kind == "cc" and s is None):
        raise ValueError("case 2 needs N, and the case share when kind is cc")
    df = df.filter("Chromosome IS NOT NULL AND Position IS NOT NULL")
    return df.filter(_finite("P") & _finite("AF")).filter("P > 0 AND AF > 0 AND AF < 1")


def prepare(df: DataFrame, kind: str, n: float | None = None, s: float | None = None) -> DataFrame:
    """Case 1 when BETA and SE are there, else case 2."""
    if {"BETA", "SE"} <= set(df.columns):
        return coloc_case1(df, kind)
    if {"P", "AF"} <= set(df.columns):
        return coloc_case2(df, kind, n, s)
    raise ValueError("neither (BETA, SE) nor (P, AF)")


#: What names a pair: study and cell type, locus of the study, gene (with its locus) of the cell type.
KEYS = ("dataset1", "dataset2", "Feature1", "Feature2")
SITE = ("Chromosome", "Position")


def trait_loci(
    trait: DataFrame, blocks: DataFrame, width: int = 1_000_000, threshold: float | None = 5e-8, study: str = "dataset",
) -> DataFrame:
    """The trait side: rows of a study in its loci, as dataset1 and Feature1.

    Variants are placed in LD blocks, and a study keeps only the loci in which any of its variants
    reaches the threshold (None keeps all).
    """
    placed = partition_by_block(trait, blocks, width=width)
    if threshold is not None:
        placed = locus_filter_any(placed, "P", threshold, [study, "Loci"])
    return placed.withColumnsRenamed({study: "dataset1", "Loci": "Feature1"})


def qtl_loci(
    qtl: DataFrame, blocks: DataFrame, trait: DataFrame, width: int = 1_000_000, cell: str = "CELL", gene: str = "GENEID",
) -> DataFrame:
    """The QTL side: rows of a cell type at sites that the trait side keeps, as dataset2 and Feature2 = gene_locus.

    Blocks are looked up once for every site of the trait, and not for every QTL row.
    """
    sites = partition_by_block(trait.select(*SITE).distinct(), blocks, width=width)
    placed = qtl.join(sites, list(SITE))
    return placed.withColumn("Feature2", F.concat_ws("_", gene, "Loci")).withColumnRenamed(cell, "dataset2").drop("Loci")


def _side(df: DataFrame, i: int, keys: list[str]) -> DataFrame:
    stats = [c for c in STAT_COLS if c in df.columns]
    own = [c for c in (f"dataset{i}", f"Feature{i}") if c in df.columns]
    return df.select(*keys, *own, *[F.col(c).alias(f"F{i}_{c}") for c in stats])


def coloc_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row pair of two traits at the same site, with what names the pair."""
    left = _side(a, 1, [*SITE, "SNPID"])
    right = _side(b.withColumnRenamed("SNPID", "SNPID_2"), 2, [*SITE, "SNPID_2"])
    return left.join(right, list(SITE))


# rows of the first side up to which a task takes more loci
LOCUS_ROWS = 50_000


def coloc_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Variants shared by each pair of features, one row per side and variant.

    Each side is reduced to one row per (data set, feature, variant), so the pairs are what is needed
    and not the product of all rows at a site. The lowest P (then BETA) stands for a repeated variant.

    With loci (`Feature1`), the second side goes to the loci that the first has at a site, both are dealt
    by locus and matched there. All variants of a pair then lie in one task: what sums over a pair
    needs no exchange of the pairs, which are many more than the rows of the sides.
    """
    key = [*SITE, "SNPID"]

    def slim(df: DataFrame, i: int) -> DataFrame:
        order = [c for c in ("P", "BETA", "SE") if c in df.columns]
        own = [c for c in (f"dataset{i}", f"Feature{i}") if c in df.columns]
        return _side(first_by(df, [*own, *key], order), i, key)

    left, right = slim(a, 1), slim(b, 2)
    if "Feature1" not in a.columns:
        return left.join(right, key)
    here = [*key, "Feature1"]
    loci = a.select(*SITE, "Feature1").distinct()
    placed = right.join(loci, list(SITE))
    named = {"_l": [c for c in left.columns if c not in here], "_r": [c for c in right.columns if c not in key]}
    types = dict(left.dtypes) | dict(right.dtypes)
    absent = {k: F.lit(None).cast(f"struct<{','.join(f'`{c}`:{types[c]}' for c in cols)}>").alias(k) for k, cols in named.items()}
    present = {k: F.struct(*cols).alias(k) for k, cols in named.items()}
    both = left.select(*here, present["_l"], absent["_r"]).unionByName(placed.select(*here, absent["_l"], present["_r"]))
    both = both.filter(" AND ".join(f"{c} IS NOT NULL" for c in key))
    # few bytes make many pairs: as many tasks as the session sets or the rows need, and not as the bytes suggest
    parts = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.count() // LOCUS_ROWS)
    both = both.repartition(parts, "Feature1")
    met = both.groupBy(*here).agg(F.collect_list("_l").alias("_ls"), F.collect_list("_r").alias("_rs"))
    pairs = met.select(*here, F.explode("_ls").alias("_l"), "_rs").select(*here, "_l", F.explode("_rs").alias("_r"))
    fields = {c: f"{k}.{c}" for k, cols in named.items() for c in cols} | {c: c for c in here}
    order = [*key, *left.columns[len(key):], *right.columns[len(key):]]
    return pairs.select(*[F.col(fields[c]).alias(c) for c in order])


def _named(df: DataFrame, keys: tuple[str, ...] | None) -> tuple[str, ...]:
    """The columns that name a pair: those of KEYS that the table has, unless others are given."""
    return keys or tuple(k for k in KEYS if k in df.columns)


def _sdy2(i: int, pair: Window) -> Column:
    """Squared trait sd of a pair's side: through-origin slope of 2N f(1-f) on 1/varbeta."""
    x = F.lit(1.0) / F.col(f"F{i}_varbeta")
    f = F.col(f"F{i}_AF")
    y = F.lit(2.0) * F.col(f"F{i}_N") * f * (F.lit(1.0) - f)
    return F.try_divide(F.sum(x * y).over(pair), F.sum(x * x).over(pair))


def _lbf(i: int, kind: str, by_effect: bool, n: float | None, s: float | None) -> Column:
    sd2 = F.lit(PRIOR_SD[kind] ** 2)
    if by_effect:
        v = F.col(f"F{i}_varbeta")
        w = sd2 * F.col(f"_sdy{i}") if kind == "quant" else sd2
        z2 = F.col(f"F{i}_BETA") * F.col(f"F{i}_BETA") / v
    else:
        f = F.col(f"F{i}_AF")
        info = F.lit(2.0 * n) * f * (F.lit(1.0) - f)
        v = F.lit(1.0) / (info * F.lit(s * (1 - s)) if kind == "cc" else info)
        w = sd2
        z = F.expr(upper_quantile_sql(f"(F{i}_P / 2)"))
        z2 = z * z
    r = w / (w + v)
    return F.lit(0.5) * (F.ln(F.lit(1.0) - r) + r * z2)


def abf_lbf(
    pairs: DataFrame, kinds: tuple[str, str] = ("cc", "quant"), n: tuple[float | None, float | None] = (None, None),
    s: tuple[float | None, float | None] = (None, None), keys: tuple[str, ...] | None = None,
) -> DataFrame:
    """Log approximate Bayes factors `lbf1`, `lbf2` of every variant of a pair.

    With BETA and varbeta a quantitative side takes its trait sd from the pair's own
    variants (needs AF and N), which a window sums where they lie; with P, AF the variance
    comes from N.
    """
    keys = _named(pairs, keys)
    effect = [f"F{i}_varbeta" in pairs.columns for i in (1, 2)]
    need = [i for i in (1, 2) if effect[i - 1] and kinds[i - 1] == "quant"]
    for i in need:
        if f"F{i}_N" not in pairs.columns:
            pairs = pairs.withColumn(f"F{i}_N", F.lit(float(n[i - 1])))
    pairs = pairs.withColumns({f"_sdy{i}": _sdy2(i, Window.partitionBy(*keys)) for i in need})
    out = pairs.withColumns(
        {f"lbf{i}": _lbf(i, kinds[i - 1], effect[i - 1], n[i - 1], s[i - 1]) for i in (1, 2)}
    )
    return out.drop("_sdy1", "_sdy2")


def coloc_abf(
    lbf: DataFrame, p1: float = 1e-4, p2: float = 1e-4, p12: float = 1e-5,
    keys: tuple[str, ...] | None = None,
) -> DataFrame:
    """Posterior of the five hypotheses per pair, and the pair's best variant.

    One pass over the variants; pairs without shared variants do not appear. PPH3 is 0
    and the ratio null for a single-variant pair. Ties for the best variant go to the
    lower SNPID.
    """
    keys = _named(lbf, keys)
    both = F.col("lbf1") + F.col("lbf2")
    top = F.struct((-both).alias("neg"), *[F.col(c) for c in ("SNPID", "Chromosome", "Position")])
    g = log_sum_exp(
        lbf, list(keys), {"s1": F.col("lbf1"), "s2": F.col("lbf2"), "s12": both},
        extra=[F.count("*").alias("_n"), F.min(top).alias("_top")],
        merge=[F.sum("_n").alias("nsnps"), F.min("_top").alias("_top")],
    )
    ln = lambda v: F.ln(F.lit(v))
    h = {
        "l0": F.lit(0.0),
        "l1": ln(p1) + F.col("s1"),
        "l2": ln(p2) + F.col("s2"),
        "l3": ln(p1) + ln(p2) + F.when(F.col("nsnps") > 1, ln_diff(F.col("s1") + F.col("s2"), F.col("s12"))),
        "l4": ln(p12) + F.col("s12"),
    }
    g = g.withColumns(h)
    g = g.withColumn("_m", F.greatest(*h))
    # null l3 means no mass there
    w = {i: F.coalesce(F.exp(F.col(f"l{i}") - F.col("_m")), F.lit(0.0)) for i in range(5)}
    g = g.withColumns({f"_w{i}": c for i, c in w.items()})
    total = sum((F.col(f"_w{i}") for i in range(1, 5)), F.col("_w0"))
    g = g.withColumns({f"PPH{i}": F.col(f"_w{i}") / total for i in range(5)})
    return g.select(
        *keys, "_top.Chromosome", "nsnps", *[f"PPH{i}" for i in range(5)],
        F.try_divide("PPH4", "PPH3").alias("PPH4_PPH3"),
        F.col("_top.SNPID").alias("SNPID"), F.col("_top.Position").alias("Position"),
        F.exp(-F.col("_top.neg") - F.col("s12")).alias("SNP_PP_H4"), F.lit("abf").alias("METHOD"),
        F.col("s12").alias("_s12"),
    )


def coloc_full(lbf: DataFrame, summary: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """All variants of all pairs with SNP.PP.H4 and the pair's posteriors.

    `summary` has one row a pair; it is put to the pair's variants, and a window hands it to them, so
    variants that lie by locus stay there. Variants of a pair without a name or a summary are left out.
    """
    keys = _named(lbf, keys)
    pp = [*[f"PPH{i}" for i in range(5)], "PPH4_PPH3", "METHOD", "_s12"]
    own = [c for c in lbf.columns if c not in keys]
    variants = lbf.select(*keys, F.struct(*own).alias("_v"))
    pairs = summary.select(*keys, F.struct(*pp).alias("_p"))
    both = variants.unionByName(pairs, allowMissingColumns=True)
    both = both.withColumn("_p", F.max("_p").over(Window.partitionBy(*keys))).filter("_v IS NOT NULL AND _p IS NOT NULL")
    both = both.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(*keys, "_v.*", "_p.*")
    return both.withColumn("SNP_PP_H4", F.exp(F.col("lbf1") + F.col("lbf2") - F.col("_s12"))).drop("_s12", "lbf1", "lbf2")


# Colocalisation method registry.
METHODS: dict[str, Callable[..., DataFrame]] = {"abf": coloc_abf}


def colocalise(
    trait: DataFrame, qtl: DataFrame, blocks: DataFrame, kinds: tuple[str, str] = ("cc", "quant"),
    n: tuple[float | None, float | None] = (None, None), s: tuple[float | None, float | None] = (None, None),
    threshold: float | None = 5e-8, width: int = 1_000_000, method: str = "abf", **priors: float,
) -> tuple[DataFrame, DataFrame]:
    """(Bayes factors of all shared variants, posteriors per pair) of all studies against all cell types.

    From association rows (dataset, variant, statistics) and QTL rows (CELL, GENEID, variant, statistics):
    loci with a hit, QTLs at their sites, shared variants, Bayes factors, posteriors. The rows of the
    factors are many times the input and are not written; the sides are.
    """
    side1 = settle(trait_loci(prepare(trait, kinds[0], n[0], s[0]), blocks, width, threshold))
    side2 = qtl_loci(prepare(qtl, kinds[1], n[1], s[1]), blocks, side1, width)
    lbf = abf_lbf(coloc_intersect(side1, side2), kinds, n, s)
    return lbf, METHODS[method](lbf, **priors)


def coloc_min_p12(
    summary: DataFrame, p1: float = 1e-4, p2: float = 1e-4, p12: float = 1e-5, points: int = 100
) -> DataFrame:
    """Smallest p12 of a log grid from p1*p2 to min(p1, p2) with H4 > 0.5.

    Only for pairs with PPH4 >= 0.5; the prior of H0 shrinks as p12 grows. H4 beats the
    rest where slope * p12 > rest, which is linear, so the grid point is computed and
    not searched. It must be over by a billionth: pairs of two variants with equal factors tie
    at p1 * p2.
    """
    lo, hi = math.log10(p1 * p2), math.log10(min(p1, p2))
    step = (hi - lo) / (points - 1)
    n = F.col("nsnps").cast("double")
    free = F.lit(1.0) - n * (p1 + p2) - n * (n - 1) * (p1 * p2)
    scale = F.col("PPH0") / (free - n * p12)
    slope = F.col("PPH4") / p12 + scale * n
    rest = (scale * free + F.col("PPH1") + F.col("PPH2") + F.col("PPH3")) * (1 + 1e-9)
    first = F.pow(F.lit(10.0), F.lit(lo))
    # index of the first grid point strictly above rest / slope
    index = F.greatest(F.floor((F.log10(rest / slope) - lo) / step) + 1, F.lit(0))
    above = F.when(rest <= 0, first).when(index < points, F.pow(F.lit(10.0), F.lit(lo) + index * step))
    value = F.when(slope > 0, above).otherwise(F.when(slope * first > rest, first))
    return summary.withColumn("min_p12", F.when(F.col("PPH4") >= 0.5, value))


def filter_coloc(df: DataFrame, pp: float = 0.5, ratio: float = 5.0) -> DataFrame:
    """PPH4 and PPH4/PPH3 thresholds; a null ratio (PPH3 = 0) passes."""
    r = F.col("PPH4_PPH3")
    return df.filter((F.col("PPH4") >= pp) & (r.isNull() | (r >= ratio)))

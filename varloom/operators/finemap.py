"""Gene z-scores and single-effect fine-mapping of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.frames import tiled_running
from varloom.functions.logsum import STEP, log_sum_exp
from varloom.sources.sinks import release, settle


def group_size_filter(df: DataFrame, n: int = 100, group: str = "grp", unit: str | None = None) -> DataFrame:
    """Drop groups with fewer than n rows (or distinct units)."""
    size = F.count_distinct(unit) if unit else F.count("*")
    big = settle(df.groupBy(group).agg(size.alias("_n")).filter(F.col("_n") >= n).select(group))
    return df.join(big, group, "left_semi")


def gene_z(weights: DataFrame, z: DataFrame, ld: DataFrame, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """z_gene = sum(w z) / sqrt(w' R w).

    `ld` is the upper triangle (id1 <= id2, r) including the diagonal; off-diagonal
    terms count twice. Both sums run over the variants that have a z-score in the study,
    and the variance is joined along existing pairs only.
    """
    key = ["gene", "type", "context"]

    def whole(df: DataFrame, *columns: str) -> DataFrame:
        """Rows without a null there: those with one have no variance."""
        return df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))

    z = whole(z, *by, "id", "z").repartition("id")
    studies = z.groupBy("id", *by).agg(F.sum("z").alias("_z"), F.count("*").alias("_n"))
    studies = studies.groupBy("id").agg(F.collect_list(F.struct(*by, "_z", "_n")).alias("_studies"))
    # equal rows of a gene and variant are one, by the sort that the join on the variant needs
    same = Window.partitionBy("id", *key).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = whole(weights, *key, "id").select(*key, "id", "weight").repartition("id")
    w = w.select(
        *key, "id", F.sum("weight").over(same).alias("_w"), F.count(F.lit(1)).over(same).alias("_m"),
        F.row_number().over(Window.partitionBy("id", *key).orderBy("id")).alias("_k"),
    ).filter("_k = 1")
    w = w.groupBy("id").agg(F.collect_list(F.struct(*key, "_w", "_m", F.xxhash64(*key).alias("_h"))).alias("_weights"))
    pairs = whole(ld.select("id1", "id2", "r"), "id1", "id2")
    own = pairs.filter("id1 = id2").groupBy(F.col("id1").alias("id")).agg(F.sum("r").alias("_r"), F.count("*").alias("_own"))
    # a row a variant, written once: its weights, its studies and its pair with itself
    variants = settle(w.join(studies, "id").join(own, "id", "left"))

    # a weight is dealt by its gene once, with its studies
    here = variants.select(F.inline("_weights"), "_r", "_own", "_studies").drop("_h")
    here = here.repartition(*key).select(*key, "_w", "_m", "_r", "_own", F.inline("_studies"))
    sums = here.groupBy(*by, *key).agg(
        F.sum(F.col("_w") * F.col("_z")).alias("_num"), F.sum(F.col("_m") * F.col("_n")).alias("n_snps"),
        F.sum(F.col("_w") * F.col("_r") * F.col("_w")).alias("_own_den"), F.sum("_own").alias("_owns"),
    )

    # pairs of different variants: the hashes of their genes tell which can share one, and only those meet the weights
    sets = variants.select("id", F.col("_weights._h").alias("_hs"))
    shared = settle(
        pairs.filter("id1 <> id2")
        .join(sets.toDF("id1", "_h1"), "id1")
        .join(sets.toDF("id2", "_h2"), "id2")
        .select("id1", "id2", "r", F.explode(F.array_intersect("_h1", "_h2")).alias("_h"))
    )
    each = variants.select("id", F.inline("_weights")).drop("_m")
    of = variants.select("id", F.transform("_studies", lambda s: F.struct(*[s[c].alias(c) for c in by])).alias("_in"))
    left, right = (each.withColumnsRenamed({"id": f"id{k}", "_w": f"_w{k}"}) for k in (1, 2))
    others = (
        shared.join(left, ["id1", "_h"])
        .join(right, ["id2", "_h", *key])
        .join(of.toDF("id1", "_in1"), "id1")
        .join(of.toDF("id2", "_in2"), "id2")
        .select(*key, (F.lit(2.0) * F.col("_w1") * F.col("r") * F.col("_w2")).alias("_d"), F.inline(F.array_intersect("_in1", "_in2")))
        .groupBy(*by, *key)
        .agg(F.sum("_d").alias("_den"), F.count("*").alias("_pairs"))
    )
    both = sums.join(others, [*by, *key], "left").filter("_owns > 0 OR _pairs > 0")
    den = F.coalesce(F.col("_own_den") + F.col("_den"), "_own_den", "_den")
    z_value = F.when(den > 0, F.col("_num") / F.sqrt(den))
    return both.select(*by, *key, "n_snps", z_value.alias("z"))


def ln_bf(z: Column, var: Column) -> Column:
    """Log Bayes factor of a unit-variance z-score under N(0, var) effects."""
    return F.lit(-0.5) * F.ln(F.lit(1.0) + var) + F.lit(0.5) * z * z * var / (F.lit(1.0) + var)


def _posterior(df: DataFrame, prior: DataFrame, region: list[str]) -> DataFrame:
    """Rows with `_lw` (log prior x BF), the region's ln sum and the single-effect pip.

    The priors, a row a group, are written: Spark then knows that rows need not be dealt by group.
    """
    rows = df.join(settle(prior.select("grp", "pi", "var")), "grp").withColumn(
        "_lw", F.ln("pi") + ln_bf(F.col("z"), F.col("var"))
    )
    total = settle(log_sum_exp(rows, region, {"_ls": F.col("_lw")}))
    release(df.sparkSession)
    # ln(1 + sum w), the 1 being "no effect in the region"
    top = F.greatest(F.col("_ls"), F.lit(0.0))
    total = total.withColumn("_lt", top + F.ln(F.exp(F.col("_ls") - top) + F.exp(-top)))
    return rows.join(total, region).withColumn("pip", F.exp(F.col("_lw") - F.col("_lt")))


# Which groups share one effect variance.
STRUCTURES = ("shared_all", "shared_type", "shared_context", "shared_nonSNP", "independent")


def variance_tie(structure: str) -> Column:
    """The name under which a row's group shares its effect variance; needs `type` or `context` where that decides."""
    if structure not in STRUCTURES:
        raise ValueError(f"structure is one of {STRUCTURES}")
    snp = F.col("grp") == "SNP"
    shared = {
        "shared_all": F.lit("all"), "shared_nonSNP": F.lit("nonSNP"), "independent": F.col("grp"),
        **({structure: F.col(structure[7:])} if structure in ("shared_type", "shared_context") else {}),
    }[structure]
    return shared if structure == "shared_all" else F.when(snp, F.lit("SNP")).otherwise(shared)


def _em(z: DataFrame, params: dict, passes: int, tol: float | None, region: list[str]) -> dict:
    """{group: (tie, pi, var)} after so many passes, or fewer once no value changes by more than `tol` of it.

    A pass reads `z`, which lies by region, and sums weights per (region, group) and then per region without
    an exchange: exponents are cut into steps, so that no sum overflows. A row per group and tie
    comes to the driver, which ties the variances.
    """
    for _ in range(passes):
        of = {k: F.create_map(*[F.lit(x) for g, p in params.items() for x in (g, p[k])])[F.col("grp")] for k in (1, 2)}
        shrink = of[2] / (F.lit(1.0) + of[2])
        lw = F.ln(of[1]) + ln_bf(F.col("z"), of[2])
        mean = F.col("z") * shrink
        rows = z.select("grp", *region, lw.alias("_lw"), (mean * mean + shrink).alias("_m2")).withColumn("_b", F.floor(F.col("_lw") / STEP))
        w = F.exp(F.col("_lw") - F.col("_b") * STEP)
        sums = rows.groupBy(*region, "grp", "_b").agg(F.count("*").alias("n"), F.sum(w).alias("_s"), F.sum(w * F.col("_m2")).alias("_v"))
        here = Window.partitionBy(*region)  # groups times a few steps
        top = F.max("_b").over(here)
        scale = F.exp((F.col("_b") - F.col("_top")) * STEP)
        sums = sums.withColumn("_top", top).withColumn("_s", F.col("_s") * scale).withColumn("_v", F.col("_v") * scale)
        total = F.exp(-F.col("_top") * STEP) + F.sum("_s").over(here)
        sums = sums.withColumn("_t", total).groupBy("grp").agg(
            F.sum("n").alias("n"), F.sum(F.col("_s") / F.col("_t")).alias("s"), F.sum(F.col("_v") / F.col("_t")).alias("v")
        )
        got = {r["grp"]: r for r in sums.collect()}
        tied: dict = {}
        for g, (tie, _, _) in params.items():
            if g in got:
                s, v = tied.get(tie, (0.0, 0.0))
                tied[tie] = (s + got[g]["s"], v + got[g]["v"])
        new = {}
        for g, (tie, pi, var) in params.items():
            s, v = tied.get(tie, (0.0, 0.0))
            new[g] = (tie, max(got[g]["s"] / got[g]["n"], 1e-12) if g in got else pi, max(v / s, 1e-6) if s > 0 else var)
        still = tol is not None and all(abs(new[g][k] - params[g][k]) <= tol * params[g][k] for g in params for k in (1, 2))
        params = new
        if still:
            break
    return params


def single_effect_regions(z: DataFrame, params: dict, least: float, region: list[str]) -> DataFrame:
    """Regions that hold no effect or one with probability `least` or more, by the inclusion priors."""
    pi = F.create_map(*[F.lit(x) for g, p in params.items() for x in (g, p[1])])[F.col("grp")]
    per = z.groupBy(*region).agg(F.sum(F.log1p(-pi)).alias("_none"), F.sum(pi / (1 - pi)).alias("_odds"))
    return per.filter(F.exp("_none") * (1 + F.col("_odds")) >= least).select(*region)


def est_group_prior(
    df: DataFrame, structure: str = "shared_all", prefit: int = 3, iters: int = 150, min_group_size: int = 100, min_var: int = 2,
    min_gene: int = 1, min_p_single: float = 0.8, pi0: float = 0.01, var0: float = 10.0, tol: float = 1e-4,
    region: tuple[str, ...] = ("region_id",),
) -> DataFrame:
    """(grp, pi, var): EM for the prior inclusion of each group and the effect variances.

    `structure` says which groups share a variance: all of them, those of a `type` or `context`, all
    but variants, or none. Groups under `min_group_size` rows are left out, then regions with
    fewer than `min_var` rows or `min_gene` genes. After `prefit` passes only regions stay that have at most one
    effect with probability `min_p_single`; from there at most `iters` passes follow, fewer once all
    parameters change by less than `tol` of their value. One effect per region. Rows without z are
    not counted; no rows give none. Only a row per group comes back between passes, and each starts
    from the cached z table, so the plan does not grow and a lost executor only costs its cached part.
    """
    spark, keys = df.sparkSession, list(region)
    schema = "grp string, pi double, var double"
    tie = variance_tie(structure)
    rows = df.filter("z IS NOT NULL").select("grp", tie.alias("tie"), "z", *keys)
    rows = group_size_filter(rows, min_group_size, "grp")
    # dealt by region once; a null is no region
    here = Window.partitionBy(*keys)
    rows = rows.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).repartition(*keys).withColumns(
        {"_n": F.count("*").over(here), "_g": F.count_if(F.col("grp") != "SNP").over(here)}
    )
    z = rows.filter((F.col("_n") >= min_var) & (F.col("_g") >= min_gene)).drop("_n", "_g").persist()
    params = {r["grp"]: (r["tie"], pi0, var0) for r in z.select("grp", "tie").distinct().collect()}
    if not params:
        z.unpersist()
        return spark.createDataFrame([], schema)
    params = _em(z, params, prefit, None, keys)
    # both sides lie by region
    single = z.join(single_effect_regions(z, params, min_p_single, keys), keys, "left_semi").persist()
    single.count()
    z.unpersist()
    release(spark)
    params = _em(single, params, iters, tol, keys)
    single.unpersist()
    return spark.createDataFrame([(g, p[1], p[2]) for g, p in sorted(params.items())], schema)


def region_pip(
    df: DataFrame, prior: DataFrame, coverage: float = 0.95, region: tuple[str, ...] = ("region_id",)
) -> DataFrame:
    """Single-effect inclusion probability of every variant and gene, and the credible set.

    `alpha` is the share within the region given an effect there; `cs` marks the
    smallest set, by alpha, that reaches the coverage (ties by id). The cumulative sum
    runs over bands of alpha, so a region's rows are never sorted in one task. `df` is read twice;
    the rows with their alpha are written for the sum, which reads them twice.
    """
    keys = list(region)
    rows = _posterior(df, prior, keys).withColumn("alpha", F.exp(F.col("_lw") - F.col("_ls")))
    rows = settle(rows.drop("_lw", "_ls", "_lt", "pi", "var"))
    release(df.sparkSession)
    band = F.floor(-F.ln(F.greatest(F.col("alpha"), F.lit(1e-300))) * 10)
    out = tiled_running(
        rows, keys, band, [F.desc("alpha"), F.col("id"), F.col("grp")], {"_before": ("sum", F.col("alpha"))}, inclusive=False
    )
    return out.withColumn("cs", F.col("_before") < coverage).drop("_before")


def screen_regions(df: DataFrame, threshold: float = 0.5, region: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """Rows of the regions whose non-variant inclusion probability reaches the threshold."""
    df = settle(df)
    release(df.sparkSession)
    mass = F.sum(F.when(F.col("grp") != "SNP", F.col("pip")).otherwise(0.0))
    kept = df.groupBy(*region).agg(mass.alias("nonSNP_PIP")).filter(F.col("nonSNP_PIP") >= threshold)
    return df.join(kept, list(region))


def region_screen_table(df: DataFrame, region: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """Per region: numbers of genes and variants, largest |z| of each, non-variant PIP."""
    snp = F.col("grp") == "SNP"
    az = F.abs("z")
    return df.groupBy(*region).agg(
        F.count_if(~snp).alias("n_gids"), F.count_if(snp).alias("n_sids"),
        F.max(F.when(~snp, az)).alias("max_gene_absZ"), F.max(F.when(snp, az)).alias("max_snp_absZ"),
        F.sum(F.when(~snp, F.col("pip")).otherwise(0.0)).alias("nonSNP_PIP"),
    )


def filter_pip(df: DataFrame, threshold: float = 0.7, column: str = "susie_pip") -> DataFrame:
    return df.filter(F.col(column) > threshold)


def gene_annotate(df: DataFrame, genes: DataFrame, key: str = "GENEID") -> DataFrame:
    """Gene name and mid position; unmapped genes stay."""
    g = genes.select(
        key, "GENENAME", F.col("Chromosome").alias("gene_chrom"),
        F.floor((F.col("Start") + F.col("End_")) / 2).alias("gene_pos"),
    )
    return df.join(g, key, "left")


def ld_long_extract(ld: DataFrame, ids: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Upper triangle with diagonal for the kept variants; then the gene of each row.

    `genes` is (gene, varID); a variant of several genes gives a row for each pair it
    forms within a gene.
    """
    keep = ids.select("varID").distinct()
    out = (
        ld.filter(F.col("id1") <= F.col("id2"))
        .join(keep.withColumnRenamed("varID", "id1"), "id1", "left_semi")
        .join(keep.withColumnRenamed("varID", "id2"), "id2", "left_semi")
    )
    if genes is None:
        return out
    a = genes.select("gene", F.col("varID").alias("id1")).distinct()
    b = genes.select("gene", F.col("varID").alias("id2")).distinct()
    return out.join(a, "id1").join(b, ["gene", "id2"], "left_semi")


def weights_from_qtl(qtl: DataFrame, genes: DataFrame, ld: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, genes, covariances) of a QTL table with columns gene, varID, weight."""
    known = genes.select("gene").distinct()
    weights = qtl.join(known, "gene", "left_semi")
    extra = genes.join(weights.select("gene"), "gene", "left_semi").distinct()
    n = weights.groupBy("gene").agg(F.count("*").alias("n_snps"))
    cov = ld_long_extract(ld, weights, weights.select("gene", "varID"))
    return weights, extra.join(n, "gene"), cov


def heritability_share(df: DataFrame, by: tuple[str, ...] = ("group_label",), value: str = "pve", category: str = "category") -> DataFrame:
    """Share of each category and its `NN%` label."""
    total = df.groupBy(*by).agg(F.sum(value).alias("_t"))
    share = F.try_divide(F.col(value), F.col("_t"))
    return df.join(total, list(by)).select(
        *by, category, share.alias("percentage"),
        F.concat(F.round(share * 100, 0).cast("long").cast("string"), F.lit("%")).alias("percentage_label"),
    )


def param_long(df: DataFrame, categories: list[str]) -> DataFrame:
    """One row per (group_label, name, category); total PVE repeats as an SNP row.

    `df` has group_label, name and one column per category; total_pve sits in rows
    without a name.
    """
    long = df.unpivot(["group_label", "name"], categories, "category", "score").filter("score IS NOT NULL")
    totals = long.filter("category = 'total_pve'").withColumn("name", F.lit("SNP"))
    out = long.filter("name IS NOT NULL").unionByName(totals)
    label = F.when(F.col("name") == "SNP", F.concat_ws("_", "name", "group_label")).otherwise(
        F.concat(F.lit("gene_"), "group_label")
    )
    return out.withColumn("label", label)


def param_long_wide(df: DataFrame, categories: list[str]) -> DataFrame:
    """The long parameters as label x category."""
    return param_long(df, categories).groupBy("label").pivot("category", categories).agg(F.max("score"))

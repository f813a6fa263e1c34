"""Inputs and regressions for heritability estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.frames import first_by, tiled_running
from varloom.functions.linear import dot, solve
from varloom.functions.scalars import chr_order, midpoint, strand_ambiguous, z_from_p
from varloom.operators.ld import windowed_scores
from varloom.operators.signatures import t_two_sided
from varloom.sources.sinks import settle


def munge(df: DataFrame, n: float | None = None, by: tuple[str, ...] = ("dataset",), maf: float = 0.01) -> DataFrame:
    """Valid, unambiguous, unique variants with N and a signed Z.

    Keeps 0 < P <= 1, single-nucleotide alleles, minor allele frequency over `maf`; a
    repeated variant keeps its lowest P.
    """
    ok = (F.col("P") > 0) & (F.col("P") <= 1) & F.col("NEA").isin(*"ACGT") & F.col("EA").isin(*"ACGT")
    ok &= (F.col("NEA") != F.col("EA")) & ~strand_ambiguous(F.col("NEA"), F.col("EA"))
    df = df.filter(ok).filter("RSID IS NOT NULL AND BETA IS NOT NULL")
    if "AF" in df.columns:
        f = F.col("AF")
        df = df.filter(f.isNull() | (F.least(f, 1 - f) > maf))
    if "N" not in df.columns:
        df = df.withColumn("N", F.lit(float(n)))
    df = first_by(df, [*by, "RSID"], ["P", "EA", "BETA"])
    return df.select(
        *by, F.col("RSID").alias("SNP"), F.col("EA").alias("A1"), F.col("NEA").alias("A2"), "N",
        z_from_p("P", "BETA").alias("Z"),
    )


def ld_score(ld: DataFrame, annot: DataFrame, labels: list[str]) -> DataFrame:
    """l2 of each variant per annotation: sum of bias-corrected r2 over its neighbours.

    `annot` is (LD, label, value); r2 is corrected by (1 - r2) / (n - 2) with the number of
    donors `n` of the pair. Pairs of two donors or fewer are left out.
    """
    ld = ld.filter("n > 2")
    adj = F.col("r2") - (F.lit(1.0) - F.col("r2")) / (F.col("n") - 2)
    joined = ld.join(annot, "LD")
    return joined.groupBy("Lead").agg(
        *[F.sum(F.when(F.col("label") == x, adj * F.col("value")).otherwise(0.0)).alias(f"l2_{x}") for x in labels]
    )


def gene_bins(qtl: DataFrame, bins: int = 5, by: tuple[str, ...] = ("CELL",), chrom: str = "Chromosome") -> DataFrame:
    """(by, chrom, GENEID, h2cis, bin): genes cut into `bins` by cis heritability.

    A gene's cis heritability is its sum of squared effects; it is ranked among the genes of its data
    set and chromosome, which the expression scores are made for one by one.
    """
    keys = [*by, chrom]
    h2 = qtl.groupBy(*keys, "GENEID").agg(F.sum(F.col("BETA") * F.col("BETA")).alias("h2cis"))
    order = Window.partitionBy(*keys).orderBy(F.round("h2cis", 9), "GENEID")
    return h2.withColumn("bin", F.ntile(bins).over(order))


def gene_counts(binned: DataFrame, by: tuple[str, ...] = ("CELL",), chrom: str = "Chromosome") -> DataFrame:
    """(by, chrom, bin, G, ave_h2cis): genes of a bin and their mean cis heritability."""
    return binned.groupBy(*by, chrom, "bin").agg(F.count("*").alias("G"), F.avg("h2cis").alias("ave_h2cis"))


def effect_sizes(qtl: DataFrame, binned: DataFrame, by: tuple[str, ...] = ("CELL",), chrom: str = "Chromosome") -> DataFrame:
    """(by, LD, bin, value): squared effects on the genes of a bin, summed per variant."""
    keys = [*by, chrom, "GENEID"]
    eff = qtl.select(*keys, F.col("SNPID").alias("LD"), (F.col("BETA") * F.col("BETA")).alias("_b2"))
    return eff.join(binned.select(*keys, "bin"), keys).groupBy(*by, "LD", "bin").agg(F.sum("_b2").alias("value"))


def expression_sets(
    qtl: DataFrame, packed: DataFrame, cells: list[str], bins: int = 5, reach: float = 1.0, cell: str = "CELL",
) -> DataFrame:
    """(Lead, sets): a variant's expression score in every gene bin of every data set, in the order of `cells`.

    The score of a bin sums r2 * effect**2 over the bin's QTLs within `reach` cM; `packed` is one row
    a variant with its donor words. `sets` holds an array by bin for each of `cells`.
    """
    values = effect_sizes(qtl, gene_bins(qtl, bins, (cell,)), (cell,)).filter(F.col(cell).isin(cells))
    labels = {(c, b): f"{i}_{b}" for i, c in enumerate(cells) for b in range(1, bins + 1)}
    number = F.create_map(*[x for i, c in enumerate(cells) for x in (F.lit(c), F.lit(i))]) if cells else F.lit(None)
    values = values.select("LD", F.concat_ws("_", number[F.col(cell)], "bin").alias("label"), "value")
    wide = windowed_scores(packed, values, list(labels.values()), reach, correct=False)
    return wide.select("Lead", F.array(*[F.array(*[F.col(f"l2_{labels[c, b]}") for b in range(1, bins + 1)]) for c in cells]).alias("sets"))


def expression_score(
    qtl: DataFrame, packed: DataFrame, cells: list[str], bins: int = 5, reach: float = 1.0, cell: str = "CELL",
) -> DataFrame:
    """(Lead, cell, scores): `expression_sets` with a row for each of `cells`; `scores` is an array by bin."""
    wide = expression_sets(qtl, packed, cells, bins, reach, cell)
    per = [F.struct(F.lit(c).alias(cell), F.get("sets", i).alias("scores")) for i, c in enumerate(cells)]
    return wide.select("Lead", F.inline(F.array(*per)))


def annotation_counts(
    variants: DataFrame, annot: DataFrame, sets: dict[str, list[str]], low: float = 0.05, key: str = "model",
) -> DataFrame:
    """(key, M, overlap, M_total): variants of each annotation and of each pair, for sets of annotations.

    `variants` is (SNPID, AF) and counts those of `low` < AF < 1 - `low`; `annot` is (LD, label, value).
    `sets` names the annotations of each model; M and the rows of `overlap` follow its order.
    """
    labels = sorted({x for some in sets.values() for x in some})
    wide = annot.groupBy(F.col("LD").alias("_v")).agg(
        *[F.sum(F.when(F.col("label") == x, F.col("value")).otherwise(0)).cast("double").alias(f"_y{i}") for i, x in enumerate(labels)]
    )
    # a row a variant on both sides, which is too much to broadcast however few bytes its file has
    rows = variants.filter((F.col("AF") > low) & (F.col("AF") < 1 - low)).join(wide.hint("merge"), F.col("SNPID") == F.col("_v"), "left")
    at = {x: F.coalesce(f"_y{i}", F.lit(0.0)) for i, x in enumerate(labels)}
    pairs = sorted({(min(a, b), max(a, b)) for some in sets.values() for a in some for b in some})
    col = {p: f"_p{i}" for i, p in enumerate(pairs)}
    one = rows.agg(
        F.count("*").cast("double").alias("M_total"),
        *[F.coalesce(F.sum(at[x]), F.lit(0.0)).alias(f"_m{i}") for i, x in enumerate(labels)],
        *[F.coalesce(F.sum(at[a] * at[b]), F.lit(0.0)).alias(c) for (a, b), c in col.items()],
    )
    entry = [
        F.struct(
            F.lit(name).alias(key), F.array(*[F.col(f"_m{labels.index(x)}") for x in some]).alias("M"),
            F.array(*[F.array(*[F.col(col[min(a, b), max(a, b)]) for b in some]) for a in some]).alias("overlap"),
        )
        for name, some in sets.items()
    ]
    return one.select("M_total", F.inline(F.array(*entry))).select(key, "M", "overlap", "M_total")


def coefficients(
    df: DataFrame, scores: list[str], by: list[str], blocks: int = 200, m_snps: Column | float | None = None,
    weight: str | None = None, chi_limit: bool = False,
) -> DataFrame:
    """(by, block, coef): regression of chi-square on scores, for all rows (block -1) and without each block.

    `df` has `by`, Chromosome, Position, Z, N and the score columns, and an id (SNP) if several
    variants share a position, so that blocks do not depend on the order of ties. A row weighs
    1 / (w (1 + N h2 l2 / M)^2) with its total score l2, its regression weight score w (`weight`, or l2
    itself) and the h2 that the means give; l2 and w are 1 at least. Scores go in as N l2 / mean(N), so
    coefficients are per variant times mean(N), which `coef` divides out: its first entry is the
    intercept, the others are per variant. `chi_limit` leaves out chi-squares of
    max(0.001 max(N), 80) and more.

    Rows are summed per group and block in Spark (blocks of equal count in genome order, numbered by
    a tiled running count), and the k x k systems are solved in array columns of those sums. A group
    with fewer rows than blocks or coefficients gives none.
    """
    k = len(scores) + 1
    ids = [c for c in ("SNP",) if c in df.columns]
    m_col = m_snps if isinstance(m_snps, Column) else F.lit(None if m_snps is None else float(m_snps))
    base = df.select(
        *by, *ids, "Chromosome", "Position", (F.col("Z") * F.col("Z")).alias("chi2"), F.col("N").cast("double").alias("N"),
        *[F.col(s).alias(f"_s{i}") for i, s in enumerate(scores)], (F.col(weight) if weight else F.lit(0.0)).alias("_wl"),
        m_col.cast("double").alias("_ms"),
    )
    l2 = sum((F.col(f"_s{i}") for i in range(1, len(scores))), F.col("_s0"))
    base = settle(base.dropna(subset=[c for c in base.columns if c != "_ms"]).withColumn("_l2", l2))
    if chi_limit:
        # a row a group, as are the totals: written, their size is known and the rows stay where they are
        limit = settle(base.groupBy(*by).agg(F.greatest(0.001 * F.max("N"), F.lit(80.0)).alias("_limit")))
        base = base.join(limit, by).filter("chi2 < _limit").drop("_limit")
    totals = base.groupBy(*by).agg(
        F.count("*").alias("_m"), F.avg("chi2").alias("_chi"), F.avg(F.col("_l2") * F.col("N")).alias("_aln"), F.avg("N").alias("_an"),
    ).filter((F.col("_m") >= blocks) & (F.col("_m") > k))
    totals = settle(totals)
    tile = chr_order("Chromosome") * 1_000_000 + F.floor(F.col("Position") / 1_000_000)
    ranked = tiled_running(base, by, tile, ["Chromosome", "Position", *ids], {"_rank": ("sum", F.lit(1))}).join(totals, by)
    number = F.floor((F.col("_rank") - 1) * blocks / F.col("_m")).cast("int")
    return _left_out(ranked.withColumn("block", number), len(scores), by, weight is not None)


def _left_out(ranked: DataFrame, n_scores: int, by: list[str], weighted: bool) -> DataFrame:
    """(by, block, coef) from rows with their block and the sums of their group; see `coefficients`."""
    k = n_scores + 1
    m = F.coalesce("_ms", F.col("_m").cast("double"))
    h2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("_chi") - 1) * m, F.col("_aln"))))
    ld = F.greatest("_l2", F.lit(1.0))
    het = F.lit(1.0) + F.col("N") * h2 * ld / m
    w = F.lit(1.0) / ((F.greatest("_wl", F.lit(1.0)) if weighted else ld) * het * het)
    rows = ranked.withColumn("_w", w)
    x = [F.lit(1.0), *[F.col(f"_s{i}") * F.col("N") / F.col("_an") for i in range(n_scores)]]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    names = [*[f"y{i}" for i in range(k)], *[f"x{i}_{j}" for i, j in upper]]
    sums = rows.groupBy(*by, "block").agg(
        F.first("_an").alias("_an"), *[F.sum(F.col("_w") * x[i] * F.col("chi2")).alias(f"y{i}") for i in range(k)],
        *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"x{i}_{j}") for i, j in upper],
    )
    sums = settle(sums)
    # `blocks` rows a group
    every = Window.partitionBy(*by)
    whole = sums.groupBy(*by).agg(F.lit(-1).alias("block"), F.first("_an").alias("_an"), *[F.sum(c).alias(c) for c in names])
    left = sums.select(*by, "block", "_an", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in names])
    both = whole.unionByName(left)
    matrix = F.array(*[F.array(*[F.col(f"x{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)])
    coef = solve(matrix, F.array(*[F.col(f"y{i}") for i in range(k)]), k)
    return both.withColumn("_c", coef).select(
        *by, "block", F.transform("_c", lambda c, i: F.when(i == 0, c).otherwise(c / F.col("_an"))).alias("coef")
    )


def joint_coefficients(
    df: DataFrame, scores: list[str], own: DataFrame, cells: list[str], bins: int, by: list[str], blocks: int = 200,
    m_snps: float | None = None, weight: str | None = None, chi_limit: bool = False, cell: str = "CELL",
) -> DataFrame:
    """(by, cell, block, coef): `coefficients` on `scores` and then on the `bins` scores of each cell in `own`.

    `own` is (Lead, sets) as of `expression_sets`, a row a variant, and `df` has Lead too. Rows are dealt
    and ranked once for all cells, with the total of each cell's scores in place of these: null where the
    cell leaves the row out. The scores meet the rows last, where a row is taken apart into its cells and summed.
    """
    ids = [c for c in ("SNP",) if c in df.columns]
    ok = F.transform("sets", lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + F.when(~F.isnan(x), x)))
    names = [f"_s{i}" for i in range(len(scores))]
    base = df.select(
        "Lead", *by, *ids, "Chromosome", "Position", (F.col("Z") * F.col("Z")).alias("chi2"), F.col("N").cast("double").alias("N"),
        *[F.col(s).alias(n) for s, n in zip(scores, names)], (F.col(weight) if weight else F.lit(0.0)).alias("_wl"),
        F.lit(None if m_snps is None else float(m_snps)).cast("double").alias("_ms"),
    )
    base = base.dropna(subset=[c for c in base.columns if c != "_ms"])
    # a row a variant on the right, here and below, which is not for a broadcast
    base = settle(base.join(own.select("Lead", ok.alias("_own")).hint("merge"), "Lead"))
    each = range(len(cells))
    if chi_limit:
        # a row a group, as are the totals below
        most = [F.max(F.when(F.get("_own", i).isNotNull(), F.col("N"))) for i in each]
        limits = settle(base.groupBy(*by).agg(F.array(*[F.greatest(0.001 * m, F.lit(80.0)) for m in most]).alias("_limit")))
        kept = F.zip_with("_own", "_limit", lambda v, most: F.when(F.col("chi2") < most, v))
        base = base.join(limits, by).withColumn("_own", kept).drop("_limit")
    l2 = sum((F.col(n) for n in names[1:]), F.col(names[0])) + F.col("_v")
    totals = base.select("*", F.posexplode("_own").alias("_c", "_v")).filter("_v is not null").groupBy(*by, "_c").agg(
        F.count("*").alias("_m"), F.avg("chi2").alias("_chi"), F.avg(l2 * F.col("N")).alias("_aln"), F.avg("N").alias("_an"),
    )
    totals = settle(totals.filter((F.col("_m") >= blocks) & (F.col("_m") > len(scores) + bins + 1)))
    sizes = settle(totals.groupBy(*by).agg(F.array(*[F.max(F.when(F.col("_c") == i, F.col("_m"))) for i in each]).alias("_sizes")))
    tile = chr_order("Chromosome") * 1_000_000 + F.floor(F.col("Position") / 1_000_000)
    counts = {f"_r{i}": ("sum", F.get("_own", i).isNotNull().cast("int")) for i in each}
    ranked = tiled_running(base, by, tile, ["Chromosome", "Position", *ids], counts).join(sizes, by)
    number = [
        F.when(F.get("_own", i).isNotNull(), F.floor((F.col(f"_r{i}") - 1) * blocks / F.get("_sizes", i)).cast("int")) for i in each
    ]
    ranked = ranked.select("Lead", *by, "chi2", "N", *names, "_wl", "_ms", F.array(*number).alias("block"))
    parts = ranked.join(own.hint("merge"), "Lead").select(*by, "chi2", "N", *names, "_wl", "_ms", F.posexplode(F.arrays_zip("block", "sets")).alias("_c", "_e"))
    parts = parts.filter("_e.block is not null").join(totals, [*by, "_c"])
    some = [F.get("_e.sets", b).alias(f"_s{len(scores) + b}") for b in range(bins)]
    parts = parts.select("*", F.col("_e.block").alias("block"), F.get(F.array(*[F.lit(c) for c in cells]), F.col("_c")).alias(cell), *some)
    total = sum((F.col(f"_s{i}") for i in range(1, len(scores) + bins)), F.col("_s0"))
    return _left_out(parts.withColumn("_l2", total), len(scores) + bins, [*by, cell], weight is not None)


def jackknife(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, Quantity, Estimate, SE, blocks) from values (by, block, Quantity, value); block -1 holds the estimate.

    The standard error is that of the pseudo-values of the left-out blocks. Groups in which a value is
    null or NaN give no row.
    """
    left = F.col("block") >= 0
    n = F.count(F.when(left, F.col("value")))
    out = df.groupBy(*by, "Quantity").agg(
        F.max(F.when(~left, F.col("value"))).alias("Estimate"),
        ((n - 1) * F.stddev_samp(F.when(left, F.col("value"))) / F.sqrt(n)).alias("SE"), n.alias("blocks"),
        F.count(F.when(F.col("value").isNull() | F.isnan("value"), 1)).alias("_bad"),
    )
    return out.filter("_bad = 0 AND Estimate IS NOT NULL AND blocks > 1").drop("_bad")


def h2_regression(
    df: DataFrame, scores: list[str], blocks: int = 200, by: str = "dataset", m_snps: float | None = None, weight: str | None = None,
) -> DataFrame:
    """(by, Quantity, Estimate, SE): the intercept and the coefficient of each score times mean(N), by `coefficients`.

    Too few rows give no result for that study.
    """
    mean_n = df.groupBy(F.col(by).alias("_by")).agg(F.avg("N").alias("_an"))
    coef = coefficients(df, scores, [by], blocks, m_snps, weight).join(mean_n, F.col(by) == F.col("_by"))
    names = ["intercept", *scores]
    values = [F.struct(F.lit(q).alias("Quantity"), (F.get("coef", i) * (F.col("_an") if i else F.lit(1.0))).alias("value")) for i, q in enumerate(names)]
    return jackknife(coef.select(by, "block", F.inline(F.array(*values))), [by]).drop("blocks")


def partitioned_h2(coef: DataFrame, counts: DataFrame, names: list[str], by: list[str], key: str = "model") -> DataFrame:
    """A row per group and annotation: share of variants and of h2, enrichment, coefficient, with errors.

    `coef` comes from `coefficients` and `counts` from `annotation_counts`; `names` are the annotations
    of a model in order, the group's own one as `own` if it differs by `key`. The h2 of an annotation
    counts every variant in it with the effects of all annotations that it has. Enrichment is
    its share of h2 over its share of variants, and its p tests the effect per variant inside against
    outside, with as many degrees of freedom as blocks. All errors are block jackknifes, for the shares
    of their ratio. Also a row `h2` of the total, with the intercept as `intercept`.
    """
    k = len(names)
    tau = F.slice("coef", 2, k)
    base = coef.join(counts, key).withColumn("_t", tau)
    h2 = dot(F.col("_t"), F.col("M"))
    values = [("h2", h2), ("intercept", F.get("coef", 0))]
    for i, name in enumerate(names):
        row, m = F.get("overlap", i), F.get("M", i)
        inside = dot(F.col("_t"), row)
        outside = F.zip_with("M", row, lambda a, b: a - b)
        values += [
            (f"{name}|share", F.try_divide(inside, h2)), (f"{name}|tau", F.get("_t", i)),
            (f"{name}|gap", F.coalesce(F.try_divide(inside, m) - F.try_divide(dot(F.col("_t"), outside), F.col("M_total") - m), F.lit(0.0))),
        ]
    entry = F.array(*[F.struct(F.lit(n).alias("Quantity"), v.alias("value")) for n, v in values])
    out = jackknife(base.select(*by, "block", F.inline(entry)), by)
    split = F.split("Quantity", r"\|")
    out = out.withColumns({"Category": split[0], "_q": F.coalesce(F.get(split, 1), F.lit("total"))})

    def of(q: str, c: str) -> Column:
        return F.max(F.when(F.col("_q") == q, F.col(c)))

    wide = out.groupBy(*by, "Category").agg(
        of("share", "Estimate").alias("Prop_h2"), of("share", "SE").alias("Prop_h2_SE"),
        of("tau", "Estimate").alias("Coefficient"), of("tau", "SE").alias("Coefficient_SE"), of("gap", "Estimate").alias("_gap"),
        of("gap", "SE").alias("_gap_SE"), of("total", "Estimate").alias("Estimate"), of("total", "SE").alias("SE"), F.max("blocks").alias("_b"),
    )
    wide = wide.join(counts.select(F.col(key).alias("_k"), "M", "M_total"), F.col(key) == F.col("_k")).drop("_k")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("Category")).cast("int")
    share = F.when(place > 0, F.try_divide(F.get("M", place - 1), F.col("M_total")))
    z = F.try_divide(F.col("_gap"), F.col("_gap_SE"))
    wide = wide.withColumn("Prop_SNPs", share)
    return wide.select(
        *by, "Category", "Prop_SNPs", "Prop_h2", "Prop_h2_SE",
        F.try_divide("Prop_h2", "Prop_SNPs").alias("Enrichment"), F.try_divide("Prop_h2_SE", "Prop_SNPs").alias("Enrichment_SE"),
        F.when(F.col("_gap_SE") > 0, t_two_sided(z, F.col("_b"))).alias("Enrichment_p"), "Coefficient", "Coefficient_SE",
        F.try_divide("Coefficient", "Coefficient_SE").alias("Coefficient_z"), "Estimate", "SE",
    )


def mediated_h2(coef: DataFrame, ld_counts: list[float], cis: DataFrame, by: list[str], cell: str = "CELL") -> DataFrame:
    """(by, Quantity, Estimate, SE_Estimate, Estimate_over_h2, SE_over_h2) for h2med, h2nonmed and h2.

    `coef` is a joint regression on LD scores, which `ld_counts` gives the variants of, and then on the
    expression scores of the gene bins; `cis` is (cell, H), the total cis heritability of the genes of
    each bin. h2med is the coefficients of the bins times that; shares of h2 are ratio jackknifes.
    """
    k = len(ld_counts)
    rows = coef.join(cis.withColumnRenamed(cell, "_cell"), F.col(cell) == F.col("_cell")).drop("_cell")
    med = dot(F.slice("coef", k + 2, F.size("H")), F.col("H"))
    rest = dot(F.slice("coef", 2, k), F.array(*[F.lit(float(m)) for m in ld_counts]))
    rows = rows.withColumns({"_med": med, "_rest": rest}).withColumn("_all", F.col("_med") + F.col("_rest"))
    names = {"h2med": "_med", "h2nonmed": "_rest", "h2": "_all"}
    entry = [
        F.struct(F.lit(q).alias("Quantity"), v.alias("value"))
        for name, c in names.items() for q, v in ((name, F.col(c)), (f"{name}|over", F.try_divide(F.col(c), F.col("_all"))))
    ]
    out = jackknife(rows.select(*by, "block", F.inline(F.array(*entry))), by)
    over = F.col("Quantity").endswith("|over")
    out = out.withColumn("_name", F.regexp_replace("Quantity", r"\|over$", ""))
    return out.groupBy(*by, F.col("_name").alias("Quantity")).agg(
        F.max(F.when(~over, F.col("Estimate"))).alias("Estimate"), F.max(F.when(~over, F.col("SE"))).alias("SE_Estimate"),
        F.max(F.when(over, F.col("Estimate"))).alias("Estimate_over_h2"), F.max(F.when(over, F.col("SE"))).alias("SE_over_h2"),
    )


def heritability_table(df: DataFrame, keys: tuple[str, ...] = ("disease", "dataset", "CELL")) -> DataFrame:
    """h2, h2med and their ratio on one row; rows without an h2 are dropped."""

    def of(q: str, c: str):
        return F.max(F.when(F.col("Quantity") == q, F.col(c)))

    return (
        df.groupBy(*keys)
        .agg(
            of("h2", "Estimate").alias("h2"), of("h2", "SE_Estimate").alias("h2_SE"),
            of("h2med", "Estimate").alias("h2med"), of("h2med", "SE_Estimate").alias("h2med_SE"),
            of("h2med", "Estimate_over_h2").alias("h2med_h2"), of("h2med", "SE_over_h2").alias("h2med_h2_SE"),
        )
        .filter("h2 IS NOT NULL")
    )


def prepare_expression_input(qtl: DataFrame, genes: DataFrame, panel: DataFrame, n: float) -> DataFrame:
    """GENE, GENE_COORD, SNP, CHR, SNP_COORD, N, Z for genes of the annotation.

    X is chromosome 23 and is then left out, as the per-chromosome writer does.
    """
    g = genes.select("GENEID", midpoint("Start", "End_").alias("GENE_COORD"))
    ids = panel.groupBy("SNPID").agg(F.min("RSID").alias("_rs"))
    chrom = F.when(F.col("Chromosome") == "X", 23).otherwise(F.col("Chromosome").try_cast("int"))
    return (
        qtl.join(g, "GENEID")
        .join(ids, "SNPID", "left")
        .select(
            F.col("GENEID").alias("GENE"), "GENE_COORD", F.coalesce("_rs", "SNPID").alias("SNP"), chrom.alias("CHR"),
            F.split("SNPID", ":")[1].cast("long").alias("SNP_COORD"), F.lit(float(n)).alias("N"), "Z",
        )
        .filter("CHR <> 23")
    )


def mesc_sort(df: DataFrame) -> DataFrame:
    return df.orderBy("GENE_COORD", "GENE", "SNP_COORD")


def enrichment_matrix(
    df: DataFrame, datasets: list[str], row: str = "category", own: str = "is_own", value: str = "Enrichment", p: str = "Enrichment_p"
) -> DataFrame:
    """The row of each study's own annotation, as category x study of enrichment and -log10 p."""
    kept = df.filter(F.col(own))
    return kept.groupBy(row).pivot("dataset", datasets).agg(
        F.max(value).alias("enrichment"), F.max(-F.log10(p)).alias("log10p")
    )

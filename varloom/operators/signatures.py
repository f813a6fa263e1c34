"""Signatures, ranking metrics, enrichment, correlations and set tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.frames import tiled_running, wide
from varloom.sources.sinks import settle

METRICS = ("signal.to.noise", "t.test", "ratio.of.classes", "diff.of.classes", "log.ratio.of.classes")


def module_score(
    counts: DataFrame, sets: DataFrame, cells: DataFrame | None = None, bins: int = 24, controls: int = 100,
    seed: int = 1, value: str = "value",
) -> DataFrame:
    """Mean of signature genes minus mean of control genes, per cell and signature.

    Genes are cut into `bins` by mean expression; each signature gene draws up to
    `controls` genes of its bin, in an order hashed with its own name, and the draws of a
    signature are united. Zero entries count through the set sizes, and a cell without any
    of the genes scores 0. Windows run over the genes only.
    """
    everyone = (cells if cells is not None else counts).select("cell").distinct()
    n = everyone.agg(F.count("*"))
    means = counts.groupBy("gene").agg((F.sum(value) / n.scalar()).alias("_m"))
    binned = settle(means.withColumn("_bin", F.ntile(bins).over(Window.orderBy("_m", "gene"))))
    members = sets.join(binned.select("gene", "_bin"), "gene")
    # one draw per signature gene; a draw looks at one bin of genes
    drawing = members.select(F.col("gene").alias("_for"), "_bin").distinct().join(binned.select("gene", "_bin"), "_bin")
    hashed = F.row_number().over(Window.partitionBy("_for").orderBy(F.xxhash64("gene", "_for", F.lit(seed)), "gene"))
    pool = drawing.withColumn("_r", hashed).filter(F.col("_r") <= controls).select("_for", "gene")
    hit = members.select("signature", "gene", F.lit(1).alias("_hit")).distinct()
    ctrl = members.select("signature", F.col("gene").alias("_for")).distinct().join(pool, "_for").select("signature", "gene").distinct()
    both = hit.join(ctrl.withColumn("_ctrl", F.lit(1)), ["signature", "gene"], "full_outer")
    roles = settle(both.fillna(0, subset=["_hit", "_ctrl"]))
    sizes = roles.groupBy("signature").agg(F.sum("_hit").alias("_nh"), F.sum("_ctrl").alias("_nc"))
    # the roles of a signature as one array over the numbered genes: bit 1 a member, bit 2 a control
    numbered = settle(roles.select("gene").distinct().withColumn("_g", F.row_number().over(Window.orderBy("gene")) - 1))
    names = sizes.agg(F.collect_list(F.struct("signature")))
    grid = numbered.withColumn("_s", names.scalar()).select("gene", "_g", F.inline("_s"))
    marked = grid.join(roles.withColumn("_r", F.col("_hit") + 2 * F.col("_ctrl")), ["signature", "gene"], "left")
    vectors = marked.groupBy("signature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_g", "_r"))), lambda x: x["_r"]).alias("_roles")
    )
    known = settle(sizes.join(vectors, sizes["signature"].eqNullSafe(vectors["signature"])).select(sizes["signature"], "_nh", "_nc", "_roles"))
    # a cell's values are one array, which every signature sums in place: no row a cell and signature is grouped or sorted
    entry = F.struct("_g", F.col(value).cast("double").alias("_v"))
    per = counts.join(numbered, "gene").groupBy("cell").agg(F.collect_list(entry).alias("_values"))
    signed = known.agg(F.collect_list(F.struct("signature", "_nh", "_nc", "_roles"))).scalar()

    def total(values: Column, roles: Column, bit: int) -> Column:
        """Sum of the values whose gene has the role; a null value and a gene without any role add nothing."""

        def add(acc: Column, x: Column) -> Column:
            role = F.get(roles, x["_g"])
            return acc + F.when(role.isNull() | x["_v"].isNull(), 0.0).otherwise(x["_v"] * F.when(role.bitwiseAND(bit) > 0, 1.0).otherwise(0.0))

        return F.coalesce(F.aggregate(values, F.lit(0.0), add), F.lit(0.0))

    def scored(s: Column) -> Column:
        hits, drawn = total(F.col("_values"), s["_roles"], 1), total(F.col("_values"), s["_roles"], 2)
        score = hits / s["_nh"] - F.coalesce(F.try_divide(drawn, s["_nc"]), F.lit(0.0))
        return F.struct(s["signature"].alias("signature"), score.alias("score"))

    rows = everyone.join(per, "cell", "left").withColumn("_s", signed)
    return rows.select("cell", F.inline(F.transform("_s", scored)))


def rank_metric(
    cells: DataFrame, counts: DataFrame, tag: str = "cluster", metric: str = "signal.to.noise", min_cells: int = 3,
    value: str = "umi",
) -> DataFrame:
    """Ranking metric of every gene for each tag value against all other cells.

    Means and variances come from sums, so zero cells are never rows. Standard
    deviations are floored at 0.2 * |mean| (a mean of 0 counts as 1). Tag values with
    fewer than `min_cells` cells on either side are left out.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    v = F.col(value).cast("double")
    total = cells.agg(F.count("*")).scalar()
    sizes = cells.filter(F.col(tag).isNotNull()).groupBy(tag).agg(F.count("*").cast("double").alias("_n1"))
    sizes = sizes.withColumn("_n2", total - F.col("_n1")).filter(
        (F.col("_n1") >= min_cells) & (F.col("_n2") >= min_cells)
    )
    # the one pass over the counts; what follows works on (tag value, gene) rows
    per = settle(
        counts.join(cells.select("cell", tag), "cell")
        .groupBy(tag, "gene")
        .agg(F.sum(v).alias("_s1"), F.sum(v * v).alias("_q1"))
    )
    alls = per.groupBy("gene").agg(
        F.sum("_s1").alias("_s"), F.sum("_q1").alias("_q")
    )
    tags = sizes.agg(F.collect_list(F.struct(tag, "_n1", "_n2")))
    grid = alls.withColumn("_tags", tags.scalar()).select("gene", "_s", "_q", F.inline("_tags"))
    x = grid.join(per, [tag, "gene"], "left").fillna(0.0, subset=["_s1", "_q1"])

    def moments(s: Column, q: Column, n: Column) -> tuple[Column, Column]:
        mean = s / n
        sd = F.sqrt(F.greatest((q - n * mean * mean) / (n - 1), F.lit(0.0)))
        floor = F.lit(0.2) * F.abs(F.when(mean == 0, F.lit(1.0)).otherwise(mean))
        return mean, F.greatest(sd, floor)

    m1, d1 = moments(F.col("_s1"), F.col("_q1"), F.col("_n1"))
    m2, d2 = moments(F.col("_s") - F.col("_s1"), F.col("_q") - F.col("_q1"), F.col("_n2"))
    x = x.withColumns({"m1": m1, "d1": d1, "m2": m2, "d2": d2})
    a, b = F.col("m1"), F.col("m2")
    formula = {
        "signal.to.noise": (a - b) / (F.col("d1") + F.col("d2")),
        "t.test": (a - b) / F.sqrt(F.col("d1") * F.col("d1") / F.col("_n1") + F.col("d2") * F.col("d2") / F.col("_n2")),
        "ratio.of.classes": F.try_divide(a, b),
        "diff.of.classes": a - b,
        "log.ratio.of.classes": F.log2(F.nullif(F.try_divide(a, b), F.lit(0.0))),
    }[metric]
    return x.select(tag, "gene", formula.alias("metric"))


def rank_metric_order(df: DataFrame, tag: str = "cluster") -> DataFrame:
    """Genes ordered by falling metric per tag value, nulls out. Bounded by the genes."""
    w = Window.partitionBy(tag).orderBy(F.desc("metric"), "gene")
    return df.filter(F.col("metric").isNotNull() & ~F.isnan("metric")).withColumn("rank", F.row_number().over(w))


def _es(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Enrichment score from the hit rows alone.

    `hits` has keys, rank, _w (|metric|), _n (genes), _k (set size). The running sum can
    only peak right after a hit and only bottom out right before one.
    """
    w = Window.partitionBy(*keys).orderBy("rank")
    total = F.sum("_w").over(Window.partitionBy(*keys))
    i = F.row_number().over(w)
    cum = F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0))
    miss = (F.col("rank") - i) / (F.col("_n") - F.col("_k"))
    at = hits.select(*keys, (cum / total - miss).alias("_hi"), ((cum - F.col("_w")) / total - miss).alias("_lo"))
    g = at.groupBy(*keys).agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    return g.select(*keys, F.when(F.col("_hi") >= -F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("ES"))


def gsea_es(
    ranks: DataFrame, sets: DataFrame, tag: str = "cluster", min_size: int = 10, max_size: int = 500
) -> DataFrame:
    """Weighted enrichment score per (tag value, signature), sets of 10 to 500 genes."""
    ranks = settle(ranks)
    n = ranks.groupBy(tag).agg(F.count("*").cast("double").alias("_n"))
    hits = sets.distinct().join(ranks.select(tag, "gene", "rank", F.abs("metric").alias("_w")), "gene").join(n, tag)
    size = settle(
        hits.groupBy(tag, "signature").agg(F.count("*").alias("_k")).filter(F.col("_k").between(min_size, max_size))
    )
    hits = hits.join(size, [tag, "signature"])
    return _es(hits, [tag, "signature"]).join(size.withColumnRenamed("_k", "size"), [tag, "signature"])


def gsea_test(
    ranks: DataFrame, sets: DataFrame, tag: str = "cluster", nperm: int = 10_000, min_size: int = 10,
    max_size: int = 500, seed: int = 1,
) -> DataFrame:
    """Enrichment score with a gene-permutation p-value and its BH-adjusted value.

    Random sets depend on (tag value, set size, permutation) only, so sets of one size
    share them. A permutation draws more hashed ranks than it needs and keeps the first
    distinct ones, those left out if the set has over half of the genes; if hashes ever give
    too few, the lowest ranks not drawn fill the set. Every permutation is a row group of at
    most `max_size` rows.
    """
    ranks = settle(ranks)
    es = settle(gsea_es(ranks, sets, tag, min_size, max_size))
    n = ranks.groupBy(tag).agg(F.count("*").alias("_n"))
    shapes = es.select(tag, "size").distinct().join(n, tag)
    perm = shapes.withColumn("_perm", F.explode(F.sequence(F.lit(1), F.lit(nperm))))
    size, all_ranks = F.col("size").cast("int"), F.sequence(F.lit(1).cast("long"), F.col("_n"))
    few = F.when(F.col("size") * 2 > F.col("_n"), F.col("_n") - F.col("size")).otherwise(F.col("size")).cast("int")
    draws = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), few * 4 + 40),
            lambda j: F.pmod(F.xxhash64(F.col(tag), F.col("size"), F.col("_perm"), j, F.lit(seed)), F.col("_n")) + 1,
        )
    )
    perm = perm.withColumn("_d", draws)
    drawn = F.slice(F.when(F.size("_d") < few, F.array_union("_d", all_ranks)).otherwise(F.col("_d")), 1, few)
    picked = perm.select(tag, "size", "_perm", "_n", F.when(few < size, F.array_except(all_ranks, drawn)).otherwise(drawn).alias("_r"))
    rows = picked.select(tag, "size", "_perm", F.col("_n").cast("double").alias("_n"), F.explode("_r").alias("rank"))
    rows = rows.join(ranks.select(tag, F.col("rank").cast("long").alias("rank"), F.abs("metric").alias("_w")), [tag, "rank"])
    null = _es(rows.withColumn("_k", F.col("size")), [tag, "size", "_perm"])
    null = null.withColumnRenamed("ES", "_es0")
    joined = es.join(null, [tag, "size"])
    same = F.signum("_es0") == F.signum("ES")
    beyond = same & (F.abs("_es0") >= F.abs("ES"))
    g = joined.groupBy(tag, "signature", "size", "ES").agg(
        F.count_if(same).alias("_same"), F.count_if(beyond).alias("nMoreExtreme"), F.avg(F.when(same, F.abs("_es0"))).alias("_mean")
    )
    g = g.withColumns(
        {
            "NES": F.try_divide(F.col("ES"), F.col("_mean")),
            "pval": (F.col("nMoreExtreme") + 1) / (F.col("_same") + 1),
        }
    ).drop("_same", "_mean")
    return bh_adjust(settle(g), "pval", by=[tag]).withColumnRenamed("p_adj", "padj")


def bh_adjust(df: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted values, by group or over the whole table.

    Ranks and the running minimum go through bands of p, so a table of any length is
    spread over its bands.
    """
    keys = by or ["_all"]
    if by is None:
        df = df.withColumn("_all", F.lit(1))
    keyed = df.filter(F.col(p).isNotNull())
    per = settle(keyed.groupBy(*keys, p).agg(F.count("*").alias("_c")))
    band = F.floor(-F.ln(F.greatest(F.col(p), F.lit(1e-300))) * 1000)
    n = per.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    ranked = tiled_running(per, keys, band, [F.col(p)], {"_rank": ("sum", F.col("_c"))}, tile_desc=True)
    ranked = ranked.join(n, keys).withColumn("_neg", -F.least(F.col(p) * F.col("_m") / F.col("_rank"), F.lit(1.0)))
    adj = tiled_running(ranked, keys, band, [F.desc(p)], {"_best": ("max", F.col("_neg"))})
    adj = adj.select(*keys, p, (-F.col("_best")).alias("p_adj"))
    return df.join(adj, [*keys, p], "left").drop("_all")


def _ranked(long: DataFrame, by: list[str]) -> DataFrame:
    """Average ranks of `value` inside each subset."""
    w = Window.partitionBy(*by, "subset").orderBy("value")
    ties = F.count("*").over(Window.partitionBy(*by, "subset", "value"))
    return long.withColumn("rank", F.rank().over(w) + (ties - 1) / 2.0)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom (finite series)."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cos, sin = F.cos(theta), F.sin(theta)
    even = df % 2 == 0
    steps = F.greatest(F.floor(df / 2) - 1, F.lit(0)).cast("int")
    first = F.when(even, F.lit(1.0)).otherwise(cos)

    def add(acc: Column, i: Column) -> Column:
        num = F.when(even, 2 * i - 1).otherwise(2 * i)
        den = F.when(even, 2 * i).otherwise(2 * i + 1)
        term = acc["t"] * num / den * cos * cos
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    start = F.struct(first.cast("double").alias("t"), first.cast("double").alias("s"))
    series = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, add)["s"]).otherwise(first)
    odd_a = F.lit(2 / math.pi) * (theta + F.when(df > 1, sin * series).otherwise(0.0))
    return F.lit(1.0) - F.when(even, sin * series).otherwise(odd_a)


def spearman_matrix(
    long: DataFrame, subsets: list[str], by: list[str] | None = None, unit: str = "donor"
) -> DataFrame:
    """Rank correlation of every pair of subsets over units, with its p-value.

    `long` is (by, unit, subset, value). Ranks are pivoted to one row per unit, and all
    pairs are aggregated side by side, so no unit emits its pairs as rows. Subset names
    are the columns of a report, stated by the caller.
    """
    by = by or []
    filled = wide(long, [*by, unit], "subset", subsets, F.max("value"), fill=0.0)
    ranks = _ranked(filled.unpivot([*by, unit], subsets, "subset", "value"), by)
    names = {s: f"v{i}" for i, s in enumerate(subsets)}
    flat = wide(ranks, [*by, unit], "subset", subsets, F.max("rank")).withColumnsRenamed(names)
    pairs = [(a, b) for a in subsets for b in subsets]
    half = {(a, b): F.corr(names[a], names[b]) for i, a in enumerate(subsets) for b in subsets[i:]}
    cols = {k: f"c{i}" for i, k in enumerate(half)}
    agg = flat.groupBy(*by).agg(F.count("*").alias("n"), *[v.alias(cols[k]) for k, v in half.items()])
    entry = [
        F.struct(F.lit(a).alias("subset_1"), F.lit(b).alias("subset_2"), F.col(cols.get((a, b)) or cols[(b, a)]).alias("r"))
        for a, b in pairs
    ]
    out = agg.select(*by, "n", F.inline(F.array(*entry)))
    r = F.col("r")
    t = r * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1.0) - r * r, F.lit(1e-300)))
    p = F.when((F.col("subset_1") != F.col("subset_2")) & (F.col("n") > 2), t_two_sided(t, F.col("n") - 2))
    return out.withColumn("p", p)


def compare_correlations(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("female", "male"), alpha: float = 0.05) -> DataFrame:
    """Class of each pair by sign and significance in two correlation tables."""
    key = ["subset_1", "subset_2"]

    def kept(df: DataFrame, n: str) -> DataFrame:
        diag = F.col("subset_1") == F.col("subset_2")
        r = F.when(diag, F.lit(100.0)).when(F.col("p") <= alpha, F.col("r"))
        return df.select(*key, r.alias(f"{n}_r"))

    x, y = (F.col(f"{n}_r") for n in names)
    label = (
        F.when((x == 100) & (y == 100), "Diagonal")
        .when(x.isNull() & y.isNull(), "Non-significant")
        .when(x.isNotNull() & y.isNull(), f"Only {names[0]}")
        .when(x.isNull() & y.isNotNull(), f"Only {names[1]}")
        .when((x > 0) & (y > 0), "Consistent, positive")
        .when((x < 0) & (y < 0), "Consistent, negative")
        .otherwise("Unknown")
    )
    return kept(a, names[0]).join(kept(b, names[1]), key, "full_outer").withColumn("class", label)


def set_overlap_test(a: DataFrame, b: DataFrame, universe: DataFrame, key: str = "gene") -> DataFrame:
    """Sizes of A, B, A and B in a universe, and the hypergeometric upper tail.

    Sizes come from one join; the tail is a sum of at most min(|A|, |B|) terms by the
    ratio of neighbouring terms, from a first term of summed logarithms.
    """
    u = universe.select(key).distinct()
    x = u.join(a.select(key).distinct().withColumn("_a", F.lit(1)), key, "left").join(
        b.select(key).distinct().withColumn("_b", F.lit(1)), key, "left"
    )
    s = x.agg(
        F.count("*").alias("n_universe"), F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
    )

    def lfact(c: Column) -> Column:
        terms = F.sequence(F.lit(1), F.greatest(c, F.lit(1)).cast("int"))
        return F.aggregate(terms, F.lit(0.0), lambda acc, i: acc + F.ln(i.cast("double")))

    def lchoose(n: Column, k: Column) -> Column:
        return lfact(n) - lfact(k) - lfact(n - k)

    n, na, nb, k = (F.col(c) for c in ("n_universe", "n_a", "n_b", "n_both"))
    first = F.exp(lchoose(na, k) + lchoose(n - na, nb - k) - lchoose(n, nb))
    top = F.least(na, nb)

    def add(acc: Column, i: Column) -> Column:
        ratio = (na - i) * (nb - i) / ((i + 1) * (n - na - nb + i + 1))
        term = acc["t"] * ratio
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    rest = F.when(
        top > k,
        F.aggregate(
            F.sequence(k, F.greatest(top - 1, k)), F.struct(first.alias("t"), first.alias("s")), add
        )["s"],
    ).otherwise(first)
    return s.withColumn("p", F.least(rest, F.lit(1.0)))


def deg_sets(df: DataFrame, order: list[str], lfc: float = 0.25, p: float = 0.05) -> DataFrame:
    """Genes passing in any element: label and size of their set, and mean LFC in it.

    `set_order` is the position of the first element of the set, by which results are
    laid out after `set_size`.
    """
    rank = F.create_map(*[F.lit(x) for i, e in enumerate(order) for x in (e, i)])[F.col("element")]
    hit = df.filter((F.col("lfc") > lfc) & (F.col("p_adj") < p)).withColumn("_o", rank)
    return hit.groupBy("gene").agg(
        F.concat_ws(";", F.sort_array(F.collect_set("element"))).alias("set_values"),
        F.count("*").alias("set_size"), F.avg("lfc").alias("avg_lfc"), F.min("_o").alias("set_order"),
    )


def geneset_join(sets: DataFrame, results: DataFrame) -> DataFrame:
    """Gene set members with their per-population results."""
    return sets.join(results, "gene").withColumn("id", F.concat_ws(".", "cell_type", "cluster"))

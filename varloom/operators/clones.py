"""Clonotype tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.frames import first_by, spread_nulls


def clone_sharing(clones: DataFrame, tag: str = "tag", more_than: int = 1) -> DataFrame:
    """Cells per tag value in clones that exceed the size in every tag value, or not."""
    has = clones.filter("clonotype IS NOT NULL")
    sizes = has.groupBy("clonotype", tag).agg(F.count("*").alias("_n"))
    n_groups = has.select(tag).distinct().agg(F.count("*"))
    shared = (
        sizes.filter(F.col("_n") > more_than).groupBy("clonotype").agg(F.count("*").alias("_g"))
        .filter(F.col("_g") == n_groups.scalar()).select("clonotype", F.lit("Shared").alias("_s"))
    )
    labelled = sizes.join(shared, "clonotype", "left").withColumn("sharing", F.coalesce("_s", F.lit("Unique")))
    return labelled.groupBy(tag, "sharing").agg(
        F.sum("_n").alias("cells"), F.count("*").alias("clones")
    )


def clone_membership(clones: DataFrame, tag: str = "tag", at_least: int = 1) -> DataFrame:
    """Number of clones per combination of the tag values they occur in."""
    sizes = clones.filter("clonotype IS NOT NULL").groupBy("clonotype", tag).agg(F.count("*").alias("_n"))
    combos = sizes.filter(F.col("_n") >= at_least).groupBy("clonotype").agg(
        F.concat_ws("&", F.sort_array(F.collect_set(tag))).alias("groups")
    )
    return combos.groupBy("groups").agg(F.count("*").alias("clones"))


def polyreactive_flag(clones: DataFrame, tag: str = "tag", at_least: int = 2) -> DataFrame:
    """`pR` for a donor's clone with at least two cells in more than one antigen."""
    sizes = clones.filter("clonotype IS NOT NULL AND donor IS NOT NULL").groupBy("clonotype", "donor", tag).agg(
        F.count("*").alias("_n")
    )
    many = F.count_if(F.col("_n") >= at_least) > 1
    flag = sizes.groupBy(F.col("clonotype").alias("_c"), F.col("donor").alias("_d")).agg(F.when(many, "pR").otherwise("non-pR").alias("pr_tag"))
    out = clones.withColumn("_key", spread_nulls(F.col("clonotype")))
    return out.join(flag, (F.col("_key") == F.col("_c")) & (F.col("donor") == F.col("_d")), "left").drop("_key", "_c", "_d")


def vdj_consensus(contigs: DataFrame) -> DataFrame:
    """Most frequent V and J gene per clonotype and chain, as one row per clonotype.

    Ties go to the gene first in name order.
    """
    ok = contigs.filter(
        "is_cell = 'True' AND high_confidence = 'True' AND productive = 'True' AND chain IN ('TRA', 'TRB')"
    )

    def best(gene: str) -> DataFrame:
        n = ok.groupBy("clonotype", "chain", gene).agg(F.count("*").alias("_n"))
        return first_by(n, ["clonotype", "chain"], [F.desc("_n"), gene]).select("clonotype", "chain", gene)

    def of(chain: str, gene: str):
        return F.max(F.when(F.col("chain") == chain, F.col(gene)))

    return best("v_gene").join(best("j_gene"), ["clonotype", "chain"]).groupBy("clonotype").agg(
        of("TRA", "v_gene").alias("tra_v"), of("TRA", "j_gene").alias("tra_j"),
        of("TRB", "v_gene").alias("trb_v"), of("TRB", "j_gene").alias("trb_j"),
    )


def tcr_table(clones: DataFrame, vdj: DataFrame, groups: list[str], tag: str = "tag") -> DataFrame:
    """Clone attributes with cells per tag value, local and global size, per donor."""
    has = clones.filter("clonotype IS NOT NULL")
    total = has.groupBy("clonotype").agg(F.count("*").alias("global_size"))
    c = F.col(tag)
    per = has.filter("donor IS NOT NULL").groupBy("clonotype", "donor").agg(
        F.count("*").alias("local_size"), *[F.count_if(c == g).alias(g) for g in groups]
    )
    order = F.regexp_replace("clonotype", "clonotype", "").try_cast("int")
    return per.join(total, "clonotype").join(vdj, "clonotype", "left").withColumn("clone_order", order)


def reactivity_summary(
    clones: DataFrame, classes: list[str], reactivity: str = "tag", by_cell: bool = True
) -> DataFrame:
    """Per donor: count and proportion of each reactivity, over cells or clones."""
    has = clones.filter("donor IS NOT NULL AND clonotype IS NOT NULL").withColumn(
        "_r", F.coalesce(reactivity, F.lit("Unknown"))
    )
    if not by_cell:
        per = has.groupBy("donor", "_r", "clonotype").agg(F.lit(1).alias("_x"))
        total = has.groupBy("donor").agg(F.count_distinct("clonotype").alias("_t"))
    else:
        per, total = has, has.groupBy("donor").agg(F.count("*").alias("_t"))
    r = F.col("_r")
    wide = per.groupBy("donor").agg(*[F.count_if(r == x).alias(f"{x}_C") for x in classes])
    out = wide.join(total, "donor")
    return out.select(
        "donor", *[f"{x}_C" for x in classes], *[(F.col(f"{x}_C") / F.col("_t")).alias(f"{x}_P") for x in classes]
    )

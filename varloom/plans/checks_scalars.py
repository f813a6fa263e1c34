"""Queries over the scalar functions, one per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import scalars as sc
from varloom.functions.scalars import erfc_sql
from varloom.plans.registry import query
from varloom.plans.checks_traits import rnd


@query(
    "fn_ids",
    """SELECT dataset, Position, Chromosome || ':' || CAST(Position AS VARCHAR) || ':' || NEA || ':' || EA AS snpid,
              Chromosome || ':' || CAST(Position AS VARCHAR) || ':' || coalesce(NEA, '') || ':' || coalesce(EA, '') AS blank,
              CASE WHEN NEA IS NOT NULL THEN Chromosome || ':' || CAST(Position AS VARCHAR) || '_' || NEA || '_' || EA END AS ukb,
              coalesce(nullif(trim(NEA), ''), EA) AS first FROM {gwas}""",
)
def _(t):
    return t.gwas.select(
        "dataset", "Position", sc.snpid().alias("snpid"), sc.snpid_blank().alias("blank"), sc.ukb_id(sc.snpid()).alias("ukb"),
        sc.first_id("NEA", "EA").alias("first"),
    )


@query(
    "fn_alleles",
    """SELECT dataset, Position, translate(NEA, 'ACGT', 'TGCA') AS comp, NEA || EA IN ('AT', 'TA', 'CG', 'GC') AS ambiguous,
              CASE WHEN BETA >= 0 THEN EA ELSE NEA END AS risk, CASE WHEN BETA >= 0 THEN NEA ELSE EA END AS other FROM {gwas}""",
)
def _(t):
    risk, other = sc.risk_alleles(F.col("BETA"))
    return t.gwas.select(
        "dataset", "Position", sc.complement("NEA").alias("comp"), sc.strand_ambiguous(F.col("NEA"), F.col("EA")).alias("ambiguous"),
        risk.alias("risk"), other.alias("other"),
    )


@query(
    "fn_statistics",
    f"""SELECT dataset, SNPID, round(ln(0.5D + AF), 6) AS beta, round(BETA / SE, 6) AS z, round(abs(BETA / (SE + AF)), 6) AS se, round(1 / sqrt(1000.0D), 9) AS se_n,
               round(1 / sqrt(2 * 1000.0D * AF * (1 - AF)), 6) AS se_maf, round({erfc_sql('(abs(BETA / SE / 4) / 1.4142135623730951D)')}, 9) AS p FROM {{sumstats}}""",
)
def _(t):
    s = t.sumstats.withColumns({"OR": F.lit(0.5) + F.col("AF"), "Z": F.col("SE") + F.col("AF"), "z4": F.col("BETA") / F.col("SE") / 4})
    out = s.select(
        "dataset", "SNPID", sc.beta_from_or("OR").alias("beta"), sc.z_from_beta_se().alias("z"), sc.se_from_beta_z().alias("se"),
        sc.se_from_n(1000).alias("se_n"), sc.se_from_n_maf(1000, "AF").alias("se_maf"), sc.p_from_z("z4").alias("p"),
    )
    return rnd(rnd(out, 6, "beta", "z", "se", "se_maf"), 9, "se_n", "p")


@query(
    "fn_labels",
    """SELECT DISTINCT CELL, split_part(CELL, '_', 1) AS name, split_part(CELL, '_', 2) AS cluster, CELL AS file, CAST(split_part(CELL, '_', 2) AS INT) AS category,
              'LIB-lung-B_Hu_' || split_part(CELL, '_', 1) || '_3' || 'C_10D' AS library FROM {qtl}""",
)
def _(t):
    lib = F.concat(F.lit("LIBB_Hu_3_"), F.split("CELL", "_")[0], F.lit("_C_10D"))
    return t.qtl.select(
        "CELL", sc.cell_name("CELL").alias("name"), sc.cell_cluster("CELL").alias("cluster"), F.col("CELL").alias("file"),
        sc.category_of_file("CELL").alias("category"), sc.library_id(lib, "LIB", "LIB-lung").alias("library"),
    ).distinct()


@query(
    "fn_math",
    """SELECT CELL, SNPID, GENEID, round(CASE WHEN P = 0 OR -log10(P) > 10 THEN 10.0D ELSE -log10(P) END, 6) AS capped,
              round(CASE WHEN MAF = 0 THEN ln(0.025D / 0.975D) WHEN MAF = 1 THEN ln(0.975D / 0.025D) ELSE ln(MAF / (1 - MAF)) END, 6) AS logit, CAST(floor((Position + Position + 7) / 2.0) AS BIGINT) AS mid,
              CAST(Chromosome AS INT) AS chr_order FROM {qtl}""",
)
def _(t):
    q = t.qtl.withColumn("_e", F.col("Position") + 7)
    out = q.select(
        "CELL", "SNPID", "GENEID", sc.neg_log10("P", 10).alias("capped"), sc.logit("MAF").alias("logit"), sc.midpoint("Position", "_e").alias("mid"),
        sc.chr_order("Chromosome").alias("chr_order"),
    )
    return rnd(out, 6, "capped", "logit")

"""Overlap of association signals with QTLs, and its gene x cell summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.frames import distinct_list, first_by, wide
from varloom.functions.scalars import neg_log10
from varloom.operators import ld as ld_ops
from varloom.operators.clean import significant

# Columns kept per QTL kind.
QTL_COLUMNS = {
    "eQTL": ["SNPID", "GENEID", "GENENAME", "P", "BETA"],
    "chromQTL": ["SNPID", "Peak", "P", "BETA"],
    "tfQTL": ["SNPID", "TF", "Peak", "P", "BETA"],
}


def qtl_project(df: DataFrame, kind: str = "eQTL", keep: tuple[str, ...] = ("CELL",)) -> DataFrame:
    """The kind's columns; an RSID column is carried through."""
    extra = ["RSID"] if "RSID" in df.columns else []
    return df.select(*[k for k in keep if k in df.columns], *QTL_COLUMNS[kind], *extra)


def overlap(qtl: DataFrame, gwas: DataFrame, prefixes: tuple[str, str] = ("", "")) -> DataFrame:
    """Inner join on SNPID; colliding names get the side's prefix; SNPID is split."""
    clash = (set(qtl.columns) & set(gwas.columns)) - {"SNPID"}
    left, right = (
        d.withColumnsRenamed({c: f"{p}_{c}" for c in clash}) if p else d
        for d, p in zip((qtl, gwas), prefixes)
    )
    parts = F.split("SNPID", ":")
    return (
        left.join(right, "SNPID")
        .drop("Chromosome", "Position", "REF", "ALT")
        .withColumns(
            {
                "Chromosome": parts[0],
                "Position": parts[1].cast("long"),
                "REF": F.try_element_at(parts, F.lit(3)),
                "ALT": F.try_element_at(parts, F.lit(4)),
            }
        )
    )


def overlap_gwas(
    gwas: DataFrame, qtl: DataFrame, ld: DataFrame | None = None, populations: list[str] | None = None,
    threshold: float = 5e-8,
) -> DataFrame:
    """Significant variants, or their proxies, joined to QTLs.

    `gwas` has dataset, SNPID, P, BETA. Without LD a signal stands for itself.
    """
    stats = gwas.select("dataset", "SNPID", "P", "BETA")
    sig = significant(stats, threshold)
    if ld is None:
        signals = sig.withColumnsRenamed({"P": "GWAS_Lead_P", "BETA": "GWAS_Lead_BETA"})
        return overlap(qtl, signals)
    best = F.greatest(*populations) if len(populations) > 1 else F.col(populations[0])
    pairs = sig.select("dataset", F.col("SNPID").alias("Lead")).distinct().join(ld, "Lead")
    own = sig.select("dataset", "SNPID").distinct()
    lead_rows = own.select("dataset", F.col("SNPID").alias("Lead"), F.col("SNPID").alias("LD")).withColumn(
        "Category", F.lit("Lead")
    )
    w = Window.partitionBy("dataset", "LD").orderBy(F.desc_nulls_last("_max"), "Lead")
    proxies = (
        pairs.join(own.select("dataset", F.col("SNPID").alias("LD")), ["dataset", "LD"], "left_anti")
        .withColumn("_max", best)
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .select("dataset", "Lead", "LD", F.lit("LD").alias("Category"))
    )
    signals = ld_ops.ld_add_info(lead_rows.unionByName(proxies), stats, by=("dataset",))
    return overlap(qtl, signals)


def best_per_gene(df: DataFrame, by: str | list[str] = "GENEID") -> DataFrame:
    keys = [by] if isinstance(by, str) else by
    return first_by(df, keys, ["P", "SNPID", *[c for c in df.columns if c not in (*keys, "P", "SNPID")]])


def gene_cell_matrix(
    df: DataFrame, cells: list[str], keys: tuple[str, ...] = ("GENEID", "GENENAME"), log: bool = True
) -> DataFrame:
    """Best P per gene and cell as a gene x cell table of -log10 P, 0 where absent.

    `cells` fixes the columns and their order, including cells with no rows.
    """
    out = wide(df, list(keys), "CELL", cells, F.min("P"))
    if not log:
        return out
    return out.select(*keys, *[F.coalesce(neg_log10(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in cells])


def replication(
    df: DataFrame, key: str = "GENEID", study: str = "dataset", names: tuple[str, str] = ("GWAS_datasets", "Number_of_GWAS_datasets"),
) -> DataFrame:
    """Per feature: its distinct studies joined by ", " and their number."""
    return df.groupBy(key).agg(
        distinct_list(F.col(study), ", ").alias(names[0]), F.count_distinct(study).alias(names[1])
    )


def master_summary(
    df: DataFrame, studies: DataFrame, by: tuple[str, ...] = ("disease",), keys: tuple[str, ...] = ("GENEID", "GENENAME"),
    value: str = "P", threshold: float = 0.0, log: bool = True,
) -> DataFrame:
    """Per group and gene: best value, cells over the threshold, studies of the group.

    The best value per cell is aggregated in long form, before any pivot.
    """
    best = F.max(neg_log10(value)) if log else F.max(value)
    per_cell = df.groupBy(*by, *keys, "CELL").agg(best.alias("_v"))
    over = (F.col("_v") > threshold) if log else (F.col("_v") >= threshold)
    n = studies.groupBy(*by).agg(F.count_distinct("dataset").alias("Number_of_GWAS_studies"))
    return (
        per_cell.groupBy(*by, *keys)
        .agg(F.max("_v").alias("Max_value"), F.count_if(over).alias("Number_of_celltypes"))
        .join(n, list(by))
    )


def egene_matrix(
    df: DataFrame, columns: list[str], key: str = "gene", column: str = "id", cap: float = 10.0
) -> DataFrame:
    """FDR of eGenes as gene x population, -log10 capped; genes with no value are dropped.

    A cell without an eGene is null, and FDR = 0 is at the cap. The caller states the
    populations, so one without any eGene is simply not listed.
    """
    kept = df.filter("is_egene AND FDR >= 0")
    out = wide(kept, [key], column, columns, F.min("FDR"))
    return out.select(key, *[neg_log10(F.col(f"`{c}`"), cap).alias(c) for c in columns])


def locus_outer_merge(
    a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_1", "_2")
) -> DataFrame:
    """Full outer merge of two traits at a locus with -log10 P of both."""
    left = a.select(*keys, neg_log10("P").alias(f"log10p{suffixes[0]}"))
    right = b.select(*keys, neg_log10("P").alias(f"log10p{suffixes[1]}"))
    return left.join(right, keys, "full_outer")


def shared_ids(a: DataFrame, b: DataFrame, column: str = "SNPID") -> DataFrame:
    return a.select(column).intersect(b.select(column))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def reduce_outer(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full outer merge of many (key, value) tables: one union and one pivot."""
    long = union_by_name(
        [d.select(key, F.lit(n).alias("_name"), F.col(value).alias("_value")) for n, d in frames.items()]
    )
    return wide(long, [key], "_name", list(frames), F.max("_value"))

"""Interval operators: points in blocks, flags, merged loci, region assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.frames import islands, point_in_interval


def locus_text(chrom: str, start: str, end: str):
    return F.concat(
        F.col(chrom), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string")
    )


def partition_by_block(
    df: DataFrame, blocks: DataFrame, prefix: str | None = None, width: int = 1_000_000
) -> DataFrame:
    """Variants inside blocks (both ends inclusive) with `Loci` = chr:start-end.

    `prefix` names a column put before the locus, as QTL tables do with the gene.
    """
    b = blocks.select("Chromosome", F.col("Start").alias("_bs"), F.col("End_").alias("_be"))
    out = point_in_interval(df, b, width, start="_bs", end="_be")
    loci = locus_text("Chromosome", "_bs", "_be")
    if prefix:
        loci = F.concat(F.col(prefix).cast("string"), F.lit("_"), loci)
    return out.withColumn("Loci", loci).drop("_bs", "_be")


# Partition method registry.
PARTITIONS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "GWAS": lambda df, blocks: partition_by_block(df, blocks),
    "eQTL": lambda df, blocks: partition_by_block(df, blocks, prefix="GENEID"),
}


def interval_flag(
    variants: DataFrame, intervals: DataFrame, labels: list[str], label: str = "label",
    width: int = 1_000_000,
) -> DataFrame:
    """0/1 per variant and annotation label, plus the constant `base`.

    One range join for all labels; the flags are a map-side combined max per variant.
    """
    if len(set(labels)) != len(labels) or "base" in labels or set(labels) & set(variants.columns):
        raise ValueError("annotation labels clash")
    keys = variants.columns
    regions = intervals.select("Chromosome", F.col("Start").alias("_bs"), F.col("End_").alias("_be"), label)
    hits = point_in_interval(variants, regions, width, start="_bs", end="_be", how="left")
    flags = [F.max(F.when(F.col(label) == x, 1).otherwise(0)).alias(x) for x in labels]
    return hits.groupBy(*keys).agg(F.lit(1).alias("base"), *flags)


def parse_locus(df: DataFrame, column: str) -> DataFrame:
    parts = F.split(column, "[:-]")
    return df.withColumns(
        {
            "Chromosome": parts[0],
            "Start": parts[1].cast("long"),
            "End_": parts[2].cast("long"),
        }
    )


def haploblock_to_loci(blocks: DataFrame, slack: int = 500_000, column: str = "Haploblock") -> DataFrame:
    """Merge `chr:a-b` blocks closer than `slack` and give each block its `Loci`."""
    parsed = parse_locus(blocks, column)
    spans = parsed.select("Chromosome", "Start", "End_").distinct()
    marked = islands(spans, ["Chromosome"], "Start", "End_", gap=slack)
    merged = marked.groupBy("Chromosome", "_island").agg(
        F.min("Start").alias("_s"), F.max("End_").alias("_e")
    )
    named = marked.join(merged, ["Chromosome", "_island"]).select(
        "Chromosome", "Start", "End_", locus_text("Chromosome", "_s", "_e").alias("Loci")
    )
    return parsed.join(named, ["Chromosome", "Start", "End_"]).drop("Start", "End_")


def assign_regions(
    df: DataFrame, regions: DataFrame, gene: str | None = None, width: int = 1_000_000
) -> DataFrame:
    """Region of each variant; with `gene`, one region per gene.

    A gene whose variants fall in several regions gets the region of its first
    variant and `spans` = true.
    """
    r = regions.select(
        "Chromosome", F.col("Start").alias("_bs"), F.col("End_").alias("_be"),
        locus_text("Chromosome", "Start", "End_").alias("region_id"),
    )
    placed = point_in_interval(df, r, width, start="_bs", end="_be").drop("_bs", "_be")
    if gene is None:
        return placed
    return placed.groupBy(gene).agg(
        F.min_by("region_id", F.struct("Chromosome", "Position", "region_id")).alias("region_id"),
        (F.min("region_id") != F.max("region_id")).alias("spans"),
    )


def drop_region_genes(
    df: DataFrame, genes: DataFrame, locus: str = "6:28477897-33448354", key: str = "GENEID"
) -> DataFrame:
    """Drop genes that overlap a locus."""
    chrom, span = locus.split(":")
    lo, hi = (int(x) for x in span.split("-"))
    inside = genes.filter(
        (F.col("Chromosome") == chrom) & (F.col("Start") <= hi) & (F.col("End_") >= lo)
    ).select(key)
    return df.join(inside, key, "left_anti")


def locus_filter_any(df: DataFrame, column: str, threshold: float, locus: list[str] | None = None) -> DataFrame:
    """Keep whole loci with any value at or under the threshold.

    The passing loci are found by a small aggregate and semi-joined, so no locus is
    sorted or held in one task.
    """
    keys = locus or ["Loci"]
    passing = df.filter(F.col(column) <= threshold).select(*keys).distinct()
    return df.join(passing, keys, "left_semi")


def locus_summary(
    df: DataFrame, locus: str = "Loci", threshold: float = 5e-8, by: tuple[str, ...] = ()
) -> DataFrame:
    """Per locus: best variant, distinct variants and distinct significant ones."""
    best = F.min_by(F.struct("SNPID", "RSID", "P"), F.struct("P", "SNPID"))
    return (
        df.groupBy(*by, locus)
        .agg(
            best.alias("_b"),
            F.count_distinct("SNPID").alias("n_snps"),
            F.count_distinct(F.when(F.col("P") <= threshold, F.col("SNPID"))).alias("n_sig_snps"),
        )
        .select(*by, locus, "_b.SNPID", "_b.RSID", "_b.P", "n_sig_snps", "n_snps")
    )


def loci_with_blocks(
    df: DataFrame, locus: str = "Loci", block: str = "Haploblock", threshold: float = 5e-8,
    by: tuple[str, ...] = (),
) -> DataFrame:
    n = df.groupBy(*by, locus).agg(F.count_distinct(block).alias("n_haploblocks"))
    return locus_summary(df, locus, threshold, by).join(n, [*by, locus])



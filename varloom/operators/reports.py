"""Study-level summaries and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.frames import distinct_list, first_by, wide
from varloom.functions.scalars import cell_cluster, cell_name, thousands_position
from varloom.operators.panel import translate_ids_snp


def max_pp4(df: DataFrame, by: list[str]) -> DataFrame:
    """Row with the largest PPH4 per group (ties by SNPID)."""
    return first_by(df, by, [F.desc("PPH4"), "SNPID", *[c for c in df.columns if c not in (*by, "PPH4", "SNPID")]])


def coloc_matrix(df: DataFrame, cells: list[str], threshold: float = 0.8, key: str = "Feature2", cell: str = "dataset2", study: str = "dataset1") -> DataFrame:
    """Best PPH4 per feature and cell, 0 where absent, with the studies over the threshold.

    One grouped pass gives the columns, the study list and the counts.
    """
    over = F.col("PPH4") >= threshold
    agg = df.groupBy(key).agg(
        distinct_list(F.when(over, F.col(study)), ", ").alias("datasets"),
        F.count_distinct(F.when(over, F.col(study))).alias("Number_of_datasets"),
        F.max("PPH4").alias("Max_PPH4"),
        *[F.coalesce(F.max(F.when(F.col(cell) == c, F.col("PPH4"))), F.lit(0.0)).alias(c) for c in cells],
    )
    n = sum((F.when(F.col(f"`{c}`") >= threshold, 1).otherwise(0) for c in cells[1:]), F.when(F.col(f"`{cells[0]}`") >= threshold, 1).otherwise(0))
    return agg.filter("Number_of_datasets > 0").withColumn("Number_of_celltypes", n)


def coloc_by_block(df: DataFrame, blocks: DataFrame, cells: list[str], key: str = "Feature1") -> DataFrame:
    """Best PPH4 per block and cell, beside the block summary."""
    out = wide(df, [key], "dataset2", cells, F.max("PPH4"))
    return out.join(blocks, key, "left")


def assoc_counts(df: DataFrame, manifest: DataFrame, feature: str, study: str = "dataset", name: str = "n_features") -> DataFrame:
    """Distinct features per study, 0 for studies without any."""
    n = df.groupBy(study).agg(F.count_distinct(feature).alias(name))
    return manifest.select(study).distinct().join(n, study, "left").fillna(0, subset=[name])


def counts_to_meta(meta: DataFrame, counts: DataFrame, key: str = "dataset") -> DataFrame:
    """Counts beside the manifest; no study is lost, and `has_counts` tells which had any."""
    marked = counts.withColumn("has_counts", F.lit(True))
    return meta.join(marked, key, "left").withColumn("has_counts", F.coalesce("has_counts", F.lit(False)))


def union_missing_rows(new: DataFrame, old: DataFrame, keys: list[str], kind: str = "sum_stats", link: str = "Link") -> DataFrame:
    """Old rows without a new one, then the new rows; non-sumstats lose their link."""
    lost = old.join(new.select(*keys).distinct(), keys, "left_anti")
    out = lost.unionByName(new, allowMissingColumns=True).distinct()
    return out.withColumn(link, F.when(F.col(kind) != 0, F.col(link)))


def _cell_split(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({"Cell_name": cell_name(column), "Cluster": cell_cluster(column)})


def report_overlap(df: DataFrame, panel: DataFrame) -> DataFrame:
    """Overlap report: LD defaults, cell and cluster, positions, ids and lead alleles."""
    has_ld = "Category" in df.columns
    if not has_ld:
        df = df.withColumns(
            {"Lead": F.col("SNPID"), "GWAS_P": F.col("GWAS_Lead_P"), "GWAS_BETA": F.col("GWAS_Lead_BETA")}
        )
    s, ld = F.split("SNPID", ":"), F.split("Lead", ":")
    df = _cell_split(df, "CELL").withColumns(
        {
            "ld": F.lit(has_ld),
            "Position": thousands_position(s[0], s[1]),
            "GWAS_Lead_Position": thousands_position(ld[0], ld[1]),
            "GWAS_Lead_ref": F.try_element_at(ld, F.lit(3)),
            "GWAS_Lead_alt": F.try_element_at(ld, F.lit(4)),
        }
    )
    df = translate_ids_snp(df, panel, "SNPID", "SNP_id")
    # without LD the lead is the variant itself
    df = translate_ids_snp(df, panel, "Lead", "Lead_id") if has_ld else df.withColumn("Lead_id", F.col("SNP_id"))
    return df.drop("SNPID", "Lead").withColumnsRenamed({"SNP_id": "SNPID", "Lead_id": "Lead"})


REPORT_ORDER = ["disease", "dataset", "Cell_name", "Cluster", "GENEID"]


def report_sort(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return df.orderBy(*[c for c in [*REPORT_ORDER, *(extra or [])] if c in df.columns])


def report_coloc(df: DataFrame, panel: DataFrame, genes: DataFrame | None = None, best: bool = True) -> DataFrame:
    """Coloc report: cell and cluster, locus text, gene, alleles, ids, best row per group."""
    f1 = F.split("Feature1", "[:-]")
    s = F.split("SNPID", ":")
    df = _cell_split(df.withColumnRenamed("dataset1", "dataset"), "dataset2").withColumns(
        {
            "GENEID": F.split("Feature2", "_")[0],
            "locus": F.concat(
                thousands_position(f1[0], f1[1]), F.lit("-"), F.format_number(f1[2].cast("long"), 0)
            ),
            "Position": thousands_position(s[0], s[1]),
            "REF": F.try_element_at(s, F.lit(3)),
            "ALT": F.try_element_at(s, F.lit(4)),
        }
    )
    if genes is not None:
        g = genes.select(F.regexp_replace("GENEID", r"\.\d+$", "").alias("GENEID"), F.col("GENENAME").alias("_gn"))
        df = df.join(g, "GENEID", "left").withColumn("GENENAME", F.coalesce("_gn", "GENEID")).drop("_gn")
    df = translate_ids_snp(df, panel, "SNPID", "SNP_id").drop("SNPID").withColumnRenamed("SNP_id", "SNPID")
    return max_pp4(df, [c for c in REPORT_ORDER if c in df.columns]) if best else df


def report_heritability(table: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Heritability rows with cell and cluster, in cell-type order when one is given."""
    df = _cell_split(table, "CELL")
    if order is None:
        return df.orderBy("disease", "dataset", "CELL")
    o = order.select(F.col("sample_name").alias("CELL"), F.col("cell_order"))
    return df.join(o, "CELL", "left").orderBy("disease", "dataset", "cell_order")


def report_studies(
    new: DataFrame, original: DataFrame, overlap: DataFrame, coloc: DataFrame, keys: list[str]
) -> DataFrame:
    """Manifest with association counts of overlap and coloc, plus the studies left out."""
    out = new
    for df, name in ((overlap, "Number_of_associations_OVERLAP"), (coloc, "Number_of_associations_COLOC")):
        n = df.groupBy("sample_name").agg(F.count_distinct("Feature").alias(name))
        out = out.join(n, "sample_name", "left")
    return union_missing_rows(out, original, keys)


def translate_ids_gene(df: DataFrame, features: DataFrame, column: str = "gene", to: str = "name", source: str = "ensembl", target: str = "name") -> DataFrame:
    """Gene id in the other vocabulary; several hits are joined with `;`."""
    names = features.groupBy(F.col(source).alias("_k")).agg(distinct_list(F.col(target), ";").alias("_v"))
    return df.join(names, F.col(column) == F.col("_k"), "left").withColumn(to, F.col("_v")).drop("_k", "_v")

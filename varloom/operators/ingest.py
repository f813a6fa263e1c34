"""Column canonicalisation of raw association files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.scalars import as_col

# Canonical column -> names it is known under, in order of preference.
ALIASES: dict[str, list[str]] = {
    "Chromosome": ["Chr", "CHROM", "CHR", "Chromosome", "chr", "chromosome", "#CHR", "#CHROM"],
    "Position": ["pos", "POS", "BP", "Position", "Position_b37", "base_pair_location", "Position (hg19)",
                 "position", "base_pair_location_grch37", "BP_hg19"],
    "RSID": ["rsID", "dbSNP rsID", "variant_id", "SNP", "#SNP", "rsid", "db SNP RS ID/Marker", "Variant",
             "RSID", "ID", "rs_id_all", "rs_id"],
    "P": ["P", "p-value", "P-value", "Pvalue", "P.value_association", "P_BOLT_LMM", "P_value", "p_value",
          "pval_meta", "P_GC", "p.khor", "all_inv_var_meta_p", "GC-adjusted P", "Logistic-adjusted P-value",
          "frequentist_add_pvalue", "p.value", "PVALUE", "pval", "P_Value", "p"],
    "BETA": ["beta", "Beta", "BETA", "beta_meta", "beta_0", "all_inv_var_meta_beta", "EFFECT", "EFFECT1", "Effect"],
    "OR": ["OR", "or.khor", "odds_ratio", "or_meta", "all_OR"],
    "SE": ["se", "SE", "standard_error", "se_meta", "se.khor", "se_0", "StdErr", "all_inv_var_meta_sebeta",
           "STDERR", "sebeta", "SE_GC"],
    "NEA": ["other_allele", "NEA", "NonEffectAllele", "NonEffect_Allele", "Non_Effect_allele",
            "non_effect_allele", "A2", "a2", "Allele2", "ALLELE0", "Non_coded", "allele_A", "Major allele",
            "Major_allele", "major allele", "major_allele", "ALT", "alt", "ALT_allele", "OTHER_ALLELE"],
    "EA": ["effect_allele", "EA", "EffectAllele", "Effect_Allele", "Effect_allele", "A1", "a1", "ALLELE1",
           "Coded", "Allele1", "allele_B", "Minor allele", "Minor_allele", "minor allele", "minor_allele",
           "REF", "ref", "REF_allele", "effect_allel", "EFFECT_ALLELE"],
    "AF": ["EAF", "FREQ_Effect_Allele", "MAF", "A1FREQ", "maf1", "effect_allele_frequency", "Coded_freq",
           "minor_allele_frequency", "Freq1", "AF", "FREQ1", "af"],
    "Z": ["z", "Z", "Zscore"],
}

# Biobank layouts as (p column, beta column, se column, p transform).
BIOBANK_LAYOUTS = {
    "ln_meta": ("pval_meta", "beta_meta", "se_meta", "ln"),
    "ln_eur": ("pval_EUR", "beta_EUR", "se_EUR", "ln"),
    "log10_meta": ("neglog10_pval_meta", "beta_meta", "se_meta", "neglog10"),
    "log10_eur": ("neglog10_pval_EUR", "beta_EUR", "se_EUR", "neglog10"),
}

# Columns of the meta-analysis consortium files.
CONSORTIUM = {
    "#CHR": "Chromosome", "POS": "Position", "REF": "NEA", "ALT": "EA", "SNP": "SNPID",
    "all_inv_var_meta_beta": "BETA", "all_inv_var_meta_sebeta": "SE", "all_inv_var_meta_p": "P",
    "all_meta_AF": "AF", "rsid": "RSID",
}

REQUIRED = ["Chromosome", "Position", "RSID", "P", "BETA", "OR", "SE", "NEA", "EA", "AF", "Z"]


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def canon_columns(
    df: DataFrame, keep: tuple[str, ...] = ("dataset",), aliases: dict[str, list[str]] = ALIASES
) -> DataFrame:
    """Canonical columns from the first alias that holds a value.

    An alias column that is null throughout falls through to the next one, which
    `coalesce` gives row by row, so no pass over the data is needed to find it.
    """
    out = [quoted(c) for c in keep if c in df.columns]
    for target, names in aliases.items():
        found = [quoted(n) for n in names if n in df.columns]
        if found:
            out.append((found[0] if len(found) == 1 else F.coalesce(*found)).alias(target))
    return df.select(*out)


def biobank_layout(df: DataFrame) -> str:
    for name, (p, b, s, _) in BIOBANK_LAYOUTS.items():
        if {p, b, s} <= set(df.columns):
            return name
    raise ValueError("no known biobank layout in the columns")


def adapt_biobank(
    df: DataFrame, layout: str | None = None, population: str | None = None,
    keep: tuple[str, ...] = ("dataset",),
) -> DataFrame:
    """Biobank files: p is stored as ln p or as -log10 p.

    `population_ok` is false where the stated ancestry disagrees with the layout.
    """
    layout = layout or biobank_layout(df)
    p, b, s, how = BIOBANK_LAYOUTS[layout]
    p_value = F.exp(p) if how == "ln" else F.pow(F.lit(10.0), -F.col(p))
    out = df.select(
        *[c for c in keep if c in df.columns],
        F.col("chr").alias("Chromosome"),
        F.col("pos").alias("Position"),
        p_value.alias("P"),
        F.col(b).alias("BETA"),
        F.col(s).alias("SE"),
        F.col("ref").alias("NEA"),
        F.col("alt").alias("EA"),
    )
    if population is None:
        return out
    agrees = (population == "EUR") == layout.endswith("_eur")
    return out.withColumn("population_ok", F.lit(agrees))


def adapt_meta_consortium(df: DataFrame, keep: tuple[str, ...] = ("dataset",)) -> DataFrame:
    return df.select(
        *[c for c in keep if c in df.columns],
        *[quoted(src).alias(dst) for src, dst in CONSORTIUM.items()],
    )


def marker_split(df: DataFrame, marker: str = "MarkerName") -> DataFrame:
    """`chr1:123` to coordinates, only when the file has neither."""
    if "Chromosome" in df.columns or "Position" in df.columns:
        return df
    parts = F.split(marker, ":")
    return df.withColumns(
        {
            "Chromosome": F.regexp_replace(parts[0], "chr", ""),
            "Position": F.try_element_at(parts, F.lit(2)).try_cast("long"),
        }
    )


def prefer_beta(df: DataFrame) -> DataFrame:
    """BETA wins over OR; a file with neither is an error."""
    if "BETA" not in df.columns and "OR" not in df.columns:
        raise ValueError("no BETA or OR column")
    return df.drop("OR") if "BETA" in df.columns else df


def normalise_alleles(df: DataFrame) -> DataFrame:
    """Upper-case alleles; numbers are not alleles; `literal_ref` marks the text REF."""
    present = [a for a in ("NEA", "EA") if a in df.columns]
    for a in ("NEA", "EA"):
        if a in present:
            up = F.upper(F.col(a).cast("string"))
            value = F.when(up.try_cast("double").isNull(), up)
        else:
            value = F.lit(None).cast("string")
        df = df.withColumn(a, value)
    flag = F.coalesce(F.col("NEA") == "REF", F.lit(False)) | F.coalesce(F.col("EA") == "REF", F.lit(False))
    return df.withColumn("literal_ref", flag)


def bad_reason(columns: list[str]) -> Column:
    """Name of the first column that is null or not a number."""
    out = None
    for c in columns:
        v = as_col(c)
        ok = v.rlike(r"^\d+(\.0)?$") if c == "Position" else v.try_cast("double").isNotNull()
        reasons = F.when(v.isNull(), f"{c}: null").when(~ok, f"{c}: not numeric")
        out = reasons if out is None else F.coalesce(out, reasons)
    return out


def quarantine_bad(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows with a `bad_reason`)."""
    marked = df.withColumn("bad_reason", bad_reason(columns))
    good = marked.filter(F.col("bad_reason").isNull()).drop("bad_reason")
    return good, marked.filter(F.col("bad_reason").isNotNull())


def recode_chromosome(df: DataFrame, to: str = "letters", column: str = "Chromosome") -> DataFrame:
    """Strip `chr` and `.0`, True -> 1, and map the sex chromosomes either way."""
    c = F.regexp_replace(F.regexp_replace(F.col(column).cast("string"), "chr", ""), r"\.0$", "")
    c = F.when(c == "True", "1").otherwise(c)
    if to == "numbers":
        c = F.upper(c)
        c = F.when(c == "X", "23").when(c == "Y", "24").otherwise(c)
    else:
        c = F.when(c == "23", "X").when(c == "24", "Y").otherwise(c)
    return df.withColumn(column, F.nullif(c, F.lit("")))


def missing_columns(
    df: DataFrame, required: list[str] = REQUIRED, by: str = "dataset"
) -> DataFrame:
    """Per study, canonical columns that are absent or null throughout."""
    present = [c for c in required if c in df.columns]
    absent = [F.lit(c) for c in required if c not in df.columns]
    counts = df.groupBy(by).agg(*[F.count(c).alias(c) for c in present])
    names = F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in present], *absent)
    return counts.select(by, F.array_join(F.array_sort(F.array_compact(names)), ",").alias("missing"))

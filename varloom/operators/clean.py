"""Typed parsing and cleaning of association columns read as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.frames import with_missing
from varloom.functions.scalars import CHROMOSOMES, chr_order

# What a cell must look like to be kept.
PATTERNS = {
    "int": r"^\d+$",
    "signed_int": r"^-?\d+$",
    "float": r"^\d+(\.\d+)?(e-\d+)?$",
    "signed_float": r"^-?\d+(\.\d+)?(e-\d+)?$",
    "nucleotide": r"^[ATCG]+$",
    "chromosome": r"^([1-9]|1[0-9]|2[0-2]|X|Y|MT)$",
}
SPARK_TYPE = {
    "int": "long", "signed_int": "long", "float": "double", "signed_float": "double",
    "nucleotide": "string", "chromosome": "string",
}

COORDINATE_PROGRAM = ["Chromosome", "Position"]
ALLELE_PROGRAM = ["NEA", "EA"]
STAT_KINDS = {
    "P": "float", "BETA": "signed_float", "OR": "signed_float", "SE": "float",
    "Z": "signed_float", "AF": "float",
}
STATS_PROGRAM = list(STAT_KINDS)

INFO = ["Chromosome", "Position", "NEA", "EA", "SNPID", "RSID", "Original_RSID"]
STATS = ["P", "BETA", "SE", "Z", "AF"]
EXTRA = ["RA", "NRA", "Notes", "found"]


def _typed(value: Column, kind: str) -> tuple[Column, Column]:
    """(row is kept, typed value): null stays, text must match its pattern."""
    ok = value.isNull() | value.rlike(PATTERNS[kind])
    return ok, value.try_cast(SPARK_TYPE[kind])


def typed_parse(df: DataFrame, column: str, kind: str, signed: bool = False) -> DataFrame:
    """Keep nulls and well-formed cells of `column`, drop other rows, cast."""
    kind = f"signed_{kind}" if signed else kind
    have = dict(df.dtypes)[column]
    if have == SPARK_TYPE[kind] and have in ("long", "bigint", "double"):
        return df if signed else df.filter(F.col(column).isNull() | (F.col(column) >= 0))
    ok, value = _typed(F.col(column).cast("string"), kind)
    return df.filter(ok).withColumn(column, value)


# Chromosome text after the prefix -> canonical chromosome.
CHROMOSOME_OF = {**{c: c for c in CHROMOSOMES}, "23": "X", "24": "Y"}


def clean_chromosome(df: DataFrame, column: str = "Chromosome") -> DataFrame:
    """Drop a non-digit prefix and a trailing `.0`, keep the 25 valid values.

    One anchored pattern does the prefix, the suffix and the shape check.
    """
    token = F.regexp_extract(F.col(column).cast("string"), r"^[^\d+]*?(\d{1,2}|X|Y|MT)(?:\.0)?$", 1)
    table = F.create_map(*[F.lit(x) for kv in CHROMOSOME_OF.items() for x in kv])
    return (
        df.withColumn("_token", token)
        .withColumn("_chr", table[F.col("_token")])
        .filter(F.col(column).isNull() | F.col("_chr").isNotNull())
        .withColumn(column, F.col("_chr"))
        .drop("_token", "_chr")
        .select(*df.columns)
    )


def clean_position(df: DataFrame, column: str = "Position") -> DataFrame:
    """Unsigned integers, with or without a trailing `.0`."""
    if dict(df.dtypes)[column] in ("bigint", "int"):
        return df.filter(F.col(column).isNull() | (F.col(column) >= 0)).withColumn(
            column, F.col(column).cast("long")
        )
    text = F.col(column).cast("string")
    whole = F.substring_index(text, ".", 1).try_cast("long")
    return df.filter(text.isNull() | text.rlike(r"^\d+(\.0)?$")).withColumn(column, whole)


def clean_alleles(
    df: DataFrame, columns: tuple[str, ...] = ("NEA", "EA", "REF", "ALT")
) -> DataFrame:
    """`?` means missing; other cells must be plain nucleotides."""
    for c in [x for x in columns if x in df.columns]:
        v = F.col(c)
        df = df.filter(v.isNull() | v.rlike(r"^(\?|[ATCG]+)$")).withColumn(c, F.when(v != "?", v))
    return df


def clean_stat(df: DataFrame, column: str) -> DataFrame:
    kind = STAT_KINDS[column]
    have = dict(df.dtypes)[column]
    if have == "double":
        v = F.col(column)
        ok = v.isNull() | (F.lit(True) if kind.startswith("signed") else v >= 0)
        df = df.filter(ok & (v.isNull() | ~F.isnan(v)))
    else:
        df = typed_parse(df, column, kind)
    if column in ("P", "AF"):
        df = df.filter(F.col(column).isNull() | F.col(column).between(0.0, 1.0))
    return df


def clean_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    for c in columns or [x for x in STATS_PROGRAM if x in df.columns]:
        df = clean_stat(df, c)
    return df


# Column cleaner registry: name -> DataFrame function.
CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "Chromosome": clean_chromosome,
    "Position": clean_position,
    **{a: (lambda df, a=a: clean_alleles(df, (a,))) for a in ("NEA", "EA", "REF", "ALT")},
    **{s: (lambda df, s=s: clean_stat(df, s)) for s in STATS_PROGRAM},
}


def sanitize(
    df: DataFrame,
    program: list[str],
    recover: Callable[[DataFrame], DataFrame] | None = None,
    dropna: bool | list[str] = False,
) -> DataFrame:
    """Clean the program's columns in order, recover values, drop incomplete rows."""
    if not program:
        raise ValueError("empty cleaning program")
    unknown = [c for c in program if c not in CLEANERS]
    if unknown:
        raise ValueError(f"no cleaner for {unknown}")
    for c in program:
        df = CLEANERS[c](df)
    if recover is not None:
        df = df.transform(recover)
    required = program if dropna is True else (dropna or [])
    return df.dropna(subset=required) if required else df


def require_columns(
    df: DataFrame,
    mandatory: tuple[str, ...] = ("Chromosome", "Position", "NEA", "EA", "P"),
    optional: tuple[str, ...] = ("NEA", "EA"),
    first: tuple[str, ...] = ("dataset", "disease"),
) -> DataFrame:
    """Add optional columns as null, insist on mandatory ones, fix the column order."""
    df = with_missing(df, {c: "string" for c in optional})
    missing = [c for c in mandatory if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    order = [c for c in [*first, *INFO, *STATS, *EXTRA] if c in df.columns]
    return df.select(*order)


def significant(df: DataFrame, threshold: float = 5e-8, column: str = "P") -> DataFrame:
    return df.filter(F.col(column) <= threshold)


def canonical_contigs(df: DataFrame, column: str = "Chromosome", keep_all: bool = False) -> DataFrame:
    """Drop NW*, *alt and *random contigs."""
    if keep_all:
        return df
    c = F.col(column)
    return df.filter(~(c.startswith("NW") | c.endswith("alt") | c.endswith("random")))


def drop_nonfinite_z(df: DataFrame, column: str = "z") -> DataFrame:
    z = F.col(column)
    return df.filter(z.isNotNull() & ~F.isnan(z) & (F.abs(z) < F.lit(float("inf"))))


def eligible_analyses(
    df: DataFrame, is_stats: Column | str = "sum_stats", n: Column | str = "sample_size",
    by: str = "dataset",
) -> DataFrame:
    """Per study, the analyses its columns, kind and sample size allow."""
    cols = set(df.columns)
    stats = (F.col(is_stats) if isinstance(is_stats, str) else is_stats).cast("boolean")
    size = F.col(n) if isinstance(n, str) else n
    g = df.groupBy(by).agg(
        F.max(stats).alias("_stats"), F.max(size).alias("_n"), F.count("*").alias("_rows")
    )
    some, s = F.col("_rows") > 0, F.col("_stats")
    has_n = F.coalesce(F.col("_n") > 0, F.lit(False))
    p = F.lit("P" in cols)
    twas = F.lit({"P", "BETA", "SE", "Z"} <= cols)
    coloc = F.lit({"BETA", "SE"} <= cols) | (F.lit({"P", "AF"} <= cols) & has_n)
    return g.select(
        by,
        (p & some).alias("OVERLAP"),
        (p & s & some).alias("GARFIELD"),
        (twas & s & some).alias("TWAS"),
        (coloc & s & some).alias("COLOC"),
    )


def genome_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(chr_order("Chromosome"), "Position")


def top_list(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def qc_report(df: DataFrame, by: str = "dataset") -> DataFrame:
    """One pass over text columns: type, null and range checks per study."""
    num = {c: F.col(c).try_cast("double") for c in ("P", "BETA", "OR", "SE", "Z", "AF") if c in df.columns}
    chrom, pos = F.col("Chromosome").try_cast("int"), F.col("Position").try_cast("long")
    checks = {
        "chr_null": F.col("Chromosome").isNull(),
        "chr_not_int": F.col("Chromosome").isNotNull() & chrom.isNull(),
        "chr_range": ~chrom.between(1, 24),
        "pos_null": F.col("Position").isNull(),
        "pos_not_int": F.col("Position").isNotNull() & pos.isNull(),
    }
    for c, v in num.items():
        checks[f"{c.lower()}_not_float"] = F.col(c).isNotNull() & v.isNull()
    for c in ("P", "AF"):
        if c in num:
            checks[f"{c.lower()}_range"] = ~num[c].between(0.0, 1.0)
    if "SE" in num:
        checks["se_negative"] = num["SE"] < 0
    out = df.groupBy(by).agg(
        F.count("*").alias("rows"), *[F.count_if(cond).alias(n) for n, cond in checks.items()]
    )
    effect_missing = "BETA" not in df.columns and "OR" not in df.columns
    flags = [F.col(n) > 0 for n in checks]
    review = F.lit(effect_missing)
    for f in flags:
        review = review | f
    return out.withColumn("review", review)


def std_metrics(raw: DataFrame, std: DataFrame, by: str = "dataset") -> DataFrame:
    """Per study: input rows, output rows, rows in the panel, proportion."""
    a = raw.groupBy(by).agg(F.count("*").alias("n_entries"))
    b = std.groupBy(by).agg(F.count("*").alias("n_variants"), F.count_if("found").alias("n_in_panel"))
    zero = F.lit(0)
    return a.join(b, by, "left").select(
        by,
        "n_entries",
        F.coalesce("n_variants", zero).cast("long").alias("n_variants"),
        F.coalesce("n_in_panel", zero).cast("long").alias("n_in_panel"),
        F.coalesce(F.try_divide("n_in_panel", "n_variants"), F.lit(0.0)).alias("proportion"),
    )

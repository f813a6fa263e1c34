"""Scans. Text is read as strings and typed later, row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False)


def tidy_sumstats(df: DataFrame) -> DataFrame:
    """Strip `.0` from chromosomes, True -> 1, byte-ish text -> null."""
    cols = {}
    for c, t in df.dtypes:
        if t == "string":
            v = F.col(f"`{c}`")
            cols[c] = F.when(v.rlike("^b'.*'$"), None).otherwise(v)
    df = df.withColumns(cols)
    if "Chromosome" in df.columns:
        c = F.regexp_replace(F.col("Chromosome").cast("string"), r"\.0", "")
        df = df.withColumn("Chromosome", F.when(c == "True", "1").otherwise(c))
    return df


def scan_sumstats(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    return tidy_sumstats(read_delimited(spark, path, sep))


# Catalog column -> canonical column.
CATALOG_COLUMNS = {
    "CHR_ID": "Chromosome", "CHR_POS": "Position", "STRONGEST SNP-RISK ALLELE": "RSID",
    "P-VALUE": "P", "OR or BETA": "BETA", "RISK ALLELE FREQUENCY": "AF",
}


# Patterns of catalog cells: what separates values, a risk allele at the end, the same
# with its dash, and a place in stead of an id.
CATALOG_SEPARATOR = r"\s[x;]\s|;\s|\s"
CATALOG_ALLELE = r"([ACTGN]+)$"
CATALOG_ALLELE_TAIL = r"-[ACTGN?]+$"
CATALOG_PLACE = r"(?<![^A-z])((1[0-9]|2[0-4]|[1-9]|X|Y):\d+)$"


def scan_catalog(df: DataFrame, keep: tuple[str, ...] = (), cols: dict[str, str] = CATALOG_COLUMNS) -> DataFrame:
    """One row per variant of an association-catalog table.

    Multi-valued cells are split on ` x `, ` ; `, `; ` and white space and lined up by
    position. A statistic given once holds for every variant of its row, and each
    statistic reads its own cell.
    """
    present = {s: c for s, c in cols.items() if s in df.columns}
    parts = {
        c: F.split(F.regexp_replace(F.coalesce(F.col(f"`{s}`"), F.lit("")), CATALOG_SEPARATOR, ";"), ";")
        for s, c in present.items()
    }
    df = df.select(*[F.col(k) for k in keep], *[v.alias(f"_{c}") for c, v in parts.items()])
    ids = [c for c in ("Chromosome", "Position", "RSID") if c in parts]
    size = F.greatest(*[F.size(f"_{c}") for c in ids]) if len(ids) > 1 else F.size(f"_{ids[0]}")
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(1), size)))

    def pick(c: str) -> Column:
        arr = F.col(f"_{c}")
        item = F.try_element_at(arr, F.col("_i"))
        if c not in ids:
            item = F.when(F.size(arr) == 1, arr[0]).otherwise(item)
        return F.nullif(item, F.lit(""))

    df = df.select(*keep, F.col("_i").alias("item"), *[pick(c).alias(c) for c in parts])
    raw = F.col("RSID")
    allele = F.nullif(F.regexp_extract(raw, CATALOG_ALLELE, 1), F.lit(""))
    bare = F.regexp_replace(raw, CATALOG_ALLELE_TAIL, "")
    bare = F.when(bare == "", raw).otherwise(bare)
    place = F.regexp_extract(bare, CATALOG_PLACE, 1)
    embedded = place != ""
    bits = F.split(place, ":")
    null = F.lit(None).cast("string")
    out = df.withColumns(
        {
            "EA": allele,
            "NEA": null,
            "Chromosome": F.when(embedded, bits[0]).otherwise(F.col("Chromosome")),
            "Position": F.when(embedded, bits[1]).otherwise(F.col("Position")),
            "RSID": F.when(embedded, null).otherwise(bare),
        }
    )
    return out.withColumn("AF", F.nullif("AF", F.lit("NR"))) if "AF" in out.columns else out


def scan_panel(spark: SparkSession, path: str, genome: str | None = None) -> DataFrame:
    """Panel stored as Parquet partitioned by genome and/or Chromosome."""
    df = spark.read.parquet(path).withColumn("Chromosome", F.col("Chromosome").cast("string"))
    return df.filter(F.col("genome") == genome) if genome else df


def panel_lookup(panel: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Panel rows by site, RSID, SNPID or chromosome: a semi-join, never an IN list."""
    return panel.join(wanted.select(*on).distinct(), on, "left_semi")


def scan_intervals(
    spark: SparkSession, path: str, chrom: str | None = None, start: str | None = None,
    end: str | None = None, sep: str = "\t",
) -> DataFrame:
    """First three columns, or three named ones (all or none)."""
    named = [chrom, start, end]
    if any(named) and not all(named):
        raise ValueError("name all of chrom, start, end or none")
    df = spark.read.csv(path, sep=sep, header=bool(chrom))
    cols = named if chrom else df.columns[:3]
    return df.select(
        F.regexp_replace(F.col(f"`{cols[0]}`"), "^chr", "").alias("Chromosome"),
        F.col(f"`{cols[1]}`").try_cast("long").alias("Start"),
        F.col(f"`{cols[2]}`").try_cast("long").alias("End_"),
    )


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))


def scan_bim(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _fields(spark, path).select(
        f[0].alias("Chromosome"), f[1].alias("id"), f[2].cast("double").alias("cM"),
        f[3].cast("long").alias("Position"),
    )


# Key columns of an annotation matrix.
ANNOT_KEYS = ["CHR", "BP", "SNP", "CM"]


def scan_annot(spark: SparkSession, path: str, long: bool = True) -> DataFrame:
    """Annotation matrix (Spark reads gz itself); long form has (keys, label, value)."""
    df = read_delimited(spark, path)
    labels = [c for c in df.columns if c not in ANNOT_KEYS]
    df = df.select(*ANNOT_KEYS, *[F.col(f"`{c}`").cast("int").alias(c) for c in labels])
    return df.unpivot(ANNOT_KEYS, labels, "label", "value") if long else df


def scan_ld_pairs(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _fields(spark, path).filter(f[2] != "SNP_A").select(
        f[2].alias("Lead"), f[5].alias("LD"), F.element_at(f, -1).try_cast("double").alias("r2")
    )


def scan_manifest(
    df: DataFrame, flag: str | None = None, category: int | None = None, project: str | None = None,
    need_size: bool = False,
) -> DataFrame:
    """Distinct usable studies, selected by project, category, analysis flag and size."""
    df = df.dropDuplicates()
    if "messy" in df.columns:
        messy = F.regexp_replace(F.coalesce(F.col("messy").cast("string"), F.lit("0")), r"\.0$", "")
        df = df.filter(messy.try_cast("int") == 0)
    if project is not None and "project" in df.columns:
        df = df.filter(F.col("project") == project)
    if category is not None:
        df = df.filter(F.col("Category") == category)
    if flag is not None:
        df = df.filter(F.col(flag).cast("boolean"))
    return df.filter(F.col("sample_size") > 0) if need_size else df


def study_key(df: DataFrame, sizes: DataFrame | None = None, name: str = "sample_name", build: str = "build") -> DataFrame:
    """`<sample>_<build>`, and the sample size when a size table is given."""
    out = df.withColumn("study", F.concat_ws("_", name, build))
    return out if sizes is None else out.join(sizes.select(name, F.col("sample_size").alias("N")), name, "left")


def file_format(name: str) -> str:
    """VCF, TSV or CSV from a file name, ignoring gz and bgz."""
    parts = name.lower().split(".")
    while parts and parts[-1] in ("gz", "bgz"):
        parts.pop()
    kinds = {"vcf": "VCF", "tsv": "TSV", "txt": "TSV", "ssf": "TSV", "csv": "CSV"}
    if not parts or parts[-1] not in kinds:
        raise ValueError(f"unknown file type: {name}")
    return kinds[parts[-1]]


def only_match(paths: list[str], key: str) -> str:
    hits = [p for p in paths if key in p]
    if len(hits) != 1:
        raise ValueError(f"{key}: expected one file, found {len(hits)}")
    return hits[0]


def scan_vcf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(Chromosome, Position, id, NEA, EA, qual, filter, info, sample, fields, allele): text VCF, a row per allele and sample.

    Every file's own `#CHROM` line names its samples, wherever a split of the file starts. `fields` maps the
    keys of the row's FORMAT to the sample's values, whatever their order; values that a row leaves off at the end and `.`
    are absent. `info` maps keys to values, a flag to an empty text. A file without samples gives rows
    with a null sample and no fields; `allele` counts the alternatives of a line from 0.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("_file"), "value").filter("NOT startswith(value, '##')")
    heads = lines.filter("startswith(value, '#')").select(F.col("_file").alias("_head"), F.split("value", "\t").alias("_cols"))
    f = F.split("value", "\t")
    rows = lines.filter("NOT startswith(value, '#') AND value <> ''").select("_file", f.alias("f")).join(heads, F.col("_file") == F.col("_head"))
    present = lambda c: F.nullif(c, F.lit("."))
    info = F.transform(F.split(F.coalesce(present(F.get("f", 7)), F.lit("")), ";"), lambda x: F.split(x, "=", 2))
    info = F.map_from_entries(F.array_distinct(F.transform(F.filter(info, lambda x: x[0] != ""), lambda x: F.struct(x[0], F.coalesce(F.get(x, 1), F.lit(""))))))
    samples = F.when(F.size("f") > 9, F.slice("f", 10, F.size("f"))).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select(
        F.regexp_replace(F.get("f", 0), "^chr", "").alias("Chromosome"), F.get("f", 1).alias("Position"), present(F.get("f", 2)).alias("id"),
        F.get("f", 3).alias("NEA"), F.split(F.get("f", 4), ",").alias("_alts"), present(F.get("f", 5)).alias("qual"),
        present(F.get("f", 6)).alias("filter"), info.alias("info"), F.split(F.coalesce(F.get("f", 8), F.lit("")), ":").alias("_keys"),
        "_cols", F.posexplode(samples).alias("_at", "_value"),
    )
    values = F.split("_value", ":")
    pairs = F.filter(F.zip_with("_keys", values, lambda k, v: F.struct(k.alias("k"), present(v).alias("v"))), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    fields = F.when(F.col("_value").isNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.map_from_entries(pairs))
    rows = rows.withColumns({"sample": F.get("_cols", F.col("_at") + 9), "fields": fields})
    return rows.select("*", F.posexplode("_alts").alias("allele", "EA")).select(
        "Chromosome", "Position", "id", "NEA", "EA", "qual", "filter", "info", "sample", "fields", "allele"
    )


# Fields of association results in VCF -> column.
VCF_FIELDS = {"ES": "BETA", "SE": "SE", "EZ": "Z", "AF": "AF", "SS": "N"}


def vcf_sumstats(vcf: DataFrame) -> DataFrame:
    """Association rows of `scan_vcf` as text columns; a sample without any value has no row.

    A field with a value for each alternative gives the allele its own. LP is -log10 of P.
    """

    def own(key: str) -> Column:
        v = F.split(F.try_element_at("fields", F.lit(key)), ",")
        return F.nullif(F.when(F.size(v) > 1, F.get(v, F.col("allele"))).otherwise(F.get(v, 0)), F.lit("."))

    p = F.pow(F.lit(10.0), -own("LP").try_cast("double")).cast("string")
    return vcf.filter(F.size("fields") > 0).select(
        F.col("sample").alias("dataset"), "Chromosome", "Position", F.coalesce(own("ID"), "id").alias("RSID"), "NEA", "EA",
        p.alias("P"), *[own(k).alias(c) for k, c in VCF_FIELDS.items()],
    )


def scan_by_extension(spark: SparkSession, paths: list[str]) -> DataFrame:
    """TSV, CSV and text VCF files together, columns matched by name; VCF gives its association rows."""
    groups: dict[str, list[str]] = {}
    for p in paths:
        groups.setdefault(file_format(p), []).append(p)
    seps = {"TSV": "\t", "CSV": ","}
    frames = [vcf_sumstats(scan_vcf(spark, ps)) if k == "VCF" else read_delimited(spark, ps, seps[k]) for k, ps in sorted(groups.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# QTL dialect -> (source column, target column).
QTL_DIALECTS = {
    "with_rsid": [("GENEID", "gene"), ("rsid", "rsid"), ("SNPID", "varID"), ("ref", "ref_allele"),
             ("alt", "eff_allele"), ("BETA", "weight"), ("P", "pval")],
    "maybe_rsid": [("GENEID", "gene"), ("rsid", "rsid"), ("RSID", "rsid"), ("SNPID", "varID"), ("ref", "ref_allele"),
             ("alt", "eff_allele"), ("BETA", "weight"), ("P", "pval")],
}
OPTIONAL_QTL = {"maybe_rsid": {"rsid", "RSID"}, "with_rsid": set()}


def scan_qtl_dialect(df: DataFrame, dialect: str, keep: tuple[str, ...] = ()) -> DataFrame:
    cols, done = [], set()
    for src, dst in QTL_DIALECTS[dialect]:
        if dst in done or (src in OPTIONAL_QTL[dialect] and src not in df.columns):
            continue
        cols.append(F.col(src).alias(dst))
        done.add(dst)
    out = df.select(*keep, *cols)
    return out.withColumn("Chromosome", F.concat(F.lit("chr"), F.split("varID", ":")[0]))


def _gtf_attr(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", f'{name} "([^"]+)"', 1), F.lit(""))


def scan_genes(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    """Distinct (gene, genename, gene_type) of GTF gene rows, for a gene list."""
    schema = ("seqname string, source string, feature string, start long, `end` long, score string, "
              "strand string, frame string, attributes string")
    df = spark.read.csv(path, sep="\t", schema=schema, comment="#", quote="")
    df = df.filter("feature = 'gene'").select(
        _gtf_attr("gene_id").alias("gene"), _gtf_attr("gene_name").alias("genename"),
        _gtf_attr("gene_type").alias("gene_type"),
    )
    if genes is not None:
        df = df.join(genes.select("gene"), "gene", "left_semi")
    return df.distinct()


def scan_weights(spec: list[dict]) -> DataFrame:
    """Prediction weights: one entry per (type, context) with a DataFrame under `df`."""
    frames = [
        s["df"].withColumns({"type": F.lit(s["type"]), "context": F.lit(s["context"])}) for s in spec
    ]
    return reduce(DataFrame.unionByName, frames)


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature dictionary with its 1-based order, plain or gz."""
    df = spark.read.csv(path, sep="\t", schema="ensembl string, name string, kind string")
    return df


def scan_counts_10x(
    spark: SparkSession, matrix: str, features: DataFrame, barcodes: DataFrame, feature_id: str = "ensembl"
) -> DataFrame:
    """MatrixMarket triples to (cell, gene, umi).

    `features` and `barcodes` carry their 1-based line number in `ix`. Comment lines go,
    and so does the size line: the first line after the comments of a file that has any.
    """
    lines = spark.read.text(matrix).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_n"),
    )
    comment = F.col("value").startswith("%")
    size = lines.groupBy("_f").agg(
        F.max(comment).alias("_has"), F.min_by(F.when(~comment, F.col("value")), F.when(~comment, F.struct("_b", "_n"))).alias("value")
    ).filter("_has").select("_f", "value")
    data = lines.filter(~comment).join(size, ["_f", "value"], "left_anti")
    f = F.split("value", r"\s+")
    triples = data.select(
        f[0].cast("long").alias("_f"), f[1].cast("long").alias("_c"), f[2].cast("long").alias("umi")
    )
    genes = features.select(F.col("ix").alias("_f"), F.col(feature_id).alias("gene"))
    cells = barcodes.select(F.col("ix").alias("_c"), F.col("barcode").alias("cell"))
    return triples.join(genes, "_f").join(cells, "_c").select("cell", "gene", "umi")


def scan_lane_table(df: DataFrame, lane_ids: list[str]) -> DataFrame:
    """Aggregation table with a 1-based `lane` and `;` lane tags as columns."""
    tags = F.split("lane_tag", ";")
    return df.withColumns(
        {name: F.nullif(F.try_element_at(tags, F.lit(i + 1)), F.lit("NA")) for i, name in enumerate(lane_ids)}
    )


def scan_lane_classes(spark: SparkSession, path: str, lane_regex: str = r"lane-(\d+)") -> DataFrame:
    """Per-lane barcode classification files; the lane comes from the file path."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumn(
        "lane", F.regexp_extract(F.col("_metadata.file_path"), lane_regex, 1).cast("int")
    )


def scan_with_provenance(
    spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t"
) -> DataFrame:
    """Many result files at once, with columns parsed from each file's path."""
    df = spark.read.csv(path, sep=sep, header=True, recursiveFileLookup=True)
    where = F.col("_metadata.file_path")
    return df.select(
        "*", *[F.nullif(F.regexp_extract(where, rx, 1), F.lit("")).alias(c) for c, rx in columns.items()]
    )


def scan_json_metrics(df: DataFrame, names: dict[str, str], column: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat JSON metrics `<library>_<metric>` to (library, metric, value).

    `names` maps a metric's name in the file to its short name.
    """
    any_name = "|".join(names)
    entries = df.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("key", "text"))
    raw = F.regexp_extract("key", f"({any_name})", 1)
    short = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return entries.filter(raw != "").select(
        *keep,
        F.regexp_replace("key", f"_?({any_name})", "").alias("library"),
        short[raw].alias("metric"),
        F.col("text").try_cast("double").alias("value"),
    )

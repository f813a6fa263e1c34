"""Queries over association tables: scans, cleaning, panel matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import clean, ingest, panel
from varloom.plans.registry import query
from varloom.sources import readers, sinks

LP = "round(-log10(P), 6)"


def lp(c: str = "P"):
    return F.round(-F.log10(c), 6)


# --- scans -------------------------------------------------------------------

CHR_CLEAN = """CASE WHEN regexp_matches(Chromosome, '\\.0') THEN replace(Chromosome, '.0', '')
               WHEN Chromosome = 'True' THEN '1' ELSE Chromosome END"""


@query(
    "scan_sumstats",
    f"""SELECT dataset, CAST(line AS VARCHAR) AS line, {CHR_CLEAN} AS Chromosome, Position, P,
               CASE WHEN BETA = 'b''''' THEN NULL ELSE BETA END AS BETA FROM {{raw_gwas}}""",
)
def _(t):
    path = sinks.scratch(t.spark, "sumstats")
    sinks.sink_tsv(t.raw_gwas.select("dataset", "line", "Chromosome", "Position", "P", "BETA"), path)
    return readers.scan_sumstats(t.spark, path)


CATALOG = """
SELECT p_partkey AS row_no,
       CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 22 + 1 AS VARCHAR(4)) || ';' || CAST(p_size % 21 + 1 AS VARCHAR(4))
            ELSE CAST(p_size % 22 + 1 AS VARCHAR(4)) END AS CHR_ID,
       CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR(12)) || ' x ' || CAST(p_partkey + 7 AS VARCHAR(12))
            WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR(12)) END AS CHR_POS,
       CASE WHEN p_size % 3 = 0 THEN 'rs' || CAST(p_partkey AS VARCHAR(12)) || '-A; rs' || CAST(p_partkey + 1 AS VARCHAR(12)) || '-?'
            WHEN p_size % 7 = 0 THEN 'chr' || CAST(p_size % 22 + 1 AS VARCHAR(4)) || ':' || CAST(p_partkey * 3 AS VARCHAR(12))
            ELSE 'rs' || CAST(p_partkey AS VARCHAR(12)) || '-TC' END AS snp,
       CAST(p_size AS VARCHAR(4)) || 'E-9' AS pv,
       CASE WHEN p_size % 3 = 0 THEN '0.1;0.2' ELSE '0.3' END AS eff,
       CASE WHEN p_size % 3 = 0 THEN 'NR' ELSE '0.25' END AS raf
FROM {part}
"""


@query(
    "scan_catalog",
    f"""WITH c AS ({CATALOG})
    SELECT row_no, CAST(1 AS INT) AS item,
           split_part(CHR_ID, ';', 1) AS Chromosome,
           CASE WHEN snp LIKE 'chr%' THEN split_part(snp, ':', 2) ELSE split_part(CHR_POS, ' x ', 1) END AS Position,
           CASE WHEN snp LIKE 'chr%' THEN NULL ELSE split_part(split_part(snp, ';', 1), '-', 1) END AS RSID,
           pv AS P, split_part(eff, ';', 1) AS BETA, nullif(raf, 'NR') AS AF,
           CASE WHEN snp LIKE '%;%' THEN 'A' WHEN snp LIKE 'chr%' THEN NULL ELSE 'TC' END AS EA, CAST(NULL AS VARCHAR) AS NEA
    FROM c
    UNION ALL
    SELECT row_no, CAST(2 AS INT), split_part(CHR_ID, ';', 2), split_part(CHR_POS, ' x ', 2),
           split_part(split_part(snp, '; ', 2), '-', 1), pv, '0.2', NULL, NULL, NULL
    FROM c WHERE snp LIKE '%;%'""",
)
def _(t):
    src = t.sql(CATALOG).withColumnsRenamed(
        {"snp": "STRONGEST SNP-RISK ALLELE", "pv": "P-VALUE", "eff": "OR or BETA", "raf": "RISK ALLELE FREQUENCY"}
    )
    return readers.scan_catalog(src, keep=("row_no",))


@query(
    "scan_panel",
    """SELECT p.Chromosome, p.Position, p.REF, p.ALT, p.SNPID, p.RSID FROM {panel_multi} p
       WHERE EXISTS (SELECT 1 FROM {gwas} g WHERE g.Chromosome = p.Chromosome AND g.Position = p.Position AND g.P <= 5e-8)""",
)
def _(t):
    wanted = clean.significant(t.gwas)
    return readers.panel_lookup(t.panel_multi, wanted, ["Chromosome", "Position"])


@query("scan_intervals", "SELECT Chromosome, Start, End_ FROM {blocks}")
def _(t):
    path = sinks.scratch(t.spark, "intervals")
    sinks.sink_tsv(t.blocks.withColumn("Chromosome", F.concat(F.lit("chr"), "Chromosome")), path)
    return readers.scan_intervals(t.spark, path, "Chromosome", "Start", "End_")


@query("scan_bim", 'SELECT Chromosome, RSID AS id, CAST(0.5 AS DOUBLE) AS "cM", Position FROM {panel}')
def _(t):
    path = sinks.scratch(t.spark, "bim")
    t.panel.select(
        F.concat_ws("\t", "Chromosome", "RSID", F.lit("0.5"), F.col("Position").cast("string"), "REF", "ALT")
    ).write.text(path)
    return readers.scan_bim(t.spark, path)


@query("scan_ld_pairs", "SELECT SNPID AS Lead, RSID AS LD, Position % 100 / CAST(100 AS DOUBLE) AS r2 FROM {panel}")
def _(t):
    path = sinks.scratch(t.spark, "ld")
    rows = t.panel.select(
        F.concat_ws("  ", "Chromosome", "Position", "SNPID", "Chromosome", "Position", "RSID",
                    (F.col("Position") % 100 / 100).cast("string")).alias("value")
    )
    rows.write.text(path)
    return readers.scan_ld_pairs(t.spark, path)


@query(
    "scan_manifest",
    """SELECT DISTINCT sample_name, disease, messy, Category, sum_stats, sample_size, build, COLOC, Link
       FROM {manifest} WHERE messy = '0' AND COLOC AND Category = 2 AND sample_size > 0""",
)
def _(t):
    return readers.scan_manifest(t.manifest, flag="COLOC", category=2, need_size=True)


@query(
    "study_key",
    """SELECT a.sample_name, a.disease, a.sample_name || '_' || a.build AS study, b.sample_size AS N
       FROM {manifest} a LEFT JOIN {manifest} b ON a.sample_name = b.sample_name""",
)
def _(t):
    m = t.manifest
    keyed = readers.study_key(m.select("sample_name", "disease", "build"), m.select("sample_name", "sample_size"))
    return keyed.select("sample_name", "disease", "study", "N")


@query("scan_by_extension", "SELECT dataset, CAST(line AS VARCHAR) AS line, Chromosome, Position FROM {raw_gwas}")
def _(t):
    base = sinks.scratch(t.spark, "mixed")
    raw = t.raw_gwas.select("dataset", "line", "Chromosome", "Position")
    sinks.sink_tsv(raw.filter("dataset < 'GCST4'"), f"{base}/a.tsv")
    sinks.sink_tsv(raw.filter("dataset >= 'GCST4'"), f"{base}/b.csv", sep=",")
    return readers.scan_by_extension(t.spark, [f"{base}/a.tsv", f"{base}/b.csv"])


def _write_vcf(t, path: str, studies: list[str], order: list[str]) -> None:
    """Association rows as one text VCF: a line a variant, a column a study, fields in the given order."""
    text = {"ES": F.col("BETA"), "SE": F.col("SE"), "LP": -F.log10("P"), "AF": F.col("AF"), "ID": F.col("RSID")}
    value = F.concat_ws(":", *[text[k].cast("string") for k in order])
    wide = t.sumstats.filter(F.col("dataset").isin(studies)).withColumn("v", value).groupBy("Chromosome", "Position", "RSID", "NEA", "EA")
    wide = wide.pivot("dataset", studies).agg(F.max("v")).fillna(".", subset=studies)
    body = wide.select(F.lit(1).alias("o"), F.concat_ws(
        "\t", "Chromosome", F.col("Position").cast("string"), F.lit("."), "NEA", "EA", F.lit("."), F.lit("PASS"), F.lit("DB;NS=3"), F.lit(":".join(order)), *studies,
    ).alias("value"))
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *studies])
    top = t.spark.createDataFrame([(0, "##fileformat=VCFv4.2"), (0, head)], "o int, value string")
    body.unionByName(top).repartition(1).sortWithinPartitions("o", "value").select("value").write.text(path)


@query("scan_vcf", """SELECT dataset, Chromosome, Position, RSID, NEA, EA, round(-log10(P), 6) AS P, BETA, SE, AF FROM {sumstats}""")
def _(t):
    base = sinks.scratch(t.spark, "vcf")
    _write_vcf(t, f"{base}/a.vcf", ["GCST1", "GCST2", "GCST3"], ["ES", "SE", "LP", "AF", "ID"])
    _write_vcf(t, f"{base}/b.vcf", ["GCST4", "GCST5", "GCST6", "GCST7"], ["ID", "LP", "AF", "SE", "ES"])
    out = readers.scan_by_extension(t.spark, [f"{base}/a.vcf", f"{base}/b.vcf"])
    num = {c: F.col(c).cast("double") for c in ("P", "BETA", "SE", "AF")}
    return out.withColumns(num).select("dataset", "Chromosome", F.col("Position").cast("long").alias("Position"), "RSID", "NEA", "EA", lp().alias("P"), "BETA", "SE", "AF")


@query(
    "scan_qtl_dialect",
    """SELECT CELL, GENEID AS gene, SNPID AS varID, split_part(SNPID, ':', 3) AS ref_allele, split_part(SNPID, ':', 4) AS eff_allele,
              BETA AS weight, round(-log10(P), 6) AS pval, 'chr' || Chromosome AS Chromosome FROM {qtl}""",
)
def _(t):
    q = t.qtl.withColumns({"ref": F.split("SNPID", ":")[2], "alt": F.split("SNPID", ":")[3], "P": lp()})
    return readers.scan_qtl_dialect(q.drop("Chromosome"), "maybe_rsid", keep=("CELL",))


@query("scan_genes", "SELECT DISTINCT GENEID AS gene, GENENAME AS genename, gene_type FROM {genes} WHERE GENEID IN (SELECT GENEID FROM {qtl})")
def _(t):
    path = sinks.scratch(t.spark, "gtf")
    line = F.concat_ws(
        "\t", F.concat(F.lit("chr"), "Chromosome"), F.lit("src"), F.lit("gene"), F.col("Start").cast("string"),
        F.col("End_").cast("string"), F.lit("."), F.lit("+"), F.lit("."),
        F.concat(F.lit('gene_id "'), "GENEID", F.lit('"; gene_type "'), "gene_type", F.lit('"; gene_name "'),
                 "GENENAME", F.lit('";')),
    )
    t.genes.select(line).write.text(path)
    return readers.scan_genes(t.spark, path, t.qtl.select(F.col("GENEID").alias("gene")))


WEIGHTS = """SELECT GENEID AS gene, SNPID AS id, split_part(SNPID, ':', 3) AS ref, split_part(SNPID, ':', 4) AS alt,
             max(BETA) AS weight FROM {{qtl}} WHERE CELL LIKE '%_{n}' GROUP BY GENEID, SNPID"""


@query(
    "scan_weights",
    f"""SELECT *, 'expression' AS type, 'a' AS context FROM ({WEIGHTS.format(n=0)})
        UNION ALL SELECT *, 'expression' AS type, 'b' AS context FROM ({WEIGHTS.format(n=1)})""",
)
def _(t):
    return readers.scan_weights(
        [
            {"df": t.sql(WEIGHTS.format(n=i)), "type": "expression", "context": c}
            for i, c in enumerate("ab")
        ]
    )


@query("scan_counts_10x", "SELECT cell, gene, umi FROM {counts}")
def _(t):
    base = sinks.scratch(t.spark, "matrix")
    counts = t.counts
    genes = t.features.select("ensembl", "name").withColumn("ix", F.substring("ensembl", 5, 11).cast("long") + 1)
    triples = counts.select(
        F.concat_ws(" ", (F.substring("gene", 5, 11).cast("long") + 1).cast("string"),
                    (F.col("cell") + 1).cast("string"), F.col("umi").cast("string")).alias("value")
    )
    head = t.spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), ("200 1 1",)], "value string")
    head.coalesce(1).write.text(f"{base}/0head")
    triples.write.text(f"{base}/1body")
    cells = t.orders.select((F.col("o_orderkey") + 1).alias("ix"), F.col("o_orderkey").alias("barcode"))
    return readers.scan_counts_10x(t.spark, f"{base}/*", genes, cells)


@query("scan_features", "SELECT ensembl, name, kind FROM {features}")
def _(t):
    path = sinks.scratch(t.spark, "features")
    t.features.write.csv(path, sep="\t", compression="gzip")
    return readers.scan_features(t.spark, path)


@query("scan_with_provenance", "SELECT SNPID, dataset1 AS study, disease AS disease_name FROM {coloc_hits}")
def _(t):
    base = sinks.scratch(t.spark, "provenance")
    t.coloc_hits.select("dataset1", "disease", "SNPID", "PPH4").write.partitionBy("disease", "dataset1").csv(
        base, sep="\t", header=True
    )
    return readers.scan_with_provenance(
        t.spark, base, {"study": r"dataset1=([^/]+)", "disease_name": r"disease=([^/]+)"}
    ).drop("PPH4")


@query(
    "scan_json_metrics",
    """SELECT event_id, 'lib' || CAST(user_id AS VARCHAR) AS library, 'kept' AS metric,
              CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM {events}""",
)
def _(t):
    js = F.regexp_replace("props", '"k"', F.concat(F.lit('"lib'), F.col("user_id").cast("string"), F.lit('_frac_reads_kept"')))
    df = t.events.select("event_id", js.alias("json"))
    return readers.scan_json_metrics(df, {"frac_reads_kept": "kept"}, keep=("event_id",))


@query(
    "sink_tsv",
    "SELECT dataset, disease, Chromosome, CAST(Position AS VARCHAR) AS Position, NEA, EA FROM {gwas}",
)
def _(t):
    path = sinks.scratch(t.spark, "tsv")
    sinks.sink_tsv(t.gwas.select("dataset", "disease", "Chromosome", "Position", "NEA", "EA"), path)
    return readers.read_delimited(t.spark, path)


@query("sink_by_chromosome", "SELECT GENEID, SNPID, CAST(Position AS VARCHAR) AS Position, CAST(Chromosome AS INT) AS CHR FROM {qtl}")
def _(t):
    path = sinks.scratch(t.spark, "bychr")
    sinks.sink_by_chromosome(
        t.qtl.select("GENEID", "SNPID", "Position", F.col("Chromosome").alias("CHR")), path, ["GENEID", "Position"]
    )
    return readers.read_delimited(t.spark, path)


@query(
    "scan_annot",
    """SELECT Chromosome AS "CHR", CAST(Position AS VARCHAR) AS "BP", SNPID AS "SNP", '0.0' AS "CM", l.label, CAST(CASE WHEN (REF = 'A') = (l.label = 'isA') THEN 1 ELSE 0 END AS INT) AS value
       FROM {panel} JOIN (SELECT 'isA' AS label UNION ALL SELECT 'notA') l ON TRUE""",
)
def _(t):
    return readers.scan_annot(t.spark, _annot_file(t))


@query(
    "sink_annot_gz",
    """SELECT Chromosome AS "CHR", CAST(Position AS VARCHAR) AS "BP", SNPID AS "SNP", '0.0' AS "CM", CAST(REF = 'A' AS INT) AS "isA", CAST(REF <> 'A' AS INT) AS "notA" FROM {panel}""",
)
def _(t):
    return readers.scan_annot(t.spark, _annot_file(t), long=False)


def _annot_file(t) -> str:
    path = sinks.scratch(t.spark, "annot")
    keys = t.panel.select(
        F.col("Chromosome").alias("CHR"), F.col("Position").alias("BP"), F.col("SNPID").alias("SNP"), F.lit(0.0).alias("CM"), "REF"
    )
    long = keys.withColumn("label", F.when(F.col("REF") == "A", "isA").otherwise("notA")).withColumn("value", F.lit(1))
    sinks.sink_annot_gz(long.drop("REF"), path, ["isA", "notA"])
    return path


# --- canonicalisation --------------------------------------------------------


@query(
    "canon_columns",
    """SELECT dataset, Chromosome, Position, round(-log10(P), 6) AS P, BETA, SE, EA AS NEA, NEA AS EA, AF FROM {gwas}""",
)
def _(t):
    raw = t.gwas.select(
        "dataset", F.col("Chromosome").alias("chrom_text"), F.lit(None).cast("string").alias("Chr"),
        F.col("Chromosome").alias("CHROM"), F.col("Position").alias("base_pair_location"), lp().alias("p-value"),
        F.col("BETA").alias("EFFECT"), F.col("SE").alias("StdErr"), F.col("NEA").alias("REF"), F.col("EA").alias("ALT"),
        F.col("AF").alias("EAF"),
    )
    return ingest.canon_columns(raw)


@query(
    "adapt_biobank",
    """SELECT dataset, Chromosome, Position, round(l_quantity_p, 9) AS P, BETA, SE, NEA, EA, FALSE AS population_ok
       FROM (SELECT *, exp(-5.0 * AF) AS l_quantity_p FROM {gwas})""",
)
def _(t):
    raw = t.gwas.select(
        "dataset", F.col("Chromosome").alias("chr"), F.col("Position").alias("pos"), (F.lit(-5.0) * F.col("AF")).alias("pval_meta"),
        F.col("BETA").alias("beta_meta"), F.col("SE").alias("se_meta"), F.col("NEA").alias("ref"), F.col("EA").alias("alt"),
    )
    return ingest.adapt_biobank(raw, population="EUR").withColumn("P", F.round("P", 9))


@query(
    "adapt_meta_consortium",
    """SELECT dataset, Chromosome, Position, NEA, EA, SNPID, BETA, SE, round(-log10(P), 6) AS P, AF, RSID FROM {sumstats}""",
)
def _(t):
    names = {v: k for k, v in ingest.CONSORTIUM.items()}
    return ingest.adapt_meta_consortium(t.sumstats.withColumnsRenamed(names)).withColumn("P", lp())


@query(
    "marker_split",
    "SELECT dataset, Chromosome, Position, BETA FROM {sumstats}",
)
def _(t):
    raw = t.sumstats.select(
        "dataset", "BETA", F.concat(F.lit("chr"), "Chromosome", F.lit(":"), F.col("Position").cast("string")).alias("MarkerName")
    )
    return ingest.marker_split(raw).drop("MarkerName")


@query("prefer_beta", "SELECT dataset, Chromosome, Position, BETA FROM {gwas}")
def _(t):
    return ingest.prefer_beta(t.gwas.select("dataset", "Chromosome", "Position", "BETA", F.exp("BETA").alias("OR")))


@query(
    "normalise_alleles",
    """SELECT line, CASE WHEN regexp_matches(NEA, '^[0-9]+$') THEN NULL ELSE upper(NEA) END AS NEA,
              CASE WHEN regexp_matches(EA, '^[0-9]+$') THEN NULL ELSE upper(EA) END AS EA,
              coalesce(upper(NEA) = 'REF', FALSE) OR coalesce(upper(EA) = 'REF', FALSE) AS literal_ref FROM {raw_gwas}""",
)
def _(t):
    return ingest.normalise_alleles(t.raw_gwas.select("line", "NEA", "EA"))


@query(
    "quarantine_bad",
    """SELECT line, Position, P, bad_reason FROM (SELECT line, Position, P,
         CASE WHEN Position IS NULL THEN 'Position: null' WHEN NOT regexp_matches(Position, '^[0-9]+(\\.0)?$') THEN 'Position: not numeric'
              WHEN P IS NULL THEN 'P: null' WHEN try_cast(P AS DOUBLE) IS NULL THEN 'P: not numeric' END AS bad_reason FROM {raw_gwas})
       WHERE bad_reason IS NOT NULL""",
)
def _(t):
    return ingest.quarantine_bad(t.raw_gwas.select("line", "Position", "P"), ["Position", "P"])[1]


@query(
    "quarantine_good",
    """SELECT line, Position, P FROM {raw_gwas} WHERE regexp_matches(Position, '^[0-9]+(\\.0)?$') AND try_cast(P AS DOUBLE) IS NOT NULL""",
)
def _(t):
    return ingest.quarantine_bad(t.raw_gwas.select("line", "Position", "P"), ["Position", "P"])[0]


@query(
    "recode_chromosome",
    """SELECT line, CASE WHEN c IN ('True') THEN '1' WHEN c = '23' THEN 'X' WHEN c = '24' THEN 'Y' ELSE nullif(c, '') END AS Chromosome
       FROM (SELECT line, replace(replace(Chromosome, 'chr', ''), '.0', '') AS c FROM {raw_gwas})""",
)
def _(t):
    return ingest.recode_chromosome(t.raw_gwas.select("line", "Chromosome"))


@query(
    "missing_columns",
    """SELECT dataset, array_to_string(list_sort(list_concat(['OR', 'RSID', 'Z'],
              CASE WHEN count(AF) = 0 THEN ['AF'] ELSE [] END)), ',') AS missing
       FROM (SELECT dataset, CASE WHEN dataset = 'GCST1' THEN NULL ELSE AF END AS AF FROM {gwas}) GROUP BY dataset""",
)
def _(t):
    df = t.gwas.withColumn("AF", F.when(F.col("dataset") != "GCST1", F.col("AF")))
    return ingest.missing_columns(df)


# --- cleaning ----------------------------------------------------------------

FLOAT = "^[0-9]+(\\.[0-9]+)?(e-[0-9]+)?$"
SFLOAT = "^-?[0-9]+(\\.[0-9]+)?(e-[0-9]+)?$"


@query(
    "typed_parse",
    f"SELECT line, round(try_cast(BETA AS DOUBLE), 6) AS BETA FROM {{raw_gwas}} WHERE BETA IS NULL OR regexp_matches(BETA, '{SFLOAT}')",
)
def _(t):
    out = clean.typed_parse(t.raw_gwas.select("line", "BETA"), "BETA", "float", signed=True)
    return out.withColumn("BETA", F.round("BETA", 6))


CLEAN_CHR = """CASE WHEN Chromosome IN ('23', 'chrX') THEN 'X' WHEN Chromosome = '24' THEN 'Y'
               WHEN Chromosome LIKE 'chr%' AND Chromosome <> 'chrUn' THEN substr(Chromosome, 4)
               ELSE replace(Chromosome, '.0', '') END"""
VALID_CHR = "(c IS NULL OR regexp_matches(c, '^([1-9]|1[0-9]|2[0-2]|X|Y|MT)$'))"


@query(
    "clean_chromosome",
    f"SELECT line, c AS Chromosome FROM (SELECT line, {CLEAN_CHR} AS c FROM {{raw_gwas}}) WHERE {VALID_CHR}",
)
def _(t):
    return clean.clean_chromosome(t.raw_gwas.select("line", "Chromosome"))


@query(
    "clean_position",
    """SELECT line, CAST(p AS BIGINT) AS Position FROM (SELECT line, replace(Position, '.0', '') AS p FROM {raw_gwas})
       WHERE p IS NULL OR regexp_matches(p, '^[0-9]+$')""",
)
def _(t):
    return clean.clean_position(t.raw_gwas.select("line", "Position"))


@query(
    "clean_alleles",
    """SELECT line, nullif(NEA, '?') AS NEA, nullif(EA, '?') AS EA FROM {raw_gwas}
       WHERE (NEA IS NULL OR NEA = '?' OR regexp_matches(NEA, '^[ATCG]+$')) AND (EA IS NULL OR EA = '?' OR regexp_matches(EA, '^[ATCG]+$'))""",
)
def _(t):
    return clean.clean_alleles(t.raw_gwas.select("line", "NEA", "EA"))


STATS_OK = f"""(P IS NULL OR regexp_matches(P, '{FLOAT}') AND try_cast(P AS DOUBLE) <= 1)
    AND (BETA IS NULL OR regexp_matches(BETA, '{SFLOAT}')) AND (SE IS NULL OR regexp_matches(SE, '{FLOAT}'))
    AND (AF IS NULL OR regexp_matches(AF, '{FLOAT}') AND try_cast(AF AS DOUBLE) <= 1)"""


@query(
    "clean_stats",
    f"""SELECT line, round(try_cast(P AS DOUBLE) * 1e3, 9) AS P, round(try_cast(BETA AS DOUBLE), 6) AS BETA,
               round(try_cast(SE AS DOUBLE), 6) AS SE, round(try_cast(AF AS DOUBLE), 6) AS AF
        FROM {{raw_gwas}} WHERE {STATS_OK}""",
)
def _(t):
    out = clean.clean_stats(t.raw_gwas.select("line", "P", "BETA", "SE", "AF"))
    return out.withColumns(
        {"P": F.round(F.col("P") * 1e3, 9), **{c: F.round(c, 6) for c in ("BETA", "SE", "AF")}}
    )


@query(
    "sanitize",
    f"""SELECT line, c AS Chromosome, CAST(p AS BIGINT) AS Position FROM
        (SELECT line, {CLEAN_CHR} AS c, replace(Position, '.0', '') AS p FROM {{raw_gwas}})
        WHERE c IS NOT NULL AND {VALID_CHR} AND regexp_matches(p, '^[0-9]+$')""",
)
def _(t):
    return clean.sanitize(t.raw_gwas.select("line", "Chromosome", "Position"), clean.COORDINATE_PROGRAM, dropna=True)


@query(
    "require_columns",
    """SELECT dataset, disease, Chromosome, Position, CAST(NULL AS VARCHAR) AS NEA, CAST(NULL AS VARCHAR) AS EA,
              round(-log10(P), 6) AS P, BETA FROM {gwas}""",
)
def _(t):
    df = t.gwas.select("BETA", lp().alias("P"), "Position", "Chromosome", "disease", "dataset")
    return clean.require_columns(df)


@query(
    "significant",
    "SELECT dataset, Chromosome, Position, round(-log10(P), 6) AS P, BETA FROM {gwas} WHERE P <= 5e-8",
)
def _(t):
    return clean.significant(t.gwas).select("dataset", "Chromosome", "Position", lp().alias("P"), "BETA")


@query(
    "drop_nonfinite_z",
    """SELECT dataset, Position, round(z, 6) AS z FROM (SELECT dataset, Position, CASE WHEN BETA = 0 THEN NULL ELSE BETA / SE END AS z FROM {gwas}) q
       WHERE z IS NOT NULL""",
)
def _(t):
    b = F.col("BETA")
    z = F.when(b == 0, F.when(F.col("Position") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(b / F.col("SE"))
    return clean.drop_nonfinite_z(t.gwas.select("dataset", "Position", z.alias("z"))).withColumn("z", F.round("z", 6))


CONTIG = """CASE l_orderkey % 5 WHEN 1 THEN 'NW_00' || CAST(l_partkey AS VARCHAR(12)) WHEN 2 THEN 'chr6_alt' WHEN 3 THEN 'chr1_random'
            ELSE CAST(l_partkey % 22 + 1 AS VARCHAR(4)) END"""


@query(
    "canonical_contigs",
    f"""SELECT * FROM (SELECT l_orderkey, {CONTIG} AS Chromosome FROM {{lineitem}}) q
        WHERE NOT (Chromosome LIKE 'NW%' OR Chromosome LIKE '%alt' OR Chromosome LIKE '%random')""",
)
def _(t):
    return clean.canonical_contigs(t.sql(f"SELECT l_orderkey, {CONTIG} AS Chromosome FROM {{lineitem}}"))


@query(
    "eligible_analyses",
    """SELECT g.dataset, TRUE AS OVERLAP, max(s) = 1 AS GARFIELD, FALSE AS TWAS, max(s) = 1 AS COLOC
       FROM (SELECT dataset, CASE WHEN dataset <= 'GCST4' THEN 1 ELSE 0 END AS s FROM {gwas}) g GROUP BY g.dataset""",
)
def _(t):
    return clean.eligible_analyses(
        t.gwas.withColumns({"sum_stats": F.col("dataset") <= "GCST4", "sample_size": F.lit(1000)})
    )


@query(
    "qc_report",
    """SELECT dataset, count(*) AS rows,
         count(*) FILTER (WHERE Chromosome IS NULL) AS chr_null,
         count(*) FILTER (WHERE Chromosome IS NOT NULL AND NOT regexp_matches(Chromosome, '^[0-9]+$')) AS chr_not_int,
         count(*) FILTER (WHERE regexp_matches(Chromosome, '^[0-9]+$') AND try_cast(Chromosome AS INT) NOT BETWEEN 1 AND 24) AS chr_range,
         count(*) FILTER (WHERE Position IS NULL) AS pos_null,
         count(*) FILTER (WHERE Position IS NOT NULL AND NOT regexp_matches(Position, '^-?[0-9]+$')) AS pos_not_int,
         count(*) FILTER (WHERE P IS NOT NULL AND try_cast(P AS DOUBLE) IS NULL) AS p_not_float,
         count(*) FILTER (WHERE BETA IS NOT NULL AND try_cast(BETA AS DOUBLE) IS NULL) AS beta_not_float,
         count(*) FILTER (WHERE SE IS NOT NULL AND try_cast(SE AS DOUBLE) IS NULL) AS se_not_float,
         count(*) FILTER (WHERE AF IS NOT NULL AND try_cast(AF AS DOUBLE) IS NULL) AS af_not_float,
         count(*) FILTER (WHERE try_cast(P AS DOUBLE) NOT BETWEEN 0 AND 1) AS p_range,
         count(*) FILTER (WHERE try_cast(AF AS DOUBLE) NOT BETWEEN 0 AND 1) AS af_range,
         count(*) FILTER (WHERE try_cast(SE AS DOUBLE) < 0) AS se_negative, TRUE AS review
       FROM {raw_gwas} GROUP BY dataset""",
)
def _(t):
    return clean.qc_report(t.raw_gwas)


@query(
    "genome_sort",
    """SELECT dataset, Chromosome, Position, SNPID FROM {sumstats} ORDER BY CAST(Chromosome AS INT), Position""",
)
def _(t):
    return clean.genome_sort(t.sumstats.select("dataset", "Chromosome", "Position", "SNPID"))


@query(
    "top_list",
    "SELECT dataset, SNPID, BETA FROM {sumstats} ORDER BY BETA DESC, SE, dataset, SNPID LIMIT 50",
)
def _(t):
    return clean.top_list(t.sumstats, [F.desc("BETA"), "SE", "dataset", "SNPID"], 50).select("dataset", "SNPID", "BETA")


# --- panel -------------------------------------------------------------------

GKEYS = "dataset, Chromosome, Position, NEA, EA, round(-log10(P), 6) AS P, BETA, SE, AF"


def gw(t):
    """gwas with P on a scale that both engines round alike."""
    return t.gwas.select("dataset", "Chromosome", "Position", "NEA", "EA", lp().alias("P"), "BETA", "SE", "AF")


@query(
    "panel_match",
    f"""SELECT g.*, p.REF, p.ALT, p.RSID IS NOT NULL AS matched FROM (SELECT {GKEYS} FROM {{gwas}}) g
        LEFT JOIN {{panel_multi}} p ON g.Chromosome = p.Chromosome AND g.Position = p.Position""",
)
def _(t):
    return panel.panel_match(gw(t), t.panel_multi)


COMP = "translate({0}, 'ACGT', 'TGCA')"
CODE = """CASE WHEN {0} IS NULL THEN '0' WHEN {0} = REF THEN '1' WHEN {0} = ALT THEN '2' WHEN translate({0}, 'ACGT', 'TGCA') = REF THEN '3'
          WHEN translate({0}, 'ACGT', 'TGCA') = ALT THEN '4' ELSE '5' END"""
NOTE = """CASE codes WHEN '1-2' THEN 'Found' WHEN '2-1' THEN 'Flip' WHEN '3-4' THEN 'Complement' WHEN '1-0' THEN 'Fill' WHEN '0-2' THEN 'Fill'
          WHEN '4-3' THEN 'Flip-Complement' WHEN '0-1' THEN 'Flip-Fill' WHEN '2-0' THEN 'Flip-Fill' WHEN '3-0' THEN 'Complement-Fill'
          WHEN '0-4' THEN 'Complement-Fill' WHEN '0-3' THEN 'Flip-Complement-Fill' WHEN '4-0' THEN 'Flip-Complement-Fill' {extra} ELSE 'Not Found' END"""
RANK = """CASE Notes WHEN 'Found' THEN 0 WHEN 'Flip' THEN 1 WHEN 'Complement' THEN 2 WHEN 'Fill' THEN 3 WHEN 'Flip-Complement' THEN 4
          WHEN 'Flip-Fill' THEN 5 WHEN 'Complement-Fill' THEN 6 WHEN 'Flip-Complement-Fill' THEN 7 ELSE 8 END"""
ALLKEYS = "dataset, Chromosome, Position, NEA, EA, P, BETA, SE, AF"


def harmonise_sql(src: str, keys: str, extra: str = "", panel_name: str = "{panel_multi}") -> str:
    """The reference method: fan out, classify, rank per input row, keep the best."""
    on = "g.Chromosome = p.Chromosome AND g.Position = p.Position"
    return f"""m AS (SELECT g.*, p.REF, p.ALT FROM (SELECT DISTINCT {keys} FROM {src}) g LEFT JOIN {panel_name} p ON {on}),
      c AS (SELECT *, {CODE.format('NEA')} || '-' || {CODE.format('EA')} AS codes FROM m),
      n AS (SELECT *, CASE WHEN REF IS NULL THEN 'Not Found' ELSE {NOTE.format(extra=extra)} END AS Notes FROM c),
      r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {RANK}) AS rk, row_number() OVER (PARTITION BY {keys} ORDER BY {RANK}, REF, ALT) AS rn FROM n),
      h AS (SELECT DISTINCT {', '.join('r.' + k.strip() for k in keys.split(',') if k.strip() not in ('NEA', 'EA'))},
              CASE WHEN Notes = 'Not Found' THEN NEA ELSE REF END AS NEA, CASE WHEN Notes = 'Not Found' THEN EA ELSE ALT END AS EA,
              CASE WHEN Notes <> 'Not Found' THEN REF END AS REF, CASE WHEN Notes <> 'Not Found' THEN ALT END AS ALT,
              Notes, Notes <> 'Not Found' AS found FROM r WHERE rk = 1 AND (Notes <> 'Not Found' OR rn = 1))"""


@query("harmonise_biallelic", f"WITH g0 AS (SELECT {GKEYS} FROM {{gwas}}), {harmonise_sql('g0', ALLKEYS)} SELECT * FROM h")
def _(t):
    return panel.harmonise_biallelic(gw(t), t.panel_multi)


BOTH_NULL = "CASE WHEN AF < 0.3 THEN NULL ELSE NEA END AS NEA, CASE WHEN AF < 0.5 THEN NULL ELSE EA END AS EA"


@query(
    "harmonise_multiallelic",
    f"""WITH g0 AS (SELECT dataset, Chromosome, Position, {BOTH_NULL}, P, BETA, SE, AF FROM (SELECT {GKEYS} FROM {{gwas}})),
        {harmonise_sql('g0', ALLKEYS, "WHEN '0-0' THEN 'Fill'")} SELECT * FROM h""",
)
def _(t):
    af = F.col("AF")
    df = gw(t).withColumns({"NEA": F.when(af >= 0.3, F.col("NEA")), "EA": F.when(af >= 0.5, F.col("EA"))})
    return panel.harmonise_multiallelic(df, t.panel_multi)


@query(
    "best_note",
    f"""WITH m AS (SELECT g.*, p.REF, p.ALT FROM (SELECT DISTINCT {GKEYS} FROM {{gwas}}) g JOIN {{panel_multi}} p
                   ON g.Chromosome = p.Chromosome AND g.Position = p.Position),
        c AS (SELECT *, {CODE.format('NEA')} || '-' || {CODE.format('EA')} AS codes FROM m),
        n AS (SELECT *, {NOTE.format(extra='')} AS Notes FROM c),
        r AS (SELECT *, rank() OVER (PARTITION BY {ALLKEYS} ORDER BY {RANK}) AS rk,
                     row_number() OVER (PARTITION BY {ALLKEYS} ORDER BY {RANK}, REF, ALT) AS rn FROM n)
        SELECT {ALLKEYS}, REF, ALT, Notes FROM r WHERE rk = 1 AND (Notes <> 'Not Found' OR rn = 1)""",
)
def _(t):
    from varloom.functions.scalars import allele_codes, note_of

    rows = gw(t).distinct().join(t.panel_multi.select("Chromosome", "Position", "REF", "ALT"), ["Chromosome", "Position"])
    rows = rows.withColumn("Notes", note_of(allele_codes(F.col("NEA"), F.col("EA"))))
    return panel.best_note(rows, [k.strip() for k in ALLKEYS.split(",")])


@query(
    "recover_coords_by_rsid",
    """WITH g AS (SELECT DISTINCT dataset, RSID, SNPID, CASE WHEN AF < 0.2 OR AF > 0.8 THEN NULL ELSE Chromosome END AS c,
              CASE WHEN AF < 0.4 THEN NULL ELSE Position END AS p FROM {sumstats}),
            q AS (SELECT DISTINCT RSID, Chromosome, Position FROM {panel})
       SELECT g.dataset, g.RSID, g.SNPID, coalesce(g.c, q.Chromosome) AS Chromosome, coalesce(g.p, q.Position) AS Position
       FROM g LEFT JOIN q ON g.RSID = q.RSID""",
)
def _(t):
    af = F.col("AF")
    df = t.sumstats.select(
        "dataset", "RSID", "SNPID", F.when(~((af < 0.2) | (af > 0.8)), F.col("Chromosome")).alias("Chromosome"),
        F.when(af >= 0.4, F.col("Position")).alias("Position"),
    )
    return panel.recover_coords_by_rsid(df, t.panel)


@query(
    "annotate_rsid",
    """WITH ids AS (SELECT SNPID, min(RSID) AS RSID FROM {panel_multi} GROUP BY SNPID)
       SELECT s.dataset, s.SNPID, s.BETA, min('old' || s.RSID) AS Original_RSID, min(i.RSID) AS RSID
       FROM {sumstats} s LEFT JOIN ids i ON s.SNPID = i.SNPID GROUP BY s.dataset, s.SNPID, s.BETA""",
)
def _(t):
    df = t.sumstats.select("dataset", "SNPID", "BETA", F.concat(F.lit("old"), "RSID").alias("RSID"))
    return panel.annotate_rsid(df, t.panel_multi)


@query(
    "detect_build",
    """WITH s AS (SELECT DISTINCT Chromosome, Position FROM {panel}),
            a AS (SELECT g.dataset, avg(CASE WHEN s.Position IS NULL THEN 0.0 ELSE 1.0 END) AS r FROM {gwas} g LEFT JOIN s
                  ON g.Chromosome = s.Chromosome AND g.Position = s.Position GROUP BY g.dataset),
            b AS (SELECT g.dataset, avg(CASE WHEN s.Position IS NULL THEN 0.0 ELSE 1.0 END) AS r FROM {gwas} g LEFT JOIN s
                  ON g.Chromosome = s.Chromosome AND g.Position = s.Position + 1 GROUP BY g.dataset)
       SELECT a.dataset, CASE WHEN b.r > a.r THEN 'hg19' ELSE 'hg38' END AS build, round(greatest(a.r, b.r), 6) AS rate,
              CASE WHEN greatest(a.r, b.r) < 0.9 THEN 'low' ELSE 'ok' END AS status FROM a JOIN b ON a.dataset = b.dataset""",
)
def _(t):
    shifted = t.panel.withColumn("Position", F.col("Position") + 1)
    return panel.detect_build(t.gwas, {"hg19": shifted, "hg38": t.panel}).withColumn("rate", F.round("rate", 6))


# Blocks as chain segments: two hops, one strand reversed, some change chromosome.
CHAINS = """
SELECT 'hg18' AS src, 'hg19' AS dst, Chromosome, Start, End_, CASE WHEN Start % 7 = 0 THEN 'X' ELSE Chromosome END AS q_chromosome,
       Start + 500 AS q_start, End_ + 500 AS q_end, CASE WHEN Start % 3 = 0 THEN '-' ELSE '+' END AS strand FROM {blocks}
UNION ALL
SELECT 'hg19', 'hg38', Chromosome, Start + 300, End_ + 300, Chromosome, Start + 1300, End_ + 1300, '+' FROM {blocks}
"""


@query(
    "liftover",
    f"""WITH ch AS ({CHAINS}),
        h1 AS (SELECT g.dataset, g.BETA, g.NEA, g.EA, g.Chromosome AS c0, c.q_chromosome AS Chromosome,
                 CASE WHEN c.strand = '-' THEN c.q_end - 1 - (g.Position - c.Start) ELSE c.q_start + (g.Position - c.Start) END AS Position
               FROM {{sumstats}} g JOIN ch c ON c.src = 'hg18' AND g.Chromosome = c.Chromosome AND g.Position >= c.Start AND g.Position < c.End_),
        h2 AS (SELECT g.dataset, g.BETA, g.NEA, g.EA, g.c0, c.q_chromosome AS Chromosome, c.q_start + (g.Position - c.Start) AS Position
               FROM h1 g JOIN ch c ON c.src = 'hg19' AND g.Chromosome = c.Chromosome AND g.Position >= c.Start AND g.Position < c.End_)
        SELECT dataset, BETA, NEA, EA, Chromosome, Position,
               Chromosome || ':' || CAST(Position AS VARCHAR) || ':' || NEA || ':' || EA AS SNPID FROM h2 WHERE c0 = Chromosome""",
)
def _(t):
    df = t.sumstats.select("dataset", "BETA", "NEA", "EA", "Chromosome", "Position")
    return panel.liftover(df, t.sql(CHAINS), ["hg18", "hg19", "hg38"], width=20_000)


# Builds as nodes: each nation converts to a neighbour of its region and to the next one.
EDGES = """
SELECT 'b' || CAST(n_nationkey AS VARCHAR(4)) AS src, 'b' || CAST((n_nationkey + 1) % 25 AS VARCHAR(4)) AS dst FROM {nation}
UNION ALL
SELECT 'b' || CAST(n_nationkey AS VARCHAR(4)), 'b' || CAST(n_regionkey AS VARCHAR(4)) FROM {nation} WHERE n_nationkey <> n_regionkey
"""


@query(
    "build_path",
    f"""WITH RECURSIVE e AS ({EDGES}),
        w(src, node, path, depth) AS (SELECT src, dst, src || '>' || dst, 1 FROM e WHERE src <> 'b3'
          UNION ALL SELECT w.src, e.dst, w.path || '>' || e.dst, w.depth + 1 FROM w JOIN e ON w.node = e.src
          WHERE w.node <> 'b3' AND w.depth < 6 AND NOT contains('>' || w.path || '>', '>' || e.dst || '>')),
        x AS (SELECT src, path, depth, row_number() OVER (PARTITION BY src ORDER BY depth, path) AS rn FROM w WHERE node = 'b3')
        SELECT src, path, depth FROM x WHERE rn = 1""",
)
def _(t):
    return panel.build_path(t.spark, t.sql(EDGES), "b3")


@query(
    "build_lineage",
    """SELECT sample_name, disease, build AS original_build, 'hg38' AS genome, build <> 'hg38' AS LiftOver FROM {manifest}""",
)
def _(t):
    m = t.manifest
    edges = t.sql("SELECT DISTINCT 'hg19' AS src, 'hg38' AS dst FROM {region}")
    paths = panel.build_path(t.spark, edges, "hg38")
    return panel.build_lineage(m.select("sample_name", "disease"), m.select("sample_name", "build"), paths, "hg38")


@query(
    "translate_ids_snp",
    """SELECT q.CELL, q.GENEID, q.SNPID, coalesce(p.RSID, q.SNPID) AS SNP FROM {qtl_new} q LEFT JOIN
       (SELECT SNPID, min(RSID) AS RSID FROM {panel} GROUP BY SNPID) p ON q.SNPID = p.SNPID""",
)
def _(t):
    return panel.translate_ids_snp(t.qtl_new.select("CELL", "GENEID", "SNPID"), t.panel)


ZIN = """SELECT dataset, RSID, CASE WHEN AF < 0.3 THEN NEA WHEN AF < 0.5 THEN translate(EA, 'ACGT', 'TGCA') WHEN AF < 0.55 THEN 'N' ELSE EA END AS A1,
         CASE WHEN AF < 0.3 THEN EA WHEN AF < 0.5 THEN translate(NEA, 'ACGT', 'TGCA') ELSE NEA END AS A2, BETA / SE AS z FROM {sumstats}
         UNION ALL SELECT dataset, RSID, EA, NEA, 1.5 FROM {sumstats} WHERE AF > 0.9"""


@query(
    "harmonise_z_to_ref",
    f"""WITH z AS ({ZIN}), o AS (SELECT *, count(*) OVER (PARTITION BY dataset, RSID) AS n FROM z),
        j AS (SELECT o.dataset, o.RSID AS id, p.ALT AS A1, p.REF AS A2,
          CASE WHEN (o.A1 = p.ALT AND o.A2 = p.REF) OR (translate(o.A1,'ACGT','TGCA') = p.ALT AND translate(o.A2,'ACGT','TGCA') = p.REF) THEN o.z
               WHEN (o.A1 = p.REF AND o.A2 = p.ALT) OR (translate(o.A1,'ACGT','TGCA') = p.REF AND translate(o.A2,'ACGT','TGCA') = p.ALT) THEN -o.z END AS z
          FROM o JOIN {{panel}} p ON o.RSID = p.RSID WHERE o.n = 1 AND p.REF || p.ALT NOT IN ('AT','TA','CG','GC'))
        SELECT dataset, id, A1, A2, round(CASE WHEN z = 0 THEN 0.0 ELSE z END, 6) AS z FROM j WHERE z IS NOT NULL""",
)
def _(t):
    out = panel.harmonise_z_to_ref(t.sql(ZIN), t.panel)
    z = F.col("z")
    return out.withColumn("z", F.round(F.when(z == 0, F.lit(0.0)).otherwise(z), 6))


WIN = """SELECT GENEID AS gene, 'rs' || CAST(CAST((Position - 10000) / 97 AS BIGINT) AS VARCHAR(12)) AS id,
         CASE WHEN MAF < 0.2 THEN split_part(SNPID, ':', 4) ELSE split_part(SNPID, ':', 3) END AS ref,
         CASE WHEN MAF < 0.2 THEN split_part(SNPID, ':', 3) ELSE split_part(SNPID, ':', 4) END AS alt,
         max(BETA) AS weight, 'expression' AS type, CELL AS context FROM {qtl} GROUP BY GENEID, CELL, Position, SNPID, MAF"""


@query(
    "harmonise_weights",
    f"""WITH w AS ({WIN}) SELECT z.dataset, w.gene, w.id, p.REF AS ref, p.ALT AS alt,
          CASE WHEN w.weight = 0 THEN 0.0 WHEN w.ref = p.REF THEN w.weight ELSE -w.weight END AS weight, w.type, w.context
        FROM w JOIN {{panel}} p ON w.id = p.RSID JOIN (SELECT DISTINCT dataset, RSID FROM {{sumstats}}) z ON z.RSID = w.id
        WHERE p.REF || p.ALT NOT IN ('AT','TA','CG','GC')""",
)
def _(t):
    z = t.sumstats.select("dataset", F.col("RSID").alias("id"))
    out = panel.harmonise_weights(t.sql(WIN), t.panel, z, by=("dataset",))
    w = F.col("weight")
    return out.withColumn("weight", F.when(w == 0, F.lit(0.0)).otherwise(w))


@query(
    "qtl_convert_id",
    """SELECT q.CELL, q.GENEID, q.SNPID, q.BETA, p.RSID AS varID FROM {qtl_new} q JOIN
       (SELECT SNPID, min(RSID) AS RSID FROM {panel} GROUP BY SNPID) p ON q.SNPID = p.SNPID""",
)
def _(t):
    return panel.qtl_convert_id(t.qtl_new.select("CELL", "GENEID", "SNPID", "BETA"), t.panel)


@query(
    "recover_stats",
    """SELECT dataset, Position, round(ln(o), 6) AS BETA, round(CASE WHEN ln(o) = 0 THEN 0.0 ELSE ln(o) / SE END, 6) AS Z
       FROM (SELECT dataset, Position, SE, 0.5 + AF AS o FROM {sumstats})""",
)
def _(t):
    df = t.sumstats.select("dataset", "Position", "SE", (F.lit(0.5) + F.col("AF")).alias("OR"))
    out = panel.recover_stats(df)
    z = F.col("Z")
    return out.select("dataset", "Position", F.round("BETA", 6).alias("BETA"), F.round(F.when(z == 0, F.lit(0.0)).otherwise(z), 6).alias("Z"))


@query(
    "dedupe_lowest_p",
    """SELECT dataset, Chromosome, Position, NEA, EA, BETA, round(-log10(min(P)), 6) AS P FROM {gwas}
       GROUP BY dataset, Chromosome, Position, NEA, EA, BETA""",
)
def _(t):
    df = t.gwas.select("dataset", "Chromosome", "Position", "NEA", "EA", "BETA", "P")
    return panel.dedupe_lowest_p(df).withColumn("P", lp())


POLISH = """
      f AS (SELECT h.*, Chromosome || ':' || CAST(Position AS VARCHAR) || ':' || NEA || ':' || EA AS SNPID FROM h
            WHERE NEA IS NOT NULL AND EA IS NOT NULL AND P IS NOT NULL),
      i AS (SELECT f.*, x.RSID FROM f LEFT JOIN (SELECT SNPID, min(RSID) AS RSID FROM {panel_multi} GROUP BY SNPID) x ON f.SNPID = x.SNPID),
      s AS (SELECT dataset, Chromosome, Position, NEA, EA, SNPID, RSID, CAST(NULL AS VARCHAR) AS Original_RSID, P,
              CASE WHEN BETA = 0 THEN 0.0 WHEN Notes LIKE 'Flip%' THEN -BETA ELSE BETA END AS BETA, SE,
              CASE WHEN BETA = 0 THEN 0.0 WHEN Notes LIKE 'Flip%' THEN -BETA / SE ELSE BETA / SE END AS Z,
              CASE WHEN Notes LIKE 'Flip%' THEN 1 - AF ELSE AF END AS AF, Notes, found FROM i)
      SELECT dataset, Chromosome, Position, NEA, EA, SNPID, RSID, Original_RSID, BETA, SE, round(Z, 6) AS Z, round(AF, 6) AS AF,
             CASE WHEN BETA >= 0 THEN EA ELSE NEA END AS RA, CASE WHEN BETA >= 0 THEN NEA ELSE EA END AS NRA, Notes, found, max(P) AS P
      FROM s GROUP BY ALL"""


def std_out(df):
    b, z = F.col("BETA"), F.col("Z")
    return df.withColumns(
        {
            "BETA": F.when(b == 0, F.lit(0.0)).otherwise(b),
            "Z": F.round(F.when(z == 0, F.lit(0.0)).otherwise(z), 6),
            "AF": F.round("AF", 6),
            "P": lp(),
        }
    )


@query(
    "polish",
    f"WITH g0 AS (SELECT {GKEYS} FROM {{gwas}}), {harmonise_sql('g0', ALLKEYS)}, {POLISH}",
)
def _(t):
    h = panel.harmonise_biallelic(t.gwas.drop("disease"), t.panel_multi).dropna(subset=["NEA", "EA"])
    return std_out(panel.polish(h.withColumn("Z", F.col("BETA") / F.col("SE")), t.panel_multi))


STD = f"""WITH g0 AS (SELECT dataset, replace(Chromosome, 'chr', '') AS Chromosome, Position, NEA, EA, round(-log10(P), 6) AS P, BETA, SE, AF
            FROM {{gwas}} WHERE (NEA IS NULL OR regexp_matches(NEA, '^[ACGT]+$')) AND (EA IS NULL OR regexp_matches(EA, '^[ACGT]+$'))),
          {harmonise_sql('g0', ALLKEYS)},"""


@query("standardise", f"{STD} {POLISH}")
def _(t):
    return std_out(panel.standardise(t.gwas.drop("disease"), t.panel_multi))


TEXT = f"""WITH g0 AS (SELECT dataset, c AS Chromosome, try_cast(place AS BIGINT) AS Position, nullif(NEA, '?') AS NEA, nullif(EA, '?') AS EA,
            CASE WHEN try_cast(P AS DOUBLE) = 0 THEN 999.0 ELSE round(-log10(try_cast(P AS DOUBLE)), 6) END AS P, try_cast(BETA AS DOUBLE) AS BETA, try_cast(SE AS DOUBLE) AS SE, try_cast(AF AS DOUBLE) AS AF
            FROM (SELECT *, {CLEAN_CHR} AS c, replace(Position, '.0', '') AS place FROM {{raw_gwas}})
            WHERE c IS NOT NULL AND {VALID_CHR} AND regexp_matches(place, '^[0-9]+$') AND P IS NOT NULL AND {STATS_OK}
              AND (NEA IS NULL OR NEA = '?' OR regexp_matches(NEA, '^[ATCG]+$')) AND (EA IS NULL OR EA = '?' OR regexp_matches(EA, '^[ATCG]+$'))),
          {harmonise_sql('g0', ALLKEYS)},"""


@query("standardise_text", f"{TEXT} {POLISH.replace('max(P) AS P', 'nullif(max(P), 999.0) AS P')}")
def _(t):
    """From dirty text, against a stored panel."""
    return std_out(panel.standardise(t.raw_gwas.drop("line"), panel.store_panel(t.panel_multi)))


# Rows as a catalog lists them: places or alleles missing, exponents in capitals.
CATALOG_TYPED = """SELECT 'GCST' || CAST(l_linenumber AS VARCHAR(4)) AS dataset, v.RSID,
   CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE v.Chromosome END AS Chromosome, CASE WHEN l_orderkey % 5 < 2 THEN NULL ELSE v.Position END AS Position,
   CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE v.REF END AS NEA, CASE WHEN l_orderkey % 3 < 2 THEN NULL ELSE v.ALT END AS EA,
   CAST(l_linenumber AS VARCHAR(4)) || 'E-' || CAST(CAST(l_quantity AS INT) AS VARCHAR(4)) AS P, round((l_discount - 0.05) * 4.0, 4) AS BETA
   FROM {lineitem} JOIN {variant} v ON v.vid = l_partkey"""
CATKEYS = "dataset, RSID, Chromosome, Position, NEA, EA, P, BETA"
CAT_SQL = f"""WITH c0 AS (SELECT dataset, q.RSID, p.Chromosome, p.Position, NEA, EA, round(-log10(CAST(P AS DOUBLE)), 6) AS P, BETA FROM ({CATALOG_TYPED}) q
            JOIN (SELECT DISTINCT RSID, Chromosome, Position FROM {{panel_multi}}) p ON q.RSID = p.RSID),
    g0 AS (SELECT * FROM c0), {harmonise_sql('g0', CATKEYS, "WHEN '0-0' THEN 'Fill'")},
    f AS (SELECT h.*, Chromosome || ':' || CAST(Position AS VARCHAR) || ':' || NEA || ':' || EA AS SNPID FROM h WHERE NEA IS NOT NULL AND EA IS NOT NULL),
    i AS (SELECT f.* EXCLUDE (RSID), f.RSID AS Original_RSID, x.RSID FROM f LEFT JOIN (SELECT SNPID, min(RSID) AS RSID FROM {{panel_multi}} GROUP BY SNPID) x ON f.SNPID = x.SNPID),
    s AS (SELECT dataset, Chromosome, Position, NEA, EA, SNPID, RSID, Original_RSID, P,
            CASE WHEN BETA = 0 THEN 0.0 WHEN Notes LIKE 'Flip%' THEN -BETA ELSE BETA END AS BETA, Notes, found FROM i)
    SELECT dataset, Chromosome, Position, NEA, EA, SNPID, RSID, min(Original_RSID) AS Original_RSID, BETA,
           CASE WHEN BETA >= 0 THEN EA ELSE NEA END AS RA, CASE WHEN BETA >= 0 THEN NEA ELSE EA END AS NRA, Notes, found, max(P) AS P
    FROM s GROUP BY dataset, Chromosome, Position, NEA, EA, SNPID, RSID, BETA, Notes, found"""


@query("standardise_catalog", CAT_SQL)
def _(t):
    out = panel.standardise(t.sql(CATALOG_TYPED), panel.store_panel(t.panel_multi), "catalog")
    b = F.col("BETA")
    return out.withColumns({"BETA": F.when(b == 0, F.lit(0.0)).otherwise(b), "P": lp()})


@query(
    "std_metrics",
    f"""{STD} o AS (WITH {POLISH.strip()}),
        a AS (SELECT dataset, count(*) AS n FROM {{gwas}} GROUP BY dataset),
        b AS (SELECT dataset, count(*) AS n, count(*) FILTER (WHERE found) AS k FROM o GROUP BY dataset)
        SELECT a.dataset, a.n AS n_entries, b.n AS n_variants, b.k AS n_in_panel, round(b.k / CAST(b.n AS DOUBLE), 6) AS proportion
        FROM a JOIN b ON a.dataset = b.dataset""",
)
def _(t):
    std = panel.standardise(t.gwas.drop("disease"), t.panel_multi)
    return clean.std_metrics(t.gwas, std).withColumn("proportion", F.round("proportion", 6))

"""Domain tables as SQL projections of the driver tables.

The text runs unchanged in Spark and in the SQL oracle. `{name}` marks another
view or a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["variant"] = """
SELECT p_partkey AS vid, p_size AS vsize,
       CAST(p_partkey % 22 + 1 AS VARCHAR(2)) AS Chromosome,
       CAST(10000 + p_partkey * 97 AS BIGINT) AS Position,
       substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS REF,
       substr('ACGT', CAST((p_partkey + 1 + CAST(floor(p_partkey / 4.0) AS BIGINT) % 3) % 4 + 1 AS INT), 1) AS ALT,
       substr('ACGT', CAST((p_partkey + 1 + (CAST(floor(p_partkey / 4.0) AS BIGINT) + 1) % 3) % 4 + 1 AS INT), 1) AS ALT2,
       'rs' || CAST(p_partkey AS VARCHAR(20)) AS RSID
FROM {part}
"""

VIEWS["panel"] = """
SELECT Chromosome, Position, REF, ALT,
       Chromosome || ':' || CAST(Position AS VARCHAR(12)) || ':' || REF || ':' || ALT AS SNPID, RSID
FROM {variant}
"""

VIEWS["panel_multi"] = """
SELECT Chromosome, Position, REF, ALT, SNPID, RSID FROM {panel}
UNION ALL
SELECT Chromosome, Position, REF, ALT2 AS ALT,
       Chromosome || ':' || CAST(Position AS VARCHAR(12)) || ':' || REF || ':' || ALT2 AS SNPID,
       'rsM' || CAST(vid AS VARCHAR(20)) AS RSID
FROM {variant} WHERE vsize <= 10
"""

VIEWS["gwas"] = """
SELECT 'GCST' || CAST(l.l_linenumber AS VARCHAR(4)) AS dataset,
       CASE WHEN l.l_linenumber <= 3 THEN 'Asthma' ELSE 'IBD' END AS disease,
       CASE WHEN l.l_orderkey % 31 = 0 THEN 'chr' || v.Chromosome ELSE v.Chromosome END AS Chromosome,
       CASE WHEN l.l_orderkey % 29 = 0 THEN v.Position + 1 ELSE v.Position END AS Position,
       CASE l.l_orderkey % 8 WHEN 3 THEN v.ALT WHEN 4 THEN translate(v.REF,'ACGT','TGCA')
            WHEN 5 THEN translate(v.ALT,'ACGT','TGCA') WHEN 6 THEN NULL ELSE v.REF END AS NEA,
       CASE l.l_orderkey % 8 WHEN 3 THEN v.REF WHEN 4 THEN translate(v.ALT,'ACGT','TGCA')
            WHEN 5 THEN translate(v.REF,'ACGT','TGCA') WHEN 7 THEN 'N' ELSE v.ALT END AS EA,
       pow(10.0, -l.l_quantity / 6.0) AS P,
       round((l.l_discount - 0.05) * 4.0, 4) AS BETA,
       round(0.01 + l.l_tax, 4) AS SE,
       CAST(l.l_partkey % 97 + 1 AS DOUBLE) / 100 AS AF
FROM {lineitem} l JOIN {variant} v ON v.vid = l.l_partkey
"""

# Standard-format association rows on panel coordinates.
VIEWS["sumstats"] = """
SELECT 'GCST' || CAST(l.l_linenumber AS VARCHAR(4)) AS dataset,
       CASE WHEN l.l_linenumber <= 3 THEN 'Asthma' ELSE 'IBD' END AS disease,
       v.Chromosome, v.Position, v.REF AS NEA, v.ALT AS EA,
       v.Chromosome || ':' || CAST(v.Position AS VARCHAR(12)) || ':' || v.REF || ':' || v.ALT AS SNPID,
       v.RSID,
       min(pow(10.0, -l.l_quantity / 6.0)) AS P,
       round(min((l.l_discount - 0.05) * 4.0), 4) AS BETA,
       round(min(0.01 + l.l_tax), 4) AS SE,
       min(CAST(l.l_partkey % 97 + 1 AS DOUBLE) / 100) AS AF
FROM {lineitem} l JOIN {variant} v ON v.vid = l.l_partkey
GROUP BY l.l_linenumber, v.Chromosome, v.Position, v.REF, v.ALT, v.RSID
"""

# The same kind of table as raw text, with the dirt a file can hold.
VIEWS["raw_gwas"] = """
SELECT 'GCST' || CAST(l_linenumber AS VARCHAR(4)) AS dataset, l_orderkey AS line,
       CASE l_orderkey % 23 WHEN 1 THEN 'chr' || CAST(l_partkey % 22 + 1 AS VARCHAR(2))
            WHEN 2 THEN CAST(l_partkey % 22 + 1 AS VARCHAR(2)) || '.0' WHEN 3 THEN '23' WHEN 4 THEN '24'
            WHEN 5 THEN 'chrX' WHEN 6 THEN 'MT' WHEN 7 THEN 'chrUn' WHEN 8 THEN NULL WHEN 9 THEN '27'
            WHEN 10 THEN 'True' ELSE CAST(l_partkey % 22 + 1 AS VARCHAR(2)) END AS Chromosome,
       CASE l_orderkey % 19 WHEN 1 THEN CAST(10000 + l_partkey * 97 AS VARCHAR(12)) || '.0' WHEN 2 THEN '-5'
            WHEN 3 THEN 'abc' WHEN 4 THEN NULL ELSE CAST(10000 + l_partkey * 97 AS VARCHAR(12)) END AS Position,
       CASE l_orderkey % 11 WHEN 1 THEN '?' WHEN 2 THEN 'AT|' WHEN 3 THEN 'acg' WHEN 4 THEN NULL WHEN 5 THEN 'REF'
            ELSE substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) END AS NEA,
       CASE l_orderkey % 13 WHEN 1 THEN '?' WHEN 2 THEN '1' WHEN 3 THEN 'GATTACA' WHEN 4 THEN NULL
            ELSE substr('ACGT', CAST((l_partkey + 1) % 4 + 1 AS INT), 1) END AS EA,
       CASE l_orderkey % 17 WHEN 1 THEN 'NA' WHEN 2 THEN '.5' WHEN 3 THEN '1e+5' WHEN 4 THEN '1.5' WHEN 5 THEN NULL
            WHEN 6 THEN '0' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(4)) || 'e-' || CAST(l_linenumber + 2 AS VARCHAR(4)) END AS P,
       CASE l_orderkey % 7 WHEN 1 THEN '-0.' || CAST(CAST(l_quantity AS INT) AS VARCHAR(4)) WHEN 2 THEN NULL WHEN 3 THEN 'b'''''
            ELSE '0.' || CAST(CAST(l_quantity AS INT) AS VARCHAR(4)) END AS BETA,
       CASE l_orderkey % 9 WHEN 1 THEN '-0.1' WHEN 2 THEN NULL ELSE '0.0' || CAST(l_linenumber AS VARCHAR(4)) END AS SE,
       CASE l_orderkey % 21 WHEN 1 THEN '1.2' WHEN 2 THEN NULL ELSE '0.' || CAST(l_partkey % 9 + 1 AS VARCHAR(4)) END AS AF
FROM {lineitem}
"""

VIEWS["qtl"] = """
SELECT l_returnflag || l_linestatus || '_' || CAST(l_linenumber % 2 AS VARCHAR(2)) AS CELL,
       'ENSG' || lpad(CAST(l_suppkey AS VARCHAR(11)), 11, '0') AS GENEID,
       'GENE' || CAST(l_suppkey AS VARCHAR(11)) AS GENENAME,
       v.Chromosome, v.Position,
       v.Chromosome || ':' || CAST(v.Position AS VARCHAR(12)) || ':' || v.REF || ':' || v.ALT AS SNPID,
       pow(10.0, -l_quantity / 4.0) AS P, round((l_tax - 0.04) * 10.0, 4) AS BETA, round(0.02 + l_discount, 4) AS SE,
       CAST(l_partkey % 49 + 1 AS DOUBLE) / 100 AS MAF
FROM {lineitem} JOIN {variant} v ON v.vid = l_partkey
"""

# QTLs in cis: two genes in every block of 20 kb.
VIEWS["qtl_cis"] = """
SELECT l_returnflag || l_linestatus || '_' || CAST(l_linenumber % 2 AS VARCHAR(2)) AS CELL,
       'ENSG' || lpad(CAST(2 * (CAST(v.Chromosome AS INT) + 22 * CAST(floor((v.Position - 10000) / 20000.0) AS BIGINT)) + l_suppkey % 2 AS VARCHAR(11)), 11, '0') AS GENEID,
       v.Chromosome, v.Position,
       v.Chromosome || ':' || CAST(v.Position AS VARCHAR(12)) || ':' || v.REF || ':' || v.ALT AS SNPID,
       pow(10.0, -l_quantity / 4.0) AS P, round((l_tax - 0.04) * 10.0, 4) AS BETA, round(0.02 + l_discount, 4) AS SE,
       CAST(l_partkey % 49 + 1 AS DOUBLE) / 100 AS MAF
FROM {lineitem} JOIN {variant} v ON v.vid = l_partkey
"""

# QTLs with variants that no panel has and genes that no annotation has.
VIEWS["qtl_new"] = """
SELECT CELL, CASE WHEN Position % 7 = 0 THEN 'ENSX' || substr(GENEID, 5) ELSE GENEID END AS GENEID, GENENAME, Chromosome, Position,
       CASE WHEN Position % 11 = 0 THEN Chromosome || ':' || CAST(Position + 1 AS VARCHAR(12)) || ':A:G' ELSE SNPID END AS SNPID, P, BETA, SE, MAF
FROM {qtl}
"""

VIEWS["genes"] = """
SELECT 'ENSG' || lpad(CAST(s_suppkey AS VARCHAR(11)), 11, '0') AS GENEID,
       'GENE' || CAST(s_suppkey AS VARCHAR(11)) AS GENENAME,
       CAST(s_suppkey % 22 + 1 AS VARCHAR(2)) AS Chromosome,
       CAST(9000 + s_suppkey * 1900 AS BIGINT) AS Start, CAST(9000 + s_suppkey * 1900 + 1501 AS BIGINT) AS End_,
       CASE WHEN s_acctbal > 0 THEN 'protein_coding' ELSE 'lincRNA' END AS gene_type
FROM {supplier}
"""

VIEWS["blocks"] = """
SELECT DISTINCT Chromosome, 10000 + CAST(floor((Position - 10000) / 20000.0) AS BIGINT) * 20000 AS Start,
       10000 + CAST(floor((Position - 10000) / 20000.0) AS BIGINT) * 20000 + 19000 AS End_
FROM {variant}
"""

# Hard-call genotypes of 50 donors in two populations; one in 41 is missing.
VIEWS["genotypes"] = """
SELECT g.donor, CASE WHEN g.donor < 28 THEN 'EUR' ELSE 'AFR' END AS population,
       g.Chromosome, g.Position, g.SNPID,
       CAST(CASE WHEN (g.donor * 31 + g.vid * 7) % 41 = 0 THEN NULL
            WHEN (g.donor * 31 + g.block * 17 + g.tweak) % 10 < 5 THEN 0
            WHEN (g.donor * 31 + g.block * 17 + g.tweak) % 10 < 8 THEN 1 ELSE 2 END AS INT) AS dosage
FROM (SELECT vid, Chromosome, Position, SNPID, block, donor,
             CASE WHEN vsize <= 12 AND donor < 9 THEN vsize ELSE 0 END AS tweak
      FROM (SELECT vid, vsize, Chromosome, Position,
                   Chromosome || ':' || CAST(Position AS VARCHAR(12)) || ':' || REF || ':' || ALT AS SNPID,
                   CAST(floor(Position / 8000.0) AS BIGINT) AS block, {donors50}
            FROM {variant}) d) g
"""

# A genetic map of about 10 cM a megabase, at an uneven rate.
VIEWS["genetic_map"] = """
SELECT Chromosome, b * 50000 AS Position, 0.5D * b + 0.1D * ((b * 7) % 3) AS cM
FROM (SELECT DISTINCT Chromosome, CAST(floor(Position / 50000.0) AS BIGINT) AS b FROM {variant}) q
"""

VIEWS["cells"] = """
SELECT o_orderkey AS cell, 'D' || CAST(o_custkey % 20 AS VARCHAR(4)) AS donor,
       CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
       substr(o_orderpriority, 1, 1) AS cluster,
       CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'Hashtag' || CAST(o_custkey % 4 + 1 AS VARCHAR(2)) END AS hashtag,
       CAST(o_custkey % 6 + 1 AS INT) AS lane
FROM {orders}
"""

VIEWS["counts"] = """
SELECT l_orderkey AS cell, 'ENSG' || lpad(CAST(l_partkey % 200 AS VARCHAR(11)), 11, '0') AS gene, CAST(sum(l_quantity) AS BIGINT) AS umi
FROM {lineitem} GROUP BY l_orderkey, l_partkey % 200
"""

VIEWS["features"] = """
SELECT DISTINCT gene AS ensembl, 'SYM' || CAST(CAST(substr(gene, 5) AS BIGINT) % 150 AS VARCHAR(6)) AS name,
       CASE WHEN CAST(substr(gene, 5) AS BIGINT) % 20 = 0 THEN 'MT' ELSE 'nuclear' END AS kind
FROM {counts}
"""

# Signatures of uneven size from gene numbers.
VIEWS["signatures"] = """
SELECT 'S' || CAST(CAST(substr(ensembl, 5) AS BIGINT) % 7 AS VARCHAR(4)) AS signature, ensembl AS gene FROM {features}
UNION ALL
SELECT 'T' || CAST(CAST(substr(ensembl, 5) AS BIGINT) % 11 AS VARCHAR(4)) AS signature, ensembl AS gene FROM {features}
"""

VIEWS["clones"] = """
SELECT event_id AS cell, 'clonotype' || CAST(user_id AS VARCHAR(12)) AS clonotype, event_type AS tag,
       'D' || CAST(event_id % 12 AS VARCHAR(4)) AS donor, value FROM {events}
"""

VIEWS["contigs"] = """
SELECT event_id AS contig, 'clonotype' || CAST(user_id AS VARCHAR(12)) AS clonotype,
       CASE WHEN event_type IN ('view', 'click') THEN 'TRA' WHEN event_type = 'error' THEN 'IGH' ELSE 'TRB' END AS chain,
       'V' || CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR(4)) AS v_gene,
       'J' || CAST(CAST(floor(value * 2) AS BIGINT) % 4 AS VARCHAR(4)) AS j_gene,
       CASE WHEN value < 30 THEN 'True' ELSE 'False' END AS productive,
       'True' AS is_cell, 'True' AS high_confidence
FROM {events}
"""

# One row per study and cell type of a colocalisation run.
VIEWS["coloc_hits"] = """
SELECT 'GCST' || CAST(l_linenumber AS VARCHAR(4)) AS dataset1,
       CASE WHEN l_linenumber <= 3 THEN 'Asthma' ELSE 'IBD' END AS disease,
       l_returnflag || l_linestatus || '_' || CAST(l_linenumber % 2 AS VARCHAR(2)) AS dataset2,
       CAST(v.Chromosome AS VARCHAR(2)) || ':' || CAST(CAST(floor(v.Position / 20000.0) AS BIGINT) * 20000 AS VARCHAR(12)) || '-'
         || CAST(CAST(floor(v.Position / 20000.0) AS BIGINT) * 20000 + 20000 AS VARCHAR(12)) AS Feature1,
       'ENSG' || lpad(CAST(l_suppkey AS VARCHAR(11)), 11, '0') || '_' || v.Chromosome AS Feature2,
       v.Chromosome || ':' || CAST(v.Position AS VARCHAR(12)) || ':' || v.REF || ':' || v.ALT AS SNPID,
       v.Position, l_quantity / 51.0 AS PPH4,
       CASE WHEN l_orderkey % 50 = 0 THEN 0.0 ELSE (1.0 - l_quantity / 51.0) / 4.0 END AS PPH3,
       l_orderkey AS line
FROM {lineitem} JOIN {variant} v ON v.vid = l_partkey
"""

VIEWS["cell_types"] = """
SELECT l_returnflag || l_linestatus || '_' || CAST(l_linenumber % 2 AS VARCHAR(2)) AS sample_name,
       CAST(dense_rank() OVER (ORDER BY l_returnflag || l_linestatus || '_' || CAST(l_linenumber % 2 AS VARCHAR(2)) DESC) AS INT) AS cell_order
FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_linenumber % 2
"""

# Study manifest, one row per customer.
VIEWS["manifest"] = """
SELECT 'ST' || CAST(c_custkey AS VARCHAR(12)) AS sample_name, c_mktsegment AS disease,
       CASE WHEN c_acctbal < 0 THEN '1.0' ELSE '0' END AS messy,
       CAST(c_nationkey % 3 + 1 AS INT) AS Category, CAST(c_custkey % 2 AS INT) AS sum_stats,
       CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE CAST(floor(c_acctbal) AS BIGINT) END AS sample_size,
       CASE WHEN c_custkey % 3 = 0 THEN 'hg19' ELSE 'hg38' END AS build,
       c_acctbal > 1000 AS COLOC, 'http://x/' || CAST(c_custkey AS VARCHAR(12)) AS Link
FROM {customer}
"""

# Region-level z-scores of variants and genes.
VIEWS["region_z"] = """
SELECT 'SNP' AS grp, RSID AS id, Chromosome || ':' || CAST(CAST(floor(Position / 20000.0) AS BIGINT) AS VARCHAR(12)) AS region_id,
       BETA / SE / 4.0 AS z, dataset
FROM {sumstats}
UNION ALL
SELECT CELL AS grp, GENEID || '_' || Chromosome AS id, Chromosome || ':' || CAST(CAST(floor(Position / 20000.0) AS BIGINT) AS VARCHAR(12)) AS region_id,
       max(BETA / SE) / 2.0 AS z, 'GCST1' AS dataset
FROM {qtl} GROUP BY CELL, GENEID, Chromosome, CAST(floor(Position / 20000.0) AS BIGINT)
"""

# Gene-level differential expression of a tag against the rest.
VIEWS["deg"] = """
SELECT l_returnflag || l_linestatus AS element, 'ENSG' || lpad(CAST(l_suppkey AS VARCHAR(11)), 11, '0') AS gene,
       min(l_tax) AS p_adj, round(avg(l_discount) * 8 - 0.15, 6) AS lfc
FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_suppkey
"""

DONORS50 = {
    "spark": "explode(sequence(0, 49)) AS donor",
    "duckdb": "unnest(range(0, 50)) AS donor",
}

_TOKEN = re.compile(r"\{(\w+)\}")


def _deps(text: str) -> list[str]:
    return sorted({t for t in _TOKEN.findall(text) if t != "donors50"})


def load(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """The named view or driver table as a DataFrame.

    A row of variants becomes 50 of genotypes, and a file of few bytes is one task: variants are
    dealt to as many tasks as the session sets before that. A row of variants is also many times
    its bytes in the file, so that Spark may broadcast more than it takes it for; with `dealt` a
    join with them is never a broadcast.
    """
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("{donors50}", DONORS50["spark"])
    parts = {d: load(spark, sf_dir, d, dealt) for d in _deps(text)}
    if dealt and "variant" in parts:
        parts["variant"] = parts["variant"].hint("merge")
    if name == "genotypes":
        parts["variant"] = parts["variant"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vid")
    return spark.sql(text, **parts)


def run_sql(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    """Portable SQL over views, for inputs one query needs alone; `given` has those that are at hand."""
    text = text.replace("{donors50}", DONORS50["spark"])
    return spark.sql(text, **{d: given[d] if d in given else load(spark, sf_dir, d) for d in _deps(text)})


def oracle(text: str) -> str:
    """Prefix the views an oracle text names as CTEs; `0.1D` becomes a DOUBLE literal."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for d in _deps(VIEWS[name]):
                visit(d)
            order.append(name)

    for t in _deps(text):
        visit(t)

    def plain(s: str) -> str:
        s = s.replace("{donors50}", DONORS50["duckdb"])
        s = _TOKEN.sub(lambda m: m.group(1), s)
        return re.sub(r"(?<![A-Za-z_0-9.])(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"CAST(\1 AS DOUBLE)", s)

    body = plain(text).strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n]).strip()})" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

"""Queries over intervals, loci, linkage and QTL overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import clean, intervals, ld, loci, overlap
from varloom.plans.registry import query
from varloom.sources.sinks import settle

CELLS = ["AF_0", "AF_1", "AO_0", "AO_1", "NF_0", "NF_1", "NO_0", "NO_1", "RF_0", "RF_1", "RO_0", "RO_1"]
POPS = ["AFR", "EUR"]


def lp(c: str = "P"):
    return F.round(-F.log10(c), 6)


# --- intervals ---------------------------------------------------------------


@query(
    "partition_by_block",
    """SELECT s.dataset, s.SNPID, b.Chromosome || ':' || CAST(b.Start AS VARCHAR) || '-' || CAST(b.End_ AS VARCHAR) AS Loci
       FROM {sumstats} s JOIN {blocks} b ON s.Chromosome = b.Chromosome AND s.Position BETWEEN b.Start AND b.End_""",
)
def _(t):
    return intervals.partition_by_block(t.sumstats.select("dataset", "SNPID", "Chromosome", "Position"), t.blocks, width=20_000).select(
        "dataset", "SNPID", "Loci"
    )


LABELLED = "SELECT Chromosome, Start, End_, CASE WHEN Start % 3 = 0 THEN 'open' ELSE 'coding' END AS label FROM {blocks}"


@query(
    "interval_flag",
    f"""WITH r AS ({LABELLED})
        SELECT p.Chromosome, p.Position, p.SNPID, 1 AS base,
               CAST(EXISTS (SELECT 1 FROM r WHERE r.label = 'open' AND r.Chromosome = p.Chromosome AND p.Position BETWEEN r.Start AND r.End_) AS INT) AS "open",
               CAST(EXISTS (SELECT 1 FROM r WHERE r.label = 'coding' AND r.Chromosome = p.Chromosome AND p.Position BETWEEN r.Start AND r.End_) AS INT) AS coding
        FROM {{panel}} p""",
)
def _(t):
    return intervals.interval_flag(
        t.panel.select("Chromosome", "Position", "SNPID"), t.sql(LABELLED), ["open", "coding"], width=20_000
    )


HAPLO = """SELECT DISTINCT Chromosome || ':' || CAST(Start * 40 AS VARCHAR(14)) || '-' || CAST(End_ * 40 - (Start % 11) * 70000 AS VARCHAR(14)) AS Haploblock FROM {blocks}"""


@query(
    "haploblock_to_loci",
    f"""WITH h AS (SELECT Haploblock, split_part(Haploblock, ':', 1) AS c, CAST(split_part(split_part(Haploblock, ':', 2), '-', 1) AS BIGINT) AS s,
                   CAST(split_part(split_part(Haploblock, ':', 2), '-', 2) AS BIGINT) AS e FROM ({HAPLO})),
        m AS (SELECT *, max(e) OVER (PARTITION BY c ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM h),
        i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 500000 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
        SELECT Haploblock, c AS Chromosome, c || ':' || CAST(min(s) OVER (PARTITION BY c, g) AS VARCHAR) || '-' || CAST(max(e) OVER (PARTITION BY c, g) AS VARCHAR) AS Loci FROM i""",
)
def _(t):
    return intervals.haploblock_to_loci(t.sql(HAPLO))


@query(
    "assign_regions",
    """WITH r AS (SELECT q.GENEID, q.Chromosome, q.Position, b.Chromosome || ':' || CAST(b.Start AS VARCHAR) || '-' || CAST(b.End_ AS VARCHAR) AS region_id
              FROM (SELECT GENEID || '_' || CELL AS GENEID, Chromosome, Position FROM {qtl}) q
              JOIN {blocks} b ON q.Chromosome = b.Chromosome AND q.Position BETWEEN b.Start AND b.End_)
       SELECT GENEID, (array_agg(region_id ORDER BY Chromosome, Position, region_id))[1] AS region_id, count(DISTINCT region_id) > 1 AS spans
       FROM r GROUP BY GENEID""",
)
def _(t):
    q = t.qtl.select(F.concat_ws("_", "GENEID", "CELL").alias("GENEID"), "Chromosome", "Position")
    return intervals.assign_regions(q, t.blocks, gene="GENEID", width=20_000)


@query(
    "drop_region_genes",
    """SELECT q.GENEID, q.SNPID, q.CELL FROM {qtl} q WHERE q.GENEID NOT IN
       (SELECT GENEID FROM {genes} WHERE Chromosome = '6' AND Start <= 160000 AND End_ >= 30000)""",
)
def _(t):
    return intervals.drop_region_genes(t.qtl.select("GENEID", "SNPID", "CELL"), t.genes, "6:30000-160000")


PLACED = """SELECT s.dataset, s.SNPID, s.RSID, s.P, b.Chromosome || ':' || CAST(b.Start AS VARCHAR(12)) || '-' || CAST(b.End_ AS VARCHAR(12)) AS Loci,
            s.Chromosome || ':' || CAST(CAST(floor(s.Position / 7000.0) AS BIGINT) AS VARCHAR(12)) AS Haploblock
     FROM {sumstats} s JOIN {blocks} b ON s.Chromosome = b.Chromosome AND s.Position BETWEEN b.Start AND b.End_"""


def placed(t):
    """The same table through the range join."""
    src = t.sumstats.withColumn(
        "Haploblock", F.concat(F.col("Chromosome"), F.lit(":"), F.floor(F.col("Position") / 7000.0).cast("string"))
    )
    return intervals.partition_by_block(src, t.blocks, width=20_000).select("dataset", "SNPID", "RSID", "P", "Loci", "Haploblock")


@query(
    "locus_filter_any",
    f"""WITH p AS ({PLACED}) SELECT dataset, SNPID, Loci FROM (SELECT *, min(P) OVER (PARTITION BY dataset, Loci) AS m FROM p) q WHERE m <= 5e-8""",
)
def _(t):
    return intervals.locus_filter_any(placed(t), "P", 5e-8, ["dataset", "Loci"]).select("dataset", "SNPID", "Loci")


SUMMARY = """SELECT dataset, Loci, arg_min(SNPID, (P, SNPID)) AS SNPID, arg_min(RSID, (P, SNPID)) AS RSID, round(-log10(min(P)), 6) AS P,
             count(DISTINCT CASE WHEN P <= 5e-8 THEN SNPID END) AS n_sig_snps, count(DISTINCT SNPID) AS n_snps {extra} FROM p GROUP BY dataset, Loci"""


@query("locus_summary", f"WITH p AS ({PLACED}) " + SUMMARY.format(extra=""))
def _(t):
    return intervals.locus_summary(placed(t), by=("dataset",)).withColumn("P", lp())


@query(
    "loci_with_blocks",
    f"WITH p AS ({PLACED}) " + SUMMARY.format(extra=", count(DISTINCT Haploblock) AS n_haploblocks"),
)
def _(t):
    return intervals.loci_with_blocks(placed(t), by=("dataset",)).withColumn("P", lp())


# --- loci --------------------------------------------------------------------


# Rows by rank, each taken unless a top taken before lies strictly within 10 kb.
CLUMPED = """cb AS (SELECT dataset, Chromosome, Position, min(P) AS P, arg_min(SNPID, (P, SNPID)) AS SNPID FROM {sumstats} WHERE P <= 5e-8 GROUP BY dataset, Chromosome, Position),
    cs AS (SELECT *, row_number() OVER (PARTITION BY dataset, Chromosome ORDER BY P, Position) AS rn FROM cb),
    cr AS (SELECT DISTINCT dataset, Chromosome, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS tops FROM cs UNION ALL
           SELECT s.dataset, s.Chromosome, s.rn, CASE WHEN len(list_filter(r.tops, lambda x: abs(x - s.Position) < 10000)) > 0 THEN r.tops ELSE list_append(r.tops, s.Position) END
           FROM cr r JOIN cs s ON s.dataset = r.dataset AND s.Chromosome = r.Chromosome AND s.rn = r.rn + 1),
    ct AS (SELECT dataset, Chromosome, unnest(arg_max(tops, rn)) AS Position FROM cr GROUP BY dataset, Chromosome),
    clumped AS (SELECT cb.* FROM cb JOIN ct ON cb.dataset = ct.dataset AND cb.Chromosome = ct.Chromosome AND cb.Position = ct.Position)"""


@query("clump_top", f"WITH RECURSIVE {CLUMPED} SELECT dataset, Chromosome, Position, SNPID, round(-log10(P), 6) AS P FROM clumped")
def _(t):
    tops = loci.clump_top(clean.significant(t.sumstats), 20_000).withColumn("P", lp())
    return tops.select("dataset", "Chromosome", "Position", "SNPID", "P")


# Tops given as the best significant row per 40 kb tile.
TOPS = """SELECT dataset, Chromosome, Position, P FROM (
            SELECT dataset, Chromosome, Position, P,
                   row_number() OVER (PARTITION BY dataset, Chromosome, CAST(floor(Position / 40000.0) AS BIGINT) ORDER BY P, Position) AS rn
            FROM {sumstats} WHERE P <= 5e-8) q WHERE rn = 1"""
DEFINED = f"""tops AS ({TOPS}),
    n AS (SELECT *, row_number() OVER (PARTITION BY dataset, Chromosome ORDER BY P, Position) AS Loci FROM tops),
    mem AS (SELECT s.dataset, s.Chromosome, s.Position, s.SNPID, s.P, n.Loci FROM {{sumstats}} s JOIN n
            ON s.dataset = n.dataset AND s.Chromosome = n.Chromosome AND s.Position BETWEEN n.Position - 10000 AND n.Position + 10000)"""
LOCUS_COLS = ["dataset", "Chromosome", "Position", "SNPID", "Loci", "Start", "End_"]


def _defined(t, shrink=False):
    src = t.sumstats.select("dataset", "Chromosome", "Position", "SNPID", "P")
    return loci.define_loci(src, t.sql(TOPS), window=20_000, shrink=shrink)


@query(
    "define_loci",
    f"""WITH {DEFINED}, b AS (SELECT dataset, Chromosome, Loci, min(Position) AS Start, max(Position) AS End_ FROM mem WHERE P <= 5e-8 GROUP BY ALL)
        SELECT m.dataset, m.Chromosome, m.Position, m.SNPID, m.Loci, b.Start, b.End_ FROM mem m
        JOIN b ON m.dataset = b.dataset AND m.Chromosome = b.Chromosome AND m.Loci = b.Loci WHERE m.Position BETWEEN b.Start AND b.End_""",
)
def _(t):
    return _defined(t, shrink=True).select(*LOCUS_COLS)


MERGED = f"""{DEFINED},
    sp AS (SELECT dataset, Chromosome, Loci, min(Position) AS s, max(Position) AS e FROM mem GROUP BY ALL),
    pe AS (SELECT *, max(e) OVER (PARTITION BY dataset, Chromosome ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM sp),
    isl AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, Chromosome ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM pe),
    bnd AS (SELECT dataset, Chromosome, g, min(s) AS Start, max(e) AS End_ FROM isl GROUP BY ALL),
    mg AS (SELECT DISTINCT m.dataset, m.Chromosome, m.Position, m.SNPID, CAST(i.g AS INT) AS Loci, b.Start, b.End_
           FROM mem m JOIN isl i ON m.dataset = i.dataset AND m.Chromosome = i.Chromosome AND m.Loci = i.Loci
           JOIN bnd b ON i.dataset = b.dataset AND i.Chromosome = b.Chromosome AND i.g = b.g)"""


@query("merge_loci", f"WITH {MERGED} SELECT * FROM mg")
def _(t):
    return loci.merge_loci(_defined(t)).select(*LOCUS_COLS)


@query(
    "number_loci",
    f"""WITH {MERGED} SELECT dataset, Chromosome, Position, SNPID, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY CAST(Chromosome AS INT), Start) AS INT) AS Loci,
        Start, End_ FROM mg""",
)
def _(t):
    return loci.number_loci(loci.merge_loci(_defined(t))).select(*LOCUS_COLS)


IDENTIFIED = MERGED.replace(f"({TOPS})", "(SELECT dataset, Chromosome, Position, P FROM clumped)").replace("m.SNPID, CAST(i.g", "m.SNPID, m.P, CAST(i.g")


@query(
    "identify_loci",
    f"""WITH RECURSIVE {CLUMPED}, {IDENTIFIED} SELECT dataset, Chromosome, Position, SNPID, round(-log10(P), 6) AS P,
          CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY CAST(Chromosome AS INT), Start) AS INT) AS Loci, Start, End_ FROM mg""",
)
def _(t):
    return loci.identify_loci(t.sumstats.select("dataset", "Chromosome", "Position", "SNPID", "P"), window=20_000).withColumn("P", lp())


# --- linkage -----------------------------------------------------------------

WINDOW = 25_000
LD_SQL = f"""ld AS (
    SELECT a.SNPID AS Lead, b.SNPID AS LD, a.population, corr(a.dosage, b.dosage) AS r, CAST(count(*) AS DOUBLE) AS n
    FROM {{genotypes}} a JOIN {{genotypes}} b ON a.donor = b.donor AND a.Chromosome = b.Chromosome AND abs(a.Position - b.Position) <= {WINDOW}
    WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL
      AND a.SNPID IN (SELECT SNPID FROM {{sumstats}} WHERE P <= 5e-8)
    GROUP BY a.SNPID, b.SNPID, a.population),
  r2 AS (SELECT Lead, LD, population, round(r * r, 8) AS r2, n FROM ld WHERE r IS NOT NULL AND NOT isnan(r)),
  wide AS (SELECT Lead, LD, max(CASE WHEN population = 'AFR' THEN r2 END) AS AFR, max(CASE WHEN population = 'EUR' THEN r2 END) AS EUR FROM r2 GROUP BY Lead, LD
           HAVING max(r2) >= 0.8)"""


def _ld(t):
    leads = clean.significant(t.sumstats).select("SNPID")
    return ld.ld_pairs(t.genotypes, leads, WINDOW).withColumn("r2", F.round("r2", 8))


def _wide(t):
    """The pair table, written once as a pipeline would."""
    return settle(ld.ld_merge_populations(_ld(t), POPS))


@query("ld_pairs", f"WITH {LD_SQL} SELECT Lead, LD, population, r2, n FROM r2")
def _(t):
    return _ld(t)


@query("ld_merge_populations", f"WITH {LD_SQL} SELECT Lead, LD, AFR, EUR FROM wide")
def _(t):
    return _wide(t)


@query(
    "ld_add_missing",
    f"""WITH {LD_SQL} SELECT Lead, LD, AFR, EUR FROM wide UNION ALL
        SELECT SNPID, SNPID, 1.0, 1.0 FROM (SELECT DISTINCT SNPID FROM {{panel}}) p WHERE SNPID NOT IN (SELECT Lead FROM wide)""",
)
def _(t):
    return ld.ld_add_missing(_wide(t), t.panel.select("SNPID"), POPS)


@query(
    "missing_leads",
    f"WITH {LD_SQL} SELECT DISTINCT SNPID AS Lead FROM {{panel}} WHERE SNPID NOT IN (SELECT Lead FROM wide)",
)
def _(t):
    return ld.missing_leads(t.panel, _wide(t))


# Proxies read off a pair table that keeps only some variants as leads.
PROXY = "pr AS (SELECT * FROM wide WHERE Lead = LD AND AFR IS NOT NULL AND Lead < '15' OR Lead <> LD)"


@query(
    "lead_or_proxy",
    f"""WITH {LD_SQL}, {PROXY}, le AS (SELECT * FROM pr WHERE Lead = LD),
        px AS (SELECT *, row_number() OVER (PARTITION BY LD ORDER BY greatest(AFR, EUR) DESC NULLS LAST, Lead) AS rn FROM pr WHERE LD NOT IN (SELECT LD FROM le))
        SELECT Lead, LD, AFR, EUR, 'Lead' AS Category FROM le UNION ALL SELECT Lead, LD, AFR, EUR, 'LD' FROM px WHERE rn = 1""",
)
def _(t):
    pairs = _wide(t).filter("Lead = LD AND AFR IS NOT NULL AND Lead < '15' OR Lead <> LD")
    return ld.lead_or_proxy(pairs, POPS)


@query(
    "ld_add_info",
    f"""WITH {LD_SQL}, g AS (SELECT dataset, SNPID, round(-log10(P), 6) AS P, BETA FROM {{sumstats}})
        SELECT DISTINCT a.dataset, w.Lead, w.LD AS SNPID, w.AFR, w.EUR, a.P AS GWAS_P, a.BETA AS GWAS_BETA, b.P AS GWAS_Lead_P, b.BETA AS GWAS_Lead_BETA
        FROM wide w JOIN g a ON w.LD = a.SNPID LEFT JOIN g b ON w.Lead = b.SNPID AND a.dataset = b.dataset""",
)
def _(t):
    g = t.sumstats.select("dataset", "SNPID", lp().alias("P"), "BETA")
    pairs = _wide(t).join(g.select("dataset", F.col("SNPID").alias("LD")), "LD")
    return ld.ld_add_info(pairs, g, by=("dataset",))


# --- overlap -----------------------------------------------------------------


@query(
    "qtl_project",
    "SELECT CELL, SNPID, GENEID, GENENAME, round(-log10(P), 6) AS P, BETA, 'rs' || SNPID AS RSID FROM {qtl}",
)
def _(t):
    return overlap.qtl_project(t.qtl.withColumn("RSID", F.concat(F.lit("rs"), "SNPID")), "eQTL").withColumn("P", lp())


# QTL rows at P <= 1e-4, one per cell, gene and variant.
SIGQTL = """SELECT CELL, GENEID, GENENAME, SNPID, min(P) AS P, min(BETA) AS BETA FROM {qtl} GROUP BY CELL, GENEID, GENENAME, SNPID"""


@query(
    "overlap",
    f"""WITH q AS ({SIGQTL}) SELECT q.SNPID, q.CELL, q.GENEID, round(-log10(q.P), 6) AS qtl_P, q.BETA AS qtl_BETA, s.dataset,
         round(-log10(s.P), 6) AS gwas_P, s.BETA AS gwas_BETA, split_part(q.SNPID, ':', 1) AS Chromosome, CAST(split_part(q.SNPID, ':', 2) AS BIGINT) AS Position,
         split_part(q.SNPID, ':', 3) AS REF, split_part(q.SNPID, ':', 4) AS ALT
        FROM q JOIN {{sumstats}} s ON q.SNPID = s.SNPID WHERE s.P <= 5e-8""",
)
def _(t):
    q = t.sql(SIGQTL).drop("GENENAME")
    g = clean.significant(t.sumstats).select("dataset", "SNPID", "P", "BETA")
    return overlap.overlap(q, g, ("qtl", "gwas")).withColumns({"qtl_P": lp("qtl_P"), "gwas_P": lp("gwas_P")})


OV = f"""ov AS (SELECT q.CELL, q.GENEID, q.GENENAME, q.SNPID, q.P, q.BETA, s.dataset, s.disease
        FROM ({SIGQTL}) q JOIN {{sumstats}} s ON q.SNPID = s.SNPID WHERE s.P <= 5e-8)"""


def _ov(t):
    sig = clean.significant(t.sumstats).select("dataset", "disease", "SNPID")
    return t.sql(SIGQTL).join(sig, "SNPID").select("CELL", "GENEID", "GENENAME", "SNPID", "P", "BETA", "dataset", "disease")


@query(
    "overlap_gwas",
    f"""WITH {LD_SQL}, sig AS (SELECT DISTINCT dataset, SNPID FROM {{sumstats}} WHERE P <= 5e-8),
        le AS (SELECT dataset, SNPID AS Lead, SNPID AS LD, 'Lead' AS Category FROM sig),
        px AS (SELECT s.dataset, w.Lead, w.LD, 'LD' AS Category, row_number() OVER (PARTITION BY s.dataset, w.LD ORDER BY greatest(w.AFR, w.EUR) DESC NULLS LAST, w.Lead) AS rn
               FROM sig s JOIN wide w ON s.SNPID = w.Lead LEFT JOIN sig o ON o.dataset = s.dataset AND o.SNPID = w.LD WHERE o.SNPID IS NULL),
        al AS (SELECT * FROM le UNION ALL SELECT dataset, Lead, LD, Category FROM px WHERE rn = 1),
        q AS ({SIGQTL})
        SELECT a.dataset, a.Lead, q.SNPID, a.Category, q.CELL, q.GENEID, round(-log10(x.P), 6) AS GWAS_P, x.BETA AS GWAS_BETA,
               round(-log10(y.P), 6) AS GWAS_Lead_P, y.BETA AS GWAS_Lead_BETA
        FROM al a JOIN q ON a.LD = q.SNPID LEFT JOIN {{sumstats}} x ON x.dataset = a.dataset AND x.SNPID = a.LD
        LEFT JOIN {{sumstats}} y ON y.dataset = a.dataset AND y.SNPID = a.Lead""",
)
def _(t):
    out = overlap.overlap_gwas(t.sumstats, t.sql(SIGQTL), _wide(t), POPS)
    return out.select(
        "dataset", "Lead", "SNPID", "Category", "CELL", "GENEID", lp("GWAS_P").alias("GWAS_P"), "GWAS_BETA",
        lp("GWAS_Lead_P").alias("GWAS_Lead_P"), "GWAS_Lead_BETA",
    )


@query(
    "best_per_gene",
    """SELECT GENEID, SNPID, round(-log10(P), 6) AS P FROM (SELECT *, row_number() OVER (PARTITION BY GENEID ORDER BY P, SNPID) AS rn FROM {qtl}) q WHERE rn = 1""",
)
def _(t):
    return overlap.best_per_gene(t.qtl).select("GENEID", "SNPID", lp().alias("P"))


def pivot_sql(src: str, value: str, key: str = "CELL") -> str:
    return ", ".join(f"coalesce(round(max(CASE WHEN {key} = '{c}' THEN {value} END), 6), 0.0) AS \"{c}\"" for c in [*CELLS, "ZZ"])


@query(
    "gene_cell_matrix",
    f"WITH {OV} SELECT GENEID, GENENAME, {pivot_sql('ov', '-log10(P)')} FROM ov GROUP BY GENEID, GENENAME",
)
def _(t):
    out = overlap.gene_cell_matrix(_ov(t), [*CELLS, "ZZ"])
    return out.select("GENEID", "GENENAME", *[F.round(c, 6).alias(c) for c in [*CELLS, "ZZ"]])


@query(
    "replication",
    f"""WITH {OV} SELECT GENEID, string_agg(DISTINCT dataset, ', ' ORDER BY dataset) AS GWAS_datasets, count(DISTINCT dataset) AS Number_of_GWAS_datasets
        FROM ov GROUP BY GENEID""",
)
def _(t):
    return overlap.replication(_ov(t))


@query(
    "master_summary",
    f"""WITH {OV}, c AS (SELECT disease, GENEID, GENENAME, CELL, -log10(min(P)) AS v FROM ov GROUP BY ALL)
        SELECT c.disease, GENEID, GENENAME, round(max(v), 6) AS Max_value, count(*) FILTER (WHERE v > 7) AS Number_of_celltypes, max(n) AS Number_of_GWAS_studies
        FROM c JOIN (SELECT disease, count(DISTINCT dataset) AS n FROM {{sumstats}} GROUP BY disease) s ON c.disease = s.disease GROUP BY ALL""",
)
def _(t):
    studies = t.sumstats.select("disease", "dataset")
    return overlap.master_summary(_ov(t), studies, threshold=7.0).withColumn("Max_value", F.round("Max_value", 6))


EG = """SELECT 'ENSG' || lpad(CAST(l_suppkey AS VARCHAR(11)), 11, '0') AS gene, l_returnflag || l_linestatus || '_' || CAST(l_linenumber % 2 AS VARCHAR(2)) AS id,
        min(CASE WHEN l_quantity = 50 THEN 0.0D ELSE pow(10.0D, -l_quantity / 4.5) END) AS FDR, min(l_quantity) < 2.0 AS is_egene FROM {lineitem}
        GROUP BY l_suppkey, l_returnflag, l_linestatus, l_linenumber % 2"""


@query(
    "egene_matrix",
    f"""WITH e AS ({EG}) SELECT gene, {', '.join(f"round(max(CASE WHEN id = '{c}' THEN CASE WHEN FDR = 0 THEN 10.0D WHEN -log10(FDR) > 10 THEN 10.0D ELSE -log10(FDR) END END), 6) AS \"{c}\"" for c in CELLS)}
        FROM e WHERE is_egene GROUP BY gene""",
)
def _(t):
    out = overlap.egene_matrix(t.sql(EG), CELLS)
    return out.select("gene", *[F.round(c, 6).alias(c) for c in CELLS])


@query(
    "locus_outer_merge",
    f"""WITH a AS (SELECT SNPID, min(P) AS P FROM {{sumstats}} GROUP BY SNPID),
             b AS (SELECT SNPID, min(P) AS P FROM {{qtl}} GROUP BY SNPID)
        SELECT coalesce(a.SNPID, b.SNPID) AS SNPID, round(-log10(a.P), 6) AS log10p_gwas, round(-log10(b.P), 6) AS log10p_qtl FROM a FULL JOIN b ON a.SNPID = b.SNPID""",
)
def _(t):
    a = t.sumstats.groupBy("SNPID").agg(F.min("P").alias("P"))
    b = t.qtl.groupBy("SNPID").agg(F.min("P").alias("P"))
    out = overlap.locus_outer_merge(a, b, ["SNPID"], ("_gwas", "_qtl"))
    return out.select("SNPID", F.round("log10p_gwas", 6).alias("log10p_gwas"), F.round("log10p_qtl", 6).alias("log10p_qtl"))


@query(
    "shared_ids",
    "SELECT SNPID FROM {sumstats} WHERE P <= 5e-8 INTERSECT SELECT SNPID FROM {qtl}",
)
def _(t):
    return overlap.shared_ids(clean.significant(t.sumstats), t.qtl)


@query(
    "union_by_name",
    """SELECT SNPID, dataset, CAST(NULL AS VARCHAR) AS CELL, BETA FROM {sumstats} UNION ALL SELECT SNPID, NULL, CELL, BETA FROM {qtl}""",
)
def _(t):
    return overlap.union_by_name([t.sumstats.select("SNPID", "dataset", "BETA"), t.qtl.select("BETA", "CELL", "SNPID")])


@query("distinct_rows", "SELECT DISTINCT CELL, GENEID, Chromosome FROM {qtl}")
def _(t):
    return overlap.distinct_rows(t.qtl.select("CELL", "GENEID", "Chromosome"))


@query(
    "reduce_outer",
    f"""SELECT GENEID, {', '.join(f"round(max(CASE WHEN CELL = '{c}' THEN BETA END), 6) AS {c.lower()}" for c in CELLS)} FROM {{qtl}} GROUP BY GENEID""",
)
def _(t):
    per = {c.lower(): t.qtl.filter(F.col("CELL") == c) for c in CELLS}
    out = overlap.reduce_outer(per, "GENEID", "BETA")
    return out.select("GENEID", *[F.round(c, 6).alias(c) for c in per])

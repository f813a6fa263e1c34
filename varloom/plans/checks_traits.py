"""Queries over colocalisation, fine-mapping and heritability."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import coloc, finemap
from varloom.plans.checks_loci import LD_SQL, _ld, lp
from varloom.plans.registry import query
from varloom.sources.sinks import release, settle


def rnd(df, digits: int, *cols: str):
    out = {}
    for c in cols:
        v = F.round(c, digits)
        out[c] = F.when(v == 0, F.lit(0.0)).otherwise(v)
    return df.withColumns(out)


# --- colocalisation ----------------------------------------------------------


@query(
    "coloc_case1",
    """SELECT dataset, SNPID, BETA, SE, AF, round(SE * SE, 9) AS varbeta FROM {sumstats} WHERE SE > 0 AND AF > 0 AND AF < 1 AND BETA IS NOT NULL AND dataset <> 'GCST3'""",
)
def _(t):
    s = t.sumstats
    dirty = s.withColumn("BETA", F.when(F.col("dataset") == "GCST3", F.lit(float("inf"))).otherwise(F.col("BETA")))
    out = coloc.coloc_case1(dirty, "quant")
    return rnd(out, 9, "varbeta").select("dataset", "SNPID", "BETA", "SE", "AF", "varbeta")


@query(
    "coloc_case2",
    "SELECT dataset, SNPID, round(-log10(P), 6) AS P, AF FROM {sumstats} WHERE P > 0 AND AF > 0 AND AF < 1",
)
def _(t):
    return coloc.coloc_case2(t.sumstats, "cc", 1000, 0.3).select("dataset", "SNPID", lp().alias("P"), "AF")


CK = "dataset1, dataset2, Feature1, Feature2"
TRAIT1 = """SELECT dataset1, Feature1, Chromosome, Position, SNPID, P, BETA, SE, varbeta FROM (
              SELECT s.dataset AS dataset1, b.Chromosome || ':' || CAST(b.Start AS VARCHAR(12)) || '-' || CAST(b.End_ AS VARCHAR(12)) AS Feature1,
                s.Chromosome, s.Position, s.SNPID, s.P, s.BETA, s.SE, s.SE * s.SE AS varbeta,
                min(s.P) OVER (PARTITION BY s.dataset, b.Chromosome, b.Start, b.End_) AS best
              FROM {sumstats} s JOIN {blocks} b ON s.Chromosome = b.Chromosome AND s.Position BETWEEN b.Start AND b.End_ WHERE s.SE > 0) q WHERE best <= 5e-8"""
TRAIT2 = """SELECT q.CELL AS dataset2, q.GENEID || '_' || b.Chromosome || ':' || CAST(b.Start AS VARCHAR(12)) || '-' || CAST(b.End_ AS VARCHAR(12)) AS Feature2,
              q.Chromosome, q.Position, q.SNPID, q.P, q.BETA, q.SE, q.MAF AS AF, q.SE * q.SE AS varbeta
            FROM {qtl_cis} q JOIN {blocks} b ON q.Chromosome = b.Chromosome AND q.Position BETWEEN b.Start AND b.End_ WHERE q.SE > 0 AND q.MAF > 0 AND q.MAF < 1"""
INTER = f"""t1 AS MATERIALIZED ({TRAIT1}), t2 AS MATERIALIZED ({TRAIT2}),
   d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset1, Feature1, Chromosome, Position, SNPID ORDER BY P, BETA, SE) AS rn FROM t1) q WHERE rn = 1),
   d2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset2, Feature2, Chromosome, Position, SNPID ORDER BY P, BETA, SE) AS rn FROM t2) q WHERE rn = 1),
   pr AS MATERIALIZED (SELECT d1.dataset1, d2.dataset2, d1.Feature1, d2.Feature2, d1.Chromosome, d1.Position, d1.SNPID, d1.P AS F1_P, d1.BETA AS F1_BETA, d1.SE AS F1_SE,
           d1.varbeta AS F1_varbeta, d2.P AS F2_P, d2.BETA AS F2_BETA, d2.SE AS F2_SE, d2.AF AS F2_AF, d2.varbeta AS F2_varbeta
          FROM d1 JOIN d2 ON d1.Chromosome = d2.Chromosome AND d1.Position = d2.Position AND d1.SNPID = d2.SNPID)"""
N_QTL = 500.0


def _t1(t):
    return coloc.trait_loci(coloc.coloc_case1(t.sumstats.drop("AF"), "cc"), t.blocks, width=20_000)


def _t2(t, trait):
    return coloc.qtl_loci(coloc.coloc_case1(t.qtl_cis.withColumnRenamed("MAF", "AF"), "quant"), t.blocks, trait, width=20_000)


def _pairs(t):
    trait = settle(_t1(t))
    return coloc.coloc_intersect(trait, _t2(t, trait))


@query("coloc_trait_loci", f"SELECT dataset1, Feature1, SNPID, round(varbeta, 9) AS varbeta FROM ({TRAIT1}) q")
def _(t):
    return rnd(_t1(t), 9, "varbeta").select("dataset1", "Feature1", "SNPID", "varbeta")


@query(
    "coloc_pairs",
    f"""WITH t1 AS ({TRAIT1}), t2 AS ({TRAIT2})
        SELECT {CK}, t1.Position, t1.SNPID, t2.SNPID AS SNPID_2, t1.BETA AS F1_BETA, t2.BETA AS F2_BETA
        FROM t1 JOIN t2 ON t1.Chromosome = t2.Chromosome AND t1.Position = t2.Position""",
)
def _(t):
    trait = settle(_t1(t))
    return coloc.coloc_pairs(trait, _t2(t, trait)).select(*coloc.KEYS, "Position", "SNPID", "SNPID_2", "F1_BETA", "F2_BETA")


@query(
    "coloc_intersect",
    f"WITH {INTER} SELECT {CK}, SNPID, F1_BETA, F1_SE, F2_BETA, F2_SE, round(-log10(F2_P), 6) AS F2_P FROM pr",
)
def _(t):
    return _pairs(t).select(*coloc.KEYS, "SNPID", "F1_BETA", "F1_SE", "F2_BETA", "F2_SE", lp("F2_P").alias("F2_P"))


LBF = f"""{INTER},
   sd AS (SELECT {CK}, sum((1.0D / F2_varbeta) * (2.0D * {N_QTL}D * F2_AF * (1.0D - F2_AF))) / sum((1.0D / F2_varbeta) * (1.0D / F2_varbeta)) AS s2 FROM pr GROUP BY {CK}),
   rr AS (SELECT pr.*, 0.04D / (0.04D + F1_varbeta) AS r1, (0.0225D * s2) / (0.0225D * s2 + F2_varbeta) AS r2 FROM pr JOIN sd USING ({CK})),
   lb AS MATERIALIZED (SELECT {CK}, Chromosome, Position, SNPID, 0.5D * (ln(1.0D - r1) + r1 * F1_BETA * F1_BETA / F1_varbeta) AS lbf1,
            0.5D * (ln(1.0D - r2) + r2 * F2_BETA * F2_BETA / F2_varbeta) AS lbf2 FROM rr)"""


def _coloc(t):
    """Bayes factors and posteriors of all studies, cell types, loci and genes."""
    return coloc.colocalise(t.sumstats.drop("AF"), t.qtl_cis.withColumnRenamed("MAF", "AF"), t.blocks, n=(None, N_QTL), width=20_000)


@query("abf_lbf", f"WITH {LBF} SELECT {CK}, SNPID, round(lbf1, 6) AS lbf1, round(lbf2, 6) AS lbf2 FROM lb")
def _(t):
    return rnd(coloc.abf_lbf(_pairs(t), n=(None, N_QTL)), 6, "lbf1", "lbf2").select(*coloc.KEYS, "SNPID", "lbf1", "lbf2")


ABF = f"""{LBF},
   mx AS (SELECT *, max(lbf1) OVER w AS m1, max(lbf2) OVER w AS m2, max(lbf1 + lbf2) OVER w AS m12 FROM lb WINDOW w AS (PARTITION BY {CK})),
   ls AS (SELECT {CK}, count(*) AS nsnps, max(m1) + ln(sum(exp(lbf1 - m1))) AS s1, max(m2) + ln(sum(exp(lbf2 - m2))) AS s2,
            max(m12) + ln(sum(exp(lbf1 + lbf2 - m12))) AS s12, max(m12) AS top, arg_min(SNPID, (-(lbf1 + lbf2), SNPID)) AS SNPID,
            arg_min(Position, (-(lbf1 + lbf2), SNPID)) AS Position, min(Chromosome) AS Chromosome FROM mx GROUP BY {CK}),
   hh AS (SELECT *, ln(1e-4D) + s1 AS l1, ln(1e-4D) + s2 AS l2, ln(1e-5D) + s12 AS l4,
            CASE WHEN nsnps > 1 AND 1.0D - exp(s12 - s1 - s2) > 1e-12 THEN 2 * ln(1e-4D) + s1 + s2 + ln(1.0D - exp(s12 - s1 - s2)) END AS l3 FROM ls),
   ww AS (SELECT *, greatest(0.0D, l1, l2, coalesce(l3, -1e9D), l4) AS m FROM hh),
   pw AS (SELECT *, exp(-m) AS w0, exp(l1 - m) AS w1, exp(l2 - m) AS w2, CASE WHEN l3 IS NULL THEN 0.0D ELSE exp(l3 - m) END AS w3, exp(l4 - m) AS w4 FROM ww),
   pp AS (SELECT *, w0 + w1 + w2 + w3 + w4 AS tot FROM pw),
   sm AS MATERIALIZED (SELECT {CK}, Chromosome, nsnps, w0 / tot AS PPH0, w1 / tot AS PPH1, w2 / tot AS PPH2, w3 / tot AS PPH3, w4 / tot AS PPH4,
            CASE WHEN w3 > 0 THEN w4 / w3 END AS ratio, SNPID, Position, exp(top - s12) AS SNP_PP_H4, s12 FROM pp)"""
PPH = "round(PPH0, 6) AS PPH0, round(PPH1, 6) AS PPH1, round(PPH2, 6) AS PPH2, round(PPH3, 6) AS PPH3, round(PPH4, 6) AS PPH4"
PPC = [f"PPH{i}" for i in range(5)]


@query(
    "coloc_abf",
    f"""WITH {ABF} SELECT {CK}, Chromosome, nsnps, {PPH}, PPH3 = 0 AS no_ratio, SNPID, Position, round(SNP_PP_H4, 6) AS SNP_PP_H4, 'abf' AS METHOD FROM sm""",
)
def _(t):
    out = rnd(_coloc(t)[1], 6, *PPC, "SNP_PP_H4").withColumn("no_ratio", F.col("PPH4_PPH3").isNull())
    return out.select(*coloc.KEYS, "Chromosome", "nsnps", *PPC, "no_ratio", "SNPID", "Position", "SNP_PP_H4", "METHOD")


@query(
    "coloc_full",
    f"""WITH {ABF} SELECT {CK}, lb.SNPID, {PPH}, round(exp(lb.lbf1 + lb.lbf2 - sm.s12), 6) AS SNP_PP_H4 FROM lb JOIN sm USING ({CK})""",
)
def _(t):
    out = coloc.coloc_full(*_coloc(t))
    return rnd(out, 6, *PPC, "SNP_PP_H4").select(*coloc.KEYS, "SNPID", *PPC, "SNP_PP_H4")


HITS = f"{ABF}, hits AS (SELECT * FROM sm WHERE PPH4 >= 0.5 AND (ratio IS NULL OR ratio >= 5))"


def _hits(t):
    """Pairs that colocalise, as the reports take them."""
    return coloc.filter_coloc(_coloc(t)[1])


@query("filter_coloc", f"WITH {HITS} SELECT {CK}, SNPID, round(PPH4, 6) AS PPH4 FROM hits")
def _(t):
    return rnd(_hits(t), 6, "PPH4").select(*coloc.KEYS, "SNPID", "PPH4")


GRID = ", ".join(f"pow(10.0D, -8.0D + {i} * 4.0D / 99)" for i in range(100))


@query(
    "coloc_min_p12",
    f"""WITH {ABF}, g AS (SELECT unnest([{GRID}]) AS p),
        k AS (SELECT *, nsnps * (1e-4D + 1e-4D) + nsnps * (nsnps - 1) * 1e-8D AS fx FROM sm WHERE PPH4 >= 0.5),
        m AS (SELECT {CK}, min(g.p) AS p FROM k, g WHERE PPH4 * g.p / 1e-5D + PPH0 * nsnps * g.p / (1.0D - fx - nsnps * 1e-5D) >
              1.000000001D * (PPH0 * (1.0D - fx) / (1.0D - fx - nsnps * 1e-5D) + PPH1 + PPH2 + PPH3) GROUP BY {CK})
        SELECT {CK}, round(log10(m.p), 6) AS log_p12 FROM sm LEFT JOIN m USING ({CK})""",
)
def _(t):
    return coloc.coloc_min_p12(_coloc(t)[1]).select(*coloc.KEYS, F.round(F.log10("min_p12"), 6).alias("log_p12"))


# --- fine-mapping ------------------------------------------------------------


@query(
    "group_size_filter",
    """SELECT CELL, GENEID, SNPID FROM {qtl} WHERE CELL IN (SELECT CELL FROM {qtl} GROUP BY CELL HAVING count(DISTINCT GENEID) >= 60 AND count(DISTINCT GENEID) < 1000000)""",
)
def _(t):
    return finemap.group_size_filter(t.qtl.select("CELL", "GENEID", "SNPID"), 60, "CELL", "GENEID")


GW = """SELECT GENEID AS gene, 'expression' AS type, CELL AS context, SNPID AS id, max(BETA) AS weight FROM {qtl} GROUP BY GENEID, CELL, SNPID"""
LDR = """SELECT a.SNPID AS id1, b.SNPID AS id2, CASE WHEN a.SNPID = b.SNPID THEN 1.0D ELSE CAST((a.Position + b.Position) % 7 - 3 AS DOUBLE) / 10 END AS r
         FROM (SELECT Chromosome, Position, SNPID, CAST(floor(Position / 25000.0) AS BIGINT) AS bin FROM {panel}) a
         JOIN (SELECT Chromosome, Position, SNPID, CAST(floor(Position / 25000.0) AS BIGINT) AS bin FROM {panel}) b
           ON a.Chromosome = b.Chromosome AND a.bin = b.bin AND a.SNPID <= b.SNPID"""


@query(
    "gene_z",
    f"""WITH w AS ({GW}), r AS ({LDR}), z AS (SELECT dataset, SNPID AS id, BETA / SE AS z FROM {{sumstats}}),
        n AS (SELECT z.dataset, w.gene, w.type, w.context, sum(w.weight * z.z) AS num, count(*) AS n_snps FROM w JOIN z ON w.id = z.id WHERE z.z IS NOT NULL GROUP BY ALL),
        d AS (SELECT z1.dataset, w1.gene, w1.type, w1.context, sum(CASE WHEN r.id1 = r.id2 THEN 1.0 ELSE 2.0 END * w1.weight * r.r * w2.weight) AS den
              FROM r JOIN w w1 ON r.id1 = w1.id JOIN w w2 ON r.id2 = w2.id AND w1.gene = w2.gene AND w1.context = w2.context
                JOIN (SELECT DISTINCT dataset, id FROM z WHERE z IS NOT NULL) z1 ON z1.id = r.id1 JOIN (SELECT DISTINCT dataset, id FROM z WHERE z IS NOT NULL) z2 ON z2.id = r.id2 AND z2.dataset = z1.dataset GROUP BY ALL)
        SELECT n.dataset, n.gene, n.type, n.context, n.n_snps, CASE WHEN den > 1e-9 THEN round(num / sqrt(den), 6) END AS z
        FROM n JOIN d ON n.dataset = d.dataset AND n.gene = d.gene AND n.context = d.context WHERE den > 1e-9""",
)
def _(t):
    z = t.sumstats.select("dataset", F.col("SNPID").alias("id"), (F.col("BETA") / F.col("SE")).alias("z"))
    # the rows of GW, dealt by variant, as gene_z needs them
    q = t.qtl.select(F.col("GENEID").alias("gene"), F.col("CELL").alias("context"), F.col("SNPID").alias("id"), "BETA").repartition("id")
    w = q.groupBy("gene", F.lit("expression").alias("type"), "context", "id").agg(F.max("BETA").alias("weight"))
    out = finemap.gene_z(w, z, t.sql(LDR)).filter("z IS NOT NULL")
    return rnd(out, 6, "z")


PRIOR = "SELECT grp, CASE WHEN grp = 'SNP' THEN 0.01D ELSE 0.05D END AS pi, CASE WHEN grp = 'SNP' THEN 5.0D ELSE 8.0D END AS var FROM {region_z} GROUP BY grp"
PIP = f"""w AS (SELECT z.*, p.pi, ln(p.pi) - 0.5D * ln(1.0D + p.var) + 0.5D * z.z * z.z * p.var / (1.0D + p.var) AS lw FROM {{region_z}} z JOIN ({PRIOR}) p ON z.grp = p.grp),
   m AS (SELECT *, max(lw) OVER (PARTITION BY dataset, region_id) AS mx FROM w),
   l AS (SELECT *, mx + ln(sum(exp(lw - mx)) OVER (PARTITION BY dataset, region_id)) AS ls FROM m),
   a AS (SELECT dataset, region_id, grp, id, z, exp(lw - ls) AS alpha, exp(lw - greatest(ls, 0.0D) - ln(exp(ls - greatest(ls, 0.0D)) + exp(-greatest(ls, 0.0D)))) AS pip FROM l),
   c AS (SELECT *, sum(alpha) OVER (PARTITION BY dataset, region_id ORDER BY alpha DESC, id, grp ROWS UNBOUNDED PRECEDING) - alpha AS bef FROM a)"""
RG = ("dataset", "region_id")


def _region_z(t):
    """The rows of the regions, written once: priors and posteriors read them several times."""
    out = settle(t.region_z)
    release(t.spark)
    return out


@query(
    "region_pip",
    f"WITH {PIP} SELECT dataset, region_id, grp, id, round(pip, 6) AS pip, round(alpha, 6) AS alpha, bef < 0.95 AS cs FROM c",
)
def _(t):
    z = _region_z(t)
    out = finemap.region_pip(z, t.sql(PRIOR, region_z=z), region=RG)
    return rnd(out, 6, "pip", "alpha").select("dataset", "region_id", "grp", "id", "pip", "alpha", "cs")


@query(
    "screen_regions",
    f"""WITH {PIP}, s AS (SELECT dataset, region_id, sum(CASE WHEN grp <> 'SNP' THEN pip ELSE 0 END) AS g FROM c GROUP BY ALL)
        SELECT c.dataset, c.region_id, c.grp, c.id, round(s.g, 6) AS nonSNP_PIP FROM c JOIN s ON c.dataset = s.dataset AND c.region_id = s.region_id WHERE s.g >= 0.5""",
)
def _(t):
    z = _region_z(t)
    pips = finemap.region_pip(z, t.sql(PRIOR, region_z=z), region=RG).select("dataset", "region_id", "grp", "id", "pip")
    return rnd(finemap.screen_regions(pips, region=RG), 6, "nonSNP_PIP").drop("pip")


@query(
    "region_screen_table",
    f"""WITH {PIP} SELECT dataset, region_id, count(*) FILTER (WHERE grp <> 'SNP') AS n_gids, count(*) FILTER (WHERE grp = 'SNP') AS n_sids,
          round(max(CASE WHEN grp <> 'SNP' THEN abs(z) END), 6) AS max_gene_absZ, round(max(CASE WHEN grp = 'SNP' THEN abs(z) END), 6) AS max_snp_absZ,
          round(sum(CASE WHEN grp <> 'SNP' THEN pip ELSE 0 END), 6) AS nonSNP_PIP FROM c GROUP BY dataset, region_id""",
)
def _(t):
    z = _region_z(t)
    pips = finemap.region_pip(z, t.sql(PRIOR, region_z=z), region=RG)
    return rnd(finemap.region_screen_table(pips, RG), 6, "max_gene_absZ", "max_snp_absZ", "nonSNP_PIP")


@query("filter_pip", "SELECT dataset1, SNPID, round(PPH4, 6) AS susie_pip FROM {coloc_hits} WHERE PPH4 > 0.7")
def _(t):
    df = t.coloc_hits.select("dataset1", "SNPID", F.col("PPH4").alias("susie_pip"))
    return rnd(finemap.filter_pip(df), 6, "susie_pip")


# the EM by recursion: a working table of parameters, tied over all groups as `shared_all` does
EM_STEP = """SELECT it + 1, grp, pi, var, greatest(abs(pi - pi0) / pi0, abs(var - var0) / var0) AS change FROM (
    SELECT any_value(it) AS it, grp, any_value(pi0) AS pi0, any_value(var0) AS var0, greatest(sum(pip) / count(*), 1e-12D) AS pi, greatest(sum(sum(pip * m2)) OVER () / sum(sum(pip)) OVER (), 1e-6D) AS var FROM (
      SELECT it, grp, pi AS pi0, var AS var0, m2, w / (1.0D + sum(w) OVER (PARTITION BY dataset, region_id)) AS pip FROM (
        SELECT p.it, p.pi, p.var, z.grp, z.dataset, z.region_id, p.pi * exp(-0.5D * ln(1.0D + p.var) + 0.5D * z.z * z.z * p.var / (1.0D + p.var)) AS w,
               z.z * z.z * (p.var / (1.0D + p.var)) * (p.var / (1.0D + p.var)) + p.var / (1.0D + p.var) AS m2
        FROM {rows} z JOIN (SELECT * FROM {src}) p ON z.grp = p.grp)) GROUP BY grp)"""
EM = f"""em0 AS MATERIALIZED (SELECT grp, z, dataset, region_id FROM {{region_z}} WHERE z IS NOT NULL AND grp IN (SELECT grp FROM {{region_z}} WHERE z IS NOT NULL GROUP BY grp HAVING count(*) >= 100)),
   em1 AS MATERIALIZED (SELECT z.* FROM em0 z JOIN (SELECT dataset, region_id FROM em0 GROUP BY dataset, region_id HAVING count(*) >= 2 AND count(*) FILTER (WHERE grp <> 'SNP') >= 1) r USING (dataset, region_id)),
   pre AS (SELECT 0 AS it, grp, 0.01D AS pi, 10.0D AS var, 1.0D AS change FROM em1 GROUP BY grp UNION ALL {EM_STEP.format(rows='em1', src='pre WHERE it < 3')}),
   em2 AS MATERIALIZED (SELECT z.* FROM em1 z JOIN (SELECT dataset, region_id FROM em1 JOIN (SELECT grp, pi FROM pre WHERE it = 3) p USING (grp) GROUP BY dataset, region_id
        HAVING exp(sum(ln(1.0D - pi))) * (1.0D + sum(pi / (1.0D - pi))) >= 0.8) r USING (dataset, region_id)),
   fit AS (SELECT 0 AS it, grp, pi, var, 1.0D AS change FROM pre WHERE it = 3
           UNION ALL {EM_STEP.format(rows='em2', src='(SELECT *, max(change) OVER () AS most FROM fit) WHERE it < 150 AND most > 1e-4')}),
   prior AS (SELECT grp, pi, var FROM fit WHERE it = (SELECT max(it) FROM fit))"""


def _prior(t, z=None, **options):
    return finemap.est_group_prior(_region_z(t) if z is None else z, region=RG, **options)


@query("est_group_prior", f"WITH RECURSIVE {EM} SELECT grp, round(pi, 6) AS pi, round(var, 6) AS var FROM prior")
def _(t):
    return rnd(_prior(t), 6, "pi", "var")


@query("est_group_prior_converged")
def _(t):
    """Every group with its own variance, over all rows, until nothing changes."""
    return rnd(_prior(t, **PLAIN), 6, "pi", "var")


# the EM without its choice of groups and regions
PLAIN = {"structure": "independent", "prefit": 3, "min_group_size": 1, "min_var": 1, "min_gene": 0, "min_p_single": 0.0}

FITTED = PIP.replace(f"({PRIOR})", "prior")


@query(
    "region_pip_fitted",
    f"""WITH RECURSIVE {EM}, {FITTED}, s AS (SELECT dataset, region_id, sum(CASE WHEN grp <> 'SNP' THEN pip ELSE 0 END) AS g FROM c GROUP BY ALL)
        SELECT c.dataset, c.region_id, c.grp, c.id, round(c.pip, 6) AS pip, bef < 0.95 AS cs, round(s.g, 6) AS nonSNP_PIP FROM c JOIN s ON c.dataset = s.dataset AND c.region_id = s.region_id WHERE s.g >= 0.5""",
)
def _(t):
    """Regions of a molecular signal, by the priors that the EM finds."""
    z = _region_z(t)
    pips = finemap.region_pip(z, _prior(t, z), region=RG).select("dataset", "region_id", "grp", "id", "pip", "cs")
    return rnd(finemap.screen_regions(pips, region=RG), 6, "pip", "nonSNP_PIP")


@query(
    "gene_annotate",
    """SELECT q.CELL, q.GENEID, q.SNPID, g.GENENAME, g.Chromosome AS gene_chrom, CAST(floor((g.Start + g.End_) / 2.0) AS BIGINT) AS gene_pos
       FROM (SELECT CELL, GENEID, SNPID FROM {qtl_new}) q LEFT JOIN {genes} g ON q.GENEID = g.GENEID""",
)
def _(t):
    return finemap.gene_annotate(t.qtl_new.select("CELL", "GENEID", "SNPID"), t.genes)


@query(
    "ld_long_extract",
    f"""WITH r AS ({LDR}), k AS (SELECT DISTINCT SNPID AS v, GENEID AS gene FROM {{qtl}})
        SELECT a.gene, r.id1, r.id2, r.r FROM r JOIN k a ON r.id1 = a.v JOIN k b ON r.id2 = b.v AND a.gene = b.gene""",
)
def _(t):
    k = t.qtl.select(F.col("SNPID").alias("varID"), F.col("GENEID").alias("gene"))
    return finemap.ld_long_extract(t.sql(LDR), k, k)


QW = """w AS (SELECT q.GENEID AS gene, q.SNPID AS varID, max(q.BETA) AS weight FROM {qtl} q JOIN {genes} g ON q.GENEID = g.GENEID WHERE g.gene_type = 'protein_coding' GROUP BY q.GENEID, q.SNPID)"""


@query(
    "weights_from_qtl",
    f"WITH {QW} SELECT gene, varID, weight FROM w",
)
def _(t):
    return _weights(t)[0]


@query("weights_from_qtl_genes", f"WITH {QW} SELECT w.gene, g.GENENAME AS genename, g.gene_type, count(*) AS n_snps FROM w JOIN {{genes}} g ON w.gene = g.GENEID GROUP BY ALL")
def _(t):
    return _weights(t)[1]


@query("weights_from_qtl_covariances", f"WITH {QW}, r AS ({LDR}) SELECT a.gene, r.id1, r.id2, r.r FROM r JOIN w a ON r.id1 = a.varID JOIN w b ON r.id2 = b.varID AND a.gene = b.gene")
def _(t):
    return _weights(t)[2]


def _weights(t):
    """Weights, genes and covariances of the genes that code for proteins."""
    w = t.qtl.groupBy(F.col("GENEID").alias("gene"), F.col("SNPID").alias("varID")).agg(F.max("BETA").alias("weight"))
    g = t.genes.filter("gene_type = 'protein_coding'").select(F.col("GENEID").alias("gene"), F.col("GENENAME").alias("genename"), "gene_type")
    return finemap.weights_from_qtl(w, g, t.sql(LDR))


SHARE = "SELECT l_returnflag AS group_label, 'c' || CAST(l_linenumber AS VARCHAR(2)) AS category, sum(l_quantity) AS pve FROM {lineitem} GROUP BY l_returnflag, l_linenumber"


@query(
    "heritability_share",
    f"""WITH s AS ({SHARE}), t AS (SELECT *, pve / sum(pve) OVER (PARTITION BY group_label) AS f FROM s)
        SELECT group_label, category, round(f, 6) AS percentage, CAST(CAST(round(f * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS percentage_label FROM t""",
)
def _(t):
    return rnd(finemap.heritability_share(t.sql(SHARE)), 6, "percentage")


PARAMS = """SELECT l_returnflag || l_linestatus AS group_label, CASE l_linenumber WHEN 1 THEN 'SNP' WHEN 2 THEN NULL ELSE 'tissue' END AS name,
             CASE WHEN l_linenumber IN (1, 3) THEN round(avg(l_tax), 6) END AS group_prior, CASE WHEN l_linenumber IN (1, 3) THEN round(avg(l_discount), 6) END AS group_pve,
             CASE WHEN l_linenumber = 2 THEN round(avg(l_tax) * 3, 6) END AS total_pve FROM {lineitem} WHERE l_linenumber <= 3 GROUP BY l_returnflag, l_linestatus, l_linenumber"""


@query(
    "param_long_wide",
    f"""WITH p AS ({PARAMS}), l AS (
          SELECT group_label, name, 'group_prior' AS category, group_prior AS score FROM p WHERE name IS NOT NULL UNION ALL
          SELECT group_label, name, 'group_pve', group_pve FROM p WHERE name IS NOT NULL UNION ALL
          SELECT group_label, 'SNP', 'total_pve', total_pve FROM p WHERE total_pve IS NOT NULL),
        b AS (SELECT CASE WHEN name = 'SNP' THEN 'SNP_' || group_label ELSE 'gene_' || group_label END AS label, category, score FROM l)
        SELECT label, max(CASE WHEN category = 'group_prior' THEN score END) AS group_prior, max(CASE WHEN category = 'group_pve' THEN score END) AS group_pve,
               max(CASE WHEN category = 'total_pve' THEN score END) AS total_pve FROM b GROUP BY label""",
)
def _(t):
    return finemap.param_long_wide(t.sql(PARAMS), ["group_prior", "group_pve", "total_pve"])

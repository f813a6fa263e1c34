"""Queries over heritability: scores, regressions, and the tables and reports made of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from varloom.functions.scalars import upper_quantile_sql
from varloom.operators import heritability, ld, reports
from varloom.plans.checks_loci import CELLS
from varloom.plans.checks_traits import rnd
from varloom.plans.registry import query
from varloom.sources.sinks import release, settle


def rounded(df, digits: dict[str, int]):
    for c, d in digits.items():
        df = rnd(df, d, c)
    return df


# --- inputs ------------------------------------------------------------------

MUNGE = f"""SELECT dataset, SNP, A1, A2, 5000.0D AS N, CASE WHEN BETA = 0 THEN 0.0D ELSE sign(BETA) * {upper_quantile_sql('(P / 2)')} END AS Z
     FROM (SELECT dataset, RSID AS SNP, EA AS A1, NEA AS A2, P, BETA, row_number() OVER (PARTITION BY dataset, RSID ORDER BY P, EA, BETA) AS rn FROM {{sumstats}}
           WHERE P > 0 AND P <= 1 AND NEA || EA NOT IN ('AT', 'TA', 'CG', 'GC') AND least(AF, 1 - AF) > 0.01) q WHERE rn = 1"""


def _munged(t, sumstats=None):
    return heritability.munge(t.sumstats if sumstats is None else sumstats, n=5000.0)


@query("munge", f"SELECT dataset, SNP, A1, A2, N, round(Z, 6) AS Z FROM ({MUNGE}) q")
def _(t):
    return rnd(_munged(t), 6, "Z")


MESC = """SELECT q.GENEID AS GENE, CAST(floor((g.Start + g.End_) / 2.0) AS BIGINT) AS GENE_COORD, coalesce(p.RSID, q.SNPID) AS SNP, CAST(q.Chromosome AS INT) AS CHR,
           CAST(split_part(q.SNPID, ':', 2) AS BIGINT) AS SNP_COORD, 91.0D AS N, round(q.BETA / q.SE, 6) AS Z
          FROM {qtl_new} q JOIN {genes} g ON q.GENEID = g.GENEID LEFT JOIN {panel} p ON q.SNPID = p.SNPID"""


def _mesc(t):
    q = t.qtl_new.withColumn("Z", F.round(F.col("BETA") / F.col("SE"), 6))
    return heritability.prepare_expression_input(q, t.genes, t.panel, 91)


@query("prepare_expression_input", MESC)
def _(t):
    return rnd(_mesc(t), 6, "Z")


@query("mesc_sort", f"SELECT * FROM ({MESC}) q ORDER BY GENE_COORD, GENE, SNP_COORD")
def _(t):
    return heritability.mesc_sort(rnd(_mesc(t), 6, "Z"))


# --- scores ------------------------------------------------------------------

# annotations of all variants; `regress` marks those that regressions use
ANNOT = """SELECT SNPID AS LD, 'base' AS label, 1 AS value FROM {panel} UNION ALL SELECT SNPID, 'ref' || REF, 1 FROM {panel} WHERE REF IN ('A', 'C')
  UNION ALL SELECT SNPID, 'even', 1 FROM {panel} WHERE CAST(floor(Position / 20000.0) AS BIGINT) % 2 = 0
  UNION ALL SELECT SNPID, 'regress', 1 FROM {panel} WHERE REF || ALT NOT IN ('AT', 'TA', 'CG', 'GC')"""
LABELS = ["base", "refA", "refC", "even", "regress"]
MODELS = {x: ["base", x] for x in ("refA", "refC", "even")}
BINS, BLOCKS = 5, 200

GENMAP = """mp AS (SELECT Chromosome, Position AS p0, cM AS c0, lead(Position) OVER (PARTITION BY Chromosome ORDER BY Position) AS p1, lead(cM) OVER (PARTITION BY Chromosome ORDER BY Position) AS c1 FROM {genetic_map}),
   cmv AS (SELECT v.SNPID, v.Chromosome, v.Position, m.c0 + coalesce((v.at - m.p0) * (m.c1 - m.c0) / (m.p1 - m.p0), 0.0D) AS cM
           FROM (SELECT p.*, least(greatest(p.Position, e.lo), e.hi) AS at FROM {panel} p
                 JOIN (SELECT Chromosome, min(Position) AS lo, max(Position) AS hi FROM {genetic_map} GROUP BY Chromosome) e ON p.Chromosome = e.Chromosome) v
           JOIN mp m ON v.Chromosome = m.Chromosome AND v.at >= m.p0 AND (m.p1 IS NULL OR v.at < m.p1))"""
CMLD = f"""{GENMAP}, gen AS (SELECT g.SNPID, g.donor, g.dosage, c.Chromosome, c.cM FROM {{genotypes}} g JOIN cmv c ON g.SNPID = c.SNPID WHERE g.population = 'EUR' AND g.dosage IS NOT NULL),
   freq AS (SELECT SNPID, sum(dosage) / (2.0D * count(*)) AS AF FROM gen GROUP BY SNPID),
   pr AS (SELECT a.SNPID AS Lead, b.SNPID AS LD, corr(a.dosage, b.dosage) AS r, CAST(count(*) AS DOUBLE) AS n
          FROM gen a JOIN gen b ON a.donor = b.donor AND a.Chromosome = b.Chromosome AND abs(a.cM - b.cM) <= 1 GROUP BY a.SNPID, b.SNPID),
   r2 AS (SELECT Lead, LD, r * r AS r2, n FROM pr WHERE r IS NOT NULL AND NOT isnan(r))"""
LDSCORE = f"""ann AS ({ANNOT}), lsc AS (SELECT r.Lead, {', '.join(f"sum(CASE WHEN a.label = '{x}' THEN r.r2 - (1 - r.r2) / (r.n - 2) ELSE 0 END) AS l2_{x}" for x in LABELS)}
          FROM r2 r JOIN ann a ON r.LD = a.LD WHERE r.n > 2 GROUP BY r.Lead)"""


def _packed(t):
    return settle(ld.genetic_position(ld.pack_variants(t.genotypes, "EUR"), t.genetic_map))


def _ldscore(t, packed):
    return ld.windowed_scores(packed, t.sql(ANNOT), LABELS)


@query("genetic_position", f"WITH {GENMAP} SELECT SNPID, round(cM, 9) AS cM FROM cmv")
def _(t):
    return rnd(ld.genetic_position(t.panel, t.genetic_map), 9, "cM").select("SNPID", "cM")


@query("ld_score", f"WITH {CMLD}, {LDSCORE} SELECT Lead, {', '.join(f'round(l2_{x}, 6) AS l2_{x}' for x in LABELS)} FROM lsc")
def _(t):
    return rnd(_ldscore(t, _packed(t)), 6, *[f"l2_{x}" for x in LABELS])


COUNTS = f"""cnt AS (SELECT count(*) AS m_total, {', '.join(f"sum(CASE WHEN label_{x} THEN 1 ELSE 0 END) AS m_{x}" for x in LABELS)},
          {', '.join(f"sum(CASE WHEN label_base AND label_{x} THEN 1 ELSE 0 END) AS o_{x}" for x in MODELS)}
        FROM (SELECT f.SNPID, {', '.join(f"coalesce(bool_or(a.label = '{x}'), false) AS label_{x}" for x in LABELS)}
              FROM freq f LEFT JOIN ann a ON f.SNPID = a.LD WHERE f.AF > 0.05 AND f.AF < 1 - 0.05 GROUP BY f.SNPID) q)"""


@query(
    "annotation_counts",
    f"""WITH {CMLD}, ann AS ({ANNOT}), {COUNTS} {' UNION ALL '.join(
        f"SELECT '{x}' AS model, CAST(m_total AS DOUBLE) AS M_total, CAST(m_base AS DOUBLE) AS M_base, CAST(m_{x} AS DOUBLE) AS M_own, CAST(o_{x} AS DOUBLE) AS both FROM cnt" for x in MODELS)}""",
)
def _(t):
    out = heritability.annotation_counts(_packed(t), t.sql(ANNOT), MODELS)
    return out.select("model", "M_total", F.get("M", 0).alias("M_base"), F.get("M", 1).alias("M_own"), F.get(F.get("overlap", 0), 1).alias("both"))


def regression_sql(rows: str, keys: list[str], k: int) -> str:
    """CTEs from weighted rows (keys, block, wt, y, x1...) to `fit` (keys, block, c0...), block -1 for all rows.

    One elimination step a CTE on the block sums; x0 is 1.
    """
    x = ["1.0D", *[f"x{i}" for i in range(1, k)]]
    cells = [(i, j) for i in range(k) for j in range(k + 1)]
    by = ", ".join(keys)
    sums = ", ".join(f"sum(wt * {x[i]} * {'y' if j == k else x[j]}) AS m{i}_{j}" for i, j in cells)
    whole = ", ".join(f"sum(m{i}_{j}) AS m{i}_{j}" for i, j in cells)
    left = ", ".join(f"sum(m{i}_{j}) OVER (PARTITION BY {by}) - m{i}_{j} AS m{i}_{j}" for i, j in cells)
    out = [f"bs AS (SELECT {by}, block, avg(an) AS an, {sums} FROM {rows} GROUP BY {by}, block)",
           f"e0 AS (SELECT {by}, -1 AS block, avg(an) AS an, {whole} FROM bs GROUP BY {by} UNION ALL SELECT {by}, block, an, {left} FROM bs)"]
    for p in range(k):
        def cell(i, j):
            scaled = f"(m{p}_{j} / nullif(m{p}_{p}, 0))"
            return scaled if i == p else f"m{i}_{j} - m{i}_{p} * {scaled}"
        out.append(f"e{p + 1} AS (SELECT {by}, block, an, {', '.join(f'{cell(i, j)} AS m{i}_{j}' for i, j in cells)} FROM e{p})")
    coefs = ", ".join(f"m{i}_{k} / {'an' if i else '1.0D'} AS c{i}" for i in range(k))
    return ", ".join([*out, f"fit AS (SELECT {by}, block, {coefs} FROM e{k})"])


def weighted_sql(rows: str, keys: list[str], k: int, m: str, extra: str = "") -> str:
    """CTE `wr`: rows (keys, SNP, Chromosome, Position, Z, N, s1..., w) with block, weight and scaled scores."""
    by, l2 = ", ".join(keys), " + ".join(f"s{i}" for i in range(1, k))
    on = " AND ".join(f"q.{c} = z.{c}" for c in keys)
    return f"""zr AS (SELECT *, Z * Z AS chi2, {l2} AS l2 FROM {rows}),
      zl AS (SELECT q.* FROM zr q JOIN (SELECT {by}, greatest(0.001D * max(N), 80.0D) AS lim FROM zr GROUP BY {by}) z ON {on} WHERE q.chi2 < z.lim),
      zt AS (SELECT {by}, count(*) AS cnt, avg(chi2) AS chi, avg(l2 * N) AS aln, avg(N) AS an FROM zl GROUP BY {by} HAVING count(*) >= {BLOCKS} AND count(*) > {k}),
      zw AS (SELECT q.*, z.an, 1.0D + q.N * greatest(0.0D, least(1.0D, (z.chi - 1) * {m} / z.aln)) * greatest(q.l2, 1.0D) / {m} AS het,
              CAST(floor((row_number() OVER (PARTITION BY {', '.join('q.' + c for c in keys)} ORDER BY CAST(q.Chromosome AS INT), q.Position, q.SNP) - 1) * {BLOCKS} / z.cnt) AS INT) AS block
             FROM zl q JOIN zt z ON {on}),
      wr AS (SELECT *, 1.0D / (greatest(w, 1.0D) * het * het) AS wt, chi2 AS y, {', '.join(f's{i} * N / an AS x{i}' for i in range(1, k))} FROM zw)"""


def jack_sql(values: dict[str, str], keys: list[str], src: str = "vals") -> str:
    """Estimate and error columns e_<name>, s_<name> of expressions over the rows of `fit` and what is joined to it."""
    inner = ", ".join(f"{v} AS {n}" for n, v in values.items())
    per = ", ".join(
        f"max(CASE WHEN block = -1 THEN {n} END) AS e_{n}, ({BLOCKS} - 1) * stddev_samp(CASE WHEN block >= 0 THEN {n} END) / sqrt({BLOCKS}.0D) AS s_{n}" for n in values
    )
    return f"vals AS (SELECT {', '.join(keys)}, block, {inner} FROM {src}), jk AS (SELECT {', '.join(keys)}, {per} FROM vals GROUP BY {', '.join(keys)})"


# Student's t with an even number of degrees of freedom: terms of the finite series in cos(theta)^2
T_TERMS = ", ".join(f"{math.prod((2 * j - 1) / (2 * j) for j in range(1, i + 1))!r}D" for i in range(BLOCKS // 2))


def t_sql(z: str) -> str:
    theta = f"atan(abs({z}) / sqrt({BLOCKS}.0D))"
    series = f"list_sum(list_transform([{T_TERMS}], lambda t, i: t * power(cos({theta}), 2 * (i - 1))))"
    return f"(1.0D - sin({theta}) * {series})"


# --- heritability by annotation ----------------------------------------------

KEYS = ["dataset", "model"]


def _z_rows(t, scores, sumstats=None):
    """Munged rows with their place and the scores of the variant.

    Tables with a row a variant are dealt: the panel is many times the bytes of the file it is made of.
    """
    place = t.panel.select(F.col("RSID").alias("SNP"), "Chromosome", "Position", F.col("SNPID").alias("Lead"))
    munged = _munged(t, t.dealt("sumstats") if sumstats is None else sumstats)
    return munged.join(place.hint("merge"), "SNP").join(scores.hint("merge"), "Lead")


def _h2_parts(t):
    """Partitioned heritability of base and one annotation, per study and annotation."""
    packed = _packed(t)
    counts = settle(heritability.annotation_counts(packed, t.sql(ANNOT), MODELS))
    own = F.inline(F.array(*[F.struct(F.lit(x).alias("model"), F.col(f"l2_{x}").alias("own")) for x in MODELS]))
    scores = _ldscore(t, packed).select("Lead", F.col("l2_base").alias("base"), F.col("l2_regress").alias("w"), own)
    size = counts.select(F.col("model").alias("_k"), (F.get("M", 0) + F.get("M", 1)).alias("m_sum"))
    rows = _z_rows(t, scores).join(size, F.col("model") == F.col("_k"))
    coef = heritability.coefficients(rows, ["base", "own"], KEYS, BLOCKS, F.col("m_sum"), "w", chi_limit=True)
    return heritability.partitioned_h2(settle(coef), counts, ["base", "own"], KEYS)


Z_SQL = f"""mg AS ({MUNGE}), z AS (SELECT m.dataset, m.SNP, m.Z, 5000.0D AS N, p.Chromosome, p.Position, p.SNPID AS Lead FROM mg m JOIN {{panel}} p ON m.SNP = p.RSID)"""
H2_ROWS = " UNION ALL ".join(
    f"SELECT z.dataset, '{x}' AS model, z.SNP, z.Chromosome, z.Position, z.Z, z.N, l.l2_base AS s1, l.l2_{x} AS s2, l.l2_regress AS w, c.m_base AS mb, c.m_{x} AS mo, c.o_{x} AS ob, c.m_total AS mt FROM z JOIN lsc l ON z.Lead = l.Lead, cnt c"
    for x in MODELS
)
H2_FIT = f"""{CMLD}, {LDSCORE}, {COUNTS}, {Z_SQL}, hr AS MATERIALIZED ({H2_ROWS}), {weighted_sql('hr', KEYS, 3, '(mb + mo)')}, {regression_sql('wr', KEYS, 3)},
   src AS (SELECT f.*, k.mb, k.mo, k.ob, k.mt, c1 * k.mb + c2 * k.mo AS h2 FROM fit f JOIN (SELECT DISTINCT model, mb, mo, ob, mt FROM hr) k ON f.model = k.model)"""
H2_VALUES = {
    "h2": "h2", "icpt": "c0",
    "bshare": "(c1 * mb + c2 * ob) / h2", "btau": "c1", "bgap": "CASE WHEN mt = mb THEN 0.0D ELSE (c1 * mb + c2 * ob) / mb - c2 * (mo - ob) / (mt - mb) END",
    "oshare": "(c1 * ob + c2 * mo) / h2", "otau": "c2", "ogap": "(c1 * ob + c2 * mo) / mo - c1 * (mb - ob) / (mt - mo)",
}
H2_ALL = f"""{H2_FIT}, {jack_sql(H2_VALUES, KEYS, 'src')},
   res AS (SELECT j.dataset, j.model, 'base' AS Category_, k.mb / k.mt AS Prop_SNPs, e_bshare AS Prop_h2, s_bshare AS Prop_h2_SE, e_bgap AS gap, s_bgap AS gap_se, e_btau AS tau, s_btau AS tau_se, CAST(NULL AS DOUBLE) AS est, CAST(NULL AS DOUBLE) AS se
             FROM jk j JOIN (SELECT DISTINCT model, mb, mo, mt FROM hr) k ON j.model = k.model
           UNION ALL SELECT j.dataset, j.model, 'own', k.mo / k.mt, e_oshare, s_oshare, e_ogap, s_ogap, e_otau, s_otau, NULL, NULL FROM jk j JOIN (SELECT DISTINCT model, mb, mo, mt FROM hr) k ON j.model = k.model
           UNION ALL SELECT dataset, model, 'h2', NULL, NULL, NULL, NULL, NULL, NULL, NULL, e_h2, s_h2 FROM jk
           UNION ALL SELECT dataset, model, 'intercept', NULL, NULL, NULL, NULL, NULL, NULL, NULL, e_icpt, s_icpt FROM jk),
   parts AS (SELECT dataset, model, Category_ AS Category, Prop_SNPs, Prop_h2, Prop_h2_SE, Prop_h2 / Prop_SNPs AS Enrichment, Prop_h2_SE / Prop_SNPs AS Enrichment_SE,
              CASE WHEN gap_se > 0 THEN {t_sql('(gap / gap_se)')} END AS Enrichment_p, tau AS Coefficient, tau_se AS Coefficient_SE, tau / tau_se AS Coefficient_z, est AS Estimate, se AS SE FROM res)"""
H2_COLS = {
    "Prop_SNPs": 6, "Prop_h2": 6, "Prop_h2_SE": 6, "Enrichment": 6, "Enrichment_SE": 6, "Enrichment_p": 6,
    "Coefficient": 9, "Coefficient_SE": 9, "Coefficient_z": 6, "Estimate": 6, "SE": 6,
}


@query("h2_regression", f"WITH {H2_ALL} SELECT dataset, model, Category, {', '.join(f'round({c}, {d}) AS {c}' for c, d in H2_COLS.items())} FROM parts")
def _(t):
    return rounded(_h2_parts(t), H2_COLS)


STUDIES = [f"GCST{i}" for i in range(1, 8)]


@query(
    "enrichment_matrix",
    f"""WITH {H2_ALL} SELECT model AS category, {', '.join(
        f"round(max(CASE WHEN dataset = '{d}' THEN Enrichment END), 6) AS {d}_enrichment, round(max(CASE WHEN dataset = '{d}' THEN -log10(Enrichment_p) END), 6) AS {d}_log10p" for d in STUDIES)}
        FROM parts WHERE Category = 'own' GROUP BY model""",
)
def _(t):
    own = _h2_parts(t).withColumn("is_own", F.col("Category") == "own")
    out = heritability.enrichment_matrix(own, STUDIES, row="model")
    return rnd(out, 6, *[f"{d}_{c}" for d in STUDIES for c in ("enrichment", "log10p")]).withColumnRenamed("model", "category")


# --- expression scores and mediated heritability -------------------------------

BINNED = f"""gb AS (SELECT CELL, Chromosome, GENEID, sum(BETA * BETA) AS h2cis, ntile({BINS}) OVER (PARTITION BY CELL, Chromosome ORDER BY round(sum(BETA * BETA), 9), GENEID) AS bin
   FROM {{qtl}} GROUP BY CELL, Chromosome, GENEID)"""
EFFECTS = f"""{BINNED}, eff AS (SELECT q.CELL, q.SNPID AS LD, g.bin, sum(q.BETA * q.BETA) AS b2
   FROM {{qtl}} q JOIN gb g ON q.CELL = g.CELL AND q.Chromosome = g.Chromosome AND q.GENEID = g.GENEID GROUP BY q.CELL, q.SNPID, g.bin)"""
ESCORE = f"""{EFFECTS}, es AS (SELECT r.Lead, e.CELL, e.bin, sum(e.b2 * r.r2) AS score FROM r2 r JOIN eff e ON r.LD = e.LD GROUP BY r.Lead, e.CELL, e.bin)"""
CELL_LIST = ", ".join(f"'{c}'" for c in CELLS)


def _qtl(t):
    """What bins and scores read of the QTLs, written once."""
    out = settle(t.dealt("qtl").select("CELL", "Chromosome", "GENEID", "SNPID", "BETA"))
    release(t.spark)
    return out


@query("gene_bins", f"WITH {BINNED} SELECT CELL, Chromosome, GENEID, round(h2cis, 9) AS h2cis, CAST(bin AS INT) AS bin FROM gb")
def _(t):
    return rnd(heritability.gene_bins(t.qtl, BINS), 9, "h2cis").select("CELL", "Chromosome", "GENEID", "h2cis", "bin")


@query("gene_counts", f"WITH {BINNED} SELECT CELL, Chromosome, CAST(bin AS INT) AS bin, count(*) AS G, round(avg(h2cis), 9) AS ave_h2cis FROM gb GROUP BY CELL, Chromosome, bin")
def _(t):
    return rnd(heritability.gene_counts(heritability.gene_bins(t.qtl, BINS)), 9, "ave_h2cis")


@query(
    "expression_score",
    f"""WITH {CMLD}, {ESCORE} SELECT l.Lead, c.CELL, CAST(b.bin AS INT) AS bin, round(coalesce(es.score, 0.0D), 6) AS score
        FROM (SELECT DISTINCT Lead FROM r2) l CROSS JOIN (SELECT unnest([{CELL_LIST}]) AS CELL) c CROSS JOIN (SELECT unnest(range(1, {BINS + 1})) AS bin) b
        LEFT JOIN es ON es.Lead = l.Lead AND es.CELL = c.CELL AND es.bin = b.bin""",
)
def _(t):
    out = heritability.expression_score(_qtl(t), _packed(t), CELLS, BINS)
    out = out.select("Lead", "CELL", F.posexplode("scores").alias("bin", "score")).withColumn("bin", F.col("bin") + 1)
    return rnd(out, 6, "score")


MED_KEYS = ["disease", "dataset", "CELL"]


def _mediated(t):
    """h2med, h2nonmed and h2 per study and cell type, from a joint regression."""
    packed = _packed(t)
    model = {"base": ["base"]}
    m = float(heritability.annotation_counts(packed, t.sql(ANNOT), model).first()["M"][0])
    ld_part = _ldscore(t, packed).select("Lead", "l2_base", F.col("l2_regress").alias("w"))
    qtl = _qtl(t)
    own = settle(heritability.expression_sets(qtl, packed, CELLS, BINS))
    release(t.spark)
    sumstats = settle(t.dealt("sumstats"))
    release(t.spark)
    studies = settle(sumstats.select("dataset", "disease").distinct())
    rows = _z_rows(t, ld_part, sumstats).join(studies, "dataset")
    coef = heritability.joint_coefficients(rows, ["l2_base"], own, CELLS, BINS, MED_KEYS[:2], BLOCKS, m, "w", chi_limit=True)
    binned = heritability.gene_bins(qtl, BINS)
    per = binned.groupBy("CELL", "bin").agg(F.sum("h2cis").alias("h"))
    cis = per.groupBy("CELL").agg(*[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("h"))), F.lit(0.0)).alias(f"h{b}") for b in range(1, BINS + 1)])
    cis = cis.select("CELL", F.array(*[F.col(f"h{b}") for b in range(1, BINS + 1)]).alias("H"))
    return heritability.mediated_h2(settle(coef), [m], cis, MED_KEYS)


K_MED = BINS + 2
MED_ROWS = f"""SELECT d.disease, z.dataset, c.CELL, z.SNP, z.Chromosome, z.Position, z.Z, z.N, l.l2_base AS s1,
   {', '.join(f'coalesce(w.s{b}, 0.0D) AS s{b + 1}' for b in range(1, BINS + 1))}, l.l2_regress AS w, cnt.m_base AS mb
   FROM z JOIN (SELECT DISTINCT dataset, disease FROM {{sumstats}}) d ON z.dataset = d.dataset JOIN lsc l ON z.Lead = l.Lead CROSS JOIN (SELECT unnest([{CELL_LIST}]) AS CELL) c
   LEFT JOIN (SELECT Lead, CELL, {', '.join(f'sum(CASE WHEN bin = {b} THEN score END) AS s{b}' for b in range(1, BINS + 1))} FROM es GROUP BY Lead, CELL) w ON w.Lead = z.Lead AND w.CELL = c.CELL, cnt"""
MED_VALUES = {"med": "med", "non": "non", "tot": "med + non", "medr": "med / (med + non)", "nonr": "non / (med + non)", "totr": "(med + non) / (med + non)"}
MED_ALL = f"""{CMLD}, {LDSCORE}, {COUNTS}, {ESCORE}, {Z_SQL}, hr AS MATERIALIZED ({MED_ROWS}), {weighted_sql('hr', MED_KEYS, K_MED, 'mb')}, {regression_sql('wr', MED_KEYS, K_MED)},
   hc AS (SELECT CELL, {', '.join(f'coalesce(sum(CASE WHEN bin = {b} THEN h2cis END), 0.0D) AS h{b}' for b in range(1, BINS + 1))} FROM gb GROUP BY CELL),
   src AS (SELECT f.*, {' + '.join(f'c{b + 1} * h.h{b}' for b in range(1, BINS + 1))} AS med, c1 * cnt.m_base AS non FROM fit f JOIN hc h ON f.CELL = h.CELL, cnt),
   {jack_sql(MED_VALUES, MED_KEYS, 'src')},
   med AS ({' UNION ALL '.join(f"SELECT disease, dataset, CELL, '{q}' AS Quantity, e_{n} AS Estimate, s_{n} AS SE_Estimate, e_{n}r AS Estimate_over_h2, s_{n}r AS SE_over_h2 FROM jk WHERE e_tot IS NOT NULL" for q, n in (('h2med', 'med'), ('h2nonmed', 'non'), ('h2', 'tot')))})"""
MED_COLS = {"Estimate": 6, "SE_Estimate": 6, "Estimate_over_h2": 3, "SE_over_h2": 3}


@query("h2med", f"WITH {MED_ALL} SELECT disease, dataset, CELL, Quantity, {', '.join(f'round({c}, {d}) AS {c}' for c, d in MED_COLS.items())} FROM med")
def _(t):
    return rounded(_mediated(t), MED_COLS)


HTAB = """ht AS (SELECT disease, dataset, CELL, max(CASE WHEN Quantity = 'h2' THEN Estimate END) AS h2, max(CASE WHEN Quantity = 'h2' THEN SE_Estimate END) AS h2_SE,
   max(CASE WHEN Quantity = 'h2med' THEN Estimate END) AS h2med, max(CASE WHEN Quantity = 'h2med' THEN SE_Estimate END) AS h2med_SE,
   max(CASE WHEN Quantity = 'h2med' THEN Estimate_over_h2 END) AS h2med_h2, max(CASE WHEN Quantity = 'h2med' THEN SE_over_h2 END) AS h2med_h2_SE FROM med GROUP BY disease, dataset, CELL)"""
HTAB_COLS = {"h2": 6, "h2_SE": 6, "h2med": 6, "h2med_SE": 6, "h2med_h2": 3, "h2med_h2_SE": 3}


@query("heritability_table", f"WITH {MED_ALL}, {HTAB} SELECT disease, dataset, CELL, {', '.join(f'round({c}, {d}) AS {c}' for c, d in HTAB_COLS.items())} FROM ht")
def _(t):
    return rounded(heritability.heritability_table(_mediated(t)), HTAB_COLS)


@query(
    "report_heritability",
    f"""WITH {MED_ALL}, {HTAB} SELECT h.disease, h.dataset, h.CELL, {', '.join(f'round(h.{c}, {d}) AS {c}' for c, d in HTAB_COLS.items())}, split_part(h.CELL, '_', 1) AS Cell_name, split_part(h.CELL, '_', 2) AS Cluster, o.cell_order
        FROM ht h LEFT JOIN {{cell_types}} o ON h.CELL = o.sample_name""",
)
def _(t):
    return rounded(reports.report_heritability(heritability.heritability_table(_mediated(t)), t.cell_types), HTAB_COLS)

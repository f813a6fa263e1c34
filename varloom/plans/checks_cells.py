"""Queries over cells, expression, signatures and clones."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions.frames import first_by
from varloom.operators import cells, clones, expression, reports, signatures
from varloom.plans.checks_loci import CELLS
from varloom.plans.checks_traits import HITS, _hits, _t1, rnd
from varloom.plans.registry import query
from varloom.sources import readers

CL = ["1", "2", "3", "4", "5"]
TAGS = ["click", "error", "purchase", "signup", "view"]


def q(c: str) -> str:
    return '"' + c + '"'


# --- annotation --------------------------------------------------------------

LANES = """SELECT DISTINCT CAST(o_custkey % 6 + 1 AS INT) AS lane, 'B' || CAST(o_custkey % 6 % 3 AS VARCHAR(2)) AS chrom_batch,
            CAST(o_custkey % 6 % 2 AS VARCHAR(2)) || ';19' AS seq_batch,
            'Hu;' || CASE WHEN o_custkey % 6 = 0 THEN 'NA' ELSE 'NKB' END || ';T' || CAST(o_custkey % 6 AS VARCHAR(2)) AS lane_tag FROM {orders}"""


@query(
    "scan_lane_table",
    f"""SELECT lane, chrom_batch, seq_batch, lane_tag, split_part(lane_tag, ';', 1) AS species, nullif(split_part(lane_tag, ';', 2), 'NA') AS cell_type,
               split_part(lane_tag, ';', 3) AS tissue, CAST(NULL AS VARCHAR) AS extra FROM ({LANES}) q""",
)
def _(t):
    return readers.scan_lane_table(t.sql(LANES), ["species", "cell_type", "tissue", "extra"])


BARCODES = "SELECT o_orderkey AS cell, 'BC' || CAST(o_orderkey AS VARCHAR(14)) || '-' || CAST(o_custkey % 7 + 1 AS VARCHAR(2)) AS barcode, CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'H' || CAST(o_custkey % 4 AS VARCHAR(2)) END AS hashtag FROM {orders}"


@query(
    "annotate_lanes",
    f"""WITH b AS (SELECT *, CAST(split_part(barcode, '-', 2) AS INT) AS lane FROM ({BARCODES}) q)
        SELECT b.cell, b.barcode, b.hashtag, b.lane, l.chrom_batch, l.seq_batch, l.lane_tag, b.hashtag || '-' || l.chrom_batch AS overlay FROM b LEFT JOIN ({LANES}) l ON b.lane = l.lane""",
)
def _(t):
    return cells.annotate_lanes(t.sql(BARCODES), t.sql(LANES))


CLASSES = "SELECT 'BC' || CAST(o_orderkey AS VARCHAR(14)) AS core, CAST(o_custkey % 5 + 1 AS INT) AS lane, CASE WHEN o_totalprice > 200000 THEN 'Doublet' ELSE 'tag' END AS class FROM {orders} WHERE o_orderstatus <> 'P'"


@query(
    "annotate_hashtag",
    f"""WITH b AS (SELECT cell, barcode, split_part(barcode, '-', 1) AS core, CAST(split_part(barcode, '-', 2) AS INT) AS lane FROM ({BARCODES}) q)
        SELECT b.cell, b.barcode, b.lane, c.class AS hashtag FROM b LEFT JOIN ({CLASSES}) c ON b.core = c.core AND b.lane = c.lane""",
)
def _(t):
    return cells.annotate_hashtag(t.sql(BARCODES).select("cell", "barcode"), t.sql(CLASSES))


GENO = "SELECT o_orderkey AS cell, CASE o_custkey % 5 WHEN 0 THEN 'DBL' WHEN 1 THEN 'AMB' ELSE 'DLCP00' || CAST(o_custkey AS VARCHAR(12)) END AS geno_call FROM {orders} WHERE o_totalprice > 50000"
DONORLESS = "SELECT cell, sex, cluster, hashtag, lane, CASE WHEN hashtag IS NULL THEN NULL ELSE donor END AS donor FROM {cells}"


@query(
    "fallback_donor",
    f"""SELECT c.cell, c.donor, g.geno_call, coalesce(c.donor, CASE WHEN g.geno_call NOT IN ('DBL', 'AMB') THEN regexp_replace(g.geno_call, '^DLCP0*', '') END) AS full_donor
        FROM ({DONORLESS}) c LEFT JOIN ({GENO}) g ON c.cell = g.cell""",
)
def _(t):
    return cells.fallback_donor(t.sql(DONORLESS).select("cell", "donor"), t.sql(GENO))


DONORS = "SELECT 'D' || CAST(c_custkey AS VARCHAR(12)) AS donor, c_mktsegment AS smoking, c_nationkey + 20 AS Age FROM {customer} WHERE c_acctbal > 0"


@query(
    "join_donor_meta",
    f"SELECT c.cell, c.donor, d.smoking AS smoking_status, d.Age AS age FROM {{cells}} c LEFT JOIN ({DONORS}) d ON c.donor = d.donor",
)
def _(t):
    return cells.join_donor_meta(t.cells.select("cell", "donor"), t.sql(DONORS), {"smoking": "smoking_status", "Age": "age"})


# --- subsetting --------------------------------------------------------------


@query(
    "cell_qc",
    """WITH s AS (SELECT c.cell, CAST(sum(c.umi) AS BIGINT) AS n_counts, count(*) AS n_feats, round(sum(CASE WHEN f.kind = 'MT' THEN c.umi ELSE 0 END) * 100.0 / sum(c.umi), 6) AS percent_mt
                  FROM {counts} c JOIN {features} f ON c.gene = f.ensembl GROUP BY c.cell)
       SELECT k.cell, k.cluster, n_counts, n_feats, percent_mt FROM {cells} k JOIN s ON k.cell = s.cell
       WHERE n_counts BETWEEN 50 AND 300 AND n_feats BETWEEN 2 AND 9 AND percent_mt <= 10""",
)
def _(t):
    mito = t.features.filter("kind = 'MT'").select(F.col("ensembl").alias("gene"))
    out = cells.cell_qc(t.cells.select("cell", "cluster"), t.counts, mito, 50, 300, 2, 9, 10.0)
    return rnd(out, 6, "percent_mt")


@query(
    "subset_by_criteria",
    "SELECT cell, cluster, hashtag, lane FROM {cells} WHERE cluster IN ('1', '3', '5') AND NOT coalesce(hashtag IN ('Hashtag2'), FALSE) AND NOT coalesce(lane IN (4, 6), FALSE) AND NOT coalesce(lane IN (2), FALSE)",
)
def _(t):
    sheet = t.spark.createDataFrame(
        [("discard", "NA", "Hashtag2", "4;6"), ("keep", "1;3;5", "NA", "NA"), ("discard", None, "NA", "2")], "action string, cluster string, hashtag string, lane string"
    )
    return cells.subset_by_criteria(t.cells.select("cell", "cluster", "hashtag", "lane"), cells.parse_criteria(sheet))


BAD = "SELECT DISTINCT sex AS subset, cluster FROM {cells} WHERE (sex = 'Male' AND cluster = '2') OR (sex = 'Female' AND cluster IN ('4', '5'))"


@query(
    "drop_clusters",
    "SELECT cell, sex AS subset, cluster FROM {cells} WHERE NOT ((sex = 'Male' AND cluster = '2') OR (sex = 'Female' AND cluster IN ('4', '5')))",
)
def _(t):
    return cells.drop_clusters(t.cells.select("cell", F.col("sex").alias("subset"), "cluster"), t.sql(BAD))


@query("merge_clusters", "SELECT cell, CASE WHEN cluster IN ('1', '4') THEN 'a' WHEN cluster = '5' THEN 'b' ELSE cluster END AS cluster FROM {cells}")
def _(t):
    return cells.merge_clusters(t.cells.select("cell", "cluster"), {"a": ["1", "4"], "b": ["5"]})


@query("relabel_rest", "SELECT cell, CASE WHEN hashtag IN ('Hashtag1', 'Hashtag3') THEN 'odd' WHEN hashtag IS NOT NULL THEN 'Rest' END AS hashtag FROM {cells}")
def _(t):
    return cells.relabel_rest(t.cells.select("cell", "hashtag"), "hashtag", ["Hashtag1", "Hashtag3"], "odd")


@query(
    "filter_tags",
    "SELECT cell, donor, sex, cluster, hashtag, lane FROM {cells} WHERE cluster IN ('1', '2') AND sex <> 'Male' AND hashtag IS NOT NULL AND lane > 2",
)
def _(t):
    return cells.filter_tags(t.cells, [("cluster", ["1", "2"], True), ("sex", ["Male"], False)], ("hashtag",), "lane", 2)


GX, GY = "ENSG00000000003", "ENSG00000000007"
XY = f"""xy AS (SELECT c.cell, coalesce(max(CASE WHEN n.gene = '{GX}' THEN n.umi END), 0) AS x, coalesce(max(CASE WHEN n.gene = '{GY}' THEN n.umi END), 0) AS y
         FROM {{cells}} c LEFT JOIN {{counts}} n ON c.cell = n.cell GROUP BY c.cell)"""
CLASS = "CASE WHEN x > 0 AND y > 0 THEN 'DP' WHEN x > 0 THEN 'SP.X' WHEN y > 0 THEN 'SP.Y' ELSE 'DN' END"


def _xy(t):
    return expression.coexpression(t.cells, t.counts, GX, GY)


@query("express_class", f"WITH {XY} SELECT cell, x, y, {CLASS} AS express_class FROM xy")
def _(t):
    return cells.express_class(_xy(t), "x", "y", 0)


@query("class_fractions", f"WITH {XY}, k AS (SELECT {CLASS} AS express_class FROM xy) SELECT express_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS fraction FROM k GROUP BY 1")
def _(t):
    return rnd(cells.class_fractions(cells.express_class(_xy(t), "x", "y", 0)), 9, "fraction")


@query(
    "coexpress_density",
    f"""WITH {XY}, b AS (SELECT *, CAST(least(floor(x / CAST(max(x) OVER () AS DOUBLE) * 20), 19) AS INT) AS bx, CAST(least(floor(y / CAST(max(y) OVER () AS DOUBLE) * 20), 19) AS INT) AS "by" FROM xy)
        SELECT cell, x, y, bx, "by", round(count(*) OVER (PARTITION BY bx, "by") / CAST(count(*) OVER () AS DOUBLE), 9) AS density FROM b""",
)
def _(t):
    return rnd(expression.coexpress_density(_xy(t), bins=20), 9, "density")


# --- composition -------------------------------------------------------------


@query("group_props", "SELECT sex, cluster, count(*) AS n_cells, round(count(*) / sum(count(*)) OVER (PARTITION BY sex), 9) AS share FROM {cells} GROUP BY sex, cluster")
def _(t):
    return rnd(cells.group_props(t.cells, ["sex", "cluster"], ["sex"]), 9, "share")


@query("cell_counts", "SELECT donor, cluster, count(*) AS n_cells FROM {cells} GROUP BY donor, cluster")
def _(t):
    return cells.cell_counts(t.cells, ["donor", "cluster"])


@query(
    "donor_cluster_props",
    f"SELECT donor, {', '.join(f'round(count(*) FILTER (WHERE cluster = {chr(39)}{c}{chr(39)}) / CAST(count(*) AS DOUBLE), 9) AS {q(c)}' for c in CL)} FROM {{cells}} GROUP BY donor",
)
def _(t):
    return rnd(cells.donor_cluster_props(t.cells, CL), 9, *CL)


@query("cluster_share", "SELECT donor, round(avg(CASE WHEN cluster = '3' THEN 1.0D ELSE 0.0D END), 9) AS share FROM {cells} GROUP BY donor")
def _(t):
    return rnd(cells.cluster_share(t.cells, "3"), 9, "share")


PHEN_IN = "SELECT cell, donor, CASE WHEN lane <= 3 THEN 'nk' ELSE 'b' END AS population, cluster FROM {cells}"
SORTER = "SELECT DISTINCT donor, population, CASE WHEN population = 'nk' THEN 12.5D ELSE 40.0D END AS cell_percent FROM (" + PHEN_IN + ") p"
SUBS = [f"{p} {c}" for p in ("B", "NK") for c in CL]
PHEN = f"""ph AS (SELECT donor, upper(population) || ' ' || cluster AS immune_subset, count(*) / CAST(sum(count(*)) OVER (PARTITION BY donor, population) AS DOUBLE)
            * CASE WHEN population = 'nk' THEN 12.5D ELSE 40.0D END / 100 AS v FROM ({PHEN_IN}) q GROUP BY donor, population, cluster)"""


@query(
    "immune_phenotypes",
    f"""WITH {PHEN}, e AS (SELECT max(CASE WHEN v = 0 OR v = 1 THEN 1 ELSE 0 END) AS e FROM ph),
        l AS (SELECT donor, immune_subset, CASE WHEN e = 1 THEN 0.5D + 0.95D * (v - 0.5D) ELSE v END AS v FROM ph, e)
        SELECT donor, immune_subset, round(ln(v / (1 - v)), 6) AS value FROM l""",
)
def _(t):
    return rnd(cells.immune_phenotypes(t.sql(PHEN_IN), t.sql(SORTER), do_logit=True), 6, "value")


@query(
    "phenotype_matrix",
    f"WITH {PHEN} SELECT donor, {', '.join(f'coalesce(round(max(CASE WHEN immune_subset = {chr(39)}{s}{chr(39)} THEN v END), 9), 0.0D) AS {q(s)}' for s in SUBS)} FROM ph GROUP BY donor",
)
def _(t):
    return rnd(cells.phenotype_matrix(cells.immune_phenotypes(t.sql(PHEN_IN), t.sql(SORTER)), SUBS), 9, *SUBS)


@query(
    "low_donor_report",
    """WITH n AS (SELECT cluster, donor, count(*) AS k FROM {cells} GROUP BY cluster, donor)
       SELECT cluster, count(*) FILTER (WHERE k <= 140) AS donor_count, nullif(coalesce(string_agg(CASE WHEN k <= 140 THEN donor END, ';' ORDER BY donor), ''), '') AS donors,
              CAST(sum(k) AS BIGINT) AS cluster_size FROM n GROUP BY cluster""",
)
def _(t):
    return cells.low_donor_report(t.cells, 140)


@query(
    "tag_by_cluster",
    """WITH n AS (SELECT donor, cluster, count(*) AS n FROM {cells} GROUP BY donor, cluster), s AS (SELECT donor, sum(n) AS total FROM n GROUP BY donor),
            f AS (SELECT CASE WHEN min(total) / sum(total) > 0.05 THEN min(total) ELSE median(total) END AS f FROM s)
       SELECT n.donor, n.cluster, n.n, round(n.n * (SELECT f FROM f) / s.total, 6) AS scaled, CAST(s.total AS BIGINT) AS total FROM n JOIN s ON n.donor = s.donor""",
)
def _(t):
    return rnd(cells.tag_by_cluster(t.cells, "donor"), 6, "scaled")


@query(
    "pre_post_counts",
    f"""WITH b AS (SELECT coalesce(donor, 'Unassigned') AS donor, cluster, lane FROM ({DONORLESS}) q),
        pre AS (SELECT donor, count(*) AS pre FROM b GROUP BY donor)
        SELECT b.donor, max(pre.pre) AS pre, count(*) AS post, {', '.join(f'count(*) FILTER (WHERE cluster = {chr(39)}{c}{chr(39)}) AS {q(c)}' for c in CL)}
        FROM b JOIN pre ON b.donor = pre.donor WHERE lane <> 2 GROUP BY b.donor""",
)
def _(t):
    base = t.sql(DONORLESS)
    return cells.pre_post_counts(base, base.filter("lane <> 2"), CL)


BATCHES = "SELECT o_orderkey, substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7) AS day, CAST(o_custkey % 12 AS VARCHAR(3)) || ';' || CAST(o_custkey % 7 + 30 AS VARCHAR(3)) AS ids FROM {orders}"


@query(
    "harmonise_batches",
    f"""WITH b AS ({BATCHES}), u AS (SELECT DISTINCT unnest(string_split(ids, ';')) AS i FROM b), n AS (SELECT i, row_number() OVER (ORDER BY length(i), i) AS n FROM u),
        d AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM b) q)
        SELECT b.o_orderkey, b.day, b.ids, CASE WHEN d.k <= 26 THEN '' ELSE chr(CAST(64 + (d.k - 1) // 26 AS INT)) END || chr(CAST(65 + (d.k - 1) % 26 AS INT)) AS day_code, CAST(x.n AS VARCHAR) || ';' || CAST(y.n AS VARCHAR) AS ids_code
        FROM b JOIN d ON d.day = b.day JOIN n x ON x.i = split_part(b.ids, ';', 1) JOIN n y ON y.i = split_part(b.ids, ';', 2)""",
)
def _(t):
    return cells.harmonise_batches(t.sql(BATCHES), "day", "ids")


@query(
    "downsample_group",
    "SELECT cell, donor, cluster, hashtag, lane FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5('1:' || cell), cell) AS rn FROM {cells}) q WHERE rn <= 100",
)
def _(t):
    return cells.downsample_group(t.cells.select("cell", "donor", "cluster", "hashtag", "lane"), "cluster", 100)


@query("sample_share", f"SELECT cell, cluster FROM {{cells}} WHERE substr(md5('1:' || cell), 1, 8) < '{int(0.05 * 2**32):08x}'")
def _(t):
    return cells.sample_share(t.cells.select("cell", "cluster"), 0.05)


# --- expression --------------------------------------------------------------

FULL = """sz AS (SELECT cluster, count(*) AS n FROM {cells} GROUP BY cluster),
   su AS (SELECT c.cluster, k.gene, sum(k.umi) AS s, count(*) FILTER (WHERE k.umi > 0) AS p FROM {counts} k JOIN {cells} c ON k.cell = c.cell GROUP BY c.cluster, k.gene),
   fu AS (SELECT z.cluster, g.gene, z.n, coalesce(su.s, 0) AS s, coalesce(su.p, 0) AS p FROM sz z JOIN (SELECT DISTINCT gene FROM su) g ON TRUE LEFT JOIN su ON su.cluster = z.cluster AND su.gene = g.gene)"""


@query("group_stats", f"WITH {FULL} SELECT cluster, gene, round(s / CAST(n AS DOUBLE), 6) AS mean, round(p * 100.0D / n, 6) AS percent FROM fu")
def _(t):
    return rnd(expression.group_stats(t.cells, t.counts), 6, "mean", "percent")


@query(
    "group_stats_scaled",
    f"""WITH {FULL}, m AS (SELECT *, s / CAST(n AS DOUBLE) AS m FROM fu), z AS (SELECT *, (m - avg(m) OVER (PARTITION BY cluster)) / stddev_samp(m) OVER (PARTITION BY cluster) AS z FROM m)
        SELECT cluster, gene, round(least(greatest(z, -1.5D), 1.5D), 6) AS mean, round(p * 100.0D / n, 6) AS percent FROM z""",
)
def _(t):
    return rnd(expression.group_stats(t.cells, t.counts, norm=True, limits=(-1.5, 1.5)), 6, "mean", "percent")


@query("lognormalise", "SELECT cell, gene, umi, round(ln(1 + umi / CAST(sum(umi) OVER (PARTITION BY cell) AS DOUBLE) * 10000), 6) AS value FROM {counts}")
def _(t):
    return rnd(expression.lognormalise(t.counts), 6, "value")


CPM = """v AS (SELECT c.cluster, k.gene, 1e6D * k.umi / sum(k.umi) OVER (PARTITION BY k.cell) AS v FROM {counts} k JOIN {cells} c ON k.cell = c.cell),
   sz AS (SELECT cluster, count(*) AS n FROM {cells} GROUP BY cluster HAVING count(*) >= 10),
   su AS (SELECT cluster, gene, sum(v) AS s, count(*) AS p FROM v GROUP BY cluster, gene),
   fu AS (SELECT z.cluster, g.gene, z.n, coalesce(su.s, 0) AS s, coalesce(su.p, 0) AS p FROM sz z JOIN (SELECT DISTINCT gene FROM su) g ON TRUE LEFT JOIN su ON su.cluster = z.cluster AND su.gene = g.gene),
   st AS (SELECT cluster, gene, s / n AS m, CASE WHEN p = 0 THEN 0 ELSE s / p END AS pm, p / CAST(n AS DOUBLE) AS pr FROM fu)"""
STAT3 = {"mean": "m", "pos_mean": "pm", "prop": "pr"}
CPM_COLS = [f"{s}.{c}" for s in STAT3 for c in CL]


@query(
    "cpm_stats",
    f"""WITH {CPM} SELECT gene, {', '.join(f'round(max(CASE WHEN cluster = {chr(39)}{c}{chr(39)} THEN {STAT3[s]} END), 5) AS {q(s + "." + c)}' for s in STAT3 for c in CL)} FROM st GROUP BY gene""",
)
def _(t):
    out = expression.cpm_stats(t.cells, t.counts, groups=CL)
    return out.select("gene", *[F.round(f"`{c}`", 5).alias(c) for c in CPM_COLS])


@query(
    "gene_mean_per_donor",
    f"""SELECT c.donor, round(avg(coalesce(k.umi, 0)), 6) AS mean FROM {{cells}} c LEFT JOIN (SELECT * FROM {{counts}} WHERE gene = '{GX}') k ON c.cell = k.cell WHERE c.cluster = '2' GROUP BY c.donor""",
)
def _(t):
    return rnd(expression.gene_mean_per_donor(t.cells, t.counts, GX, "2"), 6, "mean")


@query(
    "group_color_stats",
    f"""WITH v AS (SELECT c.cluster, CAST(coalesce(k.umi, 0) AS DOUBLE) AS v FROM {{cells}} c LEFT JOIN (SELECT * FROM {{counts}} WHERE gene = '{GX}') k ON c.cell = k.cell)
        SELECT cluster, median(v) AS median, round(avg(v), 6) AS mean, round(count(*) FILTER (WHERE v > 0) * 100.0D / count(*), 6) AS burst_frequency, round(avg(v) FILTER (WHERE v > 10), 6) AS burst_size FROM v GROUP BY cluster""",
)
def _(t):
    return rnd(expression.group_color_stats(t.cells, t.counts, GX, threshold=10), 6, "mean", "burst_frequency", "burst_size")


VAR = """n AS (SELECT CAST(count(DISTINCT cell) AS DOUBLE) AS n FROM {counts}),
   mo AS (SELECT gene, sum(umi) / max(n.n) AS mean, (sum(CAST(umi AS DOUBLE) * umi) - sum(umi) * (sum(umi) / max(n.n))) / (max(n.n) - 1) AS var FROM {counts}, n GROUP BY gene),
   xy AS (SELECT *, log10(mean) AS x, log10(var) AS y FROM mo),
   sm AS (SELECT count(*) AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM xy),
   co AS (SELECT s0*(s2*s4-s3*s3)-s1*(s1*s4-s3*s2)+s2*(s1*s3-s2*s2) AS d, t0*(s2*s4-s3*s3)-s1*(t1*s4-s3*t2)+s2*(t1*s3-s2*t2) AS d0,
            s0*(t1*s4-s3*t2)-t0*(s1*s4-s3*s2)+s2*(s1*t2-t1*s2) AS d1, s0*(s2*t2-t1*s3)-s1*(s1*t2-t1*s2)+t0*(s1*s3-s2*s2) AS d2 FROM sm),
   sv AS (SELECT gene, mean, var, var / pow(10.0D, d0/d + d1/d*x + d2/d*x*x) AS std_var FROM xy, co),
   rk AS (SELECT *, row_number() OVER (ORDER BY std_var DESC, gene) AS rank, sum(std_var) OVER (ORDER BY std_var DESC, gene ROWS UNBOUNDED PRECEDING) - std_var AS bef, sum(std_var) OVER () AS tot FROM sv)"""


@query("variable_genes", f"WITH {VAR} SELECT gene, round(mean, 5) AS mean, round(std_var, 5) AS std_var FROM rk WHERE bef < tot * 0.6")
def _(t):
    return rnd(expression.variable_genes(t.counts, 60.0), 5, "mean", "std_var").select("gene", "mean", "std_var")


def _lognorm(t):
    return expression.lognormalise(t.counts).select("cell", "gene", "value")


def _varg(t):
    return expression.variable_genes(t.counts, 25.0).select("gene", "rank")


REGRESS = f"""{VAR}, ge AS (SELECT gene FROM rk WHERE bef < tot * 0.25),
   cq AS (SELECT c.cell, CAST(sum(c.umi) AS DOUBLE) AS a, sum(CASE WHEN f.kind = 'MT' THEN c.umi ELSE 0 END) * 100.0D / sum(c.umi) AS b FROM {{counts}} c
          JOIN {{features}} f ON c.gene = f.ensembl WHERE c.cell IN (SELECT cell FROM {{cells}}) GROUP BY c.cell),
   cc AS (SELECT cell, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b FROM cq),
   sh AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, CAST(count(*) AS DOUBLE) AS n FROM cc),
   ln AS (SELECT cell, gene, ln(1 + umi / CAST(sum(umi) OVER (PARTITION BY cell) AS DOUBLE) * 10000) AS y FROM {{counts}}),
   ro AS (SELECT l.cell, l.gene, l.y, cc.a, cc.b FROM ln l JOIN ge ON l.gene = ge.gene JOIN cc ON l.cell = cc.cell),
   pg AS (SELECT gene, sum(y) AS sy, sum(y * y) AS yy, sum(a * y) AS ay, sum(b * y) AS byy FROM ro GROUP BY gene),
   cf AS (SELECT gene, sy / n AS c0, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS c1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS c2, yy, ay, byy, n FROM pg, sh),
   sd AS (SELECT gene, c0, c1, c2, sqrt(greatest(yy - n * c0 * c0 - c1 * ay - c2 * byy, 0) / (n - 1)) AS sd FROM cf)"""


@query(
    "regress_out",
    f"""WITH {REGRESS} SELECT r.cell, r.gene, round(least(greatest((y - c0 - c1 * a - c2 * b) / sd, -10), 10), 5) AS residual, round(c0, 6) AS c0, round(sd, 6) AS sd
        FROM ro r JOIN sd ON r.gene = sd.gene""",
)
def _(t):
    out = rnd(expression.regress_out(_lognorm(t), _meta(t), _varg(t)), 6, "c0", "sd")
    return rnd(out, 5, "residual").drop("c1", "c2")


def _meta(t):
    mito = t.features.filter("kind = 'MT'").select(F.col("ensembl").alias("gene"))
    return cells.cell_qc(t.cells.select("cell"), t.counts, mito, max_mp=100.0)


@query("pca_embed")
def _(t):
    return expression.residual_components(_lognorm(t), _meta(t), _varg(t), 10)[0]


# the dense residuals of all cells: their second moments have the component variances as eigenvalues
DENSE = f"""{REGRESS}, rd AS (SELECT c.cell, g.gene, CASE WHEN r.y IS NULL THEN (0 - g.c0 - g.c1 * c.a - g.c2 * c.b) / g.sd
     ELSE least(greatest((r.y - g.c0 - g.c1 * c.a - g.c2 * c.b) / g.sd, -10), 10) END AS v FROM cc c CROSS JOIN sd g LEFT JOIN ro r ON r.cell = c.cell AND r.gene = g.gene WHERE g.sd > 0),
   gm AS (SELECT x.gene AS g1, y.gene AS g2, sum(x.v * y.v) AS s FROM rd x JOIN rd y ON x.cell = y.cell GROUP BY x.gene, y.gene),
   nn AS (SELECT count(*) AS n FROM cc)"""


@query(
    "pca_variances",
    f"""WITH {DENSE} SELECT (SELECT count(DISTINCT g1) FROM gm) AS components, round((SELECT sum(s) FROM gm WHERE g1 = g2) / (n - 1), 6) AS total,
          round((SELECT sum(s * s) FROM gm) / (n - 1) / (n - 1), 6) AS squares, round((SELECT sum(x.s * y.s * z.s) FROM gm x JOIN gm y ON x.g2 = y.g1 JOIN gm z ON y.g2 = z.g1 AND z.g2 = x.g1) / pow(n - 1.0D, 3), 5) AS cubes FROM nn""",
)
def _(t):
    """Sums of the component variances, of their squares and cubes: the traces of powers of the moment matrix."""
    var = expression.residual_components(_lognorm(t), _meta(t), _varg(t), 1)[1]
    row = (len(var), sum(var), sum(v * v for v in var), sum(v**3 for v in var))
    out = t.spark.createDataFrame([row], "components long, total double, squares double, cubes double")
    return rnd(rnd(out, 6, "total", "squares"), 5, "cubes")


@query("cluster_cells")
def _(t):
    return expression.cluster_cells(expression.residual_components(_lognorm(t), _meta(t), _varg(t), 10)[0], 5)


# --- signatures --------------------------------------------------------------


# With 200 genes in 24 bins every gene of a bin is a control, so the hash order drops out.
MODULE = """ln AS (SELECT cell, gene, ln(1 + umi / CAST(sum(umi) OVER (PARTITION BY cell) AS DOUBLE) * 10000) AS v FROM {counts}),
   bn AS (SELECT gene, ntile(24) OVER (ORDER BY round(sum(v), 7), gene) AS bin FROM ln GROUP BY gene),
   hit AS (SELECT DISTINCT signature, gene FROM {signatures} WHERE gene IN (SELECT gene FROM bn)),
   ctl AS (SELECT DISTINCT h.signature, c.gene FROM hit h JOIN bn b ON h.gene = b.gene JOIN bn c ON c.bin = b.bin),
   ro AS (SELECT signature, gene, max(h) AS h, max(c) AS c FROM (SELECT signature, gene, 1 AS h, 0 AS c FROM hit UNION ALL SELECT signature, gene, 0, 1 FROM ctl) u GROUP BY ALL),
   sz AS (SELECT signature, sum(h) AS nh, sum(c) AS nc FROM ro GROUP BY signature)"""


@query(
    "module_score",
    f"""WITH {MODULE}, per AS (SELECT l.cell, r.signature, sum(l.v * r.h) / max(sz.nh) - sum(l.v * r.c) / max(sz.nc) AS s
          FROM ln l JOIN ro r ON l.gene = r.gene JOIN sz ON sz.signature = r.signature GROUP BY l.cell, r.signature)
        SELECT c.cell, sz.signature, round(coalesce(per.s, 0.0), 6) AS score
        FROM (SELECT DISTINCT cell FROM {{cells}}) c CROSS JOIN sz LEFT JOIN per ON per.cell = c.cell AND per.signature = sz.signature""",
)
def _(t):
    return rnd(signatures.module_score(_lognorm(t), t.signatures, t.cells), 6, "score")


RANKM = f"""{FULL}, tot AS (SELECT count(*) AS n FROM {{cells}}),
   qs AS (SELECT c.cluster, k.gene, sum(CAST(k.umi AS DOUBLE) * k.umi) AS q FROM {{counts}} k JOIN {{cells}} c ON k.cell = c.cell GROUP BY c.cluster, k.gene),
   al AS (SELECT gene, sum(s) AS s, sum(q) AS q FROM (SELECT su.gene, CAST(su.s AS DOUBLE) AS s, qs.q FROM su JOIN qs ON su.cluster = qs.cluster AND su.gene = qs.gene) u GROUP BY gene),
   mm AS (SELECT f.cluster, f.gene, f.s / CAST(f.n AS DOUBLE) AS m1, (a.s - f.s) / (tot.n - f.n) AS m2, coalesce(qs.q, 0) AS q1, a.q - coalesce(qs.q, 0) AS q2, CAST(f.n AS DOUBLE) AS n1, CAST(tot.n - f.n AS DOUBLE) AS n2
          FROM fu f JOIN al a ON f.gene = a.gene LEFT JOIN qs ON qs.cluster = f.cluster AND qs.gene = f.gene, tot),
   sd AS (SELECT *, sqrt(greatest((q1 - n1*m1*m1) / (n1 - 1), 0)) AS a1, sqrt(greatest((q2 - n2*m2*m2) / (n2 - 1), 0)) AS a2 FROM mm),
   rm AS (SELECT cluster, gene, (m1 - m2) / (greatest(a1, 0.2D * CASE WHEN m1 = 0 THEN 1 ELSE abs(m1) END) + greatest(a2, 0.2D * CASE WHEN m2 = 0 THEN 1 ELSE abs(m2) END)) AS metric FROM sd),
   ro AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY metric DESC, gene) AS rank FROM rm)"""


def _metric(t):
    return signatures.rank_metric(t.cells, t.counts)


def _ranks(t):
    return signatures.rank_metric_order(_metric(t))


@query("rank_metric", f"WITH {RANKM} SELECT cluster, gene, round(metric, 6) AS metric FROM rm")
def _(t):
    return rnd(_metric(t), 6, "metric")


@query("rank_metric_order", f"WITH {RANKM} SELECT cluster, gene, round(metric, 6) AS metric, CAST(rank AS INT) AS rank FROM ro")
def _(t):
    return rnd(_ranks(t), 6, "metric")


@query(
    "gsea_es",
    f"""WITH {RANKM}, g AS (SELECT r.cluster, s.signature, r.rank, r.gene, abs(r.metric) AS w FROM ro r JOIN (SELECT DISTINCT signature, gene FROM {{signatures}}) s ON r.gene = s.gene),
        k AS (SELECT cluster, signature, count(*) AS k, sum(w) AS nr FROM g GROUP BY ALL HAVING count(*) BETWEEN 10 AND 500),
        grid AS (SELECT k.cluster, k.signature, r.rank, k.k, k.nr, CASE WHEN g.gene IS NULL THEN 0 ELSE g.w END AS w, CASE WHEN g.gene IS NULL THEN 1 ELSE 0 END AS miss, count(*) OVER (PARTITION BY k.cluster, k.signature) AS n
                 FROM k JOIN ro r ON r.cluster = k.cluster LEFT JOIN g ON g.cluster = k.cluster AND g.signature = k.signature AND g.rank = r.rank),
        run AS (SELECT *, sum(w) OVER o / nr - sum(miss) OVER o / CAST(n - k AS DOUBLE) AS es FROM grid WINDOW o AS (PARTITION BY cluster, signature ORDER BY rank ROWS UNBOUNDED PRECEDING)),
        mx AS (SELECT cluster, signature, max(k) AS size, max(es) AS hi, min(es) AS lo FROM run GROUP BY ALL)
        SELECT cluster, signature, size, round(CASE WHEN hi >= -lo THEN hi ELSE lo END, 6) AS ES FROM mx""",
)
def _(t):
    return rnd(signatures.gsea_es(_ranks(t), t.signatures), 6, "ES")


@query("gsea_test")
def _(t):
    out = signatures.gsea_test(_ranks(t), t.signatures)
    return rnd(out, 6, "ES", "NES", "pval", "padj")


@query(
    "bh_adjust",
    """WITH p AS (SELECT dataset, SNPID, P, rank() OVER (PARTITION BY dataset ORDER BY P) + count(*) OVER (PARTITION BY dataset, P) - 1 AS r, count(*) OVER (PARTITION BY dataset) AS m FROM {sumstats})
       SELECT dataset, SNPID, round(-log10(min(least(P * m / r, 1.0D)) OVER (PARTITION BY dataset ORDER BY P DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adj FROM p""",
)
def _(t):
    out = signatures.bh_adjust(t.sumstats.select("dataset", "SNPID", "P"), "P", ["dataset"])
    return rnd(out.select("dataset", "SNPID", (-F.log10("p_adj")).alias("p_adj")), 6, "p_adj")


PLONG = "SELECT sex, donor, cluster AS subset, CAST(count(*) AS DOUBLE) AS value FROM {cells} GROUP BY sex, donor, cluster"
SPEAR = f"""w AS (SELECT c.sex, c.donor, s.cluster AS subset, coalesce(p.value, 0) AS value FROM (SELECT DISTINCT sex, donor FROM {{cells}}) c JOIN (SELECT DISTINCT cluster FROM {{cells}}) s ON TRUE
            LEFT JOIN ({PLONG}) p ON p.sex = c.sex AND p.donor = c.donor AND p.subset = s.cluster),
   r AS (SELECT *, rank() OVER (PARTITION BY sex, subset ORDER BY value) + (count(*) OVER (PARTITION BY sex, subset, value) - 1) / 2.0D AS rk FROM w),
   sp AS (SELECT a.sex, a.subset AS subset_1, b.subset AS subset_2, corr(a.rk, b.rk) AS r, count(*) AS n FROM r a JOIN r b ON a.sex = b.sex AND a.donor = b.donor GROUP BY ALL)"""


def _spear(t):
    return signatures.spearman_matrix(t.sql(PLONG), CL, ["sex"])


@query("spearman_matrix", f"WITH {SPEAR} SELECT sex, subset_1, subset_2, round(r, 6) AS r, n FROM sp")
def _(t):
    return rnd(_spear(t), 6, "r").drop("p")


# Ten donors per sex: eight degrees of freedom, for which the series has four terms.
@query(
    "spearman_p",
    f"""WITH {SPEAR}, a AS (SELECT *, atan(abs(r) * sqrt(8.0D / greatest(1.0D - r * r, 1e-300)) / sqrt(8.0D)) AS th FROM sp)
        SELECT sex, subset_1, subset_2, n, round(r, 6) AS r, CASE WHEN subset_1 <> subset_2 THEN
          round(1 - sin(th) * (1 + pow(cos(th), 2) / 2 + 3 * pow(cos(th), 4) / 8 + 15 * pow(cos(th), 6) / 48), 6) END AS p FROM a""",
)
def _(t):
    return rnd(_spear(t), 6, "r", "p")


CORRIN = """SELECT CASE WHEN l_linestatus = 'F' THEN 'female' ELSE 'male' END AS sx, l_returnflag AS subset_1, 'c' || CAST(l_linenumber AS VARCHAR(2)) AS subset_2,
            round(avg(l_discount) * 100 - 5, 6) AS r, min(l_tax) + 0.0D + CASE WHEN avg(l_quantity) > 25.4 THEN 0.06D ELSE 0.01D END AS p FROM {lineitem} GROUP BY 1, 2, 3"""


@query(
    "compare_correlations",
    f"""WITH c AS ({CORRIN}), f AS (SELECT subset_1, subset_2, CASE WHEN p <= 0.05 THEN r END AS r FROM c WHERE sx = 'female'), m AS (SELECT subset_1, subset_2, CASE WHEN p <= 0.05 THEN r END AS r FROM c WHERE sx = 'male')
        SELECT f.subset_1, f.subset_2, f.r AS female_r, m.r AS male_r, CASE WHEN f.r IS NULL AND m.r IS NULL THEN 'Non-significant' WHEN m.r IS NULL THEN 'Only female' WHEN f.r IS NULL THEN 'Only male'
           WHEN f.r > 0 AND m.r > 0 THEN 'Consistent, positive' WHEN f.r < 0 AND m.r < 0 THEN 'Consistent, negative' ELSE 'Unknown' END AS class
        FROM f JOIN m ON f.subset_1 = m.subset_1 AND f.subset_2 = m.subset_2""",
)
def _(t):
    c = t.sql(CORRIN)
    return signatures.compare_correlations(c.filter("sx = 'female'"), c.filter("sx = 'male'"))


SETA = "SELECT DISTINCT gene FROM {counts} WHERE umi > 95"
SETB = "SELECT gene FROM {signatures} WHERE signature IN ('S1', 'S2', 'T4')"


@query(
    "set_overlap_test",
    f"""WITH u AS (SELECT DISTINCT gene FROM {{counts}}), a AS (SELECT DISTINCT gene FROM ({SETA}) x), b AS (SELECT DISTINCT gene FROM ({SETB}) y)
        SELECT (SELECT count(*) FROM u) AS n_universe, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b ON a.gene = b.gene) AS n_both""",
)
def _(t):
    return _overlap(t).drop("p")


def _overlap(t):
    return signatures.set_overlap_test(t.sql(SETA), t.sql(SETB), t.counts.select("gene"))


@query(
    "set_overlap_p",
    f"""WITH u AS (SELECT count(DISTINCT gene) AS n FROM {{counts}}), a AS (SELECT DISTINCT gene FROM ({SETA}) x), b AS (SELECT DISTINCT gene FROM ({SETB}) y),
        s AS (SELECT u.n AS n_universe, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b ON a.gene = b.gene) AS n_both FROM u),
        k AS (SELECT *, unnest(range(n_both, least(n_a, n_b) + 1)) AS k FROM s),
        l AS (SELECT n_universe, n_a, n_b, n_both, lgamma(n_a + 1.0) - lgamma(k + 1.0) - lgamma(n_a - k + 1.0) + lgamma(n_universe - n_a + 1.0) - lgamma(n_b - k + 1.0)
                - lgamma(n_universe - n_a - n_b + k + 1.0) - lgamma(n_universe + 1.0) + lgamma(n_b + 1.0) + lgamma(n_universe - n_b + 1.0) AS lp FROM k)
        SELECT n_universe, n_a, n_b, n_both, round(sum(exp(lp)), 9) AS p FROM l GROUP BY ALL""",
)
def _(t):
    return rnd(_overlap(t), 9, "p")


@query(
    "deg_sets",
    """SELECT gene, string_agg(element, ';' ORDER BY element) AS set_values, count(*) AS set_size, round(avg(lfc), 4) AS avg_lfc,
              CAST(min(list_position(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], element) - 1) AS INT) AS set_order FROM {deg} WHERE lfc > 0.25 AND p_adj < 0.05 GROUP BY gene""",
)
def _(t):
    return rnd(signatures.deg_sets(t.deg, ["AF", "AO", "NF", "NO", "RF", "RO"]), 4, "avg_lfc")


RES = "SELECT gene, element AS cell_type, '1' AS cluster, p_adj AS FDR, p_adj < 0.02 AS is_egene FROM {deg}"
GSET = "SELECT 'S' || CAST(s_nationkey % 4 AS VARCHAR(3)) AS signature, 'ENSG' || lpad(CAST(s_suppkey AS VARCHAR(11)), 11, '0') AS gene FROM {supplier}"


@query("geneset_join", f"SELECT g.signature, g.gene, r.cell_type, r.cluster, r.FDR, r.is_egene, r.cell_type || '.' || r.cluster AS id FROM ({GSET}) g JOIN ({RES}) r ON g.gene = r.gene")
def _(t):
    return signatures.geneset_join(t.sql(GSET), t.sql(RES))


@query(
    "translate_ids_gene",
    """SELECT d.element, d.gene, n.name FROM {deg} d LEFT JOIN (SELECT ensembl, string_agg(DISTINCT name, ';' ORDER BY name) AS name FROM
         (SELECT ensembl, name FROM {features} UNION ALL SELECT ensembl, 'ALT' || substr(ensembl, 13) FROM {features} WHERE kind = 'MT') x GROUP BY ensembl) n ON d.gene = n.ensembl""",
)
def _(t):
    f = t.features.select("ensembl", "name")
    extra = t.features.filter("kind = 'MT'").select("ensembl", F.concat(F.lit("ALT"), F.col("ensembl").substr(13, 3)).alias("name"))
    return reports.translate_ids_gene(t.deg.select("element", "gene"), f.unionByName(extra))


# --- clones ------------------------------------------------------------------


@query(
    "clone_sharing",
    """WITH n AS (SELECT clonotype, tag, count(*) AS n FROM {clones} GROUP BY ALL), s AS (SELECT clonotype FROM n WHERE n > 3 GROUP BY clonotype HAVING count(*) = (SELECT count(DISTINCT tag) FROM {clones}))
       SELECT n.tag, CASE WHEN s.clonotype IS NULL THEN 'Unique' ELSE 'Shared' END AS sharing, CAST(sum(n.n) AS BIGINT) AS cells, count(*) AS clones FROM n LEFT JOIN s ON n.clonotype = s.clonotype GROUP BY 1, 2""",
)
def _(t):
    return clones.clone_sharing(t.clones, more_than=3)


@query(
    "clone_membership",
    """WITH n AS (SELECT clonotype, tag, count(*) AS n FROM {clones} GROUP BY ALL HAVING count(*) >= 6), g AS (SELECT clonotype, string_agg(tag, '&' ORDER BY tag) AS groups FROM n GROUP BY clonotype)
       SELECT groups, count(*) AS clones FROM g GROUP BY groups""",
)
def _(t):
    return clones.clone_membership(t.clones, at_least=6)


@query(
    "polyreactive_flag",
    """WITH n AS (SELECT clonotype, donor, tag, count(*) AS n FROM {clones} GROUP BY ALL), f AS (SELECT clonotype, donor, CASE WHEN count(*) FILTER (WHERE n >= 2) > 1 THEN 'pR' ELSE 'non-pR' END AS pr_tag FROM n GROUP BY ALL)
       SELECT c.cell, c.clonotype, c.donor, c.tag, f.pr_tag FROM {clones} c JOIN f ON c.clonotype = f.clonotype AND c.donor = f.donor""",
)
def _(t):
    return clones.polyreactive_flag(t.clones).select("cell", "clonotype", "donor", "tag", "pr_tag")


VDJ = """ok AS (SELECT * FROM {contigs} WHERE productive = 'True' AND chain IN ('TRA', 'TRB')),
   v AS (SELECT clonotype, chain, v_gene, row_number() OVER (PARTITION BY clonotype, chain ORDER BY count(*) DESC, v_gene) AS rn FROM ok GROUP BY clonotype, chain, v_gene),
   j AS (SELECT clonotype, chain, j_gene, row_number() OVER (PARTITION BY clonotype, chain ORDER BY count(*) DESC, j_gene) AS rn FROM ok GROUP BY clonotype, chain, j_gene),
   vd AS (SELECT v.clonotype, max(CASE WHEN v.chain = 'TRA' THEN v_gene END) AS tra_v, max(CASE WHEN v.chain = 'TRA' THEN j_gene END) AS tra_j, max(CASE WHEN v.chain = 'TRB' THEN v_gene END) AS trb_v,
            max(CASE WHEN v.chain = 'TRB' THEN j_gene END) AS trb_j FROM v JOIN j ON v.clonotype = j.clonotype AND v.chain = j.chain WHERE v.rn = 1 AND j.rn = 1 GROUP BY v.clonotype)"""


@query("vdj_consensus", f"WITH {VDJ} SELECT * FROM vd")
def _(t):
    return clones.vdj_consensus(t.contigs)


@query(
    "tcr_table",
    f"""WITH {VDJ}, g AS (SELECT clonotype, count(*) AS global_size FROM {{clones}} GROUP BY clonotype)
        SELECT c.clonotype, c.donor, count(*) AS local_size, {', '.join(f"count(*) FILTER (WHERE tag = '{x}') AS {q(x)}" for x in TAGS)}, max(g.global_size) AS global_size,
          max(vd.tra_v) AS tra_v, max(vd.tra_j) AS tra_j, max(vd.trb_v) AS trb_v, max(vd.trb_j) AS trb_j, CAST(substr(c.clonotype, 10) AS INT) AS clone_order
        FROM {{clones}} c JOIN g ON c.clonotype = g.clonotype LEFT JOIN vd ON c.clonotype = vd.clonotype GROUP BY c.clonotype, c.donor""",
)
def _(t):
    return clones.tcr_table(t.clones, clones.vdj_consensus(t.contigs), TAGS)


@query(
    "reactivity_summary",
    f"""WITH c AS (SELECT DISTINCT donor, tag, clonotype FROM {{clones}}), n AS (SELECT donor, count(DISTINCT clonotype) AS n FROM {{clones}} GROUP BY donor)
        SELECT c.donor, {', '.join(f"count(*) FILTER (WHERE tag = '{x}') AS {x}_C, round(count(*) FILTER (WHERE tag = '{x}') / CAST(max(n.n) AS DOUBLE), 9) AS {x}_P" for x in TAGS)}
        FROM c JOIN n ON c.donor = n.donor GROUP BY c.donor""",
)
def _(t):
    return rnd(clones.reactivity_summary(t.clones, TAGS, by_cell=False), 9, *[f"{x}_P" for x in TAGS])


# --- reports -----------------------------------------------------------------


@query(
    "max_pp4",
    """SELECT dataset1, Feature2, SNPID, round(PPH4, 6) AS PPH4 FROM (SELECT *, row_number() OVER (PARTITION BY dataset1, Feature2 ORDER BY PPH4 DESC, SNPID) AS rn FROM {coloc_hits}) q WHERE rn = 1""",
)
def _(t):
    return rnd(reports.max_pp4(t.coloc_hits, ["dataset1", "Feature2"]), 6, "PPH4").select("dataset1", "Feature2", "SNPID", "PPH4")


MAXC = {c: f"coalesce(max(CASE WHEN dataset2 = '{c}' THEN PPH4 END), 0.0D)" for c in CELLS}


@query(
    "coloc_matrix",
    f"""WITH {HITS}, m AS (SELECT Feature2, coalesce(string_agg(DISTINCT CASE WHEN PPH4 >= 0.8 THEN dataset1 END, ', ' ORDER BY CASE WHEN PPH4 >= 0.8 THEN dataset1 END), '') AS datasets,
          count(DISTINCT CASE WHEN PPH4 >= 0.8 THEN dataset1 END) AS Number_of_datasets, max(PPH4) AS Max_PPH4, {', '.join(f'{v} AS {q(c)}' for c, v in MAXC.items())} FROM hits GROUP BY Feature2)
        SELECT Feature2, datasets, Number_of_datasets, round(Max_PPH4, 6) AS Max_PPH4, {', '.join(f'round({q(c)}, 6) AS {q(c)}' for c in CELLS)},
          {' + '.join(f'CAST({q(c)} >= 0.8 AS INT)' for c in CELLS)} AS Number_of_celltypes FROM m WHERE Number_of_datasets > 0""",
)
def _(t):
    return rnd(reports.coloc_matrix(_hits(t), CELLS), 6, "Max_PPH4", *CELLS)


@query(
    "coloc_by_block",
    f"""WITH {HITS}, b AS (SELECT Feature1, count(DISTINCT SNPID) AS n_snps FROM t1 WHERE P <= 5e-8 GROUP BY Feature1)
        SELECT h.Feature1, {', '.join(f"round(max(CASE WHEN dataset2 = '{c}' THEN PPH4 END), 6) AS {q(c)}" for c in CELLS)}, max(b.n_snps) AS n_snps
        FROM hits h LEFT JOIN b ON h.Feature1 = b.Feature1 GROUP BY h.Feature1""",
)
def _(t):
    blocks = _t1(t).filter("P <= 5e-8").groupBy("Feature1").agg(F.count_distinct("SNPID").alias("n_snps"))
    return rnd(reports.coloc_by_block(_hits(t), blocks, CELLS), 6, *CELLS)


@query(
    "assoc_counts",
    "SELECT 'ST' || CAST(c.c_custkey AS VARCHAR) AS dataset, count(DISTINCT o.o_orderpriority || o.o_orderstatus) AS n_features FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000 GROUP BY c.c_custkey",
)
def _(t):
    hits = t.orders.filter("o_totalprice > 150000").select(
        F.concat(F.lit("ST"), F.col("o_custkey").cast("string")).alias("dataset"), F.concat("o_orderpriority", "o_orderstatus").alias("f")
    )
    return reports.assoc_counts(hits, t.manifest.select(F.col("sample_name").alias("dataset")), "f")


@query(
    "counts_to_meta",
    """SELECT m.sample_name, m.disease, n.n, n.n IS NOT NULL AS has_counts FROM {manifest} m LEFT JOIN
       (SELECT 'ST' || CAST(o_custkey AS VARCHAR) AS sample_name, count(*) AS n FROM {orders} WHERE o_totalprice > 300000 GROUP BY o_custkey) n ON m.sample_name = n.sample_name""",
)
def _(t):
    n = t.orders.filter("o_totalprice > 300000").groupBy(F.concat(F.lit("ST"), F.col("o_custkey").cast("string")).alias("sample_name")).agg(F.count("*").alias("n"))
    return reports.counts_to_meta(t.manifest.select("sample_name", "disease"), n, "sample_name")


@query(
    "union_missing_rows",
    """SELECT sample_name, disease, sum_stats, CASE WHEN sum_stats <> 0 THEN Link END AS Link FROM {manifest} WHERE NOT COLOC
       UNION SELECT sample_name, disease, sum_stats, CASE WHEN sum_stats <> 0 THEN 'new' END FROM {manifest} WHERE COLOC""",
)
def _(t):
    m = t.manifest.select("sample_name", "disease", "sum_stats", "Link", "COLOC")
    new = m.filter("COLOC").withColumn("Link", F.lit("new")).drop("COLOC")
    return reports.union_missing_rows(new, m.drop("COLOC"), ["sample_name", "disease"])


def comma(text: str) -> str:
    """Thousands separators of a whole number given as text (up to nine digits)."""
    once = f"regexp_replace({text}, '([0-9])([0-9][0-9][0-9])$', '\\1,\\2')"
    return f"regexp_replace({once}, '([0-9])([0-9][0-9][0-9],)', '\\1,\\2')"


def pos_sql(c: str) -> str:
    number = f"split_part({c}, ':', 2)"
    return f"'Chr' || split_part({c}, ':', 1) || ':' || {comma(number)}"


OVR = """SELECT q.CELL, q.GENEID, q.SNPID, s.dataset, s.disease, round(-log10(min(s.P)), 6) AS GWAS_Lead_P, min(s.BETA) AS GWAS_Lead_BETA
         FROM {qtl} q JOIN {sumstats} s ON q.SNPID = s.SNPID WHERE s.P <= 5e-8 GROUP BY q.CELL, q.GENEID, q.SNPID, s.dataset, s.disease"""


@query(
    "report_overlap",
    f"""WITH o AS ({OVR}) SELECT CELL, GENEID, dataset, disease, GWAS_Lead_P, GWAS_Lead_BETA, GWAS_Lead_P AS GWAS_P, GWAS_Lead_BETA AS GWAS_BETA, split_part(CELL, '_', 1) AS Cell_name,
          split_part(CELL, '_', 2) AS Cluster, FALSE AS ld, {pos_sql('o.SNPID')} AS Position, {pos_sql('o.SNPID')} AS GWAS_Lead_Position,
          split_part(o.SNPID, ':', 3) AS GWAS_Lead_ref, split_part(o.SNPID, ':', 4) AS GWAS_Lead_alt, p.RSID AS SNPID, p.RSID AS Lead FROM o JOIN {{panel}} p ON o.SNPID = p.SNPID""",
)
def _(t):
    return reports.report_overlap(_overlaps(t.qtl, t.sumstats), t.panel)


def _overlaps(qtl, sumstats):
    """The rows of OVR. Both sides are made distinct before they meet, by the sort that their join needs.

    What follows the join only passes its rows on, which are a multiple of the input's. A null SNPID
    meets nothing; the coalesce says so to Spark, and the lookup of the ids then keeps the rows' order.
    """
    known = F.coalesce("SNPID", F.lit(""))
    q = qtl.filter("SNPID IS NOT NULL").select("CELL", "GENEID", known.alias("SNPID")).repartition("SNPID")
    s = sumstats.filter("P <= 5e-8 AND SNPID IS NOT NULL").select("SNPID", "dataset", "disease", "P", "BETA").repartition("SNPID")
    s = s.groupBy("SNPID", "dataset", "disease").agg(
        F.round(-F.log10(F.min("P")), 6).alias("GWAS_Lead_P"), F.min("BETA").alias("GWAS_Lead_BETA")
    )
    once = first_by(q, ["SNPID", "CELL", "GENEID"], ["SNPID"])
    return once.join(s, "SNPID").select("CELL", "GENEID", "SNPID", "dataset", "disease", "GWAS_Lead_P", "GWAS_Lead_BETA")


SPAN = "split_part(Feature1, ':', 2)"
LOCUS = (
    "'Chr' || split_part(Feature1, ':', 1) || ':' || " + comma(f"split_part({SPAN}, '-', 1)") + " || '-' || " + comma(f"split_part({SPAN}, '-', 2)")
)


@query(
    "report_coloc",
    f"""WITH {HITS}, d AS (SELECT DISTINCT dataset, disease FROM {{sumstats}}),
        h AS (SELECT *, row_number() OVER (PARTITION BY disease, dataset1, dataset2, split_part(Feature2, '_', 1) ORDER BY PPH4 DESC, sid) AS rn FROM
           (SELECT c.*, d.disease, p.RSID AS sid FROM hits c JOIN d ON c.dataset1 = d.dataset JOIN {{panel}} p ON c.SNPID = p.SNPID) x)
        SELECT h.disease, dataset1 AS dataset, split_part(dataset2, '_', 1) AS Cell_name, split_part(dataset2, '_', 2) AS Cluster, split_part(Feature2, '_', 1) AS GENEID,
          coalesce(g.GENENAME, split_part(Feature2, '_', 1)) AS GENENAME, {LOCUS} AS locus, sid AS SNPID, {pos_sql('h.SNPID')} AS Position,
          split_part(h.SNPID, ':', 3) AS REF, split_part(h.SNPID, ':', 4) AS ALT, round(PPH4, 6) AS PPH4, round(SNP_PP_H4, 6) AS SNP_PP_H4
        FROM h LEFT JOIN {{genes}} g ON g.GENEID = split_part(Feature2, '_', 1) WHERE rn = 1""",
)
def _(t):
    studies = t.sumstats.select(F.col("dataset").alias("dataset1"), "disease").distinct()
    out = reports.report_coloc(_hits(t).join(studies, "dataset1"), t.panel, t.genes)
    return rnd(out, 6, "PPH4", "SNP_PP_H4").select(
        "disease", "dataset", "Cell_name", "Cluster", "GENEID", "GENENAME", "locus", "SNPID", "Position", "REF", "ALT", "PPH4", "SNP_PP_H4"
    )


@query(
    "report_coloc_locus",
    f"""WITH {HITS} SELECT DISTINCT Feature1, {LOCUS} AS locus, {pos_sql('SNPID')} AS Position, split_part(SNPID, ':', 3) AS REF, split_part(SNPID, ':', 4) AS ALT FROM hits""",
)
def _(t):
    return reports.report_coloc(_hits(t), t.panel, best=False).select("Feature1", "locus", "Position", "REF", "ALT").distinct()


FEAT = """SELECT 'ST' || CAST(o_custkey AS VARCHAR(12)) AS sample_name, o_orderpriority || o_orderstatus AS Feature FROM {orders} WHERE o_totalprice > 150000"""


@query(
    "report_studies",
    f"""WITH n AS (SELECT sample_name, count(DISTINCT Feature) AS n FROM ({FEAT}) q GROUP BY sample_name), k AS (SELECT sample_name, count(DISTINCT Feature) AS n FROM ({FEAT}) q WHERE Feature LIKE '1%' GROUP BY sample_name)
        SELECT m.sample_name, m.disease, m.sum_stats, CASE WHEN m.sum_stats <> 0 THEN m.Link END AS Link, CASE WHEN m.COLOC THEN n.n END AS Number_of_associations_OVERLAP, CASE WHEN m.COLOC THEN k.n END AS Number_of_associations_COLOC
        FROM {{manifest}} m LEFT JOIN n ON m.sample_name = n.sample_name LEFT JOIN k ON m.sample_name = k.sample_name""",
)
def _(t):
    m = t.manifest.select("sample_name", "disease", "sum_stats", "Link", "COLOC")
    hits = t.sql(FEAT)
    return reports.report_studies(m.filter("COLOC").drop("COLOC"), m.drop("COLOC"), hits, hits.filter("Feature LIKE '1%'"), ["sample_name", "disease"])

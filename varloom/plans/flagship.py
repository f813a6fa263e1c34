"""The flagship plan: raw association rows to a gene x cell matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.scalars import snpid
from varloom.operators import clean, overlap, panel
from varloom.plans.checks_association import ALLKEYS, harmonise_sql
from varloom.plans.checks_loci import CELLS, SIGQTL
from varloom.plans.registry import query


def gene_by_cell(gwas: DataFrame, panel_df: DataFrame, qtl: DataFrame, cells: list[str]) -> DataFrame:
    """Significant, panel-aligned variants joined to QTLs; best P per gene and cell."""
    sig = clean.significant(clean.clean_chromosome(gwas))
    aligned = panel.harmonise_biallelic(sig, panel_df, distinct=False).filter("found")
    hits = aligned.select("dataset", snpid().alias("SNPID")).distinct()
    best = overlap.best_per_gene(overlap.overlap(qtl, hits), ["GENEID", "CELL"])
    return overlap.gene_cell_matrix(best, cells)


@query(
    "flagship",
    f"""WITH g0 AS (SELECT dataset, replace(Chromosome, 'chr', '') AS Chromosome, Position, NEA, EA, P, BETA, SE, AF FROM {{gwas}} WHERE P <= 5e-8),
        {harmonise_sql('g0', ALLKEYS)}, s AS (SELECT DISTINCT Chromosome || ':' || CAST(Position AS VARCHAR) || ':' || NEA || ':' || EA AS SNPID FROM h WHERE found),
        o AS (SELECT q.* FROM ({SIGQTL}) q JOIN s ON q.SNPID = s.SNPID)
        SELECT GENEID, GENENAME, {', '.join(f"round(coalesce(max(CASE WHEN CELL = '{c}' THEN -log10(P) END), 0.0), 6) AS {chr(34)}{c}{chr(34)}" for c in CELLS)} FROM o GROUP BY GENEID, GENENAME""",
)
def _(t):
    gwas = t.gwas.drop("disease")
    out = gene_by_cell(gwas, t.panel_multi, t.sql(SIGQTL), CELLS)
    return out.select("GENEID", "GENENAME", *[F.round(c, 6).alias(c) for c in CELLS])

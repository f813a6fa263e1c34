"""Association loci: clumping, windows, merging, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.frames import first_by, islands, point_in_interval, tiled_running
from varloom.functions.scalars import chr_order
from varloom.operators.clean import significant
from varloom.sources.sinks import settle

KEYS = ("dataset", "Chromosome")


def clump_top(df: DataFrame, window: int = 100_000, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Greedy top signals of a table already filtered to significant rows.

    Bounds are exclusive: a variant exactly window/2 away survives. Only the best row
    of a position can become a top, and signals further apart than half a window never
    touch each other, so the greedy pass runs per island of nearby positions: one
    key's rows are neither sorted nor held together, and an island holds at most one
    row per base it spans. A round takes every row that beats all rows within reach, and
    removes what they reach; the order within a round does not matter, as tops of one
    round are out of each other's reach.
    """
    distance = round(window / 2)
    ties = [F.col("P"), F.col("SNPID")] if "SNPID" in df.columns else [F.col("P")]
    best = settle(first_by(df, [*keys, "Position"], ties))
    slim = best.select(*keys, "Position", "P").withColumn("_end", F.col("Position"))
    left = islands(slim, list(keys), "Position", "_end", gap=distance - 1).drop("_end")
    near = Window.partitionBy(*keys, "_island").orderBy("Position").rangeBetween(1 - distance, distance - 1)
    own = F.struct("P", "Position")
    tops = None
    while True:
        step = left.withColumn("_top", own == F.min(own).over(near))
        step = settle(step.withColumn("_gone", F.max("_top").over(near)))
        new = step.filter("_top").select(*keys, "Position")
        tops = new if tops is None else tops.unionByName(new)
        left = step.filter("NOT _gone").drop("_top", "_gone")
        if left.isEmpty():
            break
    return best.join(tops, [*keys, "Position"], "left_semi")


def define_loci(
    df: DataFrame, tops: DataFrame, window: int = 100_000, shrink: bool = False,
    threshold: float = 5e-8, keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """All variants within +-window/2 (inclusive) of each top, with Loci, Start, End_.

    Loci are numbered per key by (P, Position) of their top. `shrink` narrows a locus
    to the span of its significant variants.
    """
    half = round(window / 2)
    w = Window.partitionBy(*keys).orderBy("P", "Position")
    spans = tops.select(*keys, "P", "Position").withColumn("Loci", F.row_number().over(w)).select(
        *keys, "Loci", (F.col("Position") - half).alias("_ws"), (F.col("Position") + half).alias("_we")
    )
    members = point_in_interval(df, spans, max(window, 1), keys=keys, start="_ws", end="_we").drop("_ws", "_we")
    locus = [*keys, "Loci"]
    if shrink:
        sig = members.filter(F.col("P") <= threshold).groupBy(*locus).agg(
            F.min("Position").alias("Start"), F.max("Position").alias("End_")
        )
        return members.join(sig, locus).filter(F.col("Position").between(F.col("Start"), F.col("End_")))
    bounds = members.groupBy(*locus).agg(
        F.min("Position").alias("Start"), F.max("Position").alias("End_")
    )
    return members.join(bounds, locus)


def merge_loci(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Merge overlapping loci, renumber them per key and refresh their bounds.

    The running maximum of the ends decides, and a variant shared by merged loci is
    kept once.
    """
    keys = list(keys)
    spans = df.select(*keys, "Loci", "Start", "End_").distinct()
    marked = islands(spans, keys, "Start", "End_")
    bounds = marked.groupBy(*keys, "_island").agg(F.min("Start").alias("_s"), F.max("End_").alias("_e"))
    names = marked.select(*keys, "Loci", "_island").join(bounds, [*keys, "_island"])
    out = df.drop("Start", "End_").join(names, [*keys, "Loci"])
    return out.select(
        *[c for c in df.columns if c not in ("Loci", "Start", "End_")],
        F.col("_island").cast("int").alias("Loci"), F.col("_s").alias("Start"), F.col("_e").alias("End_"),
    ).distinct()


def number_loci(df: DataFrame, by: tuple[str, ...] = ("dataset",), chrom: str = "Chromosome") -> DataFrame:
    """Locus ids that run on across chromosomes, in genome order."""
    by = list(by)
    numbered = _numbers(settle(df.select(*by, chrom, "Loci", "Start").distinct()), by, chrom)
    out = df.join(numbered, [*by, chrom, "Loci", "Start"])
    return out.withColumn("Loci", F.col("_id")).drop("_id").select(*df.columns)


def _numbers(loci: DataFrame, by: list[str], chrom: str = "Chromosome") -> DataFrame:
    """(by, chrom, Loci, Start) with `_id` counting loci in genome order."""
    counted = tiled_running(
        loci, by, chr_order(chrom), ["Start", "Loci"], {"_id": ("sum", F.lit(1))}
    )
    return counted.select(*by, chrom, "Loci", "Start", F.col("_id").cast("int").alias("_id"))


def identify_loci(
    df: DataFrame, threshold: float = 5e-8, window: int = 100_000, shrink: bool = False,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Significant -> clump -> window -> merge -> number; no locus gives an empty table.

    Same result as chaining the single operators, but only tables of loci are merged
    and numbered; the variants are read twice, for the bounds and for the members.
    """
    key_list, half = list(keys), round(window / 2)
    tops = settle(clump_top(significant(df, threshold), window, keys).select(*keys, "P", "Position"))
    w = Window.partitionBy(*keys).orderBy("P", "Position")
    spans = settle(
        tops.withColumn("Loci", F.row_number().over(w)).select(
            *keys, "Loci", (F.col("Position") - half).alias("_ws"), (F.col("Position") + half).alias("_we")
        )
    )
    width = max(window, 1)
    seen = significant(df, threshold) if shrink else df
    members = point_in_interval(seen.select(*keys, "Position"), spans, width, keys=keys, start="_ws", end="_we")
    bounds = members.groupBy(*keys, "Loci").agg(F.min("Position").alias("Start"), F.max("Position").alias("End_"))
    marked = settle(islands(bounds, key_list, "Start", "End_"))
    merged = settle(
        marked.groupBy(*keys, F.col("_island").alias("Loci")).agg(
            F.min("Start").alias("Start"), F.max("End_").alias("_e")
        )
    )
    ids = _numbers(merged, [k for k in keys if k != "Chromosome"]).join(merged, [*keys, "Loci", "Start"]).select(
        *keys, F.col("Loci").alias("_island"), F.col("Start").alias("_s"), "_e", "_id"
    )
    windows = spans.join(marked, [*keys, "Loci"]).join(ids, [*keys, "_island"])
    inside = windows.select(
        *keys, (F.col("Start") if shrink else F.col("_ws")).alias("_ws"),
        (F.col("End_") if shrink else F.col("_we")).alias("_we"), "_id", "_s", "_e",
    )
    out = point_in_interval(df, inside, width, keys=keys, start="_ws", end="_we")
    return out.select(
        *df.columns, F.col("_id").alias("Loci"), F.col("_s").alias("Start"), F.col("_e").alias("End_")
    ).distinct()

"""DataFrame building blocks: range joins, two-level running aggregates, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.sources.sinks import settle


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in `order`.

    Spark turns row_number() = 1 into a group limit before the shuffle, so a hot
    key sends at most one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def spread_nulls(key: Column) -> Column:
    """A text key for an outer join in which nulls meet nothing and don't gather in one task."""
    return F.coalesce(key, F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 4096).cast("string")))


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent columns as typed nulls."""
    return df.withColumns(
        {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    )


def point_in_interval(
    points: DataFrame,
    intervals: DataFrame,
    width: int,
    keys: tuple[str, ...] = ("Chromosome",),
    pos: str = "Position",
    start: str = "Start",
    end: str = "End_",
    how: str = "inner",
) -> DataFrame:
    """Join points to the closed intervals that hold them.

    Intervals are replicated to the `width`-sized bins they touch; a point has one
    bin, so the join is an equi-join on (keys, bin) and emits no duplicates. `how`
    may be inner, left, left_semi or left_anti.
    """
    clash = [c for c in intervals.columns if c in points.columns and c not in keys]
    right = intervals.withColumnsRenamed({c: f"{c}__r" for c in clash})
    s, e = (f"{c}__r" if c in clash else c for c in (start, end))
    right = right.withColumnsRenamed({k: f"{k}__k" for k in keys}).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    )
    left = points.withColumn("_pbin", F.floor(F.col(pos) / width))
    cond = (F.col("_pbin") == F.col("_bin")) & F.col(pos).between(F.col(s), F.col(e))
    for k in keys:
        cond &= F.col(k) == F.col(f"{k}__k")
    out = left.join(right, cond, how)
    return out.drop("_pbin", "_bin", *[f"{k}__k" for k in keys])


def tiled_running(
    df: DataFrame,
    keys: list[str],
    tile: Column,
    order: list,
    running: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    tile_desc: bool = False,
) -> DataFrame:
    """Running sum / max / count per key without putting a key in one task.

    `tile` must be monotone in `order` (coarser). Each (key, tile) is summarised
    with a map-side combined aggregate, the few tile rows are scanned, and rows are
    then scanned only inside their own tile, so a hot key is spread over its tiles. Rows are
    dealt once, by key and tile in one struct, where null equals null: the join with the tiles
    and the scan both take them as they lie.
    `running` maps an output name to ("sum" | "max", column).
    """
    df = df.withColumn("_tile", tile)
    agg = {"sum": F.sum, "max": F.max}
    tiles = df.groupBy(*keys, "_tile").agg(
        *[agg[op](c).alias(f"_t_{name}") for name, (op, c) in running.items()]
    )
    torder = F.col("_tile").desc() if tile_desc else F.col("_tile")
    before = Window.partitionBy(*keys).orderBy(torder).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*keys, "_tile")
    tiles = tiles.select(
        place.alias("_of"),
        *[
            agg[op](f"_t_{name}").over(before).alias(f"_p_{name}")
            for name, (op, _) in running.items()
        ],
    )
    columns = [c for c in df.columns if c != "_tile"]
    rest = [c for c in columns if c not in keys]
    dealt = df.select(place.alias("_in"), *rest).join(tiles, F.col("_in") == F.col("_of")).drop("_of")
    joined = dealt.withColumns({k: F.col("_in")[k] for k in keys}) if keys else dealt
    inner = (
        Window.partitionBy("_in")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    outs = {}
    for name, (op, c) in running.items():
        own, prev = agg[op](c).over(inner), F.col(f"_p_{name}")
        if op == "sum":
            outs[name] = F.coalesce(own, F.lit(0)) + F.coalesce(prev, F.lit(0))
        else:
            outs[name] = F.greatest(own, prev)
    return joined.withColumns(outs).select(*columns, *[n for n in running if n not in columns])


def islands(
    df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, tile: int = 1_000_000
) -> DataFrame:
    """Gaps and islands: `_island` counts up where start > running max(end) + gap.

    The spans are written once, because the two scans read them several times.
    """
    df = settle(df)
    by = [F.col(start), F.col(end)]
    pos_tile = F.floor(F.col(start) / tile)
    df = tiled_running(
        df, keys, pos_tile, by, {"_prev_end": ("max", F.col(end))}, inclusive=False
    )
    flag = F.when(
        F.col("_prev_end").isNull() | (F.col(start) > F.col("_prev_end") + gap), 1
    ).otherwise(0)
    df = df.withColumn("_new", flag)
    df = tiled_running(df, keys, pos_tile, by, {"_island": ("sum", F.col("_new"))})
    return df.drop("_prev_end", "_new")


def wide(
    df: DataFrame, keys: list[str], column: str, values: list, agg: Column, fill=None
) -> DataFrame:
    """Pivot with the values stated, so no extra job lists them."""
    out = df.groupBy(*keys).pivot(column, values).agg(agg)
    return out if fill is None else out.fillna(fill, subset=[str(v) for v in values])


def distinct_list(c: Column, sep: str) -> Column:
    return F.concat_ws(sep, F.sort_array(F.collect_set(c)))


def share(count: Column, by: list[str] | None = None) -> Column:
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return count / F.sum(count).over(w)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

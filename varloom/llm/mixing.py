"""Mixing sources to target weights: weighted sampling without replacement, on the JVM alone.

Every source takes whole epochs of its documents first. The rest of its budget is drawn by keys
-ln(u) / weight in rising order until the words are used up; u comes from the row's id, so reruns
draw the same. The running sum that finds a source's last document needs no sort of the source: keys
fall into tiles, tiles are summed with map-side combining, and only the rows of the one tile in which
the budget ends are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.sources.sinks import settle

#: Words are the maximal runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeated.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and most epochs of a source.
SHARE, EPOCHS = 1.5, 2
#: Tiles of the keys (a power of two), and how often the one in which a budget ends is cut again. A source's
#: rows spread over them evenly if their weights are alike: a millionth is left to be sorted.
TILES, LEVELS = 1 << 10, 2


def uniform(key: Column) -> Column:
    """A number between 0 and 1 (both excluded) from the MD5 of a string."""
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def sample_key(u: Column, weight: Column) -> Column:
    """Exponential key: rows with small keys come first, heavier ones sooner; without a positive weight last."""
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
) -> DataFrame:
    """(source, source_size, target): the budget of every source from (source, source_size).

    `share` of all words is dealt by weight; a source stops at `epochs` times its own size and its
    excess is dealt to the others again, until none is above. In the order of size to weight the
    sources that stop come first, so one level of words per weight settles all. One row a source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * epochs)
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything).cast("double") * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", rest / F.sum("_w").over(after))
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    target = F.coalesce(F.least("_cap", level * F.col("_w")), F.col("_cap"))
    return rows.select("source", "source_size", target.alias("target"))


def measure(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc, source, size, u, kept): every document's number of words and its draw; no text unless kept.

    `kept` is a struct of the columns in `keep`, whatever their names. A null or empty text has size 0,
    a text of any length is counted in full. A row without an id draws by its text.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    kept = [F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("kept")] if keep else []
    return docs.select(
        ident.alias("doc"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        uniform(F.coalesce(ident.cast("string"), text, F.lit(""))).alias("u"), *kept,
    )


def mix(
    measured: DataFrame, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
    epochs: int = EPOCHS, tiles: int = TILES, levels: int = LEVELS,
) -> DataFrame:
    """(doc, source, size, source_size, target, epochs, part, taken, and the kept columns) for every row of `measure`.

    A source takes `epochs` whole copies of each of its documents and then, in the order of the sample
    keys, documents as a whole until the words left do not hold the next one, of which it takes the
    first words: `part` words besides the epochs, `taken` in all. So a source takes its target
    rounded down, and no document over the most epochs.

    `weight` is the documents' quality, over the columns of `measured` (null counts as 1; zero, negative
    and NaN are drawn last). A null source is a source, in order after the others. Rows equal in key, id
    and size are drawn together and share what is left evenly, rounded down. A source without words
    has target 0. No rows give none.
    """
    w = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    kept = [c for c in ("kept",) if c in measured.columns]
    rows = measured.select("doc", "source", "size", "u", F.when(F.isnan(w), 0.0).otherwise(w).alias("_w"), *kept)
    rows = settle(rows.select("doc", "source", "size", sample_key(F.col("u"), F.col("_w")).alias("_key"), "_w", *kept))

    sums = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg(F.when(F.col("_w") > 0, F.col("_w"))).alias("_mean")))
    means = sums.select(F.col("source").alias("_s"), "_mean")
    plan = targets(sums.drop("_mean"), weights, share, epochs).join(means, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # whole words and whole epochs, in integers
    words = F.floor("target").cast("long")
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.least(F.floor(words / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("long"))
    plan = settle(plan.withColumn("_rest", words - F.col("_epochs") * F.col("source_size")).withColumnRenamed("source", "_s"))

    # exp(-key * mean weight) is uniform for a document of mean weight; it falls as the key rises
    at = F.least(1 - F.exp(-F.col("_key") * F.coalesce("_mean", F.lit(1.0))), F.lit(1 - 2.0**-53))
    ends = plan.select("_s", "_mean", F.col("_rest").alias("_left"), F.lit(0).cast("long").alias("_in"))
    filled = rows.filter("size > 0")

    def inside(level: int) -> DataFrame:
        """Rows of the tile in which each source's budget ends, as far as the levels before have found it."""
        same = F.col("source").eqNullSafe(F.col("_s")) & (F.floor(at * float(tiles**level)) == F.col("_in"))
        return filled.join(ends, same)

    for level in range(levels):
        tile = F.floor(at * float(tiles ** (level + 1)))
        sums = inside(level).groupBy("_s", "_mean", "_left", tile.alias("_tile")).agg(F.sum("size").alias("_n"))
        # at most `tiles` rows a source
        sums = sums.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_s").orderBy("_tile")))
        sums = sums.filter("_upto > _left and _upto - _n <= _left")
        ends = settle(sums.select("_s", "_mean", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), F.col("_tile").alias("_in")))
    # only that tile is put in order, equal rows as one
    order = F.struct("_key", "doc", "size")
    last = inside(levels).groupBy("_s", order.alias("_cut"), "_left").agg(F.sum("size").alias("_n"), F.count("*").alias("_rows"))
    last = last.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_s").orderBy("_cut")))
    last = last.filter("_upto > _left and _upto - _n <= _left")
    evenly = F.floor((F.col("_left") - F.col("_upto") + F.col("_n")) / F.col("_rows")).cast("long")
    last = last.select(F.col("_s").alias("_es"), "_cut", evenly.alias("_part"))
    plan = settle(plan.join(last, F.col("_s").eqNullSafe(F.col("_es")), "left"))

    # one row a source; Spark checks its size before it sends it to all tasks
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left")
    part = F.when(order < F.col("_cut"), F.col("size")).when(order == F.col("_cut"), F.col("_part")).otherwise(0)
    out = out.withColumn("part", F.when(F.col("size") > 0, F.coalesce(part, F.lit(0))).otherwise(0).cast("long"))
    return out.select(
        "doc", "source", "size", "source_size", "target", F.col("_epochs").alias("epochs"), "part",
        (F.col("_epochs") * F.col("size") + F.col("part")).alias("taken"), *[f"{c}.*" for c in kept],
    )


def emit(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents of a mix: a row (epoch, text, ...) for every copy taken, the partial one last.

    `mixed` comes from `mix`, with the text kept by `measure`. A partial copy is cut after `part` words; one of all
    words is whole. Documents of which nothing is taken give no row.
    """
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = mixed.filter((F.col("size") > 0) & (copies > 0)).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.col("part").cast("int"))
    cut = (F.col("epoch") > F.col("epochs")) & (F.col("part") < F.col("size"))
    return rows.withColumn(text_col, F.when(cut, F.array_join(words, " ")).otherwise(F.col(text_col)))

"""Cell metadata: annotation, quality control, subsetting, composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.frames import tiled_running, wide
from varloom.functions.scalars import logit
from varloom.sources.sinks import settle


def barcode_lane(c: Column | str) -> Column:
    """Lane number at the end of a barcode (`ACGT-3`)."""
    return F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).cast("int")


def annotate_lanes(
    cells: DataFrame, lanes: DataFrame, hashtag: str = "hashtag", batch: str = "chrom_batch"
) -> DataFrame:
    """Lane row of each cell by barcode suffix, plus the overlay `hashtag-batch`.

    `cells` has barcode; `lanes` is one row per lane (chromium batch, sequencing batch,
    lane tags). A missing hashtag or batch gives a null overlay.
    """
    if "lane" not in cells.columns:
        cells = cells.withColumn("lane", barcode_lane("barcode"))
    out = cells.join(lanes, "lane", "left")
    return out.withColumn("overlay", F.concat(F.col(hashtag), F.lit("-"), F.col(batch).cast("string")))


def annotate_hashtag(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """Hashtag class by barcode core and lane."""
    cells = cells.withColumns(
        {"lane": barcode_lane("barcode"), "core": F.regexp_extract("barcode", r"^([^-]+)", 1)}
    )
    right = classes.select("core", "lane", F.col("class").alias("hashtag"))
    return cells.join(right, ["core", "lane"], "left").drop("core")


def fallback_donor(cells: DataFrame, geno: DataFrame, prefix: str = r"^DLCP0*") -> DataFrame:
    """Hashtag donor, else the genotype donor; doublets and ambiguous calls are null."""
    call = F.col("geno_call")
    donor = F.when(~call.isin("DBL", "AMB"), F.regexp_replace(call, prefix, ""))
    return cells.join(geno, "cell", "left").withColumn("full_donor", F.coalesce("donor", donor))


def join_donor_meta(cells: DataFrame, donors: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    return cells.join(donors.withColumnsRenamed(renames or {}), "donor", "left")


def cell_qc(
    cells: DataFrame, counts: DataFrame, mito: DataFrame | None = None, min_counts: int = 0, max_counts: int = 1 << 40,
    min_feats: int = 0, max_feats: int = 1 << 40, max_mp: float = 10.0,
) -> DataFrame:
    """Cells within the count, gene and mitochondrial-share limits (bounds inclusive)."""
    if mito is None:
        marked = counts.withColumn("_mt", F.lit(0))
    else:
        marked = counts.join(mito.select("gene", F.lit(1).alias("_mt")), "gene", "left")
    stats = marked.groupBy("cell").agg(
        F.sum("umi").alias("n_counts"), F.count_if(F.col("umi") > 0).alias("n_feats"),
        (F.sum(F.when(F.col("_mt") == 1, F.col("umi")).otherwise(0)) * 100.0 / F.sum("umi")).alias("percent_mt"),
    )
    ok = F.col("n_counts").between(min_counts, max_counts) & F.col("n_feats").between(min_feats, max_feats)
    return cells.join(stats.filter(ok & (F.col("percent_mt") <= max_mp)), "cell")


def parse_criteria(criteria: DataFrame) -> list[tuple[str, str, list[str]]]:
    """A criteria table (rows keep / discard, one column per tag) as rules.

    The table is a hand-written sheet, which is read whole on the driver.
    """
    tags = criteria.columns[1:]
    rules = []
    for row in criteria.collect():
        for tag in tags:
            if row[tag] is not None and row[tag] != "NA":
                rules.append((row[0], tag, row[tag].split(";")))
    return rules


def subset_by_criteria(cells: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Apply keep / discard rules; a null tag is not discarded and not kept."""
    for action, tag, values in rules:
        hit = F.coalesce(F.col(tag).cast("string").isin(*values), F.lit(False))
        cells = cells.filter(hit if action == "keep" else ~hit)
    return cells


def drop_clusters(cells: DataFrame, bad: DataFrame, keys: tuple[str, ...] = ("subset", "cluster")) -> DataFrame:
    return cells.join(bad.select(*keys), list(keys), "left_anti")


def merge_clusters(cells: DataFrame, merges: dict[str, list[str]], column: str = "cluster") -> DataFrame:
    """Relabel each set of clusters to one value."""
    c = F.col(column)
    out = reduce(lambda acc, kv: F.when(c.isin(*kv[1]), kv[0]).otherwise(acc), merges.items(), c)
    return cells.withColumn(column, out)


def relabel_rest(
    cells: DataFrame, column: str, keep: list[str], label: str | None = None, rest: str = "Rest"
) -> DataFrame:
    """Groups outside `keep` become `rest`; the kept ones may share one label."""
    c = F.col(column)
    kept = F.lit(label) if label else c
    return cells.withColumn(column, F.when(c.isin(*keep), kept).otherwise(F.when(c.isNotNull(), rest)))


def filter_tags(
    cells: DataFrame, rules: list[tuple[str, list[str], bool]], not_null: tuple[str, ...] = (),
    value: str | None = None, above: float | None = None,
) -> DataFrame:
    """Several (tag, values, keep?) rules, null removal and a value threshold."""
    for tag, values, keep in rules:
        hit = F.coalesce(F.col(tag).isin(*values), F.lit(False))
        cells = cells.filter(hit if keep else ~hit)
    if not_null:
        cells = cells.dropna(subset=list(not_null))
    return cells if above is None else cells.filter(F.col(value) > above)


def express_class(df: DataFrame, x: str, y: str, threshold: float) -> DataFrame:
    """DP / SP.X / SP.Y / DN by two thresholds."""
    hx, hy = F.col(x) > threshold, F.col(y) > threshold
    return df.withColumn(
        "express_class",
        F.when(hx & hy, "DP").when(hx & ~hy, "SP.X").when(~hx & hy, "SP.Y").when(~hx & ~hy, "DN"),
    )


def class_fractions(df: DataFrame, column: str = "express_class") -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def group_props(cells: DataFrame, groups: list[str], within: list[str] | None = None) -> DataFrame:
    """Cells per group and their share overall or within `within`."""
    n = cells.groupBy(*groups).agg(F.count("*").alias("n_cells"))
    w = Window.partitionBy(*(within or []))
    return n.withColumn("share", F.col("n_cells") / F.sum("n_cells").over(w))


def cell_counts(cells: DataFrame, groups: list[str]) -> DataFrame:
    return cells.groupBy(*groups).agg(F.count("*").alias("n_cells"))


def donor_cluster_props(cells: DataFrame, clusters: list[str], fill: bool = True) -> DataFrame:
    """Share of each cluster per donor as donor x cluster, 0 where absent.

    The division is by the donor's own total, taken in the same pivot aggregate.
    """
    c = F.col("cluster")
    d = cells.filter("donor IS NOT NULL").groupBy("donor")
    out = d.agg(F.count("*").alias("_n"), *[F.count_if(c == x).alias(f"_{x}") for x in clusters])
    share = {x: F.col(f"_{x}") / F.col("_n") for x in clusters}
    return out.select("donor", *[(v if fill else F.nullif(v, F.lit(0.0))).alias(x) for x, v in share.items()])


def cluster_share(cells: DataFrame, cluster: str) -> DataFrame:
    """Share of one cluster per donor."""
    hit = F.when(F.col("cluster") == cluster, 1.0).otherwise(0.0)
    return cells.filter("donor IS NOT NULL").groupBy("donor").agg(F.avg(hit).alias("share"))


def immune_phenotypes(
    cells: DataFrame, sorter: DataFrame | None = None, do_logit: bool = False, sorted_share: str = "cell_percent"
) -> DataFrame:
    """Share of every subset per donor: in silico, or among CD45+ cells.

    With `sorter` (donor, subset group, percent among CD45+) the in-silico share is
    scaled by the sorted share of its group. Long result (donor, subset, value).
    """
    n = cells.filter("donor IS NOT NULL").groupBy("donor", "population", "cluster").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("donor", "population")
    value = F.col("_n") / F.sum("_n").over(w)
    out = n.withColumn("value", value)
    if sorter is not None:
        out = out.join(sorter.select("donor", "population", sorted_share), ["donor", "population"]).withColumn(
            "value", F.col("value") * F.col(sorted_share) / 100
        )
    if do_logit:
        # one share of 0 or 1 anywhere makes all shares be pulled in, as the published function does
        edge = out.agg(F.coalesce(F.max(F.col("value").isin(0.0, 1.0)), F.lit(False)))
        out = out.withColumn("value", logit("value", edge.scalar()))
    return out.select("donor", F.concat_ws(" ", F.upper("population"), "cluster").alias("immune_subset"), "value")


def phenotype_matrix(long: DataFrame, subsets: list[str]) -> DataFrame:
    return wide(long, ["donor"], "immune_subset", subsets, F.max("value"), fill=0.0)


def low_donor_report(cells: DataFrame, at_most: int = 10) -> DataFrame:
    """Per cluster: donors with few cells, their `;` list, and the cluster size."""
    per = cells.groupBy("cluster", "donor").agg(F.count("*").alias("_n"))
    low = F.col("_n") <= at_most
    names = F.concat_ws(";", F.array_sort(F.collect_list(F.when(low, F.col("donor")))))
    return per.groupBy("cluster").agg(
        F.count_if(low).alias("donor_count"), F.nullif(names, F.lit("")).alias("donors"),
        F.sum("_n").alias("cluster_size"),
    )


def tag_by_cluster(cells: DataFrame, tag: str, cluster: str = "cluster") -> DataFrame:
    """Contingency of tag and cluster, scaled so every tag value weighs the same.

    The common size is the smallest tag size if it is over 5 % of all cells, else the
    median size.
    """
    n = cells.filter(F.col(tag).isNotNull()).groupBy(tag, cluster).agg(F.count("*").alias("n"))
    sizes = n.groupBy(tag).agg(F.sum("n").alias("total"))
    norm = sizes.agg(
        F.min("total").alias("_min"), F.sum("total").alias("_all"), F.percentile("total", 0.5).alias("_med")
    ).withColumn("_factor", F.when(F.col("_min") / F.col("_all") > 0.05, F.col("_min")).otherwise(F.col("_med")))
    factor = sizes.select(tag, "total", (norm.select("_factor").scalar() / F.col("total")).alias("_f"))
    return n.join(factor, tag).select(tag, cluster, "n", (F.col("n") * F.col("_f")).alias("scaled"), "total")


def pre_post_counts(before: DataFrame, after: DataFrame, clusters: list[str]) -> DataFrame:
    """Cells per donor before and after filtering, with a column per cluster."""
    name = F.coalesce(F.col("donor"), F.lit("Unassigned"))
    c = F.col("cluster")
    post = after.groupBy(name.alias("donor")).agg(
        F.count("*").alias("post"), *[F.count_if(c == x).alias(x) for x in clusters]
    )
    undoubled = before.filter("hashtag IS NULL OR hashtag <> 'Doublet'")
    pre = undoubled.groupBy(name.alias("donor")).agg(F.count("*").alias("pre"))
    return post.join(pre, "donor").select("donor", "pre", "post", *clusters)


def harmonise_batches(df: DataFrame, date_col: str | None = None, ids_col: str | None = None) -> DataFrame:
    """Dates to letters in order (A to Z, then AA); `a;b` ids to dense numbers in natural order.

    Both code tables hold one row per distinct value and are numbered tile by tile. Each
    distinct id list is taken apart, recoded by a join, and put together again.
    """
    if date_col:
        days = df.select(date_col).filter(F.col(date_col).isNotNull()).distinct()
        tile = F.substring(F.col(date_col).cast("string"), 1, 7)
        codes = tiled_running(days, [], tile, [date_col], {"_n": ("sum", F.lit(1))})
        df = df.join(codes.select(date_col, letters(F.col("_n")).alias(f"{date_col}_code")), date_col, "left")
    if ids_col:
        lists = settle(df.select(ids_col).filter(F.col(ids_col).isNotNull()).distinct())
        parts = lists.select(ids_col, F.posexplode(F.split(ids_col, ";")).alias("_at", "_id"))
        size = F.length("_id")
        tile = F.concat(F.lpad(size.cast("string"), 9, "0"), F.substring("_id", 1, 3))
        ids = tiled_running(parts.select("_id").distinct(), [], tile, [size, F.col("_id")], {"_n": ("sum", F.lit(1))})
        coded = parts.join(ids, "_id").groupBy(ids_col).agg(F.array_sort(F.collect_list(F.struct("_at", F.col("_n").cast("string").alias("_n")))).alias("_c"))
        coded = coded.select(F.col(ids_col).alias("_key"), F.array_join("_c._n", ";").alias(f"{ids_col}_code"))
        df = df.join(coded, F.col(ids_col) == F.col("_key"), "left").drop("_key")
    return df


def letters(n: Column) -> Column:
    """1 to A, 26 to Z, 27 to AA, and so on."""
    def digit(s: Column, _: Column) -> Column:
        rest = F.floor((s["n"] - 1) / 26)
        more = F.concat(F.char(F.lit(65) + F.pmod(s["n"] - 1, F.lit(26))), s["t"])
        return F.when(s["n"] > 0, F.struct(rest.alias("n"), more.alias("t"))).otherwise(s)

    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("t"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, digit, lambda s: s["t"])


def downsample_group(cells: DataFrame, column: str | None, n: int, seed: int = 1, key: str = "cell") -> DataFrame:
    """At most n pseudo-random rows per group (or overall), the same on every run.

    The group limit is applied before the shuffle, so a big group sends n rows per task.
    """
    order = [_hashed(key, seed), F.col(key)]
    if column is None:
        return cells.orderBy(*order).limit(n)
    w = Window.partitionBy(column).orderBy(*order)
    return cells.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sample_share(cells: DataFrame, share: float, seed: int = 1, key: str = "cell") -> DataFrame:
    """A fixed share of rows by hash, without a shuffle."""
    return cells.filter(F.substring(_hashed(key, seed), 1, 8) < f"{int(share * 2**32):08x}")


def _hashed(key: str, seed: int) -> Column:
    """Hex digits in an order that has nothing to do with the key's."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))

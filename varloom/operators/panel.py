"""Matching, harmonising and lifting variants against a reference panel."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.functions.frames import first_by, point_in_interval, spread_nulls
from varloom.functions.scalars import (
    FLIP_NOTES,
    NOTE_ORDER,
    beta_from_or,
    complement,
    note_rank,
    rank_of_codes,
    risk_alleles,
    se_from_beta_z,
    snpid,
    snpid_blank,
    strand_ambiguous,
    z_from_beta_se,
    z_from_p,
)
from varloom.operators import clean
from varloom.sources.sinks import release, scratch, settle

SITE = ["Chromosome", "Position"]


@dataclass(frozen=True)
class StoredPanel:
    """A panel written once in the three forms that the operators join, each bucketed by its join key.

    `sites` has a row (Chromosome, Position, _alleles) a site, `ids` a row (SNPID, RSID) a variant id and
    `places` the distinct (RSID, Chromosome, Position). A join with one of them moves only the other
    side, as long as there are at least as many buckets as shuffle partitions.
    """

    sites: DataFrame
    ids: DataFrame
    places: DataFrame


def store_panel(panel: DataFrame, buckets: int | None = None, name: str | None = None) -> StoredPanel:
    """Write a panel (Chromosome, Position, REF, ALT, SNPID, RSID) for repeated use.

    `buckets` is the session's number of shuffle partitions unless given. The tables are named
    `<name>_sites` and so on; `open_panel` finds them again.
    """
    spark = panel.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"panel_{uuid.uuid4().hex}"
    parts = {
        "sites": (_site_alleles(panel), SITE), "ids": (_variant_ids(panel), ["SNPID"]), "places": (_places(panel), ["RSID"]),
    }
    for part, (rows, keys) in parts.items():
        # dealt as the buckets are, so that each is one file
        rows = rows.repartition(buckets, *keys)
        rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch(spark, f"{name}_{part}")).saveAsTable(f"{name}_{part}")
    return open_panel(spark, name)


def open_panel(spark: SparkSession, name: str) -> StoredPanel:
    return StoredPanel(*[spark.table(f"{name}_{part}") for part in ("sites", "ids", "places")])


Panel = DataFrame | StoredPanel


def panel_match(df: DataFrame, panel: DataFrame) -> DataFrame:
    """Left join on the site with a `matched` marker; fans out at multi-allelic sites."""
    right = panel.select(*SITE, "REF", "ALT", F.lit(True).alias("matched"))
    out = df.drop("REF", "ALT").join(right, SITE, "left")
    return out.withColumn("matched", F.coalesce("matched", F.lit(False)))


def best_note(df: DataFrame, keys: list[str], notes: str = "Notes") -> DataFrame:
    """Among rows of one input row (same `keys`) keep the best note.

    Ties are kept, except that `Not Found` is kept once.
    """
    w = Window.partitionBy(*keys).orderBy(note_rank(notes))
    ranked = df.withColumns(
        {"_rank": F.rank().over(w), "_rn": F.row_number().over(w.orderBy(note_rank(notes), *_rest(df, keys)))}
    )
    keep = (F.col("_rank") == 1) & ((F.col(notes) != "Not Found") | (F.col("_rn") == 1))
    return ranked.filter(keep).drop("_rank", "_rn")


def _rest(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _variant_ids(panel: Panel) -> DataFrame:
    if isinstance(panel, StoredPanel):
        return panel.ids
    return panel.groupBy("SNPID").agg(F.min("RSID").alias("RSID"))


def _places(panel: Panel) -> DataFrame:
    return panel.places if isinstance(panel, StoredPanel) else panel.select("RSID", *SITE).distinct()


def _site_alleles(panel: Panel) -> DataFrame:
    """One row per site with its (REF, ALT) pairs; a site has a handful of them."""
    if isinstance(panel, StoredPanel):
        return panel.sites
    return (
        panel.groupBy(*SITE)
        .agg(F.sort_array(F.collect_set(F.struct("REF", "ALT"))).alias("_alleles"))
    )


def _code(target: Column, comp: Column, site: Column) -> Column:
    ref, alt = site["REF"], site["ALT"]
    return (
        F.when(target.isNull(), "0")
        .when(target == ref, "1")
        .when(target == alt, "2")
        .when(comp == ref, "3")
        .when(comp == alt, "4")
        .otherwise("5")
    )


def _harmonise(df: DataFrame, panel: Panel, fill_both: bool, distinct: bool) -> DataFrame:
    """Join each row once to its site's alleles and choose the best pair in place.

    A row keeps its identity, so no key over all columns is needed to tell which
    matches belong together, and there is no shuffle beyond the site join.
    """
    df = df.drop("REF", "ALT").withColumns({"_cn": complement("NEA"), "_ce": complement("EA")})
    df = df.join(_site_alleles(panel), SITE, "left")
    nea, ea = F.col("NEA"), F.col("EA")

    def code(site: Column) -> Column:
        pair = F.concat(_code(nea, F.col("_cn"), site), F.lit("-"), _code(ea, F.col("_ce"), site))
        return F.struct(pair.alias("codes"), site["REF"].alias("REF"), site["ALT"].alias("ALT"))

    def rank(o: Column) -> Column:
        r = rank_of_codes(o["codes"])
        if fill_both:
            r = F.when(o["codes"] == "0-0", NOTE_ORDER.index("Fill")).otherwise(r)
        return F.struct(r.alias("rank"), o["REF"].alias("REF"), o["ALT"].alias("ALT"))

    df = df.withColumn("_options", F.transform(F.transform("_alleles", code), rank))
    best = F.array_min(F.transform("_options", lambda o: o["rank"]))
    df = df.withColumn("_best", best)
    kept = F.filter("_options", lambda o: o["rank"] == F.col("_best"))
    lost = len(NOTE_ORDER) - 1
    kept = F.when(F.col("_best") == lost, F.slice("_options", 1, 1)).otherwise(kept)
    notes = F.array(*[F.lit(n) for n in NOTE_ORDER])
    df = df.withColumn("_m", F.explode_outer(kept)).withColumn(
        "Notes", notes[F.coalesce(F.col("_m.rank"), F.lit(lost))]
    )
    found = F.col("Notes") != "Not Found"
    df = df.withColumns(
        {
            "REF": F.when(found, F.col("_m.REF")),
            "ALT": F.when(found, F.col("_m.ALT")),
            "NEA": F.when(found, F.col("_m.REF")).otherwise(nea),
            "EA": F.when(found, F.col("_m.ALT")).otherwise(ea),
            "found": found,
        }
    ).drop("_cn", "_ce", "_alleles", "_options", "_best", "_m")
    return df.distinct() if distinct else df


def harmonise_biallelic(df: DataFrame, panel: Panel, distinct: bool = True) -> DataFrame:
    """Align NEA, EA to REF, ALT. Rows missing both alleles stay unmatched."""
    return _harmonise(df, panel, fill_both=False, distinct=distinct)


def harmonise_multiallelic(df: DataFrame, panel: Panel, distinct: bool = True) -> DataFrame:
    """Same; a row missing both alleles is filled once per panel allele."""
    return _harmonise(df, panel, fill_both=True, distinct=distinct)


# Harmoniser registry by protocol.
HARMONISERS: dict[str, Callable[..., DataFrame]] = {
    "sumstats": harmonise_biallelic,
    "catalog": harmonise_multiallelic,
}


def recover_coords_by_rsid(df: DataFrame, panel: Panel) -> DataFrame:
    """Fill a missing chromosome and/or position from the RSID.

    Only rows that need it are joined; the others never meet the join, so a mass of
    rows without RSID cannot skew it.
    """
    needs = F.col("RSID").isNotNull() & (F.col("Chromosome").isNull() | F.col("Position").isNull())
    rest = df.filter(~needs)
    places = _places(panel).select(
        F.col("RSID").alias("_id"), F.col("Chromosome").alias("_c"), F.col("Position").alias("_p")
    )
    cond = (
        (F.col("RSID") == F.col("_id"))
        & (F.col("Chromosome").isNull() | (F.col("Chromosome") == F.col("_c")))
        & (F.col("Position").isNull() | (F.col("Position") == F.col("_p")))
    )
    filled = (
        df.filter(needs)
        .join(places, cond, "left")
        .withColumns({"Chromosome": F.coalesce("Chromosome", "_c"), "Position": F.coalesce("Position", "_p")})
        .select(*df.columns)
    )
    with_id = filled.unionByName(rest.filter("RSID IS NOT NULL")).distinct()
    return with_id.unionByName(rest.filter("RSID IS NULL"))


def annotate_rsid(df: DataFrame, panel: Panel, distinct: bool = True) -> DataFrame:
    """Panel RSID by SNPID; the file's own id is kept as `Original_RSID`.

    One row per variant and statistics, whatever the ids.
    """
    return _annotated(df, panel, distinct).drop("_key")


def _annotated(df: DataFrame, panel: Panel, distinct: bool) -> DataFrame:
    """`annotate_rsid` with the key that its rows are dealt by: equal rows have equal ones.

    The key is the SNPID, and of rows without one a hash of what stays as it is in `polish`. As a
    column of a grouping it spares a further exchange.
    """
    if "RSID" in df.columns:
        df = df.withColumnRenamed("RSID", "Original_RSID")
    else:
        df = df.withColumn("Original_RSID", F.lit(None).cast("string"))
    ids = _variant_ids(panel).withColumnRenamed("SNPID", "_id")
    fixed = [c for c in ("dataset", *SITE, "NEA", "EA", "Notes") if c in df.columns]
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*fixed), F.lit(4096)).cast("string"))
    out = df.withColumn("_key", F.coalesce("SNPID", spread)).join(ids, F.col("_key") == F.col("_id"), "left").drop("_id")
    if not distinct:
        return out
    keys = [c for c in out.columns if c not in ("Original_RSID", "RSID")]
    return out.groupBy(*keys).agg(
        F.min("Original_RSID").alias("Original_RSID"), F.min("RSID").alias("RSID")
    ).select(*out.columns)


def build_number(build: Column) -> Column:
    return F.regexp_extract(build, r"(\d+)", 1).cast("int")


def detect_build(
    df: DataFrame, panels: dict[str, DataFrame], by: str = "dataset", low: float = 0.9
) -> DataFrame:
    """Best-matching build per study.

    All panels are joined at once as one site table holding the builds of a site.
    Ties go to the highest build number. `status` is ok, low (rate under `low` with
    20 rows or more), minority (rows with coordinates are under half of those
    without) or no coordinates; the build is null for the last two.
    """
    sites = reduce(
        DataFrame.unionByName,
        [p.select(*SITE, F.lit(b).alias("_build")) for b, p in panels.items()],
    ).groupBy(*SITE).agg(F.collect_set("_build").alias("_builds"))
    complete = F.col("Chromosome").isNotNull() & F.col("Position").isNotNull()
    joined = df.select(by, *SITE, complete.alias("_ok")).join(sites, SITE, "left")
    hit = {
        b: F.count_if(F.coalesce(F.array_contains("_builds", b), F.lit(False))) for b in panels
    }
    g = joined.groupBy(by).agg(
        F.count_if("_ok").alias("_n"), F.count_if(~F.col("_ok")).alias("_miss"),
        *[h.alias(f"_h_{b}") for b, h in hit.items()],
    )
    options = [
        F.struct(
            F.try_divide(F.col(f"_h_{b}"), F.col("_n")).alias("rate"),
            build_number(F.lit(b)).alias("number"), F.lit(b).alias("build"),
        )
        for b in panels
    ]
    best = F.greatest(*options) if len(options) > 1 else options[0]
    minority = (F.col("_miss") > 0) & (F.col("_n") < F.col("_miss") * 0.5) & (F.col("_n") + F.col("_miss") > 20)
    status = (
        F.when(F.col("_n") == 0, "no coordinates")
        .when(minority, "minority")
        .when((best["rate"] < low) & (F.col("_n") >= 20), "low")
        .otherwise("ok")
    )
    usable = (F.col("_n") > 0) & ~minority
    return g.select(
        by,
        F.when(usable, best["build"]).alias("build"),
        F.when(usable, best["rate"]).alias("rate"),
        status.alias("status"),
    )


def liftover(
    df: DataFrame, chains: DataFrame, path: list[str], width: int = 100_000
) -> DataFrame:
    """Move positions along a path of builds.

    `chains` holds ungapped segments: src, dst, Chromosome, Start, End_ (exclusive),
    q_chromosome, q_start, q_end, strand. Unmapped rows and rows that end on another
    chromosome are dropped; rows without coordinates stay with a null SNPID.
    """
    has = F.col("Chromosome").isNotNull() & F.col("Position").isNotNull()
    out = df.filter(has).withColumn("_source", F.col("Chromosome"))
    for src, dst in zip(path, path[1:]):
        hop = chains.filter((F.col("src") == src) & (F.col("dst") == dst)).select(
            "Chromosome", F.col("Start").alias("_s"), (F.col("End_") - 1).alias("_e"),
            F.col("q_chromosome").alias("_qc"), F.col("q_start").alias("_qs"),
            F.col("q_end").alias("_qe"), F.col("strand").alias("_strand"),
        )
        moved = F.when(
            F.col("_strand") == "-", F.col("_qe") - 1 - (F.col("Position") - F.col("_s"))
        ).otherwise(F.col("_qs") + (F.col("Position") - F.col("_s")))
        out = (
            point_in_interval(out, hop, width, start="_s", end="_e")
            .withColumns({"Position": moved, "Chromosome": F.col("_qc")})
            .drop("_s", "_e", "_qc", "_qs", "_qe", "_strand")
        )
    out = out.filter(F.col("Chromosome") == F.col("_source")).drop("_source")
    out = out.withColumn("SNPID", snpid_blank())
    rest = df.filter(~has).withColumn("SNPID", F.lit(None).cast("string"))
    return out.unionByName(rest.select(*out.columns))


def build_path(spark: SparkSession, edges: DataFrame, target: str, max_depth: int | None = None) -> DataFrame:
    """Shortest conversion path (src, path, depth) from every build that can reach `target`.

    Breadth first from the target: a level holds the builds not seen before, each with the
    first of its shortest paths, so a build is visited once. `max_depth` limits the
    number of steps; by default all builds are found.
    """
    edges = settle(edges.select("src", "dst").distinct().filter(F.col("src") != target))
    level = edges.filter(F.col("dst") == target).select(
        "src", F.concat_ws(">", "src", "dst").alias("path"), F.lit(1).alias("depth")
    )
    found, depth = settle(level), 1
    while max_depth is None or depth < max_depth:
        last = found.filter(F.col("depth") == depth).select(F.col("src").alias("dst"), "path")
        depth += 1
        level = (
            edges.join(last, "dst").join(found.select("src"), "src", "left_anti").groupBy("src")
            .agg(F.min(F.concat_ws(">", "src", "path")).alias("path")).withColumn("depth", F.lit(depth))
        )
        level = settle(level)
        if level.isEmpty():
            break
        found = settle(found.unionByName(level))
    return found


def build_lineage(
    manifest: DataFrame, builds: DataFrame, paths: DataFrame, target: str
) -> DataFrame:
    """Manifest rows with the original build and whether a lift is needed.

    `builds` lists the builds a study is available in; the target itself is taken
    first, then the one with the shortest path (ties by name).
    """
    reach = builds.join(
        paths.select(F.col("src").alias("build"), F.col("depth")), "build", "left"
    ).withColumn("depth", F.when(F.col("build") == target, 0).otherwise(F.col("depth")))
    chosen = first_by(
        reach.filter("depth IS NOT NULL"), ["sample_name"], [F.col("depth"), F.col("build")]
    ).select("sample_name", F.col("build").alias("original_build"))
    return manifest.join(chosen, "sample_name").withColumns(
        {"genome": F.lit(target), "LiftOver": F.col("original_build") != target}
    )


def translate_ids_snp(df: DataFrame, panel: DataFrame, column: str = "SNPID", to: str = "SNP") -> DataFrame:
    """RSID of a SNPID, or the SNPID itself when the panel lacks it."""
    ids = panel.groupBy(F.col("SNPID").alias("_id")).agg(F.min("RSID").alias("_rs"))
    return (
        df.withColumn("_key", spread_nulls(F.col(column)))
        .join(ids, F.col("_key") == F.col("_id"), "left")
        .withColumn(to, F.coalesce("_rs", column))
        .drop("_id", "_rs", "_key")
    )


def _orientation(a1: Column, a2: Column, ref: Column, alt: Column) -> Column:
    """1 when (a1, a2) reads (alt, ref) on either strand, -1 when swapped, else null."""
    c1, c2 = complement(a1), complement(a2)
    same = ((a1 == alt) & (a2 == ref)) | ((c1 == alt) & (c2 == ref))
    swap = ((a1 == ref) & (a2 == alt)) | ((c1 == ref) & (c2 == alt))
    return F.when(same, 1).when(swap, -1)


def harmonise_z_to_ref(
    z: DataFrame, panel: DataFrame, by: tuple[str, ...] = ("dataset",), id_col: str = "RSID"
) -> DataFrame:
    """z-scores oriented to the reference alleles.

    Ids seen more than once in a study, strand-ambiguous pairs and alleles that fit
    the reference in no way are dropped.
    """
    once = (
        z.groupBy(*by, id_col)
        .agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in ("A1", "A2", "z")])
        .filter("_n = 1")
    )
    ref = panel.select(id_col, "REF", "ALT")
    sign = _orientation(F.col("A1"), F.col("A2"), F.col("REF"), F.col("ALT"))
    return (
        once.join(ref, id_col)
        .filter(~strand_ambiguous(F.col("REF"), F.col("ALT")))
        .withColumn("_s", sign)
        .filter(F.col("_s").isNotNull())
        .select(
            *by, F.col(id_col).alias("id"), F.col("ALT").alias("A1"), F.col("REF").alias("A2"),
            (F.col("z") * F.col("_s")).alias("z"),
        )
    )


def harmonise_weights(
    weights: DataFrame, panel: DataFrame, z: DataFrame, id_col: str = "RSID", by: tuple[str, ...] = ()
) -> DataFrame:
    """Weights on panel alleles, for variants with a z-score; ambiguous ones out.

    With `by` each study keeps the weights of its own variants, and its columns come first.
    """
    sign = _orientation(F.col("alt"), F.col("ref"), F.col("_REF"), F.col("_ALT"))
    ref = panel.select(
        F.col(id_col).alias("id"), F.col("REF").alias("_REF"), F.col("ALT").alias("_ALT")
    )
    return (
        weights.join(ref, "id")
        .filter(~strand_ambiguous(F.col("_REF"), F.col("_ALT")))
        .join(z.select(*by, "id").distinct(), "id")
        .withColumn("_s", sign)
        .filter(F.col("_s").isNotNull())
        .withColumns(
            {"weight": F.col("weight") * F.col("_s"), "ref": F.col("_REF"), "alt": F.col("_ALT")}
        )
        .select(*by, *weights.columns)
    )


def qtl_convert_id(qtl: DataFrame, panel: DataFrame) -> DataFrame:
    """QTL rows whose SNPID the panel knows, with its RSID as `varID`."""
    ids = panel.groupBy("SNPID").agg(F.min("RSID").alias("varID"))
    return qtl.join(ids, "SNPID")


# --- statistics and the standard protocol -----------------------------------


def recover_stats(df: DataFrame, legacy_sign: bool = False) -> DataFrame:
    """Add each of BETA, Z, SE that is absent and computable; two passes.

    Z from P uses the upper quantile, so it has the sign of BETA; `legacy_sign`
    gives the opposite one.
    """
    absent = [c for c in ("BETA", "Z", "SE") if c not in df.columns]
    for c in absent * 2:
        have = set(df.columns)
        if c in have:
            continue
        if c == "BETA" and "OR" in have:
            df = df.withColumn("BETA", beta_from_or("OR"))
        elif c == "Z" and {"BETA", "SE"} <= have:
            df = df.withColumn("Z", z_from_beta_se())
        elif c == "Z" and {"P", "BETA"} <= have and "SE" not in have:
            df = df.withColumn("Z", z_from_p("P", "BETA", legacy_sign))
        elif c == "SE" and {"Z", "BETA"} <= have:
            df = df.withColumn("SE", se_from_beta_z())
    return df


def dedupe_lowest_p(df: DataFrame) -> DataFrame:
    """Rows equal but for P become one with the lowest P."""
    others = [c for c in df.columns if c != "P"]
    return df.groupBy(*others).agg(F.min("P").alias("P")).select(*df.columns)


def polish(df: DataFrame, panel: Panel, first: tuple[str, ...] = ("dataset", "disease")) -> DataFrame:
    """Ids, effect signs, risk alleles, lowest-P duplicates, column order.

    Rows are not globally sorted here: `genome_sort` or the partitioned sink does it
    where an order is wanted.
    """
    had_ids = "RSID" in df.columns
    df = df.filter(F.col("P").isNotNull()).withColumn("SNPID", snpid())
    df = _annotated(df, panel, distinct=had_ids)
    flipped = F.col("Notes").isin(*FLIP_NOTES)
    for c in ("BETA", "Z"):
        if c in df.columns:
            df = df.withColumn(c, F.when(flipped, -F.col(c)).otherwise(F.col(c)))
    if "AF" in df.columns:
        df = df.withColumn("AF", F.when(flipped, 1 - F.col("AF")).otherwise(F.col("AF")))
    sign = next((F.col(c) for c in ("BETA", "Z") if c in df.columns), None)
    if sign is None:
        null = F.lit(None).cast("string")
        df = df.withColumns({"RA": null, "NRA": null})
    else:
        ra, nra = risk_alleles(sign)
        df = df.withColumns({"RA": ra, "NRA": nra})
    order = [c for c in [*first, *clean.INFO, *clean.STATS, *clean.EXTRA] if c in df.columns]
    return dedupe_lowest_p(df.drop("REF", "ALT")).select(*order)


def standardise(
    df: DataFrame, panel: Panel, kind: str = "sumstats", legacy_sign: bool = False
) -> DataFrame:
    """Coordinates, alleles, statistics, polish. `kind` is sumstats or catalog.

    A panel that is used often is stored first (`store_panel`), and then not grouped or moved again.

    Catalog cells write exponents as `2E-8`, so their statistics are cast before the
    text rules apply.
    """
    df = clean.with_missing(df, {"NEA": "string", "EA": "string"})
    missing = [c for c in ("Chromosome", "Position", "P") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    catalog = kind == "catalog"
    if catalog:
        stats = [c for c in clean.STATS_PROGRAM if c in df.columns]
        df = df.withColumns({c: F.col(c).try_cast("double") for c in stats})
    lookup = (lambda d: recover_coords_by_rsid(d, panel)) if catalog and "RSID" in df.columns else None
    df = clean.sanitize(df, clean.COORDINATE_PROGRAM, lookup, dropna=True)
    if lookup:
        # the recovery deals all rows up to three times: its shuffle files go before the next steps write theirs
        df = settle(df)
        release(df.sparkSession)
    df = clean.sanitize(
        df, clean.ALLELE_PROGRAM, lambda d: HARMONISERS[kind](d, panel, distinct=False), dropna=True
    )
    program = [c for c in clean.STATS_PROGRAM if c in df.columns]
    recover = None if catalog else (lambda d: recover_stats(d, legacy_sign))
    df = clean.sanitize(df, program, recover)
    return polish(df, panel)

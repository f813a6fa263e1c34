"""Linkage between variants from hard-call genotypes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.frames import point_in_interval
from varloom.sources.sinks import settle

WORD = 63


# donors of one numbering shard, unless the shards are given
SHARD_DONORS = 4096

# donors up to which their numbers are carried to the genotypes
CARRIED_DONORS = 131_072


def genotype_words(genotypes: DataFrame, shards: int | None = None) -> DataFrame:
    """Pack donors into words of 63: bit masks of observed, dosage 1 and dosage 2.

    One row per variant, population and word replaces 63 genotype rows, and the masks
    are built with a map-side combined bit_or. Donors are numbered inside hash shards,
    so numbering never gathers all of them; there are as many shards as the donors need,
    because a shard ends in a word that is not full. The numbers go to the genotypes, or both
    are dealt by donor if there are many: genotypes never pass through the driver, whatever
    size Spark takes them for.
    """
    donors = settle(genotypes.select("population", "donor").distinct())
    many = donors.count()
    if shards is None:
        shards = 1 + many // SHARD_DONORS
    donors = donors.withColumn("_shard", F.pmod(F.xxhash64("donor"), F.lit(shards)).cast("int"))
    slot = F.row_number().over(Window.partitionBy("population", "_shard").orderBy("donor")) - 1
    donors = donors.withColumn("_slot", slot).select(
        "population", "donor", "_shard", F.floor(F.col("_slot") / WORD).cast("int").alias("_word"),
        (F.col("_slot") % WORD).cast("int").alias("_bit"),
    ).hint("broadcast" if many <= CARRIED_DONORS else "merge")
    mask = F.expr("shiftleft(1L, _bit)")
    zero = F.lit(0).cast("long")

    def packed(cond: Column) -> Column:
        return F.bit_or(F.when(cond, mask).otherwise(zero))

    return (
        genotypes.filter(F.col("dosage").isNotNull())
        .join(donors, ["population", "donor"])
        .groupBy("population", "Chromosome", "Position", "SNPID", "_shard", "_word")
        .agg(
            packed(F.lit(True)).alias("obs"),
            packed(F.col("dosage") == 1).alias("one"),
            packed(F.col("dosage") == 2).alias("two"),
        )
    )


def _word_arrays(words: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """One row per `keys` with its words as arrays `obs`, `one` and `two`, and their length.

    All arrays list the same words in one order; a word in which a variant has no call is zero.
    """
    per = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_shard", "_word", "obs", "one", "two"))).alias("_w"))
    per = settle(per)
    # as many rows as there are words of donors
    slots = [tuple(r) for r in per.select(F.explode("_w").alias("w")).select("w._shard", "w._word").distinct().orderBy("_shard", "_word").collect()]
    kind = dict(per.dtypes)["_w"]
    blank = F.array(*[F.struct(*[F.lit(x).cast(t).alias(n) for x, t, n in zip((s, w, 0, 0, 0), ("int", "int", "long", "long", "long"), ("_shard", "_word", "obs", "one", "two"))]) for s, w in slots]) if slots else F.array().cast(kind)

    def fill(b: Column) -> Column:
        own = F.filter("_w", lambda w: (w["_shard"] == b["_shard"]) & (w["_word"] == b["_word"]))
        return F.coalesce(F.get(own, 0), b)

    full = F.when(F.size("_w") == len(slots), F.col("_w")).otherwise(F.transform(blank, fill))
    out = per.select(*keys, full.alias("_w"))
    return out.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in ("obs", "one", "two")]), len(slots)


# donor words up to which a pair's sums are written out one by one
UNROLL = 8


def _shared(width: int, *parts: tuple[int, tuple[str, str]]) -> Column:
    """Sum over all words of the weighted numbers of donors that both masks hold."""

    def both(part: tuple[int, tuple[str, str]], k: Column) -> Column:
        f, (a, b) = part
        return F.bit_count(F.get(a, k).bitwiseAND(F.get(b, k))) * f

    def at(k: Column) -> Column:
        return sum((both(p, k) for p in parts[1:]), both(parts[0], k))

    if width > UNROLL:
        return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0), lambda s, k: s + at(k)).cast("double")
    terms = [at(F.lit(k)) for k in range(width)] or [F.lit(0)]
    while len(terms) > 1:  # a flat tree
        terms = [sum(terms[i + 1 : i + 2], terms[i]) for i in range(0, len(terms), 2)]
    return terms[0].cast("double")


def _pair_sums(width: int) -> dict[str, Column]:
    """Donors with both calls and the sums of a pair: the lead has masks _o, _a, _b, the other obs, one, two."""
    return {
        "n": _shared(width, (1, ("_o", "obs"))),
        "sx": _shared(width, (1, ("_a", "obs")), (2, ("_b", "obs"))),
        "sy": _shared(width, (1, ("_o", "one")), (2, ("_o", "two"))),
        "sxx": _shared(width, (1, ("_a", "obs")), (4, ("_b", "obs"))),
        "syy": _shared(width, (1, ("_o", "one")), (4, ("_o", "two"))),
        "sxy": _shared(width, (1, ("_a", "one")), (2, ("_a", "two")), (2, ("_b", "one")), (4, ("_b", "two"))),
    }


def _pair_r2() -> Column:
    cov = F.expr("n * sxy - sx * sy")
    return F.try_divide(cov * cov, F.expr("(n * sxx - sx * sx) * (n * syy - sy * sy)"))


def ld_pairs(genotypes: DataFrame, leads: DataFrame, window: int = 250_000, shards: int | None = None) -> DataFrame:
    """r2 of each lead with every variant within +-window, per population, and its donors `n`.

    Donors missing either genotype are left out of a pair. A variant of a population is one row
    with its donor words. Leads are replicated to the window-sized bins they reach, so the pair
    join is an equi-join on (population, chromosome, bin); a pair is made once, its counts are
    popcounts and its r2 is computed in place, so no table of pairs is shuffled. Only ids that
    stand for several sites have their pairs summed over these.
    """
    site = ["population", "Chromosome", "Position", "SNPID"]
    arrays, width = _word_arrays(genotype_words(genotypes, shards), site)
    span = max(int(window), 1)
    place = F.struct("Chromosome", "Position")
    many = settle(arrays.groupBy("SNPID").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi")).filter("_lo <> _hi").select(F.col("SNPID").alias("_id")))
    repeats = not many.isEmpty()
    if repeats:
        again = F.col("SNPID").eqNullSafe(F.col("_id"))
        arrays = arrays.join(many.withColumn("_many", F.lit(True)), again, "left").drop("_id").fillna(False, subset=["_many"])
    else:
        arrays = arrays.withColumn("_many", F.lit(False))
    lead = arrays.join(leads.select("SNPID").distinct(), "SNPID", "left_semi").select(
        "population", "Chromosome", F.col("SNPID").alias("Lead"), F.col("_many").alias("_again"),
        F.col("Position").alias("_lp"), F.col("obs").alias("_o"), F.col("one").alias("_a"), F.col("two").alias("_b"),
        F.explode(
            F.sequence(F.floor((F.col("Position") - span) / span), F.floor((F.col("Position") + span) / span))
        ).alias("_bin"),
    )
    other = arrays.withColumn("_bin", F.floor(F.col("Position") / span)).withColumnRenamed("SNPID", "LD")
    # few bytes make many pairs: as many tasks as the session sets, and not as the bytes suggest
    cell = ["population", "Chromosome", "_bin"]
    other = other.repartition(int(genotypes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)
    pairs = lead.join(other, cell).filter(F.abs(F.col("Position") - F.col("_lp")) <= span)
    sums = _pair_sums(width)

    def made(rows: DataFrame) -> DataFrame:
        return rows.select("Lead", "LD", "population", *[c.alias(k) for k, c in sums.items()])

    out = made(pairs.filter(~F.col("_again") & ~F.col("_many")))
    if repeats:
        names = ["Lead", "LD", "population"]
        summed = made(pairs.filter(F.col("_again") | F.col("_many"))).groupBy(*names).agg(*[F.sum(k).alias(k) for k in sums])
        out = out.unionByName(summed)
    return out.select("Lead", "LD", "population", _pair_r2().alias("r2"), "n").filter(F.col("r2").isNotNull())


def genetic_position(variants: DataFrame, gmap: DataFrame, width: int = 1_000_000) -> DataFrame:
    """`variants` with cM, interpolated between the points of a map (Chromosome, Position, cM).

    Before the first point of a chromosome and after its last one the value of that point holds;
    a chromosome without points gets null. Of points at one place the highest counts.
    """
    points = gmap.groupBy("Chromosome", "Position").agg(F.max("cM").alias("cM"))
    # a map has some ten thousand points a chromosome
    order = Window.partitionBy("Chromosome").orderBy("Position")
    spans = points.select(
        F.col("Chromosome").alias("_mc"), F.col("Position").alias("_p0"), F.col("cM").alias("_c0"),
        F.lead("Position").over(order).alias("_p1"), F.lead("cM").over(order).alias("_c1"),
    ).withColumn("_pe", F.coalesce(F.col("_p1") - 1, F.col("_p0")))
    ends = points.groupBy(F.col("Chromosome").alias("_ec")).agg(F.min("Position").alias("_lo"), F.max("Position").alias("_hi"))
    placed = variants.join(ends, F.col("Chromosome") == F.col("_ec"), "left").withColumn(
        "_at", F.least(F.greatest("Position", "_lo"), F.col("_hi"))
    )
    spans = spans.withColumnRenamed("_mc", "_ec")
    out = point_in_interval(placed, spans, width, keys=("_ec",), pos="_at", start="_p0", end="_pe", how="left")
    step = (F.col("_at") - F.col("_p0")) * (F.col("_c1") - F.col("_c0")) / (F.col("_p1") - F.col("_p0"))
    return out.withColumn("cM", F.col("_c0") + F.coalesce(step, F.lit(0.0))).drop("_ec", "_lo", "_hi", "_at", "_p0", "_c0", "_p1", "_c1", "_pe")


def pack_variants(genotypes: DataFrame, population: str, shards: int = 1) -> DataFrame:
    """One row a variant of one population: its donor words as arrays, and its allele frequency.

    The population is filtered before packing. All arrays list the same words in one order; a word in
    which a variant has no call is zero.
    """
    words = genotype_words(genotypes.filter(F.col("population") == population), shards)
    out, _ = _word_arrays(words, ["Chromosome", "Position", "SNPID"])
    count = {c: F.aggregate(F.transform(c, F.bit_count), F.lit(0), lambda a, x: a + x) for c in ("obs", "one", "two")}
    return out.withColumn("AF", F.try_divide(count["one"] + 2 * count["two"], 2 * count["obs"]))


def windowed_scores(
    packed: DataFrame, values: DataFrame, labels: list[str], reach: float = 1.0, correct: bool = True,
) -> DataFrame:
    """(Lead, l2_<label>...): for every variant the sum of r2 * value over the variants within `reach` cM.

    `packed` has SNPID, Chromosome, cM and the donor words; `values` is (LD, label, value) and absent
    ones are 0. With `correct`, r2 is lowered by (1 - r2) / (n - 2) with the donors n that both
    variants have, and pairs of two donors or fewer are left out. Every variant is a lead; those
    whose genotype is constant or unplaced get no row.

    The map is cut into tiles of `reach`: a lead goes to its tile and the two beside it, a neighbour has
    one. A pair is made once and summed on the map side, and no table of pairs is written or shuffled.
    Tables with a row a variant are dealt: few bytes in files are many in memory, too many to broadcast.
    """
    per = values.groupBy(F.col("LD").alias("_v")).agg(
        *[F.sum(F.when(F.col("label") == x, F.col("value"))).cast("double").alias(f"_y{i}") for i, x in enumerate(labels)]
    ).hint("merge")
    first = packed.select(F.size("obs").alias("n")).first()
    width = first["n"] if first else 0
    tile = F.floor(F.col("cM") / reach).cast("long")
    placed = packed.filter("cM is not null")
    lead = placed.select(
        F.col("Chromosome").alias("_c"), F.col("SNPID").alias("Lead"), F.col("cM").alias("_cm"),
        F.col("obs").alias("_o"), F.col("one").alias("_a"), F.col("two").alias("_b"),
        F.explode(F.array(tile - 1, tile, tile + 1)).alias("_t"),
    )
    other = placed.join(per, F.col("SNPID") == F.col("_v"), "left").withColumn("_tile", tile)
    # few bytes make many pairs: as many tasks as the session sets, and not as the bytes suggest
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    other = other.repartition(parts, "Chromosome", "_tile")
    near = (F.col("_c") == F.col("Chromosome")) & (F.col("_t") == F.col("_tile")) & (F.abs(F.col("cM") - F.col("_cm")) <= reach)
    pairs = lead.hint("merge").join(other, near)

    pairs = pairs.select("Lead", *[f"_y{i}" for i in range(len(labels))], *[c.alias(k) for k, c in _pair_sums(width).items()])
    pairs = pairs.withColumn("r2", _pair_r2()).filter("r2 is not null")
    if correct:
        pairs = pairs.filter("n > 2").withColumn("r2", F.expr("r2 - (1D - r2) / (n - 2)"))
    return pairs.groupBy("Lead").agg(
        *[F.sum(F.col("r2") * F.coalesce(f"_y{i}", F.lit(0.0))).alias(f"l2_{x}") for i, x in enumerate(labels)]
    )


# LD engine registry.
ENGINES: dict[str, Callable[..., DataFrame]] = {"genotypes": ld_pairs}


def ld_merge_populations(ld: DataFrame, populations: list[str], threshold: float = 0.8) -> DataFrame:
    """Pairs at or over the threshold in any population, with every population's r2."""
    wide = ld.groupBy("Lead", "LD").agg(*[F.max(F.when(F.col("population") == p, F.col("r2"))).alias(p) for p in populations])
    any_over = F.greatest(*[F.col(p) for p in populations]) if len(populations) > 1 else F.col(populations[0])
    return wide.filter(any_over >= threshold)


def missing_leads(leads: DataFrame, ld: DataFrame) -> DataFrame:
    """Leads with no pair at all."""
    return leads.select(F.col("SNPID").alias("Lead")).distinct().join(
        ld.select("Lead"), "Lead", "left_anti"
    )


def ld_add_missing(ld: DataFrame, leads: DataFrame, populations: list[str]) -> DataFrame:
    """Leads with no pair become their own proxy with r2 = 1."""
    own = missing_leads(leads, ld).select(
        "Lead", F.col("Lead").alias("LD"), *[F.lit(1.0).alias(p) for p in populations]
    )
    return ld.unionByName(own)


def lead_or_proxy(ld: DataFrame, populations: list[str]) -> DataFrame:
    """Lead rows, then for each proxy that is no lead its pair with the highest r2."""
    lead = ld.filter(F.col("LD") == F.col("Lead"))
    best = F.greatest(*populations) if len(populations) > 1 else F.col(populations[0])
    w = Window.partitionBy("LD").orderBy(F.desc_nulls_last("_max"), "Lead")
    proxies = (
        ld.join(lead.select("LD"), "LD", "left_anti")
        .withColumn("_max", best)
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .drop("_max", "_rn")
    )
    return lead.withColumn("Category", F.lit("Lead")).unionByName(
        proxies.withColumn("Category", F.lit("LD"))
    )


def ld_add_info(ld: DataFrame, gwas: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of the proxy (`GWAS_`) and of the lead (`GWAS_Lead_`), as distinct rows.

    Every column of the three tables is in the result, so its rows are distinct when theirs are; the
    pairs are told apart where the first join needs them.
    """
    by = list(by)
    proxy = gwas.select(*by, "SNPID", F.col("P").alias("GWAS_P"), F.col("BETA").alias("GWAS_BETA"))
    lead = gwas.select(
        *by, F.col("SNPID").alias("Lead"), F.col("P").alias("GWAS_Lead_P"), F.col("BETA").alias("GWAS_Lead_BETA")
    )
    out = ld.withColumnRenamed("LD", "SNPID").repartition(*by, "SNPID").distinct()
    return out.join(proxy.distinct(), [*by, "SNPID"], "left").join(lead.distinct(), [*by, "Lead"], "left")

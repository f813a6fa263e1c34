"""Hand-written cases for single rules."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from varloom.functions import scalars
from varloom.operators import clean, coloc, ingest, intervals, loci, panel, signatures
from varloom.sources import readers


def rows(df):
    return [tuple(r) for r in df.collect()]


ALLELES = [
    ("A", "G", "Found", "A", "G", 1),
    ("G", "A", "Flip", "A", "G", -1),
    ("T", "C", "Complement", "A", "G", 1),
    ("C", "T", "Flip-Complement", "A", "G", -1),
    ("A", None, "Fill", "A", "G", 1),
    (None, "A", "Flip-Fill", "A", "G", -1),
    ("T", None, "Complement-Fill", "A", "G", 1),
    (None, "T", "Flip-Complement-Fill", "A", "G", -1),
    ("A", "C", "Not Found", "A", "C", 1),
]


@pytest.fixture(scope="module")
def panel_ag(spark):
    return spark.createDataFrame(
        [("1", 100, "A", "G", "1:100:A:G", "rs1"), ("1", 200, "A", "T", "1:200:A:T", "rs2")],
        "Chromosome string, Position long, REF string, ALT string, SNPID string, RSID string",
    )


@pytest.mark.parametrize("nea,ea,note,out_nea,out_ea,sign", ALLELES)
def test_alleles(spark, panel_ag, nea, ea, note, out_nea, out_ea, sign):
    df = spark.createDataFrame(
        [("1", 100, nea, ea, 0.01, 0.5, 0.2)], "Chromosome string, Position long, NEA string, EA string, P double, BETA double, AF double"
    )
    (r,) = panel.standardise(df, panel_ag).collect()
    assert (r.Notes, r.NEA, r.EA, r.found) == (note, out_nea, out_ea, note != "Not Found")
    assert r.BETA == 0.5 * sign and r.AF == pytest.approx(0.2 if sign > 0 else 0.8)
    assert r.RA == (out_ea if sign > 0 else out_nea)


def test_palindrome_is_flip(spark, panel_ag):
    df = spark.createDataFrame([("1", 200, "T", "A")], "Chromosome string, Position long, NEA string, EA string")
    assert panel.harmonise_biallelic(df, panel_ag).collect()[0].Notes == "Flip"


def test_both_missing(spark, panel_ag):
    df = spark.createDataFrame([("1", 100, None, None)], "Chromosome string, Position long, NEA string, EA string")
    assert panel.harmonise_biallelic(df, panel_ag).dropna(subset=["NEA", "EA"]).count() == 0
    r = panel.harmonise_multiallelic(df, panel_ag).collect()[0]
    assert (r.Notes, r.NEA, r.EA) == ("Fill", "A", "G")


def test_standardise_twice_is_the_same(spark, panel_ag):
    df = spark.createDataFrame(
        [("chr1", "100.0", n, e, 0.01, 0.5, 0.2) for n, e, *_ in ALLELES],
        "Chromosome string, Position string, NEA string, EA string, P double, BETA double, AF double",
    )
    once = panel.standardise(df, panel_ag).filter("found").drop("Original_RSID", "Notes")
    again = panel.standardise(once, panel_ag).drop("Original_RSID", "Notes")
    assert sorted(map(str, rows(once.distinct()))) == sorted(map(str, rows(again.select(*once.columns))))


def test_chromosome_text(spark):
    texts = ["chrX", "chr7", "7.0", "23", "24", "MT", "chrUn", "X", None, "0", "25"]
    df = spark.createDataFrame([(t,) for t in texts], "Chromosome string")
    assert [r[0] for r in rows(clean.clean_chromosome(df))] == ["X", "7", "7", "X", "Y", "MT", "X", None]


@pytest.mark.parametrize("text,signed,kept", [
    ("1e-5", False, True), ("0.5", False, True), (".5", False, False), ("1e+5", False, False),
    ("-2", False, False), ("-2", True, True), ("+1", True, False), (None, False, True),
])
def test_float_text(spark, text, signed, kept):
    df = spark.createDataFrame([(text,)], "P string")
    assert clean.typed_parse(df, "P", "float", signed).count() == int(kept)


def test_nucleotides_do_not_admit_a_pipe(spark):
    df = spark.createDataFrame([("A|",), ("ACGT",), ("?",)], "EA string")
    assert [r[0] for r in rows(clean.clean_alleles(df))] == ["ACGT", None]


def test_complement(spark):
    df = spark.createDataFrame([("ACGTN-x",)], "a string").select(
        scalars.complement("a").alias("c"), scalars.complement(scalars.complement("a")).alias("cc")
    )
    assert rows(df) == [("TGCANx", "ACGTNx")]


@pytest.mark.parametrize("p", [0.9, 0.5, 0.05, 1e-3, 1e-8, 1e-15])
def test_z_from_p(spark, p):
    df = spark.createDataFrame([(p, -1.0)], "P double, BETA double")
    z, back, legacy = rows(df.select(
        scalars.z_from_p("P", "BETA").alias("z"), scalars.p_from_z("1.5").alias("p"), scalars.z_from_p("P", "BETA", True).alias("l")
    ))[0]
    assert z == pytest.approx(NormalDist().inv_cdf(p / 2), rel=1e-12)
    assert legacy == -z and back == pytest.approx(math.erfc(1.5 / math.sqrt(2)), rel=1e-12)


def test_extreme_p_keeps_a_finite_z(spark):
    z = spark.createDataFrame([(0.0, 1.0), (1e-200, 1.0)], "P double, BETA double").select(scalars.z_from_p("P", "BETA"))
    a, b = (r[0] for r in rows(z))
    assert 37.0 < a < 37.1 and 30.0 < b < 30.4


def test_ids(spark):
    df = spark.createDataFrame([("1_2_A_C", "NK_1_2", "x_3")], "a string, b string, c string").select(
        scalars.ukb_id("a"), scalars.cell_name("b"), scalars.cell_cluster("b"), scalars.category_of_file("c"), scalars.disease_of_file("c")
    )
    assert rows(df) == [("1:2_A_C", "NK", "1_2", 3, "x")]


CLUMP = [(100, 1e-9), (140, 1e-8), (150, 1e-10), (220, 1e-9)]


def test_clump_bounds_are_exclusive(spark):
    df = spark.createDataFrame([("s", "1", p, v) for p, v in CLUMP], "dataset string, Chromosome string, Position long, P double")
    assert sorted(r.Position for r in loci.clump_top(df, 100).collect()) == [100, 150, 220]


def test_no_locus_gives_an_empty_table(spark):
    df = spark.createDataFrame([("s", "1", 5, "a", 0.5)], "dataset string, Chromosome string, Position long, SNPID string, P double")
    out = loci.identify_loci(df)
    assert out.count() == 0 and {"Loci", "Start", "End_"} <= set(out.columns)


def _pairs(spark, n):
    return spark.createDataFrame(
        [("a", "b", "a_b", "1", i, f"s{i}", 0.1 * i + 0.1, 0.01, 0.2, 0.01) for i in range(n)],
        "Feature1 string, Feature2 string, Pair string, Chromosome string, Position long, SNPID string, F1_BETA double, F1_varbeta double, F2_BETA double, F2_varbeta double",
    )


def test_coloc_single_variant(spark):
    (r,) = coloc.coloc_abf(coloc.abf_lbf(_pairs(spark, 1), ("cc", "cc"))).collect()
    assert r.PPH3 == 0 and r.PPH4_PPH3 is None
    assert coloc.filter_coloc(spark.createDataFrame([(0.9, None)], "PPH4 double, PPH4_PPH3 double")).count() == 1


def test_coloc_posteriors_sum_to_one(spark):
    (r,) = coloc.coloc_abf(coloc.abf_lbf(_pairs(spark, 7), ("cc", "cc"))).collect()
    assert sum(r[f"PPH{i}"] for i in range(5)) == pytest.approx(1.0)


def test_coloc_huge_bayes_factors(spark):
    df = _pairs(spark, 4).withColumns({"F1_BETA": F.lit(60.0) + F.col("Position"), "F2_BETA": F.lit(60.0) + F.col("Position")})
    (r,) = coloc.coloc_abf(coloc.abf_lbf(df, ("cc", "cc"))).collect()
    assert r.SNPID == "s3" and sum(r[f"PPH{i}"] for i in range(5)) == pytest.approx(1.0)


def test_liftover_strands(spark):
    chains = spark.createDataFrame(
        [("hg19", "hg38", "1", 100, 200, "1", 1000, 1100, "+"), ("hg19", "hg38", "1", 300, 400, "1", 2000, 2100, "-"),
         ("hg19", "hg38", "2", 0, 100, "3", 0, 100, "+")],
        "src string, dst string, Chromosome string, Start long, End_ long, q_chromosome string, q_start long, q_end long, strand string",
    )
    df = spark.createDataFrame(
        [("1", 150, "A", None), ("1", 300, "A", "C"), ("1", 200, "A", "C"), ("2", 50, "A", "C"), (None, 5, "A", "C")],
        "Chromosome string, Position long, NEA string, EA string",
    )
    got = sorted(((r.Position, r.SNPID) for r in panel.liftover(df, chains, ["hg19", "hg38"]).collect()), key=str)
    assert got == sorted([(1050, "1:1050:A:"), (2099, "1:2099:A:C"), (5, None)], key=str)


def test_shortest_build_path(spark):
    edges = spark.createDataFrame([("hg18", "hg19"), ("hg19", "hg38"), ("hg18", "hg38"), ("hg17", "hg18")], "src string, dst string")
    assert sorted(rows(panel.build_path(spark, edges, "hg38"))) == [
        ("hg17", "hg17>hg18>hg38", 2), ("hg18", "hg18>hg38", 1), ("hg19", "hg19>hg38", 1)
    ]


def test_detect_build_status(spark, panel_ag):
    df = spark.createDataFrame([("a", "1", 100), ("b", None, None)], "dataset string, Chromosome string, Position long")
    got = {r.dataset: (r.build, r.status) for r in panel.detect_build(df, {"hg19": panel_ag, "hg38": panel_ag}).collect()}
    assert got == {"a": ("hg38", "ok"), "b": (None, "no coordinates")}


def test_file_formats():
    assert [readers.file_format(x) for x in ("a.tsv.gz", "b.csv", "c.vcf.bgz")] == ["TSV", "CSV", "VCF"]
    with pytest.raises(ValueError):
        readers.only_match(["a", "ab"], "a")


def test_catalog_cells(spark):
    cols = ["CHR_ID", "CHR_POS", "STRONGEST SNP-RISK ALLELE", "P-VALUE", "OR or BETA", "RISK ALLELE FREQUENCY"]
    df = spark.createDataFrame(
        [("1;2", "5;6", "rs1-A; rs2-?", "1E-9", "0.1;0.2", "NR"), ("", "", "chr7:123", "2E-9", "", "0.3")], cols
    )
    got = [(r.Chromosome, r.Position, r.RSID, r.EA, r.P, r.BETA, r.AF) for r in readers.scan_catalog(df).collect()]
    assert got == [
        ("1", "5", "rs1", "A", "1E-9", "0.1", None), ("2", "6", "rs2", None, "1E-9", "0.2", None),
        ("7", "123", None, None, "2E-9", None, "0.3"),
    ]


def test_catalog_protocol(spark, panel_ag):
    cols = ["CHR_ID", "CHR_POS", "STRONGEST SNP-RISK ALLELE", "P-VALUE", "OR or BETA", "RISK ALLELE FREQUENCY"]
    df = spark.createDataFrame(
        [("", "", "rs1-G", "2E-8", "0.3", "0.4"), ("1", "200", "rs2-?", "3E-9", "", "NR"), ("", "", "rs9-A", "1E-9", "0.1", "0.2")], cols
    )
    got = {r.SNPID: (r.P, r.Notes, r.RSID, r.Original_RSID) for r in panel.standardise(readers.scan_catalog(df), panel_ag, "catalog").collect()}
    assert got == {"1:100:A:G": (2e-8, "Fill", "rs1", "rs1"), "1:200:A:T": (3e-9, "Fill", "rs2", "rs2")}


def test_canon_columns_takes_the_first_filled_alias(spark):
    df = spark.createDataFrame([(None, "7", 5), (None, "8", 6)], "Chr string, CHROM string, BP long")
    assert rows(ingest.canon_columns(df)) == [("7", 5), ("8", 6)]


def test_interval_flag_rejects_clashes(spark):
    df = spark.createDataFrame([("1", 5)], "Chromosome string, Position long")
    with pytest.raises(ValueError):
        intervals.interval_flag(df, df, ["base"])


def test_bh(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, 0.01]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = {r.i: r.p_adj for r in signatures.bh_adjust(df).collect()}
    order = sorted(range(6), key=lambda i: ps[i])
    best, want = 1.0, {}
    for rank in range(6, 0, -1):
        i = order[rank - 1]
        best = min(best, ps[i] * 6 / max(sum(q <= ps[i] for q in ps), rank))
        want[i] = best
    assert got == pytest.approx(want)


def _t_tail(t, df, steps=200_000):
    """Two-sided tail by integrating the density over the angle."""
    theta = math.atan(t / math.sqrt(df))
    h = (math.pi / 2 - theta) / steps
    area = sum(math.cos(theta + (i + 0.5) * h) ** (df - 1) for i in range(steps)) * h
    return area * 2 * math.gamma((df + 1) / 2) / (math.sqrt(math.pi) * math.gamma(df / 2))


@pytest.mark.parametrize("t,df", [(2.0, 1), (2.0, 2), (2.5, 7), (1.3, 18), (3.1, 33)])
def test_student_t(spark, t, df):
    out = spark.range(1).select(signatures.t_two_sided(F.lit(t), F.lit(df).cast("long"))).collect()[0][0]
    assert out == pytest.approx(_t_tail(t, df), rel=1e-6)


def test_hypergeometric_tail(spark):
    mk = lambda xs: spark.createDataFrame([(f"g{i}",) for i in xs], "gene string")
    r = signatures.set_overlap_test(mk(range(8)), mk(range(5, 15)), mk(range(40))).collect()[0]
    want = sum(math.comb(8, k) * math.comb(32, 10 - k) for k in range(3, 9)) / math.comb(40, 10)
    assert (r.n_a, r.n_b, r.n_both) == (8, 10, 3) and r.p == pytest.approx(want)

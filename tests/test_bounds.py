"""Rules past their old bounds: caps, clamps and nulls."""

import math

import pytest
from pyspark.sql import functions as F

from varloom.functions import scalars
from varloom.operators import cells, expression, finemap, heritability, overlap, panel, signatures


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_three_criteria_rows(spark):
    sheet = spark.createDataFrame([("keep", "1;2"), ("discard", "2"), ("discard", "9")], "action string, cluster string")
    assert len(cells.parse_criteria(sheet)) == 3


def test_vectors_are_as_long_as_the_gene_table_and_hold_every_cell(spark):
    genes = spark.createDataFrame([(f"g{k}", k) for k in range(1, 151)], "gene string, rank int")
    values = spark.createDataFrame([("a", "g150", 2.0), ("a", "g1", 1.0), ("b", "other", 3.0)], "cell string, gene string, value double")
    everyone = spark.createDataFrame([("a",), ("b",), ("c",)], "cell string")
    got = {r.cell: r.features.toArray() for r in expression.cell_vectors(values, genes, everyone).collect()}
    assert set(got) == {"a", "b", "c"} and all(len(v) == 150 for v in got.values())
    assert got["a"][149] == 2.0 and got["a"].sum() == 3.0 and got["c"].sum() == 0


def test_a_chain_of_twelve_builds(spark):
    edges = spark.createDataFrame([(f"b{k:02}", f"b{k + 1:02}") for k in range(12)], "src string, dst string")
    got = dict((r[0], r[2]) for r in rows(panel.build_path(spark, edges, "b12")))
    assert got == {f"b{k:02}": 12 - k for k in range(12)}
    assert panel.build_path(spark, edges, "b12", max_depth=3).count() == 3


def test_logit_of_small_shares_and_of_none(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.0,), (None,)], "p double")
    got = [r[0] for r in df.select(scalars.logit("p")).collect()]
    assert got[0] == pytest.approx(math.log(0.01 / 0.99)) and got[1] == pytest.approx(math.log(0.02 / 0.98))
    assert got[2] == pytest.approx(math.log(0.025 / 0.975)) and got[3] is None
    all_in = [r[0] for r in df.select(scalars.logit("p", F.lit(True))).collect()]
    assert all_in[0] == pytest.approx(math.log(0.0345 / 0.9655))


def test_a_null_is_no_bound(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1e-30,), (0.1,)], "p double")
    assert [r[0] for r in df.select(scalars.neg_log10("p", 10)).collect()] == [None, 10.0, 10.0, 1.0]
    assert [r[0] for r in df.select(scalars.clamp("p", 0.05, 0.08)).collect()] == [None, 0.05, 0.05, 0.08]


def test_egene_cells_without_an_egene(spark):
    df = spark.createDataFrame([("g", "x", 0.0, True), ("g", "y", 0.5, False), ("h", "y", 0.01, True)], "gene string, id string, FDR double, is_egene boolean")
    assert sorted(rows(overlap.egene_matrix(df, ["x", "y"]))) == [("g", 10.0, None), ("h", None, 2.0)]


def test_letters_past_z(spark):
    df = spark.createDataFrame([(f"2020-{m:02}-{d:02}", f"{m};{d}") for m in (1, 2) for d in range(1, 15)], "day string, ids string")
    got = {r.day: r for r in cells.harmonise_batches(df, "day", "ids").collect()}
    assert [got[d].day_code for d in sorted(got)][24:28] == ["Y", "Z", "AA", "AB"]
    assert got["2020-02-14"].ids_code == "2;14"
    one = spark.createDataFrame([(702,), (703,)], "n int").select(cells.letters(F.col("n")))
    assert [r[0] for r in one.collect()] == ["ZZ", "AAA"]


def test_gene_z_of_a_study_that_lacks_a_variant(spark):
    w = spark.createDataFrame([("g", "t", "c", "a", 1.0), ("g", "t", "c", "b", 1.0)], "gene string, type string, context string, id string, weight double")
    z = spark.createDataFrame([("s1", "a", 3.0), ("s2", "a", 3.0), ("s2", "b", 3.0)], "dataset string, id string, z double")
    ld = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "b", 1.0)], "id1 string, id2 string, r double")
    got = {r.dataset: r.z for r in finemap.gene_z(w, z, ld).collect()}
    assert got == {"s1": pytest.approx(3.0), "s2": pytest.approx(6 / math.sqrt(3))}


def test_ld_score_uses_the_donors_of_each_pair(spark):
    ld = spark.createDataFrame([("a", "a", 1.0, 28.0), ("a", "b", 0.5, 12.0), ("a", "c", 1.0, 2.0)], "Lead string, LD string, r2 double, n double")
    annot = spark.createDataFrame([(x, "base", 1) for x in "abc"], "LD string, label string, value int")
    assert rows(heritability.ld_score(ld, annot, ["base"])) == [("a", pytest.approx(1.0 + 0.5 - 0.5 / 10))]


def test_cells_without_signature_genes_score_zero(spark):
    counts = spark.createDataFrame([("a", "g1", 2.0), ("b", "g2", 1.0)], "cell string, gene string, value double")
    everyone = spark.createDataFrame([("a",), ("b",), ("c",)], "cell string")
    sets = spark.createDataFrame([("s", "g1")], "signature string, gene string")
    got = dict((r.cell, r.score) for r in signatures.module_score(counts, sets, everyone, bins=2).collect())
    assert set(got) == {"a", "b", "c"} and got["c"] == 0.0


def test_control_genes_are_drawn_for_each_signature_gene(spark):
    genes = [f"g{k:03}" for k in range(60)]
    counts = spark.createDataFrame([("a", g, 1.0 + k / 1000) for k, g in enumerate(genes)], "cell string, gene string, value double")
    sets = spark.createDataFrame([("s", "g000"), ("s", "g001")], "signature string, gene string")
    one = signatures.module_score(counts, sets.limit(1), bins=1, controls=5).first().score
    two = signatures.module_score(counts, sets, bins=1, controls=5).first().score
    assert one != two and abs(two) < 0.06


@pytest.mark.parametrize("size", [12, 490])
def test_random_sets_have_their_size(spark, size, monkeypatch):
    ranks = spark.createDataFrame([("t", f"g{k}", k, float(k)) for k in range(1, 501)], "cluster string, gene string, rank int, metric double")
    sets = spark.createDataFrame([("s", f"g{k}") for k in range(1, size + 1)], "signature string, gene string")
    seen = []
    real = signatures._es

    def spy(hits, keys):
        if "_perm" in keys:
            seen.append(hits.groupBy("_perm").count().select("count").distinct().collect())
        return real(hits, keys)

    monkeypatch.setattr(signatures, "_es", spy)
    out = signatures.gsea_test(ranks, sets, nperm=40)
    assert out.count() == 1 and [r[0] for r in seen[0]] == [size]

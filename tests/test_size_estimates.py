"""Rows that are few bytes in a file and many in memory don't pass through the driver."""

import datetime

import pytest
from pyspark.sql import functions as F

from varloom.operators import heritability, ld
from varloom.plans import checks_heritability
from varloom.plans.registry import Inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def genotypes(spark):
    rows = spark.range(40).withColumn("donor", F.explode(F.sequence(F.lit(0), F.lit(27))))
    return rows.select(
        "donor", F.lit("EUR").alias("population"), F.lit("1").alias("Chromosome"), (F.col("id") * 500).alias("Position"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("SNPID"), ((F.col("id") * F.col("donor")) % 3).cast("int").alias("dosage"),
    )


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(2020, 1, 1)
    spark.createDataFrame([(i, 1 + i % 20) for i in range(60)], "p_partkey long, p_size int").write.parquet(f"{at}/part.parquet")
    lines = [
        (i, i % 60, i % 7, 1 + i % 3, float(1 + i % 50), 1.0, (i % 11) / 100, (i % 9) / 100, "AN"[i % 2], "FO"[i % 2], day) for i in range(400)
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).write.parquet(f"{at}/lineitem.parquet")
    return Inputs(spark, at)


def test_genotypes_are_not_broadcast(inputs):
    # donors are on the right, and the choice isn't left to estimates
    words = ld.genotype_words(inputs.genotypes.filter("population = 'EUR'"), 1)
    assert "rightHint=(strategy=broadcast)" in words._jdf.queryExecution().optimizedPlan().toString()
    assert "BuildLeft" not in plan(words)


def test_many_donors_are_dealt(genotypes, monkeypatch):
    words = sorted(map(tuple, ld.genotype_words(genotypes, 1).collect()))
    monkeypatch.setattr(ld, "CARRIED_DONORS", 3)
    dealt = ld.genotype_words(genotypes, 1)
    assert "Broadcast" not in plan(dealt) and sorted(map(tuple, dealt.collect())) == words


def test_variants_are_not_broadcast(genotypes):
    packed = ld.settle(ld.pack_variants(genotypes, "EUR").withColumn("cM", F.col("Position") / 4000))
    annot = ld.settle(packed.select(F.col("SNPID").alias("LD"), F.lit("base").alias("label"), F.lit(1).alias("value")))
    assert "Broadcast" not in plan(ld.windowed_scores(packed, annot, ["base"]))
    assert "Broadcast" not in plan(heritability.annotation_counts(packed, annot, {"base": ["base"]}))


def test_scores_meet_the_studies_without_a_broadcast(inputs):
    scores = ld.settle(inputs.panel.select(F.col("SNPID").alias("Lead"), F.lit(1.0).alias("base")))
    rows = checks_heritability._z_rows(inputs, scores)
    assert "Broadcast" not in plan(rows) and rows.count() > 0


@pytest.mark.parametrize("name", ["qtl", "sumstats"])
def test_a_dealt_view_has_the_same_rows(inputs, name):
    usual, dealt = getattr(inputs, name), inputs.dealt(name)
    assert "Broadcast" not in plan(dealt) and "Broadcast" in plan(usual)
    assert sorted(map(str, usual.collect())) == sorted(map(str, dealt.collect()))

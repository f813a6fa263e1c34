"""A stored panel gives the results of the plain one, and is not moved by joins."""

import pytest
from pyspark.sql import functions as F

from varloom.operators import panel


@pytest.fixture(scope="module")
def sites(spark):
    rows = [(str(k % 3 + 1), 100 + k // 2, "A", "CGT"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "Chromosome string, Position long, REF string, ALT string")
    return df.withColumns({"SNPID": F.concat_ws(":", "Chromosome", "Position", "REF", "ALT"), "RSID": F.concat(F.lit("rs"), "Position", F.lit("_"), "Chromosome")})


@pytest.fixture(scope="module")
def stored(sites):
    return panel.store_panel(sites, 8)


@pytest.mark.parametrize("kind", ["sumstats", "catalog"])
def test_same_results(spark, sites, stored, kind):
    rows = [(None if k % 7 == 0 else str(k % 3 + 1), None if k % 5 == 0 else 100 + k // 2, f"rs{100 + k // 2}_{k % 3 + 1}", "A" if k % 2 else None, "CGTA"[k % 4], 0.01 * (k % 9), 0.5 - k % 2, 0.1)
            for k in range(80)] + [(None, None, None, "A", "C", 0.1, 0.2, 0.1)]
    df = spark.createDataFrame(rows, "Chromosome string, Position long, RSID string, NEA string, EA string, P double, BETA double, SE double")
    plain, kept = (panel.standardise(df, p, kind) for p in (sites, stored))
    assert plain.count() and sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, kept.collect()), key=str)
    again = panel.open_panel(spark, stored.sites.sparkSession.catalog.listTables(pattern="panel_*_sites")[0].name.removesuffix("_sites"))
    assert again.ids.columns == ["SNPID", "RSID"]


def test_the_panel_side_is_not_exchanged(spark, sites, stored):
    df = spark.createDataFrame([("1", 101, "A", "C")], "Chromosome string, Position long, NEA string, EA string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = [panel.harmonise_biallelic(df, p, distinct=False)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for p in (sites, stored)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved[1] == 1 < moved[0]

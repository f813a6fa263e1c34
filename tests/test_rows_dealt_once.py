"""Running sums, ids and regions: rows go to their key once, and tables that several steps read are made once."""

import pytest
from pyspark.sql import functions as F

from tests.test_size_estimates import inputs, plan  # noqa: F401
from varloom.functions.frames import tiled_running
from varloom.operators import finemap, panel
from varloom.plans import checks_traits, registry, views


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_running_sums_of_null_and_repeated_keys(spark, no_broadcast):
    rows = [(k, g, p, v) for k in ("a", None) for g in (1, None) for p, v in ((1, 1), (5, 2), (5, 3), (12, 4), (40, 5))]
    df = spark.createDataFrame(rows, "k string, g int, p int, v int")
    out = tiled_running(df, ["k", "g"], F.floor(F.col("p") / 10), ["p", "v"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, inclusive=False)
    # the tiles are summed, scanned and dealt; the rows are dealt to them and scanned there
    assert out.columns == ["k", "g", "p", "v", "s", "m"] and plan(out).count("Exchange") <= 4
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(k, g, p, v, sum(range(v)), v - 1 or None) for k, g, p, v in rows]
    assert got == sorted(want, key=str)


def test_polish_groups_where_the_ids_are_met(spark, no_broadcast):
    names = "dataset string, Chromosome string, Position long, NEA string, EA string, RSID string, P double, BETA double, Notes string, REF string, ALT string"
    rows = [("S", "1", 5, "A", "C", r, p, 0.5, "Found", "A", "C") for r in ("x", "w") for p in (0.1, 0.2)]
    rows += [("S", None, 5, "A", "C", r, p, 0.5, "Not Found", None, None) for r in ("x", "w", None) for p in (0.1, 0.2)]
    rows += [("S", None, 5, "A", "G", "x", 0.3, 0.5, "Not Found", None, None)] * 2
    known = spark.createDataFrame([("1", 5, "A", "C", "1:5:A:C", "rs1")], "Chromosome string, Position long, REF string, ALT string, SNPID string, RSID string")
    out = panel.polish(spark.createDataFrame(rows, names), known)
    got = sorted(map(tuple, out.select("SNPID", "EA", "RSID", "Original_RSID", "P").collect()), key=str)
    # a row for each variant and original id that is left, with its lowest P
    assert got == sorted([("1:5:A:C", "C", "rs1", "w", 0.1), (None, "C", None, "w", 0.1), (None, "G", None, "x", 0.3)], key=str)
    # the rows, and the ids of the panel
    assert plan(out).count("Exchange") == 2


@pytest.mark.parametrize("name", ["region_pip", "screen_regions", "region_screen_table", "region_pip_fitted"])
def test_regions_are_made_once(inputs, monkeypatch, name):  # noqa: F811
    made = []
    load = views.load

    def counted(spark, at, what, *a, **k):
        made.append(what)
        return load(spark, at, what, *a, **k)

    monkeypatch.setattr(views, "load", counted)
    monkeypatch.setattr(registry, "load", counted)
    out = registry.QUERIES[name](inputs.spark, inputs.sf_dir)
    assert made.count("region_z") == 1
    # no step of the frame makes the rows again
    assert "l_partkey" not in plan(out)


def test_rows_without_a_region_are_in_none(spark):
    rows = [("SNP" if i % 3 else "g", f"r{i % 5}" if i % 5 else None, float(i % 7)) for i in range(200)]
    schema = "grp string, region_id string, z double"
    options = {"min_group_size": 1, "iters": 5, "min_p_single": 0.0}
    got = finemap.est_group_prior(spark.createDataFrame(rows, schema), **options).collect()
    assert got == finemap.est_group_prior(spark.createDataFrame([r for r in rows if r[1]], schema), **options).collect()


def test_screened_rows_are_read_from_one_table(spark):
    df = spark.createDataFrame([("a", "g", "x", 0.6), ("a", "SNP", "y", 0.2), ("b", "g", "z", 0.1)], "region_id string, grp string, id string, pip double")
    out = finemap.screen_regions(df)
    assert "settled" in plan(out) and sorted(r.id for r in out.collect()) == ["x", "y"]


def test_one_region_z(spark, inputs):  # noqa: F811
    assert sorted(map(str, checks_traits._region_z(inputs).collect())) == sorted(map(str, inputs.region_z.collect()))

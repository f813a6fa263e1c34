"""Module scores sum in a cell's own array."""

import re

from varloom.operators import signatures

COUNTS = [
    (1, "a", 2.0), (1, "b", 3.0), (1, "b", 1.0), (2, "c", 4.0), (2, "a", None), (3, "x", 9.0), (3, None, 5.0), (None, "a", 7.0), (4, "d", 1.0),
]
SETS = [("S", "a"), ("S", "b"), ("T", "c"), ("T", "c"), (None, "a")]


def frames(spark):
    counts = spark.createDataFrame(COUNTS, "cell long, gene string, value double")
    cells = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "cell long")
    return counts, spark.createDataFrame(SETS, "signature string, gene string"), cells


def test_scores_of_repeated_and_null_rows(spark):
    counts, sets, cells = frames(spark)
    got = {(r.cell, r.signature): r.score for r in signatures.module_score(counts, sets, cells, bins=1, controls=100).collect()}
    # in one bin every gene is a control of every signature: a, b, c, d, x and the null gene
    want = {}
    for cell in (1, 2, 5, None):
        for s, genes in (("S", "ab"), ("T", "c"), (None, "")):
            mine = [(g, v) for c, g, v in COUNTS if c is not None and c == cell and g is not None and v is not None]
            hit = sum(v for g, v in mine if g in genes)
            want[cell, s] = hit / max(len(genes), 1) - (sum(v for _, v in mine) / 6 if s else 0.0)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_no_row_a_cell_and_signature_is_grouped(spark):
    counts, sets, cells = frames(spark)
    plan = signatures.module_score(counts, sets, cells, bins=1)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[cell#\d+L?, signature#", plan), plan
    assert not re.search(r"SortMergeJoin \[cell#\d+L?, signature#|hashpartitioning\(cell#\d+L?, signature#", plan), plan

"""The overlap report groups its inputs before they meet, and looks an id up once."""

import re

from varloom.operators import reports
from varloom.plans.checks_cells import _overlaps

QTL = [
    ("RF_0", "G1", "1:100:A:C"), ("RF_0", "G1", "1:100:A:C"), ("RF_1", "G1", "1:100:A:C"), ("RF_0", None, "1:100:A:C"),
    ("RF_0", None, "1:100:A:C"), ("RF_0", "G2", "1:200:A:C"), ("RF_0", "G2", None), (None, "G3", "2:1500:G:T"),
]
STATS = [
    ("S1", "IBD", "1:100:A:C", 1e-9, 0.5), ("S1", "IBD", "1:100:A:C", 1e-8, 0.1), ("S2", None, "1:100:A:C", 5e-8, None),
    ("S1", "IBD", "1:200:A:C", 1e-7, 0.1), ("S1", "IBD", None, 1e-9, 0.1), ("S1", "IBD", "2:1500:G:T", 1e-10, -1.0), ("S3", "IBD", "2:1500:G:T", None, -1.0),
]


def frames(spark):
    q = spark.createDataFrame(QTL, "CELL string, GENEID string, SNPID string")
    s = spark.createDataFrame(STATS, "dataset string, disease string, SNPID string, P double, BETA double")
    return q, s


def test_rows_are_those_of_the_grouped_join(spark):
    q, s = frames(spark)
    got = sorted(map(repr, map(tuple, _overlaps(q, s).collect())))
    best = {}
    for cell, gene, snp in QTL:
        for study, disease, other, p, beta in STATS:
            if snp is not None and snp == other and p is not None and p <= 5e-8:
                best.setdefault((cell, gene, snp, study, disease), []).append((p, beta))
    import math

    want = []
    for k, v in best.items():
        betas = [b for _, b in v if b is not None]
        want.append((*k, round(-math.log10(min(p for p, _ in v)), 6), min(betas) if betas else None))
    assert got == sorted(map(repr, want)) and len(got) == 7


def test_nothing_is_grouped_or_sorted_after_the_overlap(spark):
    q, s = frames(spark)
    panel = spark.createDataFrame([("1:100:A:C", "rs1")], "SNPID string, RSID string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = reports.report_overlap(_overlaps(q, s), panel)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x for x in plan.split("\n") if x.strip()]
    joins = [k for k, x in enumerate(lines) if "SortMergeJoin" in x]
    assert len(joins) == 2  # the overlap and one lookup of its id
    # from the lookup to the overlap there are only projections
    between = lines[joins[0] + 1 : joins[1]]
    assert not [x for x in between if re.search(r"Sort|Exchange|Aggregate", x)], plan
    assert {(r.SNPID, r.Lead) for r in out.collect()} == {("rs1", "rs1"), ("2:1500:G:T", "2:1500:G:T")}

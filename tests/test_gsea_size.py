"""gsea_test is registered with the operator's number of permutations."""

import __spark_entry__ as entry
from tests.conftest import SF


def test_p_values_go_below_what_few_permutations_allow(spark):
    p = [r["pval"] for r in entry.queries()["gsea_test"](spark, SF).select("pval").collect()]
    # a permutation in ten thousand is the unit of most p-values, and 50 draws give none under 1 / 51
    assert p and min(p) < 1 / 51
    assert len({round(x, 4) for x in p}) > 50

"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.compare import compare, connect
from varloom.plans import catalog

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    cur = con.execute(ORACLES[name])
    msg = compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall())
    # an all-null or empty column has no type to compare
    assert msg == "ok" or msg.startswith("KINDS") and "[]" in msg, msg


# iterative fits and random sets; each has a plain version in these tests, `pca_variances` checks the components
WITHOUT = {"cluster_cells", "est_group_prior_converged", "gsea_test", "pca_embed"}


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_only_known_queries_have_no_oracle():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WITHOUT


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["GENEID", "GENENAME"]

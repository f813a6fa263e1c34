"""Name -> (Spark query, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varloom.plans.views import load, oracle, run_sql
from varloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Views of one scale factor as attributes: `t.gwas`, `t.panel`, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def dealt(self, name: str) -> DataFrame:
        """A view whose joins with the variants are no broadcasts."""
        return load(self.spark, self.sf_dir, name, dealt=True)

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        return run_sql(self.spark, self.sf_dir, text, **given)


def query(name: str, sql: str | None = None):
    """Register `fn(t: Inputs) -> DataFrame` under an operator id."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return wrap

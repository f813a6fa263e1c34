"""Log-sum-exp per key as plain map-side combined sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# exp(STEP) times any row count stays inside a double.
STEP = 200


def log_sum_exp(
    df: DataFrame, keys: list[str], terms: dict[str, Column], extra: list[Column] | None = None,
    merge: list[Column] | None = None,
) -> DataFrame:
    """ln(sum(exp(term))) per key for several terms in one pass over the rows.

    Rows are first summed per (key, floor(term / STEP)), scaled by that bucket, so no
    maximum is needed beforehand and a hot key is combined on the map side. A key then
    has a handful of bucket rows, which are put together with their own maximum.
    `extra` aggregates go along in the first step and `merge` combines them.
    """
    df = df.withColumns({f"_b_{n}": F.floor(c / STEP) for n, c in terms.items()})
    buckets = [f"_b_{n}" for n in terms]
    first = df.groupBy(*keys, *buckets).agg(
        *[F.sum(F.exp(c - F.col(f"_b_{n}") * STEP)).alias(f"_s_{n}") for n, c in terms.items()],
        *(extra or []),
    )
    second = first.groupBy(*keys).agg(
        *[F.collect_list(F.col(f"_b_{n}") * STEP + F.ln(f"_s_{n}")).alias(n) for n in terms],
        *(merge or []),
    )

    def total(name: str) -> Column:
        top = F.array_max(name)
        s = F.aggregate(name, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return top + F.ln(s)

    return second.withColumns({n: total(n) for n in terms})


def ln_diff(a: Column, b: Column) -> Column:
    """ln(exp(a) - exp(b)); null when that is not positive."""
    gap = F.lit(1.0) - F.exp(b - a)
    return F.when(gap > 1e-12, a + F.ln(gap))

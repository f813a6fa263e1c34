"""Small dense systems as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def solve(matrix: Column, right: Column, k: int) -> Column:
    """x of matrix * x = right for a symmetric positive definite k x k matrix; null if a pivot is 0.

    `matrix` is an array of rows. Gauss-Jordan elimination, one fold step a pivot; such a matrix
    needs no exchange of rows.
    """
    rows = F.zip_with(matrix, right, lambda row, y: F.concat(row, F.array(y)))

    def eliminate(m: Column, p: Column) -> Column:
        def row(r: Column, i: Column) -> Column:
            scaled = F.transform(F.get(m, p), lambda x: F.try_divide(x, F.get(F.get(m, p), p)))
            return F.when(i == p, scaled).otherwise(F.zip_with(r, scaled, lambda a, b: a - F.get(r, p) * b))

        return F.transform(m, row)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), rows, eliminate)
    return F.transform(done, lambda r: F.get(r, k))

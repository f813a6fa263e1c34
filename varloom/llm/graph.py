"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.sources.sinks import settle


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union index pairs into `label`, where label[x] <= x is the smallest member of x's set.

    `label` must be flat (label[label] == label), and so is the result.
    """
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def _min_per(df: DataFrame) -> DataFrame:
    return df.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable.

    Each round is a large-star and a small-star step: aggregates with map-side combining and
    equi-joins, so a node with very many edges is split by adaptive execution and never gathered.
    A round is written to the checkpoint folder, which cuts the lineage. Rows with a null end
    and self-loops are no edges; no edges give no rows.
    """
    e = settle(
        edges.filter(f"{a} <> {b}")
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _min_per(both).withColumn("m", F.least("k", "m"))
        large = (
            both.join(low, F.col("u") == F.col("k"))
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = _min_per(large)
        joined = large.join(low, F.col("u") == F.col("k"))
        small = (
            joined.filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        e = settle(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))

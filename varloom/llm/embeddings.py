"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors at cosine c and unit length are sqrt(2 - 2c) apart, so a Gaussian projection of their
difference is normal with that deviation. A window around each query holds the partner with a
known chance; the number of windows that hold it is binomial, which fixes the count to ask for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.graph import components, merge_labels
from varloom.sources.sinks import settle

SEED = 20261
#: Vectors a task compares with as many others; a bin with more is cut into such blocks.
BLOCK_ROWS = 2048
_QUERIES, _PAIRS = 256, 1 << 15


def within(width: float, deviation: float) -> float:
    """Chance that a normal projection of a difference lies within +-width."""
    return math.erf(width / deviation / math.sqrt(2))


def calibrate(cosine: float, projections: int, width: float, miss: float) -> tuple[float, int]:
    """(window half-width, count): a pair at `cosine` reaches the count with chance 1 - miss.

    `width` is in deviations of such a pair. Closer pairs reach it more often.
    """
    p = within(width, 1.0)
    below, count = 0.0, 0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            break
        count = k + 1
    return width * math.sqrt(2 - 2 * cosine), count


def _directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, n))


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, vec, label) of the rows that can link: a label, and a finite, non-zero vector."""
    v = F.col("vec")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (
        vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull())
        .filter(ok & F.exists(v, lambda x: x != 0))
    )


def _linker(cosine: float, projections: int, half: float, count: int):
    def compare(x: np.ndarray, unit: np.ndarray, rows: np.ndarray, cols: np.ndarray):
        """Pairs of a query in `rows` and a vector in `cols` that collide often and are close."""
        p = unit @ _directions(unit.shape[1], projections)
        order = np.sort(p[cols], axis=0)
        rank = np.argsort(np.argsort(p[cols], axis=0, kind="stable"), axis=0)
        for at in range(0, len(rows), _QUERIES):
            q = rows[at : at + _QUERIES]
            hits = np.zeros((len(q), len(cols)), np.int16)
            for k in range(projections):
                lo = np.searchsorted(order[:, k], p[q, k] - half, "left")
                hi = np.searchsorted(order[:, k], p[q, k] + half, "right")
                hits += (rank[None, :, k] >= lo[:, None]) & (rank[None, :, k] < hi[:, None])
            i, j = np.nonzero(hits >= count)
            i, j = q[i], cols[j]
            for s in range(0, len(i), _PAIRS):
                a, b = i[s : s + _PAIRS], j[s : s + _PAIRS]
                dot = np.einsum("ij,ij->i", x[a], x[b])
                norm = np.sqrt(np.einsum("ij,ij->i", x[a], x[a])) * np.sqrt(np.einsum("ij,ij->i", x[b], x[b]))
                near = (dot >= cosine * norm) & (a != b)
                yield a[near], b[near]

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        # what may overflow or vanish when squared is scaled first; a cosine has no scale
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        x = flat / np.abs(flat).max(axis=1, keepdims=True)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        ids, mult = table["id"].to_numpy(), table["copies"].to_numpy()
        own = table["own"].to_numpy(zero_copy_only=False).astype(bool)
        inside = table["inside"][0].as_py()
        rows = np.arange(n) if inside else np.flatnonzero(own)
        cols = rows if inside else np.flatnonzero(~own)
        label, n_links = np.arange(n), np.zeros(n, np.int64)
        if len(rows) and len(cols):
            for a, b in compare(x, unit, rows, cols):
                np.add.at(n_links, a, mult[b])
                if not inside:
                    np.add.at(n_links, b, mult[a])
                label = merge_labels(label, a, b)
        out = np.flatnonzero(n_links)
        return pa.table({"id": ids[out], "n": n_links[out], "root": ids[label[out]]})

    return run


def links(classes: DataFrame, cosine: float, projections: int, width: float, miss: float, block: int = BLOCK_ROWS) -> DataFrame:
    """(id, n, root) per class and task: vectors linked to it there, and a class it reaches.

    `classes` is (id, vec, label, copies) with one row per different vector. They are binned by
    their first projection; a linked pair lies in one bin or in two neighbours. A bin over
    `block` rows is cut into blocks by id, and a task holds two blocks at most.
    """
    half, count = calibrate(cosine, projections, width, miss)
    # four deviations: a linked pair is further apart on this projection in 6 of 100,000 cases
    step = 4 * math.sqrt(2 - 2 * cosine)

    def place(batches):
        axes: dict[int, np.ndarray] = {}
        for b in batches:
            vec = b.column(b.schema.get_field_index("vec"))
            flat, at = vec.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(vec.value_lengths().to_numpy())]
            out = np.empty(b.num_rows, np.int64)
            for k in range(b.num_rows):
                v = flat[at[k] : at[k + 1]]
                v = v / np.abs(v).max()
                if len(v) not in axes:
                    axes[len(v)] = _directions(len(v), projections + 1)[:, projections]
                out[k] = math.floor(v @ axes[len(v)] / math.sqrt(v @ v) / step)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "bin"])

    kind = dict(classes.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in classes.columns)
    placed = settle(
        classes.mapInArrow(place, f"{schema}, bin long").withColumn("dim", F.size("vec"))
    )
    # blocks of each bin and of the next one
    sizes = placed.groupBy("label", "dim", "bin").agg(F.ceil(F.count("*") / block).alias("own_n"))
    near = Window.partitionBy("label", "dim").orderBy("bin").rangeBetween
    sizes = sizes.withColumns(
        {"next_n": F.coalesce(F.max("own_n").over(near(1, 1)), F.lit(0)), "last_n": F.coalesce(F.max("own_n").over(near(-1, -1)), F.lit(0))}
    ).withColumnsRenamed({"label": "label_", "dim": "dim_", "bin": "bin_"})
    rows = placed.join(sizes, (F.col("label") == F.col("label_")) & (F.col("dim") == F.col("dim_")) & (F.col("bin") == F.col("bin_")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), "own_n"))

    def upto(n: str):
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    part = F.col("part")
    # (first bin, its block, neighbouring bin or same, its block, is the first side)
    same = F.transform(upto("own_n"), lambda t: F.struct(F.col("bin").alias("b"), F.least(part, t).alias("i"), F.lit(0).alias("gap"), F.greatest(part, t).alias("j"), (part <= t).alias("own")))
    after = F.transform(upto("next_n"), lambda t: F.struct(F.col("bin").alias("b"), part.alias("i"), F.lit(1).alias("gap"), t.alias("j"), F.lit(True).alias("own")))
    before = F.transform(upto("last_n"), lambda t: F.struct((F.col("bin") - 1).alias("b"), t.alias("i"), F.lit(1).alias("gap"), part.alias("j"), F.lit(False).alias("own")))
    tasks = rows.select("id", "vec", "copies", "label", "dim", F.explode(F.concat(same, after, before)).alias("t")).select(
        "id", "vec", "copies", "label", "dim", "t.*", ((F.col("t.gap") == 0) & (F.col("t.i") == F.col("t.j"))).alias("inside")
    )
    return tasks.groupBy("label", "dim", "b", "i", "gap", "j").applyInArrow(
        _linker(cosine, projections, half, count), "id long, n long, root long"
    )


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    cosine: float = 0.93, projections: int = 32, width: float = 2.0, miss: float = 1e-4,
) -> DataFrame:
    """(id, n_links, component) for every row of `vectors`.

    Rows link when their labels are equal and not null, their vectors have one length, and the
    cosine in double precision is at least `cosine`. Vectors that are null, empty, zero or hold
    null or non-finite parts link with nothing, and so do rows without an id. Equal vectors are
    compared once, as one class with its number of copies. `miss` bounds the chance that a pair
    right at `cosine` fails the collision count. Extra columns are ignored; no rows give none.
    """
    classes = usable(vectors, id_col, vec_col, label_col).groupBy("label", "vec").agg(
        F.min("id").alias("id"), F.count("*").alias("copies")
    )
    classes = settle(classes.select("id", "vec", "label", "copies"))
    found = settle(links(classes, cosine, projections, width, miss))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    per_class = (
        classes.join(n, "id", "left")
        .join(comp.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("label").alias("label_"), F.col("vec").alias("vec_"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    # a row that cannot link has no class; of the key only a hash is shuffled, the rest is compared
    joined = rows.join(per_class, F.col("id").isNotNull() & (F.col("label") == F.col("label_")) & (F.col("vec") == F.col("vec_")), "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component"))

"""Anchors that occur more than once, gathered per document."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.words import mix


def anchor_batch(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Anchor rows of one batch, combined before the shuffle.

    An anchor that repeats inside the batch is certain: its first row goes to its own key, so
    that other batches meet it, and the others to keys of their own. A hot anchor so sends one
    row a batch to its key, and no row is lost.
    """
    order = np.argsort(h, kind="stable")
    h, doc, pos = h[order], doc[order], pos[order]
    same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
    sure = same | np.r_[same[1:], False] if len(h) else same
    h = np.where(same, mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64)), h)
    return pa.RecordBatch.from_arrays(
        [pa.array(h.view(np.int64)), pa.array(doc), pa.array(np.where(sure, -1 - pos, pos).astype(np.int32))],
        ["h", "doc", "pos"],
    )


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h: those that are certain or have a neighbour of equal h."""
    last: tuple[int, int, int] | None = None  # (h, doc, pos) that waits for its successor
    for b in batches:
        if not b.num_rows:
            continue
        h, doc, pos = (c.to_numpy() for c in b.columns)
        if last is not None:
            h, doc, pos = (np.r_[np.array([x], c.dtype), c] for x, c in zip(last, (h, doc, pos)))
        same = h[1:] == h[:-1]
        keep = (pos < 0) | np.r_[False, same] | np.r_[same, False]
        # the last row is held back; if its equal has gone out before, it is certain
        hold = int(pos[-1]) if pos[-1] < 0 or not (len(same) and same[-1]) else -1 - int(pos[-1])
        last = (int(h[-1]), int(doc[-1]), hold)
        keep[-1] = False
        p = pos[keep]
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(np.where(p < 0, -1 - p, p))], ["doc", "pos"])
    if last is not None and last[2] < 0:
        yield pa.RecordBatch.from_arrays([pa.array([last[1]], pa.int64()), pa.array([-1 - last[2]], pa.int32())], ["doc", "pos"])


def repeated(anchors: DataFrame) -> DataFrame:
    """(doc, at): sorted positions of each document's anchors that occur more than once.

    A document's list is no longer than its text.
    """
    rows = anchors.repartition("h").sortWithinPartitions("h").mapInArrow(_repeated, "doc long, pos int")
    return rows.groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("at"))


def release(spark) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps.

    It removes what no live frame refers to, on both sides of the bridge to the JVM. Spark's
    event queue refers to the last query until another one ends.
    """
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()

"""Quality by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import words
from varloom.llm.labelled import bounded, fold, logistic, sigmoid, training_labels
from varloom.sources.sinks import settle

#: Labelled rows that set the two numbers of the calibration; the discriminant reads all.
CALIBRATION_ROWS = 20_000
#: Weight of the pooled diagonal in each class covariance, in rows.
SHRINK_ROWS = 200.0
THRESHOLD = 0.3
_KINDS = np.zeros(256, np.int64)  # 0 other bytes, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 stop, 7 symbol
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:?'\"-()"), 1):
    _KINDS[list(_chars)] = _k
_KINDS[[c for c in range(33, 127) if not _KINDS[c]]] = 7
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "other", "stops", "symbols", "newlines",
    "line_words", "repeated_lines", "repeated_words", "top_symbol",
)


def statistics(data: np.ndarray) -> list[float]:
    """Transformed statistics of one text's bytes, NAMES by position; all finite for any text."""
    n = len(data)
    hist = np.bincount(data, minlength=256)
    kind = np.bincount(_KINDS, hist, 8)
    text = data.tobytes()
    parts, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w = len(parts)
    share = lambda k: math.sqrt(k / (n + 1))  # noqa: E731  evens the spread of small shares
    part = lambda a, b: math.asin(math.sqrt(min(1.0, a / b))) if b else 0.0
    symbols = hist * (_KINDS == 7)
    return [
        math.log1p(n), math.log1p(w), math.log((n + 1) / (w + 1)), share(kind[2]), share(kind[3]), share(kind[0]),
        share(kind[6]), share(kind[7]), share(kind[5]), math.log1p(w / (len(lines) + 1)),
        part(len(lines) - len(set(lines)), len(lines)), part(w - len(set(parts)), w), share(float(symbols.max())),
    ]


def _table(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = words.texts(b.column(1))
        x = [statistics(data[at[k] : at[k + 1]]) for k in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, x) per row; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_table, f"doc {dict(rows.dtypes)['doc']}, x array<double>")


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and class: count, sums and sums of products, one row per number."""
    for b in batches:
        x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
        y = b.column(1).to_numpy()
        for c in (0, 1):
            z = np.c_[x[y == c], np.ones((y == c).sum())]
            g = (z.T @ z).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(g), c, np.int32)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g)], ["y", "k", "v"]
            )


@dataclass
class Discriminant:
    """Class means and Cholesky factors, and the line from log-density differences to log-odds."""

    mean: np.ndarray  # class x statistic
    factor: np.ndarray  # inverse Cholesky factors
    log_det: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Half the Mahalanobis difference plus the log-determinants: log p1(x) - log p0(x)."""
        d = [((x - m) @ f.T for m, f in zip(self.mean, self.factor))]
        q = [np.einsum("ij,ij->i", z, z) for z in d[0]]
        out = 0.5 * (q[0] - q[1]) + 0.5 * (self.log_det[0] - self.log_det[1])
        return np.sign(out) * np.log1p(np.abs(out))  # tails of a normal density overstate the odds

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.difference(x) + self.offset)


def discriminant(gram: dict[int, np.ndarray]) -> Discriminant | None:
    """From each class's sums of products (a column of ones last); None unless both have rows.

    A class covariance is shrunk towards the diagonal of the pooled one with the weight of
    SHRINK_ROWS rows, so it is positive definite for any number of rows.
    """
    if len(gram) < 2 or any(g[-1, -1] < 1 for g in gram.values()):
        return None
    n = np.array([gram[c][-1, -1] for c in (0, 1)])
    mean = np.array([gram[c][-1, :-1] / gram[c][-1, -1] for c in (0, 1)])
    scatter = [gram[c][:-1, :-1] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = np.diag(np.maximum(np.diag(scatter[0] + scatter[1]) / n.sum(), 1e-4))
    factor, log_det = [], []
    for c in (0, 1):
        cov = (scatter[c] + SHRINK_ROWS * pooled) / (n[c] + SHRINK_ROWS) + 1e-6 * np.eye(len(pooled))
        low = np.linalg.cholesky((cov + cov.T) / 2)
        factor.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(mean, np.array(factor), np.array(log_det))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0, label_col: str = "quality") -> DataFrame:
    """(doc, held_out, score, predicted) for every row of `docs`.

    Labels of the held-out fold, null labels and labels other than 0 and 1 are not read. Without
    both classes the score is the share of good rows (0.5 without any label). Null and empty texts
    are scored by the statistics of an empty text. Extra columns are ignored.
    """
    rows = settle(document_statistics(docs, id_col, text_col))
    train = training_labels(labels, id_col, label_col, folds, held)
    known = settle(rows.join(train, F.col("doc") == F.col("key")).select("key", "x", "y"))
    sums = known.select("x", "y").mapInArrow(_sums, "y int, k int, v double")
    # (number of statistics + 1) squared numbers per class
    gram: dict[int, np.ndarray] = {}
    d = len(NAMES) + 1
    for r in sums.groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        gram.setdefault(r["y"], np.zeros(d * d))[r["k"]] = r["v"]
    model = discriminant({c: g.reshape(d, d) for c, g in gram.items()})
    if model is None:
        n = {c: g[-1] for c, g in gram.items()}
        flat = float((n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2))
    else:
        sample = bounded(known, CALIBRATION_ROWS).toArrow()
        delta = model.difference(np.array(sample["x"].to_pylist()))
        model.slope, model.offset = map(float, logistic(delta[:, None], sample["y"].to_numpy().astype(float)))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            s = np.full(b.num_rows, flat) if model is None else model.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc", "score"])

    out = rows.mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, score double")
    return out.select(
        "doc", F.coalesce(fold("doc", folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

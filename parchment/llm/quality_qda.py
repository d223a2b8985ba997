"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has its own mean and covariance, shrunk towards the identity of the standardised statistics; the
score is the logistic of the difference of the two log densities plus the log prior, from Cholesky factors
that are made once and travel with the scoring tasks.

Scale: one pass makes 18 statistics per document; the fit needs only sums of them and of their products by
class, added up in Spark, so at most 2 * (1 + 18 + 18 * 18) numbers reach the driver whatever the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Weight of the identity in each class covariance.
SHRINK = 0.1
#: Score from which a document is predicted to be good.
THRESHOLD = 0.3
_SYMBOLS = np.frombuffer(b"#%&*$@^~|<>{}[]\\=_+", np.uint8)
_STOPS = np.frombuffer(b".,;:!?", np.uint8)
N_STATS = 18


def _logit(p: float) -> float:
    return float(np.log((p + 0.004) / (1.004 - p)))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one whole text; those of an empty text are finite too."""
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    nw = len(words)
    lens = np.fromiter(map(len, words), np.int64, nw)
    seen = Counter(words)
    lines = text.split(b"\n")
    part = lambda x, of: x / of if of else 0.0
    return [
        np.log1p(nw),
        np.log1p(lens.mean() if nw else 0.0),
        np.log1p(lens.std() if nw else 0.0),
        np.log1p(lens.max() if nw else 0),
        part(np.log1p(len(seen)), np.log1p(nw)),
        _logit(part(max(seen.values(), default=0), nw)),
        _logit(part(sum(map(eq, words, words[1:])), nw)),
        _logit(part(len(lines) - len(set(lines)), len(lines))),
        np.log1p(part(nw, len(lines))),
        _logit(part(int(count[_SYMBOLS].sum()), n)),
        _logit(part(int(count[_STOPS].sum()), n)),
        _logit(part(int(count[ord("|")]), n)),
        _logit(part(int(count[48:58].sum()), n)),
        _logit(part(int(count[65:91].sum()), n)),
        _logit(part(int(count[128:].sum()), n)),
        _logit(part(int((lens <= 3).sum()), nw)),
        _logit(part(sum(map(bytes.isalpha, words)), nw)),
        _logit(part(sum(map(bytes.istitle, words)), nw)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Standardisation, and per class mean, inverse Cholesky factor, log determinant and log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        log = [p - 0.5 * ((((z - m) @ i.T) ** 2).sum(axis=1) + d) for m, i, d, p in zip(self.means, self.inverses, self.log_dets, self.log_priors, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def from_moments(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = SHRINK) -> Discriminant | None:
    """The discriminant from counts, sums and sums of products by class; None if a class has no row."""
    if (n == 0).any():
        return None
    d = sums.shape[1]
    centre = sums.sum(axis=0) / n.sum()
    within = sum(squares[c] - np.outer(sums[c], sums[c]) / n[c] for c in (0, 1)) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(within), 1e-6))
    means, inverses, dets = [], [], []
    for c in (0, 1):
        m = sums[c] / n[c]
        cov = (squares[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale)
        factor = np.linalg.cholesky((1 - shrink) * cov + shrink * np.eye(d) + 1e-9 * np.eye(d))
        means.append((m - centre) / scale)
        inverses.append(np.linalg.inv(factor))
        dets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(inverses), np.array(dets), np.log(n / n.sum()))


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array([statistics(t or b"") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 + N_STATS + N_STATS**2))
    for batch in batches:
        if batch.num_rows:
            x, y = np.array(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist())
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
    at = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel()), pa.array(at[1].ravel()), pa.array(total.ravel())], ["c", "i", "v"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row; a null text counts as the empty text."""
    C.ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(C.lean(_statistics_of), "doc_id long, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", shrink: float = SHRINK, train: Column | None = None) -> Discriminant | None:
    """Learn from the labelled rows for which `train` holds; a document with labels of both kinds counts once with each.

    Null ids and labels other than 0 and 1 teach nothing. Without a row of either class there is no model.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    rows = stats.where(train if train is not None else F.lit(True)).join(y, "doc_id").select("x", "y")
    got = rows.mapInArrow(C.lean(_moments), "c long, i long, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + N_STATS + N_STATS**2))
    for r in got:
        total[r.c, r.i] = r.v
    return from_moments(total[:, 0], total[:, 1 : 1 + N_STATS], total[:, 1 + N_STATS :].reshape(2, N_STATS, N_STATS), shrink)


def _scorer(model: Discriminant | None, ready: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column(1).to_pylist()
            x = np.array(got if ready else [statistics(t or b"") for t in got], np.float64).reshape(len(got), N_STATS)
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["row", "score"])

    return run


def scores(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score) of rows of document_statistics; 0.5 without a model."""
    return stats.select(F.col("doc_id").alias("row"), "x").mapInArrow(C.lean(_scorer(model, True)), "row long, score double").withColumnRenamed("row", "doc_id")


def kept(docs: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the threshold: one pass, no shuffle."""
    C.ship(docs.sparkSession)
    both = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[text_col].cast("binary").alias("text"))
    kind = both.schema["row"].dataType.simpleString()
    out = both.mapInArrow(C.lean(_scorer(model, False)), f"row {kind}, score double")
    return out.where(F.col("score") >= threshold).select("row.*")


def classified(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted; learned from the rows that are not held out.

    Null and empty texts have scores of their own; repeated rows are scored each; an empty table gives an empty result.
    """
    stats = C.written(document_statistics(docs), "stats")
    model = fit(stats, labels, train=~held_out)
    out = scores(stats, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

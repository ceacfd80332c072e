"""Operator 4, a regularised quadratic discriminant over document statistics.

Each text gives a short vector of log-transformed statistics. The model needs only the count, sum
and sum of outer products of each class, which the tasks add up over all labelled rows. Covariances
shrink towards a scaled identity and their Cholesky factors are kept; a score is the logistic of the
difference of the two Gaussian log-densities plus the log prior odds.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, remainder, small, tidy

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\v\f\r", b"!?", b"#*$%&<>", b"|", b".,;:", b"{}[]()=_/\\", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _i
NAMES = ["length", "words", "mean_word", "distinct", "top", "repeats", "short", "long", "twice", "lines", "line_repeats", "upper", "lower", "digit", "space", "bang", "symbol", "pipe", "stop", "code", "high", "other", "entropy", "windows"]
DIM = len(NAMES)
#: Labelled rows that a fit takes, about, if there are more.
SAMPLE = 100_000


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of a whole text; an empty one has those of no characters."""
    words = text.split()
    n, size = len(words), len(text)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, bytes_, 11)
    p = bytes_[bytes_ > 0] / max(1, size)
    lines = [x for x in text.split(b"\n") if x.strip()]
    next_to = sum(map(bytes.__eq__, words, words[1:]))
    shingles = Counter(zip(words, words[1:], words[2:])) if n > 2 else {}
    part = lambda x, of: np.log((x + 0.5) / (of + 5.0))
    return np.array([
        np.log1p(size), np.log1p(n), np.log1p(lengths.mean() if n else 0), part(len(counts), n), part(max(counts.values(), default=0), n), part(next_to, n),
        part(int((lengths <= 3).sum()), n), part(int((lengths > 12).sum()), n), part(sum(k == 2 for k in counts.values()), n), part(len(lines), n), part(len(lines) - len(set(lines)), len(lines)),
        *(part(kinds[i], size) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0)), -(p * np.log(p)).sum() if size else 0.0, part(len(shingles), max(0, n - 2)),
    ])


def _moments(batches):
    """(label, n, sums, sums of outer products) of the statistics of a task's texts."""
    total = {}
    for batch in batches:
        y = batch.column(0).to_numpy()
        x = np.array([statistics(t) for t in byte_texts(batch.column(1))]).reshape(-1, DIM)
        for label in np.unique(y):
            own = x[y == label]
            n, s, ss = total.get(label, (0, 0.0, 0.0))
            total[label] = (n + len(own), s + own.sum(axis=0), ss + own.T @ own)
    for label, (n, s, ss) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([int(label)], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], names=["y", "n", "s", "ss"])


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverses of the Cholesky factors
    log_dets: list[float]
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [-0.5 * ((((z - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets)]
        if not density:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -30, 30)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1) -> Discriminant:
    """From (n, sum, sum of outer products) of classes 0 and 1; a missing class leaves the prior."""
    n0, n1 = (moments.get(k, (0,))[0] for k in (0, 1))
    odds = float(np.log((n1 + 1) / (n0 + 1)))
    if min(n0, n1) < 2:
        return Discriminant(np.zeros(DIM), np.ones(DIM), [], [], [], odds)
    n = n0 + n1
    centre = (moments[0][1] + moments[1][1]) / n
    scale = np.sqrt(np.maximum(np.diag(moments[0][2] + moments[1][2]) / n - centre**2, 1e-6))
    means, factors, dets = [], [], []
    for k in (0, 1):
        size, s, ss = moments[k]
        mean = s / size
        cov = (ss / size - np.outer(mean, mean)) / np.outer(scale, scale)
        part = max(shrink, min(1.0, DIM / size))
        cov = (1 - part) * cov + part * np.eye(DIM) * max(np.trace(cov) / DIM, 1e-3)
        low = np.linalg.cholesky(cov)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(low))
        dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(centre, scale, means, factors, dets, odds)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Discriminant:
    """Fit on labelled rows whose crc32(id as text) mod ``folds`` is not 0: all of them, or, if there
    are more than ``sample``, about that many, chosen by a hash of the id.

    Rows without a label of 0 or 1 are left out. Texts meet the labels before their statistics are
    taken, so rows without a label cost a scan. What comes to the driver is the moments of each task
    that has rows of a class, added up by class before that.
    """
    learn = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(id_col, folds) != 0)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    n = learn.count()
    if n > sample:
        learn = learn.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (sample << 30) // n)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = texts.join(small(learn, min(n, sample)), "id").select("y", "text").mapInArrow(tidy(_moments), "y int, n long, s array<double>, ss array<double>")
    flat = parts.select("y", "n", F.posexplode(F.concat("s", "ss")).alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    moments = {}
    for y in {r.y for r in flat}:
        own = sorted((r for r in flat if r.y == y), key=lambda r: r.i)
        v = np.array([r.v for r in own])
        moments[y] = (own[0].n, v[:DIM], v[DIM:].reshape(DIM, DIM))
    return discriminant(moments)


def _apply(model: Discriminant, threshold: float, keep_only: bool, at: int):
    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in byte_texts(batch.column(at))]).reshape(-1, DIM)
            score = model.scores(x)
            if keep_only:
                yield batch.filter(pa.array(score >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only the text enters a score. A null text is empty, and empty texts are scored like any other.
    Without two labelled rows of each class every score is the prior. A null id counts as the empty
    text in the fold and is not learnt from. Repeated rows are scored as often as they occur.
    """
    model = fit(docs, labels, id_col, text_col, label_col, folds)
    rows = docs.select(F.col(id_col).alias("id"), (remainder(id_col, folds) == 0).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(_apply(model, threshold, False, 2)), f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier predicts as class 1.

    A null text is scored as an empty one and stays null; null ids are not learnt from; repeated rows
    stay or go together; other columns may have any name. Without two labelled rows of each class
    every score is the prior. An empty table gives no rows.
    """
    model = fit(docs, labels, text_col=text_col)
    return docs.mapInArrow(tidy(_apply(model, threshold, True, docs.columns.index(text_col))), docs.schema)

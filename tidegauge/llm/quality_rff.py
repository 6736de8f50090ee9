"""Operator 8: document quality by random Fourier features of document statistics.

One pass turns each whole text into ``len(STATISTICS)`` numbers. They are
standardised, mapped to random Fourier features of a Gaussian kernel, and a
ridge regression is fitted from normal equations that every partition sums for
itself. Scores are calibrated by isotonic regression on a part of the labelled
rows that the ridge does not see. Only sums of fixed size (features squared,
and score bins) reach the driver.

Null and empty texts have the statistics of a text without characters and get a
score like any other. Very long texts are read whole. Repeated rows count each.
Without labels every score is 0.5; with labels of one class it is that class's
share. Where no labelled row is left for calibration, the ridge's score counts
as it is, cut to 0 and 1. Ties have equal scores. An empty table gives an empty
result. A null id matches no label and is scored. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import id_text_row, materialize

STATISTICS = (
    "log_chars", "log_words", "word_length", "long_words", "short_words", "upper", "digits", "punctuation", "symbols", "bangs", "bars",
    "above_ascii", "spaces", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "line_words", "short_lines", "compressed",
    "sentence_words",
)
#: Bytes of each class that is counted.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "digits": b"0123456789",
    "punctuation": b".,;:?'\"()-",
    "symbols": b"#$%&*@^~_+=<>{}[]\\/`",
    "bangs": b"!",
    "bars": b"|",
    "above_ascii": bytes(range(128, 256)),
    "spaces": b" \t\n\r",
}
STOP = re.compile(rb"[.!?]")


def statistics(text: str | None) -> list[float]:
    """The numbers of ``STATISTICS``, all 0 for an empty text."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATISTICS)
    words = raw.lower().split()
    n, n_words = len(raw), max(len(words), 1)
    counts = {k: (n - len(raw.translate(None, v))) / n for k, v in CLASSES.items()}
    sizes = np.array([len(w) for w in words]) if words else np.zeros(1)
    distinct = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_words = [len(x.split()) for x in lines] or [0]
    values = {
        "log_chars": np.log1p(n),
        "log_words": np.log1p(len(words)),
        "word_length": sizes.mean(),
        "long_words": (sizes > 12).mean(),
        "short_words": (sizes < 4).mean(),
        "distinct_words": len(distinct) / n_words,
        "top_word": max(distinct.values(), default=0) / n_words,
        "repeated_pairs": 1 - pairs / max(len(words) - 1, 1),
        "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1),
        "line_words": np.log1p(np.mean(line_words)),
        "short_lines": float(np.mean([x < 4 for x in line_words])),
        "compressed": min(len(zlib.compress(raw, 1)) / n, 2.0),
        "sentence_words": np.log1p(n_words / (1 + len(STOP.findall(raw)))),
    } | counts
    return [float(values[k]) for k in STATISTICS]


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])

    return id_text_row(docs, id_col, text_col, carry=False).mapInArrow(measure, "id long, x array<double>")


@dataclass
class Scaler:
    mean: np.ndarray
    spread: np.ndarray


@dataclass
class Features:
    """cos(w x + b): random Fourier features of the kernel exp(-gamma |x - y|^2)."""

    scaler: Scaler
    weights: np.ndarray
    shifts: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.scaler.mean) / self.scaler.spread, -6, 6)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / len(self.shifts)) * np.cos(z @ self.weights + self.shifts)])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def scaler_of(x: DataFrame) -> Scaler:
    """Mean and spread of each statistic, from one aggregation."""
    columns = [F.get("x", k) for k in range(len(STATISTICS))]
    row = x.agg(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    values = np.array([v or 0.0 for v in row], dtype=float)
    mean, spread = values[: len(columns)], values[len(columns) :]
    return Scaler(mean, np.where(spread > 1e-9, spread, 1.0))


def random_features(scaler: Scaler, n: int, gamma: float, seed: int) -> Features:
    draw = np.random.default_rng(seed)
    weights = draw.normal(scale=np.sqrt(2 * gamma), size=(len(STATISTICS), n))
    return Features(scaler, weights, draw.uniform(0, 2 * np.pi, n))


def ridge(rows: DataFrame, features: Features, penalty: float) -> np.ndarray:
    """Ridge weights of (x, label) rows, from normal equations summed in each partition."""
    size = len(features.shifts) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            z, y = features(matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"]
        )

    summed = rows.select("x", "label").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((size, size + 1))
    total[summed["i"], summed["j"]] = summed["v"]
    keep = np.full(size, penalty)
    keep[0] = 1e-6
    return np.linalg.solve(total[:, :size] + np.diag(keep), total[:, size])


def pooled(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic means by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for y, n in zip(ones, counts):
        blocks.append([float(y), float(n), 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), y / n) for y, n, k in blocks]) if blocks else np.zeros(0)


@dataclass
class Model:
    features: Features
    weights: np.ndarray
    points: np.ndarray  # bin centres of raw scores
    values: np.ndarray  # calibrated scores there

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.clip(self.raw(x), 0.0, 1.0) if self.weights.any() else np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.points, self.values), 0.0, 1.0)


def fit(
    labelled: DataFrame, *, n_features: int = 192, gamma: float = 0.02, penalty: float = 1.0, bins: int = 400, seed: int = 7
) -> Model:
    """Model of (x, label, calibrate) rows: the ridge learns from rows that are not for calibration."""
    labelled = materialize(labelled.select("x", F.col("label").cast("double").alias("label"), "calibrate"), "labelled")
    features = random_features(scaler_of(labelled), n_features, gamma, seed)
    model = Model(features, ridge(labelled.where("not calibrate"), features, penalty), np.zeros(0), np.zeros(0))

    def bin_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.rint((model.raw(matrix(b.column(0))) + 0.5) * bins / 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], names=["bin", "label"])

    binned = labelled.where("calibrate").select("x", "label").mapInArrow(bin_up, "bin int, label double")
    found = binned.groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if len(found):
        model.points = found["bin"].to_numpy() * 2 / bins - 0.5
        prior = found["ones"].sum() / found["n"].sum()
        model.values = pooled(found["ones"].to_numpy() + prior * 0.5, found["n"].to_numpy() + 0.5)
    return model


def apply(rows: DataFrame, model: Model) -> DataFrame:
    """(id, score) of (id, x) rows."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.score(matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], names=["id", "score"])

    return rows.select("id", "x").mapInArrow(rate, "id long, score double")


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", calibrate: str
) -> DataFrame:
    """Per document: id_col and score. ``labels`` are the rows to learn from; ``calibrate`` says in SQL which of them calibrate."""
    x = materialize(described(docs, id_col, text_col), "statistics")
    marked = labels.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.expr(calibrate).alias("calibrate")
    )
    return apply(x, fit(x.join(marked, "id"))).withColumnRenamed("id", id_col)

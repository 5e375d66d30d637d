"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic steps.

Statistics of the whole text (shares of characters and words, repetition, lines) are scaled and
mapped to cosines of random projections, whose inner products approximate a Gaussian kernel.
The normal equations are summed within partitions, the sums are added in two levels, and a small
system is solved. Raw scores become probabilities by pooling adjacent violators over a histogram
of the training scores.

Nothing that grows with the corpus reaches the driver: one row of moments, ``SLOTS`` matrices of
fixed size, and ``BINS`` histogram rows.

Defined cases: null and empty texts have the statistics of the empty text and get a score;
repeated rows are scored alike; labels that are null are not learnt from, repeated labels count
each; without any label every score is 0.5, with one class its share; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import flat_texts

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "signs", "points", "space",
    "distinct_words", "same_as_before", "commonest_word", "repeated_lines", "ended_lines",
    "log_line", "loud_words", "sign_words", "entropy", "bars", "repeated_pairs", "capital_words",
)
FEATURES = 256
SLOTS = 32
BINS = 2048

_POINTS = np.zeros(256, bool)
_POINTS[list(b".,;:!?'\"()-")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTERS = _UPPER.copy()
_LETTERS[97:123] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[33:127] = True
_SIGNS &= ~(_LETTERS | _DIGITS | _POINTS)


def statistics(text: str, data: np.ndarray) -> list[float]:
    """The statistics of one text, given also as bytes."""
    n = len(data)
    if n == 0:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(data, minlength=256)
    letters = int(counts[_LETTERS].sum()) + int(counts[128:].sum())
    words = text.split()
    m = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    last = [w[-1] for w in words]
    share = counts[counts > 0] / n
    return [
        float(np.log1p(len(text))), float(np.log1p(m)), len(text) / max(m, 1),
        counts[_UPPER].sum() / max(letters, 1), counts[_DIGITS].sum() / n, counts[_SIGNS].sum() / n,
        counts[_POINTS].sum() / n, counts[_SPACE].sum() / n,
        len(seen) / max(m, 1), same / max(m - 1, 1), max(seen.values(), default=0) / max(m, 1),
        1 - len(set(lines)) / max(len(lines), 1), sum(x.rstrip()[-1] in ".!?:" for x in lines) / max(len(lines), 1),
        float(np.log1p(n / max(len(lines), 1))), sum(c == "!" for c in last) / max(m, 1),
        sum(c in "#$%&*~^|<>{}[]@+=_" for c in last) / max(m, 1), float(-(share * np.log2(share)).sum()),
        counts[124] / n, 1 - pairs / max(m - 1, 1) if m > 1 else 0.0, sum(w[0].isupper() for w in words) / max(m, 1),
    ]


def matrix_of(texts: pa.Array) -> np.ndarray:
    flat, offsets = flat_texts(texts)
    out = np.empty((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        out[i] = statistics(text.as_py() or "", flat[offsets[i] : offsets[i + 1]])
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, stats``: the statistics of every whole text, row by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(matrix_of(batch.column(1)))], names=[id_col, "stats"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, stats array<double>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


@dataclass
class Classifier:
    """A fitted model; ``of_statistics`` maps statistics to probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def of_statistics(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _stats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pool_adjacent(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit to ``y`` over increasing ``x``: pooled mean x and level of each block."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(
    stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality",
    features: int = FEATURES, width: float = 4.0, ridge: float = 1e-3, seed: int = 11,
) -> Classifier:
    """Learn ``label_col`` from all labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y"))
    known = known.where(~held_out(F.col("label_id")))
    rows = stats.join(known, stats[id_col] == known["label_id"]).select("stats", "y")
    d = len(STATISTICS)
    moments = rows.agg(
        F.count("*").alias("n"), F.avg("y").alias("y"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)],
    ).first()
    rng = np.random.default_rng(seed)
    n = moments["n"]
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(d)])
    scale[scale < 1e-9] = 1.0
    model = Classifier(
        mean, scale, rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + d + 1), np.array([0.0]), np.array([moments["y"] if n else 0.5]))
    if not n or moments["y"] in (0.0, 1.0):
        return model
    size = features + d + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z, y = model.features(_stats(batch.column(0))), batch.column(1).to_numpy()
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ y
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(size * (size + 1))
        for x in table.column("sums"):
            total += np.frombuffer(x.as_py())
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(partial, "slot int, sums binary").groupBy("slot").applyInArrow(added, "sums binary")
    total = np.zeros((size, size + 1))
    for row in sums.toLocalIterator():  # at most SLOTS rows of fixed size
        total += np.frombuffer(row["sums"]).reshape(size, size + 1)
    penalty = np.full(size, ridge * n / features)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(total[:, :size] + np.diag(penalty), total[:, size])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_stats(batch.column(0))) if batch.num_rows else np.zeros(0)
            cell = np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(raw), batch.column(1)], names=["cell", "raw", "y"])

    bins = rows.mapInArrow(scored, "cell int, raw double, y double").groupBy("cell").agg(
        F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("w"))
    held = sorted((r["raw"], r["y"], r["w"]) for r in bins.collect())  # at most BINS rows
    x, y, w = map(np.array, zip(*held))
    model.knots, model.levels = pool_adjacent(x, y, w.astype(float))
    return model


def score_statistics(stats: DataFrame, model: Classifier, *, id_col: str = "doc_id") -> DataFrame:
    """``id_col, score`` for each row of ``stats``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.of_statistics(_stats(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[id_col, "score"])

    schema = f"`{id_col}` {stats.schema[id_col].dataType.simpleString()}, score double"
    return stats.select(id_col, "stats").mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: Classifier, *, text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its text, row by row; a column ``into`` is replaced."""
    @F.pandas_udf("double")
    def score(texts):
        return pd.Series(model.of_statistics(matrix_of(pa.Array.from_pandas(texts, type=pa.string()))), dtype=float)

    return docs.withColumn(into, score(F.col(text_col)))

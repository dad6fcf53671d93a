"""A quality classifier on random Fourier features.

Document statistics are standardised and mapped to ``cos(w x + b)`` features whose inner products approximate a Gaussian
kernel (Rahimi and Recht, 2007).  Each partition sums its share of the normal equations; the sums meet row by row of the
matrix in a shuffle, so the driver gets one matrix whatever the number of partitions.  The ridge solution gives raw
scores, which isotonic regression on a fold of its own turns into probabilities.

All training rows are used; there is no sample.  Statistics are computed once for every document and kept as a narrow
table in the shared folder, so that texts are read once and neither joined nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import crc_of_id, materialize, release, text_or_empty

FEATURES = 128
RIDGE = 1e-3
BINS = 256
#: Groups of partitions whose sums meet first.
SOME = 64
THRESHOLD = 0.7
HELD_OUT = 2
CALIBRATION = 3  # the remainder whose rows calibrate; the others fit

STATS = ("log_bytes", "log_words", "word_bytes", "long_words", "distinct_words", "distinct_lines", "line_words", "upper", "digits", "blanks", "punctuation", "symbols", "pipes", "marks", "non_ascii", "sentences", "entropy", "doubled", "control")


def _classes() -> np.ndarray:
    """Byte classes as columns of a 0/1 matrix."""
    sets = [range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), b".,;:!?'\"()-", b"#*$%&<>@^~_=+\\/[]{}", b"|", b"!?", range(128, 256), b".!?", [*range(0, 9), *range(14, 32), 127]]
    out = np.zeros((256, len(sets)))
    for k, s in enumerate(sets):
        out[list(s), k] = 1
    return out


_CLASSES = _classes()


def statistics(text: str) -> np.ndarray:
    """The statistics of one text, all finite; of an empty one too."""
    raw = text.encode()
    n = len(raw)
    codes = np.frombuffer(raw, np.uint8)
    hist = np.bincount(codes, minlength=256).astype(float)
    upper, digits, blanks, punct, symbols, pipes, marks, wide, sentences, control = hist @ _CLASSES / max(n, 1)
    words = raw.split()
    w = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = hist[hist > 0] / max(n, 1)
    doubled = np.count_nonzero(codes[1:] == codes[:-1]) / max(n, 1)
    return np.array([
        np.log1p(n), np.log1p(len(words)), min((n - hist[[9, 10, 11, 12, 13, 32]].sum()) / w, 100.0), sum([len(x) > 20 for x in words]) / w, len(set(words)) / w,
        len(set(lines)) / max(len(lines), 1), min(np.log1p(w / max(len(lines), 1)), 8.0), upper, digits, blanks, punct, symbols, pipes, marks, wide, sentences, -(p * np.log2(p)).sum(), doubled, control,
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``stats`` (array of double), a row for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "stats": pa.array([g.tolist() for g in got], pa.list_(pa.float64()))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, stats array<double>")


class RandomFeatures:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, width: float = 4.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([z, np.ones((len(z), 1))])


def isotonic(rise: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``rise`` in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for y, w in zip(rise, weight):
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, n2 = blocks.pop()
            y1, w1, n1 = blocks[-1]
            blocks[-1] = [(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([[y] * n for y, _, n in blocks]) if blocks else np.array([])


class Model:
    """Features, ridge weights and the calibration curve."""

    def __init__(self, features: RandomFeatures | None, weights: np.ndarray | None, knots: np.ndarray, levels: np.ndarray):
        self.features, self.weights, self.knots, self.levels = features, weights, knots, levels

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.levels[0])
        raw = self.raw(stats)
        curve = np.interp(raw, self.knots, self.levels)
        # A thousandth of the raw score keeps the order within the flat steps of the curve.
        return np.clip(0.999 * curve + 0.001 * np.clip(raw, 0, 1), 0.0, 1.0)


def _stack(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _summed(rows: DataFrame, matrix) -> np.ndarray:
    """The sum over all rows of ``matrix(stats, label)``: partition sums, then row by row of the matrix in two shuffles, so that no task meets the parts of all partitions."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = matrix(_stack(batch.column(0)), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), float))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(len(total)), pa.int32()), "part": pa.array(total.tolist(), pa.list_(pa.float64()))})

    parts = rows.select("stats", F.col("label").cast("double")).mapInArrow(part, "row int, part array<double>").withColumn("some", F.pmod(F.spark_partition_id(), F.lit(SOME)))

    def group(key, table):
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([_stack(table.column(1).combine_chunks()).sum(0).tolist()], pa.list_(pa.float64()))})

    parts = parts.groupBy("row", "some").applyInArrow(group, "row int, part array<double>")
    got = parts.groupBy("row").applyInArrow(group, "row int, part array<double>").collect()
    return np.array([r.part for r in sorted(got, key=lambda r: r.row)])


def fit(labelled: DataFrame, *, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """Fit on all rows of ``labelled`` (``stats``, ``label`` 0 to 1, ``calibrate`` boolean).

    Without rows, or with one label only, the score is that share for every text (0.5 without rows).
    """
    rows = labelled.where(F.col("label").isNotNull() & ~F.isnan("label"))
    sums = _summed(rows, lambda x, y: np.vstack([x.sum(0), (x**2).sum(0), np.full(x.shape[1], len(x)), np.full(x.shape[1], y.sum())]))
    if not len(sums):
        return Model(None, None, np.array([0.0]), np.array([0.5]))
    n, ones = sums[2][0], sums[3][0]
    if ones in (0, n):
        return Model(None, None, np.array([0.0]), np.array([ones / n]))
    mean = sums[0] / n
    spread = np.sqrt(np.maximum(sums[1] / n - mean**2, 0))
    rf = RandomFeatures(mean, np.maximum(spread, 1e-6), features)
    # Both labels weigh the same in the fit; calibration restores the true shares.
    weigh = lambda y: y * 0.5 * n / ones + (1 - y) * 0.5 * n / (n - ones)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = rf(x)
        zw = z * weigh(y)[:, None]
        return np.vstack([zw.T @ z, y @ zw])

    train = rows.where(~F.col("calibrate"))
    a = _summed(train, normal)
    if not len(a):
        train, a = rows, _summed(rows, normal)
    gram, moment = a[:-1], a[-1]
    weights = np.linalg.solve(gram + ridge * n * np.eye(len(gram)) / features, moment)
    model = Model(rf, weights, np.array([0.0]), np.array([0.0]))

    def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.raw(x)
        k = np.clip(((raw + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.vstack([np.bincount(k, minlength=BINS), np.bincount(k, y, BINS), np.bincount(k, raw, BINS)])

    c = _summed(rows.where("calibrate"), curve)
    if not len(c):
        c = _summed(rows, curve)
    some = c[0] > 0
    return Model(rf, weights, c[2][some] / c[0][some], isotonic(c[1][some] / c[0][some], c[0][some]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text.

    Returns ``id_col``, ``held_out`` (crc32 of the identifier as text is 2 modulo 4), ``score`` (double, 0 to 1) and
    ``predicted`` (1 if score >= threshold).  Held-out rows are never learned from.  Only texts enter a score, so equal texts
    score alike; null texts count as empty.  Labels that are null, or whose identifier is null or of no document, are
    ignored; several labels of one document count as their mean.  Rows are kept one to one, repeated identifiers too; texts
    are read whole, however long; an empty table gives no rows; columns other than the named ones are not read.
    """
    stats = materialize(document_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.avg("label").alias("label"))
    fold = F.pmod(crc_of_id("id"), F.lit(4))
    labelled = materialize(stats.where(fold != HELD_OUT).join(known, "id").select("stats", "label", (fold == CALIBRATION).alias("calibrate")), "labelled")
    model = fit(labelled)
    release(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(_stack(batch.column(1)))
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "held_out": batch.column(2), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    kind = docs.schema[id_col].dataType.simpleString()
    return stats.select("id", "stats", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")

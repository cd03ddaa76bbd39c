"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. One scan turns every whole text into statistics (:data:`STATISTICS`), a small staged table.
2. Labelled rows fit: all of them, no sample. Mean and deviation scale the statistics; ``FEATURES`` random Fourier
   features (seeded) approximate a Gaussian kernel of width ``WIDTH`` per root of a statistic. Every partition sums its
   part of the normal equations, a few groups add these up, and the driver solves one system of fixed size.
3. Of the rows to learn from, one remainder is kept to calibrate: ridge scores are counted in ``BINS`` bins of fixed
   bounds, and pooled means that never fall over the bins make the calibrated score, with lines between them.

Rows learn by crc32 of the id as text: remainder 2 of 4 is held out, 3 calibrates, 0 and 1 fit. Labels, language,
source and id are no inputs. Defined cases: null texts are empty ones and score as such; null ids are never learned
from and count as not held out; repeated rows each get a row back; without labels the score is 0.5; with labels of one
kind only it tends to that label; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, no_text, stage
from fleetlens.llm.shingles import span_hashes, word_bounds

STATISTICS = [
    "log_words", "word_length", "word_deviation", "upper", "digits", "symbols", "marks", "space", "other_bytes", "distinct_words",
    "commonest_word", "log_lines", "repeated_lines", "line_words", "shouted_words", "marked_words", "repeated_pairs", "ends",
]
FEATURES, WIDTH, RIDGE, BINS, GROUPS, SEED = 192, 0.8, 1.0, 400, 16, 4
LOW, HIGH = -0.5, 1.5
FOLDS, HELD_OUT, CALIBRATES, GOOD = 4, 2, 3, 0.7

_CLASS = np.zeros((6, 256))
for _row, _bytes in enumerate((
    range(0x41, 0x5B), range(0x30, 0x3A), b"#*$%&|<>{}[]@\\^~_=+/", b"!?", (0x20, *range(0x09, 0x0E)), range(0x80, 0x100),
)):
    _CLASS[_row, list(_bytes)] = 1


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text; those of an empty one are 0."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(raw)
    n = len(starts)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(raw, minlength=256)
    upper, digits, symbols, marks, space, other = (_CLASS @ counts) / len(raw)
    hashes, lengths = span_hashes(raw, starts, ends), ends - starts
    _, times = np.unique(hashes, return_counts=True)
    pairs = len(np.unique(hashes[1:] * np.uint64(3) + hashes[:-1])) if n > 1 else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    last = raw[ends - 1]
    begins_upper = (raw[starts] >= 0x41) & (raw[starts] <= 0x5A)
    second = raw[np.minimum(starts + 1, ends - 1)]
    shouted = begins_upper & (second >= 0x41) & (second <= 0x5A) & (lengths > 1)
    return [
        np.log1p(n), lengths.mean(), lengths.std(), upper, digits, symbols, marks, space, other, len(times) / n,
        times.max() / n, np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), shouted.mean(),
        _CLASS[2][last].mean(), 1 - pairs / (n - 1) if n > 1 else 0.0, np.isin(last, list(b".,;:!?")).mean(),
    ]


def with_statistics(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``stats``."""
    rows = docs.select(F.col(id).alias("id"), no_text(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["id", "stats"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, stats array<double>")


def fold(id: str) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % FOLDS


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    #: calibrated score at the middle of every bin, ascending
    levels: np.ndarray

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.deviation) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        middles = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
        return np.clip(np.interp(self.ridge(stats), middles, self.levels), 0, 1)


def fourier(stats: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Cosines of seeded random projections, and a constant. Statistics are held within six deviations."""
    r = np.random.default_rng(SEED)
    d = len(STATISTICS)
    directions = r.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, FEATURES))
    phases = r.uniform(0, 2 * np.pi, FEATURES)
    scaled = np.clip((stats - mean) / deviation, -6, 6)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(scaled @ directions + phases), np.ones((len(stats), 1))], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(STATISTICS))


def _normal_equations(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray | None:
    """[Z y]' [Z y] of all rows (stats, y): summed in each partition, then in ``GROUPS`` groups."""
    size = FEATURES + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = np.column_stack([fourier(_matrix(batch.column(0)), mean, deviation), np.asarray(batch.column(1))])
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size)
        for batch in parts:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py())
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    parts = arrow_map(rows.select("stats", F.col("y").cast("double")), run, "part binary")
    sums = arrow_map(parts.repartition(GROUPS), add, "part binary").collect()
    return sum(np.frombuffer(r.part) for r in sums).reshape(size, size) if sums else None


def pooled(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Isotonic means of the bins by pooling neighbours that fall; bins without rows lie on lines between the others."""
    used = np.flatnonzero(counts)
    blocks: list[list[float]] = []  # ones, rows, bins
    for i in used:
        blocks.append([ones[i], counts[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    # half a row of either label keeps the ends off 0 and 1
    means = np.repeat([(b[0] + 0.5) / (b[1] + 1) for b in blocks], [int(b[2]) for b in blocks])
    return np.interp(np.arange(len(counts)), used, np.maximum.accumulate(means))


def fit(labelled: DataFrame) -> Classifier | None:
    """``labelled`` (stats, y, fold) should be a stored table: it is read three times."""
    used = labelled.filter(F.col("fold") != HELD_OUT)
    parts = [f(F.col("stats")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    *moments, n = used.agg(*parts, F.count("*")).first()
    if not n:
        return None
    mean, deviation = np.array(moments[::2], float), np.array(moments[1::2], float)
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    sums = _normal_equations(used.filter(F.col("fold") != CALIBRATES), mean, deviation)
    if sums is None:
        sums = _normal_equations(used, mean, deviation)
    zz, zy = sums[:-1, :-1], sums[:-1, -1]
    penalty = np.full(len(zz), RIDGE * 0.01)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(zz + np.diag(penalty), zy)
    raw = Classifier(mean, deviation, weights, np.zeros(BINS))
    chosen = used.filter(F.col("fold") == CALIBRATES)
    bins = _counted(chosen, raw) or _counted(used, raw)
    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for row in bins:
        counts[row.bin], ones[row.bin] = row.n, row.ones
    return Classifier(mean, deviation, weights, pooled(counts, ones))


def _counted(rows: DataFrame, model: Classifier) -> list:
    """Rows and ones per bin of the ridge score: at most :data:`BINS` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (model.ridge(_matrix(batch.column(0))) - LOW) / (HIGH - LOW) * BINS
            bins = pa.array(np.clip(at, 0, BINS - 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([bins, batch.column(1)], ["bin", "y"])

    binned = arrow_map(rows.select("stats", F.col("y").cast("double")), run, "bin int, y double")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()


def scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    stats = stage(with_statistics(docs, id, text), "statistics")
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    learned = stats.filter(fold("id") != HELD_OUT).join(known, "id").select("stats", "y", fold("id").alias("fold"))
    model = fit(stage(learned, "labelled-statistics"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            made = model.score(_matrix(batch.column(1))) if model is not None else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], ["id", "score"])

    scored = arrow_map(stats, run, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    held = F.coalesce(fold("id") == HELD_OUT, F.lit(False))
    return scored.select(F.col("id").alias(id), held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))

"""Quality scores: a Gaussian kernel over document statistics by random Fourier features.

Statistics of the whole text are standardised and mapped to random cosine features. Ridge weights
solve normal equations that are summed in every partition of the labelled sample and then over
partitions. Isotonic calibration, fitted on scores of the other fold, turns them into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import rows
from rinkspark.llm.hashing import LOWER, Prefixes, apart, words

#: Labelled documents to fit on, the first by hash of the id.
LABELLED = 20_000
#: Cosine features, the kernel's width in standard deviations, the ridge penalty and the sample's partitions.
COSINES = 256
WIDTH = 4.0
RIDGE = 1e-2
PARTS = 8
SEED = 5
#: Bytes handled at once: arrays of eight bytes for each, several at a time.
_SLICE = 1 << 18

STATISTICS = (
    "log_bytes", "letters", "digits", "upper", "spaces", "high_bytes", "marks", "odd_marks", "bangs", "pipes",
    "log_lines", "log_line_bytes", "log_words", "word_bytes", "short_words", "long_words", "distinct_words", "top_word",
    "same_as_before", "distinct_pairs", "distinct_lines", "blank_marks",
)


def _counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its most frequent one."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(row):
        order = np.lexsort((value, row))
        r, v = row[order], value[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        first = np.flatnonzero(new)
        distinct = np.bincount(r[first], minlength=n).astype(np.float64)
        np.maximum.at(most, r[first], np.diff(np.append(first, len(r))).astype(np.float64))
    return distinct, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has zeros."""
    n = len(offsets) - 1
    data, offsets = apart(data, offsets)
    bytes_ = np.maximum(np.diff(offsets) - 1, 0).astype(np.float64)
    share = lambda x, of: x / np.maximum(of, 1)
    high = data >= 128
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) & ~high
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    mark = ~(high | letter | digit | space)
    odd = np.isin(data, np.frombuffer(b"#$%&*@^~=+<>{}[]\\_", np.uint8))
    low = LOWER[data]
    sums = Prefixes(low)
    a, b = words(low)
    row = np.searchsorted(offsets, a, "right") - 1
    size = (b - a).astype(np.float64)
    hashed = sums.of(a, b)
    count = np.bincount(row, minlength=n).astype(np.float64)
    distinct, most = _distinct(row, hashed, n)
    same = (row[1:] == row[:-1]) & (hashed[1:] == hashed[:-1]) if len(row) else np.zeros(0, bool)
    together = (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    pair_row = row[1:][together]
    pairs, _ = _distinct(pair_row, (hashed[:-1] * np.uint64(31) + hashed[1:])[together] if len(row) else hashed, n)
    line_end = np.flatnonzero((data == 10) | (np.isin(np.arange(len(data)), offsets[1:] - 1)))
    line_start = np.concatenate([[0], line_end[:-1] + 1]).astype(np.int64) if len(line_end) else np.zeros(0, np.int64)
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lines = np.bincount(line_row, minlength=n).astype(np.float64)
    other_lines, _ = _distinct(line_row, sums.of(line_start, line_end), n)
    by_row = lambda x, w=None: np.bincount(x, w, n).astype(np.float64)
    blank_mark = space.copy()
    blank_mark[:-1] &= mark[1:]
    blank_mark[-1:] = False
    return np.stack([
        np.log1p(bytes_), share(_counts(letter | high, offsets), bytes_), share(_counts(digit, offsets), bytes_), share(_counts(letter & (data < 97), offsets), bytes_),
        share(_counts(space, offsets) - 1, bytes_), share(_counts(high, offsets), bytes_), share(_counts(mark, offsets), bytes_), share(_counts(odd, offsets), bytes_),
        share(_counts(data == 33, offsets), bytes_), share(_counts(data == 124, offsets), bytes_), np.log1p(lines), np.log1p(share(bytes_, lines)), np.log1p(count),
        share(by_row(row, size), count), share(by_row(row, size <= 3), count), share(by_row(row, size > 16), count), share(distinct, count), share(most, count),
        share(by_row(row[1:][same] if len(row) else row), count), share(pairs, np.maximum(count - 1, 1)), share(other_lines, lines), share(_counts(blank_mark, offsets), bytes_),
    ], axis=1) * (bytes_ > 0)[:, None]


class Model:
    """Standardisation, random cosines, ridge weights and an isotonic step function."""

    def __init__(self, mean, spread, weights, steps, values):
        self.mean, self.spread, self.weights, self.steps, self.values = mean, spread, weights, steps, values

    @staticmethod
    def cosines(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(x.shape[1], COSINES)) / WIDTH
        phase = rng.uniform(0, 2 * np.pi, COSINES)
        z = np.clip((x - mean) / spread, -8, 8)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ w + phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x, self.mean, self.spread) @ self.weights

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offsets) - 1, self.values[0])
        return np.clip(np.interp(self.raw(statistics(data, offsets)), self.steps, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit, by pooling adjacent violators."""
    at, own = np.unique(x, return_inverse=True)
    weight = np.bincount(own, minlength=len(at)).astype(float)
    mean = np.bincount(own, weights=y, minlength=len(at)) / weight  # equal scores are one point, in whatever order they came
    blocks: list[list[float]] = []
    for a, b, n in zip(at, mean, weight, strict=True):
        blocks.append([b, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, _, last = blocks.pop()
            u, m, first, _ = blocks.pop()
            blocks.append([(u * m + v * n) / (m + n), m + n, first, last])
    knots = np.array([[k for _, _, a, b in blocks for k in (a, b)], [v for v, _, _, _ in blocks for _ in (0, 1)]])
    return knots[0], knots[1]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = rows.utf8(batch.column("text"))
    for lo, hi in rows.pieces(offsets, _SLICE):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows.released(batches):
        x = [statistics(data, offsets) for _, _, data, offsets in _slices(batch)]
        x = np.concatenate(x) if x else np.zeros((0, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])


def _sums(mean: np.ndarray, spread: np.ndarray):
    """A partition's normal equations, apart for even and odd ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, COSINES + 1, COSINES + 2))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            z = Model.cosines(x, mean, spread)
            zy = np.hstack([z, batch.column("quality").to_numpy()[:, None]])
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for f in (0, 1):
                total[f] += z[fold == f].T @ zy[fold == f]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _ridge(sums: np.ndarray) -> np.ndarray:
    a, b = sums[:, :-1], sums[:, -1]
    penalty = RIDGE * max(1.0, a[-1, -1] / 1000) * np.eye(len(a))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, b)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Model:
    """A model of ``labels(doc_id, quality)`` from rows that are not held out; the sample is bounded."""
    rows.bounded_batches(docs.sparkSession)
    learn = ~rows.is_held_out("doc_id", modulus, held_out)
    known = labels.where(learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    wanted = rows.written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").mapInArrow(_statistics, "doc_id long, quality int, x array<double>")
    # one text an id, however many rows have it
    sample = sample.groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    sample = sample.withColumn("fold", (F.abs(F.xxhash64("doc_id", F.lit(3))) % 2).cast("int"))
    sample = rows.written(sample.repartition(PARTS))
    got = sample.orderBy("doc_id").select("quality", "fold", "x").toArrow()
    y = got.column("quality").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, None, [float(y.mean()) if len(y) else 0.5])
    x = np.array(got.column("x").to_pylist())
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    sums = sum(np.frombuffer(r.sums).reshape(2, COSINES + 1, COSINES + 2) for r in sample.mapInArrow(_sums(mean, spread), "sums binary").collect())
    fold = got.column("fold").to_numpy()
    z = Model.cosines(x, mean, spread)
    # each fold is scored by the weights of the other, so that calibration sees no score of its own fit
    other = np.where(fold == 0, z @ _ridge(sums[1]), z @ _ridge(sums[0]))
    return Model(mean, spread, _ridge(sums[0] + sums[1]), *isotonic(other, y))


def _score(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            out = [model.scores(data, offsets) for _, _, data, offsets in _slices(batch)]
            yield batch.append_column(name, pa.array(np.concatenate(out) if out else np.zeros(0)))

    return run


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1), which it must not have yet."""
    return docs.mapInArrow(_score(model, name), docs.withColumn(name, F.lit(0.0)).schema)


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text, ...)``.

    Labels are learnt from rows whose crc32 of the id modulo ``modulus`` is not ``held_out``; a null
    id or label teaches nothing, a document labelled both ways counts as 0, and an id with several
    rows teaches by one of them, that of the least statistics. A null or empty text has statistics of
    zero; those of a long text are of all of it, held in one task. With one kind of label, or none,
    every score is the labels' mean (0.5). Equal scores stay equal. Repeated rows pass through; an
    empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, labels, modulus, held_out)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), rows.is_held_out("doc_id", modulus, held_out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))

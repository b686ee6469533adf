"""Toxicity by non-negative positive-unlabelled learning on hashed words and word parts.

Confirmed toxic documents are the positives; all others, labelled or not, are unlabelled. A linear
classifier is fitted in numpy by gradient steps on the class-prior-corrected risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``. The prior is the share of toxic rows among
the labels that may be learnt from; labels say nothing else about the unlabelled rows. Scores are
placed so that the prior's share of all rows reaches the cut, by margins that weights of the other
fold give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import rows
from rinkspark.llm.hashing import LOWER, Prefixes, apart, words

#: Hash buckets of words and grams, and the features the classifier keeps of them.
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
FEATURES = 1024
SIGMAS = 5.0
GRAM = 6
#: Bytes of the word beginnings that are features, and how often is often.
BEGINNINGS = (6, 7, 8)
OFTEN = 3
#: The bounded sample to fit on: confirmed toxic documents, and unlabelled ones, the first by hash of the id.
POSITIVES = 4000
UNLABELLED = 8000
#: Share of the confirmed documents that may score below the cut where all others stay far from it.
MISSED = 0.05
#: Sample tables are summed in so many parts.
PARTS = 8
#: Bytes handled at once: arrays of eight bytes for each, several at a time.
_SLICE = 1 << 18


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words, word beginnings and six-byte parts of words."""
    data, offsets = apart(LOWER[data], offsets)
    a, b = words(data)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = Prefixes(data)
    n = np.maximum(b - a - GRAM, 0)
    of = np.repeat(np.arange(len(a)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[of]
    at, hashed = [a, start], [sums.of(a, b), sums.of(start, start + GRAM)]
    for size in BEGINNINGS:
        longer = a[b - a > size]
        at.append(longer)
        hashed.append(sums.of(longer, longer + size) * np.uint64(0x9E3779B97F4A7C15))
    return np.searchsorted(offsets, np.concatenate(at), "right") - 1, np.concatenate(hashed)


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def features(data: np.ndarray, offsets: np.ndarray, named: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of a text's hashes, each once a row.

    A feature is a hash bucket, or BUCKETS past it for one that a text has OFTEN times or more.
    ``named`` are the hashes that matter, sorted; without it all do.
    """
    row, hashed = _hashed(data, offsets)
    if named is not None:
        hit = _among(hashed, named)
        row, hashed = row[hit], hashed[hit]
    bucket = _bucket(hashed)
    key, times = np.unique(row * (2 * BUCKETS) + bucket, return_counts=True)
    key = np.concatenate([key, key[times >= OFTEN] + BUCKETS])
    key.sort()
    return key // (2 * BUCKETS), key % (2 * BUCKETS)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = rows.utf8(batch.column("text"))
    for lo, hi in rows.pieces(offsets, _SLICE):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, n = np.zeros((2, 2 * BUCKETS), np.int32), np.zeros(2, np.int64)
    for batch in rows.released(batches):
        side = batch.column("positive").to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, data, offsets in _slices(batch):
            row, bucket = features(data, offsets)
            for s in (0, 1):
                sums[s] += np.bincount(bucket[side[lo + row] == s], minlength=2 * BUCKETS).astype(np.int32)
        n += np.bincount(side, minlength=2)
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sums, n)], names=["sums", "n"])


def _chosen(sums: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The buckets whose share among positives differs beyond chance from that among the rest.

    Differences are taken in standard errors, SIGMAS at least, so that among all buckets hardly one is
    chosen by chance: what no class prefers must not add up in long texts.
    """
    p, q = sums[1] / max(1, n[1]), sums[0] / max(1, n[0])
    both = (sums[0] + sums[1] + 0.5) / (n.sum() + 1)
    z = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / max(1, n[1]) + 1 / max(1, n[0])))
    far = np.flatnonzero((z >= SIGMAS) & (sums.sum(axis=0) >= 3))
    return np.sort(far[np.argsort(-z[far], kind="stable")[:most]])


def _names(chosen: np.ndarray):
    """(bucket, hash) of every row's hashes in the chosen buckets, each once a row."""
    keep = np.zeros(BUCKETS, bool)
    keep[chosen % BUCKETS] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            for _, _, data, offsets in _slices(batch):
                row, hashed = _hashed(data, offsets)
                hit = keep[_bucket(hashed)]
                both = np.unique(np.stack([row[hit].astype(np.uint64), hashed[hit]], axis=1), axis=0)[:, 1] if hit.any() else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_bucket(both)), pa.array(both.view(np.int64))], names=["bucket", "hash"])

    return run


def _named(sample: DataFrame, chosen: np.ndarray) -> np.ndarray:
    """The commonest hash of each chosen bucket: others that fall into it, as a long text has, are no feature."""
    n = sample.mapInArrow(_names(chosen), "bucket long, hash long").groupBy("bucket", "hash").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("bucket").agg(F.max_by("hash", F.struct("n", "hash")).alias("hash")).collect()
    return np.sort(np.array([r.hash for r in best], np.int64).view(np.uint64))


def _presence(chosen: np.ndarray, named: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            found: list[np.ndarray] = []
            for lo, hi, data, offsets in _slices(batch):
                row, bucket = features(data, offsets, named)
                hit = _among(bucket, chosen)
                found += np.split(np.searchsorted(chosen, bucket[hit]).astype(np.int32), np.searchsorted(row[hit], np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("fold"), pa.array(found, pa.list_(pa.int32()))], names=["positive", "fold", "found"])

    return run


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, prior: float, steps: int = 500, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk under the logistic loss, by Adam.

    ``weights`` of the unlabelled rows sum to one. Where the estimated risk of negatives falls below
    zero, the step goes up that term instead, so that it can't be driven down further.
    """
    d = positive.shape[1]
    p, u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (positive, unlabelled))
    w = np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    penalised = np.arange(d + 1) < d
    for t in range(1, steps + 1):
        at_p, at_u = p @ w, u @ w
        rest = weights @ np.logaddexp(0, at_u) - prior * np.logaddexp(0, at_p).mean()
        share_p, share_u = 1 / (1 + np.exp(-np.clip(at_p, -40, 40))), 1 / (1 + np.exp(-np.clip(at_u, -40, 40)))
        up = -prior * ((1 - share_p) @ p) / len(p)
        down = (weights * share_u) @ u - prior * (share_p @ p) / len(p)
        grad = (up + down if rest >= 0 else -down) + decay * w * penalised
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:d], float(w[d])


def _calibrated(margin: np.ndarray, positive: np.ndarray, weights: np.ndarray, prior: float, cut: float) -> float:
    """The offset of margins that places the cut where the prior's share of all rows reaches it.

    Where confirmed rows stand so far out that the cut would fall below nearly all of them, only the
    MISSED share of them stays below it.
    """
    order = np.argsort(-margin, kind="stable")
    at = min(int(np.searchsorted(np.cumsum(weights[order]), prior)), len(order) - 1)
    return float(np.log(cut / (1 - cut)) - max(margin[order[at]], np.quantile(margin[positive], MISSED)))


class Model:
    """Chosen features with their weights, and the hashes that they are; gives each text a probability."""

    def __init__(self, chosen: np.ndarray, named: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.named, self.weights, self.bias = chosen, named, weights, bias

    @staticmethod
    def constant(bias: float) -> Model:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), bias)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, bucket = features(data, offsets, self.named)
        hit = _among(bucket, self.chosen)
        margin = self.bias + np.bincount(row[hit], self.weights[np.searchsorted(self.chosen, bucket[hit])], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, cut: float = 0.7) -> Model:
    """A model of ``labels(doc_id, toxic)`` from rows that are not held out; samples are bounded."""
    rows.bounded_batches(docs.sparkSession)
    learn = ~rows.is_held_out("doc_id", modulus, held_out)
    known = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = rows.written(known)
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if not counts.n or not counts.toxic or counts.toxic == counts.n:
        share = (counts.toxic or 0) / counts.n if counts.n else 0.0
        return Model.constant(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    order = [F.xxhash64("doc_id"), "doc_id"]
    toxic = known.where("toxic = 1").orderBy(*order).limit(POSITIVES)
    rest = docs.select("doc_id").where(learn).distinct().join(F.broadcast(toxic.select("doc_id")), "doc_id", "left_anti").orderBy(*order).limit(UNLABELLED)
    wanted = rows.written(toxic.select("doc_id", F.lit(True).alias("positive")).unionByName(rest.select("doc_id", F.lit(False).alias("positive"))))
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    sample = rows.written(sample.select("positive", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))).cast("int").alias("fold"), "text").repartition(PARTS))
    sums, n = np.zeros((2, 2 * BUCKETS), np.int64), np.zeros(2, np.int64)
    for r in sample.mapInArrow(_sum_parts, "sums binary, n binary").collect():
        sums += np.frombuffer(r.sums, np.int32).reshape(2, 2 * BUCKETS)
        n += np.frombuffer(r.n, np.int64)
    chosen = _chosen(sums, n, FEATURES)
    named = _named(sample, chosen)
    got = sample.mapInArrow(_presence(chosen, named), "positive boolean, fold int, found array<int>").collect()
    x = np.zeros((len(got), len(chosen)), np.float32)
    for i, r in enumerate(got):
        x[i, r.found] = 1
    positive = np.array([r.positive for r in got], bool)
    if not positive.any() or positive.all():
        return Model.constant(float(np.log(counts.toxic / (counts.n - counts.toxic))))
    # unlabelled texts stand for all: confirmed ones are among them with the weight that they have there
    prior = min(max(counts.toxic / counts.n, 1e-4), 0.9)
    confirmed = min(counts.toxic / max(1, docs.where(learn).count()), prior)
    weights = np.where(positive, confirmed / positive.sum(), (1 - confirmed) / (~positive).sum())
    w, b = nnpu(x[positive], x, weights, prior)
    # margins for the calibration come from weights of the other fold
    fold, margin = np.array([r.fold for r in got]), x @ w + b
    for f in (0, 1):
        here, other = fold == f, fold != f
        if not (positive & other).any() or not here.any() or positive[other].all():
            continue
        v, c = nnpu(x[positive & other], x[other], weights[other] / weights[other].sum(), prior)
        margin[here] = x[here] @ v + c
    return Model(chosen, named, w, b + _calibrated(margin, positive, weights, prior, cut))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            out = [model.scores(data, offsets) for _, _, data, offsets in _slices(batch)]
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text, ...)``.

    Labels are learnt from rows whose crc32 of the id modulo ``modulus`` is not ``held_out``; a null
    id or label teaches nothing, a document labelled both ways counts as toxic, and an id with several
    rows teaches by the least of its texts. A null or empty text gets the score of a text without any
    feature; the features of a long text are of all of it, held in one task. Without two kinds of
    labels every score is the labels' share. Equal features give equal scores. Repeated rows pass
    through; an empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, labels, modulus, held_out, cut)
    scored = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", rows.is_held_out("doc_id", modulus, held_out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))

"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier over hashed byte n-grams is
fitted (ridge regression to plus and minus one, one factorisation for all bits). A text goes to the
language whose codeword loses least, each bit weighted by its classifier's reliability; texts whose
two nearest codewords are about as near are flagged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import rows
from rinkspark.llm.hashing import LOWER, apart

BUCKETS = 2048
GRAMS = (2, 3)
#: Documents to learn from, about, and of one language at most: each language's first by hash of the id.
LABELLED = 12_000
PER_LANGUAGE = 1500
RIDGE = 0.05
PARTS = 8
#: Probability by which the best language has to lead the second.
CLEAR = 0.2
#: Loss difference that counts as e times likelier.
SCALE = 0.25
NONE = "und"
#: Bytes handled at once: arrays of eight bytes for each, several at a time.
_SLICE = 1 << 18


def codewords(n: int) -> np.ndarray:
    """Codewords of plus and minus one for ``n`` languages: exhaustive up to seven, else random columns."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, float).T
    rng = np.random.default_rng(10)
    bits = max(15, 10 * int(np.ceil(np.log2(n))))
    best = None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart_ = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if best is None or apart_ > best[0]:
            best = apart_, code
    return best[1]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of hashed n-gram counts of each whole text, at unit length."""
    n = len(offsets) - 1
    data, offsets = apart(LOWER[data], offsets)
    x = data.astype(np.uint32)
    counts = np.zeros(n * BUCKETS)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * BUCKETS
    for size in GRAMS:
        if len(x) < size:
            continue
        h = np.zeros(len(x) - size + 1, np.uint32)
        for i in range(size):
            h = h * np.uint32(0x01000193) + x[i : len(x) - size + 1 + i]
        h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)
        inside = row[: len(h)] == row[size - 1 :]
        counts += np.bincount((row[: len(h)] + h)[inside], minlength=len(counts))
    out = np.sqrt(counts.reshape(n, BUCKETS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Model:
    """Languages, their codewords, the bits' weights and reliabilities."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def likely(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages, from reliability-weighted squared hinge losses."""
        bits = np.clip(x @ self.weights[:-1] + self.weights[-1], -1.5, 1.5)
        loss = (np.maximum(0, 1 - bits[:, None, :] * self.code[None]) ** 2 * self.trust).sum(axis=2) / self.trust.sum()
        e = np.exp(-(loss - loss.min(axis=1, keepdims=True)) / SCALE)
        return e / e.sum(axis=1, keepdims=True)


def fitted(languages: list[str], x: np.ndarray, y: np.ndarray) -> Model:
    code = codewords(len(languages))
    target = code[y]
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    gram = (x1.T @ x1).astype(np.float64) + RIDGE * np.eye(x1.shape[1])
    weights = np.linalg.solve(gram, (x1.T @ target.astype(x.dtype)).astype(np.float64))
    right = ((x1 @ weights) * target > 0).mean(axis=0)
    return Model(languages, code, weights, np.maximum(0.05, np.log((right + 0.01) / (1.01 - right)) / np.log(101)))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = rows.utf8(batch.column("text"))
    for lo, hi in rows.pieces(offsets, _SLICE):
        for a in range(lo, hi, 512):  # the counts take BUCKETS numbers a row
            b = min(hi, a + 512)
            yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows.released(batches):
        x = [features(data, offsets).astype(np.float16).tobytes() for _, _, data, offsets in _slices(batch)]
        raw, size = b"".join(x), BUCKETS * 2
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([raw[i * size : (i + 1) * size] for i in range(batch.num_rows)], pa.binary())], names=["lang", "x"])


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> Model:
    """A model of the languages of documents that are not held out; the sample is bounded."""
    rows.bounded_batches(docs.sparkSession)
    learn = ~rows.is_held_out("doc_id", modulus, held_out)
    known = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang").distinct()
    # each language has an equal part in the sample: that share of the hash range holds about so many of its documents, and all if it has fewer
    sizes = rows.written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    n_languages = sizes.count()
    most = min(PER_LANGUAGE, LABELLED / max(1, n_languages))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    wanted = known.join(rows.small(sizes, n_languages), "lang").where(place * F.col("n").cast("double") < most * float(1 << 40))
    wanted = rows.written(wanted.select("doc_id", "lang"))
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(wanted), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = sample.select("lang", "text").repartition(PARTS).mapInArrow(_sample, "lang string, x binary").toArrow()
    names = got.column("lang").to_pylist()
    languages = sorted(set(names))
    if len(languages) < 2:
        return Model(languages, codewords(len(languages)), np.zeros((BUCKETS + 1, 1)), np.ones(1))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    where = {name: i for i, name in enumerate(languages)}
    return fitted(languages, x, np.array([where[n] for n in names]))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            names, scores, unclear = [], [], []
            for _, _, data, offsets in _slices(batch):
                n = len(offsets) - 1
                if len(model.languages) < 2:
                    names += (model.languages or [NONE]) * n
                    scores.append(np.full(n, float(len(model.languages))))
                    unclear.append(np.zeros(n, bool))
                    continue
                p = model.likely(features(data, offsets))
                names += [model.languages[i] for i in p.argmax(axis=1)]
                top = np.sort(p, axis=1)
                scores.append(top[:, -1])
                unclear.append(top[:, -1] - top[:, -2] < CLEAR)
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lettered"), pa.array(names, pa.string()), pa.array(join(scores, float)), pa.array(join(unclear, bool))], names=["doc_id", "lettered", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row of ``docs(doc_id, text, lang, ...)``.

    Languages are learnt from rows whose crc32 of the id modulo ``modulus`` is not ``held_out`` and
    whose lang is not null; about ``LABELLED`` documents, as many of each language as there are or as
    its equal part allows. A document's rows of one lang teach by one of their texts. A text that is
    null or has no letter is ``und`` with score 0, as all are if no language can be learnt. Of
    codewords that lose alike the language first in order is chosen, flagged as ambiguous. The
    counts of a long text are of all of it. Null ids and repeated rows pass through; an empty table
    gives an empty result; other columns are not read.
    """
    model = fit(docs, modulus, held_out)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    said = docs.select("doc_id", "text", lettered).mapInArrow(_predict(model), "doc_id long, lettered boolean, lang_pred string, score double, ambiguous boolean")
    named = F.col("lettered") & (F.col("lang_pred") != NONE)
    return said.select("doc_id", rows.is_held_out("doc_id", modulus, held_out).alias("held_out"), F.when(named, F.col("lang_pred")).otherwise(NONE).alias("lang_pred"), F.when(named, F.col("score")).otherwise(0.0).alias("score"), (F.col("ambiguous") & named).alias("ambiguous"))

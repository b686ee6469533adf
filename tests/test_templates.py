import random

import numpy as np
import pytest

from rinkspark.operators import clusters, templates
from rinkspark.streaming import screens

ROWS = "ordinal int, label string, words array<long>"


def _apart(a, b):
    return sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True))


def _bitmaps(seed, n, labels=3, spread=6):
    rng = random.Random(seed)
    centre = [[rng.getrandbits(63), rng.getrandbits(64) - 2**63] for _ in range(labels)]
    out = []
    for i in range(n):
        c = rng.randrange(labels)
        words = list(centre[c])
        for _ in range(rng.randint(0, spread)):
            w = rng.randrange(2)
            words[w] ^= 1 << rng.randrange(62)
        out.append((3 * i, str(rng.choice([c, c, c, (c + 1) % labels])), words))
    return out


@pytest.mark.parametrize("most", [1000, 7])
def test_nearest_by_parts_is_nearest_of_all(spark, most):
    known, samples = _bitmaps(1, 60), [(i, w) for i, _, w in _bitmaps(1, 90)[40:]] + [(1, [0, -1]), (2, [0, -1])]
    got = {r.id: (r.label, r.score, r.other) for r in templates.nearest(spark.createDataFrame(samples, "id int, words array<long>"), spark.createDataFrame(known, ROWS), "id", 128, most=most).collect()}
    for i, w in samples:
        score, _, label = min((_apart(w, t), o, lab) for o, lab, t in known)
        other = min((_apart(w, t) for _, lab, t in known if lab != label), default=None)
        assert got[i] == (label, score / 128, other / 128)
    one = spark.createDataFrame([(0, "only", [5, 6])], ROWS)
    [r] = templates.nearest(spark.createDataFrame([(1, [5, 7])], "id int, words array<long>"), one, "id", 128).collect()
    assert (r.label, r.score, r.other, r.confident) == ("only", 1 / 128, None, True)
    assert templates.nearest(one, one.limit(0), "ordinal", 128).count() == 0


@pytest.mark.parametrize("most", [1000, 9])
def test_leaving_one_out_by_parts(spark, most):
    known = [*_bitmaps(2, 40), (1, "alone", [7, 7])]
    got = {r.ordinal: (r.label, r.predicted, r.same, r.other) for r in templates.leave_one_out(spark.createDataFrame(known, ROWS), 128, most).collect()}
    for o, label, w in known:
        rest = [(_apart(w, t), p, lab) for p, lab, t in known if p != o]
        same = min((d for d, _, lab in rest if lab == label), default=None)
        other = min(d for d, _, lab in rest if lab != label)
        assert got[o] == (label, min(rest)[2], None if same is None else same / 128, other / 128)
    [r] = templates.leave_one_out(spark.createDataFrame(known[:1], ROWS), 128).collect()
    assert (r.predicted, r.same, r.other) == (None, None, None)


@pytest.mark.parametrize("within", [0, 1, 4, 8])
def test_thinning_keeps_what_the_scan_in_order_keeps(spark, within):
    known = _bitmaps(3, 80)
    kept = []
    for o, label, w in known:
        if all(label != k or _apart(w, t) > within for _, k, t in kept):
            kept.append((o, label, w))
    got = [tuple(r) for r in templates.thinned(spark.createDataFrame(known, ROWS).repartition(3), within).collect()]
    assert sorted(got) == kept and (within == 0 or len(kept) < len(known))


def test_segments_of_frames_settle_as_one(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for source in range(6):
        frames, value = [], 0
        for i in range(rng.choice([1, 40, 400])):
            value = rng.choice([value, value, value ^ 1 << rng.randrange(8), rng.getrandbits(40)])
            frames.append((3 * i, value))
        out, _, _ = screens.settle(iter(frames))
        rows += [(source, o, v) for o, v in frames]
        want |= {(source, o) for o in out}
    df = spark.createDataFrame(rows, "source int, ordinal int, hash long").repartition(4)
    for segment in (1, 7, 50_000):
        found = screens.settled(df, segment=segment)
        assert found.dtypes == [("source", "int"), ("ordinal", "int")]
        assert {tuple(r) for r in found.collect()} == want
    assert screens.settled(df.limit(0)).count() == 0


def test_lloyd_rounds_are_the_same_on_any_partitioning(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.3, (30, 3)) for c in (0, 2, 5)]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id int, features array<float>")
    got = [{r.id: r.cluster for r in clusters.lloyd(df.repartition(n), 3, "id", 2).collect()} for n in (1, 5)]
    assert got[0] == got[1]
    grid = np.floor(points.astype(float) * clusters.GRID).astype(np.int64)
    centres = [np.floor_divide(grid[[i for i in got[0] if got[0][i] == c]].sum(axis=0), list(got[0].values()).count(c)) for c in (1, 2, 3)]
    assert all(got[0][i] == 1 + min(range(3), key=lambda j: (((grid[i] - centres[j]) ** 2).sum(), j)) for i in got[0])
    assert {r.cluster for r in clusters.lloyd(df.limit(2), 3, "id").collect()} == {1, 2}
    assert clusters.lloyd(df.limit(0), 3, "id").count() == 0

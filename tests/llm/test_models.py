import random
import zlib

import numpy as np

from rinkspark.llm import language_id, quality, toxicity


def _prose(rng, n, letters="etaoinshr"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_positive_unlabelled_learning_finds_held_out_toxic_texts(spark, docs_of):
    rng = random.Random(1)
    bad = ["vilest", "loathso", "grumblegrot"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = _prose(rng, 60).split()
        for _ in range(4 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "er", "ing"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, None, int(toxic)))
    labels += [(None, 1, 1), (3, 1, None)]
    rows += [(9001, None), (9002, ""), (None, rows[0][1]), (9003, _prose(rng, 30_000))]
    got = toxicity.score(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    right = sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held)
    assert right > 0.95
    assert {r.doc_id: r.score for r in got if r.doc_id in (9001, 9002, 9003) and r.predicted} == {}


def test_risk_is_not_negative_for_separable_data():
    x = np.vstack([np.tile([1.0, 0.0], (30, 1)), np.tile([0.0, 1.0], (300, 1))])
    w, b = toxicity.nnpu(x[:30], x, np.full(330, 1 / 330), 0.1)
    assert w[0] + b > 0 > w[1] + b


def test_quality_separates_junk(spark, docs_of):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = _prose(rng, 80).capitalize() + "." if good else rng.choice([" ".join(["same"] * 80), _prose(rng, 60).replace(" ", "### "), _prose(rng, 60).upper() + "!!"])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(9001, None), (9002, ""), (None, rows[1][1])]
    labels += [(None, 0, 0), (2, None, 0)]
    got = quality.score(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and sum(r.predicted == (r.doc_id % 4 > 0) for r in held) / len(held) > 0.95
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_isotonic_fit_is_the_pooled_mean():
    x, y = np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1])
    steps, values = quality.isotonic(x, y)
    assert list(np.interp(x, steps, values)) == [0, 0.5, 0.5, 1]


def test_statistics_of_texts_do_not_depend_on_neighbours():
    texts = [b"One two two. Three!", b"", b"a\nb\na\n", "Été à la plage".encode()]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    together = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_languages_are_told_apart_and_letterless_texts_are_not(docs_of):
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "efghi", "cc": "klmno", "dd": "noprs"}
    names = list(letters)
    rows = [(i, _prose(rng, 40, letters[names[i % 4]])) for i in range(400)]
    lang = lambda i: names[i % 4] if i is not None and i < 400 else None
    rows += [(9001, None), (9002, ""), (9003, "123 !!"), (None, rows[0][1])]
    got = language_id.identify(docs_of(rows, lang)).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(r.lang_pred == names[r.doc_id % 4] for r in held)
    none = {r.doc_id: r for r in got if r.doc_id in (9001, 9002, 9003)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in none.values())


def test_mixed_texts_are_ambiguous_and_codewords_are_apart():
    code = language_id.codewords(4)
    assert code.shape == (4, 7) and min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) >= 4
    assert language_id.codewords(12).shape[0] == 12


def test_without_labels_or_rows(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a b"), (2, None)], lambda i: None)
    assert all(r.score == 0.5 for r in quality.score(docs, labels).collect())
    assert all(r.predicted == 0 for r in toxicity.score(docs, labels).collect())
    assert all(r.lang_pred == "und" for r in language_id.identify(docs).collect())
    empty = docs.limit(0)
    assert quality.score(empty, labels).count() == toxicity.score(empty, labels).count() == language_id.identify(empty).count() == 0


def test_isotonic_fit_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = rng.permutation(30).astype(float)
        y = (rng.random(30) < x / 30).astype(float)
        by = y[np.argsort(x)]
        want = [max(min(by[a : b + 1].mean() for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
        steps, values = quality.isotonic(x, y)
        assert np.allclose(np.interp(np.arange(30.0), steps, values), want)


def _raw(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_quality_weights_match_dense_equations_and_repeated_rows_change_nothing(spark, docs_of):
    rng = random.Random(5)
    texts = {i: _prose(rng, 30) if i % 3 else _prose(rng, 20).upper() + "!!" for i in range(90)}
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in texts], "doc_id long, quality int, toxic int")
    model = quality.fit(docs_of(list(texts.items())), labels)
    again = quality.fit(docs_of(list(texts.items()) + [(7, texts[7])] * 200), labels)
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    x = np.concatenate([quality.statistics(*_raw(texts[i])) for i in learnt])
    z = quality.Model.cosines(x, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3))
    y = np.array([i % 3 > 0 for i in learnt], float)
    dense = np.linalg.solve(z.T @ z + quality.RIDGE * np.diag([1.0] * quality.COSINES + [1e-7]), z.T @ y)
    # the constant's penalty is the least that keeps the equations regular
    assert np.allclose(z @ model.weights, z @ dense, atol=1e-3)
    assert np.allclose(model.weights, again.weights, atol=1e-9)


def test_output_codes_match_dense_equations(docs_of):
    rng = random.Random(6)
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "ghijkl"}
    names = list(letters)
    rows = [(i, _prose(rng, 25, letters[names[i % 3]])) for i in range(120)]
    lang = lambda i: names[i % 3]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs_of(rows, lang)).collect()}
    x = np.concatenate([language_id.features(*_raw(t)) for _, t in rows])
    learnt = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    code = language_id.codewords(3)
    a = np.hstack([x[learnt].astype(np.float16).astype(float), np.ones((len(learnt), 1))])
    w = np.linalg.solve(a.T @ a + language_id.RIDGE * np.eye(a.shape[1]), a.T @ code[[i % 3 for i in learnt]])
    bits = np.clip(np.hstack([x, np.ones((len(x), 1))]) @ w, -1.5, 1.5)
    right = ((a @ w) * code[[i % 3 for i in learnt]] > 0).mean(axis=0)
    trust = np.maximum(0.05, np.log((right + 0.01) / (1.01 - right)) / np.log(101))
    for i, _ in rows:
        loss = [sum(trust[b] * max(0, 1 - bits[i, b] * code[k, b]) ** 2 for b in range(code.shape[1])) / trust.sum() for k in range(3)]
        p = np.exp(-np.array(loss) / language_id.SCALE)
        assert got[i][0] == names[int(np.argmin(loss))] and abs(got[i][1] - p.max() / p.sum()) < 0.02


def test_rare_languages_are_learnt_beside_frequent_ones(docs_of, monkeypatch):
    monkeypatch.setattr(language_id, "LABELLED", 60)
    rng = random.Random(7)
    alphabets = {f"l{k:02d}": [chr(97 + (3 * k + j) % 26) for j in range(4)] for k in range(12)}
    names = list(alphabets)
    of = {i: names[i % 12] if i < 60 else names[0] for i in range(600)}
    rows = [(i, _prose(rng, 30, alphabets[of[i]])) for i in range(600)]
    got = language_id.identify(docs_of(rows, lambda i: of[i])).collect()
    assert {r.lang_pred for r in got} == set(names)


def test_risk_steps_match_a_numeric_gradient():
    rng = np.random.default_rng(8)
    p, u = (rng.random((20, 3)) < 0.5).astype(float), (rng.random((60, 3)) < 0.4).astype(float)
    weights, prior = np.full(60, 1 / 60), 0.2

    def risk(w):
        at_p, at_u = p @ w[:3] + w[3], u @ w[:3] + w[3]
        rest = (weights * np.logaddexp(0, at_u)).sum() - prior * np.logaddexp(0, at_p).mean()
        return prior * np.logaddexp(0, -at_p).mean() + max(0, rest) + 0.5e-4 * (w[:3] ** 2).sum()

    w, b = toxicity.nnpu(p, u, weights, prior, steps=4000, rate=0.01)
    best = np.append(w, b)
    for k in range(4):
        for step in (-0.05, 0.05):
            other = best.copy()
            other[k] += step
            assert risk(other) >= risk(best) - 1e-4


def test_long_and_repeated_rows_of_the_models(spark, docs_of):
    rng = random.Random(9)
    long = _prose(rng, 200_000)
    rows = [(i, _prose(rng, 20) if i % 2 else _prose(rng, 20).upper()) for i in range(60)] + [(99, long), (99, long), (1, "other text of one id")]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows, lambda i: "aa" if i % 2 else "bb")
    for got in (quality.score(docs, labels), toxicity.score(docs, labels), language_id.identify(docs)):
        got = got.collect()
        assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 99}) == 1


def test_equal_scores_are_one_point_in_any_order():
    x, y = np.array([1.0, 1, 1, 1, 2]), np.array([0.0, 0, 1, 1, 1])
    rng = np.random.default_rng(3)
    for _ in range(20):
        order = rng.permutation(5)
        steps, values = quality.isotonic(x[order], y[order])
        assert list(np.interp([1.0, 2.0], steps, values)) == [0.5, 1.0]
    x, y = rng.integers(0, 9, 300).astype(float), rng.integers(0, 2, 300).astype(float)
    first = quality.isotonic(x, y)
    for _ in range(10):
        order = rng.permutation(300)
        again = quality.isotonic(x[order], y[order])
        assert np.allclose(first[0], again[0]) and np.allclose(first[1], again[1])
    assert np.all(np.diff(first[1]) >= 0)

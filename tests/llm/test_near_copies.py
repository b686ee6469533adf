import random

import corpus_pipeline
import pyarrow as pa

from rinkspark.llm import near_copies


def _set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def _naive(ids, texts):
    sets, group = [_set(t) for t in texts], list(range(len(ids)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    return [least[root(i)] for i in range(len(ids))]


def _edited(seed):
    """Copies on both sides of the threshold, chains of them, and texts of few words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(30, 150))) for _ in range(8)]
    for _ in range(120):
        w = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w[rng.choice([0, 0, 3]) :]))
    return [*texts, None, "", " \n", "one two", "One\tTWO", "one", texts[0].upper()]


def _check(docs_of, texts):
    ids = [500 - i if i % 11 else None for i in range(len(texts))]
    got = near_copies.near_copies(docs_of(list(zip(ids, texts)))).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(map(str, zip(ids, _naive(ids, texts))))


def test_components_match_brute_force_jaccard(docs_of):
    _check(docs_of, _edited(1))


def test_crowded_bands_keep_every_component(docs_of, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", 2)
    _check(docs_of, _edited(2))


def test_a_set_too_large_for_a_byte_a_bucket_has_no_histogram():
    texts = [" ".join(f"w{i * i}" for i in range(20_000)), "a b c d e f g"]
    (got,) = near_copies._sets(5)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    assert [len(x) for x in got["set"].to_pylist()] == [19_996, 3]
    assert got["bag"].type == pa.list_(pa.int8()) and [x and sum(x) for x in got["bag"].to_pylist()] == [None, 3]


def test_pairs_of_sets_without_histogram_are_kept(spark):
    full, none = [20] + [0] * 127, None
    sets = spark.createDataFrame([(i, 20, list(range(20)), bag) for i, bag in enumerate([none, none, full, [0] * 127 + [20]])], "node long, size int, set array<long>, bag array<tinyint>")
    pairs = near_copies._prefix_pairs(sets.selectExpr("node", "node as root"), sets, 0.8)
    assert {(r.u, r.v) for r in pairs.collect()} == {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)}


def test_no_documents(docs_of):
    assert near_copies.near_copies(docs_of([(1, "x")]).limit(0)).count() == 0


def test_stage_drops_an_edited_copy(spark, docs_of):
    words = [f"w{i * i % 997}" for i in range(100)]
    copy, other = [*words[:50], "changed", *words[51:]], [f"v{w}" if i % 9 == 0 else w for i, w in enumerate(words)]
    docs = docs_of([(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(other))])
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == {1, 3}

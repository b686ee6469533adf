import random
import time
from collections import Counter

from rinkspark.llm import decontaminate


def _words(rng, n, of=4000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def _shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def _best(doc, item):
    """(similarity, start, windows) over all windows of the item's size that start at a shared shingle or end the text."""
    d, b = _shingles(doc), _shingles(item)
    weight, found = Counter(b), []
    for s in {max(0, min(p, len(d) - len(b))) for p, h in enumerate(d) if h in weight}:
        window = Counter(d[s : s + len(b)])
        both = sum(min(n, weight[h]) for h, n in window.items())
        sim = both / (len(b) + sum(window.values()) - both)
        if sim >= 0.8:
            found.append((sim, s))
    return (round(max(found)[0], 9), min(s for v, s in found if v == max(found)[0]), len(found)) if found else None


def test_windows_of_repetitive_texts_match_brute_force(spark, docs_of):
    """Shingles that occur often, in the item and around it, count as often as both have them."""
    rng = random.Random(1)
    items = [(i, _words(rng, n, of)) for i, (n, of) in enumerate([(40, 3), (60, 4000), (25, 2), (5, 9), (80, 6)])] + [(9, ["a"] * 30), (1, _words(rng, 30))]
    docs = []
    for k in range(60):
        _, item = rng.choice(items)
        text = list(item)
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(text)
        cut = rng.randint(0, 2)
        docs.append((k, _words(rng, rng.randint(0, 20), 3) + text[cut:] * rng.choice([1, 1, 2]) + _words(rng, rng.randint(0, 12), 3)))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    given = docs_of([(k, " ".join(w)) for k, w in docs] + [(3, " ".join(docs[3][1])), (70, " ".join(docs[5][1])), (None, " ".join(docs[6][1]))])
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_windows) for r in decontaminate.leaks(given, table).collect()}
    want = {}
    for k, w in [*docs, (70, docs[5][1]), (None, docs[6][1])]:
        for i, item in items:
            if found := _best(w, item):
                want[k, i] = max(found, want.get((k, i), found))
    missed = want.keys() - got.keys()
    assert got.keys() <= want.keys() and len(missed) <= 0.02 * len(want) and len(want) > 40
    assert all(got[k] == want[k] for k in got if k[1] != 1)
    assert all(got[k][0] == want[k][0] for k in got)


def test_items_of_thousands_of_words_take_seconds(spark, docs_of):
    rng = random.Random(2)
    item = _words(rng, 5000, 100_000)
    near = list(item)
    for i in range(0, 5000, 400):
        near[i] = "other"
    docs = docs_of([(1, " ".join(_words(rng, 3000) + item + _words(rng, 3000))), (2, " ".join(near)), (3, " ".join(item[:2400])), (4, " ".join(_words(rng, 8000, 100_000)))])
    table = spark.createDataFrame([(7, " ".join(item)), (8, "a b c d e f")], "item_id long, text string")
    decontaminate.leaks(docs.limit(1), table.where("item_id = 8")).collect()
    began = time.monotonic()
    got = {r.doc_id: (r.item_id, round(r.similarity, 4), r.start) for r in decontaminate.leaks(docs, table).collect()}
    took = time.monotonic() - began
    shared = 4996 - 5 * 13 + 4  # thirteen words changed, the first of all in one shingle alone
    assert got == {1: (7, 1.0, 3000), 2: (7, round(shared / (2 * 4996 - shared), 4), 1)} or got[2][1] == round(shared / (2 * 4996 - shared), 4)
    assert set(got) == {1, 2} and took < 30

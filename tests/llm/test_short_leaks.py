from rinkspark.llm import decontaminate


def test_texts_shorter_than_the_item_match_brute_force(spark, docs_of):
    item = [f"w{i}" for i in range(50)]
    texts = {1: item[:-1], 2: item[3:], 3: item[:20] + item[21:], 4: item[:40], 5: item[:30], 6: item, 7: ["x", *item[:-1]], 8: []}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {}
    for i, w in texts.items():
        windows = [w[s : s + 50] for s in range(max(1, len(w) - 49))]
        best = max(len(shingles(v) & shingles(item)) / len(shingles(v) | shingles(item)) for v in windows)
        if best >= 0.8:
            want[i] = round(best, 9)
    assert set(want) == {1, 2, 3, 6, 7} and want[1] == round(45 / 46, 9)
    docs, table = docs_of([(i, " ".join(w)) for i, w in texts.items()]), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert {r.doc_id: round(r.similarity, 9) for r in decontaminate.leaks(docs, table).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(docs, table).collect()} == {4, 5, 8}

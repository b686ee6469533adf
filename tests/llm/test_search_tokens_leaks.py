import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from rinkspark.llm import byte_bpe, decontaminate, topk
from rinkspark.llm.queries import RANKS, bpe_digests


def _naive_topk(rows, k=5, every=50):
    vecs = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in vecs if i % every == 0}.items():
        best = sorted((-int(v @ w), j) for j, w in vecs if j != q and len(w) == len(v))[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12) * rng.choice([0.1, 1, 3])]) for i in range(600)]
    rows += [(i, rows[0][1]) for i in range(600, 640)] + [(700, [0.0] * 12), (701, None), (702, [1.0] * 11 + [float("nan")]), (703, [1.0] * 11 + [None]), (None, [1.0] * 12), rows[3], (750, [1.0, 2.0]), (751, [1.0, 3.0]), (800, [])]
    table = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, norm double").repartition(4)
    got = sorted(tuple(r) for r in topk.top_inner_products(table).collect())
    assert got == _naive_topk(rows)
    assert topk.top_inner_products(table.limit(0)).count() == 0


def test_blocks_and_floors_do_not_change_results(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 40), ("QUERY_ROWS", 3), ("SEED_VECTORS", 10), ("TIERS", 5), ("FIT_VECTORS", 50)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=20)]) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_inner_products(table).collect()) == _naive_topk(rows)


def test_huge_components_stay_exact():
    q, c = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 5.0]])
    assert topk._products(q, c)[0, 0] == 2**60 + 15


def _codec():
    return byte_bpe.codec(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def _texts():
    rng = random.Random(3)
    parts = ["hello", " world", "'ll", "'", "  ", "\n\n", "\t", "é", "123", "!!", " ...", "日本", "　", "x", "😀", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(60)] + ["a" * 3000, " " * 2000 + "b", "\n" * 700, "", None]


def test_tokens_match_one_pass_however_texts_are_cut(docs_of):
    texts, enc = _texts(), _codec()
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    for chunk, overlap in ((50, 20), (300, 8), (1 << 15, 512)):
        encoded = byte_bpe.encode(docs_of([(i, t) for i, t in enumerate(texts)]), path, pattern, chunk, overlap, keep_text=True)
        got = {r.doc_id: r for r in byte_bpe.decode(encoded, path, pattern).collect()}
        both = byte_bpe.encode_and_decode(docs_of([(i, t) for i, t in enumerate(texts)]), path, pattern, chunk, overlap).select("doc_id", "ids", "decoded")
        assert {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in both.collect()} == {i: (list(r.ids), bytes(r.decoded)) for i, r in got.items()}
        for i, t in enumerate(texts):
            assert list(got[i].ids) == enc.encode_ordinary(t or ""), (chunk, i)
            assert bytes(got[i].decoded) == (t or "").encode() and got[i].text == (t or "")


def test_stitching_without_a_common_boundary():
    pattern = public_tokenizers.PATTERN
    text = "a" * 120 + " b" * 40
    chunks = []
    for j, start in enumerate(range(0, len(text), 30)):
        part = text[start : start + 40]
        found = byte_bpe.boundaries(part, pattern, start + 40 >= len(text))
        chunks.append((start, part, [start + b for b in found if b <= 10], [start + b for b in found if b >= 30]))
    pieces = list(byte_bpe.stitch(chunks, pattern))
    assert "".join(pieces) == text
    assert byte_bpe.encode_pieces(pieces, _codec()) == _codec().encode_ordinary(text)


def test_digests(docs_of):
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    rows = bpe_digests(byte_bpe.decode(byte_bpe.encode(docs_of([(None, ""), (2, "hi there"), (2, "hi there")]), path, pattern), path, pattern)).collect()
    import hashlib

    want = hashlib.sha256(" ".join(map(str, _codec().encode_ordinary("hi there"))).encode()).hexdigest()
    assert sorted(str((r.doc_id, r.n_tokens)) for r in rows) == ["(2, 2)", "(2, 2)", "(None, 0)"]
    assert {r.ids_sha256 for r in rows if r.doc_id} == {want}
    assert byte_bpe.encode(docs_of([(1, "x")]).limit(0), path, pattern).count() == 0
    long = byte_bpe.encode(docs_of([(None, "ab " * 100), (None, "ab " * 100)]), path, pattern, 50, 20).collect()
    assert [(r.doc_id, list(r.ids)) for r in long] == [(None, _codec().encode_ordinary("ab " * 100))] * 2


def _words(text):
    import re

    return [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]


def _naive_leaks(docs, items):
    out = {}
    for i, t in docs:
        w = _words(t)
        have = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])
        for item, text in items:
            v = _words(text)
            want = [tuple(v[k : k + 5]) for k in range(len(v) - 4)] or ([tuple(v)] if v else [])
            n = len(want)
            if not set(have) & set(want):
                continue
            for s in range(max(1, len(have) - n + 1)):
                window = have[s : s + n]
                if n and window:
                    both = sum(min(window.count(x), want.count(x)) for x in set(want))
                    alike = both / (n + len(window) - both)
                    if alike >= 0.8:
                        out[(i, item)] = max(out.get((i, item), 0), alike)
    return out


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_leaks_match_brute_force(spark, docs_of, monkeypatch, by_shuffle):
    if by_shuffle:
        monkeypatch.setattr(decontaminate, "KNOWN_SHINGLES", 0)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(k, prose(rng.randint(15, 60))) for k in range(12)] + [(50, ["one", "two"]), (51, []), (52, prose(30))]
    docs = []
    for i in range(60):
        body = prose(rng.randint(0, 80))
        _, item = rng.choice(items)
        part = list(item)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            if part:
                part[rng.randrange(len(part))] = word()
        if rng.random() < 0.3 and len(part) > 20:
            part.insert(rng.randrange(len(part)), word())
        at = rng.randint(0, len(body))
        if i % 5 == 0:  # a copy cut short at the text's start and end
            body, part = [], part[rng.randint(0, 2) : len(part) - rng.randint(0, 2)]
            at = 0
        joined = body[:at] + part + body[at:] if i % 3 else body
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(joined).capitalize()))
    docs += [(900, None), (901, ""), (902, "One, two"), (None, " ".join(items[0][1])), (903, " ".join(items[1][1] * 3)), (904, " ".join(items[2][1][:-1])), (904, " ".join(items[2][1][2:]))]
    table = spark.createDataFrame([(k, " ".join(w), 1.0) for k, w in items] + [(None, "x y", 0.0), (60, None, 0.0)], "item_id long, text string, size double")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs_of(docs), table).collect()}
    want = _naive_leaks(docs, [(k, " ".join(w)) for k, w in items])
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert (904, 2) in want
    kept = {r.doc_id for r in decontaminate.clean(docs_of(docs), table).collect()}
    assert kept == {i for i, _ in docs if i is None or not any(k[0] == i for k in want)}


def test_starts_and_empty_tables(spark, docs_of):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(5)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start) for r in decontaminate.leaks(docs_of([(k, "intro here " + t) for k, t in items]), table).collect())
    assert got == [(k, k, 2) for k in range(5)]
    assert decontaminate.leaks(docs_of([(1, "x")]), table.limit(0)).count() == 0
    assert decontaminate.leaks(docs_of([(1, "x")]).limit(0), table).count() == 0


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = [base]
    for n in range(64):
        x = base
        for b in rng.sample(range(64), n):
            x ^= 1 << b
        prints.append(x)
    signed = [(i, p - (1 << 64) if p >> 63 else p, 9) for i, p in enumerate(prints)]
    items = spark.createDataFrame([signed[0]], "item_id long, fp long, size int")
    keys = {(r.block, r.value) for r in decontaminate._item_keys(items).collect()}
    blocks = spark.createDataFrame(signed, "item_id long, fp long, size int").selectExpr("fp", *(f"{decontaminate._block(i)} as b{i}" for i in range(decontaminate.BLOCKS))).collect()
    for r in blocks:
        if ((r.fp ^ signed[0][1]) & (2**64 - 1)).bit_count() <= decontaminate.RADIUS:
            assert any((i, r[f"b{i}"]) in keys for i in range(decontaminate.BLOCKS))

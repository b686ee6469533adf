import hashlib
import random
import re

import numpy as np
import xxhash

from rinkspark.llm import components, rows, simhash_dedup, suffix_dedup


def _naive_removal(texts, depth):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - depth + 1):
            seen[b[i : i + depth]] = seen.get(b[i : i + depth], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def _naive_sharing(docs, words):
    seen = {}
    docs = [(i, t, (t or "").encode().split()) for i, t in docs]
    for i, t, w in docs:
        for k in range(len(w) - words + 1):
            seen.setdefault(tuple(w[k : k + words]), set()).add((i, t))
    return [int(any(len(seen[tuple(w[k : k + words])]) > 1 for k in range(len(w) - words + 1))) for _, _, w in docs]


def _near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(rng.randint(30, 120)) for _ in range(6)]
    texts = list(base)
    for _ in range(25):
        t = rng.choice(base)
        a, b = sorted(rng.randrange(len(t)) for _ in range(2))
        texts.append(rng.choice([t, t[a:b], prose(8) + t[a:] + prose(5), t[:a] + "#" + t[b:], t[a:b] + t[a:b]]))
    return texts + [None, "", "a" * 500, "ab" * 300, texts[0]]


def test_repeats_match_brute_force(docs_of):
    for seed, depth, gram in ((1, 40, 10), (2, 64, 16)):
        texts = _near_copies(seed)
        got = suffix_dedup.remove_repeats(docs_of([(i if i % 9 else None, t) for i, t in enumerate(texts)]), depth, gram, 9).collect()
        shares = _naive_sharing([(i if i % 9 else None, t) for i, t in enumerate(texts)], 9)
        assert {0, 1} == set(shares)
        want = [(i if i % 9 else None, *w, s) for i, (w, s) in enumerate(zip(_naive_removal(texts, depth), shares))]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_long_texts_are_cut_into_stretches(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    texts = [text, "x" + text[1300:2600], text[100:3000] + "y"]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    assert all(len(d) > 700 for d in data)
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs_of(list(enumerate(texts))), 60, 15, 7).collect())
    assert got == [(i, *w, s) for i, (w, s) in enumerate(zip(_naive_removal(texts, 60), _naive_sharing(enumerate(texts), 7)))]


def test_repeats_without_broadcasts(docs_of, monkeypatch):
    monkeypatch.setattr(rows, "BROADCAST_ROWS", 0)
    texts = _near_copies(8)
    got = suffix_dedup.remove_repeats(docs_of(list(enumerate(texts))), 40, 10).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted((i, *w) for i, w in enumerate(_naive_removal(texts, 40)))


def test_depth_of_production_matches_brute_force(docs_of):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8))) for _ in range(n))
    long, passage, short = prose(90), prose(55), prose(50)
    texts = [prose(40) + " " + long, long + prose(5), prose(70) + " " + passage + " " + prose(30), passage, prose(9) + " " + short, short + " " + prose(3), prose(60), long[3:403], long[3:402], passage + " " + prose(4) + " " + passage]
    twice = prose(60)
    texts += [twice + " " + twice, "w " * 300]
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs_of(list(enumerate(texts)))).collect())
    shares = _naive_sharing(enumerate(texts), 51)
    assert shares == [1, 1, 1, 1, 0, 0, 0, 1, 1, 1, 0, 0]
    assert got == [(i, *w, s) for i, (w, s) in enumerate(zip(_naive_removal(texts, 400), shares))]


def test_no_documents(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([(1, "x")]).limit(0)).count() == 0
    assert simhash_dedup.near_duplicates(docs_of([(1, "x")]).limit(0)).count() == 0


def _naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _naive_components(ids, prints):
    group = list(range(len(ids)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprints_match_brute_force():
    for text in [*_near_copies(3), "One TWO three\x0bfour\x1cfive", "ÀB c", "x " * 70_000]:
        assert simhash_dedup.fingerprint(text) == _naive_fingerprint(text)


def test_components_match_brute_force(docs_of):
    texts = [*_near_copies(4), "One two", "one TWO", None]
    ids = [100 - i if i % 7 else None for i in range(len(texts))]
    got = simhash_dedup.near_duplicates(docs_of(list(zip(ids, texts)))).collect()
    prints = [_naive_fingerprint(t) for t in texts]
    want = zip(ids, prints, _naive_components(ids, prints))
    assert sorted(map(str, ((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got))) == sorted(map(str, want))


def test_crowded_variants_keep_every_component(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CROWD", 3)
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = set(base)
    for _ in range(150):
        x = rng.choice(base)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.choice([0, 1, 2, 3, 31, 32, 33, 40, 62, 63])
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    for r in edges.collect():
        assert bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= 2
    roots = {r.node: r.root for r in components.components(edges).collect()}
    want = _naive_components(signed, prints)
    assert [roots.get(s, s) for s in signed] == want


def test_components_of_chains_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(60, 50), (50, 60), (70, 70), (None, 1)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50}

import hashlib
import random
import re
from collections import Counter

import numpy as np

from rinkspark.llm import personal_data, rows, secret_scan


def _naive_secrets(text):
    text = text or ""
    out = []
    for kind, pattern, ok in (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m)]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def _naive_personal(text):
    text = text or ""

    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (2 if i % 2 else 1)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return out


def _texts(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_secret_patterns_match_the_plain_expressions():
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "K", "ſecret", ": ", " = ", '"', "'", "abcdef12", "AKIA", "A1B2C3D4E5F6", "0123456789abcdef" * 2, " ", "é", ".", "=", "x"]
    for text in _texts(parts, 3000, 1):
        assert secret_scan.base_spans(text) == _naive_secrets(text), text


def test_personal_patterns_match_the_plain_expressions():
    parts = ["a", "b.c", "@", "x-y", ".", "10", "256", "1", "0255", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "+", "(", ")", "555", "é", "٣", "\n"]
    for text in _texts(parts, 3000, 2):
        assert personal_data.base_spans(text) == _naive_personal(text), text


def _digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_secret_query_keeps_base_spans_and_learns_formats(docs_of):
    rng = random.Random(3)
    code = lambda: "tk-" + "".join(rng.choice("ABCDEF0123456789") for _ in range(24))
    texts = [f'le mot {i} token = "{code()}" et la suite' for i in range(60)]
    texts += [f"und hier steht {code()} ohne wort" for _ in range(10)]
    texts += ["thisisjustalongwordwithoutanydigit and more", "version-2-of-the-document-name-1", None, "", "x" * 200_000, texts[0]]
    got = {}
    for r in secret_scan.digests(secret_scan.scan(docs_of(list(enumerate(texts))))).collect():
        got[r.doc_id] = r
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        base = _naive_secrets(text)
        assert got[i].base_sha256 == _digest(base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(filter(None, got[i].spans.split(",")))
    assert all(got[i].spans for i in range(60, 70))
    assert got[70].spans == "" and got[72].spans == "" and got[73].spans == ""


def test_automata_merge_states_and_prefer_their_format():
    rng = random.Random(4)
    words = ["d" * 4 + "-" + "h" * rng.randint(3, 8) for _ in range(200)]
    automaton = secret_scan.Automaton(words)
    assert len(automaton.states) < 30
    assert automaton.score("dddd-hhhh") > automaton.score("hhhh-dddd")
    assert secret_scan.Formats({}, Counter()).kind("abcdefgh12345678ABCD") is None


def test_personal_query_keeps_base_spans_and_bootstraps(docs_of):
    texts = [f"please phone +1 (555) 010-{1000 + i} today" for i in range(12)]
    texts += ["please phone 0044-2071-888999 today", "room 1234567 is free", None, "", "A" * 100_000 + " a@b.co", texts[0]]
    got = {r.doc_id: r for r in personal_data.digests(personal_data.scan(docs_of(list(enumerate(texts))))).collect()}
    for i, text in enumerate(texts):
        base = _naive_personal(text)
        assert got[i].base_sha256 == _digest(base)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in personal_data.KINDS)
    assert got[12].spans == "phone:13:29"
    assert got[13].spans == "" and got[14].spans == ""


def _naive_bootstrap(texts, rounds):
    """Accepted instances by kind, from dictionaries in place of tables."""
    edges = set()
    for t in texts:
        spans = personal_data.base_spans(t or "")
        for k, a, b in spans + [("", a, b) for a, b in personal_data.unknowns(t or "", spans)]:
            edges |= {(k, t[a:b].lower(), p) for p in personal_data.contexts(t, a, b)}
    size = {p: len({i for _, i, q in edges if q == p}) for _, _, p in edges}
    accepted, sure = {}, {}
    for _ in range(rounds):
        told = {(k, i, p) for k, i, p in edges if k} | {(accepted[i], i, p) for k, i, p in edges if not k and i in accepted}
        able = {}
        for k, _, p in told:
            able[p, k] = able.get((p, k), 0) + 1
        able = {x: n for x, n in able.items() if n >= personal_data.SUPPORT}
        now = {(p, k): sure.get((p, k), n / size[p]) for (p, k), n in able.items()}
        left = {(i, p) for k, i, p in edges if not k and i not in accepted and any(q == p for q, _ in able)}
        if not left:
            break
        kinds = {k for _, k in able}

        def score(i, k, of):
            miss = [1 - min(of[p, k], 0.999) for j, p in left if j == i and (p, k) in of]
            return 1 - float(np.prod(miss)) if miss else None

        sure = {(p, k): min(1.0, (n + sum(score(i, k, now) or 0 for i, q in left if q == p) * n / size[p]) / size[p]) for (p, k), n in able.items()}
        good = {x: y for x, y in sure.items() if y >= personal_data.CONFIDENT}
        found = {i: max(((score(i, k, good), k) for k in kinds if score(i, k, good) is not None), default=(0, "")) for i, _ in left}
        accepted = accepted | {i: k for i, (y, k) in found.items() if y >= personal_data.ACCEPT}
    return accepted


def _bootstrap_texts(seed):
    rng = random.Random(seed)
    number = lambda: f"0{rng.randint(20, 99)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)}"
    local = [number() for _ in range(14)]
    texts = [f"bitte ruf +49 (30) 5550-{1000 + i} heute an" for i in range(60)]
    texts += [f"bitte ruf {x} heute an" for x in local[:12]]
    # a context that no seed has: only numbers found in the first round, and two that stand nowhere else
    texts += [f"mein fax {x}, danke" for x in local]
    texts += [f"saal {rng.randint(1000, 9999)} ist frei" for _ in range(20)]
    texts += [f"kunde {rng.choice(local)} oder kunde {rng.randint(10000, 99999)} und kunde AB{rng.randint(1000, 9999)}" for _ in range(9)]
    return texts, local


def test_bootstrapping_reaches_contexts_without_seeds(docs_of):
    texts, local = _bootstrap_texts(1)
    spans = [set(filter(None, r.spans.split(","))) for r in sorted(personal_data.digests(personal_data.scan(docs_of(list(enumerate(texts))))).collect(), key=lambda r: r.doc_id)]
    assert all(spans[60 + i] == {f"phone:10:{10 + len(local[i])}"} for i in range(12))
    assert all(spans[72 + i] == {f"phone:9:{9 + len(local[i])}"} for i in range(14))
    assert not any(spans[86:106])


def test_graph_scores_match_brute_force(spark, docs_of):
    for seed in (2, 3):
        texts, _ = _bootstrap_texts(seed)
        rng = random.Random(seed)
        texts = [t for t in texts if rng.random() < 0.9] + [None, "", texts[0], texts[0]]
        scanned = docs_of(list(enumerate(texts))).selectExpr("doc_id as row", "doc_id", "text").mapInArrow(personal_data._scan, personal_data._SCAN)
        for rounds in (1, 2, 3):
            want = _naive_bootstrap(texts, rounds)
            hashes = {r.h: k for r in spark.createDataFrame([(i, k) for i, k in want.items()], "i string, k string").selectExpr("xxhash64(i) as h", "k").collect() for k in [r.k]}
            assert {r.i: r.kind for r in personal_data.scored_instances(scanned, rounds).collect()} == hashes


def test_candidates_join_numbers_between_single_blanks():
    found = lambda t: [t[a:b] for a, b in personal_data.unknowns(t, personal_data.base_spans(t))]
    assert found("call 020 7946 0958. or  12  345678 or 040 12-34, AB1234 x 99") == ["020 7946 0958", "345678", "040 12-34", "AB1234"]
    assert personal_data.contexts("a" * 37 + " 1234567", 38, 45) == [] and personal_data.contexts("a" * 36 + " 1234567", 37, 44) == ["< " + "a" * 36]


def test_planted_formats_and_contexts_in_a_table_of_prose(spark, docs_of):
    """Precision and recall of what the learnt formats and patterns add on 1,000 documents of prose."""
    rng = random.Random(9)
    prose = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(1000).collect()]
    key = lambda: rng.choice(["zq.", "zk."]) + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(10))
    texts, planted_keys, planted_phones = [], set(), set()
    for i, t in enumerate(prose):
        at = t.find(" ") + 1
        here = t[:at]
        if i % 5 == 0:
            here += f"api_key = {key()} "
        if i % 11 == 0:
            k = key()
            planted_keys.add((i, len(here), len(here) + len(k)))
            here += k + " "
        if i % 7 == 0:
            here += f"hotline +1 (555) 0{rng.randint(100000, 999999)} now "
        if i % 50 == 3:
            k = f"0{rng.randint(100, 999)}-{rng.randint(100000, 999999)}"
            here += "hotline "
            planted_phones.add((i, len(here), len(here) + len(k)))
            here += k + " now "
        texts.append(here + t[at:])
    docs = docs_of(list(enumerate(texts)))
    added = lambda df: {(r.doc_id, s.start, s.end) for r in df.collect() for s in r.spans if s.added}
    keys, phones = added(secret_scan.scan(docs)), added(personal_data.scan(docs))
    assert len(keys & planted_keys) >= 0.9 * len(planted_keys) and len(keys & planted_keys) >= 0.9 * len(keys)
    assert phones == planted_phones


def test_automaton_likelihoods_match_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("dh") for _ in range(4)) + "-" + "l" * rng.randint(3, 6) for _ in range(300)]
    a = secret_scan.Automaton(words)
    # every training word walks through kept states, and their counts are those of the walks
    seen = {}
    for word in words:
        at = 0
        for s in [*word, "$"]:
            seen.setdefault(at, {}).setdefault(s, 0)
            seen[at][s] += 1
            at = a.next[at].get(s) if s != "$" else None
    assert set(seen) == set(a.states)
    for state, counts in seen.items():
        assert dict(a.count[state]) == counts and a.total[state] == sum(counts.values())
    floor = len({s for w in words for s in w} | {"$"}) + 1
    for word in ("dhdh-lll", "dd-xx", "llll"):
        at, total = 0, 0.0
        for s in word:
            counts = seen.get(at, {})
            total += np.log((counts.get(s, 0) + 0.5) / (sum(counts.values()) + 0.5 * floor))
            at = a.next[at].get(s) if at is not None else None
        assert abs(a.score(word) - total / len(word)) < 1e-9


def test_masking_replaces_spans_and_keeps_other_columns(docs_of):
    docs = docs_of([(1, "mail a@b.co and 10.0.0.1."), (2, None), (3, "nothing"), (None, "a@b.co"), (3, "nothing")])
    got = sorted(((r.doc_id, r.text, r.n_chars, r.row, r.spans) for r in personal_data.masked(docs).collect()), key=str)
    assert personal_data.masked(docs).columns == docs.columns
    assert got == sorted([(1, "mail [EMAIL] and [IP].", 22, 1, "x"), (2, None, None, 1, "x"), (3, "nothing", 7, 1, "x"), (None, "[EMAIL]", 7, 1, "x"), (3, "nothing", 7, 1, "x")], key=str)


def test_empty_tables(docs_of):
    empty = docs_of([(1, "x")]).limit(0)
    assert secret_scan.scan(empty).count() == 0
    assert personal_data.scan(empty).count() == 0
    assert personal_data.masked(empty).count() == 0


def test_long_runs_and_many_spans_take_seconds():
    import random
    import re
    import time

    plain = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("0123.. a") for _ in range(rng.randint(0, 40)))
        assert [m.span() for m in personal_data._IP.finditer(text)] == [m.span() for m in plain.finditer(text)]
    spans = [("x", a, a + rng.randint(1, 30)) for a in sorted(rng.sample(range(4000), 300))]
    taken = rows.Taken(spans)
    for _ in range(3000):
        lo = rng.randrange(4100)
        hi = lo + rng.randint(1, 20)
        assert taken.touches(lo, hi) == any(a < hi and lo < b for _, a, b in spans)
    began = time.monotonic()
    assert personal_data.base_spans("7" * 1_000_000) == []
    many = "mail a1@b.cc or 12345x 10.0.0.1 token: abcdef1234 X9y8z7w6v5 " * 25_000
    for found, rest in ((personal_data.base_spans, personal_data.unknowns), (secret_scan.base_spans, secret_scan.candidates)):
        every = found(many)
        assert len(every) >= 25_000 and len(rest(many, every)) >= 25_000
    assert time.monotonic() - began < 40

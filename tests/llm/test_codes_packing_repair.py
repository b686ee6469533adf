import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rinkspark.llm import conversation_repair, packing, vector_codes
from rinkspark.llm.queries import WORDS


def _naive_codes(rows, parts=16, entries=64, rounds=2):
    """(code rows by (id, vector), label errors, codebooks) of rows of one length."""
    kept = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in rows]
    kept = [(i, lab, q + [0] * (-len(q) % parts)) for i, lab, q in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[q[p * width : (p + 1) * width] for p in range(parts)] for _, _, q in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            by = defaultdict(list)
            for c in cut:
                by[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(by[k]) for x in zip(*by[k], strict=True)] if by[k] else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(i, lab, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, lab, _), f in zip(kept, found, strict=True)], books


VECTORS = "vec_id long, embedding array<float>, label int, q int, dim int, row long, pos int"


def _vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=32) * 0.2], int(rng.integers(4))) for i in range(150)]
    rows += [(i, rows[3][1], None) for i in range(150, 260)] + [rows[7], (None, rows[9][1], 2), (rows[5][0], rows[6][1], 1)]
    return rows


@pytest.mark.parametrize("heavy", [1024, 8])
def test_codes_match_plain_lloyd(spark, monkeypatch, heavy):
    monkeypatch.setattr(vector_codes, "HEAVY", heavy)
    rows, short = _vectors(), [(i, [0.1 * i, -0.3, 2.5], 9) for i in range(5)]
    broken = [(900, None, 1), (901, [float("nan")] * 32, 1), (902, [None] * 32, 1), (903, [float("inf")] * 32, None)]
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows + short + broken], VECTORS).repartition(5)
    compressed, books = vector_codes.compress(table)
    got = [tuple(r) for r in vector_codes.digests(compressed, books).collect()]
    (long_, b), (few, s) = _naive_codes(rows), _naive_codes(short)
    errors = defaultdict(int)
    for _, lab, _, e in long_ + few:
        errors[lab] += e
    digest = hashlib.sha256(",".join(str(x) for book in (s, b) for p in book for e in p for x in e).encode()).hexdigest()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted([(i, c, e, errors[lab], digest) for i, lab, c, e in long_ + few], key=key)
    back = {r.row: r for r in vector_codes.decompress(compressed, books).where("dim = 32").collect()}
    assert len(back) == len(rows) and all(r.q == [x for p, c in enumerate(r.codes) for x in b[p][c]] for r in back.values())


def test_no_vectors_and_vectors_without_components(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.digests(*vector_codes.compress(empty)).count() == 0
    table = spark.createDataFrame([(1, [], 1, 1, 1, 1, 1), (2, [], 1, 1, 1, 1, 1), (3, [1e30] * 20, 1, 1, 1, 1, 1)], VECTORS)
    got = {r.vec_id: r for r in vector_codes.digests(*vector_codes.compress(table)).collect()}
    assert got[1].code == "00" * 16 and all(r.error == 0 == r.label_error for r in got.values())


def _texts():
    rng = random.Random(5)
    parts = ["Hello", "world's", "I'll", "'", " ", "\n", "\t", "É", "Straße", "ß", "123", "!!", "...", "日本", "　", "x́", "İ", "Σας", "½", "µ", "\x1c", "\x85", "\xa0", "😀", "<|endoftext|>", "\x00", "co'dn't"]
    out = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 150))) for _ in range(80)]
    return out + ["a" * 4000, "word " * 3000, " ", "", None, "word " * 3000]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packed_pieces_are_the_library_s_tokens(spark, docs_of, capacity):
    texts = _texts()
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "again")])
    packed = packing.pack(docs, public_tokenizers.path(WORDS), capacity, keep_ids=True)
    got = packed.collect()
    library = Tokenizer.from_file(public_tokenizers.path(WORDS))
    library.encode_special_tokens = True
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        by[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want = [(k, lo, np.array(ids[lo : lo + capacity], "<u4").tobytes()) for k, lo in enumerate(range(0, len(ids), capacity))]
        want = [(k, lo, len(data) // 4, zlib.crc32(data)) for k, lo, data in want for _ in range(1 + (i == 3))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in by[i]] == sorted(want, key=lambda w: w[1])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        content.sort()
        assert [o for o, _ in content] == list(itertools.accumulate([0, *(n for _, n in content[:-1])]))
        assert sum(n for _, n in content) <= capacity
    lengths = [r.length for r in got]
    assert len(bins) <= len(_first_fit([*lengths], capacity)) and len(bins) >= -(-sum(lengths) // capacity)
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert set(joined) == set(bins) and all(len(ids) == 4 * sum(n for _, n in bins[k]) for k, ids in joined.items())
    assert all(zlib.crc32(joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32 for r in got)
    assert packing.pack(docs.limit(0), public_tokenizers.path(WORDS)).count() == 0


def _first_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, used in enumerate(bins) if used + n <= capacity), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    return bins


def test_each_bin_is_as_full_as_it_can_be():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        pieces = [rng.randint(1, capacity) for _ in range(rng.randint(1, 12))]
        left = list(pieces)
        for n, content in packing.minimum_bin_slack([(x, 1) for x in pieces], capacity):
            for _ in range(n):
                longest = max(left)
                used = [length for length, times in content for _ in range(times)]
                others = list(left)
                others.remove(longest)
                best = max(sum(c) for k in range(len(others) + 1) for c in itertools.combinations(others, k) if sum(c) <= capacity - longest)
                assert longest in used and sum(used) == longest + best
                for x in used:
                    left.remove(x)
        assert not left
    assert sum(n for n, _ in packing.minimum_bin_slack([(1000, 10**12), (3096, 10**12)])) == 10**12
    assert packing.minimum_bin_slack([]) == []


def _damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range((kind != 0) + (kind == 3)):
            yield conv, turn, "user" if kind == 4 else role, text


def _naive_repair(rows):
    """The numbers of one conversation's ordered (turn, role, text), by a program over whole strings."""
    white = "[\\x20\\x09-\\x0D]"
    seen, faults = set(), []
    for _, role, text in rows:
        bare = re.sub(f"{white}+\\Z", "", text)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    state = {"": (0, "", ())}
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def better(into, key, value):
        if key not in into or value < into[key]:
            into[key] = value

    def inserted(now):
        out = dict(now)
        for _ in range(3):
            for s, (c, a, t) in list(out.items()):
                for r in legal[s].replace("s", ""):
                    better(out, r, (c + 2, a + "I", (*t, {"u": "user:", "a": "assistant:"}[r])))
        return out

    def step(now, role, text, fault):
        out = {}
        for s, (c, a, t) in now.items():
            better(out, s, (c + 3, a + "D", t))
            if fault in (1, 2):
                continue
            if role[:1] and role[:1] in legal[s]:
                better(out, role[:1], (c + fault // 3, a + "K", (*t, f"{role}:{text}")))
            for r in legal[s].replace("s", ""):
                better(out, r, (c + 2 + fault // 3, a + "R", (*t, {"u": "user:", "a": "assistant:"}[r] + text)))
        return out

    # insertions are explored from every kept string, not only the best of each state
    for (_, role, text), fault in zip(rows, faults, strict=True):
        state = step(inserted(state), role, text, fault)
    state = inserted(state)
    cost, audit, text = min(state[s] for s in ("", "a") if s in state)
    given = [t for t, _, _ in rows if t is not None]
    gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest(), list(text)


TURNS = "conv_id long, turn long, role string, text string, copies_ int, fault int, codes string"


def _talks():
    rng = random.Random(7)
    rows = []
    for conv in [*range(120), None]:
        n = rng.randint(1, 9) if conv != 5 else 300
        for turn in rng.sample(range(3 * n), n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "so", " ", "", None, "line\nnext.", "a:b", "Why? \t", "é…", f"own {turn}.", f"{turn}"])
            rows.append((conv, None if rng.random() < 0.03 else turn, role, text))
    seen, out = set(), []
    for r in rows:  # one row a turn: nothing says which of two would come first
        if r[:2] not in seen:
            seen.add(r[:2])
            out.append(r)
    return out


@pytest.mark.parametrize("cut", [{}, {"slab": 3, "segment": 7}, {"slab": 1, "segment": 1}])
def test_repairs_match_a_program_over_strings(spark, cut):
    rows = _talks()
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TURNS).repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.digests(conversation_repair.damaged(table), table, **cut).collect()}
    by = {c: [] for c, *_ in rows}
    for conv, *rest in _damaged(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))):
        by[conv].append(tuple(rest))
    want = {c: _naive_repair(r) for c, r in by.items()}
    assert {c: w[:-1] for c, w in want.items()} == got
    lines = defaultdict(list)
    for r in conversation_repair.repaired(conversation_repair.damaged(table), **cut).collect():
        lines[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    assert {c: [x for _, x in sorted(v)] for c, v in lines.items()} == {c: w[-1] for c, w in want.items() if w[-1]}


def test_the_cheapest_repair_of_short_conversations_by_trying_all():
    """Every edit of every turn, with up to two insertions anywhere."""
    good = re.compile(r"(s?(ua)+)?\Z")
    kinds = {1: ("u", 0), 2: ("u", 1), 3: ("a", 0), 4: ("a", 1), 5: ("s", 0), 6: ("s", 1), 7: ("x", 0), 8: ("x", 1), 0: None}
    runs = [("", "")] + [("I" * k, "".join(r)) for k in (1, 2) for r in itertools.product("ua", repeat=k)]

    def options(kind):
        if kinds[kind] is None:
            return [("D", "", 3)]
        initial, open_ = kinds[kind]
        return [("D", "", 3), ("K", initial, open_), ("R", "u", 2 + open_), ("R", "a", 2 + open_)]

    for n in range(4):
        for turns in itertools.product(range(9), repeat=n) if n < 3 else random.Random(8).sample(list(itertools.product(range(9), repeat=3)), 40):
            found = [("", "", 0)]
            for kind in turns:
                found = [(a + i + e, r + j + x, c + 2 * len(i) + p) for a, r, c in found for i, j in runs for e, x, p in options(kind)]
            found = [(c + 2 * len(i), a + i) for a, r, c in found for i, j in runs if good.match(r + j)]
            cost, audit = min(found)
            [(codes, tail)] = conversation_repair.solved([np.array(turns, np.uint8)])
            assert "".join(conversation_repair.CODES[c] for c in codes) + "I" * tail == audit


def test_many_copies_of_a_turn_and_no_conversations(spark):
    table = spark.createDataFrame([(1, 0, "user", "So.")] * 500 + [(1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    [r] = conversation_repair.digests(table, table).collect()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (499, 499, 3 * 499, "K" + "D" * 499 + "K")
    assert conversation_repair.digests(table.limit(0), table.limit(0)).count() == 0
    [r] = conversation_repair.digests(table.limit(0), table).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())

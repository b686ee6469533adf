"""Conversations repaired at least cost: a dynamic program over ranks instead of audit strings.

A repair keeps, deletes or re-roles each turn and may insert empty turns anywhere, so that what is left
reads: perhaps a system turn, then user and assistant in pairs. Of the cheapest repairs the one whose
edits' initials come first in ASCII order is taken. A layer of the program is one turn, and what may
happen at it is a macro edit: a run of insertions and then the turn's own edit, written as their
initials. Every such code ends with the only letter of it that isn't I, so no code begins another, and
strings of codes compare as their first different codes do. What is best in each of the four states
after a layer is therefore held as a cost, a rank among the four, and a pointer to the state and the
code that it came by; the strings are read off the pointers at the end. A blank or repeated turn has to
go: what could be inserted before it can follow it, for the same cost and with an earlier string, so it
changes no state and is left out of the layers.

Turns are dealt out by ranges of (conversation, turn), and a conversation may span many tasks. Where it
does, each of its segments is solved from all four states to all four, a matrix of costs and ranks;
matrices are folded in order, which gives every segment its first and last state, and segments then
follow their pointers on their own. Copies of one turn are one row with a count before any shuffle by
conversation. Only the repaired texts meet by conversation at the end, where they stream through the
hash, whose order is fixed; one byte a turn is held there.

Defined cases: null roles and texts count as one blank. Rows of one turn go by role and the hashes of
their text, copies side by side; null turns come first. A null id is a conversation. Equality of texts
is that of two 64-bit hashes. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rinkspark.llm import rows

#: Costs of the edits, and of leaving a turn that breaks off.
INSERT, REROLE, DELETE, LEFT_OPEN = 2, 2, 3, 1
#: A longer conversation is cut into segments of so many turns.
SEGMENT = 1 << 16
#: Turns that a task solves together.
SLAB = 1 << 15

# White space, ends of sentences, and the faults in the order in which they count.
_WHITE = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The codes of macro edits in ASCII order; DELETED stands for a turn that has to go.
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")
DELETED = CODES.index("D")
#: Insertions that end a conversation, by its last state.
_TAIL = np.array([0, 2, 1, 0])
_FAR = 1 << 40


def _after(state: int, initial: str) -> int | None:
    """The state after a turn whose role has this initial; none where it may not stand."""
    allowed = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
    before, then = allowed.get(initial, ((), None))
    return then if state in before else None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By kind of turn, state before and state after: the least cost, and the first code that has it."""
    cost, code = np.full((9, 4, 4), _FAR), np.zeros((9, 4, 4), np.int64)
    for kind in range(1, 9):
        initial, left_open = "uasx"[(kind - 1) // 2], LEFT_OPEN * ((kind - 1) % 2)
        for state in range(4):
            at, options = state, []
            for run in range(3):
                own, paid = "I" * run, INSERT * run
                options += [(at, paid + DELETE, own + "D"), (_after(at, initial), paid + left_open, own + "K"), (_NEXT[at], paid + REROLE + left_open, own + "R")]
                at = _NEXT[at]
            for then in range(4):
                found = [(paid, CODES.index(own)) for to, paid, own in options if to == then]
                if found:
                    cost[kind, state, then], code[kind, state, then] = min(found)
    return cost, code


_COST, _CODE = _tables()


def forward(kinds: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(costs, ranks, pointers by layer) of runs of layers, each from its first state; the longest run comes first.

    Ranks order the best edits up to each state; a pointer is the state before, times 16, and the code.
    """
    cost, rank, steps = np.full((len(start), 4), _FAR), np.zeros((len(start), 4), np.int64), []
    cost[np.arange(len(start)), entry] = 0
    for i in range(int(length[0]) if len(length) else 0):
        m = int(np.searchsorted(-length, -i, "left"))
        kind = kinds[start[:m] + i]
        key = (cost[:m, :, None] + _COST[kind]) * 4 + rank[:m, :, None]
        before = key.argmin(axis=1)
        code = _CODE[kind[:, None], before, np.arange(4)]
        cost[:m] = np.minimum(np.take_along_axis(key, before[:, None, :], 1)[:, 0] >> 2, _FAR)
        rank[:m] = (np.take_along_axis(rank[:m], before, 1) * 16 + code).argsort(axis=1).argsort(axis=1)
        steps.append((before << 4 | code).astype(np.uint8))
    return cost, rank, steps


def backward(steps: list[np.ndarray], start: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """The codes by layer of all runs, each from its last state back; ``n`` layers in all."""
    out, state = np.zeros(n, np.uint8), last.copy()
    for i in range(len(steps) - 1, -1, -1):
        m = len(steps[i])
        pointer = steps[i][np.arange(m), state[:m]]
        out[start[:m] + i] = pointer & 15
        state[:m] = pointer >> 4
    return out


def last_states(cost: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The state in which each conversation ends cheapest, its last insertions counted."""
    return ((cost + INSERT * _TAIL) * 4 + rank).argmin(axis=-1)


def _with_deleted(kinds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.full(len(kinds), DELETED, np.uint8)
    out[kinds > 0] = codes
    return out


def solved(kinds: list[np.ndarray]) -> list[tuple[bytes, int]]:
    """(codes, insertions at the end) of whole conversations, each given by the kinds of its turns."""
    if not kinds:
        return []
    layers = [k[k > 0] for k in kinds]
    length = np.array([len(x) for x in layers], np.int64)
    order = np.argsort(-length, kind="stable")
    start = (np.cumsum(length) - length)[order]
    flat = np.concatenate([*layers, np.zeros(0, np.uint8)])
    cost, rank, steps = forward(flat, start, length[order], np.full(len(order), NOTHING))
    last = last_states(cost, rank)
    codes = np.split(backward(steps, start, last, len(flat)), np.cumsum(length)[:-1])
    tail = np.zeros(len(order), np.int64)
    tail[order] = _TAIL[last]
    return [(_with_deleted(k, c).tobytes(), int(t)) for k, c, t in zip(kinds, codes, tail, strict=True)]


def matrix(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(costs, ranks) of a segment from each state to each."""
    flat = kinds[kinds > 0]
    cost, rank, _ = forward(flat, np.zeros(4, np.int64), np.full(4, len(flat)), np.arange(4))
    return cost, rank


def folded(segments: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(first state, last state) of each segment of one conversation, by their matrices in order."""
    cost, rank, steps = np.array([0, _FAR, _FAR, _FAR]), np.zeros(4, np.int64), []
    for costs, ranks in segments:
        key = (cost[:, None] + costs) * 4 + rank[:, None]
        before = key.argmin(axis=0)
        cost = np.minimum(key.min(axis=0) >> 2, _FAR)
        rank = (rank[before] * 4 + ranks[before, np.arange(4)]).argsort().argsort()
        steps.append(before)
    state, out = int(last_states(cost, rank)), []
    for before in reversed(steps):
        out.append((int(before[state]), state))
        state = out[-1][0]
    return out[::-1]


def between(kinds: np.ndarray, first: int, last: int) -> bytes:
    """The codes of a segment between two known states."""
    flat = kinds[kinds > 0]
    start = np.zeros(1, np.int64)
    _, _, steps = forward(flat, start, np.array([len(flat)]), np.array([first]))
    return _with_deleted(kinds, backward(steps, start, np.array([last]), len(flat))).tobytes()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after damage by the checksum of ``conv_id:turn``, nulls as one blank.

    Of each twenty, rows with remainder 0 are dropped, 1 emptied, 2 lose their ends of sentences, 3 are
    doubled, and 4 become a user's.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")]


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= left[k].eqNullSafe(right[f"_{k}"])
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, t1, t2, copies, fault, text), a row for equal turns; a text that has to go is null."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    copies = F.col("copies").cast("long") if "copies" in conversations.columns else F.lit(1).cast("long")
    given = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    stripped = F.rtrim("text", F.lit(_WHITE))
    own = F.when(stripped == "", BLANK).when(F.substring(stripped, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    once = given.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    once = rows.written(once.select("conv_id", "turn", "role", *(k.alias(f"t{i}") for i, k in enumerate(rows.text_key(), 1)), "copies", own.alias("fault"), "text"))
    by = ["conv_id", "role", "t1", "t2"]
    earliest = F.when(F.bool_or(F.col("turn").isNull()), None).otherwise(F.min("turn"))
    first = once.groupBy(*by).agg(earliest.alias("turn")).select(*(F.col(c).alias(f"_{c}") for c in (*by, "turn")), F.lit(True).alias("_first"))
    both = once.join(first, _same(once, first, [*by, "turn"]), "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("_first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    kept = F.when(fault.isin(FINE, TRUNCATED), F.col("text"))
    return rows.written(both.select("conv_id", "turn", "role", "t1", "t2", "copies", fault.alias("fault"), kept.alias("text")))


def _changes(ids: pa.Array) -> np.ndarray:
    """Where another conversation begins, the first row left out."""
    if len(ids) < 2:
        return np.zeros(0, np.int64)
    a, b = ids.slice(0, len(ids) - 1), ids.slice(1)
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    other |= (pc.is_null(a).to_numpy(zero_copy_only=False)) != (pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(other) + 1


def _segments(slab: int, segment: int):
    """Segments of a sorted partition: conversations inside it solved, its first and last one and what is too long as matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "kinds", "codes", "tail", "costs", "ranks"]
        first, held, n = True, [], 0

        def made(ids: pa.Array, kinds: np.ndarray, cuts: list[int], opened: bool, closed: bool) -> pa.RecordBatch:
            """``cuts`` are where segments begin and end; the first may have begun before, the last may go on."""
            parts = [kinds[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
            loose = [opened and i == 0 or not closed and i == len(parts) - 1 for i in range(len(parts))]
            whole = iter(solved([k for k, open_ in zip(parts, loose, strict=True) if not open_]))
            found = []
            for k, open_ in zip(parts, loose, strict=True):
                cost, rank = matrix(k) if open_ else (None, None)
                found.append((k.tobytes(), None, None, cost.ravel().tolist(), rank.ravel().tolist()) if open_ else (None, *next(whole), None, None))
            kinds_, codes, tail, costs, ranks = zip(*found, strict=True)
            kind = [pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip((kinds_, codes, tail, costs, ranks), kind, strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(cuts[:-1])), *columns], names)

        def column(parts: list[pa.RecordBatch], name: str) -> pa.Array:
            return pa.concat_arrays([p.column(p.schema.get_field_index(name)) for p in parts])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n < slab:
                continue
            ids, kinds = column(held, "conv_id"), column(held, "kind").to_numpy(zero_copy_only=False).astype(np.uint8)
            cuts = [0, *_changes(ids).tolist()]
            rest = cuts[-1]
            if rest:
                yield made(ids, kinds, cuts, first, True)
                first = False
            tail = pa.Table.from_batches(held).slice(rest).combine_chunks()
            held, n = tail.to_batches(), len(kinds) - rest
            while n >= segment:
                yield made(ids.slice(rest), kinds[rest:], [0, segment], True, False)
                rest, first = rest + segment, True
                tail = tail.slice(segment)
                held, n = tail.to_batches(), n - segment
        if n:
            ids, kinds = column(held, "conv_id"), column(held, "kind").to_numpy(zero_copy_only=False).astype(np.uint8)
            yield made(ids, kinds, [0, *_changes(ids).tolist(), len(kinds)], first, False)

    return run


def _numbers(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("seg")
    states = folded([(np.array(c).reshape(4, 4), np.array(r).reshape(4, 4)) for c, r in zip(group["costs"], group["ranks"], strict=True)])
    tail = [0] * (len(states) - 1) + [int(_TAIL[states[-1][1]])]
    return pd.DataFrame({"seg": group["seg"].to_numpy(), "first": [s[0] for s in states], "last": [s[1] for s in states], "tail": tail})


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = [np.frombuffer(k, np.uint8) for k in _numbers(batch, "kinds")]
        codes = [between(*x) for x in zip(kinds, _numbers(batch, "first"), _numbers(batch, "last"), strict=True)]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "seg", "tail")]
        yield pa.RecordBatch.from_arrays([*kept[:2], pa.array(codes, pa.binary()), kept[2]], ["conv_id", "seg", "codes", "tail"])


def edits(of_turns: DataFrame, slab: int = SLAB, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, codes, tail): in order of ``seg``, a byte for each row of ``turns`` in its order, and the insertions at the end."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "u", 1).when(initial == "a", 3).when(initial == "s", 5).otherwise(7) + (F.col("fault") == TRUNCATED).cast("int")
    kind = F.when(F.col("fault").isin(BLANK, DUPLICATE), 0).otherwise(kind)
    slim = of_turns.select("conv_id", "turn", "role", "t1", "t2", kind.alias("kind"))
    ordered = slim.repartitionByRange("conv_id", *_order()).sortWithinPartitions("conv_id", *_order())
    id_field = of_turns.schema["conv_id"]
    fields = [("kinds", T.BinaryType()), ("codes", T.BinaryType()), ("tail", T.IntegerType()), ("costs", T.ArrayType(T.LongType())), ("ranks", T.ArrayType(T.LongType()))]
    schema = T.StructType([id_field, *(T.StructField(n, t) for n, t in fields)])
    found = rows.written(ordered.mapInArrow(_segments(slab, segment), schema).withColumn("seg", F.monotonically_increasing_id()))
    whole = found.where("kinds is null").select("conv_id", "seg", "codes", "tail")
    loose = found.where("kinds is not null")
    states = loose.groupBy("conv_id").applyInPandas(lambda g: _fold(g), "seg long, first int, last int, tail int")
    joined = loose.select("conv_id", "seg", "kinds").join(states, "seg").select("conv_id", "seg", "kinds", "first", "last", "tail")
    return whole.unionByName(joined.mapInArrow(_between, whole.schema))


class _Conversation:
    """One conversation as its rows come by: first its edits, then its turns in order."""

    def __init__(self, digest: bool):
        self.codes, self.tail, self.at, self.state = bytearray(), 0, 0, NOTHING
        self.counts, self.illegal, self.cost = [0] * 4, 0, 0
        self.seen, self.low, self.high, self.turn, self.initial = 0, None, None, None, None
        self.audit, self.hash, self.lines, self.digest = bytearray(), hashlib.sha256(), 0, digest
        self.out: list[tuple[int, str, str]] = []

    def line(self, role: str, text: str) -> None:
        if self.digest:
            self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
        else:
            self.out.append((self.lines, role, text))
        self.lines += 1

    def insert(self, n: int) -> None:
        for _ in range(n):
            self.state = _NEXT[self.state]
            self.line(_ROLES[self.state], "")
        self.cost += INSERT * n

    def add(self, turn: int | None, role: str, copies: int, fault: int, text: str | None) -> None:
        if turn is not None and (self.turn is None or turn != self.turn):
            self.seen, self.low, self.high, self.turn = self.seen + 1, turn if self.low is None else self.low, turn, turn
        initial = role[:1]
        self.illegal += copies - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        code = CODES[self.codes[self.at]]
        self.at += 1
        if fault in (BLANK, DUPLICATE):
            self.counts[fault] += copies
            self.audit += b"D" * copies
            self.cost += DELETE * copies
            return
        self.counts[fault] += 1
        self.counts[DUPLICATE] += copies - 1
        self.audit += code.encode() + b"D" * (copies - 1)
        self.insert(len(code) - 1)
        self.cost += DELETE * (copies - 1) + {"K": 0, "R": REROLE, "D": DELETE}[code[-1]] + LEFT_OPEN * (fault == TRUNCATED and code[-1] != "D")
        if code[-1] == "K":
            self.state = _after(self.state, initial)
            self.line(role, text)
        elif code[-1] == "R":
            self.state = _NEXT[self.state]
            self.line(_ROLES[self.state], text)

    def end(self) -> None:
        self.insert(self.tail)
        self.audit += b"I" * self.tail

    def numbers(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.seen
        return gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest()


_DIGESTS = [("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()), ("cost", T.LongType()), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
_LINES = [("place", T.LongType()), ("role", T.StringType()), ("text", T.StringType())]
#: Characters of finished rows that a task sends on together.
_OUT = 1 << 22


def _rebuilt(digest: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, now_id, out, size = None, None, [], 0

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        def taken(c: _Conversation) -> list[tuple]:
            found, c.out = [(now_id, *x) for x in c.out], []
            return found

        for batch in rows.released(batches):
            ids = _numbers(batch, "conv_id")
            for i, r in enumerate(zip(*(_numbers(batch, c) for c in ("what", "codes", "tail", "turn", "role", "copies", "fault", "text")), strict=True)):
                if r[0] == 0:
                    if now is not None:
                        now.end()
                        out += [(now_id, *now.numbers())] if digest else taken(now)
                    now, now_id = _Conversation(digest), ids[i]
                elif r[0] == 1:
                    now.codes += r[1]
                    now.tail = r[2]
                else:
                    now.add(*r[3:])
                    if not digest:
                        out += taken(now)
                    size += len(r[7] or "")
                if size + 64 * len(out) >= _OUT and out:
                    yield batch_of(out)
                    out, size = [], 0
        if now is not None:
            now.end()
            out += [(now_id, *now.numbers())] if digest else taken(now)
        if out:
            yield batch_of(out)

    return run


def _by_conversation(conversations: DataFrame, ids: DataFrame, digest: bool, slab: int, segment: int) -> DataFrame:
    rows.bounded_batches(conversations.sparkSession)
    of_turns = turns(conversations)
    nothing = {c: F.lit(None).cast(t) for c, t in (("seg", "long"), ("codes", "binary"), ("tail", "int"), ("turn", of_turns.schema["turn"].dataType), ("role", "string"), ("t1", "long"), ("t2", "long"), ("copies", "long"), ("fault", "int"), ("text", "string"))}

    def shaped(df: DataFrame, what: int) -> DataFrame:
        return df.select("conv_id", F.lit(what).alias("what"), *(F.col(c) if c in df.columns else v.alias(c) for c, v in nothing.items()))

    every = shaped(ids.select("conv_id").distinct(), 0).unionByName(shaped(edits(of_turns, slab, segment), 1)).unionByName(shaped(of_turns, 2))
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "what", "seg", *_order())
    fields = [of_turns.schema["conv_id"], *(T.StructField(n, t) for n, t in (_DIGESTS if digest else _LINES))]
    schema = T.StructType(fields)
    return ordered.mapInArrow(_rebuilt(digest, to_arrow_schema(schema)), schema)


def repaired(conversations: DataFrame, slab: int = SLAB, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, place, role, text): the turns of the repaired conversations, ``place`` from zero on.

    ``conversations(conv_id, turn, role, text[, copies])``; ``copies`` says how often a row stands there.
    """
    return _by_conversation(conversations, conversations, False, slab, segment)


def digests(conversations: DataFrame, ids: DataFrame, slab: int = SLAB, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``ids``."""
    return _by_conversation(conversations, ids, True, slab, segment)

"""Exact removal of repeated passages by a depth-limited radix sort of suffixes.

A suffix is ordered only through its first ``depth`` bytes, by most-significant-digit passes;
suffixes that stay equal to that depth are exactly the repeated windows. Suffixes are not
shuffled one by one. The digit of a suffix is the content-chosen *gram* inside its window (the
smallest hash among the window's grams), and neighbouring suffixes with the same gram travel as
one *run*. The passes are:

1. gram: a run whose gram occurs once holds no repeated window and leaves the sort;
2. span: runs of equal bytes from first to last window are equal throughout, and are settled;
3. block, then window: runs that share a gram but not a span are cut at fixed distances from
   the gram, first into blocks of windows and then, where two blocks share the bytes that all
   windows of such a block have in common, into single windows.

Each pass keeps every suffix that is still open and one settled representative of each equal
group, so a group of any size costs a pass one row a member and never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import rows
from rinkspark.llm.hashing import GAP, Prefixes, apart, between_gaps, mixed

DEPTH = 400
GRAM = 100
#: Suffixes of one block of the third pass: windows whose gram starts at the same distance // BLOCK.
BLOCK = 20
#: Bytes handled at once; longer texts are cut into stretches that overlap by one run.
STRETCH = 1 << 20
#: Words of a passage that documents share, and of its gram.
PASSAGE_WORDS = 51
PASSAGE_GRAM = 17

def _minima(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours, from running minima of blocks of ``n``."""
    full = np.full(-(-len(x) // n) * n, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    by = full.reshape(-1, n)
    ahead = np.minimum.accumulate(by, axis=1).ravel()
    behind = np.minimum.accumulate(by[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x) - n + 1], ahead[n - 1 : len(x)])


def runs_of(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of suffixes of the texts in ``data``: row, first and last start, place of the gram.

    All places count from the start of ``data``.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(data) < depth:
        return none
    hashed = Prefixes(data).grams(gram)
    place = np.arange(len(hashed), dtype=np.uint64)
    # the high bits order the grams, the low bits give the place and prefer the leftmost of equals
    least = _minima((hashed >> np.uint64(24) << np.uint64(24)) | place, depth - gram + 1)
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(len(at), dtype=np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    whole = starts + depth <= offsets[row + 1]
    starts, row, at = starts[whole], row[whole], at[whole]
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return row[first], starts[first], starts[last], at[first]


def _as_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word between ASCII white space, and where each text's words begin."""
    hashed, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo, hi in rows.pieces(offsets, STRETCH):
        part, at = apart(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        # a long text is taken in parts that end where a word does
        blank = np.flatnonzero(GAP[part])
        cuts = np.unique(np.append(blank[np.searchsorted(blank, np.arange(STRETCH, len(part), STRETCH))] + 1, [0, len(part)]))
        begins = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            begin, end = between_gaps(part[a:b])
            hashed.append(Prefixes(part[a:b]).of(begin, end))
            begins.append(begin + a)
        first.append(np.searchsorted(np.concatenate(begins), at[1:]) + first[-1][-1])
    return np.concatenate(hashed), np.concatenate(first)


def _stretches(batch_text: pa.Array, depth: int, words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, symbols, offsets, symbols of the text before): rows together, or parts of a long one."""
    data, offsets = rows.utf8(batch_text)
    if words:
        data, offsets = _as_words(data, offsets)
    for lo, hi in rows.pieces(offsets, STRETCH):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if len(part) <= STRETCH:
            yield lo, part, at, 0
            continue
        for begin in range(0, len(part), STRETCH):
            cut = part[begin : begin + STRETCH + depth - 1]
            yield lo, cut, np.array([0, len(cut)], np.int64), begin


_RUN = pa.schema([("d", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("gram", pa.int64()), ("span", pa.int64()), ("span2", pa.int64()), ("at", pa.int64())])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _find_runs(depth: int, gram: int, words: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            d, k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "k1", "k2"))
            for row0, data, offsets, before in _stretches(batch.column("text"), depth, words):
                row, lo, hi, at = runs_of(data, offsets, depth, gram)
                if not len(row):
                    continue
                one, two = Prefixes(data), Prefixes(data, 1)
                start = offsets[row] - before
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (d[row0 + row], k1[row0 + row], k2[row0 + row], lo - start, hi - start, _signed(one.of(at, at + gram)), _signed(one.of(lo, hi + depth)), _signed(two.of(lo, hi + depth)), at - lo)], schema=_RUN
                )

    return find


_PART = pa.schema([(n, pa.int64()) for n in ("d", "k1", "k2", "lo", "hi", "gram", "at")] + [("settled", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("core", pa.int64())])
_ROW = ("d", "k1", "k2")


def _cut_runs(depth: int, block: int, words: bool):
    """Cuts the runs listed in ``parts`` at multiples of ``block`` of the distance to their gram.

    A piece is named by its bytes and its place around the gram; its core are the bytes that every
    window of its block has, whether the piece holds all of the block or not.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            who = [batch.column(c).to_pylist() for c in _ROW]
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                data = np.frombuffer((batch.column("text")[i].as_py() or "").encode(), np.uint8)
                if words:
                    data, _ = _as_words(data, np.array([0, len(data)], np.int64))
                by: dict[int, list] = {}
                for p in parts:
                    by.setdefault(p["lo"] // STRETCH, []).append(p)
                for some in by.values():
                    base = min(p["lo"] for p in some)
                    end = max(p["hi"] for p in some) + depth
                    one, two = Prefixes(data[base:end]), Prefixes(data[base:end], 1)
                    lo, hi, at, gram, settled = (np.array([p[c] for p in some]) for c in ("lo", "hi", "at", "gram", "settled"))
                    n = hi - lo + 1
                    of = np.repeat(np.arange(len(some)), n)
                    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of]
                    cell = (at[of] - (start - lo[of])) // block
                    new = np.ones(len(start), bool)
                    new[1:] = (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(start)) - 1
                    a, b, of, cell = start[first], start[last], of[first], cell[first]
                    place = lo[of] + at[of]
                    far = place - a
                    around = mixed(far.astype(np.uint64))
                    h1, h2 = one.of(a - base, b - base + depth) ^ around, two.of(a - base, b - base + depth)
                    core = one.of(place - cell * block - base, place - cell * block - (block - 1) + depth - base) ^ mixed(cell.astype(np.uint64))
                    row = [np.full(len(a), w[i]) for w in who]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*row, a, b, gram[of], far, settled[of], _signed(h1), _signed(h2), _signed(core))], schema=_PART)

    return cut


def _beside(keyed: DataFrame, lists: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Texts with their lists, by shuffle at any size; while the lists' keys are few only texts that have one move."""
    n = lists.count()
    if n > rows.BROADCAST_ROWS:
        return keyed.join(lists.hint("merge"), keys, how)
    some = rows.small(lists.select(*keys), n)
    with_list = keyed.join(some, keys, "left_semi").join(lists.hint("merge"), keys)
    if how == "inner":
        return with_list
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in lists.schema if f.name not in keys]
    return with_list.unionByName(keyed.join(some, keys, "left_anti").select("*", *rest))


def _cut(keyed: DataFrame, parts: DataFrame, depth: int, block: int, words: bool) -> DataFrame:
    """The pieces of ``parts``, cut from the texts of their rows.

    A row is named by its id and its text. Rows alike in both give the pieces of a settled run more
    than once, which changes nothing; open runs are of rows without their like.
    """
    lists = rows.written(parts.groupBy(*_ROW).agg(F.collect_list(F.struct("lo", "hi", "at", "gram", "settled")).alias("parts")))
    texts = _beside(keyed, lists, list(_ROW))
    schema = ", ".join(f"{n} long" for n in ("d", "k1", "k2", "lo", "hi", "gram", "at")) + ", settled boolean, h1 long, h2 long, core long"
    return texts.select(*_ROW, "text", "parts").mapInArrow(_cut_runs(depth, block, words), schema)


def _classes(runs: DataFrame, names: list[str], among: str, *more) -> DataFrame:
    """Groups of equal runs: one of them, and whether they ``repeat``, which ``among`` tells in SQL."""
    one = F.min(F.struct(*_ROW, "lo", "hi", "at")).alias("r")
    return runs.groupBy(*names).agg(F.expr(among).alias("repeat"), F.min("gram").alias("gram"), one, *more)


def _repeating(runs: DataFrame, classes: DataFrame, names: list[str]) -> DataFrame:
    return runs.join(classes.where("repeat").select(*names), names, "left_semi").select("k1", "k2", "lo", "hi")


def repeated_ranges(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, words: bool = False, across: bool = False) -> DataFrame:
    """Rows (k1, k2, lo, hi): starts lo to hi of repeated windows of the distinct text (k1, k2).

    Windows count bytes, or ``words`` between white space. With ``across`` only windows that another
    document has too are repeated, and of those that one document has more than once at least one is
    listed. Rows alike in id and text are one document.
    """
    # a settled representative stands for runs of several documents
    many = "count(1) > 1"
    apart_ = "min(d) <> max(d) or min(k1) <> max(k1)"
    among, among_settled = (f"{many} and ({apart_})", f"{many} and ({apart_} or bool_or(settled))") if across else (many, many)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), "text", *rows.text_key())
    schema = ", ".join(f"{f.name} long" for f in _RUN)
    every = rows.written(keyed.where(F.length("text") > 0).mapInArrow(_find_runs(depth, gram, words), schema))
    # a gram that does not repeat leaves the sort
    repeating = rows.written(every.groupBy("gram").agg(F.expr(among).alias("repeat")).where("repeat").select("gram"))
    runs = rows.written(every.join(repeating, "gram", "left_semi"))
    rows.dropped(every)
    # and one whose runs are all equal is settled
    equal = runs.groupBy("gram").agg(F.expr("min(span) = max(span) and min(span2) = max(span2)").alias("equal"))
    equal = rows.written(equal.where("equal").select("gram"))
    found = [rows.written(runs.join(equal, "gram", "left_semi").select("k1", "k2", "lo", "hi"))]
    left = rows.written(runs.join(equal, "gram", "left_anti"))
    rows.dropped(runs, repeating, equal)
    spans = rows.written(_classes(left, ["span", "span2"], among))
    found.append(rows.written(_repeating(left, spans, ["span", "span2"])))
    rows.dropped(left)
    open_grams = spans.where("not repeat").select("gram").distinct()
    parts = spans.join(open_grams, "gram", "left_semi")
    parts = rows.written(parts.select("gram", "r.*", F.col("repeat").alias("settled")))
    rows.dropped(spans)

    cut = rows.written(_cut(keyed, parts, depth, min(BLOCK, depth // 2), words))
    blocks = rows.written(_classes(cut, ["h1", "h2"], among_settled, F.min("core").alias("core"), F.max("settled").alias("settled")))
    found.append(rows.written(_repeating(cut.where("not settled"), blocks, ["h1", "h2"])))
    rows.dropped(parts, cut)
    told = blocks.withColumn("settled", F.col("settled") | F.col("repeat"))
    shared = told.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.bool_and("settled").alias("all")).where("n > 1 and not all")
    parts = told.join(shared.select("core"), "core", "left_semi")
    parts = rows.written(parts.select("gram", "r.*", "settled"))
    rows.dropped(blocks)

    cut = rows.written(_cut(keyed, parts, depth, 1, words))
    windows = cut.groupBy("h1", "h2").agg(F.expr(among_settled).alias("repeat"))
    found.append(rows.written(_repeating(cut.where("not settled"), windows, ["h1", "h2"])))
    rows.dropped(parts, cut)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def sharing_texts(docs: DataFrame, words: int = PASSAGE_WORDS, gram: int = PASSAGE_GRAM) -> DataFrame:
    """Distinct (k1, k2) of the texts with a passage of ``words`` words that another document has too.

    Words are what ASCII white space parts, as they are written.
    """
    return rows.written(repeated_ranges(docs, words, gram, words=True, across=True).select("k1", "k2").distinct())


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage int"


def _remove(depth: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            data, offsets = rows.utf8(batch.column("text"))
            got = ([], [], [], [])
            for i, ranges in enumerate(batch.column("ranges")):
                text = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(text) + 1, np.int32)
                ranges = ranges.as_py() or []
                for r in ranges:
                    edge[r["lo"]] += 1
                    edge[r["hi"] + depth] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                kept = text[~gone] if ranges else text
                for x, y in zip(got, (len(text), int(gone.sum()), int(begins.sum()), hashlib.sha256(kept.tobytes()).hexdigest())):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in got[:3]), pa.array(got[3], pa.string()), batch.column("shares_passage")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"])

    return remove


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, passage: int = PASSAGE_WORDS) -> DataFrame:
    """For each row of ``docs(doc_id, text, ...)`` what is left once repeated windows are removed.

    Every byte goes that is covered by a ``depth``-byte string which also starts anywhere else.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and shares_passage: 1 if the document
    has a passage of ``passage`` words that another document has too, which may be shorter than
    ``depth`` bytes and stays. A null text is an empty one; texts shorter than ``depth`` stay whole;
    texts of any length are hashed in stretches; repeated rows repeat each other, null ids too; an
    empty table gives an empty result; other columns are not read.
    """
    rows.bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    # what documents share comes first, so that only its small result stays while bytes are sorted
    sharing = sharing_texts(docs, passage, max(1, passage // 3))
    ranges = repeated_ranges(docs, depth, gram).select("k1", "k2", F.struct("lo", "hi").alias("range"), F.lit(0).alias("shares"))
    sharing = sharing.select("k1", "k2", F.lit(None).cast(ranges.schema["range"].dataType).alias("range"), F.lit(1).alias("shares"))
    # one list of distinct ranges for a distinct text, however many rows hold it
    lists = ranges.unionByName(sharing).groupBy("k1", "k2").agg(F.collect_set("range").alias("ranges"), F.max("shares").alias("shares_passage"))
    lists = rows.written(lists)
    keyed, keys = docs.select("doc_id", "text", *rows.text_key()), ["k1", "k2"]
    joined = _beside(keyed, lists, keys, "left").withColumn("shares_passage", F.coalesce("shares_passage", F.lit(0)))
    return joined.select("doc_id", "text", "ranges", "shares_passage").mapInArrow(_remove(depth), _OUT)

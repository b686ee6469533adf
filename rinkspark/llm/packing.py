"""Documents packed into training sequences by minimum bin slack.

A document is its tokens and an end token; what is longer than a sequence is cut into pieces of full
length and a rest. Which pieces go together depends on their lengths alone, and those are numbers up
to the capacity: the histogram of lengths has at most ``capacity`` rows at any size of the corpus, and
the packing is worked out on it. Each bin is opened by the longest piece left, and a subset-sum over
the lengths still available, held as the bits of an integer, finds the fullest combination for the
rest of the bin. That combination stays the fullest for as long as its lengths last, so it is taken
as often as they do: the work is bounded by the number of lengths, not of bins.

Spark counts lengths by partition of the input, which gives every piece a number among those of its
length without bringing them together, and each piece finds its bin and place from that number. Only
rows of a few numbers are joined; tokens never move.

Defined cases: a null or empty text is the end token alone; repeated and null ids are documents of
their own; an empty table gives no rows; other columns are not read. A text is tokenised whole in one
task, whatever its length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkspark.llm import rows

#: Tokens of a sequence, and the token that ends a document.
CAPACITY = 4096
END = 1
#: Words whose tokens a Python worker keeps at most.
KEPT_WORDS = 1_000_000
#: Bytes of tokens in one Arrow batch from Python.
OUT_BYTES = 4 << 20

# The tokenizer's split of a lower-cased word, and the characters for which Python's
# lower case and letters are the library's; words with others go through the library's own steps.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-z0-9à-öø-ÿß]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Tokens of words, as little-endian 32-bit ids, by the word's bytes; made by the library when first asked for.

    The vocabulary's normaliser, split and merges never reach across white space, which they drop, so
    a text's tokens are those of what stands between ASCII white space, one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.merges, self.letters, self.parts = self.whole.model, _byte_letters(), {}

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(self.parts) >= KEPT_WORDS:
            self.parts.clear()
        text = word.decode()
        if _PLAIN.fullmatch(text):
            out = b""
            for part in _SPLIT.findall(text.lower()):
                ids = self.parts.get(part)
                if ids is None:
                    ids = self.parts[part] = self._part(part)
                out += ids
        else:
            out = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = out
        return out

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


#: One table of words a Python worker and vocabulary; tasks that follow one another share it.
_words: dict[str, Words] = {}


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth): the pieces of each document.

    ``ids`` are little-endian 32-bit numbers. ``nth`` counts the pieces of one length from zero on
    within ``part``, a partition of the input.
    """
    rows.bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    numbers = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.IntegerType()), ("ids", T.BinaryType()), ("part", T.IntegerType()), ("nth", T.LongType())]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, t) for n, t in numbers)])
    last = array("I", [end]).tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = Words(path)
        words, part, seen = _words[path], TaskContext.get().partitionId(), [0] * (capacity + 1)

        def made(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            row, piece, start, length, data, nth = zip(*found, strict=True)
            places = pa.array([part] * len(found), pa.int32())
            columns = [ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(data, pa.binary()), places, pa.array(nth, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *(n for n, _ in numbers)])

        for batch in rows.released(batches):
            raw, at = rows.utf8(batch.column(1))
            found, held = [], 0
            for i in range(len(batch)):
                ids = words.of(raw[at[i] : at[i + 1]].tobytes()) + last
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[lo : lo + 4 * capacity]
                    length = len(piece) // 4
                    found.append((i, k, lo // 4, length, piece, seen[length]))
                    seen[length] += 1
                    held += len(piece)
                    if held >= OUT_BYTES:
                        yield made(batch.column(0), found)
                        found, held = [], 0
            if found:
                yield made(batch.column(0), found)

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def fullest(left: list[int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination that fills ``room`` best, from ``left[length]`` pieces of each length.

    Bit n of ``sums`` is set if some combination has n tokens in all. A length's supply enters in
    powers of two, longest lengths first, until the room is filled exactly.
    """
    sums, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in range(min(room, len(left) - 1), 0, -1):
        supply, step = min(left[length], room // length), 1
        while supply:
            step = min(step, supply)
            steps.append((length, step, sums))
            sums |= (sums << (length * step)) & mask
            supply, step = supply - step, 2 * step
        if sums >> room:
            break
    reached, times = sums.bit_length() - 1, {}
    for length, step, before in reversed(steps):
        if not before >> reached & 1:
            times[length] = times.get(length, 0) + step
            reached -= length * step
    return sorted(times.items(), reverse=True)


def minimum_bin_slack(counts: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, times), ...]) in turn: so many bins of one combination each, until no piece is left."""
    left, out = [0] * (capacity + 1), []
    for length, n in counts:
        left[length] += n
    for longest in range(capacity, 0, -1):
        while left[longest]:
            left[longest] -= 1
            rest = dict(fullest(left, capacity - longest))
            left[longest] += 1
            rest[longest] = rest.get(longest, 0) + 1
            bins = min(left[length] // times for length, times in rest.items())
            for length, times in rest.items():
                left[length] -= bins * times
            out.append((bins, sorted(rest.items(), reverse=True)))
    return out


#: Room for the numbers of one length's pieces in a search key.
_SHIFT = 50


def _places(bins: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """For runs of pieces of one length: their key, first number, pieces a bin, first bin, and offset in it."""
    taken: dict[int, int] = {}
    found, first = [], 0
    for n, content in bins:
        offset = 0
        for length, times in content:
            before = taken.get(length, 0)
            found.append(((length << _SHIFT) + before, before, times, first, offset))
            taken[length] = before + n * times
            offset += length * times
        first += n
    found.sort()
    return tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece's sequence and place.

    The tokens themselves are kept where ``keep_ids`` asks for them.
    """
    slim = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "part", "nth"]
    table = rows.written(tokenised(docs, path, capacity, end).select(*slim, *["ids"] * keep_ids))
    by_part = rows.written(table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = [(r.length, r.n) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()]
    keys, before, times, first, offsets = _places(minimum_bin_slack(counts, capacity))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = table.join(rows.small(by_part.select("length", "part", ahead.alias("ahead"))), ["length", "part"]).withColumn("number", F.col("ahead") + F.col("nth"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    schema = T.StructType([*(numbered.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            run = np.searchsorted(keys, (length << _SHIFT) + number, "right") - 1
            inside = number - before[run]
            found = [first[run] + inside // times[run], offsets[run] + inside % times[run] * length]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], [*columns, "sequence_id", "offset"])

    out = numbered.select(*columns, "number").mapInArrow(placed, schema)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the tokens of each sequence in order, as bytes, from ``pack`` with ``keep_ids``.

    A group is one sequence, so it holds no more than the capacity.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))

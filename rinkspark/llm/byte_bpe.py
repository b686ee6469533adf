"""Byte-level BPE over whole texts: overlapping chunks are pre-tokenised in parallel and stitched.

The pre-token pattern looks ahead but never back, so two passes over a text that share a boundary
agree from there on. A long text is cut into overlapping chunks, each pre-tokenised from its own
start without knowing the text before. Where the boundaries of two neighbours coincide inside
their overlap, the chunks are stitched; if they never do, the earlier pass goes on into the next
chunk until it meets one. The stitched pieces are then encoded, and decoding joins raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import rows

CHUNK = 1 << 15
OVERLAP = 512
#: Characters after a match that may still change it: a contraction is three characters long.
MARGIN = 3


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Where pre-tokens start, as far as text beyond the end can't change it."""
    end = len(text) - (0 if last else MARGIN)
    found = [0]
    for m in regex.compile(pattern).finditer(text):
        if m.end() > end:
            break
        found.append(m.end())
    return found


def _safe(text: str, at: int) -> bool:
    """Whether the text may be cut here: a run of white space before the cut would match further."""
    return at == 0 or not text[at - 1].isspace()


def stitch(chunks: list[tuple[int, str, list[int], list[int]]], pattern: str) -> Iterator[str]:
    """The pieces of a text, cut at true pre-token boundaries.

    ``chunks`` are (start, text, head boundaries, tail boundaries) in order; boundaries count from
    the start of the whole text. The head are those in the overlap with the chunk before, the tail
    those in the overlap with the next.
    """
    compiled = regex.compile(pattern)
    begin, text, _, tail = chunks[0]
    # ``held`` is the text from ``at`` on, and ``at`` a true boundary
    at, held = begin, text
    for start, text, head, next_tail in chunks[1:]:
        heads = set(head)
        meet = next((b for b in tail if b in heads and b > at and _safe(held, b - at)), None)
        whole = held + text[at + len(held) - start :]
        if meet is None:
            # the pass from before goes on, one pre-token at a time, until both agree
            here = max((b for b in tail if at <= b < start), default=at)
            own = {start + b for b in boundaries(text, pattern, False)}
            while here < at + len(whole):
                if here in own and here > at and _safe(whole, here - at):
                    meet = here
                    break
                m = compiled.match(whole, here - at)
                if m is None or m.end() > len(whole) - MARGIN:
                    break
                here = at + m.end()
        if meet is not None:
            yield whole[: meet - at]
            held, at = whole[meet - at :], meet
        else:
            held = whole
        tail = next_tail if meet is not None else []
    yield held


def encode_pieces(pieces: Iterable[str], enc: tiktoken.Encoding) -> list[int]:
    ids: list[int] = []
    for piece in pieces:
        ids += enc.encode_ordinary(piece)
    return ids


_IDS = "doc_id long, text string, ids array<int>, decoded binary"


def _encoded(docs: list, texts: list[str], every: Iterable[list[int]], enc: tiktoken.Encoding, keep: bool, decode: bool) -> list[pa.Array]:
    """The columns of ``_IDS``; decoding starts from the ids alone."""
    ids, back = [], []
    for some in every:
        ids.append(np.array(some, np.int32))
        back.append(enc.decode_bytes(some) if decode else None)
    return [pa.array(docs, pa.int64()), pa.array(texts, pa.string()) if keep else pa.nulls(len(ids), pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.binary())]


_NAMES = ["doc_id", "text", "ids", "decoded"]


def _encode_single(path: str, pattern: str, keep: bool, decode: bool):
    """Texts of one chunk: stitching it with no neighbour gives the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path, pattern)
        for batch in rows.released(batches):
            texts = batch.column("text").to_pylist()
            ids = (encode_pieces(stitch([(0, t, [], [])], pattern), enc) for t in texts)
            yield pa.RecordBatch.from_arrays(_encoded(batch.column("doc_id").to_pylist(), texts, ids, enc, keep, decode), names=_NAMES)

    return run


_PIECE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            for i, text in enumerate(batch.column("text")):
                text, row, doc = text.as_py(), batch.column("row")[i].as_py(), batch.column("doc_id")[i].as_py()
                n = -(-len(text) // chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([j == n - 1 for j in range(n)]), pa.array([text[j * chunk : (j + 1) * chunk + overlap] for j in range(n)], pa.string())], schema=_PIECE
                )

    return run


def _pretokenise(pattern: str, chunk: int, overlap: int):
    places = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            heads, tails = [], []
            for number, last, text in zip(batch.column("chunk").to_pylist(), batch.column("last").to_pylist(), batch.column("text").to_pylist()):
                found = boundaries(text, pattern, last)
                heads.append([number * chunk + b for b in found if b <= overlap])
                tails.append([number * chunk + b for b in found if b >= chunk])
            yield batch.append_column("head", pa.array(heads, places)).append_column("tail", pa.array(tails, places))

    return run


def _stitch_and_encode(path: str, pattern: str, chunk: int, keep: bool, decode: bool):
    def run(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        chunks = [(r["chunk"] * chunk, r["text"], r["head"], r["tail"]) for r in parts]
        enc = codec(path, pattern)
        ids = encode_pieces(stitch(chunks, pattern), enc)
        text = "".join(r["text"][:chunk] for r in parts) if keep else None
        return pa.table(_encoded([parts[0]["doc_id"]], [text], [ids], enc, keep, decode), names=_NAMES)

    return run


def _pieces_of(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int, keep: bool, decode: bool) -> DataFrame:
    rows.bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).alias("text")
    size = F.coalesce(F.char_length("text"), F.lit(0))
    one = docs.where(size <= chunk).select(F.col("doc_id").cast("long"), text).mapInArrow(_encode_single(path, pattern, keep, decode), _IDS)
    many = docs.where(size > chunk).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text)
    cut = many.mapInArrow(_cut(chunk, overlap), "row long, doc_id long, chunk long, last boolean, text string").repartition("row", "chunk")
    marked = cut.mapInArrow(_pretokenise(pattern, chunk, overlap), "row long, doc_id long, chunk long, last boolean, text string, head array<long>, tail array<long>")
    return one.unionByName(marked.groupBy("row").applyInArrow(_stitch_and_encode(path, pattern, chunk, keep, decode), _IDS))


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, keep_text: bool = False) -> DataFrame:
    """(doc_id, text, ids) of every row of ``docs(doc_id, text, ...)``, as one pass over each whole text gives.

    ``path`` names a rank file that every executor has (a line a token: base64 and rank). A null or
    empty text has no ids. Ids, null ones too, and repeated rows pass through; an empty table gives an
    empty result; other columns are not read. Every text is taken as overlapping chunks of ``chunk``
    characters; those of a text that has several are dealt out. ``text`` is null unless ``keep_text``.
    """
    return _pieces_of(docs, path, pattern, chunk, overlap, keep_text, False).drop("decoded")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, keep_text: bool = False) -> DataFrame:
    """What ``encode`` gives, and ``decoded`` as ``decode`` gives it, from one Python process a task."""
    return _pieces_of(docs, path, pattern, chunk, overlap, keep_text, True)


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path, pattern)
        for batch in rows.released(batches):
            yield batch.append_column("decoded", pa.array([enc.decode_bytes(ids.values.to_pylist() if ids.is_valid else []) for ids in batch.column("ids")], pa.binary()))

    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary), the raw bytes of its ``ids``; null ids give no bytes."""
    return encoded.mapInArrow(_decode(path, pattern), encoded.withColumn("decoded", F.lit(b"")).schema)

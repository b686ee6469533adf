"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

The fixed patterns' matches are seed entities. The words around a seed make lexical patterns, and
tokens in the same places that no fixed pattern matches are instances still unknown. Spark scores
the graph of patterns and instances in rounds: a pattern is as sure as the distinct instances it
surrounds, an instance as the patterns around it (noisy-or). Instances of confident patterns are
reported under the pattern's kind, and from the next round on they count as seeds, wherever else they
stand, so that they induce patterns that no seed of the fixed patterns has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import rows

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: What a pattern needs: distinct seeds or accepted instances of its kind, and its share of sure instances.
SUPPORT = 5
CONFIDENT = 0.8
#: Score from which an unknown instance is reported.
ACCEPT = 0.8

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Begun only where a run of digits begins, and never given back: what a run doesn't start, no later digit of it does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\s,;:!?\"'<>()\[\]{}|]+")
# A context's words are whole words of at most 36 letters, with at most three marks or blanks between.
_WORD_BEFORE = re.compile(r"(?<![^\W\d_])([^\W\d_]{1,36})[^\w\n]{0,3}$")
_WORD_AFTER = re.compile(r"[^\w\n]{0,3}([^\W\d_]{1,36})(?![^\W\d_])")
_NUMBER = re.compile(r"\+?[0-9][0-9./-]*")


def luhn(digits: str) -> bool:
    """The check-digit sum: from the right, every second digit doubled and its digits added."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns' matches, in code points, by kind and then start."""
    found = []
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def _emails(text: str) -> Iterator[re.Match]:
    """The e-mail pattern's matches, looked for only around each at sign."""
    end = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        m = _EMAIL.match(text, begin) if begin < at else None
        if m:
            yield m
            end = m.end()
        at = text.find("@", max(at + 1, end))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the word before, the words on either side."""
    before = _WORD_BEFORE.search(text, max(0, start - 39), start)
    after = _WORD_AFTER.match(text, end)
    out = []
    if before:
        out.append("< " + before[1].lower())
        if after:
            out.append(f"{before[1].lower()} <> {after[1].lower()}")
    return out


def unknowns(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens with four digits or more, or an at sign, that no fixed pattern touches.

    Numbers that single blanks join are one token.
    """
    out: list[tuple[int, int]] = []
    if not _DIGIT.search(text) and "@" not in text:
        return out
    joined: list[tuple[int, int, bool]] = []
    for m in _TOKEN.finditer(text):
        word = m[0].rstrip(".")
        a, b, number = m.start(), m.start() + len(word), _NUMBER.fullmatch(word) is not None
        if number and joined and joined[-1][2] and joined[-1][1] == a - 1 and text[a - 1] == " ":
            joined[-1] = joined[-1][0], b, True
        elif number or _DIGIT.search(word) or "@" in word:
            joined.append((a, b, number))
    found = rows.Taken(taken)
    for a, b, _ in joined:
        if (len(_DIGIT.findall(text, a, b)) >= 4 or "@" in text[a + 1 : b - 1]) and not found.touches(a, b):
            out.append((a, b))
    return out


_SCAN = "row long, doc_id long, base array<struct<kind:string,start:long,end:long>>, seen array<struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>>"
_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SEEN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows.released(batches):
        base, seen = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            every = spans + [("", a, b) for a, b in unknowns(text, spans)]
            seen.append([{"kind": k, "start": a, "end": b, "instance": text[a:b].lower(), "patterns": contexts(text, a, b)} for k, a, b in every])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(base, _BASE), pa.array(seen, _SEEN)], names=["row", "doc_id", "base", "seen"])


def _noisy_or(sure: str):
    return 1 - F.exp(F.sum(F.log(1 - F.least(sure, F.lit(0.999)))))


def scored_instances(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(i, kind, score): hashes of unknown instances that confident patterns surround, with the round's score."""
    edges = scanned.select(F.explode("seen").alias("s")).select("s.kind", F.xxhash64("s.instance").alias("i"), F.explode("s.patterns").alias("p"))
    edges = rows.written(edges.select("kind", "i", F.xxhash64("p").alias("p")).distinct())
    sizes = rows.written(edges.groupBy("p").agg(F.countDistinct("i").alias("all")))
    seeds, unknown = edges.where("kind <> ''"), edges.where("kind = ''").select("i", "p")
    accepted = rows.counted(seeds.select("i", "kind", F.lit(1.0).alias("score")).limit(0))
    patterns = seeds.limit(0).select("p", "kind", F.lit(0.0).alias("sure"))
    for _ in range(rounds):
        # a pattern can be confident only with enough seeds and accepted instances of one kind
        told = seeds.select("kind", "i", "p").unionByName(unknown.join(rows.small(accepted), "i").select("kind", "i", "p")).distinct()
        able = told.groupBy("p", "kind").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= SUPPORT)
        able = able.join(sizes, "p").join(patterns, ["p", "kind"], "left").select("p", "kind", "seeds", "all", F.coalesce("sure", F.col("seeds") / F.col("all")).alias("sure"))
        able = rows.counted(able)
        left = rows.counted(unknown.join(rows.small(accepted.select("i"), of=accepted), "i", "left_anti").join(rows.small(able.select("p").distinct(), of=able), "p", "left_semi"))
        if not left._counted["rows"]:
            break
        # an instance's score for a kind is the noisy-or of its patterns of that kind
        scores = left.join(able, "p").groupBy("i", "kind").agg(_noisy_or("sure").alias("score"))
        gained = left.join(scores, "i").groupBy("p", "kind").agg(F.sum("score").alias("gained"))
        sure = F.least(F.lit(1.0), (F.col("seeds") + F.coalesce("gained", F.lit(0.0)) * F.col("seeds") / F.col("all")) / F.col("all"))
        patterns = rows.counted(able.join(gained, ["p", "kind"], "left").select("p", "kind", sure.alias("sure")))
        good = patterns.where(F.col("sure") >= CONFIDENT)
        new = left.join(rows.small(good, of=patterns), "p").groupBy("i", "kind").agg(_noisy_or("sure").alias("score")).where(F.col("score") >= ACCEPT)
        # the kind that fits best; of equals the last in the alphabet
        new = new.groupBy("i").agg(F.max(F.struct("score", "kind")).alias("b")).select("i", "b.kind", "b.score")
        accepted = rows.counted(accepted.unionByName(new))
    return accepted


def scan(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, spans) of every row of ``docs(doc_id, text, ...)``; spans are {kind, start, end, added}.

    Places are code points of the whole text, ends exclusive, in order of kind and then start.
    ``added`` marks what the bootstrapped patterns found. A null or empty text has no spans; very
    long texts are searched whole. Ids, null ones too, and repeated rows pass through (an instance
    counts once for a pattern, however often it is there); an empty table gives an empty result;
    other columns are not read.
    """
    rows.bounded_batches(docs.sparkSession)
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scanned = rows.written(keyed.mapInArrow(_scan, _SCAN))
    found = scored_instances(scanned, rounds)
    best = found.select("i", "kind")
    unknown = scanned.select("row", F.explode("seen").alias("s")).where("s.kind = ''").select("row", F.xxhash64("s.instance").alias("i"), "s.start", "s.end")
    added = unknown.join(rows.small(best, of=found), "i").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", F.lit(True).alias("added"))).alias("more"))
    out = scanned.select("row", "doc_id", "base").join(added, "row", "left")
    kinds = "array('" + "','".join(KINDS) + "')"
    every = F.expr("concat(transform(base, b -> struct(b.kind, b.start, b.end, false as added)), coalesce(more, cast(array() as array<struct<kind:string,start:bigint,end:bigint,added:boolean>>)))")
    order = f"array_sort(spans, (a, b) -> cast(case when a.kind <> b.kind then array_position({kinds}, a.kind) - array_position({kinds}, b.kind) else sign(a.start - b.start) end as int))"
    return out.select("doc_id", every.alias("spans")).select("doc_id", F.expr(order).alias("spans"))


def joined(spans: str, keep: str = "true") -> str:
    """SQL for kind:start:end of the spans that ``keep`` holds for, comma-joined."""
    return f"array_join(transform(filter({spans}, s -> {keep}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def digests(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the fixed patterns' spans, all spans as text, and how many they are."""
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}' and not s.added)) as bigint)").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *count, F.sha2(F.expr(joined("spans", "not s.added")), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def masked(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; n_chars follows."""
    row, found = rows.fresh(docs, "row"), rows.fresh(docs, "spans")
    keyed = rows.written(docs.select(F.monotonically_increasing_id().alias(row), *docs.columns))
    spans = scan(keyed.select(F.col(row).alias("doc_id"), "text"), rounds)
    touched = rows.counted(spans.where("size(spans) > 0").select(F.col("doc_id").alias(row), F.col("spans").alias(found)))
    out = keyed.join(rows.small(touched), row, "left").select(*docs.columns, found)
    return out.mapInArrow(_masker(found), keyed.select(*docs.columns).schema)


def _without(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] > at:
            parts += [text[at : max(at, s["start"])], f"[{s['kind'].upper()}]"]
            at = s["end"]
    return "".join(parts) + text[at:]


def _masker(found: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            texts = [_without(t.as_py(), s) if s else t.as_py() for t, s in zip(batch.column("text"), batch.column(found).to_pylist())]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in batch.schema.names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            names = [n for n in batch.schema.names if n != found]
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return run

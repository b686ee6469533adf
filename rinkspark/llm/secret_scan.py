"""Secret scans: fixed patterns, and formats learnt from what they find by grammar inference.

The credentials that the fixed patterns label are turned into prefix trees over character classes,
one a kind. States whose outgoing frequencies are statistically compatible are merged, which gives
a probabilistic automaton of the kind's format. All other candidate tokens of the corpus are then
scored by how much likelier the automaton makes them than the mix of classes that candidates have
anyway; those that fit a format as well as its labelled credentials do are reported too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkspark.llm import rows

KINDS = ("assign", "access", "hex")
#: Labelled credentials to learn a kind from, the first by hash of the distinct values.
LABELLED = 400
#: Characters of the longest labelled credentials that are learnt from; longer ones are not in the sample.
LONGEST = 512
ALPHA = 0.05
#: A token fits a format if it gains as much as a labelled credential, less so many standard deviations.
SIGMAS = 3.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_DIGITS = re.compile(r"[0-9]+")
_REST = re.compile(r"[A-Za-z0-9+/_.=-]*")
_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
#: Characters of the shortest candidate token: as many as an assigned value has at least.
SHORTEST = 8


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns' matches, in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens of SHORTEST or more characters of assigned values, with a digit and a letter, apart from ``taken``.

    Dots at a token's ends are punctuation. The search goes from digits, which prose has few of.
    """
    out, end, spans = [], 0, rows.Taken(taken)
    for m in _DIGITS.finditer(text):
        if m.start() < end:
            continue
        lo, hi = m.start(), _REST.match(text, m.end()).end()
        while lo > end and text[lo - 1] in _CHARACTERS:
            lo -= 1
        end = hi
        while text[lo] == ".":
            lo += 1
        while text[hi - 1] == ".":
            hi -= 1
        if hi - lo >= SHORTEST and any(c.isalpha() for c in text[lo:hi]) and not spans.touches(lo, hi):
            out.append((lo, hi))
    return out


def symbols(word: str) -> str:
    """Character classes: d digit, h and H hex letters, l and L others, the rest themselves."""
    return "".join("d" if c.isdigit() else "h" if "a" <= c <= "f" else "H" if "A" <= c <= "F" else "l" if c.islower() else "L" if c.isupper() else c for c in word)


class Automaton:
    """A probabilistic automaton inferred from words by merging compatible prefix-tree states."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.alpha = alpha
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.total: list[int] = [0]
        for word in words:
            self._add(word)
        self._merge()
        self.alphabet = sorted({s for c in self.count for s in c})

    def _add(self, word: str) -> None:
        at = 0
        for s in [*word, "$"]:
            self.count[at][s] += 1
            self.total[at] += 1
            if s == "$":
                return
            if s not in self.next[at]:
                self.next[at][s] = len(self.next)
                self.next.append({})
                self.count.append(Counter())
                self.total.append(0)
            at = self.next[at][s]

    def _similar(self, a: int, b: int) -> bool:
        """Hoeffding's test on every symbol's frequency, here and below."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            within = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.count[a][s] / n - self.count[b][s] / m) >= within for s in self.count[a].keys() | self.count[b].keys()):
                return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to the automaton at ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.total[a] += self.total[b]
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t

    def _merge(self) -> None:
        kept = [0]
        border = [(0, s) for s in sorted(self.next[0])]
        while border:
            source, s = border.pop(0)
            state = self.next[source][s]
            if state in kept:
                continue
            into = next((k for k in kept if self._similar(k, state)), None)
            if into is None:
                kept.append(state)
            else:
                self.next[source][s] = into
                self._fold(into, state)
            border = [(k, s) for k in kept for s in sorted(self.next[k]) if self.next[k][s] not in kept]
        self.states = kept

    def score(self, word: str) -> float:
        """Mean log-likelihood of the word's symbols; unseen ones get the share of half a sighting."""
        at, total, floor = 0, 0.0, len(self.alphabet) + 1
        for s in word:
            n = self.total[at] if at is not None else 0
            seen = self.count[at][s] if at is not None else 0
            total += math.log((seen + 0.5) / (n + 0.5 * floor))
            at = self.next[at].get(s) if at is not None else None
        return total / max(1, len(word))


class Formats:
    """The automata of all kinds, with the mix of classes they are held against."""

    def __init__(self, labelled: dict[str, list[str]], mix: Counter):
        every = sum(mix.values()) + 16
        self.mix = {s: math.log((n + 1) / every) for s, n in mix.items()}
        self.rare = math.log(1 / every)
        self.kinds: dict[str, tuple[Automaton, float, int]] = {}
        for kind in KINDS:
            words = [symbols(w) for w in labelled.get(kind, [])]
            if len(words) < 20:
                continue
            automaton = Automaton(words)
            gains = [self._gain(automaton, w) for w in words]
            mean = sum(gains) / len(gains)
            spread = math.sqrt(sum((g - mean) ** 2 for g in gains) / len(gains))
            self.kinds[kind] = automaton, max(0.0, mean - SIGMAS * spread), min(map(len, words))

    def _gain(self, automaton: Automaton, word: str) -> float:
        return automaton.score(word) - sum(self.mix.get(s, self.rare) for s in word) / max(1, len(word))

    def kind(self, token: str) -> str | None:
        """The kind whose format the token fits best, if it fits one."""
        word = symbols(token)
        fits = [(self._gain(a, word) - least, k) for k, (a, least, n) in self.kinds.items() if len(word) >= n]
        best = max(fits, default=(-1.0, ""))
        return best[1] if best[0] >= 0 else None


_SCAN = "row long, doc_id long, base array<struct<kind:string,start:long,end:long,value:string>>, found array<struct<start:long,end:long,value:string>>"
_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows.released(batches):
        base, found = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b, "value": _ASSIGN.match(text, a)[2] if k == "assign" else text[a:b]} for k, a, b in spans])
            found.append([{"start": a, "end": b, "value": text[a:b]} for a, b in candidates(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(base, _BASE), pa.array(found, _FOUND)], names=["row", "doc_id", "base", "found"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a task's candidates have each class of characters."""
    total: Counter = Counter()
    for batch in batches:
        for found in batch.column(0).to_pylist():
            for f in found:
                total.update(symbols(f["value"]))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["class", "n"])


def _first(values: DataFrame, n: int) -> list[str]:
    return [r.value for r in values.distinct().orderBy(F.xxhash64("value"), "value").limit(n).collect()]


def learn(scanned: DataFrame) -> Formats:
    """Automata of the labelled credentials in a scanned table; samples are bounded by the constants above."""
    short = F.length("value") <= LONGEST
    labels = scanned.select(F.explode("base").alias("b")).select("b.kind", "b.value").where(short)
    labelled = {k: _first(labels.where(F.col("kind") == k).select("value"), LABELLED) for k in KINDS}
    # the mix counts every character of every candidate; a row a class comes to the driver
    counted = scanned.select("found").mapInArrow(_classes, "class string, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    mix = Counter({r["class"]: r.n for r in counted})
    mix.update("".join(symbols(w) for k in KINDS for w in labelled[k]))
    return Formats(labelled, mix)


def _score(formats: Formats):
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.released(batches):
            out = []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist()):
                all_spans = [{k: b[k] for k in ("kind", "start", "end")} | {"added": False} for b in base]
                for f in found:
                    if kind := formats.kind(f["value"]):
                        all_spans.append({"kind": kind, "start": f["start"], "end": f["end"], "added": True})
                out.append(sorted(all_spans, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"])))
            typed = pa.list_(pa.struct([*spans.value_type, pa.field("added", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, typed)], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """(doc_id, spans) of every row of ``docs(doc_id, text, ...)``; spans are {kind, start, end, added}.

    Places are code points of the whole text, ends exclusive, in order of start and then kind.
    ``added`` marks spans that a learnt format found; without ``formats`` they are learnt from
    ``docs``. A null or empty text has no spans. Ids, null ones too, and repeated rows pass through;
    an empty table gives an empty result, and too few labels of a kind teach no format of it. Very
    long texts are searched whole, and long tokens scored whole. A token that fits two formats alike
    is of the kind last in the alphabet. Other columns are not read.
    """
    rows.bounded_batches(docs.sparkSession)
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scanned = rows.written(keyed.mapInArrow(_scan, _SCAN))
    return scanned.select("doc_id", "base", "found").mapInArrow(_score(formats or learn(scanned)), "doc_id long, spans array<struct<kind:string,start:long,end:long,added:boolean>>")


def joined(spans: str, keep: str = "true") -> str:
    """SQL for kind:start:end of the spans that ``keep`` holds for, comma-joined."""
    return f"array_join(transform(filter({spans}, s -> {keep}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def digests(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the fixed patterns' spans, all spans as text, and how many they are."""
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}' and not s.added)) as bigint)").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *count, F.sha2(F.expr(joined("spans", "not s.added")), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))

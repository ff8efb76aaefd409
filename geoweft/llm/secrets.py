"""Secret scans: fixed patterns, and formats inferred as probabilistic automata.

A first pass over the texts finds the base spans (assignments, access keys, hexadecimal runs), whose credentials are
labelled examples, and counts how candidates look. Candidates are all runs of token characters (those of assignments),
of any length and kind, less the full stops at their ends. Where a run holds a base span, its parts between full stops
that hold none are candidates instead. For each kind, a bounded sample of distinct credentials (`SAMPLE`, the smallest
hashes) becomes a prefix tree of character classes whose states are merged where their futures are statistically
compatible (Hoeffding bounds on endings and next symbols, in breadth-first order, merging deterministically). A second
pass scores every candidate of every text by its log-likelihood under each automaton against a background model, per
character; what an automaton explains better by `MARGIN` and as likely as its own examples is a span of kind `format`;
of a candidate that isn't, the parts between full stops are scored. The background is counted over all candidates, apart
for each set of kinds of characters (digits, small letters, capitals) that a candidate has: words are compared with
words, words in capitals with such, and neither makes a number look strange.

Candidates are strings of character classes, few of which are distinct: each task scores a string once and keeps what
it found, in a table that is cleared when it is full. No text leaves the task that reads it.

Defined results: null and empty texts have no spans; with no credentials no format is inferred and base spans stand
alone; repeated rows are scanned once each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm._common import cut, id_and_bytes

# The base patterns.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")

SAMPLE = 2000
ALPHA = 0.4
MARGIN = 0.15
#: Distinct strings of classes that a task holds at once.
HELD = 100_000
_HINTS = (b"pass", b"secret", b"token", b"api")
_TOKEN = np.zeros(256, np.bool_)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_RUN = re.compile(rb"[^\0\1]+")
_PART = re.compile(rb"[^.]+")
#: Character classes: digits, a-f, g-z, A-Z; any other character is itself.
_CLASS = bytes(ord("d") if 48 <= b < 58 else ord("h") if 97 <= b < 103 else ord("l") if 103 <= b < 123 else ord("U") if 65 <= b < 91 else b for b in range(256))
#: Classes of token characters; 1 for the further bytes of a code point, 0 for all else.
_SYMBOL = bytes(_CLASS[b] if _TOKEN[b] else int(128 <= b < 192) for b in range(256))


def base_spans(text: bytes, stretches: list[tuple[int, int]]) -> list[tuple[int, int, int, bytes]]:
    """(start, end, kind, credential) in bytes, by start and kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), 0, m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for s, e in stretches:
        if e - s >= 32:
            out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text, s, e)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def long_runs(text: bytes, least: int = 32) -> list[tuple[int, int]]:
    """Stretches of `least` or more token characters; every long hexadecimal run lies in one."""
    inside = _TOKEN[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def candidates(text: bytes, taken: list[tuple[int, int, int, bytes]]) -> bytes:
    """The text's bytes as _SYMBOL; where a run holds a base span, its full stops and the parts that overlap one are 0.
    The runs that are left are the candidates."""
    symbols = text.translate(_SYMBOL)
    if not taken:
        return symbols
    starts, ends = _merged([(a, b) for a, b, *_ in taken])

    def free(a: int, b: int) -> bool:
        """Whether no base span overlaps [a, b): the last one that starts before b ends by a."""
        k = bisect_left(starts, b)
        return not k or ends[k - 1] <= a

    left = bytearray(symbols)
    for run in _RUN.finditer(symbols):
        i, j = run.span()
        if free(i, j):
            continue
        left[i:j] = left[i:j].replace(b".", b"\0")
        for part in _PART.finditer(symbols, i, j):
            if not free(*part.span()):
                left[part.start() : part.end()] = bytes(part.end() - part.start())
    return bytes(left)


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans that are sorted by start."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def code_points(text: bytes) -> np.ndarray | None:
    """How many code points lie before each byte; None where each byte is one."""
    return None if text.isascii() else np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]


def make_up(symbols: bytes) -> int:
    """Which kinds of characters a string of classes has: 1 digits, 2 small letters, 4 capitals, summed."""
    return (b"d" in symbols) + 2 * (b"h" in symbols or b"l" in symbols) + 4 * (b"U" in symbols)


def count_pairs(tokens: dict[bytes, int], counts: np.ndarray) -> None:
    """Adds the pairs of neighbouring classes of candidates (ends are 0), 65,536 counts for each make-up."""
    whole = {t: n for t, n in tokens.items() if t.strip(b".")}
    names = [t.strip(b".") for t in whole]
    if not names:
        return
    symbols = np.frombuffer(b"\0" + b"\0".join(names) + b"\0", np.uint8).astype(np.int64)
    lengths = [len(t) + 1 for t in names]
    makes = np.repeat(np.array([make_up(t) for t in names], np.int64), lengths)
    times = np.repeat(np.array([*whole.values()], np.int64), lengths)
    counts += np.bincount(makes << 16 | symbols[:-1] << 8 | symbols[1:], times, len(counts)).astype(np.int64)


@dataclass
class Automaton:
    """States with transitions per symbol; counts of passages, of endings, and of each transition."""

    move: list[dict[int, int]] = field(default_factory=lambda: [{}])
    through: list[dict[int, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [0])
    passed: list[int] = field(default_factory=lambda: [0])
    floor: float = 0.0

    def add(self, symbols: bytes, times: int = 1) -> None:
        at = 0
        self.passed[0] += times
        for c in symbols:
            self.through[at][c] = self.through[at].get(c, 0) + times
            if c not in self.move[at]:
                self.move[at][c] = len(self.move)
                self.move.append({})
                self.through.append({})
                self.ends.append(0)
                self.passed.append(0)
            at = self.move[at][c]
            self.passed[at] += times
        self.ends[at] += times

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether two states' futures are compatible: endings and symbols within Hoeffding bounds, all the way down."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.passed[a], self.passed[b]
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.through[a].keys() | self.through[b].keys():
                if abs(self.through[a].get(c, 0) / n - self.through[b].get(c, 0) / m) > bound:
                    return False
                if c in self.move[a] and c in self.move[b] and (self.move[a][c], self.move[b][c]) != (a, b):
                    todo.append((self.move[a][c], self.move[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.passed[a] += self.passed[b]
            for c, n in self.through[b].items():
                self.through[a][c] = self.through[a].get(c, 0) + n
                if c in self.move[a]:
                    todo.append((self.move[a][c], self.move[b][c]))
                else:
                    self.move[a][c] = self.move[b][c]

    def generalise(self, alpha: float = ALPHA) -> Automaton:
        """Merges compatible states: the first state that settled ones lead to joins the first of them it agrees with, or
        settles itself, until settled states lead nowhere else."""
        settled, known = [0], {0}
        while True:
            parent, c = next(((s, c) for s in settled for c in sorted(self.move[s]) if self.move[s][c] not in known), (None, None))
            if parent is None:
                break
            state = self.move[parent][c]
            alike = next((s for s in settled if self._alike(s, state, alpha)), None)
            if alike is None:
                settled.append(state)
                known.add(state)
            else:
                self.move[parent][c] = alike
                self._fold(alike, state)
        return self._compact(settled)

    def _compact(self, settled: list[int]) -> Automaton:
        number = {s: k for k, s in enumerate(settled)}
        return Automaton([{c: number[t] for c, t in self.move[s].items()} for s in settled], [dict(self.through[s]) for s in settled], [self.ends[s] for s in settled], [self.passed[s] for s in settled])

    def score(self, symbols: bytes) -> float:
        """Log-likelihood per symbol, the end counted as one."""
        at, total = 0, 0.0
        for c in symbols:
            if c not in self.move[at]:
                return -math.inf
            total += math.log(self.through[at][c] / self.passed[at])
            at = self.move[at][c]
        if not self.ends[at]:
            return -math.inf
        return (total + math.log(self.ends[at] / self.passed[at])) / (len(symbols) + 1)


@dataclass(frozen=True)
class Formats:
    automata: dict[int, Automaton]
    background: np.ndarray

    def background_score(self, symbols: bytes) -> float:
        pairs = np.frombuffer(b"\0" + symbols + b"\0", np.uint8)
        return float(self.background[make_up(symbols)][pairs[:-1], pairs[1:]].mean())

    def accepts(self, symbols: bytes) -> float | None:
        """How much better than the background the best format explains a string of classes; None if none does."""
        best = max((score for a in self.automata.values() if (score := a.score(symbols)) >= a.floor), default=None)
        better = None if best is None else best - self.background_score(symbols)
        return better if better is not None and better >= MARGIN else None

    def spans(self, run: bytes) -> list[tuple[int, int]]:
        """What is accepted of a run of classes: the whole less full stops at its ends, else parts between them."""
        token = run.lstrip(b".")
        start = len(run) - len(token)
        token = token.rstrip(b".")
        if not token:
            return []
        if self.accepts(token) is not None:
            return [(start, start + len(token))]
        return [p.span() for p in _PART.finditer(run) if self.accepts(p[0]) is not None] if b"." in token else []


def infer(examples: dict[int, list[bytes]], background: Counter) -> Formats:
    """Automata per kind from sampled credentials; background: counts of (make-up, class, next class) over all candidates."""
    counts = np.full((8, 256, 256), 0.01)
    for (make, a, b), n in background.items():
        counts[make, a, b] += n
    model = np.log(counts / counts.sum(2, keepdims=True))
    automata = {}
    for kind, tokens in examples.items():
        tree = Automaton()
        symbols = [t.translate(_CLASS) for t in tokens]
        for s in symbols:
            tree.add(s)
        learnt = tree.generalise()
        learnt.floor = float(np.quantile([learnt.score(s) for s in symbols], 0.02))
        automata[kind] = learnt
    return Formats(automata, model)


_SPAN = "array<struct<start:long,end:long,kind:int>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, spans (code points, end exclusive; kind as in KINDS; by start, then kind)."""
    struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
    texts = id_and_bytes(docs, id_col, text_col)
    formats = docs.sparkSession.sparkContext.broadcast(learn(texts, sample))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[tuple[int, int]]] = {}

        def spans(run: bytes) -> list[tuple[int, int]]:
            got = known.get(run)
            if got is None:
                got = formats.value.spans(run)
                if len(known) >= HELD:
                    known.clear()
                if len(run) <= 64:
                    known[run] = got
            return got

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or b""
                base = base_spans(text, long_runs(text))
                symbols = candidates(text, base)
                found = [(s, e, k) for s, e, k, _ in base]
                for m in _RUN.finditer(symbols):
                    for i, j in spans(m[0]):
                        found.append((m.start() + i, m.start() + j, 3))
                before = code_points(text) if found else None
                at = (lambda i: i) if before is None else (lambda i, n=before: int(n[i]))
                out.append([{"start": at(s), "end": at(e), "kind": k} for s, e, k in sorted(found, key=lambda f: (f[0], f[2]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, struct)], names=["doc_id", "spans"])

    return texts.mapInArrow(judge, f"doc_id long, spans {_SPAN}")


def learn(texts: DataFrame, sample: int) -> Formats:
    """Formats of at most `sample` distinct credentials per base kind, and the background of all candidates."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(8 << 16, np.int64)
        runs: Counter = Counter()
        for batch in batches:
            labelled = set()
            for text in batch.column(1).to_pylist():
                text = text or b""
                base = base_spans(text, long_runs(text))
                labelled |= {(k, c) for *_, k, c in base}
                runs.update(map(re.Match.group, _RUN.finditer(candidates(text, base))))
                if len(runs) >= HELD:
                    count_pairs(runs, counts)
                    runs.clear()
            yield found(sorted(labelled), [1] * len(labelled))
        count_pairs(runs, counts)
        used = np.flatnonzero(counts).tolist()
        yield found([(3, p.to_bytes(3, "big")) for p in used], counts[used].tolist())

    def found(tokens: list[tuple[int, bytes]], times: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in tokens], pa.int32()), pa.array([t for _, t in tokens], pa.binary()), pa.array(times, pa.int64())], names=["kind", "token", "n"])

    seen = cut(texts.mapInArrow(gather, "kind int, token binary, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("token"), "token"))
    examples: dict[int, list[bytes]] = {}
    for r in seen.filter("kind < 3").withColumn("nth", nth).filter(F.col("nth") <= sample).orderBy("kind", "nth").collect():
        examples.setdefault(r.kind, []).append(bytes(r.token))
    pairs = seen.filter("kind = 3").select("token", "n").collect()  # classes only: at most 2^19 rows
    return infer(examples, Counter({tuple(bytes(r.token)): r.n for r in pairs}))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text."""
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), text("spans").alias("spans"))

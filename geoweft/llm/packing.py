"""Hierarchical multi-length packing of tokenised documents.

Each document becomes its token ids plus one end id. Full windows of the largest tier leave at once. What remains is
routed to the smallest context tier that holds it; every tier packs its own windows, the longest pieces first, and the
gap behind a piece is filled with pieces of shorter tiers, the last of which is cut to fit. A window is therefore full
(a power of two) everywhere but at the end of a task, where at most one window of the largest tier stays partly empty.

All of that happens where the rows are: no shuffle, memory bounded by one Arrow batch and the pieces pending in it.
Sequence ids hold the task's partition number, so a task that runs again on the same split gives the same ids.

Step groups gather windows of one tier up to an equal number of tokens. Each task numbers its windows of a tier; the
packed pieces are written once to the shared folder, and prefix sums over the tasks' totals (a row for each task and tier)
make the numbers global. So every group of a tier but its last has the same number of windows, whatever the tasks are.

Defined results: null and empty texts are one end id; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm._common import id_and_bytes, stored

TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 1 << 16
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, nth long, ids binary"

#: Texts of these code points only take the fast encoder; tests hold it equal to the reference tokenizer on all of them.
_PLAIN = re.compile(r"[\x00-ſ‐-‧€\n]*")
#: Longer runs without a space go to the reference tokenizer, whose merge loop doesn't slow down on them.
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoders(tokenizer_json: str):
    """(fast, exact): two encoders of one byte-level vocabulary file; the fast one knows no added tokens."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_json)
    with open(tokenizer_json, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    symbols = _byte_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items()}
    fast = tiktoken.Encoding("packing", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return fast, exact


@lru_cache(maxsize=2)
def _added(tokenizer_json: str) -> tuple[str, ...]:
    """Strings of the added tokens, which the tokenizer finds in texts."""
    with open(tokenizer_json, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens") or [])


def encode(text: str, tokenizer_json: str) -> np.ndarray:
    """The ids that the tokenizers library gives for the whole text with add_special_tokens=False."""
    fast, exact = encoders(tokenizer_json)
    if _PLAIN.fullmatch(text) and not _LONG_RUN.search(text) and not any(t in text for t in _added(tokenizer_json)):
        return np.array(fast.encode_ordinary(text), dtype="<u4")
    return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


class _Packer:
    """Packs pieces (document, start, length) into windows; rows gather in `out`."""

    def __init__(self, tiers: tuple[int, ...], task: int):
        self.tiers, self.task = sorted(tiers), task
        self.made = dict.fromkeys(self.tiers, 0)
        self.pools: dict[int, list[list[int]]] = {t: [] for t in self.tiers}
        self.sequences = 0
        self.out: list[tuple] = []

    def add(self, doc: int, tokens: int) -> None:
        largest = self.tiers[-1]
        start = 0
        while tokens - start >= largest:
            self._emit(largest, [[doc, start, largest]])
            start += largest
        if tokens > start:
            self._route([doc, start, tokens - start])

    def _route(self, piece: list[int]) -> None:
        self.pools[next(t for t in self.tiers if piece[2] <= t)].append(piece)

    def _emit(self, tier: int, pieces: list[list[int]]) -> None:
        sequence = (self.task << 32) + self.sequences
        offset = 0
        for doc, start, length in pieces:
            self.out.append((doc, start, length, sequence, offset, tier, self.made[tier]))
            offset += length
        self.sequences += 1
        self.made[tier] += 1

    def _filled(self, k: int) -> bool:
        """Packs one window of tier k; False if too little is left to fill it."""
        tier = self.tiers[k]
        if sum(p[2] for p in self.pools[tier][-1:]) + self._below(k, tier) < tier:
            return False
        window = [self.pools[tier].pop()]
        gap = tier - window[0][2]
        while gap:
            # the longest tier that fits whole, else the shortest that has a piece to cut
            fits = [t for t in self.tiers[: k + 1] if self.pools[t] and self.pools[t][-1][2] <= gap]
            pool = self.pools[fits[-1] if fits else next(t for t in self.tiers[: k + 1] if self.pools[t])]
            piece = pool.pop()
            taken = min(gap, piece[2])
            window.append([piece[0], piece[1], taken])
            if piece[2] > taken:
                self._route([piece[0], piece[1] + taken, piece[2] - taken])
            gap -= taken
        self._emit(tier, window)
        return True

    def _below(self, k: int, enough: int) -> int:
        """Tokens pending in tiers up to k beside the next piece of tier k, counted until they are enough."""
        total = 0
        for t in self.tiers[: k + 1]:
            pool = self.pools[t]
            for i in range(len(pool) - (t == self.tiers[k])):
                total += pool[i][2]
                if total >= enough:
                    return total
        return total

    def settle(self) -> None:
        """Packs every window that can be filled from what is pending, the longest tiers first."""
        for k in reversed(range(len(self.tiers))):
            while self.pools[self.tiers[k]] and self._filled(k):
                pass

    def finish(self) -> None:
        """Packs what is left into windows of the largest tier; the last of them stays partly empty."""
        self.settle()
        largest, window, room = self.tiers[-1], [], self.tiers[-1]
        for t in reversed(self.tiers):
            for doc, start, length in self.pools[t]:
                while length:
                    taken = min(room, length)
                    window.append([doc, start, taken])
                    start, length, room = start + taken, length - taken, room - taken
                    if not room:
                        self._emit(largest, window)
                        window, room = [], largest
            self.pools[t] = []
        if window:
            self._emit(largest, window)


def pack(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of packed sequences, with their ids as little-endian unsigned 32-bit numbers: see the module's text.

    Tiers are powers of two. A piece is ids [start, start + length) of its document and lies at `offset` of sequence
    `sequence_id`, a window of `tier` ids that belongs to `step_group`, of step_tokens // tier windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(tiers, TaskContext.get().partitionId())
        pending: dict[int, tuple[int, np.ndarray]] = {}
        count = 0

        def rows() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            doc, start, length, sequence, offset, tier, nth = (zip(*out, strict=True) if out else [()] * 7)
            cut = [pending[d][1][s : s + n].tobytes() for d, s, n in zip(doc, start, length, strict=True)]
            left = {p[0] for pool in packer.pools.values() for p in pool}
            columns = [pa.array([pending[d][0] for d in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([len(pending[d][1]) for d in doc], pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(tier, pa.int32()), pa.array(nth, pa.int64()), pa.array(cut, pa.binary())]
            for d in [d for d in pending if d not in left]:
                del pending[d]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode((text or b"").decode("utf-8", "replace"), tokenizer_json), np.uint32(end_id)).astype("<u4")
                    pending[count] = (i, ids)
                    packer.add(count, len(ids))
                    count += 1
                packer.settle()
                yield rows()
        packer.finish()
        yield rows()

    return step_groups(stored(id_and_bytes(docs, id_col, text_col).mapInArrow(run, PIECES)), sorted(tiers), step_tokens)


def step_groups(pieces: DataFrame, tiers: list[int], step_tokens: int) -> DataFrame:
    """pieces with step_group in place of nth, the window's number among those of its task and tier."""
    pieces = pieces.withColumn("task", F.shiftright("sequence_id", 32))
    totals = pieces.groupBy("tier", "task").agg((F.max("nth") + 1).alias("n"))
    starts = totals.select("tier", "task", (F.sum("n").over(Window.partitionBy("tier").orderBy("task")) - F.col("n")).alias("before"))
    rank = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")) - 1
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    group = F.shiftleft(rank.cast("long"), 48) + F.floor((F.col("before") + F.col("nth")) / per_step)
    placed = pieces.join(F.broadcast(starts), ["tier", "task"])  # a row for each task and tier
    return placed.select(*[group.alias("step_group") if c == "nth" else F.col(c) for c in pieces.columns if c != "task"])


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")

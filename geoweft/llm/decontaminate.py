"""Benchmark decontamination over a distributed positional inverted index.

Index: each task turns its documents into shards of about `shard_words` words. A shard stores its words and, per word,
the ascending positions of all its occurrences (positions run through the shard's documents; deltas, compressed). The
index covers every word of every document, holds whole documents, and is written to the shared folder before use.

Search: test items come to the shards in blocks of bounded size, one block at a time: its matches are written to the
shared folder before the next one is read. Each window of an item is listed under the word that fewest windows of the
block have; a shard visits the windows of the words it holds, and no others. There, the lists of a window's words are
intersected from the rarest on, each shifted by the word's offset in the window, so that what is left are exact phrase
matches. Proximity matches hold all the window's words within some more words in any order, or within the whole document
where it is shorter than that. Matches never cross documents.

Defined results: null text has no words; an item without words matches nothing; an item shorter than a window is one
window; repeated rows are searched once each; of items with one id and several texts all texts count; an item with a null
id is searched too, its words are hit, but it has no id to be listed by; empty tables give no rows or no matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm._common import cut, id_and_bytes, packed_id, unpacked_id

WINDOW = 13
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 2 << 20
#: The query's proximity matches: a window's words within so many more.
SLOP = 3
INDEX = "shard long, doc_ids binary, lengths binary, words binary, counts binary, postings binary"
SPANS = "array<struct<item:string,start:int,end:int,kind:string>>"
FOUND = f"shard long, row int, items array<string>, spans {SPANS}"
_SPAN = pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Letters A-Z in lower case; bytes outside words become spaces.
_WORDS = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Shards of the positional index, see INDEX; one shard for each `shard_words` words of a task."""

    def shard(number: int, ids: list[int], lengths: list[int], vocabulary: dict[bytes, int], codes: list[int]) -> pa.RecordBatch:
        code = np.array(codes, np.uint64)
        both = np.sort((code << np.uint64(32)) | np.arange(len(code), dtype=np.uint64))
        positions = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        counts = np.bincount(code.astype(np.int64), minlength=len(vocabulary)).astype(np.uint32)
        deltas = np.diff(positions, prepend=np.uint32(0))
        starts = np.r_[0, np.cumsum(counts, dtype=np.int64)[:-1]] if len(counts) else []
        deltas[starts] = positions[starts]
        words = b" ".join(vocabulary)
        sized = [len(words).to_bytes(8, "little") + pa.compress(words, codec="zstd", asbytes=True), len(deltas).to_bytes(8, "little") + _pack(deltas)]
        values = [number, np.array(ids, np.int64).tobytes(), np.array(lengths, np.int64).tobytes(), sized[0], _pack(counts), sized[1]]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(values)], names=[c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, lengths, vocabulary, codes = [], [], {}, []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                ids.append(i)
                lengths.append(len(words))
                codes += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                if len(codes) >= shard_words or len(ids) >= shard_words:
                    yield shard(number, ids, lengths, vocabulary, codes)
                    number, ids, lengths, vocabulary, codes = number + 1, [], [], {}, []
        if ids:
            yield shard(number, ids, lengths, vocabulary, codes)

    return id_and_bytes(docs, id_col, text_col).withColumn("doc_id", packed_id("doc_id")).mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Tests:
    """A block of test items: their words as codes of one vocabulary."""

    vocabulary: dict[bytes, int]
    items: list[tuple[str, list[int]]]

    def windows(self, size: int) -> dict[int, list[tuple[tuple[int, ...], list[str | None]]]]:
        """Each distinct window with the items that hold it, listed under its word that fewest windows hold."""
        out: dict[tuple[int, ...], dict[str | None, None]] = {}
        for item, codes in self.items:
            for k in range(max(1, len(codes) - size + 1) if codes else 0):
                out.setdefault(tuple(codes[k : k + size]), {})[item] = None
        held = Counter(c for window in out for c in set(window))
        listed: dict[int, list[tuple[tuple[int, ...], list[str | None]]]] = {}
        for window, items in out.items():
            listed.setdefault(min(window, key=lambda c: (held[c], c)), []).append((window, list(items)))
        return listed


def test_blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Tests]:
    """The items in blocks of about block_bytes of text each, one block on the driver at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        vocabulary: dict[bytes, int] = {}
        items = [(r.item, [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(bytes(r.text))]) for r in part.collect()]
        yield Tests(vocabulary, items)


class Shard:
    """One row of the index, read back: lists() of the test words that occur in it."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int]):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        size = int.from_bytes(row["words"][:8], "little")
        words = pa.decompress(row["words"][8:], size, codec="zstd", asbytes=True).split(b" ") if size else []
        counts = np.frombuffer(pa.decompress(row["counts"], 4 * len(words), codec="zstd"), np.uint32)
        deltas = np.frombuffer(pa.decompress(row["postings"][8:], 4 * int.from_bytes(row["postings"][:8], "little"), codec="zstd"), np.uint32)
        ends = np.cumsum(counts, dtype=np.int64)
        self.lists = {vocabulary[w]: np.cumsum(deltas[ends[k] - counts[k] : ends[k]], dtype=np.int64) for k, w in enumerate(words) if w in vocabulary}

    def within_document(self, start: np.ndarray, length: int) -> np.ndarray:
        return start + length <= self.ends[np.searchsorted(self.ends, start, "right")]

    def phrase(self, window: tuple[int, ...]) -> np.ndarray:
        """Positions at which the window's words follow each other: lists intersected from the rarest on."""
        lists = self.lists
        order = sorted(range(len(window)), key=lambda k: len(lists[window[k]]))
        at = lists[window[order[0]]] - order[0]
        at = at[at >= 0]
        for k in order[1:]:
            if not len(at):
                return at
            other = lists[window[k]]
            near = np.searchsorted(other, at + k)
            near[near == len(other)] = 0
            at = at[other[near] == at + k]
        return at[self.within_document(at, len(window))] if len(at) else at

    def proximity(self, window: tuple[int, ...], reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of stretches that hold all the window's words: `reach` words, or the whole of a document that
        has fewer. They are sought around the rarest word."""
        terms = sorted(set(window), key=lambda t: len(self.lists[t]))
        least, far = self.lists[terms[0]], np.iinfo(np.int64).max
        near = [np.append(self.lists[t], far) for t in terms[1:]]
        for other in near:  # each word has an occurrence within reach of the rarest one's
            least = least[other[np.searchsorted(other, least - reach + 1)] < least + reach]
        doc = np.searchsorted(self.ends, least, "right")
        low, high = (self.ends - self.lengths)[doc], self.ends[doc]
        first, last = np.maximum(low, least - reach + 1), np.maximum(low, np.minimum(least, high - reach))
        count = last - first + 1
        start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        end = np.minimum(start + reach, np.repeat(high, count))
        start, kept = np.unique(start, return_index=True)
        end = end[kept]
        for other in near:
            kept = other[np.searchsorted(other, start)] < end
            start, end = start[kept], end[kept]
        return start, end


def search(index: DataFrame, tests: Tests, *, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Per document of the index with matches (shard, row, doc_id): the items it holds phrases of, and the spans matched
    (word positions, end exclusive; kind phrase, and proximity if slop gives the further words that a stretch may hold)."""
    shared = index.sparkSession.sparkContext.broadcast((tests.vocabulary, tests.windows(window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, listed = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, vocabulary)
                spans: dict[int, list[dict]] = {}
                have = shard.lists.keys()
                for codes, items in (w for term in have for w in listed.get(term, ())):
                    if not have >= set(codes):
                        continue
                    at = shard.phrase(codes)
                    matches = [("phrase", at, at + len(codes))]
                    if slop is not None:
                        matches.append(("proximity", *shard.proximity(codes, len(codes) + slop)))
                    for kind, starts, ends in matches:
                        docs = np.searchsorted(shard.ends, starts, "right")
                        firsts = shard.ends[docs] - shard.lengths[docs]
                        for doc, a, b in zip(docs.tolist(), (starts - firsts).tolist(), (ends - firsts).tolist(), strict=True):
                            spans.setdefault(doc, []).extend({"item": i, "start": a, "end": b, "kind": kind} for i in items)
                held = sorted(spans)
                items = [sorted({s["item"] for s in spans[k] if s["kind"] == "phrase" and s["item"] is not None}) for k in held]
                columns = [pa.array([row["shard"]] * len(held), pa.int64()), pa.array(held, pa.int32()), pa.array(items, pa.list_(pa.string())), pa.array([spans[k] for k in held], pa.list_(_SPAN))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "row", "items", "spans"])

    return index.mapInArrow(run, FOUND)


def indexed_documents(index: DataFrame) -> DataFrame:
    """Per document of the index: shard, row, doc_id, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, lengths in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids, lengths = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids), pa.array(lengths)], names=["shard", "row", "doc_id", "n_words"])

    return index.select("shard", "doc_ids", "lengths").mapInArrow(run, "shard long, row int, doc_id long, n_words long")


def _covered(spans: Column) -> Column:
    """Words inside any phrase span: spans by start, each counted from where the ones before it end."""
    phrases = F.array_sort(F.transform(F.filter(spans, lambda s: s["kind"] == "phrase"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"])).cast("long")).alias("n"))
    return F.aggregate(phrases, zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = None, share: int = 20, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans, contaminated (a word in `share` or more is hit)."""
    index = cut(build_index(docs, id_col=id_col, text_col=text_col, shard_words=shard_words))
    found = None
    for tests in test_blocks(benchmark, id_col=item_id_col, text_col=item_text_col, block_bytes=block_bytes):
        own = cut(search(index, tests, window=window, slop=slop))
        found = own if found is None else found.unionByName(own)
    found = found.groupBy("shard", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    rows = indexed_documents(index).join(found, ["shard", "row"], "left")
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    hit = rows.withColumn("n_hit", _covered(F.col("spans")))
    return hit.select(unpacked_id("doc_id"), "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def item_digests(found: DataFrame) -> DataFrame:
    """The contract's columns, and n_near: items of which some window's words lie near each other, in any order."""
    near = F.array_distinct(F.transform(F.filter("spans", lambda s: (s["kind"] == "proximity") & s["item"].isNotNull()), lambda s: s["item"]))
    n_items = lambda items: F.size(items).cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items("items").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated", n_items(near).alias("n_near"))

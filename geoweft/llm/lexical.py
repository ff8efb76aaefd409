"""Ranked lexical search over an impact-ordered index, score at a time.

Index: each task turns its documents into shards. A shard has one row for each of its terms: the documents that hold it,
grouped by the exact impact of the term in them, the highest group first. Impacts are integers, so that equal ones make a
group. The index covers every term of every document; it is written as Parquet to the shared folder.

Search: a term's weight follows from the documents that hold it in all shards. Items come to the shards in blocks, with the
rows of their terms only. A shard adds an item's groups up from the highest impact on, whatever term they are of. Each
term's next impact bounds what it can still add. Once these bounds prove that none but a few documents can be among the
best, the rest of the lists is read for those only, which makes their scores exact. The best of all shards are merged.

Scores (integers, `div` rounds down): with N documents that have terms, L terms in all and n in the document, m is
MILLI_MIN + (SLOPE * n * N) div L; an item's term of weight w adds w * ((SCALE * tf) div (1000 * tf + K8 * m)).

Bounded memory: a shard has SHARD_DOCS documents or about SHARD_TERMS terms, a block of items about BLOCK_TERMS terms.

Defined results: null or empty texts have no terms and are never found; an item without terms has no rows; items of equal
id and text are one item, of equal id and other text each searched for itself; repeated rows are documents of their own;
null ids come last among equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.llm._common import cut, ensure_checkpoint_dir, id_and_bytes, matched, packed_id, remove, unpacked_id

SCALE, K8, MILLI_MIN, SLOPE = 1_000_000_000, 8, 10, 90
SHARD_DOCS, SHARD_TERMS = 1 << 15, 1 << 22
BLOCK_TERMS = 1 << 16
#: So many terms of items (some twenty bytes each) may be broadcast to the index.
BROADCAST_TERMS = 1 << 18
#: Reading stops when at most so many documents for each wanted one can be among the best.
STILL_OPEN = 4
FIRST_POSTINGS = 1 << 12
INDEX = "shard long, term binary, docs int, impacts binary, sizes binary, postings binary"
FOUND = "item long, doc_id long, score long"
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Letters A-Z in lower case; bytes outside terms become spaces.
_TERMS = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
PIECE_BYTES = 1 << 20


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each PIECE_BYTES, so that a long text never becomes one long list."""
    clean, at = (text or b"").translate(_TERMS), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE_BYTES)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


@dataclass(frozen=True)
class Index:
    """rows: INDEX, a shard's row of the empty term has its documents' ids as postings; docs and terms are N and L."""

    rows: DataFrame
    docs: int
    terms: int
    folder: str


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [sum(map(len, pieces(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["docs", "terms"])


def _slices(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """values cut at starts, each part as bytes; starts has the end as its last element."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _shard(number: int, ids: list[int], sizes: list[int], vocabulary: dict[bytes, int], codes: list[np.ndarray], docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard. codes: a document's terms as numbers of the vocabulary."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    head = [[number], [b""], [len(ids)], [b""], [b""], [np.array(ids, np.int64).tobytes()]]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(head, (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)
    if not vocabulary:
        return
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
    both, tf = np.unique((np.concatenate(codes) << 16) | doc, return_counts=True)
    code, doc = both >> 16, both & 0xFFFF
    m = np.array([MILLI_MIN + SLOPE * n * docs // terms for n in sizes], np.int64)
    impact = (SCALE * tf) // (1000 * tf + K8 * m[doc])
    order = np.lexsort((doc, -impact, code))
    code, doc, impact = code[order], doc[order], impact[order]
    fresh = np.r_[True, code[1:] != code[:-1]]
    starts = np.r_[np.flatnonzero(fresh), len(code)]
    groups = np.flatnonzero(fresh | np.r_[True, impact[1:] != impact[:-1]])
    of = np.searchsorted(groups, starts)
    lengths = np.diff(np.r_[groups, len(code)])
    columns = [
        pa.array(np.full(len(vocabulary), number, np.int64)),
        pa.array(list(vocabulary), pa.binary()),
        pa.array(np.diff(starts).astype(np.int32)),
        _slices(impact[groups].astype(np.int32), of),
        _slices(lengths.astype(np.uint16), of),
        _slices(doc.astype(np.uint16), starts),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> Index:
    """The index of all documents, see the module's text; remove(spark, index.folder) deletes it."""
    if not 0 < shard_docs < 1 << 16:
        raise ValueError("a shard numbers its documents by 16 bits")
    rows = id_and_bytes(docs, id_col, text_col).withColumn("doc_id", packed_id("doc_id"))
    n_docs, n_terms = (x or 0 for x in rows.mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def empty() -> tuple[list, list, dict, list]:
            return [], [], defaultdict(count().__next__), []

        number, held = TaskContext.get().partitionId() << 32, 0
        ids, sizes, vocabulary, codes = empty()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)) for words in pieces(text)]
                ids.append(i)
                sizes.append(sum(map(len, own)))
                codes += own
                held += sizes[-1]
                if held >= shard_terms or len(ids) >= shard_docs:
                    yield from _shard(number, ids, sizes, vocabulary, codes, n_docs, n_terms)
                    number, held = number + 1, 0
                    ids, sizes, vocabulary, codes = empty()
        if ids:
            yield from _shard(number, ids, sizes, vocabulary, codes, n_docs, n_terms)

    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/lexical-{uuid.uuid4().hex}"
    rows.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(folder)
    return Index(spark.read.parquet(folder), n_docs, n_terms, folder)


def _terms_of(items: DataFrame) -> DataFrame:
    """(item, term): the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set().union(*pieces(text))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary())], names=["item", "term"])

    return items.select("item", F.col("text").cast("binary")).mapInArrow(run, "item long, term binary")


def best(lists: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best documents of a shard; lists: each term's weight, impacts, group sizes and postings."""
    gain = np.concatenate([w * impacts.astype(np.int64) for w, impacts, _, _ in lists])
    size = np.concatenate([s for _, _, s, _ in lists]).astype(np.int64)
    term = np.repeat(np.arange(len(lists)), [len(x[1]) for x in lists])
    postings = np.concatenate([x[3] for x in lists])
    start = np.cumsum(size) - size
    order = np.argsort(-gain, kind="stable")
    upto = np.cumsum(size[order])
    first_group = np.r_[0, np.cumsum([len(x[1]) for x in lists])]
    read = np.zeros(len(lists), np.int64)  # groups read of each term
    score = np.zeros(len(ids), np.int64)
    at, want, open_docs = 0, FIRST_POSTINGS, None
    while at < len(order):
        end = min(len(order), int(np.searchsorted(upto, want)) + 1)
        groups = order[at:end]
        n = size[groups]
        where = np.arange(n.sum()) + np.repeat(start[groups] - (np.cumsum(n) - n), n)
        np.add.at(score, postings[where], np.repeat(gain[groups], n))
        read += np.bincount(term[groups], minlength=len(lists))
        at, want = end, max(2 * want, int(upto[end - 1]) + FIRST_POSTINGS)
        if at < len(order) and len(ids) > k:
            unread = first_group[:-1] + read
            bound = int(gain[unread[unread < first_group[1:]]].sum())  # each term's next impact
            least = np.partition(score, len(score) - k)[len(score) - k]
            if bound < least:  # unseen documents are out
                open_docs = np.flatnonzero(score + bound >= least)
                if len(open_docs) <= STILL_OPEN * k:
                    break
                open_docs = None
    if open_docs is not None:
        wanted = np.zeros(len(ids), np.bool_)
        wanted[open_docs] = True
        for t in range(len(lists)):
            g = first_group[t] + read[t]
            if g < first_group[t + 1]:
                last = first_group[t + 1] - 1
                tail = postings[start[g] : start[last] + size[last]]
                hit = np.flatnonzero(wanted[tail])
                np.add.at(score, tail[hit], gain[g + np.searchsorted(start[g : last + 1] - start[g], hit, "right") - 1])
    else:
        open_docs = np.flatnonzero(score)
    open_docs = open_docs[score[open_docs] > 0]
    order = np.lexsort((ids[open_docs], -score[open_docs]))[:k]
    return [(int(ids[d]), int(score[d])) for d in open_docs[order]]


def search(index: Index, benchmark: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    items = cut(items.distinct().withColumn("item", F.monotonically_increasing_id()))
    asked = cut(_terms_of(items))
    distinct = asked.select("term").distinct()
    n_asked = distinct.count()
    counts = index.rows.select("term", "docs").join(F.broadcast(distinct) if n_asked <= BROADCAST_TERMS else distinct, "term", "left_semi")
    counts = counts.groupBy("term").agg(F.sum("docs").alias("df"), F.count(F.lit(1)).alias("shards"))
    weights = counts.withColumn("w", F.floor(1000 * F.log((F.lit(2.0) * index.docs + 2) / (2 * F.col("df") + 1)))).filter("w > 0")
    blocks = -(-max(1, asked.count()) // BLOCK_TERMS)
    asked = cut(asked.join(weights, "term").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")))
    needed = asked.groupBy("term").agg(F.first("shards").alias("shards"), F.collect_set("block").alias("in_blocks"))
    if n_asked <= BROADCAST_TERMS:
        lists = index.rows.join(F.broadcast(needed.drop("shards")), "term")
    else:
        lists = matched(index.rows, needed, "term", "shards", index.rows.count(), "shard").filter("in_blocks IS NOT NULL")
    lists = lists.select("shard", F.explode("in_blocks").alias("block"), "term", "impacts", "sizes", "postings")
    questions = asked.groupBy("block").agg(F.collect_list(F.struct("item", "term", "w")).alias("asked"))
    shards = index.rows.filter(F.col("term") == F.lit(b"")).select("shard", F.col("postings").alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    shards = shards.join(questions, "block").select(F.col("shard").alias("of_shard"), F.col("block").alias("of_block"), "ids", F.expr("asked.item AS items"), F.expr("asked.term AS terms"), F.expr("asked.w AS weights"))

    def run(held: pa.Table, beside: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if held.num_rows and beside.num_rows:
            columns = (held.column(c).to_pylist() for c in ("term", "impacts", "sizes", "postings"))
            rows = {t: (np.frombuffer(i, np.int32), np.frombuffer(s, np.uint16), np.frombuffer(p, np.uint16)) for t, i, s, p in zip(*columns, strict=True)}
            ids = np.frombuffer(beside.column("ids")[0].as_py(), np.int64)
            of_item: dict[int, list] = {}
            for item, t, w in zip(*(beside.column(c)[0].as_py() for c in ("items", "terms", "weights")), strict=True):
                if t in rows:
                    of_item.setdefault(item, []).append((w, *rows[t]))
            out = [(item, *found) for item, own in of_item.items() for found in best(own, ids, k)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item", "doc_id", "score"), columns, strict=True)})

    found = lists.groupBy("shard", "block").cogroup(shards.groupBy("of_shard", "of_block")).applyInArrow(run, FOUND)
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", unpacked_id("doc_id"), "score")


def ranked(docs: DataFrame, benchmark: DataFrame, *, k: int = 10) -> DataFrame:
    """Index and search in one: the k best of docs for each item. The index is removed, the few rows found are kept."""
    index = build_index(docs)
    found = cut(search(index, benchmark, k=k))
    remove(docs.sparkSession, index.folder)
    return found

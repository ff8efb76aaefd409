"""Exact dedup by a log-structured merge index of digests.

1. Each document is normalised (every run of ASCII white space becomes one space) and digested where it lies.
2. Memtables gather digest -> (smallest id, rows) and flush as sorted runs, each cut into at most FANOUT digest ranges,
   with a Bloom filter of its digests sized by the run. A hot text is one entry of each memtable, however many rows hold it.
3. Compaction goes by levels. On each, runs of a range meet in groups of about `bucket_rows` entries, are merged, the two
   smallest first, and cut into FANOUT ranges again, down to the buckets. A filter tells which digests of one run can be in
   the other, only those are searched, and of equal digests the smallest id stays.
4. Hits (rows that are to go) are compared byte by byte with the row that stays. A hot group is dealt over salts, each
   with its own copy of the kept text. Rows whose bytes differ, a digest collision, are grouped by their bytes.

Bounded memory: a memtable has `memtable_rows` entries, a bucket about `bucket_rows`. The index's bytes are in proportion
to its digests, whatever the number of memtables and buckets. Hot groups, few by a bound that follows from the number of
rows, are broadcast to the rows; all others meet them by shuffle.

Defined results: null counts as empty; white space alone is one space, not empty; of repeated rows (same id, same
text) the first stays and each has its row in the result; null ids are equal, and behind all others; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm._common import blob_partitions, cut, id_and_bytes, matched, named, numbered, packed_id, unpacked_id

SPACE = frozenset(b" \t\n\v\f\r")
RUNS = "bucket long, run long, rows long, digests binary, ids binary, sizes binary, filter binary"
FILTER_HASHES = 4
FILTER_BITS_PER_ROW = 10
FANOUT = 64
SALT_ROWS, SALT_PARTS = 256, 4096
#: So many hits (about a hundred bytes each) may be broadcast to the texts.
BROADCAST_HITS = 1 << 17


def normalised(text: bytes) -> bytes:
    """text with each run of ASCII white space replaced by one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in SPACE else b"") + b" ".join(words) + (b" " if text[-1] in SPACE else b"")


def _slots(digests: np.ndarray, bits: int) -> np.ndarray:
    """The filter bits of each digest: words of the digest itself, folded, serve as hashes."""
    width = digests.dtype.itemsize
    raw = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), width)
    raw = np.pad(raw, ((0, 0), (0, -width % 8)))
    word = raw.view("<u8")
    base = word[:, 0] ^ (word[:, -1] * np.uint64(0x9E3779B97F4A7C15))
    step = (word[:, word.shape[1] // 2] * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    return np.stack([(base + np.uint64(i) * step) >> np.uint64(7) for i in range(FILTER_HASHES)], 1) % np.uint64(bits)


def make_filter(digests: np.ndarray, bits: int = 0) -> np.ndarray:
    """A filter of `bits` bits; by default a power of two, at least FILTER_BITS_PER_ROW for each digest."""
    table = np.zeros(bits or max(64, 1 << (len(digests) * FILTER_BITS_PER_ROW - 1).bit_length()), np.bool_)
    table[_slots(digests, len(table)).ravel().astype(np.int64)] = True
    return np.packbits(table)


def may_hold(packed: np.ndarray, digests: np.ndarray) -> np.ndarray:
    at = _slots(digests, len(packed) * 8).astype(np.int64)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def merge(one: tuple, two: tuple) -> tuple:
    """Two sorted runs (digests, ids, sizes, filter) as one; the larger is searched for the smaller's possible hits."""
    big, small = (one, two) if len(one[0]) >= len(two[0]) else (two, one)
    digests, ids, sizes, bits = big[0], big[1].copy(), big[2].copy(), big[3]
    possible = np.flatnonzero(may_hold(bits, small[0]))
    at = np.minimum(np.searchsorted(digests, small[0][possible]), len(digests) - 1)
    same = digests[at] == small[0][possible]
    hit, at = possible[same], at[same]
    ids[at] = np.minimum(ids[at], small[1][hit])
    sizes[at] += small[2][hit]
    fresh = np.ones(len(small[0]), np.bool_)
    fresh[hit] = False
    where = np.searchsorted(digests, small[0][fresh])
    digests, ids, sizes = (np.insert(a, where, b[fresh]) for a, b in ((digests, small[0]), (ids, small[1]), (sizes, small[2])))
    if 8 * len(bits) < FILTER_BITS_PER_ROW * len(digests):
        return digests, ids, sizes, make_filter(digests)
    return digests, ids, sizes, bits | make_filter(small[0], 8 * len(bits))


def cut_run(digests: np.ndarray, ids: np.ndarray, sizes: np.ndarray, width: int, run: int) -> pa.Table:
    """A sorted run in parts, one for each of `width` equal ranges of digests that it has any of: rows as in RUNS."""
    size = digests.dtype.itemsize
    lead = np.frombuffer(digests.tobytes(), np.uint8).reshape(len(digests), size)[:, : min(4, size)]
    number = np.zeros(len(digests), np.int64)
    for column in lead.T:
        number = number * 256 + column
    bucket = number * width >> (8 * lead.shape[1])
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(digests) else np.zeros(0, np.int64)
    parts = [slice(a, b) for a, b in zip(at, [*at[1:], len(digests)], strict=True)] if len(at) else []
    columns = [bucket[at], [run] * len(parts), [p.stop - p.start for p in parts], *([a[p].tobytes() for p in parts] for a in (digests, ids, sizes)), [make_filter(digests[p]).tobytes() for p in parts]]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RUNS.split(", ")])


def digest_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """doc_id, digest (the index key: the first digest_bytes of the SHA-256), text_sha256 (hex)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(normalised(t or b"")).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "sha"])

    rows = id_and_bytes(docs, id_col, text_col).withColumn("doc_id", packed_id("doc_id")).mapInArrow(run, "doc_id long, sha binary")
    return rows.select("doc_id", F.substring("sha", 1, digest_bytes).alias("digest"), "sha")


def build_runs(digests: DataFrame, width: int, *, memtable_rows: int, digest_bytes: int) -> DataFrame:
    """Sorted runs of (digest, smallest id, rows), cut into `width` ranges, each part with its filter."""

    def flush(table: dict[bytes, list[int]], run: int) -> list[pa.RecordBatch]:
        keys = np.array(sorted(table), f"S{digest_bytes}")
        values = np.array([table[k.ljust(digest_bytes, b"\0")] for k in keys.tolist()], np.int64).reshape(-1, 2)
        return cut_run(keys, values[:, 0], values[:, 1], width, run).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        table: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                entry = table.get(key)
                if entry is None:
                    if len(table) >= memtable_rows:
                        yield from flush(table, number)
                        table, number = {}, number + 1
                    table[key] = [i, 1]
                else:
                    entry[0] = min(entry[0], i)
                    entry[1] += 1
        if table:
            yield from flush(table, number)

    return digests.select("doc_id", "digest").mapInArrow(run, RUNS)


def merged(table: pa.Table, digest_bytes: int) -> tuple:
    """The runs of a table as one, the smallest merged first."""
    kinds = {"digests": f"S{digest_bytes}", "ids": np.int64, "sizes": np.int64, "filter": np.uint8}
    level = [(r["rows"], k, tuple(np.frombuffer(r[c], t) for c, t in kinds.items())) for k, r in enumerate(table.to_pylist())]
    heapq.heapify(level)
    fresh = len(level)
    while len(level) > 1:
        both = merge(heapq.heappop(level)[2], heapq.heappop(level)[2])
        heapq.heappush(level, (len(both[0]), fresh, both))
        fresh += 1
    return level[0][2]


def compact(runs: DataFrame, buckets: int, *, digest_bytes: int) -> DataFrame:
    """digest, keep_id, group_size: runs cut into min(buckets, FANOUT) ranges, merged level by level down to the buckets."""
    def level(wider: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            digests, ids, sizes, _ = merged(table, digest_bytes)
            return cut_run(digests, ids, sizes, wider, key[1].as_py())  # a range's groups are the next level's runs

        return run

    width = min(buckets, FANOUT)
    while width < buckets:
        group = F.pmod(F.xxhash64("run"), F.lit(-(-buckets // width))).alias("group")
        width = min(buckets, width * FANOUT)
        runs = runs.groupBy("bucket", group).applyInArrow(level(width), RUNS)

    def last(table: pa.Table) -> pa.Table:
        digests, ids, sizes, _ = merged(table, digest_bytes)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(digest_bytes), len(digests), [None, pa.py_buffer(digests.tobytes())])
        return pa.table({"digest": raw.cast(pa.binary()), "keep_id": ids, "group_size": sizes})

    return runs.groupBy("bucket").applyInArrow(last, "digest binary, keep_id long, group_size long")


def _verified(docs: DataFrame, hits: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of hits (doc_id, digest, sha, keep_id, salts): those whose bytes differ from the kept row's, with their text's
    SHA-256. A kept text is copied once for each salt, SALT_ROWS rows of its group or the SALT_PARTS-th part of all rows."""
    keepers = hits.select("digest", "keep_id", "salts").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    wanted = hits.select("doc_id", "digest", "sha", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"), F.lit(False).alias("stays")).unionByName(
        keepers.select(F.col("keep_id").alias("doc_id"), "digest", F.lit(None).cast("binary").alias("sha"), "salt", F.lit(True).alias("stays"))
    )
    texts = docs.select(packed_id(id_col).alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ").alias("norm"))
    few = hits.count() <= BROADCAST_HITS  # kept rows are fewer
    found = (F.broadcast(wanted) if few else wanted).join(texts, "doc_id").withColumn("got", F.unhex(F.sha2("norm", 256)))
    found = found.filter(F.expr("substring(got, 1, length(digest)) = digest AND (sha IS NULL OR got = sha)"))
    rows = found.filter(~F.col("stays")).select("doc_id", "digest", "sha", "salt", "norm")
    kept = found.filter("stays").select("digest", "salt", F.col("norm").alias("kept_norm"))
    return rows.join(kept, ["digest", "salt"]).groupBy("doc_id", "digest", "sha").agg(F.max(F.col("norm") == F.col("kept_norm")).alias("same")).filter(~F.col("same"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 100_000, bucket_rows: int = 200_000, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text. See the module's text."""
    if (own := numbered(docs, id_col, text_col)) is not None:
        return named(exact_dedup(own, id_col="row", memtable_rows=memtable_rows, bucket_rows=bucket_rows, digest_bytes=digest_bytes), own, "keep_id")
    digests = cut(digest_rows(docs, id_col=id_col, text_col=text_col, digest_bytes=digest_bytes).groupBy("doc_id", "digest", "sha").agg(F.count(F.lit(1)).alias("copies")))
    entries, rows = digests.agg(F.count(F.lit(1)), F.sum("copies")).first()
    buckets = min(blob_partitions(entries, bucket_rows), 256 ** min(4, digest_bytes))
    ones = digests.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    runs = build_runs(ones, min(buckets, FANOUT), memtable_rows=memtable_rows, digest_bytes=digest_bytes)
    index = cut(compact(runs, buckets, digest_bytes=digest_bytes))
    placed = matched(ones, index.filter("group_size > 1"), "digest", "group_size", rows or 0, "doc_id")
    placed = placed.select("doc_id", "digest", "sha", "copy", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    placed = cut(placed)
    hits = placed.filter("group_size > 1 AND doc_id <> keep_id AND copy = 1").withColumn("salts", F.ceil(F.col("group_size") / max(SALT_ROWS, (rows or 0) // SALT_PARTS)).cast("int"))
    other = cut(_verified(docs, hits, id_col, text_col)).select("doc_id", "digest", "sha", F.lit(True).alias("differs"))
    if not other.isEmpty():
        placed = _regrouped(placed, digests, other)
    return placed.select(unpacked_id("doc_id"), unpacked_id("keep_id"), "group_size", ((F.col("doc_id") == F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _regrouped(placed: DataFrame, digests: DataFrame, other: DataFrame) -> DataFrame:
    """placed after a digest collision: rows with one of the digests concerned are grouped by their whole SHA-256."""
    touched = other.select("digest").distinct()
    again = digests.join(touched, "digest", "left_semi").groupBy("digest", "sha").agg(F.min("doc_id").alias("own_keep"), F.sum("copies").alias("own_size"))
    rows = placed.join(again, ["digest", "sha"], "left")
    return rows.select("doc_id", "digest", "sha", "copy", F.coalesce("own_keep", "keep_id").alias("keep_id"), F.coalesce("own_size", "group_size").alias("group_size"))

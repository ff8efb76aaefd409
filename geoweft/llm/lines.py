"""Reversible line dedup: sharded cuckoo filters backed by exact tables of reference counts.

State, as Parquet in one folder, a new version for every change:

* refs: (shard, key, refs), how many documents more (or fewer) hold a line's key since the version before. Their sum over
  the versions is the exact count; compact() makes one table of them.
* filters: a cuckoo filter a shard, of the keys that are common, that is, held by `min_docs` documents. An insertion puts
  the keys in that become common, a deletion takes out those that cease to be; a filter that would be too full is made anew
  from the shard's counts. Fingerprints without a place wait in the filter's stash, so that none is ever lost.
* docs and gone: each inserted document's distinct keys, and the ids deleted since, so that deletion needs ids only.

apply() splits texts, asks the filter for each key, has the exact counts take back its false hits, and drops the rest.
After insertions and deletions in any order the results are those of an index of the documents that are left.

Small filters (BROADCAST_FILTERS bytes, checked) go to the texts. Larger ones meet the keys by shard, a crowded shard dealt
over salts; confirmed keys then meet the texts by the digest of the text. A hot line is one row of each task before it is
counted. A key is the first 16 bytes of the SHA-256 of the line.

Defined results: null or empty texts are one empty line; keys of fewer than `min_chars` code points are never dropped;
each row is a document, repeated rows count once each; a deletion takes all documents of an id, null as well, and ids
that aren't there change nothing; a document may be inserted again; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm._common import BROADCAST_IDS, blob_partitions, cut, ensure_checkpoint_dir, id_and_bytes, matched

WHITE = b" \t\n\v\f\r"
MIN_DOCS, MIN_CHARS = 10, 1
KEY_BYTES = 16
SHARD_KEYS = 1 << 17
BROADCAST_FILTERS = 32 << 20
#: Keys that meet a filter in one task.
GROUP_ROWS = 1 << 18
SLOTS, FULL, TURNS = 4, 0.9, 200
FILTERS = "shard long, slots binary, stash binary, held long"
APPLIED = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, text string"


# --- cuckoo filter: numpy arrays of SLOTS 16-bit fingerprints a bucket, 0 is free ---


def _fields(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, hash) of each key."""
    raw = np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, KEY_BYTES)
    return np.maximum(raw[:, 4:6].copy().view("<u2").ravel(), 1), raw[:, 8:16].copy().view("<u8").ravel().astype(np.int64)


def _other(bucket: np.ndarray, fingerprint: np.ndarray, mask: np.ndarray | int) -> np.ndarray:
    return bucket ^ ((fingerprint.astype(np.int64) * 0x5BD1E995) & mask)


def _rank(values: np.ndarray) -> np.ndarray:
    """How many equal values lie before each."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(values) else np.zeros(0, np.int64)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.r_[first, len(values)]))
    return out


class Cuckoo:
    """A shard's filter. stash: bucket << 16 | fingerprint of what found no place."""

    def __init__(self, slots: np.ndarray, stash: np.ndarray, held: int):
        self.slots, self.stash, self.held = slots, stash, held

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        """Empty, with room for twice as many keys."""
        buckets = 1 << max(2, int(np.ceil(np.log2(2 * max(1, keys) / SLOTS))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.zeros(0, np.int64), 0)

    @classmethod
    def read(cls, slots: bytes, stash: bytes, held: int) -> Cuckoo:
        return cls(np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(stash, np.int64).copy(), held)

    def row(self, shard: int) -> tuple:
        return shard, self.slots.tobytes(), self.stash.tobytes(), self.held

    @property
    def capacity(self) -> int:
        return int(FULL * self.slots.size)

    def put(self, keys: np.ndarray) -> None:
        """Adds keys, all new, side by side: free slots first, then by moving fingerprints on."""
        mask = len(self.slots) - 1
        fingerprint, at = _fields(keys)
        at = at & mask
        self.held += len(keys)
        for turn in range(TURNS):
            if not len(at):
                break
            rank, free = _rank(at), self.slots[at] == 0
            placed = rank < free.sum(1)
            column = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.slots[at[placed], column[placed]] = fingerprint[placed]
            fingerprint, at = fingerprint[~placed], at[~placed]
            if turn % 2:  # one of each bucket takes the place of a fingerprint, which moves on
                first, column = _rank(at) == 0, (turn // 2) % SLOTS
                moved = self.slots[at[first], column]
                self.slots[at[first], column] = fingerprint[first]
                fingerprint[first] = moved
            at = _other(at, fingerprint, mask)
        self.stash = np.concatenate([self.stash, (at << 16) | fingerprint.astype(np.int64)])

    def take(self, keys: np.ndarray) -> None:
        """Removes keys, all of which must have been put in."""
        mask = len(self.slots) - 1
        fingerprint, one = _fields(keys)
        one = one & mask
        self.held -= len(keys)
        while len(one):
            two = _other(one, fingerprint, mask)
            in_one, in_two = (self.slots[b] == fingerprint[:, None] for b in (one, two))
            bucket, where = np.where(in_one.any(1), one, two), np.where(in_one.any(1)[:, None], in_one, in_two)
            found = where.any(1)
            place = np.where(found, bucket * SLOTS + where.argmax(1), -1)
            now = found & (_rank(place) == 0)
            self.slots.ravel()[place[now]] = 0
            for b, o, f in zip(one[~found], two[~found], fingerprint[~found], strict=True):
                at = np.flatnonzero((self.stash == (b << 16 | int(f))) | (self.stash == (o << 16 | int(f))))
                self.stash = np.delete(self.stash, at[:1])
            later = found & ~now
            one, fingerprint = one[later], fingerprint[later]


class Filters:
    """The filters of all shards, or of one, asked for many keys at once."""

    def __init__(self, rows: list[tuple], shards: int):
        self.shards = shards
        held = {r[0]: Cuckoo.read(*r[1:]) for r in rows}
        empty = np.zeros((1, SLOTS), np.uint16)
        tables = [held[s].slots if s in held else empty for s in range(shards)]
        sizes = np.array([len(t) for t in tables], np.int64)
        self.base, self.mask, self.slots = np.cumsum(sizes) - sizes, sizes - 1, np.concatenate(tables)
        self.stash = np.concatenate([np.zeros(0, np.int64), *[c.stash + (self.base[s] << 16) for s, c in held.items()]])

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        shard = shard_numbers(keys, self.shards)
        fingerprint, at = _fields(keys)
        mask, base = self.mask[shard], self.base[shard]
        at = at & mask
        out = np.zeros(len(keys), np.bool_)
        for bucket in (base + at, base + _other(at, fingerprint, mask)):
            out |= (self.slots[bucket] == fingerprint[:, None]).any(1)
            if len(self.stash):
                out |= np.isin((bucket << 16) | fingerprint, self.stash)
        return out


def shard_numbers(keys: np.ndarray, shards: int) -> np.ndarray:
    raw = np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, KEY_BYTES)
    return raw[:, :4].copy().view(">u4").ravel().astype(np.int64) % shards


def _shard_of(key: str, shards: int) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long") % shards


def _array(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), f"V{KEY_BYTES}")


# --- lines and their keys ---


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, None if it is too short to be dropped."""
    bare = line.strip(WHITE).lower()
    if len(bare) < min_chars or (min_chars > 1 and len(bare.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.sha256(bare).digest()[:KEY_BYTES]


def _keyed(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, keys): the distinct keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [list({k: None for line in (t or b"").split(b"\n") if (k := line_key(line, min_chars))}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.binary()))], names=["doc_id", "keys"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, keys array<binary>")


# --- the index ---


@dataclass(frozen=True)
class LineIndex:
    """A version of the index; an earlier one stays readable until compact() of a later one."""

    spark: SparkSession
    folder: str
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    first: int = 1
    version: int = 0

    def _read(self, name: str, schema: str, versions: range) -> DataFrame:
        paths = [f"{self.folder}/{name}/{v}" for v in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """(shard, key, refs): the exact counts."""
        rows = self._read("refs", "shard long, key binary, refs long", range(self.first, self.version + 1))
        if self.version == self.first:
            return rows
        return rows.groupBy("shard", "key").agg(F.sum("refs").alias("refs")).filter("refs > 0")

    def filters(self) -> DataFrame:
        return self._read("filters", FILTERS, range(self.version, self.version + 1) if self.version else range(0))

    def documents(self) -> DataFrame:
        """(doc_id, keys) of the documents that are in the index."""
        rows = gone = None
        for v in range(self.first, self.version + 1):
            own = self._read("docs", "doc_id long, keys array<binary>", range(v, v + 1)).withColumn("since", F.lit(v))
            off = self._read("gone", "doc_id long", range(v, v + 1)).withColumn("until", F.lit(v))
            rows, gone = (own, off) if rows is None else (rows.unionByName(own), gone.unionByName(off))
        if rows is None:
            return self._read("docs", "doc_id long, keys array<binary>", range(0))
        gone = gone.groupBy("doc_id").agg(F.max("until").alias("until")).withColumnRenamed("doc_id", "gone_id")
        return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("until") > F.col("since")), "left_anti").select("doc_id", "keys")

    def _next(self, docs: DataFrame | None, gone: DataFrame | None) -> LineIndex:
        """The version after a change: documents to insert, (doc_id, keys), or ids to delete."""
        out = replace(self, version=self.version + 1)
        path = lambda name: f"{self.folder}/{name}/{out.version}"
        none = self._read("docs", "doc_id long, keys array<binary>", range(0))
        (none if docs is None else docs).write.parquet(path("docs"))
        (none.select("doc_id") if gone is None else gone).write.parquet(path("gone"))
        if gone is None:
            rows, sign = self.spark.read.parquet(path("docs")), 1
        else:
            ids = self.spark.read.parquet(path("gone")).withColumnRenamed("doc_id", "gone_id")
            rows, sign = self.documents().join(ids, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi"), -1
        change = rows.select(F.explode("keys").alias("key")).groupBy("key").agg((sign * F.count(F.lit(1))).alias("refs"))
        change = change.select(_shard_of("key", self.shards).alias("shard"), "key", "refs")
        change.write.parquet(path("refs"))
        self._crossed(self.spark.read.parquet(path("refs"))).write.parquet(path("filters"))
        return out

    def _crossed(self, change: DataFrame) -> DataFrame:
        """FILTERS after a change of counts."""
        before = self.counts().select("shard", "key", F.col("refs").alias("was"), F.lit(0).cast("long").alias("by"))
        both = before.unionByName(change.select("shard", "key", F.lit(0).cast("long").alias("was"), F.col("refs").alias("by")))
        if self.version:
            both = both.groupBy("shard", "key").agg(F.sum("was").alias("was"), F.sum("by").alias("by"))
        both = both.withColumn("now", F.col("was") + F.col("by")).filter(F.greatest("was", "now") >= self.min_docs)
        both = cut(both.select("shard", "key", (F.col("was") >= self.min_docs).alias("was"), (F.col("now") >= self.min_docs).alias("now")))
        old = cut(self.filters())
        room = F.floor(F.octet_length("slots") / 2 * FULL)
        # shards whose filter would be too full read all their common keys, the others those that change sides
        more = both.groupBy("shard").agg(F.count_if("now").alias("common"))
        crowded = more.join(old.select("shard", room.alias("room")), "shard", "left").filter(F.col("common") > F.coalesce("room", F.lit(0))).select("shard", F.lit(True).alias("anew"))
        keys = both.join(crowded, "shard", "left").filter("coalesce(anew, false) OR was <> now")

        def run(held: pa.Table, filters: pa.Table) -> pa.Table:
            shard = (held if held.num_rows else filters).column(held.column_names.index("shard") if held.num_rows else "of_shard")[0].as_py()
            rows = list(zip(*(held.column(c).to_pylist() for c in ("key", "was", "now", "anew")), strict=True)) if held.num_rows else []
            if any(r[3] for r in rows):
                common = [k for k, _, now, _ in rows if now]
                cuckoo = Cuckoo.sized(len(common))
                cuckoo.put(_array(common))
            else:
                cuckoo = Cuckoo.read(*(filters.column(c)[0].as_py() for c in ("slots", "stash", "held")))
                cuckoo.take(_array([k for k, was, now, _ in rows if was and not now]))
                cuckoo.put(_array([k for k, was, now, _ in rows if now and not was]))
            return pa.table({n.split()[0]: [v] for n, v in zip(FILTERS.split(", "), cuckoo.row(shard), strict=True)})

        return keys.groupBy("shard").cogroup(old.withColumnRenamed("shard", "of_shard").groupBy("of_shard")).applyInArrow(run, FILTERS)

    def insert(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._next(_keyed(docs, self.min_chars, id_col, text_col), None)

    def delete(self, ids: DataFrame, *, id_col: str = "doc_id") -> LineIndex:
        """Takes out all documents of the given ids."""
        return self._next(None, ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct())

    def compact(self) -> LineIndex:
        """The same state as one version; its folder gets no reader of earlier versions after that."""
        out = replace(self, first=self.version + 1, version=self.version + 1)
        for name, rows in (("docs", self.documents()), ("gone", self._read("gone", "doc_id long", range(0))), ("refs", self.counts()), ("filters", self.filters())):
            rows.write.parquet(f"{self.folder}/{name}/{out.version}")
        return out

    def apply(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", indexed: bool = False, texts: bool = True) -> DataFrame:
        """APPLIED: each document without its common lines. indexed: all of docs are in the index, whose counts then tell
        the filter's false hits without another look at the texts. texts: with the text that is left."""
        filters = cut(self.filters())
        size = filters.agg(F.sum(F.octet_length("slots") + F.octet_length("stash"))).first()[0] or 0
        if size <= BROADCAST_FILTERS and self.shards <= BROADCAST_FILTERS >> 5:
            held = self.spark.sparkContext.broadcast([tuple(r) for r in filters.toPandas().itertuples(index=False)])
            false = cut(self._false_hits(docs, held, indexed, id_col, text_col))
            if false.count() <= BROADCAST_IDS:
                return self._dropped(docs, held, {bytes(r.key) for r in false.collect()}, id_col, text_col, texts)
        return self._applied_by_shuffle(docs, filters, id_col, text_col, texts)

    def _false_hits(self, docs: DataFrame, held, indexed: bool, id_col: str, text_col: str) -> DataFrame:
        """Keys that the filters pass though they aren't common."""
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = Filters(held.value, shards)
            for batch in batches:
                keys = _array(batch.column(0).to_pylist())
                yield batch.filter(pa.array(filters.may_hold(keys)))

        if indexed:
            return self.counts().filter(F.col("refs") < self.min_docs).select("key").mapInArrow(run, "key binary")
        keys = _keyed(docs, self.min_chars, id_col, text_col).select(F.explode("keys").alias("key")).mapInArrow(run, "key binary").distinct()
        return keys.join(self.counts().filter(F.col("refs") >= self.min_docs), "key", "left_anti")

    def _dropped(self, docs: DataFrame, held, false: set[bytes], id_col: str, text_col: str, texts: bool) -> DataFrame:
        shards, min_chars = self.shards, self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = Filters(held.value, shards)
            for batch in batches:
                lines = [(t or b"").split(b"\n") for t in batch.column(1).to_pylist()]
                keys = [[line_key(x, min_chars) for x in own] for own in lines]
                asked = list({k: None for own in keys for k in own if k})
                common = {k for k, may in zip(asked, filters.may_hold(_array(asked)).tolist(), strict=True) if may and k not in false}
                yield _rows(batch.column(0), lines, [[k in common for k in own] for own in keys], texts)

        return id_and_bytes(docs, id_col, text_col).mapInArrow(run, APPLIED)

    def _applied_by_shuffle(self, docs: DataFrame, filters: DataFrame, id_col: str, text_col: str, texts: bool) -> DataFrame:
        """apply() without a broadcast that grows with the index: keys meet filters by shard, texts their common keys by digest."""
        min_chars = self.min_chars
        rows = id_and_bytes(docs, id_col, text_col).withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit(b"")), 256)))
        each = rows.groupBy("sha").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        sha = each.select(F.col("sha").alias("own"), "text", "copies")
        keys = cut(_keyed_by(sha, min_chars).withColumn("shard", _shard_of("key", self.shards)))
        salts = keys.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("salts"))
        asked = matched(keys, salts.withColumn("times", F.col("salts").cast("long") * GROUP_ROWS), "shard", "times", keys.count(), "own")
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("own"), F.col("salts")).cast("int")).select("shard", "salt", "own", "copies", "key")
        copies = filters.join(salts, "shard").withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(F.col("shard").alias("of_shard"), "of_salt", "slots", "stash", "held")

        def run(held: pa.Table, own: pa.Table) -> pa.Table:
            if not held.num_rows or not own.num_rows:
                return pa.table({"own": pa.array([], pa.binary()), "copies": pa.array([], pa.int64()), "key": pa.array([], pa.binary())})
            found = Filters([(0, *(own.column(c)[0].as_py() for c in ("slots", "stash", "held")))], 1).may_hold(_array(held.column("key").to_pylist()))
            return held.filter(pa.array(found)).select(["own", "copies", "key"])

        possible = cut(asked.groupBy("shard", "salt").cogroup(copies.groupBy("of_shard", "of_salt")).applyInArrow(run, "own binary, copies long, key binary"))
        common = self.counts().filter(F.col("refs") >= self.min_docs).select("key", F.col("refs").alias("times"))
        sure = matched(possible, common, "key", "times", keys.count(), "own").filter("times IS NOT NULL")
        sure = cut(sure.groupBy("own").agg(F.first("copies").alias("copies"), F.collect_list("key").alias("common")).withColumnRenamed("own", "sha"))
        rows = matched(rows, sure, "sha", "copies", docs.count(), "doc_id")

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines = [(t or b"").split(b"\n") for t in batch.column(1).to_pylist()]
                sets = [set(c or ()) for c in batch.column(2).to_pylist()]
                yield _rows(batch.column(0), lines, [[bool(s) and line_key(x, min_chars) in s for x in own] for own, s in zip(lines, sets, strict=True)], texts)

        return rows.select("doc_id", "text", "common").mapInArrow(drop, APPLIED)


def _keyed_by(rows: DataFrame, min_chars: int) -> DataFrame:
    """(own, copies, key) of (own, text, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = list({k: None for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars))})
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(keys), pa.binary()), pa.array([copies] * len(keys), pa.int64()), pa.array(keys, pa.binary())], names=["own", "copies", "key"])

    return rows.mapInArrow(run, "own binary, copies long, key binary")


def _rows(ids: pa.Array, lines: list[list[bytes]], off: list[list[bool]], texts: bool) -> pa.RecordBatch:
    kept = [b"\n".join(x for x, o in zip(own, gone, strict=True) if not o) for own, gone in zip(lines, off, strict=True)]
    columns = [ids, pa.array(map(len, lines), pa.int64()), pa.array(map(sum, off), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept] if texts else [None] * len(kept), pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in APPLIED.split(", ")])


def create(spark: SparkSession, folder: str | None = None, *, keys: int = SHARD_KEYS, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
    """An empty index for about so many distinct keys; by default in the shared checkpoint folder."""
    folder = folder or f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    return LineIndex(spark, folder, blob_partitions(keys, SHARD_KEYS), min_docs, min_chars)


def drop_common_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, texts: bool = True) -> DataFrame:
    """Indexes docs and applies the index to them: APPLIED."""
    index = create(docs.sparkSession, keys=16 * docs.count(), min_docs=min_docs, min_chars=min_chars).insert(docs)
    return index.apply(docs, indexed=True, texts=texts)

"""N-gram Jaccard join with set-relation skipping.

Sets. A document's set holds the 64-bit hashes of its distinct k-word shingles. Documents with the same set (128-bit
digest of it) are one from then on; hash collisions are the only inexactness (about n * m / 2^64 for a pair of sets).

Candidates. Shingles have one global order, the frequent ones last. Two sets that reach the threshold share a shingle
among the first n - ceil(t * n) + 1 of each, so only these are indexed, with set size and position, in lists dealt by
shingle. Lists are sorted by size, and a list is read from a set on up to the first size that rules a link out. Pairs of
short lists are counted; a pair whose positions or count of shared prefix shingles rule a link out is dropped. In a list
longer than `long_list` (already in a task's own part of it, before the shuffle) each set is tied to its neighbour
instead, so that no list makes more rows than it has members or a fixed number of pairs.

Answers. Candidate components are the cells within which all links lie. A cell's sets meet in one task (a large cell in
blocks, each pair of blocks in one task) and are joined exactly: a set's candidates come from the index lists of its
first shingles, of which blocks are skipped whose size or position rules a link out; where it is highly similar to a set
just answered, its overlaps are that set's, changed only by the lists of the shingles in which the two differ (`Answers`).
Links make the components; every document counts its links.

Frequencies only set the order, they don't decide links. Over all documents, two counts are made by the leading 32 bits
of a hash: of shingles that repeat within a chunk, and of each set's first shingles in the order of hashes. The
`ORDERED` most frequent go to all tasks (three MB at most) and come last, the rarest first; before them come those whose
bit is set in a map of all that can make long lists (16 MB at most); the others come first. Within, hashes give the order.

Defined results: each row is a node of the links, also where ids are repeated or null; a null id comes behind all others; null, empty and blank texts have an empty set, no links and themselves as component; texts of fewer
than k words are one shingle; repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm._common import FAN, blob_partitions, cut, dealt, id_and_bytes, named, numbered, packed_id, packed_parts, unpacked_id
from geoweft.llm.components import connected_components

WORDS, PERCENT = 5, 80
ORDERED = 1 << 18
CHUNK_SHINGLES = 1 << 21
CHUNK_REPEATS = 4
COUNTED_PERCENT = 30
COUNTS_PER_PARTITION = 1 << 21
MOST_BITS = 1 << 27
LONG_LIST = 16
POSTINGS_PER_PARTITION = 1 << 19
CELL_SHINGLES = 1 << 20
SPREAD, SPREAD_SHINGLES = 8, 1 << 15
#: Entries of a block of an index list; by how many percent less a leader's answers reach, for those derived from them.
BLOCK, LOOSER = 16, 10
BROADCAST_ROWS = 1 << 19
POSTING = np.dtype([("shingle", "<u8"), ("set", "<i8"), ("size", "<u4"), ("position", "<u4")])
#: The position of a posting that stands for a whole chunk's list.
_ANY = (1 << 32) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, np.bool_)
_SPACE[[*b" \t\n\v\f\r"]] = True


def _scrambled(a: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        a = (a ^ (a >> np.uint64(shift))) * np.uint64(factor)
    return a ^ (a >> np.uint64(31))


#: Tabulation hashing: a number for each byte at each of 64 places in a word.
_TABLE = _scrambled(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, the text's bytes), A-Z in lower case, words between ASCII white space."""
    raw = np.frombuffer((text or b"").lower(), np.uint8)
    inside = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, raw
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = _TABLE[((place & 63) << 8) | raw[inside]]
    if lengths.max() > 64:
        value = value * (2 * (place >> 6) + 1).astype(np.uint64)
    return _scrambled(np.add.reduceat(value, first)), starts, raw


def shingle_set(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Ascending hashes of the distinct shingles of k words; of all words if there are fewer."""
    own = word_hashes(text)[0]
    if not len(own):
        return own
    k = min(k, len(own))
    n = len(own) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ own[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _set_id(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _ceil(a, percent: int):
    return -(-a * percent // 100)


def prefix_length(n, percent: int):
    """Of a set of n shingles, so many first ones share one with every set that reaches the threshold."""
    return n - _ceil(n, percent) + 1


def _least_overlap(a, b, percent: int):
    """The fewest shared shingles with which sets of a and b shingles reach the threshold."""
    return -(-(a + b) * percent // (100 + percent))


_SUMMARY = "doc_id long, n long, key binary, node long, cell long, times long, part int, salt long, blob binary"


def _summaries(docs: DataFrame, partitions: int, k: int) -> DataFrame:
    """Three kinds of rows: documents (doc_id, n, key, node), shingles' cells that repeat within a chunk (cell, times),
    and the cells of each set's first shingles, dealt by cell (part, salt, blob)."""
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "key": pa.binary(), "node": pa.int64(), "cell": pa.int64(), "times": pa.int64(), "part": pa.int32(), "salt": pa.int64(), "blob": pa.binary()}

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gathered, size, salt = [], 0, TaskContext.get().partitionId() << 32

        def counts() -> Iterator[pa.RecordBatch]:
            nonlocal gathered, size, salt
            value, times = np.unique(np.concatenate([_cells(x) for x in gathered]), return_counts=True)
            kept = times >= CHUNK_REPEATS
            yield batch_of(int(kept.sum()), cell=value[kept].astype(np.int64), times=times[kept].astype(np.int64))
            first = np.concatenate([_cells(x[: -(-len(x) * COUNTED_PERCENT // 100)]) for x in gathered])
            parts, blobs = packed_parts(first, _by_cell(first), min(FAN, partitions))
            yield batch_of(len(parts), part=parts, salt=[salt] * len(parts), blob=blobs)
            salt += 1
            gathered, size = [], 0

        for batch in batches:
            ns, keys = [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, k)
                ns.append(len(found))
                keys.append(set_key(found))
                gathered.append(found)
                size += len(found)
                if size >= CHUNK_SHINGLES:
                    yield from counts()
            yield batch_of(len(ns), doc_id=batch.column(0).to_pylist(), n=ns, key=keys, node=[_set_id(x) for x in keys])
        if gathered:
            yield from counts()

    return docs.mapInArrow(run, _SUMMARY)


def _cells(found: np.ndarray) -> np.ndarray:
    """What frequencies are counted by: the leading 32 bits of a shingle's hash."""
    return (found >> np.uint64(32)).astype(np.uint32)


def _by_cell(cells: np.ndarray) -> np.ndarray:
    """What cells are dealt by."""
    return cells.astype(np.uint64) << np.uint64(32)


def _frequent(summary: DataFrame, partitions: int, bits: int, long_list: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, times, map): the ORDERED cells that most sets share, ascending, and a bitmap of all cells that can make a
    long list, by the leading bits of the cell."""
    shift = 33 - bits.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(part, []).append(cells)
        for part in list(parts):
            value, times = np.unique(np.frombuffer(b"".join(parts.pop(part)), np.uint32), return_counts=True)
            kept = times > long_list // 2
            value, times = value[kept].astype(np.int64), times[kept].astype(np.int64)
            at = value >> shift
            first, last = (int(at[0]) // 8, int(at[-1]) // 8) if len(at) else (0, 0)
            flags = np.zeros(8 * (last - first + 1), np.bool_)
            flags[at - 8 * first] = True
            top = np.sort(np.argsort(-times, kind="stable")[:ORDERED])
            cells = [*value[top].tolist(), None]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([*times[top].tolist(), None], pa.int64()), pa.array([None] * len(top) + [first], pa.int64()), pa.array([None] * len(top) + [np.packbits(flags).tobytes()], pa.binary())], names=["cell", "times", "first", "flags"])

    dealt_cells = dealt(summary.filter("part IS NOT NULL").select("part", "salt", F.lit(0).alias("kind"), "blob"), partitions, {0: (np.dtype("<u4"), _by_cell)})
    first = cut(dealt_cells.select("part", "blob").mapInArrow(run, "cell long, times long, first long, flags binary"))
    both = summary.filter("times IS NOT NULL").groupBy("cell").agg(F.sum("times").alias("times")).unionByName(first.filter("cell IS NOT NULL").select("cell", "times"))
    most = both.groupBy("cell").agg(F.max("times").alias("times")).orderBy(F.desc("times"), "cell").limit(ORDERED).toArrow()
    cells, times = most.column("cell").to_numpy().astype(np.uint32), most.column("times").to_numpy()
    order = np.argsort(cells)
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in first.filter("flags IS NOT NULL").select("first", "flags").toLocalIterator():
        own = np.frombuffer(bytes(r.flags), np.uint8)
        bitmap[r.first : r.first + len(own)] |= own
    return cells[order], times[order], bitmap


def _ordered(found: np.ndarray, cells: np.ndarray, times: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """found in the global order: by hash, then what the bitmap holds by hash, then known cells, the rarest first."""
    if not len(cells):
        return found
    own = _cells(found)
    place = own >> np.uint32(33 - (8 * len(bitmap)).bit_length())
    rank = ((bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(np.int64)
    at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
    hot = cells[at] == own
    rank[hot] = 1 + times[at[hot]]
    return found[np.argsort(rank, kind="stable")] if rank.any() else found


def _tied(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in a list sorted by size, but for gaps in size that no link spans."""
    near = sizes[1:] * percent <= sizes[:-1] * 100
    return np.flatnonzero(near), np.flatnonzero(near) + 1


PAIRS = "a long, b long, na int, nb int, shared int, placed int"
_PAIR_NAMES = [c.split()[0] for c in PAIRS.split(", ")]
_SURE = 1 << 24


def _postings(docs: DataFrame, partitions: int, frequent, k: int, percent: int, long_list: int) -> DataFrame:
    """(part, salt, kind, blob): postings of one part, or (kind 1) ties made of a chunk's long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        order = frequent.value
        gathered, size, seen, salt = [], 0, set(), TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal gathered, size, seen, salt
            rows = np.concatenate(gathered) if gathered else np.zeros(0, POSTING)
            gathered, size, seen = [], 0, set()
            rows = rows[np.lexsort((rows["set"], rows["size"], rows["shingle"]))]
            starts = np.flatnonzero(np.r_[True, rows["shingle"][1:] != rows["shingle"][:-1]]) if len(rows) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(rows)].astype(np.int64)
            keep, ties = np.ones(len(rows), np.bool_), []
            for s, e in zip(*(x[ends - starts > long_list] for x in (starts, ends)), strict=True):
                part = rows[s:e]
                ties.append(np.stack([part["set"][1:], part["set"][:-1]], 1))
                keep[s + 1 : e] = False
                rows["position"][s] = _ANY
            rows = rows[keep]
            parts, blobs = packed_parts(rows, _dealt_by(rows), min(FAN, partitions))
            kinds = [0] * len(parts)
            if ties:
                blobs.append(np.unique(np.concatenate(ties), axis=0).tobytes())
                parts.append(salt % min(FAN, partitions))
                kinds.append(1)
            salt += 1
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([salt] * len(parts), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "salt", "kind", "blob"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, k)
                if not len(found) or (key := _set_id(set_key(found))) in seen:
                    continue
                seen.add(key)
                n = len(found)
                first = _ordered(found, *order)[: prefix_length(n, percent)]
                rows = np.empty(len(first), POSTING)
                rows["shingle"], rows["set"], rows["size"], rows["position"] = first, key, n, np.arange(len(first))
                gathered.append(rows)
                size += len(rows)
                if size >= CHUNK_SHINGLES // 4:
                    yield flush()
        if gathered:
            yield flush()

    return docs.mapInArrow(run, "part int, salt long, kind int, blob binary")


def _dealt_by(rows: np.ndarray) -> np.ndarray:
    """What postings are dealt by: their shingle, mixed anew, as the smallest shingles are indexed most."""
    return rows["shingle"] * _MIX


def list_pairs(rows: np.ndarray, percent: int, long_list: int) -> np.ndarray:
    """Candidate pairs of index lists, each pair once with its number of shared shingles: columns as in PAIRS.

    rows: postings in any order. Lists are sorted by size; from a set on, the list is read up to the first size that
    rules a link out. `placed` tells whether some shared position leaves enough shingles behind it.
    """
    rows = rows[np.lexsort((rows["position"], rows["set"], rows["size"], rows["shingle"]))]
    rows = rows[np.r_[True, (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["set"][1:] != rows["set"][:-1]) | (rows["position"][1:] == _ANY)]] if len(rows) else rows
    if not len(rows):
        return np.zeros((0, 6), np.int64)
    starts = np.flatnonzero(np.r_[True, rows["shingle"][1:] != rows["shingle"][:-1]])
    ends = np.r_[starts[1:], len(rows)]
    whole = np.maximum.reduceat(rows["position"], starts) == _ANY
    longer = (ends - starts > long_list) | whole
    sets, sizes, positions = rows["set"], rows["size"].astype(np.int64), rows["position"].astype(np.int64)
    out = []
    for s, e, every in zip(starts[longer], ends[longer], whole[longer], strict=True):
        one, two = (np.arange(e - s - 1), np.arange(1, e - s)) if every else _tied(sizes[s:e], percent)
        out.append(np.stack([sets[s + one], sets[s + two], sizes[s + one], sizes[s + two], np.full(len(one), _SURE), np.ones(len(one), np.int64)], 1))
    end_of = np.repeat(np.where(longer, starts, ends), ends - starts)  # lists that are tied have no pairs
    at = np.arange(len(rows))
    for step in range(1, long_list):
        at = at[at + step < end_of[at]]
        at = at[sizes[at + step] * percent <= sizes[at] * 100]
        if not len(at):
            break
        a, b = at, at + step
        need = _least_overlap(sizes[a], sizes[b], percent)
        placed = np.minimum(sizes[a] - positions[a], sizes[b] - positions[b]) >= need
        out.append(np.stack([sets[a], sets[b], sizes[a], sizes[b], np.ones(len(a), np.int64), placed.astype(np.int64)], 1))
    if not out:
        return np.zeros((0, 6), np.int64)
    found = np.concatenate(out)
    swap = found[:, 0] < found[:, 1]
    found[swap] = found[swap][:, [1, 0, 3, 2, 4, 5]]
    order = np.lexsort((found[:, 1], found[:, 0]))
    found = found[order]
    first = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)])
    merged = found[first]
    merged[:, 4] = np.minimum(np.add.reduceat(found[:, 4], first), _SURE)
    merged[:, 5] = np.maximum.reduceat(found[:, 5], first)
    return merged


def _pairs(postings: DataFrame, partitions: int, percent: int, long_list: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind:
                    ties = np.frombuffer(blob, np.int64).reshape(-1, 2)
                    flat = np.zeros(len(ties), np.int64)
                    yield rows_of(np.stack([ties.max(1), ties.min(1), flat, flat, flat + _SURE, flat + 1], 1))
                else:
                    lists.setdefault(part, []).append(np.frombuffer(blob, POSTING))
        for part in list(lists):
            found = list_pairs(np.concatenate(lists.pop(part)), percent, long_list)
            for k in range(0, len(found), 1 << 18):
                yield rows_of(found[k : k + (1 << 18)])

    def rows_of(found: np.ndarray) -> pa.RecordBatch:
        kinds = [pa.int64()] * 2 + [pa.int32()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(found.T, kinds, strict=True)], names=_PAIR_NAMES)

    found = dealt(postings, partitions, {0: (POSTING, _dealt_by)}).mapInArrow(run, PAIRS)
    summed = found.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"), F.max("placed").alias("placed"))
    # in the prefix that ends first, all shingles but the shared ones are missing from the other set
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    short = lambda n: F.col(n) - F.ceil(F.col(n) * percent / 100) + 1 - F.col("shared") <= F.col(n) - need
    return summed.filter((F.col("placed") == 1) & ((F.col("shared") >= _SURE) | short("na") | short("nb"))).select("a", "b")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for `lengths[0]` places, then on with starts[1]."""
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(int(lengths.sum()))


class Answers:
    """The exact join of the sets of one cell, one set after the other: its overlaps with all sets that it may link with.

    Shingles are numbered from the cell's rarest on. The index holds each set's prefix at `loose` percent: lists of
    (set, size, rest: its shingles from this one on), by size and rest, in blocks of BLOCK entries. A pair's first shared
    shingle leaves at least the overlap they need in both, so a block whose sizes or largest rest rule that out is
    skipped. Candidates are verified by counting all their shingles.

    A set that differs from the last one answered by little (`_near`) has no link outside that one's candidates at
    `loose` percent, and its overlaps are that one's, changed by the lists of the shingles in which the two differ.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.loose = percent, max(1, percent - LOOSER)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.read = self.skipped = self.derived = 0
        m = len(sets)
        _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.empty(len(counts), np.int64)
        number[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        code = number[code]
        owner = np.repeat(np.arange(m), self.sizes)
        self.owners = owner[np.argsort(code, kind="stable")]
        self.list_ends = np.cumsum(np.bincount(code, minlength=len(counts)))
        self.list_starts = np.r_[0, self.list_ends[:-1]]
        order = np.lexsort((code, owner))
        self.flat = code[order]
        self.set_ends = np.cumsum(self.sizes)
        self.set_starts = self.set_ends - self.sizes
        rest = np.repeat(self.set_ends, self.sizes) - np.arange(len(code))
        first = np.repeat(self.sizes, self.sizes) - rest < np.repeat(prefix_length(self.sizes, self.loose), self.sizes)
        shingle, self.entry_set, self.entry_rest = self.flat[first], owner[first], rest[first]
        order = np.lexsort((self.entry_rest, self.sizes[self.entry_set], shingle))
        shingle, self.entry_set, self.entry_rest = shingle[order], self.entry_set[order], self.entry_rest[order]
        sizes = np.bincount(shingle, minlength=len(counts))
        blocks = -(-sizes // BLOCK)
        self.block_ends = np.cumsum(blocks)
        self.block_starts = self.block_ends - blocks
        ends = np.cumsum(sizes)
        self.starts = np.repeat(ends - sizes, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(self.block_starts, blocks))
        self.lengths = np.minimum(np.repeat(ends, blocks) - self.starts, BLOCK)
        self.most_rest = np.maximum.reduceat(self.entry_rest, self.starts)
        self.least_size = self.sizes[self.entry_set[self.starts]]
        self.most_size = self.sizes[self.entry_set[self.starts + self.lengths - 1]]
        self.mark = np.zeros(len(counts), np.bool_)
        self.where = np.full(m, -1)

    def codes(self, x: int) -> np.ndarray:
        return self.flat[self.set_starts[x] : self.set_ends[x]]

    def _found(self, x: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlaps): all that reach `percent` with set x are among them."""
        n, own = int(self.sizes[x]), self.codes(x)
        first = own[: prefix_length(n, percent)]
        blocks = self.block_ends[first] - self.block_starts[first]
        at, rest = _ranges(self.block_starts[first], blocks), np.repeat(n - np.arange(len(first)), blocks)
        need = _least_overlap(n, self.least_size[at], percent)
        kept = (100 * self.most_size[at] >= percent * n) & (percent * self.least_size[at] <= 100 * n) & (np.minimum(rest, self.most_rest[at]) >= need)
        self.skipped += len(at) - int(kept.sum())
        at, rest = at[kept], rest[kept]
        entries, rest = _ranges(self.starts[at], self.lengths[at]), np.repeat(rest, self.lengths[at])
        self.read += len(entries)
        others = self.entry_set[entries]
        kept = np.minimum(rest, self.entry_rest[entries]) >= _least_overlap(n, self.sizes[others], percent)
        found = np.unique(others[kept])
        self.mark[own] = True
        lengths = self.sizes[found]
        shared = np.add.reduceat(self.mark[self.flat[_ranges(self.set_starts[found], lengths)]].astype(np.int64), np.cumsum(lengths) - lengths)
        self.read += int(lengths.sum())
        self.mark[own] = False
        return found, shared

    def _differing(self, x: int, leader: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of x that the leader lacks, and of the leader that x lacks."""
        own, led = self.codes(x), self.codes(leader)
        self.mark[led] = True
        fresh = own[~self.mark[own]]
        self.mark[led] = False
        self.mark[own] = True
        gone = led[~self.mark[led]]
        self.mark[own] = False
        return fresh, gone

    def _near(self, x: int, fresh: np.ndarray, gone: np.ndarray) -> bool:
        """Whether all that link with x reach `loose` percent with the leader: against it the shared shingles shrink by
        the fresh ones at most, all shingles grow by those gone at most."""
        return 100 * len(fresh) + self.loose * len(gone) <= (self.percent - self.loose) * self.sizes[x]

    def _counted(self, codes: np.ndarray, n: int) -> np.ndarray:
        """How often each candidate of the leader stands in the lists of these shingles."""
        at = self.where[self.owners[_ranges(self.list_starts[codes], self.list_ends[codes] - self.list_starts[codes])]]
        self.read += len(at)
        return np.bincount(at[at >= 0], minlength=n)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sets, overlaps) of set 0, 1, ..."""
        leader, found, shared = None, None, None
        last = len(self.sizes) - 1
        for x in range(last + 1):
            if leader is not None:
                fresh, gone = self._differing(x, leader)
                if self._near(x, fresh, gone):
                    self.derived += 1
                    yield found, shared + self._counted(fresh, len(found)) - self._counted(gone, len(found))
                    continue
                self.where[found] = -1
                leader = None
            if x < last and self._near(x + 1, *self._differing(x + 1, x)):
                leader = x
                found, shared = self._found(x, self.loose)
                self.where[found] = np.arange(len(found))
                yield found, shared
            else:
                yield self._found(x, self.percent)


def cell_links(ids: np.ndarray, copies: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(root, links) of each set: its smallest linked id in this cell, and the documents linked with one of its copies.

    across: only links between different blocks count.
    """
    m = len(sets)
    parent = np.arange(m)
    links = np.zeros(m, np.int64)

    def roots(of: np.ndarray) -> np.ndarray:
        above = parent[of]
        while (parent[above] != above).any():
            above = parent[above]
        return above

    cell = Answers(sets, percent)
    for x, (found, shared) in enumerate(cell.overlaps()):
        linked = (100 * shared >= percent * (cell.sizes[found] + cell.sizes[x] - shared)) & (found != x)
        if across:
            linked &= blocks[found] != blocks[x]
        some = found[linked]
        if len(some):
            links[x] = copies[some].sum()
            some = np.append(some, x)
            own = roots(some)
            least = own.min()
            parent[own] = parent[some] = least
    own = roots(np.arange(m))
    root = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(root, own, ids)
    return root[own], links


def join_cells(rows: DataFrame, percent: int) -> DataFrame:
    """(id, root, links) per set and unit: the exact join within cells. rows: id, cell, copies, blocks, hashes.

    A cell of several blocks is dealt as one unit per pair of blocks, each set going to the units of its block.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def finish() -> None:
            if rows:
                ids = np.array([r[0] for r in rows], np.int64)
                root, links = cell_links(ids, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]), [np.frombuffer(r[3], np.uint64) for r in rows], percent, unit[1] != unit[2])
                done.append((ids, root, links))

        def out() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*done, strict=True)] if done else [np.zeros(0, np.int64)] * 3
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["id", "root", "links"])

        for batch in batches:
            for i, cell, copies, one, two, block, hashes in zip(*(batch.column(c).to_pylist() for c in ("id", "cell", "copies", "one", "two", "block", "hashes")), strict=True):
                if (cell, one, two) != unit:
                    finish()
                    unit, rows = (cell, one, two), []
                if not rows or (i, hashes) != (rows[-1][0], rows[-1][3]):  # repeated rows of one document
                    rows.append((i, copies, block, hashes))
            yield out()
        finish()
        yield out()

    found = rows.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    units = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    units = units.select("id", "cell", "copies", "one", "two", "block", "hashes")
    dealt = units.repartition("cell", "one", "two").sortWithinPartitions("cell", "one", "two", F.substring("hashes", 1, 8), F.length("hashes"), "id", "hashes")
    return dealt.mapInArrow(join, "id long, root long, links long")


def _sets(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The sets of members (id, cell, copies, blocks, key), made again from their texts (doc_id, text)."""
    small = members.count() <= BROADCAST_ROWS
    wanted = texts.join(F.broadcast(members) if small else members, texts.doc_id == members.id)
    # a document id with several texts: the set's own text is told by its key
    return wanted.select("id", "cell", "copies", "blocks", "key", "text").mapInArrow(lambda b: _own(b, k), "id long, cell long, copies long, blocks int, hashes binary")


def _own(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of rows whose text has the key looked for."""
    for batch in batches:
        found = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
        kept = pa.array([set_key(f) == x for f, x in zip(found, batch.column("key").to_pylist(), strict=True)], pa.bool_())
        columns = [batch.column(c) for c in ("id", "cell", "copies", "blocks")] + [pa.array([f.tobytes() for f in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "cell", "copies", "blocks", "hashes"]).filter(kept)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, long_list: int = LONG_LIST, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links."""
    if (own := numbered(docs, id_col, text_col)) is not None:
        return named(jaccard_components(own, id_col="row", words=words, percent=percent, long_list=long_list, cell_shingles=cell_shingles), own, "component_id")
    texts = id_and_bytes(docs, id_col, text_col).withColumn("doc_id", packed_id("doc_id"))
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.length(F.col(text_col)))).first()[0] or 0
    counters = blob_partitions(total // 20, COUNTS_PER_PARTITION)  # three tenths of a shingle for each six letters
    summary = cut(_summaries(texts, counters, words))
    rows = summary.filter("key IS NOT NULL").select("doc_id", "n", "key", "node")
    groups = cut(rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("node").alias("node"), F.count(F.lit(1)).alias("copies")))
    bits = min(MOST_BITS, max(1 << 16, 1 << (total // 5).bit_length()))
    frequent = spark.sparkContext.broadcast(_frequent(summary, counters, bits, long_list))
    indexed = groups.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    partitions = blob_partitions(indexed, POSTINGS_PER_PARTITION)
    edges = _pairs(_postings(texts, partitions, frequent, words, percent, long_list), partitions, percent, long_list)
    cells = cut(connected_components(edges))
    members = groups.join(cells, "node")
    weights = cells_weights(members, cell_shingles)
    members = cut(members.join(weights, "component").select("id", F.col("component").alias("cell"), "copies", "blocks", "key"))
    links = cut(join_cells(_sets(members, texts, words), percent))
    roots = links.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    if members.filter("blocks > 1").isEmpty():
        found = roots.select(F.col("a").alias("id"), F.col("b").alias("component"))
    else:
        found = connected_components(roots).select(F.col("node").alias("id"), "component")
    found = found.groupBy("id").agg(F.min("component").alias("component"))
    counted = groups.join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(found, "id", "left")
    classes = counted.select("key", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = rows.select("doc_id", "n", "key")
    found = rows.join(classes, "key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.select(unpacked_id("doc_id"), F.col("n").alias("n_shingles"), unpacked_id("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def cells_weights(members: DataFrame, cell_shingles: int) -> DataFrame:
    """(component, blocks): into how many blocks each cell is dealt. Up to SPREAD blocks of about SPREAD_SHINGLES, so that
    a hot group's pairs of blocks keep many tasks busy; beyond that as many as blocks of cell_shingles need."""
    total = F.sum("n")
    spread = F.least(F.lit(SPREAD), F.ceil(total / F.lit(min(SPREAD_SHINGLES, cell_shingles))))
    return members.groupBy("component").agg(F.greatest(spread, F.ceil(total / F.lit(cell_shingles))).cast("int").alias("blocks"))

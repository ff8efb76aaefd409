"""Substring dedup: paragraphs by MinHash banding, and exact passages that keep to no paragraph.

Paragraphs are all lines of at least one shingle of words. Where lines are wrapped, the whole block between blank lines
is a paragraph too. A block is wrapped if each of its lines has fewer than `WRAP_WORDS` words, or if no line but the last
has room for the next one's first word. Paragraphs of the same words are one node. A node's MinHash signature is cut into bands, tuned so that a pair at the threshold is missed with a probability below
`MISS`. Nodes that share a band are tied to the smallest of them (one edge per node and band, however many share it),
first within a chunk of documents, of which one node goes on, so that a hot band has one row per chunk; the components of these ties are cells, within which exact Jaccard similarity is verified and links make clusters. A set
of few shingles, which at the threshold has equal ones only, needs one band.

Passages inside or across paragraphs: of each `ANCHOR` neighbouring words the one with the smallest hash starts a window
of `WINDOW_WORDS` words. Texts that share ANCHOR + WINDOW_WORDS - 1 = 51 words share such a window. Windows meet by their
hash, and those of several documents stay. A shared run of 51 words reaches at most ANCHOR - 1 words beyond its anchors'
windows, so the ANCHOR - 1 words before and behind each window are compared too, step by step, among the documents that
agree so far. Of a window that a chunk of documents holds often, two occurrences meet those of other chunks; windows of more
than HEAVY occurrences are not gathered either, but compared by sums over the keys of what stands around them (`_by_keys`).
Each word of a document belongs to the smallest document it is found to share it with (itself included);
neighbouring words of one such document are a passage, so that every word removed stays in a smaller document.

Defined results: null and empty texts and lines shorter than a shingle have no paragraphs; a passage repeated within one document alone isn't reported;
each row is a document, also where ids are repeated or null; a null id comes behind all others; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm import set_join
from geoweft.llm._common import FAN, blob_partitions, cut, dealt, id_and_bytes, matched, named, numbered, packed_id, packed_parts, unpacked_id
from geoweft.llm.components import connected_components

WRAP_WORDS = 30
ANCHOR, WINDOW_WORDS = 20, 32
MISS = 0.002
LETTERS_PER_PARTITION = 1 << 23
CONTEXTS_PER_PARTITION = 1 << 15
#: Windows that a chunk of documents has more often are crowded; those with more occurrences in all are heavy.
CROWD, HEAVY = 16, 1 << 16
_BAND = np.dtype([("band", "<u8"), ("node", "<i8")])
_WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<u4")])
_CONTEXT = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1", 2), ("near", "<u4", (2, ANCHOR - 1))])  # 32 bits of the words beside a window
_PLACE = np.dtype([("doc", "<i8"), ("node", "<i8"), ("start", "<u4"), ("end", "<u4")])
BANDS, WINDOWS, PLACES, TIES, CROWDED = range(5)
_DEALT = {BANDS: (_BAND, lambda rows: rows["band"]), WINDOWS: (_WINDOW, lambda rows: rows["hash"])}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^ \t-\r]+")
_FOUND = "kind int, doc_id long, start_word int, end_word int, a long, b long"


def tuned_bands(percent: int, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold less often than MISS, with `most` hashes."""
    t = percent / 100
    fits = [(r, b) for r in range(1, most + 1) for b in range(1, most // r + 1) if (1 - t**r) ** b < MISS]
    rows = max(r for r, _ in fits)
    return min(b for r, b in fits if r == rows), rows


def _rolling(own: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(own) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ own[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def signature_bands(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each stretch of shingles, one 64-bit key per band of its MinHash signature."""
    odd = (np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    at = np.stack([starts, ends], 1).ravel()
    room = np.append(shingles, np.uint64(0))  # so that the last end is a place too
    least = np.empty((len(odd), len(starts)), np.uint64)
    step = max(1, (1 << 20) // len(room))
    for k in range(0, len(odd), step):
        some = odd[k : k + step, None]
        mixed = room[None, :] * some
        mixed ^= mixed >> np.uint64(31)
        mixed *= some
        least[k : k + step] = np.minimum.reduceat(mixed, at, axis=1)[:, ::2]
    out = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(starts), 1)
    for j in range(rows):
        out = (out ^ least[j::rows]) * _MIX
        out ^= out >> np.uint64(29)
    return out.T.view(np.int64)


def _sliding(a: np.ndarray, width: int, choose) -> np.ndarray:
    """choose (minimum or maximum) over each stretch of `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        a = choose(a[:-done], a[done:])
        done *= 2
    return choose(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def anchors(own: np.ndarray) -> np.ndarray:
    """Positions with the smallest hash among some ANCHOR neighbours, with a whole window behind each."""
    n = len(own) - WINDOW_WORDS + 1
    if n < ANCHOR:
        return np.zeros(0, np.int64)
    mixed = _rolling(own[: n + 3], 4)
    least = _sliding(mixed, ANCHOR, np.minimum)
    edge = np.zeros(ANCHOR - 1, np.uint64)
    return np.flatnonzero(mixed == _sliding(np.r_[edge, least, edge], ANCHOR, np.maximum))


def _windows(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at starts."""
    out = np.full(len(starts), WINDOW_WORDS, np.uint64)
    for j in range(WINDOW_WORDS):
        out = (out ^ own[starts + j]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _wrapped(lines: list[str]) -> bool:
    """Whether no line but the last has room for the first word of the next."""
    width = max(len(x.rstrip()) for x in lines)
    return all(len(x.rstrip()) + 1 + len(_WORD.search(y)[0]) > width for x, y in zip(lines, lines[1:], strict=False))


def _paragraphs(text: bytes | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and (start, end) of the lines and wrapped blocks that are paragraphs, in words."""
    own, starts, raw = set_join.word_hashes(text)
    ends = np.append(np.searchsorted(starts, np.flatnonzero(raw == 10)), len(own))
    places = np.stack([np.r_[0, ends[:-1]], ends], 1)
    counts = places[:, 1] - places[:, 0]
    edges = np.flatnonzero(np.diff((counts > 0).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    blocks, lines = [], None
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a < 2:
            continue
        if counts[a:b].max() >= WRAP_WORDS:
            lines = lines or text.decode("utf-8", "replace").split("\n")
            if not _wrapped(lines[a:b]):
                continue
        blocks.append((places[a, 0], places[b - 1, 1]))
    places = np.concatenate([places, np.array(blocks, places.dtype).reshape(-1, 2)])
    return own, places[places[:, 1] - places[:, 0] >= k]


def alone(percent: int) -> int:
    """Sets of so many elements at most reach the threshold with equal sets only."""
    return -(-percent // (100 - percent)) - 1 if percent < 100 else 1 << 31


def banded(nodes: np.ndarray, keys: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, ties) of a chunk: for each band the least of its nodes, and pairs that tie the others to it.

    nodes: of each paragraph; keys: its band keys, of which a paragraph of few shingles needs the first alone.
    """
    _, first = np.unique(nodes, return_index=True)
    nodes, keys, few = nodes[first], keys[first], few[first]
    rows = np.empty(keys.size, _BAND)
    rows["band"], rows["node"] = keys.view(np.uint64).ravel(), np.repeat(nodes, keys.shape[1])
    rows = rows[~(np.repeat(few, keys.shape[1]) & (np.arange(keys.size) % keys.shape[1] > 0))]
    return tied_bands(rows)


def tied_bands(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (band, node): one row per band, of its least node, and (node, least) of the other nodes."""
    if not len(rows):
        return rows, np.zeros((0, 2), np.int64)
    rows = rows[np.argsort(rows["band"], kind="stable")]
    starts = np.flatnonzero(np.r_[True, rows["band"][1:] != rows["band"][:-1]])
    least = np.minimum.reduceat(rows["node"], starts)
    sizes = np.diff(np.r_[starts, len(rows)])
    several = np.repeat(sizes > 1, sizes)
    ties = np.stack([rows["node"][several], np.repeat(least, sizes)[several]], 1)
    first = rows[starts]
    first["node"] = least
    return first, np.unique(ties[ties[:, 0] != ties[:, 1]], axis=0)


def _scan(docs: DataFrame, partitions: int, k: int, percent: int) -> DataFrame:
    """(part, salt, kind, blob): places of paragraphs, ties of their nodes within a chunk, bands, passage windows, and of
    crowded ones those that needn't meet others."""
    bands, rows = tuned_bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, coarse = _first_salt(), min(FAN, partitions)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                chunk = batch.slice(at, 2000)
                places, keys, windows = [], [], []
                for doc, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
                    own, found = _paragraphs(text, k)
                    if len(found):
                        some = np.empty(len(found), _PLACE)
                        some["doc"], (some["start"], some["end"]) = doc, found.T
                        some["node"] = [xxhash.xxh3_64_intdigest(own[a:b].tobytes()) - (1 << 63) for a, b in found.tolist()]
                        places.append(some)
                        keys.append(signature_bands(_rolling(own, k), found[:, 0], found[:, 1] - k + 1, bands, rows))
                    starts = anchors(own)
                    if len(starts):
                        some = np.empty(len(starts), _WINDOW)
                        some["hash"], some["doc"], some["start"] = _windows(own, starts), doc, starts
                        windows.append(some)
                blobs: list[tuple[int, int, bytes]] = []
                if places:
                    all_of = np.concatenate(places)
                    least, ties = banded(all_of["node"], np.concatenate(keys), all_of["end"] - all_of["start"] - k + 1 <= alone(percent))
                    blobs += [(salt % coarse, PLACES, all_of.tobytes()), (salt % coarse, TIES, ties.tobytes())]
                    blobs += [(p, BANDS, x) for p, x in zip(*packed_parts(least, least["band"], coarse), strict=True)]
                if windows:
                    all_of, crowded = parted(np.concatenate(windows))
                    blobs += [(p, WINDOWS, x) for p, x in zip(*packed_parts(all_of, all_of["hash"], coarse), strict=True)]
                    if len(crowded):
                        blobs.append((salt % coarse, CROWDED, crowded.tobytes()))
                parts, kinds, packed = zip(*blobs, strict=True) if blobs else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([salt] * len(parts), pa.int64()), pa.array(kinds, pa.int32()), pa.array(packed, pa.binary())], names=["part", "salt", "kind", "blob"])
                salt += 1

    return docs.mapInArrow(run, "part int, salt long, kind int, blob binary")


def _reduced(scanned: DataFrame, partitions: int) -> DataFrame:
    """What one exchange of _scan()'s rows leaves, by kind: places (doc_id, start_word, end_word, a: node), ties (a, b:
    nodes), and windows (doc_id, start_word, a: hash) that several documents hold."""

    def rows_of(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
        types = {"doc_id": pa.int64(), "start_word": pa.int32(), "end_word": pa.int32(), "a": pa.int64(), "b": pa.int64()}
        values = [pa.array(np.ascontiguousarray(columns[c])).cast(t) if c in columns else pa.nulls(n, t) for c, t in types.items()]
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *values], names=["kind", *types])

    def tied(ties: np.ndarray) -> pa.RecordBatch:
        return rows_of(TIES, len(ties), a=ties[:, 0], b=ties[:, 1])

    def windows_of(rows: np.ndarray) -> pa.RecordBatch:
        return rows_of(WINDOWS, len(rows), doc_id=rows["doc"], start_word=rows["start"].astype(np.int32), a=np.ascontiguousarray(rows["hash"]).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == TIES:
                    yield tied(np.frombuffer(blob, np.int64).reshape(-1, 2))
                elif kind == CROWDED:
                    yield windows_of(np.frombuffer(blob, _WINDOW))
                elif kind == PLACES:
                    rows = np.frombuffer(blob, _PLACE)
                    yield rows_of(PLACES, len(rows), doc_id=rows["doc"], start_word=rows["start"].astype(np.int32), end_word=rows["end"].astype(np.int32), a=rows["node"])
                else:
                    parts.setdefault((part, kind), []).append(blob)
        for part, kind in list(parts):
            blob = b"".join(parts.pop((part, kind)))
            if kind == BANDS:
                yield tied(tied_bands(np.frombuffer(blob, _BAND))[1])
            else:
                yield windows_of(_shared_windows(np.frombuffer(blob, _WINDOW)))

    return dealt(scanned, partitions, _DEALT).mapInArrow(run, _FOUND)


def _shared_windows(rows: np.ndarray) -> np.ndarray:
    """Those rows whose hash several documents have."""
    rows = rows[np.argsort(rows["hash"], kind="stable")]
    starts = np.flatnonzero(np.r_[True, rows["hash"][1:] != rows["hash"][:-1]])
    sizes = np.diff(np.r_[starts, len(rows)])
    return rows[np.repeat(np.minimum.reduceat(rows["doc"], starts) != np.maximum.reduceat(rows["doc"], starts), sizes)]


def _first_salt() -> int:
    """Of the numbers that a task may give to its chunks, the first."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32


def _blobs(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """Rows of each part, by hash, from batches of (part, blob)."""
    parts: dict[int, list[bytes]] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts.setdefault(part, []).append(blob)
    for part in list(parts):
        rows = np.frombuffer(b"".join(parts.pop(part)), kind)
        if len(rows):
            yield rows[np.argsort(rows["hash"], kind="stable")]


def parted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(meet, stay) of a chunk's windows: of those more often than CROWD and in several documents, one occurrence of the
    least and one of the greatest document meet other chunks' ones; the others are shared for certain and stay."""
    rows = rows[np.lexsort((rows["doc"], rows["hash"]))]
    starts = np.flatnonzero(np.r_[True, rows["hash"][1:] != rows["hash"][:-1]])
    sizes = np.diff(np.r_[starts, len(rows)])
    crowded = (sizes > CROWD) & (rows["doc"][starts] != rows["doc"][starts + sizes - 1])
    stays = np.repeat(crowded, sizes)
    stays[starts] = stays[starts + sizes - 1] = False
    return rows[~stays], rows[stays]


def _contexts(windows: DataFrame, texts: DataFrame, partitions: int) -> DataFrame:
    """(part, salt, kind, blob): shared windows with the words beside them, from their texts, dealt by the windows' hash."""
    by_doc = windows.groupBy("doc_id").agg(F.collect_list("start_word").alias("starts"), F.collect_list("hash").alias("hashes")).withColumnRenamed("doc_id", "of")
    small = windows.count() <= set_join.BROADCAST_ROWS
    found = texts.join(F.broadcast(by_doc) if small else by_doc, F.col("doc_id") == F.col("of")).select("doc_id", "text", "starts", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _first_salt()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out = []
                for doc, text, starts, hashes in zip(*(c.to_pylist() for c in batch.slice(at, 2000).columns), strict=True):
                    own = set_join.word_hashes(text)[0]
                    starts, hashes = np.array(starts, np.int64), np.array(hashes, np.int64).view(np.uint64)
                    inside = starts + WINDOW_WORDS <= len(own)  # a document id may have several texts
                    starts, hashes = starts[inside], hashes[inside]
                    inside = _windows(own, starts) == hashes
                    starts, hashes = starts[inside], hashes[inside]
                    some = np.zeros(len(starts), _CONTEXT)
                    some["hash"], some["doc"], some["start"] = hashes, doc, starts
                    some["n"] = np.minimum(np.stack([starts, len(own) - WINDOW_WORDS - starts], 1), ANCHOR - 1)
                    room = np.r_[np.zeros(ANCHOR - 1, np.uint32), (own >> np.uint64(32)).astype(np.uint32), np.zeros(ANCHOR - 1, np.uint32)]
                    steps = np.arange(ANCHOR - 1)
                    some["near"][:, 0] = room[starts[:, None] + (ANCHOR - 2 - steps)]
                    some["near"][:, 1] = room[starts[:, None] + (ANCHOR - 1 + WINDOW_WORDS + steps)]
                    out.append(some)
                all_of = np.concatenate(out)
                parts, blobs = packed_parts(all_of, all_of["hash"], min(FAN, partitions))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([salt] * len(parts), pa.int64()), pa.array([0] * len(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "salt", "kind", "blob"])
                salt += 1

    return found.mapInArrow(run, "part int, salt long, kind int, blob binary")


def shared_stretches(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, start, end, first) of windows and of the words beside them that several documents share; rows: _CONTEXT."""

    def firsts(label: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether rows of a label have several documents, and the least of them; labels ascend."""
        starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        sizes = np.diff(np.r_[starts, len(label)])
        least = np.minimum.reduceat(docs, starts)
        return np.repeat(least != np.maximum.reduceat(docs, starts), sizes), np.repeat(least, sizes)

    rows = rows[np.argsort(rows["hash"], kind="stable")]
    label = np.cumsum(np.r_[True, rows["hash"][1:] != rows["hash"][:-1]])
    shared, first = firsts(label, rows["doc"])
    rows, label, first = rows[shared], label[shared], first[shared]
    start = rows["start"].astype(np.int64)
    whole, out = [start, start + WINDOW_WORDS], []
    for side in (0, 1):
        at, own = np.arange(len(rows)), label
        least, since, upto = first.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        changed = np.zeros(len(rows), np.bool_)  # whether the words have left the window's own first document

        def leave(some: np.ndarray) -> None:
            """The words since the last change are a stretch; those of the window's first document lengthen the window."""
            own_first = some[~changed[some]]
            whole[side][own_first] += upto[own_first] if side else -upto[own_first]
            some = some[changed[some]]
            a, b = (start[some] + WINDOW_WORDS + since[some], start[some] + WINDOW_WORDS + upto[some]) if side else (start[some] - upto[some], start[some] - since[some])
            out.append((rows["doc"][some], a, b, least[some]))

        whole[side] = whole[side].copy()
        for j in range(ANCHOR - 1):
            long = rows["n"][at, side] > j
            at, own = at[long], own[long]
            if not len(at):
                break
            word = rows["near"][at, side, j]
            order = np.lexsort((word, own))
            at, own, word = at[order], own[order], word[order]
            own = np.cumsum(np.r_[True, (own[1:] != own[:-1]) | (word[1:] != word[:-1])])
            many, now = firsts(own, rows["doc"][at])
            at, own, now = at[many], own[many], now[many]
            other = now != least[at]
            leave(at[other])
            changed[at[other]] = True
            least[at[other]], since[at[other]] = now[other], j
            upto[at] = j + 1
        leave(np.arange(len(rows)))
    return [(rows["doc"], *whole, first), *out]


def _packed_stretches(doc: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, blob) of stretches (start, end, first), those in a row of one first document as one."""
    if not len(doc):
        return
    order = np.lexsort((found[:, 0], found[:, 2], doc))
    doc, found = doc[order], found[order]
    group = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (found[1:, 2] != found[:-1, 2])]) << 32
    fresh = np.r_[True, (group + found[:, 0])[1:] > np.maximum.accumulate(group + found[:, 1])[:-1]]
    starts = np.flatnonzero(fresh)
    doc, found = doc[starts], np.stack([found[starts, 0], np.maximum.reduceat(found[:, 1], starts), found[starts, 2]], 1)
    held, first = np.unique(doc, return_index=True)
    for k in range(0, len(held), 10_000):
        some = [x.tobytes() for x in np.split(found, first[1:])[k : k + 10_000]]
        yield pa.RecordBatch.from_arrays([pa.array(held[k : k + 10_000]), pa.array(some, pa.binary())], names=["doc_id", "blob"])


def _stretches(contexts: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, blob) of stretches (start, end, first) that a document shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blobs(batches, _CONTEXT):
            doc, *found = (np.concatenate(c) for c in zip(*shared_stretches(rows), strict=True))
            yield from _packed_stretches(doc, np.stack(found, 1))

    return dealt(contexts, partitions, {0: (_CONTEXT, lambda rows: rows["hash"])}).select("part", "blob").mapInArrow(run, "doc_id long, blob binary")


def context_keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, known) of rows of _CONTEXT: of the window, and with each further word before and behind it; columns in the
    order of the text, the window's in the middle."""
    far = ANCHOR - 1
    keys, known = np.empty((len(rows), 2 * far + 1), np.uint64), np.ones((len(rows), 2 * far + 1), np.bool_)
    keys[:, far] = rows["hash"]
    for side, step in ((0, -1), (1, 1)):
        key = rows["hash"] ^ np.uint64(side + 1)
        for j in range(far):
            key = (key ^ rows["near"][:, side, j]) * _MIX
            key ^= key >> np.uint64(29)
            keys[:, far + step * (j + 1)], known[:, far + step * (j + 1)] = key, rows["n"][:, side] > j
    return keys, known


def stretches_of_keys(rows: np.ndarray, shared: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, stretches) of rows of _CONTEXT; shared: ascending keys that several documents have, least: of these the least."""
    keys, known = context_keys(rows)
    at = np.minimum(np.searchsorted(shared, keys), max(0, len(shared) - 1))
    held = known & (shared[at] == keys) if len(shared) else np.zeros_like(known)
    first = np.where(held, least[at] if len(shared) else 0, 0)
    words = np.r_[np.arange(ANCHOR - 1), np.full(WINDOW_WORDS, ANCHOR - 1), np.arange(ANCHOR, 2 * ANCHOR - 1)]
    held, first = held[:, words], first[:, words]
    fresh = np.ones_like(held)
    fresh[:, 1:] = (held[:, 1:] != held[:, :-1]) | (first[:, 1:] != first[:, :-1])
    begins = np.flatnonzero(fresh.ravel())
    ends = np.r_[begins[1:], fresh.size]
    kept = held.ravel()[begins]
    begins, ends = begins[kept], ends[kept]
    row, column = np.divmod(begins, len(words))
    start = rows["start"][row].astype(np.int64) - (ANCHOR - 1) + column
    return rows["doc"][row], np.stack([start, start + ends - begins, first.ravel()[begins]], 1)


def _by_keys(contexts: DataFrame) -> DataFrame:
    """What _stretches() gives, with no window's occurrences gathered: chunks sum their keys' least and greatest document,
    sums over all chunks tell which keys several documents have, and go back to the chunks that asked."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(blob, _CONTEXT)
                keys, known = context_keys(rows)
                key, doc = keys[known], np.repeat(rows["doc"], known.sum(1))
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                columns = [pa.array([chunk] * len(starts), pa.int64()), pa.array(key[starts].view(np.int64)), pa.array(np.minimum.reduceat(doc, starts)), pa.array(np.maximum.reduceat(doc, starts))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "key", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, keys, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared, least = np.array(keys or [], np.int64).view(np.uint64), np.array(least or [], np.int64)
                order = np.argsort(shared)
                yield from _packed_stretches(*stretches_of_keys(np.frombuffer(blob, _CONTEXT), shared[order], least[order]))

    chunks = cut(contexts.select(F.xxhash64("part", "salt").alias("chunk"), "blob"))
    asked = cut(chunks.mapInArrow(sums, "chunk long, key long, least long, most long"))
    summed = asked.groupBy("key").agg(F.min("least").alias("first"), F.max("most").alias("last"), F.count(F.lit(1)).alias("times"))
    shared = cut(summed.filter("first < last").select("key", "first", "times"))
    told = matched(asked.select("chunk", "key"), shared, "key", "times", asked.count(), "chunk").filter("first IS NOT NULL")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("key", "first")).alias("told")).select("chunk", F.col("told.key").alias("keys"), F.col("told.first").alias("least"))
    return chunks.join(told, "chunk").select("blob", "keys", "least").mapInArrow(run, "doc_id long, blob binary")


def split_spans(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, first) without overlap, by start: each word with the least first of the rows that hold it."""
    low = int(found[:, 0].min())
    least = np.full(int(found[:, 1].max()) - low + 1, np.iinfo(np.int64).max)
    for a, b, first in found.tolist():
        np.minimum(least[a - low : b - low], first, out=least[a - low : b - low])
    edges = np.flatnonzero(np.diff(least)) + 1
    spans = np.stack([np.r_[0, edges[:-1]], edges], 1)
    kept = least[spans[:, 0]] != np.iinfo(np.int64).max
    return np.column_stack([spans + low, least[spans[:, 0]]])[kept]


def _passages(stretches: DataFrame) -> DataFrame:
    """Passages of each document: doc_id, start_word, end_word, first_doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            spans = [split_spans(np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 3)) for blobs in batch.column(1).to_pylist()]
            doc = np.repeat(np.array(docs, np.int64), [len(x) for x in spans])
            a, b, first = np.concatenate([*spans, np.zeros((0, 3), np.int64)]).T
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.ascontiguousarray(first))], names=["doc_id", "start_word", "end_word", "first_doc_id"])

    by_doc = stretches.groupBy("doc_id").agg(F.collect_list("blob").alias("blobs"))
    return by_doc.mapInArrow(run, "doc_id long, start_word int, end_word int, first_doc_id long")


def _paragraph_sets(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(id, cell, copies, blocks, hashes) of members (doc_id, start_word, end_word, id, cell, blocks), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, places = _paragraphs(text, k)
                held = set(map(tuple, places.tolist()))
                shingles = _rolling(own, k)
                for w in wanted:
                    place = (w["start_word"], w["end_word"])
                    if place in held:  # a document id may have several texts
                        out.append((w["id"], w["cell"], 1, w["blocks"], np.unique(shingles[place[0] : place[1] - k + 1]).tobytes()))
            columns = zip(*out, strict=True) if out else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["id", "cell", "copies", "blocks", "hashes"])

    by_doc = members.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word", "id", "cell", "blocks")).alias("wanted")).withColumnRenamed("doc_id", "of")
    small = members.count() <= set_join.BROADCAST_ROWS
    found = texts.join(F.broadcast(by_doc) if small else by_doc, F.col("doc_id") == F.col("of")).select("text", "wanted")
    return found.mapInArrow(run, "id long, cell long, copies long, blocks int, hashes binary")


def paragraph_clusters(nodes: DataFrame, ties: DataFrame, texts: DataFrame, *, words: int, percent: int, cell_shingles: int = set_join.CELL_SHINGLES) -> DataFrame:
    """(node, cluster) of paragraph nodes with links; nodes: node, first (doc_id, start_word, end_word); ties: a, b."""
    cells = cut(connected_components(ties))
    members = nodes.select("node", "first.*").join(cells, "node")
    weights = set_join.cells_weights(members.select("component", (F.col("end_word") - F.col("start_word")).alias("n")), cell_shingles)
    members = cut(members.join(weights, "component").select("doc_id", "start_word", "end_word", F.col("node").alias("id"), F.col("component").alias("cell"), "blocks"))
    links = cut(set_join.join_cells(_paragraph_sets(members, texts, words), percent)).filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    return connected_components(links).select("node", F.col("component").alias("cluster"))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = set_join.WORDS, percent: int = set_join.PERCENT) -> DataFrame:
    """Passages that several documents hold: doc_id, kind (paragraph or passage), start_word, end_word (exclusive, of the
    words between ASCII white space), first_doc_id (smallest document of the cluster), removed (not in that document)."""
    if (own := numbered(docs, id_col, text_col)) is not None:
        return named(repeated_passages(own, id_col="row", words=words, percent=percent), own, "first_doc_id")
    total = docs.agg(F.sum(F.length(F.col(text_col)))).first()[0] or 0
    partitions = blob_partitions(total, LETTERS_PER_PARTITION)
    texts = id_and_bytes(docs, id_col, text_col).withColumn("doc_id", packed_id("doc_id"))
    reduced = cut(_reduced(_scan(texts, partitions, words, percent), partitions))
    found = reduced.filter(F.col("kind") == PLACES).select("doc_id", "start_word", "end_word", F.col("a").alias("node"))
    ties = reduced.filter(F.col("kind") == TIES).select("a", "b")
    nodes = cut(found.groupBy("node").agg(F.min(F.struct("doc_id", "start_word", "end_word")).alias("first"), F.max("doc_id").alias("last_doc_id"), F.count(F.lit(1)).alias("times")))
    clusters = cut(paragraph_clusters(nodes, ties, texts, words=words, percent=percent))
    placed = nodes.join(clusters, "node", "left").select("node", "times", F.col("first.doc_id").alias("first_doc_id"), "last_doc_id", "cluster", F.col("cluster").isNotNull().alias("linked"))
    linked = placed.filter("linked")  # connected_components() has a row for each node of a cluster
    ends = linked.groupBy("cluster").agg(F.min("first_doc_id").alias("first_doc_id"), F.max("last_doc_id").alias("last_doc_id"))
    linked = linked.select("node", "times", "cluster").join(ends, "cluster").select("node", "times", "first_doc_id", "last_doc_id")
    shared = linked.unionByName(placed.filter("NOT linked").select("node", "times", "first_doc_id", "last_doc_id")).filter("first_doc_id < last_doc_id")
    shared = cut(shared.select("node", "times", "first_doc_id"))
    rows = nodes.agg(F.sum("times")).first()[0] or 0
    whole = matched(found, shared, "node", "times", rows, "doc_id").filter("first_doc_id IS NOT NULL").select("doc_id", F.lit("paragraph").alias("kind"), "start_word", "end_word", "first_doc_id")
    windows = reduced.filter(F.col("kind") == WINDOWS).select("doc_id", "start_word", F.col("a").alias("hash"))
    heavy = cut(windows.groupBy("hash").count().filter(F.col("count") > HEAVY).select("hash"))
    n_heavy = heavy.count()  # one for each HEAVY windows at most
    rest = windows.join(F.broadcast(heavy) if n_heavy <= set_join.BROADCAST_ROWS else heavy, "hash", "left_anti") if n_heavy else windows
    near = blob_partitions(rest.count(), CONTEXTS_PER_PARTITION)
    found = _stretches(_contexts(rest, texts, near), near)
    if n_heavy:
        hot = windows.join(F.broadcast(heavy) if n_heavy <= set_join.BROADCAST_ROWS else heavy, "hash", "left_semi")
        found = found.unionByName(_by_keys(_contexts(hot, texts, 1)))
    parts = _passages(found).select("doc_id", F.lit("passage").alias("kind"), "start_word", "end_word", "first_doc_id")
    rows = whole.unionByName(parts).withColumn("removed", F.col("doc_id") != F.col("first_doc_id"))
    return rows.select(unpacked_id("doc_id"), "kind", "start_word", "end_word", unpacked_id("first_doc_id"), "removed")

"""OpenStreetMap PBF extracts as tables: nodes, ways, relations, and a zone map of their blocks.

A file is a row of frames (length, header, blob). Frames are found without decoding blobs; each partition decodes a run
of frames. Two ways in: the data source "osmpbf" for files on a mounted file system that driver and executors share
(any size), and from_binary() for files behind Spark's own readers (each under 2 GB).

Options of the source: path, entity (nodes, ways, relations), keys (comma separated; rows with none of them are
skipped before their values are decoded), prefixes (likewise), keep (the tags to keep), frames (per partition), window
(min_lat,max_lat,min_lon,max_lon: nodes; with a zone map in option `blocks`, other blocks are not read).

A path may be a folder of extracts. Comparisons of lat and lon in a query's filter reach the source of nodes as a window;
where the folder has a fresh zone map, see index_folder(), only blocks that meet the window are listed and read. write()
makes such a folder of nodes, one file a task.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMAS = {
    "nodes": "id long, lat double, lon double, tags map<string,string>, seq long",
    "ways": "id long, node_ids array<long>, tags map<string,string>, seq long",
    "relations": "id long, members array<struct<type:string,id:long,role:string>>, tags map<string,string>, seq long",
}
BLOCKS = "offset long, length long, min_lat double, max_lat double, min_lon double, max_lon double, node_count long"
MEMBER_TYPES = ("node", "way", "relation")
MOST_HEADER = 64 << 10


class FormatError(ValueError):
    """The bytes aren't a PBF extract."""


# --- protocol buffers ---

def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position) of an unsigned number of at most 64 bits."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise FormatError("truncated number")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if not b & 0x80:
            if value >> 64:
                raise FormatError("number overflows 64 bits")
            return value, at
        shift += 7
        if shift > 63:
            raise FormatError("number overflows 64 bits")


def signed(value: int) -> int:
    """Zigzag."""
    return (value >> 1) ^ -(value & 1)


def as_int64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: numbers, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise FormatError("truncated field")
            value, at = data[at : at + size], at + size
        else:
            raise FormatError(f"wire type {kind}")
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """Unsigned numbers that stand one behind the other."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = raw < 0x80
    if not last[-1]:
        raise FormatError("truncated number")
    ends = np.flatnonzero(last)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    if place.max() > 9:
        raise FormatError("number overflows 64 bits")
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def packed_signed(data: bytes) -> np.ndarray:
    u = packed(data)
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)


# --- frames and blobs ---

@dataclass(frozen=True)
class Frame:
    kind: str
    offset: int
    length: int


def opened(path: str):
    """A file to read from any place: a path, or a URI of a store that all executors reach (file, hdfs, s3, gs)."""
    if "://" not in path:
        return open(path, "rb")
    store, name = pa_fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def size_and_time(path: str) -> tuple[int, int]:
    """Size, and modification time in ns."""
    if "://" not in path:
        s = os.stat(path)
        return s.st_size, s.st_mtime_ns
    store, name = pa_fs.FileSystem.from_uri(path)
    info = store.get_file_info(name)
    return info.size, info.mtime_ns


def frames(path: str) -> Iterator[Frame]:
    """Every frame of a file: kind, and offset and length of its blob. The end is only clean between frames."""
    end = size_and_time(path)[0]
    with opened(path) as f:
        while head := f.read(4):
            if len(head) < 4:
                raise FormatError("truncated frame length")
            size = struct.unpack(">I", head)[0]
            if size > MOST_HEADER:
                raise FormatError(f"frame header of {size} bytes")
            kind, length = blob_header(f.read(size), size)
            at = f.tell()
            f.seek(min(at + length, end))
            if at + length > end:
                raise FormatError("truncated blob")
            yield Frame(kind, at, length)


def blob_header(data: bytes, size: int) -> tuple[str, int]:
    if len(data) < size:
        raise FormatError("truncated frame header")
    kind = length = None
    for n, v in fields(data):
        if n == 1:
            kind = v.decode()
        elif n == 3:
            length = v
    if kind is None or length is None:
        raise FormatError("frame header without type or size")
    return kind, length


def frames_of(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(kind, offset, blob) of a whole file in memory."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise FormatError("truncated frame length")
        size = struct.unpack_from(">I", data, at)[0]
        if size > MOST_HEADER:
            raise FormatError(f"frame header of {size} bytes")
        kind, length = blob_header(data[at + 4 : at + 4 + size], size)
        at += 4 + size
        if at + length > len(data):
            raise FormatError("truncated blob")
        yield kind, at, data[at : at + length]
        at += length


def unpack_blob(blob: bytes) -> bytes:
    """A blob's content: as it is, or zlib; other compressions are errors."""
    raw = size = packed_data = None
    for n, v in fields(blob):
        if n == 1:
            raw = v
        elif n == 2:
            size = v
        elif n == 3:
            packed_data = v
        elif n in (4, 5, 6, 7):
            raise FormatError("blob compression isn't supported")
    if raw is None:
        if packed_data is None:
            raise FormatError("blob without data")
        try:
            raw = zlib.decompress(packed_data)
        except zlib.error as e:
            raise FormatError(f"blob: {e}") from e
    if size is not None and packed_data is not None and size != len(raw):
        raise FormatError("blob size differs from its header")
    return raw


# --- blocks ---

@dataclass(frozen=True)
class Gate:
    """Which rows pass, by keys or prefixes of keys, and which tags are kept (all if none are named)."""

    keys: frozenset[str] = frozenset()
    prefixes: tuple[str, ...] = ()
    keep: frozenset[str] = frozenset()

    def passes(self, names: list[str]) -> bool:
        return not (self.keys or self.prefixes) or any(n in self.keys or n.startswith(self.prefixes or ("\0",)) for n in names)

    def tags(self, pairs: list[tuple[str, str]]) -> dict[str, str]:
        """Of equal keys the last wins."""
        return {k: v for k, v in pairs if not self.keep or k in self.keep or (self.prefixes and k.startswith(self.prefixes))}


class Block:
    """A decoded primitive block."""

    def __init__(self, data: bytes):
        self.strings, self.groups = [], []
        self.granularity, self.lat0, self.lon0 = 100, 0, 0
        for n, v in fields(data):
            if n == 1:
                self.strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
            elif n == 2:
                self.groups.append(v)
            elif n == 17:
                self.granularity = v
            elif n == 19:
                self.lat0 = as_int64(v)
            elif n == 20:
                self.lon0 = as_int64(v)

    def degrees(self, value, offset: int):
        return (offset + self.granularity * value) / 1e9

    def text(self, index: int) -> str | None:
        return self.strings[index] if 0 <= index < len(self.strings) else None

    def pairs(self, keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
        return list(zip(keys.tolist(), values.tolist(), strict=False))

    def tagged(self, pairs: list[tuple[int, int]], gate: Gate) -> dict[str, str] | None:
        """The tags of a row that passes; pairs outside the string table are skipped."""
        names = [(k, v) for k, v in ((self.text(a), b) for a, b in pairs) if k is not None]
        if not gate.passes([k for k, _ in names]):
            return None
        return gate.tags([(k, t) for k, v in names if (t := self.text(v)) is not None])

    def nodes(self, gate: Gate) -> Iterator[tuple]:
        for group in self.groups:
            for n, v in fields(group):
                if n == 1:
                    yield from self._plain(v, gate)
                elif n == 2:
                    yield from self._dense(v, gate)

    def _plain(self, data: bytes, gate: Gate) -> Iterator[tuple]:
        f: dict = {2: b"", 3: b""}
        for n, v in fields(data):
            f[n] = v
        tags = self.tagged(self.pairs(packed(f[2]), packed(f[3])), gate)
        if tags is not None:
            yield signed(f.get(1, 0)), self.degrees(signed(f.get(8, 0)), self.lat0), self.degrees(signed(f.get(9, 0)), self.lon0), tags

    def _dense(self, data: bytes, gate: Gate) -> Iterator[tuple]:
        f = {1: b"", 8: b"", 9: b"", 10: b""} | dict(fields(data))
        ids, lat, lon = (np.cumsum(packed_signed(f[k])) for k in (1, 8, 9))
        if not len(ids) == len(lat) == len(lon):
            raise FormatError("dense nodes of different lengths")
        lat, lon = self.degrees(lat, self.lat0).tolist(), self.degrees(lon, self.lon0).tolist()
        codes, at = packed(f[10]).tolist(), 0
        for i, node in enumerate(ids.tolist()):
            pairs = []
            while at < len(codes) and codes[at]:
                if at + 1 >= len(codes):
                    raise FormatError("key without a value")
                pairs.append((codes[at], codes[at + 1]))
                at += 2
            at += 1
            tags = self.tagged(pairs, gate)
            if tags is not None:
                yield node, lat[i], lon[i], tags

    def ways(self, gate: Gate) -> Iterator[tuple]:
        """Ways with tags."""
        for f in self._messages(3):
            pairs = self.pairs(packed(f.get(2, b"")), packed(f.get(3, b"")))
            tags = self.tagged(pairs, gate) if pairs else None
            if tags is not None:
                yield as_int64(f.get(1, 0)), np.cumsum(packed_signed(f.get(8, b""))).tolist(), tags

    def relations(self, gate: Gate) -> Iterator[tuple]:
        """Relations; members of unknown types are skipped, as is what has no type, id or role of its own."""
        for f in self._messages(4):
            tags = self.tagged(self.pairs(packed(f.get(2, b"")), packed(f.get(3, b""))), gate)
            if tags is None:
                continue
            ids = np.cumsum(packed_signed(f.get(9, b""))).tolist()
            roles, kinds = packed(f.get(8, b"")).tolist(), packed(f.get(10, b"")).tolist()
            members = [(MEMBER_TYPES[k], i, self.text(r) or "") for r, i, k in zip(roles, ids, kinds, strict=False) if k < len(MEMBER_TYPES)]
            yield as_int64(f.get(1, 0)), members, tags

    def _messages(self, number: int) -> Iterator[dict]:
        for group in self.groups:
            for n, v in fields(group):
                if n == number:
                    yield dict(fields(v))


def rows_of(blob: bytes, entity: str, gate: Gate, first: int, window: tuple[float, ...] | None = None) -> Iterator[tuple]:
    """A block's rows, numbered from `first` on."""
    for k, row in enumerate(getattr(Block(unpack_blob(blob)), entity)(gate)):
        if window is None or entity != "nodes" or (window[0] <= row[1] <= window[1] and window[2] <= row[2] <= window[3]):
            yield (*row, first + k)


def _gate(options: dict) -> Gate:
    split = lambda k: [x.strip() for x in options.get(k, "").split(",") if x.strip()]
    return Gate(frozenset(split("keys")), tuple(split("prefixes")), frozenset(split("keep")))


# --- Spark ---

class Run(InputPartition):
    def __init__(self, path: str, frames: list[tuple[int, int]]):
        self.path, self.frames = path, frames


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.entity = options["path"], options.get("entity", "nodes")
        self.gate, self.per_run = _gate(options), int(options.get("frames", "16"))
        self.window = tuple(map(float, options["window"].split(","))) if options.get("window") else None
        self.known = {tuple(map(int, b.split(":"))) for b in options["blocks"].split(",")} if options.get("blocks") else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of lat and lon narrow the window; Spark still tests all filters on what is read."""
        if self.entity == "nodes":
            low, high = {}, {}
            for f in filters:
                name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
                if name in ("lat", "lon") and isinstance(getattr(f, "value", None), float | int):
                    if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                        low[name] = max(low.get(name, f.value), f.value)
                    if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                        high[name] = min(high.get(name, f.value), f.value)
            if low or high:
                own = self.window or (-90.0, 90.0, -180.0, 180.0)
                self.window = (max(own[0], low.get("lat", own[0])), min(own[1], high.get("lat", own[1])), max(own[2], low.get("lon", own[2])), min(own[3], high.get("lon", own[3])))
        yield from filters

    def partitions(self) -> list[InputPartition]:
        runs: list[InputPartition] = []
        zones = zone_map(self.path, self.window) if self.entity == "nodes" and self.window else None
        for path in files_of(self.path):
            found = zones.get(path, []) if zones is not None else [(f.offset, f.length) for f in frames(path) if f.kind == "OSMData"]
            if self.known is not None:
                found = [f for f in found if f in self.known]
            runs += [Run(path, found[k : k + self.per_run]) for k in range(0, len(found), self.per_run)]
        return runs or [Run(self.path, [])]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not partition.frames:
            return
        with opened(partition.path) as f:
            for offset, length in partition.frames:
                f.seek(offset)
                yield from rows_of(f.read(length), self.entity, self.gate, offset << 20, self.window)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class PbfWriter(DataSourceWriter):
    """Nodes (id, lat, lon, tags) as one file a task. Files get their names when all tasks are done."""

    def __init__(self, options: dict):
        self.path, self.per_block = options["path"], int(options.get("block", "8000"))
        self.store, self.folder = pa_fs.FileSystem.from_uri(self.path) if "://" in self.path else (None, self.path)

    def _store(self) -> pa_fs.FileSystem:
        return self.store or pa_fs.LocalFileSystem()

    def write(self, rows: Iterator) -> Written:
        name = f"{self.folder}/_part-{uuid.uuid4().hex}"
        self._store().create_dir(self.folder, recursive=True)
        with self._store().open_output_stream(name) as out:
            out.write(encoded_frame("OSMHeader", b""))
            held: list[tuple] = []
            for row in rows:
                held.append((row.id, row.lat, row.lon, row.tags or {}))
                if len(held) >= self.per_block:
                    out.write(encoded_frame("OSMData", encoded_nodes(held)))
                    held = []
            if held:
                out.write(encoded_frame("OSMData", encoded_nodes(held)))
        return Written([name])

    def commit(self, messages: list) -> None:
        for k, name in enumerate(sorted(n for m in messages if m for n in m.files)):
            self._store().move(name, f"{self.folder}/part-{k:05d}-{name[-8:]}.osm.pbf")

    def abort(self, messages: list) -> None:
        for name in (n for m in messages if m for n in m.files):
            self._store().delete_file(name)


class PbfSource(DataSource):
    """spark.read.format("osmpbf"); register with spark.dataSource.register(PbfSource)."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("entity", "nodes")]

    def reader(self, schema) -> PbfReader:
        return PbfReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PbfWriter:
        return PbfWriter(dict(self.options))


def read(spark: SparkSession, path: str, entity: str = "nodes", **options: str) -> DataFrame:
    """The rows of an entity; switches the pushdown of filters to Python sources on for the session."""
    spark.dataSource.register(PbfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("osmpbf").option("entity", entity).options(**options).load(path)


def write(nodes: DataFrame, path: str, *, files: int, block: int = 8000) -> None:
    """nodes (id, lat, lon, tags) as a folder of `files` extracts, near ones together, so that zone maps can tell them apart."""
    spark = nodes.sparkSession
    spark.dataSource.register(PbfSource)
    near = nodes.select("id", "lat", "lon", "tags").withColumn("y", F.floor(F.col("lat") * 20)).withColumn("x", F.floor(F.col("lon") * 20))
    near.repartitionByRange(files, "y", "x").sortWithinPartitions("y", "x", "id").select("id", "lat", "lon", "tags").write.format("osmpbf").option("block", block).mode("append").save(path)


def from_binary(spark: SparkSession, path: str, entity: str = "nodes", **options: str) -> DataFrame:
    """As read(), of files that only Spark's readers reach."""
    gate = _gate(options)

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in SCHEMAS[entity].replace("map<string,string>", "m").replace("array<struct<type:string,id:long,role:string>>", "a").split(", ")]
        for batch in batches:
            rows = [row for content in batch.content for kind, at, blob in frames_of(content) if kind == "OSMData" for row in rows_of(blob, entity, gate, at << 20)]
            yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMAS[entity])


# --- encoding ---

def _number(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    return _number(number << 3) + _number(value) if isinstance(value, int) else _number(number << 3 | 2) + _number(len(value)) + value


def _deltas(values: Iterable[int]) -> bytes:
    out, last = bytearray(), 0
    for v in values:
        d, last = v - last, v
        out += _number((d << 1) ^ (d >> 63))
    return bytes(out)


def encoded_nodes(rows: list[tuple]) -> bytes:
    """A block of dense nodes (id, lat, lon, tags) in units of 100 nanodegrees."""
    strings: dict[str, int] = {"": 0}
    pairs = bytearray()
    for _, _, _, tags in rows:
        for text in (t for pair in tags.items() for t in pair):
            pairs += _number(strings.setdefault(text, len(strings)))
        pairs += _number(0)
    dense = _field(1, _deltas(r[0] for r in rows)) + _field(8, _deltas(round(r[1] * 1e7) for r in rows)) + _field(9, _deltas(round(r[2] * 1e7) for r in rows)) + _field(10, bytes(pairs))
    return _field(1, b"".join(_field(1, t.encode()) for t in strings)) + _field(2, _field(2, dense))


def encoded_frame(kind: str, content: bytes) -> bytes:
    blob = _field(2, len(content)) + _field(3, zlib.compress(content))
    head = _field(1, kind.encode()) + _field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


# --- zone map ---

ZONES = "_zone_map"


def files_of(path: str) -> list[str]:
    """The extracts at a path: itself, or those in a folder, by name."""
    store, name = pa_fs.FileSystem.from_uri(path) if "://" in path else (pa_fs.LocalFileSystem(), path)
    if store.get_file_info(name).type != pa_fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in store.get_file_info(pa_fs.FileSelector(name)) if i.type == pa_fs.FileType.File and i.base_name.endswith(".pbf"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def index_folder(spark: SparkSession, path: str) -> str:
    """Writes the zone map of a folder of extracts as Parquet into it. Files are listed and read by tasks."""
    columns = f"file string, {BLOCKS}, source_size long, source_mtime_ns long"

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for file in batch.file:
                size, changed = size_and_time(file)
                with opened(file) as f:
                    for frame in [x for x in frames(file) if x.kind == "OSMData"]:
                        f.seek(frame.offset)
                        nodes = [(n[1], n[2]) for n in Block(unpack_blob(f.read(frame.length))).nodes(Gate())]
                        if nodes:
                            lat, lon = zip(*nodes, strict=True)
                            out.append((file.rsplit("/", 1)[-1], frame.offset, frame.length, min(lat), max(lat), min(lon), max(lon), len(nodes), size, changed))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])

    names = files_of(path)
    found = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names))).mapInPandas(run, columns)
    found.write.mode("overwrite").parquet(f"{path}/{ZONES}")
    return f"{path}/{ZONES}"


def zone_map(path: str, window: tuple[float, ...]) -> dict[str, list[tuple[int, int]]] | None:
    """The blocks (offset, length) of each file that may have nodes in the window; None without a zone map of the files as
    they are now."""
    store, name = pa_fs.FileSystem.from_uri(path) if "://" in path else (pa_fs.LocalFileSystem(), path)
    if store.get_file_info(f"{name}/{ZONES}").type != pa_fs.FileType.Directory:
        return None
    table = pq.read_table(f"{name}/{ZONES}", filesystem=store)
    sources = set(zip(*(table.column(c).to_pylist() for c in ("file", "source_size", "source_mtime_ns")), strict=True))
    if {(f.rsplit("/", 1)[-1], *size_and_time(f)) for f in files_of(path)} != sources:
        return None
    out: dict[str, list[tuple[int, int]]] = {}
    for r in table.to_pylist():
        if r["min_lat"] <= window[1] and r["max_lat"] >= window[0] and r["min_lon"] <= window[3] and r["max_lon"] >= window[2]:
            out.setdefault(f"{path.rstrip('/')}/{r['file']}", []).append((r["offset"], r["length"]))
    return {f: sorted(blocks) for f, blocks in out.items()}


def index_path(path: str) -> str:
    """Where a file's zone map lies: europe.osm.pbf and region.pbf -> europe.idx, region.idx."""
    for ending in (".osm.pbf", ".pbf"):
        if path.endswith(ending):
            return path[: -len(ending)] + ".idx"
    return path + ".idx"


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """BLOCKS: where each block of nodes lies and how far its nodes reach."""
    found = [(f.offset, f.length) for f in frames(path) if f.kind == "OSMData"]

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            with opened(path) as f:
                for offset, length in zip(batch.offset, batch.length, strict=True):
                    f.seek(offset)
                    nodes = [(n[1], n[2]) for n in Block(unpack_blob(f.read(length))).nodes(Gate())]
                    if nodes:
                        lat, lon = zip(*nodes, strict=True)
                        out.append((offset, length, min(lat), max(lat), min(lon), max(lon), len(nodes)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return spark.createDataFrame(found, "offset long, length long").repartition(max(1, len(found) // 16)).mapInPandas(run, BLOCKS)


def fingerprint(path: str) -> tuple[int, int, str]:
    """(size, modification time in ns, SHA-256) of a file."""
    digest = hashlib.sha256()
    with opened(path) as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return *size_and_time(path), digest.hexdigest()


def write_index(spark: SparkSession, path: str) -> str:
    """Writes the zone map beside the file as Parquet, with the file's fingerprint in each row."""
    size, changed, digest = fingerprint(path)
    block_index(spark, path).select("*", F.lit(size).cast("long").alias("source_size"), F.lit(changed).cast("long").alias("source_mtime_ns"), F.lit(digest).alias("source_sha256")).coalesce(1).write.mode("overwrite").parquet(index_path(path))
    return index_path(path)


def is_fresh(index: DataFrame, path: str) -> bool:
    """Whether a zone map still belongs to the file as it is."""
    row = index.select("source_size", "source_mtime_ns").first()
    return row is not None and (row.source_size, row.source_mtime_ns) == size_and_time(path)


def blocks_for(index: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """The blocks that may have nodes in the window; none for a window without an inside."""
    if not (window[0] < window[1] and window[2] < window[3]):
        return index.limit(0)
    return index.filter((F.col("min_lat") <= window[1]) & (F.col("max_lat") >= window[0]) & (F.col("min_lon") <= window[3]) & (F.col("max_lon") >= window[2]))

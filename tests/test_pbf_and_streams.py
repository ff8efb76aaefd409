"""PBF bytes encoded by hand, zone maps, graph files and streams."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from geoweft.plans.views import zones
from geoweft.sources import files, pbf
from geoweft.streaming import live


def number(n):
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def zigzag(n):
    return (n << 1) ^ (n >> 63)


def part(field, value):
    if isinstance(value, int):
        return number(field << 3) + number(value)
    return number(field << 3 | 2) + number(len(value)) + value


def pack(values):
    return b"".join(map(number, values))


def deltas(values):
    return pack(zigzag(b - a) for a, b in zip([0, *values], values))


def block(strings, *groups):
    return part(1, b"".join(part(1, s.encode()) for s in ["", *strings])) + b"".join(part(2, g) for g in groups)


def frame(kind, content, packed=True):
    blob = part(2, len(content)) + part(3, zlib.compress(content)) if packed else part(1, content)
    head = part(1, kind.encode()) + part(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def unit(degrees):
    return round(degrees * 1e7)


def plain(i, lat, lon, keys, values):
    return part(1, part(1, zigzag(i)) + part(2, pack(keys)) + part(3, pack(values)) + part(8, zigzag(unit(lat))) + part(9, zigzag(unit(lon))))


def dense(rows, keys_vals):
    return part(2, part(1, deltas([r[0] for r in rows])) + part(8, deltas([unit(r[1]) for r in rows])) + part(9, deltas([unit(r[2]) for r in rows])) + part(10, pack(keys_vals)))


@pytest.fixture
def extract(tmp_path):
    strings = ["amenity", "cafe", "addr:housenumber", "7", "charging_station", "name", "x", "parking", "type", "multipolygon", "inner"]
    one = block(strings, plain(101, 48.0, 11.0, [1, 3], [2, 4]), dense([(202, 48.1, 11.1), (203, 48.2, 11.2), (204, 48.3, 11.3)], [1, 5, 0, 6, 7, 0, 6, 7, 1, 2, 0]))
    way = part(1, 301) + part(2, pack([1])) + part(3, pack([8])) + part(8, deltas([101, 202, 101]))
    bare = part(1, 302) + part(8, deltas([101]))
    relation = part(1, 401) + part(2, pack([9])) + part(3, pack([10])) + part(8, pack([11, 0, 11])) + part(9, deltas([301, 101, 5])) + part(10, pack([1, 0, 9]))
    two = block(strings, part(3, way) + part(3, bare), part(4, relation))
    three = block([], dense([(1, 52.52, 13.405)], []))
    path = tmp_path / "map.osm.pbf"
    path.write_bytes(frame("OSMHeader", b"") + frame("OSMData", one) + frame("Other", b"?") + frame("OSMData", two, packed=False) + frame("OSMData", three))
    return path


def test_entities(spark, extract):
    for read in (pbf.read, pbf.from_binary):
        nodes = {r.id: r for r in read(spark, str(extract)).collect()}
        assert set(nodes) == {101, 202, 203, 204, 1}
        assert nodes[101].tags == {"amenity": "cafe", "addr:housenumber": "7"} and nodes[203].tags == {"name": "x"}
        assert (nodes[202].lat, nodes[202].lon, nodes[1].lat) == pytest.approx((48.1, 11.1, 52.52))
        ways = read(spark, str(extract), "ways").collect()
        assert [(w.id, w.node_ids, w.tags) for w in ways] == [(301, [101, 202, 101], {"amenity": "parking"})]
        rel = read(spark, str(extract), "relations").collect()
        assert [tuple(m) for m in rel[0].members] == [("way", 301, "inner"), ("node", 101, "")] and rel[0].tags == {"type": "multipolygon"}
    seq = [r.seq for r in pbf.read(spark, str(extract)).orderBy("id").collect()]
    assert len(set(seq)) == 5


def test_gates(spark, extract):
    gated = {r.id: r.tags for r in pbf.read(spark, str(extract), keys="amenity", keep="name").collect()}
    assert gated == {101: {}, 202: {}, 204: {"name": "x"}}
    assert {r.id for r in pbf.read(spark, str(extract), prefixes="addr:").collect()} == {101}
    assert pbf.read(spark, extract.as_uri(), prefixes="addr:").count() == 1 and pbf.size_and_time(extract.as_uri()) == pbf.size_and_time(str(extract))
    assert {r.id for r in pbf.read(spark, str(extract), window="48.0,48.15,11.0,11.2").collect()} == {101, 202}


def test_zone_map(spark, extract):
    index = spark.read.parquet(pbf.write_index(spark, str(extract)))
    assert pbf.index_path(str(extract)).endswith("map.idx") and pbf.index_path("/m/r.pbf") == "/m/r.idx"
    rows = index.orderBy("offset").collect()
    assert [r.node_count for r in rows] == [4, 1] and len(rows[0].source_sha256) == 64
    hit = pbf.blocks_for(index, (48.0, 48.3, 10.0, 12.0)).collect()
    assert [r.node_count for r in hit] == [4]
    blocks = ",".join(f"{r.offset}:{r.length}" for r in hit)
    assert {r.id for r in pbf.read(spark, str(extract), blocks=blocks).collect()} == {101, 202, 203, 204}
    assert pbf.blocks_for(index, (0.0, 0.0, 0.0, 0.0)).count() == 0
    assert pbf.is_fresh(index, str(extract))
    with open(extract, "ab") as f:
        f.write(b"\0")
    assert not pbf.is_fresh(index, str(extract))


def test_filters_reach_the_blocks(spark, tmp_path):
    """Written, indexed and read by a filter: only blocks that meet the window are read; a changed file makes the map stale."""
    rows = [(i, 48 + i % 50 / 100, 12 + i // 50 / 100, {"n": str(i)} if i % 2 else None) for i in range(1000)]
    nodes = spark.createDataFrame(rows, "id long, lat double, lon double, tags map<string,string>")
    path = str(tmp_path / "world")
    pbf.write(nodes, path, files=3, block=50)
    assert len(pbf.files_of(path)) == 3 and not [f for f in (tmp_path / "world").iterdir() if f.name.startswith("_part")]
    whole = {(r.id, round(r.lat, 7), round(r.lon, 7)): r.tags for r in pbf.read(spark, path).collect()}
    assert whole == {(i, round(a, 7), round(o, 7)): t or {} for i, a, o, t in rows}
    inside = (F.col("lat") > 48.1) & (F.col("lat") <= 48.2) & (F.col("lon") >= 12.05) & (F.col("lon") < 12.1)
    want = {i for i, a, o, _ in rows if 48.1 < round(a, 7) <= 48.2 and 12.05 <= round(o, 7) < 12.1}
    blocks = lambda: pbf.read(spark, path, frames="1").filter(inside).rdd.getNumPartitions()
    every = blocks()
    index = spark.read.parquet(pbf.index_folder(spark, path))
    assert index.count() == every and index.agg(F.sum("node_count")).first()[0] == 1000
    assert {r.id for r in pbf.read(spark, path).filter(inside).collect()} == want and len(want) > 20
    assert blocks() < every / 2 and pbf.read(spark, path, frames="1").filter("lat > 80").rdd.getNumPartitions() == 1
    with open(pbf.files_of(path)[0], "ab") as f:
        f.write(pbf.encoded_frame("OSMData", pbf.encoded_nodes([(5000, 48.15, 12.07, {})])))
    assert blocks() == every + 1 and {r.id for r in pbf.read(spark, path).filter(inside).collect()} == want | {5000}


@pytest.mark.parametrize("data", [b"\0\0", struct.pack(">I", 1 << 20), frame("OSMData", b"")[:-1], struct.pack(">I", 2) + part(3, 1)])
def test_bad_frames(tmp_path, data):
    (tmp_path / "bad.pbf").write_bytes(data)
    with pytest.raises(pbf.FormatError):
        list(pbf.frames(str(tmp_path / "bad.pbf")))
    with pytest.raises(pbf.FormatError):
        list(pbf.frames_of(data))


def test_bad_blobs():
    for blob in (part(4, b"x"), part(2, 3), part(2, 9) + part(3, zlib.compress(b"abc")), part(3, b"no zlib")):
        with pytest.raises(pbf.FormatError):
            pbf.unpack_blob(blob)
    with pytest.raises(pbf.FormatError, match="64 bits"):
        pbf.varint(b"\xff" * 10, 0)
    with pytest.raises(pbf.FormatError):
        pbf.packed(b"\x80")
    assert pbf.packed_signed(pack(zigzag(n) for n in (0, -1, 5, -(1 << 62)))).tolist() == [0, -1, 5, -(1 << 62)]


def test_graph_files(spark, tmp_path):
    doc = {"nodes": [{"id": 1, "lat": 48.0, "lon": 12.0}, {"id": 2, "lat": 48.1, "lon": 12.0}], "edges": [{"from": 1, "to": 2, "dist_m": 5.0, "speed_kph": 30.0}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    v, e = files.read_graph_json(spark, str(tmp_path / "g.json"))
    assert v.count() == 2 and tuple(e.first()) == (1, 2, 5.0, 30.0, 0.0, 0.0, "")
    files.write_graph_json(v, e, str(tmp_path / "out"))
    again = files.read_graph_json(spark, str(tmp_path / "out"))
    assert again[0].collect() == v.collect() and again[1].collect() == e.collect()
    (tmp_path / "wide.json").write_text(json.dumps(doc, indent=1))
    assert files.read_graph_json(spark, str(tmp_path / "wide.json"))[0].count() == 2
    files.write_pois(v, str(tmp_path / "poi"))
    assert files.read_pois(spark, str(tmp_path / "poi")).count() == 2
    with pytest.raises(ValueError, match="version 2"):
        files.read_pois(spark, str(tmp_path / "poi"), 2)
    (tmp_path / "s.json").write_text('{"highway_speeds": {"motorway": 120}, "allowed_highways": [" Primary "], "window": [48, 49, 11, 12]}')
    s = files.read_settings(spark, str(tmp_path / "s.json"))
    assert s.highway_speeds == {"motorway": 120} and s.allowed_highways == ("primary",) and s.window == (48, 49, 11, 12)


def run(spark, tmp_path, df, schema, parts, build, mode):
    src = tmp_path / "in"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = build(stream).writeStream.format("memory").queryName(df).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(df).collect()


def test_geofence_stream(spark, tmp_path):
    from datetime import datetime

    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    parts = [[("v", t(1), 48.65, 12.0), ("v", t(2), 48.65, 12.65)], [("v", t(3), 48.65, 12.65), ("v", t(4), 48.65, 12.85), ("w", t(4), 0.0, 0.0)], [("v", t(5), 0.0, 0.0)]]
    rows = run(spark, tmp_path, "fence", "vehicle string, ts timestamp, lat double, lon double", parts, lambda s: live.geofence(s, zones(spark)), "append")
    assert sorted((r.ts.second, r.event, r.territory_id) for r in rows) == [(2, "enter", "Zone-1"), (4, "enter", "Zone-2"), (4, "leave", "Zone-1"), (5, "leave", "Zone-2")]


def test_session_stream(spark, tmp_path):
    from datetime import datetime

    parts = [[("s", datetime(2024, 1, 1, 0, k, j), f"{k}.{j}") for j in range(3)] for k in range(2)]
    rows = run(spark, tmp_path, "log", "session string, ts timestamp, text string", parts, lambda s: live.session_log(s, 4), "update")
    assert rows[-1].log == ["0.2", "1.0", "1.1", "1.2"]


def test_locate_is_the_batch_join(spark):
    from geoweft.operators import territory

    p = spark.range(3000).select(F.col("id").cast("string").alias("vehicle"), "id", F.current_timestamp().alias("ts"), (48.2 + (F.col("id") * 71 % 199) * 0.005).alias("lat"), (12.5 + (F.col("id") * 31 % 193) * 0.005).alias("lon"))
    e = territory.edges_of(zones(spark))
    one = {(r.id, r.territory_id) for r in live.locate(p, e).filter("territory_id IS NOT NULL").collect()}
    assert one == {(r.id, r.territory_id) for r in territory.find_territory(p, e).collect()}

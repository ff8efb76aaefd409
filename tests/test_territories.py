"""Territories, dispatch and GeoJSON on the fixture zones."""

import json

import pytest
from pyspark.sql import functions as F

from geoweft.functions.text import property_string
from geoweft.operators import dispatch, territory
from geoweft.plans.views import zones
from geoweft.sources import files


def square(lat0, lon0, lat1, lon1):
    a, b, c, d = map(float, (lat0, lon0, lat1, lon1))
    return [(a, b), (a, d), (c, d), (c, b), (a, b)]


def layer(spark, **shapes):
    """One territory for each name: a list of (outer, holes)."""
    rows = [("t", k, k, {}, polys) for k, polys in shapes.items()]
    return territory.edges_of(spark.createDataFrame(rows, f"layer string, territory_id string, name string, props map<string,string>, geometry {territory.GEOMETRY}"))


def at(spark, edges, *points):
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, lat double, lon double")
    found = {r.id: r.territory_id for r in territory.find_territory(rows, edges).collect()}
    return [found.get(i) for i in range(len(points))]


def test_polygons(spark):
    assert at(spark, layer(spark, a=[(square(0, 0, 10, 10), [])]), (5, 5), (20, 20), (0, 5), (0, 0)) == ["a", None, "a", "a"]
    assert at(spark, layer(spark, a=[(square(0, 0, 10, 10), []), (square(20, 20, 30, 30), [])]), (25, 25), (15, 15)) == ["a", None]
    holed = layer(spark, a=[(square(0, 0, 10, 10), [square(4, 4, 6, 6)])])
    assert at(spark, holed, (1, 1), (5, 5), (4, 5)) == ["a", None, "a"]  # a hole's edge is inside
    open_ring = layer(spark, a=[(square(0, 0, 10, 10)[:4], [])])
    assert at(spark, open_ring, (5, 5), (5, 11)) == ["a", None]


def test_overlap_takes_least_id(spark):
    both = layer(spark, b=[(square(0, 0, 10, 10), [])], a=[(square(5, 5, 15, 15), [])])
    assert at(spark, both, (7, 7), (2, 2)) == ["a", "b"]
    rows = spark.createDataFrame([(0, 7.0, 7.0)], "id long, lat double, lon double")
    assert {r.territory_id for r in territory.find_territories(rows, both).collect()} == {"a", "b"}


def test_zones(spark):
    edges = territory.edges_of(zones(spark))
    assert at(spark, edges, (48.65, 12.65), (48.65, 12.85), (48.35, 13.3), (0, 0), (48.98, 13.0)) == ["Zone-1", "Zone-2", "Zone-2", None, "Zone-3"]
    near = {(r.territory_id, r.neighbor) for r in territory.neighbors(edges).collect()}
    assert near == {("Zone-1", "Zone-2"), ("Zone-2", "Zone-1")}
    far = {(r.territory_id, r.neighbor): r.dist_m for r in territory.neighbors(edges, 40_000).collect()}
    assert far["Zone-1", "Zone-3"] == pytest.approx(27953.261, abs=0.01)


def test_policies(spark):
    edges = territory.edges_of(zones(spark))
    out = spark.createDataFrame([("P-out", 0.0, 0.0)], "id string, lat double, lon double")
    assert territory.assign(out, edges).first().territory_id is None
    assert territory.assign(out, edges, "nearest").first().territory_id in {"Zone-1", "Zone-2", "Zone-3"}
    assert territory.assign(out, edges, "fallback:Zone-3").first().territory_id == "Zone-3"
    with pytest.raises(Exception, match="no territory"):
        territory.assign(out, edges, "error").collect()
    with pytest.raises(ValueError, match="fallback"):
        territory.assign(out, edges, "fallback:none")
    with pytest.raises(ValueError, match="policy"):
        territory.assign(out, edges, "other")


def test_many_points(spark):
    points = spark.range(20_000).select("id", (48.2 + (F.col("id") % 200) * 0.005).alias("lat"), (12.5 + (F.floor(F.col("id") / 200) % 200) * 0.005).alias("lon"))
    rows = territory.assign(points, territory.edges_of(zones(spark)))
    assert rows.count() == 20_000 and rows.filter("territory_id IS NOT NULL").count() > 0


def test_include_and_manifests(spark):
    parcels = spark.createDataFrame([("P001", 48.65, 12.65, 0), ("P002", 48.62, 12.85, 1), ("P003", 48.98, 13.0, 2), ("P004", 40.0, 10.0, 3)], "id string, lat double, lon double, row_ord long")
    z = zones(spark)
    assigned = territory.assign(parcels, territory.edges_of(z))
    rows = {r.id: r for r in dispatch.include_properties(assigned, z, ["territory_id", "depot", "vehicle"]).collect()}
    assert (rows["P001"].depot, rows["P001"].vehicle) == ("Depot-Passau", "VAN-01")
    assert rows["P002"].depot == "Depot-Freyung|Depot-Passau" and rows["P004"].depot == ""
    groups = {r.id: r.manifest for r in dispatch.manifest_groups(assigned, z, "vehicle").collect()}
    assert groups == {"P001": "VAN-01", "P002": "VAN-02", "P003": "VAN-03", "P004": "UNASSIGNED"}


def test_vehicle_constraint(spark):
    v = spark.createDataFrame([("v", {"territory_id": "Zone-1"})], "vehicle string, props map<string,string>")
    s = spark.createDataFrame([("near", "Zone-1"), ("far", "Zone-3")], "shipment string, territory_id string")
    assert [(r.shipment, r.cost) for r in dispatch.compatible(v, s).collect()] == [("near", 0.0)]


def path(spark, *points):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(points)], "qid long, pos long, lat double, lon double")


def test_path_events(spark):
    edges = layer(spark, west=[(square(0, 0, 10, 5), [])], east=[(square(0, 5, 10, 10), [])])
    rows = territory.path_events(path(spark, *[(5, x) for x in (-1, 1, 4, 6, 9, 11)]), edges).orderBy("event").collect()
    assert [r.territory_id for r in rows] == ["west", "east"]
    assert rows[0].entered_km < rows[0].left_km <= rows[1].entered_km < rows[1].left_km
    far = layer(spark, far=[(square(50, 50, 60, 60), [])])
    assert territory.path_events(path(spark, (0, 0), (1, 1), (2, 2)), far).count() == 0
    inside = territory.path_events(path(spark, (5, 1), (5, 2)), edges).collect()
    assert len(inside) == 1 and inside[0].entered_km == 0 and inside[0].left_km > 100


def test_cost_factors(spark):
    edges = layer(spark, home=[(square(0, 0, 10, 10), [])], next=[(square(0, 10, 10, 20), [])], far=[(square(100, 100, 110, 110), [])])
    v = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 15.0), (3, 105.0, 105.0), (4, 50.0, 50.0)], "id long, lat double, lon double")
    got = {r.id: r.factor for r in territory.cost_factors(v, edges, "home", same=1.0, neighbor=1.1, foreign=1.5).collect()}
    assert got == {1: 1.0, 2: 1.1, 3: 1.5, 4: 1.0}


def test_geojson_round_trip(spark, tmp_path):
    z = zones(spark)
    text = files.to_geojson(z).first().geojson
    doc = json.loads(text)
    assert [f["properties"]["territory_id"] for f in doc["features"]] == ["Zone-1", "Zone-2", "Zone-3"]
    assert {f["geometry"]["type"] for f in doc["features"]} == {"MultiPolygon"}
    (tmp_path / "delivery.geojson").write_text(text)
    (tmp_path / "bad.geojson").write_text("{not json")
    back = files.read_geojson(spark, str(tmp_path))
    assert {(r.layer, r.territory_id) for r in back.collect()} == {("delivery", f"Zone-{i}") for i in (1, 2, 3)}
    assert at(spark, territory.edges_of(back), (48.65, 12.65)) == ["Zone-1"]
    assert {r.key for r in territory.property_keys(back).collect()} == {"depot", "vehicle", "technician", "territory_id"}


def test_geojson_ids(spark, tmp_path):
    ring = [[12.6, 48.6], [12.7, 48.6], [12.7, 48.7], [12.6, 48.6]]
    feature = lambda props: {"type": "Feature", "properties": props, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    props = [{"postcode": "84130", "z": 1}, {"id": 7}, {"territory_id": "T", "name": "n"}, {}, {"id": "p", "list": ["a", "b"], "x": 2.5, "whole": 3.0, "flag": True, "none": None}]
    point = {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "mix.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [*map(feature, props), point]}))
    rows = files.read_geojson(spark, str(tmp_path))
    assert {r.territory_id for r in rows.collect()} == {"84130", "7", "T", "3", "p"}
    get = lambda k: property_string(F.try_variant_get("props", f"$.{k}", "variant"))
    r = rows.filter("territory_id = 'p'").select(*[get(k).alias(k) for k in ("list", "x", "whole", "flag", "none", "absent")]).first()
    assert tuple(r) == ("a|b", "2.5", "3", "true", "", "")
    (tmp_path / "one.geojson").write_text(json.dumps(feature({"id": "single"})))
    assert files.read_geojson(spark, str(tmp_path / "one.geojson")).first().territory_id == "single"
    with pytest.raises(ValueError, match="2 times"):
        files.check_unique(rows.unionByName(rows))


def test_short_ring_is_an_error(spark):
    rows = [("t", "a", "a", {}, [([(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [])])]
    short = spark.createDataFrame(rows, f"layer string, territory_id string, name string, props map<string,string>, geometry {territory.GEOMETRY}")
    with pytest.raises(Exception, match="four points"):
        files.to_geojson(short).collect()


def test_postal_groups(spark):
    ring = [(48.0, 12.0), (48.0, 13.0), (49.0, 13.0), (48.0, 12.0)]
    rows = [("postal", c, "", {}, [(ring, [])]) for c in ("12345", "12399", "98765", "1234")]
    t = spark.createDataFrame(rows, f"layer string, territory_id string, name string, props map<string,string>, geometry {territory.GEOMETRY}")
    got = {r.territory_id: (len(r.geometry), r.layer) for r in territory.postal_groups(t, 3).collect()}
    assert got == {"123": (2, "plz3"), "987": (1, "plz3")}
    with pytest.raises(ValueError):
        territory.postal_groups(t, 6)


def test_parcel_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("parcel_id,lat,lon,weight_kg\nP001,48.65,12.65,4.3\nP002,48.62,12.85,1.1\nP003,40.0,10.0,3.0\n")
    parcels = files.read_parcels(spark, str(tmp_path / "p.csv"))
    z = zones(spark)
    assigned = dispatch.include_properties(territory.assign(parcels.withColumn("id", F.col("parcel_id")), territory.edges_of(z)), z, ["depot"])
    files.write_assignments(assigned, str(tmp_path / "out"), ["territory_id", "depot"])
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["parcel_id", "territory_id", "depot"] and back.count() == 3
    manifests = dispatch.manifest_groups(assigned, z, "vehicle")
    files.write_manifests(manifests, str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith((".", "_"))} == {"VAN-01.csv", "VAN-02.csv", "UNASSIGNED.csv"}
    assert "parcel_id" in (tmp_path / "m" / "VAN-01.csv").read_text().splitlines()[0].split(",")
    (tmp_path / "bad.csv").write_text("parcel_id,lat,lon\nP001,north,12\n")
    with pytest.raises(Exception, match="isn't a number"):
        files.read_parcels(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "short.csv").write_text("parcel_id,lat\nP001,1\n")
    with pytest.raises(ValueError, match="lon"):
        files.read_parcels(spark, str(tmp_path / "short.csv"))


def test_long_manifests_keep_their_order(spark, tmp_path, monkeypatch):
    """Manifests above SORTED_ROWS are sorted in many tasks and written in their order; short ones are as before."""
    monkeypatch.setattr(files, "SORTED_ROWS", 100)
    monkeypatch.setattr(files, "cut", lambda df, cut=files.cut: parts.append(cut(df)) or parts[-1])
    parts = []
    rows = [(f"P{i}", (i * 7919) % 3001, ["a b", "c", "d"][0 if i % 3 else 1 if i % 60 else 2]) for i in range(3001)]
    m = spark.createDataFrame(rows, "parcel_id string, row_ord long, manifest string").repartition(4)
    files.write_manifests(m, str(tmp_path / "m"))
    for name in ("a b", "c", "d"):
        lines = (tmp_path / "m" / f"{name}.csv").read_text().splitlines()
        assert lines == ["parcel_id", *[p for p, _, f in sorted(rows, key=lambda r: r[1]) if f == name]]
    assert {p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith((".", "_SUCCESS"))} == {"a b.csv", "c.csv", "d.csv"}
    assert len(parts) == 3  # all rows, and the two long ones sorted


def test_areas_lose_nothing_and_keep_their_turn_beyond_the_poles(spark):
    import math

    def square(tid, lat0, lat9, lon0, lon9):
        return ("a", tid, "", {}, [([(lat0, lon0), (lat0, lon9), (lat9, lon9), (lat9, lon0), (lat0, lon0)], [])])

    boxes = [(47 + 0.01 * k, 47 + 0.01 * k + 0.0094, 11 + 0.01 * k, 11 + 0.01 * k + 0.0097) for k in range(0, 20000, 40)]
    t = spark.createDataFrame([square(f"D{k}", *b) for k, b in enumerate(boxes)], f"layer string, territory_id string, name string, props map<string,string>, geometry {territory.GEOMETRY}")
    got = {r.territory_id: r.area_m2 for r in territory.areas(t).collect()}
    for k, (lat0, lat9, lon0, lon9) in enumerate(boxes):
        want = math.radians(lon9 - lon0) * (math.sin(math.radians(lat9)) - math.sin(math.radians(lat0))) * 6378137.0**2
        assert abs(got[f"D{k}"] - want) < 2e-6  # the last place of a sine
    assert min(got.values()) < 0 < max(got.values())


def test_neighbors_near_and_beyond_the_poles(spark):
    e = layer(spark, A=[(square(100, 11, 100.01, 11.01), [])], B=[(square(100.01, 11, 100.02, 11.01), [])], C=[(square(89.99, 11, 89.995, 11.01), [])], D=[(square(89.99, 11.06, 89.995, 11.07), [])])
    both = lambda **k: {(r.territory_id, r.neighbor) for r in territory.neighbors(e, **k).collect()}
    assert both() == {("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")}
    assert both(most_deg=0.03) == {("A", "B"), ("B", "A")}


def test_registered_neighbors_leave_out_nothing_near_a_pole(spark, tmp_path):
    """Districts in rows of forty up to beyond the pole, against the query's SQL: near it those far apart in degrees are neighbors."""
    import duckdb

    from geoweft.plans import queries

    spark.range(4295 * 40, 4305 * 40).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {tuple(r) for r in queries.territory_neighbors(spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
        want = set(db.execute(queries.SQL["territory_neighbors"]).fetchall())
    assert {r[:2] for r in got} == {r[:2] for r in want} and len(want) == len(got)
    far = {(a, b) for a, b, _ in got if abs(int(a[1:]) % 40 - int(b[1:]) % 40) > 4}
    assert len(far) > 1000
    held = {r[:2]: r[2] for r in want}
    assert all(abs(held[a, b] - m) < 2e-4 for a, b, m in got)

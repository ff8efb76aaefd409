"""The nearest place asked for, places on routes, bundles of actions, neighbours by cells."""

import json
import random

import pytest
from pyspark.sql import functions as F

from geoweft.functions.lineage import stored
from geoweft.operators import assistant, compose, dispatch, nearest, poi, search, territory

PLACE = "kind string, id long, lat double, lon double, tags map<string,string>"


def haversine(a, b, c, d):
    import math

    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("few", [32, 0])
def test_nearest_places(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW_QUERIES", few)
    tags = [{"natural": "water"}, {"name": "Chiemsee"}, {"landuse": "forest"}, {"amenity": "Pharmacy"}, {"name": "McDonald's", "brand": "McDonald's", "amenity": "fast_food"}, {"name": "Huber"}, {"addr:street": "Rosenweg", "addr:housenumber": "5"}]
    rows = [("way" if i % 2 else "node", i, 48 + i / 100, 12.0, t) for i, t in enumerate(tags, 1)] + [("way", 20, 49.0, 12.0, {"amenity": "pharmacy"})]
    places = spark.createDataFrame(rows, PLACE)
    aliases = spark.createDataFrame([("goldbogen", "mcdonalds")], "alias string, canonical string")
    streets = spark.createDataFrame([("hauptstr", "Hauptstr", [7])], "key string, display string, node_ids array<long>")
    vertices = spark.createDataFrame([(7, 48.0, 12.0)], "id long, lat double, lon double")
    prompts = ["Wo ist der nächste See?", "nearest forest", "nächste Apotheke", "nächste Goldbogen", "nearest Gasthof Huber am Eck", "nächste Rosenweg", "nearest Hauptstr", "nearest Unbekanntes", "?", "nearest maci"]
    q = spark.createDataFrame([(i, p, 48.0, 12.0) for i, p in enumerate(prompts)] + [(50, "nearest forest", None, None)], "qid long, prompt string, lat double, lon double")
    got = {r.qid: (r.stage, r.id) for r in assistant.nearest_places(q, places.drop("kind"), places, streets, vertices, aliases).collect()}
    assert got == {0: ("lake", 1), 1: ("forest", 3), 2: ("apotheke", 20), 3: ("name", 5), 4: ("name", 6), 5: ("address", 7), 6: ("street", 7), 9: ("name", 5)}


def test_places_in_many_windows(spark):
    rng = random.Random(6)
    kinds = ["cafe", "Bar", ""]
    places = [(rng.choice(["way", "way", "node"]), i, 48 + rng.random(), 12 + rng.random(), {"amenity": rng.choice(kinds)} if i % 9 else {"name": "x"}) for i in range(600)]
    routes = []
    for q in range(60):
        lat, lon, size = 48 + rng.random(), 12 + rng.random(), rng.choice([0.0, 0.001, 0.02, 0.3, 2.0])
        routes.append((q, lat - size, lat + size, lon - size / 2, lon + size / 2, "amenity", rng.choice(["CAFE", "bar", None])))
    routes += [(90, 49.0, 48.0, 12.0, 13.0, "amenity", None)]
    df = spark.createDataFrame(routes, "qid long, min_lat double, max_lat double, min_lon double, max_lon double, key string, value string")
    got = {}
    for r in poi.on_routes(spark.createDataFrame(places, PLACE), df).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    want = {}
    for q, a, b, c, d, key, value in routes:
        inside = [(round(haversine((a + b) / 2, (c + d) / 2, lat, lon), 6), i) for kind, i, lat, lon, t in places if kind == "way" and a <= lat <= b and c <= lon <= d and key in t and (value is None or t[key].lower() == value.lower())]
        if inside:
            want[q] = [i for _, i in sorted(inside)[:8]]
    assert got == want and poi.on_routes(spark.createDataFrame(places, PLACE), df.limit(0)).isEmpty()


def test_wide_and_thin_windows_meet_few_places(spark, monkeypatch):
    """Wide windows hold all places, thin ones of their length none; neither kind is paired with all of them."""
    places = [("way", i, 48 + 0.001 * (i // 40), 12 + 0.001 * (i % 40), {"amenity": "cafe"}) for i in range(4000)] + [("way", 5000 + i, 48.05, 12.0101, {"amenity": "cafe"}) for i in range(30)]
    wide = [(q, 47.9, 48.2 + 0.0002 * q, 11.99, 12.03 + 0.0003 * q) for q in range(60)]
    thin = [(100 + q, 48.0, 48.099, 12.0005 + 0.001 * q, 12.0005 + 0.001 * q) for q in range(20)] + [(200, 48.0, 48.1, 12.01, 12.01), (201, 48.0, 48.1, 12.0101, 12.0101)]
    df = spark.createDataFrame([(*r, "amenity", "cafe") for r in wide + thin], "qid long, min_lat double, max_lat double, min_lon double, max_lon double, key string, value string")
    met, kind = [], type(df)
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **k: (met.append(self), own(self, *a, **k))[1])
    got = {}
    for r in poi.on_routes(spark.createDataFrame(places, PLACE), df).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    want = {q: [i for _, i in sorted((round(haversine((a + b) / 2, (c + d) / 2, lat, lon), 6), i) for _, i, lat, lon, _ in places if a <= lat <= b and c <= lon <= d)[:8]] for q, a, b, c, d in wide + thin}
    assert got == {q: ids for q, ids in want.items() if ids} and len(got) == 62
    assert met and sum(m.agg(F.sum(F.size("there"))).first()[0] for m in met) < 2 * 62 * 4030 / 10


def test_bundles(spark):
    edges = spark.createDataFrame([(1, 2, 100.0), (2, 1, 100.0), (3, 1, 90.0)], "src long, dst long, dist_m double").select("*", F.lit(50.0).alias("speed_kph"), F.lit(0.0).alias("max_height_m"), F.lit(0.0).alias("max_weight_t"), F.lit("").alias("hwy_type"))
    vertices = spark.createDataFrame([(1, 48.0, 12.0), (2, 48.001, 12.0), (3, 48.1, 12.1)], "id long, lat double, lon double")
    places = spark.createDataFrame([("node", 5, 48.001, 12.0, {"name": "n"}), ("way", 5, 48.0, 12.0, {"name": "w"}), ("relation", 6, 48.0, 12.0, {}), ("node", 7, 48.1, 12.1, {})], PLACE)
    streets = spark.createDataFrame([], "key string, display string, node_ids array<long>")
    at = {"lat": 48.001, "lon": 12.0}
    acts = [
        (0, 0, "show_info", {"id": 5}), (0, 1, "highlight_poi", {"id": "9"}), (0, 2, "compute_route", {"from": at, "to": {"id": 5}}), (0, 3, "noop", None), (0, 4, "show_info", {"id": "x"}),
        (0, 5, "compute_route", {"from": at, "to": {"id": 7}}), (0, 6, "compute_route", {"to": {"id": 5}}), (0, 7, "compute_route", {"from": at, "to": {"id": 6}}), (0, 8, "compute_route", {"from": at, "to": {"query": "nowhere at all"}}),
        (1, 0, "noop", {}), (1, 1, "show_info", {}), (1, 2, "dance", {}), (2, 0, None, {}), (3, 0, "compute_route", None), (4, 0, "compute_route", {"from": at}),
    ]
    df = spark.createDataFrame([(q, n, t, None if p is None else json.dumps(p)) for q, n, t, p in acts], "qid long, nth int, type string, params string")
    rows = {(r.qid, r.nth): r for r in assistant.run_bundles(df, places.drop("kind").withColumn("seq", F.col("id")), places, streets, edges, vertices).collect()}
    brief = assistant.run_bundles(df, places.drop("kind").withColumn("seq", F.col("id")), places, streets, edges, vertices, paths=False)
    assert "path" not in brief.columns  # all ways together may be far longer than the graph
    ends = lambda r: (r.error, r.from_node, r.to_node, r.cost)
    assert {k: ends(r) for k, r in rows.items()} == {(r.qid, r.nth): ends(r) for r in brief.collect()}
    assert all(not r.path or (r.path[0], r.path[-1]) == (r.from_node, r.to_node) for r in rows.values())
    assert len(rows) == 13
    assert (rows[0, 0].kind, rows[0, 0].label, rows[0, 0].lat) == ("way", "w", 48.0) and rows[0, 1].error == "not found" and rows[0, 4].error == "invalid id"
    assert rows[0, 2].path == [2, 1] and rows[0, 2].distance_m == 100.0 and rows[0, 3].note == "no-op on server"
    assert rows[0, 5].error == "no path" and rows[0, 6].error == "from: not found" and rows[0, 7].error == rows[0, 8].error == "to: not found"
    assert {k: r.error for k, r in rows.items() if k[0]} == {(1, 1): "action 1: missing id param for show_info", (2, 0): "action 0: missing type", (3, 0): "action 0: params required for compute_route", (4, 0): "action 0: missing to param for compute_route"}


def test_neighbors_of_unlike_sizes(spark):
    """Boxes meet by cells: a large one and many small ones, touching, near and far."""
    rng = random.Random(2)
    boxes = {"big": (48.0, 48.5, 12.0, 12.5)} | {f"s{i}": (a := 48 + rng.random() * 0.6, a + 0.004, b := 12 + rng.random() * 0.6, b + 0.003) for i in range(160)}
    ring = lambda a, b, c, d: [(a, c), (a, d), (b, d), (b, c)]
    rows = [("l", t, t, {}, [(ring(*x), [])]) for t, x in boxes.items()]
    t = spark.createDataFrame(rows, f"layer string, territory_id string, name string, props map<string,string>, geometry {territory.GEOMETRY}")
    got = {(r.territory_id, r.neighbor): r.dist_m for r in territory.neighbors(territory.edges_of(t), 300.0).collect()}
    far = lambda p, q: (boxes[p][0] - boxes[q][1]) * 111320 > 310 or (boxes[q][0] - boxes[p][1]) * 111320 > 310 or (boxes[p][2] - boxes[q][3]) * 70000 > 310 or (boxes[q][2] - boxes[p][3]) * 70000 > 310
    assert all(not far(p, q) and d <= 300 for (p, q), d in got.items()) and {(q, p) for p, q in got} == set(got)
    everyone = spark.createDataFrame([(p, q) for p in boxes for q in boxes if p < q], "a string, b string")
    e = territory.edges_of(t)
    v = e.select(F.col("territory_id").alias("v"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon")).distinct()
    d = territory.geo.segment_distance_m(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")])
    near = everyone.select("a", "b", F.col("a").alias("v"), F.col("b").alias("territory_id")).unionByName(everyone.select("a", "b", F.col("b").alias("v"), F.col("a").alias("territory_id")))
    want = {(r.a, r.b) for r in near.join(v, "v").join(e, "territory_id").groupBy("a", "b").agg(F.min(d).alias("m")).filter("m <= 300").collect()}
    assert {k for k in got if k[0] < k[1]} == want and len(want) > 5


def test_guessed_stations_are_taken_in_the_order_of_rows(spark):
    """Against the plain loop: two imports, names that want the same stations, ties."""
    rng = random.Random(11)
    stations = [(f"s{i:02d}", "", 48 + rng.random() / 25, 12 + rng.random() / 25) for i in range(25)] + [("named", "Feuerwehr Altdorf", 48.0, 12.0)]
    names = [(imp, f"{imp} Ort {chr(97 + k % 26)}{chr(97 + k // 26)}", rng.randrange(30)) for imp in ("x", "y") for k in range(35)]
    spots = {n: (48 + rng.random() / 25, 12 + rng.random() / 25) for _, n, _ in names}
    want = {}
    for imp in ("x", "y"):
        free = {s[0]: s for s in stations if not s[1]}
        for _, row, n in sorted((i, r, n) for i, n, r in names if i == imp):
            near = sorted((haversine(*spots[n], a, b), i) for i, _, a, b in free.values())
            if near and near[0][0] <= 1500:
                want[imp, n] = near[0][1]
                del free[near[0][1]]
    roster = spark.createDataFrame(names, "import string, name string, first_row long")
    hints = spark.createDataFrame([(n, *at) for n, at in spots.items()], "name string, lat double, lon double")
    rows = dispatch.match_roster(roster, spark.createDataFrame(stations, "id string, name string, lat double, lon double"), hints).collect()
    assert {(r["import"], r["name"]): r["id"] for r in rows if r["match"] == "guessed"} == want and 10 < len(want) < 60 and len(rows) == 70


def test_roster_keys_that_begin_alike(spark):
    """Keys of one beginning aren't all compared with each other, and are matched as by comparing all."""
    keys = [f"customer {i}" for i in range(400)]
    named = spark.createDataFrame([(k, f"s{i}") for i, k in enumerate(keys)], "k string, id string")
    asked = [f"customer {i} nord" for i in range(0, 3000, 7)] + ["cust", "omer 39", "nowhere", "", "customer 12 nord"]
    rest = spark.createDataFrame(list(enumerate(asked)), "first_row long, key string")
    got = {r.first_row: r.k for r in dispatch._holding(rest, named).collect()}
    want = {i: min((-len(k), k) for k in keys if k in a or a in k)[1] for i, a in enumerate(asked) if any(k in a or a in k for k in keys)}
    assert got == want


def test_questions_meet_few_places_of_a_name(spark, monkeypatch):
    """Many questions for a name that many places have: each meets those around it, not all of them."""
    met, top = [], nearest._top

    def counted(pairs, *rest):
        met.append(pairs.count())
        return top(pairs, *rest)

    monkeypatch.setattr(nearest, "_top", counted)
    places = spark.createDataFrame([("node", i, 40 + i / 100, 12.0, {"name": ("Huber", "Maier")[i % 2]}) for i in range(1000)] + [("node", 5000, None, 12.0, {"name": "Huber"})], PLACE)
    q = spark.createDataFrame([(i, "nearest Gasthof Huber am Eck", 40.0011 + i / 50, 12.0) for i in range(200)], "qid long, prompt string, lat double, lon double")
    none = spark.createDataFrame([], "alias string, canonical string")
    streets, vertices = spark.createDataFrame([], "key string, display string, node_ids array<long>"), spark.createDataFrame([], "id long, lat double, lon double")
    got = {r.qid: (r.stage, r.id, r.label) for r in assistant.nearest_places(q, places.drop("kind"), places, streets, vertices, none).collect()}
    assert got == {i: ("name", 2 * i, "Huber") for i in range(200)}
    assert 0 < sum(met) <= 200 * 20


def test_nearest_hits(spark):
    """Of a text's hits the nearest, of equals the least id; questions at one place share it."""
    hits = spark.createDataFrame([("a", 2, 48.1, 12.0, "x"), ("a", 1, 47.9, 12.0, "y"), ("a", 3, 48.1, 12.0, "z"), ("b", 3, 48.1, 12.0, "z")], "k string, id long, lat double, lon double, label string")
    asked = spark.createDataFrame([(q, "ab"[q % 2], 48.05, 12.0) for q in range(50)] + [(90, "a", 47.0, 12.0), (91, "c", 47.0, 12.0)], "qid long, k string, qlat double, qlon double")
    got = {r.qid: (r.id, r.label, round(r.dist_m)) for r in compose.nearest_hits(asked, hits).collect()}
    far = round(haversine(47.0, 12.0, 47.9, 12.0))
    assert got == {q: (2, "x", 5560) if q % 2 == 0 else (3, "z", 5560) for q in range(50)} | {90: (1, "y", far)}


def joins_by_broadcast(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_roster_joins_gather_no_table_on_the_driver(spark):
    """Spark's estimates come from compressed bytes, so large tables look small; the joins must not go by them."""
    town = lambda k: "Q" + "".join(chr(97 + k // 26**i % 26) for i in range(3)) + "x"
    rows = [(f"FF {town(k)}{' Nord' if k % 3 else ''}", k) for k in range(400)]
    stations = spark.createDataFrame([(f"s{k:03d}", f"Feuerwehr {town(k)}" if k % 2 else "", 48 + k / 50, 12.0) for k in range(800)], "id string, name string, lat double, lon double")
    hints = spark.createDataFrame([(n, 48 + k / 50, 12.001) for n, k in rows], "name string, lat double, lon double")
    roster = spark.createDataFrame(rows, "name string, first_row long")
    got = dispatch.match_roster(stored(roster), stored(stations), stored(hints))  # as files, of which Spark knows the bytes
    assert joins_by_broadcast(got) == 0
    found = {r.first_row: (r.match, r.id) for r in got.collect()}
    want = lambda k: ("exact" if k % 3 == 0 else "substring", f"s{k:03d}") if k % 2 else ("guessed", f"s{k:03d}")
    assert {k: v for k, v in found.items() if v != want(k)} == {} and len(found) == 400


def test_area_reports_gather_no_table_on_the_driver(spark):
    """As for rosters: relations, ways, nodes and rings meet by joins that are dealt over tasks."""
    from geoweft.operators import boundaries

    town = lambda k: "Q" + "".join(chr(97 + k // 26**i % 26) for i in range(2)) + "x"
    n = 60
    nodes = spark.createDataFrame([(k * 10 + i, 48 + k / 50 + a, 12.0 + b) for k in range(n) for i, (a, b) in enumerate(((0, 0), (0, 0.01), (0.01, 0.01), (0.01, 0)))], "id long, lat double, lon double")
    ways = spark.createDataFrame([(k, {"landuse": "forest"} if k % 2 else {"a": "b"}, [k * 10 + i for i in (0, 1, 2, 3, 0)]) for k in range(n)], "id long, tags map<string,string>, node_ids array<long>")
    relations = spark.createDataFrame([(k, {"boundary": "administrative", "name": town(k)}, [("way", k, "outer")]) for k in range(n)], "id long, tags map<string,string>, members array<struct<type:string,id:long,role:string>>")
    questions = spark.createDataFrame([(k, town(k)) for k in range(n)], "qid long, name string")
    got = boundaries.area_report(*map(stored, (questions, relations, ways, nodes)))
    assert joins_by_broadcast(got) == 0
    rows = {r.qid: r for r in got.collect()}
    assert len(rows) == n and all(r.id == k and r.rings == 1 and r.forest == (k % 2 == 1) and 700_000 < r.area_m2 < 900_000 and r.net_m2 == r.area_m2 for k, r in rows.items())

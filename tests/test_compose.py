"""Compositions on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from geoweft.operators import boundaries, compose, nearest


def test_nearest_named(spark):
    rows = [(1, 48.0, 12.0, {"name": "McDonald's", "brand": "McDonald's"}), (2, 48.1, 12.0, {"name": "McDonald's"}), (3, 48.2, 12.0, {"name": "Apotheke am Eck", "amenity": "pharmacy"})]
    a = spark.createDataFrame(rows, "id long, lat double, lon double, tags map<string,string>")
    aliases = spark.createDataFrame([("maci", "mcdonalds")], "alias string, canonical string")
    q = spark.createDataFrame([(0, "Wo ist der nächste McDonald's?", 48.09, 12.0), (1, "nächste maci", 48.09, 12.0), (2, "nearest Apotheke", 48.0, 12.0), (3, "nächste?", 48.0, 12.0), (4, "nearest nothing", 48.0, 12.0)], "qid long, prompt string, lat double, lon double")
    got = {r.qid: r.id for r in compose.nearest_named(q, a, aliases).collect()}
    assert got == {0: 2, 1: 1, 2: 3}


def test_route_actions(spark):
    block = '```route-action\n{"action": "compute_route", "from": "A", "to": "B"}\n```'
    rows = [(0, f"Gern.\n{block}\n Bis dann. "), (1, "nur Text"), (2, block.replace('"B"', '""')), (3, block.replace("compute_route", "noop")), (4, "```route-action\n{broken}\n```")]
    got = compose.route_actions(spark.createDataFrame(rows, "qid long, answer string")).orderBy("qid").collect()
    assert (got[0]["from"], got[0].to, got[0].clean) == ("A", "B", "Gern.Bis dann.")
    assert all(r.to is None and r.clean == t for r, (_, t) in zip(got[1:], rows[1:], strict=True))
    acts = spark.createDataFrame([(0, "noop", {}), (1, "zoom_to", {"lat": "1"}), (2, "show_info", {"id": "5"}), (3, "dance", {})], "qid long, type string, params map<string,string>")
    assert {r.qid for r in compose.valid_actions(acts).collect()} == {0, 2}


def test_rings(spark):
    nodes = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(48.0, 12.0), (48.0, 12.01), (48.01, 12.01), (48.01, 12.0), (48.1, 12.1)], 1)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(10, [1, 2, 3]), (11, [3, 4, 1]), (12, [5, 1]), (13, [1, 2, 3, 1])], "id long, node_ids array<long>")
    rel = spark.createDataFrame([(1, [("way", 10, ""), ("way", 12, ""), ("way", 11, ""), ("way", 13, ""), ("node", 5, "")])], "id long, members array<struct<type:string,id:long,role:string>>")
    rings = compose.relation_rings(rel, ways, nodes).orderBy("ring")
    got = [[(p.lat, p.lon) for p in r.points] for r in rings.collect()]
    # 10 and 11 close and go on into 13; 12 stays open
    assert len(got) == 1 and got[0][0] == got[0][-1] == (48.0, 12.0) and len(got[0]) == 10
    square = spark.createDataFrame([(1, 0, [(48.0, 12.0), (48.0, 12.01), (48.01, 12.01), (48.01, 12.0), (48.0, 12.0)])], "id long, ring int, points array<struct<lat:double,lon:double>>")
    assert compose.ring_areas(square).first().area_m2 == pytest.approx(1113.19 * 1113.19 * 0.669, rel=0.01)


def test_stations(spark):
    points = spark.createDataFrame([("node", 1, 48.0, 12.0, {"amenity": "fire_station", "name": "Feuerwehr Adldorf"}), ("way", 2, 48.5, 12.0, {"place": "village", "name": "Wallersdorf"}), ("relation", 3, 48.0, 12.0, {"amenity": "fire_station"})], "kind string, id long, lat double, lon double, tags map<string,string>")
    assert [r.id for r in compose.osm_stations(points).collect()] == ["osm:node/1"]
    none = spark.createDataFrame([], "id long, lat double, lon double, tags map<string,string>")
    streets = spark.createDataFrame([], "key string, display string, node_ids array<long>")
    v = spark.createDataFrame([], "id long, lat double, lon double")
    names = spark.createDataFrame([("2.1.3 FF Adldorf",), ("FF Wallersdorf",), ("FF Nirgends",), ("FF",)], "name string")
    got = {r.name: r.lat for r in compose.station_hints(names, none, points, streets, v).collect()}
    assert got == {"2.1.3 FF Adldorf": 48.0, "FF Wallersdorf": 48.5}


def test_intents_carried_out(spark):
    """Ways to a place, over the nearest place of a kind, and between two places named."""
    side = 4
    at = lambda i: (48 + (i - 1) // side / 1000, 12 + (i - 1) % side / 1000)
    ids = range(1, side * side + 1)
    vertices = spark.createDataFrame([(i, *at(i)) for i in ids], "id long, lat double, lon double")
    steps = [(a, b, 100.0) for a in ids for b in (a + 1, a - 1, a + side, a - side) if b in ids and (abs(a - b) == side or (a - 1) // side == (b - 1) // side)]
    edges = spark.createDataFrame(steps, "src long, dst long, dist_m double").select("*", F.lit(50.0).alias("speed_kph"), F.lit(0.0).alias("max_height_m"), F.lit(0.0).alias("max_weight_t"), F.lit("").alias("hwy_type"))
    place = lambda i, **tags: (i, i, *at(i), tags)
    addresses = spark.createDataFrame([place(16, **{"addr:street": "Zielweg", "addr:housenumber": "1"}), place(4, **{"addr:street": "Startgasse", "addr:housenumber": "7"})], "id long, seq long, lat double, lon double, tags map<string,string>")
    points = spark.createDataFrame([("node", 13, *at(13), {"amenity": "fuel", "name": "Tank"}), ("node", 9, *at(3), {"amenity": "cafe"})], "kind string, id long, lat double, lon double, tags map<string,string>")
    streets = spark.createDataFrame([("zielweg", "Zielweg", [16])], "key string, display string, node_ids array<long>")
    prompts = [(1, "Navigiere nach Zielweg 1", *at(1)), (2, "nach Zielweg 1 mit Zwischenstopp Tankstelle", *at(1)), (3, "Wie lange dauert es von Startgasse 7 nach Zielweg 1?", *at(1)), (4, "nach Zielweg 1 mit Zwischenstopp Apotheke", *at(1)), (5, "Navigiere nach Nirgendwo", *at(1)), (6, "was ist das", *at(1))]
    rows = compose.run_intents(spark.createDataFrame(prompts, "qid long, prompt string, lat double, lon double"), addresses, points, streets, edges, vertices).collect()
    got = {r.qid: r for r in rows}
    assert {q: (r.intent, r.status, r.stop_label) for q, r in got.items()} == {1: ("navigate", "ok", None), 2: ("multi_stop", "ok", "Tank"), 3: ("duration", "ok", None), 4: ("multi_stop", "ok", None), 5: ("navigate", "to not found", None)}
    assert all(got[q].distance_m == 600.0 for q in (1, 2, 4)) and got[3].distance_m == 300.0
    assert got[2].path[0] == 1 and got[2].path[-1] == 16 and 13 in got[2].path and len(set(got[2].path)) == 7


def test_layers_as_they_are_and_bad_ones(spark, tmp_path):
    from geoweft.sources import files

    (tmp_path / "good.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "bad one.geojson").write_text("{nothing")
    (tmp_path / "other.geojson").write_text('{"type":"Topology"}')
    assert {(r.layer, r.value[:2]) for r in files.raw_layers(spark, str(tmp_path)).collect()} == {("good", '{"'), ("bad one", "{n"), ("other", '{"')}
    assert {r.layer for r in files.bad_layers(spark, str(tmp_path)).collect()} == {"bad one", "other"}


def test_rings_that_touch_are_not_nested(spark):
    """A square with a hole in it, an island in the hole, and a neighbour that shares an edge; a ring without an area."""
    square = lambda a, b, size: [(a, b), (a, b + size), (a + size, b + size), (a + size, b), (a, b)]
    rows = [square(48.0, 12.0, 0.1), square(48.02, 12.02, 0.06), square(48.04, 12.04, 0.02)[::-1], square(48.0, 12.1, 0.1), [(48.0, 12.0), (48.1, 12.1), (48.0, 12.0)]]
    rings = spark.createDataFrame([(1, k, r) for k, r in enumerate(rows)] + [(2, 0, square(48.045, 12.045, 0.01))], "id long, ring int, points array<struct<lat:double,lon:double>>")
    got = {(r.id, r.ring): r for r in boundaries.ring_report(rings).collect()}
    assert {k: r.depth for k, r in got.items()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 0, (1, 4): 0, (2, 0): 0}
    assert got[1, 0].mercator_m2 == pytest.approx(got[1, 0].area_m2 / math.cos(math.radians(48.05)) ** 2, rel=1e-4) and got[1, 4].area_m2 == 0


def test_area_reports(spark):
    """Each name once: the least id of those that hold it; wooded sums, plain single rings, nothing closed, not found."""
    nodes = spark.createDataFrame([(i * 10 + k, 48 + i * 0.2 + a, 12 + b) for i in range(4) for k, (a, b) in enumerate(((0.0, 0.0), (0.0, 0.1), (0.1, 0.1), (0.1, 0.0)))], "id long, lat double, lon double")
    ways = spark.createDataFrame([(i, [i * 10, i * 10 + 1, i * 10 + 2, i * 10 + 3, i * 10], {"natural": "wood"} if i == 1 else {}) for i in range(3)] + [(3, [30, 31], {})], "id long, node_ids array<long>, tags map<string,string>")
    member = lambda *ids: [("way", i, "outer") for i in ids]
    kind = {"boundary": "administrative"}
    relations = spark.createDataFrame(
        [(5, member(0, 1), kind | {"name": "Große Au"}), (6, member(0, 2), kind | {"name": "Grosse Au Süd"}), (7, member(2), kind | {"name": "Moos"}), (8, member(3), kind | {"name": "Offen"}), (4, member(0), {"name": "Moos"})],
        "id long, members array<struct<type:string,id:long,role:string>>, tags map<string,string>",
    )
    questions = spark.createDataFrame([(1, "grosse au"), (2, "AU SÜD"), (3, "moos"), (4, "offen"), (5, "nowhere"), (6, ""), (7, None), (8, "grosse au")], "qid long, name string")
    got = {r.qid: r for r in boundaries.area_report(questions, relations, ways, nodes).collect()}
    assert {q: r.id for q, r in got.items()} == {1: 5, 2: 6, 3: 7, 4: 8, 5: None, 6: None, 7: None, 8: 5}
    assert got[1].forest and got[1].area_m2 == pytest.approx(got[1].net_m2) and got[1].area_m2 > 0 and got[1].outline == 0
    assert (got[2].area_m2, got[2].rings) == (0.0, 2) and got[2].net_m2 > 0
    assert got[3].area_m2 > 0 and (got[4].rings, got[4].area_m2, got[4].outline) == (0, 0.0, None) and got[5].area_m2 is None
    assert boundaries.area_report(questions.limit(0), relations, ways, nodes).count() == 0
    assert boundaries.area_report(questions, relations.limit(0), ways, nodes).filter("id IS NULL").count() == 8


def test_rings_of_many_relations_need_no_call_of_their_own(spark):
    cells = spark.range(300).withColumn("n", F.col("id") * 4)
    ways = cells.select(F.explode(F.array(*[F.struct((F.col("n") + k).alias("id"), F.array(F.col("n") + k, F.col("n") + (k + 1) % 4).alias("node_ids")) for k in range(4)])).alias("w")).select("w.*")
    nodes = cells.select(F.explode(F.array(*[F.struct((F.col("n") + k).alias("id"), F.lit(48.0 + k // 2).alias("lat"), F.lit(12.0 + (k in (1, 2))).alias("lon")) for k in range(4)])).alias("v")).select("v.*")
    relations = cells.select("id", F.array(*[F.struct(F.lit("way").alias("type"), (F.col("n") + k).alias("id"), F.lit("").alias("role")) for k in (0, 2, 3, 1)]).alias("members"))
    rings = compose.relation_rings(relations, ways, nodes)
    assert "FlatMapGroups" not in rings._jdf.queryExecution().executedPlan().toString()
    got = rings.collect()
    assert len(got) == 300 and {(r.ring, len(r.points), tuple(r.points[0]) == tuple(r.points[-1])) for r in got} == {(0, 8, True)}


def test_chains_take_the_first_member_left_that_goes_on():
    way = lambda name, a, b: {"first": a, "last": b, "points": [{"lat": float(a), "lon": name}, {"lat": float(b), "lon": name}]}
    ways = [way(0.0, 1, 2), way(1.0, 5, 6), way(2.0, 2, 3), way(3.0, 2, 4), way(4.0, 3, 1), way(5.0, 6, 5)]
    assert [[p["lon"] for p in ring] for ring in compose._chained(ways)] == [[0.0, 0.0, 2.0, 2.0, 4.0, 4.0, 0.0], [1.0, 1.0, 5.0, 5.0, 1.0]]


def test_held_meets_texts_by_parts_of_their_lengths(spark):
    from geoweft.operators import search

    hays = [f"bezirk d{k}" for k in range(0, 600, 7)] + ["", "d", "x" * 3000 + "d21"]
    needles = [f"d{k}" for k in range(0, 60)] + ["bezirk d7", "nirgends"]
    corpus, asked = spark.createDataFrame([(h,) for h in hays], "hay string"), spark.createDataFrame([(n,) for n in needles], "sought string")
    got = sorted((r.hay, r.sought) for r in search.held(corpus, "hay", asked, "sought").collect())
    assert got == sorted((h, n) for h in hays for n in needles if n in h)
    # 'd2' and 'd1' have many rows, yet a longer name meets its own only: no pair is made that doesn't hold
    plan = search.held(corpus.filter("length(hay) < 100"), "hay", asked, "sought")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and "contains" not in plan


def test_prompts_meet_few_places_of_a_kind(spark, monkeypatch):
    """Prompts for a kind that many places have meet those around them; of equals the kind, then the id decides."""
    met, top = [], nearest._top

    def counted(pairs, *rest):
        met.append(pairs.count())
        return top(pairs, *rest)

    monkeypatch.setattr(nearest, "_top", counted)
    rows = [(kind, i, 40 + i / 50, 12.0, {"amenity": ("Cafe", "bank")[i % 2], "name": f"{kind}{i}"}) for i in range(500) for kind in ("way", "node")]
    points = spark.createDataFrame(rows, "kind string, id long, lat double, lon double, tags map<string,string>")
    prompts = spark.createDataFrame([(q, "Nächstes Café", 40 + q / 5, 12.0) for q in range(40)] + [(90, "Nächstes Café", None, 12.0)], "qid long, prompt string, lat double, lon double")
    got = {}
    for r in compose.intent_places(prompts, points).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.kind, r.id, r.label))
    want = {}
    for q in range(40):
        order = sorted((abs(i - 10 * q), kind, i) for kind, i, _, _, t in rows if t["amenity"] == "Cafe")
        want[q] = [{(kind, i, f"{kind}{i}") for d, kind, i in order if d == d0} for d0 in sorted({d for d, _, _ in order})]
    assert set(got) == set(range(40)) and all(len(v) == 8 for v in got.values())
    for q, found in got.items():
        assert found[:2] == [("node", 10 * q, f"node{10 * q}"), ("way", 10 * q, f"way{10 * q}")] and set(found[:2]) == want[q][0]
        assert set(found) <= set.union(*want[q][:5])
    assert 0 < sum(met) <= 40 * 500

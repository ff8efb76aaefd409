"""Text rules, search, labels, stations, intents."""

import pytest
from pyspark.sql import functions as F

from geoweft.functions import cost, geo, osm, text
from geoweft.operators import dispatch, intent, poi, search
from geoweft.plans import queries as plans
from geoweft.sources import files


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_normalize(spark):
    assert apply(spark, ["Hauptstraße 5", "KÖLN-NORD", "alreadyclean", "", "ẞ"], text.normalize) == ["hauptstrasse5", "koelnnord", "alreadyclean", "", "ss"]
    assert apply(spark, ["McDonald's", "  Köln-Nord, 2. ", "Café"], text.normalize_compare) == ["mcdonalds", "koeln nord  2", "caf"]


def test_numbers(spark):
    assert apply(spark, ["50", "30 mph", "DE:Urban", "", "none", "12,5 t", "5.", ".5", "1.2.3", "-7"], text.parse_maxspeed_kph) == pytest.approx([50, 48.2802, 50, 0, 0, 12.5, 5, 0.5, 0, 7])
    assert apply(spark, [0.0, 59 * 60.0, 60 * 60.0, 125 * 60.0], text.duration_text, "double") == ["0 min", "59 min", "1 h", "2 h 5 min"]
    assert apply(spark, [" ", "a/b:c", None, 'x<>|"'], text.sanitize_name) == ["UNASSIGNED", "a_b_c", "UNASSIGNED", "x____"]


def test_parse_address(spark):
    got = apply(spark, ["Berlin Hauptbahnhof", "Hauptstraße 5, Berlin", "  ", "Hauptstraße 5 84130 Dingolfing", "Am See 7a Ort", ", Ulm", "12345"], text.parse_address)
    parts = [(r.street, r.housenumber, r.postcode, r.city) for r in got]
    assert parts == [("Berlin Hauptbahnhof", "", "", ""), ("Hauptstraße 5", "5", "", "Berlin"), ("", "", "", ""), ("Hauptstraße", "5", "84130", "Dingolfing"), ("Am See", "7a", "", ""), ("", "", "", "Ulm"), ("", "", "12345", "")]


def addresses(spark):
    rows = [
        (1, 0, 52.52, 13.405, {"name": "Berlin Hauptbahnhof", "amenity": "station", "addr:street": "Europaplatz", "addr:city": "Berlin", "addr:postcode": "10557"}),
        (2, 1, 52.5, 13.4, {"name": "Berlin Apotheke", "amenity": "pharmacy", "addr:street": "Friedrichstraße", "addr:city": "Berlin"}),
        (3, 2, 48.1, 11.5, {"addr:street": "Hauptstraße", "addr:housenumber": "5", "addr:postcode": "84130", "addr:city": "Dingolfing"}),
    ]
    return spark.createDataFrame(rows, "id long, seq long, lat double, lon double, tags map<string,string>")


def ask(spark, *raw):
    return spark.createDataFrame(list(enumerate(raw)), "qid long, raw string")


def test_search_addresses(spark):
    q = ask(spark, "Berlin Hauptbahnhof", "Hauptstraße 5, Dingolfing", "nothing here")
    best = {r.qid: r.id for r in search.search_addresses(addresses(spark), q, 1).collect()}
    assert best == {0: 1, 1: 3}
    first = {r.qid: (r.id, r.score) for r in search.best_address(addresses(spark), q).collect()}
    # the number stays in the street where a comma splits it, so number and city score
    assert first == {0: (1, 11), 1: (3, 5)}


def test_poi_search_and_labels(spark):
    tags = {"name": "Berlin Hauptbahnhof", "amenity": "station", "addr:street": "Europaplatz", "addr:city": "Berlin"}
    points = spark.createDataFrame([("way", 10, 52.5201, 13.4051, tags), ("node", 7, 48.0, 11.0, {"name": "Bayern Tankstelle", "amenity": "fuel"})], "kind string, id long, lat double, lon double, tags map<string,string>")
    got = {r.qid: r for r in search.search_pois(points, ask(spark, "Berlin Hauptbahnhof", "Tankstelle"), 5).filter("rank = 1").collect()}
    assert got[0].label == "Berlin Hauptbahnhof — Europaplatz, Berlin" and (got[1].kind, got[1].id) == ("node", 7)
    rows = text.labelled(points, "poi", osm.tags_of("tags")).collect()
    assert rows[0].subtitle == "station" and rows[1].label == "Bayern Tankstelle" and rows[1].subtitle == "fuel"
    shop = spark.createDataFrame([({"name": "REWE Center", "addr:street": "Hauptstraße", "addr:housenumber": "5", "addr:postcode": "50667", "addr:city": "Köln"},), ({},), ({"amenity": "fast_food"},)], "tags map<string,string>")
    assert [r.label for r in text.labelled(shop, "address", osm.tags_of("tags")).collect()] == ["REWE Center — Hauptstraße 5, 50667 Köln", "Adresse", "fast food"]


def test_unified_search_and_resolve(spark):
    points = spark.createDataFrame([("way", 10, 48.3, 11.7, {"name": "Kloster Weltenburg", "tourism": "museum"})], "kind string, id long, lat double, lon double, tags map<string,string>")
    streets = spark.createDataFrame([("seeweg", "Seeweg", [5])], "key string, display string, node_ids array<long>")
    v = spark.createDataFrame([(5, 48.2, 11.6)], "id long, lat double, lon double")
    q = ask(spark, "Hauptbahnhof", "kloster weltenburg", "Seeweg", "48.1, 11.5", "", "zzz", "Flughafen München")
    rows = search.search(addresses(spark), points, streets, v, q, 5).collect()
    assert [(r.kind, r.id, r.nth) for r in rows if r.qid == 0] == [("address", 1, 1)]
    assert [(r.kind, r.match) for r in rows if r.qid == 1] == [("poi", "Treffer über Name/Marke")]
    assert [(r.kind, r.label, r.subtitle) for r in rows if r.qid == 2] == [("street", "Seeweg", "Straße")]
    got = {r.qid: r.resolution for r in search.resolve(addresses(spark), points, streets, v, q).collect()}
    assert got == {0: "address", 1: "search", 2: "street", 3: "coordinates", 4: "not found", 5: "not found", 6: "not found"}


def test_labels(spark):
    nodes = spark.createDataFrame([(1, 48.65, 12.49, {"place": "town", "name": "Landshut"}), (2, 49.2, 12.1, {"place": "village", "name": "Außerhalb"})], "id long, lat double, lon double, tags map<string,string>")
    assert [r.name for r in poi.place_labels(nodes, (48.6, 48.7, 12.4, 12.6), 10).collect()] == ["Landshut"]
    v = spark.createDataFrame([(1, 48.1, 11.1), (2, 49.1, 12.1)], "id long, lat double, lon double")
    streets = spark.createDataFrame([("hauptstrasse", "Hauptstraße", [1]), ("fernstrasse", "Fernstraße", [2])], "key string, display string, node_ids array<long>")
    assert [(r.name, r.lat) for r in poi.street_labels(streets, v, (48.0, 48.5, 11.0, 11.5), 5).collect()] == [("Hauptstraße", 48.1)]
    assert poi.street_labels(streets, v, (0.0, 0.0, 0.0, 0.0), 5).count() == 0
    windows = {"11.2,48.4,11.8,48.9": True, "": False, "11,48,12": False, "181,48,12,49": False, "nan,48,12,49": False, "12,49,11,48": False}
    assert {w: files.parse_window(w, "bbox") is not None for w in windows} == windows
    assert [poi.parse_zoom(z) for z in ("12", "-1", "x", "99")] == [12, 10, 10, 22]


def test_poi_tables(spark):
    nodes = spark.createDataFrame([(1, 48.0, 11.0, {}), (2, 48.2, 11.2, {}), (3, 48.4, 11.4, {}), (10, 48.137, 11.575, {"amenity": "cafe"}), (99, 0.0, 0.0, {})], "id long, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([(20, [1, 2, 2], {"amenity": "parking"}, 0)], "id long, node_ids array<long>, tags map<string,string>, seq long")
    relations = spark.createDataFrame([(30, [("way", 20, ""), ("node", 3, ""), ("relation", 5, "")], {"boundary": "administrative", "name": "x"}, 0)], "id long, members array<struct<type:string,id:long,role:string>>, tags map<string,string>, seq long")
    needed = poi.needed_nodes(nodes, nodes.filter(osm.is_poi("tags")), ways, relations)
    assert {r.id for r in needed.collect()} == {1, 2, 3, 10}
    points = poi.poi_points(nodes, ways, relations, needed)
    got = {(r.kind, r.id): r.lat for r in points.collect()}
    assert got[("way", 20)] == pytest.approx((48.0 + 48.2 + 48.2) / 3) and got[("relation", 30)] == pytest.approx((48.0 + 48.2 * 2 + 48.4) / 4) and ("node", 10) in got
    assert poi.relation_centroids_nested(relations, ways, nodes).first().lat == pytest.approx((48.0 + 48.2 * 2) / 3)
    assert poi.lookup(points, 20).first().kind == "way"
    assert [r.id for r in poi.near(points, 48.137, 11.575, "amenity", None, 2).collect()] == [10, 20]


def test_hydrants(spark):
    rows = [(k, 48.0, 11.0, {"emergency": "fire_hydrant"} | t) for k, t in enumerate([{"name": "Überflurhydrant"}, {"name": "Unterflur 3"}, {"fire_hydrant:type": "pond", "name": "Wand"}, {"name": "Wandhydrant"}, {}])]
    got = poi.hydrants(spark.createDataFrame(rows, "id long, lat double, lon double, tags map<string,string>"), (47.0, 49.0, 10.0, 12.0)).collect()
    assert [r.type for r in got] == ["pillar", "underground", "pond", "wall", ""]


def test_stations(spark):
    assert apply(spark, ["2.1.3 DGF FF Musterstadt", "Feuerwehr Musterstadt", "Musterstadt", "FF 12"], text.station_key) == ["dgf musterstadt", "musterstadt", "musterstadt", ""]
    stations = spark.createDataFrame([("a", "Feuerwehr Adldorf", 48.0, 12.0), ("b", "", 48.5, 12.5), ("c", "", 48.501, 12.5)], "id string, name string, lat double, lon double")
    roster = spark.createDataFrame([("FF Adldorf", 0), ("1.2 DGF FF Adldorf", 1), ("Wallersdorf", 2), ("Zweitort", 3), ("Drittort", 4)], "name string, first_row long")
    hints = spark.createDataFrame([("Wallersdorf", 48.5, 12.5), ("Zweitort", 48.5, 12.5), ("Drittort", 48.5, 12.5)], "name string, lat double, lon double")
    got = {r.name: (r.match, r.id) for r in dispatch.match_roster(roster, stations, hints).collect()}
    assert got == {"FF Adldorf": ("exact", "a"), "1.2 DGF FF Adldorf": ("substring", "a"), "Wallersdorf": ("guessed", "b"), "Zweitort": ("guessed", "c"), "Drittort": ("unmatched", None)}
    fleet = "station_id string, pos int, callsign string, type string"
    merged = dispatch.merge_vehicles(spark.createDataFrame([("a", 0, "1", "x"), ("a", 1, "2", "y")], fleet), spark.createDataFrame([("a", 0, "2", "z"), ("a", 1, "3", "n"), ("a", 2, "3", "m")], fleet))
    assert [(r.callsign, r.type) for r in merged.orderBy("pos").collect()] == [("1", "x"), ("2", "z"), ("3", "m")]
    stored = spark.createDataFrame([("manual:1", "Old", 1.0, 1.0), ("osm:1", "Own", 2.0, 2.0)], "id string, name string, lat double, lon double")
    changes = spark.createDataFrame([("manual:1", " ", 5.0, 5.0, False), ("osm:1", "New", 9.0, 9.0, False), ("manual:2", "Add", 3.0, 3.0, False)], "id string, name string, lat double, lon double, deleted boolean")
    assert {tuple(r) for r in dispatch.upsert_stations(stored, changes).collect()} == {("manual:1", "Old", 5.0, 5.0), ("osm:1", "New", 2.0, 2.0), ("manual:2", "Add", 3.0, 3.0)}


def test_roster_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Dienststelle,FunkRufname,Fahrzeugtyp,Ort\nFF A,1/1,LF, X \n,2/1,LF,\nFF B,,TLF,\n")
    got = files.read_roster(spark, str(tmp_path / "r.csv")).orderBy("name").collect()
    assert [(r.name, r.callsign, r.type, r.meta) for r in got] == [("FF A", "1/1", "LF", {"ort": "X"}), ("FF B", "", "TLF", {})]


CASES = {
    "äh, Flughafen München": ("navigate", "", "flughafen münchen", ""),
    "Wie lange dauert es von Dingolfing nach Landshut?": ("duration", "dingolfing", "landshut", ""),
    "Wie lange brauche ich nach Ulm": ("duration", "", "ulm", ""),
    "Route nach Landshut!": ("navigate", "", "landshut", ""),
    "Ich will nach Passau fahren": ("navigate", "", "passau", ""),
    "Nächste Tankstelle": ("poi_near", "", "", "tankstelle"),
    "Bäckerei auf der Route": ("poi_on_route", "", "", "bäckerei"),
    "über Landshut nach Passau": ("multi_stop", "", "passau", ""),
    "nach Ulm mit Zwischenstopp Bäckerei": ("multi_stop", "", "ulm", "bäckerei"),
    "Wo kann man hier im Wald spazieren gehen?": ("leisure", "", "", "wald"),
    "was ist das": ("unknown", "", "", ""),
    "Dingolfing.": ("navigate", "", "dingolfing", ""),
    "": ("unknown", "", "", ""),
    "dies hier sind mehr als fünf Worte ohne Ziel": ("unknown", "", "", ""),
}


def test_intents(spark):
    rows = intent.classify(spark.createDataFrame(list(enumerate(CASES)), "qid long, prompt string")).orderBy("qid").collect()
    assert {p: (r.intent, r.origin, r.destination, r.keyword) for p, r in zip(CASES, rows, strict=True)} == CASES
    assert (rows[5].tag_key, rows[5].tag_value) == ("amenity", "fuel")


def test_options():
    o = cost.RouteOptions(profile="delivery").settled()
    assert (o.engine, o.objective, o.max_kph, o.left_turn, o.u_turn) == ("astar", "duration", 80, 3, 10)
    assert cost.RouteOptions(engine="ch", max_kph=2).settled().max_kph == 5 and cost.RouteOptions().settled().objective == "distance"


def test_window_growth(spark):
    row = spark.range(1).select(*geo.expand_window(F.lit(48.0), F.lit(49.0), F.lit(11.0), F.lit(12.0), 0)).first()
    assert tuple(row) == (48.0, 49.0, 11.0, 12.0)


def test_queries_have_names_and_oracles():
    assert set(plans.SQL) <= set(plans.QUERIES) and len(plans.SQL) > 45


def test_progress(spark):
    steps = spark.createDataFrame([(1, 0, 10), (2, 5, 10), (3, 4, 10), (4, 20, 10), (5, 0, 0)], "seq int, done long, total long")
    assert [r.percent for r in files.import_progress(steps).orderBy("seq").collect()] == [60, 78, 78, 95, 95]


def test_progress_is_not_one_tasks_work(spark):
    """Steps of one seq share the highest percent, null comes first, and rows aren't gathered in one partition."""
    steps = spark.createDataFrame([(3, 5, 10), (3, 10, 10), (None, 2, 10), (1, 0, 10), (9, 1, 0)], "seq int, done long, total long")
    got = [(r.seq, r.percent) for r in files.import_progress(steps).collect()]
    assert sorted(got, key=str) == sorted([(3, 95), (3, 95), (None, 67), (1, 67), (9, 95)], key=str)
    from pyspark.sql import functions as F

    many = spark.range(0, 4000, 1, 4).select(F.col("id").alias("seq"), F.col("id").alias("done"), F.lit(4000).alias("total"))
    assert files.import_progress(many).select(F.spark_partition_id()).distinct().count() == 4


def test_search_by_pieces_is_search_of_every_row(spark, monkeypatch):
    """Many queries meet the corpora by an index of pieces; results are those of testing every row."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(61)
    word = lambda: "".join(rng.choices("abcdäß", k=rng.randrange(1, 6)))
    tags = [{"addr:street": f"{word()} {word()}", "addr:housenumber": str(rng.randrange(30)), "addr:postcode": f"{rng.randrange(40):05d}", "addr:city": word(), "name": word(), "brand": word(), "shop": word()} for _ in range(200)]
    tags = [{k: v for k, v in t.items() if rng.random() < 0.8} for t in tags]
    rows = [("node", i, i, 48.0 + i / 1000, 12.0, t) for i, t in enumerate(tags)]
    corpus = spark.createDataFrame(rows, "kind string, id long, seq long, lat double, lon double, tags map<string,string>")
    raws = [rng.choice([word(), f"{word()} {rng.randrange(30)}", f"{word()} {rng.randrange(30)}, {rng.randrange(40):05d} {word()}", f"{word()} {word()}", "", "?", "a"]) for _ in range(60)]
    queries = spark.createDataFrame(list(enumerate(raws)), "qid long, raw string")
    streets = corpus.filter("tags['addr:street'] IS NOT NULL").groupBy(search.text.normalize(F.col("tags")["addr:street"]).alias("key")).agg(F.min(F.col("tags")["addr:street"]).alias("display"), F.array(F.min("id")).alias("node_ids"))

    def found():
        return [
            sorted((r.qid, r["rank"], r.id, r.score) for r in search.search_addresses(corpus.drop("kind"), queries, 7).collect()),
            sorted(map(tuple, search.best_address(corpus.drop("kind"), queries).collect())),
            sorted((r.qid, r["rank"], r.kind, r.id, r.score) for r in search.search_pois(corpus, queries, 7).collect()),
            sorted((r.qid, r["rank"], r.key, r.score) for r in search.search_streets(streets, corpus, queries, 7).collect()),
        ]

    by_pieces = found()
    monkeypatch.setattr(search, "FEW_QUERIES", 1000)
    assert by_pieces == found() and all(by_pieces)


def test_rows_of_one_split_are_dealt(spark):
    """Tests on texts run on all cores, also where a corpus is one split; equal tags are scored once and keep all rows."""
    cores = spark.sparkContext.defaultParallelism
    rows = addresses(spark).withColumn("seq", F.col("id")).coalesce(1)
    asked, _ = search._distinct(ask(spark, "Hauptstraße", "Berlin"))
    assert search.score_addresses(rows, asked).rdd.getNumPartitions() >= cores
    points = spark.createDataFrame([("node", k, 48.0, 12.0, {"name": "Café Eins" if k % 3 else "Café", "amenity": "cafe"} if k % 7 else {}) for k in range(200)], "kind string, id long, lat double, lon double, tags map<string,string>")
    got = [(r.id, r.label) for r in search.search_pois(points, ask(spark, "café"), 90).orderBy("rank").collect()]
    of = lambda hit: [k for k in range(200) if k % 7 and (k % 3 == 0) == hit]
    want = [(k, "Café") for k in of(True)] + [(k, "Café Eins") for k in of(False)]
    assert got == want[:90]

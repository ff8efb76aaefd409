"""More registered queries: single rules, labels and lists, sources and sinks read back, routes over several stops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import cost, geo, osm, text
from geoweft.functions.lineage import cut, shared_dir
from geoweft.operators import assistant, boundaries, compose, dispatch, graph, intent, nearest, poi, routing, search, territory
from geoweft.plans.queries import BUILT, PROPS, STREETS, WINDOW, bear, built, grid, hav, norm_compare, query, zone_edges, zone_sql
from geoweft.plans.views import ctes, districts, table, view, zones
from geoweft.sources import files, pbf


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"


def tagged(df: DataFrame, **columns) -> DataFrame:
    """df with `tags` of the given columns, empty ones left out; __ in a name is a colon."""
    pairs = [x for k, c in columns.items() for x in (F.lit(k.replace("__", ":")), c.cast("string"))]
    return df.withColumn("tags", F.map_filter(F.create_map(*pairs), lambda _, v: v != ""))


# --- scalar rules ---

@query("SELECT o_orderkey AS id, CASE WHEN s < 3600 THEN CAST(floor(s / 60 + 0.5) AS BIGINT) || ' min' WHEN s // 60 % 60 = 0 THEN (s // 3600) || ' h' ELSE (s // 3600) || ' h ' || (s // 60 % 60) || ' min' END AS said FROM (SELECT *, (o_orderkey * 37) % 20011 AS s FROM orders)")
def duration_texts(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.duration_text(((F.col("o_orderkey") * 37) % 20011).cast("double")).alias("said"))


@query("SELECT doc_id, coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), '') AS said FROM documents")
def first_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_non_empty(F.col("lang"), F.col("source")).alias("said"))


@query("SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN p_name WHEN 2 THEN p_brand || '|' || p_size WHEN 3 THEN '' WHEN 4 THEN p_size || '.5' ELSE 'true' END AS said FROM part")
def property_texts(spark, sf):
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    n = lambda c: F.col(c).cast("string")
    kind = F.col("p_partkey") % 6
    value = F.when(kind == 0, F.concat(n("p_partkey"), F.lit(".0"))).when(kind == 1, q("p_name")).when(kind == 2, F.concat(F.lit("["), q("p_brand"), F.lit(","), n("p_size"), F.lit("]"))).when(kind == 3, F.lit("null")).when(kind == 4, F.concat(n("p_size"), F.lit(".5"))).otherwise("true")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.property_string(F.parse_json(value)).alias("said"))


@query(f"{ctes('points')} SELECT id, CASE WHEN id % 5 IN (0, 1) THEN round(lat, 6) WHEN id % 5 = 2 THEN -round(lat, 6) END AS lat, CASE WHEN id % 5 IN (0, 1, 2) THEN round(lon, 6) END AS lon FROM points")
def lat_lon_texts(spark, sf):
    """Texts of coordinates: with comma, with blank, negative, out of the world, and none."""
    k, at = F.col("id") % 5, F.format_string("%.6f", "lat")
    lon = F.format_string("%.6f", "lon")
    raw = F.when(k == 0, F.concat_ws(", ", at, lon)).when(k == 1, F.concat(F.lit(" "), at, F.lit(" "), lon)).when(k == 2, F.concat(F.lit("-"), at, F.lit(","), lon)).when(k == 3, F.concat(F.lit("1"), at, F.lit(", "), lon)).otherwise(F.concat(at, F.lit(" N")))
    return view(spark, sf, "points").select("id", search.parse_lat_lon(raw).alias("p")).select("id", "p.lat", "p.lon")


@query("SELECT o_orderkey AS seq, max(CASE WHEN t > 0 THEN 60 + (least(d, t) * 70 + t) // (2 * t) ELSE 60 END) OVER (ORDER BY o_orderkey) AS percent FROM (SELECT o_orderkey, o_orderkey // 3 AS d, (SELECT count(*) FROM orders) AS t FROM orders)")
def import_progress(spark, sf):
    o = table(spark, sf, "orders")
    return files.import_progress(o.select(F.col("o_orderkey").alias("seq"), F.floor(F.col("o_orderkey") / 3).alias("done"), F.lit(o.count()).alias("total")))


@query(f"{ctes('pois')}, t AS (SELECT id, CASE id % 9 WHEN 0 THEN 'amenity' WHEN 1 THEN 'railway' WHEN 2 THEN 'highway' WHEN 3 THEN 'natural' WHEN 4 THEN 'landuse' WHEN 5 THEN 'boundary' WHEN 6 THEN 'healthcare' WHEN 7 THEN 'building' ELSE 'public_transport' END AS k, CASE id % 7 WHEN 0 THEN 'station' WHEN 1 THEN 'bus_stop' WHEN 2 THEN 'water' WHEN 3 THEN 'forest' WHEN 4 THEN 'platform' WHEN 5 THEN '' ELSE 'peak' END AS v, id % 4 > 0 AS named FROM pois) SELECT id, v <> '' AND (k IN ('amenity', 'healthcare', 'public_transport') OR (k = 'railway' AND v IN ('station', 'platform')) OR (k = 'highway' AND v = 'bus_stop') OR (k = 'natural' AND v IN ('water', 'peak')) OR (k = 'landuse' AND v = 'forest') OR (k = 'boundary' AND named)) AS eligible, v <> '' AND k <> 'building' AS node_gate, v <> '' AND k NOT IN ('building', 'highway') AS way_gate, v <> '' AND k IN ('amenity', 'natural', 'landuse', 'boundary') AS relation_gate FROM t")
def place_gates(spark, sf):
    """Which keys and values make a place, and which entities are read as one, by kind."""
    p = view(spark, sf, "pois").select("id")
    key = F.element_at(F.array(*[F.lit(k) for k in ("amenity", "railway", "highway", "natural", "landuse", "boundary", "healthcare", "building", "public_transport")]), (F.col("id") % 9 + 1).cast("int"))
    value = F.element_at(F.array(*[F.lit(v) for v in ("station", "bus_stop", "water", "forest", "platform", "", "peak")]), (F.col("id") % 7 + 1).cast("int"))
    name = F.when(F.col("id") % 4 > 0, "named").otherwise("")
    p = p.withColumn("tags", F.map_filter(F.create_map(key, value, F.lit("name"), name), lambda _, v: v != ""))
    return p.select("id", osm.is_poi("tags").alias("eligible"), *[osm.passes_gate(k, F.col("tags")).alias(f"{k}_gate") for k in osm.GATE_KEYS])


@query(f"{ctes('pois')} SELECT id, kind, name, CASE WHEN brand = '' THEN '' ELSE brand END AS brand, 4 + CASE WHEN place <> '' THEN 1 ELSE 0 END + CASE WHEN emergency <> '' THEN 1 ELSE 0 END + CASE WHEN natural_kind <> '' THEN 1 ELSE 0 END + CASE WHEN amenity <> '' THEN 1 ELSE 0 END - CASE WHEN name = '' THEN 1 ELSE 0 END - 1 AS kept FROM pois")
def place_tags(spark, sf):
    """Entities as places keep their tags: all of the kept keys, none of others."""
    p = view(spark, sf, "pois").withColumn("tags", F.map_concat("tags", F.create_map(F.lit("building"), F.lit("yes"))))
    found = poi.gated(p.filter("kind = 'node'"), "node").unionByName(poi.gated(p.filter("kind = 'way'"), "way"))
    return found.select("id", "kind", osm.tag("tags", "name").alias("name"), osm.tag("tags", "brand").alias("brand"), F.size("tags").alias("kept"))


@query(f"{ctes('addresses', 'pois')} SELECT 'address' AS side, count(*) AS n, count(*) AS addresses, 0 AS named FROM addresses UNION ALL SELECT 'poi', count(*), 0, count(*) FILTER (name <> '') FROM pois")
def tag_predicates(spark, sf):
    """How many entities have an address key, and how many a name."""
    t = view(spark, sf, "addresses").select(F.lit("address").alias("side"), "tags").unionByName(view(spark, sf, "pois").select(F.lit("poi").alias("side"), "tags"))
    return t.groupBy("side").agg(F.count("*").alias("n"), F.count_if(osm.is_address(F.col("tags"))).alias("addresses"), F.count_if(osm.has_key(F.col("tags"), ("name",))).cast("int").alias("named"))


@query(f"{ctes('ways')} SELECT id, lower(trim(highway)) IN ('primary', 'track') OR lower(trim(highway)) = 'primary_link' AS allowed, CASE lower(trim(highway)) WHEN 'primary' THEN 99e0 WHEN 'motorway' THEN 110e0 WHEN 'secondary' THEN 70e0 WHEN 'residential' THEN 30e0 WHEN 'service' THEN 20e0 WHEN 'track' THEN 25e0 WHEN 'living_street' THEN 10e0 ELSE 50e0 END AS usual FROM ways")
def allowed_highways(spark, sf):
    h = osm.tag("tags", "highway")
    return view(spark, sf, "ways").select("id", osm.is_driveable(h, (" Primary", "TRACK ", "")).alias("allowed"), osm.default_speed(h, {"primary": 99.0, "track": -1.0}).alias("usual"))


@query(f"{ctes('pois')} SELECT id, CASE id % 5 WHEN 0 THEN 'pipe' WHEN 1 THEN 'underground' WHEN 2 THEN 'pillar' WHEN 3 THEN 'wall' ELSE '' END AS type FROM pois WHERE lat BETWEEN {WINDOW[0]}e0 AND {WINDOW[1]}e0 AND lon BETWEEN {WINDOW[2]}e0 AND {WINDOW[3]}e0 ORDER BY id LIMIT 2000")
def hydrant_types(spark, sf):
    p, k = view(spark, sf, "pois").drop("tags"), F.col("id") % 5
    name = F.when(k == 1, "Unterflurhydrant 7").when(k == 2, "Ein ÜBERFLUR-Hydrant").when(k == 3, "Wandhydrant").otherwise("")
    p = tagged(p, emergency=F.lit("fire_hydrant"), fire_hydrant__type=F.when(k == 0, " pipe ").otherwise(""), name=name)
    return poi.hydrants(p, WINDOW, 10**6).select("id", "type")


@query(f"{ctes('points')}, d AS (SELECT id, ({bear('lat', 'lon', '48.5e0', '12.8e0')} - {bear('lat', 'lon', '48.9e0', '12.6e0')} + 540) % 360 - 180 AS diff FROM points) SELECT id, CASE WHEN id % 5 > 2 THEN 7e0 ELSE 0e0 END + CASE WHEN abs(diff) > 160 THEN 30e0 WHEN diff > 30 THEN 2e0 WHEN diff < -30 THEN 1000000e0 ELSE 0e0 END AS penalty FROM d")
def turn_penalties(spark, sf):
    to = lambda lat, lon: geo.bearing_deg(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    kind = geo.turn_kind(geo.angle_diff_deg(to(48.5, 12.8), to(48.9, 12.6)))
    opt = cost.RouteOptions(crossing=5.0, traffic_light=2.0, left_turn=8.0, right_turn=2.0, u_turn=30.0, no_left_turn=True)
    return view(spark, sf, "points").select("id", cost.transition_penalty(F.col("id") % 5, kind, opt).alias("penalty"))


# --- territories ---

@query(f"{ctes('districts')} SELECT layer, tid AS territory_id, round((3 * lat0 + 2 * lat9) / 5, 9) AS lat, round((3 * lon0 + 2 * lon9) / 5, 9) AS lon FROM districts")
def territory_centroids(spark, sf):
    return territory.centroids(districts(spark, sf)).select("layer", "territory_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def city_layers(spark, sf) -> DataFrame:
    """Addresses' postcodes as territories of their city's layer, with one of three properties each."""
    a = view(spark, sf, "addresses").groupBy("city", "postcode").agg(F.min("id").alias("id"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    corner = lambda y, x: F.struct((F.col("lat") + y).alias("lat"), (F.col("lon") + x).alias("lon"))
    ring = F.array(corner(0.0, 0.0), corner(0.0, 0.001), corner(0.001, 0.001), corner(0.0, 0.0))
    props = F.create_map(F.concat(F.lit("key_"), (F.col("id") % 3).cast("string")), F.col("postcode"))
    hole = F.array().cast("array<array<struct<lat:double,lon:double>>>")
    return a.select(F.col("city").alias("layer"), F.col("postcode").alias("territory_id"), F.concat(F.lit("area "), "postcode").alias("name"), props.alias("props"), F.array(F.struct(ring.alias("outer"), hole.alias("holes"))).alias("geometry"))


@query(f"{ctes('addresses')} SELECT city AS layer, count(DISTINCT postcode) AS territories, min(postcode) AS first_id FROM addresses GROUP BY city")
def city_layer_counts(spark, sf):
    t = city_layers(spark, sf)
    return territory.layer_counts(t).join(t.groupBy("layer").agg(F.min("territory_id").alias("first_id")), "layer")


@query(f"{ctes('addresses')} SELECT DISTINCT city AS layer, 'key_' || (i % 3) AS key FROM (SELECT city, postcode, min(id) AS i FROM addresses GROUP BY 1, 2)")
def city_property_keys(spark, sf):
    return territory.property_keys(city_layers(spark, sf))


@query(f"{ctes('addresses')} SELECT postcode AS territory_id, 'area ' || postcode AS name, CASE WHEN min(id) % 3 = 1 THEN postcode ELSE '' END AS key_1 FROM addresses WHERE city = 'NATION_3' GROUP BY postcode")
def flat_territories(spark, sf):
    """A layer's territories by id, with a property as a column."""
    return dispatch.flatten(territory.in_layer(city_layers(spark, sf), "NATION_3"), ["territory_id", "key_1"])


@query(f"{ctes('districts')}, k AS (SELECT DISTINCT unnest(['depot', key]) AS key FROM districts WHERE layer = 'layer 3') SELECT 1 AS nth, 'territory_id' AS key UNION ALL SELECT CAST(row_number() OVER (ORDER BY key) + 1 AS INT), key FROM k")
def includable_keys(spark, sf):
    return dispatch.include_key_rows(districts(spark, sf), "layer 3")


# --- places ---

@query(f"{ctes('addresses', 'vertices')}, d AS (SELECT a.id AS qid, v.id, {hav('a.lat', 'a.lon', 'v.lat', 'v.lon')} AS m FROM addresses a JOIN vertices v ON abs(a.lat - v.lat) < 0.01 AND abs(a.lon - v.lon) < 0.01) SELECT qid, CAST(r AS INT) AS rank, id, round(m, 5) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, id) AS r FROM d WHERE m <= 250) WHERE r <= 5")
def nearest_five(spark, sf):
    q = view(spark, sf, "addresses").select(F.col("id").alias("qid"), "lat", "lon")
    return nearest.nearest(q, view(spark, sf, "vertices").select("id", "lat", "lon"), k=5, max_m=250.0).select("qid", "rank", "id", F.round("dist_m", 5).alias("dist_m"))


@query(f"{ctes('points', 'vertices')}, q AS (SELECT id AS qid, lat, lon FROM points WHERE id % 64 = 0), d AS (SELECT q.qid, v.id, {hav('q.lat', 'q.lon', 'v.lat', 'v.lon')} AS m FROM q, vertices v) SELECT qid, CAST(r AS INT) AS rank, id, round(m, 4) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, id) AS r FROM d) WHERE r <= 2")
def nearest_far_away(spark, sf):
    """The two nearest vertices of places (every 64th point) that mostly lie far outside the map."""
    q = view(spark, sf, "points").filter("id % 64 = 0").select(F.col("id").alias("qid"), "lat", "lon")
    return nearest.nearest(q, view(spark, sf, "vertices").select("id", "lat", "lon"), k=2).select("qid", "rank", "id", F.round("dist_m", 4).alias("dist_m"))


@query(f"{ctes('pois')}, r AS (SELECT *, CASE place WHEN 'city' THEN 100 WHEN 'town' THEN 80 WHEN 'village' THEN 60 WHEN 'quarter' THEN 45 WHEN 'hamlet' THEN 30 WHEN 'locality' THEN 15 ELSE 0 END AS rank FROM pois WHERE lat BETWEEN {WINDOW[0]}e0 AND {WINDOW[1]}e0 AND lon BETWEEN {WINDOW[2]}e0 AND {WINDOW[3]}e0) SELECT 11 AS zoom, name, place AS kind, rank FROM (SELECT * FROM r WHERE rank > 0 ORDER BY rank DESC, name, id LIMIT 24) UNION ALL SELECT 8, name, place, rank FROM (SELECT * FROM r WHERE rank > 0 ORDER BY rank DESC, name, id LIMIT 14)")
def zoom_labels(spark, sf):
    """Labels by zoom: none at 6, places at 8 and 11."""
    g, p = built(spark, sf), view(spark, sf, "pois")
    at = lambda z: poi.labels(p, g.streets, g.vertices, WINDOW, z).select(F.lit(z).alias("zoom"), "name", "kind", "rank")
    return at(6).unionByName(at(8)).unionByName(at(11))


@query(f"{ctes('pois')}, c AS (SELECT id, min(kind) AS k FROM (SELECT 7 AS id, 'node' AS kind UNION ALL SELECT 7, 'way' UNION ALL SELECT 7, 'relation') GROUP BY id) SELECT 'any' AS asked, 'way' AS kind, 7 AS id UNION ALL SELECT 'relation', 'relation', 7 UNION ALL SELECT 'node', kind, id FROM pois WHERE id = 9 AND kind = 'node'")
def place_lookup(spark, sf):
    """A place by id (of way, node and relation the first), and by kind and id."""
    p = view(spark, sf, "pois").select("kind", "id")
    p = p.filter("id <> 7").unionByName(p.filter("id = 7").select(F.explode(F.array(F.lit("node"), F.lit("relation"), F.lit("way"))).alias("kind"), "id"))
    row = lambda said, df: df.select(F.lit(said).alias("asked"), "kind", F.col("id").cast("int").alias("id"))
    return row("any", poi.lookup(p, 7)).unionByName(row("relation", poi.lookup(p, 7, "relation"))).unionByName(row("node", poi.lookup(p, 9, "node")))


@query(f"{ctes('ways', 'vertices', 'pois')}, w AS (SELECT w.id, avg(lat) AS lat, avg(lon) AS lon FROM (SELECT id, unnest(node_ids) AS node FROM ways WHERE id % 3 = 0) w JOIN vertices v ON v.id = node GROUP BY w.id), m AS (SELECT id % 2 AS id, unnest(node_ids) AS node FROM ways WHERE id % 3 = 0), r AS (SELECT m.id, avg(lat) AS lat, avg(lon) AS lon FROM m JOIN vertices v ON v.id = node GROUP BY m.id) SELECT 'node' AS kind, id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM pois WHERE kind = 'node' UNION ALL SELECT 'way', id, round(lat, 9), round(lon, 9) FROM w UNION ALL SELECT 'relation', id, round(lat, 9), round(lon, 9) FROM r")
def all_places(spark, sf):
    """Places of nodes, ways and relations."""
    park = lambda df: df.withColumn("tags", F.create_map(F.lit("leisure"), F.lit("park")))
    w = park(view(spark, sf, "ways").filter("id % 3 = 0").select("id", "node_ids"))
    member = F.struct(F.lit("way").alias("type"), F.col("id"), F.lit("").alias("role"))
    r = park(w.groupBy((F.col("id") % 2).alias("g")).agg(F.collect_list(member).alias("members")).select(F.col("g").alias("id"), "members"))
    nodes = view(spark, sf, "pois").filter("kind = 'node'").select("id", "lat", "lon", "tags")
    return poi.poi_points(nodes, w, r, view(spark, sf, "vertices").select("id", "lat", "lon")).select("kind", "id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("SELECT user_id AS session, count(*) AS kept, min(n) AS first FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) WHERE n > c - 40 GROUP BY user_id")
def last_forty(spark, sf):
    """The last 40 events of each user."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), nth.alias("turn"))
    return poi.last_messages(e).groupBy("session").agg(F.count("*").alias("kept"), F.min("turn").alias("first"))


# --- stations ---

def _stations(spark, sf, n: int) -> DataFrame:
    s = table(spark, sf, "supplier").filter(F.col("s_suppkey") % n == 0)
    manual = F.col("s_suppkey") % 4 == 0
    return s.select(F.concat(F.when(manual, "manual:").otherwise("osm:node/"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 6 == 0, " ").otherwise(F.col("s_name")).alias("name"), (F.lit(48.0) + F.col("s_suppkey") * 0.001).alias("lat"), F.lit(12.0).alias("lon"), F.col("s_suppkey").alias("k"))


_ST = "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'manual:' ELSE 'osm:node/' END || s_suppkey AS id, CASE WHEN s_suppkey % 6 = 0 THEN ' ' ELSE s_name END AS name, 48e0 + s_suppkey * 0.001e0 AS lat, 12e0 AS lon FROM supplier"


@query(f"WITH s AS ({_ST}), o AS (SELECT k, 'osm:node/' || k AS id, 'FF ' || k AS name, 48e0 + k * 0.001e0 AS lat FROM s) SELECT o.id, CASE WHEN trim(coalesce(s.name, '')) <> '' THEN s.name ELSE o.name END AS name, round(o.lat, 9) AS lat, 'osm' AS source FROM o LEFT JOIN (SELECT * FROM s WHERE k % 2 = 0) s ON s.id = o.id WHERE o.lat BETWEEN 48.01e0 AND 48.06e0 UNION ALL SELECT id, name, round(lat, 9), 'manual' FROM s WHERE k % 2 = 0 AND id LIKE 'manual:%' AND lat BETWEEN 48.01e0 AND 48.06e0")
def station_list(spark, sf):
    """Fire stations of the map with stored names, and manual ones, in a window."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("node").alias("kind"), (F.lit(48.0) + F.col("s_suppkey") * 0.001).alias("lat"), F.lit(12.0).alias("lon"), F.concat(F.lit(" FF "), F.col("s_suppkey").cast("string")).alias("n"))
    points = tagged(s, amenity=F.lit("fire_station"), name=F.col("n"))
    found = dispatch.list_stations(compose.osm_stations(points), _stations(spark, sf, 2), (48.01, 48.06, 11.0, 13.0))
    return found.select("id", "name", F.round("lat", 9).alias("lat"), "source")


@query(f"WITH s AS ({_ST}), o AS (SELECT * FROM s WHERE k % 2 = 0), c AS (SELECT k, id, CASE WHEN k % 5 = 0 THEN '' ELSE 'new ' || k END AS name, lat + 1 AS lat, k % 7 = 0 AS deleted FROM s WHERE k % 3 = 0) SELECT coalesce(c.id, o.id) AS id, CASE WHEN coalesce(c.name, '') <> '' THEN c.name ELSE trim(coalesce(o.name, '')) END AS name, round(CASE WHEN coalesce(c.id, o.id) LIKE 'manual:%' THEN coalesce(c.lat, o.lat) ELSE coalesce(o.lat, c.lat) END, 9) AS lat FROM o FULL JOIN c ON c.id = o.id WHERE NOT coalesce(deleted, false)")
def station_changes(spark, sf):
    k = F.col("k")
    c = _stations(spark, sf, 3).select("id", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("new "), k.cast("string"))).alias("name"), (F.col("lat") + 1).alias("lat"), "lon", (k % 7 == 0).alias("deleted"))
    return dispatch.upsert_stations(_stations(spark, sf, 2), c).select("id", "name", F.round("lat", 9).alias("lat"))


# --- answers ---

@query("SELECT p_partkey AS qid, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN p_brand END AS \"from\", CASE WHEN p_partkey % 4 < 2 THEN p_name END AS \"to\", CASE WHEN p_partkey % 4 < 2 THEN 'Gern.' || 'Bis bald' WHEN p_partkey % 4 = 2 THEN 'no block' ELSE 'x' || chr(10) || '```route-action' || chr(10) || '{\"action\": \"noop\"}' || chr(10) || '```' END AS clean FROM part")
def answer_actions(spark, sf):
    """Route actions in answers: with and without origin, none, and one of another kind."""
    k = F.col("p_partkey") % 4
    block = lambda doc: F.concat(F.lit("\n```route-action\n"), doc, F.lit("\n```"))
    doc = F.to_json(F.struct(F.lit("compute_route").alias("action"), F.when(k == 1, F.col("p_brand")).alias("from"), F.col("p_name").alias("to")))
    said = F.when(k < 2, F.concat(F.lit("Gern. "), block(doc), F.lit("\n Bis bald"))).when(k == 2, "no block").otherwise(F.concat(F.lit("x"), block(F.lit('{"action": "noop"}'))))
    return compose.route_actions(table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), said.alias("answer")))


@query("WITH a AS (SELECT p_partkey AS qid, CASE p_partkey % 8 WHEN 0 THEN 'highlight_poi' WHEN 1 THEN 'show_info' WHEN 2 THEN 'compute_route' WHEN 3 THEN 'ask_user' WHEN 4 THEN 'noop' WHEN 5 THEN 'zoom_to' WHEN 6 THEN 'add_waypoint' ELSE 'other' END AS type, p_partkey % 3 AS p FROM part) SELECT qid, type FROM a WHERE (type IN ('highlight_poi', 'show_info') AND p = 0) OR (type = 'compute_route' AND p = 1) OR type = 'noop' OR (type IN ('zoom_to', 'add_waypoint') AND p = 2)")
def valid_actions(spark, sf):
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(t) for t in ("highlight_poi", "show_info", "compute_route", "ask_user", "noop", "zoom_to", "add_waypoint", "other")])
    params = F.when(k % 3 == 0, F.create_map(F.lit("id"), F.lit("7"))).when(k % 3 == 1, F.create_map(F.lit("to"), F.lit("x"), F.lit("lat"), F.lit("1"))).otherwise(F.create_map(F.lit("lat"), F.lit("1"), F.lit("lon"), F.lit("2")))
    return compose.valid_actions(table(spark, sf, "part").select(k.alias("qid"), F.element_at(kinds, (k % 8 + 1).cast("int")).alias("type"), params.alias("params"))).select("qid", "type")


@query(f"{BUILT}, {STREETS}, q AS (SELECT * FROM (VALUES (1, 'strasse1'), (2, 'strasse'), (3, 'asse2'), (4, 'none')) AS q(qid, k)) SELECT qid, node, name FROM (SELECT qid, display AS name, node_ids[1] AS node, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN key = k THEN 3 WHEN starts_with(key, k) THEN 2 ELSE 1 END DESC, display, key) AS r FROM streets JOIN q ON contains(key, k)) WHERE r = 1")
def street_nodes(spark, sf):
    g = built(spark, sf)
    return search.street_node(g.streets, g.vertices, spark.sql("SELECT * FROM VALUES (1, 'Straße 1'), (2, 'straße'), (3, 'asse 2'), (4, 'none') AS q(qid, raw)"))


# --- graph ---

@query(f"{BUILT} SELECT src, string_agg(dst || ':' || printf('%.3f', dist_m), ',' ORDER BY dst, dist_m) AS heads FROM ed GROUP BY src")
def adjacency_lists(spark, sf):
    said = F.transform("out", lambda e: F.concat(e["dst"].cast("string"), F.lit(":"), F.format_string("%.3f", e["dist_m"])))
    return graph.adjacency(built(spark, sf).edges).select("src", F.array_join(said, ",").alias("heads"))


@query(f"{BUILT} SELECT way, src, dst FROM ed JOIN vertices p ON p.id = src JOIN vertices q ON q.id = dst WHERE p.lat BETWEEN {WINDOW[0]}e0 AND {WINDOW[1]}e0 AND p.lon BETWEEN {WINDOW[2]}e0 AND {WINDOW[3]}e0 AND q.lat BETWEEN {WINDOW[0]}e0 AND {WINDOW[1]}e0 AND q.lon BETWEEN {WINDOW[2]}e0 AND {WINDOW[3]}e0")
def window_edges(spark, sf):
    """The graph built for a window."""
    return graph.build_graph(view(spark, sf, "vertices").select("id", "lat", "lon"), view(spark, sf, "ways"), window=WINDOW).edges.select("way", "src", "dst")


@query(f"{ctes('directed')}, e AS (SELECT src, dst, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS m, speed_kph AS v FROM directed) SELECT src, dst, round(CASE WHEN src % 2 = 0 THEN m * 0.5 ELSE m END, 6) AS dist_m, CASE WHEN src % 2 = 0 THEN 7e0 ELSE v END AS speed_kph FROM e")
def parallel_edges(spark, sf):
    """Of parallel edges the shortest."""
    e, _ = grid(spark, sf)
    other = e.withColumn("dist_m", F.when(F.col("src") % 2 == 0, F.col("dist_m") * 0.5).otherwise(F.col("dist_m") * 1.5)).withColumn("speed_kph", F.lit(7.0))
    return routing.shortest_edges(e.unionByName(other)).select("src", "dst", F.round("dist_m", 6).alias("dist_m"), "speed_kph")


_CELL = "FROM vertices a JOIN vertices b ON b.id = a.id + 1 AND a.x < 39 JOIN vertices c ON c.id = a.id + 41 JOIN vertices d ON d.id = a.id + 40"


@query(f"{ctes('vertices')}, c AS (SELECT a.id, a.lat AS lat1, c.lat AS lat2, a.lon AS lon1, b.lon AS lon2 {_CELL}) SELECT id, 0 AS ring, 8 AS points, round(abs(radians(lon2 - lon1) * (2 * (2 + sin(radians(lat1)) + sin(radians(lat1))) - 2 * (2 + sin(radians(lat2)) + sin(radians(lat2)))) / 2) * 6378137e0 * 6378137e0 / 2, 1) AS area_m2 FROM c")
def area_rings(spark, sf):
    """Rings chained from the four ways around each cell of the grid, and their areas."""
    v = view(spark, sf, "vertices")
    corner = lambda n, p: v.select(F.col("id").alias(p), (F.col("id") - n).alias("id"))
    cells = v.filter("x < 39").select("id").join(corner(1, "b"), "id").join(corner(41, "c"), "id").join(corner(40, "d"), "id")
    lines = [("id", "b"), ("b", "c"), ("c", "d"), ("d", "id")]
    ways = cells.select(F.posexplode(F.array(*[F.array(a, b) for a, b in lines])).alias("k", "node_ids"), "id").select((F.col("id") * 4 + F.col("k")).alias("id"), "node_ids")
    member = lambda k: F.struct(F.lit("way").alias("type"), (F.col("id") * 4 + k).cast("long").alias("id"), F.lit("outer").alias("role"))
    relations = cells.select("id", F.array(*[member(k) for k in (0, 2, 3, 1)]).alias("members"))
    rings = compose.relation_rings(relations, ways, v.select("id", "lat", "lon"))
    sized = rings.select("id", "ring", F.size("points").alias("n"), F.round(compose.ring_area(F.col("points")), 1).alias("area_m2"))
    return sized.withColumnRenamed("n", "points")


RING = "round(radians(lon9 - lon0 - 0.002e0 * {0}) * (sin(radians(lat9 - 0.001e0 * {0})) - sin(radians(lat0 + 0.001e0 * {0}))) * 6378137e0 * 6378137e0, 9)"
FLAT = "(radians(lon9 - lon0 - 0.002e0 * {0}) * (ln(tan(pi() / 4 + radians(lat9 - 0.001e0 * {0}) / 2)) - ln(tan(pi() / 4 + radians(lat0 + 0.001e0 * {0}) / 2))) * 6378137e0 * 6378137e0)"


def _each_ring(of: str, last: str) -> str:
    """Sums of a figure of the rings 0 to k % 3 of a district: all, and with every second one taken off."""
    return ", ".join(f"{of.format(0)} + CASE WHEN k % 3 > 0 THEN {sign}{of.format(1)} ELSE 0e0 END + CASE WHEN k % 3 > 1 THEN {of.format(2)} ELSE 0e0 END AS {name}{last}" for name, sign in (("all_", ""), ("net_", "-")))


@query(f"{ctes('districts')}, b AS (SELECT *, lower('Bezirk ' || tid) AS name, {_each_ring(RING, 'm2')}, {_each_ring(FLAT, 'flat')} FROM districts), f AS (SELECT q.k AS qid, min(b.k) AS k FROM b q LEFT JOIN b ON b.k % 4 <> 1 AND contains(b.name, q.name) GROUP BY q.k) SELECT qid, f.k AS id, k % 3 + 1 AS rings, k % 2 = 0 AS forest, round(CASE WHEN k IS NULL THEN NULL WHEN k % 2 = 0 OR k % 3 = 0 THEN all_m2 ELSE 0e0 END, 1) AS area_m2, round(net_m2, 1) AS net_m2, round(net_flat, 1) AS mercator_m2, CASE WHEN k IS NOT NULL THEN 0 END AS outline FROM f LEFT JOIN b USING (k)")
def boundary_areas(spark, sf):
    """Areas of boundaries asked for by name: of each district up to three rings in each other, each of two ways. Every
    fourth district is no administrative area, so its name finds another or none."""
    d = view(spark, sf, "districts").withColumn("r", F.explode(F.sequence(F.lit(0), (F.col("k") % 3).cast("int"))))
    node = lambda n: (F.col("k") * 100 + F.col("r") * 10 + n).cast("long")
    low, high = (lambda c: F.col(c) + 0.001 * F.col("r")), (lambda c: F.col(c) - 0.001 * F.col("r"))
    corners = [(low("lat0"), low("lon0")), (low("lat0"), high("lon9")), (high("lat9"), high("lon9")), (high("lat9"), low("lon0"))]
    nodes = d.select(F.inline(F.array(*[F.struct(node(i).alias("id"), a.alias("lat"), b.alias("lon")) for i, (a, b) in enumerate(corners)])))
    way = lambda h: (F.col("k") * 10 + F.col("r") * 2 + h).cast("long")
    wood = F.when((F.col("k") % 2 == 0) & (F.col("r") == F.col("k") % 3), F.create_map(F.lit("landuse"), F.lit("forest"))).otherwise(F.create_map(F.lit("source"), F.lit("survey")))
    ways = d.select(F.inline(F.array(*[F.struct(way(h).alias("id"), wood.alias("tags"), F.array(*map(node, ids)).alias("node_ids")) for h, ids in enumerate(((0, 1, 2), (2, 3, 0)))])))
    member = lambda h: F.struct(F.lit("way").alias("type"), way(h).alias("id"), F.lit("outer").alias("role"))
    kind = F.when(F.col("k") % 4 == 1, "postal_code").otherwise("administrative")
    members = d.groupBy("k", "tid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", F.array(member(0), member(1)).alias("m")))), lambda x: x["m"])).alias("members"))
    relations = members.select(F.col("k").alias("id"), F.create_map(F.lit("boundary"), kind, F.lit("name"), F.concat(F.lit("Bezirk "), "tid")).alias("tags"), "members")
    questions = view(spark, sf, "districts").select(F.col("k").alias("qid"), F.concat(F.lit("bezirk-"), "tid").alias("name"))
    found = boundaries.area_report(questions, relations, ways, nodes)
    return found.select("qid", "id", "rings", "forest", *[F.round(c, 1).alias(c) for c in ("area_m2", "net_m2", "mercator_m2")], "outline")


@query(f"{ctes('positions')} SELECT qid, count(*) AS points, round(sum(lat), 6) AS lat, round(sum(lon), 6) AS lon FROM positions GROUP BY qid")
def route_lines(spark, sf):
    """Paths as GeoJSON lines, read back."""
    line = F.from_json("geojson", "type string, geometry struct<type:string,coordinates:array<array<double>>>")
    p = routing.line_strings(view(spark, sf, "positions")).select("qid", line["geometry"]["coordinates"].alias("c"))
    total = lambda i: F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + F.get(x, F.lit(i))), 6)
    return p.select("qid", F.size("c").cast("long").alias("points"), total(1).alias("lat"), total(0).alias("lon"))


# --- sources and sinks, read back ---

@query(f"{ctes('vertices', 'directed')} SELECT 'edge' AS kind, src AS a, dst AS b, round({hav('lat1', 'lon1', 'lat2', 'lon2')}, 6) AS x, speed_kph AS y FROM directed UNION ALL SELECT 'node', id, 0, lat, lon FROM vertices WHERE id IN (SELECT src FROM directed)")
def graph_json(spark, sf):
    """The street grid written as JSON and read again."""
    e, v = grid(spark, sf)
    path = scratch(spark)
    files.write_graph_json(v, e, path)
    v, e = files.read_graph_json(spark, path)
    rows = e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.round("dist_m", 6).alias("x"), F.col("speed_kph").alias("y"))
    return rows.unionByName(v.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("lat").alias("x"), F.col("lon").alias("y")))


@query(f"{ctes('addresses')} SELECT city AS layer, postcode AS territory_id, 4 AS points, round(min(lat), 9) AS lat, round(min(lon), 9) AS lon FROM addresses GROUP BY city, postcode")
def layer_files(spark, sf):
    """Layers written as GeoJSON with their manifest, and read again."""
    path = scratch(spark)
    files.write_layers(city_layers(spark, sf), path)
    t = files.read_layers(spark, path)
    ring = F.col("geometry")[0]["outer"]
    return t.select("layer", "territory_id", F.size(ring).alias("points"), F.round(ring[0]["lat"], 9).alias("lat"), F.round(ring[0]["lon"], 9).alias("lon"))


@query(zone_sql(f", {PROPS} SELECT CAST(p.id AS VARCHAR) AS parcel_id, coalesce(o.tid, '') AS territory_id, coalesce(depot, '') AS depot FROM points p LEFT JOIN own o ON o.id = p.id LEFT JOIN pr ON pr.tid = o.tid"))
def assignment_files(spark, sf):
    """Parcels written as CSV, read, assigned, written with a property, and read again."""
    path = scratch(spark)
    view(spark, sf, "points").select(F.col("id").alias("parcel_id"), "lat", "lon").write.csv(f"{path}/parcels", header=True)
    p = files.read_parcels(spark, f"{path}/parcels").withColumn("id", F.col("parcel_id"))
    a = dispatch.include_properties(territory.assign(p, zone_edges(spark)), zones(spark), ["depot"])
    files.write_assignments(a, f"{path}/assigned", ["depot"])
    back = spark.read.csv(f"{path}/assigned", header=True)
    return back.select("parcel_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("territory_id", "depot")])


@query(zone_sql(f", {PROPS} SELECT CASE WHEN coalesce(depot, '') = '' THEN 'UNASSIGNED' ELSE replace(depot, '|', '_') END || '.csv' AS file, count(*) AS parcels, CAST(sum(p.id) AS BIGINT) AS ids FROM points p LEFT JOIN own o ON o.id = p.id LEFT JOIN pr ON pr.tid = o.tid GROUP BY 1"))
def manifest_files(spark, sf):
    """One CSV file per manifest."""
    path = scratch(spark)
    p = view(spark, sf, "points").withColumn("row_ord", F.col("id"))
    a = territory.assign(p, zone_edges(spark)).select("id", "row_ord", "territory_id")
    files.write_manifests(dispatch.manifest_groups(a, zones(spark), "depot"), path)
    rows = spark.read.csv(path, header=True).select("id", F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("file").agg(F.count("*").alias("parcels"), F.sum(F.col("id").cast("long")).alias("ids"))


@query(f"WITH s AS ({_ST}) SELECT id, name, round(lat, 9) AS lat FROM s WHERE k % 2 = 0")
def station_files(spark, sf):
    """Stored stations written and read again."""
    path = scratch(spark)
    files.write_stations(_stations(spark, sf, 2), path)
    return files.read_stations(spark, path).select("id", "name", F.round("lat", 9).alias("lat"))


@query(f"{ctes('pois')} SELECT kind, id, name FROM pois")
def place_files(spark, sf):
    """The table of places written and read again."""
    path = scratch(spark)
    files.write_pois(view(spark, sf, "pois").select("kind", "id", "lat", "lon", "tags"), path)
    return files.read_pois(spark, path).select("kind", "id", osm.tag("tags", "name").alias("name"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'call ' || n_nationkey ELSE '' END AS callsign, 'T' || n_regionkey AS type, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'x' || n_nationkey END AS note FROM nation WHERE n_nationkey % 5 > 0")
def roster_files(spark, sf):
    """A roster with German headers in odd case; rows without a name go."""
    k = F.col("n_nationkey")
    path = scratch(spark)
    r = table(spark, sf, "nation").select(F.when(k % 5 > 0, F.col("n_name")).otherwise(" ").alias("DienstStelle"), F.when(k % 2 == 0, F.concat(F.lit("call "), k.cast("string"))).alias("Funkrufname"), F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("FAHRZEUGTYP"), F.when(k % 3 > 0, F.concat(F.lit("x"), k.cast("string"))).alias("Note"))
    r.write.csv(path, header=True)
    return files.read_roster(spark, path).select("name", "callsign", "type", F.coalesce(F.col("meta")["note"], F.lit("")).alias("note"))


@query(f"{ctes('addresses')} SELECT 'plz2' AS layer, substr(postcode, 1, 2) AS territory_id, count(DISTINCT postcode) AS polygons FROM addresses GROUP BY 2")
def postal_layers(spark, sf):
    """Postcode areas read from GeoJSON, grouped by two digits, published as a layer and read again."""
    path = scratch(spark)
    t = city_layers(spark, sf).withColumn("layer", F.lit("postcodes")).dropDuplicates(["territory_id"])
    files.write_geojson(t, f"{path}/source")
    return files.publish_postal(spark, f"{path}/source/layer=postcodes", 2, f"{path}/published").select("layer", "territory_id", F.size("geometry").cast("long").alias("polygons"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS value FROM part")
def redacted_settings(spark, sf):
    """Settings without what only the server may know."""
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "ai.OpenAI_api_key").when(F.col("p_partkey") % 3 == 1, "ai.model").otherwise("openai_api_key.note").alias("key"), F.col("p_name").alias("value"))
    out = files.public_settings(p.select(F.concat(F.col("p_partkey").cast("string"), F.lit("."), "key").alias("key"), "value"))
    return out.select(F.substring_index("key", ".", 1).cast("long").alias("k"), "value")


# --- routes over several stops ---

CHAINS = 40


@query(f"{ctes('directed')}, e AS (SELECT src, dst, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS m FROM directed), n AS (SELECT count(DISTINCT src) AS n FROM directed), q AS (SELECT range AS qid, 1 + (range * 7919) % n AS a, 1 + (range * 104729) % n AS b, 1 + (range * 611953) % n AS c FROM range({CHAINS}), n), d(root, node, cost) USING KEY (root, node) AS (SELECT DISTINCT r, r, 0e0 FROM (SELECT a AS r FROM q UNION SELECT b FROM q) UNION SELECT d.root, e.dst, min(d.cost + e.m) FROM d JOIN e ON e.src = d.node LEFT JOIN recurring.d AS k ON k.root = d.root AND k.node = e.dst WHERE k.cost IS NULL OR d.cost + e.m < k.cost - 1e-9 GROUP BY d.root, e.dst) SELECT qid, CASE WHEN x.cost IS NULL OR y.cost IS NULL THEN 'no path' ELSE 'ok' END AS status, round(x.cost + y.cost, 4) AS cost, CASE WHEN x.cost IS NOT NULL AND y.cost IS NOT NULL THEN true END AS joined FROM q LEFT JOIN d x ON x.root = a AND x.node = b LEFT JOIN d y ON y.root = b AND y.node = c")
def chained_routes(spark, sf):
    """Routes over a stop: legs joined, the joint once, so that each step of the path is an edge."""
    e, v = grid(spark, sf)
    e, v = cut(e), cut(v)
    n = v.count()
    q = spark.range(CHAINS).select(F.col("id").alias("qid"), *[(1 + (F.col("id") * k) % n).alias(c) for c, k in (("a", 7919), ("b", 104729), ("c", 611953))])
    stops = q.select("qid", F.posexplode(F.array("a", "b", "c")).alias("pos", "node"))
    r = cut(routing.route_chains(stops, e, v, cost.RouteOptions(engine="dijkstra-node")))
    steps = routing.path_steps(r).join(e.select("src", "dst", F.lit(1).alias("known")), ["src", "dst"], "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("known").alias("k"))
    whole = r.join(q, "qid").join(steps, "qid", "left")
    joined = (F.element_at("path", 1) == F.col("a")) & (F.element_at("path", -1) == F.col("c")) & F.array_contains("path", F.col("b")) & (F.coalesce("n", F.lit(0)) == F.coalesce("k", F.lit(0))) & (F.coalesce("n", F.lit(0)) == F.size("path") - 1)
    return whole.select("qid", "status", F.round("cost", 4).alias("cost"), F.when(F.col("status") == "ok", joined).alias("joined"))


@query(f"{ctes('directed')}, e AS (SELECT src, dst, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS m FROM directed), g AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src), rk AS (SELECT id, row_number() OVER (ORDER BY degree, id) AS rank FROM g), u AS (SELECT e.* FROM e JOIN rk a ON a.id = src JOIN rk b ON b.id = dst WHERE b.rank > a.rank), n AS (SELECT count(DISTINCT src) AS n FROM directed), q AS (SELECT DISTINCT 1 + (range * 37) % n AS a, 1 + (range * 41 + 3) % n AS b FROM range({CHAINS}), n), d(root, node, cost) USING KEY (root, node) AS (SELECT DISTINCT r, r, 0e0 FROM (SELECT a AS r FROM q UNION SELECT b FROM q) UNION SELECT d.root, u.dst, min(d.cost + u.m) FROM d JOIN u ON u.src = d.node LEFT JOIN recurring.d AS k ON k.root = d.root AND k.node = u.dst WHERE k.cost IS NULL OR d.cost + u.m < k.cost - 1e-9 GROUP BY d.root, u.dst) SELECT a AS from_id, b AS to_id, round(min(x.cost + y.cost), 4) AS cost FROM q JOIN d x ON x.root = a JOIN d y ON y.root = b AND y.node = x.node GROUP BY a, b")
def upward_searches(spark, sf):
    """Searches from both ends over edges to higher ranks."""
    e, v = grid(spark, sf)
    e, v = cut(e), cut(v)
    n = v.count()
    q = spark.range(CHAINS).select((1 + (F.col("id") * 37) % n).alias("from_id"), (1 + (F.col("id") * 41 + 3) % n).alias("to_id")).distinct()
    up = graph.upward_edges(e, graph.contraction_ranks(e))
    return routing.upward_costs(q, up, v).select("from_id", "to_id", F.round("cost", 4).alias("cost"))


_NAMES = "nn AS (SELECT node, min(display) AS name FROM (SELECT display, unnest(node_ids) AS node FROM streets) GROUP BY node)"
_STEP = "SELECT qid, pos, 1 + x + 40 * y AS node FROM (SELECT k.x AS qid, CASE WHEN v.y = 0 THEN v.x ELSE k.x + v.y END AS pos, v.x, v.y FROM vertices v JOIN (SELECT DISTINCT x FROM vertices) k ON (v.y = 0 AND v.x <= k.x) OR v.x = k.x)"


@query(f"{BUILT}, {STREETS}, {_NAMES}, sh AS (SELECT src, dst, arg_min(speed_kph, dist_m) AS v FROM ed GROUP BY 1, 2), a AS (SELECT qid, pos, s.node, lat, lon, coalesce(name, '') AS name FROM ({_STEP}) s JOIN vx ON vx.id = s.node LEFT JOIN nn ON nn.node = s.node), b AS (SELECT *, lead(node) OVER o AS nxt, lead(lat) OVER o AS nlat, lead(lon) OVER o AS nlon, lead(name) OVER o AS nname, max(pos) OVER (PARTITION BY qid) AS last FROM a WINDOW o AS (PARTITION BY qid ORDER BY pos)), c AS (SELECT b.*, CASE WHEN nxt IS NULL THEN NULL ELSE {bear('lat', 'lon', 'nlat', 'nlon')} END AS br, coalesce({hav('lat', 'lon', 'nlat', 'nlon')}, 0) AS m, coalesce({hav('lat', 'lon', 'nlat', 'nlon')}, 0) * 3.6 / CASE WHEN v > 0 THEN v ELSE 50e0 END AS s FROM b LEFT JOIN sh ON src = node AND dst = nxt), d AS (SELECT *, sum(m) OVER o - m AS mb, sum(s) OVER o - s AS sb, sum(m) OVER w AS ma, sum(s) OVER w AS sa, (br - lag(br) OVER o + 540) % 360 - 180 AS turn FROM c WINDOW o AS (PARTITION BY qid ORDER BY pos), w AS (PARTITION BY qid)), i AS (SELECT *, abs(turn) >= 45 AS sharp FROM d WHERE pos > 0 AND pos < last AND (abs(turn) >= 45 OR (name <> '' AND nname <> '' AND name <> nname))), t AS (SELECT qid, pos, 1 AS part, CASE WHEN sharp AND abs(turn) > 150 THEN 'uturn' WHEN sharp AND turn > 0 THEN 'turn-right' WHEN sharp THEN 'turn-left' ELSE 'turn' END AS type, CASE WHEN sharp AND abs(turn) > 150 THEN 'Wenden' WHEN sharp AND turn > 0 THEN 'Rechts abbiegen' WHEN sharp THEN 'Links abbiegen' ELSE 'Abbiegen' END || CASE WHEN nname <> '' THEN ' auf ' || nname ELSE '' END AS instruction, node, CASE WHEN lead(pos) OVER o IS NULL THEN ma - mb ELSE mb - coalesce(lag(mb) OVER o, 0) END AS x, CASE WHEN lead(pos) OVER o IS NULL THEN sa - sb ELSE sb - coalesce(lag(sb) OVER o, 0) END AS y, mb FROM i WINDOW o AS (PARTITION BY qid ORDER BY pos)), z AS (SELECT qid, pos, part, type, instruction, node, x, y FROM t UNION ALL SELECT d.qid, pos, 0, 'depart', 'Los geht''s', node, coalesce(f, ma), CASE WHEN f IS NULL THEN sa ELSE 0 END FROM d LEFT JOIN (SELECT qid, min(mb) AS f FROM t GROUP BY qid) g ON g.qid = d.qid WHERE pos = 0 AND last > 0 UNION ALL SELECT qid, pos, 2, 'arrive', 'Ziel erreicht', node, 0, 0 FROM d WHERE pos = last) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY part, pos) AS INT) AS nth, type, instruction, node, round(x, 4) AS distance_m, round(y, 4) AS duration_s FROM z")
def path_instructions(spark, sf):
    """Instructions along paths that follow the first row of the grid up to each column and then the column."""
    g = built(spark, sf)
    g = graph.Graph(cut(g.edges), cut(g.vertices), cut(g.streets))
    v = view(spark, sf, "vertices")
    k = v.select(F.col("x").alias("qid")).distinct()
    row = v.filter("y = 0").join(k, F.col("x") <= F.col("qid")).select("qid", F.col("x").alias("pos"), F.col("id").alias("node"))
    down = v.filter("y > 0").select(F.col("x").alias("qid"), (F.col("x") + F.col("y")).alias("pos"), F.col("id").alias("node"))
    paths = row.unionByName(down).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda n: n["node"]).alias("path"))
    m = routing.maneuvers(graph.path_coords(paths, g.vertices), g.edges, graph.node_street_names(g.streets))
    return m.select("qid", "nth", "type", "instruction", "node", F.round("distance_m", 4).alias("distance_m"), F.round("duration_s", 4).alias("duration_s"))


# --- the assistant ---

_ENDS = f"{ctes('pois', 'vertices')}, r AS (SELECT o_orderkey AS qid, ['promo', 'small', 'medium', 'large'][CAST(o_orderkey % 4 AS INT) + 1] AS value, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon FROM orders JOIN vertices a ON a.id = o_custkey % (SELECT count(*) FROM part) + 1 JOIN vertices b ON b.id = o_orderkey % (SELECT count(*) FROM part) + 1), w AS (SELECT qid, value, least(alat, blat) AS lat0, greatest(alat, blat) AS lat9, least(alon, blon) AS lon0, greatest(alon, blon) AS lon9 FROM r)"


def order_routes(spark, sf) -> DataFrame:
    """Bounds of a route for each order, between two vertices."""
    n = table(spark, sf, "part").count()
    end = lambda p, c: view(spark, sf, "vertices").select((F.col("id") - 1).alias(c), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % n).alias("a"), (F.col("o_orderkey") % n).alias("b")).join(end("a", "a"), "a").join(end("b", "b"), "b")
    return o.select("qid", *[f(f"a{c}", f"b{c}").alias(name) for c, low, high in (("lat", "min_lat", "max_lat"), ("lon", "min_lon", "max_lon")) for f, name in ((F.least, low), (F.greatest, high))])


@query(f"{_ENDS}, d AS (SELECT qid, id, name AS label, {hav('(lat0 + lat9) / 2', '(lon0 + lon9) / 2', 'lat', 'lon')} AS m FROM w JOIN pois ON kind = 'way' AND shop = value AND lat BETWEEN lat0 AND lat9 AND lon BETWEEN lon0 AND lon9) SELECT qid, CAST(rank AS INT) AS rank, id, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(m, 6), id) AS rank FROM d) WHERE rank <= 8")
def pois_on_routes(spark, sf):
    """Every order's route with every place: the eight nearest to its middle."""
    value = F.element_at(F.array(*[F.lit(x) for x in ("promo", "small", "medium", "large")]), (F.col("qid") % 4 + 1).cast("int"))
    return poi.on_routes(view(spark, sf, "pois"), order_routes(spark, sf).select("*", F.lit("shop").alias("key"), value.alias("value"))).select("qid", "rank", "id", "label")


@query(f"{_ENDS}, d AS (SELECT qid, id, name AS label, {hav('(lat0 + lat9) / 2', '(lon0 + lon9) / 2', 'lat', 'lon')} AS m FROM w JOIN pois ON kind = 'way' AND amenity = 'cafe' AND qid % 3 = 0 AND lat BETWEEN lat0 AND lat9 AND lon BETWEEN lon0 AND lon9) SELECT qid, CAST(rank AS INT) AS rank, id, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(m, 6), id) AS rank FROM d) WHERE rank <= 8")
def places_on_routes(spark, sf):
    """Every order's route with a prompt: a café on the way, one near by, or none on the way of its kind."""
    said = F.element_at(F.array(F.lit("Café auf dem Weg"), F.lit("Café in der Nähe"), F.lit("Museum auf dem Weg")), (F.col("qid") % 3 + 1).cast("int"))
    routes = order_routes(spark, sf)
    return assistant.places_on_routes(routes.select("qid", said.alias("prompt")), routes, view(spark, sf, "pois")).select("qid", "rank", "id", "label")


_PLACES = f"{ctes('vertices')}, p AS (SELECT v.id, v.lat, v.lon, p_name AS name, part.p_size AS s FROM part JOIN vertices v ON v.id = p_partkey + 1), q AS (SELECT c_custkey AS qid, 48e0 + 0.001e0 * (c_custkey % 53) + 0.0003e0 AS qlat, 12e0 + 0.001e0 * (c_custkey % 41) + 0.0002e0 AS qlon, c_custkey % 6 AS class, part.p_name AS asked FROM customer JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part))"


def asked_places(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Parts as places (kind, id, lat, lon, tags) and questions (qid, prompt, lat, lon) of customers, of six kinds."""
    v, n = view(spark, sf, "vertices").select("id", "lat", "lon"), table(spark, sf, "part").count()
    own = table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("id"), "p_name", F.col("p_size").alias("s")).join(v, "id")
    when = lambda m, x: F.when(F.col("s") % m == 0, x).otherwise("")
    places = cut(tagged(own, name=F.col("p_name"), natural=when(6, "water"), landuse=when(7, "forest"), amenity=when(5, "Pharmacy"), shop=when(4, "bakery")).select(F.when(F.col("id") % 2 == 0, "way").otherwise("node").alias("kind"), "id", "lat", "lon", "tags"))
    q = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % n).alias("p_partkey")).join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    said = F.element_at(F.array(F.lit("Wo ist der nächste See?"), F.lit("where is the nearest forest"), F.lit("nächste Apotheke in der Nähe"), F.lit("Nächste Bäckerei!"), F.concat(F.lit("nearest "), "p_name"), F.concat(F.lit("wo ist der nächste große "), "p_name", F.lit("-laden 48.0, 12.0"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    q = q.select(F.col("c_custkey").alias("qid"), said.alias("prompt"), (48 + 0.001 * (F.col("c_custkey") % 53) + 0.0003).alias("lat"), (12 + 0.001 * (F.col("c_custkey") % 41) + 0.0002).alias("lon"))
    return q, places


@query(f"{_PLACES}, m AS (SELECT qid, class, id, {hav('qlat', 'qlon', 'lat', 'lon')} AS d, row_number() OVER (PARTITION BY qid ORDER BY name <> asked, id) AS nth FROM q JOIN p ON (class = 0 AND s % 6 = 0) OR (class = 1 AND s % 7 = 0) OR (class = 2 AND s % 5 = 0 AND id % 2 = 0) OR (class = 3 AND s % 4 = 0 AND id % 2 = 0) OR (class = 4 AND contains(name, asked)) OR (class = 5 AND contains(asked, name))) SELECT qid, ['lake', 'forest', 'apotheke', 'bäckerei', 'address', 'name'][CAST(any_value(class) AS INT) + 1] AS stage, arg_min(id, struct_pack(d := round(d, 6), i := id)) AS id FROM m WHERE class <> 4 OR nth <= 50 GROUP BY qid")
def nearest_places(spark, sf):
    """A question of every customer: a lake, a forest, a pharmacy, a bakery, and names within names both ways."""
    q, places = asked_places(spark, sf)
    g = built(spark, sf)
    return assistant.nearest_places(q, places.drop("kind"), places, g.streets, g.vertices, poi.brand_aliases(places)).select("qid", "stage", "id")


@query(f"{_PLACES}, m AS (SELECT qid, id, {hav('qlat', 'qlon', 'lat', 'lon')} AS d, row_number() OVER (PARTITION BY qid ORDER BY name <> asked, id) AS nth, class FROM q JOIN p ON class = 4 AND contains(name, asked)) SELECT qid, arg_min(id, struct_pack(d := round(d, 6), i := id)) AS id FROM m WHERE nth <= 200 GROUP BY qid")
def nearest_named(spark, sf):
    """The nearest of the 200 best places of the name that a sixth of the customers ask for."""
    q, places = asked_places(spark, sf)
    return compose.nearest_named(q.filter("qid % 6 = 4"), places.drop("kind"), poi.brand_aliases(places)).select("qid", "id")


_ACTS = ("highlight_poi", "show_info", "compute_route", "noop", "zoom_to", "dance")
_NODE = f"(SELECT arg_min(v.id, struct_pack(d := round({hav('v.lat', 'v.lon', 'LAT', 'LON')}, 6), i := v.id)) FROM vertices v)"


@query(f"""{ctes('pois', 'vertices')}, a AS (SELECT c_custkey // 4 AS qid, CAST(c_custkey % 4 AS INT) AS nth, {list(_ACTS)!r}[CASE WHEN c_custkey % 97 = 5 THEN 6 ELSE CAST(c_custkey % 5 AS INT) + 1 END] AS type, c_custkey AS k, c_custkey % 89 = 3 AS bare, (SELECT count(*) FROM part) AS n FROM customer),
    f AS (SELECT *, CASE WHEN type = 'dance' THEN 'action ' || nth || ': unknown action type: dance' WHEN bare AND type IN ('highlight_poi', 'show_info') THEN 'action ' || nth || ': missing id param for ' || type WHEN bare AND type = 'compute_route' THEN 'action ' || nth || ': missing to param for compute_route' END AS fault FROM a),
    b AS (SELECT qid, min(nth) AS nth FROM f WHERE fault IS NOT NULL GROUP BY qid)
    SELECT qid, nth, type, fault AS error, NULL AS id, NULL AS kind, NULL AS from_node, NULL AS to_node, NULL AS note FROM f SEMI JOIN b USING (qid, nth)
    UNION ALL SELECT f.qid, f.nth, type, CASE WHEN k % 11 = 0 THEN 'invalid id' WHEN p.id IS NULL THEN 'not found' END, CASE WHEN k % 11 <> 0 THEN p.id END, CASE WHEN k % 11 <> 0 THEN p.kind END, NULL, NULL, NULL FROM f LEFT JOIN pois p ON p.id = k % (n + 40) + 1 WHERE type IN ('highlight_poi', 'show_info') AND f.qid NOT IN (SELECT qid FROM b)
    UNION ALL SELECT f.qid, f.nth, type, CASE WHEN k % 7 = 0 THEN 'from: not found' WHEN p.id IS NULL THEN 'to: not found' END, NULL, NULL, CASE WHEN k % 7 <> 0 AND p.id IS NOT NULL THEN {_NODE.replace('LAT', '(48e0 + 0.001e0 * (k % 9))').replace('LON', '(12e0 + 0.001e0 * (k % 7))')} END, CASE WHEN k % 7 <> 0 AND p.id IS NOT NULL THEN p.id END, NULL FROM f LEFT JOIN pois p ON p.id = k % (n + 40) + 1 WHERE type = 'compute_route' AND f.qid NOT IN (SELECT qid FROM b)
    UNION ALL SELECT qid, nth, type, NULL, NULL, NULL, NULL, NULL, 'no-op on server' FROM f WHERE type IN ('noop', 'zoom_to') AND qid NOT IN (SELECT qid FROM b)""")
def action_bundles(spark, sf):
    """Four customers' actions a bundle: places by id, ways between a position and a place, faulty ones, unknown ids."""
    n, k = table(spark, sf, "part").count(), F.col("c_custkey")
    kind = F.when(k % 97 == 5, "dance").otherwise(F.element_at(F.array(*[F.lit(t) for t in _ACTS]), (k % 5 + 1).cast("int")))
    place = F.when(k % 11 == 0, "x7").otherwise((k % (n + 40) + 1).cast("string"))
    start = F.when(k % 7 != 0, F.struct((48 + 0.001 * (k % 9)).alias("lat"), (12 + 0.001 * (k % 7)).alias("lon")))
    doc = F.when(k % 89 == 3, "{}").otherwise(F.to_json(F.struct(place.alias("id"), start.alias("from"), F.struct((k % (n + 40) + 1).alias("id")).alias("to"))))
    acts = table(spark, sf, "customer").select(F.floor(k / 4).alias("qid"), (k % 4).cast("int").alias("nth"), kind.alias("type"), doc.alias("params"))
    e, v = grid(spark, sf)
    both_ways = e.unionByName(e.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in e.columns]))
    out = assistant.run_bundles(acts, view(spark, sf, "addresses"), view(spark, sf, "pois"), built(spark, sf).streets, both_ways, v, paths=False)
    return out.select("qid", "nth", "type", "error", "id", "kind", "from_node", "to_node", "note")


@query(f"""{ctes('pois')}, a AS (SELECT {norm_compare('name')} AS c FROM pois UNION ALL SELECT {norm_compare('brand')} FROM pois), b(alias) AS (VALUES ('maci'), ('mcdo'), ('mcd'), ('mcdonald'), ('mcdonalds'), ('macdonalds'), ('maccdonalds'), ('macca')),
    k AS (SELECT replace(c, ' ', '') AS alias, min(c) AS canonical FROM a WHERE c <> '' GROUP BY 1 UNION ALL SELECT alias, 'mcdonalds' FROM b),
    q AS (SELECT c_custkey AS qid, CASE c_custkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_brand, '#', ' ') WHEN 2 THEN 'Mc Do' ELSE concat('no ', p_name) END AS raw FROM customer JOIN part ON p_partkey = c_custkey % (SELECT count(*) FROM part))
    SELECT qid, canonical FROM q JOIN k ON alias = replace({norm_compare('raw')}, ' ', '')""")
def alias_lookups(spark, sf):
    """What every customer calls a place: a name in capitals, a brand, a chain's nickname, and no alias at all."""
    n = table(spark, sf, "part").count()
    q = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % n).alias("p_partkey")).join(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    raw = F.element_at(F.array(F.upper("p_name"), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit("Mc Do"), F.concat(F.lit("no "), "p_name")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return intent.lookup_alias(q.select(F.col("c_custkey").alias("qid"), raw.alias("raw")), poi.brand_aliases(view(spark, sf, "pois")))


@query(f"{ctes('directed')}, e AS (SELECT src, dst, {hav('lat1', 'lon1', 'lat2', 'lon2')} * [1.5e0, 0.8e0, 1.5e0, 2e0][CAST(floor(((dst - 1) % 40) / 10) AS INT) + 1] AS m FROM directed), d(node, cost) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), 0e0 UNION SELECT e.dst, min(d.cost + e.m) FROM d JOIN e ON e.src = d.node LEFT JOIN recurring.d AS k ON k.node = e.dst WHERE k.cost IS NULL OR d.cost + e.m < k.cost - 1e-9 GROUP BY e.dst) SELECT v.src AS to_id, round(d.cost, 4) AS cost FROM (SELECT DISTINCT src FROM directed) v JOIN d ON d.node = v.src")
def territory_routes(spark, sf):
    """From the first vertex to all others, where streets of one's own territory are cheap, those of its neighbours dearer,
    and others dearest; the territories are four strips of the grid."""
    e, v = grid(spark, sf)
    strip = view(spark, sf, "vertices").groupBy(F.floor(F.col("x") / 10).alias("t")).agg((F.min("lat") - 0.001).alias("lat0"), (F.max("lat") + 0.001).alias("lat9"), (F.min("lon") - 0.0005).alias("lon0"), (F.max("lon") + 0.0004).alias("lon9"))
    corner = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    ring = F.array(*[corner(*c) for c in (("lat0", "lon0"), ("lat0", "lon9"), ("lat9", "lon9"), ("lat9", "lon0"))])
    hole = F.array().cast("array<array<struct<lat:double,lon:double>>>")
    t = strip.select(F.lit("strips").alias("layer"), F.concat(F.lit("T"), F.col("t").cast("string")).alias("territory_id"), F.array(F.struct(ring.alias("outer"), hole.alias("holes"))).alias("geometry"))
    factors = cut(territory.cost_factors(v, territory.edges_of(t), "T1", same=0.8, neighbor=1.5, foreign=2.0))
    pairs = v.select(F.lit(1).cast("long").alias("from_id"), F.col("id").alias("to_id"))
    return routing.route_pairs(pairs, e, v, cost.RouteOptions(), factors, paths=False).select("to_id", F.round("cost", 4).alias("cost"))


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 4 AS kind, c_custkey % (SELECT count(*) FROM supplier) AS spot, CASE c_custkey % 4 WHEN 0 THEN '2.1.3 FF ' || c_name WHEN 1 THEN 'FF ' || c_name || ' Nord' WHEN 2 THEN 'WF Nirgends-' || c_custkey ELSE 'Ohne Ort-' || c_custkey END AS name FROM customer),
    f AS (SELECT spot, min(k) AS k FROM r WHERE kind = 2 GROUP BY spot)
    SELECT name, CASE WHEN kind = 0 THEN 'exact' WHEN kind = 1 THEN 'substring' WHEN f.k IS NOT NULL THEN 'guessed' ELSE 'unmatched' END AS match, CASE WHEN kind < 2 THEN 's' || r.k WHEN f.k IS NOT NULL THEN 'u' || r.spot END AS id FROM r LEFT JOIN f ON f.k = r.k""")
def roster_match_many(spark, sf):
    """A name for every customer: that of a station, one that holds a station's, one near an unnamed station, which the
    first of them takes, and one that is nowhere."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    k, n = F.col("c_custkey"), s.count()
    text_of = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    name = F.element_at(F.array(text_of("2.1.3 FF ", F.col("c_name")), text_of("FF ", F.col("c_name"), " Nord"), text_of("WF Nirgends-", k), text_of("Ohne Ort-", k)), (k % 4 + 1).cast("int"))
    roster = c.select(name.alias("name"), k.alias("first_row"))
    named = c.select(text_of("s", k).alias("id"), text_of("Feuerwehr ", F.col("c_name")).alias("name"), F.lit(10.0).alias("lat"), F.lit(10.0).alias("lon"))
    unnamed = s.select(text_of("u", F.col("s_suppkey")).alias("id"), F.lit("").alias("name"), (40 + 0.02 * F.col("s_suppkey")).alias("lat"), F.lit(11.0).alias("lon"))
    hints = c.filter(k % 4 == 2).select(name.alias("name"), (40 + 0.02 * (k % n) + 0.001).alias("lat"), F.lit(11.001).alias("lon"))
    return dispatch.match_roster(roster, named.unionByName(unnamed), hints).select("name", "match", "id")


# --- windows of requests ---

@query(f"""{ctes('points')}, q AS (SELECT id, id % 7 AS k, lat, lon, 48.4e0 + (id % 3) * 0.1e0 AS low, 48.8e0 AS high FROM points),
    r AS (SELECT *, CASE WHEN k = 1 THEN 'invalid lat/lon' WHEN k IN (3, 6) THEN 'missing query or lat/lon' WHEN k IN (0, 2, 5) AND id % 5 <> 0 AND NOT (round(lat, 6) BETWEEN low AND high AND round(lon, 6) BETWEEN 12.6 AND 13.2) THEN 'outside configured window' END AS error FROM q)
    SELECT id AS qid, CASE WHEN error IS NULL AND k IN (0, 2, 5) THEN round(lat, 6) END AS lat, CASE WHEN error IS NULL AND k IN (0, 2, 5) THEN round(lon, 6) END AS lon, CASE WHEN k = 4 THEN 'small ring' END AS raw, error FROM r""")
def window_checks(spark, sf):
    """Requests with positions, texts of positions, names, nothing, and positions outside the world; four in five with a window."""
    k, id = F.col("id") % 7, F.col("id")
    lat, lon = F.round("lat", 6), F.round("lon", 6)
    p = view(spark, sf, "points")
    told = F.format_string("%.6f, %.6f", "lat", "lon")
    raw = F.when(k == 2, told).when(k == 4, " small ring ").when(k == 3, "  ")
    q = p.select(id.alias("qid"), F.when(k.isin(0, 5), lat).when(k == 1, lat + 90).alias("lat"), F.when(k.isin(0, 1, 5), lon).alias("lon"), raw.alias("raw"))
    w = p.filter("id % 5 <> 0").select(id.alias("qid"), (48.4 + (id % 3) * 0.1).alias("min_lat"), F.lit(48.8).alias("max_lat"), F.lit(12.6).alias("min_lon"), F.lit(13.2).alias("max_lon"))
    return search.check_locations(q, w)


@query(f"{ctes('addresses', 'points')}, f AS (SELECT a.id AS qid, b.id, b.lat, b.lon FROM addresses a JOIN addresses b ON a.postcode = b.postcode OR b.id = a.id % 50 + 1) SELECT qid, id FROM f WHERE qid % 4 = 0 OR (lat BETWEEN 48.01 AND 48.04 AND lon BETWEEN 12e0 AND 12.02)")
def results_in_windows(spark, sf):
    """Addresses found for addresses, of which three in four ask within a window."""
    a = view(spark, sf, "addresses").select("id", "lat", "lon", "postcode")
    asked = a.select(F.col("id").alias("qid"), F.col("postcode").alias("p"))
    found = asked.join(a, F.col("p") == F.col("postcode")).select("qid", "id", "lat", "lon").unionByName(asked.join(a, F.col("id") == F.col("qid") % 50 + 1).select("qid", "id", "lat", "lon")).distinct()
    w = asked.filter("qid % 4 <> 0").select("qid", F.lit(48.01).alias("min_lat"), F.lit(48.04).alias("max_lat"), F.lit(12.0).alias("min_lon"), F.lit(12.02).alias("max_lon"))
    return search.in_windows(found, w).select("qid", "id")


# --- extracts ---

@query(f"{ctes('points')} SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon, CASE WHEN id % 3 = 0 THEN 'yes' ELSE '' END AS mark, true AS pruned FROM points WHERE lat BETWEEN 48.4 AND 48.6 AND lon > 12.7 AND lon <= 12.95")
def extract_window(spark, sf):
    """All points written as extracts, their blocks indexed, and a window read back by a filter on lat and lon: its rows,
    and whether fewer blocks were read than there are."""
    folder = f"{scratch(spark)}-extracts"
    path = folder.removeprefix("file:")
    pbf.write(tagged(view(spark, sf, "points"), mark=F.when(F.col("id") % 3 == 0, "yes").otherwise("")), path, files=4, block=200)
    blocks = spark.read.parquet(pbf.index_folder(spark, path)).count()
    read = pbf.read(spark, path, frames="1").filter((F.col("lat") >= 48.4) & (F.col("lat") <= 48.6) & (F.col("lon") > 12.7) & (F.col("lon") <= 12.95))
    pruned = read.rdd.getNumPartitions() < blocks  # a partition a block
    return read.select("id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.coalesce(F.col("tags")["mark"], F.lit("")).alias("mark"), F.lit(pruned).alias("pruned"))

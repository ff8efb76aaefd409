"""The registered queries of the map engine, and the SQL that gives the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import cost, geo, osm, text
from geoweft.functions.lineage import cut
from geoweft.operators import compose, dispatch, graph, intent, nearest, poi, routing, search, territory, trips
from geoweft.plans.views import ZONES, ctes, districts, table, view, zone_edges_sql, zones

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MIDDLE = (48.5, 12.8)
WINDOW = (48.005, 48.03, 12.004, 12.031)


def query(sql: str | None = None):
    """Registers a function as a query, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- the oracle's formulas ---

def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    return f"(2 * 6371000e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def bear(a: str, b: str, c: str, d: str) -> str:
    return f"((degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b}))))) + 360) % 360)"


def seg(lat: str, lon: str) -> str:
    """Distance to the segment lat1 lon1 lat2 lon2."""
    k = f"cos(radians({lat})) * 111320e0"
    x1, y1, dx, dy = f"((lon1 - {lon}) * {k})", f"((lat1 - {lat}) * 111320e0)", f"((lon2 - lon1) * {k})", "((lat2 - lat1) * 111320e0)"
    t = f"coalesce(least(1e0, greatest(0e0, -({x1} * {dx} + {y1} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0))), 0)"
    return f"sqrt(pow({x1} + {t} * {dx}, 2) + pow({y1} + {t} * {dy}, 2))"


def norm(c: str) -> str:
    return f"translate(replace(replace(replace(replace(lower({c}), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), ' -,.;:', '')"


def norm_compare(c: str) -> str:
    spelt = f"replace(replace(replace(replace(lower({c}), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue')"
    return f"trim(regexp_replace(translate(translate({spelt}, '''’‘', ''), '-,.', '   '), '[^a-z0-9 ]', '', 'g'))"


ZE = f"ze AS (SELECT * FROM {zone_edges_sql()})"
_ON = "pow(lon - (lon1 + coalesce(least(1e0, greatest(0e0, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / nullif(pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2), 0))), 0) * (lon2 - lon1)), 2) + pow(lat - (lat1 + coalesce(least(1e0, greatest(0e0, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / nullif(pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2), 0))), 0) * (lat2 - lat1)), 2) <= 1e-18"
HELD = f"held AS (SELECT id, tid FROM (SELECT id, tid, poly, bool_or({_ON}) AS touch, count(*) FILTER (WHERE (lat1 > lat) <> (lat2 > lat) AND lon < (lon2 - lon1) * (lat - lat1) / nullif(lat2 - lat1, 0) + lon1) AS c FROM points, ze GROUP BY id, tid, poly) WHERE touch OR c % 2 = 1 GROUP BY id, tid), own AS (SELECT id, min(tid) AS tid FROM held GROUP BY id)"


def zone_sql(body: str, *more: str) -> str:
    return f"{ctes('points', *more)}, {ZE}, {HELD} {body}"


def zone_edges(spark: SparkSession) -> DataFrame:
    return territory.edges_of(zones(spark))


# --- scalar functions ---

@query(f"{ctes('points')} SELECT id, round({hav('lat', 'lon', '48.5e0', '12.8e0')}, 5) AS dist_m, round({bear('lat', 'lon', '48.5e0', '12.8e0')}, 8) AS bearing FROM points")
def haversine_and_bearing(spark, sf):
    here = (F.col("lat"), F.col("lon"), F.lit(MIDDLE[0]), F.lit(MIDDLE[1]))
    return view(spark, sf, "points").select("id", F.round(geo.haversine_m(*here), 5).alias("dist_m"), F.round(geo.bearing_deg(*here), 8).alias("bearing"))


@query(f"{ctes('points')}, d AS (SELECT id, ({bear('lat', 'lon', '48.5e0', '12.8e0')} - {bear('lat', 'lon', '48.9e0', '12.6e0')} + 540) % 360 - 180 AS diff FROM points) SELECT id, round(diff, 7) AS diff, CASE WHEN abs(diff) > 160 THEN 'u-turn' WHEN diff > 30 THEN 'right' WHEN diff < -30 THEN 'left' ELSE 'straight' END AS kind FROM d")
def turn_kinds(spark, sf):
    to = lambda lat, lon: geo.bearing_deg(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    d = view(spark, sf, "points").select("id", geo.angle_diff_deg(to(*MIDDLE), to(48.9, 12.6)).alias("diff"))
    return d.select("id", F.round("diff", 7).alias("diff"), geo.turn_kind(F.col("diff")).alias("kind"))


@query(f"{ctes('points')} SELECT id, round(radians(lon) * 6378137e0, 4) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0, 4) AS my, round((id % 1024) / 1024e0 * 360 - 180, 9) AS tile_lon, round(degrees(atan(sinh(pi() * (1 - 2 * (id % 1000) / 1024e0)))), 9) AS tile_lat FROM points")
def tiles_and_mercator(spark, sf):
    z, p = F.lit(10.0), view(spark, sf, "points")
    return p.select("id", F.round(geo.mercator_x(F.col("lon")), 4).alias("mx"), F.round(geo.mercator_y(F.col("lat")), 4).alias("my"), F.round(geo.tile_lon(F.col("id") % 1024, z), 9).alias("tile_lon"), F.round(geo.tile_lat(F.col("id") % 1000, z), 9).alias("tile_lat"))


@query(f"SELECT doc_id, md5({norm('text')}) AS street_key, length({norm('text')}) AS key_chars, md5({norm_compare('text')}) AS compare_key FROM documents")
def normalize_texts(spark, sf):
    key = text.normalize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(key).alias("street_key"), F.char_length(key).cast("long").alias("key_chars"), F.md5(text.normalize_compare(F.col("text"))).alias("compare_key"))


FLOAT = lambda c: f"try_cast(replace(regexp_extract({c}, '[0-9.,]+'), ',', '.') AS DOUBLE)"
SPEED = f"CASE lower(maxspeed) WHEN 'de:urban' THEN 50e0 WHEN 'de:rural' THEN 100e0 WHEN 'de:motorway' THEN 130e0 ELSE coalesce({FLOAT('maxspeed')} * CASE WHEN maxspeed LIKE '%mph%' THEN 1.60934e0 ELSE 1e0 END, 0) END"
USUAL = "CASE lower(trim(highway)) WHEN 'motorway' THEN 110e0 WHEN 'primary' THEN 80e0 WHEN 'secondary' THEN 70e0 WHEN 'residential' THEN 30e0 WHEN 'service' THEN 20e0 WHEN 'track' THEN 25e0 WHEN 'living_street' THEN 10e0 ELSE 50e0 END"
ONEWAY = "CASE WHEN oneway = 'yes' THEN 1 WHEN oneway IN ('-1', 'reverse') THEN -1 WHEN lower(junction) = 'roundabout' THEN 1 ELSE 0 END"
ROADS = f"roads AS (SELECT id, seq, node_ids, name, lower(trim(highway)) AS hwy_type, CASE WHEN {SPEED} > 0 THEN {SPEED} ELSE {USUAL} END AS speed_kph, coalesce({FLOAT('maxheight')}, 0) AS max_height_m, coalesce({FLOAT('maxweight')}, 0) AS max_weight_t, {ONEWAY} AS oneway FROM ways WHERE lower(trim(highway)) <> 'footway' AND lower(trim(access)) NOT IN ('no', 'private') AND hgv <> 'no' AND len(node_ids) >= 2)"


@query(f"{ctes('ways')}, {ROADS} SELECT id, name, hwy_type, round(speed_kph, 6) AS speed_kph, max_height_m, max_weight_t, oneway FROM roads")
def road_ways(spark, sf):
    r = graph.road_ways(view(spark, sf, "ways"))
    return r.select("id", "name", "hwy_type", F.round("speed_kph", 6).alias("speed_kph"), "max_height_m", "max_weight_t", "oneway")


@query(f"{ctes('ways')} SELECT id, coalesce({FLOAT('maxspeed')}, -1) AS number, round({SPEED}, 6) AS kph, {ONEWAY} AS direction FROM ways")
def parse_tags(spark, sf):
    t = osm.tags_of("tags")
    return view(spark, sf, "ways").select("id", F.coalesce(text.first_float(t("maxspeed")), F.lit(-1.0)).alias("number"), F.round(text.parse_maxspeed_kph(t("maxspeed")), 6).alias("kph"), text.parse_oneway(t("oneway"), t("junction")).alias("direction"))


@query("SELECT page_id, CASE WHEN trim(coalesce(url, '')) = '' THEN 'UNASSIGNED' ELSE regexp_replace(trim(url), '[/\\\\:*?\"<>|]', '_', 'g') END AS file_name FROM pages")
def sanitize_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.sanitize_name(F.col("url")).alias("file_name"))


@query(f"{ctes('points')} SELECT id, lat, lon FROM points WHERE lat BETWEEN 48.5e0 AND 48.7e0 AND lon BETWEEN 12.6e0 AND 12.9e0")
def bbox_filter(spark, sf):
    return view(spark, sf, "points").filter(geo.within(F.col("lat"), F.col("lon"), (48.5, 48.7, 12.6, 12.9)))


@query(f"{ctes('points')} SELECT id, round(greatest(-90, lat - id / 111320e0), 9) AS lat0, round(least(90, lat + 0.1e0 + id / 111320e0), 9) AS lat1, round(greatest(-180, lon - id / (111320e0 * cos(radians((lat + lat + 0.1e0) / 2)))), 9) AS lon0, round(least(180, lon + 0.2e0 + id / (111320e0 * cos(radians((lat + lat + 0.1e0) / 2)))), 9) AS lon1 FROM points")
def bbox_expand(spark, sf):
    w = geo.expand_window(F.col("lat"), F.col("lat") + 0.1, F.col("lon"), F.col("lon") + 0.2, F.col("id"))
    return view(spark, sf, "points").select("id", *[F.round(c, 9).alias(n) for c, n in zip(w, ("lat0", "lat1", "lon0", "lon1"), strict=True)])


@query(f"{ctes('pois')} SELECT id, (emergency <> '' OR shop <> '' OR place <> '' OR amenity <> '' OR natural_kind = 'water') AS eligible, CASE place WHEN 'city' THEN 100 WHEN 'town' THEN 80 WHEN 'village' THEN 60 WHEN 'quarter' THEN 45 WHEN 'hamlet' THEN 30 WHEN 'locality' THEN 15 ELSE 0 END AS place_rank FROM pois")
def poi_rules(spark, sf):
    return view(spark, sf, "pois").select("id", osm.is_poi("tags").alias("eligible"), osm.place_rank(osm.tag("tags", "place")).alias("place_rank"))


@query(f"{ctes('directed')}, d AS (SELECT *, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS m, least(speed_kph, 130e0) AS v FROM directed) SELECT src, dst, round(m, 6) AS distance, round(m * 3.6 / v, 6) AS duration, round(m / 1000 * (1 + 0.7 * pow(v / 100, 2)), 8) AS economy, round(m * 3.6 / greatest(speed_kph * 1.3, 10), 6) AS emergency, round(m * 3.6 / greatest(least(speed_kph * 0.25, 25e0), 3), 6) AS cycling, hwy_type IN ('', 'primary', 'secondary', 'motorway') AND NOT (max_height_m > 0 AND max_height_m < 4) AND NOT (max_weight_t > 0 AND max_weight_t < 7) AS truck_allowed FROM d")
def edge_costs(spark, sf):
    e = grid(spark, sf)[0]
    by = lambda **k: cost.edge_cost(F.col("dist_m"), F.col("speed_kph"), cost.RouteOptions(**k).settled())
    truck = cost.RouteOptions(profile="truck", height_m=4.0, weight_t=7.0).settled()
    return e.select("src", "dst", F.round(by(objective="distance"), 6).alias("distance"), F.round(by(objective="duration"), 6).alias("duration"), F.round(by(objective="economy"), 8).alias("economy"), F.round(by(emergency=True), 6).alias("emergency"), F.round(cost.edge_seconds(F.col("dist_m"), F.col("speed_kph"), cost.RouteOptions(profile="cycling").settled()), 6).alias("cycling"), cost.edge_allowed(F.col("max_height_m"), F.col("max_weight_t"), F.col("hwy_type"), truck).alias("truck_allowed"))


# --- graph ---

def grid(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of the street grid."""
    e = view(spark, sf, "directed").withColumn("dist_m", geo.haversine_m(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")])).drop("lat1", "lon1", "lat2", "lon2")
    v = view(spark, sf, "vertices").select("id", "lat", "lon")
    return e, graph.vertices_of(v, e)


def built(spark, sf) -> graph.Graph:
    return graph.build_graph(view(spark, sf, "vertices").select("id", "lat", "lon"), view(spark, sf, "ways"))


def kept(spark, sf) -> graph.Graph:
    """built(), written once, for queries of many steps."""
    nodes = view(spark, sf, "vertices").select("id", "lat", "lon")
    roads = cut(graph.road_ways(view(spark, sf, "ways")))
    edges = cut(graph.build_edges(nodes, roads))
    vertices = cut(graph.vertices_of(nodes, edges))
    return graph.Graph(edges, vertices, cut(graph.street_dictionary(roads, vertices)))


STEPS = f"st AS (SELECT id AS way, hwy_type, speed_kph, max_height_m, max_weight_t, oneway, i - 1 AS pos, node_ids[i] AS a, node_ids[i + 1] AS b FROM (SELECT *, unnest(range(1, len(node_ids))) AS i FROM roads)), pl AS (SELECT st.*, {hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS dist_m FROM st JOIN vertices p ON p.id = a JOIN vertices q ON q.id = b), ed AS (SELECT way, pos, a AS src, b AS dst, dist_m, speed_kph, max_height_m, max_weight_t, hwy_type FROM pl WHERE dist_m > 0 AND oneway >= 0 UNION ALL SELECT way, pos, b, a, dist_m, speed_kph, max_height_m, max_weight_t, hwy_type FROM pl WHERE dist_m > 0 AND oneway <= 0), vx AS (SELECT id, lat, lon FROM vertices WHERE id IN (SELECT src FROM ed))"
BUILT = f"{ctes('ways', 'vertices')}, {ROADS}, {STEPS}"


@query(f"{BUILT} SELECT way, CAST(pos AS INT) AS pos, src, dst, round(dist_m, 6) AS dist_m, round(speed_kph, 6) AS speed_kph, max_height_m, max_weight_t, hwy_type FROM ed")
def build_edges(spark, sf):
    return built(spark, sf).edges.select("way", "pos", "src", "dst", F.round("dist_m", 6).alias("dist_m"), F.round("speed_kph", 6).alias("speed_kph"), "max_height_m", "max_weight_t", "hwy_type")


@query(f"{BUILT} SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) < max(lat) AND min(lon) < max(lon) AS valid FROM vx")
def graph_bounds(spark, sf):
    return graph.bounds(built(spark, sf).vertices)


@query(f"{BUILT} SELECT count(DISTINCT src) AS vertices, count(*) AS edges FROM ed")
def graph_counts(spark, sf):
    return graph.counts(built(spark, sf).edges)


@query(f"{BUILT}, d AS (SELECT src AS id, count(*) AS degree FROM ed GROUP BY src) SELECT id, degree, row_number() OVER (ORDER BY degree, id) - 1 AS rank FROM d")
def contraction_ranks(spark, sf):
    return graph.contraction_ranks(built(spark, sf).edges)


@query(f"{BUILT}, d AS (SELECT src AS id, count(*) AS degree FROM ed GROUP BY src), r AS (SELECT id, row_number() OVER (ORDER BY degree, id) AS rank FROM d) SELECT way, CAST(pos AS INT) AS pos, src, dst FROM ed JOIN r a ON a.id = src JOIN r b ON b.id = dst WHERE b.rank > a.rank")
def upward_edges(spark, sf):
    e = built(spark, sf).edges
    return graph.upward_edges(e, graph.contraction_ranks(e)).select("way", "pos", "src", "dst")


STREETS = f"nm AS (SELECT {norm('name')} AS key, name, seq, CASE WHEN len(node_ids) > 3 THEN [node_ids[1], node_ids[len(node_ids) // 2 + 1], node_ids[len(node_ids)]] ELSE node_ids END AS s FROM roads WHERE name <> ''), smp AS (SELECT key, n, min(seq * 10 + i) AS f FROM (SELECT key, seq, unnest(s) AS n, generate_subscripts(s, 1) AS i FROM nm) GROUP BY key, n), kept AS (SELECT key, n, r FROM (SELECT key, n, row_number() OVER (PARTITION BY key ORDER BY f) AS r FROM smp) WHERE r <= 16 AND n IN (SELECT id FROM vx)), streets AS (SELECT key, arg_max(name, strlen(name) * 1000000000 - seq) AS display, any_value(l) AS node_ids FROM nm JOIN (SELECT key, list(n ORDER BY r) AS l FROM kept GROUP BY key) USING (key) GROUP BY key)"


@query(f"{BUILT}, {STREETS} SELECT key, display, array_to_string(node_ids, ',') AS node_ids FROM streets")
def street_dictionary(spark, sf):
    return built(spark, sf).streets.select("key", "display", F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("node_ids"))


@query(f"{BUILT}, {STREETS} SELECT node, min(display) AS name FROM (SELECT display, unnest(node_ids) AS node FROM streets) GROUP BY node")
def node_street_names(spark, sf):
    return graph.node_street_names(built(spark, sf).streets)


@query(f"{ctes('ways', 'vertices')} SELECT w.id, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon, count(*) AS n FROM (SELECT id, unnest(node_ids) AS node FROM ways) w JOIN vertices v ON v.id = node GROUP BY w.id")
def way_centroids(spark, sf):
    return poi.way_centroids(view(spark, sf, "ways"), view(spark, sf, "vertices")).select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "n")


def relations(spark, sf) -> DataFrame:
    """A relation for each three ways, with a member node and a way that isn't there."""
    w = view(spark, sf, "ways").select((F.col("id") % 3).alias("g"), "id")
    member = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.cast("long").alias("id"), F.lit("").alias("role"))
    return w.groupBy("g").agg(F.concat(F.collect_list(member("way", F.col("id"))), F.array(member("node", F.lit(5)), member("way", F.lit(99)), member("node", F.lit(5)))).alias("members")).select(F.col("g").alias("id"), "members")


@query(f"{ctes('ways', 'vertices')}, m AS (SELECT id % 3 AS id, unnest(node_ids) AS node FROM ways UNION ALL SELECT g, 5 FROM (SELECT DISTINCT id % 3 AS g FROM ways), (VALUES (1), (2))), f AS (SELECT m.id, avg(lat) AS lat, avg(lon) AS lon FROM m JOIN vertices v ON v.id = node GROUP BY m.id), c AS (SELECT w.id, avg(lat) AS lat, avg(lon) AS lon FROM (SELECT id, unnest(node_ids) AS node FROM ways) w JOIN vertices v ON v.id = node GROUP BY w.id), n AS (SELECT id % 3 AS id, avg(lat) AS nlat, avg(lon) AS nlon FROM c GROUP BY 1) SELECT id, round(lat, 9) AS lat, round(lon, 9) AS lon, round(nlat, 9) AS nested_lat, round(nlon, 9) AS nested_lon FROM f JOIN n USING (id)")
def relation_centroids(spark, sf):
    r, w, v = relations(spark, sf), view(spark, sf, "ways"), view(spark, sf, "vertices").select("id", "lat", "lon")
    nested = poi.relation_centroids_nested(r, w, v).select("id", F.round("lat", 9).alias("nested_lat"), F.round("lon", 9).alias("nested_lon"))
    return poi.relation_centroids_flat(r, w, v).select("id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon")).join(nested, "id")


@query(f"{ctes('ways', 'vertices', 'pois')} SELECT id FROM vertices WHERE id IN (SELECT unnest(node_ids) FROM ways WHERE highway = 'track') OR id = 5 OR id IN (SELECT id FROM pois WHERE kind = 'node' AND amenity = 'cafe')")
def node_semi_join(spark, sf):
    p = view(spark, sf, "pois").filter("kind = 'node' AND amenity = 'cafe'")
    w = view(spark, sf, "ways").filter("highway = 'track'")
    return poi.needed_nodes(view(spark, sf, "vertices"), p, w, relations(spark, sf)).select("id")


# --- territories ---

@query(zone_sql("SELECT p.id, tid AS territory_id FROM points p LEFT JOIN own o ON o.id = p.id"))
def assign_unassigned(spark, sf):
    return territory.assign(view(spark, sf, "points"), zone_edges(spark)).select("id", "territory_id")


@query(zone_sql(f", d AS (SELECT p.id, tid, min({seg('lat', 'lon')}) AS m FROM points p, ze GROUP BY p.id, tid), n AS (SELECT id, arg_min(tid, m) AS near FROM d GROUP BY id) SELECT p.id, coalesce(tid, near) AS territory_id FROM points p LEFT JOIN own o ON o.id = p.id JOIN n ON n.id = p.id"))
def assign_nearest(spark, sf):
    return territory.assign(view(spark, sf, "points"), zone_edges(spark), "nearest").select("id", "territory_id")


@query(zone_sql("SELECT p.id, coalesce(tid, 'Zone-3') AS territory_id FROM points p LEFT JOIN own o ON o.id = p.id"))
def assign_fallback(spark, sf):
    return territory.assign(view(spark, sf, "points"), zone_edges(spark), "fallback:Zone-3").select("id", "territory_id")


@query(zone_sql("SELECT id, tid AS territory_id FROM held"))
def find_all_territories(spark, sf):
    return territory.find_territories(view(spark, sf, "points"), zone_edges(spark))


@query(zone_sql(f"SELECT p.id, tid AS territory_id, round(min({seg('lat', 'lon')}), 4) AS dist_m FROM points p, ze GROUP BY p.id, tid"))
def boundary_distances(spark, sf):
    return territory.boundary_distances(view(spark, sf, "points"), zone_edges(spark)).select("id", "territory_id", F.round("dist_m", 4).alias("dist_m"))


DISTRICT_EDGES = "de AS (SELECT tid, unnest([lat0, lat0, lat9, lat9]) AS lat1, unnest([lon0, lon9, lon9, lon0]) AS lon1, unnest([lat0, lat9, lat9, lat0]) AS lat2, unnest([lon9, lon9, lon0, lon0]) AS lon2 FROM districts)"


@query(f"{ctes('districts')}, {DISTRICT_EDGES}, v AS (SELECT tid AS t, lat1 AS lat, lon1 AS lon FROM de), d AS (SELECT least(t, tid) AS a, greatest(t, tid) AS b, min({seg('lat', 'lon')}) AS m FROM v JOIN de ON t <> tid GROUP BY 1, 2) SELECT a AS territory_id, b AS neighbor, round(m, 4) AS dist_m FROM d WHERE m <= 50 UNION ALL SELECT b, a, round(m, 4) FROM d WHERE m <= 50")
def territory_neighbors(spark, sf):
    return territory.neighbors(territory.edges_of(districts(spark, sf))).select("territory_id", "neighbor", F.round("dist_m", 4).alias("dist_m"))


PROPS = "pr(tid, depot, vehicle) AS (VALUES " + ", ".join(f"('{k}', '{p['depot']}', '{p['vehicle']}')" for k, (p, _) in ZONES.items()) + ")"


@query(zone_sql(f", {PROPS} SELECT p.id, o.tid AS territory_id, coalesce(depot, '') AS depot, coalesce(vehicle, '') AS vehicle FROM points p LEFT JOIN own o ON o.id = p.id LEFT JOIN pr ON pr.tid = o.tid"))
def include_columns(spark, sf):
    a = territory.assign(view(spark, sf, "points"), zone_edges(spark)).select("id", "territory_id")
    return dispatch.include_properties(a, zones(spark), ["territory_id", "depot", "vehicle"])


@query(zone_sql(f", {PROPS} SELECT CASE WHEN coalesce(depot, '') = '' THEN 'UNASSIGNED' ELSE replace(depot, '|', '_') END AS manifest, count(*) AS parcels FROM points p LEFT JOIN own o ON o.id = p.id LEFT JOIN pr ON pr.tid = o.tid GROUP BY 1"))
def manifest_counts(spark, sf):
    a = territory.assign(view(spark, sf, "points"), zone_edges(spark)).select("id", "territory_id")
    return dispatch.manifest_counts(dispatch.manifest_groups(a, zones(spark), "depot"))


@query(f"{ctes('districts')} SELECT layer, tid AS territory_id, lat0 AS min_lat, lat9 AS max_lat, lon0 AS min_lon, lon9 AS max_lon FROM districts")
def territory_boxes(spark, sf):
    return territory.boxes(territory.edges_of(districts(spark, sf)))


@query(f"{ctes('districts')} SELECT layer, tid AS territory_id, round(radians(lon9 - lon0) * (sin(radians(lat9)) - sin(radians(lat0))) * 6378137e0 * 6378137e0, 2) AS area_m2 FROM districts")
def territory_areas(spark, sf):
    return territory.areas(districts(spark, sf)).select("layer", "territory_id", F.round("area_m2", 2).alias("area_m2"))


@query(f"{ctes('districts')} SELECT layer, count(*) AS territories FROM districts GROUP BY layer")
def layer_counts(spark, sf):
    return territory.layer_counts(districts(spark, sf))


@query(f"{ctes('districts')} SELECT DISTINCT layer, unnest(['depot', key]) AS key FROM districts")
def property_keys(spark, sf):
    return territory.property_keys(districts(spark, sf))


def postcodes(spark, sf) -> DataFrame:
    """Addresses' postcodes as small squares."""
    a = view(spark, sf, "addresses").groupBy("postcode").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    corner = lambda y, x: F.struct((F.col("lat") + y).alias("lat"), (F.col("lon") + x).alias("lon"))
    ring = F.array(corner(0.0, 0.0), corner(0.0, 0.001), corner(0.001, 0.001), corner(0.0, 0.0))
    hole = F.array().cast("array<array<struct<lat:double,lon:double>>>")
    return a.select(F.lit("postal").alias("layer"), F.col("postcode").alias("territory_id"), F.lit("").alias("name"), F.array(F.struct(ring.alias("outer"), hole.alias("holes"))).alias("geometry"))


@query(f"{ctes('addresses')} SELECT substr(postcode, 1, 3) AS territory_id, count(DISTINCT postcode) AS codes, count(DISTINCT postcode) AS polygons FROM addresses GROUP BY 1")
def postal_groups(spark, sf):
    return territory.postal_groups(postcodes(spark, sf), 3).select("territory_id", "codes", F.size("geometry").cast("long").alias("polygons"))


@query(f"{ctes('positions')}, {ZE}, points AS (SELECT row_number() OVER () AS id, qid, pos, lat, lon FROM positions), {HELD}, w AS (SELECT qid, pos, tid, sum(coalesce({hav('plat', 'plon', 'lat', 'lon')}, 0)) OVER (PARTITION BY qid ORDER BY pos) / 1000 AS km FROM (SELECT p.*, tid, lag(lat) OVER b AS plat, lag(lon) OVER b AS plon FROM points p LEFT JOIN own o ON o.id = p.id WINDOW b AS (PARTITION BY qid ORDER BY pos))), g AS (SELECT *, lead(km) OVER b AS nkm, CASE WHEN tid IS NOT DISTINCT FROM lag(tid) OVER b AND lag(pos) OVER b IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM w WINDOW b AS (PARTITION BY qid ORDER BY pos)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY qid ORDER BY pos) AS run FROM g), s AS (SELECT qid, run, min(tid) AS territory_id, min(km) AS e, arg_max(coalesce(nkm, km), pos) AS l FROM r GROUP BY qid, run) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY run) AS INT) AS event, territory_id, round(e, 6) AS entered_km, round(l, 6) AS left_km FROM s WHERE territory_id IS NOT NULL")
def territory_events(spark, sf):
    e = territory.path_events(view(spark, sf, "positions"), zone_edges(spark))
    return e.select("qid", "event", "territory_id", F.round("entered_km", 6).alias("entered_km"), F.round("left_km", 6).alias("left_km"))


@query(zone_sql("SELECT p.id, CASE WHEN tid IS NULL THEN 1e0 WHEN tid = 'Zone-1' THEN 0.9e0 WHEN tid = 'Zone-2' THEN 1.1e0 ELSE 1.5e0 END AS factor FROM points p LEFT JOIN own o ON o.id = p.id"))
def territory_factors(spark, sf):
    return territory.cost_factors(view(spark, sf, "points"), zone_edges(spark), "Zone-1", same=0.9, neighbor=1.1, foreign=1.5)


@query(zone_sql(f", {PROPS} SELECT vehicle, CAST(o.id AS VARCHAR) AS shipment, 0e0 AS cost FROM own o JOIN pr ON pr.tid = o.tid"))
def vehicle_compatibility(spark, sf):
    v = zones(spark).select(F.col("props")["vehicle"].alias("vehicle"), F.create_map(F.lit("territory_id"), F.col("territory_id")).alias("props"))
    s = territory.find_territory(view(spark, sf, "points"), zone_edges(spark)).select(F.col("id").cast("string").alias("shipment"), "territory_id")
    return dispatch.compatible(v, s)


# --- nearest ---

@query(f"{ctes('addresses', 'vertices')}, d AS (SELECT a.id AS qid, v.id, {hav('a.lat', 'a.lon', 'v.lat', 'v.lon')} AS m FROM addresses a, vertices v) SELECT qid, id, round(m, 5) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, id) AS r FROM d) WHERE r = 1")
def nearest_node(spark, sf):
    q = view(spark, sf, "addresses").select(F.col("id").alias("qid"), "lat", "lon")
    return nearest.nearest(q, view(spark, sf, "vertices").select("id", "lat", "lon")).select("qid", "id", F.round("dist_m", 5).alias("dist_m"))


@query(f"{ctes('addresses', 'pois')}, p AS (SELECT id, lat + 0.0004e0 AS lat, lon + 0.0003e0 AS lon FROM addresses), d AS (SELECT p.id AS qid, kind, o.id, name AS label, {hav('p.lat', 'p.lon', 'o.lat', 'o.lon')} AS m, CASE kind WHEN 'node' THEN 0 ELSE 1 END AS k FROM p JOIN pois o ON abs(p.lat - o.lat) < 0.01 AND abs(p.lon - o.lon) < 0.01) SELECT qid, kind, id, label, round(m, 5) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, k, id) AS r FROM d WHERE m <= 500) WHERE r = 1")
def nearest_label(spark, sf):
    p = view(spark, sf, "pois").select(F.when(F.col("kind") == "node", 0).otherwise(1).alias("kind_rank"), "kind", "id", "lat", "lon", F.col("name").alias("label"))
    q = view(spark, sf, "addresses").select(F.col("id").alias("qid"), (F.col("lat") + 0.0004).alias("lat"), (F.col("lon") + 0.0003).alias("lon"))
    return nearest.nearest_label(q, p).select("qid", "kind", "id", "label", F.round("dist_m", 5).alias("dist_m"))


@query(f"{ctes('pois')} SELECT kind, id, name AS label, round({hav('48.01e0', '12.02e0', 'lat', 'lon')}, 5) AS dist_m FROM pois WHERE shop = 'promo' ORDER BY {hav('48.01e0', '12.02e0', 'lat', 'lon')}, kind, id LIMIT 8")
def pois_near(spark, sf):
    return poi.near(view(spark, sf, "pois"), 48.01, 12.02, "shop", "Promo", 8).select("kind", "id", "label", F.round("dist_m", 5).alias("dist_m"))


@query(f"{ctes('pois')} SELECT id, name AS label, round({hav('48.0175e0', '12.0175e0', 'lat', 'lon')}, 5) AS dist_m FROM pois WHERE shop = 'small' AND kind = 'way' AND lat BETWEEN {WINDOW[0]}e0 AND {WINDOW[1]}e0 AND lon BETWEEN {WINDOW[2]}e0 AND {WINDOW[3]}e0 ORDER BY {hav('48.0175e0', '12.0175e0', 'lat', 'lon')}, id LIMIT 8")
def pois_on_route(spark, sf):
    return poi.on_route(view(spark, sf, "pois"), WINDOW, "shop", "small").select("id", "label", F.round("dist_m", 5).alias("dist_m"))


@query(f"{ctes('pois')}, r AS (SELECT *, CASE place WHEN 'city' THEN 100 WHEN 'town' THEN 80 WHEN 'village' THEN 60 WHEN 'quarter' THEN 45 WHEN 'hamlet' THEN 30 WHEN 'locality' THEN 15 ELSE 0 END AS rank FROM pois WHERE lat BETWEEN {WINDOW[0]}e0 AND {WINDOW[1]}e0 AND lon BETWEEN {WINDOW[2]}e0 AND {WINDOW[3]}e0) SELECT name, lat, lon, place AS kind, rank FROM r WHERE rank > 0 ORDER BY rank DESC, name, id LIMIT 36")
def place_labels(spark, sf):
    return poi.place_labels(view(spark, sf, "pois"), WINDOW, 13)


@query(f"{BUILT}, {STREETS}, s AS (SELECT key, display AS name, unnest(node_ids) AS n FROM streets), c AS (SELECT key, name, lat, lon, pow(lat - {(WINDOW[0] + WINDOW[1]) / 2!r}e0, 2) + pow(lon - {(WINDOW[2] + WINDOW[3]) / 2!r}e0, 2) AS d2, vx.id FROM s JOIN vx ON vx.id = n WHERE lat BETWEEN {WINDOW[0]}e0 AND {WINDOW[1]}e0 AND lon BETWEEN {WINDOW[2]}e0 AND {WINDOW[3]}e0), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d2, id) AS r FROM c) SELECT name, lat, lon, round(d2, 15) AS d2 FROM b WHERE r = 1 ORDER BY d2, name, key LIMIT 32")
def street_labels(spark, sf):
    g = built(spark, sf)
    return poi.street_labels(g.streets, g.vertices, WINDOW, 32).select("name", "lat", "lon", F.round("d2", 15).alias("d2"))


@query(f"{ctes('pois')} SELECT id, lat, lon, name, '' AS type FROM pois WHERE emergency = 'fire_hydrant' AND lat BETWEEN {WINDOW[0]}e0 AND {WINDOW[1]}e0 AND lon BETWEEN {WINDOW[2]}e0 AND {WINDOW[3]}e0 ORDER BY id LIMIT 500")
def hydrants(spark, sf):
    return poi.hydrants(view(spark, sf, "pois"), WINDOW)


@query(f"{ctes('pois')}, a AS (SELECT {norm_compare('name')} AS c FROM pois UNION ALL SELECT {norm_compare('brand')} FROM pois), b(alias) AS (VALUES ('maci'), ('mcdo'), ('mcd'), ('mcdonald'), ('mcdonalds'), ('macdonalds'), ('maccdonalds'), ('macca')) SELECT replace(c, ' ', '') AS alias, min(c) AS canonical FROM a WHERE c <> '' GROUP BY 1 UNION ALL SELECT alias, 'mcdonalds' FROM b")
def brand_aliases(spark, sf):
    return poi.brand_aliases(view(spark, sf, "pois"))


# --- search ---

PARSED = "p(qid, street, housenumber, postcode, city, raw) AS (VALUES (1, 'smallring5', '5', '', 'nation_3', 'smallring5nation_3'), (2, 'redbolt', '', '', '', 'redbolt'), (3, '', 'nation_7', '', '', 'nation_7'), (4, '', '', '00012', '', '00012'), (5, 'blue', '', '12345', '', 'bluegear12345'), (6, 'gear', '', '', '', 'gear'), (7, '', 'brand#1', '', '', 'brand#1'), (8, 'promo', '', '', '', 'promo'), (9, 'oldanvil', '', '', '', 'oldanvil'))"
ADDRESS = f"{ctes('addresses')}, {PARSED}, f AS (SELECT id, seq, {norm('street')} AS st, housenumber AS hn, postcode AS pc, {norm('city')} AS ci FROM addresses), sc AS (SELECT qid, id, seq, CASE WHEN st = p.street AND p.street <> '' THEN 3 ELSE 0 END + CASE WHEN hn = p.housenumber AND p.housenumber <> '' THEN 4 ELSE 0 END + CASE WHEN pc = p.postcode AND p.postcode <> '' THEN 2 ELSE 0 END + CASE WHEN ci = p.city AND p.city <> '' THEN 1 ELSE 0 END + CASE WHEN st = p.raw THEN 4 WHEN contains(st, p.raw) THEN 1 ELSE 0 END + CASE WHEN ci = p.raw THEN 3 ELSE 0 END AS s, p.street <> '' AND contains(st, p.street) AS part FROM f, p), sd AS (SELECT qid, id, seq, CASE WHEN s = 0 AND part THEN 1 ELSE s END AS score FROM sc)"


@query(f"{ADDRESS} SELECT qid, CAST(rank AS INT) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sd WHERE score > 0) WHERE rank <= 10")
def address_search(spark, sf):
    return search.search_addresses(view(spark, sf, "addresses"), view(spark, sf, "queries"), 10).select("qid", "rank", "id", "score")


@query(f"{ADDRESS} SELECT qid, arg_max(id, score * CAST(1000000000 AS BIGINT) - seq) AS id, max(score) AS score FROM sd WHERE score > 0 GROUP BY qid")
def best_address(spark, sf):
    return search.best_address(view(spark, sf, "addresses"), view(spark, sf, "queries"))


STREET_QUERIES = "(VALUES (1, 'Straße 1'), (2, 'STRASSE'), (3, 'asse'), (4, '2'), (5, 'none'), (6, ' ')) AS q(qid, raw)"


@query(f"{BUILT}, {STREETS}, q AS (SELECT qid, {norm('raw')} AS k FROM {STREET_QUERIES}), s AS (SELECT qid, key, display, node_ids[1] AS node, CASE WHEN key = k THEN 3 WHEN starts_with(key, k) THEN 2 WHEN contains(key, k) THEN 1 ELSE 0 END AS score FROM streets, q WHERE k <> '') SELECT qid, CAST(rank AS INT) AS rank, name, key, score, node FROM (SELECT qid, key, display AS name, node, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, display, key) AS rank FROM s WHERE score > 0) WHERE rank <= 5")
def street_search(spark, sf):
    g = built(spark, sf)
    q = spark.sql(f"SELECT qid, raw FROM {STREET_QUERIES}")
    return search.search_streets(g.streets, g.vertices, q, 5).select("qid", "rank", "name", "key", "score", "node")


def _field(c: str, w: tuple[int, int, int, int]) -> str:
    return f"CASE WHEN {c} = '' OR k = '' THEN 0 WHEN {c} = k THEN {w[0]} WHEN starts_with({c}, k) THEN {w[1]} WHEN contains({c}, k) THEN {w[2]} ELSE (SELECT CASE WHEN count(*) = 0 THEN 0 WHEN count(*) = len(toks) THEN {w[3]} * count(*) ELSE {w[3]} END FROM (SELECT unnest(toks) AS t) WHERE contains({c}, t)) END"


@query(f"{ctes('pois', 'queries')}, q AS (SELECT qid, k, list_filter(string_split(k, ' '), lambda x: x <> '') AS toks FROM (SELECT qid, {norm_compare('raw')} AS k FROM queries)), f AS (SELECT *, {norm_compare('name')} AS n, {norm_compare('brand')} AS b, {norm_compare('shop')} AS s, {norm_compare('amenity')} AS a FROM pois), sc AS (SELECT qid, kind, id, name AS label, CAST({_field('n', (120, 100, 80, 12))} + {_field('b', (100, 85, 70, 10))} + {_field('s', (70, 55, 45, 7))} + {_field('a', (70, 55, 45, 7))} + {_field('n', (75, 60, 45, 6))} AS INT) AS score FROM f, q) SELECT qid, CAST(rank AS INT) AS rank, kind, id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label, kind, id) AS rank FROM sc WHERE score > 0) WHERE rank <= 7")
def poi_search(spark, sf):
    return search.search_pois(view(spark, sf, "pois"), view(spark, sf, "queries"), 7).select("qid", "rank", "kind", "id", "label", "score")


def _staged(parsed: str, asked: str, *more: str) -> str:
    """The staged search in SQL: adr, poi and street hold each stage's ranked rows, u10 (or another limit) what is left."""
    address = ADDRESS.replace(ctes("addresses"), ctes("addresses", "pois", "queries", "ways", "vertices"), 1).replace(PARSED, parsed, 1)
    score = " + ".join(_field(c, w) for c, w in (("n", (120, 100, 80, 12)), ("b", (100, 85, 70, 10)), ("s", (70, 55, 45, 7)), ("a", (70, 55, 45, 7)), ("n", (75, 60, 45, 6))))
    return f"""{address}, {ROADS}, {STEPS}, {STREETS},
        pq AS (SELECT qid, k, list_filter(string_split(k, ' '), lambda x: x <> '') AS toks FROM (SELECT qid, {norm_compare('raw')} AS k FROM {asked})),
        pf AS (SELECT *, {norm_compare('name')} AS n, {norm_compare('brand')} AS b, {norm_compare('shop')} AS s, {norm_compare('amenity')} AS a FROM pois),
        psc AS (SELECT qid, kind, id, lat, lon, name AS label, CAST({score} AS INT) AS score FROM pf, pq),
        poi AS (SELECT qid, 1 AS stage, rank, 'poi' AS kind, id, lat, lon, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label, kind, id) AS rank FROM psc WHERE score > 0) WHERE rank <= 20),
        adr AS (SELECT qid, 0 AS stage, rank, 'address' AS kind, r.id, lat, lon, street || ' ' || housenumber || ', ' || postcode || ' ' || city AS label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sd WHERE score > 0) r JOIN addresses a ON a.id = r.id),
        sq AS (SELECT qid, CASE WHEN street <> '' THEN street ELSE raw END AS k FROM p),
        street AS (SELECT qid, 2 AS stage, rank, 'street' AS kind, node AS id, lat, lon, display AS label FROM (SELECT qid, display, node_ids[1] AS node, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN key = k THEN 3 WHEN starts_with(key, k) THEN 2 ELSE 1 END DESC, display, key) AS rank FROM streets JOIN sq ON k <> '' AND contains(key, k)) JOIN vx ON vx.id = node WHERE rank <= 20){''.join(more)}"""


def _first_of(name: str, rows: str, limit: int) -> str:
    """A CTE of rows of which each label and place stays once, `limit` to a query."""
    return f""", {name} AS (SELECT * EXCLUDE (o, nth) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stage, rank) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY qid, {norm_compare('label')}, CAST(round(lat * 1e6) AS BIGINT), CAST(round(lon * 1e6) AS BIGINT) ORDER BY stage, rank) AS o FROM ({rows})) WHERE o = 1) WHERE nth <= {limit})"""


def _search_sql(name: str, limit: int) -> tuple[str, ...]:
    open_slots = lambda of: f"{limit} - (SELECT count(*) FROM {of} d WHERE d.qid = x.qid)"
    fill = lambda stage, of: f"SELECT * FROM {of} UNION ALL SELECT * FROM {stage} x WHERE rank <= least(2 * ({open_slots(of)}), 20)"
    return (
        _first_of(f"{name}0", f"SELECT * FROM adr WHERE rank <= {min(2 * limit, 50)}", limit),
        _first_of(f"{name}1", fill("poi", f"{name}0"), limit),
        _first_of(name, fill("street", f"{name}1"), limit),
    )


@query(_staged(PARSED, "queries", *_search_sql("u", 10)) + " SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY stage, rank) AS INT) AS nth, kind, id, label, round(lat, 9) AS lat, round(lon, 9) AS lon FROM u")
def unified_search(spark, sf):
    g = kept(spark, sf)
    found = search.search(view(spark, sf, "addresses"), view(spark, sf, "pois"), g.streets, g.vertices, view(spark, sf, "queries"), 10)
    return found.select("qid", "nth", "kind", "id", "label", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


_MORE = [(20, "48.1, 11.5"), (21, "Flughafen München"), (22, "Straße 2"), (23, "?"), (24, "asse"), (25, "strasse-2 zzz")]
_ASKED = "(SELECT qid, raw FROM queries UNION ALL VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _MORE if k > 21) + ")"
_PARSED_MORE = PARSED[:-1] + ", (22, 'strasse', '2', '', '', 'strasse2'), (23, '?', '', '', '', '?'), (24, 'asse', '', '', '', 'asse'), (25, 'zzz', 'strasse2', '', '', 'strasse2zzz'))"


@query(_staged(_PARSED_MORE, _ASKED, *_search_sql("u", 6), """,
        ba AS (SELECT sd.qid, arg_max(sd.id, score * CAST(1000000000 AS BIGINT) - seq) AS id FROM sd WHERE score > 0 GROUP BY sd.qid),
        sr AS (SELECT s.qid, lat, lon FROM street s JOIN p ON p.qid = s.qid AND p.street <> '' WHERE rank = 1 AND s.qid NOT IN (SELECT qid FROM ba)),
        fs AS (SELECT qid, arg_min(lat, stage * 1000 + rank) AS lat, arg_min(lon, stage * 1000 + rank) AS lon, arg_min(label, stage * 1000 + rank) AS label FROM u WHERE qid NOT IN (SELECT qid FROM ba) AND qid NOT IN (SELECT qid FROM sr) GROUP BY qid),
        done AS (SELECT 20 AS qid, 'coordinates' AS resolution, 48.1e0 AS lat, 11.5e0 AS lon, '48.100000, 11.500000' AS label UNION ALL SELECT ba.qid, 'address', lat, lon, street || ' ' || housenumber || ', ' || postcode || ' ' || city FROM ba JOIN addresses a ON a.id = ba.id
                 UNION ALL SELECT qid, 'street', lat, lon, 'asse' FROM sr UNION ALL SELECT qid, 'search', lat, lon, label FROM fs)""")
       + f" SELECT q.qid, coalesce(resolution, 'not found') AS resolution, round(lat, 9) AS lat, round(lon, 9) AS lon, label FROM (SELECT qid FROM {_ASKED} UNION ALL VALUES (20), (21)) q LEFT JOIN done ON done.qid = q.qid")
def resolve_locations(spark, sf):
    g = kept(spark, sf)
    more = spark.createDataFrame(_MORE, "qid int, raw string")
    found = search.resolve(view(spark, sf, "addresses"), view(spark, sf, "pois"), g.streets, g.vertices, view(spark, sf, "queries").unionByName(more))
    return found.select("qid", "resolution", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "label")


# --- routing ---

def requests(spark, sf) -> DataFrame:
    """From every vertex of the grid to the first one."""
    return grid(spark, sf)[1].select(F.col("id").alias("qid"), F.lit(1).cast("long").alias("from_id"), F.col("id").alias("to_id"))


@query(f"{ctes('directed')}, e AS (SELECT src, dst, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS m FROM directed), d(node, cost) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), 0e0 UNION SELECT e.dst, min(d.cost + e.m) FROM d JOIN e ON e.src = d.node LEFT JOIN recurring.d AS k ON k.node = e.dst WHERE k.cost IS NULL OR d.cost + e.m < k.cost - 1e-9 GROUP BY e.dst) SELECT v.src AS qid, 'ok' AS status, round(d.cost, 5) AS cost FROM (SELECT DISTINCT src FROM directed) v JOIN d ON d.node = v.src")
def route_distances(spark, sf):
    e, v = grid(spark, sf)
    return routing.route(requests(spark, sf), e, v, cost.RouteOptions(engine="dijkstra-node"), paths=False).select("qid", "status", F.round("cost", 5).alias("cost"))


TURNING = dict(objective="duration", crossing=5.0, left_turn=8.0, u_turn=30.0)


_TURN = f"(({bear('b.lat', 'b.lon', 'c.lat', 'c.lon')} - {bear('a.lat', 'a.lon', 'b.lat', 'b.lon')} + 540) % 360 - 180)"


@query(f"{ctes('directed', 'vertices')}, e AS (SELECT src, dst, {hav('lat1', 'lon1', 'lat2', 'lon2')} * 3.6 / least(speed_kph, 130e0) AS s FROM directed), g AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src), t AS (SELECT x.src AS p, x.dst AS h, y.dst AS a, y.s + CASE WHEN g.n > 2 THEN 5 ELSE 0 END + CASE WHEN abs({_TURN}) > 160 THEN 30 WHEN {_TURN} < -30 THEN 8 ELSE 0 END AS s FROM e x JOIN e y ON y.src = x.dst JOIN g ON g.id = x.dst JOIN vertices a ON a.id = x.src JOIN vertices b ON b.id = x.dst JOIN vertices c ON c.id = y.dst), d(p, h, cost) USING KEY (p, h) AS (SELECT src, dst, s FROM e WHERE src = 1 UNION SELECT t.h, t.a, min(d.cost + t.s) FROM d JOIN t ON t.p = d.p AND t.h = d.h LEFT JOIN recurring.d AS k ON k.p = t.h AND k.h = t.a WHERE k.cost IS NULL OR d.cost + t.s < k.cost - 1e-9 GROUP BY t.h, t.a) SELECT v.src AS qid, 'ok' AS status, round(CASE WHEN v.src = 1 THEN 0 ELSE c END, 4) AS cost, true AS fits FROM (SELECT DISTINCT src FROM directed) v LEFT JOIN (SELECT h, min(cost) AS c FROM d GROUP BY h) ON h = v.src")
def route_turn_aware(spark, sf):
    """From the first vertex to all, with turns and crossings that cost; whether each path's own cost is the one given."""
    e, v = grid(spark, sf)
    e, v = cut(e), cut(v)
    opt = cost.RouteOptions(**TURNING).settled()
    q = cut(requests(spark, sf))
    r = routing.route(q, e, v, opt, paths=False)
    paid = routing.paid_costs(q, e, v, opt)
    return r.join(paid, "qid", "left").select("qid", "status", F.round("cost", 4).alias("cost"), (F.abs(F.coalesce("paid", F.lit(0.0)) - F.col("cost")) < 1e-6).alias("fits"))


@query()
def route_instructions(spark, sf):
    g = kept(spark, sf)
    q = g.vertices.agg(F.min("id").alias("a"), F.max("id").alias("b"))
    wanted = g.vertices.crossJoin(F.broadcast(q)).select(F.col("id").alias("qid"), F.col("a").alias("from_id"), F.col("id").alias("to_id"))
    return routing.instructions(wanted, g.edges, g.vertices, graph.node_street_names(g.streets), cost.RouteOptions(objective="duration"))


@query(f"{ctes('directed', 'vertices')}, e AS (SELECT src, dst, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS m, speed_kph FROM directed) SELECT y AS qid, round(coalesce(sum(m), 0), 5) AS distance_m, round(coalesce(sum(m * 3.6 / speed_kph), 0), 5) AS duration_s FROM vertices v LEFT JOIN e ON e.src = v.id AND e.dst = v.id + 1 GROUP BY y UNION ALL SELECT 1000000 + x, round(coalesce(sum(m), 0), 5), round(coalesce(sum(m * 3.6 / speed_kph), 0), 5) FROM vertices v LEFT JOIN e ON e.src = v.id AND e.dst = v.id + 40 GROUP BY x")
def path_metrics(spark, sf):
    """Paths along all rows and columns of the grid."""
    e, _ = grid(spark, sf)
    v = view(spark, sf, "vertices")
    line = lambda key, order: v.groupBy(key.alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "id"))), lambda n: n["id"]).alias("path"))
    paths = line(F.col("y"), "x").unionByName(line(F.col("x") + 1000000, "y"))
    m = routing.path_metrics(paths, e)
    return m.select("qid", F.round("distance_m", 5).alias("distance_m"), F.round("duration_s", 5).alias("duration_s"))


def _trip_tables(spark, sf, per_trip: int) -> tuple[DataFrame, ...]:
    """(trips, stops, dependencies, edges, vertices): all customers as stops all over the grid, `per_trip` to a trip, the rest
    to the last one; in a trip the first stop comes before the second."""
    e, v = grid(spark, sf)
    e, v = cut(e), cut(v)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).filter("k IS NOT NULL")
    s = c.select(F.floor(F.col("k") / per_trip).alias("trip"), F.col("k").alias("ord"), F.concat(F.lit("S"), F.lpad(F.col("k").cast("string"), F.greatest(F.lit(6), F.length(F.col("k").cast("string"))), F.lit("0"))).alias("stop"), (1 + (F.col("k") * 7919) % v.count()).alias("node"), (F.col("k") % 5).cast("double").alias("demand"))
    s = cut(s)
    t = s.select("trip").distinct().select("trip", F.lit(1).cast("long").alias("start"), F.when(F.col("trip") % 2 == 1, 2).cast("long").alias("end"), F.lit(False).alias("loop"), (F.col("trip") % 3 < 2).alias("optimize"), F.lit(6.0).alias("capacity"))
    by = s.groupBy("trip").agg(F.min_by("stop", "ord").alias("before"), F.min("ord").alias("o")).join(s.select("trip", (F.col("ord") - 1).alias("o"), F.col("stop").alias("after")), ["trip", "o"])
    return t, s, by.select("trip", "before", "after"), e, v


def _solved(spark, sf, per_trip: int) -> DataFrame:
    t, s, needs, e, v = _trip_tables(spark, sf, per_trip)
    points = s.select("trip", "node").unionByName(t.select("trip", F.col("start").alias("node"))).unionByName(t.filter("end IS NOT NULL").select("trip", F.col("end").alias("node")))
    return trips.solve(t, s, needs, trips.cost_matrix(points, e, v, cost.RouteOptions(engine="dijkstra-node", objective="duration")))


_LEGS = f"e AS (SELECT src, dst, {hav('lat1', 'lon1', 'lat2', 'lon2')} * 3.6 / least(speed_kph, 130e0) AS s FROM directed), n AS (SELECT count(DISTINCT src) AS n FROM directed), st AS (SELECT c_custkey // 6 AS trip, c_custkey % 6 AS i, 1 + (c_custkey * 7919) % n AS node, c_custkey % 5 AS demand FROM customer, n), d(root, node, cost) USING KEY (root, node) AS (SELECT DISTINCT r, r, 0e0 FROM (SELECT node AS r FROM st UNION SELECT 1) UNION SELECT d.root, e.dst, min(d.cost + e.s) FROM d JOIN e ON e.src = d.node LEFT JOIN recurring.d AS k ON k.root = d.root AND k.node = e.dst WHERE k.cost IS NULL OR d.cost + e.s < k.cost - 1e-9 GROUP BY d.root, e.dst)"


@query(f"{ctes('directed')}, {_LEGS}, w(trip, seen, last, n, cost) AS (SELECT trip, 1 << i, st.node, 1, d.cost FROM st JOIN d ON d.root = 1 AND d.node = st.node WHERE CASE WHEN trip % 3 < 2 THEN i <> 1 ELSE i = 0 END UNION ALL SELECT w.trip, w.seen | (1 << i), st.node, w.n + 1, w.cost + d.cost FROM w JOIN st ON st.trip = w.trip JOIN d ON d.root = w.last AND d.node = st.node WHERE w.seen & (1 << i) = 0 AND (i <> 1 OR w.seen & 1 = 1) AND (w.trip % 3 < 2 OR i = w.n)), t AS (SELECT trip, count(*) AS n, sum(demand) AS demand FROM st GROUP BY trip), f AS (SELECT w.trip, min(w.cost + d.cost) AS cost FROM w JOIN t ON t.trip = w.trip AND t.n = w.n JOIN d ON d.root = w.last AND d.node = CASE WHEN w.trip % 2 = 1 THEN 2 ELSE 1 END GROUP BY w.trip) SELECT trip, 'ok' AS status, CAST(n AS INT) AS stops, round(cost, 4) AS cost, CAST(demand AS DOUBLE) AS demand, demand > 6 AS over_capacity FROM t JOIN f USING (trip)")
def trip_orders(spark, sf):
    """Tours of all customers, six stops each, the first before the second: the cheapest order, or for every third the order given; half of
    them end elsewhere than they start."""
    r = _solved(spark, sf, 6)
    return r.select("trip", "status", F.size("order").alias("stops"), F.round("cost", 4).alias("cost"), "demand", "over_capacity")


@query()
def trip_orders_long(spark, sf):
    """Tours of all customers, twenty stops each: nearest feasible stop, then reversals, or the order given."""
    return _solved(spark, sf, 20)


_URL = "replace(replace(replace(replace({}, ',', '%2C'), '|', '%7C'), '+', '%2B'), ':', '%3A')"


@query(f"{ctes('positions')}, p AS (SELECT qid, list(printf('%.6f,%.6f', lat, lon) ORDER BY pos) AS p FROM positions GROUP BY qid HAVING count(*) >= 2) SELECT qid, 'https://www.google.com/maps/dir/?api=1&destination=' || {_URL.format('p[len(p)]')} || '&origin=' || {_URL.format('p[1]')} || '&travelmode=driving' || CASE WHEN len(p) > 2 THEN '&waypoints=' || {_URL.format("array_to_string(p[2:1 + least(len(p) - 2, 9)], '|')")} ELSE '' END AS google, 'https://maps.apple.com/?daddr=' || {_URL.format("array_to_string(p[2:], '+to:')")} || '&dirflg=d&saddr=' || {_URL.format('p[1]')} AS apple FROM p")
def map_links(spark, sf):
    return routing.map_links(view(spark, sf, "positions"))


# --- messages, rosters, intents ---

@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_messages(spark, sf):
    return poi.last_messages(table(spark, sf, "conversations").withColumn("session", F.col("conv_id")), 3).select("conv_id", "turn", "role")


def _fleet(spark, sf, side: int) -> DataFrame:
    p = table(spark, sf, "part").filter(F.col("p_partkey") % 2 == side)
    return p.select((F.col("p_partkey") % 7).cast("string").alias("station_id"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("callsign"), F.concat_ws("/", "p_type", "p_size").alias("type"))


@query("WITH r AS (SELECT CAST(p_partkey % 7 AS VARCHAR) AS station_id, p_brand AS callsign, p_type || '/' || p_size AS type, (p_partkey % 2) * 1000000000 + p_partkey AS k FROM part), m AS (SELECT station_id, callsign, min(k) AS f, arg_max(type, k) AS type FROM r GROUP BY 1, 2) SELECT station_id, CAST(row_number() OVER (PARTITION BY station_id ORDER BY f) - 1 AS INT) AS pos, callsign, type FROM m")
def roster_merge(spark, sf):
    return dispatch.merge_vehicles(_fleet(spark, sf, 0), _fleet(spark, sf, 1))


@query("WITH n AS (SELECT n_name AS name, n_nationkey AS k FROM nation), r AS (SELECT '2.1.3 FF ' || n_name AS name, n_nationkey AS first_row, lower(n_name) AS key FROM nation UNION ALL VALUES ('Feuerwehr NATION_1x', 100, 'nation_1x'), ('WF Nowhere', 101, 'nowhere')) SELECT name, CAST(first_row AS BIGINT) AS first_row, CASE WHEN first_row < 100 THEN 'exact' WHEN first_row = 100 THEN 'substring' ELSE 'unmatched' END AS match, CASE WHEN first_row < 100 THEN 'osm:' || first_row WHEN first_row = 100 THEN 'osm:1' END AS id FROM r")
def roster_match(spark, sf):
    n = table(spark, sf, "nation")
    stations = n.select(F.concat(F.lit("osm:"), "n_nationkey").alias("id"), F.concat(F.lit("Feuerwehr "), "n_name").alias("name"), F.lit(48.0).alias("lat"), F.lit(12.0).alias("lon"))
    extra = spark.sql("SELECT * FROM VALUES ('Feuerwehr NATION_1x', 100L), ('WF Nowhere', 101L) AS r(name, first_row)")
    roster = n.select(F.concat(F.lit("2.1.3 FF "), "n_name").alias("name"), F.col("n_nationkey").cast("long").alias("first_row")).unionByName(extra)
    hints = extra.select("name", F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"))
    return dispatch.match_roster(roster, stations, hints)


def _said(c: str, phrases) -> str:
    """Whether a text holds one of the phrases."""
    return "(" + " OR ".join(f"contains({c}, '{x}')" for x in phrases) + ")"


def _after(c: str, phrases, plain: str, tail: str = "{}") -> str:
    """What follows the first of the phrases that a text begins with."""
    return "CASE " + " ".join(f"WHEN starts_with({c}, '{x}') THEN " + tail.format(rf"regexp_replace(substr({c}, {len(x) + 1}), '^\\s+|\\s+$', '', 'g')") for x in phrases) + f" ELSE {plain} END"


_GROUP = lambda pattern, n: rf"regexp_replace(coalesce(regexp_extract(low, '{pattern}', {n}), ''), '^\\s+|\\s+$', '', 'g')"
_STOP = r"(?:\s*[?!.]|$)"
_WORD = r"[^\p{L}\p{N}_]"
_TO = _GROUP(rf"von\s+(.+?)\s+nach\s+(.+?){_STOP}", 2)
INTENTS = rf"""
    WITH p AS (SELECT concat_ws('/', conv_id, turn) AS qid, text AS prompt FROM conversations WHERE role = 'user' UNION ALL VALUES ('a', 'äh, Flughafen München'), ('b', 'Wie lange dauert es von A nach B?'), ('c', 'nächste Tankstelle'), ('d', 'Über Ulm nach Bonn mit Zwischenstopp Tankstelle'), ('e', 'Bitte route nach Ulm Hbf!'), ('f', 'Ich will nach Passau fahren'), ('g', 'Café auf dem Weg'), ('h', 'Wo kann ich am See spazieren?'), ('i', 'was ist das'), ('j', '')),
    l AS (SELECT qid, lower(regexp_replace(prompt, '^\s+|\s+$', '', 'g')) AS raw FROM p), q AS (SELECT qid, {_after('raw', intent.FILLERS, 'raw')} AS low FROM l),
    w AS (SELECT *, {_after('low', intent.NAVIGATE, "''", "regexp_replace({}, '[ ?!.]+$', '')")} AS prefix, {_GROUP(r'nach\s+(.+?)\s+(?:navigieren|fahren|route|navigation)', 1)} AS postfix,
          list_filter(regexp_split_to_array(low, '\s+'), lambda x: x <> '') AS words FROM q),
    i AS (SELECT *, CASE WHEN {_said('low', intent.DURATION)} THEN 'duration' WHEN {_said('low', intent.STOPOVER)} OR regexp_matches(low, '(^|{_WORD})über{_WORD}([^\n]*{_WORD})?nach({_WORD}|$)') THEN 'multi_stop' WHEN {_said('low', intent.ON_ROUTE)} THEN 'poi_on_route'
          WHEN prefix <> '' OR postfix <> '' THEN 'navigate' WHEN {_said('low', intent.NEAR)} THEN 'poi_near' WHEN {_said('low', intent.LEISURE)} THEN 'leisure'
          WHEN len(words) BETWEEN 1 AND 5 AND NOT list_has_any(words, {list(intent.QUESTION_WORDS)!r}) THEN 'navigate' ELSE 'unknown' END AS intent FROM w),
    k AS (SELECT *, CASE WHEN intent IN ('multi_stop', 'poi_on_route', 'poi_near', 'leisure') THEN coalesce((SELECT arg_min(word, length(word) * -1000 + nth) FROM (SELECT unnest({sorted(intent.KEYWORDS)!r}) AS word, generate_subscripts({sorted(intent.KEYWORDS)!r}, 1) AS nth) WHERE contains(low, word)), '') ELSE '' END AS keyword FROM i)
    SELECT qid, intent, CASE WHEN intent = 'duration' THEN {_GROUP(rf'von\s+(.+?)\s+nach\s+(.+?){_STOP}', 1)} ELSE '' END AS origin,
           CASE intent WHEN 'duration' THEN CASE WHEN {_TO} <> '' THEN {_TO} ELSE {_GROUP(rf'nach\s+(.+?){_STOP}', 1)} END WHEN 'multi_stop' THEN {_GROUP(r'nach\s+(.+?)(?:\s+mit|\s+und|\s*[?!.]|$)', 1)}
             WHEN 'navigate' THEN CASE WHEN prefix <> '' THEN prefix WHEN postfix <> '' THEN postfix ELSE regexp_replace(low, '[ ?!.]+$', '') END ELSE '' END AS destination,
           k.keyword, coalesce(t.k, '') AS tag_key, coalesce(t.v, '') AS tag_value
    FROM k LEFT JOIN (VALUES {', '.join(f"('{x}', '{t[0]}', '{t[1]}')" for x, t in intent.KEYWORDS.items())}) AS t(keyword, k, v) ON t.keyword = k.keyword"""


@query(INTENTS)
def intents(spark, sf):
    """All user messages as prompts, with some that have an intent."""
    own = table(spark, sf, "conversations").filter("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("qid"), F.col("text").alias("prompt"))
    more = spark.sql("SELECT * FROM VALUES ('a', 'äh, Flughafen München'), ('b', 'Wie lange dauert es von A nach B?'), ('c', 'nächste Tankstelle'), ('d', 'Über Ulm nach Bonn mit Zwischenstopp Tankstelle'), ('e', 'Bitte route nach Ulm Hbf!'), ('f', 'Ich will nach Passau fahren'), ('g', 'Café auf dem Weg'), ('h', 'Wo kann ich am See spazieren?'), ('i', 'was ist das'), ('j', '') AS q(qid, prompt)")
    return intent.classify(own.unionByName(more))


_WORDS = sorted(intent.KEYWORDS)
_WORD_ROWS = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in intent.KEYWORDS.items())


@query(f"WITH k(keyword, tag_key, tag_value) AS (VALUES {_WORD_ROWS}), p AS (SELECT p_partkey AS id, lower(concat(p_name, ' ', list_extract({_WORDS!r}, CAST(p_partkey % {len(_WORDS)} AS INT) + 1), ' ', p_brand)) AS said FROM part), f AS (SELECT id, keyword, tag_key, tag_value, row_number() OVER (PARTITION BY id ORDER BY length(keyword) DESC, keyword) AS nth FROM p JOIN k ON contains(said, keyword)) SELECT p.id, coalesce(keyword, '') AS keyword, coalesce(tag_key, '') AS tag_key, coalesce(tag_value, '') AS tag_value FROM p LEFT JOIN f ON f.id = p.id AND nth = 1")
def keyword_tags(spark, sf):
    """Each part's name, a word people use for a kind of place, and its brand: the tag asked for."""
    word = F.element_at(F.array(*[F.lit(k) for k in _WORDS]), (F.col("p_partkey") % len(_WORDS) + 1).cast("int"))
    said = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), intent.keyword(F.lower(F.concat_ws(" ", "p_name", word, "p_brand"))).alias("keyword"))
    found = said.join(F.broadcast(intent.keyword_tags(spark)), "keyword", "left")
    return found.select("id", "keyword", *[F.coalesce(c, F.lit("")).alias(c) for c in ("tag_key", "tag_value")])


# --- compositions ---

@query()
def text_routes(spark, sf):
    g = kept(spark, sf)
    r = spark.sql("SELECT * FROM VALUES (1, 'Straße 1', 'Straße 2'), (2, '48.001, 12.001', 'small ring'), (3, '?', 'Straße 2'), (4, 'Straße 2', 'Flughafen München') AS q(qid, from_raw, to_raw)")
    return compose.text_routes(r, view(spark, sf, "addresses"), view(spark, sf, "pois"), g.streets, g.edges, g.vertices, cost.RouteOptions(objective="duration"))


@query(f"{ctes('pois')}, d AS (SELECT 1 AS qid, 'poi_near' AS intent, kind, id, name AS label, {hav('48.01e0', '12.01e0', 'lat', 'lon')} AS m FROM pois WHERE amenity = 'cafe' UNION ALL SELECT 2, 'leisure', kind, id, name, {hav('48.02e0', '12.02e0', 'lat', 'lon')} FROM pois WHERE natural_kind = 'water'), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY m, kind, id) AS INT) AS rank FROM d) SELECT qid, intent, rank, kind, id, label, round(m, 5) AS dist_m FROM r WHERE rank <= CASE qid WHEN 1 THEN 8 ELSE 5 END")
def intent_places(spark, sf):
    q = spark.sql("SELECT * FROM VALUES (1, 'Nächstes Café', 48.01D, 12.01D), (2, 'Wo kann ich am See spazieren?', 48.02D, 12.02D), (3, 'Route nach Ulm', 48.0D, 12.0D) AS q(qid, prompt, lat, lon)")
    return compose.intent_places(q, view(spark, sf, "pois")).select("qid", "intent", "rank", "kind", "id", "label", F.round("dist_m", 5).alias("dist_m"))


@query(f"{BUILT} SELECT (SELECT count(*) FROM vx) AS vertices, (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM customer) AS addresses, (SELECT count(*) FROM part) AS pois, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) < max(lat) AND min(lon) < max(lon) AS valid FROM vx")
def engine_status(spark, sf):
    g = built(spark, sf)
    return compose.status(g.edges, g.vertices, table(spark, sf, "customer"), view(spark, sf, "pois"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels of each manifest: assignment to the delivery zones, grouped by vehicle."""
    assigned = territory.assign(view(spark, sf_dir, "points"), zone_edges(spark)).select("id", "territory_id")
    return dispatch.manifest_counts(dispatch.manifest_groups(assigned, zones(spark), "vehicle")).orderBy("manifest")

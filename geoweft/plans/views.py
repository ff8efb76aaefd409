"""Views of the driver's tables as map data. One text serves Spark and the SQL oracle; only ordered lists differ."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The delivery zones; rings as lon lat.
ZONES = {
    "Zone-1": ({"depot": "Depot-Passau", "vehicle": "VAN-01", "technician": "Alice|Bob"}, ["12.6 48.6, 12.7 48.6, 12.8 48.6, 12.8 48.68, 12.7 48.68, 12.7 48.76, 12.6 48.76, 12.6 48.68, 12.6 48.6"]),
    "Zone-2": ({"depot": "Depot-Freyung|Depot-Passau", "vehicle": "VAN-02", "technician": "Bob|Carla"}, ["12.8 48.6, 12.9 48.6, 12.9 48.68, 12.8 48.68, 12.8 48.6", "13.2 48.3, 13.3 48.3, 13.4 48.3, 13.4 48.38, 13.3 48.38, 13.2 48.38, 13.2 48.3"]),
    "Zone-3": ({"depot": "Depot-Freyung", "vehicle": "VAN-03", "technician": "Dieter"}, ["12.95 48.95, 13.05 48.95, 13.05 49.03, 12.95 49.03, 12.95 48.95"]),
}

VIEWS = {
    "points": """
        SELECT o_orderkey AS id, 48.2021e0 + ((o_orderkey * 71) % 199) * 0.005e0 AS lat, 12.5017e0 + ((o_orderkey * 31) % 193) * 0.005e0 AS lon FROM {orders}""",
    "vertices": """
        SELECT p_partkey + 1 AS id, p_partkey % 40 AS x, CAST(floor(p_partkey / 40e0) AS BIGINT) AS y,
               48e0 + 0.001e0 * CAST(floor(p_partkey / 40e0) AS BIGINT) AS lat, 12e0 + 0.001e0 * (p_partkey % 40) AS lon, p_size, p_type FROM {part}""",
    "grid_edges": """
        SELECT a.id AS a, b.id AS b, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, CAST(20 + a.p_size AS DOUBLE) AS speed_kph, a.p_size % 7 = 0 AS one_way,
               CASE a.p_type WHEN 'STANDARD' THEN 'residential' WHEN 'ECONOMY' THEN 'primary' WHEN 'MEDIUM' THEN 'secondary' WHEN 'PROMO' THEN 'track' WHEN 'LARGE' THEN 'motorway' ELSE '' END AS hwy_type,
               CASE WHEN a.p_size % 5 = 0 THEN 3.5e0 ELSE 0e0 END AS max_height_m, CASE WHEN a.p_size % 11 = 0 THEN 7.5e0 ELSE 0e0 END AS max_weight_t
        FROM {vertices} a JOIN {vertices} b ON b.id = a.id + 1 AND a.x < 39
        UNION ALL
        SELECT a.id, b.id, a.lat, a.lon, b.lat, b.lon, CAST(20 + a.p_size AS DOUBLE), a.p_size % 7 = 0,
               CASE a.p_type WHEN 'STANDARD' THEN 'residential' WHEN 'ECONOMY' THEN 'primary' WHEN 'MEDIUM' THEN 'secondary' WHEN 'PROMO' THEN 'track' WHEN 'LARGE' THEN 'motorway' ELSE '' END,
               CASE WHEN a.p_size % 5 = 0 THEN 3.5e0 ELSE 0e0 END, CASE WHEN a.p_size % 11 = 0 THEN 7.5e0 ELSE 0e0 END
        FROM {vertices} a JOIN {vertices} b ON b.id = a.id + 40""",
    "directed": """
        SELECT a AS src, b AS dst, lat1, lon1, lat2, lon2, speed_kph, hwy_type, max_height_m, max_weight_t FROM {grid_edges}
        UNION ALL SELECT b, a, lat2, lon2, lat1, lon1, speed_kph, hwy_type, max_height_m, max_weight_t FROM {grid_edges} WHERE NOT one_way""",
    "way_lines": """
        SELECT 1000000 + y AS id, LIST_OF(x, id) AS node_ids FROM {vertices} GROUP BY y
        UNION ALL SELECT 2000000 + x, LIST_OF(y, id) FROM {vertices} GROUP BY x""",
    "ways": """
        SELECT id, id AS seq, node_ids,
               CASE id % 11 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' WHEN 3 THEN 'residential' WHEN 4 THEN 'service' WHEN 5 THEN 'track' WHEN 6 THEN 'footway'
                    WHEN 7 THEN 'primary_link' WHEN 8 THEN 'living_street' WHEN 9 THEN 'road' ELSE ' Residential ' END AS highway,
               CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN '50' WHEN 2 THEN '30 mph' WHEN 3 THEN 'DE:urban' WHEN 4 THEN 'walk' ELSE '12,5' END AS maxspeed,
               CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'yes' WHEN 2 THEN '-1' WHEN 3 THEN 'no' ELSE 'reverse' END AS oneway,
               CASE WHEN id % 17 = 0 THEN 'Roundabout' ELSE '' END AS junction,
               CASE WHEN id % 4 = 0 THEN '3.5 m' ELSE '' END AS maxheight, CASE WHEN id % 9 = 0 THEN '7,5 t' ELSE '' END AS maxweight,
               CASE WHEN id % 13 = 0 THEN ' Private' ELSE '' END AS access, CASE WHEN id % 19 = 0 THEN 'no' ELSE '' END AS hgv,
               CASE WHEN id % 7 = 3 THEN '' WHEN id % 2 = 0 THEN concat('Straße ', id % 5) ELSE concat('strasse-', id % 5) END AS name
        FROM {way_lines}""",
    "pois": """
        SELECT p_partkey + 1 AS id, CASE WHEN p_partkey % 2 = 0 THEN 'node' ELSE 'way' END AS kind, 48e0 + 0.001e0 * CAST(floor(p_partkey / 40e0) AS BIGINT) AS lat, 12e0 + 0.001e0 * (p_partkey % 40) AS lon,
               p_name AS name, p_brand AS brand, lower(p_type) AS shop,
               CASE p_size % 10 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' WHEN 3 THEN 'hamlet' WHEN 4 THEN 'quarter' WHEN 5 THEN 'locality' ELSE '' END AS place,
               CASE p_size % 8 WHEN 0 THEN 'fire_hydrant' WHEN 1 THEN 'phone' ELSE '' END AS emergency,
               CASE p_size % 6 WHEN 0 THEN 'water' WHEN 1 THEN 'scrub' ELSE '' END AS natural_kind, CASE WHEN p_size % 9 = 0 THEN 'cafe' ELSE '' END AS amenity
        FROM {part}""",
    "addresses": """
        SELECT c_custkey AS id, c_custkey AS seq, 48e0 + 0.001e0 * (c_custkey % 60) AS lat, 12e0 + 0.001e0 * (c_custkey % 37) AS lon, p_name AS street,
               CAST(c_custkey % 50 + 1 AS VARCHAR(10)) AS housenumber, lpad(CAST(c_custkey % 100000 AS VARCHAR(10)), 5, '0') AS postcode, n_name AS city
        FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {part} ON p_partkey = c_custkey % (SELECT count(*) FROM {part})""",
    "districts": """
        SELECT c_custkey AS k, concat('D', CAST(c_custkey AS VARCHAR(10))) AS tid, concat('layer ', CAST(c_nationkey % 5 AS VARCHAR(10))) AS layer, concat('key_', CAST(c_custkey % 3 AS VARCHAR(10))) AS key,
               47e0 + 0.01e0 * floor(c_custkey / 40e0) AS lat0, 11e0 + 0.01e0 * (c_custkey % 40) AS lon0,
               47e0 + 0.01e0 * floor(c_custkey / 40e0) + 0.01e0 - 0.0002e0 * (c_custkey % 4) AS lat9, 11e0 + 0.01e0 * (c_custkey % 40) + 0.01e0 - 0.0003e0 * (c_custkey % 3) AS lon9 FROM {customer}""",
    "positions": """
        SELECT user_id AS qid, n AS pos, 48.5821e0 + (user_id % 20) * 0.01e0 AS lat, 12.5517e0 + (n % 90) * 0.01e0 AS lon
        FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM {events}) AS e""",
    "queries": """
        SELECT qid, raw FROM (VALUES (1, 'small ring 5, NATION_3'), (2, 'red bolt'), (3, 'NATION_7'), (4, '00012'), (5, 'blue gear 12345'), (6, 'gear'), (7, 'Brand#1'), (8, 'promo'), (9, 'old anvil')) AS v(qid, raw)""",
}

TAGS = {
    "ways": {k: k for k in ("highway", "maxspeed", "oneway", "junction", "maxheight", "maxweight", "access", "hgv", "name")},
    "pois": {"name": "name", "brand": "brand", "shop": "shop", "place": "place", "emergency": "emergency", "natural": "natural_kind", "amenity": "amenity"},
    "addresses": {"addr:street": "street", "addr:housenumber": "housenumber", "addr:postcode": "postcode", "addr:city": "city"},
}
_LIST = re.compile(r"LIST_OF\((\w+), (\w+)\)")
_REF = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view (or table) as a DataFrame; tagged ones get their map column `tags`."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = _LIST.sub(r"transform(array_sort(collect_list(struct(\1, \2))), s -> s.\2)", VIEWS[name])
    out = spark.sql(text, **{r: view(spark, sf_dir, r) for r in set(_REF.findall(text))})
    if name in TAGS:
        pairs = [x for k, c in TAGS[name].items() for x in (F.lit(k), F.col(c).cast("string"))]
        out = out.withColumn("tags", F.map_filter(F.create_map(*pairs), lambda _, v: v != ""))
    return out


def ctes(*names: str) -> str:
    """The views as common table expressions for the oracle, each after those it needs, from WITH on."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in done:
            for r in _REF.findall(VIEWS[name]):
                add(r)
            done.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_LIST.sub(r'list(\2 ORDER BY \1)', _REF.sub(r'\1', VIEWS[n]))})" for n in done)


def _ring(text: str) -> list[tuple[float, float]]:
    """(lat, lon) of "lon lat, ..."."""
    return [tuple(map(float, p.split()[::-1])) for p in text.split(", ")]


def zones(spark: SparkSession) -> DataFrame:
    """The delivery layer as a territories table; props is a map."""
    rows = [("delivery", k, k, props, [(_ring(r), []) for r in polys]) for k, (props, polys) in ZONES.items()]
    from geoweft.operators.territory import GEOMETRY

    return spark.createDataFrame(rows, f"layer string, territory_id string, name string, props map<string,string>, geometry {GEOMETRY}")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each customer as a territories table of five layers; some touch, some are a few dozen metres apart."""
    d = view(spark, sf_dir, "districts")
    corner = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    ring = F.array(*[corner(*c) for c in (("lat0", "lon0"), ("lat0", "lon9"), ("lat9", "lon9"), ("lat9", "lon0"), ("lat0", "lon0"))])
    hole = F.array().cast("array<array<struct<lat:double,lon:double>>>")
    props = F.create_map(F.lit("depot"), F.col("tid"), F.col("key"), F.lit("x"))
    return d.select("layer", F.col("tid").alias("territory_id"), F.col("tid").alias("name"), props.alias("props"), F.array(F.struct(ring.alias("outer"), hole.alias("holes"))).alias("geometry"))


def zone_edges_sql() -> str:
    """VALUES rows (tid, poly, lat1, lon1, lat2, lon2) of the delivery layer."""
    rows = []
    for k, (_, polys) in ZONES.items():
        for p, text in enumerate(polys):
            ring = _ring(text)
            rows += [f"('{k}', {p}, {a[0]!r}e0, {a[1]!r}e0, {b[0]!r}e0, {b[1]!r}e0)" for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]
    return f"(VALUES {', '.join(rows)}) AS z(tid, poly, lat1, lon1, lat2, lon2)"

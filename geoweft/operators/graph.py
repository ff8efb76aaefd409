"""The road graph: edges, vertices and street names from nodes and ways.

nodes: id, lat, lon, tags. ways: id, node_ids (in order), tags, seq (file order). All steps are joins and aggregates;
nothing but the streets' sample nodes (16 at most) is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions import geo, osm, text

STREET_SAMPLES = 16


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    vertices: DataFrame
    streets: DataFrame


def road_ways(ways: DataFrame, *, allowed: tuple[str, ...] | None = None, speeds: dict[str, float] | None = None) -> DataFrame:
    """Ways that can be driven: id, seq, node_ids, name, hwy_type, speed_kph, max_height_m, max_weight_t, oneway."""
    tag = osm.tags_of("tags")
    ok = osm.is_driveable(tag("highway"), allowed) & ~osm.is_access_denied("tags") & (F.size("node_ids") >= 2)
    signed = text.parse_maxspeed_kph(tag("maxspeed"))
    usual = osm.default_speed(tag("highway"), speeds)
    return ways.filter(ok).select(
        "id", "seq", "node_ids", tag("name").alias("name"),
        F.lower(text.trim(tag("highway"))).alias("hwy_type"),
        F.when(signed > 0, signed).when(usual > 0, usual).otherwise(osm.OTHER_SPEED).alias("speed_kph"),
        text.parse_measure(tag("maxheight")).alias("max_height_m"),
        text.parse_measure(tag("maxweight")).alias("max_weight_t"),
        text.parse_oneway(tag("oneway"), tag("junction")).alias("oneway"),
    )


def build_edges(nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """Directed edges: way, pos, src, dst, dist_m and the road's limits. Segments with a missing end or no length go."""
    step = F.posexplode(F.arrays_zip(F.slice("node_ids", F.lit(1), F.size("node_ids") - 1).alias("a"), F.slice("node_ids", F.lit(2), F.size("node_ids") - 1).alias("b")))
    road = ["hwy_type", "speed_kph", "max_height_m", "max_weight_t", "oneway"]
    segments = roads.select(F.col("id").alias("way"), *road, step.alias("pos", "s")).select("way", "pos", *road, F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    ends = lambda p: nodes.select(F.col("id").alias(p), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    placed = segments.join(ends("a"), "a").join(ends("b"), "b").withColumn("dist_m", geo.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    placed = placed.filter((F.col("dist_m") > 0) & ~F.isnan("dist_m"))
    forth = F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))
    back = F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    ways_of = F.when(F.col("oneway") == 1, F.array(forth)).when(F.col("oneway") == -1, F.array(back)).otherwise(F.array(forth, back))
    return placed.withColumn("e", F.explode(ways_of)).select("way", "pos", "e.src", "e.dst", "dist_m", "speed_kph", "max_height_m", "max_weight_t", "hwy_type")


def vertices_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge that leaves them: id, lat, lon."""
    return nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", "lat", "lon")


def street_dictionary(roads: DataFrame, vertices: DataFrame) -> DataFrame:
    """key, display (the longest name in bytes, the first of equals), node_ids (first 16 sample nodes, then only those
    that are vertices). Streets without a vertex are dropped."""
    n = F.size("node_ids")
    samples = F.array_distinct(F.array(F.element_at("node_ids", 1), F.get("node_ids", F.when(n > 3, F.floor(n / 2)).otherwise(F.least(F.lit(1), n - 1)).cast("int")), F.element_at("node_ids", -1)))
    named = roads.filter("name <> ''").select(text.normalize(F.col("name")).alias("key"), "name", "seq", samples.alias("samples"))
    display = named.groupBy("key").agg(F.max_by("name", F.struct(F.octet_length("name"), -F.col("seq"))).alias("display"))
    each = named.select("key", "seq", F.posexplode("samples").alias("pos", "node")).groupBy("key", "node").agg(F.min(F.struct("seq", "pos")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("first"))
    kept = each.withColumn("nth", nth).filter(F.col("nth") <= STREET_SAMPLES).join(vertices.select(F.col("id").alias("node")), "node", "left_semi")
    lists = kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "node"))), lambda s: s["node"]).alias("node_ids"))
    return display.join(lists, "key")


def build_graph(nodes: DataFrame, ways: DataFrame, *, window: tuple[float, float, float, float] | None = None, allowed: tuple[str, ...] | None = None, speeds: dict[str, float] | None = None) -> Graph:
    """The graph of the roads in the window (min_lat, max_lat, min_lon, max_lon), or of all."""
    if window is not None:
        nodes = nodes.filter(geo.within(F.col("lat"), F.col("lon"), window))
    roads = road_ways(ways, allowed=allowed, speeds=speeds)
    edges = build_edges(nodes, roads)
    vertices = vertices_of(nodes, edges)
    return Graph(edges, vertices, street_dictionary(roads, vertices))


def node_street_names(streets: DataFrame) -> DataFrame:
    """node, name: the least display name of the streets that sample it."""
    return streets.select(F.explode("node_ids").alias("node"), "display").groupBy("node").agg(F.min("display").alias("name"))


def bounds(vertices: DataFrame) -> DataFrame:
    """One row: min_lat, max_lat, min_lon, max_lon, valid (both spans above 0)."""
    box = vertices.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    return box.withColumn("valid", F.coalesce((F.col("min_lat") < F.col("max_lat")) & (F.col("min_lon") < F.col("max_lon")), F.lit(False)))


def counts(graph_edges: DataFrame) -> DataFrame:
    return graph_edges.agg(F.count_distinct("src").alias("vertices"), F.count(F.lit(1)).alias("edges"))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, out: the edges that leave each vertex, by head and distance; for export only."""
    out = F.array_sort(F.collect_list(F.struct("dst", "dist_m", "speed_kph", "max_height_m", "max_weight_t", "hwy_type")))
    return edges.groupBy("src").agg(out.alias("out"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def contraction_ranks(edges: DataFrame) -> DataFrame:
    """id, degree, rank: vertices numbered from 0 by degree, then id.

    Ranks are counted per degree: a histogram of degrees gives where each degree's ranks begin, so that no window runs
    over all vertices.
    """
    degrees = out_degrees(edges)
    sizes = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("degree", F.coalesce(F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("degree").orderBy("id")) - 1
    return degrees.withColumn("within", within).join(F.broadcast(before), "degree").select("id", "degree", (F.col("before") + F.col("within")).alias("rank"))


def upward_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges that lead to a vertex of higher rank."""
    rank_of = lambda c, name: ranks.select(F.col("id").alias(c), F.col("rank").alias(name))
    return edges.join(rank_of("src", "src_rank"), "src").join(rank_of("dst", "dst_rank"), "dst").filter("dst_rank > src_rank")


def path_coords(paths: DataFrame, vertices: DataFrame) -> DataFrame:
    """qid, pos, node, lat, lon of paths (qid, path); nodes that the graph doesn't know are left out."""
    steps = paths.select("qid", F.posexplode("path").alias("pos", "node"))
    return steps.join(vertices.withColumnRenamed("id", "node"), "node").select("qid", "pos", "node", "lat", "lon")

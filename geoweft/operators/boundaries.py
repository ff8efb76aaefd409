"""Reports on areas: the rings of administrative boundaries, how they lie in each other, and what they enclose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import geo, osm, text
from geoweft.functions.lineage import cut, dealt
from geoweft.operators import compose, search, territory

#: How far inside of its longest edge a ring is asked for what lies around it, in degrees.
INSIDE = 1e-6


def _edges(points: Column) -> Column:
    """Array of a (one end) and b (the next) of a closed ring."""
    return F.transform(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: F.struct(F.get(points, i).alias("a"), p.alias("b")))


def _total(edges: Column, term) -> Column:
    return F.aggregate(F.transform(edges, term), F.lit(0.0), lambda s, x: s + x)


def mercator_areas(rings: DataFrame) -> DataFrame:
    """id, ring, mercator_m2: areas in the plane of web maps, which grow towards the poles."""
    first = F.get("points", F.lit(0))
    x, y = lambda p: geo.mercator_x(p["lon"] - first["lon"]), lambda p: geo.mercator_y(p["lat"]) - geo.mercator_y(first["lat"])
    return rings.select("id", "ring", (F.abs(_total(_edges(F.col("points")), lambda e: x(e["a"]) * y(e["b"]) - x(e["b"]) * y(e["a"]))) / 2).alias("mercator_m2"))


def inner_points(rings: DataFrame) -> DataFrame:
    """id (of id and ring), lat, lon: a point just inside the middle of each ring's longest edge."""
    first = F.get("points", F.lit(0))
    edges = _edges(F.col("points"))
    turn = _total(edges, lambda e: (e["a"]["lon"] - first["lon"]) * (e["b"]["lat"] - first["lat"]) - (e["b"]["lon"] - first["lon"]) * (e["a"]["lat"] - first["lat"]))
    sized = F.transform(edges, lambda e: F.struct(F.hypot(e["b"]["lat"] - e["a"]["lat"], e["b"]["lon"] - e["a"]["lon"]).alias("n"), e["a"].alias("a"), e["b"].alias("b")))
    e = rings.select(F.struct("id", "ring").alias("id"), F.signum(turn).alias("turn"), F.array_max(sized).alias("e")).filter("turn <> 0 AND e.n > 0").select("id", "turn", "e.*")
    step = lambda axis: (F.col(f"b.{axis}") - F.col(f"a.{axis}")) / F.col("n") * F.col("turn") * INSIDE
    middle = lambda axis: (F.col(f"a.{axis}") + F.col(f"b.{axis}")) / 2
    return e.select("id", (middle("lat") + step("lon")).alias("lat"), (middle("lon") - step("lat")).alias("lon"))


def nesting(rings: DataFrame) -> DataFrame:
    """id, ring, depth: in how many other rings of the same id each ring (id, ring, points) lies.

    A point just inside a ring meets the rings of its own id whose bounds hold it, through a grid of the id of about as many
    cells as it has rings, and of these only the edges in its band of latitude. Rings that share corners or edges don't count
    as nested; rings without an area have depth 0.
    """
    axis = lambda f, c: f(F.transform("points", lambda p: p[c]))
    low, high = F.array_min, F.array_max
    box = rings.select("id", "ring", F.size("points").alias("n"), axis(low, "lat").alias("min_lat"), axis(high, "lat").alias("max_lat"), axis(low, "lon").alias("min_lon"), axis(high, "lon").alias("max_lon"))
    grid = box.groupBy("id").agg(F.count(F.lit(1)).alias("rings"), F.min("min_lat").alias("lat0"), F.min("min_lon").alias("lon0"), F.greatest(F.max("max_lat") - F.min("min_lat"), F.max("max_lon") - F.min("min_lon")).alias("span")).filter("rings > 1")
    grid = grid.select("id", "lat0", "lon0", (F.greatest("span", F.lit(1e-9)) / F.least(F.ceil(F.sqrt("rings")), F.lit(1024))).alias("size"))
    bands = F.least(F.greatest(F.floor(F.col("n") / territory.BAND_EDGES), F.lit(1)), F.lit(territory.MOST_BANDS))
    box = cut(box.withColumn("bands", bands).join(dealt(grid), "id"))
    band = lambda lat: F.least(F.greatest(F.floor((lat - F.col("min_lat")) / F.greatest(F.col("max_lat") - F.col("min_lat"), F.lit(1e-9)) * F.col("bands")), F.lit(0)), F.col("bands") - 1)
    cells = lambda a, b, origin: F.explode(F.sequence(geo.cell(F.col(a), F.col(origin), F.col("size")), geo.cell(F.col(b), F.col(origin), F.col("size"))))
    around = box.withColumnRenamed("ring", "other").withColumn("cx", cells("min_lon", "max_lon", "lon0")).withColumn("cy", cells("min_lat", "max_lat", "lat0")).drop("lat0", "lon0", "size", "n")
    inner = inner_points(rings).select("id.id", "id.ring", "lat", "lon").join(dealt(grid), "id")
    inner = inner.select("id", "ring", "lat", "lon", geo.cell(F.col("lon"), F.col("lon0"), F.col("size")).alias("cx"), geo.cell(F.col("lat"), F.col("lat0"), F.col("size")).alias("cy"))
    met = inner.join(dealt(around), ["id", "cx", "cy"]).filter("ring <> other AND lat BETWEEN min_lat - 1e-8 AND max_lat + 1e-8 AND lon BETWEEN min_lon - 1e-8 AND max_lon + 1e-8")
    met = met.select("id", "ring", "other", "lat", "lon", band(F.col("lat")).alias("band"))
    edges = rings.select("id", "ring", F.explode(_edges(F.col("points"))).alias("e")).select("id", "ring", F.col("e.a.lat").alias("lat1"), F.col("e.a.lon").alias("lon1"), F.col("e.b.lat").alias("lat2"), F.col("e.b.lon").alias("lon2"))
    edges = edges.filter("lat1 <> lat2 OR lon1 <> lon2").join(dealt(box.select("id", "ring", "min_lat", "max_lat", "bands")), ["id", "ring"])
    edges = edges.withColumn("band", F.explode(F.sequence(band(F.least("lat1", "lat2") - 1e-8), band(F.greatest("lat1", "lat2") + 1e-8)))).select("id", F.col("ring").alias("other"), "band", "lat1", "lon1", "lat2", "lon2")
    e = [F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")]
    tested = met.join(dealt(edges), ["id", "other", "band"]).groupBy("id", "ring", "other").agg(F.bool_or(geo.on_segment(*e)).alias("on_edge"), F.count_if(geo.crosses(*e)).alias("crossed"))
    depths = tested.filter("on_edge OR crossed % 2 = 1").groupBy("id", "ring").agg(F.count(F.lit(1)).alias("depth"))
    return rings.select("id", "ring").join(dealt(depths), ["id", "ring"], "left").select("id", "ring", F.coalesce("depth", F.lit(0)).alias("depth"))


def ring_report(rings: DataFrame) -> DataFrame:
    """id, ring, depth, area_m2 (sphere), mercator_m2 of rings (id, ring, points)."""
    rings = cut(rings)
    return nesting(rings).join(dealt(compose.ring_areas(rings).join(dealt(mercator_areas(rings)), ["id", "ring"])), ["id", "ring"])


def named_boundaries(questions: DataFrame, relations: DataFrame) -> DataFrame:
    """qid, id: the administrative relation of the least id whose name holds the name asked for, both as they are compared.
    Questions (qid, name) without one have no row; an empty name asks for nothing."""
    named = relations.filter(osm.tag("tags", "boundary") == "administrative").select("id", text.normalize_compare(osm.tag("tags", "name")).alias("hay")).filter("hay <> ''")
    asked = questions.select("qid", text.normalize_compare(F.col("name")).alias("sought")).filter("sought <> ''")
    wanted = cut(asked.select("sought").distinct())
    named = named.groupBy("hay").agg(F.min("id").alias("id"))
    met = search.held(named, "hay", wanted, "sought").groupBy("sought").agg(F.min("id").alias("id"))
    return asked.join(dealt(met), "sought").select("qid", "id")


def area_report(questions: DataFrame, relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """qid, id, rings, forest, area_m2, net_m2, mercator_m2, outline: what the boundary asked for encloses.

    questions: qid, name. relations: id, tags, members; ways: id, tags, node_ids; nodes: id, lat, lon.
    area_m2 is the sum of all rings' areas if a member way is forest or wood or there is but one ring, else 0; net_m2 and
    mercator_m2 take rings in an odd number of others as holes; outline is the number of the largest ring, the least of
    equals. A name that is not found has a row with nulls; a boundary without closed rings has 0 rings and areas of 0.
    Only the boundaries asked for are assembled, each once.
    """
    found = cut(named_boundaries(questions, relations))
    wanted = cut(relations.join(dealt(found.select("id").distinct()), "id", "left_semi").select("id", "members"))
    rings = ring_report(compose.relation_rings(wanted, ways, nodes))
    tag = osm.tags_of("tags")
    woods = ways.filter((tag("landuse") == "forest") | (tag("natural") == "wood")).select(F.col("id").alias("way"))
    members = wanted.select("id", F.explode("members").alias("m")).filter("m.type = 'way'").select("id", F.col("m.id").alias("way"))
    forests = members.join(dealt(woods), "way", "left_semi").select("id").distinct().withColumn("wooded", F.lit(True))
    side = F.when(F.col("depth") % 2 == 0, 1).otherwise(-1)
    sums = rings.groupBy("id").agg(F.count(F.lit(1)).alias("rings"), F.sum("area_m2").alias("all_m2"), F.sum(side * F.col("area_m2")).alias("net_m2"), F.sum(side * F.col("mercator_m2")).alias("mercator_m2"), F.max_by("ring", F.struct("area_m2", -F.col("ring"))).alias("outline"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    each = wanted.select("id").join(dealt(sums), "id", "left").join(dealt(forests), "id", "left").withColumn("forest", F.coalesce("wooded", F.lit(False))).withColumn("rings", F.coalesce("rings", F.lit(0)))
    each = each.select("id", "rings", "forest", F.when(F.col("forest") | (F.col("rings") == 1), F.coalesce("all_m2", F.lit(0.0))).otherwise(0.0).alias("area_m2"), zero("net_m2"), zero("mercator_m2"), "outline")
    return questions.select("qid").join(dealt(found.join(dealt(each), "id")), "qid", "left")

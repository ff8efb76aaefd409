"""Territories, parcels, rosters, graphs and settings from files, and what is written back."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import text
from geoweft.functions.lineage import cut
from geoweft.operators.territory import GEOMETRY

_POINTS = "array<array<array<double>>>"
FEATURE = "struct<type:string,properties:variant,geometry:struct<type:string,coordinates:variant>>"
COLLECTION = f"struct<type:string,features:array<{FEATURE}>,properties:variant,geometry:struct<type:string,coordinates:variant>>"


def _polygons(kind: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates as GEOMETRY; a Polygon is a MultiPolygon of one."""
    one = F.try_variant_get(coordinates, "$", _POINTS)
    many = F.try_variant_get(coordinates, "$", f"array<{_POINTS}>")
    polys = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    ring = lambda r: F.transform(r, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    return F.transform(polys, lambda p: F.struct(ring(p[0]).alias("outer"), F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), ring).alias("holes"))).cast(GEOMETRY)


def read_geojson(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """territories (layer, territory_id, name, props, geometry) of GeoJSON files, each a collection or one feature.

    The layer is the file's name without ending unless given. Ids: property territory_id, else id, else the value of
    the first property by name, else the feature's number. Files that aren't GeoJSON, and features that aren't polygons,
    give no rows.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("stem"))
    doc = F.from_json("value", COLLECTION)
    parsed = files.select(F.lit(layer).alias("layer") if layer else F.url_decode("stem").alias("layer"), doc.alias("d"))
    features = parsed.select("layer", F.posexplode(F.coalesce("d.features", F.array(F.struct(F.col("d.type").alias("type"), F.col("d.properties").alias("properties"), F.col("d.geometry").alias("geometry"))))).alias("nth", "f"))
    flat = features.select("layer", "nth", F.col("f.properties").alias("props"), _polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry")).filter("geometry IS NOT NULL")
    keyed = flat.withColumn("first_key", F.array_min(F.map_keys(F.try_variant_get("props", "$", "map<string,string>"))))
    get = lambda k: F.nullif(text.property_string(F.try_variant_get("props", f"$.{k}", "variant")), F.lit(""))
    first = F.nullif(F.try_variant_get("props", "$", "map<string,string>")[F.col("first_key")], F.lit(""))
    ident = F.coalesce(get("territory_id"), get("id"), first, F.col("nth").cast("string"))
    return keyed.select("layer", ident.alias("territory_id"), F.coalesce(get("territory_name"), get("name"), F.lit("")).alias("name"), "props", "geometry")


def check_unique(territories: DataFrame) -> DataFrame:
    """territories, or an error that names an id that a layer has twice."""
    twice = territories.groupBy("layer", "territory_id").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"layer {twice.layer}: territory {twice.territory_id} comes {twice['count']} times")
    return territories


def to_geojson(territories: DataFrame) -> DataFrame:
    """layer, geojson: each layer as a FeatureCollection of MultiPolygons with territory_id among the properties.

    Rings need four points at least. props: a map of strings.
    """
    ring = lambda r: F.when(F.size(r) >= 4, F.transform(r, lambda p: F.array(p["lon"], p["lat"]))).otherwise(F.raise_error(F.lit("a ring has fewer than four points")).cast("array<array<double>>"))
    shape = F.transform("geometry", lambda p: F.concat(F.array(ring(p["outer"])), F.transform(F.coalesce(p["holes"], F.array().cast("array<array<struct<lat:double,lon:double>>>")), ring)))
    feature = F.struct(F.lit("Feature").alias("type"), F.map_concat(F.map_filter("props", lambda k, _: k != "territory_id"), F.create_map(F.lit("territory_id"), F.col("territory_id"))).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), shape.alias("coordinates")).alias("geometry"))
    rows = territories.select("layer", "territory_id", feature.alias("feature"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("territory_id", F.to_json("feature").alias("json")))), lambda f: f["json"])
    return rows.groupBy("layer").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("geojson"))


def write_geojson(territories: DataFrame, path: str) -> None:
    """One folder per layer below path, with its collection as text."""
    to_geojson(territories).select("layer", F.col("geojson").alias("value")).write.mode("overwrite").partitionBy("layer").text(path)


def read_parcels(spark: SparkSession, path: str) -> DataFrame:
    """Parcels of CSV files: parcel_id, lat, lon and all other columns as text, row_ord (the place in the input).

    A missing column, or a latitude or longitude that isn't a number, is an error.
    """
    rows = spark.read.csv(path, header=True)
    if lost := {"parcel_id", "lat", "lon"} - set(rows.columns):
        raise ValueError(f"parcels need the columns {sorted(lost)}")
    number = lambda c: F.coalesce(F.trim(c).try_cast("double"), F.raise_error(F.concat(F.lit(f"{c} of parcel "), F.coalesce("parcel_id", F.lit("?")), F.lit(" isn't a number"))).cast("double"))
    return rows.select("parcel_id", number("lat").alias("lat"), number("lon").alias("lon"), *[c for c in rows.columns if c not in ("parcel_id", "lat", "lon")], F.monotonically_increasing_id().alias("row_ord"))


def write_assignments(assigned: DataFrame, path: str, include: list[str]) -> None:
    """parcel_id, territory_id and the included columns as CSV."""
    columns = ["parcel_id", "territory_id", *[c for c in dict.fromkeys(include) if c != "territory_id"]]
    assigned.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


#: Manifests of more rows are sorted in many tasks; one then writes the parts in their order, without holding them.
SORTED_ROWS = 1_000_000


def write_manifests(manifests: DataFrame, path: str) -> None:
    """One CSV file per manifest, <manifest>.csv below path, rows in input order (row_ord)."""
    manifests = cut(manifests)
    counts = manifests.groupBy("manifest").agg(F.count(F.lit(1)).alias("n"))
    long = sorted(r["manifest"] for r in counts.filter(F.col("n") > SORTED_ROWS).select("manifest").collect())  # few: each has many rows
    rows = manifests.filter(~F.col("manifest").isin(long)) if long else manifests
    rows = rows.repartition("manifest").sortWithinPartitions("manifest", "row_ord").drop("row_ord")
    rows.withColumn("_file", F.col("manifest")).drop("manifest").write.mode("overwrite").partitionBy("_file").csv(path, header=True)
    spark = manifests.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop_path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for part in fs.globStatus(hadoop_path(folder, "_file=*/part-*")):
        # a manifest is one task's: its folder holds one file
        name = unquote(part.getPath().getParent().getName().removeprefix("_file="))
        fs.rename(part.getPath(), hadoop_path(folder, f"{name}.csv"))
        fs.delete(part.getPath().getParent(), True)
    for n, name in enumerate(long):
        own = cut(manifests.filter(F.col("manifest") == name).drop("manifest").repartitionByRange("row_ord").sortWithinPartitions("row_ord"))
        own.drop("row_ord").coalesce(1).write.mode("overwrite").csv(f"{path}/_long={n}", header=True)
        for part in fs.globStatus(hadoop_path(folder, f"_long={n}/part-*")):
            fs.rename(part.getPath(), hadoop_path(folder, f"{name}.csv"))
        fs.delete(hadoop_path(folder, f"_long={n}"), True)


def write_layers(territories: DataFrame, path: str) -> None:
    """Each layer as GeoJSON below path, and the manifest of layers (layer, path) beside them."""
    write_geojson(territories, f"{path}/layers")
    layers = territories.select("layer").distinct()
    layers.select("layer", F.concat(F.lit("layers/layer="), F.col("layer")).alias("path")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """The territories of all layers that the manifest names."""
    rows = spark.read.schema("layer string, path string").json(f"{path}/manifest").collect()
    out = [read_geojson(spark, f"{path}/{r.path}", r.layer) for r in sorted(rows)]
    return reduce(lambda a, b: a.unionByName(b), out) if out else spark.createDataFrame([], f"layer string, territory_id string, name string, props variant, geometry {GEOMETRY}")


def raw_layers(spark: SparkSession, path: str) -> DataFrame:
    """layer, value: the GeoJSON files below path as they are."""
    return spark.read.text(path, wholetext=True).select(F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)).alias("layer"), "value")


def bad_layers(spark: SparkSession, path: str) -> DataFrame:
    """layer, problem: files below path that read_geojson() gives no rows of."""
    doc = F.from_json("value", "type string, features array<string>, geometry string")
    problem = F.when(doc["type"].isNull(), "isn't JSON with a type").when((doc["type"] == "FeatureCollection") & doc["features"].isNull(), "has no features").when(~doc["type"].isin("FeatureCollection", "Feature"), "isn't a feature or a collection")
    return raw_layers(spark, path).select("layer", problem.alias("problem")).filter("problem IS NOT NULL")


def publish_postal(spark: SparkSession, source: str, digits: int, path: str) -> DataFrame:
    """Groups the postcode areas of a GeoJSON file by their first digits, writes them as layer plz<digits> and reads it."""
    from geoweft.operators.territory import postal_groups

    grouped = postal_groups(read_geojson(spark, source), digits).withColumn("props", F.create_map(F.lit("name"), F.col("name"), F.lit("codes"), F.col("codes").cast("string")))
    write_layers(grouped, path)
    return read_layers(spark, path)


def write_stations(stations: DataFrame, path: str) -> None:
    """Stored stations (id, name, lat, lon) as JSON lines."""
    stations.select("id", "name", "lat", "lon").write.mode("overwrite").json(path)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, name string, lat double, lon double").json(path)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """name, callsign, type, meta, row of a roster CSV; headers in any case, German or English; rows without a name go."""
    rows = spark.read.csv(path, header=True)
    by = {c.strip().lower(): c for c in rows.columns}
    pick = lambda *names: next((by[n] for n in names if n in by), None)
    name, call, kind = pick("dienststelle", "station"), pick("funkrufname", "callsign"), pick("fahrzeugtyp", "type")
    if name is None:
        raise ValueError("a roster needs a column dienststelle or station")
    cell = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if c else F.lit("")
    rest = [(k, c) for k, c in by.items() if c not in (name, call, kind)]
    meta = F.map_filter(F.create_map(*[x for k, c in rest for x in (F.lit(k), cell(c))]), lambda _, v: v != "") if rest else F.create_map().cast("map<string,string>")
    return rows.select(cell(name).alias("name"), cell(call).alias("callsign"), cell(kind).alias("type"), meta.alias("meta"), F.monotonically_increasing_id().alias("row")).filter("name <> ''")


_NODE = "struct<id:long,lat:double,lon:double>"
_EDGE = "struct<from:long,to:long,dist_m:double,speed_kph:double,max_height_m:double,max_weight_t:double>"


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a graph as JSON: one document of nodes {id, lat, lon} and edges {from, to, dist_m, ...}, or
    lines {node} and {edge}, as write_graph_json() makes them."""
    lines = spark.read.schema(f"node {_NODE}, edge {_EDGE}, nodes array<{_NODE}>, edges array<{_EDGE}>")
    rows = lines.json(path)
    if rows.filter("node IS NOT NULL OR edge IS NOT NULL OR nodes IS NOT NULL OR edges IS NOT NULL").isEmpty():
        rows = lines.json(path, multiLine=True)  # a document over several lines
    of = lambda one, many: rows.select(F.explode(F.coalesce(many, F.array(one))).alias("x")).filter("x IS NOT NULL").select("x.*")
    e = of("edge", "edges")
    return of("node", "nodes"), e.select(F.col("from").alias("src"), F.col("to").alias("dst"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dist_m", "speed_kph", "max_height_m", "max_weight_t")], F.lit("").alias("hwy_type"))


def write_graph_json(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices and edges as JSON lines below path: {node} and {edge}, which read_graph_json() reads again."""
    nodes = vertices.select(F.struct("id", "lat", "lon").alias("node"), F.lit(None).cast(_EDGE).alias("edge"))
    lines = edges.select(F.lit(None).cast(_NODE).alias("node"), F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "dist_m", "speed_kph", "max_height_m", "max_weight_t").alias("edge"))
    nodes.unionByName(lines).write.mode("overwrite").json(path)


POI_VERSION = 3


def write_pois(points: DataFrame, path: str) -> None:
    """The POI table, in a folder that names its version."""
    points.write.mode("overwrite").parquet(f"{path}/v{POI_VERSION}")


def read_pois(spark: SparkSession, path: str, version: int = POI_VERSION) -> DataFrame:
    if version != POI_VERSION:
        raise ValueError(f"POI tables of version {version} can't be read; the current one is {POI_VERSION}")
    return spark.read.parquet(f"{path}/v{version}")


# Settings that only the server may know.
SECRET_SETTINGS = ("openai_api_key",)


def public_settings(settings: DataFrame, secrets: tuple[str, ...] = SECRET_SETTINGS) -> DataFrame:
    """Settings (key, value) with the values of secret keys emptied; a key may be a path, its last part counts."""
    last = F.lower(F.substring_index("key", ".", -1))
    return settings.select("key", F.when(last.isin(*secrets), "").otherwise(F.col("value")).alias("value"))


@dataclass(frozen=True)
class Settings:
    """Import settings; speeds override the defaults, an empty list of highways allows the usual ones."""

    highway_speeds: dict[str, float] = field(default_factory=dict)
    allowed_highways: tuple[str, ...] = ()
    window: tuple[float, float, float, float] | None = None


def read_settings(spark: SparkSession, path: str) -> Settings:
    rows = spark.read.schema("highway_speeds map<string,double>, allowed_highways array<string>, window array<double>").json(path, multiLine=True).collect()
    r = rows[0] if rows else None
    return Settings(dict(r.highway_speeds or {}), tuple(a.strip().lower() for a in r.allowed_highways or () if a and a.strip()), tuple(r.window) if r.window else None) if r else Settings()


def parse_window(raw: str | None, order: str = "lat") -> tuple[float, float, float, float] | None:
    """(min_lat, max_lat, min_lon, max_lon) of "min_lat,max_lat,min_lon,max_lon", or for order "bbox" of
    "min_lon,min_lat,max_lon,max_lat"; None if it isn't a valid window."""
    from geoweft.functions.geo import valid_window

    try:
        n = [float(x) for x in (raw or "").split(",")]
    except ValueError:
        return None
    if len(n) != 4:
        return None
    w = (n[0], n[1], n[2], n[3]) if order == "lat" else (n[1], n[3], n[0], n[2])
    return w if valid_window(w) else None


def parse_limit(raw: str | None, default: int, least: int, most: int) -> int:
    try:
        return max(least, min(most, int((raw or "").strip())))
    except ValueError:
        return default


def import_progress(steps: DataFrame) -> DataFrame:
    """seq, percent: 60 plus 35 parts in proportion, half up, never falling. steps: seq, done, total.

    There are 36 values of percent at most: each stands from the first step that reaches it on, so that no task sees all
    steps in order. Steps of one seq share the highest of them.
    """
    done = F.least(F.greatest(F.col("done"), F.lit(0)), F.col("total"))
    percent = F.lit(60) + F.when(F.col("total") > 0, F.floor((done * 70 + F.col("total")) / (2 * F.col("total")))).otherwise(0)
    at = F.struct(F.col("seq").isNotNull(), "seq")  # null is before all
    first = steps.groupBy(percent.alias("percent")).agg(F.min(at).alias("at"))
    reached = first.agg(F.collect_list(F.struct("percent", "at")).alias("reached"))
    so_far = F.array_max(F.transform(F.filter("reached", lambda r: r["at"] <= at), lambda r: r["percent"]))
    return steps.crossJoin(F.broadcast(reached)).select("seq", so_far.alias("percent"))

"""Dispatch: assignments with chosen properties, manifests, vehicle constraints, station rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions import geo, text
from geoweft.functions.lineage import cut, dealt
from geoweft.operators import search
from geoweft.operators.territory import property_keys


def property_column(props: Column, key: str, kind: str) -> Column:
    """A property as text: props is a map of strings or a VARIANT."""
    if kind.startswith("map"):
        return F.coalesce(props[key], F.lit(""))
    return text.property_string(F.try_variant_get(props, f'$["{key}"]', "variant"))


def include_properties(assigned: DataFrame, territories: DataFrame, include: list[str]) -> DataFrame:
    """assigned (…, territory_id) with the chosen properties of each row's territory; territory_id comes once."""
    keys = [k for k in dict.fromkeys(include) if k != "territory_id"]
    kind = dict(territories.dtypes)["props"]
    chosen = territories.select("territory_id", *[property_column(F.col("props"), k, kind).alias(k) for k in keys])
    out = assigned.join(F.broadcast(chosen) if territories.count() <= 100_000 else chosen, "territory_id", "left")
    return out.select(*assigned.columns, *[F.coalesce(k, F.lit("")).alias(k) for k in keys])


def include_key_rows(territories: DataFrame, layer: str | None = None) -> DataFrame:
    """nth, key: what include_properties() may be asked for, territory_id, then all property names of the layer or of all."""
    rows = territories if layer is None else territories.filter(F.col("layer") == layer)
    keys = property_keys(rows).select("key").distinct().filter("key <> 'territory_id'")
    named = keys.select((F.row_number().over(Window.orderBy("key")) + 1).alias("nth"), "key")  # names of properties are few
    return territories.sparkSession.sql("SELECT 1 AS nth, 'territory_id' AS key").unionByName(named)


def include_keys(territories: DataFrame, layer: str | None = None) -> list[str]:
    """include_key_rows() as a list."""
    return [r.key for r in include_key_rows(territories, layer).orderBy("nth").collect()]


def flatten(territories: DataFrame, keys: list[str]) -> DataFrame:
    """territory_id, name and each property of keys as a text column of its own."""
    kind = dict(territories.dtypes)["props"]
    return territories.select("territory_id", "name", *[property_column(F.col("props"), k, kind).alias(k) for k in dict.fromkeys(keys) if k not in ("territory_id", "name")])


def manifest_groups(assigned: DataFrame, territories: DataFrame, group_by: str) -> DataFrame:
    """assigned with `manifest`: the file name of the row's group; rows without territory or property: UNASSIGNED.

    Groups whose names become equal as file names share a manifest.
    """
    if group_by == "territory_id":
        value = F.col("territory_id")
        rows = assigned
    else:
        rows = include_properties(assigned, territories, [group_by])
        value = F.when(F.col("territory_id").isNotNull(), F.col(group_by))
    return rows.withColumn("manifest", text.sanitize_name(value)).select(*assigned.columns, "manifest")


def manifest_counts(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("manifest").agg(F.count(F.lit(1)).alias("parcels"))


def compatible(vehicles: DataFrame, shipments: DataFrame, vehicle_property: str = "territory_id") -> DataFrame:
    """vehicle, shipment, cost 0 of pairs in which the vehicle's property is the shipment's territory; all others are
    impossible and have no row. vehicles: vehicle, props (map); shipments: shipment, territory_id."""
    v = vehicles.select("vehicle", F.coalesce(F.col("props")[vehicle_property], F.lit("")).alias("territory_id")).filter("territory_id <> ''")
    return v.join(shipments.select("shipment", "territory_id"), "territory_id").select("vehicle", "shipment", F.lit(0.0).alias("cost"))


# --- stations: id, name, lat, lon; vehicles: station_id, pos, callsign, type, meta ---

def merge_vehicles(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Vehicles by station and callsign: incoming ones replace those of the same callsign where these stood, the last of
    several wins; new ones follow in the order they first came. Both sides: station_id, pos, callsign, type."""
    rows = existing.select("station_id", "pos", "callsign", "type", F.lit(0).alias("side")).unionByName(incoming.select("station_id", "pos", "callsign", "type", F.lit(1).alias("side")))
    key = F.struct("side", "pos")
    merged = rows.groupBy("station_id", "callsign").agg(F.min(key).alias("first"), F.max_by("type", key).alias("type"))
    return merged.withColumn("pos", F.row_number().over(Window.partitionBy("station_id").orderBy("first")) - 1).select("station_id", "pos", "callsign", "type")


def list_stations(osm_stations: DataFrame, stored: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """id, name, lat, lon, source: stations of the map, with stored names where there are any, and manual ones."""
    known = stored.select("id", F.col("name").alias("own"))
    named = osm_stations.join(known, "id", "left").select("id", text.first_non_empty(F.col("own"), F.col("name")).alias("name"), "lat", "lon", F.lit("osm").alias("source"))
    manual = stored.filter(F.startswith("id", F.lit("manual:"))).select("id", "name", "lat", "lon", F.lit("manual").alias("source"))
    return named.unionByName(manual).filter(geo.within(F.col("lat"), F.col("lon"), window))


def upsert_stations(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored table after changes (id, name, lat, lon, deleted): blank names keep the old one, only manual stations
    move, new ones are added, deleted ones go."""
    old = stored.select(F.col("id"), *[F.col(c).alias(f"old_{c}") for c in ("name", "lat", "lon")])
    both = old.join(changes, "id", "full_outer").filter(~F.coalesce("deleted", F.lit(False)))
    moves = F.startswith("id", F.lit("manual:"))
    place = lambda c: F.when(moves, F.coalesce(c, f"old_{c}")).otherwise(F.coalesce(f"old_{c}", c))
    return both.select("id", text.first_non_empty(F.col("name"), F.col("old_name")).alias("name"), place("lat").alias("lat"), place("lon").alias("lon"))


#: Names beyond this many are matched by equal parts of keys; up to it, each meets all of them.
FEW_NAMES = 256


def _holding(rest: DataFrame, named: DataFrame) -> DataFrame:
    """rest (…, key) with the one of named (k, id) of which one key holds the other: of several the longest, then the least.

    Keys meet by equal parts (see search.held()), each key once, however many names have it.
    """
    named, keys = cut(named), cut(rest.select("key").distinct())
    holds = F.contains("key", F.col("k")) | F.contains("k", F.col("key"))
    if named.count() <= FEW_NAMES:
        met = keys.join(F.broadcast(named), holds)
    else:
        met = search.held(keys.filter("key <> ''"), "key", named, "k").select("key", "k", "id")
        met = met.unionByName(search.held(named, "k", keys.filter("key <> ''"), "key").select("key", "k", "id"))
        met = met.unionByName(named.join(F.broadcast(keys.filter("key = ''")), holds).select("key", "k", "id"))  # an empty key, of which there is one at most, is held by all
    best = met.groupBy("key").agg(F.min(F.struct((-F.length("k")).alias("n"), "k", "id")).alias("b"))
    return rest.join(dealt(best.select("key", "b.k", "b.id")), "key")


def _taken(near: DataFrame, own: list[str]) -> DataFrame:
    """Of candidates (own columns, first_row, sid, d) those that come about when names, in the order of rows, each take the
    nearest station still free in their import.

    In rounds: each name asks its nearest station left; a station keeps the earliest name that asks, and is then closed to
    all later ones. When every name keeps what it asked for, that is the result: what a station keeps only ever gets
    earlier, so no name is turned away by one that gives way later.
    """
    left, when = near.select(*own, "first_row", "sid", "d").distinct(), F.struct("first_row", "name")
    left = cut(left)
    while True:
        asked = left.groupBy(*own, "first_row").agg(F.min(F.struct("d", "sid")).alias("best")).select(*own, "first_row", "best.sid")
        kept = cut(asked.groupBy("import", "sid").agg(F.min(when).alias("keeper")))
        met = left.join(dealt(kept), ["import", "sid"], "left")
        late = F.col("keeper").isNotNull() & (when > F.col("keeper"))
        if met.filter(late).isEmpty():
            return cut(asked)
        left = cut(met.filter(~F.coalesce(late, F.lit(False))).select(*left.columns))


def match_roster(roster: DataFrame, stations: DataFrame, hints: DataFrame, radius_m: float = 1500.0) -> DataFrame:
    """Roster names (name, first_row, and import where several are matched at once) matched to stations: name, match
    (exact, substring, guessed, unmatched), id, and import if there is one.

    1. equal keys; 2. a station's key within the name's or the reverse (of several the longest, then the least);
    3. hints (name, lat, lon): the nearest unnamed station within radius_m, each taken once by an import, in the order of
    rows; see _taken().
    """
    if "import" in roster.columns:
        return _matched(roster, stations, hints, radius_m)
    return _matched(roster.withColumn("import", F.lit("")), stations, hints, radius_m).drop("import")


def _matched(roster: DataFrame, stations: DataFrame, hints: DataFrame, radius_m: float) -> DataFrame:
    own = ["import", "name"]
    keyed = roster.select("import", "name", "first_row", text.station_key(F.col("name")).alias("key"))
    named = stations.filter("name <> ''").select("id", text.station_key(F.col("name")).alias("key")).groupBy("key").agg(F.max("id").alias("id"))
    exact = keyed.join(dealt(named), "key").select(*own, "first_row", F.lit("exact").alias("match"), "id")
    rest = cut(keyed.join(dealt(exact.select(*own)), own, "left_anti"))
    part = _holding(rest, named.filter("key <> ''").select(F.col("key").alias("k"), "id"))
    best = part.groupBy(*own, "first_row").agg(F.min_by("id", F.struct(-F.length("k"), "k")).alias("id"))
    substring = best.select(*own, "first_row", F.lit("substring").alias("match"), "id")
    rest = rest.join(dealt(substring.select(*own)), own, "left_anti")
    # cells as high as the radius, and as wide at the query's latitude
    size = radius_m / 111000.0
    across = F.ceil(1 / F.cos(F.radians(F.least(F.lit(89.0), F.abs("lat") + size)))).cast("int")
    cell = lambda lat, lon: (geo.cell(F.col(lon), -180.0, size), geo.cell(F.col(lat), -90.0, size))
    unnamed = stations.filter("name = ''").select(F.col("id").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    unnamed = unnamed.select("*", *[c.alias(n) for c, n in zip(cell("slat", "slon"), ("cx", "cy"), strict=True)])
    cx, cy = cell("lat", "lon")
    around = rest.join(dealt(hints), "name").withColumn("cx", F.explode(F.sequence(cx - across, cx + across))).withColumn("cy", F.explode(F.sequence(cy - 1, cy + 1)))
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    near = around.join(dealt(unnamed), ["cx", "cy"]).withColumn("d", d).filter(F.col("d") <= radius_m).select(*own, "first_row", "sid", "d")

    guessed = _taken(near, own).select(*own, "first_row", F.lit("guessed").alias("match"), F.col("sid").alias("id"))
    found = exact.unionByName(substring).unionByName(guessed)
    missed = keyed.join(dealt(found.select(*own)), own, "left_anti").select(*own, "first_row", F.lit("unmatched").alias("match"), F.lit(None).cast("string").alias("id"))
    return found.unionByName(missed).select("import", "name", "first_row", "match", "id")

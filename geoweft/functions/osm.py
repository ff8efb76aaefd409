"""Rules on OpenStreetMap tags as Column expressions. Tags are a map column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweft.functions.text import trim

# Speeds where none is signed (km/h), and classes that cars may use.
HIGHWAY_SPEEDS = {"motorway": 110.0, "trunk": 100.0, "primary": 80.0, "secondary": 70.0, "tertiary": 60.0, "unclassified": 50.0, "residential": 30.0, "living_street": 10.0, "service": 20.0, "track": 25.0}
OTHER_SPEED = 50.0
DRIVEABLE = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "road", "track")
ROUTER_TAGS = ("highway", "name", "maxspeed", "oneway", "junction", "maxheight", "maxweight", "access", "vehicle", "motor_vehicle", "hgv")
# What makes an entity a point of interest.
POI_KEYS = ("amenity", "shop", "tourism", "leisure", "office", "craft", "healthcare", "emergency", "sport", "historic", "place", "aeroway", "public_transport")
POI_VALUES = {
    "railway": ("station", "halt", "tram_stop", "platform", "subway_entrance"),
    "highway": ("bus_stop", "services", "rest_area"),
    "natural": ("water", "wood", "peak", "beach", "cave_entrance", "spring"),
    "landuse": ("forest", "reservoir", "recreation_ground", "village_green"),
}
# Of which keys an entity needs one to be read as a place, by kind, and the keys of which its tags are kept.
GATE_KEYS = {
    "node": ("amenity", "shop", "tourism", "leisure", "office", "craft", "healthcare", "emergency", "sport", "historic", "place", "aeroway", "public_transport", "railway", "highway", "natural", "landuse", "boundary"),
    "way": ("amenity", "shop", "tourism", "leisure", "office", "craft", "healthcare", "emergency", "sport", "historic", "place", "aeroway", "public_transport", "railway", "natural", "landuse", "boundary"),
    "relation": ("amenity", "shop", "tourism", "leisure", "historic", "place", "natural", "landuse", "boundary"),
}
KEPT_KEYS = (
    "name", "alt_name", "amenity", "shop", "brand", "operator", "office", "craft", "natural", "landuse", "leisure", "tourism", "railway", "highway",
    "public_transport", "aeroway", "man_made", "healthcare", "emergency", "sport", "historic", "place", "boundary", "admin_level", "wikipedia", "website",
    "opening_hours", "phone",
)
PLACE_RANKS = {"city": 100, "town": 80, "village": 60, "suburb": 45, "quarter": 45, "neighbourhood": 45, "hamlet": 30, "locality": 15, "isolated_dwelling": 15}


def tag(tags: Column | str, key: str) -> Column:
    """A tag's value; empty where it is missing."""
    column = F.col(tags) if isinstance(tags, str) else tags
    return F.coalesce(column[key], F.lit(""))


def tags_of(tags: str):
    """The function from key to value that label and score rules take."""
    return lambda key: tag(tags, key)


def keep_tags(tags: Column, keys: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> Column:
    kept = lambda k: reduce(lambda a, p: a | F.startswith(k, F.lit(p)), prefixes, k.isin(*keys))
    return F.map_filter(tags, lambda k, _: kept(k))


def has_key(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(k) for k in keys]))


def passes_gate(kind: str | Column, tags: Column) -> Column:
    """Whether an entity of this kind (a name, or a column of names) has a key that makes it worth reading as a place."""
    if isinstance(kind, str):
        return has_key(tags, GATE_KEYS[kind])
    return reduce(lambda a, k: a | ((kind == k) & has_key(tags, GATE_KEYS[k])), GATE_KEYS, F.lit(False))


def is_address(tags: Column) -> Column:
    return F.exists(F.map_keys(tags), lambda k: F.startswith(k, F.lit("addr:")))


def tag_equals(tags: str, key: str, value: str | None = None) -> Column:
    """Whether the key is there and, if a value is given, has it in any case."""
    there = F.map_contains_key(F.col(tags), key)
    return there & (F.lower(tag(tags, key)) == value.lower()) if value else there


def is_driveable(highway: Column, allowed: tuple[str, ...] | None = None) -> Column:
    h = F.lower(trim(highway))
    if allowed:
        names = [a.strip().lower() for a in allowed if a.strip()]
        return h.isin(*names) | (F.endswith(h, F.lit("_link")) & F.regexp_replace(h, "_link$", "").isin(*names))
    return F.endswith(h, F.lit("_link")) | h.isin(*DRIVEABLE)


def is_access_denied(tags: str) -> Column:
    deny = [F.lower(trim(tag(tags, k))).isin("no", "private") for k in ("access", "vehicle", "motor_vehicle", "hgv")]
    return reduce(lambda a, b: a | b, deny)


def default_speed(highway: Column, speeds: dict[str, float] | None = None) -> Column:
    """speeds: overrides of HIGHWAY_SPEEDS; those not above 0 are ignored."""
    table = HIGHWAY_SPEEDS | {k.strip(): v for k, v in (speeds or {}).items() if v > 0 and k.strip()}
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[F.lower(trim(highway))], F.lit(OTHER_SPEED))


def is_poi(tags: str) -> Column:
    listed = [tag(tags, k).isin(*values) for k, values in POI_VALUES.items()]
    named = (tag(tags, "boundary") != "") & (tag(tags, "name") != "")
    return reduce(lambda a, b: a | b, [tag(tags, k) != "" for k in POI_KEYS] + listed) | named


def place_rank(place: Column) -> Column:
    pairs = [x for k, v in PLACE_RANKS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[place], F.lit(0))


def hydrant_type(tags: str) -> Column:
    said, name = trim(tag(tags, "fire_hydrant:type")), F.lower(tag(tags, "name"))
    return (
        F.when(said != "", said)
        .when(name.contains("unterflur"), "underground")
        .when(name.contains("überflur") | name.contains("ueberflur"), "pillar")
        .when(name.contains("wand"), "wall")
        .otherwise("")
    )

"""Geodesy as Column expressions: distances, bearings, turns, grid cells and map tiles. Angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
AREA_RADIUS_M = 6378137.0
DEGREE_M = 111320.0
METRES_PER_DEGREE = 111194.9
EDGE_TOLERANCE = 1e-9
NODE_CELL = 0.01
LABEL_CELL = 0.02


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_M)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    turn = F.radians(lon2 - lon1)
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return (F.degrees(F.atan2(F.sin(turn) * F.cos(F.radians(lat2)), north)) + 360) % 360


def angle_diff_deg(to: Column, since: Column) -> Column:
    """How far a heading turns, clockwise positive; in [-180, 180) for bearings."""
    return (to - since + 540) % 360 - 180


def turn_kind(diff: Column) -> Column:
    return F.when(F.abs(diff) > 160, "u-turn").when(diff > 30, "right").when(diff < -30, "left").otherwise("straight")


def segment_distance_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to a segment on the plane that touches the globe at the point's latitude."""
    shrink = F.cos(F.radians(lat))
    x1, y1 = (lon1 - lon) * shrink * DEGREE_M, (lat1 - lat) * DEGREE_M
    x2, y2 = (lon2 - lon) * shrink * DEGREE_M, (lat2 - lat) * DEGREE_M
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    share = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(x1 * dx + y1 * dy) / F.nullif(square, F.lit(0.0)))))
    return F.hypot(x1 + share * dx, y1 + share * dy)


def on_segment(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whether the point lies on the segment, within EDGE_TOLERANCE degrees."""
    dx, dy = lon2 - lon1, lat2 - lat1
    square = dx * dx + dy * dy
    share = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - lon1) * dx + (lat - lat1) * dy) / F.nullif(square, F.lit(0.0)))))
    ex, ey = lon - (lon1 + share * dx), lat - (lat1 + share * dy)
    return ex * ex + ey * ey <= EDGE_TOLERANCE * EDGE_TOLERANCE


def crosses(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whether a ray east from the point crosses the segment, half-open in latitude."""
    rise = F.nullif(lat2 - lat1, F.lit(0.0))
    return F.coalesce(((lat1 > lat) != (lat2 > lat)) & (lon < (lon2 - lon1) * (lat - lat1) / rise + lon1), F.lit(False))


def cell(value: Column, origin: float | Column, size: float | Column) -> Column:
    return F.floor((value - origin) / size)


def reach_m(lat: Column, size: float | Column) -> Column:
    """No point of the world beyond the square of so many degrees to each side of a point at this latitude is nearer than
    this; 0 where the point lies beyond a pole."""
    return size * METRES_PER_DEGREE * F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + 2 * size)))


def within(lat: Column, lon: Column, window: tuple[float, float, float, float]) -> Column:
    """window: min_lat, max_lat, min_lon, max_lon; borders count."""
    return lat.between(F.lit(float(window[0])), F.lit(float(window[1]))) & lon.between(F.lit(float(window[2])), F.lit(float(window[3])))


def valid_window(window: tuple[float, float, float, float]) -> bool:
    lat0, lat1, lon0, lon1 = window
    return -90 <= lat0 < lat1 <= 90 and -180 <= lon0 < lon1 <= 180


def window_center(window: tuple[float, float, float, float]) -> tuple[float, float]:
    return (window[0] + window[1]) / 2, (window[2] + window[3]) / 2


def expand_window(lat0: Column, lat1: Column, lon0: Column, lon1: Column, meters: Column | float) -> list[Column]:
    """The window grown by meters on each side, within the world; unchanged for meters <= 0. Order as in `within`."""
    m = meters if isinstance(meters, Column) else F.lit(float(meters))
    up = m / DEGREE_M
    across = m / (F.cos(F.radians((lat0 + lat1) / 2)) * DEGREE_M)
    grown = [F.greatest(F.lit(-90.0), lat0 - up), F.least(F.lit(90.0), lat1 + up), F.greatest(F.lit(-180.0), lon0 - across), F.least(F.lit(180.0), lon1 + across)]
    return [F.when(m > 0, g).otherwise(old) for g, old in zip(grown, (lat0, lat1, lon0, lon1), strict=True)]


def boxes_overlap(a: list[Column], b: list[Column]) -> Column:
    """a, b: min_lat, max_lat, min_lon, max_lon."""
    return (a[0] <= b[1]) & (b[0] <= a[1]) & (a[2] <= b[3]) & (b[2] <= a[3])


def tile_lon(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360 - 180


def tile_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / F.pow(F.lit(2.0), zoom)))))


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * AREA_RADIUS_M


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * AREA_RADIUS_M


def area_term(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """A ring edge's part of the spherical area: sum, abs(), times AREA_RADIUS_M squared over 2."""
    return F.radians(lon2 - lon1) * (2 + F.sin(F.radians(lat1)) + F.sin(F.radians(lat2)))

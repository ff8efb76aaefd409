"""Scored search over addresses, points of interest and streets, for one query or for a table of queries.

Queries are a table (qid, raw), normalised and asked once each. Up to FEW_QUERIES are tested on every row of a corpus.
More of them meet the corpus by an equi-join: a row that holds a text holds every piece of it, so a query is listed under
its piece of PIECE letters (all of a shorter text) that fewest rows have, and under what must be equal; rows meet the
queries listed under their own pieces and values, and are then tested. Scores are those of the test on every row. Top-k
per query keeps k rows per task before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions import osm, text
from geoweft.functions.lineage import cut, dealt

ADDRESS_KEYS = ("addr:street", "addr:housenumber", "addr:postcode", "addr:city", "addr:place", "name", "brand", "operator", "shop", "office", "amenity", "tourism", "leisure")
BROADCAST_QUERIES = 100_000
FEW_QUERIES, PIECE = 32, 3
_EQUAL = 1000  # slots of what must be equal, behind those of texts
STAGES = {"address": 0, "poi": 1, "street": 2}


def _pieces(value: Column, sizes: list[int]) -> Column:
    """Array of the distinct pieces of `sizes` letters that a text holds."""
    of = lambda n: F.when(F.char_length(value) >= n, F.transform(F.sequence(F.lit(1), F.char_length(value) - n + 1), lambda i: F.substr(value, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes])) if sizes else F.array().cast("array<string>")


def _met(corpus: DataFrame, hay: str, asked: DataFrame, texts: Column, values: Column | None = None, equals: list[tuple[Column, Column]] | None = None) -> DataFrame:
    """corpus rows with the rows of asked of which a text lies in `hay`, or an equal is among `values`, each pair once.

    texts: array of texts of asked; values: array of marked strings of corpus; equals: marked strings of asked (null for
    none), each with the test of a pair that it stands for. A pair that meets by several of these stays with the first.
    """
    none, equals = F.array().cast("array<string>"), equals or []
    each = asked.select("*", F.posexplode(texts).alias("_slot", "_t")).filter("_t <> ''")
    sizes = sorted(r[0] for r in each.select(F.least(F.char_length("_t"), F.lit(PIECE))).distinct().collect())
    sought = each.filter(F.char_length("_t") >= PIECE).withColumn("_key", F.explode(_pieces(F.col("_t"), [PIECE])))
    sought = sought.unionByName(each.filter(F.char_length("_t") < PIECE).withColumn("_key", F.col("_t")))
    rows = corpus.select(F.explode(_pieces(F.col(hay), sizes)).alias("_key"))
    wanted = cut(sought.select("_key").distinct())
    few = wanted.count() <= BROADCAST_QUERIES
    counts = rows.join(F.broadcast(wanted) if few else wanted, "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    rarest = sought.join(counts, "_key", "left").groupBy(*asked.columns, "_slot").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_key")).alias("_k"))
    listed = rarest.select(*asked.columns, "_slot", F.concat(F.lit("~"), F.col("_k._key")).alias("_key"))
    for i, (marked, _) in enumerate(equals):
        listed = listed.unionByName(asked.select("*", F.lit(_EQUAL + i).alias("_slot"), marked.alias("_key")).filter("_key IS NOT NULL"))
    listed = cut(listed)
    keys = F.concat(F.transform(_pieces(F.col(hay), sizes), lambda p: F.concat(F.lit("~"), p)), values if values is not None else none)
    own = corpus.withColumn("_key", F.explode(F.array_distinct(keys)))
    met = own.join(F.broadcast(listed) if listed.count() <= BROADCAST_QUERIES else listed, "_key")
    holds = lambda t: (t != "") & F.contains(F.col(hay), t)
    slot = F.col("_slot")
    fits, before = holds(F.get(texts, slot)), F.exists(F.slice(texts, F.lit(1), F.least(slot, F.size(texts))), holds)
    for i, (_, test) in enumerate(equals):
        fits = F.when(slot == _EQUAL + i, test).otherwise(fits)
        before = before | ((slot > _EQUAL + i) & test)
    return met.filter(fits & ~before).drop("_key", "_slot")


#: Texts with more parts of the lengths sought, and tables of more lengths, are met by pieces instead.
MOST_PARTS, MOST_LENGTHS = 4096, 64


def held(corpus: DataFrame, hay: str, asked: DataFrame, needle: str) -> DataFrame:
    """corpus rows with the rows of asked whose text `needle` (not empty, each once) lies in `hay`, each pair once.

    Parts of a text as long as those sought meet them by equality, so that work follows the texts and what is found; texts
    too long for that meet by pieces.
    """
    lengths = sorted(r[0] for r in asked.select(F.char_length(needle)).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        return _met(corpus, hay, asked, F.array(needle))
    short = F.char_length(hay) * len(lengths) <= MOST_PARTS
    met = corpus.filter(short).withColumn("_part", F.explode(_pieces(F.col(hay), lengths))).join(dealt(asked.withColumn("_part", F.col(needle))), "_part").drop("_part")
    rest = corpus.filter(~short)
    return met if rest.isEmpty() else met.unionByName(_met(rest, hay, asked, F.array(needle)))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (id, ...) over all cores. A table of few bytes has few splits, and the tests on its texts would be a task's work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "id")  # as named, they aren't coalesced


def _few(rows: DataFrame) -> DataFrame:
    """rows, worked out once, as a broadcast where they are few."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_QUERIES else rows


def _ranked(scored: DataFrame, order: list[Column], limit: Column | int | None) -> DataFrame:
    """rank within each query; `limit` may be a column. A constant limit lets Spark drop rows before the shuffle."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def parsed(queries: DataFrame) -> DataFrame:
    """qid, raw and the parsed address `q`."""
    return queries.select("qid", "raw", text.parse_address(F.col("raw")).alias("q"))


QUERY_PARTS = ("street", "housenumber", "postcode", "city", "raw")


def _distinct(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, by): normalised queries, each once under its least qid `k`, and the k of every qid."""
    parts = parsed(queries).select("qid", *[text.normalize(F.col(f"q.{p}")).alias(f"q_{p}") for p in QUERY_PARTS])
    names = [f"q_{p}" for p in QUERY_PARTS]
    asked = cut(parts.groupBy(*names).agg(F.min("qid").alias("k")))
    return asked, parts.join(F.broadcast(asked) if asked.count() <= BROADCAST_QUERIES else asked, names).select("qid", "k")


def score_addresses(addresses: DataFrame, asked: DataFrame) -> DataFrame:
    """k, id, seq (if addresses have it), score of each address (id, lat, lon, tags) that scores above 0; asked: of
    _distinct(). Narrow rows: what ranks them doesn't carry tags."""
    order = ["id", "seq"] if "seq" in addresses.columns else ["id"]
    field = lambda key: F.col(f"n_{ADDRESS_KEYS.index(key)}")
    fields = _dealt(addresses.select(*order, "tags")).select(*order, *[text.normalize(osm.tag("tags", key)).alias(f"n_{i}") for i, key in enumerate(ADDRESS_KEYS)])
    fields = fields.withColumn("hay", F.concat_ws("\n", *[field(k) for k in ADDRESS_KEYS]))
    # a cheap test in the join: every score has a field that holds or equals a part of the query
    asks = lambda part, *keys: (F.col(f"q_{part}") != "") & reduce(lambda a, b: a | b, [field(k) == F.col(f"q_{part}") for k in keys])
    within = lambda part: (F.col(f"q_{part}") != "") & F.contains("hay", F.col(f"q_{part}"))
    maybe = within("raw") | within("street") | asks("housenumber", "addr:housenumber") | asks("postcode", "addr:postcode") | asks("city", "addr:city", "addr:place")
    score = text.address_score(field, {p: F.col(f"q_{p}") for p in QUERY_PARTS})
    if asked.count() <= FEW_QUERIES:
        met = fields.crossJoin(F.broadcast(asked)).filter(maybe)
    else:
        mark = lambda m, c: F.concat(F.lit(m), c)
        values = F.array(mark("h", field("addr:housenumber")), mark("p", field("addr:postcode")), mark("c", field("addr:city")), mark("c", field("addr:place")))
        tests = {"h": asks("housenumber", "addr:housenumber"), "p": asks("postcode", "addr:postcode"), "c": asks("city", "addr:city", "addr:place")}
        equals = [(F.when(F.col(f"q_{part}") != "", mark(m, F.col(f"q_{part}"))), tests[m]) for m, part in (("h", "housenumber"), ("p", "postcode"), ("c", "city"))]
        met = _met(fields, "hay", asked, F.array("q_raw", "q_street"), values, equals)
    # exploded, so that the score is worked out once and behind the join
    return met.select("k", *order, F.explode(F.array(score)).alias("score")).filter("score > 0")


def top_addresses(addresses: DataFrame, queries: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(by, top): qid, k of each query, and k, id, score, rank of the best addresses of each text k, as search_addresses()."""
    asked, by = _distinct(queries)
    scored = score_addresses(addresses, asked).select(F.col("k").alias("qid"), "id", "score")
    return by, _ranked(scored, [F.desc("score"), F.col("id")], limit if limit and limit > 0 else None).withColumnRenamed("qid", "k")


def search_addresses(addresses: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """The best addresses per query: the highest score, then the least id; limit None or below 1: all."""
    by, top = top_addresses(addresses, queries, limit)
    return addresses.join(_few(by.join(top, "k")), "id").select("qid", *addresses.columns, "score", "rank")


def best_address(addresses: DataFrame, queries: DataFrame) -> DataFrame:
    """One address per query: the highest score, of equals the first in input order (column seq)."""
    asked, by = _distinct(queries)
    best = score_addresses(addresses, asked).groupBy("k").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("seq"))).alias("b"))
    return by.join(best, "k").select("qid", "b.id", "b.score")


#: The tags that scores and labels of POIs follow from.
POI_KEYS = tuple(dict.fromkeys((*text.POI_FIELDS, "addr:housenumber", "addr:postcode", *text.CATEGORY_KEYS, "street")))


def search_pois(points: DataFrame, queries: DataFrame, limit: int | None) -> DataFrame:
    """The best POIs (kind, id, lat, lon, tags) per query: the highest score, then label, kind and id. Each combination of
    tags is scored once, and rows meet the best of them."""
    q = queries.select("qid", text.normalize_compare(text.trim(F.col("raw"))).alias("q")).withColumn("tokens", F.filter(F.split("q", " +"), lambda t: t != ""))
    own = F.struct(*[osm.tag("tags", k).alias(f"t{i}") for i, k in enumerate(POI_KEYS)])
    tag = lambda key: F.col("own")[f"t{POI_KEYS.index(key)}"]
    sorts = _dealt(points.select(own.alias("own")).distinct().select(F.xxhash64("own").alias("id"), "own")).drop("id")
    fields = text.labelled(sorts, "poi", tag).drop("subtitle")
    fields = fields.select("*", text.poi_fields(tag).alias("fields"), text.is_complete(tag).alias("complete"))
    q = cut(q)
    if q.count() <= FEW_QUERIES:
        met = fields.crossJoin(F.broadcast(q))
    else:
        met = _met(fields.withColumn("hay", F.array_join(F.transform("fields", lambda f: f["v"]), "\n")), "hay", q, F.col("tokens")).drop("hay")
    pairs = met.withColumn("score", F.explode(F.array(text.poi_score(F.col("fields"), F.col("q"), F.col("tokens"))))).filter("score > 0")
    scored = pairs.withColumn("score", F.when(F.col("complete"), F.col("score") + 3).otherwise(F.col("score"))).select("qid", "own", "label", "score")
    if limit is not None:  # each has a row at least, so `limit` rows lie in as many, or in equals of the last of them
        scored = scored.withColumn("above", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score"), "label"))).filter(F.col("above") <= limit).drop("above")
    rows = points.withColumn("own", own).join(_few(scored), "own")
    return _ranked(rows.select("qid", *points.columns, "label", "score"), [F.desc("score"), F.col("label"), F.col("kind"), F.col("id")], limit)


def search_streets(streets: DataFrame, vertices: DataFrame, queries: DataFrame, limit: int | None) -> DataFrame:
    """qid, rank, name, key, score, node, lat, lon: equal, then prefix, then containing names, then by display and key."""
    q = queries.select("qid", text.normalize(F.col("raw")).alias("q")).filter("q <> ''")
    q = cut(q)
    met = streets.crossJoin(F.broadcast(q)) if q.count() <= FEW_QUERIES else _met(streets, "key", q, F.array("q"))
    scored = met.withColumn("score", text.street_score(F.col("key"), F.col("q"))).filter("score > 0")
    top = _ranked(scored, [F.desc("score"), F.col("display"), F.col("key")], limit).withColumn("node", F.get("node_ids", F.lit(0)))
    placed = top.join(vertices.select(F.col("id").alias("node"), "lat", "lon"), "node")
    return placed.select("qid", "rank", F.col("display").alias("name"), "key", "score", "node", "lat", "lon")


def street_node(streets: DataFrame, vertices: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, node, name of the best street: an exact name first (its score is the highest)."""
    return search_streets(streets, vertices, queries, 1).select("qid", "node", "name")


def _results(found: DataFrame, kind: str, tags: Column, node_id: str) -> DataFrame:
    """found (qid, rank, raw_q, ...) as search results."""
    own = found.select("qid", "rank", "raw_q", F.col(node_id).alias("id"), "lat", "lon", tags.alias("tags"))
    tag = osm.tags_of("tags")
    rows = text.labelled(own, kind, tag).select("*", text.normalize_compare(F.col("raw_q")).alias("nq"), text.address_label(tag).alias("own_label"))
    rows = rows.withColumn("match", text.match_reason(kind, tag, F.col("own_label"), F.col("nq")))
    return rows.select("qid", F.lit(kind).alias("kind"), F.lit(STAGES[kind]).alias("stage"), "rank", "id", "lat", "lon", "label", "subtitle", "match")


def search(addresses: DataFrame | None, points: DataFrame, streets: DataFrame, vertices: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Addresses (None: of those it is known that none scores), then POIs, then streets, each label and place once, `limit`
    per query: qid, nth, kind, id, ...

    A later stage only fills what earlier ones leave open; it brings min(2 * open, 20) rows. Stages are written once.
    """
    q = queries.select("qid", text.trim(F.col("raw")).alias("raw")).filter("raw <> ''")
    raws = q.withColumnRenamed("raw", "raw_q")
    out = None
    if addresses is not None:
        found = search_addresses(addresses, q, min(2 * limit, 50)).join(raws, "qid")
        out = cut(_unique(_results(found, "address", F.col("tags"), "id"), limit))
    asked = lambda n: (F.lit(limit) - F.coalesce(n, F.lit(0))).alias("open")
    open_slots = lambda done: raws.select("*", asked(F.lit(None))) if done is None else raws.join(done.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left").select("qid", "raw_q", asked(F.col("n")))
    more = search_pois(points, q, 20).join(open_slots(out), "qid").filter(F.col("rank") <= F.least(2 * F.col("open"), F.lit(20)))
    more = _results(more, "poi", F.col("tags"), "id")
    out = cut(_unique(more if out is None else out.unionByName(more), limit))
    by_street = parsed(q).select("qid", F.when(F.col("q.street") != "", F.col("q.street")).otherwise(F.col("raw")).alias("raw"))
    roads = search_streets(streets, vertices, by_street, 20).join(open_slots(out), "qid").filter(F.col("rank") <= F.least(2 * F.col("open"), F.lit(20)))
    out = cut(_unique(out.unionByName(_results(roads, "street", F.create_map(F.lit("street"), F.col("name")), "node")), limit))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("stage", "rank"))
    return out.withColumn("nth", nth).drop("stage", "rank")


def _unique(rows: DataFrame, limit: int) -> DataFrame:
    key = [F.col("qid"), text.normalize_compare(F.col("label")), F.round(F.col("lat") * 1e6).cast("long"), F.round(F.col("lon") * 1e6).cast("long")]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("stage", "rank"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("stage", "rank"))
    return rows.withColumn("first", first).filter("first = 1").withColumn("nth", nth).filter(F.col("nth") <= limit).drop("first", "nth")


def parse_lat_lon(raw: Column) -> Column:
    """struct(lat, lon) of text such as "48.1, 11.5"; null if it isn't that or lies outside the world."""
    pattern = r"^\s*([-+]?[0-9]+(?:\.[0-9]+)?)\s*[,\s]\s*([-+]?[0-9]+(?:\.[0-9]+)?)\s*$"
    lat, lon = (F.nullif(F.regexp_extract(raw, pattern, i), F.lit("")).try_cast("double") for i in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def check_locations(requests: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """qid, lat, lon, raw, error: requests (qid, lat, lon, raw) as places to resolve, or refused with a reason.

    A position, given or written as text, must lie in the world and in the request's window (qid, min_lat, max_lat,
    min_lon, max_lon), if it has one. Other text stays to be searched: its results go through in_windows().
    """
    raw = F.coalesce(text.trim(F.col("raw")), F.lit(""))
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    q = requests.select("qid", given.alias("given"), F.when(given, F.struct("lat", "lon")).otherwise(parse_lat_lon(raw)).alias("at"), F.when(~given, raw).alias("raw"))
    sides = ("min_lat", "max_lat", "min_lon", "max_lon")
    if windows is None:
        q = q.withColumn("outside", F.lit(False))
    else:
        q = q.join(windows.select("qid", *sides), "qid", "left")
        q = q.withColumn("outside", F.coalesce(~(F.col("at.lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("at.lon").between(F.col("min_lon"), F.col("max_lon"))), F.lit(False)))
    valid = F.col("at.lat").between(-90, 90) & F.col("at.lon").between(-180, 180)
    error = F.when(F.col("given") & ~valid, "invalid lat/lon").when(~F.col("given") & (F.col("raw") == ""), "missing query or lat/lon").when(F.col("outside"), "outside configured window")
    q = q.withColumn("error", error)
    sound = F.col("error").isNull()
    return q.select("qid", F.when(sound, F.col("at.lat")).alias("lat"), F.when(sound, F.col("at.lon")).alias("lon"), F.when(sound & F.col("at").isNull(), F.col("raw")).alias("raw"), "error")


def in_windows(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Search results (qid, lat, lon, ...) that lie in the window of their request, if it has one."""
    sides = [F.col(c).alias(f"_{c}") for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    met = found.join(windows.select("qid", *sides), "qid", "left")
    inside = F.col("lat").between(F.col("_min_lat"), F.col("_max_lat")) & F.col("lon").between(F.col("_min_lon"), F.col("_max_lon"))
    return met.filter(F.coalesce(inside, F.lit(True))).select(*found.columns)


def resolve(addresses: DataFrame, points: DataFrame, streets: DataFrame, vertices: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, resolution, lat, lon, label for each query: coordinates, airport of Munich, best address, street, search.

    Each step only sees the queries that the steps before left open. Airport queries with several hits are `ambiguous`,
    those without any `not found`, as are all that nothing resolves.
    """
    q = queries.select("qid", text.trim(F.col("raw")).alias("raw"))
    spot = q.withColumn("at", parse_lat_lon(F.col("raw")))
    by_coords = spot.filter("at IS NOT NULL").select("qid", F.lit("coordinates").alias("resolution"), "at.lat", "at.lon", F.format_string("%.6f, %.6f", "at.lat", "at.lon").alias("label"))
    rest = cut(spot.filter("at IS NULL AND raw <> ''").select("qid", "raw"))

    low = F.lower("raw")
    airport = (low.contains("flughafen") | low.contains("airport")) & (low.contains("münchen") | low.contains("muenchen") | low.contains("munich"))
    hints = search_addresses(addresses, rest.filter(airport), 20)
    place = text.normalize_compare(F.concat_ws(" ", *[osm.tag("tags", k) for k in ("name", "addr:city", "addr:place", "operator", "brand", "aeroway")]))
    local = hints.filter(place.contains("muenchen") | place.contains("munchen")).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("lat", "lon", text.address_label(osm.tags_of("tags")).alias("label")), "rank").alias("b"))
    hinted = rest.filter(airport).join(local, "qid", "left")
    one = F.col("n") == 1
    by_airport = hinted.select("qid", F.when(one, "airport").when(F.col("n") > 1, "ambiguous").otherwise("not found").alias("resolution"), F.when(one, F.col("b.lat")).alias("lat"), F.when(one, F.col("b.lon")).alias("lon"), F.when(one, F.col("b.label")).alias("label"))

    rest = rest.filter(~airport)
    label = F.explode(F.array(text.address_label(osm.tags_of("tags")))).alias("label")  # worked out behind the join
    by_address = cut(addresses.join(_few(best_address(addresses, rest)), "id").select("qid", F.lit("address").alias("resolution"), "lat", "lon", label))
    rest = cut(rest.join(by_address.select("qid"), "qid", "left_anti"))
    names = parsed(rest).select("qid", F.col("q.street").alias("raw")).filter("raw <> ''")
    by_street = cut(street_node(streets, vertices, names).join(names, "qid").join(vertices.withColumnRenamed("id", "node"), "node").select("qid", F.lit("street").alias("resolution"), "lat", "lon", F.col("raw").alias("label")))
    rest = cut(rest.join(by_street.select("qid"), "qid", "left_anti"))
    # what is left has no address that scores
    by_search = search(None, points, streets, vertices, rest, 6).filter("nth = 1").select("qid", F.lit("search").alias("resolution"), "lat", "lon", "label")
    out = cut(by_coords.unionByName(by_airport).unionByName(by_address).unionByName(by_street).unionByName(by_search))
    missed = q.join(out.select("qid"), "qid", "left_anti").select("qid", F.lit("not found").alias("resolution"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("string").alias("label"))
    return out.unionByName(missed)

"""Text rules of addresses, tags and labels as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How letters outside ASCII are spelt out.
UMLAUTS = (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _spelt_out(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), UMLAUTS, F.lower(text))


def normalize(text: Column) -> Column:
    """Key of a street or field: lower case, umlauts spelt out, without spaces and - , . ; :"""
    return F.translate(_spelt_out(text), " -,.;:", "")


def normalize_compare(text: Column) -> Column:
    """Text for fuzzy comparison: lower case, umlauts spelt out, only a-z, 0-9 and (uncollapsed) spaces."""
    plain = F.translate(F.translate(_spelt_out(text), "'’‘", ""), "-,.", "   ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9 ]", ""))


def first_non_empty(*texts: Column) -> Column:
    """The first text that isn't blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(trim(t), F.lit("")) for t in texts], F.lit(""))


def first_float(text: Column) -> Column:
    """The first run of digits, points and commas as a number (comma as point); null if it isn't one."""
    return F.replace(F.regexp_extract(text, "[0-9.,]+", 0), F.lit(","), F.lit(".")).try_cast("double")


def parse_maxspeed_kph(text: Column) -> Column:
    low = F.lower(trim(text))
    named = F.when(low == "de:urban", 50.0).when(low == "de:rural", 100.0).when(low == "de:motorway", 130.0)
    number = first_float(text) * F.when(low.contains("mph"), 1.60934).otherwise(1.0)
    return F.coalesce(named, number, F.lit(0.0))


def parse_measure(text: Column) -> Column:
    """Metres or tons; 0 where there is no number."""
    return F.coalesce(first_float(text), F.lit(0.0))


def parse_oneway(oneway: Column, junction: Column) -> Column:
    low = F.lower(trim(F.coalesce(oneway, F.lit(""))))
    said = F.when(low.isin("yes", "true", "1"), 1).when(low.isin("-1", "reverse"), -1).otherwise(0)
    return F.when((said == 0) & (F.lower(F.coalesce(junction, F.lit(""))) == "roundabout"), 1).otherwise(said)


def sanitize_name(text: Column) -> Column:
    """A group's name as a file name."""
    name = trim(F.coalesce(text, F.lit("")))
    return F.when(name == "", "UNASSIGNED").otherwise(F.translate(name, '/\\:*?"<>|', "_________"))


def property_string(value: Column) -> Column:
    """A dynamic (VARIANT) property as text: whole numbers without decimals, lists joined by |, null as empty."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    scalar = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.when(whole, number.cast("bigint").cast("string")).otherwise(text)).otherwise(text)
    listed = F.try_variant_get(value, "$", "array<string>")
    return F.coalesce(F.when(kind.startswith("ARRAY"), F.array_join(F.transform(listed, lambda x: F.when(x.try_cast("double") == F.floor(x.try_cast("double")), x.try_cast("double").cast("bigint").cast("string")).otherwise(x)), "|")).otherwise(scalar), F.lit(""))


def street_score(key: Column, query: Column) -> Column:
    return F.when(key == query, 3).when(F.startswith(key, query), 2).when(F.contains(key, query), 1).otherwise(0)


def duration_text(seconds: Column) -> Column:
    minutes = seconds / 60
    whole = F.floor(minutes)
    hours, rest = F.floor(whole / 60), whole % 60
    return F.when(minutes < 60, F.format_string("%.0f min", minutes)).when(rest == 0, F.format_string("%d h", hours)).otherwise(F.format_string("%d h %d min", hours, rest))


def humanize(text: Column) -> Column:
    return trim(F.replace(text, F.lit("_"), F.lit(" ")))


# --- labels; tags are given as a function from key to Column (empty where the tag is missing) ---

CATEGORY_KEYS = ("shop", "amenity", "office", "tourism", "leisure", "railway", "public_transport", "aeroway", "place", "natural")


def address_line(tag) -> Column:
    street, number = trim(tag("addr:street")), trim(tag("addr:housenumber"))
    return F.when((street != "") & (number != ""), F.concat_ws(" ", street, number)).otherwise(street)


def locality(tag) -> Column:
    return trim(F.concat_ws(" ", trim(tag("addr:postcode")), first_non_empty(tag("addr:city"), tag("addr:place"))))


def label_of(line: Column, place: Column, name: Column) -> Column:
    """The label of an address from its line, locality and name (empty where missing)."""
    where = F.concat_ws(", ", F.nullif(line, F.lit("")), F.nullif(place, F.lit("")))
    return (
        F.when((name != "") & (line != ""), F.concat(name, F.lit(" — "), where))
        .when((name != "") & (place != ""), F.concat(name, F.lit(", "), place))
        .when(name != "", name)
        .when(where != "", where)
        .otherwise("Adresse")
    )


def address_label(tag) -> Column:
    return label_of(address_line(tag), locality(tag), first_non_empty(tag("name"), tag("brand"), tag("operator")))


def category(tag) -> Column:
    return first_non_empty(*[tag(k) for k in CATEGORY_KEYS])


def labelled(df: DataFrame, kind: str, tag) -> DataFrame:
    """df with label and subtitle of search results of a kind. Parts are columns of their own on the way, so that
    none is computed twice."""
    parts = {"_line": address_line(tag), "_place": locality(tag), "_name": first_non_empty(tag("name"), tag("brand"), tag("operator")), "_kind": humanize(category(tag)), "_by": first_non_empty(tag("operator"), tag("brand")), "_street": trim(tag("street")) if kind == "street" else F.lit("")}
    out = df.select("*", *[c.alias(n) for n, c in parts.items()]).withColumn("_address", label_of(F.col("_line"), F.col("_place"), F.col("_name")))
    other = {"street": "Straße", "poi": "Ort"}.get(kind, "Adresse")
    label = F.when(F.col("_street") != "", F.col("_street")).when(F.col("_address") != "Adresse", F.col("_address")).when(F.col("_kind") != "", F.col("_kind")).otherwise(other)
    out = out.withColumn("label", label)
    out = out.select("*", normalize_compare(F.col("label")).alias("_label"), *[normalize_compare(F.col(c)).alias(f"{c}_n") for c in ("_line", "_place", "_by")])
    head = F.lit("Straße") if kind == "street" else F.when(F.col("_kind") != "", F.col("_kind")).otherwise("Adresse" if kind == "address" else "")
    said = lambda c: F.when((F.col(c) != "") & ~F.contains("_label", F.col(f"{c}_n")), F.col(c)).otherwise("")
    out = out.withColumn("_head", head).withColumn("_second", said("_by")).withColumn("_third", said("_line"))
    so_far = normalize_compare(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("_head", "_second", "_third")]))
    out = out.withColumn("_fourth", F.when((F.col("_place") != "") & ~F.contains(so_far, F.col("_place_n")) & ~F.contains("_label", F.col("_place_n")), F.col("_place")).otherwise(""))
    out = out.withColumn("_parts", F.filter(F.array("_head", "_second", "_third", "_fourth"), lambda p: p != ""))
    return out.withColumn("subtitle", F.array_join(unique_parts(F.col("_parts")), " • ")).select(*df.columns, "label", "subtitle")


def unique_parts(parts: Column) -> Column:
    """Parts whose normalised text hasn't come before, in order."""
    keys = F.transform(parts, normalize_compare)
    return F.filter(parts, lambda p, i: F.array_position(keys, normalize_compare(p)) == i + 1)


def fields_contain(query: Column, *values: Column) -> Column:
    """Whether some value holds the query, lies in it, or holds one of its words. query: normalised for comparison."""
    tokens = F.filter(F.split(query, " +"), lambda t: t != "")
    hit = lambda v: (v != "") & (F.contains(v, query) | F.contains(query, v) | F.exists(tokens, lambda t: F.contains(v, t)))
    return F.exists(F.transform(F.array(*values), normalize_compare), hit)


# What a result was found by, in order.
REASONS = (
    ("Treffer über Straße", ("street",)),
    ("Treffer über Name/Marke", ("name", "brand", "operator")),
    ("Treffer über Kategorie", ("shop", "amenity", "office", "tourism", "leisure")),
    ("Treffer über Ort", ("addr:city", "addr:place")),
)


def match_reason(kind: str, tag, label: Column, query: Column) -> Column:
    """query: normalised for comparison; label: the address label."""
    out = F.when(query == "", "")
    for said, keys in REASONS:
        found = fields_contain(query, *[tag(k) for k in keys])
        out = out.when(F.lit(True) if kind == "street" else found, said)
    address = fields_contain(query, tag("addr:street"), tag("addr:housenumber"), tag("addr:postcode"), label)
    return out.when(address, "Treffer über Adresse").otherwise("")


# --- scores ---

# Score of a field that equals, begins with or holds the query, and of each word found.
POI_FIELDS = {
    "name": (120, 100, 80, 12),
    "brand": (100, 85, 70, 10),
    "operator": (85, 70, 60, 8),
    "shop": (70, 55, 45, 7),
    "amenity": (70, 55, 45, 7),
    "office": (65, 50, 40, 6),
    "tourism": (60, 45, 35, 6),
    "leisure": (60, 45, 35, 6),
    "addr:street": (55, 45, 35, 5),
    "addr:city": (45, 35, 25, 4),
    "addr:place": (45, 35, 25, 4),
}
LABEL_FIELD = (75, 60, 45, 6)


def poi_fields(tag) -> Column:
    """All fields that count, as an array: value (normalised for comparison), exact, prefix, holds, word."""
    scored = [(tag(k), w) for k, w in POI_FIELDS.items()] + [(address_label(tag), LABEL_FIELD)]
    names = ("exact", "prefix", "holds", "word")
    raw = F.array(*[F.struct(v.alias("v"), *[F.lit(x).alias(n) for n, x in zip(names, w, strict=True)]) for v, w in scored])
    return F.transform(raw, lambda f: F.struct(normalize_compare(f["v"]).alias("v"), *[f[n].alias(n) for n in names]))


def poi_score(fields: Column, query: Column, tokens: Column) -> Column:
    """fields: of poi_fields(); query: normalised; tokens: its words."""

    def of(f: Column) -> Column:
        found = F.size(F.filter(tokens, lambda t: F.contains(f["v"], t)))
        words = F.when(found == F.size(tokens), found * f["word"]).otherwise(f["word"])
        return F.when((f["v"] == "") | (query == ""), 0).when(f["v"] == query, f["exact"]).when(F.startswith(f["v"], query), f["prefix"]).when(F.contains(f["v"], query), f["holds"]).when(found > 0, words).otherwise(0)

    return F.aggregate(fields, F.lit(0), lambda total, f: total + of(f))


def is_complete(tag) -> Column:
    """Whether a place has a name and an address, which adds 3 to its score."""
    return ((tag("name") != "") | (tag("brand") != "")) & ((tag("addr:street") != "") | (tag("addr:city") != "") | (tag("addr:place") != ""))


def address_score(field, q: dict[str, Column]) -> Column:
    """field: normalised value of a tag; q: normalised street, housenumber, postcode, city and raw of the query."""
    same = lambda v, x: (x != "") & (v == x)
    holds = lambda v, x: (v != "") & (x != "") & F.contains(v, x)
    any_of = lambda test, keys, x: reduce(lambda a, b: a | b, [test(field(k), x) for k in keys])
    points = lambda *cases: reduce(lambda w, c: w.when(c[0], c[1]), cases[1:], F.when(cases[0][0], cases[0][1])).otherwise(0)
    raw, street = q["raw"], q["street"]
    firm, kinds = ("brand", "operator"), ("shop", "office", "amenity", "tourism", "leisure")
    score = reduce(lambda a, b: a + b, [
        points((same(field("addr:street"), street), 3)),
        points((same(field("addr:housenumber"), q["housenumber"]), 4)),
        points((same(field("addr:postcode"), q["postcode"]), 2)),
        points((any_of(same, ("addr:city", "addr:place"), q["city"]), 1)),
        points((same(field("name"), raw), 6), (holds(field("name"), raw), 3)),
        points((any_of(same, firm, raw), 4), (any_of(holds, firm, raw), 2)),
        points((any_of(same, kinds, raw), 3), (any_of(holds, kinds, raw), 1)),
        points((same(field("addr:street"), raw), 4), (holds(field("addr:street"), raw), 1)),
        points((any_of(same, ("addr:city", "addr:place"), raw), 3)),
        points((same(field("name"), street), 5), (holds(field("name"), street), 2)),
        points((any_of(same, firm, street), 3), (any_of(holds, firm, street), 1)),
        points((any_of(same, kinds[:3], street), 2), (any_of(holds, kinds[:3], street), 1)),
    ])
    return F.when((score == 0) & holds(field("addr:street"), street), 1).otherwise(score)


def parse_address(raw: Column) -> Column:
    """struct(street, housenumber, postcode, city, raw) guessed from free text; all parts empty for blank text."""
    text = trim(F.coalesce(raw, F.lit("")))
    words = F.filter(F.split(F.translate(text, ",;", "  "), r"\s+"), lambda w: w != "")
    is_code = lambda w: w.rlike("^[0-9]{5}$")
    codes = F.filter(words, is_code)
    code = F.coalesce(F.get(codes, F.size(codes) - 1), F.lit(""))
    number = F.coalesce(F.get(F.filter(words, lambda w: w.rlike("[0-9]") & ~is_code(w)), F.lit(0)), F.lit(""))
    at = F.array_position(words, F.coalesce(F.get(codes, F.lit(0)), F.lit("\0"))).cast("int")
    before = F.filter(F.when(at > 0, F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(words), lambda w: (number == "") | (w != number))
    after = F.when(at > 0, F.filter(F.slice(words, at, F.size(words)), lambda w: ~is_code(w))).otherwise(F.array().cast("array<string>"))
    comma = F.instr(text, ",")
    left, right = trim(F.substring_index(text, ",", 1)), trim(F.substr(text, comma + 1))
    split = (comma > 0) & ((left != "") | (right != ""))
    shorter = (F.size(after) == 0) & (F.size(before) > 1) & ((number != "") | (code != ""))
    street = F.array_join(F.when(shorter, F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0)))).otherwise(before), " ")
    return F.struct(
        F.when(split, left).otherwise(street).alias("street"),
        number.alias("housenumber"),
        code.alias("postcode"),
        F.when(split, right).otherwise(F.array_join(after, " ")).alias("city"),
        text.alias("raw"),
    )


# --- stations ---

# Words that name the kind of organisation, not the place.
STATION_WORDS = ("ff", "wf", "bf", "feuerwehr", "freiwillige")


def station_tokens(name: Column) -> Column:
    """Words of a station's name without administrative codes such as 2.1.3."""
    code = lambda w: w.rlike(r"[0-9.]") & ~w.rlike(r"\p{L}")
    return F.filter(F.split(trim(name), r"\s+"), lambda w: (w != "") & ~code(w))


def station_key(name: Column) -> Column:
    return F.array_join(F.filter(station_tokens(F.lower(name)), lambda w: ~w.isin(*STATION_WORDS)), " ")


def station_place(name: Column) -> Column:
    return F.array_join(F.filter(station_tokens(name), lambda w: ~F.lower(w).isin(*STATION_WORDS)), " ")

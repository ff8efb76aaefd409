"""Every registered query of single rules, sources and sinks against its SQL, on the smallest tables; spatial search
against brute force."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from geoweft.operators import nearest, pyramid, routing, territory
from geoweft.plans import queries, rules

SF = "/root/testdata/sf0.001"
NAMES = sorted(k for k, f in queries.QUERIES.items() if f.__module__ == rules.__name__ and k in queries.SQL)


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "events", "documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = tables.sql(queries.SQL[name])
    assert sorted(found.columns) == columns
    want = [tuple(norm(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, (tuple(norm(r[c]) for c in columns) for r in got.collect()))) == sorted(map(repr, want))


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("k,max_m", [(1, None), (4, None), (3, 300_000.0)])
def test_nearest_everywhere(spark, k, max_m):
    """Clusters, far away queries, the poles and both sides of the date line."""
    rng = random.Random(k)
    spots = [(rng.uniform(-80, 80), rng.uniform(-179, 179)) for _ in range(12)]
    points = [(i, *(c + rng.gauss(0, 0.01) for c in rng.choice(spots))) for i in range(400)] + [(400, 10.0, 179.99), (401, 10.0, -179.99), (402, 89.9, 3.0)]
    queries = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(40)] + [(90, 10.0, -179.999), (91, 89.99, -170.0), (92, None, 1.0)]
    queries += [(100 + i, points[i][1] + 1e-4, points[i][2]) for i in range(20)]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(queries, "qid long, lat double, lon double"), spark.createDataFrame(points, "id long, lat double, lon double"), k=k, max_m=max_m).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id))
    for q, lat, lon in queries:
        if lat is None:
            assert q not in got
            continue
        near = sorted((haversine((lat, lon), p[1:]), p[0]) for p in points)
        want = [i for d, i in near if max_m is None or d <= max_m][:k]
        assert [i for _, i in sorted(got.get(q, []))] == want


def test_polygons_of_many_edges(spark, monkeypatch):
    """Cells inside are taken whole, touched ones by their bands: the same as every point against every edge."""
    rng = random.Random(5)

    def star(lat, lon, n, size):
        out = [(lat + size * r * math.sin(2 * math.pi * i / n), lon + size * r * math.cos(2 * math.pi * i / n)) for i in range(n) if (r := rng.uniform(0.5, 1.0))]
        return [*out, out[0]]

    rows = [("l", f"t{i}", "", {}, [(star(48 + i % 3 * 0.5, 12 + i // 3 * 0.5, 150, 0.4), [star(48 + i % 3 * 0.5, 12 + i // 3 * 0.5, 40, 0.1)])]) for i in range(6)]
    edges = territory.edges_of(spark.createDataFrame(rows, f"layer string, territory_id string, name string, props map<string,string>, geometry {territory.GEOMETRY}"))
    vertex = [(1000 + i, *p) for i, p in enumerate(rows[0][4][0][0][:20])]
    points = spark.createDataFrame([(i, rng.uniform(47.4, 49.6), rng.uniform(11.4, 13.2)) for i in range(900)] + vertex, "id long, lat double, lon double")
    read = lambda df: sorted(map(tuple, df.collect()))
    found, near = read(territory.find_territories(points, edges)), read(territory.nearest_territory(points, edges).select("id", "territory_id", F.round("dist_m", 4)))
    monkeypatch.setattr(territory, "FEW_EDGES", 10**6)
    assert found == read(territory.find_territories(points, edges)) and len(found) > 300
    assert near == read(territory.nearest_territory(points, edges).select("id", "territory_id", F.round("dist_m", 4)))
    assert {t for i, t in found if i >= 1000} >= {"t0"}


def test_bounds_of_cells_hold(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        box = sorted(rng.uniform(-89, 89) for _ in range(2)) + sorted(rng.uniform(-180, 180) for _ in range(2))
        at = (rng.uniform(box[0], box[1]), rng.uniform(box[2], box[3]))
        rows.append((i, rng.uniform(-89, 89), rng.uniform(-180, 180), *box, *at))
    df = spark.createDataFrame(rows, "i int, lat double, lon double, min_lat double, max_lat double, min_lon double, max_lon double, y double, x double")
    least, most = pyramid.sphere_reach()
    for r in df.select("*", least.alias("least"), most.alias("most")).collect():
        assert r.least - 1e-3 <= haversine((r.lat, r.lon), (r.y, r.x)) <= r.most + 1e-3


def test_chains_of_routes(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 1, 1.0)], "src long, dst long, dist_m double").select("*", F.lit(50.0).alias("speed_kph"), F.lit(0.0).alias("max_height_m"), F.lit(0.0).alias("max_weight_t"), F.lit("").alias("hwy_type"))
    v = spark.createDataFrame([(i, 48 + i / 1000, 12.0) for i in range(1, 5)], "id long, lat double, lon double")
    stops = [(1, 0, 1), (1, 1, 3), (1, 2, 2), (2, 0, 2), (3, 0, 1), (3, 1, 4), (4, 0, 1), (4, 1, 1), (4, 2, 2)]
    got = {r.qid: (r.status, r.cost, r.path) for r in routing.route_chains(spark.createDataFrame(stops, "qid long, pos int, node long"), e, v).collect()}
    assert got == {1: ("ok", 4.0, [1, 2, 3, 1, 2]), 2: ("ok", 0.0, [2]), 3: ("no path", None, None), 4: ("ok", 1.0, [1, 2])}


@pytest.mark.parametrize("k", [1, 2])
def test_places_are_searched_once(spark, monkeypatch, k):
    """Many queries at one place meet its points once; with `by`, only points of their own value."""
    met, top = [], nearest._top

    def counted(pairs, *rest):
        met.append(pairs.count())
        return top(pairs, *rest)

    monkeypatch.setattr(nearest, "_top", counted)
    points = spark.createDataFrame([(i, 48 + i / 1000, 12.0, "ab"[i % 2]) for i in range(10)], "id long, lat double, lon double, sort string")
    near = spark.createDataFrame([(q, 48.0, 12.0, "b") for q in range(300)] + [(900, 50.0, 12.0, "a"), (901, None, 12.0, "a")], "qid long, lat double, lon double, sort string")
    got = nearest.nearest(near, points, k=k).collect()
    assert {(r.qid, r.rank, r.id) for r in got} == {(q, 1 + n, n) for q in range(300) for n in range(k)} | {(900, 1 + n, 9 - n) for n in range(k)}
    assert sum(met) <= 2 * 10
    got = nearest.nearest(near, points, k=k, by=("sort",)).collect()
    assert {(r.qid, r.sort, r.rank, r.id) for r in got} == {(q, "b", 1 + n, 1 + 2 * n) for q in range(300) for n in range(k)} | {(900, "a", 1 + n, 8 - 2 * n) for n in range(k)}
    places = points.select(F.lit(0).alias("kind_rank"), F.lit("node").alias("kind"), "id", "lat", "lon", F.lit("x").alias("label"))
    assert {(r.qid, r.id) for r in nearest.nearest_label(near, places).collect()} == {(q, 0) for q in range(300)}


def test_cells_of_far_queries_are_dealt(spark, monkeypatch):
    """Queries far from all points keep many cells in few bytes: these go to many tasks, and no task has most of them."""
    shares, top = [], nearest._top

    def counted(pairs, *rest):
        shares.append([r["n"] for r in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return top(pairs, *rest)

    monkeypatch.setattr(nearest, "_top", counted)
    points = spark.createDataFrame([(i, 48 + i // 4 / 1000, 12 + i % 4 / 1000) for i in range(1200)], "id long, lat double, lon double")
    far = spark.createDataFrame([(q, 48.0 + q / 200, 13.0) for q in range(60)], "qid long, lat double, lon double")
    assert nearest.nearest(far, points, k=2).count() == 120
    assert len(shares) == 2 and max(shares[1]) < sum(shares[1]) / 2


def test_trips_are_made_of_all_customers(spark, tmp_path):
    """The query's rows are those of its SQL; the last trip has the stops that are left."""
    spark.range(77).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(120).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size", "'LARGE' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in queries.trip_orders(spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        for name in ("customer", "part"):
            db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert got == sorted(db.execute(queries.SQL["trip_orders"]).fetchall())
    assert [r[2] for r in got] == [6] * 12 + [5]


def test_long_trips_are_made_of_all_customers(spark, tmp_path):
    """Each customer is a stop of one trip, also those beyond the first 240 and those left for the last trip."""
    spark.range(257).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(120).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size", "'LARGE' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(queries.trip_orders_long(spark, str(tmp_path)).collect())
    assert [(r.trip, r.status, len(r.order)) for r in got] == [(k, "ok", 20) for k in range(12)] + [(12, "ok", 17)]
    assert sorted(s for r in got for s in r.order) == [f"S{k:06d}" for k in range(257)]


def test_turn_aware_routes_pay_their_costs_without_paths(spark, tmp_path, monkeypatch):
    """What the tree of ways adds up to is what each path alone pays, in one cell and in many; the query asks for no paths."""
    from geoweft.functions import cost
    from geoweft.operators import graph

    spark.range(1, 2).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(160).selectExpr("id AS p_partkey", "CAST(id * 7 % 50 + 1 AS INT) AS p_size", "'LARGE' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    e, v = (x.cache() for x in queries.grid(spark, str(tmp_path)))
    opt = cost.RouteOptions(**queries.TURNING).settled()
    q = queries.requests(spark, str(tmp_path)).cache()
    at = {r.id: (r.lat, r.lon) for r in v.collect()}
    step = {(r.src, r.dst): r.s for r in e.withColumn("s", cost.edge_cost(F.col("dist_m"), F.col("speed_kph"), opt)).collect()}
    degree = {r.id: r.degree for r in graph.out_degrees(e).collect()}

    def bearing(a, b):
        (p, x), (r, y) = ([math.radians(c) for c in at[k]] for k in (a, b))
        return math.degrees(math.atan2(math.sin(y - x) * math.cos(r), math.cos(p) * math.sin(r) - math.sin(p) * math.cos(r) * math.cos(y - x)))

    def turn(a, b, c):
        diff = (bearing(b, c) - bearing(a, b) + 540) % 360 - 180
        return (5 if degree[b] > 2 else 0) + (30 if abs(diff) > 160 else 8 if diff < -30 else 0)

    want = {r.qid: sum(step[s] for s in zip(r.path, r.path[1:])) + sum(turn(*t) for t in zip(r.path, r.path[1:], r.path[2:])) for r in routing.route(q, e, v, opt).collect() if len(r.path) > 1}
    assert len(want) > 100
    for sizes in ({}, {"whole_arcs": 60, "cell_vertices": 40}):
        got = {r.qid: r.paid for r in routing.paid_costs(q, e, v, opt, **sizes).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    asked, found = [], routing.route_pairs
    monkeypatch.setattr(routing, "route_pairs", lambda *a, paths=True, **k: asked.append(paths) or found(*a, paths=paths, **k))
    rows = queries.route_turn_aware(spark, str(tmp_path)).collect()
    assert not any(asked) and len(rows) == len(at) and all(r.fits for r in rows)


def test_cells_hold_so_many_vertices_at_most(spark, monkeypatch):
    """Against the definition, with dense and lonely places and many vertices at one; squares that are full needn't be broadcast."""
    from geoweft.operators import overlay

    rng = random.Random(4)
    at = [(48 + rng.random() / 10, 12 + rng.random() / 10) for _ in range(300)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(10.0, 10.0)] * 12
    v = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "id long, lat double, lon double").cache()
    square = {(r.id, r.depth): r.square for r in v.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(overlay.DEPTH)))).withColumn("square", overlay._square(F.col("lat"), F.col("lon"), F.col("depth"))).collect()}
    held = {}
    for s in square.values():
        held[s] = held.get(s, 0) + 1
    want = {k: next(square[k, d] for d in range(overlay.DEPTH + 1) if held[square[k, d]] <= 8 or d == overlay.DEPTH) for k in range(len(at))}
    for most in (overlay.BROADCAST_SQUARES, 0):
        monkeypatch.setattr(overlay, "BROADCAST_SQUARES", most)
        assert {r.id: r.cell for r in overlay.cells_of(v, 8).collect()} == want
    assert {r.id: r.cell for r in overlay.cells_of(v, 1000).collect()} == {k: square[k, 0] for k in range(len(at))}

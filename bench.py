"""One JSON line with the seconds that headline queries take. BENCH_SF_DIR, BENCH_CPUS; each query runs once to warm up
and is then timed, its rows counted by a sink that reads every column. Batches of routes, which take their time in the
searches, warm up on a tenth of their requests."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from geoweft.functions.cost import RouteOptions  # noqa: E402
from geoweft.operators import poi, routing, search  # noqa: E402
from geoweft.plans import queries as plans  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
EDGE_DEFAULTS = {"speed_kph": 50.0, "max_height_m": 0.0, "max_weight_t": 0.0, "hwy_type": "residential"}


def lattice(spark: SparkSession, side: int) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of a side x side grid, both ways, 50 km/h."""
    v = spark.range(1, side * side + 1).select("id", (48 + 0.001 * F.floor((F.col("id") - 1) / side)).alias("lat"), (12 + 0.001 * ((F.col("id") - 1) % side)).alias("lon"))
    steps = v.select(F.col("id").alias("src"), F.explode(F.array(*[F.struct(ok.alias("ok"), (F.col("id") + by).alias("dst"), F.lit(m).alias("dist_m")) for ok, by, m in ((F.col("id") % side != 0, 1, 74.4), (F.col("id") % side != 1, -1, 74.4), (F.col("id") <= side * (side - 1), side, 111.2), (F.col("id") > side, -side, 111.2))])).alias("e")).filter("e.ok")
    return steps.select("src", "e.dst", "e.dist_m", *[F.lit(x).alias(c) for c, x in EDGE_DEFAULTS.items()]), v


def routes(spark: SparkSession, side: int, n: int, **opt) -> DataFrame:
    """n routes from the first row to the last row of a grid."""
    e, v = lattice(spark, side)
    r = spark.range(n).select(F.col("id").alias("qid"), (F.col("id") % side + 1).alias("from_id"), (F.lit(side * side) - F.floor(F.col("id") / side) * 37 - F.col("id") * 7 % side).alias("to_id"))
    return routing.route(r, e, v, RouteOptions(objective="duration", **opt))


def maneuver_names(spark: SparkSession, sf: str) -> DataFrame:
    """Instructions along 250 paths of 400 nodes, with 10,000 other streets."""
    e, v = lattice(spark, 400)
    at = spark.range(250 * 400).select((F.col("id") / 400).cast("long").alias("qid"), (F.col("id") % 400).alias("pos"), (F.col("id") + 1).alias("node"))
    names = spark.range(10_000).select((F.col("id") * 13 % 160_000 + 1).alias("node"), F.concat(F.lit("Street "), (F.col("id") % 1000).cast("string")).alias("name"))
    return routing.maneuvers(at.join(v.withColumnRenamed("id", "node"), "node"), e, names)


def address_search(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 different top-10 searches over 50,000 addresses."""
    name = F.when(F.col("id").isin(17, 12345, 36789), "Hauptstraße").otherwise(F.concat(F.lit("Nebenstraße "), "id"))
    a = spark.range(50_000).select("id", F.col("id").alias("seq"), F.lit(48.0).alias("lat"), F.lit(12.0).alias("lon"), F.create_map(F.lit("addr:street"), name, F.lit("addr:city"), F.lit("Musterstadt")).alias("tags"))
    q = spark.range(1000).select(F.col("id").alias("qid"), F.when(F.col("id") == 0, "Hauptstraße, Musterstadt").when(F.col("id") % 2 == 0, F.concat(F.lit("Hauptstraße "), "id")).otherwise(F.concat(F.lit("Nebenstraße "), F.col("id") * 49)).alias("raw"))
    return search.search_addresses(a.repartition(32), q, 10)


def street_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of one window among 50,000 streets."""
    v = spark.range(50_000).select("id", (48 + 0.004 * F.floor(F.col("id") / 250)).alias("lat"), (11 + 0.004 * (F.col("id") % 250)).alias("lon"))
    s = v.select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("Street "), "id").alias("display"), F.array("id").alias("node_ids"))
    return poi.street_labels(s, v, (48.2, 48.24, 11.2, 11.24), 32)


HEADLINE = {k: plans.QUERIES[k] for k in ("assign_unassigned", "assign_nearest", "manifest_counts", "build_edges", "street_dictionary", "nearest_node", "territory_events", "poi_search", "route_distances")} | {
    "address_search_50k": address_search,
    "street_labels_50k": street_labels,
    "maneuver_names": maneuver_names,
}
#: Batches of routes on grids: side, requests, options.
ROUTES = {
    "route_astar_1000": (200, 1000, {"engine": "astar"}),
    "route_turn_state_200": (200, 200, {"engine": "dijkstra", "left_turn": 5.0, "crossing": 2.0}),
    "route_node_1000": (200, 1000, {"engine": "dijkstra-node"}),
    "route_node_600": (600, 100, {"engine": "dijkstra-node"}),
}


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def run(name: str, f) -> None:
        began = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    for name, f in HEADLINE.items():
        for _ in range(2):
            run(name, lambda f=f: f(spark, SF))
    for name, (side, n, opt) in ROUTES.items():
        for some in (n // 10, n):
            run(name, lambda side=side, some=some, opt=opt: routes(spark, side, some, **opt))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

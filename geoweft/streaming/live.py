"""Streams: positions that enter and leave territories, and the last messages of sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geoweft.functions import geo
from geoweft.operators import territory

EVENTS = "vehicle string, territory_id string, event string, ts timestamp"
_STATE = "territory_id string"


def locate(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """positions (vehicle, ts, lat, lon) with the least territory that holds them; no state, so batch or stream.

    Polygons are few and static; a stream can't be aggregated per point, so every ring edge is part of one expression
    over an array of the polygon's edges.
    """
    e = F.struct("lat1", "lon1", "lat2", "lon2")
    shapes = edges.groupBy("territory_id", "poly").agg(F.collect_list(e).alias("e")).groupBy().agg(F.array_sort(F.collect_list(F.struct("territory_id", "poly", "e"))).alias("shapes"))
    at = lambda x: (F.col("lat"), F.col("lon"), x["lat1"], x["lon1"], x["lat2"], x["lon2"])
    inside = lambda s: F.exists(s["e"], lambda x: geo.on_segment(*at(x))) | (F.size(F.filter(s["e"], lambda x: geo.crosses(*at(x)))) % 2 == 1)
    placed = positions.crossJoin(F.broadcast(shapes))  # one row
    return placed.withColumn("territory_id", F.get(F.filter("shapes", inside), F.lit(0))["territory_id"]).drop("shapes")


def geofence(positions: DataFrame, territories: DataFrame) -> DataFrame:
    """EVENTS: enter and leave, of a stream of positions (vehicle, ts, lat, lon). Within a batch rows go by time."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("ts").itertuples():
            here = r.territory_id if isinstance(r.territory_id, str) else None
            if here != held:
                out += [(key[0], held, "leave", r.ts)] * (held is not None) + [(key[0], here, "enter", r.ts)] * (here is not None)
                held = here
        state.update((held,))
        yield pd.DataFrame(out, columns=["vehicle", "territory_id", "event", "ts"])

    located = locate(positions, territory.edges_of(territories)).select("vehicle", "ts", "territory_id")
    return located.groupBy("vehicle").applyInPandasWithState(step, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def session_log(messages: DataFrame, keep: int = 40) -> DataFrame:
    """session, log (the last `keep` texts) after each batch of a stream of messages (session, ts, text)."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        log = (log + pd.concat(list(batches)).sort_values("ts").text.tolist())[-keep:]
        state.update((log,))
        yield pd.DataFrame({"session": [key[0]], "log": [log]})

    return messages.select("session", "ts", "text").groupBy("session").applyInPandasWithState(step, "session string, log array<string>", "log array<string>", "update", GroupStateTimeout.NoTimeout)

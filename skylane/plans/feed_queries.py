"""Queries of the change feed: the live tables at every tick of the replay, against a fold over all ticks in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylane.operators import change_feed, trajectories

from . import demo
from .queries import P, query

#: A tick an hour, and samples that hold for six of them and half a minute.
TICK_S, WINDOW_S, GRACE_S = 3600, 6 * 3600, 30

#: Every tick, the snapshot of each by its definition, and flights that the one before had.
_FOLD = """b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
tick AS (SELECT n, least(lo + to_hours(CAST(n AS INT)), hi) AS tick FROM b, unnest(range(0, CAST(ceil((epoch_us(hi) - epoch_us(lo)) / 3600000000.0) AS BIGINT) + 1)) u(n)),
snap AS (SELECT n, flight_id, event_id FROM (SELECT n, flight_id, event_id, row_number() OVER (PARTITION BY n, flight_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM tick JOIN pos ON ts <= tick AND epoch_us(ts) > epoch_us(tick) - 21630000000) WHERE rn = 1),
feed AS (SELECT coalesce(s.n, p.n + 1) AS n, coalesce(s.flight_id, p.flight_id) AS flight_id, coalesce(s.event_id, p.event_id) AS event_id,
  CASE WHEN s.n IS NULL THEN 'gone' WHEN p.n IS NULL THEN 'seen' ELSE 'moved' END AS change
  FROM snap s FULL JOIN snap p ON p.n + 1 = s.n AND p.flight_id = s.flight_id
  WHERE s.event_id IS DISTINCT FROM p.event_id AND coalesce(s.n, p.n + 1) <= (SELECT max(n) FROM tick))"""


def _samples(spark, sf) -> DataFrame:
    return demo.positions(spark, sf).withColumnRenamed("ts", "sample_time").select("flight_id", "sample_time", "event_id", "lat", "lon", "flight_level")


def _versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Versions, and the dataset's bounds."""
    rows = _samples(spark, sf)
    bounds = trajectories.dataset_bounds(rows)
    return change_feed.position_versions(rows, bounds, TICK_S, WINDOW_S, GRACE_S, order=("sample_time", "event_id")), bounds


@query("SELECT n, flight_id, event_id, change FROM feed", P, _FOLD)
def k2_k4_change_feed(spark, sf):
    versions, bounds = _versions(spark, sf)
    return change_feed.changes(versions, bounds, TICK_S).select("n", "flight_id", "event_id", "change")


@query("SELECT flight_id, event_id, min(n) AS n_from, max(n) + 1 AS n_to FROM snap GROUP BY flight_id, event_id", P, _FOLD)
def k3_position_versions(spark, sf):
    versions, _ = _versions(spark, sf)
    return versions.select("flight_id", "event_id", "n_from", "n_to")


#: The tick of the table below.
AT = 360


@query(f"SELECT flight_id, arg_max(event_id, n) AS event_id, max(n) = {AT} AS active FROM snap WHERE n <= {AT} GROUP BY flight_id", P, _FOLD)
def k2_flights_at_tick(spark, sf):
    versions, _ = _versions(spark, sf)
    return change_feed.flights_at(versions, AT, ("event_id",))


@query("""SELECT id, min(f.n) AS archived_n FROM (SELECT *, CAST(ceil((epoch_us(detected_at) - epoch_us(lo)) / 3600000000.0) AS BIGINT) AS at FROM ev, b) e
  LEFT JOIN feed f ON e.active AND f.change = 'gone' AND f.n >= e.at AND f.flight_id IN (e.flight_id_1, e.flight_id_2) GROUP BY id""", P, demo.EVENTS_SQL, _FOLD)  # fmt: skip
def k5_archived_at(spark, sf):
    versions, bounds = _versions(spark, sf)
    feed = change_feed.changes(versions, bounds, TICK_S)
    return change_feed.archived_at(demo.conflict_events(spark, sf), feed, bounds, TICK_S).select("id", F.col("archived_n"))

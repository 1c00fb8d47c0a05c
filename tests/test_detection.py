"""The whole detection against plain Python over every candidate pair: moved flights, pairs with two plans, one or none."""

import random
from datetime import datetime, timedelta

import pytest
from plain_detection import conflicts
from pyspark.sql import functions as F

from skylane.operators import blocking
from skylane.plans import demo, detection

SMALL = "/root/testdata/sf0.001"
STATE = "flight_id string, lat double, lon double, flight_level int, ground_speed_kt int, track_heading double, vertical_rate_fpm int, ts timestamp, route string"
PLAN = "flight_id string, idx int, ident string, lat double, lon double, tas int, level int"


def flat(c):
    places = (c.entry_1, c.exit_1, c.entry_2, c.exit_2, c.middle)
    return (c.horizontal_nm, c.vertical_nm, c.entry_h, c.exit_h, c.cpa_h, *[x for p in places for x in (p.lat, p.lon, p.level)])


def compare(rows, plans, pairs):
    """Numbers of conflicts by how many flights of their pair have a route, all of them equal to plain Python's."""
    flights = {r.flight_id: {"flight_id": r.flight_id, "lat": r.lat, "lon": r.lon, "level": r.flight_level or 0, "knots": r.ground_speed_kt, "track": r.track_heading, "fpm": float(r.vertical_rate_fpm or 0), "ts": r.ts, "route": r.route} for r in rows.collect()}
    ways = {}
    for r in plans.orderBy("idx").collect():
        ways.setdefault(r.flight_id, []).append((r.lat, r.lon, r.tas, r.level))
    want, seen = {}, {0: 0, 1: 0, 2: 0}
    for p in pairs.collect():
        f, g = flights[p.flight_id_1], flights[p.flight_id_2]
        found = sorted(conflicts(f, g, ways))
        if found:
            want[p.flight_id_1, p.flight_id_2] = found
            seen[(f["route"] is not None) + (g["route"] is not None)] += len(found)
    got = {}
    for r in detection.detect(pairs, rows, plans).collect():
        got.setdefault((r.flight_id_1, r.flight_id_2), []).append(flat(r.conflict))
    assert got.keys() == want.keys()
    for key, found in want.items():
        assert sorted(got[key]) == [pytest.approx(x, rel=1e-6, abs=1e-6) for x in found], key
    return seen


def test_traffic_of_the_query(spark):
    rows = demo.traffic(spark, SMALL).withColumn("route", F.when(F.col("user_id") % 2 == 0, F.lit("filed")))
    seen = compare(rows, demo.traffic_plans(spark, SMALL), blocking.candidate_pairs(rows, 0.25, mode="sphere"))
    assert sum(seen.values()) > 0


def test_random_traffic(spark):
    """Flights that climb, sink and stand still, plans of no, one and several waypoints with repeated ones, times on both sides of the bound."""
    rng, at = random.Random(17), datetime(2024, 1, 1)
    rows, plans = [], []
    for i in range(180):
        lat, lon, level = rng.uniform(49, 50), rng.uniform(14, 15.5), rng.choice((300, 305, 310))
        rows.append((f"F{i:03d}", lat, lon, level, rng.choice((0, 280, 350, 420, 480)) if i % 20 == 0 else rng.randint(280, 480), rng.uniform(0, 360), rng.choice((0, 0, 0, 50, 900, -1500)), at + timedelta(seconds=rng.choice((0, 9, 10, 11, 40, 120))), rng.choice((None, "filed", "filed", "filed")) if i % 30 else ""))
        for k in range(rng.choice((0, 1, 2, 4, 6)) if rows[-1][-1] else 0):
            way = plans[-1][3:5] if k and rng.random() < 0.1 else (lat + rng.uniform(-0.6, 0.6), lon + rng.uniform(-0.9, 0.9))
            plans.append((f"F{i:03d}", k, f"P{k}", *way, rng.choice((0, 20)) + 300, level + (rng.choice((10, -20)) if i % 4 == 0 else 0)))
    states = spark.createDataFrame(rows, STATE)
    every = states.alias("a").join(states.alias("b"), F.col("a.flight_id") < F.col("b.flight_id")).select(F.col("a.flight_id").alias("flight_id_1"), F.col("b.flight_id").alias("flight_id_2"))
    seen = compare(states, spark.createDataFrame(plans, PLAN), every)
    assert sum(seen.values()) > 200 and min(seen.values()) > 20

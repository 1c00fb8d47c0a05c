"""Blocking against all pairs, exact rounding, query windows, resets, headers and graphs of airways."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skylane.functions import geo
from skylane.operators import blocking, routes, snapshots
from skylane.sources import navdata, positions


@pytest.mark.parametrize("mode", ["sphere", "spheroid"])
@pytest.mark.parametrize("span", [(40, 60, -180, 180), (-5, 5, 170, 190), (80, 90, -180, 180)])
def test_blocking_against_all_pairs(spark, mode, span):
    rng = random.Random(3)
    at = datetime(2024, 1, 1)
    rows = [(f"F{i}", at + timedelta(seconds=rng.randint(0, 1200)), rng.uniform(*span[:2]), (rng.uniform(*span[2:]) + 180) % 360 - 180, rng.randint(200, 500)) for i in range(150)]
    df = spark.createDataFrame(rows, "flight_id string, ts timestamp, lat double, lon double, ground_speed_kt int")
    got = {(r.flight_id_1, r.flight_id_2): r.distance_nm for r in blocking.candidate_pairs(df, 0.25, 300, mode).collect()}
    a, b = (df.select(*[F.col(c).alias(f"{c}_{i}") for c in df.columns]) for i in (1, 2))
    at = [F.col(c) for c in ("lat_1", "lon_1", "lat_2", "lon_2")]
    nm = geo.geodesic_m(*at) / 1852 if mode == "spheroid" else geo.haversine_nm(*at)
    skew = F.abs(F.unix_micros("ts_1") - F.unix_micros("ts_2"))
    all_ = a.join(b, (F.col("flight_id_1") < F.col("flight_id_2")) & (skew < 300_000_000)).withColumn("nm", nm)
    want = {(r.flight_id_1, r.flight_id_2): r.nm for r in all_.filter(F.col("nm") / (F.col("ground_speed_kt_1") + F.col("ground_speed_kt_2")) <= 0.25).collect()}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_grid_rounds_by_the_exact_value(spark):
    values = [45.25, 45.75, 45.15, 45.05, 45.35, -45.25, 0.05, 0.15, 0.25, -0.05, 1e-9, 89.95, *[i / 1000 for i in range(44000, 46000, 7)], *[i / 20 for i in range(-400, 400)]]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", geo.grid(F.col("x")).alias("g")).collect()
    assert all(r.g == round(r.x, 1) for r in rows)


def test_windows_resets_and_stamps(spark):
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    navdata.check_window(now, now, now)
    navdata.check_window(now + timedelta(seconds=60), now + timedelta(hours=1), now)
    for start, end in ((now, now - timedelta(seconds=1)), (now + timedelta(seconds=61), now + timedelta(hours=1))):
        with pytest.raises(ValueError):
            navdata.check_window(start, end, now)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "flight_id string, n int")
    assert [t.count() for t in snapshots.reset(rows, rows)] == [0, 0]
    assert navdata.stamped(rows, now).select("sample_time").distinct().count() == 1


def test_each_file_of_a_folder_needs_the_header(spark, tmp_path):
    line = "2026-03-21T16:04:03Z,2026-03-21T16:02:14Z,X,S22T,LKLT,LKTB,49.3,16.0,68,A"
    for name, header in (("a.csv", ",".join(positions.HEADER)), ("b.csv", ",".join(("wrong", *positions.HEADER[1:])))):
        (tmp_path / name).write_text(f"{header}\n{line}\n")
    with pytest.raises(Exception, match="(?i)header"):
        positions.read_positions(spark, str(tmp_path)).collect()


def test_paths_of_random_airways_are_shortest(spark):
    rng = random.Random(5)
    edges = [(i, f"L{i % 6}", f"W{rng.randint(0, 9)}", f"W{rng.randint(0, 9)}") for i in range(120)]
    edges = [e for e in edges if e[2] != e[3]]
    asked = [(f"L{k}", f"W{a}", f"W{b}") for k in range(6) for a in range(10) for b in range(10) if a != b]
    found = routes.airway_paths(spark.createDataFrame(asked, "airway_id string, start string, end string"), spark.createDataFrame(edges, "id int, airway_id string, start_waypoint string, end_waypoint string")).collect()
    paths = {}
    for r in sorted(found, key=lambda r: r.pos):
        paths.setdefault((r.airway_id, r.start, r.end), []).append(r.ident)
    for (name, start, end), path in paths.items():
        near = {frozenset(e[2:]) for e in edges if e[1] == name}
        assert path[0] == start and path[-1] == end and len(set(path)) == len(path)
        assert all(frozenset(x) in near for x in zip(path, path[1:], strict=False))
    for name, start, end in asked:
        touching = [e for e in edges if e[1] == name and start in e[2:]]
        if not 1 <= len(touching) <= 2:
            assert (name, start, end) not in paths


def test_frontier_search_equals_a_queue(spark):
    """All requests at once against one search each: parallel edges, loops away from the start, unreachable ends, one airway with most requests."""
    rng = random.Random(11)
    edges = [(i, f"L{min(k, 9)}", f"W{rng.randint(0, 5 + k)}", f"W{rng.randint(0, 5 + k)}") for i, k in enumerate(rng.choices(range(14), k=150))]
    chain = [(1000 + i, "HOT", f"P{i:02d}", f"P{i + 1:02d}") for i in range(25)] + [(2000, "HOT", "P03", "P20")]
    asked = [(f"L{k}", f"W{a}", f"W{b}") for k in range(10) for a in range(12) for b in range(12)] + [("HOT", f"P{a:02d}", f"P{b:02d}") for a in range(26) for b in range(26)] + [("none", "A", "B"), (None, "A", "B")]
    schema = "airway_id string, start string, end string"
    found = routes.airway_paths(spark.createDataFrame(asked + asked[:50], schema), spark.createDataFrame(edges + chain, "id int, airway_id string, start_waypoint string, end_waypoint string")).collect()
    paths = {}
    for r in sorted(found, key=lambda r: r.pos):
        paths.setdefault((r.airway_id, r.start, r.end), []).append(r.ident)
    for name, start, end in asked:
        own = [(i, a, b) for i, of, a, b in edges + chain if of == name]
        if not any(a == b == start for _, a, b in own):
            assert paths.get((name, start, end), []) == routes.airway_path(own, start, end)

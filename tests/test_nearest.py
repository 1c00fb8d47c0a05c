"""Nearest points by nested cells against every point of the name."""

import random

import pytest
from pyspark.sql import functions as F

from skylane.functions import geo
from skylane.operators import navpoints

POINT = "id int, identificator string, lat double, lon double"
ASKED = "k int, ident string, lat double, lon double"


def around(rng, lat, lon, spread):
    return max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), (lon + rng.uniform(-spread, spread) + 180) % 360 - 180


def world(seed):
    """Points and asked rows in dense spots, near the date line and the poles, far from any point, repeated, and without a position."""
    rng = random.Random(seed)
    spots = [(50, 14, 0.02), (50, 14, 3), (0, 179.99, 0.5), (89.9, 0, 5), (-89, 120, 40), (10, -60, 60)]
    points = [(i, f"N{rng.choice((0, 0, 0, 1, 2, 3))}", *around(rng, *rng.choice(spots))) for i in range(500)]
    points += [(1000 + i, p[1], p[2], p[3]) for i, p in enumerate(points[:60])] + [(2000 + i, f"N{i % 5}", None, 14.0) for i in range(6)] + [(3000, "LONE", -40.0, -170.0), (3001, None, 1.0, 1.0), (3002, "N1", float("nan"), 2.0)]
    asked = [(i, f"N{rng.randint(0, 5)}", *around(rng, *rng.choice(spots))) for i in range(300)]
    asked += [(1000 + i, "N0", p[2], p[3]) for i, p in enumerate(points[:40])] + [(2000, "N1", None, 3.0), (2001, "N1", None, None), (2002, None, 1.0, 1.0), (2003, "LONE", 40.0, 10.0), (2004, "N4", 50.0, 14.0), (2005, "N2", float("nan"), 14.0)]
    asked += [(3000, "N0", 50.0, 14.0), (3000, "N0", 0.0, 179.0), (3001, "N1", 50.0, 14.0), (3001, "N1", 50.0, 14.0)]
    return points, asked


@pytest.mark.parametrize("mode", ["sphere", "spheroid"])
def test_cells_equal_all_namesakes(spark, mode):
    points, asked = (spark.createDataFrame(rows, schema) for rows, schema in zip(world(3), (POINT, ASKED), strict=True))
    far = geo.geodesic_m if mode == "spheroid" else lambda *x: geo.haversine_km(*x) * 1000
    whole = lambda c: F.when(~F.isnan(c), F.col(c))
    pairs = asked.join(points.select(F.col("identificator").alias("ident"), "id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "ident")
    pairs = pairs.withColumn("m", far(whole("lat"), whole("lon"), whole("p_lat"), whole("p_lon")))
    want = {}
    for r in pairs.collect():
        order = (r.m is None, r.m or 0.0, r.id)
        want[r.k] = min(want.get(r.k, order), order)
    got = {r.k: r for r in navpoints.nearest_by_name(asked, points, ["k"], mode=mode).collect()}
    assert got.keys() == want.keys() and len(got) > 250
    for k, (none, m, id_) in want.items():
        assert got[k].point_id == id_ and (got[k].distance_m is None) == none and (none or got[k].distance_m == pytest.approx(m, abs=1e-6)), k


def test_either_kind(spark):
    rows, asked = world(4)
    kinds = [spark.createDataFrame(rows[i::2], POINT) for i in (0, 1)]
    asked = spark.createDataFrame([a for a in asked if a[2] == a[2]], ASKED)
    want = {}
    for src, points in zip(("fix", "nav"), kinds, strict=True):
        far = F.when(~F.isnan("p_lat") | F.col("p_lat").isNull(), geo.geodesic_m(*[F.col(c) for c in ("lat", "lon", "p_lat", "p_lon")]))
        for r in asked.join(points.select(F.col("identificator").alias("ident"), "id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "ident").withColumn("m", far).collect():
            order = (r.p_lat is None, r.m is None, r.m or 0.0, src, r.id)
            want[r.k] = min(want.get(r.k, order), order)
    got = {r.k: (r.src, r.point_id) for r in navpoints.nearest_of_either(asked, *kinds, ["k"]).collect()}
    assert got == {k: x[3:] for k, x in want.items()}


def test_few_namesakes_are_measured(spark):
    """A name that all points and rows share: each row measures few of them."""
    rng = random.Random(5)
    points = spark.createDataFrame([("HOT", i, rng.uniform(44, 53), rng.uniform(4, 21)) for i in range(4000)], "ident string, id int, p_lat double, p_lon double").withColumn("p", F.struct("id"))
    asked = spark.createDataFrame([(i, "HOT", rng.uniform(45, 52), rng.uniform(5, 20)) for i in range(1000)], ASKED)
    found = navpoints.nearest_points(asked, points, ["k"], "ident").agg(F.count("best"), F.avg("measured"), F.max("measured")).first()
    assert found[0] == 1000 and found[1] < 100 and found[2] < 4000


def test_empty_tables(spark):
    points, asked = (spark.createDataFrame(rows[:5], schema) for rows, schema in zip(world(6), (POINT, ASKED), strict=True))
    assert navpoints.nearest_by_name(asked.limit(0), points, ["k"]).count() == 0
    assert navpoints.nearest_by_name(asked, points.limit(0), ["k"]).count() == 0


def test_navaids_are_looked_up_only_without_a_fix(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "A", 50.0, 14.0), (2, "B", 50.0, 14.0), (3, "C", 50.0, 14.0)], ASKED)
    fixes = spark.createDataFrame([(1, "A", 50.0, 14.1), (2, "C", None, None)], POINT)
    navs = spark.createDataFrame([(1, "A", 50.0, 14.0), (2, "B", 50.0, 14.2), (3, "C", 50.0, 14.3)], POINT)
    near, looked_up = navpoints.nearest_by_name, []

    def counted(rows, *args):
        looked_up.append(rows.count())
        return near(rows, *args)

    monkeypatch.setattr(navpoints, "nearest_by_name", counted)
    found = {r.k: tuple(r.point) for r in navpoints.resolve_points(asked, fixes, navs, ["k"]).collect()}
    assert found == {1: (50.0, 14.1), 2: (50.0, 14.2), 3: (50.0, 14.3)} and looked_up == [0, 0, 3, 2]

"""Golden values and small scenarios of the flight operators."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skylane.functions import geo, parsing
from skylane.operators import conflicts, events, motion, navpoints, routes, trajectories

T0 = datetime(2026, 3, 21, 16)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def L(x):  # noqa: N802
    return F.lit(x)


def test_distances(spark):
    r = one(spark, far=geo.haversine_km(L(0.0), L(0.0), L(5.0), L(5.0)), one=geo.haversine_km(L(0.0), L(0.0), L(0.0), L(1.0)), same=geo.geodesic_m(L(50.0), L(14.0), L(50.0), L(14.0)), east=geo.bearing(L(0.0), L(0.0), L(0.0), L(1.0)))
    assert abs(r.far - 785) < 1 and abs(r.one - 111.2) < 1.1 and r.same == 0 and r.east == 90


@pytest.mark.parametrize(("level", "fpm", "planned", "hours", "want"), [(300, 1000, 350, 0.01, 306), (300, 1000, 350, 0.2, 350), (350, -1000, 300, 0.01, 344), (350, -1000, 300, 0.2, 300), (300, -500, 350, 0.1, 270), (350, 500, 300, 0.1, 380), (300, 50, 350, 1.0, 300)])
def test_projected_level(spark, level, fpm, planned, hours, want):
    assert one(spark, x=geo.projected_level(L(level), L(fpm), L(planned), L(hours))).x == want


@pytest.mark.parametrize(("token", "want"), [("N0459F340", (459, 340)), ("M078F350", (452, 350)), ("K0500F100", (269, 100)), ("N0450S1110", (450, 364)), ("DENUT", None)])
def test_speed_level(spark, token, want):
    got = one(spark, x=parsing.speed_level(L(token))).x
    assert (tuple(got) if got else None) == want


def test_literals(spark):
    r = one(spark, a=parsing.coordinate(L("5230N02030E")), b=parsing.coordinate(L("52S020W")), c=parsing.pbd_position(L("PSA090060"), L(50.0), L(0.0)), d=parsing.duration_s(L("10m")), e=parsing.duration_s(L("0")))
    assert tuple(r.a) == (52.5, 20.5) and tuple(r.b) == (-52.0, -20.0) and r.c.lat == pytest.approx(50) and r.c.lon > 1.5 and r.d == 600 and r.e is None


def parsed(spark, text):
    return routes.parse_routes(spark.createDataFrame([(text,)], "route string")).first().parsed


def test_routes(spark):
    p = parsed(spark, "N0450F310 DENUT L610 LAM")
    assert tuple(p.config) == (450, 310) and [(s.ident, s.via) for s in p.segments] == [("DENUT", "L610"), ("LAM", None)] and p.valid
    p = parsed(spark, "OKL1A DENUT L610 LAM BALTU1K")
    assert (p.departure, p.arrival) == ("OKL1A", "BALTU1K") and [(s.ident, s.via) for s in p.segments] == [("DENUT", "L610"), ("LAM", None)]
    assert [s.ident for s in parsed(spark, "DCT VLM").segments] == ["VLM"]
    assert [(s.ident, s.via) for s in parsed(spark, "N0447F380 DCT AMULU DCT KETEL").segments] == [("AMULU", "DCT"), ("KETEL", None)]
    assert [(s.ident, s.tas, s.level) for s in parsed(spark, "DENUT DCT LAM/N0400F200").segments] == [("DENUT", None, None), ("LAM", 400, 200)]
    assert not parsed(spark, "???").valid and not parsed(spark, None).valid


@pytest.mark.parametrize("text,departure,segments,arrival", [
    ("N0450F350 OKL1A BALTU L610 LAM LAM3A", "OKL1A", "BALTU>L610 LAM", "LAM3A"),
    ("ANTAR UN133 PEREN DCT ABCD", None, "ANTAR>UN133 PEREN>DCT ABCD", None),
    ("PEREN UL863 EVIVI", None, "PEREN>UL863 EVIVI", None),
    ("N0447F380 DCT AMULU DCT KETEL DCT ROGMI T108 LANDU LANDU2A", None, "AMULU>DCT KETEL>DCT ROGMI>T108 LANDU", "LANDU2A"),
    ("L610 LAM", None, "L610 LAM", None),  # what could be an airway is a waypoint where no connection can stand
    ("LAM L610", None, "LAM L610", None),
    ("LAM DCT", None, "LAM>DCT", None),
    ("LAM DCT BALTU1K", None, "LAM>DCT", "BALTU1K"),
    ("OKL1A", None, "OKL1A", None),
    ("OKL1A OKL1A", "OKL1A", "OKL1A", None),
    ("OKL1A OKL1A OKL1A", "OKL1A", "OKL1A", "OKL1A"),
    ("52N020E DCT PSA030029 DCT 5230N02030E", None, "52N020E>DCT PSA030029>DCT 5230N02030E", None),
])
def test_ambiguous_routes(spark, text, departure, segments, arrival):
    p = parsed(spark, text)
    assert p.valid and p.reason is None
    assert (p.departure, " ".join(s.ident + (f">{s.via}" if s.via else "") for s in p.segments), p.arrival) == (departure, segments, arrival)


@pytest.mark.parametrize("text,reason", [("???", "???"), ("DENUT ??? LAM", "???"), ("", "empty"), (None, "empty"), ("N0450F310", "empty"), ("DENUT DCT LAM/N04", "LAM/N04"), ("BALTU1K", "no waypoint"), ("DENUT DCT DCT LAM", "DCT"), ("denut", "denut")])
def test_rejected_routes(spark, text, reason):
    rows = routes.parse_routes(spark.createDataFrame([(1, text), (2, "LAM")], "id int, route string"))
    assert [tuple(r) for r in routes.rejected_routes(rows).collect()] == [(1, text, reason)]


CHAIN = [(1, "A", "B"), (2, "B", "C"), (3, "C", "D")]


@pytest.mark.parametrize(("edges", "start", "end", "want"), [(CHAIN, "A", "D", "ABCD"), (CHAIN, "A", "Z", ""), ([(1, "A", "B"), (2, "B", "D"), (3, "B", "E")], "A", "D", "ABD"), (CHAIN, "B", "A", "BA"), (CHAIN, "B", "D", "BCD"), ([*CHAIN, (4, "B", "X")], "B", "D", "")])
def test_airway_path(edges, start, end, want):
    assert "".join(routes.airway_path(edges, start, end)) == want


def samples(spark, *rows):
    return spark.createDataFrame([("F1", T0 + timedelta(minutes=i), T0 + timedelta(minutes=m), *p) for i, (m, *p) in enumerate(rows)], "flight_id string, sample_time timestamp, time_over timestamp, lat double, lon double, flight_level int")


def test_kinematics(spark):
    rows = trajectories.with_kinematics(samples(spark, (0, 50.0, 14.0, 100), (1, 50.01, 14.01, 100), (1, 50.02, 14.02, 100), (3, None, None, None))).orderBy("sample_time").collect()
    assert rows[0].ground_speed_kt is None and rows[1].ground_speed_kt > 0
    assert rows[2].ground_speed_kt == rows[1].ground_speed_kt and rows[3].ground_speed_kt == rows[1].ground_speed_kt
    assert rows[3].lat == 50.02 and rows[3].imputed


def test_partial_rows_before_the_first_complete_one_are_not_carried(spark):
    rows = trajectories.fill_positions(samples(spark, (0, 50.0, None, None), (1, None, 14.0, 90), (2, 51.0, 15.0, 100), (3, None, 15.5, None))).orderBy("sample_time").collect()
    assert [r.lat for r in rows] == [50.0, None, 51.0, 51.0] and [r.imputed for r in rows] == [False, False, False, True]


def pair(spark, a, b):
    names = [f"{c}_{i}" for i in (1, 2) for c in conflicts.STATE]
    return spark.createDataFrame([("A", "B", *a, *b, T0, T0)], "flight_id_1 string, flight_id_2 string, " + ", ".join(f"{n} double" for n in names) + ", ts_1 timestamp, ts_2 timestamp")


def test_head_on(spark):
    r = conflicts.closest_approach(pair(spark, (50.0, 14.0, 350.0, 400.0, 90.0, 0.0), (50.0, 14.4, 350.0, 400.0, 270.0, 0.0))).first().conflict
    apart = 0.4 * 60.04 * math.cos(math.radians(50))
    assert r.cpa_h == pytest.approx(apart / 800, rel=0.01) and r.entry_h == pytest.approx((apart - 5) / 800, rel=0.02) and r.horizontal_nm < 0.1


@pytest.mark.parametrize(("a", "b"), [((50.0, 14.0, 350.0, 400.0, 90.0, 0.0),) * 2, ((50.0, 14.05, 350.0, 400.0, 90.0, 0.0), (50.0, 13.98, 350.0, 200.0, 90.0, 0.0)), ((50.0, 14.0, 350.0, 400.0, 90.0, 0.0), (50.0, 14.4, 390.0, 400.0, 270.0, 0.0))])
def test_no_conflict(spark, a, b):
    assert conflicts.closest_approach(pair(spark, a, b)).first().conflict is None


def plan(spark, levels):
    rows = [("F", i, f"W{i}", 50.0, 14.0 + i * 0.5, 400, level) for i, level in enumerate(levels)]
    state = spark.createDataFrame([("F", 50.0, 14.0, 300, 400, 0)], "flight_id string, lat double, lon double, level int, knots int, fpm int")
    return spark.createDataFrame(rows, "flight_id string, idx int, ident string, lat double, lon double, tas int, level int"), state


@pytest.mark.parametrize(("levels", "want"), [((350, 350, 350), [300, 300]), ((350, 310, 350), [310, 350]), ((300, 350, 350), [350, 350])])
def test_level_override(spark, levels, want):
    plans, states = plan(spark, levels)
    up = motion.upcoming_waypoint(plans, states)
    assert up.first().upcoming == 1
    first, *rest = [r.level for r in motion.clip_to_horizon(motion.ahead_of(plans, states, spark.createDataFrame([("F", 0)], "flight_id string, upcoming int"))).orderBy("n").collect()][1:]
    assert rest == want


def test_along_route(spark):
    plans, states = plan(spark, (300, 300, 300))
    up = motion.upcoming_waypoint(plans, states)
    leg = 0.5 * 60.04 * math.cos(math.radians(50))
    r = motion.along_route(motion.ahead_of(plans, states, up), F.lit(leg / 2 / 400)).first()
    assert r.lon == pytest.approx(14.25, abs=0.01) and r.level == 300
    assert motion.along_route(motion.ahead_of(plans, states, up), F.lit(9.0)).first().lon == 15.0


def test_point_precedence(spark):
    asked = spark.createDataFrame([(1, "52N020E", 50.0, 14.0), (2, "PSA090060", 50.0, 14.0), (3, "PSA", 50.0, 14.0), (4, "NAV", 50.0, 14.0), (5, "NONE", 50.0, 14.0)], "k int, ident string, lat double, lon double")
    fixes = spark.createDataFrame([(1, "PSA", 50.0, 15.0), (2, "PSA", 10.0, 15.0)], "id int, identificator string, lat double, lon double")
    navs = spark.createDataFrame([(1, "PSA", 50.0, 14.0), (2, "NAV", 49.0, 14.0)], "id int, identificator string, lat double, lon double")
    got = {r.k: r.point for r in navpoints.resolve_points(asked, fixes, navs, ["k"]).collect()}
    assert got[1].lat == 52 and got[2].lon > 16 and got[3].lon == 15 and got[4].lat == 49 and got[5] is None


def test_event_life_cycle(spark):
    old = spark.createDataFrame([(1, "A", "B", T0, T0, 50.0, 14.0, 1.0, 0.0, 0.1, True), (2, "A", "B", T0, T0, 55.0, 14.0, 1.0, 0.0, 0.2, True), (3, "C", "D", T0, T0, 50.0, 14.0, 1.0, 0.0, 0.2, True)], "id long, flight_id_1 string, flight_id_2 string, detected_at timestamp, last_checked timestamp, middle_point_lat double, middle_point_lon double, horizontal_distance double, vertical_distance double, remaining_time double, active boolean")
    predicted = spark.createDataFrame([("B", "A", 1, 50.01, 14.0, 2.0, 0.1, 0.05), ("A", "B", 2, 20.0, 14.0, 2.0, 0.1, 0.05)], "flight_id_1 string, flight_id_2 string, ordinal int, middle_lat double, middle_lon double, horizontal_nm double, vertical_nm double, remaining_time double")
    checked = spark.createDataFrame([("A", "B")], "flight_id_1 string, flight_id_2 string")
    rows = {r.id: r for r in events.reconcile(predicted, old, checked, F.lit(T0)).collect()}
    assert rows[1].active and rows[1].remaining_time == 0.05 and not rows[2].active and rows[3].active and rows[4].middle_point_lat == 20.0

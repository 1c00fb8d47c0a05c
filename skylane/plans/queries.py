"""Queries of the flight operators over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylane.functions import geo, parsing
from skylane.operators import blocking, boundaries, conflicts, events, motion, navpoints, routes, snapshots, trajectories
from skylane.operators.staging import staged
from skylane.streaming import replay

from . import demo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The tick of snapshot queries, and the skew that lets pairs of the driver's month of events meet.
TICK, SKEW_S = "2024-01-15 00:00:00", 86_400


def query(sql: str | None = None, *ctes: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add


def r6(**columns: Column) -> list[Column]:
    return [(F.round(c.cast("double"), 6) + 0.0).alias(n) for n, c in columns.items()]


P, G, L = demo.POSITIONS_SQL, demo.GAPS_SQL, demo.LATEST_SQL


def hav_nm(a: str, b: str, c: str, d: str) -> str:
    s = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    return f"(2 * 6371e0 * atan2(sqrt({s}), sqrt(greatest(0e0, 1 - {s}))) / 1.852e0)"


def bearing_sql(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians(({d}) - ({b}))) * cos(radians({c}))"
    x = f"(cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b}))))"
    return f"fmod(degrees(atan2({y}, {x})) + 360e0, 360e0)"


def lambert_sql(a: str, b: str, c: str, d: str) -> str:
    f = "(1 / 298.257223563e0)"
    r = lambda x: f"atan((1 - {f}) * tan(radians({x})))"
    s = f"(pow(sin(({r(c)} - {r(a)}) / 2), 2) + cos({r(a)}) * cos({r(c)}) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
    sg, p, q = f"(2 * atan2(sqrt({s}), sqrt(greatest(0e0, 1 - {s}))))", f"(({r(a)} + {r(c)}) / 2)", f"(({r(c)} - {r(a)}) / 2)"
    x = f"(({sg} - sin({sg})) * pow(sin({p}) * cos({q}), 2) / pow(cos({sg} / 2), 2))"
    y = f"(({sg} + sin({sg})) * pow(cos({p}) * sin({q}), 2) / nullif(pow(sin({sg} / 2), 2), 0))"
    return f"(CASE WHEN {sg} = 0 THEN 0e0 ELSE 6378137e0 * ({sg} - {f} / 2 * ({x} + {y})) END)"


# Latest positions, snapshots, blocking


@query("SELECT event_id, flight_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM latest", P, L)
def w1_latest_per_flight(spark, sf):
    return demo.latest(spark, sf).select("event_id", "flight_id", *r6(lat=F.col("lat"), lon=F.col("lon")))


@query("SELECT event_id, flight_id FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY ts DESC, event_id DESC) AS rn FROM gap) WHERE rn = 1 AND lat IS NOT NULL AND lon IS NOT NULL AND fl IS NOT NULL", P, G)
def w3_latest_then_validate(spark, sf):
    rows = demo.gaps(spark, sf)
    return snapshots.latest_then_validate(rows, ("sample_time", "event_id"), ("lat", "lon", "flight_level")).select("event_id", "flight_id")


@query(f"SELECT event_id, flight_id FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY ts DESC, event_id DESC) AS rn FROM pos WHERE ts > TIMESTAMP '{TICK}' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '{TICK}') WHERE rn = 1", P)
def w2_snapshot_at_tick(spark, sf):
    rows = demo.positions(spark, sf).withColumnRenamed("ts", "sample_time")
    return snapshots.snapshot_at(rows, F.lit(TICK).cast("timestamp"), 6 * 3600 - 30, 30, order=("sample_time", "event_id")).select("event_id", "flight_id")


@query("SELECT event_id, l.flight_id, CAST(fl AS INT) * 100 AS altitude_ft, gs AS ground_speed_kt FROM latest l WHERE user_id % 10 <> 7", P, L)
def j1_j3_active_latest(spark, sf):
    rows = blocking.active_positions(blocking.can_conflict(demo.positions(spark, sf)), demo.flights(spark, sf))
    found = snapshots.latest_complete_with_flight(rows, demo.flights(spark, sf), ("ts", "event_id"))
    return found.select("event_id", "flight_id", (F.col("flight_level") * 100).alias("altitude_ft"), "ground_speed_kt")


_BLOCK = f"""SELECT flight_id_1, flight_id_2, round(d, 6) AS distance_nm, round(d / v, 6) AS time_to_meeting_hours FROM (
  SELECT a.flight_id AS flight_id_1, b.flight_id AS flight_id_2, {{d}} AS d, a.gs + b.gs AS v
  FROM latest a JOIN latest b ON a.flight_id < b.flight_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < {SKEW_S * 1_000_000}) WHERE d / v <= 0.25"""
_NM, _LAMBERT = hav_nm("a.lat", "a.lon", "b.lat", "b.lon"), f"({lambert_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1852e0)"


def _pairs(rows: DataFrame) -> DataFrame:
    return blocking.flight_pairs(rows.select("flights_1", "flights_2", *r6(distance_nm=F.col("distance_nm"), time_to_meeting_hours=F.col("time_to_meeting_hours"))))


@query(_BLOCK.format(d=_NM), P, L)
def j2_blocking_pairs(spark, sf):
    return _pairs(blocking.state_pairs(demo.latest(spark, sf), 0.25, SKEW_S, "sphere"))


@query(_BLOCK.format(d=_LAMBERT), P, L)
def j2_blocking_pairs_spheroid(spark, sf):
    return _pairs(blocking.state_pairs(demo.latest(spark, sf), 0.25, SKEW_S))


@query(f"SELECT flight_id_1, string_agg(flight_id_2, ',' ORDER BY flight_id_2) AS partners, CAST(count(*) AS INT) AS n_partners FROM ({_BLOCK.format(d=_NM)}) GROUP BY flight_id_1", P, L)
def a4_partners(spark, sf):
    return blocking.partner_lists(demo.latest(spark, sf), 0.25, SKEW_S)


# Trajectories

_FILLED = """f0 AS (SELECT *, max(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND fl IS NOT NULL THEN 1 ELSE 0 END) OVER w AS s FROM gap WINDOW w AS (PARTITION BY flight_id ORDER BY ts, event_id)),
f1 AS (SELECT event_id, flight_id, ts, lat IS NOT NULL AND lon IS NOT NULL AND fl IS NOT NULL AS whole,
  coalesce(lat, CASE WHEN s = 1 THEN last_value(CASE WHEN s = 1 THEN lat END IGNORE NULLS) OVER b END) AS lat,
  coalesce(lon, CASE WHEN s = 1 THEN last_value(CASE WHEN s = 1 THEN lon END IGNORE NULLS) OVER b END) AS lon,
  coalesce(fl, CASE WHEN s = 1 THEN last_value(CASE WHEN s = 1 THEN fl END IGNORE NULLS) OVER b END) AS fl
  FROM f0 WINDOW b AS (PARTITION BY flight_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, NOT whole AND lat IS NOT NULL AND lon IS NOT NULL AND fl IS NOT NULL AS imputed FROM f1)"""


def _kinematics_sql(source: str) -> str:
    nm, course = hav_nm("plat", "plon", "lat", "lon"), bearing_sql("plat", "plon", "lat", "lon")
    ok = "lat IS NOT NULL AND lon IS NOT NULL AND fl IS NOT NULL AND plat IS NOT NULL AND plon IS NOT NULL AND pfl IS NOT NULL AND epoch_us(ts) > epoch_us(pts) AND sec <> 0"
    return f"""k0 AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(fl) OVER w AS pfl, lag(ts) OVER w AS pts,
  CAST(floor(epoch_us(ts) / 1e6) - floor(epoch_us(lag(ts) OVER w) / 1e6) AS BIGINT) AS sec FROM {source} WINDOW w AS (PARTITION BY flight_id ORDER BY ts, event_id)),
kin AS (SELECT *, CASE WHEN {ok} THEN CAST(round_even(abs({nm} * 1.852e0 / (sec / 3600e0)) / 1.852e0, 0) AS INT) END AS gs, CASE WHEN {ok} THEN CAST(trunc({course}) AS INT) END AS trk,
  CASE WHEN {ok} THEN CAST(round_even((fl - pfl) * 100 * 0.3048e0 / (sec / 60e0) / 0.3048e0, 0) AS INT) END AS vs FROM k0)"""


@query("SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon, fl AS flight_level, imputed FROM filled", P, G, _FILLED)
def w4_locf_position(spark, sf):
    rows = trajectories.fill_positions(demo.gaps(spark, sf), ("sample_time", "event_id"))
    return rows.select("event_id", *r6(lat=F.col("lat"), lon=F.col("lon")), "flight_level", "imputed")


@query("SELECT event_id, gs AS ground_speed_kt, trk AS track_heading, vs AS vertical_rate_fpm FROM kin", P, G, _kinematics_sql("gap"))
def w5_pairwise_kinematics(spark, sf):
    rows = trajectories.pairwise_kinematics(demo.gaps(spark, sf), ("sample_time", "event_id"))
    return rows.select("event_id", "derived.ground_speed_kt", "derived.track_heading", "derived.vertical_rate_fpm")


@query("""SELECT event_id, last_value(CASE WHEN NOT imputed THEN gs END IGNORE NULLS) OVER w AS ground_speed_kt, last_value(CASE WHEN NOT imputed THEN trk END IGNORE NULLS) OVER w AS track_heading,
  last_value(CASE WHEN NOT imputed THEN vs END IGNORE NULLS) OVER w AS vertical_rate_fpm FROM kin WINDOW w AS (PARTITION BY flight_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", P, G, _FILLED, _kinematics_sql("filled"))  # fmt: skip
def w6_kinematics_carry(spark, sf):
    rows = trajectories.with_kinematics(demo.gaps(spark, sf), ("sample_time", "event_id"))
    return rows.select("event_id", "ground_speed_kt", "track_heading", "vertical_rate_fpm")


@query(f"SELECT flight_id, idx, round({hav_nm('lat', 'lon', 'tlat', 'tlon')}, 6) AS leg_nm FROM (SELECT *, lead(lat) OVER w AS tlat, lead(lon) OVER w AS tlon FROM plan WINDOW w AS (PARTITION BY flight_id ORDER BY idx)) WHERE tlat IS NOT NULL", P, demo.PLANS_SQL)
def w8_legs(spark, sf):
    rows = trajectories.legs(demo.plans(spark, sf), ("flight_id",), "idx")
    return rows.select("flight_id", "idx", *r6(leg_nm=geo.haversine_nm(*[F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")])))


@query("SELECT min(ts) AS min_time, max(ts) AS max_time FROM events")
def a2_dataset_bounds(spark, sf):
    rows = trajectories.dataset_bounds(demo.positions(spark, sf), "ts")
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("min_time", "max_time")])


# Geometry

_LAG = "q AS (SELECT *, 47.5e0 AS alat, 11.25e0 AS alon, 300 AS afl FROM pos)"
_ENU = """e0 AS (SELECT *, 6371e0 + afl * 0.03048e0 AS ra, 6371e0 + fl * 0.03048e0 AS rb FROM q),
e1 AS (SELECT *, rb * cos(radians(lat)) * cos(radians(lon)) - ra * cos(radians(alat)) * cos(radians(alon)) AS dx,
  rb * cos(radians(lat)) * sin(radians(lon)) - ra * cos(radians(alat)) * sin(radians(alon)) AS dy, rb * sin(radians(lat)) - ra * sin(radians(alat)) AS dz FROM e0),
e2 AS (SELECT *, -sin(radians(alon)) * dx + cos(radians(alon)) * dy AS east, -sin(radians(alat)) * cos(radians(alon)) * dx - sin(radians(alat)) * sin(radians(alon)) * dy + cos(radians(alat)) * dz AS north,
  cos(radians(alat)) * cos(radians(alon)) * dx + cos(radians(alat)) * sin(radians(alon)) * dy + sin(radians(alat)) * dz AS up0 FROM e1),
enu AS (SELECT *, up0 + (east * east + north * north) / (2 * 6371e0) AS up FROM e2)"""


def _anchored(spark, sf) -> tuple[DataFrame, list[Column], list[Column]]:
    return demo.positions(spark, sf), [F.lit(47.5), F.lit(11.25), F.lit(300)], [F.col("lat"), F.col("lon"), F.col("flight_level")]


@query(f"SELECT event_id, round({hav_nm('alat', 'alon', 'lat', 'lon')} * 1.852e0, 6) AS km, round({bearing_sql('alat', 'alon', 'lat', 'lon')}, 6) AS course, round({lambert_sql('alat', 'alon', 'lat', 'lon')}, 3) AS metres FROM q", P, _LAG)
def m7_m8_m23_distances(spark, sf):
    rows, a, b = _anchored(spark, sf)
    at = [*a[:2], *b[:2]]
    return rows.select("event_id", *r6(km=geo.haversine_km(*at), course=geo.bearing(*at)), F.round(geo.geodesic_m(*at), 3).alias("metres"))


@query("""SELECT event_id, round(east, 6) + 0 AS east, round(north, 6) + 0 AS north, round(up, 6) + 0 AS up, round(alat + degrees(north / 6371e0), 6) + 0 AS lat, round(alon + degrees(east / (6371e0 * cos(radians(alat)))), 6) + 0 AS lon,
  round(afl + up / 0.03048e0, 6) + 0 AS level FROM enu""", P, _LAG, _ENU)  # fmt: skip
def m11_m14_enu(spark, sf):
    rows, a, b = _anchored(spark, sf)
    rows = rows.withColumns(dict(zip(("east", "north", "up"), geo.enu_km(*a, *b), strict=True)))
    back = geo.enu_to_position(F.col("east"), F.col("north"), F.col("up"), *a)
    return rows.select("event_id", *r6(east=F.col("east"), north=F.col("north"), up=F.col("up"), **dict(zip(("lat", "lon", "level"), back, strict=True))))


@query("""SELECT event_id, round(gs * sin(radians(trk)), 6) + 0 AS east, round(gs * cos(radians(trk)), 6) + 0 AS north, round(vs * 60 / (1852e0 / 0.3048e0), 6) + 0 AS up, round(vs * 0.3048e0, 6) + 0 AS metres,
  round(vs * 0.3048e0 / 1852e0, 6) + 0 AS nm, round(gs / 0.3048e0 * 60, 6) + 0 AS fpm, round(abs(gs / 2e0), 6) + 0 AS kmh, round(sqrt(gs * gs + vs * vs) * 1.944e0, 6) + 0 AS wind, round(fmod(degrees(atan2(-gs, -vs)) + 360e0, 360e0), 6) + 0 AS wind_from FROM pos""", P)  # fmt: skip
def m1_m16_m27_speeds_units(spark, sf):
    gs, trk, vs = (F.col(c) for c in ("ground_speed_kt", "track_heading", "vertical_rate_fpm"))
    east, north, up = geo.speed_vector(gs, trk, vs)
    blow, from_ = geo.wind(gs, vs)
    return demo.positions(spark, sf).select("event_id", *r6(east=east, north=north, up=up, metres=geo.feet_to_meters(vs), nm=geo.feet_to_nm(vs), fpm=geo.mps_to_fpm(gs), kmh=geo.horizontal_speed_kmh(gs, F.lit(2)), wind=blow, wind_from=from_))


_AFTER = """SELECT event_id, round(lat + degrees(gs * cos(radians(trk)) * 0.2e0 * 1.852e0 / 6371e0), 6) AS lat, round(lon + degrees(gs * sin(radians(trk)) * 0.2e0 * 1.852e0 / (6371e0 * cos(radians(lat)))), 6) AS lon,
  round(fl + vs * 60 / (1852e0 / 0.3048e0) * 0.2e0 * 1.852e0 / 0.03048e0, 6) AS level FROM pos"""


@query(_AFTER, P)
def m17_position_after(spark, sf):
    moved = geo.position_after(*[F.col(c) for c in ("lat", "lon", "flight_level", "ground_speed_kt", "track_heading", "vertical_rate_fpm")], F.lit(0.2))
    return demo.positions(spark, sf).select("event_id", *r6(**dict(zip(("lat", "lon", "level"), moved, strict=True))))


@query("""SELECT event_id, CAST(CASE WHEN abs(vs) < 100 THEN fl ELSE round_even(CASE WHEN (350 > fl AND vs > 0) THEN least(fl + vs * 0.6e0 * 0.05e0, 350e0) WHEN (350 < fl AND vs < 0) THEN greatest(fl + vs * 0.6e0 * 0.05e0, 350e0)
  ELSE fl + vs * 0.6e0 * 0.05e0 END, 0) END AS INT) AS level, abs(fl - 350) <= 4 AS near FROM pos""", P)  # fmt: skip
def m19_m20_projected_level(spark, sf):
    fl, vs = F.col("flight_level"), F.col("vertical_rate_fpm")
    return demo.positions(spark, sf).select("event_id", geo.projected_level(fl, vs, F.lit(350), F.lit(0.05)).alias("level"), geo.levels_close(fl, F.lit(350)).alias("near"))


# Closest approach

_REL = """r0 AS (SELECT *, 6371e0 + level_1 * 0.03048e0 AS ra, 6371e0 + level_2 * 0.03048e0 AS rb FROM pr),
r1 AS (SELECT *, rb * cos(radians(lat_2)) * cos(radians(lon_2)) - ra * cos(radians(lat_1)) * cos(radians(lon_1)) AS dx, rb * cos(radians(lat_2)) * sin(radians(lon_2)) - ra * cos(radians(lat_1)) * sin(radians(lon_1)) AS dy,
  rb * sin(radians(lat_2)) - ra * sin(radians(lat_1)) AS dz FROM r0),
r2 AS (SELECT *, (-sin(radians(lon_1)) * dx + cos(radians(lon_1)) * dy) / 1.852e0 AS rx, (-sin(radians(lat_1)) * cos(radians(lon_1)) * dx - sin(radians(lat_1)) * sin(radians(lon_1)) * dy + cos(radians(lat_1)) * dz) / 1.852e0 AS ry,
  (cos(radians(lat_1)) * cos(radians(lon_1)) * dx + cos(radians(lat_1)) * sin(radians(lon_1)) * dy + sin(radians(lat_1)) * dz) / 1.852e0 AS rz0,
  knots_1 * sin(radians(track_1)) AS ax, knots_1 * cos(radians(track_1)) AS ay, fpm_1 * 60 / (1852e0 / 0.3048e0) AS az, knots_2 * sin(radians(track_2)) AS b_x, knots_2 * cos(radians(track_2)) AS b_y, fpm_2 * 60 / (1852e0 / 0.3048e0) AS b_z FROM r1),
r3 AS (SELECT *, rz0 + (rx * rx + ry * ry) * 1.852e0 / (2 * 6371e0) AS rz, b_x - ax AS vx, b_y - ay AS vy, b_z - az AS vz FROM r2),
r4 AS (SELECT *, vx * vx + vy * vy + vz * vz AS vv, -(rx * vx + ry * vy + rz * vz) / nullif(vx * vx + vy * vy + vz * vz, 0) AS t, vx * vx + vy * vy AS qa, 2 * (rx * vx + ry * vy) AS qb, rx * rx + ry * ry - 25 AS qc,
  1000 * 0.3048e0 / 1852e0 AS sep FROM r3),
r5 AS (SELECT *, CASE WHEN abs(qa) < 1e-10 THEN CASE WHEN qc < 0 THEN '-inf'::DOUBLE END WHEN qb * qb - 4 * qa * qc >= 0 THEN (-qb - sqrt(greatest(0e0, qb * qb - 4 * qa * qc))) / (2 * qa) END AS h0,
  CASE WHEN abs(qa) < 1e-10 THEN CASE WHEN qc < 0 THEN 'inf'::DOUBLE END WHEN qb * qb - 4 * qa * qc >= 0 THEN (-qb + sqrt(greatest(0e0, qb * qb - 4 * qa * qc))) / (2 * qa) END AS h1,
  CASE WHEN abs(vz) < 1e-10 THEN CASE WHEN abs(rz) < sep THEN '-inf'::DOUBLE END ELSE least((sep - rz) / vz, (-sep - rz) / vz) END AS v0, CASE WHEN abs(vz) < 1e-10 THEN CASE WHEN abs(rz) < sep THEN 'inf'::DOUBLE END ELSE greatest((sep - rz) / vz, (-sep - rz) / vz) END AS v1 FROM r4),
rel AS (SELECT *, greatest(h0, v0) AS t0, least(h1, v1) AS t1, h0 IS NOT NULL AND v0 IS NOT NULL AND greatest(h0, v0) <= least(h1, v1) AND least(h1, v1) >= 0 AS hit FROM r5)"""
#: Pairs that blocking finds, and both flights' states.
_CAN_MEET = f"a.flight_id < b.flight_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < {SKEW_S * 1_000_000} AND {_NM} / (a.gs + b.gs) <= 0.25"
_PAIRS = f"""pr AS (SELECT a.flight_id AS flight_id_1, b.flight_id AS flight_id_2, a.lat AS lat_1, a.lon AS lon_1, a.fl AS level_1, a.gs AS knots_1, a.trk AS track_1, a.vs AS fpm_1, a.ts AS ts_1,
  b.lat AS lat_2, b.lon AS lon_2, b.fl AS level_2, b.gs AS knots_2, b.trk AS track_2, b.vs AS fpm_2, b.ts AS ts_2 FROM latest a JOIN latest b ON {_CAN_MEET})"""
_CPA = (P, L, _PAIRS, _REL)


def _cpa(spark, sf, until: float | None = None) -> DataFrame:
    return conflicts.closest_approaches(demo.near_states(spark, sf, 0.25, SKEW_S, until))


@query("""SELECT flight_id_1, flight_id_2, round(sqrt(pow(rx + vx * t, 2) + pow(ry + vy * t, 2)), 6) AS horizontal_nm, round(rz + vz * t, 6) AS vertical_nm, round(t, 6) AS cpa_h,
  round(lat_1 + degrees((ay * t + (ry + vy * t) / 2) * 1.852e0 / 6371e0), 6) AS middle_lat, round(lon_1 + degrees((ax * t + (rx + vx * t) / 2) * 1.852e0 / (6371e0 * cos(radians(lat_1)))), 6) AS middle_lon
  FROM rel WHERE hit AND vv >= 1e-10 AND t >= -0.75e0 / 60""", *_CPA)  # fmt: skip
def c1_closest_approach(spark, sf):
    c = F.col("conflict")
    return _cpa(spark, sf).select("flight_id_1", "flight_id_2", *r6(horizontal_nm=c["horizontal_nm"], vertical_nm=c["vertical_nm"], cpa_h=c["cpa_h"], middle_lat=c["middle"]["lat"], middle_lon=c["middle"]["lon"]))


@query("""SELECT flight_id_1, flight_id_2, round(t0, 6) AS entry_h, round(t1, 6) AS exit_h, round(lat_1 + degrees((ry + b_y * t0) * 1.852e0 / 6371e0), 6) AS entry_2_lat, round(level_1 + (az * t1) * 1.852e0 / 0.03048e0, 6) AS exit_1_level
  FROM rel WHERE hit AND vv >= 1e-10 AND t >= -0.75e0 / 60""", *_CPA)  # fmt: skip
def c2_conflict_interval(spark, sf):
    c = F.col("conflict")
    return _cpa(spark, sf).select("flight_id_1", "flight_id_2", *r6(entry_h=c["entry_h"], exit_h=c["exit_h"], entry_2_lat=c["entry_2"]["lat"], exit_1_level=c["exit_1"]["level"]))


@query("""SELECT flight_id_1, flight_id_2, round(t0, 6) AS entry_h FROM rel WHERE hit AND vv >= 1e-10 AND t >= 0 AND t0 <= 0.25 AND sqrt(pow(rx + vx * t, 2) + pow(ry + vy * t, 2)) < 5
  AND abs(rz + vz * t) < 950 * 0.3048e0 / 1852e0""", *_CPA)  # fmt: skip
def c4_f8_separation_filter(spark, sf):
    rows = _cpa(spark, sf, conflicts.HORIZON_H).filter(conflicts.is_conflict(F.col("conflict")))
    return rows.select("flight_id_1", "flight_id_2", *r6(entry_h=F.col("conflict.entry_h")))


def _moved(i: int) -> str:
    h = f"((epoch_us(greatest(ts_1, ts_2)) - epoch_us(ts_{i})) / 3.6e9)"
    late = f"abs(epoch_us(ts_1) - epoch_us(ts_2)) > 10000000 AND {h} > 0"
    return f"""round(CASE WHEN {late} THEN lat_{i} + degrees(knots_{i} * cos(radians(track_{i})) * {h} * 1.852e0 / 6371e0) ELSE lat_{i} END, 6) AS lat_{i},
  CAST(CASE WHEN {late} THEN round_even(level_{i} + fpm_{i} * 60 / (1852e0 / 0.3048e0) * {h} * 1.852e0 / 0.03048e0, 0) ELSE level_{i} END AS INT) AS level_{i}"""


@query(f"SELECT flight_id_1, flight_id_2, {_moved(1)}, {_moved(2)} FROM pr WHERE abs(epoch_us(ts_1) - epoch_us(ts_2)) < 36000000000", P, L, _PAIRS)
def j13_time_align(spark, sf):
    near = demo.state_pairs(spark, sf, 0.25, SKEW_S).filter(conflicts.time_skew_s(F.col("ts_1"), F.col("ts_2")) < 36_000)
    rows = conflicts.align_times(near)
    return rows.select("flight_id_1", "flight_id_2", *r6(lat_1=F.col("lat_1"), lat_2=F.col("lat_2")), F.col("level_1").cast("int"), F.col("level_2").cast("int"))


# Along plans

_PROGRESS = """u0 AS (SELECT p.*, lead(p.lat) OVER w AS tlat, lead(p.lon) OVER w AS tlon, s.lat AS olat, s.lon AS olon FROM plan p JOIN st s USING (flight_id) WINDOW w AS (PARTITION BY p.flight_id ORDER BY idx)),
u1 AS (SELECT *, cos(radians((lat + tlat) / 2)) AS c FROM u0),
u2 AS (SELECT *, coalesce(((olat - lat) * (tlat - lat) + (olon - lon) * c * (tlon - lon) * c) / nullif(pow(tlat - lat, 2) + pow((tlon - lon) * c, 2), 0), 1.1e0) AS pg FROM u1),
up AS (SELECT flight_id, CAST(coalesce(min(CASE WHEN tlat IS NOT NULL AND pg < 1 THEN idx * 2 + CASE WHEN pg >= 0 THEN 1 ELSE 0 END END) // 2 + min(CASE WHEN tlat IS NOT NULL AND pg < 1 THEN idx * 2 + CASE WHEN pg >= 0 THEN 1 ELSE 0 END END) % 2, max(idx)) AS INT) AS upcoming FROM u2 GROUP BY flight_id)"""
_AHEAD = f"""a0 AS (SELECT p.*, u.upcoming, s.lat AS olat, s.lon AS olon, s.level AS olevel, s.knots, s.fpm, p.idx - u.upcoming AS n FROM plan p JOIN up u USING (flight_id) JOIN st s USING (flight_id) WHERE p.idx >= u.upcoming),
a1 AS (SELECT *, coalesce(lag(lat) OVER w, olat) AS flat, coalesce(lag(lon) OVER w, olon) AS flon FROM a0 WINDOW w AS (PARTITION BY flight_id ORDER BY n)),
ah AS (SELECT *, {hav_nm('flat', 'flon', 'lat', 'lon')} AS leg FROM a1)"""
_WAY = (P, demo.PLANS_SQL, demo.STATES_SQL, _PROGRESS, _AHEAD)


def _ahead(spark, sf) -> DataFrame:
    plan, state = demo.plans(spark, sf), demo.states(spark, sf)
    return motion.ahead_of(plan, state, motion.upcoming_waypoint(plan, state))


@query("SELECT flight_id, upcoming FROM up", P, demo.PLANS_SQL, demo.STATES_SQL, _PROGRESS)
def w9_upcoming_waypoint(spark, sf):
    return motion.upcoming_waypoint(demo.plans(spark, sf), demo.states(spark, sf))


@query("SELECT flight_id, CAST(n AS INT) AS n, round(sum(leg) OVER (PARTITION BY flight_id ORDER BY n), 6) AS miles FROM ah", *_WAY)
def a6_track_miles(spark, sf):
    return motion.track_miles(_ahead(spark, sf)).select("flight_id", "n", *r6(miles=F.col("miles")))


_CLIP = """h0 AS (SELECT *, coalesce(sum(leg) OVER (PARTITION BY flight_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(leg / tas) OVER (PARTITION BY flight_id ORDER BY n) AS eh FROM ah),
h1 AS (SELECT *, first_value(level) OVER w AS pl, first_value(olevel) OVER w AS ol, first_value(eh) OVER w AS e0 FROM h0 WHERE bef <= knots * 0.5e0 WINDOW w AS (PARTITION BY flight_id ORDER BY n)),
h2 AS (SELECT *, CASE WHEN abs(fpm) < 100 THEN ol ELSE CAST(round_even(CASE WHEN pl > ol AND fpm > 0 THEN least(ol + fpm * 60 / 100e0 * e0, pl) WHEN pl < ol AND fpm < 0 THEN greatest(ol + fpm * 60 / 100e0 * e0, pl) ELSE ol + fpm * 60 / 100e0 * e0 END, 0) AS INT) END AS pj,
  sum(CASE WHEN level <> pl THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY n) AS ch FROM h1),
clip AS (SELECT flight_id, CAST(n + 1 AS INT) AS n, lat, lon, CAST(CASE WHEN abs(pj - pl) > 4 AND ch = 0 THEN pj ELSE level END AS INT) AS level, eh AS entry_h, knots FROM h2
  UNION ALL SELECT flight_id, 0, olat, olon, CAST(olevel AS INT), 0, knots FROM h2 WHERE n = 0)"""


@query("SELECT flight_id, n, round(lat, 6) AS lat, level, round(entry_h, 6) AS entry_h FROM clip", *_WAY, _CLIP)
def w10_w11_horizon_clip(spark, sf):
    return motion.clip_to_horizon(_ahead(spark, sf)).select("flight_id", "n", *r6(lat=F.col("lat"), entry_h=F.col("entry_h")), "level")


_ALONG = """l0 AS (SELECT *, knots * 0.4e0 AS way, coalesce(sum(leg) OVER w0, 0) AS bef, coalesce(lag(level) OVER w, olevel) AS fl0, row_number() OVER (PARTITION BY flight_id ORDER BY n DESC) AS back FROM ah
  WINDOW w AS (PARTITION BY flight_id ORDER BY n), w0 AS (PARTITION BY flight_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l1 AS (SELECT *, leg >= 1e-12 AND way >= bef AND way < bef + leg AS o, (way - bef) / nullif(leg, 0) AS t FROM l0),
l2 AS (SELECT *, max(CASE WHEN o THEN n END) OVER (PARTITION BY flight_id) AS hit_n FROM l1)"""
_ALONG_ROWS = f"""SELECT flight_id, round(CASE WHEN hit_n IS NULL THEN lat ELSE flat + (lat - flat) * t END, 6) AS lat, CAST(CASE WHEN hit_n IS NULL THEN level ELSE round_even(fl0 + (level - fl0) * t, 0) END AS INT) AS level,
  CAST(trunc({bearing_sql('flat', 'flon', 'lat', 'lon')}) AS INT) AS track, round(CASE WHEN hit_n IS NULL THEN 0 ELSE (level - fl0) * 100 / (leg / knots) END, 6) AS fpm FROM l2 WHERE n = hit_n OR (hit_n IS NULL AND back = 1)"""


@query(_ALONG_ROWS, *_WAY, _ALONG)
def w12_along_route(spark, sf):
    return motion.along_route(_ahead(spark, sf), F.lit(0.4)).select("flight_id", *r6(lat=F.col("lat"), fpm=F.col("fpm")), "level", "track")


_BOX = "min(lat) - 0.25e0 AS min_lat, max(lat) + 0.25e0 AS max_lat, min(lon) - 0.25e0 AS min_lon, max(lon) + 0.25e0 AS max_lon, min(level) - 10 AS min_level, max(level) + 10 AS max_level"


@query(f"SELECT flight_id, round(min_lat, 6) AS min_lat, round(max_lat, 6) AS max_lat, round(min_lon, 6) AS min_lon, round(max_lon, 6) AS max_lon, CAST(min_level AS INT) AS min_level, CAST(max_level AS INT) AS max_level FROM (SELECT flight_id, {_BOX} FROM clip GROUP BY flight_id)", *_WAY, _CLIP)
def a5_bounding_cube(spark, sf):
    rows = boundaries.bounding_boxes(motion.clip_to_horizon(_ahead(spark, sf)), ["flight_id"])
    return rows.select("flight_id", *r6(**{c: F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")}), F.col("min_level").cast("int"), F.col("max_level").cast("int"))


_SIDES = """cd AS (SELECT a.flight_id AS one, b.flight_id AS two FROM latest a JOIN latest b ON MEET),
sd AS (SELECT pair, side, n, c.lat, c.lon, c.level, entry_h, c.knots FROM clip c JOIN (SELECT one || '-' || two AS pair, 1 AS side, one AS flight_id FROM cd UNION ALL SELECT one || '-' || two, 2, two FROM cd) USING (flight_id)),
g0 AS (SELECT *, sum(coalesce(NM, 0)) OVER (PARTITION BY pair, side ORDER BY n) / knots AS reach FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM sd WINDOW w AS (PARTITION BY pair, side ORDER BY n))),
g1 AS (SELECT *, lead(lat) OVER w AS elat, lead(lon) OVER w AS elon, lead(level) OVER w AS elevel, lead(reach) OVER w AS ereach FROM g0 WINDOW w AS (PARTITION BY pair, side ORDER BY n)),
lg AS (SELECT *, least(lat, elat) - 0.25e0 AS a, greatest(lat, elat) + 0.25e0 AS b, least(lon, elon) - 0.25e0 AS c, greatest(lon, elon) + 0.25e0 AS d, least(level, elevel) - 10 AS e, greatest(level, elevel) + 10 AS f FROM g1 WHERE elat IS NOT NULL),
mt AS (SELECT x.pair, x.n AS leg_1, y.n AS leg_2, greatest(x.reach, y.reach) AS start_h, least(x.ereach, y.ereach) AS end_h FROM lg x JOIN lg y ON x.pair = y.pair AND x.side = 1 AND y.side = 2
  AND x.e <= y.f AND x.f >= y.e AND x.a <= y.b AND x.b >= y.a AND x.c <= y.d AND x.d >= y.c AND x.ereach >= y.reach AND x.reach <= y.ereach)""".replace("NM", hav_nm("plat", "plon", "lat", "lon")).replace("MEET", _CAN_MEET)


def _with_plans(spark, sf) -> DataFrame:
    """Pairs that blocking finds whose whole plans' boxes meet, with pair, and each flight's legs within the horizon as legs_1 and legs_2.

    A flight's plan is the same in all its pairs, so its box and legs are made once for a flight and carried to its pairs.
    """
    clipped = staged(motion.clip_to_horizon(_ahead(spark, sf)), "clipped")
    boxes = boundaries.bounding_boxes(clipped, ["flight_id"])
    legs = boundaries.plan_legs(clipped, ("flight_id",))
    legs = legs.groupBy("flight_id").agg(F.collect_list(F.struct("n", "reach_h", "end_reach_h", *boundaries.BOX)).alias("legs"))
    rows = demo.latest(spark, sf).join(boxes, "flight_id").join(legs, "flight_id", "left")
    pairs = blocking.candidate_pairs(rows, 0.25, SKEW_S, "sphere", (*boundaries.BOX, "legs")).filter(boundaries.boxes_meet())
    return pairs.withColumn("pair", F.concat_ws("-", "flight_id_1", "flight_id_2"))


@query("SELECT pair, leg_1, leg_2, round(start_h, 6) AS start_h, round(end_h, 6) AS end_h FROM mt", *_WAY, _CLIP, L, _SIDES)
def j5_j6_meeting_legs(spark, sf):
    rows = boundaries.meeting_legs_of(_with_plans(spark, sf), ("pair",))
    return rows.select("pair", F.col("n_1").alias("leg_1"), F.col("n_2").alias("leg_2"), *r6(start_h=F.greatest("reach_h_1", "reach_h_2"), end_h=F.least("end_reach_h_1", "end_reach_h_2")))


@query(f"SELECT x.pair FROM (SELECT pair, side, {_BOX} FROM sd GROUP BY pair, side) x JOIN (SELECT pair, side, {_BOX} FROM sd GROUP BY pair, side) y ON x.pair = y.pair AND x.side = 1 AND y.side = 2 AND x.min_level <= y.max_level AND x.max_level >= y.min_level AND x.min_lat <= y.max_lat AND x.max_lat >= y.min_lat AND x.min_lon <= y.max_lon AND x.max_lon >= y.min_lon", *_WAY, _CLIP, L, _SIDES)
def c5_meeting_plans(spark, sf):
    return _with_plans(spark, sf).select("pair")


# Navigation points


@query(f"""SELECT event_id, id AS point_id, round(m, 3) AS distance_m FROM (SELECT event_id, p.id, m, row_number() OVER (PARTITION BY event_id ORDER BY m NULLS LAST, p.id) AS rn
  FROM (SELECT a.event_id, p.id, {lambert_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} AS m FROM asked a JOIN pts p USING (name)) p) WHERE rn = 1""", P, demo.POINTS_SQL, demo.ASKED_SQL)  # fmt: skip
def j7_nearest_by_name(spark, sf):
    rows = navpoints.nearest_by_name(demo.asked_points(spark, sf), demo.fixes(spark, sf), ["event_id"])
    return rows.select("event_id", "point_id", F.round("distance_m", 3).alias("distance_m"))


@query(f"""SELECT event_id, src, id AS point_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY plat IS NULL, m NULLS LAST, src, id) AS rn
  FROM (SELECT a.event_id, p.src, p.id, p.lat AS plat, {lambert_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} AS m FROM asked a JOIN (SELECT *, 'fix' AS src FROM pts UNION ALL SELECT *, 'nav' FROM nav) p USING (name))) WHERE rn = 1""", P, demo.POINTS_SQL, demo.NAVS_SQL, demo.ASKED_SQL)  # fmt: skip
def j9_nearest_of_either(spark, sf):
    return navpoints.nearest_of_either(demo.asked_points(spark, sf), demo.fixes(spark, sf), demo.navaids(spark, sf), ["event_id"]).select("event_id", "src", "point_id")


@query("SELECT CAST(c_custkey AS BIGINT) AS code FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j12_new_airports(spark, sf):
    codes = demo._table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("code"))
    return navpoints.new_airports(codes, demo._table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("code")))


# Route texts

_TOKEN = """tk AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'N' || lpad(CAST(300 + event_id % 200 AS VARCHAR), 4, '0') || 'F' || lpad(CAST(100 + event_id % 300 AS VARCHAR), 3, '0')
  WHEN 1 THEN 'K' || lpad(CAST(500 + event_id % 400 AS VARCHAR), 4, '0') || 'S' || lpad(CAST(1000 + event_id % 300 AS VARCHAR), 4, '0') WHEN 2 THEN 'M0' || CAST(70 + event_id % 20 AS VARCHAR) || 'A' || CAST(100 + event_id % 300 AS VARCHAR)
  ELSE lpad(CAST(event_id % 90 AS VARCHAR), 2, '0') || CASE WHEN event_id % 8 = 3 THEN 'N' ELSE 'S' END || lpad(CAST(event_id % 180 AS VARCHAR), 3, '0') || CASE WHEN event_id % 3 = 0 THEN 'E' ELSE 'W' END END AS token FROM events)"""


def _tokens(spark, sf) -> DataFrame:
    e = F.col("event_id")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    token = (
        F.when(e % 4 == 0, F.concat(F.lit("N"), pad(300 + e % 200, 4), F.lit("F"), pad(100 + e % 300, 3)))
        .when(e % 4 == 1, F.concat(F.lit("K"), pad(500 + e % 400, 4), F.lit("S"), pad(1000 + e % 300, 4)))
        .when(e % 4 == 2, F.concat(F.lit("M0"), (70 + e % 20).cast("string"), F.lit("A"), (100 + e % 300).cast("string")))
        .otherwise(F.concat(pad(e % 90, 2), F.when(e % 8 == 3, "N").otherwise("S"), pad(e % 180, 3), F.when(e % 3 == 0, "E").otherwise("W")))
    )
    return demo._table(spark, sf, "events").select("event_id", token.alias("token"))


@query("""SELECT event_id, token, CAST(CASE event_id % 4 WHEN 0 THEN 300 + event_id % 200 WHEN 1 THEN trunc((500 + event_id % 400) * 0.539957e0) WHEN 2 THEN trunc((70 + event_id % 20) / 100e0 * 580e0) END AS INT) AS tas,
  CAST(CASE event_id % 4 WHEN 0 THEN 100 + event_id % 300 WHEN 1 THEN trunc((1000 + event_id % 300) * 0.328084e0) WHEN 2 THEN 100 + event_id % 300 END AS INT) AS level,
  CASE WHEN event_id % 4 = 3 THEN CAST((event_id % 90) * CASE WHEN event_id % 8 = 3 THEN 1 ELSE -1 END AS DOUBLE) END AS lat, CASE WHEN event_id % 4 = 3 THEN CAST((event_id % 180) * CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS DOUBLE) END AS lon FROM tk""", _TOKEN)  # fmt: skip
def x4_x5_tokens(spark, sf):
    rows = _tokens(spark, sf)
    s, c = parsing.speed_level(F.col("token")), parsing.coordinate(F.col("token"))
    plus = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)  # noqa: E731  no minus zero
    return rows.select("event_id", "token", s["tas"].alias("tas"), s["level"].alias("level"), plus(c["lat"]).alias("lat"), plus(c["lon"]).alias("lon"))


_NAME = "nm AS (SELECT event_id, flight_id, ts, 'P' || CAST((event_id // 3) % 4 AS VARCHAR) AS ident, CASE WHEN event_id % 3 = 0 THEN CAST(300 + event_id % 50 AS INT) END AS tas FROM pos)"


@query("SELECT event_id, ident FROM (SELECT *, lag(ident) OVER (PARTITION BY flight_id ORDER BY ts, event_id) AS b FROM nm) WHERE ident IS DISTINCT FROM b", P, _NAME)
def a9_without_repeats(spark, sf):
    rows = demo.positions(spark, sf).withColumn("ident", F.concat(F.lit("P"), (F.floor(F.col("event_id") / 3) % 4).cast("string")))
    return routes.without_repeats(rows, ("flight_id",), ("ts", "event_id")).select("event_id", "ident")


@query("SELECT event_id, coalesce(last_value(tas IGNORE NULLS) OVER (PARTITION BY flight_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 250) AS tas FROM nm", P, _NAME)
def w13_running_tas(spark, sf):
    e = F.col("event_id")
    rows = demo.plans(spark, sf).withColumn("event_id", F.substring("ident", 2, 20).cast("long"))
    rows = rows.withColumn("tas", F.when(e % 3 == 0, (300 + e % 50).cast("int"))).withColumn("default_tas", F.lit(250))
    return routes.running_values(rows, ("flight_id",), ("tas",)).select("event_id", "tas")


@query("""SELECT event_id, 'N0450F310' || ' W' || CAST(event_id % 7 AS VARCHAR) || ' L610 W9' AS route, 450 AS tas, 310 AS level, 'W' || CAST(event_id % 7 AS VARCHAR) || '>L610,W9' AS segments FROM events""")
def x2_x3_parse_routes(spark, sf):
    rows = demo._table(spark, sf, "events").select("event_id", F.concat(F.lit("N0450F310 W"), (F.col("event_id") % 7).cast("string"), F.lit(" L610 W9")).alias("route"))
    parsed = routes.parse_routes(rows)
    text = F.array_join(F.transform("parsed.segments", lambda s: F.concat_ws(">", s["ident"], s["via"])), ",")
    return parsed.select("event_id", "route", F.col("parsed.config.tas").alias("tas"), F.col("parsed.config.level").alias("level"), text.alias("segments"))


_EDGE_IDS = [(1, "A", "B"), (2, "B", "C"), (3, "C", "D"), (4, "B", "E"), (5, "E", "D")]


@query("""WITH RECURSIVE e(a, b) AS (VALUES ('A', 'B'), ('B', 'C'), ('C', 'D'), ('B', 'E'), ('E', 'D')), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
p AS (SELECT 'A' || 'B' AS path, 'B' AS last UNION ALL SELECT p.path || u.b, u.b FROM p JOIN u ON u.a = p.last WHERE NOT contains(p.path, u.b)),
s AS (SELECT path FROM p WHERE last = 'D' ORDER BY length(path), path LIMIT 1)
SELECT airway_id, path FROM (SELECT DISTINCT 'T' || CAST(user_id % 5 AS VARCHAR) AS airway_id FROM events), s""")  # fmt: skip
def g1_airway_path(spark, sf):
    ids = demo._table(spark, sf, "events").select(F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("airway_id")).distinct()
    edges = ids.crossJoin(F.broadcast(spark.createDataFrame(_EDGE_IDS, "id int, start_waypoint string, end_waypoint string")))  # five rows
    found = routes.airway_paths(ids.select("airway_id", F.lit("A").alias("start"), F.lit("D").alias("end")), edges)
    return found.groupBy("airway_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ident"))), lambda x: x["ident"]), "").alias("path"))


# Tables of a replay


@query("""SELECT coalesce(n.flight_id, o.flight_id) AS flight_id, CASE WHEN n.flight_id IS NOT NULL THEN n.t ELSE o.t END AS aircraft_type, n.flight_id IS NOT NULL OR o.a AS active FROM
  (SELECT DISTINCT CAST(user_id AS VARCHAR) AS flight_id, 'A320' AS t, user_id % 10 <> 7 AS a FROM events WHERE user_id % 3 <> 0) o FULL JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS flight_id, CASE WHEN user_id % 2 = 0 THEN 'B738' END AS t FROM events WHERE user_id % 4 <> 0) n ON n.flight_id = o.flight_id""")  # fmt: skip
def k2_upsert_flights(spark, sf):
    all_ = demo.flights(spark, sf)
    u = F.col("flight_id").cast("long")
    new = all_.filter(u % 4 != 0).withColumn("aircraft_type", F.when(u % 2 == 0, "B738"))
    return snapshots.upsert_flights(all_.filter(u % 3 != 0), new).select("flight_id", "aircraft_type", "active")


@query("""SELECT flight_id, ts, max(CASE WHEN event_id % 2 = 0 THEN fl + 1 ELSE fl END) AS flight_level FROM pos GROUP BY flight_id, ts""", P)
def k3_upsert_positions(spark, sf):
    rows = demo.positions(spark, sf).select("flight_id", F.col("ts"), "event_id", "flight_level")
    old = rows.groupBy("flight_id", "ts").agg(F.max(F.when(F.col("event_id") % 2 != 0, F.col("flight_level"))).alias("flight_level")).filter("flight_level is not null")
    both = rows.groupBy("flight_id", "ts").agg(F.max(F.when(F.col("event_id") % 2 == 0, F.col("flight_level") + 1).otherwise(F.col("flight_level"))).alias("flight_level"))
    return snapshots.upsert_positions(old, both).select("flight_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "flight_level")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS flight_id, user_id % 10 <> 7 AND user_id % 3 <> 1 AS active FROM events")
def k4_j15_deactivate_missing(spark, sf):
    all_ = demo.flights(spark, sf)
    missing = snapshots.missing_flights(all_, all_.filter(F.col("flight_id").cast("long") % 3 != 1).select("flight_id"))
    return snapshots.deactivate_missing(all_, missing).select("flight_id", "active")


@query("SELECT id, active AND CAST(flight_id_1 AS BIGINT) % 3 <> 1 AND CAST(flight_id_2 AS BIGINT) % 3 <> 1 AS active FROM ev", demo.EVENTS_SQL)
def k5_archive_events(spark, sf):
    rows = demo.conflict_events(spark, sf)
    ids = rows.select(F.explode(F.array("flight_id_1", "flight_id_2")).alias("flight_id")).distinct()
    return snapshots.archive_events(rows, ids.filter(F.col("flight_id").cast("long") % 3 == 1)).select("id", "active")


@query("""SELECT flight_id, min(ts) AS start, max(ts) AS "end", count(*) AS samples FROM (SELECT *, sum(g) OVER (PARTITION BY flight_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY flight_id ORDER BY ts, event_id)) <= 21600000000 THEN 0 ELSE 1 END AS g FROM pos)) GROUP BY flight_id, s""", P)  # fmt: skip
def r4_activity_sessions(spark, sf):
    rows = snapshots.activity_sessions(demo.positions(spark, sf), 6 * 3600, "ts")
    return rows.select("flight_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "samples")


_TICKS = "b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), tick AS (SELECT n, least(lo + to_hours(CAST(n * 12 AS INT)), hi) AS tick FROM b, unnest(range(0, CAST(ceil((epoch_us(hi) - epoch_us(lo)) / 43200000000.0) AS BIGINT) + 1)) u(n))"


@query("""SELECT n, flight_id, event_id FROM (SELECT n, flight_id, event_id, row_number() OVER (PARTITION BY n, flight_id ORDER BY ts DESC, event_id DESC) AS rn FROM tick JOIN pos ON ts <= tick AND epoch_us(ts) > epoch_us(tick) - 43230000000) WHERE rn = 1""", P, _TICKS)
def r1_r2_replay_ticks(spark, sf):
    rows = demo.positions(spark, sf).withColumnRenamed("ts", "sample_time")
    at = replay.ticks(trajectories.dataset_bounds(rows), 12 * 3600)
    return replay.snapshots(rows, at, 12 * 3600, 30, ("sample_time", "event_id")).select("n", "flight_id", "event_id")


# Events


@query("SELECT id, detected_at FROM ev WHERE active", demo.EVENTS_SQL)
def f5_t1_active_events(spark, sf):
    return events.active_by_detection(demo.conflict_events(spark, sf)).select("id", F.col("detected_at").cast("timestamp_ntz").alias("detected_at"))


@query("SELECT id, CAST(row_number() OVER (PARTITION BY least(flight_id_1, flight_id_2), greatest(flight_id_1, flight_id_2) ORDER BY remaining NULLS LAST, id) AS INT) AS rank FROM ev WHERE active", demo.EVENTS_SQL)
def f6_t2_pair_events(spark, sf):
    return events.of_pair(demo.conflict_events(spark, sf)).select("id", "rank")


@query("SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(0.3e0 + 0.7e0 * least(1e0, greatest(0e0, 1 - coalesce(remaining, 0.5e0) / 0.5e0)), 6) AS intensity FROM ev WHERE lat IS NOT NULL", demo.EVENTS_SQL)
def e2_heat_points(spark, sf):
    return events.heat_points(demo.conflict_events(spark, sf)).select("id", *r6(lat=F.col("lat"), lon=F.col("lon"), intensity=F.col("intensity")))


@query("SELECT DISTINCT flight_id FROM (SELECT flight_id_1 AS flight_id FROM ev WHERE active UNION ALL SELECT flight_id_2 FROM ev WHERE active)", demo.EVENTS_SQL)
def j16_flights_in_conflict(spark, sf):
    return events.flights_in_conflict(demo.conflict_events(spark, sf))


@query("SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY flight_id_1, flight_id_2 ORDER BY detected_at, id) AS rn FROM ev WHERE active AND lat IS NOT NULL) WHERE rn = 1", demo.EVENTS_SQL)
def e3_circle_per_pair(spark, sf):
    return events.circle_per_pair(demo.conflict_events(spark, sf)).select("id")


_PRED = """pd AS (SELECT flight_id_1, flight_id_2, CAST(row_number() OVER (PARTITION BY least(flight_id_1, flight_id_2), greatest(flight_id_1, flight_id_2) ORDER BY id) AS INT) AS ordinal, coalesce(lat, 45e0) + 0.1e0 AS lat, coalesce(lon, 5e0) AS lon, coalesce(remaining, 0) AS remaining FROM ev)"""


@query(f"""SELECT flight_id_1, flight_id_2, ordinal, id AS event_id FROM (SELECT p.*, e.id, row_number() OVER (PARTITION BY least(p.flight_id_1, p.flight_id_2), greatest(p.flight_id_1, p.flight_id_2), ordinal ORDER BY e.remaining NULLS LAST, e.id NULLS LAST) AS rn
  FROM pd p LEFT JOIN ev e ON e.active AND least(p.flight_id_1, p.flight_id_2) = least(e.flight_id_1, e.flight_id_2) AND greatest(p.flight_id_1, p.flight_id_2) = greatest(e.flight_id_1, e.flight_id_2) AND {hav_nm('p.lat', 'p.lon', 'e.lat', 'e.lon')} < 15) WHERE rn = 1""", demo.EVENTS_SQL, _PRED)  # fmt: skip
def e1_j14_match_events(spark, sf):
    return events.match_events(_predictions(spark, sf), demo.conflict_events(spark, sf)).select("flight_id_1", "flight_id_2", "ordinal", "event_id")


def _predictions(spark, sf) -> DataFrame:
    """A prediction for every event."""
    rows = demo.conflict_events(spark, sf)
    w = Window.partitionBy(events.pair_key(F.col("flight_id_1"), F.col("flight_id_2"))).orderBy("id")
    zero = F.lit(0.0)
    return rows.select("flight_id_1", "flight_id_2", F.row_number().over(w).alias("ordinal"), (F.coalesce("middle_point_lat", F.lit(45.0)) + 0.1).alias("middle_lat"), F.coalesce("middle_point_lon", F.lit(5.0)).alias("middle_lon"), zero.alias("horizontal_nm"), zero.alias("vertical_nm"), F.coalesce("remaining_time", zero).alias("remaining_time"))


# Recorder and imports


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN CAST(event_id % 500 AS INT) WHEN event_id % 2000 >= 1000 THEN CAST((event_id % 2000) // 100 AS INT) ELSE CAST(event_id % 2000 AS INT) END AS level,
  strftime(ts, '%Y-%m-%d_%H') AS hour FROM events""")  # fmt: skip
def x8_k10_levels_hours(spark, sf):
    from skylane.sources.sinks import hour_of_cycle

    e = F.col("event_id")
    text = F.when(e % 5 == 0, "x1").when(e % 3 == 0, (e % 500).cast("string")).otherwise((e % 2000).cast("string"))
    unit = F.when(e % 3 == 0, "A").otherwise("F")
    return demo._table(spark, sf, "events").select("event_id", parsing.level_from(unit, text).alias("level"), hour_of_cycle(F.col("ts").cast("timestamp")).alias("hour"))


@query("""SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY ts, user_id ORDER BY CASE event_type WHEN 'LK' THEN 1 ELSE 0 END, event_id) AS rn FROM events) WHERE rn = 1""")
def a8_first_of_each_flight(spark, sf):
    from skylane.sources.navdata import first_of_each_flight

    rows = demo._table(spark, sf, "events").select("event_id", F.col("ts").alias("sample_time"), F.col("user_id").alias("flight_id"), F.lit("ED").alias("airspace"), F.col("event_id").alias("pos"))
    return first_of_each_flight(rows, ["ED", "LK"]).select("event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def n1_json_positions(spark, sf):
    from skylane.sources.sinks import positions_from_json

    rows = demo._table(spark, sf, "events").select(F.concat(F.lit('{"flight_id":"'), F.col("event_id").cast("string"), F.lit('","p":'), F.col("props"), F.lit("}")).alias("value"))
    return positions_from_json(rows, "flight_id string, p struct<k:int>").select(F.col("flight_id").cast("long").alias("event_id"), "p.k")


@query("SELECT event_id, 'A' || CAST(event_id % 5 AS VARCHAR) || ' DCT B' AS route FROM events")
def n2_x10_json_names(spark, sf):
    e = (F.col("event_id") % 5).cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["A'), e, F.lit('", " ", "B "]'))).otherwise(F.concat(F.lit('[{"name": "A'), e, F.lit('"}, {"name": "B"}]')))
    return demo._table(spark, sf, "events").select("event_id", parsing.route_text(parsing.json_names(text)).alias("route"))


def _found(rows: DataFrame) -> DataFrame:
    c = F.col("conflict")
    return rows.select("flight_id_1", "flight_id_2", *r6(horizontal_nm=c["horizontal_nm"], vertical_nm=c["vertical_nm"], entry_h=c["entry_h"], cpa_h=c["cpa_h"]))


@query()
def c3_detect(spark, sf):
    """The whole detection in busy traffic, at the flights' own times: half of the flights have plans, so pairs have two, one or none."""
    from .detection import detect_among

    rows = demo.traffic(spark, sf).withColumn("route", F.when(F.col("user_id") % 2 == 0, F.lit("filed")))
    return _found(detect_among(rows, demo.traffic_plans(spark, sf), 0.25, mode="sphere"))


def _aligned(i: int) -> str:
    h, late = f"((epoch_us(greatest(ts_1, ts_2)) - epoch_us(ts_{i})) / 3.6e9)", f"abs(epoch_us(ts_1) - epoch_us(ts_2)) > 10000000 AND ts_{i} < greatest(ts_1, ts_2)"
    return f"""CASE WHEN {late} THEN lat_{i} + degrees(knots_{i} * cos(radians(track_{i})) * {h} * 1.852e0 / 6371e0) ELSE lat_{i} END AS lat_{i},
  CASE WHEN {late} THEN lon_{i} + degrees(knots_{i} * sin(radians(track_{i})) * {h} * 1.852e0 / (6371e0 * cos(radians(lat_{i})))) ELSE lon_{i} END AS lon_{i},
  CASE WHEN {late} THEN CAST(round_even(level_{i} + fpm_{i} * 60 / (1852e0 / 0.3048e0) * {h} * 1.852e0 / 0.03048e0, 0) AS INT) ELSE level_{i} END AS level_{i}"""


_TRAFFIC_PAIRS = f"""p0 AS (SELECT a.flight_id AS flight_id_1, b.flight_id AS flight_id_2, a.lat AS lat_1, a.lon AS lon_1, a.fl AS level_1, a.gs AS knots_1, a.trk AS track_1, a.vs AS fpm_1, a.ts AS ts_1,
  b.lat AS lat_2, b.lon AS lon_2, b.fl AS level_2, b.gs AS knots_2, b.trk AS track_2, b.vs AS fpm_2, b.ts AS ts_2 FROM traffic a JOIN traffic b ON a.flight_id < b.flight_id AND {_NM} / (a.gs + b.gs) <= 0.25),
pr AS (SELECT * REPLACE ({_aligned(1)}, {_aligned(2)}) FROM p0)"""


@query("""SELECT flight_id_1, flight_id_2, round(sqrt(pow(rx + vx * t, 2) + pow(ry + vy * t, 2)), 6) AS horizontal_nm, round(rz + vz * t, 6) + 0 AS vertical_nm, round(t0, 6) + 0 AS entry_h, round(t, 6) + 0 AS cpa_h FROM rel
  WHERE hit AND vv >= 1e-10 AND t >= 0 AND t0 <= 0.25 AND sqrt(pow(rx + vx * t, 2) + pow(ry + vy * t, 2)) < 5 AND abs(rz + vz * t) < 950 * 0.3048e0 / 1852e0 AND isfinite(t0) AND isfinite(t1)""", P, L, demo.TRAFFIC_SQL, _TRAFFIC_PAIRS, _REL)  # fmt: skip
def c3_straight_conflicts(spark, sf):
    """The detection in busy traffic without plans: flights are moved to a common time and fly straight on."""
    from .detection import near_states

    rows = demo.traffic(spark, sf).withColumn("route", F.lit(None).cast("string"))
    return _found(conflicts.detect_without_route(near_states(rows, 0.25, mode="sphere")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j2_blocking_pairs_spheroid(spark, sf_dir)

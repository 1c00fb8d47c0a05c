"""Deterministic projections of the driver's tables onto flights, plans, events and navigation points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same as positions(), for SQL.
POSITIONS_SQL = """pos AS (SELECT event_id, CAST(user_id AS VARCHAR) AS flight_id, user_id, ts,
  45e0 + ((user_id * 37) % 1000) / 100e0 + (event_id % 100) / 1000e0 AS lat, 5e0 + ((user_id * 53) % 1500) / 100e0 + (event_id % 100) / 1000e0 AS lon,
  CAST(200 + (event_id * 7) % 300 AS INT) AS gs, CAST((event_id * 13) % 360 AS INT) AS trk, CAST(60 + (event_id * 11) % 350 AS INT) AS fl,
  CAST(((event_id * 17) % 4000) - 2000 AS INT) AS vs FROM events)"""
GAPS_SQL = """gap AS (SELECT event_id, flight_id, ts, CASE WHEN event_id % 4 <> 0 THEN lat END AS lat, CASE WHEN event_id % 5 <> 0 THEN lon END AS lon,
  CASE WHEN event_id % 7 <> 0 THEN fl END AS fl FROM pos)"""
LATEST_SQL = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY ts DESC, event_id DESC) AS rn FROM pos WHERE fl > 60) WHERE rn = 1)"""
PLANS_SQL = """plan AS (SELECT flight_id, user_id, CAST(row_number() OVER (PARTITION BY flight_id ORDER BY ts, event_id) - 1 AS INT) AS idx, event_id, lat + (event_id % 7) * 0.3e0 AS lat,
  lon + (event_id % 11) * 0.2e0 AS lon, CAST(300 + (event_id * 3) % 200 AS INT) AS tas, CAST(300 + (event_id % 3) * 10 AS INT) AS level FROM pos)"""
STATES_SQL = """st AS (SELECT flight_id, user_id, lat + 0.05e0 AS lat, lon + 0.02e0 AS lon, fl AS level, gs AS knots, vs AS fpm FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY ts, event_id) AS rn FROM pos) WHERE rn = 1)"""
EVENTS_SQL = """ev AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS flight_id_1, CAST((user_id * 7 + 1) % 20 AS VARCHAR) AS flight_id_2, ts AS detected_at,
  CASE WHEN event_id % 9 <> 0 THEN 45e0 + (event_id % 40) / 20e0 END AS lat, CASE WHEN event_id % 9 <> 0 THEN 5e0 + (event_id % 30) / 20e0 END AS lon,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 60) / 100e0 END AS remaining, event_id % 3 <> 0 AS active FROM events)"""
#: Each user's latest sample moved into a small, busy space, within a minute and a half of one moment.
TRAFFIC_SQL = """traffic AS (SELECT flight_id, user_id, TIMESTAMP '2024-01-15 00:00:00' + to_seconds(event_id % 90) AS ts, 49e0 + (user_id * 37 % 100) / 100e0 AS lat, 14e0 + (user_id * 53 % 150) / 100e0 AS lon,
  gs, trk, CAST(300 + user_id % 3 * 10 AS INT) AS fl, CASE WHEN user_id % 4 = 0 THEN 0 ELSE vs END AS vs FROM latest)"""
POINTS_SQL = """pts AS (SELECT p_partkey AS id, 'W' || CAST(p_partkey % 50 AS VARCHAR) AS name, CASE WHEN p_partkey % 13 <> 0 THEN 44e0 + (p_partkey * 31 % 900) / 100e0 END AS lat,
  CASE WHEN p_partkey % 13 <> 0 THEN 4e0 + (p_partkey * 17 % 1700) / 100e0 END AS lon FROM part)"""
NAVS_SQL = """nav AS (SELECT s_suppkey AS id, 'W' || CAST(s_suppkey % 60 AS VARCHAR) AS name, 44e0 + (s_suppkey * 41 % 900) / 100e0 AS lat, 4e0 + (s_suppkey * 23 % 1700) / 100e0 AS lon FROM supplier)"""
ASKED_SQL = """asked AS (SELECT event_id, 'W' || CAST(event_id % 70 AS VARCHAR) AS name, lat, lon FROM pos)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    u = F.col("user_id")
    step = (e % 100) / F.lit(1000.0)
    return _table(spark, sf_dir, "events").select(
        "event_id", u.cast("string").alias("flight_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"),
        (45.0 + ((u * 37) % 1000) / F.lit(100.0) + step).alias("lat"), (5.0 + ((u * 53) % 1500) / F.lit(100.0) + step).alias("lon"),
        (200 + (e * 7) % 300).cast("int").alias("ground_speed_kt"), ((e * 13) % 360).cast("int").alias("track_heading"),
        (60 + (e * 11) % 350).cast("int").alias("flight_level"), ((e * 17) % 4000 - 2000).cast("int").alias("vertical_rate_fpm"),
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with missing values."""
    e = F.col("event_id")
    known = lambda c, n: F.when(e % n != 0, F.col(c)).alias(c)
    return positions(spark, sf_dir).select("event_id", "flight_id", F.col("ts").alias("sample_time"), F.col("ts").alias("time_over"), known("lat", 4), known("lon", 5), known("flight_level", 7))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each user: active unless the number ends in 7."""
    return _table(spark, sf_dir, "events").select("user_id").distinct().select(F.col("user_id").cast("string").alias("flight_id"), F.lit("A320").alias("aircraft_type"), F.lit("LKPR").alias("origin"), F.lit("EDDM").alias("destination"), (F.col("user_id") % 10 != 7).alias("active"))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skylane.operators.blocking import can_conflict, latest_per_flight

    return latest_per_flight(can_conflict(positions(spark, sf_dir)), ("ts", "event_id"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flight's samples as its plan's waypoints."""
    from pyspark.sql import Window

    e = F.col("event_id")
    w = Window.partitionBy("flight_id").orderBy("ts", "event_id")
    rows = positions(spark, sf_dir).withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
    return rows.select("flight_id", "user_id", "idx", F.concat(F.lit("P"), e.cast("string")).alias("ident"), (F.col("lat") + (e % 7) * 0.3).alias("lat"), (F.col("lon") + (e % 11) * 0.2).alias("lon"), (300 + (e * 3) % 200).cast("int").alias("tas"), (300 + (e % 3) * 10).cast("int").alias("level"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flight near its first sample."""
    from pyspark.sql import Window

    w = Window.partitionBy("flight_id").orderBy("ts", "event_id")
    rows = positions(spark, sf_dir).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return rows.select("flight_id", "user_id", (F.col("lat") + 0.05).alias("lat"), (F.col("lon") + 0.02).alias("lon"), F.col("flight_level").alias("level"), F.col("ground_speed_kt").alias("knots"), F.col("vertical_rate_fpm").alias("fpm"))


def candidates(spark: SparkSession, sf_dir: str, threshold_h: float, max_skew_s: float) -> DataFrame:
    """The pairs of flights that blocking finds among latest positions."""
    from skylane.operators.blocking import candidate_pairs

    return candidate_pairs(latest(spark, sf_dir), threshold_h, max_skew_s, "sphere").select("flight_id_1", "flight_id_2")


#: What a flight carries to its pairs.
STATE = ("lat", "lon", "level", "knots", "track", "fpm", "ts")


def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("*", F.col("flight_level").alias("level"), F.col("ground_speed_kt").alias("knots"), F.col("track_heading").alias("track"), F.col("vertical_rate_fpm").alias("fpm"))


def state_pairs(spark: SparkSession, sf_dir: str, threshold_h: float, max_skew_s: float) -> DataFrame:
    """Both flights' latest states for every pair that blocking finds."""
    from skylane.operators.blocking import candidate_pairs

    return candidate_pairs(latest_states(spark, sf_dir), threshold_h, max_skew_s, "sphere", STATE).drop("distance_nm", "time_to_meeting_hours")


def near_states(spark: SparkSession, sf_dir: str, threshold_h: float, max_skew_s: float, until: float | None = None) -> DataFrame:
    """The same for those of the pairs that may come near, by until hours if that is told."""
    from skylane.operators.near_pairs import near_candidates

    return near_candidates(latest_states(spark, sf_dir), threshold_h, max_skew_s, "sphere", STATE, until).drop("distance_nm", "time_to_meeting_hours")


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest sample moved into a small, busy space, within a minute and a half of one moment."""
    u = F.col("user_id")
    return latest(spark, sf_dir).select(
        "flight_id", "user_id", (F.lit("2024-01-15 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id") % 90)).alias("ts"), (49.0 + (u * 37 % 100) / F.lit(100.0)).alias("lat"), (14.0 + (u * 53 % 150) / F.lit(100.0)).alias("lon"),
        "ground_speed_kt", "track_heading", (300 + u % 3 * 10).cast("int").alias("flight_level"), F.when(u % 4 == 0, 0).otherwise(F.col("vertical_rate_fpm")).cast("int").alias("vertical_rate_fpm"),
    )


def traffic_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each flight of the traffic a plan along its track that begins behind it, turns a little and changes its level."""
    rows = traffic(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("idx"))
    k, u, at = F.col("idx"), F.col("user_id"), F.radians("track_heading")
    ahead, turn = (k - 1) * 0.4, k * k * (u % 5 - 2) * 0.01
    return rows.select(
        "flight_id", "idx", F.concat(F.lit("P"), u.cast("string"), k.cast("string")).alias("ident"), (F.col("lat") + ahead * F.cos(at) + turn).alias("lat"), (F.col("lon") + 1.5 * ahead * F.sin(at) - turn).alias("lon"),
        F.col("ground_speed_kt").alias("tas"), (F.col("flight_level") + F.when(k > 2, u % 2 * 10).otherwise(0)).cast("int").alias("level"),
    )


def conflict_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    placed = e % 9 != 0
    return _table(spark, sf_dir, "events").select(
        e.alias("id"), u.cast("string").alias("flight_id_1"), ((u * 7 + 1) % 20).cast("string").alias("flight_id_2"), F.col("ts").cast("timestamp").alias("detected_at"), F.col("ts").cast("timestamp").alias("last_checked"),
        F.when(placed, 45.0 + (e % 40) / F.lit(20.0)).alias("middle_point_lat"), F.when(placed, 5.0 + (e % 30) / F.lit(20.0)).alias("middle_point_lon"),
        F.lit(0.0).alias("horizontal_distance"), F.lit(0.0).alias("vertical_distance"), F.when(e % 5 != 0, (e % 60) / F.lit(100.0)).alias("remaining_time"), (e % 3 != 0).alias("active"),
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("W"), (k % 50).cast("string")).alias("identificator"), F.when(k % 13 != 0, 44.0 + (k * 31 % 900) / F.lit(100.0)).alias("lat"), F.when(k % 13 != 0, 4.0 + (k * 17 % 1700) / F.lit(100.0)).alias("lon"))


def navaids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("W"), (k % 60).cast("string")).alias("identificator"), (44.0 + (k * 41 % 900) / F.lit(100.0)).alias("lat"), (4.0 + (k * 23 % 1700) / F.lit(100.0)).alias("lon"))


def asked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named point for every position."""
    return positions(spark, sf_dir).select("event_id", F.concat(F.lit("W"), (F.col("event_id") % 70).cast("string")).alias("ident"), "lat", "lon")

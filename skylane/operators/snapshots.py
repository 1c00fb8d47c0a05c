"""Latest positions, snapshots at a time, and the tables that a replay keeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocking import latest_per_flight

COMPLETE = ("lat", "lon", "flight_level", "ground_speed_kt", "track_heading")


def all_known(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).isNotNull()
    return out


def latest_complete_with_flight(positions: DataFrame, flights: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Filter, then pick: the last position with complete kinematics of every flight, with the flight's columns."""
    return latest_per_flight(positions.filter(all_known(COMPLETE)), order).join(flights, "flight_id")


def latest_of_flight(positions: DataFrame, flights: DataFrame, flight_id: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The same for one flight: both tables are filtered by its id where they are read."""
    only = F.col("flight_id") == flight_id
    return latest_complete_with_flight(positions.filter(only), flights.filter(only), order)


def by_flight(snapshots: DataFrame) -> DataFrame:
    """Snapshots in the order of their flights' ids."""
    return snapshots.orderBy("flight_id")


def flight_ids(samples: DataFrame) -> DataFrame:
    """The distinct ids, in order."""
    return samples.select("flight_id").filter("flight_id is not null").distinct().orderBy("flight_id")


def reset(*tables: DataFrame) -> list[DataFrame]:
    """The tables without rows, to overwrite them with."""
    return [t.limit(0) for t in tables]


def latest_then_validate(positions: DataFrame, order: tuple[str, ...] = ("ts",), columns: Sequence[str] = (*COMPLETE, "ts")) -> DataFrame:
    """Pick, then filter: a flight whose last position is incomplete has none."""
    return latest_per_flight(positions, order).filter(all_known(columns))


def snapshot_at(samples: DataFrame, tick: Column, window_s: float = 5, grace_s: float = 30, time: str = "sample_time", order: tuple[str, ...] | None = None) -> DataFrame:
    """The last sample of every flight in (tick - window - grace, tick]; rows without a position don't count."""
    since = tick - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(window_s + grace_s)))
    rows = samples.filter((F.col(time) > since) & (F.col(time) <= tick) & all_known(("lat", "lon")))
    return latest_per_flight(rows, order or (time,))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of the same key, nulls included; other rows stay. Repeated source keys keep the largest row."""
    rest = [c for c in target.columns if c not in keys]
    tagged = target.select(*keys, F.lit(0).alias("_tag"), *rest).unionByName(source.select(*keys, F.lit(1).alias("_tag"), *rest))
    return tagged.groupBy(*keys).agg(F.max(F.struct("_tag", *rest)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert_flights(flights: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Flights of the snapshot are set, and active."""
    source = snapshot.select("flight_id", "aircraft_type", "origin", "destination").withColumn("active", F.lit(True))
    return upsert(flights.select(*source.columns), source, ["flight_id"])


def upsert_positions(positions: DataFrame, snapshot: DataFrame) -> DataFrame:
    return upsert(positions, snapshot, ["flight_id", "ts"])


def missing_flights(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.select("flight_id").distinct().join(current, "flight_id", "left_anti")


def deactivate_missing(flights: DataFrame, missing: DataFrame) -> DataFrame:
    gone = missing.select("flight_id", F.lit(True).alias("_gone"))
    return flights.join(gone, "flight_id", "left").withColumn("active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("active"))).drop("_gone")


def archive_events(events: DataFrame, missing: DataFrame) -> DataFrame:
    """Active events that touch a missing flight on either side become inactive."""
    for side in ("flight_id_1", "flight_id_2"):
        gone = missing.select(F.col("flight_id").alias(side), F.lit(True).alias("_gone"))
        events = events.join(gone, side, "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")
    return events


def insert_absent(flights: DataFrame, seen: DataFrame) -> DataFrame:
    """Flights that aren't in the table yet are added, active."""
    new = seen.dropDuplicates(["flight_id"]).join(flights, "flight_id", "left_anti").withColumn("active", F.lit(True))
    return flights.unionByName(new.select(*flights.columns))


def live_positions(payload: DataFrame, now: Column) -> DataFrame:
    """Positions to append for a live payload: ts is now, the wind is unpacked, and names of the plan's waypoints are kept.

    payload: flight_id, lat, lon, flight_level, speed, heading, track_heading, vertical_speed, target_flight_level,
    route_string, wind (struct of heading, speed, lat, lon, altitude) and flight_plan (array of structs with a name).
    """
    names = F.filter(F.transform("flight_plan", lambda w: w["name"]), lambda n: n.isNotNull() & (n != ""))
    wind = [F.col(f"wind.{c}").alias(f"wind_{c}") for c in ("heading", "speed", "lat", "lon", "altitude")]
    return payload.select(
        "flight_id", now.alias("ts"), "lat", "lon", "flight_level", F.col("speed").alias("ground_speed_kt"), "heading", "track_heading",
        F.coalesce(F.col("vertical_speed").cast("int"), F.lit(0)).alias("vertical_rate_fpm"), F.lit("").alias("sector_id"), F.col("route_string").alias("route"),
        "target_flight_level", *wind, names.alias("flight_plan_json"),
    )


def flight_details(latest: DataFrame) -> DataFrame:
    """Altitude in feet, and the wind, which is still and at the aircraft unless both heading and speed are known."""
    known = F.col("wind_heading").isNotNull() & F.col("wind_speed").isNotNull()
    pick = lambda c, other: F.when(known, F.col(c)).otherwise(other)
    return latest.select(
        "flight_id", "lat", "lon", (F.col("flight_level") * 100).alias("altitude_ft"), "ground_speed_kt", "track_heading",
        pick("wind_heading", F.lit(0.0)).alias("wind_heading"), pick("wind_speed", F.lit(0.0)).alias("wind_speed"),
        pick("wind_lat", F.col("lat")).alias("wind_lat"), pick("wind_lon", F.col("lon")).alias("wind_lon"),
        F.when(known, F.col("wind_altitude")).otherwise(F.col("flight_level") * 100).alias("wind_altitude"),
    )


def activity_sessions(samples: DataFrame, gap_s: float = 35, time: str = "sample_time") -> DataFrame:
    """Spans in which a flight was seen at least every gap_s seconds: start, end, number of samples."""
    return (
        samples.groupBy("flight_id", F.session_window(time, f"{int(gap_s * 1e6) + 1} microseconds").alias("w"))
        .agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("samples"))
        .drop("w")
    )

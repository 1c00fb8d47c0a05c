"""Conflict events: reconciliation with predictions, and what maps show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.functions.geo import haversine_nm, heat_intensity

from .staging import staged

SAME_NM = 15.0


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def active_by_detection(events: DataFrame, active_only: bool = True) -> DataFrame:
    rows = events.filter("active") if active_only else events
    return rows.orderBy(F.desc_nulls_first("detected_at"), "id")


def of_pair(events: DataFrame, active: bool = True) -> DataFrame:
    """Events with their rank among those of their unordered pair, by remaining time, nulls last."""
    w = Window.partitionBy(pair_key(F.col("flight_id_1"), F.col("flight_id_2"))).orderBy(F.asc_nulls_last("remaining_time"), "id")
    return events.filter(F.col("active") == active).withColumn("rank", F.row_number().over(w))


def match_events(predicted: DataFrame, events: DataFrame) -> DataFrame:
    """predicted with event_id: the active event of its pair whose middle is within SAME_NM and whose remaining time is least.

    predicted: flight_id_1, flight_id_2, ordinal (of the pair's predictions), middle_lat, middle_lon and further columns.
    """
    keyed = predicted.withColumn("_k", pair_key(F.col("flight_id_1"), F.col("flight_id_2")))
    open_ = events.filter("active").select(pair_key(F.col("flight_id_1"), F.col("flight_id_2")).alias("_k"), F.struct(F.col("remaining_time").isNull().alias("none"), "remaining_time", "id").alias("e"), F.col("middle_point_lat").alias("_lat"), F.col("middle_point_lon").alias("_lon"))
    near = keyed.select("_k", "ordinal", "middle_lat", "middle_lon").join(open_, "_k").filter(haversine_nm(F.col("middle_lat"), F.col("middle_lon"), F.col("_lat"), F.col("_lon")) < SAME_NM)
    best = near.groupBy("_k", "ordinal").agg(F.min("e").alias("e")).select("_k", "ordinal", F.col("e.id").alias("event_id"))
    return keyed.join(best, ["_k", "ordinal"], "left").drop("_k")


def reconcile(predicted: DataFrame, events: DataFrame, checked: DataFrame, now: Column, compat: bool = False) -> DataFrame:
    """The event table after predictions of the checked pairs.

    A prediction that matches an active event updates it (of several, the last by ordinal), any other makes a new one; active events of
    checked pairs that nothing matched are archived. New ids follow the greatest one, by pair and ordinal. With compat, an
    unmatched prediction makes no event where its pair has an active one.
    """
    matched = match_events(predicted, events)
    values = ("middle_lat", "middle_lon", "horizontal_nm", "vertical_nm", "remaining_time")
    names = ("middle_point_lat", "middle_point_lon", "horizontal_distance", "vertical_distance", "remaining_time")
    updates = matched.filter("event_id is not null").groupBy("event_id").agg(F.max(F.struct("ordinal", *values)).alias("u"))
    pairs = checked.select(pair_key(F.col("flight_id_1"), F.col("flight_id_2")).alias("_k")).distinct().withColumn("_checked", F.lit(True))
    rows = events.withColumn("_k", pair_key(F.col("flight_id_1"), F.col("flight_id_2"))).join(updates.withColumnRenamed("event_id", "id"), "id", "left").join(pairs, "_k", "left")
    touched = F.col("u").isNotNull()
    rows = rows.withColumns({n: F.when(touched, F.col(f"u.{v}")).otherwise(F.col(n)) for n, v in zip(names, values, strict=True)})
    rows = rows.withColumns({"last_checked": F.when(touched, now).otherwise(F.col("last_checked")), "active": F.when(~touched & F.col("_checked") & F.col("active"), F.lit(False)).otherwise(F.col("active"))})
    fresh = matched.filter("event_id is null")
    if compat:
        busy = events.filter("active").select(pair_key(F.col("flight_id_1"), F.col("flight_id_2")).alias("_k")).distinct()
        fresh = fresh.withColumn("_k", pair_key(F.col("flight_id_1"), F.col("flight_id_2"))).join(busy, "_k", "left_anti")
    top = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = _numbered(fresh, ("flight_id_1", "flight_id_2", "ordinal")).crossJoin(F.broadcast(top))  # one row
    new = numbered.select((F.col("_top") + F.col("_n")).cast("long").alias("id"), "flight_id_1", "flight_id_2", now.alias("detected_at"), now.alias("last_checked"), *[F.col(v).alias(n) for n, v in zip(names, values, strict=True)], F.lit(True).alias("active"))
    columns = ["id", "flight_id_1", "flight_id_2", "detected_at", "last_checked", *names, "active"]
    return rows.select(*columns).unionByName(new.select(*columns))


def _numbered(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Adds _n, 1 and up in order, without bringing all rows together: ranges, their sizes, and numbers within.

    Ranges come from a sample that every run draws anew, so rows are written with theirs before they are counted.
    """
    ranged = staged(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    within = ranged.withColumn("_w", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ranged.groupBy("_p").count()  # a row for each range
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return within.join(before, "_p").withColumn("_n", F.col("_w") + F.col("_b")).drop("_p", "_w", "_b")


def flights_in_conflict(events: DataFrame) -> DataFrame:
    """Flights on either side of an active event."""
    return events.filter("active").select(F.explode(F.array("flight_id_1", "flight_id_2")).alias("flight_id")).distinct()


def heat_points(events: DataFrame) -> DataFrame:
    """Place and intensity of every event, active or not, that has a place."""
    placed = events.filter(F.col("middle_point_lat").isNotNull() & F.col("middle_point_lon").isNotNull())
    return placed.select("id", F.col("middle_point_lat").alias("lat"), F.col("middle_point_lon").alias("lon"), heat_intensity(F.col("remaining_time")).alias("intensity"))


def circle_per_pair(events: DataFrame) -> DataFrame:
    """The earliest active event with a place of every ordered pair."""
    placed = events.filter(F.col("active") & (F.coalesce("middle_point_lat", F.lit(0.0)) != 0) & (F.coalesce("middle_point_lon", F.lit(0.0)) != 0))
    w = Window.partitionBy("flight_id_1", "flight_id_2").orderBy("detected_at", "id")
    return placed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def conflict_items(events: DataFrame) -> DataFrame:
    """Active events as a client shows them: the vertical distance in feet."""
    return events.filter("active").select("id", "flight_id_1", "flight_id_2", "middle_point_lat", "middle_point_lon", "horizontal_distance", (F.col("vertical_distance") * 6076.12).alias("vertical_distance_ft"), "remaining_time")


def conflict_segments(events: DataFrame) -> DataFrame:
    """A row for each flight of an active event: entry and exit, where all four are known."""
    side = lambda i: F.struct(F.col(f"flight_id_{i}").alias("flight_id"), *[F.col(f"flight_{i}_conflict_{e}_{c}").alias(f"{e}_{c}") for e in ("entry", "exit") for c in ("lat", "lon")])
    rows = events.filter("active").select("id", F.explode(F.array(side(1), side(2))).alias("s")).select("id", "s.*")
    return rows.filter("entry_lat is not null and entry_lon is not null and exit_lat is not null and exit_lon is not null")


def events_from(conflicts: DataFrame, now: Column) -> DataFrame:
    """Conflicts as predictions: an ordinal within the pair, by entry time."""
    w = Window.partitionBy("flight_id_1", "flight_id_2").orderBy("conflict.entry_h", "conflict.cpa_h")
    return conflicts.select("flight_id_1", "flight_id_2", F.row_number().over(w).alias("ordinal"), F.col("conflict.middle.lat").alias("middle_lat"), F.col("conflict.middle.lon").alias("middle_lon"), "conflict.horizontal_nm", "conflict.vertical_nm", F.col("conflict.entry_h").alias("remaining_time"), now.alias("detected_at"))



"""Gap filling and kinematics of recorded trajectories, as window projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.functions.geo import FOOT_M, bearing, haversine_km

POSITION = ("lat", "lon", "flight_level")


def _complete(columns: tuple[str, ...] = POSITION) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).isNotNull()
    return out


def _by_time(order: tuple[str, ...]) -> Window:
    return Window.partitionBy("flight_id").orderBy(*order)


def fill_positions(samples: DataFrame, order: tuple[str, ...] = ("sample_time",)) -> DataFrame:
    """Carries the last known latitude, longitude and level of a flight forward once it has had a complete sample.

    Adds imputed: whether the row wasn't complete and became so. Values of partial samples before the first complete one
    aren't carried.
    """
    upto, before = _by_time(order).rowsBetween(Window.unboundedPreceding, 0), _by_time(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.withColumn("_whole", _complete()).withColumn("_started", F.max("_whole").over(upto))
    carried = {c: F.coalesce(F.col(c), F.when(F.col("_started"), F.last(F.when(F.col("_started"), F.col(c)), ignorenulls=True).over(before))) for c in POSITION}
    filled = rows.withColumns({f"_{c}": x for c, x in carried.items()}).withColumns({c: F.col(f"_{c}") for c in POSITION})
    return filled.withColumn("imputed", ~F.col("_whole") & _complete()).drop("_whole", "_started", *[f"_{c}" for c in POSITION])


def pairwise_kinematics(samples: DataFrame, order: tuple[str, ...] = ("sample_time",), time: str = "time_over") -> DataFrame:
    """Adds derived: ground_speed_kt, track_heading, vertical_rate_fpm and heading from the sample before, or null.

    Null without a complete pair of samples or without a positive time between them, in whole seconds.
    """
    w = _by_time(order)
    before = {f"_{c}": F.lag(c).over(w) for c in (*POSITION, time)}
    rows = samples.withColumns(before)
    exact = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col(f"_{time}").cast("timestamp"))
    seconds = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.col(f"_{time}").cast("timestamp"))
    usable = _complete() & _complete(tuple(f"_{c}" for c in POSITION)) & (exact > 0) & (seconds != 0)
    at = [F.col(c) for c in ("_lat", "_lon", "lat", "lon")]
    course = bearing(*at).cast("int")
    climb = (F.col("flight_level") - F.col("_flight_level")) * 100 * FOOT_M
    derived = F.struct(
        F.rint(F.abs(F.try_divide(haversine_km(*at), seconds / 3600)) / 1.852).cast("int").alias("ground_speed_kt"),
        course.alias("track_heading"),
        F.rint(F.try_divide(climb, seconds / 60) / FOOT_M).cast("int").alias("vertical_rate_fpm"),
        course.alias("heading"),
    )
    return rows.withColumn("derived", F.when(usable, derived)).drop(*before)


def with_kinematics(samples: DataFrame, order: tuple[str, ...] = ("sample_time",), time: str = "time_over") -> DataFrame:
    """Filled samples with kinematics; imputed and underivable rows have those of the last derived one.

    One sort by flight and time serves all windows.
    """
    rows = pairwise_kinematics(fill_positions(samples, order), order, time)
    upto = _by_time(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("derived", F.last(F.when(~F.col("imputed"), F.col("derived")), ignorenulls=True).over(upto))
    return rows.select(*[c for c in rows.columns if c not in ("derived", "ground_speed_kt", "track_heading", "vertical_rate_fpm", "heading")], "derived.*")


def legs(points: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """Consecutive points as legs: from_* and to_* latitude, longitude."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = points.withColumns({f"to_{c}": F.lead(c).over(w) for c in ("lat", "lon")}).filter(F.col("to_lat").isNotNull())
    return rows.withColumnRenamed("lat", "from_lat").withColumnRenamed("lon", "from_lon")


def dataset_bounds(samples: DataFrame, time: str = "sample_time") -> DataFrame:
    return samples.agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))

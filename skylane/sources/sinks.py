"""Tables and files that imports and recorders write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import HEADER


def replace_trajectories(rows: DataFrame, path: str) -> None:
    """Writes samples anew, in folders by day."""
    rows.withColumn("day", F.to_date("sample_time")).write.mode("overwrite").partitionBy("day").parquet(path)


def record_text(records: DataFrame) -> DataFrame:
    """Records as the ten text columns; nulls are empty."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if dict(records.dtypes)[c].startswith("timestamp") else F.col(c)
    return records.select(*[F.coalesce((iso(c) if c in HEADER[:2] else F.col(c)).cast("string"), F.lit("")).alias(c) for c in HEADER])


def hour_of_cycle(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd_HH")


def record_csv(records: DataFrame, path: str, hourly: bool = False) -> None:
    """Appends records as CSV with a header, in folders by hour if asked."""
    rows = record_text(records)
    if hourly:
        rows.withColumn("hour", hour_of_cycle(F.to_timestamp("sample_time"))).write.mode("append").partitionBy("hour").csv(path, header=True, emptyValue="", nullValue="")
    else:
        rows.write.mode("append").csv(path, header=True, emptyValue="", nullValue="")


def positions_json(rows: DataFrame) -> DataFrame:
    """key and JSON text of each row, as caches hold them."""
    return rows.select("flight_id", F.to_json(F.struct(*rows.columns)).alias("value"))


def positions_from_json(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON texts; invalid ones are left out."""
    return rows.select(F.from_json("value", schema).alias("r")).filter("r.flight_id is not null").select("r.*")

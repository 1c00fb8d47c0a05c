"""Replay of recorded samples, in batch for all ticks at once and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WINDOW_S, GRACE_S = 5.0, 30.0


def ticks(bounds: DataFrame, tick_s: float = 5.0, speed: float = 1.0) -> DataFrame:
    """(n, tick, progress) from min_time on, each tick_s * speed later, the last one at max_time; progress in percent, 100 for no span."""
    step = max(1, round(tick_s * max(1.0, speed) * 1_000_000))
    low, high = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("min_time", "max_time"))
    last = F.ceil((high - low) / step).cast("long")
    rows = bounds.select(low.alias("low"), high.alias("high"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("n"))
    at = F.least(F.col("low") + F.col("n") * step, F.col("high"))
    progress = F.coalesce(F.try_divide(100.0 * (at - F.col("low")), F.col("high") - F.col("low")), F.lit(100.0))
    return rows.select("n", F.timestamp_micros(at).alias("tick"), progress.alias("progress"))


def snapshots(samples: DataFrame, at: DataFrame, window_s: float = WINDOW_S, grace_s: float = GRACE_S, order: tuple[str, ...] = ("sample_time",)) -> DataFrame:
    """For every tick of at (n, tick), the last sample of each flight in the window and grace before it.

    Ticks and samples meet in buckets as long as the window, a tick in its own and the one before, so this is an equi-join
    whose size follows the samples.
    """
    width = int((window_s + grace_s) * 1_000_000)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = samples.filter("lat is not null and lon is not null").withColumn("_b", F.floor(micros("sample_time") / width))
    right = at.select("n", "tick").withColumn("_b", F.explode(F.array(*[F.floor(micros("tick") / width) - d for d in (0, 1)])))
    age = micros("tick") - micros("sample_time")
    rows = left.join(right, "_b").filter((age >= 0) & (age < width)).drop("_b")
    w = Window.partitionBy("n", "flight_id").orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stream_samples(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1) -> DataFrame:
    """Samples of a folder's files, so many a batch, or all that are new."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def stream_latest(samples: DataFrame, late: str = "35 seconds") -> DataFrame:
    """The last sample of each flight so far (update mode); samples later than the watermark are dropped."""
    rest = [c for c in samples.columns if c not in ("flight_id", "sample_time")]
    return samples.withWatermark("sample_time", late).groupBy("flight_id").agg(F.max(F.struct("sample_time", *rest)).alias("s")).select("flight_id", "s.*")


def stream_activity(samples: DataFrame, gap: str = "35 seconds") -> DataFrame:
    """Spans in which a flight was active; in append mode a span comes out once its flight has been gone for the gap."""
    spans = samples.withWatermark("sample_time", gap).groupBy("flight_id", F.session_window("sample_time", gap).alias("w"))
    return spans.agg(F.count("*").alias("samples")).select("flight_id", F.col("w.start").alias("start"), F.col("w.end").alias("gone"), "samples")


def start_detection(positions: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str = "35 seconds") -> StreamingQuery:
    """Runs step on each batch; step has to be idempotent by batch number, as a batch may come again."""
    return positions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

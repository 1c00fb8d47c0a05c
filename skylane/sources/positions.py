"""Recorded flight positions in CSV files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylane.functions.parsing import blank_to_null, iso_utc, to_double, to_int

# The header.
HEADER = ("sample_time", "time_over", "flight_id", "aircraft_type", "origin", "destination", "lat", "lon", "flight_level", "route_string")
NUMBERS = ("lat", "lon", "flight_level")


def typed_positions(rows: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Typed samples of text rows, and further columns; usable tells whether the row has both times and a flight."""
    typed = rows.select(
        iso_utc(F.col("sample_time")).alias("sample_time"), iso_utc(F.col("time_over")).alias("time_over"),
        *[blank_to_null(F.col(c)).alias(c) for c in ("flight_id", "aircraft_type", "origin", "destination")],
        to_double(F.col("lat")).alias("lat"), to_double(F.col("lon")).alias("lon"), to_int(F.col("flight_level")).alias("flight_level"),
        blank_to_null(F.col("route_string")).alias("route_string"), *also,
    )
    return typed.withColumn("usable", F.col("sample_time").isNotNull() & F.col("time_over").isNotNull() & F.col("flight_id").isNotNull())


def _texts(spark: SparkSession, *paths: str) -> DataFrame:
    """Fields as text of CSV files or of all CSV files of folders (not deeper ones); a header other than HEADER is an error."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in HEADER])
    for path in paths:
        head = spark.read.option("pathGlobFilter", "*.csv").text(path).limit(1).collect()
        if not head or tuple(x.strip() for x in head[0][0].split(",")) != HEADER:
            raise ValueError(f"{path}: the header isn't {','.join(HEADER)}")
    return spark.read.option("pathGlobFilter", "*.csv").csv(list(paths), schema=text, header=True, enforceSchema=False, multiLine=False)


def read_positions(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of CSV files or of all CSV files of folders (not deeper ones); a header other than HEADER is an error."""
    return typed_positions(_texts(spark, *paths))


def import_positions(spark: SparkSession, *paths: str) -> tuple[DataFrame, int]:
    """Usable rows, and how many were skipped."""
    rows = read_positions(spark, *paths)
    return rows.filter("usable").drop("usable"), rows.filter("not usable").count()


@dataclass(frozen=True)
class ImportCounts:
    """Rows written; left out for want of a time or a flight; left out for a time that can't be read; written without a number that can't be read."""

    imported: int
    skipped: int
    failed: int
    unread: int


def import_to(spark: SparkSession, out: str, *paths: str) -> ImportCounts:
    """Writes the usable rows of files or folders as Parquet and counts all rows by what became of them, in the same pass.

    The counters are kept by the tasks that write, so the files are read once. A task that has to run again after it had ended counts again.
    """
    texts = _texts(spark, *paths)
    filled = lambda *names: F.array(*[F.col(f"text_{c}").isNotNull() & F.col(c).isNull() for c in names])
    kept = texts.select(*HEADER, *[blank_to_null(F.col(c)).alias(f"text_{c}") for c in (*HEADER[:2], *NUMBERS)])
    rows = typed_positions(kept, [c for c in kept.columns if c not in HEADER])
    missing = F.col("flight_id").isNull() | F.col("text_sample_time").isNull() | F.col("text_time_over").isNull()
    counts = {
        "imported": F.col("usable"), "skipped": missing, "failed": ~F.col("usable") & ~missing,
        "unread": F.col("usable") & F.exists(filled(*NUMBERS), lambda x: x),
    }
    seen = Observation(f"import-{uuid.uuid4().hex}")
    observed = rows.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()])
    observed.filter("usable").drop("usable", *[c for c in rows.columns if c.startswith("text_")]).write.parquet(out)
    return ImportCounts(**seen.get)


def import_options(folder: str) -> list[tuple[str, str, str]]:
    """(id, label, kind) of the data sets below a folder: CSV files, and folders with a CSV file whose name no file has."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file() and p.suffix.lower() == ".csv")
    names = {p.stem for p in files}
    folders = sorted(p for p in Path(folder).iterdir() if p.is_dir() and p.name not in names and any(x.suffix.lower() == ".csv" for x in p.iterdir() if x.is_file()))
    return sorted([(p.name, p.stem, "file") for p in files] + [(p.name, p.name, "folder") for p in folders], key=lambda x: x[1].lower())


def resolve(folder: str, name: str) -> str:
    """The path of a data set by its file name, its stem or its folder's name; none or several are an error."""
    found = [x for x in import_options(folder) if name in (x[0], x[1])]
    if len(found) != 1:
        raise ValueError(f"{name}: {'no' if not found else 'more than one'} data set")
    return str(Path(folder) / found[0][0])

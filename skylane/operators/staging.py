"""Written intermediate tables, which cut long plans and survive lost executors, and rows held within a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; only in local mode one of our own is made where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="skylane-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df to the cluster's shared checkpoint folder and reads it back.

    The optimizer copies expressions through projections and filters; behind a table it has only columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """df with its columns computed once for each row, without a table: for rows too many to be written.

    Neither projections nor filters are moved or copied through explode.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_held")).select("_held.*")

"""Where a session keeps the indexes that its queries share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it. Only a session on one machine may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scrivana-store-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scrivana-store/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``, read back: what follows sees the very rows that were written, and a lost executor costs a re-read."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row among its key's rows, in a total order.

    Rows are range-sorted by key and order, so a key of any size spans tasks; places within a partition are shifted by the key's rows in the partitions before.
    """
    dealt = df.repartitionByRange(F.col(key), *order).withColumn("__pid", F.spark_partition_id())
    dealt = written(dealt, new_path(df.sparkSession, "placed"))
    counts = dealt.groupBy(key, "__pid").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that has the key
    shift = counts.select(key, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(key, "__pid").orderBy(*order))
    return dealt.withColumn("__local", local).join(shift, [key, "__pid"]).withColumn(name, F.col("__local") + F.col("__before")).drop("__pid", "__local", "__before")

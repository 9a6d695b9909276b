"""Rows by dense id in buckets of fixed size, so that a range of ids reads few files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators.lineage import cut


def write(rows: DataFrame, path: str, key: str = "id", size: int = 1000) -> None:
    """Put rows; buckets that they touch are written anew, with the new row where an id is there already.

    What is read from path is first written to the checkpoint folder (lineage.cut), as path is then overwritten.
    """
    spark = rows.sparkSession
    new = rows.withColumn("bucket", F.floor(F.col(key) / size).cast("bigint"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        touched = new.select("bucket").distinct()
        old = spark.read.parquet(path).join(F.broadcast(touched) if touched.count() < 100_000 else touched, "bucket", "left_semi")
        new = cut(old.join(new.select(key), key, "left_anti").unionByName(new))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, key: str = "id", size: int = 1000) -> DataFrame:
    """Rows with ids in [start, end), or all; only the buckets concerned are listed and read."""
    rows = spark.read.parquet(path)
    if start is not None and end is not None:
        rows = rows.where(F.col("bucket").between(start // size, (end - 1) // size) & (F.col(key) >= start) & (F.col(key) < end))
    return rows.drop("bucket")

"""Blocks as a stream: finality, reorganisations, and tables that are rewritten by height."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def finality(rows: DataFrame, height: str, depth: int, into: str = "final") -> DataFrame:
    """rows with whether their height is at least depth below the highest."""
    tip = rows.agg(F.max(height)).scalar()
    return rows.withColumn(into, F.col(height) <= tip - depth)


def broken_links(blocks: DataFrame) -> DataFrame:
    """Blocks (height, hash, prev_hash) whose parent is present and has another hash, or is missing above the lowest block."""
    parents = blocks.select((F.col("height") + 1).alias("height"), F.col("hash").alias("parent_hash"))
    lowest = blocks.agg(F.min("height")).scalar()
    return blocks.join(parents, "height", "left").where((F.col("height") > lowest) & F.expr("prev_hash is distinct from parent_hash"))


def block_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 12) -> DataFrame:
    """Block rows of Parquet files as they arrive, in the order of the files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, table_path: str, checkpoint: str, span: int = 1000, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write a stream of rows with a height into partitions of span heights, once for each row however often a batch is retried.

    A batch replaces heights that it brings again: rows of an orphaned block give way to those of its successor, as a
    reorganisation asks, and those above the least such height go, as they followed the orphaned one. Only partitions that
    the batch touches are rewritten, from a copy beside the stream's checkpoint, so the table is never read from what is
    being overwritten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = transform(batch) if transform else batch
        rows = rows.withColumn("span", F.floor(F.col("height") / span).cast("bigint")).withColumn("batch", F.lit(batch_id))
        staged = f"{checkpoint.rstrip('/')}/staged/{batch_id}"
        rows.write.mode("overwrite").parquet(f"{staged}/new")
        rows = spark.read.schema(rows.schema).parquet(f"{staged}/new")
        touched = [r[0] for r in rows.select("span").distinct().collect()]  # one number for each span of heights in the batch
        files = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
        system = files(table_path).getFileSystem(spark._jsc.hadoopConfiguration())
        if touched and system.exists(files(table_path)):
            old = spark.read.parquet(table_path)
            again = old.select("height").join(rows.select("height").distinct(), "height", "left_semi").agg(F.min("height")).first()[0]
            kept = old.where(F.col("span").isin(touched)).join(rows.select("height").distinct(), "height", "left_anti")
            if again is not None:
                kept = kept.where(F.col("height") < again)
                gone = [r[0] for r in old.where((F.col("height") > again) & ~F.col("span").isin(touched)).select("span").distinct().collect()]
                for name in gone:
                    system.delete(files(f"{table_path}/span={name}"), True)
            kept.unionByName(rows).write.mode("overwrite").parquet(f"{staged}/all")
            rows = spark.read.parquet(f"{staged}/all")
        if touched:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("span").parquet(table_path)
        system.delete(files(staged), True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(table: DataFrame, depth: int) -> DataFrame:
    """The final rows of an ingested table."""
    return finality(table, "height", depth).where("final").drop("final", "span", "batch")


def restart_height(directives: DataFrame, height: str = "height", effective: str = "effective") -> DataFrame:
    """The lowest height from which tables must be rebuilt because a directive reaches back; null if none does."""
    return directives.where(F.col(effective) < F.col(height)).agg(F.min(effective).alias("rebuild_from"))

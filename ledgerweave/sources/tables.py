"""The driver's tables as ledger-shaped frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of order lines: (orderkey, linenumber) alone isn't unique.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    """Money as minor units."""
    return F.round(F.col(column) * 100).cast("bigint")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per asset movement: ticker, minter, owner, utxo, amount. Lines of orders credit the ordering customer."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("ticker"), F.col("l_suppkey").alias("minter"), F.col("l_orderkey").alias("utxo"), F.col("l_quantity").cast("bigint").alias("amount")
    )
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("utxo"), F.col("o_custkey").alias("owner"))
    return lines.join(owners, "utxo")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action log in event order: event_id, ts, user_id, event_type, value, k (the ticker in props)."""
    events = table(spark, sf_dir, "events")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

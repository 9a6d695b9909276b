"""Rules that depend on the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key. A min_by over a struct: partial aggregates drop late rows before any shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*rows.columns)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*rows.columns)


def live_state(log: DataFrame, keys: list[str], order: list[str], deleted: Column) -> DataFrame:
    """The latest row of each key of a change log, without keys whose latest row is a deletion."""
    return last_wins(log, keys, order).where(~deleted)


def capped(rows: DataFrame, keys: list[str], order: list[Column], amount: str, cap: Column) -> DataFrame:
    """rows with granted: what a cap on each key's total still allows, the row that reaches it being cut short."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(amount).over(before), F.lit(0))
    return rows.withColumn("granted", F.greatest(F.lit(0), F.least(F.col(amount), cap - used)).cast("bigint"))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], into: str, first: int = 0) -> DataFrame:
    """rows with their dense number within keys, in order."""
    return rows.withColumn(into, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (first - 1)).cast("bigint"))


def signed_numbers(rows: DataFrame, cursed: Column, order: str, into: str) -> DataFrame:
    """Blessed rows are numbered 0, 1, ... and cursed ones -1, -2, ..., each in order.

    Numbering is over the whole table, so it goes by stretches of the order key: counts of stretches are summed in one
    place, rows are numbered inside their stretch.
    """
    stretch = F.floor(F.col(order) / 100_000)
    marked = rows.withColumn("__cursed", cursed).withColumn("__stretch", stretch)
    counts = marked.groupBy("__cursed", "__stretch").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__cursed").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__cursed", "__stretch", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__cursed", "__stretch").orderBy(order))
    out = marked.withColumn("__rank", rank).join(base, ["__cursed", "__stretch"])
    place = F.col("__base") + F.col("__rank")
    return out.withColumn(into, F.when(F.col("__cursed"), -place).otherwise(place - 1).cast("bigint")).drop("__cursed", "__stretch", "__rank", "__base")


def running_balance(rows: DataFrame, keys: list[str], order: list[Column], signed: Column, into: str = "balance") -> DataFrame:
    """rows with the running sum of a signed amount."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.sum(signed).over(upto).cast("bigint"))


def first_difference(a: DataFrame, b: DataFrame, height: str, hashed: str) -> DataFrame:
    """The first height at which two chains differ or one lacks a block; null if none."""
    sides = a.select(height, F.col(hashed).alias("__a")).join(b.select(height, F.col(hashed).alias("__b")), height, "full_outer")
    return sides.where("__a is distinct from __b").agg(F.min(height).alias("first_different"))

"""Set operations between committed rows, pending changes and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(committed: DataFrame, added: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """Committed rows under pending ones: added replaces rows with its keys, deleted hides them."""
    base = committed.join(added.select(*keys).distinct(), keys, "left_anti").unionByName(added)
    return base.join(deleted.select(*keys).distinct(), keys, "left_anti")


def pending(changes: DataFrame, flushed: DataFrame, keys: list[str]) -> DataFrame:
    """Changes that aren't among the flushed ones with the same keys (and version, if keys hold one)."""
    return changes.join(flushed.select(*keys).distinct(), keys, "left_anti")


def missing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def snapshot_changes(known: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """key, change: `added` for keys only in the snapshot, `missing` for keys only known."""
    added = missing(snapshot, known, [key]).withColumn("change", F.lit("added"))
    return added.unionByName(missing(known, snapshot, [key]).withColumn("change", F.lit("missing")))


def existing(requested: DataFrame, live: DataFrame, spent: DataFrame, key: str) -> DataFrame:
    """Requested keys that are live and not spent."""
    return requested.join(live.select(key).distinct(), key, "left_semi").join(spent.select(key).distinct(), key, "left_anti")


def availability(requested: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """Each requested key with taken: whether it is registered."""
    found = registered.select(key).distinct().withColumn("__found", F.lit(True))
    return requested.join(found, key, "left").select(*requested.columns, F.col("__found").isNotNull().alias("taken"))

"""Unconfirmed transactions: admission, replacement, descendants, confirmation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.lineage import cut


#: Levels that are kept apart before they become one table.
LEVELS = 16


def descendants(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """root, node for every node reachable from each root (node) along edges (parent, child), the root included.

    Breadth first, one join for each level until a level has nothing new, so cycles and shared descendants are fine. Each
    level is written once, and again whenever LEVELS of them are put together (lineage.cut).
    """
    frontier = cut(roots.select(F.col("node").alias("root"), "node").distinct())
    levels = [frontier]
    while not frontier.isEmpty():
        found = frontier.join(edges, frontier["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, levels)
        frontier = cut(found.join(seen, ["root", "node"], "left_anti"))
        levels.append(frontier)
        if len(levels) > LEVELS:
            levels = [cut(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def replaced(spends: DataFrame) -> DataFrame:
    """Transactions (txid, outpoint, arrived) that lose an outpoint to a later one."""
    last = spends.groupBy("outpoint").agg(F.max_by("txid", F.struct("arrived", "txid")).alias("winner"))
    return spends.join(last, "outpoint").where("txid <> winner").select("txid").distinct()


def evicted(spends: DataFrame, edges: DataFrame) -> DataFrame:
    """Replaced transactions and all that spend their outputs."""
    return descendants(replaced(spends).select(F.col("txid").alias("node")), edges).select(F.col("node").alias("txid")).distinct()


def resolve_inputs(inputs: DataFrame, confirmed: DataFrame, unconfirmed_plain: DataFrame, unconfirmed: DataFrame) -> DataFrame:
    """inputs (outpoint) with status: confirmed, plain (of a known unconfirmed output without assets), pending, or blocked (unknown)."""
    mark = lambda df, name: df.select("outpoint").distinct().withColumn(name, F.lit(True))
    out = inputs.join(mark(confirmed, "c"), "outpoint", "left").join(mark(unconfirmed_plain, "p"), "outpoint", "left").join(mark(unconfirmed, "u"), "outpoint", "left")
    status = F.when(F.col("c"), "confirmed").when(F.col("p"), "plain").when(F.col("u"), "pending").otherwise("blocked")
    return out.withColumn("status", status).drop("c", "p", "u")


def confirm(pool: DataFrame, block_txs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(confirmed, remaining) of the pool's transactions after a block."""
    mined = block_txs.select("txid").distinct()
    return pool.join(mined, "txid", "left_semi"), pool.join(mined, "txid", "left_anti")

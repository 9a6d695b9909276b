"""Views that read queries return: outputs with their assets, tickers with their progress, permissions and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.intervals import overlap_join


def output_view(outputs: DataFrame, assets: DataFrame, key: str = "utxo") -> DataFrame:
    """outputs with `assets`, an array of (ticker, amount) with the largest first; empty where there are none."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("order"), "ticker", "amount")))
    held = assets.where("amount <> 0").groupBy(key).agg(F.transform(listed, lambda a: F.struct(a["ticker"].alias("ticker"), a["amount"].alias("amount"))).alias("assets"))
    none = F.array().cast(held.schema["assets"].dataType)
    return outputs.join(held, key, "left").withColumn("assets", F.coalesce("assets", none))


def mint_permission(tickers: DataFrame, height: Column) -> DataFrame:
    """tickers (limit, max, minted, start, end) with permitted: what one more mint may take at a height; 0 outside the window."""
    open_now = (F.col("start").isNull() | (height >= F.col("start"))) & (F.col("end").isNull() | (height <= F.col("end")))
    left = F.greatest(F.col("max") - F.col("minted"), F.lit(0))
    return tickers.withColumn("permitted", F.when(open_now, F.least(F.col("limit"), left)).otherwise(0).cast("bigint"))


def progress(minted: Column, most: Column) -> Column:
    """Percent minted, two digits, rounded down; null without a maximum."""
    return F.floor(F.try_divide(minted * 10_000, most)).cast("bigint")


def binding_sats(protocol: Column, kind: Column, n: Column) -> Column:
    """Sats that one unit binds: n for ordx f, 1 for other ordx, plain and atom assets, 0 for all else."""
    return F.when((protocol == "ordx") & (kind == "f"), n).when(protocol.isin("ordx", "", "atom"), F.lit(1)).otherwise(F.lit(0))


def split_overlaps(mints: DataFrame, *by: str, key: str = "mint", width: int = 8) -> DataFrame:
    """start, end, mints: the stretches that equal sets of ranges cover, with how many cover each and the least key among them.

    width is that of overlap_join, near the usual length of a range.
    """
    borders = mints.select(*by, F.explode(F.array("start", "end")).alias("at")).distinct()
    after = borders.withColumn("upto", F.lead("at").over(Window.partitionBy(*by).orderBy("at"))).where("upto is not null")
    joined = overlap_join(after, mints.select(*by, F.col("start").alias("s"), F.col("end").alias("e"), key), list(by), width, ("at", "upto"), ("s", "e"))
    met = joined.groupBy(*by, "at", "upto").agg(F.count("*").alias("mints"), F.min(key).alias("first_mint"))
    return met.select(*by, F.col("at").alias("start"), F.col("upto").alias("end"), "mints", "first_mint")


def quota(requests: DataFrame, existing: DataFrame, owner: str, key: str, most: int) -> DataFrame:
    """requests with accepted: whether the owner's keys, new ones included, stay within most; known keys may always be written."""
    have = existing.select(owner, key).distinct()
    known = requests.join(have.withColumn("__known", F.lit(True)), [owner, key], "left")
    fresh = known.where("__known is null").select(owner, key).distinct().groupBy(owner).agg(F.count("*").alias("__new"))
    held = have.groupBy(owner).agg(F.count("*").alias("__held"))
    both = known.join(fresh, owner, "left").join(held, owner, "left")
    within = F.coalesce("__new", F.lit(0)) + F.coalesce("__held", F.lit(0)) <= most
    return both.select(*requests.columns, (F.col("__known").isNotNull() | within).alias("accepted"))


def trimmed_log(log: DataFrame, order: str, keep: int, above: int) -> DataFrame:
    """The last keep rows of a log once it has more than above, else all."""
    n = log.agg(F.count("*")).scalar()
    last = log.orderBy(F.desc(order)).limit(keep)
    return log.where(n <= above).unionByName(last.where(n > above))


def end_to_end(rows: DataFrame, by: list[str], order: list[Column], amount: str) -> DataFrame:
    """rows with start and end of their amounts laid end to end from 0."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(amount).over(upto).cast("bigint")
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col(amount))

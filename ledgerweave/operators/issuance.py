"""Tickers that come into being and are minted in transactions: deploys with terms, direct mints, capped mints, and rune entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.actions import first_reason
from ledgerweave.functions.assets import is_atom_ticker, ticker_effective
from ledgerweave.functions.names import bitwork_parts
from ledgerweave.operators.ordered import first_wins

#: Bounds of a deploy's terms.
MINT_AMOUNT = (546, 100_000_000)
MINT_HEIGHT = (0, 10_000_000)
MOST_MINTS_BEFORE, MOST_MINTS = 500_000, 21_000_000
MOST_LADDER_MINTS = 100_000
LADDER_STEP, LADDER_START = (0, 64), (64, 256)


def deploy_terms(height: Column, args: Column, density: int) -> Column:
    """struct(mode, supply, reason) of a deploy with arguments mint_height, mint_amount, max_mints, md, maxg, bci, bri, bcs, brs (longs), mint_bitworkc, mint_bitworkr, bv.

    fixed: max_mints mints. perpetual (md 1, from the height density on): a ladder of bitworks with the vector bv, at most maxg
    mints, or any number (supply -1). reason names the first rule that is broken.
    """
    a = lambda n: args[n]
    empty = lambda n: F.coalesce(a(n), F.lit("")) == ""
    outside = lambda c, lo, hi: ~F.coalesce(c.between(lo, hi), F.lit(False))
    dense = height >= density
    ladder = dense & (F.coalesce(a("md"), F.lit(0)) == 1)
    step = lambda n: F.coalesce(a(n), F.lit(0))
    start = lambda n: F.coalesce(a(n), F.lit(LADDER_START[0]))
    on_ladder = (
        ("vector", empty("bv") | ~F.coalesce(a("bv").rlike("^[0-9a-f]{4,}$"), F.lit(False)) | ((step("bci") == 0) & (step("bri") == 0))),
        ("bitwork beside ladder", ~empty("mint_bitworkc") | ~empty("mint_bitworkr")),
        ("ladder step", outside(step("bci"), *LADDER_STEP) | outside(step("bri"), *LADDER_STEP)),
        ("ladder start", ((step("bci") > 0) & outside(start("bcs"), *LADDER_START)) | ((step("bri") > 0) & outside(start("brs"), *LADDER_START))),
        ("ladder mints", a("max_mints") > MOST_LADDER_MINTS),
        ("maxg", a("maxg").isNotNull() & outside(a("maxg"), 1, MOST_MINTS)),
    )
    reason = first_reason(
        ("mint height", outside(a("mint_height"), *MINT_HEIGHT)), ("mint amount", outside(a("mint_amount"), *MINT_AMOUNT)),
        ("max mints", outside(a("max_mints"), 1, F.when(dense, MOST_MINTS).otherwise(MOST_MINTS_BEFORE))), ("md", ~F.coalesce(a("md"), F.lit(0)).isin(0, 1)),
        ("mint bitwork", (~empty("mint_bitworkc") & bitwork_parts(a("mint_bitworkc")).isNull()) | (~empty("mint_bitworkr") & bitwork_parts(a("mint_bitworkr")).isNull())),
        *((name, ladder & broken) for name, broken in on_ladder),
    )
    fixed = a("mint_amount") * a("max_mints")
    supply = F.when(~ladder, fixed).when(a("maxg").isNull(), F.lit(-1).cast("bigint")).otherwise(a("mint_amount") * a("maxg"))
    return F.struct(F.when(ladder, "perpetual").otherwise("fixed").alias("mode"), F.when(reason.isNull(), supply).alias("supply"), reason.alias("reason"))


def registered(candidates: DataFrame) -> DataFrame:
    """The candidate of each ticker with the earliest commit, by its height, transaction and index; of equal commits the one that came first.

    candidates: ticker, commit_height, commit_tx, commit_index, height, tx and others. Names with other characters than a-z
    and digits are left out.
    """
    return first_wins(candidates.where(is_atom_ticker(F.col("ticker"))), ["ticker"], ["commit_height", "commit_tx", "commit_index", "height", "tx"])


def direct_mints(rows: DataFrame) -> DataFrame:
    """Tickers that are minted whole where they are made: rows (ticker, value of output 0, immutable, valid and others) with supply.

    Immutable ones, invalid ones and those of no value make none.
    """
    sound = F.col("valid") & ~F.coalesce("immutable", F.lit(False)) & (F.col("value") > 0)
    return rows.where(sound & is_atom_ticker(F.col("ticker"))).withColumn("supply", F.col("value"))


def counted(rows: DataFrame, keys: list[str], block: str, order: list[str], into: str) -> DataFrame:
    """rows with their number from 0 within keys, by block and then order.

    Only counts by block are ordered in one place for a key; rows are ordered inside their block, so one key with most of
    the rows is no hot task.
    """
    counts = rows.groupBy(*keys, block).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, block, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order))
    return rows.withColumn("__in", inside).join(base, [*keys, block]).withColumn(into, (F.col("__base") + F.col("__in") - 1).cast("bigint")).drop("__in", "__base")


def accepted_mints(mints: DataFrame, tickers: DataFrame) -> DataFrame:
    """Mints (ticker, height, tx, value of output 0, valid) that count, with nth.

    tickers: ticker, commit_height, mint_height, mint_amount, most (null: any number). A mint needs an effective ticker, its
    mint height, exactly its amount, and a place below most. Each accepted mint takes one place, so places are numbers.
    """
    known = tickers.select("ticker", "commit_height", "mint_height", "mint_amount", "most")
    rows = mints.where("valid").join(known, "ticker")
    rows = rows.where(ticker_effective(F.col("height"), F.col("commit_height")) & (F.col("height") >= F.col("mint_height")) & (F.col("value") == F.col("mint_amount")))
    placed = counted(rows, ["ticker"], "height", ["tx"], "nth").where("most is null or nth < most")
    return placed.select(*mints.columns, "nth")


def minted(accepted: DataFrame) -> DataFrame:
    """ticker, times and amount of accepted mints."""
    return accepted.groupBy("ticker").agg(F.count("*").alias("times"), F.sum("value").cast("bigint").alias("amount"))


#: What a cenotaph's etching loses.
_LOST = ("terms", "symbol", "parent")


def rune_entries(etchings: DataFrame) -> DataFrame:
    """etchings (height, tx, cenotaph, divisibility, premine, spacers, turbo, and terms, symbol, parent) with number, their place in the chain.

    A cenotaph's entry has none of the rest: zeros, no turbo, no terms, symbol or parent.
    """
    rows = counted(etchings.withColumn("__all", F.lit(0)), ["__all"], "height", ["tx"], "number").drop("__all")
    for name in ("divisibility", "premine", "spacers"):
        rows = rows.withColumn(name, F.when(F.col("cenotaph"), 0).otherwise(F.coalesce(name, F.lit(0))).cast(etchings.schema[name].dataType))
    rows = rows.withColumn("turbo", ~F.col("cenotaph") & F.coalesce("turbo", F.lit(False)))
    for name in _LOST:
        rows = rows.withColumn(name, F.when(~F.col("cenotaph"), F.col(name)))
    return rows

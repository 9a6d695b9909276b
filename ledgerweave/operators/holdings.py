"""Balances and totals from a ledger of movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balances(ledger: DataFrame, *keys: str, amount: str = "amount", into: str = "amount") -> DataFrame:
    """Sum of amount by keys, as a long. A ledger without rows has no balances; null amounts count as nothing."""
    return ledger.groupBy(*keys).agg(F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias(into))


def holder_counts(ledger: DataFrame, ticker: str = "ticker", owner: str = "owner") -> DataFrame:
    """Distinct owners by ticker. Owners are first made distinct in partial aggregates, so a hot ticker doesn't gather in one task."""
    return ledger.where(F.col(owner).isNotNull()).select(ticker, owner).distinct().groupBy(ticker).agg(F.count("*").alias("holders"))


def mint_totals(ledger: DataFrame, *keys: str) -> DataFrame:
    """Minted amount and number of mints by keys."""
    return ledger.groupBy(*keys).agg(F.sum("amount").cast("bigint").alias("minted"), F.count("*").alias("mints"))


def with_grand_total(df: DataFrame, amount: str = "amount", into: str = "grand_total") -> DataFrame:
    """df with the sum of amount over all rows: a scalar subquery, so that rows aren't gathered for it."""
    return df.withColumn(into, df.agg(F.sum(amount).cast("bigint")).scalar())


def summaries(*parts: DataFrame) -> DataFrame:
    """Balances of several protocols (owner, protocol, ticker, amount) as one summary."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return balances(union, "owner", "protocol", "ticker")


def tiered_discount(total: Column, threshold: int, divisor: int, most: int = 100) -> Column:
    """most from the threshold on, else the total over divisor, rounded down."""
    return F.when(total >= threshold, F.lit(most)).otherwise(F.floor(total / divisor)).cast("bigint")


def spendable(utxos: DataFrame, with_assets: DataFrame, key: str, value: Column | None = None) -> DataFrame:
    """Outputs without assets, and with at least a value where one is given."""
    plain = utxos.join(with_assets.select(key).distinct(), key, "left_anti")
    return plain if value is None else plain.where(value)


def after_unconfirmed(confirmed: DataFrame, spent: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """Balances less unconfirmed spends, never below 0, plus unconfirmed receipts."""
    sides = (balances(x, *keys, into=n) for x, n in ((confirmed, "a"), (spent, "b"), (received, "c")))
    out = None
    for side in sides:
        out = side if out is None else out.join(side, keys, "full_outer")
    value = {n: F.coalesce(n, F.lit(0)) for n in "abc"}
    return out.select(*keys, (F.greatest(value["a"] - value["b"], F.lit(0)) + value["c"]).cast("bigint").alias("amount"))

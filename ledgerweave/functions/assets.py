"""Predicates on assets and tickers, and the assets of one output held in an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Asset types, protocols with pool tickers, blocks until a ticker takes effect, and sats of a transfer inscription.
NFT_TYPES = ("o", "n")
FUNGIBLE = "f"
POOL_PROTOCOLS = ("ordx", "runes", "brc20")
TICKER_DELAY = 3
GENERAL_DELAY = 100
TRANSFER_SATS = 330


def is_nft(kind: Column) -> Column:
    return kind.isin(*NFT_TYPES)


def is_fungible(kind: Column) -> Column:
    return kind == FUNGIBLE


def is_atom_ticker(name: Column) -> Column:
    return name.rlike("^[a-z0-9]{1,21}$")


def ticker_effective(height: Column, commit_height: Column) -> Column:
    """Whether a ticker committed at a height counts at another; one without a commit always does."""
    return commit_height.isNull() | (commit_height <= 0) | (commit_height <= height - TICKER_DELAY)


def envelope_in_time(height: Column, input_height: Column, activation: int, commit_from: int, commit_index: Column) -> Column:
    """Whether a mint's input is young enough, after the activation, and its commit at index 0 once that is asked."""
    young = (input_height >= activation) & (input_height >= height - GENERAL_DELAY) & (input_height >= height - TICKER_DELAY)
    return young & ((height < commit_from) | (commit_index == 0))


def integer_argument(text: Column) -> Column:
    """A signed decimal integer of 64 bits, with an optional sign; null for all else."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), F.ltrim(text, F.lit("+")).try_cast("bigint"))


def pool_base(name: Column) -> Column:
    """struct(protocol, ticker) that a pool ticker `<ticker>.lpt` or `<ticker>.<protocol>.lpt` stands on; null for other names."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    protocol = F.when(n == 2, "ordx").when((n == 3) & parts[1].isin(*POOL_PROTOCOLS), parts[1])
    return F.when(protocol.isNotNull() & (F.try_element_at(parts, F.lit(-1)) == "lpt"), F.struct(protocol.alias("protocol"), parts[0].alias("ticker")))


def pool_tickers(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Rows of names whose name is a pool ticker of a known (protocol, ticker)."""
    based = names.withColumn("__base", pool_base(F.col(name)))
    met = known.select(F.col("protocol").alias("__p"), F.col("ticker").alias("__t")).distinct()
    return based.join(met, (F.col("__base.protocol") == F.col("__p")) & (F.col("__base.ticker") == F.col("__t")), "left_semi").drop("__base")


def occupied_sats(offsets: Column, transfers: Column, amounts: Column) -> Column:
    """Sats that an output's assets occupy: sizes of all offset ranges (struct start, end), overlapping ones counted each time.

    Each of the transfers counts TRANSFER_SATS instead of its one sat. Without offsets the bound amounts count.
    """
    size = F.aggregate(offsets, F.lit(0).cast("bigint"), lambda total, r: total + r["end"] - r["start"])
    bound = F.aggregate(amounts, F.lit(0).cast("bigint"), lambda total, a: total + a)
    return F.when(F.size(offsets) == 0, bound).otherwise(size + transfers * (TRANSFER_SATS - 1))


def plain_sats(value: Column, occupied: Column) -> Column:
    """What is left of an output's value; may be negative where assets share sats."""
    return value - occupied


def without_asset(assets: Column, name: Column) -> Column:
    """assets (array of structs with a name) without one."""
    return F.filter(assets, lambda a: a["name"] != name)


def without_amount(assets: Column, name: Column, amount: Column) -> Column:
    """struct(assets, rest): assets (array of struct name, amount) less an amount of one; rest is what wasn't there to take."""
    have = F.aggregate(F.filter(assets, lambda a: a["name"] == name), F.lit(0).cast("bigint"), lambda total, a: total + a["amount"])
    left = F.transform(assets, lambda a: F.struct(a["name"].alias("name"), F.when(a["name"] == name, a["amount"] - amount).otherwise(a["amount"]).alias("amount")))
    return F.struct(F.filter(left, lambda a: (a["name"] != name) | (a["amount"] > 0)).alias("assets"), F.greatest(amount - have, F.lit(0)).cast("bigint").alias("rest"))


def unbound_count(assets: Column) -> Column:
    """Assets (array of struct amount, per_sat) whose amount is no whole number of sats."""
    return F.size(F.filter(assets, lambda a: (a["per_sat"] != 0) & (a["amount"] % a["per_sat"] != 0)))


def atomical_key(text: Column) -> Column:
    """A sort key of `<64 hex>i<n>`: the id's bytes from last to first, then n, least byte first, in hex; null for other texts."""
    number = F.regexp_extract(text, "^[0-9a-fA-F]{64}i([0-9]+)$", 1)
    number = F.when(number != "", number.try_cast("bigint"))
    backwards = lambda digits: F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"))), "")
    key = F.concat(backwards(F.lower(F.substring(text, 1, 64))), backwards(F.lower(F.lpad(F.hex(number), 8, "0"))))
    return F.when(number < 2**32, key)


def atomical_order(text: Column) -> list[Column]:
    """Valid ids by key, then all others by their text."""
    key = atomical_key(text)
    return [key.isNull(), key, text]


def new_ids(last: Column, current: Column) -> Column:
    """Ids from last + 1 to current; none if there are no newer ones."""
    return F.when(current > last, F.sequence(last + 1, current)).otherwise(F.array().cast("array<bigint>"))


def range_seed(ranges: Column) -> Column:
    """The first eight bytes, in hex, of the SHA-256 of ranges (array of struct start, size) as compact JSON, in which zeros are left out."""

    def item(r: Column) -> Column:
        shown = F.array(*(F.when(r[c] != 0, F.concat(F.lit(f'"{c}":'), r[c].cast("string"))) for c in ("start", "size")))
        return F.concat(F.lit("{"), F.array_join(F.array_compact(shown), ","), F.lit("}"))

    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(ranges, item), ","), F.lit("]")).cast("binary"), 256), 1, 16)

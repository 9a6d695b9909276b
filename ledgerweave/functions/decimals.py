"""Exact decimal amounts from text."""

from __future__ import annotations

from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UINT64_MAX = 2**64 - 1


def parse(text: Column, precision: int = 18) -> Column:
    """A decimal(38, precision) of plain digits with an optional fraction of at most precision digits; null for all else."""
    shape = rf"^[0-9]+(\.[0-9]{{1,{precision}}})?$" if precision else "^[0-9]+$"
    return F.when(text.rlike(shape) & (F.length(text) <= 256), text.try_cast(f"decimal(38,{precision})"))


def token_amount(text: Column, precision: int = 18) -> Column:
    """parse(), and null above the largest unsigned 64-bit number."""
    value = parse(text, precision)
    return F.when(value <= F.lit(str(UINT64_MAX)).cast("decimal(38,0)"), value)


def canonical(value: Column) -> Column:
    """Text without trailing zeros of a fraction."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent; null for an empty whole."""
    return F.try_divide(part * 100, whole)


def sats(value: Column) -> Column:
    """Coins as sats."""
    return F.round(value * 100_000_000).cast("bigint")


def rescale(value: Column, scale: int) -> Column:
    """The value cut to so many digits of fraction."""
    factor = F.lit(10**scale)
    return (F.floor(F.abs(value) * factor) / factor * F.signum(value)).cast(f"decimal(38,{scale})")


def parse_with_precision(text: Column) -> Column:
    """struct(value, precision) of `digits[.digits][:precision]`, the precision 0 if it isn't given; null if malformed or above 18."""
    parts = F.split(text, ":")
    given = F.when(F.size(parts) == 1, F.lit(0)).when((F.size(parts) == 2) & parts[1].rlike("^[0-9]{1,2}$"), parts[1].try_cast("int"))
    fraction = F.when(parts[0].contains("."), F.length(parts[0]) - F.instr(parts[0], ".")).otherwise(0)
    value = F.when((given <= 18) & (fraction <= given), parse(parts[0], 18))
    return F.when(value.isNotNull(), F.struct(value.alias("value"), given.alias("precision")))


@F.pandas_udf(StringType())
def _roots(units: pd.Series, precision: pd.Series) -> pd.Series:
    return pd.Series([None if u is None or int(u) < 0 else str(isqrt(int(u) * 10 ** int(p))) for u, p in zip(units, precision, strict=True)], dtype=object)


def square_root(units: Column, precision: Column) -> Column:
    """The floor of the root of a decimal held as units of 10^-precision, in the same units, exact at any size; null below 0."""
    return _roots(units.cast("string"), precision.cast("int"))


def pile(amount: Column, divisibility: int, symbol: Column) -> Column:
    """An amount in smallest units as text: whole and fraction without trailing zeros, a no-break space and the symbol (¤ if null)."""
    digits = F.lpad(amount.cast("string"), F.greatest(F.length(amount.cast("string")), F.lit(divisibility + 1)), F.lit("0"))
    whole = F.substring(digits, F.lit(1), F.length(digits) - divisibility)
    fraction = F.regexp_replace(F.right(digits, F.lit(divisibility)), "0+$", "")
    return F.concat(whole, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit(" "), F.coalesce(symbol, F.lit("¤")))


def scientific(n: Column, decimals: int) -> Column:
    """A natural number (decimal(38, 0)) as d.ddE+x with so many decimals, half up."""
    digits = n.cast("string")
    padded = F.rpad(digits, F.greatest(F.length(digits), F.lit(decimals + 2)), F.lit("0"))
    kept = F.substring(padded, 1, decimals + 1).cast("decimal(38,0)")
    rounded = (kept + F.when(F.substring(padded, decimals + 2, 1) >= "5", 1).otherwise(0)).cast("string")
    longer = F.length(rounded) > decimals + 1
    exponent = (F.length(digits) - 1 + longer.cast("int")).cast("string")
    mantissa = F.substring(rounded, 1, 1) if not decimals else F.concat(F.substring(rounded, 1, 1), F.lit("."), F.substring(rounded, 2, decimals))
    return F.concat(mantissa, F.lit("E+"), exponent)

"""Rune names, ids, schedules and supplies. Names are 128-bit numbers: text in columns, whole numbers in Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the protocol.
MOST = 2**128 - 1
RESERVED = 6402364363415443603228541259936211926
SPACER = "•"
FIRST_HEIGHT, UNLOCK_BLOCKS, UNLOCK_STEP = 840_000, 210_000, 17_500
COMMIT_CONFIRMATIONS = 6


def name_of(value: int) -> str:
    """Letters of a number: bijective base 26, A being 0."""
    out, value = "", value + 1
    while value > 0:
        value, letter = divmod(value - 1, 26)
        out = chr(65 + letter) + out
    return out


def value_of(name: str) -> int | None:
    """Number of letters A to Z; None for anything else or beyond 128 bits."""
    if not name or not all("A" <= c <= "Z" for c in name):
        return None
    value = 0
    for c in name:
        value = value * 26 + ord(c) - 64
    return value - 1 if value - 1 <= MOST else None


def spaced(name: str, spacers: int) -> str:
    """The name with a spacer after each letter whose bit is set."""
    return "".join(c + (SPACER if k < len(name) - 1 and spacers >> k & 1 else "") for k, c in enumerate(name))


def parse_spaced(text: str) -> tuple[str, int] | None:
    """(name, spacers) of letters with single `.` or spacers between them; None if malformed."""
    name, spacers = "", 0
    for c in text:
        if c in ("." + SPACER):
            bit = 1 << (len(name) - 1) if name else 0
            if not bit or spacers & bit:
                return None
            spacers |= bit
        elif "A" <= c <= "Z":
            name += c
        else:
            return None
    return (name, spacers) if name and not spacers >> (len(name) - 1) & 1 else None


def shortest_of(length: int) -> int:
    """The number of the first name with length + 1 letters."""
    return value_of("A" * (length + 1))


def minimum_at(height: int, first: int = FIRST_HEIGHT) -> int:
    """The least name that may be etched in the block after height: names of 13 letters at first, then shorter ones step by step."""
    passed = height + 1 - first
    if passed < 0:
        return shortest_of(12)
    if passed >= UNLOCK_BLOCKS:
        return 0
    steps, rest = divmod(passed, UNLOCK_STEP)
    high, low = shortest_of(12 - steps), shortest_of(11 - steps)
    return high - (high - low) * rest // UNLOCK_STEP


def reserved_name(block: int, tx: int) -> int:
    return RESERVED + (block << 32 | tx)


def commitment(value: int) -> bytes:
    """Little-endian bytes without trailing zeros."""
    return value.to_bytes(16, "little").rstrip(b"\0")


def _by_text(f, column: Column) -> Column:
    """f of each text, null for null; f may return None."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return F.pandas_udf(run, "string")(column)


def encode(number: Column) -> Column:
    """Names of numbers in decimal digits; null beyond 128 bits."""
    return _by_text(lambda v: name_of(int(v)) if v.isdigit() and int(v) <= MOST else None, number)


def decode(name: Column) -> Column:
    """Numbers of names, in decimal digits; null if malformed or beyond 128 bits."""

    def number(v: str) -> str | None:
        value = value_of(v)
        return None if value is None else str(value)

    return _by_text(number, name)


def without_spacers(name: Column) -> Column:
    """Names without their spacers; null if malformed."""

    def bare(v: str) -> str | None:
        parsed = parse_spaced(v)
        return None if parsed is None else parsed[0]

    return _by_text(bare, name)


def etchable(name: Column, height: Column) -> Column:
    """Whether an unspaced name is valid, not reserved and at or above the least name of the block (registered names are another join's matter)."""

    def run(names: pd.Series, heights: pd.Series) -> pd.Series:
        least: dict[int, int] = {}
        out = []
        for n, h in zip(names, heights, strict=True):
            value = None if n is None or pd.isna(h) else value_of(n)
            if value is not None and int(h) not in least:
                least[int(h)] = minimum_at(int(h))
            out.append(value is not None and least[int(h)] <= value < RESERVED)
        return pd.Series(out)

    return F.pandas_udf(run, "boolean")(name, height)


def open_from(absolute: Column, relative: Column, etched: Column) -> Column:
    """First height at which minting is open: the later of both terms; null if there is neither."""
    return F.greatest(absolute, etched + relative)


def open_until(absolute: Column, relative: Column, etched: Column) -> Column:
    """Height at which minting ends: the earlier of both terms; null if there is neither."""
    return F.least(absolute, etched + relative)


def supply(premine: Column, mints: Column, amount: Column) -> Column:
    """Units in being, as decimal(38, 0); null where that overflows."""
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)")
    return F.try_add(wide(premine), F.try_multiply(wide(mints), wide(amount)).cast("decimal(38,0)"))

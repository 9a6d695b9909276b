"""Ordinal arithmetic: subsidies, first ordinals, heights, rarity and satributes, in closed form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the chain.
COIN = 100_000_000
FIRST_SUBSIDY = 50 * COIN
HALVING, CYCLE, PERIOD = 210_000, 1_260_000, 2_016
EPOCHS = 34
#: Fixed blocks whose sats carry a tag.
NAKAMOTO_BLOCKS = (9, 286, 688, 877, 1760, 2459, 2485, 3479, 5326, 9443, 9925, 10645, 14450, 15625, 15817, 19093, 23014, 28593, 29097)
VINTAGE_HEIGHT = 1000
#: Fixed range of the first transaction's sats: start and size.
FIRST_TRANSACTION = (45_000_000_000, 1_000_000_000)


def _starts() -> list[int]:
    """The first sat of each epoch, and the end of the last."""
    out = [0]
    for epoch in range(EPOCHS):
        out.append(out[-1] + HALVING * (FIRST_SUBSIDY >> epoch))
    return out


def subsidy(height: Column) -> Column:
    """New sats of a block."""
    return F.call_function("shiftright", F.lit(FIRST_SUBSIDY).cast("bigint"), F.least(F.floor(height / HALVING), F.lit(62)).cast("int"))


def first_ordinal(height: Column) -> Column:
    """Sats that all earlier blocks may have made: whole epochs, and this one's blocks so far."""
    epoch = F.floor(height / HALVING).cast("int")
    return F.element_at(_start_array(), F.least(epoch, F.lit(EPOCHS)) + 1) + (height - epoch * HALVING).cast("bigint") * subsidy(height)


def _start_array() -> Column:
    return F.array(*(F.lit(s).cast("bigint") for s in _starts()))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.transform(F.array(value), then)[0]


def epoch(sat: Column) -> Column:
    """The halving epoch of a sat; 0 past the last, as beyond all of them."""
    starts = _starts()

    def search(low: int, high: int) -> Column:  # exact in the late, floored epochs too
        if high - low == 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(sat < starts[middle], search(low, middle)).otherwise(search(middle, high))

    return F.when(sat < starts[-1], search(0, EPOCHS)).otherwise(0)


def _placed(sat: Column, then: Callable[[Column, Column], Column]) -> Column:
    """then(height, whether the sat is the first of its block)."""

    def of_epoch(e: Column) -> Column:
        into = sat - F.element_at(_start_array(), e + 1)
        each = subsidy(e * HALVING)
        return F.struct((e * HALVING + F.floor(into / each)).cast("bigint").alias("height"), (into % each == 0).alias("first"))

    return _let(_let(epoch(sat), of_epoch), lambda p: then(p["height"], p["first"]))


def height(sat: Column) -> Column:
    """The block that made a sat in theory."""
    return _placed(sat, lambda h, first: h)


def is_first_in_block(sat: Column) -> Column:
    return _placed(sat, lambda h, first: first)


def _rarity(sat: Column, h: Column, first: Column) -> Column:
    return (
        F.when(sat == 0, "mythic").when(first & (h % CYCLE == 0), "legendary").when(first & (h % HALVING == 0), "epic")
        .when(first & (h % PERIOD == 0), "rare").when(first, "uncommon").otherwise("common")
    )


def rarity(sat: Column) -> Column:
    return _placed(sat, lambda h, first: _rarity(sat, h, first))


def sat_place(sat: Column) -> Column:
    """A sat's cycle, epoch, period, height, offsets in those, and rarity, as a struct."""
    return _placed(
        sat,
        lambda h, first: F.struct(
            F.floor(h / CYCLE).alias("cycle"), F.floor(h / HALVING).alias("epoch"), F.floor(h / PERIOD).alias("period"), h.alias("height"), (h % HALVING).alias("epoch_block"), (h % PERIOD).alias("period_block"),
            _rarity(sat, h, first).alias("rarity"),
        ),
    )


def is_alpha(sat: Column) -> Column:
    return sat % COIN == 0


def is_fibonacci(sat: Column) -> Column:
    """Membership, over the numbers up to the last sat."""
    numbers, a, b = [], 0, 1
    while a < _starts()[-1]:
        numbers.append(a)
        a, b = b, a + b
    return sat.isin(sorted(set(numbers)))


def satributes(sat: Column) -> Column:
    """All tags of a sat, as an array of strings."""

    def tags(h: Column, first: Column) -> Column:
        return _let(
            _rarity(sat, h, first),
            lambda rare: F.array(
                F.when(rare != "common", rare), F.when(is_first_in_block(sat + 1), "black"), F.when(is_alpha(sat), "alpha"), F.when(is_alpha(sat + 1), "omega"),
                F.when(is_fibonacci(sat), "fibonacci"), F.when(sat.between(FIRST_TRANSACTION[0], sum(FIRST_TRANSACTION) - 1), "1stTX"),
                F.when(h == 9, "block9"), F.when(h == 78, "block78"), F.when(h <= VINTAGE_HEIGHT, "vintage"), F.when(h.isin(list(NAKAMOTO_BLOCKS)), "nakamoto"),
            ),
        )

    return F.array_compact(_placed(sat, tags))


def trailing_zeros(n: Column, k: int) -> Column:
    return n % 10**k == 0

"""Algebra of sorted, disjoint, half-open offset ranges held in one row: array<struct<start: bigint, end: bigint>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = "array<struct<start:bigint,end:bigint>>"


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, where use mentions it often or inside a lambda."""
    return F.transform(F.array(value), use)[0]


def _none() -> Column:
    return F.array().cast(RANGES)


def size(ranges: Column) -> Column:
    """Units in all ranges."""
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda total, r: total + r["end"] - r["start"])


def _clip(ranges: Column, low: Column, high: Column, shift: Column) -> Column:
    moved = F.transform(ranges, lambda r: _range(F.greatest(r["start"], low) - shift, F.least(r["end"], high) - shift))
    return F.filter(moved, lambda r: r["start"] < r["end"])


_FAR = 2**62


def cut(ranges: Column, at: Column) -> tuple[Column, Column]:
    """The parts below and from a position; the second begins anew at 0 there."""
    zero, far = F.lit(0).cast("bigint"), F.lit(_FAR).cast("bigint")
    return _clip(ranges, zero, at, zero), _clip(ranges, at, far, at)


def cut_range(ranges: Column, start: Column, end: Column) -> Column:
    """What lies in [start, end), beginning anew at 0; null if nothing does."""
    return _let(_clip(ranges, start, end, start), lambda part: F.when(F.size(part) > 0, part))


def _taken(ranges: Column, amount: Column) -> Column:
    """The first amount units, as ranges."""
    state = F.struct(_none().alias("out"), amount.cast("bigint").alias("left"))

    def step(s, r):
        n = F.least(s["left"], r["end"] - r["start"])
        return F.struct(F.when(n > 0, F.concat(s["out"], F.array(_range(r["start"], r["start"] + n)))).otherwise(s["out"]).alias("out"), (s["left"] - n).alias("left"))

    return F.aggregate(ranges, state, step, lambda s: s["out"])


def split(ranges: Column, amount: Column) -> tuple[Column, Column]:
    """The first amount units and the rest, which begins anew at 0 where the first part ends."""
    left = _taken(ranges, amount)
    end = F.coalesce(F.try_element_at(left, F.lit(-1))["end"], F.lit(0).cast("bigint"))
    return left, _let(end, lambda at: cut(ranges, at)[1])


def pick_up(ranges: Column, offset: Column, amount: Column) -> Column:
    """The first amount units at or after offset, in place; null unless all are there."""
    zero, far = F.lit(0).cast("bigint"), F.lit(_FAR).cast("bigint")
    taken = _taken(_clip(ranges, offset, far, zero), amount)
    return _let(taken, lambda part: F.when((amount > 0) & (size(part) == amount), part))


def merge(ranges: Column) -> Column:
    """Ranges in order, touching and overlapping ones made one."""

    def step(out, r):
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(_range(last["start"], F.greatest(last["end"], r["end"]))))
        return F.when(F.size(out) == 0, F.array(r)).when(last["end"] >= r["start"], joined).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(F.array_sort(F.filter(ranges, lambda r: r["start"] < r["end"])), _none(), step)


def append(a: Column, b: Column, length: Column) -> Column:
    """a and then b, whose positions begin at a's whole length."""
    return merge(F.concat(a, F.transform(b, lambda r: _range(r["start"] + length, r["end"] + length))))


def contains(ranges: Column, position: Column) -> Column:
    return F.exists(ranges, lambda r: (r["start"] <= position) & (position < r["end"]))


def offset_of(ranges: Column, position: Column) -> Column:
    """Units before a position; all of them if it lies in no range."""
    before = F.aggregate(ranges, F.lit(0).cast("bigint"), lambda total, r: total + F.greatest(F.lit(0), F.least(r["end"], position) - r["start"]))
    return F.when(contains(ranges, position), before).otherwise(size(ranges))

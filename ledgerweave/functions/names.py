"""Name rules and name filters, as column predicates."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed byte lengths of a ticker name.
SHORTEST, LONGEST = 3, 32


def is_name(name: Column) -> Column:
    """Not empty, and without punctuation, separators and control characters."""
    return (name != "") & ~name.rlike(r"[\p{P}\p{Z}\p{C}]")


def is_ticker_name(name: Column) -> Column:
    return is_name(name) & F.octet_length(name).between(SHORTEST, LONGEST)


def is_domain_name(name: Column) -> Column:
    """At most 32 bytes, no space or line feed, one or two valid parts around a dot."""
    parts = F.split(name, r"\.")
    return (F.octet_length(name) <= LONGEST) & ~name.rlike("[ \n]") & F.size(parts).between(1, 2) & F.forall(parts, is_name)


def name_parts(name: Column, separator: str = r"\.") -> Column:
    """struct(prefix, suffix): one part has an empty suffix, three or more have neither."""
    p = F.split(name, separator)
    made = lambda a, b: F.struct(a.alias("prefix"), b.alias("suffix"))
    return F.when(F.size(p) == 1, made(p[0], F.lit(""))).when(F.size(p) == 2, made(p[0], p[1])).otherwise(made(F.lit(""), F.lit("")))


def is_date(year: Column, month: Column, day: Column, years: tuple[int, int] = (1900, 2100)) -> Column:
    """A calendar day of the given years."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return year.between(*years) & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()


def _number(name: Column, start: int, length: int) -> Column:
    return F.substring(name, start, length).try_cast("int")


def is_full_date(name: Column, years: tuple[int, int] = (1900, 2100)) -> Column:
    """YYYYMMDD of a calendar day of the given years; the name filter takes those from 1900 to 2100."""
    return F.coalesce(name.rlike("^[0-9]{8}$") & is_date(_number(name, 1, 4), _number(name, 5, 2), _number(name, 7, 2), years), F.lit(False))


def is_short_date(name: Column) -> Column:
    """YYMMDD (years below 24 are 20YY, others 19YY) or YYYYMM, of a calendar day or month."""
    yy = _number(name, 1, 2)
    year = F.when(yy < 24, yy + 2000).otherwise(yy + 1900)
    day = is_date(year, _number(name, 3, 2), _number(name, 5, 2))
    month = is_date(_number(name, 1, 4), _number(name, 5, 2), F.lit(1))
    return F.coalesce(name.rlike("^[0-9]{6}$") & (F.coalesce(day, F.lit(False)) | F.coalesce(month, F.lit(False))), F.lit(False))


def is_steady(name: Column) -> Column:
    """Every character is one above the one before, or every one is one below; two characters at least."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), F.ascii)
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: b - a)
    return F.when(F.length(name) < 2, False).otherwise(F.forall(pairs, lambda d: d == 1) | F.forall(pairs, lambda d: d == -1))


def _of_length(kind: str, n: int):
    shapes = {"Han": rf"^\p{{IsHan}}{{{n}}}$", "D": f"^[0-9]{{{n}}}$", "L": f"^[A-Za-z]{{{n}}}$"}
    return lambda name: name.rlike(shapes[kind])


#: Fixed tags of the filters.
FILTERS = {
    **{f"{n}Han": _of_length("Han", n) for n in range(1, 5)},
    **{f"{n}D": _of_length("D", n) for n in range(1, 13)},
    **{f"{n}L": _of_length("L", n) for n in range(1, 5)},
    "cmn": lambda name: name.rlike(r"^1[3-9]\d{9}$"),
    "SDate": is_short_date,
    "FDate": is_full_date,
    "cvcv": lambda name: name.rlike("^[^aeiouAEIOU][aeiouAEIOU][^aeiouAEIOU][aeiouAEIOU]$"),
    "same": lambda name: name.rlike(r"^(.)\1*$"),
    "consecutive": is_steady,
    "symmetric": lambda name: name == F.reverse(name),
    "lucky": lambda name: name.rlike("666|888|999"),
    "2char": lambda name: F.size(F.array_distinct(F.filter(F.split(name, ""), lambda c: c != ""))) == 2,
    "DaL2": lambda name: name.rlike("^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9]{2}$"),
    "DaL3": lambda name: name.rlike("^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9]{3}$"),
}


def name_filter(name: Column, tags: str) -> Column:
    """All of the tags between plus signs; unknown tags let every name pass. Empty names never pass."""
    asked = [FILTERS[t](name) for t in tags.split("+") if t in FILTERS]
    return functools.reduce(operator.and_, asked, name != "")


def percentage(text: Column) -> Column:
    """`50%` or `0.5` as 50; null beyond 100 or if malformed."""
    percent = F.when(text.rlike(r"^[0-9]+(\.0*)?%$"), F.regexp_extract(text, "^([0-9]+)", 1).try_cast("int"))
    part = F.when(text.rlike(r"^[01](\.[0-9]{1,2}0*)?$"), F.round(text.try_cast("decimal(20,10)") * 100).cast("int"))
    value = F.coalesce(percent, part)
    return F.when(value <= 100, value)


def bitwork_parts(bitwork: Column) -> Column:
    """struct(prefix, ext) of hex digits with an optional `.0` to `.15`; null if malformed."""
    shape = r"^([0-9a-f]+)(?:\.([0-9]{1,2}))?$"
    ext = F.coalesce(F.nullif(F.regexp_extract(bitwork, shape, 2), F.lit("")).try_cast("int"), F.lit(0))
    return F.when(bitwork.rlike(shape) & (ext <= 15), F.struct(F.regexp_extract(bitwork, shape, 1).alias("prefix"), ext.alias("ext")))


def matches_bitwork(txid: Column, bitwork: Column) -> Column:
    """The id begins with the prefix, and its next hex digit is at least ext."""
    parts = bitwork_parts(bitwork)
    prefix, ext = parts["prefix"], parts["ext"]
    following = F.substring(txid, F.length(prefix) + 1, F.lit(1))
    high = F.conv(following, 16, 10).try_cast("int") >= ext
    return F.coalesce(F.startswith(txid, prefix) & ((ext == 0) | ((following != "") & high)), F.lit(False))


def derived_bitwork(base: Column, target: Column) -> Column:
    """The base, lower case and padded with zeros to 32, as long as a sixteenth of target, with `.rest` where there is one; null below 16."""
    padded = F.substring(F.concat(F.lower(base), F.lit("0" * 32)), 1, 32)
    whole = F.floor(target / 16).cast("int")
    rest = target % 16
    prefix = F.substring(padded, F.lit(1), F.least(whole, F.lit(32)))
    return F.when(target >= 16, F.when(rest > 0, F.concat(prefix, F.lit("."), rest.cast("string"))).otherwise(prefix))


def expected_bitwork(vector: Column, mints: Column, most: Column, increment: Column, start: Column) -> Column:
    """The bitwork that a ladder asks for after so many mints; null where its bounds are broken."""
    sound = start.between(64, 256) & most.between(1, 100_000) & increment.between(1, 64)
    return F.when(sound, derived_bitwork(vector, (start + F.floor(mints / most) * increment).cast("bigint")))


def pairs(text: Column, between: str = ";", of: str = "=") -> Column:
    """`a=1;b=2` as a map."""
    return F.str_to_map(text, F.lit(re.escape(between)), F.lit(re.escape(of)))

"""Golden vectors of the scalar rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import decimals, ids, names, offsets, sats


def one(spark, column):
    value = spark.range(1).select(column.alias("v")).first()["v"]
    return [tuple(r) for r in value] if isinstance(value, list) and value and hasattr(value[0], "_fields") else value


def ranges(*pairs):
    return F.lit(None).cast(offsets.RANGES) if not pairs else F.array(*(F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end")) for a, b in pairs))


PICK_UP = [
    ([(0, 10), (20, 30)], 5, 5, [(5, 10)]), ([(0, 10), (10, 20)], 10, 5, [(10, 15)]), ([(0, 10), (20, 30), (40, 50)], 5, 20, [(5, 10), (20, 30), (40, 45)]),
    ([(0, 10), (20, 30)], 0, 20, [(0, 10), (20, 30)]), ([(0, 10)], 5, 10, None), ([(0, 10)], 20, 1, None), ([(0, 10)], 0, 0, None), ([(0, 10), (20, 30)], 15, 5, [(20, 25)]),
]


@pytest.mark.parametrize(("given", "offset", "amount", "want"), PICK_UP)
def test_pick_up(spark, given, offset, amount, want):
    assert one(spark, offsets.pick_up(ranges(*given), F.lit(offset), F.lit(amount))) == want


CUT_RANGE = [([(0, 10), (10, 20)], 5, 15, [(0, 5), (5, 10)]), ([(0, 10), (10, 20)], 5, 10, [(0, 5)]), ([(0, 10)], 10, 10, None), ([(0, 10)], 20, 30, None), ([(0, 5), (5, 10)], 0, 10, [(0, 5), (5, 10)])]


@pytest.mark.parametrize(("given", "start", "end", "want"), CUT_RANGE)
def test_cut_range(spark, given, start, end, want):
    assert one(spark, offsets.cut_range(ranges(*given), F.lit(start), F.lit(end))) == want


def test_offset_algebra(spark):
    a = ranges((0, 10), (20, 30))
    left, right = offsets.split(a, F.lit(15))
    assert one(spark, left) == [(0, 10), (20, 25)]
    assert one(spark, right) == [(0, 5)]
    assert one(spark, offsets.append(ranges((0, 5)), ranges((0, 5), (7, 9)), F.lit(5))) == [(0, 10), (12, 14)]
    assert one(spark, offsets.size(a)) == 20
    assert one(spark, offsets.offset_of(a, F.lit(22))) == 12
    assert one(spark, offsets.offset_of(a, F.lit(15))) == 20


@pytest.mark.parametrize(("height", "want"), [(0, 5000000000), (1, 5000000000), (210000, 2500000000), (420000, 1250000000), (630000, 625000000)])
def test_subsidy(spark, height, want):
    assert one(spark, sats.subsidy(F.lit(height))) == want


@pytest.mark.parametrize(("height", "want"), [(0, 0), (1, 5000000000), (2, 10000000000), (3, 15000000000), (210000, 1050000000000000), (807680, 1948550000000000)])
def test_first_ordinal(spark, height, want):
    assert one(spark, sats.first_ordinal(F.lit(height))) == want


@pytest.mark.parametrize(("sat", "want"), [(0, 0), (1805619726571369, 604495), (2099999997689999, 6929999), (1050000000000000, 210000)])
def test_sat_height(spark, sat, want):
    assert one(spark, sats.height(F.lit(sat))) == want


RARITY = {
    "mythic": [0], "epic": [1050000000000000], "rare": [100800000000000, 1109640000000000, 1937670000000000],
    "uncommon": [1953568750000000, 1030915000000000, 1948833750000000, 1847158750000000], "common": [45027647018, 1, 1109640000000001],
}


@pytest.mark.parametrize(("want", "sat"), [(k, v) for k, vs in RARITY.items() for v in vs])
def test_rarity(spark, want, sat):
    assert one(spark, sats.rarity(F.lit(sat))) == want


def test_satributes(spark):
    assert one(spark, sats.satributes(F.lit(45000000000))) == ["uncommon", "alpha", "1stTX", "block9", "vintage", "nakamoto"]


@pytest.mark.parametrize(("base", "target", "want"), [("", 64, "0000"), ("a", 65, "a000.1"), ("abcd", 80, "abcd0"), ("abcd", 83, "abcd0.3"), ("0123456789abcdef", 129, "01234567.1"), ("abcdefe", 33000, "abcdefe0000000000000000000000000.8")])
def test_derived_bitwork(spark, base, target, want):
    assert one(spark, names.derived_bitwork(F.lit(base), F.lit(target))) == want


def test_bitwork(spark):
    assert one(spark, names.expected_bitwork(F.lit("888888888888"), F.lit(49995), F.lit(3333), F.lit(1), F.lit(64))) == "8888.15"
    assert one(spark, names.matches_bitwork(F.lit("abcf00"), F.lit("abc.15"))) is True
    assert one(spark, names.matches_bitwork(F.lit("abce00"), F.lit("abc.15"))) is False
    assert one(spark, names.bitwork_parts(F.lit("abc.16"))) is None


NAMES = [
    ("same", "7777", True), ("same", "7778", False), ("consecutive", "1234", True), ("consecutive", "4321", True), ("consecutive", "1235", False), ("symmetric", "1221", True), ("lucky", "16660", True), ("lucky", "66", False),
    ("cvcv", "bobo", True), ("cvcv", "abab", False), ("2char", "1212", True), ("2char", "111", False), ("FDate", "20240229", True), ("FDate", "20230229", False), ("SDate", "230229", False), ("SDate", "200229", True), ("SDate", "202412", True),
    ("cmn", "13912345678", True), ("DaL2", "a1", True), ("DaL2", "aa", False), ("2Han", "中国", True), ("3L", "abc", True), ("3D+symmetric", "121", True), ("nosuch", "anything", True), ("3D", "", False),
]


@pytest.mark.parametrize(("tags", "name", "want"), NAMES)
def test_name_filter(spark, tags, name, want):
    assert one(spark, names.name_filter(F.lit(name), tags)) is want


def test_name_rules(spark):
    assert one(spark, names.is_ticker_name(F.lit("pearl"))) is True
    assert one(spark, names.is_ticker_name(F.lit("a.b"))) is False
    assert one(spark, names.is_domain_name(F.lit("satoshi.btc"))) is True
    assert one(spark, names.is_domain_name(F.lit("a.b.c"))) is False
    assert one(spark, names.percentage(F.lit("50%"))) == 50
    assert one(spark, names.percentage(F.lit("0.5"))) == 50
    assert one(spark, names.percentage(F.lit("150%"))) is None


def test_ids(spark):
    packed = ids.utxo_id(F.lit(840000), F.lit(12), F.lit(3))
    assert [one(spark, c) for c in ids.utxo_parts(packed)] == [840000, 12, 3]
    assert tuple(one(spark, ids.asset_name(F.lit("runes:f:840000:3")))) == ("runes", "f", "840000:3")
    assert tuple(one(spark, ids.asset_name(F.lit("pearl")))) == ("ordx", "f", "pearl")
    assert one(spark, ids.outpoint(F.lit("xyz:1"))) is None
    assert one(spark, ids.iso_time(F.lit(0))) == "1970-01-01T00:00:00Z"


@pytest.mark.parametrize(("text", "want"), [("1", True), ("1.5", True), (".5", False), ("1.", False), ("-1", False), ("1e3", False), ("18446744073709551616", False), ("18446744073709551615", True), ("1.1234567890123456789", False), ("", False)])
def test_token_amount(spark, text, want):
    assert (one(spark, decimals.token_amount(F.lit(text))) is not None) is want


def test_decimal_text(spark):
    assert one(spark, decimals.canonical(decimals.parse(F.lit("1.500")))) == "1.5"
    assert one(spark, decimals.canonical(decimals.parse(F.lit("100"), 0))) == "100"

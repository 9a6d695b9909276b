"""Binary codecs, rune names and JSON actions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import actions, codecs, runes


def test_varints():
    for n in (0, 127, 128, 16384, 2**64, 2**128 - 1):
        assert codecs.read_varints(codecs.write_varint(n)) == [n]
    assert codecs.read_varints(b"\x80") is None
    assert codecs.read_varints(b"\xff" * 19) is None


def script_of(*numbers: int) -> bytes:
    payload = b"".join(map(codecs.write_varint, numbers))
    return b"\x6a\x5d" + bytes([len(payload)]) + payload


def test_runestones():
    stone = codecs.decipher(script_of(2, 3, 4, runes.value_of("UNCOMMONGOODS"), 3, 128, 10, 1, 8, 2**100, 0, 840000, 1, 5, 0, 0, 2, 7, 1), 2)
    assert (stone["cenotaph"], stone["etching"], stone["rune"], stone["cap"]) == (False, True, "2055900680524219742", str(2**100))
    assert [(e["block"], e["tx"], e["amount"], e["output"]) for e in stone["edicts"]] == [(840000, 1, "5", 0), (840000, 3, "7", 1)]
    for bad in ((126, 0), (0, 1, 2, 3), (4,), (22, 9), (0, 840000, 1, 5, 3), (2, 8)):
        assert codecs.decipher(script_of(*bad), 2)["cenotaph"]
    assert not codecs.decipher(script_of(127, 0), 2)["cenotaph"]
    assert codecs.decipher(b"\x6a\x5d\x51", 2)["cenotaph"]
    assert codecs.decipher(b"\x6a\x01a", 2) is None


def test_runestone_column(spark):
    df = spark.createDataFrame([(1, bytearray(script_of(20, 840000, 20, 3)), 1), (2, bytearray(b"\x6a\x00"), 1), (3, None, 1)], "id int, s binary, n int")
    got = {r.id: r.r for r in df.select("id", codecs.runestone(F.col("s"), F.col("n")).alias("r")).collect()}
    assert got[1].mint == "840000:3"
    assert got[2] is None
    assert got[3] is None


ENVELOPE = b"\x20" + b"k" * 32 + b"\xac\x00\x63\x03ord\x01\x01\x0atext/plain\x01\x05\x03\xa1\x61a\x00\x05hello\x68"


def test_envelopes(spark):
    (one,) = codecs.envelopes(ENVELOPE)
    assert (one["body"], one["content_type"], one["duplicate"]) == (b"hello", "text/plain", False)
    (twice,) = codecs.envelopes(b"\x00\x63\x03ord\x01\x01\x01a\x01\x01\x01b\x00\x68")
    assert twice["duplicate"]
    (odd,) = codecs.envelopes(b"\x00\x63\x03ord\x01\x01\x68")
    assert odd["incomplete"]
    (even,) = codecs.envelopes(b"\x00\x63\x03ord\x01\x16\x01a\x68")
    assert even["even"]
    (pushed,) = codecs.envelopes(b"\x00\x63\x03ord\x51\x01a\x00\x68")
    assert pushed["pushnum"]
    (stuttered,) = codecs.envelopes(b"\x00\x00\x00\x63\x03ord\x00\x68")
    assert stuttered["stutter"]
    assert codecs.envelopes(b"\x00\x63\x03ord\x01\x01") == []
    df = spark.createDataFrame([(bytearray(ENVELOPE),)], "s binary").select(F.explode(codecs.inscriptions(F.col("s"))).alias("e"))
    assert df.select(codecs.curse(F.col("e"), F.lit(True), F.lit(0))).first()[0] is None
    assert df.select(codecs.curse(F.col("e"), F.lit(False), F.lit(0))).first()[0] == "not first input"


def test_witness(spark):
    df = spark.createDataFrame([(1, [bytearray(b"sig"), bytearray(b"script"), bytearray(b"\xc0")]), (2, [bytearray(b"sig")])], "id int, w array<binary>")
    assert {r.id: r.s and bytes(r.s) for r in df.select("id", codecs.tapscript(F.col("w")).alias("s")).collect()} == {1: b"script", 2: None}


@pytest.mark.parametrize(("data", "want"), [(b"\xa1\x61a\x82\x01\x41\xff", '{"a": [1, "ff"]}'), (b"\x38\x63", "-100"), (b"\xf9\x3c\x00", "1.0"), (b"\x9f\x01\xff", "[1]"), (b"\x61", None), (b"\xf6", "null")])
def test_cbor(spark, data, want):
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(codecs.cbor_as_json(F.col("b"))).first()[0] == want


def test_directives():
    assert codecs.directive(b"\x6a\x60\x01\x2b\x05pearl\x03bc1\x03\x01\x02\x03") == {"kind": "freeze", "ticker": "pearl", "address": "bc1", "number": 197121}
    assert codecs.directive(b"\x6a\x60\x01\x28\x05pearl\x52")["number"] == 2
    assert codecs.directive(b"\x6a\x60\x01\x28\x05pearl\x52\x51") is None
    assert codecs.inscription_id(bytes(range(32)) + b"\x01") == bytes(range(32))[::-1].hex() + "i1"


def test_rune_names(spark):
    assert [runes.name_of(n) for n in (0, 25, 26, 702, 2**128 - 1)] == ["A", "Z", "AA", "AAA", "BCGDENLQRQWDSLRUGSNLBTMFIJAV"]
    assert all(runes.value_of(runes.name_of(n)) == n for n in (0, 1, 25, 26, 10**20))
    assert runes.value_of("BCGDENLQRQWDSLRUGSNLBTMFIJAW") is None
    assert runes.name_of(runes.minimum_at(840000)) == "ZZYZXBRKWXVA"
    assert runes.minimum_at(10**7) == 0
    assert runes.parse_spaced("A•B.C") == ("ABC", 3)
    assert [runes.parse_spaced(x) for x in (".A", "A..B", "A.", "")] == [None] * 4
    assert runes.spaced("ABC", 3) == "A•B•C"
    assert runes.commitment(256) == b"\x00\x01"
    row = spark.range(1).select(runes.encode(F.lit("26")), runes.decode(F.lit("AA")), runes.without_spacers(F.lit("A•B")), runes.etchable(F.lit("ABC"), F.lit(840000)), runes.supply(F.lit("5"), F.lit(3), F.lit("7"))).first()
    assert (row[0], row[1], row[2], row[3], int(row[4])) == ("AA", "26", "AB", False, 26)


ACTIONS = [
    ('{"p":"brc-20","op":"mint","tick":"ORDI","amt":"1000"}', None), ('{"p":"brc-20","op":"mint","tick":"ordi","amt":1000}', "amount"), ('{"p":"brc-20","op":"burn","tick":"ordi"}', "unknown op"),
    ('{"p":"brc-20","op":"deploy","tick":"abc"}', "ticker length"), ('{"p":"ordx","op":"mint"}', "not brc-20"), ("not json", "not brc-20"),
]


@pytest.mark.parametrize(("body", "reason"), ACTIONS)
def test_token_actions(spark, body, reason):
    got = spark.createDataFrame([(body,)], "b string").select(actions.token_action(F.col("b")).alias("t")).first().t
    assert got.reason == reason


DEPLOYS = [
    ('{"tick":"ordi","max":"21","lim":"1"}', 800000, None), ('{"tick":"ordi","max":"21"}', 800000, None), ('{"tick":"ordi","max":"0"}', 800000, "max"), ('{"tick":"ordi","max":"21","lim":"0"}', 800000, "lim"),
    ('{"tick":"ordi","max":"21","dec":"19"}', 800000, "decimals"), ('{"tick":"ordix","max":"0","self_mint":"true"}', 840000, None), ('{"tick":"ordix","max":"5"}', 840000, "self-mint flag"), ('{"tick":"ordix","max":"5","self_mint":"true"}', 800000, "self-mint height"),
]


@pytest.mark.parametrize(("body", "height", "reason"), DEPLOYS)
def test_token_deploys(spark, body, height, reason):
    got = spark.createDataFrame([(body,)], "b string").select(actions.token_deploy(F.col("b"), F.lit(height)).alias("t")).first().t
    assert got.reason == reason


def test_ordx(spark):
    bodies = ['{"tick":"pearl","lim":"10","n":"5"}', '{"tick":"pearl","lim":"10","n":"3"}', '{"tick":"a"}', '{"tick":"pearl","selfmint":"50%"}', '{"tick":"pearl","block":"5-3"}', '{"tick":"pearl","block":"2000-3000"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, b string")
    got = [r.reason for r in df.select("id", actions.ordx_deploy(F.col("b"), F.lit(10))["reason"].alias("reason")).orderBy("id").collect()]
    assert got == [None, "lim by n", "name", "selfmint without max", "block window", None]
    pairs = spark.createDataFrame([('{"p":"sns","name":"a","kvs":["x=1","y=a=b","z"]}',), ('{"p":"sns","op":"u","name":"a","k":"v"}',)], "b string").select(actions.pairs_of(F.col("b")).alias("m")).collect()
    assert [r.m for r in pairs] == [{"x": "1", "y": "a=b"}, {"k": "v"}]

"""Content codecs against their inverses and golden vectors, and views and issuance where SQL doesn't reach."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import codecs, content
from ledgerweave.operators import issuance, views

STONES = [
    {"edicts": [{"block": 840000, "tx": 3, "amount": "7", "output": 1}, {"block": 840000, "tx": 1, "amount": str(2**100), "output": 0}, {"block": 5, "tx": 9, "amount": "0", "output": 2}]},
    {"etching": True, "terms": True, "turbo": True, "rune": "2055900680524219742", "divisibility": 2, "spacers": 128, "symbol": "$", "premine": "5", "amount": "10", "cap": str(2**100), "height_start": 1, "height_end": 9, "offset_start": 2, "offset_end": 8},
    {"etching": True, "rune": "26"}, {"mint": "840000:3", "pointer": 1}, {},
]


@pytest.mark.parametrize("stone", STONES)
def test_encipher_is_the_inverse(stone):
    got = codecs.decipher(content.encipher(stone), 3)
    assert not got["cenotaph"]
    assert got["edicts"] == sorted(stone.get("edicts", []), key=lambda e: (e["block"], e["tx"]))
    for name, value in stone.items():
        if name != "edicts":
            assert got[name] == value, name


def test_long_stones():
    edicts = [{"block": 840000 + k, "tx": 1, "amount": "1", "output": 0} for k in range(17)]
    script = content.encipher({"edicts": edicts})
    assert script[2] == 0x4C or len(script) <= 78
    assert content.encipher({"edicts": edicts * 2}) is None


def test_edict_scripts(spark):
    rows = [(1, [(840000, 1, "5", 0), (840000, 3, "7", 1)]), (2, None), (3, [(840000 + k, 1, "1", 0) for k in range(40)])]
    df = spark.createDataFrame(rows, "id int, e array<struct<block:bigint,tx:bigint,amount:string,output:bigint>>").select("id", content.edict_script(F.col("e")).alias("s"))
    back = {r.id: r.r for r in df.select("id", codecs.runestone(F.col("s"), F.lit(2)).alias("r")).collect()}
    assert [(e.block, e.tx, e.amount, e.output) for e in back[1].edicts] == [(840000, 1, "5", 0), (840000, 3, "7", 1)]
    assert back[2] is None and back[3] is None


@pytest.mark.parametrize("value", [{}, {"a": "b"}, {"k": "é" * 300, "": "x"}, {str(k): "v" for k in range(30)}])
def test_cbor_round_trip(value):
    assert codecs.read_cbor(content.write_cbor(value)) == (value, len(content.write_cbor(value)))


def test_json_as_cbor(spark):
    rows = [(1, '{"a":"b"}'), (2, '{"a":1}'), (3, "no"), (4, None), (5, "[]")]
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id int, b string").select("id", content.json_as_cbor(F.col("b")).alias("c")).collect()}
    assert bytes(got[1]) == b"\xa1\x61a\x61b"
    assert [got[k] for k in (2, 3, 4, 5)] == [None] * 4


def test_titles(spark):
    text = content.write_cbor
    assert content.titles_of(b"\x63abc") == {"title": "abc", "author": "", "description": ""}
    assert content.titles_of(text({"Collection": "c", "ARTIST": "a", "description": "d", "title": "t"})) == {"title": "c", "author": "a", "description": "d"}
    named = b"\xa1\x65title" + text({"Name": "n"})
    assert content.titles_of(named)["title"] == "n"
    for bad in (b"", b"\x61", b"\x01", b"\xa1\x01\x02"):
        assert content.titles_of(bad) == {"title": "", "author": "", "description": ""}
    df = spark.createDataFrame([(1, bytearray(named)), (2, None)], "id int, m binary").select("id", content.titles(F.col("m")).alias("t"))
    assert {r.id: r.t and r.t.title for r in df.collect()} == {1: "n", 2: None}


def test_properties(spark):
    id_bytes = bytes(range(32))
    item = b"\xa3\x00\x58\x20" + id_bytes + b"\x01\xa1\x00\x61t\x02\x05"
    data = b"\xa2\x00\x81" + item + b"\x01\xa1\x00\x61g"
    assert content.properties_of(data) == {"title": "g", "items": [{"id": id_bytes[::-1].hex() + "i0", "index": 5, "title": "t"}]}
    assert content.properties_of(b"\x61") is None
    assert content.properties_of(b"\x01") is None
    df = spark.createDataFrame([(bytearray(data),)], "d binary").select(content.properties(F.col("d")).alias("p"))
    assert df.first().p["items"][0]["index"] == 5


def test_forms(spark):
    row = spark.createDataFrame([(json.dumps({"p": "sns", "op": "reg", "name": " a b "}), "no", '[{"start":1,"size":2},{"start":5,"size":0}]')], "a string, b string, c string").select(
        content.domain_action(F.col("a"))["name"], content.domain_action(F.col("b")), content.ranges_of(F.col("c")), content.ranges_of(F.col("b")),
        content.media_class(F.lit("audio/wav"), F.lit("x")), content.media_class(F.lit("audio/wav"), F.lit(None)), content.stake_asset(F.lit(127_999), False)["name"], content.stake_asset(F.lit(128_000), False)["name"],
    ).first()
    assert (row[0], row[1], [tuple(r) for r in row[2]], row[3]) == ("a b", None, [(1, 2), (5, 0)], None)
    assert tuple(row[4:]) == ("audio", "unknown", "ordx:f:dogcoin", "ordx:f:rarepizza")


def test_sats_of_inscriptions(spark):
    rows = [(1, 5, 2, 0, 7), (2, 5, 0, 3, 7), (3, 5, None, 0, 0)]
    df = spark.createDataFrame(rows, "id int, h int, tx int, place int, vin int")
    got = {r.id: r.s for r in df.select("id", views.sat_of(F.col("h"), F.col("tx"), F.col("place"), F.col("vin")).alias("s")).collect()}
    assert got == {1: 5 << 35 | 2 << 18, 2: 5 << 35 | 7, 3: -1}
    assert spark.range(1).select(views.any_of([F.lit(None).cast("boolean"), F.lit(True)]), views.any_of([F.lit(None).cast("boolean")]), views.any_of([])).first() == (True, False, False)


def test_direct_mints_and_registration(spark):
    rows = [("abc", 10, False, True), ("abC", 10, False, True), ("d", 0, False, True), ("e", 5, True, True), ("f", 5, None, False), ("g", 5, None, True)]
    got = issuance.direct_mints(spark.createDataFrame(rows, "ticker string, value long, immutable boolean, valid boolean")).collect()
    assert sorted((r.ticker, r.supply) for r in got) == [("abc", 10), ("g", 5)]
    candidates = [("x", 9, 1, 0, 1, 0), ("x", 8, 5, 0, 2, 0), ("x", 8, 4, 1, 3, 0), ("x", 8, 4, 1, 4, 0), ("X", 1, 1, 1, 1, 1)]
    (won,) = issuance.registered(spark.createDataFrame(candidates, "ticker string, commit_height int, commit_tx int, commit_index int, height int, tx int")).collect()
    assert (won.ticker, won.height) == ("x", 3)


def test_empty_tables(spark):
    mints = spark.createDataFrame([], "ticker string, height long, tx long, value long, valid boolean")
    tickers = spark.createDataFrame([], "ticker string, commit_height long, mint_height long, mint_amount long, most long")
    assert issuance.minted(issuance.accepted_mints(mints, tickers)).count() == 0
    sats = spark.createDataFrame([], "sat long, utxo long, offset long, owner long")
    assert views.disable(spark.createDataFrame([(1, "p")], "sat long, proof string"), spark.createDataFrame([], "utxo long, proof string"), sats).count() == 1

"""Decoding of raw blocks, the flow of every sat, and bucketed rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import satflow
from ledgerweave.sources import blocks, buckets

SCRIPTS = [
    ("76a91462e907b15cbf27d5425399ebf6f0fb50ebb88f1888ac", "pubkeyhash", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"),
    ("0014751e76e8199196d454941c45d1b3a323f1433bd6", "witness_v0_keyhash", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"),
    ("512079be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798", "witness_v1_taproot", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"),
    ("6a0568656c6c6f", "nulldata", "OP_RETURN"), ("51", "nonstandard", "UQ=="),
]


@pytest.mark.parametrize(("script", "kind", "address"), SCRIPTS)
def test_addresses(script, kind, address):
    assert blocks.address_of(bytes.fromhex(script)) == (kind, address)


def raw_block() -> bytes:
    size = lambda n: bytes([n])
    coinbase = b"\x01\0\0\0" + size(1) + b"\0" * 32 + b"\xff" * 4 + size(2) + b"hi" + b"\xff" * 4 + size(1) + (5000).to_bytes(8, "little") + size(25) + bytes.fromhex(SCRIPTS[0][0]) + b"\0" * 4
    spend = b"\x02\0\0\0\x00\x01" + size(1) + bytes(range(32)) + b"\x01\0\0\0" + size(0) + b"\xff" * 4 + size(2) + (7).to_bytes(8, "little") + size(0) + (0).to_bytes(8, "little") + size(7) + bytes.fromhex(SCRIPTS[3][0]) + size(1) + size(3) + b"wit" + b"\0" * 4
    return b"\x04\0\0\0" + b"\x11" * 32 + b"\x22" * 32 + (1_600_000_000).to_bytes(4, "little") + b"\0" * 8 + size(2) + coinbase + spend


def test_decode(spark):
    rows = blocks.decode(spark.createDataFrame([(5, bytearray(raw_block())), (6, bytearray(b"short")), (7, None)], "height long, raw binary"))
    heads, ins, outs = blocks.tables(rows.cache())
    assert {(r.height, r.prev_hash, r.time, r.problem) for r in heads.collect()} == {(5, "11" * 32, 1_600_000_000, None), (6, None, None, "a block ends early"), (7, None, None, "a block ends early")}
    assert [(r.tx, r.prev_vout, [bytes(w) for w in r.witness]) for r in ins.orderBy("tx").collect()] == [(0, 4294967295, []), (1, 1, [b"wit"])]
    assert [(r.tx, r.vout, r.value, r.address) for r in outs.orderBy("tx", "vout").collect()] == [(0, 0, 5000, SCRIPTS[0][2]), (1, 0, 7, "UQ=="), (1, 1, 0, "OP_RETURN")]


def test_every_sat_has_one_place(spark):
    """Against moving sats one by one."""
    rng = random.Random(4)
    ins, outs, where = [], [], {}
    n = 0
    for height in (1, 2):
        pool, want = [], []
        for tx in range(1, 6):
            sats = []
            for vin in range(rng.randint(1, 4)):
                n += 1
                value = rng.randint(0, 9)
                ins.append((height, tx, vin, n, value))
                sats += [(n, k) for k in range(value)]
            for vout in range(rng.randint(1, 4)):
                n += 1
                value = min(rng.randint(0, 8), len(sats))
                outs.append((height, tx, vout, n, value))
                where.update({s: (n, k) for k, s in enumerate(sats[:value])})
                sats = sats[value:]
            pool += sats
        reward = len(pool) + (20 if height == 1 else -2)
        want = [(None, k) for k in range(max(0, reward - len(pool)))] + pool
        for vout, value in enumerate((reward // 2, reward - reward // 2)):
            n += 1
            outs.append((height, 0, vout, n, value))
            where.update({s: (n, k) for k, s in enumerate(want[:value]) if s[0] is not None})
            want = want[value:]
    table = lambda rows, k: spark.createDataFrame(rows, f"height int, tx int, {k} int, utxo long, value long")
    moves = satflow.block_flow(table(ins, "vin"), table(outs, "vout")).cache()
    got = {}
    for r in moves.collect():
        if r.from_utxo is not None and r.to_utxo is not None:
            got.update({(r.from_utxo, r.from_offset + k): (r.to_utxo, r.to_offset + k) for k in range(r.amount)})
    assert got == where
    assert moves.where("from_utxo is null").agg(F.sum("amount")).first()[0] == 20
    utxo = next(u for _, _, _, u, v in ins if v > 4)
    assets = spark.createDataFrame([("t", utxo, 1, 4), ("t", 10**6, 0, 3)], "ticker string, utxo long, start long, end long")
    held = {(r.utxo, k) for r in satflow.carry(assets, moves).collect() for k in range(r.start, r.end)}
    assert held == {where[utxo, k] for k in range(1, 4) if (utxo, k) in where} | {(10**6, k) for k in range(3)}


def test_spend(spark):
    outs = spark.createDataFrame([("a", 0, 1, 50, "x")], "txid string, vout int, utxo long, value long, owner string")
    ins = spark.createDataFrame([(2, 1, 0, "a", 0), (2, 1, 1, "b", 0)], "height int, tx int, vin int, prev_txid string, prev_vout int")
    assert {(r.vin, r.utxo, r.value) for r in satflow.spend(ins, outs).collect()} == {(0, 1, 50), (1, None, None)}


def test_duplicate_coinbases(spark):
    rows = spark.createDataFrame([(91842, blocks.DUPLICATE_COINBASES[91842], 0), (1, "t", 0)], "h int, t string, v int")
    names = {r[0] for r in rows.select(blocks.outpoint_name(F.col("h"), F.col("t"), F.col("v"))).collect()}
    assert names == {blocks.DUPLICATE_COINBASES[91842] + ":1", "t:0"}


def test_buckets(spark, tmp_path):
    path = str(tmp_path / "b")
    buckets.write(spark.range(2500).withColumn("v", F.lit("old")), path)
    buckets.write(spark.createDataFrame([(1500, "new"), (9000, "new")], "id long, v string"), path)
    assert buckets.read(spark, path).count() == 2501
    assert {(r.id, r.v) for r in buckets.read(spark, path, 1499, 1502).collect()} == {(1499, "old"), (1500, "new"), (1501, "old")}

"""Order-dependent rules, sources and streams on small cases."""

from __future__ import annotations

import gzip
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerweave.operators import flow, intervals, ordered, paging
from ledgerweave.operators import protocols as P
from ledgerweave.sources import csv
from ledgerweave.streaming import accounts, blocks, mempool


def test_colour():
    assert P.colour([("x", 1000)], [400, 600], False) == ({(0, "x"): 400, (1, "x"): 600}, {})
    got, burned = P.colour([("a", 600), ("b", 600)], [600, 700], False)
    assert got == {(0, "a"): 600, (0, "b"): 600}
    assert not burned
    assert P.colour([("a", 650)], [600, 700], True) == ({(0, "a"): 600, (1, "a"): 50}, {})
    assert P.split_colour([("a", 500)], [400, 300, 900], {"a": 400}) == ({(1, "a"): 300, (2, "a"): 200}, {})


def test_edicts():
    assert P.apply_edicts({"r": 10}, [("r", 0, 3)], 3, [0, 1, 2]) == ({(0, "r"): 4, (1, "r"): 3, (2, "r"): 3}, {})
    assert P.apply_edicts({"r": 10}, [("r", 4, 3)], 3, [0, 1, 2]) == ({(0, "r"): 4, (1, "r"): 4, (2, "r"): 2}, {})
    assert P.apply_edicts({"r": 10}, [("r", 3, 1)], 2, [0, 1]) == ({(1, "r"): 3, (0, "r"): 7}, {})
    assert P.apply_edicts({"r": 10}, [("r", 0, 1)], 2, [0, 1], cenotaph=True) == ({}, {"r": 10})
    assert P.apply_edicts({"r": 10}, [], 1, []) == ({}, {"r": 10})


def test_freeze(spark):
    steps = [(1, 88, k, a, n) for k, (a, n) in enumerate([("receive", 2), ("freeze", 0), ("spend", 2)])] + [(1, 7, k, a, n) for k, (a, n) in enumerate([("receive", 2), ("freeze", 0), ("unfreeze", 0)])]
    rows = spark.createDataFrame(steps, "ticker long, owner long, seq long, action string, amount long")
    out = {(r.owner, r.seq): r for r in P.ordered_fold(rows, ["ticker", "owner"], ["seq"], P.freeze_account(), P.FROZEN).collect()}
    assert out[88, 1].frozen == 2
    assert (out[88, 2].burned, out[88, 2].held) == (2, 0)
    assert (out[7, 2].frozen, out[7, 2].is_frozen) == (0, False)


def test_token_account(spark):
    log = [("mint", 1, 5), ("deploy", 1, 0), ("deploy", 2, 0), ("mint", 1, 60), ("mint", 1, 101), ("mint", 2, 60), ("inscribe", 1, 70), ("inscribe", 1, 40), ("move", 1, 0), ("move", 1, 0), ("inscribe", 1, 20), ("cancel", 1, 0)]
    rows = spark.createDataFrame([(1, k, o, 2, a, n) for k, (a, o, n) in enumerate(log)], "ticker long, seq long, owner long, receiver long, action string, amount long")
    out = sorted(P.ordered_fold(rows, ["ticker"], ["seq"], lambda: P.TokenAccount(100, 100), P.ACCOUNT).collect(), key=lambda r: r.seq)
    assert [(r.accepted, r.amount) for r in out] == [(False, 0), (True, 0), (False, 0), (True, 60), (False, 0), (True, 40), (False, 0), (True, 40), (True, 40), (False, 0), (True, 20), (True, 20)]
    assert (out[-1].available, out[-1].transferable) == (20, 0)


def test_skipping_cap(spark):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate([400, 200, 100, 1])], "ticker long, seq long, amount long")
    out = sorted(P.ordered_fold(rows, ["ticker"], ["seq"], lambda: P.SkippingCap(500), P.SKIPPED).collect(), key=lambda r: r.seq)
    assert [r.accepted for r in out] == [True, False, True, False]


def test_allocation_conserves(spark):
    ins = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (1, "c", 4)], "g int, i string, v long")
    outs = spark.createDataFrame([(1, "x", 3), (1, "y", 5), (1, "z", 9)], "g int, o string, v long")
    ends = lambda df, k: flow.running_ends(df, ["g"], [F.col(k)], "v")
    got = {(r.i, r.o): r.amount for r in flow.allocate(ends(ins, "i"), ends(outs, "o"), ["g"], "i", "o").collect()}
    assert got == {("a", "x"): 3, ("b", "y"): 3, ("c", "y"): 2, ("c", "z"): 2}


def test_empty_frames(spark):
    none = spark.createDataFrame([], "g int, start long, end long")
    assert intervals.islands(none, "g").count() == 0
    assert intervals.subtract(none, none, "g").count() == 0
    assert ordered.first_wins(none, ["g"], ["start"]).count() == 0
    assert paging.paginate(none, [F.col("start")], 0, 10).count() == 0


def test_pages_past_the_end(spark):
    rows = spark.range(5)
    assert paging.paginate(rows, [F.col("id")], 9, 3).count() == 0
    assert [r.id for r in paging.paginate(rows, [F.col("id")], 3, 0).collect()] == [3, 4]
    assert {r.total for r in paging.paginate(rows, [F.col("id")], 3, 1).collect()} == {5}
    assert [r.id for r in paging.seek(rows, "id", 3, 2, reverse=True).collect()] == [2, 1]


def test_contains(spark):
    a = spark.createDataFrame([(1, 0, 10), (2, 0, 3)], "g int, start long, end long")
    b = spark.createDataFrame([(1, 2, 5), (2, 2, 5)], "g int, start long, end long")
    assert {r.g: r.contained for r in intervals.contains(a, b, "g").collect()} == {1: True, 2: False}


def test_history_csv(spark, tmp_path):
    text = "﻿ticker,type,valid,txid,vout,offset,inscriptionNumber,amount,height\nORDI,mint,1,t1,0,0,7,10,5\nordi,mint,0,t2,0,0,8,10,9\nORDI,mint,1,t1,0,0,7,10,5\n"
    with gzip.open(tmp_path / "h.csv.gz", "wt") as f:
        f.write(text)
    rows = csv.read_history(spark, str(tmp_path / "h.csv.gz")).collect()
    assert [(r.ticker, r.inscriptionNumber, r.amount) for r in rows] == [("ordi", 7, "10")]
    assert tuple(csv.height_range(csv.read_csv(spark, str(tmp_path / "h.csv.gz"), "history")).first()) == (5, 9)


def test_holder_text_and_snapshot(spark, tmp_path):
    (tmp_path / "h.txt").write_text('height: 930812\n"bc1a": 12,\n"bc1b": 3,\n')
    assert sorted(map(tuple, csv.read_holder_text(spark, str(tmp_path / "h.txt")).collect())) == [(930812, "bc1a", 12), (930812, "bc1b", 3)]
    tickers = spark.createDataFrame([("t", "id")], "name string, atomical string")
    utxos = spark.createDataFrame([("t", "x:1", 5)], "ticker string, outpoint string, amount long")
    csv.write_snapshot(tickers, utxos, 9, str(tmp_path / "snap"))
    assert [r.value for r in spark.read.text(str(tmp_path / "snap")).collect()] == ["status|height=9", "ticker|name=t|atomical=id", "utxo|ticker=t|outpoint=x:1|amount=5"]
    other = utxos.withColumn("amount", F.lit(6).cast("long"))
    assert [tuple(r) for r in csv.diff(utxos, other, ["ticker", "outpoint"], "amount").collect()] == [("t", "x:1", 5, 6)]


def test_stream_replays_like_a_batch(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    chain = pd.DataFrame({"height": range(2500), "hash": [f"h{k}" for k in range(2500)]})
    spark.createDataFrame(chain).write.parquet(source)
    schema = spark.read.parquet(source).schema
    blocks.ingest(blocks.block_stream(spark, source, schema), target, checkpoint).awaitTermination()
    fork = pd.DataFrame({"height": range(2400, 2600), "hash": [f"f{k}" for k in range(2400, 2600)]})
    spark.createDataFrame(fork).write.mode("append").parquet(source)
    blocks.ingest(blocks.block_stream(spark, source, schema), target, checkpoint).awaitTermination()
    out = {r.height: r.hash for r in spark.read.parquet(target).collect()}
    assert out == {**{k: f"h{k}" for k in range(2400)}, **{k: f"f{k}" for k in range(2400, 2600)}}
    assert blocks.committed(spark.read.parquet(target), 6).count() == 2594
    assert ordered.first_difference(spark.createDataFrame(chain), spark.read.parquet(target), "height", "hash").first()[0] == 2400


def test_chain_rules(spark):
    rows = spark.createDataFrame([(1, "a", "z"), (2, "b", "a"), (3, "c", "x")], "height int, hash string, prev_hash string")
    assert [r.height for r in blocks.broken_links(rows).collect()] == [3]
    late = spark.createDataFrame([(10, 9), (12, 5), (13, 13)], "height int, effective int")
    assert blocks.restart_height(late).first()[0] == 5


def test_mempool(spark):
    spends = spark.createDataFrame([("a", "o1", 1), ("b", "o1", 2), ("c", "o2", 3)], "txid string, outpoint string, arrived int")
    edges = spark.createDataFrame([("a", "d"), ("d", "e"), ("b", "f")], "parent string, child string")
    assert sorted(r.txid for r in mempool.evicted(spends, edges).collect()) == ["a", "d", "e"]
    done, rest = mempool.confirm(spends, spark.createDataFrame([("b",)], "txid string"))
    assert (done.count(), rest.count()) == (1, 2)
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "outpoint string")
    got = mempool.resolve_inputs(frame("1", "2", "3", "4"), frame("1"), frame("2"), frame("2", "3")).collect()
    assert {r.outpoint: r.status for r in got} == {"1": "confirmed", "2": "plain", "3": "pending", "4": "blocked"}


def test_streamed_fold_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    kinds = ["deploy", "mint", "mint", "inscribe", "move", "cancel"]
    rows = [(k % 3, k, rng.randint(1, 4), rng.randint(1, 4), rng.choice(kinds), rng.randint(1, 40)) for k in range(300)]
    schema = "ticker long, seq long, owner long, receiver long, action string, amount long"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={part}"))
    want = sorted(map(tuple, P.ordered_fold(spark.createDataFrame(rows, schema), ["ticker"], ["seq"], lambda: P.TokenAccount(2000, 100), P.ACCOUNT).collect()))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    folded = accounts.fold_stream(stream, "ticker", ["seq"], lambda: P.TokenAccount(2000, 100), P.ACCOUNT)
    sink = folded.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    sink.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("ticker", "seq", "owner", "action", "accepted", "amount", "available", "transferable").collect())) == want


def test_allocation_splits_a_hot_group(spark):
    rng = np.random.default_rng(6)
    sides = [spark.createDataFrame(pd.DataFrame({"g": 1, "k": range(3000), "v": rng.integers(1, 50, 3000)})) for _ in range(2)]
    plain = [flow.running_ends(x, ["g"], [F.col("k")], "v") for x in sides]
    split = [flow.running_ends(x, ["g"], [F.col("k")], "v", stretch=F.floor(F.col("k") / 100)) for x in sides]
    assert sorted(plain[0].collect()) == sorted(split[0].collect())
    want = sorted(flow.allocate(plain[0].withColumnRenamed("k", "a"), plain[1].withColumnRenamed("k", "b"), ["g"], "a", "b").collect())
    for width in (1, 70, 10**9):
        assert sorted(flow.allocate(split[0].withColumnRenamed("k", "a"), split[1].withColumnRenamed("k", "b"), ["g"], "a", "b", width).collect()) == want
    ends = [np.cumsum([r.v for r in x.orderBy("k").collect()]) for x in sides]
    cuts = np.unique(np.concatenate(ends))
    cuts = cuts[cuts <= min(e[-1] for e in ends)]
    assert [tuple(r) for r in want] == sorted((1, int(np.searchsorted(ends[0], c)), int(np.searchsorted(ends[1], c)), int(d)) for c, d in zip(cuts, np.diff(np.r_[0, cuts]), strict=True))


def test_a_reorganisation_drops_what_followed_the_orphaned_block(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "height long, tag string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([(h, "old") for h in range(95, 2105)])
    stream = lambda: blocks.ingest(blocks.block_stream(spark, source, spark.createDataFrame([], schema).schema), target, checkpoint, span=100).awaitTermination()
    stream()
    put([(h, "new") for h in range(1050, 1060)])
    stream()
    rows = {r.height: r.tag for r in spark.read.parquet(target).collect()}
    assert rows == {**{h: "old" for h in range(95, 1050)}, **{h: "new" for h in range(1050, 1060)}}


def test_descendants_of_a_cycle_and_a_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)] + [(k, k + 1) for k in range(10, 40)], "parent long, child long")
    out = mempool.descendants(spark.createDataFrame([(1,), (10,)], "node long"), edges).collect()
    assert sorted(map(tuple, out)) == [(1, n) for n in (1, 2, 3, 4)] + [(10, n) for n in range(10, 41)]

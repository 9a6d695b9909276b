"""Numbers, parents, galleries, authority and names of inscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave.operators import inscriptions as I


def test_numbers(spark):
    rows = [(1, 0, 0, 0, 0, False), (1, 0, 0, 1, 0, True), (1, 2, 0, 0, 0, False), (2, 1, 0, 0, 0, True), (900_000, 1, 0, 0, 0, True)]
    df = spark.createDataFrame(rows, "height int, tx int, input int, place int, offset int, cursed boolean")
    assert [(r.number, r.vindicated) for r in I.numbered(df).orderBy("height", "tx", "place").collect()] == [(0, False), (-1, False), (1, False), (-2, False), (2, True)]


def test_reinscriptions(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False)], "sat int, seq int, cursed boolean")
    assert [(r.nth, r.reinscription) for r in I.reinscriptions(df, ["seq"]).orderBy("sat", "seq").collect()] == [(0, 0), (1, 1), (2, 1), (0, 0)]


def test_parents_and_galleries(spark):
    children = spark.createDataFrame([("a", 1, [("p", 5), ("q", 6)]), ("b", 2, [("p", 5)]), ("c", 3, [])], "id string, tx int, parents array<struct<id:string,sat:int>>")
    spent = spark.createDataFrame([(1, 6), (1, 6), (2, 7)], "tx int, sat int")
    assert {r.id: [p.id for p in r.parents] for r in I.valid_parents(children, spent).collect()} == {"a": ["q"], "b": [], "c": []}
    galleries = spark.createDataFrame([("g", ["a", "x", "b"])], "id string, items array<string>")
    assert sorted((r.place, r["item"]) for r in I.gallery(galleries, children).collect()) == [(0, "a"), (2, "b")]
    held = spark.createDataFrame([("o", "a"), ("o", "b"), ("o2", "z")], "owner string, id string")
    lists = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "b")], "collection string, id string")
    assert [tuple(r) for r in I.collection_counts(held, lists).collect()] == [("o", "k", 2)]


def test_freeze_authority(spark):
    tickers = spark.createDataFrame([("t", "i1", 100), ("u", "i2", 50)], "ticker string, id string, selfmint int")
    holders = spark.createDataFrame([("i1", 7), ("i2", 8)], "id string, owner int")
    authority = I.freeze_authority(tickers, holders)
    orders = spark.createDataFrame([(10, 11, "t", 7), (10, 20, "t", 7), (10, 11, "t", 9), (10, 11, "u", 8)], "height int, effective int, ticker string, initiator int")
    assert [(r.effective, r.initiator) for r in I.directives_in_force(orders, authority).collect()] == [(11, 7)]


def test_names(spark):
    rows = spark.createDataFrame([(1, " Alice.btc "), (2, "alice.BTC"), (3, "a b"), (4, "x.y.z"), (5, "bob")], "seq int, name string")
    first = I.registered(rows, ["seq"])
    assert sorted((r.name, r.seq) for r in first.collect()) == [("alice.btc", 1), ("bob", 5)]
    owners = spark.createDataFrame([("bob", 1)], "name string, owner int")
    updates = spark.createDataFrame([("bob", 1, 1, {"k": "old", "j": "1"}), ("bob", 2, 2, {"k": "thief"}), ("bob", 1, 3, {"k": "new"})], "name string, by int, seq int, pairs map<string,string>")
    assert sorted(map(tuple, I.name_values(updates, owners, ["seq"]).collect())) == [("bob", "j", "1"), ("bob", "k", "new")]
    assert [r[0] for r in spark.createDataFrame([(0, 0), (0, 604800), (5, 4)], "a long, b long").select(I.is_fresh(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_commitments(spark):
    etchings = spark.createDataFrame([("t1", 100, b"c"), ("t2", 100, b"c")], "tx string, height int, commitment binary")
    pushes = spark.createDataFrame([("t1", b"c", 95, True), ("t2", b"c", 96, True), ("t2", b"c", 1, False)], "tx string, data binary, created int, taproot boolean")
    assert [r.tx for r in I.commits(etchings, pushes).collect()] == ["t1"]

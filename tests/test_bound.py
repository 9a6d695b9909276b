"""Rules on bound assets and the forms of assets, against brute force."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from ledgerweave.functions import assets, decimals
from ledgerweave.operators import bound
from ledgerweave.sources import csv


def test_mints_in_order(spark):
    rng = random.Random(4)
    old = [(u, t, s, s + 5) for u in range(3) for t in "ab" for s in rng.sample(range(0, 200, 10), 4)]
    new = [(u, t, seq, s, s + rng.randint(1, 9)) for u in range(3) for t in "ab" for seq in range(25) for s in rng.sample(range(0, 220, 11), rng.randint(1, 2))]
    schema = "utxo int, ticker string, start long, end long"
    out = bound.apply_mints(spark.createDataFrame(old, schema), spark.createDataFrame(new, "utxo int, ticker string, seq int, start long, end long"), 16).collect()
    want = list(old)
    for u in range(3):
        for t in "ab":
            first = [(s, e) for a, b, s, e in old if (a, b) == (u, t)]
            taken = []
            for seq in range(25):
                mine = [(s, e) for a, b, q, s, e in new if (a, b, q) == (u, t, seq)]
                if not any(s < y and x < e for s, e in mine for x, y in first + taken):
                    taken += mine
            want += [(u, t, s, e) for s, e in taken]
    assert sorted(map(tuple, out)) == sorted(want)
    assert len(want) > len(old)


def test_release_needs_owner_ticker_and_output(spark):
    requests = spark.createDataFrame([("t1", "PEARL", 0, 7), ("t1", "pearl", 0, 7), ("t1", "pearl", 1, 7), ("t1", "none", 0, 7), ("t2", "pearl", 9, 7), ("t3", "pearl", 0, 8)], "tx string, ticker string, vout int, initiator long")
    outputs = spark.createDataFrame([("t1", 0, 10, 7), ("t1", 1, 11, 9), ("t2", 0, 12, 7), ("t3", 0, 13, 8)], "tx string, vout int, utxo long, owner long")
    holders = spark.createDataFrame([(10, "pearl", 100), (10, "ruby", 5), (11, "pearl", 1), (12, "pearl", 2)], "utxo long, ticker string, amount long")
    history, left = bound.unbind(requests, outputs, holders, spark.createDataFrame([("pearl",), ("ruby",)], "ticker string"))
    assert [tuple(r) for r in history.collect()] == [("pearl", 7, 10, 100)]
    assert sorted((r.utxo, r.ticker) for r in left.collect()) == [(10, "ruby"), (11, "pearl"), (12, "pearl")]


def test_unconfirmed_rune_outputs():
    give = bound.rune_outputs
    plain = [False, False, True]
    assert give({}, [("r", 5, 0)], plain) == [False, False, False]
    assert give({"r": 5}, [], plain) == [True, False, False]
    assert give({"r": 5}, [("r", 5, 1)], plain) == [False, True, False]
    assert give({"r": 5}, [("r", 3, 1)], plain) == [True, True, False]
    assert give({"r": 5}, [("r", 0, 2)], plain) == [False, False, False]
    assert give({"r": 1}, [("r", 0, 3)], plain) == [True, False, False]
    assert give({"r": 5}, [("r", 2, 3)], plain) == [True, True, False]
    assert give({"r": 5}, [("r", 2, 4)], plain) is None
    assert give({"r": 5}, [], plain, pointer=1) == [False, True, False]
    assert give({"r": 5}, [], plain, pointer=3) is None
    assert give({"r": 5}, [], plain, pointer=2) == [False, False, False]
    assert give({"r": 5}, [], plain, cenotaph=True) == [False, False, False]
    assert give({}, [], plain, mints_or_etches=True) is None


def test_amount_forms(spark):
    rng = random.Random(5)
    numbers = [0, 1, 9, 10, 95, 99999, 123456789] + [rng.randrange(10**k) for k in range(1, 30)]
    rows = spark.createDataFrame([(str(n),) for n in numbers], "n string")
    n = F.col("n").cast("decimal(38,0)")
    out = rows.select("n", decimals.square_root(n, F.lit(8)).alias("root"), decimals.scientific(n, 3).alias("sci"), decimals.pile(F.col("n"), 4, F.lit("R")).alias("pile")).collect()
    for r in out:
        v = int(r.n)
        assert int(r.root) == math.isqrt(v * 10**8)
        digits = r.n + "0" * 5
        mantissa, exponent = int(digits[:4]) + (digits[4] >= "5"), len(r.n) - 1
        if mantissa == 10_000:
            mantissa, exponent = 1000, exponent + 1
        text = str(mantissa).ljust(4, "0") if v else "0000"
        assert r.sci == f"{text[0]}.{text[1:4]}E+{exponent}" or v == 0
        whole, fraction = divmod(v, 10**4)
        assert r.pile == (f"{whole}.{fraction:04d}".rstrip("0") if fraction else str(whole)) + " R"
    texts = [("1.25:2", 1.25), ("7", 7.0), ("7:0", 7.0), ("1.255:2", None), ("1:19", None), ("1:2:3", None), ("", None), ("a:1", None)]
    found = spark.createDataFrame(texts, "t string, v double").select("t", "v", decimals.parse_with_precision(F.col("t")).alias("p")).collect()
    assert all((r.p is None) == (r.v is None) and (r.p is None or float(r.p.value) == r.v) for r in found)


def test_assets_of_an_output(spark):
    row = spark.sql("select array(named_struct('name', 'a', 'amount', 5L), named_struct('name', 'b', 'amount', 7L)) as held")
    for amount, left, rest in ((3, [("a", 2), ("b", 7)], 0), (5, [("b", 7)], 0), (9, [("b", 7)], 4)):
        got = row.select(assets.without_amount(F.col("held"), F.lit("a"), F.lit(amount)).alias("x")).first().x
        assert ([tuple(v) for v in got.assets], got.rest) == (left, rest)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    assert row.select(assets.occupied_sats(empty, F.lit(0), F.col("held.amount"))).first()[0] == 12


def test_csv_parts(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("address,height,token\n" + "".join(f"a{k},{k},t\n" for k in range(25)) + "x,,t\n")
    csv.split_csv(spark, str(source), str(tmp_path / "parts"), 10)
    files = sorted((tmp_path / "parts").glob("*.csv"))
    assert len(files) == 3
    assert all(len(f.read_text().splitlines()) <= 11 and f.read_text().startswith("address") for f in files)
    csv.filter_csv(spark, str(source), str(tmp_path / "low"), 9)
    assert spark.read.option("header", True).csv(str(tmp_path / "low")).count() == 10
    (tmp_path / "h.csv").write_text("address,overall_balance,last_height,updated_at\nz,1.5,7,2024/05/06 07:08\ny,2,8,soon\n")
    rows = {r.address: r for r in csv.read_token_holders(spark, str(tmp_path / "h.csv")).collect()}
    assert rows["z"].updated_at.minute == 8
    assert rows["y"].updated_at is None

"""Larger and repeated keys: rules that small tables don't reach, and steps whose work must not grow faster than their input."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from ledgerweave.functions import names
from ledgerweave.operators import bound, satflow, views
from ledgerweave.plans.registry import ORACLE_SQL, QUERIES


def test_full_dates_of_any_year(spark, tmp_path):
    duckdb.sql(f"copy (select unnest([0, 33, 54333, 100003, 100008, 6000000]) as event_id) to '{tmp_path}/events.parquet' (format parquet)")
    want = duckdb.sql(f"with events as (select * from '{tmp_path}/events.parquet') select event_id, full_date from ({ORACLE_SQL['date_names']})").fetchall()
    assert sorted((r.event_id, r.full_date) for r in QUERIES["date_names"](spark, str(tmp_path)).collect()) == sorted(want)
    assert {full for _, full in want} == {True, False}
    later = spark.range(1).select(names.is_full_date(F.lit("21010210")), names.name_filter(F.lit("21010210"), "FDate"), names.is_full_date(F.lit("21010210"), (0, 9999))).first()
    assert tuple(later) == (False, False, True)


def test_disable_meets_each_output_once(spark):
    """Many requests for outputs with many sats: the join makes one row for each sat, not one for each request."""
    sats = spark.range(3000).select(F.col("id").alias("sat"), (F.col("id") % 2).alias("utxo"))
    asked = spark.range(400).select((F.col("id") % 2).alias("utxo"), F.format_string("p%03d", "id").alias("proof"))
    new = views.disable(spark.createDataFrame([(0, "before")], "sat long, proof string"), asked, sats)
    rows = {r.sat: r.proof for r in new.collect()}
    assert len(rows) == 3000
    assert (rows[0], rows[1], rows[2]) == ("before", "p001", "p000")
    assert joined(new) <= 3000 + 2999


def joined(df):
    """Rows that the joins of a plan that has run gave out, as its metrics count them."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
        if "Join" in node.nodeName():
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
    return found


def test_block_flow_without_joins(spark):
    """Fees keep their input's place as they go, and new sats come from the same pass: nothing is joined back."""
    ins = spark.createDataFrame([(1, 1, 0, 10, 5), (1, 1, 1, 11, 4), (2, 3, 0, 12, 6)], "height int, tx int, vin int, utxo long, value long")
    outs = spark.createDataFrame([(1, 1, 0, 20, 3), (1, 0, 0, 30, 9), (2, 3, 0, 21, 1), (2, 0, 0, 31, 4), (3, 0, 0, 32, 7)], "height int, tx int, vout int, utxo long, value long")
    moves = satflow.block_flow(ins, outs)
    want = [(1, 10, 0, 20, 0, 3), (1, None, 0, 30, 0, 3), (1, 10, 3, 30, 3, 2), (1, 11, 0, 30, 5, 4), (2, 12, 0, 21, 0, 1), (2, 12, 1, 31, 0, 4), (2, 12, 5, None, None, 1), (3, None, 0, 32, 0, 7)]
    assert {tuple(r) for r in moves.collect()} == set(want)
    assert "Join" not in moves._jdf.queryExecution().optimizedPlan().toString()


def test_unconfirmed_by_every_sat(spark):
    """Occupied outputs as a walk over all sats gives them, with one join, that of assets to inputs."""
    rng = random.Random(11)
    ins, outs, assets, want = [], [], [], set()
    for tx in range(1, 150):
        fails, line, held, n = False, [], 0, rng.randint(0, 4)
        for vin in range(n):
            utxo = tx * 10 + vin
            value = None if rng.random() < 0.05 else rng.randint(0, 6)
            fails, held = fails or value is None, held + (value or 0)
            ins.append((tx, vin, utxo, value))
            marked = [False] * (value or 0)
            for _ in range(rng.choice([0, 0, 1, 2])):
                protocol = rng.choice(["ordx", "ordx", "ordx", "runes", "brc20"])
                start = None if protocol == "runes" or rng.random() < 0.1 else rng.randint(0, 6)
                end = None if start is None else start + rng.randint(1, 3)
                assets.append((utxo, protocol, start, end))
                fails = fails or (protocol != "runes" and start is None)
                if protocol != "runes" and start is not None:
                    marked = [m or start <= k < end for k, m in enumerate(marked)]
            line += marked
        values = [rng.randint(0, 5) for _ in range(rng.randint(1, 3))]
        known, at = not fails and sum(values) <= held, 0
        for vout, value in enumerate(values):
            outs.append((tx, vout, value))
            want.add((tx, vout, known, known and any(line[at : at + value])))
            at += value
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    judged = bound.allocate_unconfirmed(table(ins, "tx long, vin int, utxo long, value long"), table(outs, "tx long, vout int, value long"), table(assets, "utxo long, protocol string, start long, end long"))
    assert {tuple(r) for r in judged.collect()} == want
    assert {w[2:] for w in want} == {(False, False), (True, False), (True, True)}
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1

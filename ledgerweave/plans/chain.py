"""Queries on committed and pending state, reorganisations, the mempool, and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators import flow, ordered, overlay
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import LINE_ORDER, cents, movements, table
from ledgerweave.streaming.blocks import finality
from ledgerweave.streaming.mempool import descendants as closure


@query("""
select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') and o_orderkey % 10 <> 0
union all select o_orderkey, o_custkey, 'N' from orders where o_orderstatus = 'F' and o_orderkey % 10 = 0 and o_orderkey % 20 <> 0
""")
def overlay_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed orders under pending replacements, less deletions."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    committed = orders.where("o_orderstatus in ('F', 'P')")
    added = orders.where("o_orderstatus = 'F' and o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("N"))
    deleted = orders.where("o_orderkey % 20 = 0 or (o_orderstatus = 'P' and o_orderkey % 10 = 0)")
    return overlay.overlay(committed, added, deleted, ["o_orderkey"])


_DAYS = "(select cast(ts as date) as day, cast(sum(hash) as bigint) as total from (select ts, event_id * 31 % 1009 as hash from events) group by 1)"


@query(f"select min(day) as first_different from (select a.day, a.total as x, b.total as y from {_DAYS} a full join (select cast(ts as date) as day, cast(sum(case when event_id % 5000 = 4999 then 7 else event_id * 31 % 1009 end) as bigint) as total from events group by 1) b on a.day = b.day) where x is distinct from y")
def reorg_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day whose checksum differs between two variants of the chain."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    usual = F.col("event_id") * 31 % 1009
    one = events.groupBy("day").agg(F.sum(usual).cast("bigint").alias("total"))
    two = events.groupBy("day").agg(F.sum(F.when(F.col("event_id") % 5000 == 4999, F.lit(7)).otherwise(usual)).cast("bigint").alias("total"))
    return ordered.first_difference(one, two, "day", "total")


@query("""
select day, count(*) as events, day <= (select max(cast(ts as date)) from events) - 6 as final from (select cast(ts as date) as day from events) group by day
""")
def finality_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days at least six below the tip are final."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    return finality(days.withColumn("height", F.unix_date("day")), "height", 6).drop("height")


@query("select event_id, case when event_id % 3 <> 0 then 'missing' else 'added' end as change from events where (event_id % 3 <> 0) <> (event_id % 5 <> 0)")
def mempool_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select("event_id")
    return overlay.snapshot_changes(ids.where("event_id % 3 <> 0"), ids.where("event_id % 5 <> 0"), "event_id")


@query("""
with recursive t as (select conv_id, turn, conv_id * 1000 + turn as node, case when turn > 0 then conv_id * 1000 + turn - 1 end as parent from conversations),
r as (select distinct node as root, node from t where turn = 1 union select r.root, t.node from r join t on t.parent = r.node)
select root, node from r
""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on each conversation's second turn, itself included."""
    turns = table(spark, sf_dir, "conversations").select("turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("node")).distinct()
    edges = turns.where("turn > 0").select((F.col("node") - 1).alias("parent"), F.col("node").alias("child"))
    return closure(turns.where("turn = 1").select("node"), edges)


@query(f"""
with f as (select l_orderkey as utxo, l_partkey as ticker, cast(l_quantity as bigint) as amount from lineitem), i as (select ticker, cast(sum(amount) as bigint) as minted from f group by ticker),
h as (select ticker, cast(sum(amount) as bigint) as held from (select ticker, amount from f join orders on utxo = o_orderkey) group by ticker)
select 'conservation' as audit, count(*) filter (where minted is distinct from held) as mismatches, count(*) as checked from i full join h on i.ticker = h.ticker
""")
def audit_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers whose holders' sum differs from what was minted: none."""
    minted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("ticker")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("minted"))
    held = movements(spark, sf_dir).groupBy("ticker").agg(F.sum("amount").alias("held"))
    wrong = F.when(F.expr("minted is distinct from held"), 1)
    return minted.join(held, "ticker", "full_outer").agg(F.count(wrong).alias("mismatches"), F.count("*").alias("checked")).select(F.lit("conservation").alias("audit"), "mismatches", "checked")


@query("""
with o as (select o_custkey as owner, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total from orders group by 1)
select 'flow' as audit, cast(sum(total) as bigint) as inputs, cast(sum(total) as bigint) as allocated from o
""")
def audit_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value flowing through an allocation is neither made nor lost: orders into themselves, in reverse order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("in_key"), F.col("o_orderkey").alias("out_key"), cents("o_totalprice").alias("v")).where("v > 0")
    inputs = flow.running_ends(orders, ["owner"], [F.col("in_key")], "v")
    outputs = flow.running_ends(orders, ["owner"], [F.col("out_key").desc()], "v")
    moved = flow.allocate(inputs, outputs, ["owner"], "in_key", "out_key").agg(F.sum("amount").cast("bigint").alias("allocated"))
    return orders.agg(F.sum("v").cast("bigint").alias("inputs")).select(F.lit("flow").alias("audit"), "inputs", moved.scalar().alias("allocated"))


@query("select o_orderkey from (select o_orderkey from orders union all select -1 - o_orderkey from orders) where o_orderkey in (select l_orderkey from lineitem) and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def existing_utxos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested outputs, every order and as many that do not exist, that are live and unspent."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    asked = orders.unionByName(orders.select((-1 - F.col("o_orderkey")).alias("o_orderkey")))
    return overlay.existing(asked, lines, lines.where("l_returnflag = 'R'"), "o_orderkey")


@query(f"select l_orderkey as utxo, cast(count(*) as bigint) as lines, count(distinct l_partkey) as tickers from lineitem group by l_orderkey having count(*) > (select avg(n) from (select count(*) as n from lineitem group by l_orderkey))")
def busy_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with more movements than the mean."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    by = lines.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).groupBy(F.col("l_orderkey").alias("utxo")).agg(F.sum("n").cast("bigint").alias("lines"), F.count("*").alias("tickers"))
    return by.where(F.col("lines") > by.agg(F.avg("lines")).scalar())

"""Queries of the read views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import sats
from ledgerweave.operators import holdings, lookups
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import cents, table


@query("""
with a as (select l_orderkey as utxo, l_partkey as ticker, cast(sum(cast(l_quantity as bigint)) as bigint) as amount from lineitem group by 1, 2),
r as (select utxo, ticker, amount, row_number() over (partition by utxo order by amount desc, ticker) as n, count(*) over (partition by utxo) as assets from a)
select o_orderkey as utxo, cast(round(o_totalprice * 100) as bigint) as value, cast(coalesce(r.assets, 0) as bigint) as assets, r.ticker as largest, r.amount from orders left join r on r.utxo = o_orderkey and r.n = 1
""")
def output_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each output with how many assets it holds and the largest of them."""
    outputs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("utxo"), cents("o_totalprice").alias("value"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("utxo"), F.col("l_partkey").alias("ticker"), F.col("l_quantity").cast("bigint").alias("amount"))
    seen = lookups.output_view(outputs, holdings.balances(lines, "utxo", "ticker"))
    first = F.try_element_at("assets", F.lit(1))
    return seen.select("utxo", "value", F.size("assets").cast("bigint").alias("assets"), first["ticker"].alias("largest"), first["amount"].alias("amount"))


@query("""
with m as (select p_partkey as ticker, p_size as "limit", cast(p_size as bigint) * 60 as "max", cast(coalesce((select sum(cast(l_quantity as bigint)) from lineitem where l_partkey = p_partkey), 0) as bigint) as minted, p_partkey % 40 as s, p_partkey % 40 + 30 as e from part)
select ticker, minted, cast(case when 35 >= s and 35 <= e then least("limit", greatest("max" - minted, 0)) else 0 end as bigint) as permitted, cast(minted * 10000 // "max" as bigint) as progress from m
""")
def ticker_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker with what is minted, what one more mint may take at height 35, and its progress."""
    minted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("ticker")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("m"))
    terms = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ticker"), F.col("p_size").alias("limit"), (F.col("p_size").cast("bigint") * 60).alias("max"), (F.col("p_partkey") % 40).alias("start"), (F.col("p_partkey") % 40 + 30).alias("end")
    )
    known = terms.join(minted, "ticker", "left").withColumn("minted", F.coalesce("m", F.lit(0)).cast("bigint"))
    return lookups.mint_permission(known, F.lit(35)).select("ticker", "minted", "permitted", lookups.progress(F.col("minted"), F.col("max")).alias("progress"))


@query("""
select cast(o_orderdate as date) as day, count(*) as txs, cast(sum(v) as bigint) as value, cast(max(v) as bigint) as largest, count(distinct o_custkey) as addresses
from (select o_orderdate, o_custkey, cast(round(o_totalprice * 100) as bigint) as v from orders) group by 1
""")
def block_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_custkey", cents("o_totalprice").alias("v"))
    return rows.groupBy("day").agg(F.count("*").alias("txs"), F.sum("v").cast("bigint").alias("value"), F.max("v").alias("largest"), F.countDistinct("o_custkey").alias("addresses"))


@query("""
with r as (select user_id, event_id, cast(floor(value) as bigint) as s, cast(floor(value) as bigint) + 1 + event_id % 7 as e from events where event_type = 'purchase'),
b as (select distinct user_id, p from (select user_id, s as p from r union all select user_id, e from r)), w as (select user_id, p, lead(p) over (partition by user_id order by p) as q from b)
select w.user_id, w.p as "start", w.q as "end", count(*) as mints, min(r.event_id) as first_mint from w join r on r.user_id = w.user_id and r.s <= w.p and w.q <= r.e group by w.user_id, w.p, w.q
""")
def remint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's purchase ranges cut where they overlap, each piece with the ranges over it."""
    r = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("mint"), F.floor("value").cast("bigint").alias("start"), (F.floor("value") + 1 + F.col("event_id") % 7).cast("bigint").alias("end"))
    return lookups.split_overlaps(r, "user_id")


@query("""
with w as (select user_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_type = 'purchase'),
h as (select distinct user_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_type = 'view'),
f as (select user_id, count(*) as n from (select distinct user_id, k from w where not exists (select 1 from h where h.user_id = w.user_id and h.k = w.k)) group by 1), c as (select user_id, count(*) as n from h group by 1)
select w.user_id, w.k, exists (select 1 from h where h.user_id = w.user_id and h.k = w.k) or coalesce(f.n, 0) + coalesce(c.n, 0) <= 30 as accepted from w left join f on f.user_id = w.user_id left join c on c.user_id = w.user_id
""")
def kv_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of keys by users who may hold 30 keys."""
    from ledgerweave.sources.tables import actions

    rows = actions(spark, sf_dir)
    keys = lambda kind: rows.where(F.col("event_type") == kind).select("user_id", "k")
    return lookups.quota(keys("purchase"), keys("view"), "user_id", "k", 30)


@query("select l_orderkey as utxo, ticker, amount, cast(e - amount as bigint) as \"start\", cast(e as bigint) as \"end\" from (select l_orderkey, l_partkey as ticker, amount, sum(amount) over (partition by l_orderkey order by l_partkey rows unbounded preceding) as e from (select l_orderkey, l_partkey, cast(sum(cast(l_quantity as bigint)) as bigint) as amount from lineitem group by 1, 2))")
def pseudo_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output's assets laid end to end."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("utxo"), F.col("l_partkey").alias("ticker"), F.col("l_quantity").cast("bigint").alias("amount"))
    return lookups.end_to_end(holdings.balances(lines, "utxo", "ticker"), ["utxo"], [F.col("ticker")], "amount").select("utxo", "ticker", "amount", "start", "end")


@query("""
select user_id, cast(coalesce(sum(case event_type when 'view' then 1 end), 0) as bigint) as views, cast(coalesce(sum(case event_type when 'click' then 1 end), 0) as bigint) as clicks,
cast(coalesce(sum(case event_type when 'purchase' then 1 end), 0) as bigint) as purchases from events group by user_id
""")
def name_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known keys as columns."""
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count().fillna(0)
    return wide.select("user_id", *(F.col(k).cast("bigint").alias(f"{k}s") for k in ("view", "click", "purchase")))


@query("select event_id, ts from (select event_id, ts from events order by event_id desc limit 50)")
def reorg_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is cut to its last 50 rows once it has over 100."""
    return lookups.trimmed_log(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id", 50, 100)


@query("select o_orderkey, cast(case o_orderkey % 4 when 0 then 7 when 1 then 1 when 2 then 1 else 0 end as bigint) as sats from orders")
def binding_sats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    protocol = F.when(k < 2, "ordx").when(k == 2, "atom").otherwise("runes")
    return table(spark, sf_dir, "orders").select("o_orderkey", lookups.binding_sats(protocol, F.when(k == 0, "f").otherwise("o"), F.lit(7)).cast("bigint").alias("sats"))


@query("""
select k.height, k.h0 + cast(n as bigint) * 100000000 as alpha from (select cast(i as bigint) * 30000 as height, cast(i as bigint) * 30000 * 5000000000 as h0 from range(0, 7) t(i)) k, range(0, 50) s(n)
""")
def alpha_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sat that begins a coin in some early blocks."""
    height = F.col("height")
    blocks = spark.range(0, 7).select((F.col("id") * 30000).alias("height"))
    spans = blocks.select("height", sats.first_ordinal(height).alias("s"), sats.subsidy(height).alias("n"))
    first = F.ceil(F.col("s") / sats.COIN).cast("bigint") * sats.COIN
    return spans.select("height", F.explode(F.sequence(first, F.col("s") + F.col("n") - 1, F.lit(sats.COIN).cast("bigint"))).alias("alpha"))


@query("select count(*) as utxos from (select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') and o_orderkey not in (select l_orderkey from lineitem where l_returnflag in ('A', 'N')))")
def locked_utxos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many outputs hold one kind of asset and no other."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    only = orders.join(lines.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(lines.where("l_returnflag in ('A', 'N')"), "o_orderkey", "left_anti")
    return only.agg(F.count("*").alias("utxos"))

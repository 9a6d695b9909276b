"""Balances, holders and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators import holdings as H
from ledgerweave.operators.paging import paginate, top
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import actions, cents, movements, table

_MOVES = "(select l_partkey as ticker, l_suppkey as minter, l_orderkey as utxo, cast(l_quantity as bigint) as amount, o_custkey as owner from lineitem join orders on l_orderkey = o_orderkey)"


@query(f"select ticker, owner, cast(sum(amount) as bigint) as amount from {_MOVES} group by ticker, owner")
def holders_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.balances(movements(spark, sf_dir), "ticker", "owner")


@query(f"select ticker, count(distinct owner) as holders from {_MOVES} group by ticker")
def holder_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.holder_counts(movements(spark, sf_dir))


@query(f"select owner, p_type as kind, cast(sum(amount) as bigint) as amount from {_MOVES} join part on ticker = p_partkey group by owner, p_type")
def address_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_type").alias("kind"))
    return H.balances(H.balances(movements(spark, sf_dir), "ticker", "owner").join(kinds, "ticker"), "owner", "kind")


@query(f"select p_brand as brand, cast(sum(amount) as bigint) as amount from {_MOVES} join part on ticker = p_partkey where owner = (select min(o_custkey) from orders) group by p_brand")
def address_ticker_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("owner")).scalar()
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_brand").alias("brand"))
    return H.balances(movements(spark, sf_dir).where(F.col("owner") == first).join(brands, "ticker"), "brand")


@query("select l_partkey as ticker, cast(sum(cast(l_quantity as bigint)) as bigint) as minted, count(*) as mints from lineitem group by l_partkey")
def mint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ticker"), F.col("l_quantity").cast("bigint").alias("amount"))
    return H.mint_totals(lines, "ticker")


@query("select l_partkey as ticker, l_suppkey as minter, cast(sum(cast(l_quantity as bigint)) as bigint) as minted, count(*) as mints from lineitem group by l_partkey, l_suppkey")
def mint_total_by_minter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ticker"), F.col("l_suppkey").alias("minter"), F.col("l_quantity").cast("bigint").alias("amount"))
    return H.mint_totals(lines, "ticker", "minter")


@query(f"""
select owner, protocol, ticker, cast(sum(amount) as bigint) as amount from (
  select owner, 'f' as protocol, cast(ticker as varchar) as ticker, amount from {_MOVES}
  union all select user_id, 'action', event_type, 1 from events
  union all select o_custkey, 'plain', '', cast(round(o_totalprice * 100) as bigint) from orders
) group by owner, protocol, ticker
""")
def summary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = movements(spark, sf_dir).select("owner", F.lit("f").alias("protocol"), F.col("ticker").cast("string").alias("ticker"), "amount")
    acts = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.lit("action").alias("protocol"), F.col("event_type").alias("ticker"), F.lit(1).cast("bigint").alias("amount"))
    plain = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.lit("plain").alias("protocol"), F.lit("").alias("ticker"), cents("o_totalprice").alias("amount"))
    return H.summaries(tokens, acts, plain)


@query(f"select ticker, amount, cast(sum(amount) over () as bigint) as grand_total from (select ticker, cast(sum(amount) as bigint) as amount from {_MOVES} group by ticker)")
def rune_total_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.with_grand_total(H.balances(movements(spark, sf_dir), "ticker"))


@query("select split_part(p_name, ' ', 2) as suffix, count(*) as names from part group by 1")
def subname_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("suffix")).agg(F.count("*").alias("names"))


@query(f"select owner, amount, cast(case when amount >= 1000 then 100 else amount // 10 end as bigint) as discount from (select owner, cast(sum(amount) as bigint) as amount from {_MOVES} group by owner)")
def fee_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.balances(movements(spark, sf_dir), "owner").withColumn("discount", H.tiered_discount(F.col("amount"), 1000, 10))


@query("select o_orderkey as utxo, cast(round(o_totalprice * 100) as bigint) as value from orders where o_totalprice >= 1000 and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def plain_utxos(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("utxo"), "o_totalprice")
    assets = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("utxo"))
    return H.spendable(outputs, assets, "utxo", F.col("o_totalprice") >= 1000).select("utxo", cents("o_totalprice").alias("value"))


@query("select c_custkey as owner, c_name as name from customer where c_custkey in (select o_custkey from orders join lineitem on l_orderkey = o_orderkey)")
def has_asset_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("name")).join(movements(spark, sf_dir), "owner", "left_semi")


@query("select l_orderkey as utxo, l_linenumber as vout, l_partkey as ticker, cast(l_quantity as bigint) as amount, o_custkey as owner, c_name as owner_name, c_mktsegment as segment from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey")
def spend_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("utxo"), F.col("l_linenumber").alias("vout"), F.col("l_partkey").alias("ticker"), F.col("l_quantity").cast("bigint").alias("amount"))
    outputs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("utxo"), F.col("o_custkey").alias("owner"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("owner_name"), F.col("c_mktsegment").alias("segment"))
    return lines.join(outputs, "utxo").join(owners, "owner").select("utxo", "vout", "ticker", "amount", "owner", "owner_name", "segment")


@query("select l_partkey as ticker, cast(count(*) as bigint) as mints, (select count(distinct l_partkey) from lineitem) as total from lineitem group by l_partkey order by l_partkey offset 10 limit 10")
def tickers_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("ticker")).agg(F.count("*").alias("mints"))
    return paginate(tickers, [F.col("ticker")], 10, 10)


@query("select event_id, user_id, event_type, ts from events order by event_id desc limit 50")
def topk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), [F.desc("event_id")], 50)


@query(f"""
select ticker, owner, amount, cast(place as bigint) as place, total from (
  select ticker, owner, amount, row_number() over (partition by ticker order by amount desc, owner) as place, count(*) over (partition by ticker) as total
  from (select ticker, owner, cast(sum(amount) as bigint) as amount from {_MOVES} group by ticker, owner)
) where place between 1 and 10
""")
def holders_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerweave.operators.ordered import numbered

    held = H.balances(movements(spark, sf_dir), "ticker", "owner")
    totals = held.groupBy("ticker").agg(F.count("*").alias("total"))
    return numbered(held, ["ticker"], [F.desc("amount"), F.col("owner")], "place", 1).where("place <= 10").join(totals, "ticker").select("ticker", "owner", "amount", "place", "total")


@query("""
select owner, cast(greatest(sum(case side when 'a' then amount else 0 end) - sum(case side when 'b' then amount else 0 end), 0) + sum(case side when 'c' then amount else 0 end) as bigint) as amount from (
  select o_custkey as owner, case o_orderstatus when 'F' then 'a' when 'O' then 'b' else 'c' end as side, cast(round(o_totalprice * 100) as bigint) as amount from orders
) group by owner
""")
def summary_with_unconfirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), "o_orderstatus", cents("o_totalprice").alias("amount"))
    part = lambda where: orders.where(where)
    return H.after_unconfirmed(part("o_orderstatus = 'F'"), part("o_orderstatus = 'O'"), part("o_orderstatus not in ('F', 'O')"), ["owner"])


@query("select event_type as kind, count(*) as actions, count(distinct user_id) as users from events group by event_type")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = actions(spark, sf_dir).select(F.col("event_type").alias("kind"), F.col("user_id").alias("owner"))
    users = H.holder_counts(acts, "kind", "owner").withColumnRenamed("holders", "users")
    return acts.groupBy("kind").agg(F.count("*").alias("actions")).join(users, "kind").select("kind", "actions", "users")

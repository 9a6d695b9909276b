"""Queries that depend on the order of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.operators import flow, ordered
from ledgerweave.operators.paging import paginate, seek
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import LINE_ORDER, cents, table

_ORDER = ", ".join(LINE_ORDER)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINE_ORDER, F.col("l_quantity").cast("bigint").alias("amount"))


@query("select o_custkey, o_orderpriority, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as n from orders) where n = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    return ordered.first_wins(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])


@query("select o_custkey, o_orderdate, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1")
def earliest_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return ordered.first_wins(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(f"""
select l_orderkey as utxo, l_partkey as ticker, cast(l_quantity as bigint) as amount, cast(greatest(0, least(cast(l_quantity as bigint), 500 - coalesce(sum(cast(l_quantity as bigint)) over
(partition by l_partkey order by {_ORDER} rows between unbounded preceding and 1 preceding), 0))) as bigint) as granted from lineitem
""")
def capped_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mints of a ticker up to a cap of 500; the one that reaches it is cut."""
    out = ordered.capped(_lines(spark, sf_dir), ["l_partkey"], [F.col(c) for c in LINE_ORDER], "amount", F.lit(500))
    return out.select(F.col("l_orderkey").alias("utxo"), F.col("l_partkey").alias("ticker"), "amount", "granted")


@query(f"select l_partkey as ticker, l_orderkey as utxo, cast(l_quantity as bigint) as amount, cast(row_number() over (partition by l_partkey order by {_ORDER}) - 1 as bigint) as mint_id from lineitem")
def mint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.numbered(_lines(spark, sf_dir), ["l_partkey"], [F.col(c) for c in LINE_ORDER], "mint_id")
    return out.select(F.col("l_partkey").alias("ticker"), F.col("l_orderkey").alias("utxo"), "amount", "mint_id")


@query("""
select event_id, event_type, cast(case when event_type = 'error' then -n else n - 1 end as bigint) as number from
(select event_id, event_type, row_number() over (partition by event_type = 'error' order by event_id) as n from events)
""")
def inscription_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors count down from -1, all else counts up from 0."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ordered.signed_numbers(rows, F.col("event_type") == "error", "event_id", "number")


@query("""
select event_id, user_id, event_type, cast(row_number() over (partition by user_id, event_type order by event_id) - 1
- coalesce(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as reinscription from events
""")
def reinscription_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the user did this before, less the user's earlier errors."""
    rows = ordered.numbered(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], [F.col("event_id")], "n")
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    errors = F.coalesce(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(before), F.lit(0))
    return rows.select("event_id", "user_id", "event_type", (F.col("n") - errors).cast("bigint").alias("reinscription"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as n from events) where n = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return ordered.last_wins(rows, ["user_id", "event_type"], ["event_id"])


@query("select user_id, k, event_id, value from (select user_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_id, value, event_type, row_number() over (partition by user_id, json_extract_string(props, '$.k') order by event_id desc) as n from events) where n = 1 and event_type <> 'error'")
def live_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user's key, unless the latest action deleted it."""
    from ledgerweave.sources.tables import actions

    rows = actions(spark, sf_dir).select("user_id", "k", "event_id", "value", "event_type")
    return ordered.live_state(rows, ["user_id", "k"], ["event_id"], F.col("event_type") == "error").drop("event_type")


@query("""
with d as (select cast(o_orderdate as date) as day, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as size from orders group by 1)
select day, size, cast(sum(size) over (order by day rows unbounded preceding) - size as bigint) as "start" from d
""")
def block_running_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each day's value begins when days are laid end to end. Days are summed by year first, so that no task orders all of them."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(cents("o_totalprice")).cast("bigint").alias("size"))
    out = flow.two_level_prefix(days.withColumn("year", F.year("day")), "year", [F.col("day")], "size")
    return out.select("day", "size", F.col("before").alias("start"))


@query("""
with s as (select event_id, user_id, cast(case event_type when 'purchase' then round(value * 100) when 'click' then -round(value * 100) else 0 end as bigint) as delta from events)
select event_id, user_id, delta, cast(sum(delta) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as balance from s
""")
def balance_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running balance of a user: purchases add, clicks take."""
    delta = F.when(F.col("event_type") == "purchase", cents("value")).when(F.col("event_type") == "click", -cents("value")).otherwise(0).cast("bigint")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", delta.alias("delta"))
    return ordered.running_balance(rows, ["user_id"], [F.col("event_id")], F.col("delta"))


@query(f"""
select ticker, utxo, amount, cast(n as bigint) as n, total from (
  select l_partkey as ticker, l_orderkey as utxo, cast(l_quantity as bigint) as amount, row_number() over (partition by l_partkey order by {_ORDER}) as n, count(*) over (partition by l_partkey) as total from lineitem
) where n between 11 and 20
""")
def mint_history_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 11 to 20 of each ticker's mints, with how many it has."""
    lines = _lines(spark, sf_dir)
    totals = lines.groupBy(F.col("l_partkey").alias("ticker")).agg(F.count("*").alias("total"))
    rows = ordered.numbered(lines, ["l_partkey"], [F.col(c) for c in LINE_ORDER], "n", 1).where("n between 11 and 20")
    return rows.select(F.col("l_partkey").alias("ticker"), F.col("l_orderkey").alias("utxo"), "amount", "n").join(totals, "ticker")


@query("select o_orderkey as utxo, cast(round(o_totalprice * 100) as bigint) as value, (select count(*) from orders where o_orderstatus <> 'P') as total from orders where o_orderstatus <> 'P' order by value desc, utxo offset 20 limit 20")
def utxo_list_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unspent outputs by value, the third page of ten and the fourth."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("utxo"), cents("o_totalprice").alias("value"))
    return paginate(rows, [F.desc("value"), F.col("utxo")], 20, 20)


@query("select p_partkey as ticker, p_name as name from part where p_partkey > 100 order by p_partkey limit 25")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_name").alias("name"))
    return seek(rows, "ticker", 100, 25)

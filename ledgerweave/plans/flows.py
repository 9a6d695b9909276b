"""Flow of value and joins by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators import flow
from ledgerweave.operators.intervals import as_of, overlap_join
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import LINE_ORDER, cents, table

_LINE_ORDER = ", ".join(LINE_ORDER)


@query(f"""
with i as (select o_custkey as owner, o_orderkey as in_key, cast(round(o_totalprice) as bigint) as v,
  cast(sum(cast(round(o_totalprice) as bigint)) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as bigint) as e from orders where round(o_totalprice) > 0),
l as (select o_custkey as owner, {_LINE_ORDER}, cast(l_quantity as bigint) * 100 as v, row_number() over (partition by o_custkey order by {_LINE_ORDER}) as out_key from lineitem join orders on l_orderkey = o_orderkey),
o as (select owner, out_key, v, cast(sum(v) over (partition by owner order by out_key rows unbounded preceding) as bigint) as e from l)
select i.owner, i.in_key, cast(o.out_key as bigint) as out_key, least(i.e, o.e) - greatest(i.e - i.v, o.e - o.v) as amount
from i join o on i.owner = o.owner and i.e - i.v < o.e and o.e - o.v < i.e
""")
def fifo_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer pay for the lines of the same customer, first in first out."""
    orders = table(spark, sf_dir, "orders")
    inputs = orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("in_key"), "o_orderdate", F.round("o_totalprice").cast("bigint").alias("v")).where("v > 0")
    inputs = flow.running_ends(inputs, ["owner"], [F.col("o_orderdate"), F.col("in_key")], "v")
    owners = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner"))
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER).join(owners, "l_orderkey")
    from ledgerweave.operators.ordered import numbered

    outputs = numbered(lines, ["owner"], [F.col(c) for c in LINE_ORDER], "out_key", 1).select("owner", "out_key", (F.col("l_quantity").cast("bigint") * 100).alias("v"))
    return flow.allocate(inputs, flow.running_ends(outputs, ["owner"], [F.col("out_key")], "v"), ["owner"], "in_key", "out_key")


@query("""
with f as (select o_orderkey as tx, cast(o_orderdate as date) as day, greatest(cast(round(o_totalprice * 100) as bigint) - coalesce((select sum(cast(round(l_extendedprice * 100) as bigint)) from lineitem where l_orderkey = o_orderkey), 0), 0) as fee from orders)
select tx, day, cast(fee as bigint) as fee, cast(coalesce(sum(fee) over (partition by day order by tx rows between unbounded preceding and 1 preceding), 0) as bigint) as fee_start from f
""")
def fee_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order's lines leave of its total is its fee; fees of a day follow each other in order."""
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.sum(cents("l_extendedprice")).alias("used"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), F.to_date("o_orderdate").alias("day"), cents("o_totalprice").alias("value"))
    fees = orders.join(used, "tx", "left").withColumn("fee", F.greatest(F.col("value") - F.coalesce("used", F.lit(0)), F.lit(0)).cast("bigint"))
    return flow.running_ends(fees, ["day"], [F.col("tx")], "fee").select("tx", "day", "fee", (F.col("end") - F.col("fee")).alias("fee_start"))


_RANGES = """
r as (select user_id, event_id as range_event, size, cast(sum(size) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as e
  from (select user_id, event_id, cast(floor(value) as bigint) + 1 as size from events where event_type = 'purchase'))
"""


@query(f"""
with {_RANGES}, p as (select user_id, event_id, cast(floor(value * 3) as bigint) as position from events where event_type = 'click')
select p.user_id, p.event_id, p.position, r.range_event, p.position - (r.e - r.size) as "offset" from p left join r on p.user_id = r.user_id and r.e - r.size <= p.position and p.position < r.e
""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as positions in the user's purchases laid end to end; null beyond them."""
    events = table(spark, sf_dir, "events")
    ranges = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("range_event"), (F.floor("value") + 1).cast("bigint").alias("size"))
    ranges = flow.running_ends(ranges, ["user_id"], [F.col("range_event")], "size").withColumn("start", F.col("end") - F.col("size"))
    points = events.where("event_type = 'click'").select("user_id", "event_id", F.floor(F.col("value") * 3).cast("bigint").alias("position"))
    return flow.locate(points, ranges, ["user_id"], "range_event")


@query("""
select a.event_id, a.user_id, count(b.event_id) as directives, cast(min(b.event_id) as bigint) as first_directive
from events a left join events b on a.user_id = b.user_id and b.event_type = 'error' and b.ts > a.ts and b.ts <= a.ts + interval 2 day
where a.event_type = 'purchase' group by a.event_id, a.user_id
""")
def freeze_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the same user within two days after a purchase, by a window over time rather than a join."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ahead = Window.partitionBy("user_id").orderBy("at").rangeBetween(1, 2 * 86_400 * 1_000_000)
    error = F.when(F.col("event_type") == "error", F.col("event_id"))
    seen = events.select("event_id", "user_id", "event_type", F.count(error).over(ahead).alias("directives"), F.min(error).over(ahead).alias("first_directive"))
    return seen.where("event_type = 'purchase'").drop("event_type")


@query(f"select tx, owner from (select l_orderkey as tx, l_suppkey as owner, row_number() over (partition by l_orderkey order by {', '.join(c + ' desc' for c in LINE_ORDER)}) as n from lineitem) where n = 1")
def last_input_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of an order's last line."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    return lines.groupBy(F.col("l_orderkey").alias("tx")).agg(F.max_by("l_suppkey", F.struct(*LINE_ORDER)).alias("owner"))


@query("""
with r as (select event_id, user_id, cast(floor(value) as bigint) as s, cast(floor(value) as bigint) + 1 + event_id % 7 as e from events)
select a.user_id, a.event_id as a_event, b.event_id as b_event, greatest(a.s, b.s) as "start", least(a.e, b.e) as "end"
from r a join r b on a.user_id = b.user_id and a.event_id < b.event_id and a.s < b.e and b.s < a.e
""")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's ranges that overlap, with what they share."""
    r = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("bigint").alias("s"), (F.floor("value") + 1 + F.col("event_id") % 7).cast("bigint").alias("e"))
    a = r.select("user_id", F.col("event_id").alias("a_event"), F.col("s").alias("a_start"), F.col("e").alias("a_end"))
    b = r.select("user_id", F.col("event_id").alias("b_event"), F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    met = overlap_join(a, b, ["user_id"], 8).where("a_event < b_event")
    return met.select("user_id", "a_event", "b_event", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))


@query("""
select c.event_id, c.user_id, max(p.event_id) as purchase_event from events c left join events p on p.user_id = c.user_id and p.event_type = 'purchase' and p.event_id < c.event_id
where c.event_type = 'click' group by c.event_id, c.user_id
""")
def asof_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest earlier purchase of each click's user."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("purchase_event"))
    return as_of(clicks, bought, ["user_id"], "event_id", ["purchase_event"], inclusive=False)

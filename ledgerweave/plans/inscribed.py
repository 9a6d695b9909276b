"""Queries of inscriptions, names, authority and exotic sats on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import decimals, runes, sats
from ledgerweave.operators import inscriptions as I
from ledgerweave.operators import satflow
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import actions, cents, table


@query("""
with e as (select event_id, event_id // 50 as height, event_type = 'error' as cursed from events),
v as (select *, cursed and height >= 100 as vindicated, cursed and height < 100 as low from e)
select event_id, vindicated, cast(case when low then -row_number() over (partition by low order by event_id) else row_number() over (partition by low order by event_id) - 1 end as bigint) as number from v
""")
def inscription_curses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as inscriptions, 50 a block; errors are cursed until block 100."""
    zero = F.lit(0)
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 50).alias("height"), (F.col("event_id") % 50).alias("tx"), zero.alias("input"), zero.alias("place"), zero.alias("offset"), (F.col("event_type") == "error").alias("cursed"))
    return I.numbered(rows, 100).select("event_id", "vindicated", "number")


@query("""
select event_id, user_id, cast(row_number() over w - 1 as bigint) as nth, cast(coalesce(sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as reinscription
from events window w as (partition by user_id order by event_id)
""")
def sat_reinscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("user_id").alias("sat"), (F.col("event_type") == "error").alias("cursed"))
    return I.reinscriptions(rows, ["event_id"]).select("event_id", "user_id", "nth", "reinscription")


@query("""
with c as (select o_orderkey as id, o_custkey as tx, unnest(range(0, 4)) as place from orders), p as (select id, tx, place, (id + place) % 200 as sat from c),
s as (select distinct o_custkey as tx, l_partkey % 200 as sat from orders join lineitem on l_orderkey = o_orderkey)
select id, count(s.sat) as parents from p left join s on p.tx = s.tx and p.sat = s.sat group by id
""")
def parents_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of an order's four claimed parents are among its customer's lines."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tx"))
    claimed = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("place"), ((F.col("id") + k) % 200).alias("sat")))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 200).alias("sat"))
    spent = orders.join(lines, "id").select("tx", "sat")
    return I.valid_parents(orders.withColumn("parents", claimed), spent).select("id", F.size("parents").cast("bigint").alias("parents"))


@query("select o_custkey as owner, p_brand as collection, count(*) as items from orders join lineitem on l_orderkey = o_orderkey join part on l_partkey = p_partkey where p_size < 10 group by 1, 2")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner"))
    held = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id")).join(owners, "l_orderkey").select("owner", "id")
    lists = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_brand").alias("collection"), F.col("p_partkey").alias("id"))
    return I.collection_counts(held, lists)


@query("""
with a as (select p_partkey as ticker, min(l_suppkey) as authority from part join lineitem on l_partkey = p_partkey where p_size % 2 = 0 group by 1),
d as (select l_orderkey as height, l_orderkey + l_linenumber - 3 as effective, l_partkey as ticker, l_suppkey as initiator from lineitem)
select height, effective, d.ticker, initiator from d join a on d.ticker = a.ticker and initiator = authority where abs(height - effective) <= 2
""")
def freeze_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as directives, in force where they come from the ticker's first supplier and take effect within two heights."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    tickers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, 100).otherwise(0).alias("selfmint"))
    owners = lines.groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("owner"))
    orders = lines.select(F.col("l_orderkey").alias("height"), (F.col("l_orderkey") + F.col("l_linenumber") - 3).alias("effective"), F.col("l_partkey").alias("ticker"), F.col("l_suppkey").alias("initiator"))
    return I.directives_in_force(orders, I.freeze_authority(tickers, owners)).select("height", "effective", "ticker", "initiator")


@query("""
with o as (select k as name, min_by(user_id, event_id) as owner from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_type = 'signup') group by 1),
u as (select cast(json_extract_string(props, '$.k') as bigint) as name, user_id as "by", event_id, event_type as key, cast(floor(value) as bigint) as value from events where event_type in ('view', 'click', 'purchase'))
select name, key, max_by(value, event_id) as value from (select u.* from u join o on u.name = o.name and u."by" = o.owner) group by name, key
""")
def owner_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each key that a name's first registrant wrote."""
    from ledgerweave.operators.ordered import first_wins

    rows = actions(spark, sf_dir).where("k is not null").select(F.col("k").alias("name"), "user_id", "event_id", "event_type", F.floor("value").cast("bigint").alias("value"))
    owners = first_wins(rows.where("event_type = 'signup'").select("name", F.col("user_id").alias("owner"), "event_id"), ["name"], ["event_id"]).select("name", "owner")
    writes = rows.where("event_type in ('view', 'click', 'purchase')").select("name", F.col("user_id").alias("by"), "event_id", F.create_map("event_type", "value").alias("pairs"))
    return I.name_values(writes, owners, ["event_id"])


@query("""
with recursive e as (select 0 as epoch, cast(0 as hugeint) as first union all select epoch + 1, first + cast(210000 as hugeint) * (5000000000 >> epoch) from e where epoch < 33),
s as (select o_orderkey, cast(o_orderkey % 900 as bigint) * 25000000000 + (o_orderkey % 3) * 2500000000 as sat from orders),
f as (select o_orderkey, sat, (sat - first) // (5000000000 >> epoch) + epoch * 210000 as h, (sat - first) % (5000000000 >> epoch) = 0 as is_first from s join e on sat >= first and sat < first + cast(210000 as hugeint) * (5000000000 >> epoch))
select o_orderkey, tag from (select o_orderkey, unnest([case when sat = 0 then 'mythic' when is_first and h % 210000 = 0 then 'epic' when is_first and h % 2016 = 0 then 'rare' when is_first then 'uncommon' end,
case when sat % 100000000 = 0 then 'alpha' end, case when sat = 0 then 'fibonacci' end, case when sat between 45000000000 and 45999999999 then '1stTX' end, case when h = 9 then 'block9' end, case when h = 78 then 'block78' end, case when h <= 1000 then 'vintage' end,
case when h in (9, 286, 688, 877, 1760, 2459, 2485, 3479, 5326, 9443, 9925, 10645, 14450, 15625, 15817, 19093, 23014, 28593, 29097) then 'nakamoto' end]) as tag from f) where tag is not null
""")
def satribute_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of some early sats, one a row."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ((key % 900) * 25_000_000_000 + (key % 3) * 2_500_000_000).cast("bigint").alias("sat"))
    return rows.select("o_orderkey", F.explode(sats.satributes(F.col("sat"))).alias("tag"))


@query("""
with t as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as units, cast(o_custkey + 1 as bigint) as parts from orders)
select o_orderkey, cast(units // parts as bigint) as each, cast(units % parts as bigint) as rest, cast(units * 100 // (units + parts) as bigint) as share from t
""")
def amount_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An amount in whole parts, with what is left, and a share in percent."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("units"), (F.col("o_custkey") + 1).cast("bigint").alias("parts"))
    share = F.floor(decimals.percent(F.col("units"), F.col("units") + F.col("parts"))).cast("bigint")
    return rows.select("o_orderkey", F.expr("units div parts").alias("each"), F.expr("units % parts").alias("rest"), share.alias("share"))


@query("""
with recursive n as (select p_partkey, p_partkey * 1000003 as number from part),
s as (select p_partkey, number, number + 1 as rest, '' as name from n union all select p_partkey, number, (rest - 1) // 26, chr(cast(65 + (rest - 1) % 26 as integer)) || name from s where rest > 0)
select p_partkey, cast(number as varchar) as number, name, true as same, number >= 18278 - (18278 - 702) * (1000001 - 840000 - 9 * 17500) // 17500 as etchable from s where rest = 0
""")
def rune_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as rune names and back, and whether they may be etched early on."""
    number = (F.col("p_partkey") * 1_000_003).cast("string")
    named = table(spark, sf_dir, "part").select("p_partkey", number.alias("number"), runes.encode(number).alias("name"))
    return named.select("p_partkey", "number", "name", (runes.decode(F.col("name")) == F.col("number")).alias("same"), runes.etchable(F.col("name"), F.lit(1_000_000)).alias("etchable"))


_DAY = "datediff('day', date '1970-01-01', cast(o_orderdate as date))"
_CENTS = "cast(round(l_extendedprice * 100) as bigint)"


@query(f"""
with i as (select height, tx, vin, tx * 100 + vin as utxo, v, cast(sum(v) over (partition by height, tx order by vin) as bigint) as e from
  (select {_DAY} as height, l_orderkey + 1 as tx, l_linenumber as vin, cast(sum({_CENTS}) as bigint) as v from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3)),
had as (select height, tx, cast(sum(v) as bigint) as had from i group by 1, 2),
o as (select height, tx, vout, -(tx * 10 + vout) as utxo, v, v * (vout + 1) as e from (select height, tx, unnest([0, 1]) as vout, had * 49 // 100 as v from had)),
paid as (select i.height, i.utxo as from_utxo, greatest(i.e - i.v, o.e - o.v) - (i.e - i.v) as from_offset, o.utxo as to_utxo, greatest(i.e - i.v, o.e - o.v) - (o.e - o.v) as to_offset, least(i.e, o.e) - greatest(i.e - i.v, o.e - o.v) as amount
  from i join o on i.tx = o.tx and i.e - i.v < o.e and o.e - o.v < i.e),
rest as (select i.height, i.tx, i.vin, i.utxo as from_utxo, greatest(i.e - i.v, 2 * (had * 49 // 100)) - (i.e - i.v) as base, i.e - greatest(i.e - i.v, 2 * (had * 49 // 100)) as v from i join had on i.tx = had.tx where i.e > 2 * (had * 49 // 100)),
mined as (select height, from_utxo, base as from_offset, -((height + 1000000000) * 10) as to_utxo, cast(5000 + sum(v) over (partition by height order by tx, vin) - v as bigint) as to_offset, v as amount from rest
  union all select distinct height, null, 0, -((height + 1000000000) * 10), 0, 5000 from had)
select cast(height as integer) as height, from_utxo, from_offset, to_utxo, to_offset, amount from paid union all select cast(height as integer), from_utxo, from_offset, to_utxo, to_offset, amount from mined
""")
def sat_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions of their day: their lines are inputs, two outputs take most of the value, the day's coinbase the rest."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("tx"), F.unix_date(F.to_date("o_orderdate")).alias("height"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("tx"), F.col("l_linenumber").alias("vin"), cents("l_extendedprice").alias("value"))
    inputs = lines.join(orders, "tx").groupBy("height", "tx", "vin").agg(F.sum("value").alias("value")).select("height", "tx", "vin", (F.col("tx") * 100 + F.col("vin")).alias("utxo"), "value")
    had = inputs.groupBy("height", "tx").agg(F.sum("value").alias("had"))
    half = F.floor(F.col("had") * 49 / 100).cast("bigint")
    paid = had.select("height", "tx", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("vout"), half.alias("value"))
    fees = had.groupBy("height").agg(F.sum(F.col("had") - 2 * half).alias("fees"))
    mined = fees.select("height", F.lit(0).cast("bigint").alias("tx"), F.lit(0).alias("vout"), (F.col("fees") + 5000).alias("value"))
    outputs = paid.unionByName(mined).withColumn("utxo", -(F.when(F.col("tx") == 0, F.col("height") + 10**9).otherwise(F.col("tx")) * 10 + F.col("vout")))
    return satflow.block_flow(inputs, outputs)


@query("""
with h as (select l_orderkey as tx, sum(cast(round(l_extendedprice * 100) as bigint)) as had from lineitem group by 1), d as (select datediff('day', date '1970-01-01', cast(o_orderdate as date)) as height, tx, had from h join orders on tx = o_orderkey)
select cast(height as bigint) as height, cast(sum(had) + 5000 as bigint) as sats from d group by height
""")
def sat_flow_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sats that each block of sat_flow moves: all that its inputs hold, and 5000 new ones."""
    return sat_flow(spark, sf_dir).where("to_utxo is not null").groupBy(F.col("height").cast("bigint").alias("height")).agg(F.sum("amount").cast("bigint").alias("sats"))

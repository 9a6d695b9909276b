"""Queries on amounts and ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import decimals, sats
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import table



@query("""
with recursive e as (select 0 as epoch, cast(0 as hugeint) as first union all select epoch + 1, first + cast(210000 as hugeint) * (5000000000 >> epoch) from e where epoch < 33),
s as (select o_orderkey, (o_orderkey * 104729000003) % 2099999997690000 as sat from orders),
h as (select o_orderkey, sat, epoch, cast(sat - first as bigint) as pos, cast(5000000000 >> epoch as bigint) as sub from s join e on sat >= first and sat < first + cast(210000 as hugeint) * (5000000000 >> epoch)),
r as (select *, epoch * 210000 + pos // sub as height, pos % sub = 0 as is_first from h)
select o_orderkey, sat, cast(height as bigint) as height, case when sat = 0 then 'mythic' when is_first and height % 1260000 = 0 then 'legendary' when is_first and height % 210000 = 0 then 'epic'
when is_first and height % 2016 = 0 then 'rare' when is_first then 'uncommon' else 'common' end as rarity, cast(height // 1260000 as bigint) as cycle, cast(height // 2016 as bigint) as period from r
""")
def sat_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sat = F.col("sat")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 104729000003) % 2099999997690000).alias("sat"))
    return rows.select("o_orderkey", "sat", sats.sat_place(sat).alias("p")).select("o_orderkey", "sat", "p.height", "p.rarity", "p.cycle", "p.period")


@query("""
with b as (select cast(i as bigint) * 1000 as height from range(0, 7000) t(i))
select height, case when height // 210000 < 64 then cast(5000000000 >> cast(height // 210000 as bigint) as bigint) else 0 end as subsidy,
cast((select coalesce(sum(cast(210000 as hugeint) * (5000000000 >> e)), 0) from range(0, 40) r(e) where e < height // 210000) + cast(height % 210000 as hugeint) * (5000000000 >> cast(height // 210000 as bigint)) as bigint) as first_ordinal from b
""")
def subsidy_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.col("height")
    return spark.range(0, 7000).select((F.col("id") * 1000).alias("height")).select("height", sats.subsidy(height).alias("subsidy"), sats.first_ordinal(height).alias("first_ordinal"))


@query("""
with t as (select event_id, case event_id % 5 when 0 then cast(event_id as varchar) || '.' || cast(event_id % 97 as varchar) when 1 then cast(event_id as varchar) when 2 then '-' || cast(event_id as varchar) when 3 then '.' || cast(event_id as varchar) else cast(event_id as varchar) || 'x' end as text from events)
select event_id, text, regexp_full_match(text, '[0-9]+([.][0-9]{1,8})?') as valid, cast(case when regexp_full_match(text, '[0-9]+([.][0-9]{1,8})?') then round(cast(text as decimal(30, 8)) * 100000000) end as bigint) as units from t
""")
def decimal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat_ws(".", e, (F.col("event_id") % 97).cast("string"))).when(k == 1, e).when(k == 2, F.concat(F.lit("-"), e)).when(k == 3, F.concat(F.lit("."), e)).otherwise(F.concat(e, F.lit("x")))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    value = decimals.token_amount(F.col("text"), 8)
    return rows.select("event_id", "text", value.isNotNull().alias("valid"), (value * 100000000).cast("bigint").alias("units"))


@query("select p_partkey as ticker, p_size % 10 = 0 as round_ten, cast(round(p_retailprice * 100000000) as bigint) as sats from part")
def value_to_sats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), sats.trailing_zeros(F.col("p_size"), 1).alias("round_ten"), decimals.sats(F.col("p_retailprice")).alias("sats"))

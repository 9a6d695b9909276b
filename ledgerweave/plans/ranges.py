"""Queries on sets of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import offsets
from ledgerweave.operators import intervals
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import table

_EVENT_RANGES = "(select user_id, event_type, cast(floor(value * 4) as bigint) as s, cast(floor(value * 4) as bigint) + 1 + event_id % 5 as e from events)"


def _islands_sql(source: str) -> str:
    return f"""select user_id, min(s) as s, max(e) as e from (
      select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as island from (
        select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as reach from {source})
    ) group by user_id, island"""


_ISLANDS = _islands_sql(_EVENT_RANGES)


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor(F.col("value") * 4).cast("bigint")
    return table(spark, sf_dir, "events").select("user_id", "event_type", start.alias("start"), (start + 1 + F.col("event_id") % 5).cast("bigint").alias("end"))


@query(f'select user_id, s as "start", e as "end" from ({_ISLANDS})')
def islands_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(_ranges(spark, sf_dir), "user_id")


_SWEEP = f"""
p as (select user_id, pos, sum(da) as da, sum(db) as db from (
  select user_id, s as pos, case event_type when 'error' then 0 else 1 end as da, case event_type when 'error' then 1 else 0 end as db from {_EVENT_RANGES}
  union all select user_id, e, case event_type when 'error' then 0 else -1 end, case event_type when 'error' then -1 else 0 end from {_EVENT_RANGES}) group by user_id, pos),
c as (select user_id, pos as s, lead(pos) over w as e, sum(da) over w as a, sum(db) over w as b from p window w as (partition by user_id order by pos))
"""


@query(f'with {_SWEEP} select user_id, s as "start", e as "end" from ({_islands_sql("(select user_id, s, e from c where e is not null and a > 0 and b = 0)")})')
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's other events cover and errors don't."""
    r = _ranges(spark, sf_dir)
    return intervals.subtract(r.where("event_type <> 'error'"), r.where("event_type = 'error'"), "user_id")


@query(f'with {_SWEEP} select user_id, s as "start", e as "end" from ({_islands_sql("(select user_id, s, e from c where e is not null and a > 0 and b > 0)")})')
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir)
    return intervals.intersect(r.where("event_type <> 'error'"), r.where("event_type = 'error'"), "user_id")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's disjoint ranges in one row."""
    merged = intervals.islands(_ranges(spark, sf_dir), "user_id")
    return merged.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def _parts(left: Column, right: Column) -> Column:
    """Both parts in one array, named."""
    named = lambda name, ranges: F.transform(ranges, lambda r: F.struct(F.lit(name).alias("part"), r["start"].alias("start"), r["end"].alias("end")))
    return F.concat(named("left", left), named("right", right))


_RUNNING = f'(select user_id, s, e, cast(sum(e - s) over (partition by user_id order by s rows unbounded preceding) - (e - s) as bigint) as done from ({_ISLANDS}))'


@query(f"""
with l as (select user_id, s, s + least(e - s, 40 - done) as e from {_RUNNING} where done < 40),
cutat as (select user_id, max(e) as pos from l group by user_id)
select user_id, 'left' as part, s as "start", e as "end" from l
union all select i.user_id, 'right', greatest(i.s, pos) - pos, i.e - pos from ({_ISLANDS}) i join cutat on i.user_id = cutat.user_id where i.e > pos
""")
def split_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 units of a user's ranges, and the rest counted from the cut."""
    left, right = offsets.split(F.col("ranges"), F.lit(40))
    return _held(spark, sf_dir).select("user_id", F.inline(_parts(left, right)))


@query(f"""
select user_id, 'left' as part, s as "start", least(e, 100) as "end" from ({_ISLANDS}) where s < 100
union all select user_id, 'right', greatest(s, 100) - 100, e - 100 from ({_ISLANDS}) where e > 100
""")
def cut_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = offsets.cut(F.col("ranges"), F.lit(100))
    return _held(spark, sf_dir).select("user_id", F.inline(_parts(left, right)))


@query(f"""
with c as (select user_id, greatest(s, 50) as s, e from ({_ISLANDS}) where e > 50),
r as (select user_id, s, e, cast(sum(e - s) over (partition by user_id order by s rows unbounded preceding) - (e - s) as bigint) as done from c),
ok as (select user_id from c group by user_id having sum(e - s) >= 60)
select r.user_id, s as "start", s + least(e - s, 60 - done) as "end" from r join ok on r.user_id = ok.user_id where done < 60
""")
def pickup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 units at or after 50, of users who have so many."""
    return _held(spark, sf_dir).select("user_id", F.inline(offsets.pick_up(F.col("ranges"), F.lit(50), F.lit(60))))


@query(f'select user_id, greatest(s, 50) - 50 as "start", least(e, 200) - 50 as "end" from ({_ISLANDS}) where e > 50 and s < 200')
def cut_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).select("user_id", F.inline(offsets.cut_range(F.col("ranges"), F.lit(50), F.lit(200))))


@query(f"select user_id, cast(sum(e - s) as bigint) as units, bool_or(s <= 77 and 77 < e) as holds, cast(case when bool_or(s <= 77 and 77 < e) then sum(greatest(0, least(e, 77) - s)) else sum(e - s) end as bigint) as before from ({_ISLANDS}) group by user_id")
def range_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that a user holds, whether position 77 is among them, and how many lie before it."""
    r = F.col("ranges")
    return _held(spark, sf_dir).select("user_id", offsets.size(r).alias("units"), offsets.contains(r, F.lit(77)).alias("holds"), offsets.offset_of(r, F.lit(77)).cast("bigint").alias("before"))

"""Queries of the order-dependent protocol rules. SQL steps through the short ones by recursion; tests hold the others against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators import protocols as P
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import LINE_ORDER, actions, table

#: What the event types stand for in the account queries.
ACTIONS = {"signup": "deploy", "purchase": "mint", "view": "inscribe", "click": "move", "error": "cancel"}


def _acts(spark: SparkSession, sf_dir: str, meaning: dict[str, str]) -> DataFrame:
    act = F.create_map(*(F.lit(x) for pair in meaning.items() for x in pair))[F.col("event_type")]
    return actions(spark, sf_dir).select(
        F.coalesce("k", F.lit(-1)).alias("ticker"), F.col("event_id").alias("seq"), F.col("user_id").alias("owner"), (F.col("user_id") + 1).alias("receiver"),
        act.alias("action"), F.floor(F.col("value") + 1).cast("bigint").alias("amount"),
    ).where("action is not null")


@query(f"""
with recursive r as (select l_partkey as ticker, row_number() over (partition by l_partkey order by {', '.join(LINE_ORDER)}) - 1 as seq, cast(l_quantity as bigint) as amount from lineitem),
f as (select ticker, seq, amount, amount <= 500 as accepted, cast(case when amount <= 500 then 500 - amount else 500 end as bigint) as left_after from r where seq = 0
  union all select r.ticker, r.seq, r.amount, r.amount <= f.left_after, cast(case when r.amount <= f.left_after then f.left_after - r.amount else f.left_after end as bigint) from f join r on r.ticker = f.ticker and r.seq = f.seq + 1)
select * from f
""")
def capped_mint_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mints up to 500 a ticker; those that would pass it are refused whole."""
    from ledgerweave.operators.ordered import numbered

    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    rows = numbered(lines, ["l_partkey"], [F.col(c) for c in LINE_ORDER], "seq").select(F.col("l_partkey").alias("ticker"), "seq", F.col("l_quantity").cast("bigint").alias("amount"))
    return P.ordered_fold(rows, ["ticker"], ["seq"], lambda: P.SkippingCap(500), P.SKIPPED)


@query()
def token_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ordered_fold(_acts(spark, sf_dir, ACTIONS), ["ticker"], ["seq"], lambda: P.TokenAccount(20_000, 1_000), P.ACCOUNT)


@query("""
with recursive e as (select user_id as owner, event_id as seq, case event_type when 'error' then 'freeze' when 'signup' then 'unfreeze' when 'purchase' then 'receive' when 'click' then 'spend' end as action,
  cast(floor(value + 1) as bigint) as amount from events),
r as (select *, row_number() over (partition by owner order by seq) as n from e where action is not null),
f as (select owner, cast(0 as bigint) as seq, '' as action, cast(0 as bigint) as n, cast(0 as bigint) as held, cast(0 as bigint) as frozen, cast(0 as bigint) as burned, false as is_frozen from (select distinct owner from r)
  union all select r.owner, r.seq, r.action, r.n,
    case r.action when 'receive' then f.held + r.amount when 'spend' then f.held - least(r.amount, f.held) else f.held end,
    case when r.action = 'freeze' and not f.is_frozen then f.held when r.action = 'unfreeze' then 0 when r.action = 'spend' and f.is_frozen then f.frozen - least(r.amount, f.held, f.frozen) else f.frozen end,
    case when r.action = 'spend' and f.is_frozen then least(r.amount, f.held, f.frozen) else 0 end,
    case r.action when 'freeze' then true when 'unfreeze' then false else f.is_frozen end
  from f join r on r.owner = f.owner and r.n = f.n + 1)
select cast(0 as bigint) as ticker, owner, seq, action, held, frozen, burned, is_frozen from f where n > 0
""")
def freeze_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    meaning = {"error": "freeze", "signup": "unfreeze", "purchase": "receive", "click": "spend"}
    rows = _acts(spark, sf_dir, meaning).select(F.lit(0).cast("bigint").alias("ticker"), "owner", "seq", "action", "amount")
    return P.ordered_fold(rows, ["ticker", "owner"], ["seq"], P.freeze_account(), P.FROZEN)


def _edicts(rows: list) -> list[tuple]:
    held: dict[int, int] = {}
    for r in rows:
        held[r.rune] = held.get(r.rune, 0) + 60
    got, burned = P.apply_edicts(held, [(r.rune, r.amount, r.output) for r in rows], 3, [0, 1, 2], None, rows[0].tx % 101 == 0)
    out = [(rows[0].tx, rune, output, n, False) for (output, rune), n in got.items()]
    return out + [(rows[0].tx, rune, -1, n, True) for rune, n in burned.items()]


@query()
def rune_edicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a transaction of three outputs with an edict for each line; every 101st is malformed and burns."""
    rows = table(spark, sf_dir, "lineitem").select(*LINE_ORDER).select(
        F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("rune"), (F.col("l_quantity").cast("bigint") % 40).alias("amount"), (F.col("l_linenumber") % 4).cast("bigint").alias("output"),
        *(F.col(c).alias(f"o_{c}") for c in LINE_ORDER[2:]),
    )
    return P.by_transaction(rows, "tx", ["seq", *(f"o_{c}" for c in LINE_ORDER[2:])], _edicts, "tx long, rune long, output long, amount long, burned boolean")


def _colours(rows: list) -> list[tuple]:
    half = max(1, sum(r.amount for r in rows) // 2)
    got, burned = P.colour([(r.asset, r.amount) for r in rows], [half, half, 10], rows[0].tx % 2 == 0)
    out = [(rows[0].tx, asset, output, n, False) for (output, asset), n in got.items()]
    return out + [(rows[0].tx, asset, -1, n, True) for asset, n in burned.items()]


@query()
def arc20_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines are coloured inputs; half of the value goes to each of two outputs. Even orders may colour parts of outputs."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx"), F.col("l_partkey").alias("asset")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("amount"))
    return P.by_transaction(rows, "tx", ["asset"], _colours, "tx long, asset long, output long, amount long, burned boolean")

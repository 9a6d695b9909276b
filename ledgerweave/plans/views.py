"""Queries of read views, known totals, deploys and mints on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import content
from ledgerweave.operators import issuance, views
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import LINE_ORDER, movements, table

#: Events as inscriptions, three on a sat; every fifth inscription is cursed. Sats lie on outputs, every eleventh is disabled.
_INSCRIBED = """
i as (select event_id as id, sha256(cast(event_id as varchar)) || 'i0' as inscription_id, event_id // 3 as sat, case when event_id % 5 = 0 then 'pointer' end as curse, event_type, user_id from events),
s as (select distinct sat, sat % 400 as utxo, sat * 7 % 1000 as o, sat % 50 as owner from i), d as (select sat from s where sat % 11 = 0)
"""


def _inscribed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        key.alias("id"), F.concat(F.sha2(key.cast("string").cast("binary"), 256), F.lit("i0")).alias("inscription_id"), F.floor(key / 3).alias("sat"),
        F.when(key % 5 == 0, "pointer").alias("curse"), "event_type", "user_id",
    )
    sats = rows.select("sat").distinct().select("sat", (F.col("sat") % 400).alias("utxo"), (F.col("sat") * 7 % 1000).alias("offset"), (F.col("sat") % 50).alias("owner"))
    return rows, sats, sats.where("sat % 11 = 0").select("sat")


@query(f"with {_INSCRIBED} select id, sat, utxo, o as \"offset\", owner from i join s using (sat) where sat not in (select sat from d)")
def inscriptions_in_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sats, disabled = _inscribed(spark, sf_dir)
    return views.inscriptions_of(rows, sats, disabled).select("id", "sat", "utxo", "offset", "owner")


@query(f"with {_INSCRIBED} select id, inscription_id, owner from i join s using (sat) where sat not in (select sat from d) and utxo in (7, 11, 22)")
def inscriptions_in_utxos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inscriptions of three outputs, of which some sats are disabled."""
    asked = spark.createDataFrame([(7,), (11,), (22,)], "utxo long")
    return views.inscriptions_of(*_inscribed(spark, sf_dir), asked).select("id", "inscription_id", "owner")


@query(f"with {_INSCRIBED} select id, inscription_id, sat, curse from i where inscription_id in (select sha256(cast(o_orderkey as varchar)) || 'i0' from orders)")
def inscriptions_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inscriptions asked for by textual id, those of the orders' numbers."""
    asked = table(spark, sf_dir, "orders").select(F.concat(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256), F.lit("i0")).alias("inscription_id"))
    return views.wanted(_inscribed(spark, sf_dir)[0], asked, ["inscription_id"]).select("id", "inscription_id", "sat", "curse")


@query(f"with {_INSCRIBED} select sat, min(id) as first, max(id) as last, count(*) as inscriptions, count(curse) as cursed from i group by sat")
def sat_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sat_membership(_inscribed(spark, sf_dir)[0])


@query(f"with {_INSCRIBED} select utxo, 'ordx' as protocol, 'o' as type, cast(sat as varchar) as ticker, cast(1 as bigint) as amount, o as start, o + 1 as \"end\" from s where sat not in (select sat from d)")
def sat_asset_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sats, disabled = _inscribed(spark, sf_dir)
    return views.sat_assets(views.enabled_sats(sats, disabled))


@query(f"""
with {_INSCRIBED}, r as (select c_custkey % 400 as utxo, min(c_name) as proof from customer where c_custkey % 3 = 0 group by 1)
select sat, 'before' as proof from d union all select sat, proof from s join r using (utxo) where sat not in (select sat from d)
""")
def disabled_sats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disabled sats after customers ask for those of their outputs."""
    _, sats, disabled = _inscribed(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") % 400).alias("utxo"), F.col("c_name").alias("proof"))
    return views.disable(disabled.withColumn("proof", F.lit("before")), asked, sats)


@query(f"with {_INSCRIBED} select c_name as name, id, sat from customer join i on id = c_custkey where sat % 2 = 0")
def names_on_sats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names, inscribed by events of their number, on even sats."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return views.names_on(names, _inscribed(spark, sf_dir)[0]).where("sat % 2 = 0")


@query(f"with {_INSCRIBED} select inscription_id, o_custkey as ticker, o_orderkey as mint, id, user_id, curse is not null as cursed from orders join i on i.id = o_orderkey")
def mint_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mints with what the events of their number, their inscriptions, add."""
    key = F.col("o_orderkey")
    mints = table(spark, sf_dir, "orders").select(F.concat(F.sha2(key.cast("string").cast("binary"), 256), F.lit("i0")).alias("inscription_id"), F.col("o_custkey").alias("ticker"), key.alias("mint"))
    return views.mint_details(mints, _inscribed(spark, sf_dir)[0]).select("inscription_id", "ticker", "mint", "id", "user_id", F.col("curse").isNotNull().alias("cursed"))


@query("""
select l_orderkey as utxo, case l_linenumber % 2 when 0 then 'runes' else 'brc20' end as protocol, l_partkey as ticker, cast(l_quantity as bigint) as amount, l_linenumber % 2 = 1 and l_returnflag = 'R' as invalid
from lineitem
""")
def loose_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as assets that no sat holds: even ones are runes, odd ones transfers, returned transfers are invalid."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("utxo"), F.col("l_partkey").alias("ticker"), F.col("l_quantity").cast("bigint").alias("amount"), (F.col("l_returnflag") == "R").alias("invalid"), "l_linenumber")
    return views.loose_assets(lines.where("l_linenumber % 2 = 0"), lines.where("l_linenumber % 2 = 1"))


@query("""
with p as (select distinct o_custkey as owner, o_orderkey as utxo from orders where o_orderkey % 3 = 0), n as (select distinct o_custkey as owner, l_orderkey as utxo from lineitem join orders on l_orderkey = o_orderkey)
select * from n where not exists (select 1 from p where p.owner = n.owner and p.utxo = n.utxo)
""")
def append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that a list which only grows has to take in."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("utxo"))
    pending = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("utxo")).join(orders, "utxo").select("owner", "utxo")
    return views.append_new(orders.where("utxo % 3 = 0"), pending, ["owner", "utxo"])


@query("""
with h as (select l_partkey as ticker, o_custkey as owner, cast(sum(l_quantity) as bigint) as n from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
o as (select ticker, cast(sum(n) as bigint) as amount, count(*) as holders from h group by 1), g as (select p_partkey as ticker, p_size % 6 as k from part)
select 'token' as kind, cast(g.ticker as varchar) as key, measure, expected, found from (
  select g.ticker, k, 'amount' as measure, coalesce(amount, 1) + case when k = 1 then 1 else 0 end as expected, amount as found from g left join o using (ticker)
  union all select g.ticker, k, 'holders', case when k = 2 then 0 when k = 3 then 7 else coalesce(holders, 0) end, holders from g left join o using (ticker)
) g where expected <> 0 and k <> 5 and found is distinct from expected
""")
def known_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of tickers against known ones: some wrong by one, some unchecked, some of tickers that begin later."""
    held = movements(spark, sf_dir).groupBy("ticker", "owner").agg(F.sum("amount").alias("n"))
    totals = held.groupBy("ticker").agg(F.sum("n").alias("amount"), F.count("*").alias("holders"))
    each = lambda rows: rows.select(F.lit("token").alias("kind"), F.col("ticker").cast("string").alias("key"), *(c for c in rows.columns if c != "ticker"))
    observed = each(totals.unpivot("ticker", ["amount", "holders"], "measure", "value"))
    k = F.col("p_size") % 6
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), k.alias("k")).join(totals, "ticker", "left")
    known = known.select(
        "ticker", F.when(F.col("k") == 5, 900).otherwise(100).alias("since"), (F.coalesce("amount", F.lit(1)) + (F.col("k") == 1).cast("int")).alias("amount"),
        F.when(F.col("k") == 2, 0).when(F.col("k") == 3, 7).otherwise(F.coalesce("holders", F.lit(0))).cast("bigint").alias("holders"),
    )
    golden = each(known.unpivot(["ticker", "since"], ["amount", "holders"], "measure", "expected"))
    return views.known_totals(observed, golden, 500)


_ARGS = """select p_partkey, p_size * 20000 as mint_height, cast(round(p_retailprice) as bigint) as mint_amount, cast(p_partkey * 3001 % 700000 as bigint) as max_mints, p_partkey % 4 as md, 800000 + p_partkey % 2 * 100000 as height,
case when p_partkey % 5 <> 0 then 'abcd' else 'ab' end as bv, cast(p_partkey % 3 as bigint) as bci, cast(0 as bigint) as bri, cast(p_size * 8 as bigint) as bcs, case when p_partkey % 7 = 0 then cast(p_partkey as bigint) end as maxg, case when p_partkey % 13 = 0 then 'xyz' end as mint_bitworkc from part"""


@query(f"""
with a as ({_ARGS}), b as (select *, height >= 850000 and md = 1 as ladder from a),
r as (select *, case when mint_height > 10000000 then 'mint height' when not mint_amount between 546 and 100000000 then 'mint amount' when not max_mints between 1 and case when height >= 850000 then 21000000 else 500000 end then 'max mints'
 when md not in (0, 1) then 'md' when mint_bitworkc is not null then 'mint bitwork' when ladder and (bv = 'ab' or bci = 0) then 'vector' when ladder and bci > 0 and not bcs between 64 and 256 then 'ladder start'
 when ladder and max_mints > 100000 then 'ladder mints' end as reason from b)
select p_partkey, case when ladder then 'perpetual' else 'fixed' end as mode, case when reason is null then case when not ladder then mint_amount * max_mints when maxg is null then -1 else mint_amount * maxg end end as supply, reason from r
""")
def deploy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as deploys with fixed and perpetual terms."""
    k, size = F.col("p_partkey"), F.col("p_size")
    long = lambda c: c.cast("bigint")
    args = F.struct(
        long(size * 20_000).alias("mint_height"), F.round("p_retailprice").cast("bigint").alias("mint_amount"), long(k * 3001 % 700_000).alias("max_mints"), long(k % 4).alias("md"),
        F.when(k % 5 != 0, "abcd").otherwise("ab").alias("bv"), long(k % 3).alias("bci"), long(F.lit(0)).alias("bri"), long(size * 8).alias("bcs"), long(F.lit(None)).alias("brs"),
        F.when(k % 7 == 0, long(k)).alias("maxg"), F.when(k % 13 == 0, "xyz").alias("mint_bitworkc"), F.lit(None).cast("string").alias("mint_bitworkr"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", issuance.deploy_terms(F.lit(800_000) + k % 2 * 100_000, args, 850_000).alias("t")).select("p_partkey", "t.*")


_CANDIDATES = f"""c as (select 't' || (l_partkey % 300) as ticker, l_suppkey as commit_height, l_linenumber as commit_tx, l_partkey as commit_index, row_number() over (order by {', '.join(LINE_ORDER)}) as place, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem),
w as (select *, row_number() over (partition by ticker order by commit_height, commit_tx, commit_index, place) as n from c)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("t"), (F.col("l_partkey") % 300).cast("string")).alias("ticker"), F.col("l_suppkey").alias("commit_height"), F.col("l_linenumber").alias("commit_tx"), F.col("l_partkey").alias("commit_index"), F.struct(*LINE_ORDER).alias("height"), F.lit(0).alias("tx"), "l_orderkey")


@query(f"with {_CANDIDATES} select ticker, commit_height, commit_tx, commit_index, l_orderkey from w where n = 1")
def registered_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidates of 300 tickers; the earliest commit registers."""
    return issuance.registered(_candidates(spark, sf_dir)).select("ticker", "commit_height", "commit_tx", "commit_index", "l_orderkey")


_MINTS = """
m as (select 't' || (event_id % 40) as ticker, event_id // 20 as height, event_id % 20 as tx, cast(user_id % 3 + 1 as bigint) as value, event_type <> 'error' as valid from events),
k as (select 't' || n as ticker, n as commit_height, 5 + n as mint_height, cast(n % 3 + 1 as bigint) as mint_amount, case when n % 4 > 0 then n end as most from range(39) t(n)),
b as (select m.*, most, mint_amount from m join k on m.ticker = k.ticker where valid and (commit_height <= 0 or commit_height <= height - 3) and height >= mint_height and value = mint_amount),
n as (select *, row_number() over (partition by ticker order by height, tx) - 1 as nth from b)
"""


def _mints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("event_id"), F.col("id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("t"), (k % 40).cast("string")).alias("ticker"), F.floor(k / 20).alias("height"), (k % 20).alias("tx"), (F.col("user_id") % 3 + 1).cast("bigint").alias("value"), (F.col("event_type") != "error").alias("valid"))
    known = spark.range(39).select(F.concat(F.lit("t"), n.cast("string")).alias("ticker"), n.alias("commit_height"), (n + 5).alias("mint_height"), (n % 3 + 1).alias("mint_amount"), F.when(n % 4 > 0, n).alias("most"))
    return issuance.accepted_mints(rows, known)


@query(f"with {_MINTS} select ticker, height, tx, value, valid, nth from n where most is null or nth < most")
def accepted_mints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mints of tickers with fixed amounts and numbers of mints."""
    return _mints(spark, sf_dir)


@query(f"with {_MINTS} select ticker, count(*) as times, cast(sum(value) as bigint) as amount from n where most is null or nth < most group by 1")
def minted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issuance.minted(_mints(spark, sf_dir))


@query("""
select event_id, row_number() over (order by event_id) - 1 as number, case when event_type = 'error' then 0 else cast(user_id % 19 as integer) end as divisibility, case when event_type = 'error' then 0 else event_id end as premine,
event_type <> 'error' and user_id % 2 = 0 as turbo, case when event_type <> 'error' then event_type end as symbol from events
""")
def rune_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as etchings, 50 a block; errors are cenotaphs."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.floor(k / 50).alias("height"), (k % 50).alias("tx"), (F.col("event_type") == "error").alias("cenotaph"), (F.col("user_id") % 19).cast("int").alias("divisibility"), k.alias("premine"), F.lit(0).alias("spacers"),
        (F.col("user_id") % 2 == 0).alias("turbo"), F.lit(1).alias("terms"), F.col("event_type").alias("symbol"), F.lit(None).cast("string").alias("parent"),
    )
    return issuance.rune_entries(rows).select("event_id", "number", "divisibility", "premine", "turbo", "symbol")


@query("""
with t as (select p_partkey, case p_size % 6 when 0 then 'text/plain' when 1 then 'image/svg+xml' when 2 then 'model/stl' when 3 then 'text/markdown' when 4 then 'video/mp4' else 'x' end as type, case when p_partkey % 7 <> 0 then p_name else '' end as body from part)
select p_partkey, case when body = '' then 'unknown' else case type when 'text/plain' then 'text' when 'image/svg+xml' then 'iframe' when 'text/markdown' then 'markdown' when 'video/mp4' then 'video' else 'unknown' end end as media,
split_part(p_name, ' ', 1) as name, cast(p_partkey + 1 as bigint) as size, 'ordx:f:pearl' as stake from t join part using (p_partkey)
""")
def content_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media classes, name actions, range lists and stakes."""
    k, m = F.col("p_partkey"), F.col("p_size") % 6
    kind = F.when(m == 0, "text/plain").when(m == 1, "image/svg+xml").when(m == 2, "model/stl").when(m == 3, "text/markdown").when(m == 4, "video/mp4").otherwise("x")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    action = F.to_json(F.struct(F.lit("sns").alias("p"), F.lit("reg").alias("op"), F.concat(F.lit("  "), first, F.lit(" ")).alias("name")))
    ranges = F.concat(F.lit('[{"start":'), k.cast("string"), F.lit(',"size":'), (k + 1).cast("string"), F.lit("}]"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", content.media_class(kind, F.when(k % 7 != 0, F.col("p_name")).otherwise("")).alias("media"), content.domain_action(action)["name"].alias("name"),
        content.ranges_of(ranges)[0]["size"].alias("size"), content.stake_asset(k)["name"].alias("stake"),
    )


@query("""
with b as (select 'ordx:f:pearl' as asset, o_custkey as owner, cast(sum(round(o_totalprice * 100)) as bigint) as n from orders group by 2)
select c_custkey from customer join b on owner = c_custkey where n >= 1000000
""")
def stake_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders hold the stake."""
    held = table(spark, sf_dir, "orders").select(F.lit("ordx:f:pearl").alias("asset"), F.col("o_custkey").alias("owner"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("channel"), F.lit(900_000).alias("height"))
    return views.eligible(asked, held).select("c_custkey")

"""Queries on bound assets, releases, freezes, unconfirmed transactions, and forms of names and amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import assets, decimals
from ledgerweave.operators import bound
from ledgerweave.plans.catalog import query
from ledgerweave.sources.tables import LINE_ORDER, cents, table


def _ranges(spark: SparkSession, sf_dir: str, kind: str, size: int) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    start = F.floor(F.col("value") * 10).cast("bigint")
    return events.select(F.col("user_id").alias("utxo"), F.pmod(F.col("event_id"), F.lit(3)).alias("ticker"), F.col("event_id").alias("seq"), start.alias("start"), (start + size).alias("end"))


@query("""
with r as (select user_id as utxo, event_id % 3 as ticker, event_id as seq, event_type, cast(floor(value * 10) as bigint) as s from events)
select distinct m.utxo, m.ticker, m.seq from r m join r h on m.utxo = h.utxo and m.ticker = h.ticker and m.s < h.s + 100 and h.s < m.s + 7 where m.event_type = 'click' and h.event_type = 'purchase'
""")
def mint_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as mints that meet a range of the same user and ticker bought before."""
    return bound.void_mints(_ranges(spark, sf_dir, "purchase", 100), _ranges(spark, sf_dir, "click", 7), 50)


_RELEASED = """
l as (select l_orderkey as tx, l_suppkey as initiator, row_number() over (partition by l_orderkey order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) as n from lineitem),
h as (select l_orderkey as utxo, l_partkey % 5 as ticker, cast(sum(l_quantity) as bigint) as amount, o_custkey % 10 as owner from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 4),
u as (select cast(h.ticker as varchar) as ticker, cast(owner as bigint) as owner, utxo, amount from h join l on l.tx = h.utxo and l.n = 1 where h.ticker = l.tx % 5 and owner = initiator % 10)
"""


def _released(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), (F.col("o_custkey") % 10).alias("owner"))
    outputs = orders.select("tx", F.lit(0).alias("vout"), F.col("tx").alias("utxo"), "owner")
    holders = lines.join(orders.select(F.col("tx").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("utxo"), (F.col("l_partkey") % 5).cast("string").alias("ticker")).agg(F.sum("l_quantity").cast("bigint").alias("amount"))
    last = lines.groupBy(F.col("l_orderkey").alias("tx")).agg(F.max_by("l_suppkey", F.struct(*LINE_ORDER)).alias("supplier"))
    requests = last.select("tx", (F.col("tx") % 5).cast("string").alias("ticker"), F.lit(0).alias("vout"), (F.col("supplier") % 10).alias("initiator"))
    known = spark.range(5).select(F.col("id").cast("string").alias("ticker"))
    return bound.unbind(requests, outputs, holders, known)


@query(f"with {_RELEASED} select ticker, owner, utxo, amount from u")
def unbind_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings of orders whose last line's supplier, the initiator, is their owner."""
    return _released(spark, sf_dir)[0].select("ticker", F.col("owner").cast("bigint").alias("owner"), "utxo", "amount")


@query(f"with {_RELEASED} select count(*) as held, cast(sum(h.amount) as bigint) as amount from h left join u on h.utxo = u.utxo and cast(h.ticker as varchar) = u.ticker where u.utxo is null")
def unbind_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays held after the releases."""
    return _released(spark, sf_dir)[1].agg(F.count("*").alias("held"), F.sum("amount").cast("bigint").alias("amount"))


@query(f"with {_RELEASED} select utxo, amount, (select count(*) from u where ticker = '3') as total from u where ticker = '3' order by owner, utxo limit 20 offset 2")
def unbind_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = bound.unbind_history(_released(spark, sf_dir)[0], "3", 2, 20)
    return page.select("utxo", "amount", "total")


@query(f"with {_RELEASED}, o as (select min(owner) as owner from u where ticker = '3') select utxo, amount, (select count(*) from u, o where ticker = '3' and u.owner = o.owner) as total from u, o where ticker = '3' and u.owner = o.owner order by utxo")
def unbind_history_of_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _released(spark, sf_dir)[0]
    owner = history.where("ticker = '3'").agg(F.min("owner")).scalar()
    return bound.unbind_history(history, "3", 0, 0, owner).select("utxo", "amount", "total")


_FROZEN = """f as (select l_partkey % 20 as ticker, l_suppkey as owner, l_orderkey as confirmed, l_orderkey + l_linenumber as effective, l_returnflag as action, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_quantity, '-', l_extendedprice) as txid from lineitem)"""


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    txid = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")))
    return lines.select((F.col("l_partkey") % 20).alias("ticker"), F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("confirmed"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("effective"), F.col("l_returnflag").alias("action"), txid.alias("txid"))


@query(f"with {_FROZEN} select owner, confirmed, effective, action, (select count(*) from f where ticker = 3) as total from f where ticker = 3 order by owner, confirmed, effective, action, txid limit 30 offset 10")
def freeze_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound.freeze_history(_frozen(spark, sf_dir), 3, 10, 30).select("owner", "confirmed", "effective", "action", "total")


@query(f"with {_FROZEN}, o as (select min(owner) as owner from f where ticker = 3) select confirmed, effective, action, (select count(*) from f, o where ticker = 3 and f.owner = o.owner) as total from f, o where ticker = 3 and f.owner = o.owner")
def freeze_history_of_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frozen(spark, sf_dir)
    owner = rows.where("ticker = 3").agg(F.min("owner")).scalar()
    return bound.freeze_history(rows, 3, 0, 0, owner).select("confirmed", "effective", "action", "total")


_V = "cast(round(l_extendedprice * 100) as bigint)"


@query(f"""
with i as (select l_orderkey as tx, l_linenumber as vin, l_orderkey * 10 + l_linenumber as utxo, cast(sum({_V}) as bigint) as v, min(l_partkey) as p from lineitem group by 1, 2, 3),
e as (select *, cast(sum(v) over (partition by tx order by vin) as bigint) as upto from i), had as (select tx, cast(sum(v) as bigint) as had, bool_or(p % 97 = 0 or p % 89 = 5) as fails from i group by 1),
o as (select tx, vout, had // 3 as v, had // 3 * (vout + 1) as upto, not fails and (tx % 11 <> 0) as known from had, (select unnest([0, 1, 2]) as vout)),
met as (select distinct o.tx, o.vout from o join e on o.tx = e.tx where e.p % 4 = 1 and greatest(e.upto - e.v + e.v // 4, o.upto - o.v) < least(e.upto - e.v + e.v // 2, o.upto))
select o.tx, cast(o.vout as integer) as vout, o.known, o.known and met.tx is not null as occupied from o left join met on o.tx = met.tx and o.vout = met.vout
""")
def mempool_occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as unconfirmed transactions: their lines are inputs, three outputs share the value, some inputs hold bound assets, some fail closed."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("vin"), cents("l_extendedprice").alias("v"), F.col("l_partkey").alias("p"))
    lines = lines.repartition("tx").groupBy("tx", "vin").agg(F.sum("v").alias("v"), F.min("p").alias("p")).withColumn("utxo", F.col("tx") * 10 + F.col("vin"))
    inputs = lines.select("tx", "vin", "utxo", F.when(F.col("p") % 97 != 0, F.col("v")).alias("value"))
    third = F.expr("had div 3")
    outputs = lines.groupBy("tx").agg(F.sum("v").alias("had")).select("tx", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("vout"), F.when(F.col("tx") % 11 == 0, F.col("had") * 2).otherwise(third).alias("value"))
    asset = lambda held, protocol, start, end: F.when(F.expr(held), F.struct(F.lit(protocol).alias("protocol"), F.expr(start).alias("start"), F.expr(end).alias("end")))
    nowhere = "cast(null as bigint)"
    held = F.array_compact(F.array(asset("p % 4 = 1", "ordx", "v div 4", "v div 2"), asset("p % 89 = 5", "brc20", nowhere, nowhere), asset("p % 2 = 0", "runes", nowhere, nowhere)))
    return bound.allocate_unconfirmed(inputs, outputs, lines.select("utxo", F.inline(held)))


@query("""
select p_partkey, left(p_name, 1) in ('o', 'n') as nft, lower(left(p_type, 1)) = 'e' as fungible, regexp_full_match(replace(p_name, ' ', ''), '[a-z0-9]{1,21}') as atom_ticker, p_size <= 0 or p_size <= 20 - 3 as effective,
case when regexp_full_match(p_type, '[+-]?[0-9]+') then try_cast(p_type as bigint) end as argument, cast(p_partkey % 1000 as bigint) as numeric from part
""")
def asset_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", assets.is_nft(F.left("p_name", F.lit(1))).alias("nft"), assets.is_fungible(F.when(F.lower(F.left("p_type", F.lit(1))) == "e", "f").otherwise("o")).alias("fungible"),
        assets.is_atom_ticker(F.replace("p_name", F.lit(" "))).alias("atom_ticker"), assets.ticker_effective(F.lit(20), F.col("p_size")).alias("effective"),
        assets.integer_argument(F.col("p_type")).alias("argument"), assets.integer_argument(F.concat(F.when(F.col("p_partkey") % 2 == 0, "+").otherwise(""), (F.col("p_partkey") % 1000).cast("string"))).alias("numeric"),
    )


@query("""
with n as (select p_partkey, split_part(p_name, ' ', 1) || case p_partkey % 5 when 0 then '.lpt' when 1 then '.runes.lpt' when 2 then '.atom.lpt' when 3 then '.lpt.x' else '.brc20.lpt' end as name from part),
k as (select distinct split_part(p_name, ' ', 1) as ticker, case p_size % 3 when 0 then 'ordx' when 1 then 'runes' else 'brc20' end as protocol from part where p_size < 12)
select p_partkey, name from n where exists (select 1 from k where (p_partkey % 5 = 0 and k.protocol = 'ordx' or p_partkey % 5 = 1 and k.protocol = 'runes' or p_partkey % 5 = 4 and k.protocol = 'brc20') and k.ticker = split_part(name, '.', 1))
""")
def pool_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    k = F.col("p_partkey") % 5
    ending = F.when(k == 0, ".lpt").when(k == 1, ".runes.lpt").when(k == 2, ".atom.lpt").when(k == 3, ".lpt.x").otherwise(".brc20.lpt")
    m = F.col("p_size") % 3
    known = part.where("p_size < 12").select(F.when(m == 0, "ordx").when(m == 1, "runes").otherwise("brc20").alias("protocol"), word.alias("ticker"))
    return assets.pool_tickers(part.select("p_partkey", F.concat(word, ending).alias("name")), known)


@query("""
with h as (select l_orderkey, count(*) as n, cast(sum(l_quantity) as bigint) as sats, cast(sum(case when l_linenumber = 1 then 1 else 0 end) as bigint) as transfers from lineitem group by 1)
select l_orderkey as utxo, sats + 329 * transfers as occupied, cast(round(o_totalprice) as bigint) - sats - 329 * transfers as plain, cast(n as bigint) as assets, (select cast(count(*) as bigint) from lineitem i where i.l_orderkey = h.l_orderkey and i.l_partkey % 2 = 0) as even,
(select cast(count(*) as bigint) from lineitem i where i.l_orderkey = h.l_orderkey and i.l_linenumber <> 0 and cast(i.l_quantity as bigint) % i.l_linenumber <> 0) as unbound from h join orders on l_orderkey = o_orderkey
""")
def output_sats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied and plain sats of outputs, and their assets without one kind."""
    lines = table(spark, sf_dir, "lineitem")
    amount = F.col("l_quantity").cast("bigint")
    rows = lines.groupBy(F.col("l_orderkey").alias("utxo")).agg(
        F.collect_list(F.struct(F.lit(0).cast("bigint").alias("start"), amount.alias("end"))).alias("offsets"), F.sum((F.col("l_linenumber") == 1).cast("bigint")).alias("transfers"),
        F.collect_list(F.struct((F.col("l_partkey") % 2).alias("name"), amount.alias("amount"), F.col("l_linenumber").alias("per_sat"))).alias("held"),
    )
    rows = rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("utxo"), F.round("o_totalprice").cast("bigint").alias("value")), "utxo")
    occupied = assets.occupied_sats(F.col("offsets"), F.col("transfers"), F.col("held.amount"))
    rows = rows.withColumn("occupied", occupied.cast("bigint"))
    return rows.select(
        "utxo", "occupied", assets.plain_sats(F.col("value"), F.col("occupied")).alias("plain"), F.size("held").cast("bigint").alias("assets"),
        F.size(assets.without_asset(F.col("held"), F.lit(1))).cast("bigint").alias("even"), assets.unbound_count(F.col("held")).cast("bigint").alias("unbound"),
    )


@query("""
with t as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as n from orders)
select o_orderkey, cast(n // 100 as varchar) || case when n % 100 = 0 then '' else '.' || rtrim(lpad(cast(n % 100 as varchar), 2, '0'), '0') end || chr(160) || case when o_orderkey % 3 = 0 then '¤' else '$' end as pile,
case when o_orderkey % 4 = 0 then null else cast(cast(n as decimal(38, 0)) / 100 as decimal(38, 2)) end as parsed from t
""")
def amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with their symbol, and texts that carry a precision read again."""
    key, units = F.col("o_orderkey"), cents("o_totalprice")
    text = F.concat((units.cast("decimal(38,0)") / F.lit(100)).cast("decimal(38,2)").cast("string"), F.when(key % 4 == 0, ":1").otherwise(":2"))
    text = F.when((key % 4 == 0), F.concat(F.lit("x"), text)).otherwise(text)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", units.alias("n"), text.alias("text"))
    symbol = F.when(key % 3 != 0, "$")
    return rows.select("o_orderkey", decimals.pile(F.col("n"), 2, symbol).alias("pile"), decimals.parse_with_precision(F.col("text"))["value"].cast("decimal(38,2)").alias("parsed"))


@query("""
with a as (select o_orderkey, case when o_orderkey % 9 = 0 then 'bad' || o_orderkey else sha256(cast(o_orderkey as varchar)) || 'i' || (o_orderkey % 300) end as id from orders),
k as (select *, case when o_orderkey % 9 <> 0 then list_reduce(list_reverse(regexp_extract_all(left(id, 64), '..')), lambda x, y: x || y) || list_reduce(list_reverse(regexp_extract_all(lpad(printf('%x', cast(o_orderkey % 300 as integer)), 8, '0'), '..')), lambda x, y: x || y) end as key from a)
select o_orderkey, key from k order by key is null, key, id limit 500
""")
def atomical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 ids in their canonical order (a top-k report)."""
    key = F.col("o_orderkey")
    text = F.when(key % 9 == 0, F.concat(F.lit("bad"), key.cast("string"))).otherwise(F.concat(F.sha2(key.cast("string").cast("binary"), 256), F.lit("i"), (key % 300).cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("id"))
    return rows.orderBy(*assets.atomical_order(F.col("id"))).limit(500).select("o_orderkey", assets.atomical_key(F.col("id")).alias("key"))


@query("""select o_orderkey, substr(sha256('[{' || case when o_orderkey = 0 then '' else '"start":' || o_orderkey || ',' end || '"size":' || (o_custkey + 1) || '},{' || case when o_orderkey = 0 then '' else '"start":' || (o_orderkey * 2) || ',' end || '"size":1}]'), 1, 16) as seed, len(range(o_custkey + 1, o_custkey + 1 + o_orderkey % 4)) as ids from orders""")
def range_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pair = lambda s, n: F.struct(s.cast("bigint").alias("start"), n.cast("bigint").alias("size"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.array(pair(key, F.col("o_custkey") + 1), pair(key * 2, F.lit(1))).alias("ranges"))
    return rows.select("o_orderkey", assets.range_seed(F.col("ranges")).alias("seed"), F.size(assets.new_ids(F.col("o_custkey"), F.col("o_custkey") + key % 4)).cast("bigint").alias("ids"))


@query("""
with w as (select user_id, event_type, max(event_id) as last from events group by 1, 2)
select user_id, count(*) as keys from w where user_id in (select user_id from w where event_type = 'purchase') group by user_id order by user_id limit 25 offset 5
""")
def names_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the names whose values hold a key."""
    values = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    maps = values.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "last"))).alias("kv"))
    having = maps.where(F.map_contains_key("kv", "purchase"))
    return having.orderBy("user_id").offset(5).limit(25).select("user_id", F.size("kv").cast("bigint").alias("keys"))

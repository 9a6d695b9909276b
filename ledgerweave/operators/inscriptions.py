"""Inscriptions: numbers, curses, satpoints, parents, galleries and collections, and the names among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.ordered import first_wins, last_wins

#: Fixed heights of the rules.
JUBILEE_HEIGHT = 824_544
FRESH_SECONDS = 7 * 86_400


def numbered(inscriptions: DataFrame, jubilee: int = JUBILEE_HEIGHT) -> DataFrame:
    """inscriptions (height, tx, input, place, offset, cursed) with vindicated and number.

    Curses from the jubilee on are vindicated. The others count down from -1 and all else up from 0, in chain order.
    Numbers are made of counts by height, so that only those are ordered in one place.
    """
    marked = inscriptions.withColumn("vindicated", F.col("cursed") & (F.col("height") >= jubilee))
    marked = marked.withColumn("__low", F.col("cursed") & ~F.col("vindicated"))
    counts = marked.groupBy("__low", "height").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__low").orderBy("height").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__low", "height", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__low", "height").orderBy("tx", "input", "place", "offset"))
    place = F.col("__base") + F.col("__in")
    out = marked.withColumn("__in", inside).join(base, ["__low", "height"])
    return out.withColumn("number", F.when(F.col("__low"), -place).otherwise(place - 1).cast("bigint")).drop("__low", "__in", "__base")


def reinscriptions(inscriptions: DataFrame, order: list[str]) -> DataFrame:
    """inscriptions (sat, cursed and others) with nth, how many stand on the sat before, and reinscription, of those the ones that aren't cursed."""
    before = Window.partitionBy("sat").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blessed = F.sum(F.when(F.col("cursed"), 0).otherwise(1)).over(before)
    return inscriptions.withColumn("nth", F.count("*").over(before)).withColumn("reinscription", F.coalesce(blessed, F.lit(0)))


def valid_parents(children: DataFrame, spent_sats: DataFrame) -> DataFrame:
    """children (id, tx, parents of (id, sat)) with only the parents whose sat is among the transaction's inputs (tx, sat)."""
    each = children.select("id", "tx", F.posexplode_outer("parents").alias("place", "parent")).select("id", "tx", "place", "parent", F.col("parent.sat").alias("sat"))
    kept = each.join(spent_sats.select("tx", "sat").distinct(), ["tx", "sat"], "left_semi")
    kept = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "parent"))), lambda p: p["parent"]).alias("__kept"))
    out = children.join(kept, "id", "left")
    return out.withColumn("parents", F.coalesce("__kept", F.slice("parents", 1, 0))).drop("__kept")


def gallery(galleries: DataFrame, inscriptions: DataFrame) -> DataFrame:
    """id, place, item for the items (inscription ids) of galleries that are known inscriptions."""
    items = galleries.select("id", F.posexplode("items").alias("place", "item"))
    return items.join(inscriptions.select(F.col("id").alias("item")).distinct(), "item", "left_semi").select("id", "place", "item")


def collection_counts(held: DataFrame, collections: DataFrame) -> DataFrame:
    """owner, collection, items for held inscriptions (owner, id) in uploaded collections (collection, id)."""
    return held.join(collections.distinct(), "id").groupBy("owner", "collection").agg(F.count("*").alias("items"))


def freeze_authority(tickers: DataFrame, holders: DataFrame) -> DataFrame:
    """ticker, authority: the owner now of the deploy inscription (id) of each ticker that only its deployer mints (selfmint 100)."""
    return tickers.where("selfmint = 100").join(holders.select("id", F.col("owner").alias("authority")), "id").select("ticker", "authority")


def directives_in_force(directives: DataFrame, authority: DataFrame, within: int = 2) -> DataFrame:
    """Freeze directives (height, effective, ticker, initiator) by the ticker's authority that take effect at most so many blocks from their own."""
    known = directives.join(authority, "ticker").where("initiator = authority").drop("authority")
    return known.where(F.abs(F.col("height") - F.col("effective")) <= within)


def registered(names: DataFrame, order: list[str]) -> DataFrame:
    """The first inscription of each valid name, case folded."""
    from ledgerweave.functions.names import is_domain_name

    rows = names.withColumn("name", F.lower(F.trim("name")))
    return first_wins(rows.where(is_domain_name(F.col("name"))), ["name"], order)


def name_values(updates: DataFrame, owners: DataFrame, order: list[str]) -> DataFrame:
    """name, key, value: the latest value of each key among updates (name, by, pairs) by the name's owner."""
    mine = updates.join(owners.select("name", F.col("owner").alias("__owner")), "name").where("by = __owner")
    each = mine.select("name", *order, F.explode("pairs").alias("key", "value"))
    return last_wins(each, ["name", "key"], order).select("name", "key", "value")


def is_fresh(registered_at: Column, now: Column) -> Column:
    """Registered within the last seven days and not in the future (seconds)."""
    return (now - registered_at).between(0, FRESH_SECONDS - 1)


def commits(etchings: DataFrame, pushes: DataFrame, confirmations: int = 6) -> DataFrame:
    """Etchings (tx, height, commitment) of which an input spends a taproot output that is old enough and whose tapscript pushes the commitment (pushes: tx, data, created, taproot)."""
    old = pushes.where("taproot").select("tx", F.col("data").alias("commitment"), "created")
    met = etchings.join(old, ["tx", "commitment"]).where(F.col("height") - F.col("created") + 1 >= confirmations)
    return etchings.join(met.select("tx").distinct(), "tx", "left_semi")

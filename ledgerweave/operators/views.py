"""Read views of inscriptions, names and mints, what the ledger keeps for them, and checks against known totals."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.ids import utxo_id

#: Fixed value: the sat of an inscription that no output holds.
UNBOUND = -1


def sat_of(height: Column, out_tx: Column, place: Column, coinbase_input: Column) -> Column:
    """The number that stands for an inscription's sat: packed from height, transaction and place of the inscription.

    An inscription that ends in a coinbase output (transaction 0) has the input's place instead; without an output it is UNBOUND.
    """
    made = F.when(out_tx == 0, utxo_id(height, F.lit(0), coinbase_input)).otherwise(utxo_id(height, out_tx, place))
    return F.when(out_tx.isNull(), F.lit(UNBOUND).cast("bigint")).otherwise(made)


def enabled_sats(sats: DataFrame, disabled: DataFrame) -> DataFrame:
    """sats (sat, utxo, offset and others) without the disabled ones (sat)."""
    return sats.join(disabled.select("sat").distinct(), "sat", "left_anti")


def disable(disabled: DataFrame, requests: DataFrame, sats: DataFrame) -> DataFrame:
    """disabled (sat, proof) with the enabled sats of the outputs that requests (utxo, proof) name; the least proof counts where several name one."""
    asked = requests.groupBy("utxo").agg(F.min("proof").alias("proof"))  # first, so that an output's sats don't meet all of its requests
    new = enabled_sats(sats, disabled).select("sat", "utxo").join(asked, "utxo").groupBy("sat").agg(F.min("proof").alias("proof"))
    return disabled.select("sat", "proof").unionByName(new)


def inscriptions_of(inscriptions: DataFrame, sats: DataFrame, disabled: DataFrame, utxos: DataFrame | None = None) -> DataFrame:
    """inscriptions (id, sat and others) with the utxo, offset and owner of their sat, without disabled sats; of the given utxos only, if there are any."""
    if utxos is not None:
        sats = sats.join(utxos.select("utxo").distinct(), "utxo", "left_semi")
    return inscriptions.join(enabled_sats(sats, disabled).select("sat", "utxo", "offset", "owner"), "sat")


def wanted(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are asked for: inscriptions by number or textual id, those on sats, names by inscription."""
    return rows.join(asked.select(*keys).distinct(), keys, "left_semi")


def sat_membership(inscriptions: DataFrame) -> DataFrame:
    """sat, first, last, inscriptions and cursed of each sat; its members stay rows, as a sat may have any number."""
    cursed = F.sum(F.col("curse").isNotNull().cast("bigint"))
    return inscriptions.where(F.col("sat") != UNBOUND).groupBy("sat").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("inscriptions"), cursed.alias("cursed"))


def sat_assets(sats: DataFrame) -> DataFrame:
    """The asset that each sat with inscriptions is on its output: protocol, type, ticker (the sat), amount 1, at one offset."""
    tag = [F.lit("ordx").alias("protocol"), F.lit("o").alias("type"), F.col("sat").cast("string").alias("ticker"), F.lit(1).cast("bigint").alias("amount")]
    return sats.select("utxo", *tag, F.col("offset").alias("start"), (F.col("offset") + 1).alias("end"))


def names_on(names: DataFrame, inscriptions: DataFrame) -> DataFrame:
    """names (name, id) with the sat of their inscription."""
    return names.join(inscriptions.select("id", "sat"), "id")


def mint_details(mints: DataFrame, inscriptions: DataFrame) -> DataFrame:
    """mints (inscription_id, ticker, mint, amount and others) with what their inscription adds; mints without one are left out."""
    return mints.join(inscriptions, "inscription_id")


def loose_assets(runes: DataFrame, transfers: DataFrame) -> DataFrame:
    """Assets that aren't bound to sats: utxo, protocol, ticker, amount, invalid. runes: utxo, ticker, amount; transfers those and invalid."""
    held = runes.select("utxo", F.lit("runes").alias("protocol"), "ticker", "amount", F.lit(False).alias("invalid"))
    return held.unionByName(transfers.select("utxo", F.lit("brc20").alias("protocol"), "ticker", "amount", "invalid"))


def append_new(persisted: DataFrame, pending: DataFrame, keys: list[str]) -> DataFrame:
    """What an append-only list has to take in: pending rows, each key once, that it doesn't hold yet."""
    return pending.dropDuplicates(keys).join(persisted.select(*keys), keys, "left_anti")


def eligible(requests: DataFrame, balances: DataFrame, mainnet: bool = True) -> DataFrame:
    """requests (height, channel and others) whose channel address holds at least the stake of that height (balances: asset, owner, amount)."""
    from ledgerweave.functions.content import stake_asset

    asked = requests.withColumn("__stake", stake_asset(F.col("height"), mainnet))
    held = balances.groupBy(F.col("asset").alias("__asset"), F.col("owner").alias("__owner")).agg(F.sum("amount").alias("__held"))
    met = (F.col("__stake.name") == F.col("__asset")) & (F.col("channel") == F.col("__owner")) & (F.col("__held") >= F.col("__stake.amount"))
    return asked.join(held, met, "left_semi").drop("__stake")


def known_totals(observed: DataFrame, golden: DataFrame, height: int) -> DataFrame:
    """Known totals that the ledger misses at a height: kind, key, measure, expected, found (null where the ledger has none).

    golden: kind, key, since, measure, expected; observed: kind, key, measure, value. An expected 0 isn't checked, nor is one
    of something that begins (since) later. Keys are compared in lower case.
    """
    asked = golden.where((F.col("expected") != 0) & (F.coalesce("since", F.lit(0)) <= height)).withColumn("key", F.lower("key"))
    found = observed.select("kind", F.lower("key").alias("key"), "measure", F.col("value").alias("found"))
    return asked.join(found, ["kind", "key", "measure"], "left").where("found is distinct from expected").select("kind", "key", "measure", "expected", "found")


def any_of(flags: list[Column]) -> Column:
    """Whether any flag is set; nulls aren't."""
    return reduce(or_, (F.coalesce(f, F.lit(False)) for f in flags), F.lit(False))

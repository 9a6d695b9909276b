"""Where every sat of a block goes: transactions' inputs to their outputs, what is left to the coinbase, and assets along with them.

Tables of a block: inputs (height, tx, vin, utxo, value) and outputs (height, tx, vout, utxo, value); tx 0 is the coinbase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.flow import next_ends, running_ends


def spend(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """inputs (height, tx, vin, prev_txid, prev_vout) with utxo, value and owner of the outputs they spend (txid, vout, utxo, value, owner); unknown ones stay, with nulls."""
    known = outputs.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), "utxo", "value", "owner")
    return inputs.join(known, ["prev_txid", "prev_vout"], "left")


def stretches(sources: DataFrame, targets: DataFrame, by: list[str], source_order: list[Column], target_order: list[Column], source: str, target: str, width: int | None = None) -> DataFrame:
    """by, source, source_offset, target, target_offset, amount: sources' values laid end to end and cut by the targets' values, within by.

    What no target takes has a null target. Values of 0 take no part. flow.next_ends finds all stretches; width splits large groups.
    """
    marked = lambda df, order, key, name: running_ends(df.where("value > 0"), by, order, "value").select(*by, "end", F.struct(F.col(key).alias("key"), (F.col("end") - F.col("value")).alias("start")).alias(name))
    a, b = marked(sources, source_order, source, "s"), marked(targets, target_order, target, "t")
    cuts = a.unionByName(b, allowMissingColumns=True)
    found = next_ends(cuts, by, ["s", "t"], width).where("s is not null and end > begin")
    return found.select(
        *by, F.col("s.key").alias(source), (F.col("begin") - F.col("s.start")).alias("source_offset"), F.col("t.key").alias(target), (F.col("begin") - F.col("t.start")).alias("target_offset"), (F.col("end") - F.col("begin")).alias("amount")
    )


def block_flow(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """height, from_utxo, from_offset, to_utxo, to_offset, amount for all sats of blocks. New sats have a null from_utxo; sats that an underpaying coinbase leaves have a null to_utxo.

    Fees follow the new sats in the order of their transactions, and the coinbase's outputs cut them.
    """
    placed = inputs.where("tx > 0").select("height", "tx", "vin", "value", F.struct(F.col("utxo").alias("from_utxo"), "vin").alias("from"))
    inside = stretches(placed, outputs.where("tx > 0").withColumnRenamed("utxo", "to_utxo"), ["height", "tx"], [F.col("vin")], [F.col("vout")], "from", "to_utxo")
    paid = inside.where("to_utxo is not null").select("height", "from.from_utxo", F.col("source_offset").alias("from_offset"), "to_utxo", F.col("target_offset").alias("to_offset"), "amount")
    fees = inside.where("to_utxo is null").select("height", "tx", "from.vin", F.struct("from.from_utxo", F.col("source_offset").alias("base")).alias("fee"), F.col("amount").alias("value"))
    coinbase = outputs.where("tx = 0").withColumnRenamed("utxo", "to_utxo")
    reward = coinbase.groupBy("height").agg(F.sum("value").alias("reward"))
    new = reward.select("height", F.lit(0).alias("tx"), F.lit(0).alias("vin"), F.struct(F.lit(None).cast(inputs.schema["utxo"].dataType).alias("from_utxo"), F.lit(0).cast("bigint").alias("base")).alias("fee"), "reward")
    sources = new.unionByName(fees, allowMissingColumns=True)
    left = F.col("reward") - F.coalesce(F.sum("value").over(Window.partitionBy("height")), F.lit(0))  # what fees don't cover is new
    sources = sources.withColumn("value", F.when(F.col("reward").isNotNull(), F.greatest(left, F.lit(0))).otherwise(F.col("value"))).drop("reward")
    mined = stretches(sources, coinbase, ["height"], [F.col("tx"), F.col("vin")], [F.col("vout")], "fee", "to_utxo")
    mined = mined.select("height", F.col("fee.from_utxo").alias("from_utxo"), (F.col("fee.base") + F.col("source_offset")).alias("from_offset"), "to_utxo", F.col("target_offset").alias("to_offset"), "amount")
    return paid.unionByName(mined)


def carry(assets: DataFrame, moves: DataFrame) -> DataFrame:
    """Assets (utxo, start, end and others) on the outputs that their sats reach; pieces that touch nothing known are gone.

    Assets of outputs that aren't spent stay as they are.
    """
    rest = [c for c in assets.columns if c not in ("utxo", "start", "end")]
    spent = moves.where("from_utxo is not null").select("from_utxo").distinct()
    still = assets.join(spent, assets["utxo"] == spent["from_utxo"], "left_anti")
    met = assets.join(moves.where("to_utxo is not null"), assets["utxo"] == moves["from_utxo"]).where("start < from_offset + amount and from_offset < end")
    shift = F.col("to_offset") - F.col("from_offset")
    moved = met.select(*rest, F.col("to_utxo").alias("utxo"), (F.greatest("start", "from_offset") + shift).alias("start"), (F.least(F.col("end"), F.col("from_offset") + F.col("amount")) + shift).alias("end"))
    return still.select(*rest, "utxo", "start", "end").unionByName(moved)

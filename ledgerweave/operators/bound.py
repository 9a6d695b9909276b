"""Rules on assets that are bound to sats of outputs: mints on taken sats, release, freezes, and unconfirmed allocation."""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.flow import running_ends
from ledgerweave.operators.intervals import overlap_join
from ledgerweave.operators.paging import paginate
from ledgerweave.operators.protocols import ordered_fold


def void_mints(existing: DataFrame, mints: DataFrame, width: int = 1000) -> DataFrame:
    """Keys (utxo, ticker, seq) of mints of which a range meets one of the same ticker in the output already.

    existing: utxo, ticker, start, end. mints: those and seq, with a row for each range of a mint.
    """
    a = mints.select("utxo", "ticker", "seq", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = existing.select("utxo", "ticker", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlap_join(a, b, ["utxo", "ticker"], width).select("utxo", "ticker", "seq").distinct()


class _FreeSats:
    """Mints of one output and ticker in order; one that meets sats of an accepted one is void."""

    def __init__(self):
        self.taken: list[tuple[int, int]] = []

    def __call__(self, row) -> list[tuple]:
        ranges = sorted((int(r["start"]), int(r["end"])) for r in row.ranges)
        free = all(self._free(s, e) for s, e in ranges)
        if free:
            for r in ranges:
                insort(self.taken, r)
        return [(row.utxo, row.ticker, row.seq, free)]

    def _free(self, start: int, end: int) -> bool:
        at = bisect_right(self.taken, (start, 2**63))
        return not (at and self.taken[at - 1][1] > start or at < len(self.taken) and self.taken[at][0] < end)


def apply_mints(existing: DataFrame, mints: DataFrame, width: int = 1000) -> DataFrame:
    """existing with the ranges of valid mints: those that meet neither existing ranges of their ticker nor those of an earlier valid mint.

    The first is a join by stretches; only the rest goes, in order, through a fold by output and ticker.
    """
    rest = mints.join(void_mints(existing, mints, width), ["utxo", "ticker", "seq"], "left_anti")
    rows = rest.groupBy("utxo", "ticker", "seq").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("utxo", "ticker", "seq")) + ", valid boolean"
    valid = ordered_fold(rows, ["utxo", "ticker"], ["seq"], _FreeSats, schema).where("valid")
    added = rest.join(valid, ["utxo", "ticker", "seq"], "left_semi")
    return existing.select("utxo", "ticker", "start", "end").unionByName(added.select("utxo", "ticker", "start", "end"))


def unbind(requests: DataFrame, outputs: DataFrame, holders: DataFrame, tickers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, holders left) after releases.

    requests: tx, ticker, vout, initiator (the owner of the transaction's last input). outputs: tx, vout, utxo, owner.
    holders: utxo, ticker, amount. A request counts for a known ticker, an output of its own transaction that holds it, and
    the initiator's own output; two requests for one output and ticker are one.
    """
    asked = requests.withColumn("ticker", F.lower("ticker")).join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    target = asked.join(outputs, ["tx", "vout"]).where("owner = initiator").select("ticker", "utxo", "owner").distinct()
    history = holders.join(target, ["ticker", "utxo"]).select("ticker", "owner", "utxo", "amount")
    return history, holders.join(target, ["ticker", "utxo"], "left_anti")


def unbind_history(history: DataFrame, ticker, start: int, limit: int, owner=None) -> DataFrame:
    """A page of releases of a ticker, by owner and output, or of one owner's by output."""
    rows = history.where(F.col("ticker") == ticker)
    rows = rows if owner is None else rows.where(F.col("owner") == owner)
    return paginate(rows, [F.col("owner"), F.col("utxo")], start, limit)


def freeze_history(history: DataFrame, ticker, start: int, limit: int, owner=None) -> DataFrame:
    """A page of freezes of a ticker (owner, confirmed, effective, action, txid), by those, or of one owner's."""
    rows = history.where(F.col("ticker") == ticker)
    rows = rows if owner is None else rows.where(F.col("owner") == owner)
    return paginate(rows, [F.col(c) for c in ("owner", "confirmed", "effective", "action", "txid")], start, limit)


#: Protocols whose assets aren't bound to sats and follow rules of their own.
UNBOUND_PROTOCOLS = ("runes", "atom")


def allocate_unconfirmed(inputs: DataFrame, outputs: DataFrame, assets: DataFrame) -> DataFrame:
    """tx, vout, known, occupied for each output of unconfirmed transactions.

    inputs: tx, vin, utxo, value (null if not known). outputs: tx, vout, value. assets: utxo, protocol, start, end, with a
    null start for amounts without a place. Assets and outputs are sorted along a transaction's sats once: no pairs are formed. A transaction fails closed, with known false for all its outputs, if an input
    is unknown, an asset has no place, or its outputs ask for more than its inputs hold. Otherwise an output is occupied if
    a bound asset's sats flow to it.
    """
    each = Window.partitionBy("tx")
    upto = each.orderBy("vin").rowsBetween(Window.unboundedPreceding, 0)
    known = F.greatest(F.col("value"), F.lit(0))
    held = inputs.withColumn("__end", F.sum(known).over(upto)).withColumn("__held", F.sum("value").over(each)).withColumn("__unknown", F.bool_or(F.col("value").isNull()).over(each))
    bound = assets.where(~F.col("protocol").isin(*UNBOUND_PROTOCOLS)).select("utxo", F.struct("start", "end").alias("__asset"))
    low, high = F.col("__end") - known + F.greatest("__asset.start", F.lit(0)), F.col("__end") - known + F.least("__asset.end", known)
    lies = F.col("__asset.start").isNotNull() & F.col("__asset.end").isNotNull() & (low < high)
    facts = held.join(bound, "utxo", "left").select(
        "tx", "__held", (F.col("__unknown") | (F.col("__asset").isNotNull() & F.col("__asset.start").isNull())).alias("__fails"), F.when(lies, low).alias("__at"), F.when(lies, high).alias("__high")
    )
    # an asset at the end of an output or later isn't in it: outputs stand at their last sat's end, before assets there
    asked = running_ends(outputs.withColumn("__take", F.greatest(F.col("value"), F.lit(0))), ["tx"], [F.col("vout")], "__take", "__at")
    asked = asked.select("tx", "vout", F.col("value").alias("__value"), "__at", (F.col("__at") - F.col("__take")).alias("__low"))
    rows = asked.withColumn("__output", F.lit(True)).unionByName(facts, allowMissingColumns=True)
    along = each.orderBy("__at", F.col("__output").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    good = ~F.coalesce(F.bool_or("__fails").over(each), F.lit(False)) & (F.sum("__value").over(each) <= F.coalesce(F.max("__held").over(each), F.lit(0)))
    met = F.coalesce((F.max("__high").over(along) > F.col("__low")) & (F.col("__low") < F.col("__at")), F.lit(False))
    judged = rows.withColumn("known", good).withColumn("__met", met).where("__output")
    return judged.select("tx", "vout", "known", (F.col("known") & F.col("__met")).alias("occupied"))


def rune_outputs(balances: dict, edicts: list[tuple], unspendable: list[bool], pointer: int | None = None, cenotaph: bool = False, mints_or_etches: bool = False) -> list[bool] | None:
    """Which outputs of an unconfirmed transaction get runes; None if that can't be told (a mint, an etching or a bad output number).

    edicts are (rune, amount, output). A cenotaph occupies nothing. Amounts for an unspendable output are gone.
    """
    n = len(unspendable)
    taken = [False] * n
    if cenotaph:
        return taken
    if mints_or_etches:
        return None
    left = {rune: amount for rune, amount in balances.items() if amount}
    if not left:
        return taken
    open_outputs = [k for k, gone in enumerate(unspendable) if not gone]
    for rune, amount, output in edicts:
        have = left.get(rune, 0)
        if not have:
            continue
        if output > n:
            return None
        if output < n:
            take = min(amount or have, have)
            taken[output] = taken[output] or not unspendable[output]
            left[rune] = have - take
        elif not open_outputs or not amount:
            for k in open_outputs[: min(have, len(open_outputs))]:
                taken[k] = True
            left[rune] = 0
        else:
            for k in open_outputs:
                if have:
                    taken[k], have = True, have - min(amount, have)
            left[rune] = have
    if pointer is not None and pointer >= n:
        return None
    rest = pointer if pointer is not None else (open_outputs[0] if open_outputs else None)
    if rest is not None and not unspendable[rest] and any(left.values()):
        taken[rest] = True
    return taken

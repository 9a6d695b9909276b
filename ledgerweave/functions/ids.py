"""Packed output ids, outpoints, asset names and compact ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed bit widths of a packed output id: height, transaction index, output index.
TX_BITS, OUT_BITS = 17, 18


def utxo_id(height: Column, tx: Column, out: Column) -> Column:
    """height, tx and out in one long; null where a part doesn't fit."""
    fits = height.between(0, (1 << 28) - 1) & tx.between(0, (1 << TX_BITS) - 1) & out.between(0, (1 << OUT_BITS) - 1)
    return F.when(fits, F.shiftleft(height.cast("bigint"), TX_BITS + OUT_BITS).bitwiseOR(F.shiftleft(tx.cast("bigint"), OUT_BITS)).bitwiseOR(out.cast("bigint")))


def utxo_parts(packed: Column) -> tuple[Column, Column, Column]:
    height = F.shiftrightunsigned(packed, TX_BITS + OUT_BITS)
    tx = F.shiftrightunsigned(packed, OUT_BITS).bitwiseAND(F.lit((1 << TX_BITS) - 1).cast("bigint"))
    return height, tx, packed.bitwiseAND(F.lit((1 << OUT_BITS) - 1).cast("bigint"))


def is_outpoint(text: Column) -> Column:
    return text.rlike(r"^[0-9a-fA-F]{64}:[0-9]+$")


def outpoint(text: Column) -> Column:
    """struct(txid, vout) of `txid:vout`; null if malformed."""
    parts = F.split(text, ":")
    return F.when(is_outpoint(text), F.struct(parts[0].alias("txid"), parts[1].try_cast("int").alias("vout")))


def inscription_id(text: Column) -> Column:
    """struct(txid, number) of `<txid>i<n>`; null if malformed."""
    shape = r"^([0-9a-f]{64})i([0-9]+)$"
    return F.when(text.rlike(shape), F.struct(F.regexp_extract(text, shape, 1).alias("txid"), F.regexp_extract(text, shape, 2).try_cast("int").alias("number")))


def sat_point(text: Column) -> Column:
    """struct(txid, vout, offset) of `txid:vout:offset`; null if malformed."""
    parts = F.split(text, ":")
    return F.when(text.rlike(r"^[0-9a-f]{64}:[0-9]+:[0-9]+$"), F.struct(parts[0].alias("txid"), parts[1].try_cast("int").alias("vout"), parts[2].try_cast("bigint").alias("offset")))


def rune_id(text: Column) -> Column:
    """struct(block, tx) of `block:tx`; null if malformed."""
    parts = F.split(text, ":")
    return F.when(text.rlike("^[0-9]+:[0-9]+$"), F.struct(parts[0].try_cast("bigint").alias("block"), parts[1].try_cast("int").alias("tx")))


def compact_id(txid: Column, number: Column) -> Column:
    return F.concat(txid, F.lit("i"), number.cast("string"))


def asset_name(text: Column) -> Column:
    """struct(protocol, type, ticker) of a name with up to four parts between colons.

    One part is an ordx f ticker, two are a protocol's f ticker, three are all; of four, the last two are a ticker with a
    colon. Other names are null.
    """
    p = F.split(text, ":")
    made = lambda a, b, c: F.struct(a.alias("protocol"), b.alias("type"), c.alias("ticker"))
    ordx, fungible = F.lit("ordx"), F.lit("f")
    return (
        F.when(F.size(p) == 1, made(ordx, fungible, p[0])).when(F.size(p) == 2, made(p[0], fungible, p[1]))
        .when(F.size(p) == 3, made(p[0], p[1], p[2])).when(F.size(p) == 4, made(p[0], p[1], F.concat_ws(":", p[2], p[3])))
    )


def is_op_return(script: Column) -> Column:
    return F.startswith(script, F.lit(b"\x6a"))


def is_unspendable(script: Column) -> Column:
    return is_op_return(script) | F.startswith(script, F.lit(b"\x00\x6a"))


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")

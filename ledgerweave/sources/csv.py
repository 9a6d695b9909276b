"""Readers and writers of validation snapshots: CSV histories, holder lists, and the text snapshot used for diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed column lists of the snapshot files, by kind.
COLUMNS = {
    "history": "ticker string, type string, valid string, txid string, idx int, vout int, offset bigint, inscriptionNumber bigint, inscriptionId string, `from` string, `to` string, satoshi bigint, fee bigint, amount string, overallBalance string, transferBalance string, availableBalance string, height int, txidx int",
    "rune_holders": "rune string, height int, address string, balance string",
    "arc_holders": "ticker string, height int, address string, amount bigint",
    "token_holders": "address string, overall_balance string, transferable_balance string, available_balance string, available_balance_safe string, available_balance_unsafe string, last_height int, updated_at string, token string",
    "token_tickers": "ticker string, inscription_number bigint, inscription_id string, inscription_number_start bigint, inscription_number_end bigint, deploy_height int, complete_height int",
    "arc_tickers": "ticker string, height int, atomical_id string, utxo_count int, utxo_amount bigint, minted_times bigint, minted_amount bigint, max_mints bigint",
    "arc_utxos": "ticker string, height int, utxo_id bigint, amount bigint",
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one file or a directory of them, plain or gzip, by header names. Columns missing in a file are null."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    schema = spark.createDataFrame([], COLUMNS[kind]).schema
    have = {c.lower(): c for c in raw.columns}
    pick = [
        (F.expr(f"try_cast(trim(`{have[f.name.lower()]}`) as {f.dataType.simpleString()})") if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema
    ]
    return raw.select(*pick)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """An action history: rows with valid = 0 dropped, tickers lower-cased, one row per inscription number, output and offset."""
    rows = read_csv(spark, path, "history").where("valid is distinct from '0'")
    return rows.withColumn("ticker", F.lower("ticker")).dropDuplicates(["inscriptionNumber", "txid", "vout", "offset"])


def read_token_holders(spark: SparkSession, path: str) -> DataFrame:
    """Holder rows of a token, with updated_at as a timestamp (null if it isn't `yyyy/MM/dd HH:mm`)."""
    return read_csv(spark, path, "token_holders").withColumn("updated_at", F.expr("try_to_timestamp(updated_at, 'yyyy/MM/dd HH:mm')"))


def split_csv(spark: SparkSession, path: str, target: str, rows_per_file: int) -> None:
    """The rows of a CSV as files of at most so many rows, each with the header."""
    spark.read.option("header", True).csv(path).write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(target)


def filter_csv(spark: SparkSession, path: str, target: str, height: int, column: str = "height") -> None:
    """The rows of a CSV up to a height, with the header; rows without a height are left out."""
    rows = spark.read.option("header", True).csv(path)
    rows.where(F.col(column).try_cast("bigint") <= height).write.mode("overwrite").option("header", True).csv(target)


def height_range(rows: DataFrame) -> DataFrame:
    """first_height and last_height of a history, over all of its rows."""
    return rows.agg(F.min("height").alias("first_height"), F.max("height").alias("last_height"))


def read_holder_text(spark: SparkSession, path: str) -> DataFrame:
    """height, address, amount of a holder list: a line `height: N`, then lines `"address": amount,`."""
    lines = spark.read.text(path)
    height = lines.select(F.regexp_extract("value", r"^\s*height:\s*(\d+)", 1).cast("string").alias("h")).where("h <> ''").agg(F.max(F.expr("try_cast(h as int)")).alias("height"))
    held = lines.select(F.regexp_extract("value", r'"([^"]+)"\s*:', 1).alias("address"), F.expr(r"""try_cast(regexp_extract(value, '":\\s*(-?\\d+)', 1) as bigint)""").alias("amount"))
    return held.where("address <> ''").select(height.scalar().alias("height"), "address", "amount")


def write_snapshot(tickers: DataFrame, utxos: DataFrame, height: int, path: str) -> None:
    """The pipe-delimited text snapshot: a status line, tickers, then utxos, in a fixed order."""
    status = tickers.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.lit(f"status|height={height}").alias("value"))
    named = tickers.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.format_string("ticker|name=%s|atomical=%s", "name", "atomical").alias("value"))
    held = utxos.select(F.lit(2).alias("part"), F.concat_ws("|", "ticker", "outpoint").alias("key"), F.format_string("utxo|ticker=%s|outpoint=%s|amount=%d", "ticker", "outpoint", "amount").alias("value"))
    status.unionByName(named).unionByName(held).orderBy("part", "key").select("value").write.mode("overwrite").text(path)


def diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two snapshots that differ: keys, left_value, right_value; a missing side is null."""
    a, b = (x.select(*keys, F.col(value).alias(f"{side}_value")) for x, side in ((left, "left"), (right, "right")))
    return a.join(b, keys, "full_outer").where("left_value is distinct from right_value")

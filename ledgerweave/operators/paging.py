"""Sorted pages with a total, as list queries return them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paginate(df: DataFrame, order: list[Column], start: int, limit: int, keep_total: bool = True) -> DataFrame:
    """Rows [start, start + limit) of df in order, with the count of all rows in total.

    start below 0 is 0 and a limit of 0 or less takes the rest. With keep_total false, total is the page's own size, as in
    lists that lose the total past their end. order must be total for a stable page. Spark plans a page as a top-k.
    """
    page = df.orderBy(*order).offset(max(0, start)) if start > 0 else df.orderBy(*order)
    page = page.limit(limit) if limit > 0 else page
    source = df if keep_total else page
    total = source.agg(F.count("*").alias("total")).scalar()
    return page.withColumn("total", total)


def seek(df: DataFrame, key: str, after, limit: int, reverse: bool = False) -> DataFrame:
    """Keyset page: the next limit rows after a key (exclusive), or before it in reverse; after None begins at the end concerned."""
    column = F.col(key)
    if after is not None:
        df = df.where(column < after if reverse else column > after)
    return df.orderBy(column.desc() if reverse else column.asc()).limit(limit)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(*order).limit(n)

"""Sets of half-open intervals held as rows: start, end by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(ranges: DataFrame, *by: str, adjacent: bool = True) -> DataFrame:
    """The union of each group's intervals as disjoint ones; with adjacent, intervals that touch become one. Empty ones vanish."""
    ranges = ranges.where("start < end")
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(before)
    apart = F.col("start") > reach if adjacent else F.col("start") >= reach
    marked = ranges.select(*by, "start", "end", F.when(reach.isNull() | apart, 1).otherwise(0).alias("first"))
    numbered = marked.withColumn("island", F.sum("first").over(upto))
    return numbered.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*by, "start", "end")


def _cover(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Stretches between the borders of two sets, with how many intervals of each cover them."""

    def borders(x: DataFrame, da: int, db: int) -> DataFrame:
        x = x.where("start < end")
        ends = F.array(F.struct(F.col("start").alias("at"), F.lit(da).alias("da"), F.lit(db).alias("db")), F.struct(F.col("end").alias("at"), F.lit(-da).alias("da"), F.lit(-db).alias("db")))
        return x.select(*by, F.inline(ends))

    points = borders(a, 1, 0).unionByName(borders(b, 0, 1)).groupBy(*by, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*by).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return points.select(*by, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("da").over(upto).alias("in_a"), F.sum("db").over(upto).alias("in_b")).where("end is not null")


def subtract(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """What a covers and b doesn't, as disjoint intervals that don't touch: one sweep over both sets' borders."""
    return islands(_cover(a, b, by).where("in_a > 0 and in_b = 0"), *by)


def intersect(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """What both cover, as disjoint intervals that don't touch."""
    return islands(_cover(a, b, by).where("in_a > 0 and in_b > 0"), *by)


def contains(container: DataFrame, target: DataFrame, *by: str) -> DataFrame:
    """Groups of target with contained: whether the container's union covers the whole of it."""
    missing = subtract(target, container, *by).select(*by).distinct().withColumn("missing", F.lit(True))
    return target.select(*by).distinct().join(missing, list(by), "left").select(*by, F.col("missing").isNull().alias("contained"))


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], width: int, a_cols: tuple[str, str] = ("a_start", "a_end"), b_cols: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Pairs of intervals of a group that overlap, by an equi-join on the stretches of width that they touch.

    A pair that meets in several stretches is kept in the first only. Choose width near the usual interval length.
    """
    (s, e), (x, y) = a_cols, b_cols
    stretch = lambda first, last: F.explode(F.sequence(F.floor(F.col(first) / width), F.floor((F.col(last) - 1) / width)))
    left = a.where(F.col(s) < F.col(e)).withColumn("__bin", stretch(s, e))
    right = b.where(F.col(x) < F.col(y)).withColumn("__bin", stretch(x, y))
    met = left.join(right, [*by, "__bin"]).where((F.col(s) < F.col(y)) & (F.col(x) < F.col(e)))
    return met.where(F.col("__bin") == F.floor(F.greatest(s, x) / width)).drop("__bin")


def as_of(probes: DataFrame, points: DataFrame, by: list[str], at: str, values: list[str], inclusive: bool = True) -> DataFrame:
    """probes with the values of the latest point at or before each probe (before it, if not inclusive); null where there is none.

    Both sides are sorted together once and the last point is carried on: no pairs are formed.
    """
    held = F.struct(F.col(at).alias("at"), *values)
    mixed = probes.withColumn("__point", F.lit(None).cast(points.select(held.alias("x")).schema["x"].dataType)).withColumn("__side", F.lit(1 if inclusive else 0))
    carried = points.select(*by, at, held.alias("__point"), F.lit(0 if inclusive else 1).alias("__side"))
    order = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    joined = mixed.unionByName(carried, allowMissingColumns=True).withColumn("__last", F.last("__point", ignorenulls=True).over(order))
    is_probe = F.col("__side") == (1 if inclusive else 0)
    return joined.where(is_probe).select(*probes.columns, *(F.col("__last")[v].alias(v) for v in values))


def clip(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The part of [start, end) inside [low, high)."""
    return F.greatest(start, low), F.least(end, high)

"""First-in-first-out flow of value from inputs to outputs, and positions in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_ends(rows: DataFrame, by: list[str], order: list[Column], value: str, into: str = "end", stretch: Column | None = None) -> DataFrame:
    """rows with the running sum of value within by, up to and with each row. order must be total.

    A group is summed in one task. With stretch, which must not fall along the order, it is summed by stretches instead:
    sums of stretches are ordered in one task for each group, rows only inside their stretch.
    """
    if stretch is None:
        upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(into, F.sum(value).over(upto).cast("bigint"))
    cut = rows.withColumn("__stretch", stretch)
    sums = cut.groupBy(*by, "__stretch").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "__stretch", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    upto = Window.partitionBy(*by, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("__own", F.sum(value).over(upto)).join(base, [*by, "__stretch"]).withColumn(into, (F.col("__base") + F.col("__own")).cast("bigint")).select(*rows.columns, into)


def next_ends(cuts: DataFrame, by: list[str], keys: list[str], width: int | None = None) -> DataFrame:
    """cuts (by, end, keys) with begin, the end before, and for each key the first that isn't null at or after the end.

    The rows are sorted once, from the last end to the first, and keys are carried along, so the work is linear. With
    width, a group is dealt over stretches of so much value: only the first keys of stretches are ordered in one place.
    """
    order = Window.partitionBy(*by).orderBy(F.col("end").desc())
    here = order.rangeBetween(Window.unboundedPreceding, 0)  # ties end together: each of them sees the whole tie
    if width is None:
        return cuts.select(*by, "end", F.coalesce(F.lead("end").over(order), F.lit(0)).alias("begin"), *(F.last(k, ignorenulls=True).over(here).alias(k) for k in keys))
    binned = cuts.withColumn("__bin", F.floor(F.col("end") / width))
    firsts = binned.groupBy(*by, "__bin").agg(F.max("end").alias("__end"), *(F.min_by(k, F.when(F.col(k).isNotNull(), F.col("end"))).alias(k) for k in keys))
    bins = Window.partitionBy(*by).orderBy(F.col("__bin").desc())
    later = bins.rowsBetween(Window.unboundedPreceding, -1)
    ahead = firsts.select(*by, "__bin", F.coalesce(F.lead("__end").over(bins), F.lit(0)).alias("__before"), *(F.last(k, ignorenulls=True).over(later).alias(f"__{k}") for k in keys))
    order = Window.partitionBy(*by, "__bin").orderBy(F.col("end").desc())
    here = order.rangeBetween(Window.unboundedPreceding, 0)
    own = binned.select(*by, "__bin", "end", F.lead("end").over(order).alias("__lead"), *(F.last(k, ignorenulls=True).over(here).alias(k) for k in keys))
    return own.join(ahead, [*by, "__bin"]).select(*by, "end", F.coalesce("__lead", "__before").alias("begin"), *(F.coalesce(k, f"__{k}").alias(k) for k in keys))


def allocate(inputs: DataFrame, outputs: DataFrame, by: list[str], in_key: str, out_key: str, width: int | None = None) -> DataFrame:
    """by, in_key, out_key, amount: how much of each input goes to each output, in order.

    Both sides have `end`, the running end of their value within by, and no zero values. The ends of both sides cut the
    flow into stretches; each belongs to the next input and the next output that end at or after it (next_ends). Inputs
    and outputs are never paired. What one side has beyond the other is left out. width splits large groups.
    """
    none = lambda side, key: F.lit(None).cast(side.schema[key].dataType).alias(key)
    cuts = inputs.select(*by, "end", in_key, none(outputs, out_key)).unionByName(outputs.select(*by, "end", none(inputs, in_key), out_key))
    stretch = next_ends(cuts, by, [in_key, out_key], width)
    return stretch.where(F.col(in_key).isNotNull() & F.col(out_key).isNotNull() & (F.col("end") > F.col("begin"))).select(*by, in_key, out_key, (F.col("end") - F.col("begin")).alias("amount"))


def locate(points: DataFrame, ranges: DataFrame, by: list[str], key: str, position: str = "position") -> DataFrame:
    """points with the key of the range [start, end) of their group that holds position, and the offset inside it; null beyond all ranges."""
    starts = ranges.select(*by, F.col("start").alias(position), F.struct("start", "end", key).alias("__range"))
    probes = points.withColumn("__range", F.lit(None).cast(starts.schema["__range"].dataType)).withColumn("__probe", F.lit(1))
    order = Window.partitionBy(*by).orderBy(position, "__probe").rowsBetween(Window.unboundedPreceding, 0)
    both = probes.unionByName(starts.withColumn("__probe", F.lit(0)), allowMissingColumns=True).withColumn("__last", F.last("__range", ignorenulls=True).over(order))
    inside = F.col(position) < F.col("__last.end")
    return both.where("__probe = 1").select(*points.columns, F.when(inside, F.col("__last")[key]).alias(key), F.when(inside, F.col(position) - F.col("__last.start")).alias("offset"))


def two_level_prefix(rows: DataFrame, bucket: str, order: list[Column], value: str) -> DataFrame:
    """rows with `before`, the sum of value over all earlier rows, for a whole table ordered by bucket and then order.

    Only sums by bucket are ordered in one place; rows are ordered inside their bucket.
    """
    sums = rows.groupBy(bucket).agg(F.sum(value).alias("__sum"))
    earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(bucket, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base, bucket).withColumn("before", (F.col("__base") + F.col("__own")).cast("bigint")).drop("__own", "__base")

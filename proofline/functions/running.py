"""Running aggregates over keyed, time-ordered rows, split into time buckets.

A plain window over a key puts all rows of that key into one task. Here the
window key is (key, bucket), and what earlier buckets contribute comes from a
table with one row per (key, bucket), built by a map-side-combined aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.exprs import micros

MINUTE_US = 60 * 1_000_000


def bucket_of(value: Column, width: Column | int) -> Column:
    """The bucket of a whole number, in exact arithmetic."""
    width = width if isinstance(width, Column) else F.lit(width)
    width = width.cast("bigint")
    value = value.cast("bigint")
    return F.call_function("div", value - F.pmod(value, width), width)


def time_bucket(col: Column, width_us: Column | int) -> Column:
    return bucket_of(micros(col), width_us)


def running(
    df: DataFrame,
    keys: list[str],
    time: str,
    value: Column,
    agg: str,
    out: str,
    rank: str | None = None,
    bucket_us: int = MINUTE_US,
) -> DataFrame:
    """Add ``out``: sum or max of ``value`` over all rows of the key up to this one.

    ``rank`` orders rows that share a timestamp (low first, and rows equal in
    both see each other). Rows with a NULL key or time can match nothing in a
    time-ordered lookup and are left out.
    """
    fold = {"sum": F.sum, "max": F.max}[agg]
    order = [F.col(time)] + ([F.col(rank)] if rank else [])
    slot = [*keys, "__bucket"]
    rows = (
        df.dropna(subset=[*keys, time])
        .withColumn("__bucket", time_bucket(F.col(time), bucket_us))
        .withColumn("__v", value)
    )
    inside = (
        Window.partitionBy(*slot)
        .orderBy(*order)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("__bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        rows.groupBy(*slot)
        .agg(fold("__v").alias("__t"))
        .select(*slot, fold("__t").over(earlier).alias("__before"))
    )
    joined = rows.withColumn("__inside", fold("__v").over(inside)).join(carry, slot)
    if agg == "sum":
        total = F.coalesce(F.col("__inside"), F.lit(0)) + F.coalesce(F.col("__before"), F.lit(0))
    else:
        total = F.greatest("__inside", "__before")
    return joined.select(*df.columns, total.alias(out))

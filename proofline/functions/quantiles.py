"""Exact discrete quantiles per group without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.skew import is_short, settled


def exact_quantiles(
    df: DataFrame, group: str, value: str, probs: dict[str, float], per_unit: int = 4096
) -> DataFrame:
    """One row per group with a column per quantile (``percentile_disc``).

    Equal values are counted together first. Values fall into bins of width
    1/``per_unit``; the running count over bins says which bin holds the wanted
    rank, and only the values in those few bins are put in order. Choose the
    width so that a group has some thousands of bins.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__bin", F.floor(F.col(value) * per_unit).cast("bigint"))
    )
    whole = Window.partitionBy(group)
    upto = whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.greatest(F.ceil(F.col("__total") * F.lit(p)).cast("bigint"), F.lit(1)).alias(
                    "rank"
                ),
            )
            for name, p in probs.items()
        ]
    )
    hits = (
        counted.groupBy(group, "__bin")
        .agg(F.sum("__n").alias("__in"))
        .withColumn("__total", F.sum("__in").over(whole))
        .withColumn("__upto", F.sum("__in").over(upto))
        .withColumn("q", F.explode(ranks))
        .where(
            (F.col("q.rank") > F.col("__upto") - F.col("__in"))
            & (F.col("q.rank") <= F.col("__upto"))
        )
        .select(
            group, "__bin", "q.name", "q.rank", (F.col("__upto") - F.col("__in")).alias("__below")
        )
    )
    order = (
        Window.partitionBy(group, "__bin", "name")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counted.join(hits, [group, "__bin"])
        .withColumn("__upto", F.col("__below") + F.sum("__n").over(order))
        .where(F.col("__upto") >= F.col("rank"))
        .groupBy(group)
        .agg(*[F.min(F.when(F.col("name") == n, F.col(value))).alias(n) for n in probs])
    )


MARKS = 1024
ACCURACY = 16_384


def selected_quantiles(
    df: DataFrame, group: str, value: str, probs: dict[str, float], bound: int = 100_000
) -> DataFrame:
    """``percentile_disc`` per group by selection: no bins of a fixed width, whatever the values.

    Equal values are counted together first. If a group has more than ``bound`` distinct
    values, an approximate summary names about ``MARKS`` of them, evenly spaced; exact
    counts of the rows between neighbouring marks say where the wanted rank lies, and the
    same is done with the values there. So the values in question shrink by some hundred
    times a round however they are spread, the result does not depend on how good
    the summary is, and what is put in order at the end is ``bound`` values at most.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(value).alias("__v"))
    counted = settled(rows.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n")))
    kind = counted.schema["__v"].dataType
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()]))
    totals = counted.groupBy(F.col("__g").alias("g")).agg(F.sum("__n").alias("total"))
    open_ = totals.select("g", "total", asked.alias("q")).select(
        "g", "q.name", F.greatest(F.ceil(F.col("total") * F.col("q.p")), F.lit(1)).cast("bigint").alias("rank"),
        F.lit(None).cast(kind).alias("lo"), F.lit(None).cast(kind).alias("hi"), F.lit(0).cast("bigint").alias("below"),
    )
    inside = F.expr("g <=> __g and (lo is null or __v >= lo) and (hi is null or __v <= hi)")

    def within(spans: DataFrame) -> DataFrame:
        # A row per group and quantile.
        return counted.join(F.broadcast(spans) if is_short(spans) else spans, inside)

    grid = F.array(*[F.lit(i / MARKS) for i in range(MARKS + 1)])
    # The last mark that is not above the value, by halving.
    middle = "cast((s.a + s.b + 1) div 2 as int)"
    slot = F.expr(
        f"aggregate(sequence(1, {MARKS.bit_length()}), named_struct('a', 0, 'b', size(marks) - 1), (s, i) -> "
        f"named_struct('a', if(__v >= marks[{middle}], {middle}, s.a), 'b', if(__v >= marks[{middle}], s.b, {middle} - 1))).a"
    )
    found = None
    while True:
        open_ = settled(open_)
        sizes = settled(within(open_).groupBy("g", "name").agg(F.count(F.lit(1)).alias("values")))
        sizes = sizes.select(F.col("g").alias("of"), F.col("name").alias("of_name"), "values")
        sized = open_.join(sizes, F.expr("g <=> of and name = of_name")).drop("of", "of_name")
        small = sized.where(F.col("values") <= bound).drop("values")
        found = small if found is None else found.unionByName(small)
        open_ = settled(sized.where(F.col("values") > bound).drop("values"))
        if open_.isEmpty():
            break
        marks = within(open_).groupBy("g", "name").agg(F.percentile_approx("__v", grid, F.lit(ACCURACY)).alias("marks"))
        marked = settled(
            open_.join(marks.select(F.col("g").alias("of"), F.col("name").alias("of_name"), "marks"), F.expr("g <=> of and name = of_name"))
            .drop("of", "of_name")
        )
        each = within(marked).groupBy("g", "name", "rank", "below", slot.alias("slot")).agg(
            F.sum("__n").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")
        )
        upto = Window.partitionBy("g", "name").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        each = each.withColumn("upto", F.col("below") + F.sum("n").over(upto))
        open_ = each.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(
            "g", "name", "rank", "lo", "hi", (F.col("upto") - F.col("n")).alias("below")
        )
    order = Window.partitionBy("g", "name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        within(settled(found))
        .withColumn("upto", F.col("below") + F.sum("__n").over(order))
        .where(F.col("upto") >= F.col("rank"))
        .groupBy(F.col("g").alias(group))
        .agg(*[F.min(F.when(F.col("name") == n, F.col("__v"))).alias(n) for n in probs])
    )

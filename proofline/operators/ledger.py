"""Hash-chain verification over ranges of the ledger that Spark cuts evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.skew import heavy_keys, repeat_rows, settled

# Copies of one row beyond this are counted together before the rows are placed.
COPIES = 100_000


def linked(ledger: DataFrame, chain: list[str], copies: int = COPIES) -> DataFrame:
    """Ledger rows with their predecessor in the chain.

    Adds ``copies`` (how many identical rows the row stands for), ``before_hash``
    and ``before_seq``. The order is sequence number (null first), then event
    hash, then the remaining columns, so equal sequence numbers have a fixed order.

    A chain may be most of the table, and a sequence number most of a chain, so
    nothing is grouped by them: the rows are range-partitioned by chain and
    order, which cuts anywhere, and written down with the number of their range.
    ``lag`` runs inside a range, and the first row of a range takes the last row
    of the range before: one row per range, as many as shuffle partitions.
    """
    cols = ledger.columns
    rest = [c for c in cols if c not in (*chain, "sequence_number", "event_hash")]
    order = [*chain, "sequence_number", "event_hash", *rest]
    (many,) = heavy_keys(ledger, [*chain, "sequence_number", "event_hash"], rows_per_slice=copies)
    if many.slices:
        # Identical rows cannot be cut apart by range.
        rows = ledger.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
    else:
        rows = ledger.withColumn("copies", F.lit(1).cast("bigint"))
    parts = int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(rows.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    mine = F.struct(*chain, "event_hash", "sequence_number")
    inside = Window.partitionBy("__p").orderBy(*order)
    ends = placed.groupBy("__p").agg(F.max(F.struct(*order)).alias("__end"))
    ends = ends.select(
        F.col("__p"), F.lag(F.struct(*[F.col("__end")[c].alias(c) for c in (*chain, "event_hash", "sequence_number")]))
        .over(Window.orderBy("__p")).alias("__prior")
    )
    before = F.coalesce(F.lag(mine).over(inside), F.col("__prior"))
    same = F.lit(True)
    for c in chain:
        same = same & F.col(f"__before.{c}").eqNullSafe(F.col(c))
    return (
        placed.join(F.broadcast(ends), "__p")
        .withColumn("__before", before)
        .select(
            *cols,
            "copies",
            F.when(same, F.col("__before.event_hash")).alias("before_hash"),
            F.when(same, F.col("__before.sequence_number")).alias("before_seq"),
        )
    )


def broken_copies() -> Column:
    """How many of a row's copies break the chain; the second and later ones follow the row itself."""
    first = (F.col("prev_event_hash") != F.col("before_hash")).cast("bigint")
    again = (F.col("prev_event_hash") != F.col("event_hash")).cast("bigint")
    return F.coalesce(first, F.lit(0)) + (F.col("copies") - 1) * F.coalesce(again, F.lit(0))


def chain_breaks(links: DataFrame, by: str) -> DataFrame:
    """Broken links per group."""
    return links.groupBy(by).agg(F.sum(broken_copies()).alias("chain_breaks"))


def integrity_rows(links: DataFrame) -> DataFrame:
    """Rows whose link or sequence is wrong, with the kind of fault.

    GENESIS rows are exempt from the hash test when filtering, not when labelling.
    """
    first = F.struct(
        F.col("before_hash").alias("h"), F.col("before_seq").alias("s"),
        F.lit(1).cast("bigint").alias("n"),
    )
    again = F.struct(
        F.col("event_hash").alias("h"), F.col("sequence_number").alias("s"),
        (F.col("copies") - 1).alias("n"),
    )
    seen = links.withColumn("at", F.explode(F.array(first, again))).where("at.n > 0")
    torn = F.col("prev_event_hash") != F.col("at.h")
    gap = F.col("sequence_number") != F.col("at.s") + 1
    faults = seen.where((torn & (F.col("prev_event_hash") != "GENESIS")) | gap).select(
        "ledger_event_id",
        "sequence_number",
        "prev_event_hash",
        F.col("at.h").alias("prev_computed_hash"),
        F.when(torn, "HASH_CHAIN_BREAK").when(gap, "SEQUENCE_GAP").otherwise("OK").alias(
            "integrity_status"
        ),
        F.col("at.n").alias("__n"),
    )
    return repeat_rows(faults, "__n")

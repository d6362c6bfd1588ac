"""Weighted rendezvous hashing: which shard a record belongs to, by its key alone.

Every shard draws a number from the record's key, ``w / -ln(u)`` with ``u``
uniform from the MD5 of key and shard, and the largest draw wins. The winner
depends on no other record. A shard that is added can only win records for
itself, a shard that is removed loses only its own, and a shard's expected
share is its weight's. No shuffle is needed.

A null key is a key of its own. Equal keys share a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3
CHUNK = 100_000


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13)
    # 52 bits and a half, so u is never 0 or 1.
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return weight / -F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, numbered by position in ``weights``, that wins ``key`` (text)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    w = F.array(*[F.lit(float(x)) for x in weights])
    draws = F.transform(
        w, lambda x, i: F.struct(_draw(key, i, x).alias("draw"), (-i).alias("shard"))
    )
    return (-F.array_max(draws)["shard"]).cast("int")


def sharded(df: DataFrame, key: str, shards: int | Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row in ``out`` (replaced if it is there).

    ``shards`` is a number of equal shards, or their weights.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    return df.withColumn(out, shard_of(key_text(key), weights))


def shard_plan(
    docs: DataFrame,
    shards: int | Sequence[float],
    id: str = "doc_id",
    text: str = "text",
    added: float = 1.0,
    digits: int = DIGITS,
) -> DataFrame:
    """A row per row of ``docs``: where it goes, its place there, and where it
    would go with one more shard of weight ``added``.

    Columns: id, size, text_crc32, law, shard, slot, grown_shard. Slots are
    gapless from 0 in each shard. To number them, a shard is cut into
    16^``digits`` pieces by a hash; pieces are numbered on their own and start
    where the pieces before them end. Identical rows are counted together, so a
    row repeated without bound is one row in the shuffle.

    A null text has no bytes (size 16, crc32 0). Only id and text are read.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    n = len(weights)
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = (
        docs.select(
            F.col(id).alias("id"),
            (F.octet_length(bytes_) + 16).cast("bigint").alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
        )
        .groupBy("id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    key = key_text("id")
    draw = _draw(key, F.lit(n), F.lit(float(added)))
    rows = rows.withColumn("shard", shard_of(key, weights)).withColumn(
        "piece",
        F.substring(F.md5(F.concat_ws(":", key, "size", "text_crc32")), 1, digits),
    )
    own = _draw(key, F.col("shard"), F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("shard") + 1))
    rows = rows.withColumn("grown_shard", F.when(draw > own, n).otherwise(F.col("shard")))
    piece = Window.partitionBy("shard", "piece").orderBy("id", "size", "text_crc32")
    rows = rows.withColumn(
        "before", F.coalesce(F.sum("copies").over(piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    sums = rows.groupBy("shard", "piece").agg(F.sum("copies").alias("n"))
    pieces = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "piece", F.coalesce(F.sum("n").over(pieces), F.lit(0)).alias("start"))
    # At most shards x 16^digits rows, whatever the input.
    placed = rows.join(F.broadcast(starts), ["shard", "piece"]).withColumn(
        "slot", (F.col("start") + F.col("before")).cast("bigint")
    )
    columns = ["id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    few = placed.where(f"copies <= {CHUNK}").select(*columns, "copies")
    many = (
        placed.where(f"copies > {CHUNK}")
        .withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {CHUNK}"))))
        .withColumn("slot", F.col("slot") + F.col("c") * CHUNK)
        .withColumn("copies", F.least(F.lit(CHUNK), F.col("copies") - F.col("c") * CHUNK))
        .repartition("shard", "slot")
        .select(*columns, "copies")
    )
    return (
        few.unionByName(many)
        .withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("copies") - 1)))
        .select(
            F.col("id").alias(id),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            "slot",
            F.col("grown_shard").cast("int").alias("grown_shard"),
        )
    )

"""Exact deduplication in two passes over a Bloom filter, with built-in functions only.

Pass one hashes every text to two cells of a bit table and counts, before and
after the shuffle, how many rows fall into each cell. A cell that two or more
rows hit is a set bit. Pass two tests every row against the set bits: a text
whose two cells are not both set occurs once, for certain, and its row passes
straight through; only the other rows are shuffled and grouped by SHA-256. A
false positive costs a shuffled row, never a wrong answer.

The table has sixteen cells a row, rounded up to a power of two, and at most
``max_bits`` (8 MB at the default): beyond a few million rows false positives
grow, up to the point where every row is shuffled, which is what a plain
``groupBy`` would do.

Nulls count as empty texts. A null id is the smallest. Rows that agree in id and
text are the same document listed several times: all are returned, one is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 16, 1 << 26
CHUNK = 100_000


def _cells(h: Column, bits: int) -> list[Column]:
    return [h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)]


def _size(df: DataFrame, max_bits: int) -> int:
    """Runs one job to count the rows, which for Parquet reads footers only."""
    return min(max(MIN_BITS, 1 << (16 * max(df.count(), 1) - 1).bit_length()), max_bits)


def _table(set_bits: DataFrame, bits: int) -> DataFrame:
    """One row ``words``: the bit table of the cells in ``set_bits`` as an array of longs."""
    words = set_bits.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits")
    )
    every = set_bits.sparkSession.range(bits // 64).select(F.col("id").alias("word"))
    dense = every.join(words, "word", "left").select(
        F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("w")
    )
    return dense.agg(F.sort_array(F.collect_list("w"))["bits"].alias("words"))


def _hits(df: DataFrame, h: Column, bits: int) -> DataFrame:
    # Both cells of one hash may be the same; then the row hits it once.
    return df.select(F.array(*_cells(h, bits)).alias("c")).select(F.explode(F.array_distinct("c")).alias("cell"))


def key_filter(df: DataFrame, h: Column, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """A Bloom filter of the hashes ``h`` of ``df``, as one row ``words``, and its size in bits."""
    bits = _size(df, max_bits)
    return _table(_hits(df, h, bits).distinct(), bits), bits


def in_filter(h: Column, words: Column, bits: int) -> Column:
    """Whether both cells of the hash are set."""
    one, two = (
        F.getbit(F.get(words, F.shiftright(c, 6).cast("int")), c.bitwiseAND(63).cast("int")) for c in _cells(h, bits)
    )
    return (one == 1) & (two == 1)


def repeat_filter(docs: DataFrame, text: str = "text", max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """As ``key_filter``, of the cells that two or more rows hit."""
    bits = _size(docs, max_bits)
    hits = _hits(docs, F.xxhash64(F.coalesce(F.col(text), F.lit(""))), bits)
    return _table(hits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), bits), bits


def possibly_repeated(text: Column, words: Column, bits: int) -> Column:
    return in_filter(F.xxhash64(F.coalesce(text, F.lit(""))), words, bits)


def _digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _split(docs: DataFrame, text: str, max_bits: int) -> tuple[DataFrame, DataFrame]:
    words, bits = repeat_filter(docs, text, max_bits)
    maybe = possibly_repeated(F.col(text), words.scalar(), bits)
    return docs.where(~maybe), docs.where(maybe)


def mark_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Only the id and the text are read; other columns, whatever their names, are
    not. An empty table gives an empty one.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    once, maybe = _split(docs, "text", max_bits)
    straight = once.select(
        "id",
        F.col("id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        _digest("text").alias("text_sha256"),
    )
    listed = (
        maybe.select("id", F.unhex(_digest("text")).alias("sha"))
        .groupBy("sha", "id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    groups = listed.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    # The side with one row per text is the other one, so a hot text can be split.
    joined = listed.join(groups, "sha")
    chunks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {CHUNK}"))
    copies = (
        joined.withColumn("c", F.explode(chunks))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(CHUNK), F.col("n") - F.col("c") * CHUNK) - 1)))
        .select(
            "id",
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("c") + F.col("i") == 0)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
    return straight.unionByName(copies).withColumnRenamed("id", id)


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows with equal texts that with the largest id stays; of those alike in
    id too, the one whose other columns come last in order. Columns must be
    orderable (no maps). Rows are combined before the shuffle, so of a hot text
    each task sends one row.
    """
    once, maybe = _split(docs, text, max_bits)
    rest = [c for c in docs.columns if c not in (id, text)]
    row = F.struct(F.col(id), *rest, F.coalesce(F.col(text), F.lit("")).alias("__key"), F.col(text))
    best = maybe.groupBy(F.unhex(_digest(text)).alias("__sha")).agg(F.max(row).alias("__row"))
    return once.unionByName(best.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))

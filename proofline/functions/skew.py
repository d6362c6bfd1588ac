"""Equi-joins that stay balanced when one key holds a large share of the rows.

Heavy keys are measured first, with a frequent-items sketch (``approx_top_k``):
one pass over the key columns without a shuffle, for several key sets at once.
It reports every key above a small share of its table. At most ``MAX_HOT`` keys
per side are kept, so the list fits in any broadcast however large the inputs
are, and a key that is not on it holds less than a thousandth or so of its side.

Without heavy keys the join is an ordinary one. Otherwise a heavy row goes to
one slice of its own side and is repeated for every slice of the other side, so
each pair of rows meets exactly once; rows with a null key match nothing and
are spread. Which keys the sketch names decides only where rows are sent,
never the result.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT = 1000
TRACKED = 10_000
ROWS_PER_SLICE = 1_000_000
MAX_SLICES = 4096
# Key lists up to this many rows are broadcast, after counting them.
KEY_LIST_ROWS = 200_000


class Heavy(NamedTuple):
    """Slices per heavy key hash, and whether null keys are many."""

    slices: dict[int, int]
    nulls: bool

    def __bool__(self) -> bool:
        return bool(self.slices) or self.nulls


NOTHING = Heavy({}, False)


def with_nulls(heavy: Heavy) -> Heavy:
    """For keys that come from the right of an earlier left join: null keys may be many."""
    return heavy._replace(nulls=True)


def _any_null(on: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])


def heavy_keys(
    df: DataFrame, *key_sets: list[str], rows_per_slice: int | None = None
) -> list[Heavy]:
    """Measure the heavy keys of each key set in one pass. Runs a job."""
    limit = rows_per_slice or ROWS_PER_SLICE
    sketches = []
    for i, on in enumerate(key_sets):
        keys = ", ".join(f"`{k}`" for k in on)
        sketches.append(F.expr(f"approx_top_k(xxhash64({keys}), {MAX_HOT}, {TRACKED})").alias(f"t{i}"))
        sketches.append(F.count_if(_any_null(on)).alias(f"n{i}"))
    row = df.agg(*sketches).first()
    return [
        Heavy(
            {
                t["item"]: min(-(-t["count"] // limit), MAX_SLICES)
                for t in row[f"t{i}"]
                if t["item"] is not None and t["count"] > limit
            },
            row[f"n{i}"] > limit,
        )
        for i in range(len(key_sets))
    ]


def _table(df: DataFrame, heavy: Heavy, out: str) -> DataFrame:
    rows = pa.table(
        {
            "__h": pa.array(list(heavy.slices), pa.int64()),
            out: pa.array(list(heavy.slices.values()), pa.int32()),
        }
    )
    return F.broadcast(df.sparkSession.createDataFrame(rows))


LEFT_ROW, RIGHT_ROW = "__lrow", "__rrow"


def numbered(df: DataFrame, column: str = LEFT_ROW) -> DataFrame:
    """Number the rows of a stored table, so that identical copies can be spread.

    Only for tables read directly, perhaps filtered: the number follows the
    order of rows in a partition, which is fixed there but not after a shuffle.
    """
    return df.withColumn(column, F.monotonically_increasing_id())


def _spread(df: DataFrame, row: str, slices: Column) -> Column:
    # By content, so a task run again after a lost executor sends every row to
    # the same slice whatever order its input comes in.
    columns = [row] if row in df.columns else df.columns
    return F.pmod(F.xxhash64(*columns), slices).cast("int")


def _every(slices: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(slices, F.lit(1)) - 1))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    left_heavy: Heavy | None = None,
    right_heavy: Heavy | None = None,
) -> DataFrame:
    """Join on same-named columns; ``how`` is inner, left or left_anti.

    Heavy keys not given are measured. For a computed left side, pass what was
    measured on the table its keys come from, so it is not computed twice; for
    a right side that has each key once, pass ``NOTHING``. The sides may share
    no other column names. Where copies of a row may be many, pass sides that
    are ``numbered``; the left number stays for later joins.
    """
    if how not in ("inner", "left", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if how == "left_anti":
        right, right_heavy = right.select(*on).distinct(), NOTHING
    shared = (set(left.columns) & set(right.columns)) - set(on)
    if shared:
        raise ValueError(f"ambiguous columns {sorted(shared)}")
    if left_heavy is None:
        (left_heavy,) = heavy_keys(left, on)
    if right_heavy is None:
        (right_heavy,) = heavy_keys(right, on)
    if how == "inner":
        left = left.dropna(subset=on)
    if not left_heavy and not right_heavy.slices:
        return left.join(right, on, how).drop(RIGHT_ROW)

    hash_ = F.xxhash64(*on)
    hot_left = _table(left, left_heavy, "__ls")
    l = left.withColumn("__h", hash_).join(hot_left, "__h", "left")
    r = right.dropna(subset=on).withColumn("__h", hash_).join(hot_left, "__h", "left")
    l = l.withColumn(
        "__i",
        F.when(_any_null(on), _spread(left, LEFT_ROW, F.lit(MAX_SLICES)))
        .when(F.col("__ls").isNotNull(), _spread(left, LEFT_ROW, F.col("__ls")))
        .otherwise(0),
    )
    r = r.withColumn("__i", _every(F.col("__ls"))).drop("__ls")
    slot = [*on, "__i"]
    if right_heavy.slices:
        # The keys themselves, not their hashes: a left row may be treated as
        # sure to match only if its key is on the right.
        hot_right = F.broadcast(
            right.dropna(subset=on)
            .withColumn("__h", hash_)
            .join(_table(right, right_heavy, "__rs"), "__h")
            .select(*on, "__rs")
            .distinct()
        )
        l = l.join(hot_right, on, "left").withColumn("__j", _every(F.col("__rs")))
        r = (
            r.join(hot_right, on, "left")
            .withColumn(
                "__j",
                F.when(
                    F.col("__rs").isNotNull(), _spread(right, RIGHT_ROW, F.col("__rs"))
                ).otherwise(0),
            )
            .drop("__rs")
        )
        slot.append("__j")
    r = r.drop("__h")
    if how == "left_anti":
        return l.join(r, slot, how).select(*left.columns)
    joined = l.join(r.withColumn("__found", F.lit(True)), slot, how)
    if right_heavy.slices and how == "left":
        # Copies of a row that met an empty slice of its heavy key are dropped.
        joined = joined.where(F.col("__found").isNotNull() | F.col("__rs").isNull())
    return joined.select(*left.columns, *[c for c in right.columns if c not in (*on, RIGHT_ROW)])


def is_short(keys: DataFrame) -> bool:
    """Whether a key list is within the broadcast bound. Runs a job."""
    return keys.limit(KEY_LIST_ROWS + 1).count() <= KEY_LIST_ROWS


def settled(df: DataFrame) -> DataFrame:
    """A small frame that many plans read, stored once in the checkpoint folder.

    Without a checkpoint folder it is left to be computed where it is used.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def prefilter(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Drop rows whose key is not in ``keys``, if the list is short enough to broadcast.

    For inputs of an operator that would drop them anyway: a longer list leaves
    ``df`` as it is, and the operator does the work.
    """
    keys = keys.select(*on).distinct()
    return df.join(F.broadcast(keys), on, "left_semi") if is_short(keys) else df


def keep_matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a stored table whose key is in ``keys``: by broadcast if the list
    is short, else by shuffle."""
    keys = keys.select(*on).dropna().distinct()
    if is_short(keys):
        return df.join(F.broadcast(keys), on, "left_semi")
    matched = skew_join(numbered(df), keys, on, "inner", right_heavy=NOTHING)
    return matched.select(*df.columns)


def repeat_rows(df: DataFrame, times: str, chunk: int = 1_000_000) -> DataFrame:
    """Each row ``times`` times, in chunks so that no array grows with the number."""
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / chunk))
    return (
        df.withColumn("__k", F.explode(chunks))
        .withColumn("__m", F.least(F.lit(chunk), F.col(times) - F.col("__k") * chunk))
        .withColumn("__r", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__m"))))
        .drop("__k", "__m", "__r", times)
    )

"""A bounded sample of the keys behind a count, taken in the pass that counts.

A reference is text, ``kind/key`` or ``kind/key/key``. The sample keeps, of each of
``SLOTS`` slots that references are hashed to, the one of the lowest hash. So it is a
few minima: partial results merge, it does not depend on how rows are dealt out, and
of few offending keys most are in it. Hashes are md5, which any SQL engine has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 5


def reference(kind: str, *keys: Column | str) -> Column:
    """``kind/key...``; a null key is empty text."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.concat_ws("/", F.lit(kind), *parts)


def sampled(hit: Column, ref: Column) -> Column:
    """Aggregate: the sampled references of the rows where ``hit`` holds, in order of their hashes."""
    ref = F.when(hit, ref)  # nullable, as the samples of other counts it is stacked with
    h = F.md5(ref.cast("binary"))
    slot = F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % SLOTS
    least = [F.min(F.when(slot == i, F.struct(h.alias("h"), ref.alias("ref")))) for i in range(SLOTS)]
    found = F.transform(F.array_sort(F.array_compact(F.array(*least))), lambda x: x["ref"])
    # An empty set beside the minima: a grouping with a set keeps its rows as objects, so
    # that minima of text are hashed by group instead of sorted by it.
    return F.slice(found, F.lit(1), SLOTS + F.size(F.collect_set(F.lit(None).cast("int"))))

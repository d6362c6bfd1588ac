"""The distributed helpers against brute force, with hot keys and copies."""

import random
from collections import Counter
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofline.functions.exprs import pct
from proofline.functions.quantiles import exact_quantiles
from proofline.functions.running import running
from proofline.functions.skew import heavy_keys, repeat_rows, skew_join
from proofline.operators.ledger import chain_breaks, integrity_rows, linked


def table(spark, **columns):
    return spark.createDataFrame(pa.table(columns))


def keyed(spark, n, hot_share, seed, name):
    rng = random.Random(seed)
    keys = [
        "hot" if rng.random() < hot_share else rng.choice([None, *map(str, range(12))])
        for _ in range(n)
    ]
    return keys, table(spark, k=pa.array(keys, pa.string()), **{name: list(range(n))})


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("hot_left,hot_right", [(0.5, 0.0), (0.0, 0.5), (0.5, 0.4), (0.0, 0.0)])
def test_skew_join_equals_a_plain_join(spark, how, hot_left, hot_right):
    lk, left = keyed(spark, 300, hot_left, 1, "a")
    rk, right = keyed(spark, 80, hot_right, 2, "b")
    (lh,) = heavy_keys(left, ["k"], rows_per_slice=20)
    (rh,) = heavy_keys(right, ["k"], rows_per_slice=20)
    assert bool(lh.slices) == (hot_left > 0 or lh.nulls) or lh.slices
    assert bool(rh.slices) or hot_right == 0
    args = (lh, rh) if how != "left_anti" else (lh,)
    got = Counter(
        tuple(r) for r in skew_join(left, right, ["k"], how, *args).collect()
    )
    pairs = [
        (k, a, b) for (a, k), (b, j) in product(enumerate(lk), enumerate(rk))
        if k is not None and k == j
    ]
    alone = [(k, a) for a, k in enumerate(lk) if k is None or k not in rk]
    want = {
        "inner": pairs,
        "left": pairs + [(k, a, None) for k, a in alone],
        "left_anti": alone,
    }[how]
    assert got == Counter(want)


def test_skew_join_spreads_a_hot_key_over_tasks(spark):
    left = spark.range(5000).select(F.lit("x").alias("k"), F.col("id").alias("a"))
    right = table(spark, k=["x"], b=[1])
    (heavy,) = heavy_keys(left, ["k"], rows_per_slice=100)
    assert list(heavy.slices.values()) == [50]
    assert skew_join(left, right, ["k"], "left", heavy).where("b = 1").count() == 5000


def test_skew_join_refuses_ambiguous_columns(spark):
    t = table(spark, k=["x"], a=[1])
    with pytest.raises(ValueError):
        skew_join(t, t, ["k"], "left")
    with pytest.raises(ValueError):
        skew_join(t, t, ["k"], "full")


def test_repeat_rows_in_chunks(spark):
    t = table(spark, k=["x", "y"], n=pa.array([7, 1], pa.int64()))
    assert Counter(r.k for r in repeat_rows(t, "n", chunk=3).collect()) == {"x": 7, "y": 1}


@pytest.mark.parametrize("agg", ["sum", "max"])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_equals_brute_force(spark, agg, width):
    rng = random.Random(3)
    rows = [
        (rng.choice(["hot", "hot", "b", None]), rng.randrange(60), rng.randrange(2), i)
        for i in range(200)
    ]
    df = table(
        spark, k=pa.array([r[0] for r in rows], pa.string()), s=[r[1] for r in rows],
        side=[r[2] for r in rows], v=[r[3] for r in rows],
    ).withColumn("time", F.timestamp_add("SECOND", F.col("s"), F.lit("2024-01-01").cast("timestamp_ntz")))
    value = F.when(F.col("side") == 0, F.col("v"))
    got = {
        r.v: r.out
        for r in running(df, ["k"], "time", value, agg, "out", "side", width * 1_000_000).collect()
    }
    for k, s, side, v in rows:
        if k is None:
            assert v not in got
            continue
        seen = [
            w for j, t, kind, w in rows if j == k and kind == 0 and (t, kind) <= (s, side)
        ]
        want = sum(seen) if agg == "sum" else max(seen, default=None)
        assert got[v] == want


def chain_rows(seed, copies):
    rng = random.Random(seed)
    rows, seq, prev = [], 0, "GENESIS"
    for i in range(120):
        seq += rng.choice([1, 1, 1, 2, 40])
        own = rng.choice([f"e{i}", f"e{i}", f"e{i}", None])
        back = rng.choice([prev, prev, prev, "bad", None])
        rows.append(("t", f"id{i:03}", seq, own, back))
        prev = own
    if copies:
        rows += [rows[50]] * 90  # one row copied often
        rows += [("t", f"dup{i:03}", rows[70][2], f"x{i:03}", "bad") for i in range(60)]
    return rows


def brute(rows):
    """Predecessor by (sequence, hash, id, previous), nulls first."""
    def key(r):
        return (r[2], (r[3] is not None, r[3] or ""), (r[1] is not None, r[1]),
                (r[4] is not None, r[4] or ""))

    out, before = [], None
    for r in sorted(rows, key=key):
        out.append((r, before))
        before = r
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
@pytest.mark.parametrize("copies", [False, True])
def test_chain_in_ranges_equals_a_global_order(spark, ranges, copies):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        check_chain(spark, copies)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def check_chain(spark, copies):
    rows = chain_rows(5, copies)
    names = ("tenant_id", "ledger_event_id", "sequence_number", "event_hash", "prev_event_hash")
    df = table(spark, **{n: [r[i] for r in rows] for i, n in enumerate(names)})
    links = linked(df, ["tenant_id"], copies=1 if copies else 100_000)
    truth = brute(rows)
    broken = sum(
        1 for r, b in truth if b and b[3] is not None and r[4] is not None and r[4] != b[3]
    )
    assert chain_breaks(links, "tenant_id").first()["chain_breaks"] == broken
    want = Counter()
    for r, b in truth:
        if b is None:
            continue
        torn = r[4] is not None and b[3] is not None and r[4] != b[3]
        gap = r[2] != b[2] + 1
        if (torn and r[4] != "GENESIS") or gap:
            want[(r[1], r[2], r[4], b[3], "HASH_CHAIN_BREAK" if torn else "SEQUENCE_GAP")] += 1
    assert Counter(tuple(r) for r in integrity_rows(links).collect()) == want


def test_ranges_are_even_however_few_sequence_numbers_there_are(spark, monkeypatch):
    """Forty sinks share each number, and a third of the rows have none."""
    from proofline.operators import ledger

    seen = {}
    monkeypatch.setattr(ledger, "settled", lambda df: seen.setdefault("placed", df))
    rows = spark.range(40_000).selectExpr(
        "'t' as tenant_id", "if(id % 3 = 0, null, id div 4000) as sequence_number",
        "sha2(string(id), 256) as event_hash", "'x' as prev_event_hash", "id as ledger_event_id",
    )
    assert linked(rows, ["tenant_id"]).count() == 40_000
    sizes = [r["count"] for r in seen["placed"].groupBy("__p").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * 40_000 / len(sizes)


def test_exact_quantiles(spark):
    rng = random.Random(9)
    values = [(g, rng.choice([rng.random(), 0.5])) for g in "aab" for _ in range(400)]
    values.append(("c", 0.25))
    df = table(spark, g=[g for g, _ in values], v=[v for _, v in values])
    probs = {"p50": 0.5, "p99": 0.99}
    got = {r.g: (r.p50, r.p99) for r in exact_quantiles(df, "g", "v", probs, per_unit=16).collect()}
    df.createOrReplaceTempView("quantile_rows")
    want = spark.sql(
        "SELECT g, percentile_disc(0.5) WITHIN GROUP (ORDER BY v) a,"
        " percentile_disc(0.99) WITHIN GROUP (ORDER BY v) b FROM quantile_rows GROUP BY g"
    )
    assert got == {r.g: (r.a, r.b) for r in want.collect()}


def test_pct_of_nothing_is_all(spark):
    row = table(spark, a=[0, 1], b=[0, 3]).select(pct(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in row] == [100.0, 33.33]

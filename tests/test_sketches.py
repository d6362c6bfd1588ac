"""Distributions from stored sketches, and exact quantiles by selection."""

import random

import pytest
from pyspark.sql import functions as F

from proofline.functions import quantiles as qs
from proofline.operators import sketches as sk
from proofline.operators.correlate import risk_distribution
from proofline.sources.catalog import EvidenceCatalog

PROBS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def decisions(spark, n=40_000):
    day = F.expr("timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(cast(id % 20 as int), cast(id % 24 as int))")
    return spark.range(n).select(
        day.alias("time"), F.concat(F.lit("t"), F.col("id") % 3).alias("tenant_id"), F.lit("prod").alias("environment"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("tool_category"),
        F.when(F.col("id") % 50 == 7, F.lit(float("nan"))).when(F.col("id") % 50 != 8, F.pmod(F.hash("id"), F.lit(10_007)) / 10_007)
        .alias("orm_risk_score"),
    )


@pytest.fixture
def stored(spark, tmp_path):
    rows = decisions(spark)
    rows.write.parquet(str(tmp_path / "rows"))
    cat = EvidenceCatalog(spark, {"policy_decisions": spark.read.parquet(str(tmp_path / "rows"))})
    return cat, sk.store_sketches(cat, str(tmp_path / "sketches"), "2024-02-01", "2024-03-01"), tmp_path


def test_any_window_is_answered_from_sketches_alone(spark, stored):
    cat, kept, _ = stored
    number = F.when(~F.isnan("orm_risk_score"), F.col("orm_risk_score"))  # the exact form has NaN as the highest score
    clean = EvidenceCatalog(spark, {"policy_decisions": cat["policy_decisions"].withColumn("orm_risk_score", number)})
    for as_of, days in (("2024-02-21", 20), ("2024-02-11", 3)):
        window = sk.risk_window(kept, as_of, days)
        plan = window._jdf.queryExecution().executedPlan().toString()
        assert all("/sketches/day=" in f for f in window.inputFiles()) and "PartitionFilters: [isnotnull(day" in plan
        exact = {r.tool_category: r for r in risk_distribution(clean, as_of, days, exact=True).collect()}
        got = {r.tool_category: r for r in window.collect()}
        assert got.keys() == exact.keys() and None in got and len(got) >= 3
        for c, r in got.items():
            assert r.total_decisions == exact[c].total_decisions
            assert abs(r.p90 - exact[c].p90) < 0.02 and r.p50 < r.p90 < r.p95 < r.p99
        errors = sk.rank_errors(cat["policy_decisions"], window, as_of, days).collect()
        assert len(errors) == 4 * len(got) and max(r.rank_error for r in errors) <= sk.RANK_ERROR


def test_days_are_replaced_one_by_one(spark, stored):
    cat, kept, folder = stored
    before = {tuple(r) for r in sk.risk_window(kept, "2024-02-21", 20, by=("tenant_id",)).drop(*sk.QUANTILES).collect()}
    again = sk.store_sketches(cat, str(folder / "sketches"), "2024-02-05", "2024-02-06")
    assert {tuple(r) for r in sk.risk_window(again, "2024-02-21", 20, by=("tenant_id",)).drop(*sk.QUANTILES).collect()} == before
    assert again.select("day").distinct().count() == 20
    with pytest.raises(ValueError, match="midnight"):
        sk.risk_window(kept, "2024-02-11T10:00:00Z")


def test_no_scores_have_no_quantiles(spark, tmp_path):
    rows = decisions(spark, 200).withColumn("orm_risk_score", F.lit(None).cast("double"))
    cat = EvidenceCatalog(spark, {"policy_decisions": rows})
    kept = sk.store_sketches(cat, str(tmp_path / "s"), "2024-02-01", "2024-03-01")
    got = sk.risk_window(kept, "2024-02-21", 20).collect()
    assert got and all(r.p50 is None and r.avg_orm_score is None and r.total_decisions for r in got)


def plain(values, p):
    values = sorted(values)
    return values[max(1, -(-len(values) * int(p * 100) // 100)) - 1]


def test_selection_in_rounds_equals_sorting(spark):
    rng = random.Random(3)
    groups = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(4000)],
        "one bin": [0.5 + rng.random() * 1e-9 for _ in range(4000)],
        "copies": [1.0] * 3000 + [rng.random() for _ in range(900)],
        "single": [3.5],
        None: [rng.random() for _ in range(50)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for bound in (7, 100_000):
        got = {r.g: r for r in qs.selected_quantiles(df, "g", "v", PROBS, bound).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            assert [got[g][n] for n in PROBS] == [plain(vs, p) for p in PROBS.values()], (g, bound)


def test_a_million_values_in_a_hair(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.col("id") * 1e-15 + 0.25).alias("v"))
    got = qs.selected_quantiles(df, "g", "v", {"p50": 0.5}, bound=5000).first()
    assert got.p50 == 499_999 * 1e-15 + 0.25

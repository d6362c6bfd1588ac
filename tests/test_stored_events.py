"""Assessments over derived evidence take the events' JSON apart once."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

from proofline.plans import registry
from proofline.sources.derived import derived_catalog


def _tables(folder):
    n = 60
    kinds = ["view", "click", "purchase", "signup", "error", None]
    start = dt.datetime(2024, 1, 5)
    events = {
        "event_id": list(range(n)), "ts": [start + dt.timedelta(hours=7 * i) if i % 13 else None for i in range(n)],
        "user_id": [i % 7 if i % 11 else None for i in range(n)], "event_type": [kinds[i % 6] for i in range(n)],
        "value": [float(i) for i in range(n)],
        "props": [f'{{"k": {i % 100}}}' if i % 9 else (None if i % 2 else "no json") for i in range(n)],
    }
    keys = list(range(8))
    small = {
        "events": events, "customer": {"c_custkey": keys}, "supplier": {"s_suppkey": keys},
        "nation": {"n_nationkey": keys, "n_name": [f"n{k}" for k in keys]}, "region": {"r_regionkey": keys},
    }
    for name, columns in small.items():
        pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


def test_views_over_stored_events_are_the_same(spark, tmp_path):
    _tables(tmp_path)
    plain = derived_catalog(spark, str(tmp_path))
    kept = derived_catalog(spark, str(tmp_path), str(tmp_path / "kept"))
    for name in ("tool_requests", "policy_decisions", "ledger_events", "hitl_decisions", "c04_inventory"):
        assert kept[name].dtypes == plain[name].dtypes
        assert sorted(map(str, kept[name].collect())) == sorted(map(str, plain[name].collect()))


def test_the_assessments_plan_holds_no_json_of_events(spark, tmp_path):
    _tables(tmp_path)
    results = registry._results(spark, str(tmp_path))
    assert "$.k" not in results._jdf.queryExecution().optimizedPlan().toString()
    assert results.count() == 171

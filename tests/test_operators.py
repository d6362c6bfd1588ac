"""Catalog, report, correlation, runbook and streaming operators on small evidence."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from proofline.operators import correlate as c
from proofline.operators import runbooks as d
from proofline.plans.report import build_report, metric_rollup, write_report
from proofline.plans.runner import run_assessments
from proofline.sources.catalog import EvidenceCatalog, MissingTable, normalise
from tests.conftest import NOW, frame, good_rows

SF = "/root/testdata/sf0.001"


def test_nested_stores_are_flattened(spark):
    ledger = spark.sql(
        "SELECT 't' tenant_id, 'prod' environment, '2024-01-01T00:00:00Z' time, 5 sequence_number,"
        " named_struct('event_hash', 'e', 'prev_event_hash', 'p') hash_chain,"
        " named_struct('sink_uri', 'u') immutability,"
        " named_struct('policy_decision_id', 'd') references"
    )
    row = normalise(ledger, "ledger_events").first()
    assert (row.event_hash, row.prev_event_hash, row.sink_uri) == ("e", "p", "u")
    assert row.policy_decision_id == "d" and row.time.year == 2024
    drift = spark.sql("""SELECT '{"agent_instance_id": "a9"}' payload, 'x' dimension""")
    assert normalise(drift, "drift_decisions").first().agent_instance_id == "a9"


def test_time_spellings_mean_the_same(spark):
    t = spark.sql("SELECT * FROM VALUES ('2024-01-01T10:00:00Z'), ('2024-01-01 10:00:00') t(time)")
    assert normalise(t, "budget_events").distinct().count() == 1


def test_catalog_sources(spark, tmp_path, good):
    good["budget_events"].write.parquet(f"{tmp_path}/spend")
    cat = EvidenceCatalog.from_directory(spark, str(tmp_path), overrides={"budget_events": "spend"})
    assert cat["budget_events"].count() == 3
    good["baselines"].createOrReplaceTempView("store_baselines")
    assert EvidenceCatalog.from_tables(spark, "store_")["baselines"].count() == 1
    with pytest.raises(MissingTable):
        good.without("abom")["abom"]
    with pytest.raises(ValueError):
        EvidenceCatalog(spark, {"nonsense": "x"})


def test_filters_reach_the_scan(spark, tmp_path, good, scope):
    good["tool_requests"].write.parquet(f"{tmp_path}/tool_requests")
    cat = EvidenceCatalog.from_directory(spark, str(tmp_path))
    plan = scope("bounded").scope(cat["tool_requests"]).groupBy("assessment_id").count()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time" in text and "tool_name" not in text
    assert "BroadcastHashJoin" in text


def test_report(good, scope, tmp_path):
    who = scope("high_privilege")
    results = run_assessments(good, who).cache()
    (r,) = build_report(results, who, NOW).collect()
    assert [k.check_id for k in r.checks] == [f"Check{i:02}" for i in range(1, 20)]
    assert r.summary.overall_status == "PARTIAL" and not r.run_failed
    assert r.summary.counts.PASS == 9 and r.summary.open_partial_checks == 10
    # Two checks report reads under one name; the roll-up adds them.
    assert r.metrics["count_memory_reads"] == 10
    assert all(k.startswith("count_") for k in r.metrics)
    assert metric_rollup(results).where("metric = 'threshold_min_pct'").count() == 0
    write_report(build_report(results, who, NOW), str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("*.json"))
    doc = json.loads(files[0].read_text().splitlines()[0])
    assert "manual_steps" not in doc["checks"][0] and "error" not in doc["checks"][0]
    assert doc["tenant_id"] == "acme"
    with pytest.raises(ValueError):
        write_report(build_report(results, who, NOW), str(tmp_path / "x"), "yaml")


def test_report_of_a_subset_and_of_failures(changed, good, scope):
    who = scope("bounded")
    ok = build_report(run_assessments(good, who, ["Check01", "Check03"]), who, NOW).first()
    assert ok.summary.overall_status == "CONFORMANT" and len(ok.checks) == 2
    bad = changed("tool_requests", lambda rows: rows[0].update(identity_verified=0))
    got = build_report(run_assessments(bad, who, ["Check01", "Check03"]), who, NOW).first()
    assert got.summary.overall_status == "NON_CONFORMANT" and got.run_failed
    assert got.summary.must_pass_checks_failing == 1


def test_unmatched_rows_are_repeated_per_void_decision(changed):
    def void(rows):
        rows[0].update(decision_id=None)
        rows.append({**rows[0]})

    rows = c.unmatched_requests(changed("policy_decisions", void), NOW).collect()
    assert [r.request_hash for r in rows] == ["h1", "h1"]


def test_quarantine_review_keeps_open_and_late(good):
    rows = c.quarantine_review(good, max_hours=24).collect()
    assert len(rows) == 1 and rows[0].hours_to_review is None


def test_unenrolled_by_either_identity(changed, spark):
    cat = changed("c04_inventory", lambda rows: rows[:1])
    excuse = [{**good_rows()["remediation_outcomes"][0], "outcome": "exception",
               "owner_identity": "agent-1", "workload_identity": "someone",
               "exception_ttl_expires_at": "2024-04-01T00:00:00Z"}]
    cat = cat.replaced(remediation_outcomes=frame(spark, "remediation_outcomes", excuse))
    assert c.unenrolled(cat, NOW, hours=24 * 30, match_on="owner_identity").count() == 0
    assert c.unenrolled(cat, NOW, hours=24 * 30).first().workload_identity == "agent-1"


def test_export_and_archive(good, tmp_path, spark):
    runs = spark.sql("SELECT * FROM VALUES ('run-1'), ('run-2'), (NULL) t(run_id)")
    cat = good.without("replay_traces", "breaker_events").replaced(
        replay_traces=spark.sql("SELECT 't1' trace_id, 'run-1' run_id, 'prod' environment"),
        breaker_events=spark.sql(
            "SELECT 'b' event_id, 'prod' environment, array('run-2', 'run-1') affected_run_ids"
        ),
    )
    got = {r.kind: r.n_rows for r in d.export_incident(cat, runs, str(tmp_path / "i")).collect()}
    assert got == {"policy_decisions": 2, "ledger_events": 2, "semantic_traces": 2,
                   "replay_traces": 1, "breaker_events": 1}
    rows = d.archive_agent(good, "agent-1", str(tmp_path / "a")).collect()
    assert all(r.intact for r in rows)
    assert {r.kind: r.n_rows for r in rows}["tool_requests"] == 3
    assert os.path.isdir(tmp_path / "a" / "tool_requests")


def test_replay_compare_sees_missing_changed_and_extra_steps(spark):
    def steps(values):
        return spark.sql(f"SELECT * FROM VALUES {values} t(run_id, step_index, request_hash, response_hash)")

    recorded = steps("('a', 1, 'q', 'r'), ('a', 2, 'q', NULL), ('b', 1, 'q', 'r'), ('c', 1, 'q', 'r')")
    replayed = steps("('a', 1, 'q', 'r'), ('a', 2, 'q', NULL), ('b', 1, 'q', 'X'), ('d', 1, 'q', 'r')")
    got = {r.run_id: r.replay_status for r in d.replay_compare(recorded, replayed).collect()}
    assert got == {"a": "PASS", "b": "FAIL", "c": "FAIL", "d": "FAIL"}
    row = d.replay_success(d.replay_compare(recorded, replayed)).first()
    assert (row.runs, row.runs_passed, row.met) == (4, 1, False)


# Every query beside its SQL twin would take minutes; these cover each kind of
# plan, and tools/compare.py runs them all.
SOME = [
    "q05_metrics", "q11_metrics", "q14_metrics", "verdicts", "e02_evidence_chain",
    "e03_ledger_integrity", "e15_cadence_gaps", "d09_containment", "d13_downstream_calls",
    "d16_chain_links", "s01_undecided_requests", "s03_ttl_alerts", "s05_drift_silence",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "customer", "nation", "region", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    from tools.compare import rows

    mine = entry.queries()[name](spark, SF).toArrow()
    assert rows(mine) == rows(duck.sql(entry.oracle_sql()[name]).to_arrow_table())


def test_every_query_has_a_twin():
    from proofline.plans.registry import batch_queries, stream_queries

    names = set(batch_queries()) | set(stream_queries())
    assert names <= set(entry.queries()) and names <= set(entry.oracle_sql())


def test_skewed_inputs_give_the_same_chain(spark, monkeypatch):
    from proofline.functions import skew
    from proofline.sources.derived import derived_catalog

    cat = derived_catalog(spark, SF)
    runs = cat["tool_requests"].select("run_id")
    plain = sorted(map(str, c.evidence_chain(cat, runs).collect()))
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 3)
    assert sorted(map(str, c.evidence_chain(cat, runs).collect())) == plain


def test_entry(spark):
    assert "request_hash" in entry.entry(spark).columns


def test_replay_completeness_wants_model_and_bundles_and_lists_every_trace(spark, good):
    full = {"model_id": "m", "prompt_bundle_hash": "p", "tool_schema_hash": "s"}
    traces = [{"trace_id": "whole", **full}, {"trace_id": "no steps", **full}, {"trace_id": "twice", **full},
              {"trace_id": "twice", **full, "model_id": None}, {"trace_id": "bad step", **full}]
    traces += [{"trace_id": c, **full, c: None} for c in full]
    call = {"step_type": "tool_call", "request_hash": "q", "response_hash": "r", "snapshot_uri": "u"}
    steps = [{"trace_id": t, **call} for t in ("whole", "twice", "no record", *full)]
    steps.append({"trace_id": "bad step", **call, "response_hash": None})
    cat = good.without("replay_traces", "replay_steps").replaced(
        replay_traces=frame(spark, "replay_traces", traces), replay_steps=frame(spark, "replay_steps", steps)
    )
    got = {r.trace_id: r for r in d.replay_completeness(cat).collect()}
    assert {t for t, r in got.items() if r.is_complete} == {"whole", "no steps"}
    assert len(got) == 8 and got["no steps"].steps == 0 and got["no record"].records == 0
    assert all(got[c][f"records_without_{c}"] == 1 for c in full)


def test_replay_completeness_equals_the_runbook(spark, duck):
    from tools.compare import rows

    mine = entry.queries()["d07_replay_completeness"](spark, SF).toArrow()
    assert rows(mine) == rows(duck.sql(entry.oracle_sql()["d07_replay_completeness"]).to_arrow_table())

"""Times, scope, streams and exports that earlier versions had wrong."""

import json

import pytest
from pyspark.sql import functions as F

from proofline.functions.exprs import to_datetime
from proofline.operators import runbooks as d
from proofline.plans.assessments import Assessments
from proofline.plans.report import build_report, write_report
from proofline.plans.runner import check_metrics, run_assessments
from proofline.sources.catalog import normalise
from proofline.streaming import jobs
from tests.conftest import NOW, day, frame, good_rows

SCOPE = {"tenant_id": "acme", "environment": "prod"}


@pytest.fixture
def stream(spark, tmp_path):
    """stream(table, rows): the rows as a stream of one file."""
    made = []

    def make(table, rows):
        path = str(tmp_path / f"{table}{len(made)}")
        made.append(path)
        df = normalise(frame(spark, table, rows), table)
        df.coalesce(1).write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path), df

    return make


def test_stored_times_do_not_follow_the_session_zone(spark):
    rows = [{**SCOPE, "time": t} for t in ("2024-02-01T10:00:00+02:00", "2024-02-01 10:00:00", "2024-02-01T10:00:00Z")]
    text = frame(spark, "tool_responses", rows)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [str(r.t) for r in normalise(text, "tool_responses").select(F.col("time").cast("string").alias("t")).collect()]
        assert got == ["2024-02-01 08:00:00", "2024-02-01 10:00:00", "2024-02-01 10:00:00"]
        instant = spark.sql("select timestamp'2024-02-01 10:00:00Z' as time, 'acme' as tenant_id")
        (r,) = normalise(instant, "tool_responses").select(F.col("time").cast("string").alias("t")).collect()
        assert r.t == "2024-02-01 10:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_as_of_has_an_offset_and_ends_the_window(spark, good):
    assert str(to_datetime("2024-03-01T00:00:00+02:00")) == "2024-02-29 22:00:00"
    row = {**SCOPE, "tier": "bounded", "window_days": 30}
    late, early = (Assessments.of(spark, [{**row, "as_of": t}]) for t in (NOW, "2024-02-13T12:00:00+02:00"))
    verified = lambda who: check_metrics(good, who, "Check03").first()
    counts = [[v for v in verified(who).asDict().values() if isinstance(v, int)] for who in (late, early)]
    # Requests are at 10:00 on five days; two lie before 10:00 UTC of the third.
    assert max(counts[0]) == 5 and max(counts[1]) == 2


def test_assessments_are_checked(spark):
    row = {**SCOPE, "tier": "bounded", "as_of": NOW}
    with pytest.raises(ValueError, match="unique"):
        Assessments.of(spark, [{**row, "assessment_id": "x"}, {**row, "assessment_id": "x"}])
    with pytest.raises(ValueError, match="unknown thresholds"):
        Assessments.of(spark, [{**row, "thresholds": {"min_atestation_coverage_pct": 99}}])
    columns = "assessment_id string, tenant_id string, environment string, tier string, as_of string"
    twice = spark.createDataFrame([("x", "acme", "prod", "bounded", NOW)] * 2, columns)
    with pytest.raises(ValueError, match="unique"):
        Assessments(twice)
    with pytest.raises(ValueError, match="unknown tier"):
        Assessments(spark.createDataFrame([("x", "acme", "prod", "none", NOW)], columns))


def ledger_row(n, at, event, before, **more):
    return {**SCOPE, "time": at, "ledger_event_id": f"l{n}", "sequence_number": n, "event_hash": event,
            "prev_event_hash": before, "sink_uri": "s", **more}


def test_idle_chain_makes_no_gap(stream):
    rows = [
        ledger_row(1, day(1), "a", "GENESIS"),
        ledger_row(2, day(5), "b", "a"),       # four days later
        ledger_row(3, day(5), "c", "wrong"),   # break
        ledger_row(5, day(6), "e", "d"),       # 4 is missing
        ledger_row(7, day(9), "g", "f", sink_uri="t"),  # first of its chain
        ledger_row(8, day(20), "h", "g", sink_uri="t"),
        ledger_row(9, day(28), "i", "h", sink_uri="t"),
    ]
    (one, stored), (two, _) = stream("ledger_events", rows), stream("ledger_events", rows)
    got = {(r.sequence_number, r.fault) for r in jobs.drain(jobs.ledger_faults(one, two, stored)).collect()}
    assert got == {(3, "HASH_CHAIN_BREAK"), (5, "SEQUENCE_GAP")}


def test_nonce_used_on_both_sides_of_midnight(stream):
    rows = [{**SCOPE, "time": t, "message_id": str(i), "sender_id": "a", "nonce": n} for i, (t, n) in enumerate([
        (day(3, "23:59:00"), "x"), (day(4, "00:01:00"), "x"),
        (day(3), "y"), (day(5), "y"),
        (day(9), "z"), (day(10), "z"), (day(28), "end"),
    ])]
    got = {(r.nonce, r.uses) for r in jobs.drain(jobs.nonce_replays(stream("agent_messages", rows)[0])).collect()}
    assert got == {("x", 2), ("z", 2)}


def test_candidates_of_two_tenants_and_several_discoveries(stream):
    seen = [
        {**SCOPE, "time": day(1), "event_id": "1", "candidate_hash": "c"},
        {**SCOPE, "time": day(2), "event_id": "2", "candidate_hash": "c"},
        {**SCOPE, "tenant_id": "other", "time": day(1), "event_id": "3", "candidate_hash": "c"},
        {**SCOPE, "time": day(1), "event_id": "4", "candidate_hash": "h", "candidate_payload": '{"access": "financial"}'},
        {**SCOPE, "time": day(28), "event_id": "5", "candidate_hash": "clock"},
    ]
    done = [
        {**SCOPE, "tenant_id": "other", "time": day(1, "12:00:00"), "event_id": "o", "candidate_hash": "c", "outcome": "enrolled"},
        {**SCOPE, "time": day(2, "05:00:00"), "event_id": "p", "candidate_hash": "h", "outcome": "enrolled"},
    ]
    alerts = jobs.ttl_alerts(stream("discovery_events", seen)[0], stream("remediation_outcomes", done)[0])
    got = sorted((r.tenant_id, r.candidate_hash, r.rung, str(r.alert_at)) for r in jobs.drain(alerts).collect())
    assert got == [
        ("acme", "c", "alert", "2024-02-02 22:00:00"),
        ("acme", "c", "escalate", "2024-02-03 16:00:00"),
        ("acme", "c", "terminate", "2024-02-04 10:00:00"),
        ("acme", "h", "alert", "2024-02-01 22:00:00"),
        ("acme", "h", "escalate", "2024-02-02 04:00:00"),
    ]


def test_calls_long_after_a_trigger_count_and_stay_in_their_tenant(spark, good):
    breaker = [{**SCOPE, "time": day(3), "event_id": "b", "event_type": "breaker.trigger", "agent_instance_id": "a"}]
    call = {**SCOPE, "agent_instance_id": "a", "tool_category": "financial", "decision": "allow"}
    calls = [
        {**call, "time": day(4), "request_hash": "1"}, {**call, "time": day(4), "request_hash": "2"},
        {**call, "time": day(9), "request_hash": "3", "tenant_id": "other"},
    ]
    cat = good.replaced(breaker_events=frame(spark, "breaker_events", breaker), tool_requests=frame(spark, "tool_requests", calls))
    (r,) = d.containment(cat).collect()
    assert (r.calls_after, r.containment_seconds, r.met_slo) == (2, 86_400.0, False)
    (r,) = d.containment(cat, horizon_s=3600).collect()
    assert (r.calls_after, r.met_slo) == (0, True)


def test_archive_reaches_runs_senders_and_workloads(good, tmp_path):
    rows = {r.kind: r for r in d.archive_agent(good, "agent-1", str(tmp_path / "a")).collect()}
    assert all(r.intact for r in rows.values())
    asked = [r["run_id"] for r in good_rows()["tool_requests"] if r["agent_instance_id"] == "agent-1"]
    decided = [r for r in good_rows()["policy_decisions"] if r["run_id"] in asked]
    assert rows["tool_requests"].n_rows == len(asked) and rows["policy_decisions"].n_rows == len(decided)
    assert {"ledger_events", "agent_messages", "discovery_events"} <= set(rows)


def test_reports_of_other_tenants_stay(spark, good, scope, tmp_path):
    path = str(tmp_path / "reports")
    who = scope("sandbox")
    report = build_report(run_assessments(good, who, ["Check01"]), who, NOW)
    write_report(report.withColumn("tenant_id", F.lit("other")), path)
    write_report(report, path)
    docs = [json.loads(x) for f in (tmp_path / "reports").rglob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["tenant_id"] for x in docs) == ["acme", "other"]


def test_notes_and_steps_of_ones_own(spark, good, scope):
    who = scope("high_privilege")
    own = spark.createDataFrame([("Check02", "high_privilege", "look", "paper", "because")],
                                "check_id string, tier string, step string, expected_artifact string, rationale string")
    rows = {r.check_id: r for r in run_assessments(good, who, ["Check01", "Check02", "Check06"], steps=own).collect()}
    assert all(r.notes for r in rows.values())
    assert [s.step for s in rows["Check02"].manual_steps] == ["look"]
    assert "owed: 1" in rows["Check02"].notes and not rows["Check06"].manual_steps


def test_scope_right_keeps_the_rows_of_other_tenants_apart(spark, good, scope):
    from proofline.operators import metrics as m

    def moved(*tables):
        rows = good_rows()
        return good.replaced(**{
            t: frame(spark, t, [{**r, "tenant_id": "other"} for r in rows[t]]) for t in tables
        })

    def value(function, name, cat, who, **options):
        row = function(cat, who, **options).first()
        return row[name] if row else 0

    who, tier2 = scope("bounded"), scope("high_privilege")
    # What the other tenant's rows hide without the option, and what is true.
    late = [{**r, "time": day(1)} for r in good_rows()["tool_requests"]]
    inventory = moved("c04_inventory").replaced(tool_requests=frame(spark, "tool_requests", late))
    for function, name, cat, w, hidden, true in (
        (m.approvals_present, "approvals_signed", moved("hitl_decisions"), who, 1, 0),
        (m.executed_unapproved, "executed_unapproved", moved("hitl_decisions"), who, 0, 1),
        (m.unenrolled_agents, "unenrolled_agents", inventory, who, 0, 2),
        (m.stale_baselines, "stale_baselines", moved("abom"), who, 0, 1),
        (m.enforced_responses, "enforced_responses", moved("drift_decisions"), tier2, 1, 0),
    ):
        assert value(function, name, cat, w) == hidden, name
        assert value(function, name, cat, w, scope_right=True) == true, name
    status = {r.check_id: r.status for r in run_assessments(moved("hitl_decisions"), tier2, ["Check14"], scope_right=True).collect()}
    assert status == {"Check14": "FAIL"}
    same = run_assessments(good, tier2, scope_right=True).select("check_id", "status")
    assert sorted(same.collect()) == sorted(run_assessments(good, tier2).select("check_id", "status").collect())

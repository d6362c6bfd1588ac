import pytest

from proofline.functions.vocab import ADVERSARIAL_EVENT, DRIFT_EVENT
from proofline.plans.checks import BY_ID, CHECKS, chosen
from proofline.plans.runner import run_assessments, write_results
from tests.conftest import day

PASSING = {
    "Check01": "PASS", "Check02": "PARTIAL", "Check03": "PASS", "Check04": "PASS",
    "Check05": "PASS", "Check06": "PARTIAL", "Check07": "PARTIAL", "Check08": "PASS",
    "Check09": "PASS", "Check10": "PASS", "Check11": "PARTIAL", "Check12": "PASS",
    "Check13": "PASS", "Check14": "PARTIAL", "Check15": "PARTIAL", "Check16": "PARTIAL",
    "Check17": "PARTIAL", "Check18": "PARTIAL", "Check19": "PARTIAL",
}


def result(cat, assessments, check_id):
    (row,) = run_assessments(cat, assessments, [check_id]).collect()
    return row


def test_good_evidence_at_the_highest_tier(good, scope):
    rows = {r.check_id: r for r in run_assessments(good, scope("high_privilege")).collect()}
    assert {k: r.status for k, r in rows.items()} == PASSING
    for r in rows.values():
        assert bool(r.manual_steps) == (r.classification == "PARTIAL")
        assert r.error is None and r.metrics and r.automated_finding


def test_sandbox_skips_and_may_pass_discovery(good, scope):
    rows = {r.check_id: r for r in run_assessments(good, scope("sandbox")).collect()}
    skipped = {k for k, r in rows.items() if r.status == "SKIP"}
    assert skipped == {c.check_id for c in CHECKS if "sandbox" not in c.tiers}
    assert rows["Check16"].status == "PASS" and not rows["Check16"].manual_steps
    assert rows["Check17"].status == "PARTIAL"
    assert all(rows[k].notes and rows[k].metrics is None for k in skipped)


def edit(**values):
    """Change the first row."""
    return lambda rows: rows[0].update(values)


def add(**values):
    return lambda rows: rows.append({**rows[0], **values})


FAULTS = [
    ("Check01", "tool_requests", add(request_hash="orphan")),
    ("Check01", "tool_requests", add(request_hash=None)),
    ("Check01", "policy_decisions", edit(decision_id=None)),
    ("Check02", "tool_requests", edit(originating_identity="other")),
    ("Check02", "gateway_identities", lambda rows: []),
    ("Check03", "tool_requests", edit(identity_verified=0)),
    ("Check04", "tool_requests", edit(tool_schema_hash="")),
    ("Check04", "tool_requests", edit(tool_schema_hash=None)),
    ("Check04", "policy_decisions", lambda rows: rows[:-1]),
    ("Check05", "ledger_events", lambda rows: rows[2].update(prev_event_hash="bad")),
    ("Check05", "ledger_events", lambda rows: []),
    ("Check06", "replay_traces", lambda rows: []),
    ("Check08", "budget_events", lambda rows: rows[:1]),
    ("Check09", "policy_decisions", edit(signing_key_id=None)),
    ("Check10", "memory_responses", edit(memory_decision_id=None)),
    ("Check11", "memory_quarantine", edit(item_id="i5")),
    ("Check12", "semantic_traces", edit(run_id="elsewhere")),
    ("Check12", "semantic_traces", edit(run_id=None)),
    ("Check13", "policy_decisions", edit(policy_bundle_hash="rogue")),
    ("Check13", "policy_decisions", edit(policy_bundle_hash="")),
    ("Check14", "hitl_decisions", lambda rows: []),
    ("Check14", "hitl_decisions", edit(signature_ref=None)),
    ("Check14", "policy_decisions", lambda rows: rows[1].update(obligations="HITL_Review")),
    ("Check16", "c04_inventory", lambda rows: rows[:1]),
    ("Check16", "discovery_events", edit(classifier_bundle_hash="rogue")),
    ("Check17", "memory_responses", edit(quality_decision_id=None)),
    ("Check17", "quality_bundles", edit(action_matrix='{"high_privilege": {"a": 1}}')),
    ("Check17", "quality_bundles", edit(action_matrix="not json")),
    ("Check17", "quality_bundles", edit(is_active=0)),
    ("Check18", "abom", edit(agent_instance_id="agent-1", is_current=0)),
    ("Check18", "drift_decisions", lambda rows: []),
    ("Check18", "drift_decisions", lambda rows: [r for r in rows if "-13" not in r["time"]]),
    ("Check18", "response_actions", edit(action="log_only")),
    ("Check19", "adversarial_outcomes", lambda rows: []),
    ("Check19", "adversarial_outcomes", add(event_type=DRIFT_EVENT)),
    ("Check19", "drift_decisions", add(event_type=ADVERSARIAL_EVENT)),
]


@pytest.mark.parametrize("check_id,table,change", FAULTS)
def test_one_fault_fails_the_check(changed, scope, check_id, table, change):
    if check_id == "Check18" and table == "abom":
        change = lambda rows: rows[:1]  # noqa: E731  the high-privilege agent loses its record
    assert result(changed(table, change), scope("high_privilege"), check_id).status == "FAIL"


def test_rows_outside_the_scope_do_not_count(changed, scope):
    for values in ({"tenant_id": "other"}, {"environment": "dev"}, {"time": "2023-01-01T00:00:00Z"}):
        cat = changed("tool_requests", add(request_hash="orphan", **values))
        assert result(cat, scope("bounded"), "Check01").status == "PASS"


def test_gateway_list_with_null_lets_nothing_be_suspicious(changed, spark, scope):
    cat = changed("tool_requests", edit(originating_identity="other"))
    nulls = spark.sql("SELECT * FROM VALUES ('gw'), (CAST(NULL AS STRING)) t(identity)")
    row = result(cat.replaced(gateway_identities=nulls), scope("bounded"), "Check02")
    assert row.metrics["count_non_gateway_originated_calls"] == 0


def test_live_exception_excuses_an_unenrolled_agent(changed, scope, spark):
    cat = changed("c04_inventory", lambda rows: rows[:1])
    excuse = {"outcome": "exception", "owner_identity": "agent-1",
              "exception_ttl_expires_at": "2024-04-01T00:00:00Z"}
    from tests.conftest import frame, good_rows

    rows = good_rows()["remediation_outcomes"]
    rows.append({**rows[0], **excuse})
    live = cat.replaced(remediation_outcomes=frame(spark, "remediation_outcomes", rows))
    assert result(live, scope("bounded"), "Check16").status == "PARTIAL"
    rows[-1]["exception_ttl_expires_at"] = "2024-02-01T00:00:00Z"
    over = cat.replaced(remediation_outcomes=frame(spark, "remediation_outcomes", rows))
    assert result(over, scope("bounded"), "Check16").status == "FAIL"


def test_stale_baseline_and_exact_cadence(changed, scope):
    cat = changed("baselines", edit(created_at="2023-11-01T00:00:00Z"))
    assert result(cat, scope("bounded"), "Check18").status == "FAIL"
    relaxed = scope("bounded", thresholds={"c19_baseline_max_age_days": 200})
    assert result(cat, relaxed, "Check18").status == "PARTIAL"


def test_tier_entry_that_is_not_an_object_is_an_error(changed, scope):
    cat = changed("quality_bundles", edit(action_matrix='{"bounded": ["deny"]}'))
    row = result(cat, scope("bounded"), "Check17")
    assert row.status == "ERROR" and row.error
    assert result(cat, scope("high_privilege"), "Check17").status == "FAIL"


def test_pairs_are_counted_like_a_join(changed, scope):
    cat = changed(
        "memory_quarantine",
        lambda rows: [{**rows[0], "event_id": f"q{i}", "item_id": "i5"} for i in range(3)],
    )
    row = result(cat, scope("bounded"), "Check11")
    assert row.metrics["count_quarantine_leaks"] == 3
    cat = changed("hitl_decisions", add(approval_id="a2", signature_ref=None))
    row = result(cat, scope("high_privilege"), "Check14")
    assert row.status == "FAIL"
    assert row.metrics["count_hitl_required"] == 2
    assert row.metrics["count_hitl_signed_present"] == 1
    assert row.metrics["count_hitl_required_executed_without_approval"] == 1


@pytest.mark.parametrize("check", CHECKS, ids=lambda c: c.check_id)
def test_missing_tables_give_an_error_row(spark, scope, check, good):
    tables = set(check.counts) | {
        "policy_decisions", "tool_requests", "gateway_identities", "ledger_events",
        "memory_quarantine", "semantic_traces", "hitl_decisions", "discovery_events",
        "c04_inventory", "quality_bundles", "agent_state", "policy_bundles",
    }
    row = result(good.without(*tables), scope(check.tiers[-1]), check.check_id)
    assert row.status == "ERROR" and "MissingTable" in row.error


def test_one_missing_table_leaves_the_other_checks_alone(good, scope, tmp_path, spark):
    cat = good.without("budget_events")
    rows = write_results(
        spark, cat, scope("high_privilege"), str(tmp_path / "r"), ["Check03", "Check08"]
    ).collect()
    assert {r.check_id: r.status for r in rows} == {"Check03": "PASS", "Check08": "ERROR"}


def test_unknown_check_is_refused():
    with pytest.raises(ValueError):
        chosen(["Check42"])
    assert [c.check_id for c in chosen(["Check03", "Check01"])] == ["Check01", "Check03"]
    assert len(BY_ID) == 19


def test_many_assessments_at_once(good, spark):
    from proofline.plans.assessments import Assessments
    from tests.conftest import NOW

    rows = [
        {"tenant_id": t, "environment": "prod", "tier": "bounded", "as_of": NOW, "window_days": w}
        for t, w in (("acme", 30), ("acme", 17), ("nobody", 30))
    ]
    got = run_assessments(good, Assessments.of(spark, rows), ["Check03", "Check05"]).collect()
    totals = {
        (r.assessment_id, r.check_id): (
            r.status, r.metrics.get("count_tool_requests_total", r.metrics.get("count_ledger_events"))
        )
        for r in got
    }
    assert totals[("a0", "Check03")] == ("PASS", 5)
    assert totals[("a1", "Check03")] == ("PASS", 3)
    assert totals[("a2", "Check03")] == ("PASS", 0)
    assert totals[("a2", "Check05")] == ("FAIL", 0)


def test_settings_are_validated(spark):
    from proofline.plans.assessments import Assessments

    base = {"tenant_id": "a", "environment": "prod", "tier": "bounded", "as_of": day(1)}
    for wrong in ({"tier": "root"}, {"environment": "qa"}, {"tenant_id": ""}):
        with pytest.raises(ValueError):
            Assessments.of(spark, [{**base, **wrong}])


def test_right_tables_may_be_limited_to_the_tenant(changed, scope):
    elsewhere = changed("policy_decisions", edit(tenant_id="other"))
    loose = run_assessments(elsewhere, scope("bounded"), ["Check01", "Check12"])
    assert {r.status for r in loose.collect()} == {"PASS"}
    strict = run_assessments(elsewhere, scope("bounded"), ["Check01", "Check12"], True)
    assert {r.status for r in strict.collect()} == {"FAIL"}


def test_options_of_single_metrics(changed, scope):
    from proofline.operators import metrics as m

    who = scope("high_privilege")
    cat = changed("drift_decisions", lambda rows: None)
    assert m.enforced_responses(cat, who).first().enforced_responses == 1
    assert m.enforced_responses(cat, who, only_detected=True).count() == 0
    late = changed("c04_inventory", lambda rows: rows[:1])
    assert m.unenrolled_agents(late, who, exact_hours=True).first().unenrolled_agents == 1

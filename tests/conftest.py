import os
import sys

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proofline.functions.vocab import ADVERSARIAL_EVENT, DRIFT_EVENT  # noqa: E402
from proofline.plans.assessments import Assessments  # noqa: E402
from proofline.sources.catalog import EvidenceCatalog  # noqa: E402
from proofline.sources.schemas import TABLES, ddl  # noqa: E402

NOW = "2024-03-01T00:00:00Z"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


def day(n, clock="10:00:00"):
    """A time on the n-th of February, as text in the spelling flat stores use."""
    return f"2024-02-{n:02d}T{clock}Z"


def good_rows():
    """Evidence of one tenant that passes every automatable part."""
    scope = {"tenant_id": "acme", "environment": "prod"}
    rows = {t: [] for t in TABLES}
    for i in range(1, 6):
        at = {**scope, "time": day(10 + i)}
        agent, run = f"agent-{i % 2}", f"run-{i}"
        rows["tool_requests"].append(
            {**at, "request_hash": f"h{i}", "run_id": run, "trace_id": f"t{i}",
             "agent_instance_id": agent, "originating_identity": "gw", "tool_name": "pay",
             "tool_category": "financial", "tool_schema_hash": "s1", "identity_verified": 1,
             "cost_usd": 1.5, "decision": "allow"}
        )
        rows["policy_decisions"].append(
            {**at, "decision_id": f"d{i}", "request_hash": f"h{i}", "run_id": run,
             "trace_id": f"t{i}", "tool_category": "financial", "tool_name": "pay",
             "decision": "allow", "reason": "ok",
             "obligations": "hitl_required" if i == 1 else "log",
             "policy_bundle_hash": "pb", "signature_ref": "sig", "signing_key_id": "key"}
        )
        rows["tool_responses"].append({**at, "request_hash": f"h{i}"})
        rows["ledger_events"].append(
            {**at, "ledger_event_id": f"l{i}", "sequence_number": i, "event_hash": f"e{i}",
             "prev_event_hash": f"e{i - 1}" if i > 1 else "GENESIS", "sink_uri": "worm://a",
             "run_id": run, "policy_decision_id": f"d{i}"}
        )
        rows["semantic_traces"].append(
            {**at, "event_id": f"s{i}", "run_id": run, "trace_id": f"t{i}", "audit_ref": f"l{i}"}
        )
        rows["memory_responses"].append(
            {**at, "response_id": f"m{i}", "item_id": f"i{i}", "request_type": "read",
             "memory_decision_id": f"md{i}", "quality_decision_id": f"qd{i}"}
        )
        rows["drift_decisions"] += [
            {**scope, "time": day(10 + i), "event_id": f"dr{i}-{dim}",
             "event_type": DRIFT_EVENT, "agent_instance_id": "agent-0",
             "dimension": dim, "decision": "no_drift"}
            for dim in ("tone", "tools")
        ]
    at = {**scope, "time": day(12)}
    rows["policy_decisions"].append(
        {**at, "decision_id": "d9", "request_hash": "h9", "run_id": "run-9", "decision": "deny",
         "reason": "schema_validation_failed", "policy_bundle_hash": "pb", "obligations": "log"}
    )
    rows["hitl_decisions"] = [{**at, "approval_id": "a1", "policy_decision_id": "d1",
                               "signature_ref": "hs"}]
    rows["breaker_events"] = [{**at, "event_id": "b1", "event_type": "breaker.trigger"},
                              {**at, "event_id": "b2", "event_type": "stop.activation"}]
    rows["budget_events"] = [{**at, "event_id": k, "event_type": f"budget.{k}"}
                             for k in ("decrement", "throttle", "deny")]
    rows["replay_traces"] = [{**at, "trace_id": "t1", "model_id": "m", "prompt_bundle_hash": "p",
                              "tool_schema_hash": "s1", "snapshot_uri": "u"}]
    rows["memory_decisions"] = [{**at, "decision_id": "x", "decision": "deny",
                                 "reason": "cross_tenant_read"}]
    rows["memory_quarantine"] = [{**at, "event_id": "q1", "item_id": "never-read"}]
    rows["agent_messages"] = [
        {**at, "message_id": r, "validation_status": "reject", "reason": r}
        for r in ("spoofed_sender", "nonce_replay")
    ]
    rows["policy_bundles"] = [{"bundle_hash": "pb"}]
    rows["classifier_bundles"] = [{"bundle_hash": "cb"}]
    rows["discovery_events"] = [{**at, "event_id": "e1", "candidate_hash": "c1",
                                 "workload_identity": "w", "classifier_bundle_hash": "cb"}]
    rows["remediation_outcomes"] = [{**at, "event_id": "o1", "candidate_hash": "c1",
                                     "outcome": "enrolled", "owner_identity": "team"}]
    rows["c04_inventory"] = [{"agent_instance_id": f"agent-{i}", **scope} for i in (0, 1)]
    matrix = (
        '{"bounded": {"facts": {"freshness": "deny", "confidence": "deny"}},'
        ' "high_privilege": {"facts": {"freshness": "deny"},'
        ' "policy": {"confidence": "deny", "provenance": "deny"}}}'
    )
    rows["quality_bundles"] = [{"bundle_hash": "qb", "tenant_id": "acme", "is_active": 1,
                                "action_matrix": matrix}]
    rows["response_actions"] = [{**at, "event_id": "r1", "drift_decision_id": "dr1-tone",
                                 "action": "tier_reduction"}]
    rows["adversarial_outcomes"] = [{**at, "event_id": "v1",
                                     "event_type": ADVERSARIAL_EVENT}]
    rows["baselines"] = [{"baseline_hash": "bl", "created_at": day(1)}]
    rows["agent_state"] = [
        {"agent_instance_id": f"agent-{i}", "state": "Run", "autonomy_tier": tier, **scope}
        for i, tier in enumerate(("bounded", "high_privilege"))
    ]
    rows["abom"] = [{"agent_instance_id": f"agent-{i}", "current_baseline_hash": "bl",
                     "is_current": 1, "tenant_id": "acme"} for i in (0, 1)]
    rows["gateway_identities"] = [{"identity": "gw"}]
    return rows


def frame(spark, table, rows):
    if not rows:
        return spark.createDataFrame([], ddl(table))
    data = {}
    for n, dtype, _ in TABLES[table]:
        values = [r.get(n) for r in rows]
        kind = pa.list_(pa.string()) if dtype.startswith("ARRAY") else pa.string()
        data[n] = pa.array(values, kind if all(v is None for v in values) else None)
    return spark.createDataFrame(pa.table(data))


@pytest.fixture(scope="session")
def good(spark):
    rows = good_rows()
    return EvidenceCatalog(spark, {t: frame(spark, t, r) for t, r in rows.items()})


@pytest.fixture
def changed(spark, good):
    """changed(table, edit): the good store with one table's rows edited."""

    def make(table, edit):
        rows = good_rows()[table]
        out = edit(rows)
        return good.replaced(**{table: frame(spark, table, rows if out is None else out)})

    return make


@pytest.fixture(scope="session")
def scope(spark):
    def make(tier, **settings):
        return Assessments.of(
            spark,
            [{"tenant_id": "acme", "environment": "prod", "tier": tier, "as_of": NOW, **settings}],
        )

    return make

"""An evidence store derived from the star-schema and event tables.

Every view is a projection (no window, no shuffle) of ``events`` or of a
registry table, with defects planted by the event's ``k``. The SQL is written
in the part both engines share, so the same text feeds the oracle; the few
differing names are exchanged by ``duckdb()``.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from proofline.functions.vocab import ADVERSARIAL_EVENT, DRIFT_EVENT
from proofline.sources.catalog import EvidenceCatalog, normalise

AS_OF = "2024-01-31 00:00:00"

BASE_TABLES = ("events", "customer", "nation", "region", "supplier")

_SCOPED = "tenant_id, environment, ts AS time"

VIEWS: dict[str, str] = {
    "ev": """
SELECT event_id AS e, ts, user_id AS u, event_type AS t, value AS v,
  CAST(get_json_object(props, '$.k') AS INT) AS k,
  'tenant-' || (user_id % 3) AS tenant_id,
  CASE WHEN user_id % 5 = 0 THEN 'dev' WHEN user_id % 5 = 1 THEN 'test' ELSE 'prod' END
    AS environment,
  'agent-' || user_id AS agent,
  'run-' || user_id || '-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id,
  'tr-' || event_id AS trace_id,
  md5('req-' || event_id) AS request_hash,
  CASE event_type WHEN 'view' THEN 'read_only' WHEN 'click' THEN 'reversible_write'
    WHEN 'purchase' THEN 'financial' WHEN 'signup' THEN 'irreversible_write'
    ELSE 'infrastructure' END AS category
FROM events""",
    "tool_requests": f"""
SELECT request_hash, run_id, trace_id, agent AS agent_instance_id,
  CASE WHEN k = 3 THEN agent WHEN k = 4 THEN NULL ELSE 'gateway-' || (1 + u % 10) END
    AS originating_identity,
  'tool-' || t AS tool_name, category AS tool_category,
  CASE WHEN k = 7 THEN NULL WHEN k = 8 THEN '' ELSE 'schema-' || t END AS tool_schema_hash,
  k <> 13 AS identity_verified, v AS cost_usd,
  CASE WHEN k = 97 THEN 'invariant_halt' WHEN k IN (30, 31, 32) THEN 'deny' ELSE 'allow' END
    AS decision,
  {_SCOPED}
FROM ev""",
    "policy_decisions": f"""
SELECT 'pd-' || e AS decision_id, request_hash, run_id, trace_id,
  'tool-' || t AS tool_name, category AS tool_category,
  CASE WHEN k IN (30, 31, 32) THEN 'deny' ELSE 'allow' END AS decision,
  CASE WHEN k IN (30, 31) THEN 'schema_validation_failed' WHEN k = 32 THEN 'approval_missing'
    ELSE 'ok' END AS reason,
  CASE WHEN k = 32 THEN array('HITL_REQUIRED', 'TIER') WHEN k IN (30, 31) THEN array('SCHEMA')
    ELSE array('OK') END AS reason_codes,
  CASE WHEN category = 'financial' AND k % 2 = 0 THEN 'log,hitl_required'
    WHEN k = 41 THEN 'HITL_Review' ELSE 'log' END AS obligations,
  CASE WHEN k = 50 THEN 'pb-rogue' WHEN k = 51 THEN NULL WHEN k = 52 THEN ''
    ELSE 'pb-' || (day(ts) % 25) END AS policy_bundle_hash,
  CASE WHEN k = 60 THEN NULL ELSE 'sig-' || e END AS signature_ref,
  CASE WHEN k = 61 THEN NULL ELSE 'key-' || (u % 3) END AS signing_key_id,
  least(v / 100, 1.0e0) AS orm_risk_score,
  {_SCOPED}
FROM ev WHERE k <> 21""",
    "tool_responses": """
SELECT request_hash, run_id, trace_id, md5('resp-' || e) AS response_hash, 'ok' AS status,
  CASE WHEN k % 11 = 0 THEN NULL ELSE 'snap://' || e END AS snapshot_uri,
  tenant_id, environment, ts + k * INTERVAL '1' SECOND AS time
FROM ev WHERE k NOT IN (21, 30, 31, 32)""",
    "ledger_events": """
SELECT 'le-' || e AS ledger_event_id,
  pos + 1 + CAST(floor(pos / 500) AS BIGINT) AS sequence_number,
  CASE WHEN k = 74 THEN NULL ELSE md5('ev-' || e) END AS event_hash,
  CASE WHEN pos = 0 THEN 'GENESIS' WHEN k = 78 THEN 'tampered' WHEN k = 77 THEN NULL
    ELSE md5('ev-' || (e - 9)) END AS prev_event_hash,
  'worm://ledger/' || (e % 3) AS sink_uri, 'pd-' || e AS policy_decision_id, run_id,
  'tenant-' || (e % 3) AS tenant_id,
  CASE WHEN e % 9 < 3 THEN 'dev' WHEN e % 9 < 6 THEN 'test' ELSE 'prod' END AS environment,
  ts AS time
FROM (SELECT e, u, k, ts, run_id, CAST(floor(e / 9) AS BIGINT) AS pos FROM ev) chained
WHERE k <> 79""",
    "breaker_events": f"""
SELECT 'br-' || e AS event_id,
  CASE WHEN k % 2 = 0 THEN 'breaker.trigger' ELSE 'stop.activation' END AS event_type,
  agent AS agent_instance_id, 'cause-' || (k % 3) AS trigger_cause,
  50.0e0 AS threshold_value, v AS actual_value,
  CASE WHEN k < 38 THEN 'contained' ELSE 'partial' END AS containment_outcome,
  CAST(k * 100 AS BIGINT) AS time_to_effective_stop_ms, array(run_id) AS affected_run_ids,
  {_SCOPED}
FROM ev WHERE t = 'error' AND k BETWEEN 30 AND 39""",
    "budget_events": f"""
SELECT 'bu-' || e AS event_id,
  CASE WHEN k < 80 THEN 'budget.decrement' WHEN k < 90 THEN 'budget.throttle'
    ELSE 'budget.deny' END AS event_type, {_SCOPED}
FROM ev WHERE t = 'purchase'""",
    "replay_traces": f"""
SELECT trace_id, run_id, CASE WHEN k = 70 THEN NULL ELSE 'model-' || (u % 4) END AS model_id,
  CASE WHEN k = 71 THEN NULL ELSE 'prompt-1' END AS prompt_bundle_hash,
  'schema-' || t AS tool_schema_hash,
  CASE WHEN k = 72 THEN NULL ELSE 'snap://' || e END AS snapshot_uri, {_SCOPED}
FROM ev WHERE t = 'purchase'""",
    "replay_steps": """
SELECT run_id, trace_id, request_hash,
  CASE WHEN k = 73 THEN NULL ELSE md5('resp-' || e) END AS response_hash,
  CASE WHEN k % 11 = 0 THEN NULL ELSE 'snap://' || e END AS snapshot_uri,
  e AS step_index, CASE WHEN k = 97 THEN 'invariant_halt' ELSE 'tool_call' END AS step_type,
  CASE WHEN k = 97 AND e % 2 = 0 THEN 'rule-1' ELSE NULL END AS invariant_rule_id
FROM ev WHERE k <> 21""",
    "replayed_steps": """
SELECT run_id, trace_id, request_hash,
  CASE WHEN k = 73 THEN NULL WHEN k = 75 THEN 'other' ELSE md5('resp-' || e) END
    AS response_hash,
  CAST(NULL AS STRING) AS snapshot_uri, e AS step_index, 'tool_call' AS step_type,
  CAST(NULL AS STRING) AS invariant_rule_id
FROM ev WHERE k NOT IN (21, 76)""",
    "semantic_traces": f"""
SELECT 'st-' || e AS event_id,
  CASE WHEN k = 99 THEN 'run-orphan-' || u WHEN k = 96 THEN NULL ELSE run_id END AS run_id,
  trace_id, 'intent-' || (k % 4) AS intent, 'le-' || e AS audit_ref, {_SCOPED}
FROM ev WHERE k % 3 = 0""",
    "hitl_decisions": """
SELECT 'ap-' || e AS approval_id, 'pd-' || e AS policy_decision_id, run_id,
  'tool-' || t AS tool_name, least(v / 100, 1.0e0) AS orm_risk_score,
  'approver-' || (u % 7) AS approver_id,
  CASE WHEN k % 10 = 4 AND u % 7 > 1 THEN 'deny' ELSE 'approve' END AS action,
  'reason-' || (k % 3) AS justification, 'le-' || e AS ledger_event_id,
  CASE WHEN k % 10 = 2 THEN NULL ELSE 'hsig-' || e END AS signature_ref,
  tenant_id, environment, ts + (5 + (u % 7) * 10) * INTERVAL '1' SECOND AS time
FROM ev
WHERE k <> 21 AND k % 10 <> 0 AND ((category = 'financial' AND k % 2 = 0) OR k = 41)""",
    "memory_responses": f"""
SELECT 'mr-' || e AS response_id, 'item-' || (e % 500) AS item_id,
  CASE WHEN k % 4 = 0 THEN 'write' ELSE 'read' END AS request_type,
  CASE WHEN k = 85 THEN NULL ELSE 'md-' || e END AS memory_decision_id,
  CASE WHEN k = 86 THEN NULL ELSE 'qd-' || e END AS quality_decision_id,
  run_id, 'class-' || (k % 5) AS content_class, k % 17 = 0 AS freshness_flag, {_SCOPED}
FROM ev WHERE t IN ('view', 'click')""",
    "memory_decisions": f"""
SELECT 'md-' || e AS decision_id, CASE WHEN k IN (87, 88) THEN 'deny' ELSE 'allow' END AS decision,
  CASE WHEN k = 87 THEN 'cross_tenant_read' ELSE 'acl' END AS reason, {_SCOPED}
FROM ev WHERE t IN ('view', 'click')""",
    "memory_quarantine": f"""
SELECT 'mq-' || e AS event_id, 'item-' || (e % 500) AS item_id,
  'part-' || (u % 4) AS memory_partition, 'doc-' || e AS document_ref,
  array('poison', 'cause-' || (e % 3)) AS cause_codes, array('src-' || u) AS provenance_refs,
  least(v / 100, 1.0e0) AS detection_confidence,
  CASE WHEN e % 6 = 0 THEN NULL ELSE 'reviewer-' || (u % 3) END AS reviewed_by,
  CASE WHEN e % 6 = 0 THEN NULL ELSE 'confirmed' END AS review_outcome,
  CASE WHEN e % 6 = 0 THEN NULL ELSE ts + (e % 2400) * INTERVAL '1' MINUTE END AS reviewed_at,
  {_SCOPED}
FROM ev WHERE t = 'error' AND k = 90""",
    "agent_messages": f"""
SELECT 'am-' || e AS message_id,
  CASE WHEN k IN (62, 63, 64) THEN 'reject' ELSE 'accept' END AS validation_status,
  CASE WHEN k = 62 THEN 'spoofed_sender' WHEN k = 63 THEN 'nonce_replay'
    WHEN k = 64 THEN 'bad_signature' ELSE NULL END AS reason,
  agent AS sender_id, 'nonce-' || (e % 97) AS nonce,
  ts + (k - 5) * INTERVAL '1' SECOND AS expires_at, {_SCOPED}
FROM ev WHERE t = 'click'""",
    "policy_bundles": """
SELECT 'pb-' || n_nationkey AS bundle_hash, n_name AS bundle_version,
  TIMESTAMP_NTZ '2023-12-01 00:00:00' AS signed_at FROM nation""",
    "discovery_events": f"""
SELECT 'de-' || e AS event_id, 'cand-' || u || '-' || (day(ts) % 4) AS candidate_hash,
  agent AS workload_identity,
  CASE WHEN k = 92 THEN 'cb-rogue' WHEN k = 94 THEN NULL ELSE 'cb-' || (u % 5) END
    AS classifier_bundle_hash,
  '{{"workload_identity": "agent-' || u || '", "access": "' || category || '"}}'
    AS candidate_payload, {_SCOPED}
FROM ev WHERE k % 2 = 0 AND t IN ('signup', 'error')""",
    "remediation_outcomes": """
SELECT 'ro-' || e AS event_id, 'cand-' || u || '-' || (day(ts) % 4) AS candidate_hash,
  CASE WHEN k % 12 = 0 THEN 'exception' WHEN k % 8 = 0 THEN 'enrolled' ELSE 'terminated' END
    AS outcome,
  agent AS owner_identity, agent AS workload_identity,
  ts + (k % 40) * INTERVAL '1' DAY AS exception_ttl_expires_at,
  tenant_id, environment, ts + k * INTERVAL '1' HOUR AS time
FROM ev WHERE k % 4 = 0 AND t = 'signup'""",
    "c04_inventory": """
SELECT 'agent-' || c_custkey AS agent_instance_id, 'Run' AS state,
  CASE WHEN c_custkey % 2 = 0 THEN 'bounded' ELSE 'high_privilege' END AS autonomy_tier,
  'abom-' || c_custkey AS current_abom_hash,
  'tenant-' || (c_custkey % 3) AS tenant_id,
  CASE WHEN c_custkey % 5 = 0 THEN 'dev' WHEN c_custkey % 5 = 1 THEN 'test' ELSE 'prod' END
    AS environment
FROM customer WHERE c_custkey % 7 <> 0""",
    "classifier_bundles": """
SELECT 'cb-' || r_regionkey AS bundle_hash,
  TIMESTAMP_NTZ '2023-12-01 00:00:00' AS signed_at FROM region""",
    "quality_bundles": """
SELECT 'qb-' || n_nationkey AS bundle_hash, 'tenant-' || (n_nationkey % 3) AS tenant_id,
  n_nationkey % 4 <> 3 AS is_active,
  CASE
    WHEN n_nationkey % 5 = 0 THEN '{"bounded": {"facts": {"freshness": "deny"}}}'
    WHEN n_nationkey % 5 = 1
      THEN '{"bounded": {"facts": {"confidence": "deny", "provenance": "flag"}},' ||
           ' "high_privilege": {"facts": "all", "policy": {"provenance": "deny"}}}'
    WHEN n_nationkey % 5 = 2 THEN 'not json'
    WHEN n_nationkey % 5 = 3
      THEN '{"high_privilege": {"facts": {"freshness": "deny", "confidence": "' ||
           CASE WHEN n_nationkey = 3 THEN 'flag' ELSE 'deny' END || '"}}}'
    ELSE NULL END AS action_matrix
FROM nation""",
    "quality_decisions": f"""
SELECT 'qd-' || e AS decision_id,
  CASE WHEN k = 83 THEN 'qb-rogue' WHEN k = 84 THEN NULL ELSE 'qb-' || (u % 25) END
    AS quality_bundle_hash, {_SCOPED}
FROM ev WHERE t IN ('view', 'click') AND k <> 86""",
    "drift_decisions": f"""
SELECT 'dd-' || e AS event_id,
  CASE WHEN k = 91 THEN '{ADVERSARIAL_EVENT}'
    WHEN k = 93 THEN '{DRIFT_EVENT}+{ADVERSARIAL_EVENT}'
    ELSE '{DRIFT_EVENT}' END AS event_type,
  agent AS agent_instance_id, 'dim-' || (k % 2) AS dimension,
  CASE WHEN k % 5 = 0 THEN 'drift_detected' ELSE 'no_drift' END AS decision,
  '{{"agent_instance_id": "agent-' || u || '"}}' AS payload, {_SCOPED}
FROM ev WHERE t = 'signup'""",
    "response_actions": """
SELECT 'ra-' || e AS event_id, 'dd-' || e AS drift_decision_id,
  CASE k % 25 WHEN 0 THEN 'log_only' WHEN 5 THEN 'flag' WHEN 10 THEN 'review_ticket'
    WHEN 15 THEN 'tier_reduction' ELSE 'emergency_stop' END AS action,
  tenant_id, environment, ts + INTERVAL '60' SECOND AS time
FROM ev WHERE t = 'signup' AND k % 5 = 0""",
    "adversarial_outcomes": f"""
SELECT 'ao-' || e AS event_id,
  CASE WHEN k = 11 THEN '{DRIFT_EVENT}' ELSE '{ADVERSARIAL_EVENT}' END AS event_type, {_SCOPED}
FROM ev WHERE t = 'error' AND k < 30""",
    "baselines": """
SELECT 'bl-' || c_custkey AS baseline_hash,
  CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP_NTZ '2023-10-01 00:00:00'
    ELSE TIMESTAMP_NTZ '2024-01-10 00:00:00' END AS created_at,
  CASE WHEN c_custkey % 23 = 0 THEN 'abom-old' ELSE 'abom-' || c_custkey END AS abom_hash
FROM customer WHERE c_custkey % 17 <> 0""",
    "abom": """
SELECT 'agent-' || c_custkey AS agent_instance_id, 'bl-' || c_custkey AS current_baseline_hash,
  c_custkey % 9 <> 4 AS is_current, 'tenant-' || (c_custkey % 3) AS tenant_id
FROM customer WHERE c_custkey % 11 <> 0""",
    "agent_state": """
SELECT 'agent-' || c_custkey AS agent_instance_id,
  CASE WHEN c_custkey % 10 = 9 THEN 'Quiesce' ELSE 'Run' END AS state,
  CASE WHEN c_custkey % 19 = 0 THEN 'sandbox' WHEN c_custkey % 2 = 0 THEN 'bounded'
    ELSE 'high_privilege' END AS autonomy_tier,
  'tenant-' || (c_custkey % 3) AS tenant_id,
  CASE WHEN c_custkey % 5 = 0 THEN 'dev' WHEN c_custkey % 5 = 1 THEN 'test' ELSE 'prod' END
    AS environment
FROM customer""",
    "gateway_identities": """
SELECT 'gateway-' || s_suppkey AS identity FROM supplier WHERE s_suppkey % 9 <> 8""",
}

# One assessment per (tenant, environment); tiers and windows are mixed.
ASSESSMENT_ROWS = [
    {
        "assessment_id": f"as-{t}-{env}",
        "tenant_id": f"tenant-{t}",
        "environment": env,
        "tier": ("sandbox", "bounded", "high_privilege")[(t + i) % 3],
        "as_of": AS_OF,
        "window_days": (30, 14, 21)[t],
    }
    for t in range(3)
    for i, env in enumerate(("dev", "test", "prod"))
]


def _needed(sql: str) -> list[str]:
    """Views the text reads, each after the ones it depends on."""
    found: list[str] = []

    def need(text):
        for name in re.findall(r"\b\w+\b", text):
            if name in VIEWS and name not in found and name not in own:
                need(VIEWS[name])
                if name not in found:
                    found.append(name)

    own = set(re.findall(r"(\w+) AS \(\s*SELECT", sql))
    need(sql)
    return found


def _base_view(spark: SparkSession, sf_dir: str, table: str) -> str:
    """A temporary view of one given table, made once per session and folder."""
    name = f"derived_{table}_{zlib.crc32(sf_dir.encode()):08x}"
    if not spark.catalog.tableExists(name):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
    return name


def _text(spark: SparkSession, sf_dir: str, name: str, sources: dict[str, str]) -> str:
    views = [v for v in _needed(name) if v not in sources]
    body = " ".join(VIEWS[v] for v in views)
    ctes = [
        f"{t} AS (SELECT * FROM {sources.get(t) or _base_view(spark, sf_dir, t)})"
        for t in BASE_TABLES
        if re.search(rf"FROM {t}\b", body)
    ] + [f"{v} AS (SELECT * FROM {sources[v]})" for v in VIEWS if v in sources]
    ctes += [f"{v} AS ({VIEWS[v]})" for v in views]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {name}"


def derived_frame(
    spark: SparkSession, sf_dir: str, name: str, sources: dict[str, str] | None = None
) -> DataFrame:
    """One view as a DataFrame over the parquet tables in ``sf_dir``; ``sources`` names
    temporary views to take in place of a table or of a view below it."""
    return spark.sql(_text(spark, sf_dir, name, sources or {}))


def derived_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over ``events`` as a stream; each call reads its own."""
    events = (
        spark.readStream.schema(spark.table(_base_view(spark, sf_dir, "events")).schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    source = f"derived_stream_{uuid.uuid4().hex}"
    events.createOrReplaceTempView(source)
    return normalise(spark.sql(_text(spark, sf_dir, name, {"events": source})), name)


def derived_catalog(spark: SparkSession, sf_dir: str, folder: str | None = None) -> EvidenceCatalog:
    """The views as an evidence store; each is built when first asked for.

    With a ``folder``, the rows of ``ev`` are stored there first, so that a plan that reads
    many of the views takes the events' JSON apart once and not once per view.
    """
    sources = {}
    if folder:
        ev = derived_frame(spark, sf_dir, "ev")
        ev.write.parquet(folder)
        sources["ev"] = f"derived_ev_{uuid.uuid4().hex}"
        spark.read.schema(ev.schema).parquet(folder).createOrReplaceTempView(sources["ev"])
    return EvidenceCatalog(
        spark,
        {
            name: partial(derived_frame, spark, sf_dir, name, sources)
            for name in VIEWS
            if name not in ("ev", "replayed_steps")
        },
    )


def duckdb(sql: str) -> str:
    """Put the CTEs a query needs in front of it, in the other engine's spelling."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _needed(sql)]
    if re.search(r"\bassess\b", sql):
        ctes.append(f"assess AS ({_assess_sql()})")
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        text = "WITH " + ",\n".join(ctes)
    else:
        text = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
    text = text.replace("get_json_object(", "json_extract_string(")
    text = text.replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
    return re.sub(r"\barray\(", "list_value(", text)


def _assess_sql() -> str:
    rows = ",\n".join(
        "('{assessment_id}', '{tenant_id}', '{environment}', '{tier}', {window_days})".format(**r)
        for r in ASSESSMENT_ROWS
    )
    return f"""
SELECT assessment_id, tenant_id, environment, tier, window_days,
  TIMESTAMP '{AS_OF}' AS as_of, TIMESTAMP '{AS_OF}' - window_days * INTERVAL '1' DAY AS since
FROM (VALUES {rows}) v(assessment_id, tenant_id, environment, tier, window_days)"""

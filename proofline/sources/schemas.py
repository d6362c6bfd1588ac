"""Evidence tables: columns, types and where nested stores keep them.

Names and types are fixed values (the data model evidence stores follow).
A column is ``name TYPE`` or ``name TYPE < path[, path...]``; a path is read
when the flat column is absent. ``$`` paths are fields of a JSON text column.
"""

from __future__ import annotations

_SCOPE = """
tenant_id STRING
environment STRING
time TIMESTAMP_NTZ
"""

_TABLES = {
    "tool_requests": _SCOPE + """
request_hash STRING
run_id STRING
trace_id STRING
agent_instance_id STRING
originating_identity STRING
tool_name STRING
tool_category STRING
tool_schema_hash STRING
identity_verified BOOLEAN
cost_usd DOUBLE
decision STRING
""",
    "policy_decisions": _SCOPE + """
decision_id STRING
request_hash STRING
run_id STRING
trace_id STRING
tool_name STRING
tool_category STRING
decision STRING
reason STRING
reason_codes ARRAY<STRING>
obligations STRING
policy_bundle_hash STRING
signature_ref STRING
signing_key_id STRING
orm_risk_score DOUBLE < inputs.orm_risk_score
""",
    "tool_responses": _SCOPE + """
request_hash STRING
run_id STRING
trace_id STRING
response_hash STRING
status STRING
snapshot_uri STRING
""",
    "ledger_events": _SCOPE + """
ledger_event_id STRING
sequence_number BIGINT
event_hash STRING < hash_chain.event_hash
prev_event_hash STRING < hash_chain.prev_event_hash
sink_uri STRING < immutability.sink_uri
policy_decision_id STRING < references.policy_decision_id
run_id STRING
""",
    "breaker_events": _SCOPE + """
event_id STRING
event_type STRING
agent_instance_id STRING
trigger_cause STRING
threshold_value DOUBLE
actual_value DOUBLE
containment_outcome STRING
time_to_effective_stop_ms BIGINT
affected_run_ids ARRAY<STRING>
""",
    "budget_events": _SCOPE + """
event_id STRING
event_type STRING
""",
    "replay_traces": _SCOPE + """
trace_id STRING
run_id STRING
model_id STRING
prompt_bundle_hash STRING
tool_schema_hash STRING
snapshot_uri STRING
""",
    "replay_steps": """
run_id STRING
trace_id STRING
request_hash STRING
response_hash STRING
snapshot_uri STRING
step_index BIGINT
step_type STRING
invariant_rule_id STRING
""",
    "semantic_traces": _SCOPE + """
event_id STRING
run_id STRING
trace_id STRING
intent STRING
audit_ref STRING
""",
    "hitl_decisions": _SCOPE + """
approval_id STRING
policy_decision_id STRING < context.policy_decision_id
run_id STRING
tool_name STRING < request.tool_name
orm_risk_score DOUBLE < context.orm_risk_score
approver_id STRING < decision.approver_id
action STRING < decision.action
justification STRING < decision.justification
ledger_event_id STRING < evidence.ledger_event_id
signature_ref STRING < evidence.signature
""",
    "memory_responses": _SCOPE + """
response_id STRING
item_id STRING
request_type STRING
memory_decision_id STRING
quality_decision_id STRING
run_id STRING
content_class STRING
freshness_flag BOOLEAN
""",
    "memory_decisions": _SCOPE + """
decision_id STRING
decision STRING
reason STRING
""",
    "memory_quarantine": _SCOPE + """
event_id STRING
item_id STRING
memory_partition STRING
document_ref STRING
cause_codes ARRAY<STRING>
provenance_refs ARRAY<STRING>
detection_confidence DOUBLE
reviewed_by STRING
review_outcome STRING
reviewed_at TIMESTAMP_NTZ
""",
    "agent_messages": _SCOPE + """
message_id STRING
validation_status STRING
reason STRING
sender_id STRING
nonce STRING
expires_at TIMESTAMP_NTZ
""",
    "policy_bundles": """
bundle_hash STRING
bundle_version STRING
signed_at TIMESTAMP_NTZ
""",
    "discovery_events": _SCOPE + """
event_id STRING
candidate_hash STRING
workload_identity STRING < candidate_payload$.workload_identity
classifier_bundle_hash STRING
candidate_payload STRING
""",
    "remediation_outcomes": _SCOPE + """
event_id STRING
candidate_hash STRING
outcome STRING
owner_identity STRING
workload_identity STRING
exception_ttl_expires_at TIMESTAMP_NTZ
""",
    "c04_inventory": """
agent_instance_id STRING
state STRING
autonomy_tier STRING
current_abom_hash STRING
tenant_id STRING
environment STRING
""",
    "classifier_bundles": """
bundle_hash STRING
signed_at TIMESTAMP_NTZ
""",
    "quality_bundles": """
bundle_hash STRING
tenant_id STRING
is_active BOOLEAN
action_matrix STRING
""",
    "quality_decisions": _SCOPE + """
decision_id STRING
quality_bundle_hash STRING
""",
    "drift_decisions": _SCOPE + """
event_id STRING
event_type STRING
agent_instance_id STRING < payload$.agent_instance_id
dimension STRING
decision STRING
payload STRING
""",
    "response_actions": _SCOPE + """
event_id STRING
drift_decision_id STRING
action STRING
""",
    "adversarial_outcomes": _SCOPE + """
event_id STRING
event_type STRING
""",
    "baselines": """
baseline_hash STRING
created_at TIMESTAMP_NTZ
abom_hash STRING
""",
    "abom": """
agent_instance_id STRING
current_baseline_hash STRING
is_current BOOLEAN
tenant_id STRING
""",
    "agent_state": """
agent_instance_id STRING
state STRING
autonomy_tier STRING
tenant_id STRING
environment STRING
""",
    "gateway_identities": """
identity STRING
""",
}


def _parse(block: str) -> list[tuple[str, str, tuple[str, ...]]]:
    columns = []
    for line in block.split("\n"):
        if not line.strip():
            continue
        head, _, paths = line.partition(" < ")
        name, dtype = head.split(" ", 1)
        columns.append((name, dtype, tuple(p.strip() for p in paths.split(",") if p)))
    return columns


TABLES = {name: _parse(block) for name, block in _TABLES.items()}


def ddl(table: str) -> str:
    """The flat schema of a table, for empty tables and streaming sources."""
    return ", ".join(f"{name} {dtype}" for name, dtype, _ in TABLES[table])

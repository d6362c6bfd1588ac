"""Plain SQL twins of the registered queries, over the same evidence views."""

from __future__ import annotations

from proofline.functions.vocab import ADVERSARIAL_EVENT, DRIFT_EVENT, UNENROLLED_FINDING
from proofline.plans.checks import OPEN_QUESTIONS
from proofline.sources.derived import AS_OF, duckdb

NOW = f"TIMESTAMP_NTZ '{AS_OF}'"
HIGH = "('financial', 'irreversible_write', 'infrastructure')"


def _in(table: str, alias: str = "x") -> str:
    return (
        f"assess a JOIN {table} {alias} ON {alias}.tenant_id = a.tenant_id "
        f"AND {alias}.environment = a.environment AND {alias}.time >= a.since "
        f"AND {alias}.time < a.as_of"
    )


def _tally(table: str, **counts: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in counts.items())
    return f"(SELECT a.assessment_id, {cols} FROM {_in(table)} GROUP BY 1)"


def _check(parts: list[str], **columns: str) -> str:
    joins = "".join(f" LEFT JOIN {p} p{i} USING (assessment_id)" for i, p in enumerate(parts))
    cols = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return (
        "SELECT assessment_id, assess.tenant_id, assess.environment, assess.tier, "
        f"{cols} FROM assess{joins}"
    )


def _n(col: str) -> str:
    return f"CAST(coalesce({col}, 0) AS BIGINT)"


def _pct(part: str, whole: str) -> str:
    return (
        f"CASE WHEN coalesce({whole}, 0) = 0 THEN 100.0e0 "
        f"ELSE round(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0e0, 2) END"
    )


def _checks() -> dict[str, str]:
    q = {}
    q["Check01"] = _check(
        [f"""(SELECT a.assessment_id, count(*) AS n FROM {_in('tool_requests')}
        LEFT JOIN policy_decisions p ON x.request_hash = p.request_hash
        WHERE p.decision_id IS NULL GROUP BY 1)"""],
        count_tool_calls_without_policy_decision=_n("n"),
        assessment_window_days="window_days",
    )
    q["Check02"] = _check(
        [f"""(SELECT a.assessment_id, count(*) AS n FROM {_in('tool_requests')}
        WHERE coalesce(x.originating_identity, x.agent_instance_id)
          NOT IN (SELECT identity FROM gateway_identities) GROUP BY 1)"""],
        count_non_gateway_originated_calls=_n("n"),
    )
    q["Check03"] = _check(
        [_tally("tool_requests", total="true", verified="identity_verified")],
        count_tool_requests_total=_n("total"),
        count_tool_requests_with_verified_identity=_n("verified"),
        verified_identity_coverage_pct=_pct("verified", "total"),
        threshold_min_pct="100.0e0",
    )
    q["Check04"] = _check(
        [
            _tally("tool_requests", bare="tool_schema_hash IS NULL OR tool_schema_hash = ''"),
            _tally(
                "policy_decisions",
                rejects="decision = 'deny' AND reason = 'schema_validation_failed'",
            ),
        ],
        count_requests_missing_tool_schema_hash=_n("bare"),
        count_schema_validation_rejects=_n("rejects"),
    )
    q["Check05"] = _check(
        [
            _tally("ledger_events", total="true"),
            f"""(SELECT assessment_id, count(*) AS broken FROM (
            SELECT a.assessment_id, x.prev_event_hash, lag(x.event_hash) OVER (
              PARTITION BY a.assessment_id, x.sink_uri ORDER BY x.sequence_number) AS expected
            FROM {_in('ledger_events')}) o
            WHERE expected IS NOT NULL AND prev_event_hash <> expected GROUP BY 1)""",
        ],
        count_ledger_events=_n("total"),
        count_chain_breaks=_n("broken"),
    )
    q["Check06"] = _check(
        [_tally(
            "replay_traces", total="true",
            complete="model_id IS NOT NULL AND prompt_bundle_hash IS NOT NULL "
            "AND tool_schema_hash IS NOT NULL AND snapshot_uri IS NOT NULL",
        )],
        count_replay_traces_total=_n("total"),
        count_replay_traces_complete=_n("complete"),
        replay_trace_completeness_pct=_pct("complete", "total"),
        threshold_min_success_rate_pct="95.0e0",
    )
    q["Check07"] = _check(
        [_tally(
            "breaker_events", trips="event_type = 'breaker.trigger'",
            stops="event_type = 'stop.activation'",
        )],
        count_breaker_triggers=_n("trips"),
        count_stop_activations=_n("stops"),
        containment_slo_seconds="30.0e0",
    )
    q["Check08"] = _check(
        [_tally(
            "budget_events", enforced="event_type IN ('budget.throttle', 'budget.deny')",
            spent="event_type = 'budget.decrement'",
        )],
        count_budget_enforcement_events=_n("enforced"),
        count_budget_decrement_events=_n("spent"),
    )
    high = f"tool_category IN {HIGH} AND decision = 'allow'"
    q["Check09"] = _check(
        [_tally(
            "policy_decisions", total=high,
            signed=f"{high} AND signature_ref IS NOT NULL AND signing_key_id IS NOT NULL",
        )],
        count_high_impact_allows=_n("total"),
        count_high_impact_signed=_n("signed"),
        signature_coverage_pct=_pct("signed", "total"),
        threshold_min_pct="100.0e0",
    )
    read = "request_type = 'read'"
    q["Check10"] = _check(
        [
            _tally("memory_responses", total=read,
                   decided=f"{read} AND memory_decision_id IS NOT NULL"),
            _tally("memory_decisions", crossed="decision = 'deny' AND reason = 'cross_tenant_read'"),
        ],
        count_memory_reads=_n("total"),
        count_memory_reads_with_decision=_n("decided"),
        memory_decision_coverage_pct=_pct("decided", "total"),
        count_cross_tenant_denies=_n("crossed"),
    )
    q["Check11"] = _check(
        [
            _tally("memory_quarantine", held="true"),
            f"""(SELECT a.assessment_id, count(*) AS leaks FROM {_in('memory_responses')}
            JOIN memory_quarantine z ON x.item_id = z.item_id AND x.time >= z.time GROUP BY 1)""",
        ],
        count_quarantine_events=_n("held"),
        count_quarantine_leaks=_n("leaks"),
    )
    q["Check12"] = _check(
        [f"""(SELECT s.assessment_id, count(*) AS total,
          count(*) FILTER (WHERE p.run_id IS NOT NULL AND l.run_id IS NOT NULL) AS tied
        FROM (SELECT DISTINCT a.assessment_id, x.run_id FROM {_in('semantic_traces')}) s
        LEFT JOIN (SELECT DISTINCT run_id FROM policy_decisions) p ON p.run_id = s.run_id
        LEFT JOIN (SELECT DISTINCT run_id FROM ledger_events) l ON l.run_id = s.run_id
        GROUP BY 1)"""],
        count_semantic_runs=_n("total"),
        count_semantic_runs_correlated=_n("tied"),
        correlation_coverage_pct=_pct("tied", "total"),
    )
    q["Check13"] = _check(
        [
            _tally("policy_decisions",
                   bare="policy_bundle_hash IS NULL OR policy_bundle_hash = ''"),
            f"""(SELECT a.assessment_id, count(*) AS n FROM {_in('policy_decisions')}
            LEFT JOIN policy_bundles b ON b.bundle_hash = x.policy_bundle_hash
            WHERE b.bundle_hash IS NULL GROUP BY 1)""",
        ],
        count_decisions_missing_bundle_hash=_n("bare"),
        count_decisions_with_unknown_bundle_hash=_n("n"),
    )
    q["Check14"] = _check(
        [
            f"""(SELECT a.assessment_id, count(*) AS needed, count(*) FILTER (
              WHERE h.approval_id IS NOT NULL AND h.signature_ref IS NOT NULL) AS signed
            FROM {_in('policy_decisions')}
            LEFT JOIN hitl_decisions h ON h.policy_decision_id = x.decision_id
            WHERE x.obligations ILIKE '%hitl%' GROUP BY 1)""",
            f"""(SELECT a.assessment_id, count(*) AS ran FROM {_in('tool_responses')}
            JOIN policy_decisions p ON p.request_hash = x.request_hash
            LEFT JOIN hitl_decisions h ON h.policy_decision_id = p.decision_id
            WHERE p.obligations ILIKE '%hitl%'
              AND (h.approval_id IS NULL OR h.signature_ref IS NULL) GROUP BY 1)""",
        ],
        count_hitl_required=_n("needed"),
        count_hitl_signed_present=_n("signed"),
        hitl_signature_presence_pct=_pct("signed", "needed"),
        count_hitl_required_executed_without_approval=_n("ran"),
    )
    no = "validation_status = 'reject'"
    q["Check15"] = _check(
        [_tally("agent_messages", rejected=no, spoofed=f"{no} AND reason = 'spoofed_sender'",
                replayed=f"{no} AND reason = 'nonce_replay'")],
        count_envelope_rejects=_n("rejected"),
        count_spoofed_sender_rejects=_n("spoofed"),
        count_nonce_replay_rejects=_n("replayed"),
    )
    q["Check16"] = _check(
        [
            _tally("discovery_events", found="true"),
            f"""(SELECT a.assessment_id, count(*) AS strange FROM {_in('discovery_events')}
            LEFT JOIN classifier_bundles b ON b.bundle_hash = x.classifier_bundle_hash
            WHERE b.bundle_hash IS NULL GROUP BY 1)""",
            f"""(SELECT s.assessment_id, count(*) AS delta FROM (
              SELECT a.assessment_id, a.tenant_id, a.environment, a.as_of, x.agent_instance_id,
                min(x.time) AS first_seen
              FROM {_in('tool_requests')} GROUP BY ALL) s
            LEFT JOIN c04_inventory c ON c.agent_instance_id = s.agent_instance_id
            LEFT JOIN remediation_outcomes r ON r.owner_identity = s.agent_instance_id
              AND r.tenant_id = s.tenant_id AND r.environment = s.environment
              AND r.outcome = 'exception' AND r.exception_ttl_expires_at > s.as_of
            WHERE c.agent_instance_id IS NULL AND r.owner_identity IS NULL
              AND s.first_seen < s.as_of - INTERVAL '4' DAY GROUP BY 1)""",
        ],
        count_discovery_events=_n("found"),
        count_unknown_classifier_hashes=_n("strange"),
        reconciliation_delta_outside_ttl=_n("delta"),
        remediation_ttl_hours="72.0e0",
    )
    dims = ("confidence", "freshness", "provenance")
    denied = ", ".join(
        f"count(*) FILTER (WHERE json_extract_string(c.value, '$.{d}') = 'deny') AS {d}"
        for d in dims
    )
    need = (
        "CASE tier WHEN 'high_privilege' THEN ['confidence', 'freshness', 'provenance'] "
        "WHEN 'bounded' THEN ['confidence', 'freshness'] ELSE CAST([] AS VARCHAR[]) END"
    )
    have = "[x FOR x IN [" + ", ".join(
        f"CASE WHEN {d} > 0 THEN '{d}' END" for d in dims
    ) + "] IF x IS NOT NULL]"
    q["Check17"] = _check(
        [
            _tally("memory_responses", total=read,
                   gated=f"{read} AND quality_decision_id IS NOT NULL"),
            f"""(SELECT a.assessment_id, {denied} FROM assess a
            JOIN quality_bundles b ON b.tenant_id = a.tenant_id AND b.is_active
              AND json_valid(b.action_matrix),
            LATERAL (SELECT value FROM json_each(b.action_matrix, '$.' || a.tier)) c
            GROUP BY 1)""",
        ],
        count_memory_reads=_n("total"),
        count_memory_reads_with_quality_decision=_n("gated"),
        quality_decision_coverage_pct=_pct("gated", "total"),
        threshold_min_pct="100.0e0",
        enforced_dimensions=have,
        required_dimensions=need,
        missing_enforcement=f"[d FOR d IN {need} IF NOT list_contains({have}, d)]",
    )
    q["Check18"] = _check(
        [
            f"""(SELECT a.assessment_id, count(*) AS stale FROM assess a
            JOIN agent_state g ON g.tenant_id = a.tenant_id AND g.environment = a.environment
              AND g.autonomy_tier = a.tier AND g.state = 'Run'
            LEFT JOIN abom m ON m.agent_instance_id = g.agent_instance_id AND m.is_current
            LEFT JOIN baselines b ON b.baseline_hash = m.current_baseline_hash
            WHERE b.baseline_hash IS NULL OR b.created_at < a.as_of - INTERVAL '90' DAY
            GROUP BY 1)""",
            _tally("drift_decisions", drift="true"),
            f"""(SELECT assessment_id, count(*) AS gaps FROM (
              SELECT a.assessment_id, x.time, lag(x.time) OVER (
                PARTITION BY a.assessment_id, x.agent_instance_id, x.dimension
                ORDER BY x.time) AS before
              FROM {_in('drift_decisions')}) o
            WHERE time > before + INTERVAL '24' HOUR GROUP BY 1)""",
            f"""(SELECT a.assessment_id, count(*) AS acted FROM {_in('response_actions')}
            JOIN drift_decisions d ON d.event_id = x.drift_decision_id
            WHERE x.action IN ('tier_reduction', 'emergency_stop') GROUP BY 1)""",
        ],
        count_agents_without_active_signed_baseline_or_stale=_n("stale"),
        count_cadence_gaps_exceeding_threshold=_n("gaps"),
        count_drift_decision_events=_n("drift"),
        drift_cadence_threshold_hours="24.0e0",
        max_baseline_age_days="90.0e0",
        count_enforced_response_actions=_n("acted"),
    )
    double = (
        "event_type ILIKE '%adversarial_outcome%drift_decision%' "
        "OR event_type ILIKE '%drift_decision%adversarial_outcome%'"
    )
    q["Check19"] = _check(
        [
            _tally("drift_decisions", d=f"event_type = '{DRIFT_EVENT}'",
                   dx=f"event_type = '{ADVERSARIAL_EVENT}'", dd=double),
            _tally("adversarial_outcomes", v=f"event_type = '{ADVERSARIAL_EVENT}'",
                   vx=f"event_type = '{DRIFT_EVENT}'", vd=double),
        ],
        count_drift_decision_events=_n("d"),
        count_adversarial_outcome_events=_n("v"),
        count_crossover_drift_in_adversarial_table=_n("vx"),
        count_crossover_adversarial_in_drift_table=_n("dx"),
        count_event_type_double_tag=f"{_n('dd')} + {_n('vd')}",
        count_crossover_total=f"{_n('dx')} + {_n('vx')} + {_n('dd')} + {_n('vd')}",
    )
    return q


CHECK_SQL = _checks()

_RAISED = ("bounded", "high_privilege")
_ANY = ("sandbox", *_RAISED)
_TOP = ("high_privilege",)


def _rule(ok: str, good: str = "PASS") -> str:
    return f"CASE WHEN {ok} THEN '{good}' ELSE 'FAIL' END"


_VERDICTS = {
    "Check01": (_ANY, _rule("count_tool_calls_without_policy_decision = 0")),
    "Check02": (_RAISED, _rule("count_non_gateway_originated_calls = 0", "PARTIAL")),
    "Check03": (_ANY, _rule("verified_identity_coverage_pct >= 100")),
    "Check04": (_ANY, _rule(
        "count_requests_missing_tool_schema_hash = 0 AND count_schema_validation_rejects > 0")),
    "Check05": (_RAISED, _rule("count_chain_breaks = 0 AND count_ledger_events > 0")),
    "Check06": (_RAISED, _rule("count_replay_traces_total > 0", "PARTIAL")),
    "Check07": (_RAISED, "'PARTIAL'"),
    "Check08": (_ANY, _rule("count_budget_enforcement_events > 0")),
    "Check09": (_TOP, _rule("signature_coverage_pct >= 100")),
    "Check10": (_RAISED, _rule("memory_decision_coverage_pct = 100")),
    "Check11": (_RAISED, _rule("count_quarantine_leaks = 0", "PARTIAL")),
    "Check12": (_ANY, _rule("correlation_coverage_pct = 100")),
    "Check13": (_ANY, _rule(
        "count_decisions_missing_bundle_hash = 0 "
        "AND count_decisions_with_unknown_bundle_hash = 0")),
    "Check14": (_TOP, _rule("count_hitl_required_executed_without_approval = 0", "PARTIAL")),
    "Check15": (_TOP, "'PARTIAL'"),
    "Check16": (_ANY, "CASE WHEN tier = 'sandbox' THEN " + _rule(
        "count_discovery_events > 0 AND count_unknown_classifier_hashes = 0") + " ELSE " + _rule(
        "reconciliation_delta_outside_ttl = 0 AND count_unknown_classifier_hashes = 0", "PARTIAL")
        + " END"),
    "Check17": (_ANY, _rule(
        "quality_decision_coverage_pct >= 100 AND len(missing_enforcement) = 0", "PARTIAL")),
    "Check18": (_RAISED, _rule(
        "count_agents_without_active_signed_baseline_or_stale = 0 "
        "AND count_cadence_gaps_exceeding_threshold = 0 AND count_drift_decision_events > 0 "
        "AND (tier <> 'high_privilege' OR count_enforced_response_actions > 0)", "PARTIAL")),
    "Check19": (_RAISED, _rule(
        "count_drift_decision_events > 0 AND count_adversarial_outcome_events > 0 "
        "AND count_crossover_total = 0", "PARTIAL")),
}

# The one bundle whose tier entry is not an object would make Check17 an ERROR;
# none is planted in the views.
VERDICT_SQL = "\nUNION ALL ".join(
    f"SELECT '{c}' AS check_id, assessment_id, tier, CASE WHEN tier NOT IN "
    f"({', '.join(repr(t) for t in tiers)}) THEN 'SKIP' ELSE {rule} END AS status "
    f"FROM ({CHECK_SQL[c]}) v"
    for c, (tiers, rule) in _VERDICTS.items()
)

def _keys(table: str, key: str, where: str) -> str:
    return f"SELECT a.assessment_id, '{table}/' || coalesce({key}, '') AS ref FROM {_in(table)} WHERE {where}"


# check -> what counts against it: one text per sample, each giving (assessment_id, ref)
_OFFENDERS: dict[str, list[str]] = {
    "Check01": [f"""SELECT a.assessment_id, 'tool_requests/' || coalesce(x.request_hash, '') AS ref
      FROM {_in('tool_requests')} LEFT JOIN policy_decisions p ON x.request_hash = p.request_hash
      WHERE p.decision_id IS NULL"""],
    "Check02": [f"""SELECT a.assessment_id,
        'identity/' || coalesce(x.originating_identity, x.agent_instance_id) AS ref
      FROM {_in('tool_requests')} WHERE coalesce(x.originating_identity, x.agent_instance_id)
        NOT IN (SELECT identity FROM gateway_identities)"""],
    "Check03": [_keys("tool_requests", "request_hash", "identity_verified IS NOT true")],
    "Check04": [_keys("tool_requests", "request_hash", "coalesce(tool_schema_hash, '') = ''")],
    "Check05": [f"""SELECT assessment_id, 'ledger_events/' || sink_uri || '/' || sequence_number AS ref FROM (
        SELECT a.assessment_id, x.sink_uri, x.sequence_number, x.prev_event_hash,
          lag(x.event_hash) OVER (PARTITION BY a.assessment_id, x.sink_uri ORDER BY x.sequence_number)
            AS expected
        FROM {_in('ledger_events')}) o WHERE prev_event_hash <> expected"""],
    "Check06": [_keys("replay_traces", "trace_id", "model_id IS NULL OR prompt_bundle_hash IS NULL "
                      "OR tool_schema_hash IS NULL OR snapshot_uri IS NULL")],
    "Check09": [_keys("policy_decisions", "decision_id", f"tool_category IN {HIGH} AND decision = 'allow' "
                      "AND (signature_ref IS NULL OR signing_key_id IS NULL)")],
    "Check10": [_keys("memory_responses", "response_id",
                      "request_type = 'read' AND memory_decision_id IS NULL")],
    "Check11": [f"""SELECT a.assessment_id, 'memory_responses/' || x.item_id AS ref
      FROM {_in('memory_responses')}
      JOIN memory_quarantine z ON x.item_id = z.item_id AND x.time >= z.time"""],
    "Check12": [f"""SELECT s.assessment_id, 'semantic_traces/' || coalesce(s.run_id, '') AS ref
      FROM (SELECT DISTINCT a.assessment_id, x.run_id FROM {_in('semantic_traces')}) s
      WHERE s.run_id IS NULL OR s.run_id NOT IN (SELECT run_id FROM policy_decisions WHERE run_id IS NOT NULL)
        OR s.run_id NOT IN (SELECT run_id FROM ledger_events WHERE run_id IS NOT NULL)"""],
    "Check13": [
        _keys("policy_decisions", "decision_id", "coalesce(policy_bundle_hash, '') = ''"),
        f"""SELECT a.assessment_id, 'policy_bundle_hash/' || coalesce(x.policy_bundle_hash, '') AS ref
      FROM {_in('policy_decisions')} LEFT JOIN policy_bundles b ON b.bundle_hash = x.policy_bundle_hash
      WHERE b.bundle_hash IS NULL""",
    ],
    "Check14": [
        f"""SELECT a.assessment_id, 'policy_decisions/' || coalesce(x.decision_id, '') AS ref
      FROM {_in('policy_decisions')} LEFT JOIN hitl_decisions h ON h.policy_decision_id = x.decision_id
      WHERE x.obligations ILIKE '%hitl%' AND (h.approval_id IS NULL OR h.signature_ref IS NULL)""",
        f"""SELECT a.assessment_id, 'tool_responses/' || x.request_hash AS ref FROM {_in('tool_responses')}
      JOIN policy_decisions p ON p.request_hash = x.request_hash
      LEFT JOIN hitl_decisions h ON h.policy_decision_id = p.decision_id
      WHERE p.obligations ILIKE '%hitl%' AND (h.approval_id IS NULL OR h.signature_ref IS NULL)""",
    ],
    "Check15": [_keys("agent_messages", "message_id", "validation_status = 'reject'")],
    "Check16": [
        f"""SELECT a.assessment_id, 'classifier_bundle_hash/' || coalesce(x.classifier_bundle_hash, '') AS ref
      FROM {_in('discovery_events')} LEFT JOIN classifier_bundles b ON b.bundle_hash = x.classifier_bundle_hash
      WHERE b.bundle_hash IS NULL""",
        f"""SELECT s.assessment_id, 'agent_instance_id/' || s.agent_instance_id AS ref FROM (
        SELECT a.assessment_id, a.tenant_id, a.environment, a.as_of, x.agent_instance_id,
          min(x.time) AS first_seen FROM {_in('tool_requests')} GROUP BY ALL) s
      LEFT JOIN remediation_outcomes r ON r.owner_identity = s.agent_instance_id
        AND r.tenant_id = s.tenant_id AND r.environment = s.environment
        AND r.outcome = 'exception' AND r.exception_ttl_expires_at > s.as_of
      WHERE s.agent_instance_id NOT IN (SELECT agent_instance_id FROM c04_inventory)
        AND r.owner_identity IS NULL AND s.first_seen < s.as_of - INTERVAL '4' DAY""",
    ],
    "Check17": [_keys("memory_responses", "response_id",
                      "request_type = 'read' AND quality_decision_id IS NULL")],
    "Check18": [
        """SELECT a.assessment_id, 'baseline_hash/' || coalesce(m.current_baseline_hash, '') AS ref FROM assess a
      JOIN agent_state g ON g.tenant_id = a.tenant_id AND g.environment = a.environment
        AND g.autonomy_tier = a.tier AND g.state = 'Run'
      LEFT JOIN abom m ON m.agent_instance_id = g.agent_instance_id AND m.is_current
      LEFT JOIN baselines b ON b.baseline_hash = m.current_baseline_hash
      WHERE b.baseline_hash IS NULL OR b.created_at < a.as_of - INTERVAL '90' DAY""",
        f"""SELECT assessment_id, 'drift_decisions/' || agent_instance_id || '/' || dimension AS ref FROM (
        SELECT a.assessment_id, x.agent_instance_id, x.dimension, x.time, lag(x.time) OVER (
          PARTITION BY a.assessment_id, x.agent_instance_id, x.dimension ORDER BY x.time) AS before
        FROM {_in('drift_decisions')}) o WHERE time > before + INTERVAL '24' HOUR""",
    ],
    "Check19": [
        _keys("drift_decisions", "event_id", f"event_type = '{ADVERSARIAL_EVENT}' "
              "OR event_type ILIKE '%adversarial_outcome%drift_decision%' "
              "OR event_type ILIKE '%drift_decision%adversarial_outcome%'"),
        _keys("adversarial_outcomes", "event_id", f"event_type = '{DRIFT_EVENT}' "
              "OR event_type ILIKE '%adversarial_outcome%drift_decision%' "
              "OR event_type ILIKE '%drift_decision%adversarial_outcome%'"),
    ],
}

# Of each sample the reference of the lowest md5 in each of five slots.
REFS_SQL = f"""
SELECT assessment_id, check_id, status, ref FROM (
  SELECT check_id, assessment_id, source, ref, row_number() OVER (
    PARTITION BY check_id, assessment_id, source, CAST('0x' || substr(md5(ref), 1, 4) AS INT) % 5
    ORDER BY md5(ref)) AS place
  FROM (SELECT DISTINCT * FROM ({
    " UNION ALL ".join(
        f"SELECT '{c}' AS check_id, {i} AS source, assessment_id, ref FROM ({sql}) o"
        for c, texts in _OFFENDERS.items() for i, sql in enumerate(texts))
  }) u) d) s
JOIN ({VERDICT_SQL}) v USING (check_id, assessment_id)
WHERE place = 1 AND status <> 'SKIP'"""


def _steps_sql() -> str:
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    rows = ",\n".join(
        f"({quote(check)}, {quote(tier)}, {quote(step)}, {quote(proof)}, {quote(limit)})"
        for check, owed in OPEN_QUESTIONS.items() for tiers, limit, step, proof in owed for tier in tiers
    )
    return f"""
SELECT assessment_id, check_id, status, step, expected_artifact, CAST(row_number() OVER (
    PARTITION BY assessment_id, check_id ORDER BY step, expected_artifact, rationale) - 1 AS INT) AS step_no
FROM ({VERDICT_SQL}) v
JOIN (VALUES {rows}) s(check_id, tier, step, expected_artifact, rationale) USING (check_id, tier)
WHERE status <> 'SKIP'"""


_COUNT_METRICS = {
    c: [w for w in dict.fromkeys(sql.replace(",", " ").split()) if w.startswith("count_")]
    for c, sql in CHECK_SQL.items()
}

ROLLUP_SQL = "SELECT assessment_id, metric, CAST(sum(value) AS DOUBLE) AS value FROM (\n" + (
    "\nUNION ALL ".join(
        f"SELECT assessment_id, '{m}' AS metric, {m} AS value FROM ({CHECK_SQL[c]}) v "
        f"WHERE tier IN ({', '.join(repr(t) for t in _VERDICTS[c][0])})"
        for c, names in _COUNT_METRICS.items()
        for m in names
    )
) + ") u GROUP BY 1, 2"

_STATUS = ", ".join(
    f"count(*) FILTER (WHERE status = '{s}') AS n_{s.lower()}"
    for s in ("PASS", "FAIL", "PARTIAL", "ERROR", "SKIP")
)
STATUS_SQL = f"""
SELECT *, CASE WHEN n_fail + n_error > 0 THEN 'NON_CONFORMANT' WHEN n_partial > 0 THEN 'PARTIAL'
    ELSE 'CONFORMANT' END AS overall_status,
  n_pass AS must_pass_checks_passing, n_fail + n_error AS must_pass_checks_failing,
  n_partial AS open_partial_checks, n_fail + n_error > 0 AS run_failed
FROM (SELECT assessment_id, {_STATUS} FROM ({VERDICT_SQL}) s GROUP BY 1) t"""


REPORT_SQL = f"""
SELECT assessment_id, a.tenant_id, a.environment, a.tier AS autonomy_tier, s.run_failed,
  s.overall_status, s.n_pass + s.n_fail + s.n_partial + s.n_error + s.n_skip AS n_checks
FROM assess a JOIN ({STATUS_SQL}) s USING (assessment_id)"""


def _recent(alias: str, interval: str) -> str:
    return f"{alias}.environment = 'prod' AND {alias}.time >= {NOW} - INTERVAL {interval} AND {alias}.time < {NOW}"


CORRELATE_SQL = {
    "e01_unmatched_requests": f"""
SELECT x.run_id, x.trace_id, x.agent_instance_id, x.tool_name, x.request_hash,
  x.time AS request_time
FROM tool_requests x LEFT JOIN policy_decisions p ON x.request_hash = p.request_hash
WHERE p.decision_id IS NULL AND {_recent('x', "'30' DAY")}""",
    "e02_evidence_chain": """
SELECT x.time AS request_time, x.agent_instance_id, x.tool_name, x.tool_category, x.request_hash,
  p.decision_id, p.decision, p.reason_codes, p.policy_bundle_hash, r.response_hash,
  r.status AS tool_status, r.snapshot_uri, l.ledger_event_id, l.event_hash AS ledger_event_hash,
  l.prev_event_hash AS prev_ledger_hash, l.sink_uri AS worm_uri, z.step_index AS replay_step,
  z.step_type, s.intent AS semantic_intent, s.audit_ref AS semantic_audit_ref
FROM tool_requests x
LEFT JOIN policy_decisions p ON p.request_hash = x.request_hash AND p.run_id = x.run_id
LEFT JOIN tool_responses r ON r.run_id = x.run_id AND r.trace_id = x.trace_id
LEFT JOIN ledger_events l ON l.policy_decision_id = p.decision_id
LEFT JOIN replay_steps z ON z.run_id = x.run_id AND z.request_hash = x.request_hash
LEFT JOIN semantic_traces s ON s.run_id = x.run_id AND s.audit_ref = l.ledger_event_id
WHERE x.run_id IS NOT NULL""",
    "e03_ledger_integrity": """
SELECT ledger_event_id, sequence_number, prev_event_hash, prev_computed_hash,
  CASE WHEN prev_event_hash <> prev_computed_hash THEN 'HASH_CHAIN_BREAK'
    WHEN sequence_number <> prev_sequence + 1 THEN 'SEQUENCE_GAP' ELSE 'OK' END
    AS integrity_status
FROM (
  SELECT *, lag(event_hash) OVER w AS prev_computed_hash,
    lag(sequence_number) OVER w AS prev_sequence
  FROM ledger_events WHERE environment = 'prod'
  WINDOW w AS (PARTITION BY tenant_id ORDER BY sequence_number)) o
WHERE (prev_event_hash <> prev_computed_hash AND prev_event_hash <> 'GENESIS')
  OR sequence_number <> prev_sequence + 1""",
    "e04_risk_distribution": f"""
SELECT tool_category, count(*) AS total_decisions,
  round(avg(orm_risk_score), 3) AS avg_orm_score,
  round(quantile_disc(orm_risk_score, 0.5), 3) AS p50,
  round(quantile_disc(orm_risk_score, 0.9), 3) AS p90,
  round(quantile_disc(orm_risk_score, 0.95), 3) AS p95,
  round(quantile_disc(orm_risk_score, 0.99), 3) AS p99,
  count(*) FILTER (WHERE orm_risk_score >= 0.65) AS hitl_threshold_breaches,
  count(*) FILTER (WHERE orm_risk_score >= 0.85) AS block_threshold_breaches
FROM policy_decisions x WHERE {_recent('x', "'30' DAY")} GROUP BY 1""",
    "e05_hitl_audit": f"""
SELECT h.approval_id, h.run_id, h.tool_name, h.orm_risk_score, h.approver_id, h.action,
  h.justification, h.time AS decision_time,
  date_sub('second', p.time, h.time) AS seconds_to_approve,
  h.ledger_event_id, h.signature_ref IS NOT NULL AS is_signed
FROM hitl_decisions h LEFT JOIN policy_decisions p ON p.decision_id = h.policy_decision_id
WHERE {_recent('h', "'30' DAY")}""",
    "e06_approval_fatigue": f"""
SELECT * FROM (
  SELECT h.approver_id, count(*) AS total_decisions,
    count(*) FILTER (WHERE h.action = 'approve') AS approvals,
    count(*) FILTER (WHERE h.action = 'deny') AS denials,
    round(CAST(count(*) FILTER (WHERE h.action = 'approve') AS DOUBLE) / count(*) * 100, 1)
      AS approval_rate_pct,
    round(avg(date_sub('second', p.time, h.time)), 0) AS avg_seconds_to_decide
  FROM hitl_decisions h LEFT JOIN policy_decisions p ON p.decision_id = h.policy_decision_id
  WHERE {_recent('h', "'30' DAY")} GROUP BY 1) g
WHERE approval_rate_pct > 95 AND avg_seconds_to_decide < 30""",
    "e07_breaker_history": f"""
SELECT time AS triggered_at, agent_instance_id, trigger_cause, threshold_value, actual_value,
  containment_outcome, time_to_effective_stop_ms, affected_run_ids
FROM breaker_events x WHERE {_recent('x', "'90' DAY")}""",
    "e08_quarantine_review": """
SELECT time AS quarantined_at, memory_partition, document_ref, cause_codes, provenance_refs,
  detection_confidence, reviewed_by, review_outcome,
  date_sub('hour', time, reviewed_at) AS hours_to_review
FROM memory_quarantine WHERE environment = 'prod'""",
    "e09_spend_anomalies": f"""
SELECT run_id, agent_instance_id, sum(cost_usd) AS total_cost_usd, count(*) AS total_tool_calls,
  count(*) FILTER (WHERE tool_category IN {HIGH}) AS high_impact_calls,
  min(time) AS run_start, max(time) AS run_end,
  date_sub('second', min(time), max(time)) AS run_duration_seconds
FROM tool_requests x WHERE {_recent('x', "'7' DAY")} GROUP BY 1, 2
HAVING sum(cost_usd) > 5 OR count(*) > 100
  OR count(*) FILTER (WHERE tool_category IN {HIGH}) > 5""",
    "e10_unenrolled": f"""
SELECT c.agent_instance_id AS workload_identity,
  '{UNENROLLED_FINDING}' AS finding
FROM (SELECT DISTINCT agent_instance_id FROM tool_requests x WHERE {_recent('x', "'24' HOUR")}) c
WHERE NOT EXISTS (
    SELECT 1 FROM c04_inventory i WHERE i.agent_instance_id = c.agent_instance_id)
  AND NOT EXISTS (SELECT 1 FROM remediation_outcomes r
    WHERE r.workload_identity = c.agent_instance_id AND r.outcome = 'exception'
      AND r.exception_ttl_expires_at > {NOW})""",
    "e11_classifier_coverage": f"""
SELECT count(*) AS total_governed, count(s.identity) AS scanned,
  CAST(count(s.identity) AS DOUBLE) * 100.0e0 / nullif(count(*), 0) AS coverage_pct
FROM (SELECT DISTINCT agent_instance_id AS identity FROM tool_requests x
  WHERE {_recent('x', "'24' HOUR")}) g
LEFT JOIN (SELECT DISTINCT get_json_object(candidate_payload, '$.workload_identity') AS identity
  FROM discovery_events x WHERE {_recent('x', "'24' HOUR")}) s ON s.identity = g.identity""",
    "e12_quality_coverage": f"""
SELECT count(*) AS total_retrievals,
  count(quality_decision_id) AS retrievals_with_quality_decision,
  count(*) - count(quality_decision_id) AS retrievals_without_quality_decision,
  CAST(count(quality_decision_id) AS DOUBLE) * 100.0e0 / nullif(count(*), 0) AS coverage_pct
FROM memory_responses x WHERE request_type = 'read' AND {_recent('x', "'30' DAY")}""",
    "e13_unknown_quality_bundles": f"""
SELECT x.quality_bundle_hash, count(*) AS decisions_referencing_unknown_bundle
FROM quality_decisions x LEFT JOIN quality_bundles b ON b.bundle_hash = x.quality_bundle_hash
WHERE b.bundle_hash IS NULL AND {_recent('x', "'30' DAY")} GROUP BY 1""",
    "e14_baseline_currency": f"""
SELECT g.agent_instance_id, g.autonomy_tier,
  CASE WHEN b.created_at IS NULL THEN 'no_baseline'
    WHEN date_sub('day', b.created_at, {NOW}) > 90 THEN 'baseline_stale' ELSE 'ok' END AS finding,
  date_sub('day', b.created_at, {NOW}) AS baseline_age_days
FROM agent_state g
LEFT JOIN abom m ON m.agent_instance_id = g.agent_instance_id AND m.is_current
LEFT JOIN baselines b ON b.baseline_hash = m.current_baseline_hash
WHERE g.autonomy_tier IN ('bounded', 'high_privilege') AND g.state = 'Run'
  AND (b.baseline_hash IS NULL OR date_sub('day', b.created_at, {NOW}) > 90)""",
    "e15_cadence_gaps": f"""
SELECT agent AS agent_instance_id, dimension, before AS previous_time, time AS "current_time",
  date_sub('hour', before, time) AS gap_hours
FROM (SELECT get_json_object(payload, '$.agent_instance_id') AS agent, dimension, time,
    lag(time) OVER (PARTITION BY get_json_object(payload, '$.agent_instance_id'), dimension
      ORDER BY time) AS before
  FROM drift_decisions x WHERE {_recent('x', "'30' DAY")}) o
WHERE date_sub('hour', before, time) > 24""",
    "e16_event_type_distinction": f"""
SELECT (SELECT count(*) FROM drift_decisions x WHERE {_recent('x', "'30' DAY")})
    AS c19_drift_count,
  (SELECT count(*) FROM adversarial_outcomes x WHERE {_recent('x', "'30' DAY")})
    AS c16_adversarial_count,
  (SELECT count(*) FROM adversarial_outcomes WHERE event_type = '{DRIFT_EVENT}')
    + (SELECT count(*) FROM drift_decisions WHERE event_type = '{ADVERSARIAL_EVENT}')
    AS crossover_count""",
}

OUTAGE = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
BEFORE = ("2024-01-01 00:00:00", "2024-01-10 00:00:00")
_DURING = f"time >= TIMESTAMP_NTZ '{OUTAGE[0]}' AND time < TIMESTAMP_NTZ '{OUTAGE[1]}'"
_EARLIER = f"time >= TIMESTAMP_NTZ '{BEFORE[0]}' AND time < TIMESTAMP_NTZ '{BEFORE[1]}'"
_CAND = """
cand AS (SELECT tenant_id, environment, candidate_hash, min(time) AS first_seen,
    coalesce(bool_or(get_json_object(candidate_payload, '$.access')
      IN ('financial', 'infrastructure')), false) AS high_access
  FROM discovery_events GROUP BY 1, 2, 3),
done AS (SELECT tenant_id, environment, candidate_hash, min(time) AS resolved_at,
    arg_min(outcome, (time, outcome)) AS outcome
  FROM remediation_outcomes GROUP BY 1, 2, 3)"""
_AGENT_TABLES = (
    "abom", "agent_state", "breaker_events", "c04_inventory", "drift_decisions", "tool_requests",
)
_KINDS = ("policy_decisions", "ledger_events", "replay_traces", "semantic_traces")
AGENT = "agent-7"

_REPLAY = """
SELECT run_id, count(*) AS steps_total, count(*) FILTER (WHERE same) AS steps_matched,
  count(*) FILTER (WHERE NOT same) AS steps_mismatched,
  CASE WHEN bool_and(same) THEN 'PASS' ELSE 'FAIL' END AS replay_status
FROM (SELECT coalesce(r.run_id, y.run_id) AS run_id,
    r.run_id IS NOT NULL AND y.run_id IS NOT NULL
      AND r.request_hash IS NOT DISTINCT FROM y.request_hash
      AND r.response_hash IS NOT DISTINCT FROM y.response_hash AS same
  FROM replay_steps r FULL JOIN replayed_steps y
    ON y.run_id = r.run_id AND y.step_index = r.step_index) c
GROUP BY 1"""

_CONTAIN = """
SELECT b.tenant_id, b.environment, b.agent_instance_id, b.time AS triggered_at,
  count(c.time) AS calls_after, max(c.time) AS last_call_at,
  coalesce(max(CAST(date_diff('microsecond', b.time, c.time) AS DOUBLE) / 1000000), 0)
    AS containment_seconds,
  coalesce(max(CAST(date_diff('microsecond', b.time, c.time) AS DOUBLE) / 1000000), 0) <= 5
    AS met_slo
FROM (SELECT *, lead(time) OVER (
      PARTITION BY tenant_id, environment, agent_instance_id ORDER BY time) AS next_time
    FROM (SELECT DISTINCT tenant_id, environment, agent_instance_id, time FROM breaker_events
      WHERE event_type = 'breaker.trigger' AND agent_instance_id IS NOT NULL) t) b
LEFT JOIN tool_requests c ON c.agent_instance_id = b.agent_instance_id AND c.time >= b.time
  AND c.tenant_id = b.tenant_id AND c.environment = b.environment
  AND (b.next_time IS NULL OR c.time < b.next_time)
  AND c.tool_category IN
    ('reversible_write', 'financial', 'irreversible_write', 'infrastructure')
  AND c.decision IS DISTINCT FROM 'deny'
GROUP BY 1, 2, 3, 4"""

_OF_AGENT = f"= '{AGENT}'"
_RUN_TABLES = (
    "hitl_decisions", "ledger_events", "memory_responses", "policy_decisions", "replay_steps",
    "replay_traces", "semantic_traces", "tool_responses",
)
_AGENT_ROWS = (
    {t: f"agent_instance_id {_OF_AGENT}" for t in _AGENT_TABLES}
    | {"agent_messages": f"sender_id {_OF_AGENT}"}
    | {t: f"workload_identity {_OF_AGENT}" for t in ("discovery_events", "remediation_outcomes")}
    | {
        t: f"run_id IN (SELECT run_id FROM tool_requests WHERE agent_instance_id {_OF_AGENT})"
        for t in _RUN_TABLES
    }
)

RUNBOOK_SQL = {
    "d01_bundle_onset": f"""
SELECT policy_bundle_hash, min(time) AS first_seen, count(*) AS decisions
FROM policy_decisions x WHERE {_recent('x', "'240' HOUR")}
GROUP BY 1 ORDER BY 2 DESC LIMIT 5""",
    "d02_locate_runs": f"""
SELECT run_id, trace_id, agent_instance_id, min(time) AS run_start
FROM tool_requests x WHERE {_recent('x', "'24' HOUR")}
  AND (tool_category IN {HIGH} OR decision = 'invariant_halt')
GROUP BY 1, 2, 3 ORDER BY 4 DESC LIMIT 20""",
    "d03_hitl_denied": f"""
SELECT run_id, tool_name, time, reason_codes FROM policy_decisions
WHERE environment = 'prod' AND list_contains(reason_codes, 'HITL_REQUIRED') AND decision = 'deny'
  AND time BETWEEN TIMESTAMP_NTZ '{OUTAGE[0]}' AND TIMESTAMP_NTZ '{OUTAGE[1]}'""",
    "d04_active_runs": f"""
SELECT run_id, min(time) AS run_start, max(time) AS last_activity FROM tool_requests
WHERE agent_instance_id LIKE 'agent-1%' AND environment = 'prod'
  AND time > {NOW} - INTERVAL '24' HOUR AND time < {NOW} GROUP BY 1""",
    "d05_last_good_bundle": f"""
SELECT tenant_id, environment,
  arg_max(policy_bundle_hash, (time, policy_bundle_hash)) AS policy_bundle_hash,
  max(time) AS last_used
FROM policy_decisions WHERE policy_bundle_hash IS NOT NULL
  AND time < TIMESTAMP_NTZ '{OUTAGE[0]}' GROUP BY 1, 2""",
    "d06_incident_counts": "WITH halted AS (SELECT DISTINCT run_id FROM tool_requests "
    "WHERE decision = 'invariant_halt')\n" + "\nUNION ALL ".join(
        f"SELECT '{k}' AS kind, count(*) AS n_rows FROM {k} "
        "WHERE run_id IN (SELECT run_id FROM halted)" for k in _KINDS
    ) + """
UNION ALL SELECT 'breaker_events' AS kind, count(*) AS n_rows FROM breaker_events
WHERE affected_run_ids[1] IN (SELECT run_id FROM halted)""",
    "d07_replay_completeness": """
SELECT coalesce(s.trace_id, r.trace_id) AS trace_id, coalesce(steps, 0) AS steps,
  coalesce(no_request, 0) AS calls_without_request_hash,
  coalesce(no_response, 0) AS calls_without_response_hash,
  coalesce(no_snapshot, 0) AS calls_without_snapshot,
  coalesce(no_rule, 0) AS halts_without_rule, coalesce(records, 0) AS records,
  coalesce(no_model, 0) AS records_without_model_id,
  coalesce(no_prompt, 0) AS records_without_prompt_bundle_hash,
  coalesce(no_schema, 0) AS records_without_tool_schema_hash,
  coalesce(well_stepped, true) AND coalesce(pinned, false) AS is_complete
FROM (SELECT trace_id, count(*) AS steps,
    count(*) FILTER (WHERE step_type = 'tool_call' AND request_hash IS NULL) AS no_request,
    count(*) FILTER (WHERE step_type = 'tool_call' AND response_hash IS NULL) AS no_response,
    count(*) FILTER (WHERE step_type = 'tool_call' AND snapshot_uri IS NULL) AS no_snapshot,
    count(*) FILTER (WHERE step_type = 'invariant_halt' AND invariant_rule_id IS NULL) AS no_rule,
    bool_and(CASE step_type
      WHEN 'tool_call' THEN request_hash IS NOT NULL AND response_hash IS NOT NULL
        AND snapshot_uri IS NOT NULL
      WHEN 'invariant_halt' THEN invariant_rule_id IS NOT NULL ELSE true END) AS well_stepped
  FROM replay_steps GROUP BY 1) s
FULL JOIN (SELECT trace_id, count(*) AS records,
    count(*) FILTER (WHERE model_id IS NULL) AS no_model,
    count(*) FILTER (WHERE prompt_bundle_hash IS NULL) AS no_prompt,
    count(*) FILTER (WHERE tool_schema_hash IS NULL) AS no_schema,
    bool_and(model_id IS NOT NULL AND prompt_bundle_hash IS NOT NULL
      AND tool_schema_hash IS NOT NULL) AS pinned
  FROM replay_traces GROUP BY 1) r ON s.trace_id IS NOT DISTINCT FROM r.trace_id""",
    "d08_replay_compare": _REPLAY,
    "d08_replay_success": f"""
SELECT count(*) AS runs, count(*) FILTER (WHERE replay_status = 'PASS') AS runs_passed,
  round(CAST(count(*) FILTER (WHERE replay_status = 'PASS') AS DOUBLE) / count(*) * 100, 2)
    AS success_rate_pct,
  round(CAST(count(*) FILTER (WHERE replay_status = 'PASS') AS DOUBLE) / count(*) * 100, 2) >= 95
    AS met
FROM ({_REPLAY}) r""",
    "d09_containment": _CONTAIN,
    "d09_containment_rate": f"""
SELECT count(*) AS triggers, count(*) FILTER (WHERE met_slo) AS met,
  round(CAST(count(*) FILTER (WHERE met_slo) AS DOUBLE) / count(*) * 100, 2) AS met_pct
FROM ({_CONTAIN}) c""",
    "d10_ttl_ladder": f"""
WITH {_CAND.strip()},
open_ AS (SELECT c.*, CASE WHEN high_access THEN 24.0e0 ELSE 72.0e0 END AS ttl_hours,
    CAST(date_diff('microsecond', first_seen, {NOW}) AS DOUBLE) / 3600000000 AS hours
  FROM cand c WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.tenant_id = c.tenant_id
    AND d.environment = c.environment AND d.candidate_hash = c.candidate_hash
    AND d.resolved_at <= {NOW}))
SELECT tenant_id, environment, candidate_hash, first_seen, ttl_hours,
  round(hours / ttl_hours, 4) AS elapsed_ratio,
  CASE WHEN hours >= ttl_hours THEN 'terminate' WHEN hours >= ttl_hours * 0.75 THEN 'escalate'
    WHEN hours >= ttl_hours * 0.5 THEN 'alert' ELSE 'wait' END AS ladder
FROM open_""",
    "d11_time_to_remediation": f"""
WITH {_CAND.strip()}
SELECT tenant_id, environment, candidate_hash, outcome,
  date_sub('second', first_seen, resolved_at) AS time_to_remediation_seconds
FROM cand JOIN done USING (tenant_id, environment, candidate_hash)""",
    "d12_quality_timeline": f"""
SELECT time_bucket(INTERVAL '1' HOUR, time) AS slot_start, count(*) AS reads,
  count(*) - count(quality_decision_id) AS unevaluated,
  round(CAST(count(quality_decision_id) AS DOUBLE) / count(*) * 100, 2) AS coverage_pct
FROM memory_responses WHERE request_type = 'read' AND {_DURING} GROUP BY 1""",
    "d13_downstream_calls": f"""
SELECT x.run_id, x.request_hash, x.tool_name, x.time AS call_time, max(r.time) AS read_at
FROM tool_requests x JOIN (SELECT run_id, time FROM memory_responses
    WHERE request_type = 'read' AND quality_decision_id IS NULL AND {_DURING}) r
  ON r.run_id = x.run_id AND r.time <= x.time AND x.time <= r.time + INTERVAL '86400' SECOND
GROUP BY 1, 2, 3, 4""",
    "d14_abom_mismatch": """
SELECT i.agent_instance_id, i.tenant_id, i.environment, i.current_abom_hash,
  m.current_baseline_hash AS baseline_hash, b.abom_hash AS baseline_abom_hash
FROM c04_inventory i JOIN abom m ON m.agent_instance_id = i.agent_instance_id AND m.is_current
JOIN baselines b ON b.baseline_hash = m.current_baseline_hash
WHERE i.current_abom_hash <> b.abom_hash""",
    "d15_retrieval_shift": f"""
WITH per AS (SELECT tenant_id, environment, content_class,
    count(*) FILTER (WHERE {_EARLIER}) AS reads_1, count(*) FILTER (WHERE {_DURING}) AS reads_2,
    CAST(count(*) FILTER (WHERE {_EARLIER} AND freshness_flag) AS DOUBLE) AS f1,
    CAST(count(*) FILTER (WHERE {_DURING} AND freshness_flag) AS DOUBLE) AS f2
  FROM memory_responses
  WHERE request_type = 'read' AND (({_EARLIER}) OR ({_DURING})) GROUP BY 1, 2, 3),
rated AS (SELECT *,
    coalesce(reads_1 / nullif(CAST(sum(reads_1) OVER w AS DOUBLE), 0), 0) AS s1,
    coalesce(reads_2 / nullif(CAST(sum(reads_2) OVER w AS DOUBLE), 0), 0) AS s2,
    coalesce(f1 / nullif(reads_1, 0), 0) AS r1, coalesce(f2 / nullif(reads_2, 0), 0) AS r2
  FROM per WINDOW w AS (PARTITION BY tenant_id, environment))
SELECT tenant_id, environment, content_class, reads_1, reads_2, round(s1, 6) AS share_1,
  round(s2, 6) AS share_2, round(s2 - s1, 6) AS share_change,
  round(r2 - r1, 6) AS flag_rate_change
FROM rated""",
    "d16_chain_links": """
SELECT run_id, count(*) AS traces, count(l) AS logged, count(d) AS decided, count(q) AS requested,
  count(z) AS replayed,
  count(l) = count(*) AND count(d) = count(*) AND count(q) = count(*) AND count(z) = count(*)
    AS chain_resolved
FROM (SELECT s.run_id, l.ledger_event_id AS l, p.decision_id AS d, x.request_hash AS q,
    z.request_hash AS z
  FROM semantic_traces s
  LEFT JOIN ledger_events l ON l.ledger_event_id = s.audit_ref
  LEFT JOIN policy_decisions p ON p.decision_id = l.policy_decision_id
  LEFT JOIN tool_requests x ON x.request_hash = p.request_hash
  LEFT JOIN replay_steps z ON z.request_hash = p.request_hash
  WHERE s.run_id IS NOT NULL) c
GROUP BY 1""",
    "d17_envelope_audit": """
SELECT tenant_id, environment, count(*) AS messages, count(*) FILTER (WHERE rn > 1) AS nonce_reused,
  count(*) FILTER (WHERE expires_at < time) AS expired_when_sent
FROM (SELECT *, row_number() OVER (
    PARTITION BY tenant_id, environment, sender_id, nonce ORDER BY time) AS rn
  FROM agent_messages) m
GROUP BY 1, 2""",
    "d17_envelope_offences": """
SELECT tenant_id, environment, sender_id, nonce, message_id, time, 'nonce_reused' AS reason
FROM (SELECT *, row_number() OVER (
    PARTITION BY tenant_id, environment, sender_id, nonce ORDER BY time, message_id) AS rn
  FROM agent_messages WHERE sender_id IS NOT NULL AND nonce IS NOT NULL) m WHERE rn > 1
UNION ALL
SELECT tenant_id, environment, sender_id, nonce, message_id, time, 'expired_when_sent'
FROM agent_messages WHERE expires_at < time""",
    "d18_archive_counts": "\nUNION ALL ".join(
        f"SELECT '{t}' AS kind, count(*) AS n_rows FROM {t} WHERE {by}" for t, by in _AGENT_ROWS.items()
    ),
    "d18_archive_runs": "\nUNION ALL ".join(
        f"SELECT '{t}' AS kind, run_id, count(*) AS n_rows FROM {t} WHERE {by} GROUP BY run_id"
        for t, by in _AGENT_ROWS.items()
        if t in _RUN_TABLES or t == "tool_requests"
    ),
}


# Streams report what lies before the watermark: the latest event time seen,
# less the delay; of two inputs the earlier one counts.
_LAG = "INTERVAL '10' MINUTE"
_ASKED = f"(SELECT max(time) - {_LAG} FROM tool_requests)"
_BOTH = f"least({_ASKED}, (SELECT max(time) - {_LAG} FROM policy_decisions))"

WATCH_FROM = "2024-01-01 00:00:00"
DIMENSIONS = ("dim-0", "dim-1")


def _silence_sql(horizon: str, within: str) -> str:
    """Silences up to ``horizon``, open ones included; running agents count as heard of at first."""
    dims = ", ".join(f"('{d}')" for d in DIMENSIONS)
    return f"""
SELECT tenant_id, environment, agent_instance_id, dimension, time AS silent_since,
  coalesce(bool_or(made) OVER (PARTITION BY tenant_id, environment, agent_instance_id, dimension
    ORDER BY time RANGE UNBOUNDED PRECEDING), false) AS ever_reported
FROM (SELECT *, lead(time) OVER (PARTITION BY tenant_id, environment, agent_instance_id, dimension
    ORDER BY time) AS after
  FROM (SELECT tenant_id, environment, agent_instance_id, dimension, time, true AS made
      FROM drift_decisions WHERE time >= TIMESTAMP_NTZ '{WATCH_FROM}' AND {within}
    UNION ALL SELECT DISTINCT tenant_id, environment, agent_instance_id, dim, TIMESTAMP_NTZ '{WATCH_FROM}', false
      FROM agent_state, (VALUES {dims}) d(dim) WHERE state = 'Run') u) l
QUALIFY coalesce(after, {horizon}) > time + INTERVAL '24' HOUR"""


STREAM_SQL = {
    "s01_undecided_requests": f"""
SELECT x.tenant_id, x.environment, x.request_hash, x.time AS request_time
FROM tool_requests x
WHERE NOT EXISTS (SELECT 1 FROM policy_decisions p WHERE p.request_hash = x.request_hash
    AND p.time >= x.time - INTERVAL '10' MINUTE AND p.time <= x.time + INTERVAL '10' MINUTE)
  AND (x.request_hash IS NULL OR x.time + INTERVAL '10' MINUTE < {_BOTH})""",
    # By the batch definition: the row before is found by lag over the whole chain.
    "s02_ledger_faults": f"""
WITH seqs AS (SELECT tenant_id, environment, sink_uri, sequence_number,
    lag(sequence_number) OVER (PARTITION BY tenant_id, environment, sink_uri
      ORDER BY sequence_number) AS before
  FROM (SELECT DISTINCT tenant_id, environment, sink_uri, sequence_number FROM ledger_events) d)
SELECT * FROM (
  SELECT x.tenant_id, x.environment, x.sink_uri, x.sequence_number, x.time AS row_time,
    CASE WHEN s.before + 1 < x.sequence_number THEN 'SEQUENCE_GAP'
      WHEN s.before IS NOT NULL AND x.prev_event_hash <> 'GENESIS' AND NOT EXISTS (
        SELECT 1 FROM ledger_events p WHERE p.tenant_id = x.tenant_id
          AND p.environment = x.environment AND p.sink_uri = x.sink_uri
          AND p.sequence_number = s.before AND p.event_hash = x.prev_event_hash)
      THEN 'HASH_CHAIN_BREAK' END AS fault
  FROM ledger_events x JOIN seqs s ON s.tenant_id = x.tenant_id
    AND s.environment = x.environment AND s.sink_uri = x.sink_uri
    AND s.sequence_number = x.sequence_number
  WHERE x.time + INTERVAL '1' HOUR < (SELECT max(time) - {_LAG} FROM ledger_events)) f
WHERE fault IS NOT NULL""",
    "s03_ttl_alerts": f"""
WITH {_CAND.strip()},
due AS (SELECT c.*, r.rung, c.first_seen + r.share * CASE WHEN high_access THEN 24 ELSE 72 END
    * INTERVAL '60' MINUTE AS alert_at
  FROM cand c, (VALUES ('alert', 0.5), ('escalate', 0.75), ('terminate', 1.0)) r(rung, share)),
mark AS (SELECT greatest((SELECT max(time) FROM discovery_events WHERE candidate_hash IS NOT NULL),
    (SELECT max(time) FROM remediation_outcomes WHERE candidate_hash IS NOT NULL)) - {_LAG} AS at)
SELECT d.tenant_id, d.environment, d.candidate_hash, d.rung, d.alert_at FROM due d, mark
WHERE d.alert_at < mark.at AND NOT EXISTS (SELECT 1 FROM remediation_outcomes o
    WHERE o.tenant_id = d.tenant_id AND o.environment = d.environment
      AND o.candidate_hash = d.candidate_hash AND o.time <= d.alert_at)""",
    "s04_quality_timeline": f"""
SELECT time_bucket(INTERVAL '1' HOUR, time) AS slot_start, count(*) AS reads,
  count(*) - count(quality_decision_id) AS unevaluated,
  round(CAST(count(quality_decision_id) AS DOUBLE) / count(*) * 100, 2) AS coverage_pct
FROM memory_responses WHERE request_type = 'read'
GROUP BY 1 HAVING time_bucket(INTERVAL '1' HOUR, time) + INTERVAL '1' HOUR
  <= (SELECT max(time) - {_LAG} FROM memory_responses WHERE request_type = 'read')""",
    "s05_drift_silence": f"""
SELECT tenant_id, environment, agent_instance_id, dimension, max(time) AS silent_since,
  count(*) AS decisions
FROM (SELECT *, sum(CASE WHEN before IS NULL OR time > before + INTERVAL '24' HOUR THEN 1 ELSE 0
      END) OVER (PARTITION BY tenant_id, environment, agent_instance_id, dimension ORDER BY time)
      AS session_no
  FROM (SELECT *, lag(time) OVER (PARTITION BY tenant_id, environment, agent_instance_id,
      dimension ORDER BY time) AS before FROM drift_decisions) l) n
GROUP BY 1, 2, 3, 4, session_no
HAVING max(time) + INTERVAL '24' HOUR < (SELECT max(time) - {_LAG} FROM drift_decisions)""",
    "s05_silence_alerts": _silence_sql(f"(SELECT max(time) - {_LAG} FROM drift_decisions)", "true"),
    "s06_spend_anomalies": f"""
SELECT w AS window_start, run_id, agent_instance_id, sum(cost_usd) AS total_cost_usd,
  count(*) AS total_tool_calls,
  count(*) FILTER (WHERE tool_category IN {HIGH}) AS high_impact_calls
FROM (SELECT *, unnest([time_bucket(INTERVAL '6' HOUR, time) - i * INTERVAL '6' HOUR
    FOR i IN [0, 1, 2, 3]]) AS w FROM tool_requests) x
GROUP BY 1, 2, 3
HAVING (sum(cost_usd) > 5 OR count(*) > 100
    OR count(*) FILTER (WHERE tool_category IN {HIGH}) > 5)
  AND w + INTERVAL '24' HOUR <= {_ASKED}""",
    "s07_nonce_alerts": """
SELECT tenant_id, environment, sender_id, nonce, min(time) AS first_use,
  min(time) FILTER (WHERE place = 2) AS replayed_at
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, environment, sender_id, nonce, session_no
      ORDER BY time) AS place
  FROM (SELECT *, sum(CASE WHEN before IS NULL OR time > before + INTERVAL '24' HOUR THEN 1 ELSE 0
      END) OVER (PARTITION BY tenant_id, environment, sender_id, nonce ORDER BY time
      ROWS UNBOUNDED PRECEDING) AS session_no
    FROM (SELECT *, lag(time) OVER (PARTITION BY tenant_id, environment, sender_id, nonce
        ORDER BY time) AS before FROM agent_messages
      WHERE nonce IS NOT NULL AND sender_id IS NOT NULL) l) n) r
GROUP BY 1, 2, 3, 4, session_no
HAVING count(*) > 1""",
    "s07_nonce_replays": f"""
SELECT tenant_id, environment, sender_id, nonce, min(time) AS first_use, max(time) AS last_use,
  count(*) AS uses
FROM (SELECT *, sum(CASE WHEN before IS NULL OR time > before + INTERVAL '24' HOUR THEN 1 ELSE 0
      END) OVER (PARTITION BY tenant_id, environment, sender_id, nonce ORDER BY time
      ROWS UNBOUNDED PRECEDING) AS session_no
  FROM (SELECT *, lag(time) OVER (PARTITION BY tenant_id, environment, sender_id, nonce
      ORDER BY time) AS before FROM agent_messages
    WHERE nonce IS NOT NULL AND sender_id IS NOT NULL) l) n
GROUP BY 1, 2, 3, 4, session_no
HAVING count(*) > 1 AND max(time) + INTERVAL '24' HOUR < (SELECT max(time) - {_LAG} FROM agent_messages)""",
}


def all_sql() -> dict[str, str]:
    texts = {f"q{c[-2:]}_metrics": sql for c, sql in CHECK_SQL.items()}
    texts["verdicts"] = VERDICT_SQL
    texts["r01_metric_rollup"] = ROLLUP_SQL
    texts["r02_status_counts"] = STATUS_SQL
    texts["r09_rollup"] = f"""
SELECT tenant_id, environment, metric, sum(value) AS value,
  CAST(grouping_id(tenant_id, environment, metric) AS BIGINT) AS level
FROM ({ROLLUP_SQL}) r JOIN assess USING (assessment_id)
WHERE metric NOT IN ('count_semantic_runs', 'count_semantic_runs_correlated')
GROUP BY GROUPING SETS ((tenant_id, environment, metric), (tenant_id, metric), (metric))"""
    texts["r03_evidence_refs"] = REFS_SQL
    texts["r05_report"] = REPORT_SQL
    texts["r05_report_steps"] = _steps_sql()
    texts["r05_report_checks"] = f"SELECT check_id, assessment_id, status FROM ({VERDICT_SQL}) v"
    texts["r05_report_metrics"] = ROLLUP_SQL
    texts["e04_risk_distribution_exact"] = CORRELATE_SQL["e04_risk_distribution"]
    texts["e04_risk_from_sketches"] = (
        "SELECT tool_category, total_decisions, avg_orm_score, hitl_threshold_breaches, "
        f"block_threshold_breaches, true AS ranks_hold FROM ({CORRELATE_SQL['e04_risk_distribution']}) r"
    )
    texts["e15_agent_silence"] = _silence_sql(NOW, f"time < {NOW}")
    texts |= CORRELATE_SQL | RUNBOOK_SQL | STREAM_SQL
    return {name: duckdb(sql) for name, sql in texts.items()}

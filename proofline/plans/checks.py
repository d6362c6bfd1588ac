"""The nineteen checks: what each needs, its metrics and its verdict rule.

Metrics, verdicts and findings are Spark SQL expressions over the raw counts
and the columns of the assessment.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from proofline.functions import vocab

ALL = vocab.TIERS
RAISED = ("bounded", "high_privilege")
TOP = ("high_privilege",)


@dataclass(frozen=True)
class Check:
    check_id: str
    control: str
    classification: str
    tiers: tuple[str, ...]
    title: str
    metrics: dict[str, str]
    status: str
    finding: str
    counts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    shaped: tuple[str, ...] = ()
    error: str = "cast(null as string)"

    @property
    def refs(self) -> dict[str, tuple[str, ...]]:
        """Which samples of offending keys tell what counts against the control."""
        return REFS.get(self.check_id, {})


# check -> source of counts -> samples taken there
REFS: dict[str, dict[str, tuple[str, ...]]] = {
    "Check01": {"unmatched_requests": ("unmatched_requests",)},
    "Check02": {"foreign_callers": ("foreign_callers",)},
    "Check03": {"tool_requests": ("requests_unverified",)},
    "Check04": {"tool_requests": ("requests_without_schema",)},
    "Check05": {"ledger_breaks": ("chain_breaks",)},
    "Check06": {"replay_traces": ("replay_traces_incomplete",)},
    "Check09": {"policy_decisions": ("high_impact_unsigned",)},
    "Check10": {"memory_responses": ("memory_reads_undecided",)},
    "Check11": {"quarantine_leaks": ("quarantine_leaks",)},
    "Check12": {"correlated_runs": ("semantic_runs",)},
    "Check13": {
        "policy_decisions": ("decisions_without_bundle",), "unknown_policy_bundles": ("unknown_bundles",),
    },
    "Check14": {
        "approvals_present": ("approvals_needed",), "executed_unapproved": ("executed_unapproved",),
    },
    "Check15": {"agent_messages": ("rejects",)},
    "Check16": {"unknown_classifiers": ("unknown_classifiers",), "unenrolled_agents": ("unenrolled_agents",)},
    "Check17": {"memory_responses": ("memory_reads_ungated",)},
    "Check18": {"stale_baselines": ("stale_baselines",), "cadence_gaps": ("cadence_gaps",)},
    "Check19": {"drift_decisions": ("drift_apart",), "adversarial_outcomes": ("adversarial_apart",)},
}


def _pct(part: str, whole: str) -> str:
    ratio = f"cast({part} as double) / nullif(cast({whole} as double), 0d) * 100d"
    return f"if({whole} = 0, 100d, round({ratio}, 2))"


def _ok(cond: str, good: str = "PASS") -> str:
    return f"if({cond}, '{good}', 'FAIL')"


def _none(*names: str) -> str:
    return " and ".join(f"{n} = 0" for n in names)


def _say(text: str, *names: str) -> str:
    return f"format_string('{text}', {', '.join(names)})"


def _array(items) -> str:
    return "cast(array(" + ", ".join(items) + ") as array<string>)"


REQUIRED = (
    "case tier "
    + " ".join(
        f"when '{t}' then {_array(repr(d) for d in dims)}"
        for t, dims in vocab.REQUIRED_DIMENSIONS.items()
    )
    + " end"
)
ENFORCED = (
    "filter("
    + _array(f"if(denies_{d} > 0, '{d}', null)" for d in vocab.QUALITY_DIMENSIONS)
    + ", d -> d is not null)"
)
MISSING = f"array_except({REQUIRED}, {ENFORCED})"
DOUBLE_TAGS = "drift_double + adversarial_double"
CROSSED = f"adversarial_crossed + drift_crossed + {DOUBLE_TAGS}"

# Ids, controls, classes, tiers and metric names are fixed values.
CHECKS: tuple[Check, ...] = (
    Check(
        "Check01", "C05", "AUTOMATED", ALL, "Every tool request has a policy decision",
        {
            "count_tool_calls_without_policy_decision": "unmatched_requests",
            "assessment_window_days": "window_days",
        },
        _ok(_none("unmatched_requests")),
        _say("%d request(s) without a decision in %d days", "unmatched_requests", "window_days"),
        shaped=("unmatched_requests",),
    ),
    Check(
        "Check02", "C05", "PARTIAL", RAISED, "Tools are reached through the gateway only",
        {"count_non_gateway_originated_calls": "foreign_callers"},
        _ok(_none("foreign_callers"), "PARTIAL"),
        _say("%d request(s) from callers outside the gateway list", "foreign_callers"),
        shaped=("foreign_callers",),
    ),
    Check(
        "Check03", "C01", "AUTOMATED", ALL, "Requests carry a verified identity",
        {
            "count_tool_requests_total": "requests",
            "count_tool_requests_with_verified_identity": "requests_verified",
            "verified_identity_coverage_pct": _pct("requests_verified", "requests"),
            "threshold_min_pct": "min_attestation_coverage_pct",
        },
        _ok(_pct("requests_verified", "requests") + " >= min_attestation_coverage_pct"),
        _say("%d of %d requests verified", "requests_verified", "requests"),
        counts={"tool_requests": ("requests", "requests_verified")},
    ),
    Check(
        "Check04", "C05", "AUTOMATED", ALL, "Tool inputs are validated against a schema",
        {
            "count_requests_missing_tool_schema_hash": "requests_without_schema",
            "count_schema_validation_rejects": "schema_rejects",
        },
        _ok("requests_without_schema = 0 and schema_rejects > 0"),
        _say(
            "%d request(s) without schema hash; %d schema reject(s)",
            "requests_without_schema", "schema_rejects",
        ),
        counts={
            "tool_requests": ("requests_without_schema",),
            "policy_decisions": ("schema_rejects",),
        },
    ),
    Check(
        "Check05", "C11", "AUTOMATED", RAISED, "The ledger's hash chain is unbroken",
        {"count_ledger_events": "ledger_rows", "count_chain_breaks": "chain_breaks"},
        _ok("chain_breaks = 0 and ledger_rows > 0"),
        _say("%d broken link(s) in %d ledger events", "chain_breaks", "ledger_rows"),
        counts={"ledger_events": ("ledger_rows",)},
        shaped=("ledger_breaks",),
    ),
    Check(
        "Check06", "C10", "PARTIAL", RAISED, "Runs can be replayed from their traces",
        {
            "count_replay_traces_total": "replay_traces",
            "count_replay_traces_complete": "replay_traces_complete",
            "replay_trace_completeness_pct": _pct("replay_traces_complete", "replay_traces"),
            "threshold_min_success_rate_pct": "min_replay_success_rate_pct",
        },
        _ok("replay_traces > 0", "PARTIAL"),
        _say("%d of %d replay traces complete", "replay_traces_complete", "replay_traces"),
        counts={"replay_traces": ("replay_traces", "replay_traces_complete")},
    ),
    Check(
        "Check07", "C06", "PARTIAL", RAISED, "Breakers halt side effects",
        {
            "count_breaker_triggers": "breaker_triggers",
            "count_stop_activations": "stop_activations",
            "containment_slo_seconds": "max_breaker_containment_seconds",
        },
        "'PARTIAL'",
        _say("%d trigger(s), %d stop(s)", "breaker_triggers", "stop_activations"),
        counts={"breaker_events": ("breaker_triggers", "stop_activations")},
    ),
    Check(
        "Check08", "C07", "AUTOMATED", ALL, "Budgets are enforced",
        {
            "count_budget_enforcement_events": "budget_enforcing",
            "count_budget_decrement_events": "budget_decrements",
        },
        _ok("budget_enforcing > 0"),
        _say("%d enforcement event(s), %d decrement(s)", "budget_enforcing", "budget_decrements"),
        counts={"budget_events": ("budget_enforcing", "budget_decrements")},
    ),
    Check(
        "Check09", "C12", "AUTOMATED", TOP, "High-impact decisions are signed",
        {
            "count_high_impact_allows": "high_impact_allows",
            "count_high_impact_signed": "high_impact_signed",
            "signature_coverage_pct": _pct("high_impact_signed", "high_impact_allows"),
            "threshold_min_pct": "min_signature_coverage_pct",
        },
        _ok(_pct("high_impact_signed", "high_impact_allows") + " >= min_signature_coverage_pct"),
        _say("%d of %d high-impact allows signed", "high_impact_signed", "high_impact_allows"),
        counts={"policy_decisions": ("high_impact_allows", "high_impact_signed")},
    ),
    Check(
        "Check10", "C03", "AUTOMATED", RAISED, "Memory reads are authorised",
        {
            "count_memory_reads": "memory_reads",
            "count_memory_reads_with_decision": "memory_reads_decided",
            "memory_decision_coverage_pct": _pct("memory_reads_decided", "memory_reads"),
            "count_cross_tenant_denies": "cross_tenant_denies",
        },
        _ok(_pct("memory_reads_decided", "memory_reads") + " = 100d"),
        _say("%d of %d reads decided", "memory_reads_decided", "memory_reads"),
        counts={
            "memory_responses": ("memory_reads", "memory_reads_decided"),
            "memory_decisions": ("cross_tenant_denies",),
        },
    ),
    Check(
        "Check11", "C03", "PARTIAL", RAISED, "Quarantined memory is not served again",
        {
            "count_quarantine_events": "quarantines",
            "count_quarantine_leaks": "quarantine_leaks",
        },
        _ok(_none("quarantine_leaks"), "PARTIAL"),
        _say("%d quarantine(s), %d later read(s)", "quarantines", "quarantine_leaks"),
        counts={"memory_quarantine": ("quarantines",)},
        shaped=("quarantine_leaks",),
    ),
    Check(
        "Check12", "C13", "AUTOMATED", ALL, "Semantic traces tie to evidence",
        {
            "count_semantic_runs": "semantic_runs",
            "count_semantic_runs_correlated": "semantic_runs_correlated",
            "correlation_coverage_pct": _pct("semantic_runs_correlated", "semantic_runs"),
        },
        _ok(_pct("semantic_runs_correlated", "semantic_runs") + " = 100d"),
        _say("%d of %d runs correlated", "semantic_runs_correlated", "semantic_runs"),
        shaped=("correlated_runs",),
    ),
    Check(
        "Check13", "C05", "AUTOMATED", ALL, "Decisions cite a registered policy bundle",
        {
            "count_decisions_missing_bundle_hash": "decisions_without_bundle",
            "count_decisions_with_unknown_bundle_hash": "unknown_bundles",
        },
        _ok(_none("decisions_without_bundle", "unknown_bundles")),
        _say("%d without bundle, %d unknown", "decisions_without_bundle", "unknown_bundles"),
        counts={"policy_decisions": ("decisions_without_bundle",)},
        shaped=("unknown_policy_bundles",),
    ),
    Check(
        "Check14", "HITL", "PARTIAL", TOP, "Calls that needed a human decision have a signed one",
        {
            "count_hitl_required": "approvals_needed",
            "count_hitl_signed_present": "approvals_signed",
            "hitl_signature_presence_pct": _pct("approvals_signed", "approvals_needed"),
            "count_hitl_required_executed_without_approval": "executed_unapproved",
        },
        _ok(_none("executed_unapproved"), "PARTIAL"),
        _say(
            "%d of %d approvals signed; %d executed without one",
            "approvals_signed", "approvals_needed", "executed_unapproved",
        ),
        shaped=("approvals_present", "executed_unapproved"),
    ),
    Check(
        "Check15", "C14", "PARTIAL", TOP, "Agent messages are authenticated",
        {
            "count_envelope_rejects": "rejects",
            "count_spoofed_sender_rejects": "spoofed_rejects",
            "count_nonce_replay_rejects": "nonce_rejects",
        },
        "'PARTIAL'",
        _say(
            "%d reject(s): %d spoofed, %d replayed",
            "rejects", "spoofed_rejects", "nonce_rejects",
        ),
        counts={"agent_messages": ("rejects", "spoofed_rejects", "nonce_rejects")},
    ),
    Check(
        "Check16", "C17", "PARTIAL", ALL, "No discovered workload is past its time without an outcome",
        {
            "count_discovery_events": "discoveries",
            "count_unknown_classifier_hashes": "unknown_classifiers",
            "reconciliation_delta_outside_ttl": "unenrolled_agents",
            "remediation_ttl_hours": "c17_remediation_ttl_hours",
        },
        "if(tier = 'sandbox', "
        + _ok("discoveries > 0 and unknown_classifiers = 0")
        + ", "
        + _ok(_none("unenrolled_agents", "unknown_classifiers"), "PARTIAL")
        + ")",
        _say(
            "%d discovery event(s), %d unknown classifier(s), %d agent(s) unenrolled",
            "discoveries", "unknown_classifiers", "unenrolled_agents",
        ),
        counts={"discovery_events": ("discoveries",)},
        shaped=("unknown_classifiers", "unenrolled_agents"),
    ),
    Check(
        "Check17", "C18", "PARTIAL", ALL, "Memory reads carry a quality decision",
        {
            "count_memory_reads": "memory_reads",
            "count_memory_reads_with_quality_decision": "memory_reads_gated",
            "quality_decision_coverage_pct": _pct("memory_reads_gated", "memory_reads"),
            "threshold_min_pct": "c18_quality_decision_coverage_pct",
        },
        _ok(
            _pct("memory_reads_gated", "memory_reads")
            + f" >= c18_quality_decision_coverage_pct and size({MISSING}) = 0",
            "PARTIAL",
        ),
        _say(
            "%d of %d reads gated; %d active bundle(s); enforced: %s; missing: %s",
            "memory_reads_gated", "memory_reads", "active_bundles",
            f"array_join({ENFORCED}, ',')", f"array_join({MISSING}, ',')",
        ),
        counts={"memory_responses": ("memory_reads", "memory_reads_gated")},
        shaped=("enforced_dimensions",),
        error="if(bad_matrices > 0, 'action matrix tier is not an object', null)",
    ),
    Check(
        "Check18", "C19", "PARTIAL", RAISED, "Baselines are recent and drift decisions regular",
        {
            "count_agents_without_active_signed_baseline_or_stale": "stale_baselines",
            "count_cadence_gaps_exceeding_threshold": "cadence_gaps",
            "count_drift_decision_events": "drift_rows",
            "drift_cadence_threshold_hours": "c19_drift_decision_cadence_hours",
            "max_baseline_age_days": "c19_baseline_max_age_days",
            "count_enforced_response_actions": "enforced_responses",
        },
        _ok(
            "stale_baselines = 0 and cadence_gaps = 0 and drift_rows > 0 "
            "and (tier <> 'high_privilege' or enforced_responses > 0)",
            "PARTIAL",
        ),
        _say(
            "%d stale or missing baseline(s), %d cadence gap(s), %d enforced response(s)",
            "stale_baselines", "cadence_gaps", "enforced_responses",
        ),
        counts={"drift_decisions": ("drift_rows",)},
        shaped=("stale_baselines", "cadence_gaps", "enforced_responses"),
    ),
    Check(
        "Check19", "C19/C16", "PARTIAL", RAISED, "Drift and adversarial events stay apart",
        {
            "count_drift_decision_events": "drift_typed",
            "count_adversarial_outcome_events": "adversarial_typed",
            "count_crossover_drift_in_adversarial_table": "adversarial_crossed",
            "count_crossover_adversarial_in_drift_table": "drift_crossed",
            "count_event_type_double_tag": DOUBLE_TAGS,
            "count_crossover_total": CROSSED,
        },
        _ok(f"drift_typed > 0 and adversarial_typed > 0 and {CROSSED} = 0", "PARTIAL"),
        _say(
            "%d drift and %d adversarial events; crossed %d and %d",
            "drift_typed", "adversarial_typed", "adversarial_crossed", "drift_crossed",
        ),
        counts={
            "drift_decisions": ("drift_typed", "drift_crossed", "drift_double"),
            "adversarial_outcomes": (
                "adversarial_typed", "adversarial_crossed", "adversarial_double",
            ),
        },
    ),
)

BY_ID = {c.check_id: c for c in CHECKS}

# Per check, what its counts leave open: tiers, the limit of the counts, what settles
# it, and the proof. A run may bring its own table instead.
OPEN_QUESTIONS: dict[str, tuple[tuple[tuple[str, ...], str, str, str], ...]] = {
    "Check02": (
        (ALL, "A call that never reached the log is not counted",
         "Try each backend from an agent's host without the gateway", "Transcript of refused attempts, with dates"),
    ),
    "Check06": (
        (ALL, "Equal numbers of steps do not make equal outcomes",
         "Run stored traces again and compare with replay_compare", "Its rows for a stated sample of runs"),
    ),
    "Check07": (
        (ALL, "Few triggers say little about the next one",
         "Trip a breaker on purpose and measure with containment", "Its rows for the exercise"),
    ),
    "Check11": (
        (ALL, "No quarantined item was read, but perhaps none was bad",
         "Insert a known bad item in a test tenant", "Quarantine row of the item and the reads refused after it"),
    ),
    "Check14": (
        (ALL, "An approval row names an approver, it does not prove one",
         "Check signatures and approvers of a sample of rows", "Sample with signer and role of each row"),
    ),
    "Check15": (
        (ALL, "A flag that never fired may not work",
         "Send a forged and a repeated message in a test tenant", "The rows that record both refusals"),
    ),
    "Check16": (
        (RAISED, "Outcomes say that a workload was stopped, not by what",
         "Enrol a test workload, let its time run out, and watch it", "Its outcome row and the platform's own record"),
        (TOP, "Exceptions are counted, not judged",
         "Review every open exception", "List of exceptions with owner and end"),
    ),
    "Check17": (
        (ALL, "The decision table holds a hash, not the rules that ran",
         "Recompute the hash from the deployed rules", "Both hashes and who signed"),
    ),
    "Check18": (
        (ALL, "A recent baseline may have been renewed unseen",
         "Account for each renewal in the window", "Renewals with who approved them and why"),
    ),
    "Check19": (
        (ALL, "Separate tables do not make separate responses",
         "Show how one event of each kind was handled", "Two tickets, each with the procedure followed"),
    ),
}


def chosen(check_ids=None) -> list[Check]:
    """All checks, or the named ones in order; an unknown id is an error."""
    if check_ids is None:
        return list(CHECKS)
    unknown = sorted(set(check_ids) - set(BY_ID))
    if unknown:
        raise ValueError(f"unknown checks {unknown}")
    return [c for c in CHECKS if c.check_id in set(check_ids)]

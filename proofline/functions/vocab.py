"""Closed vocabularies the operators depend on.

Fixed values: evidence stores already hold these strings, so they must be
matched exactly.
"""

ENVIRONMENTS = ("dev", "test", "prod")
TIERS = ("sandbox", "bounded", "high_privilege")

PASS, FAIL, PARTIAL, ERROR, SKIP = "PASS", "FAIL", "PARTIAL", "ERROR", "SKIP"
STATUSES = (PASS, FAIL, PARTIAL, ERROR, SKIP)

HIGH_IMPACT = ("financial", "irreversible_write", "infrastructure")
BUDGET_ENFORCING = ("budget.throttle", "budget.deny")
BUDGET_DECREMENT = "budget.decrement"
BREAKER_TRIGGER = "breaker.trigger"
STOP_ACTIVATION = "stop.activation"
ENFORCING_RESPONSES = ("tier_reduction", "emergency_stop")
DRIFT_EVENT = "gate.assurance.drift_decision"
ADVERSARIAL_EVENT = "gate.assurance.adversarial_outcome"
UNENROLLED_FINDING = "unenrolled - no C04 record and no active exception"
QUALITY_DIMENSIONS = ("confidence", "freshness", "provenance")
REQUIRED_DIMENSIONS = {
    "sandbox": (),
    "bounded": ("confidence", "freshness"),
    "high_privilege": ("confidence", "freshness", "provenance"),
}

DEFAULT_THRESHOLDS = {
    "min_replay_success_rate_pct": 95.0,
    "max_hitl_review_hours": 24.0,
    "max_breaker_containment_seconds": 30.0,
    "min_attestation_coverage_pct": 100.0,
    "min_signature_coverage_pct": 100.0,
    "c17_remediation_ttl_hours": 72.0,
    "c17_classifier_coverage_pct": 100.0,
    "c18_quality_decision_coverage_pct": 100.0,
    "c19_drift_decision_cadence_hours": 24.0,
    "c19_baseline_max_age_days": 90.0,
}
DEFAULT_WINDOW_DAYS = 30

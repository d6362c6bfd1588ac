"""Every operator as a query over the derived evidence store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import correlate as c
from proofline.operators import runbooks as d
from proofline.operators import sketches
from proofline.plans.assessments import Assessments
from proofline.plans.checks import CHECKS
from proofline.plans.oracles import AGENT, BEFORE, DIMENSIONS, OUTAGE, WATCH_FROM
from proofline.plans.report import build_report, metric_rollup, rollup, status_counts
from proofline.plans.runner import check_metrics, run_assessments
from proofline.sources.derived import (
    AS_OF,
    ASSESSMENT_ROWS,
    derived_catalog,
    derived_frame,
    derived_stream,
)
from proofline.streaming import jobs, stateful

Query = Callable[[SparkSession, str], DataFrame]


def assessments(spark: SparkSession) -> Assessments:
    return Assessments.of(spark, ASSESSMENT_ROWS)


def _metrics(check_id: str) -> Query:
    return lambda spark, sf: check_metrics(
        derived_catalog(spark, sf), assessments(spark), check_id
    )


def _results(spark: SparkSession, sf: str, refs: bool = False) -> DataFrame:
    cat = derived_catalog(spark, sf, f"{jobs.shared_folder(spark)}/events")
    return run_assessments(cat, assessments(spark), refs=refs)


def _whole_report(spark: SparkSession, sf: str, refs: bool = False) -> DataFrame:
    return build_report(_results(spark, sf, refs), assessments(spark), AS_OF)


def _evidence_refs(spark: SparkSession, sf: str) -> DataFrame:
    """A row per reference that the report gives for a check."""
    checks = _whole_report(spark, sf, refs=True).select("assessment_id", F.explode("checks").alias("c"))
    return checks.select("assessment_id", "c.check_id", "c.status", F.explode("c.evidence_refs").alias("ref"))


def _report_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A row per proof still owed, in the order of the report."""
    checks = _whole_report(spark, sf).select("assessment_id", F.explode("checks").alias("c"))
    return checks.select(
        "assessment_id", "c.check_id", "c.status", F.posexplode("c.manual_steps").alias("step_no", "s"),
    ).select("*", "s.step", "s.expected_artifact").drop("s")


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return _whole_report(spark, sf).select(
        "assessment_id", "tenant_id", "environment", "autonomy_tier", "run_failed",
        "summary.overall_status", F.size("checks").alias("n_checks"),
    )


def _report_checks(spark: SparkSession, sf: str) -> DataFrame:
    checks = _whole_report(spark, sf).select("assessment_id", F.explode("checks").alias("c"))
    return checks.select("c.check_id", "assessment_id", "c.status")


def _report_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _whole_report(spark, sf).select(
        "assessment_id", F.explode("metrics").alias("metric", "value")
    )


def _archive_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What the archive holds, per table and run."""
    rows = d.archive_rows(derived_catalog(spark, sf), AGENT)
    runs = rows.select("kind", F.get_json_object("row", "$.run_id").alias("run_id"))
    return runs.where("run_id is not null").groupBy("kind", "run_id").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def _from_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """The month's risk distribution from stored sketches, with the quantiles' rank errors held
    against the decisions: within the stated bound or not."""
    cat = derived_catalog(spark, sf)
    stored = sketches.store_sketches(cat, f"{jobs.shared_folder(spark)}/sketches", "2023-01-01", AS_OF)
    window = sketches.risk_window(stored, AS_OF)
    errors = sketches.rank_errors(cat["policy_decisions"], window, AS_OF)
    worst = errors.groupBy(F.col("tool_category").alias("of")).agg(F.max("rank_error").alias("worst"))
    return window.join(worst, F.expr("tool_category <=> of"), "left").select(
        "tool_category", "total_decisions", "avg_orm_score", "hitl_threshold_breaches", "block_threshold_breaches",
        (F.col("worst") <= sketches.RANK_ERROR).alias("ranks_hold"),
    )


def _on(operator, *args, **kwargs) -> Query:
    return lambda spark, sf: operator(derived_catalog(spark, sf), *args, **kwargs)


def _all_runs(operator) -> Query:
    def run(spark, sf):
        cat = derived_catalog(spark, sf)
        return operator(cat, cat["tool_requests"].select("run_id"))

    return run


def _halted_runs(operator) -> Query:
    def run(spark, sf):
        cat = derived_catalog(spark, sf)
        halted = cat["tool_requests"].where(F.col("decision") == "invariant_halt")
        return operator(cat, halted.select("run_id"))

    return run


def _traced_runs(operator) -> Query:
    def run(spark, sf):
        cat = derived_catalog(spark, sf)
        return operator(cat, cat["semantic_traces"].select("run_id"))

    return run


def _compared(spark, sf):
    recorded, again = (derived_frame(spark, sf, n) for n in ("replay_steps", "replayed_steps"))
    return d.replay_compare(recorded, again)


def batch_queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        f"q{k.check_id[-2:]}_metrics": _metrics(k.check_id) for k in CHECKS
    }
    q["verdicts"] = lambda s, sf: _results(s, sf).select(
        "check_id", "assessment_id", "tier", "status"
    )
    q["r01_metric_rollup"] = lambda s, sf: metric_rollup(_results(s, sf))
    q["r02_status_counts"] = lambda s, sf: status_counts(_results(s, sf))
    q["r03_evidence_refs"] = _evidence_refs
    q["r09_rollup"] = lambda s, sf: rollup(_results(s, sf))
    q["r05_report"] = _report
    q["r05_report_checks"] = _report_checks
    q["r05_report_metrics"] = _report_metrics
    q["r05_report_steps"] = _report_steps
    q |= {
        "e01_unmatched_requests": _on(c.unmatched_requests, AS_OF),
        "e02_evidence_chain": _all_runs(c.evidence_chain),
        "e03_ledger_integrity": _on(c.ledger_integrity),
        "e04_risk_distribution": _on(c.risk_distribution, AS_OF),
        "e04_risk_distribution_exact": _on(c.risk_distribution, AS_OF, exact=True),
        "e04_risk_from_sketches": _from_sketches,
        "e05_hitl_audit": _on(c.hitl_audit, AS_OF),
        "e06_approval_fatigue": _on(c.approval_fatigue, AS_OF),
        "e07_breaker_history": _on(c.breaker_history, AS_OF),
        "e08_quarantine_review": _on(c.quarantine_review),
        "e09_spend_anomalies": _on(c.spend_anomalies, AS_OF),
        "e10_unenrolled": _on(c.unenrolled, AS_OF),
        "e11_classifier_coverage": _on(c.classifier_coverage, AS_OF),
        "e12_quality_coverage": _on(c.quality_coverage, AS_OF),
        "e13_unknown_quality_bundles": _on(c.unknown_quality_bundles, AS_OF),
        "e14_baseline_currency": _on(c.baseline_currency, AS_OF),
        "e15_cadence_gaps": _on(c.cadence_gaps, AS_OF),
        "e15_agent_silence": _on(c.agent_silence, AS_OF, WATCH_FROM, DIMENSIONS),
        "e16_event_type_distinction": _on(c.event_type_distinction, AS_OF),
        "d01_bundle_onset": _on(d.bundle_onset, AS_OF, hours=240),
        "d02_locate_runs": _on(d.locate_runs, AS_OF),
        "d03_hitl_denied": _on(d.hitl_denied, *OUTAGE),
        "d04_active_runs": _on(d.active_runs, AS_OF, "agent-1", hours=24),
        "d05_last_good_bundle": _on(d.last_good_bundle, OUTAGE[0]),
        "d06_incident_counts": _halted_runs(d.incident_counts),
        "d07_replay_completeness": _on(d.replay_completeness),
        "d08_replay_compare": _compared,
        "d08_replay_success": lambda s, sf: d.replay_success(_compared(s, sf)),
        "d09_containment": _on(d.containment),
        "d09_containment_rate": lambda s, sf: d.containment_rate(
            d.containment(derived_catalog(s, sf))
        ),
        "d10_ttl_ladder": _on(d.ttl_ladder, AS_OF),
        "d11_time_to_remediation": _on(d.time_to_remediation),
        "d12_quality_timeline": _on(d.quality_timeline, *OUTAGE),
        "d13_downstream_calls": _on(d.downstream_calls, *OUTAGE, within_s=86_400),
        "d14_abom_mismatch": _on(d.abom_mismatch),
        "d15_retrieval_shift": _on(d.retrieval_shift, BEFORE, OUTAGE),
        "d16_chain_links": _traced_runs(d.chain_links),
        "d17_envelope_audit": _on(d.envelope_audit),
        "d17_envelope_offences": _on(d.envelope_offences),
        "d18_archive_counts": _on(d.archive_counts, AGENT),
        "d18_archive_runs": _archive_runs,
    }
    return q


def _streamed(job, *tables: str) -> Query:
    return lambda spark, sf: jobs.drain(job(*[derived_stream(spark, sf, t) for t in tables]))


def stream_queries() -> dict[str, Query]:
    """Streaming jobs, run over everything the tables hold and then read back."""
    return {
        "s01_undecided_requests": _streamed(
            jobs.undecided_requests, "tool_requests", "policy_decisions"
        ),
        "s02_ledger_faults": lambda spark, sf: jobs.drain(
            jobs.ledger_faults(
                *[derived_stream(spark, sf, "ledger_events") for _ in range(2)],
                derived_frame(spark, sf, "ledger_events"),
            )
        ),
        "s03_ttl_alerts": _streamed(
            jobs.ttl_alerts, "discovery_events", "remediation_outcomes"
        ),
        "s04_quality_timeline": _streamed(jobs.quality_timeline, "memory_responses"),
        "s05_drift_silence": _streamed(jobs.drift_silence, "drift_decisions"),
        "s06_spend_anomalies": _streamed(jobs.spend_anomalies, "tool_requests"),
        "s05_silence_alerts": lambda spark, sf: jobs.drain(
            stateful.silence_alerts(
                derived_stream(spark, sf, "drift_decisions"), derived_frame(spark, sf, "agent_state"),
                WATCH_FROM, DIMENSIONS,
            )
        ),
        "s07_nonce_replays": _streamed(jobs.nonce_replays, "agent_messages"),
        "s07_nonce_alerts": _streamed(stateful.nonce_alerts, "agent_messages"),
    }

"""Queries an analyst runs over the evidence: audits, incidents, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions import vocab
from proofline.functions.exprs import ago, micros, n_if, ts, whole_units
from proofline.functions.quantiles import selected_quantiles
from proofline.functions.skew import (
    NOTHING,
    RIGHT_ROW,
    heavy_keys,
    is_short,
    prefilter,
    numbered,
    repeat_rows,
    settled,
    skew_join,
    with_nulls,
)
from proofline.operators.ledger import integrity_rows, linked
from proofline.operators.metrics import spans

QUANTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def _since(df: DataFrame, environment: str, as_of, **delta) -> DataFrame:
    """Rows of the environment in the window that ends before ``as_of``."""
    return df.where(
        (F.col("environment") == environment)
        & (F.col("time") >= ago(as_of, **delta))
        & (F.col("time") < ts(as_of))
    )


def unmatched_requests(cat, as_of, days: int = 30, environment: str = "prod") -> DataFrame:
    """Requests without a decision, newest first.

    A request answered only by decisions that have no id is listed too.
    """
    asked = _since(cat["tool_requests"], environment, as_of, days=days).select(
        "run_id", "trace_id", "agent_instance_id", "tool_name", "request_hash",
        F.col("time").alias("request_time"),
    )
    answers = (
        cat["policy_decisions"]
        .where(F.col("request_hash").isNotNull())
        .groupBy("request_hash")
        .agg(n_if(F.col("decision_id").isNull()).alias("void"))
    )
    listed = (
        skew_join(numbered(asked), answers, ["request_hash"], "left", right_heavy=NOTHING)
        .withColumn("times", F.coalesce("void", F.lit(1).cast("bigint")))
        .where(F.col("times") > 0)
        .select(*asked.columns, "times")
    )
    return repeat_rows(listed, "times").orderBy(F.desc("request_time"))


def evidence_chain(cat, run_ids: DataFrame) -> DataFrame:
    """Everything recorded about the given runs, one row per combination."""
    runs = run_ids.select("run_id").where(F.col("run_id").isNotNull()).distinct()
    run, hashed, traced = ["run_id"], ["run_id", "request_hash"], ["run_id", "trace_id"]
    decision, logged = ["decision_id"], ["run_id", "ledger_event_id"]
    ledger = cat["ledger_events"].select(
        F.col("policy_decision_id").alias("decision_id"),
        "ledger_event_id",
        F.col("event_hash").alias("ledger_event_hash"),
        F.col("prev_event_hash").alias("prev_ledger_hash"),
        F.col("sink_uri").alias("worm_uri"),
        "run_id",
    )
    semantic = cat["semantic_traces"].withColumn("ledger_event_id", F.col("audit_ref"))
    short = is_short(runs)
    if short:
        runs = settled(runs)

    def of_runs(rows: DataFrame, heavy=None) -> DataFrame:
        if short:
            return rows.join(F.broadcast(runs), run, "left_semi")
        return skew_join(rows, runs, run, "inner", heavy, NOTHING)

    def measured(rows: DataFrame, *keys: list[str]):
        """Heavy keys, once per stored table for every join it feeds."""
        if short:
            return [NOTHING, *heavy_keys(of_runs(rows), *keys)]
        return heavy_keys(rows, run, *keys)

    q_run, q_hashed, q_traced = measured(cat["tool_requests"], hashed, traced)
    p_run, p_hashed, p_decision = measured(cat["policy_decisions"], hashed, decision)
    r_run, r_traced = measured(cat["tool_responses"], traced)
    z_run, z_hashed = measured(cat["replay_steps"], hashed)
    s_run, s_logged = measured(semantic, logged)
    if short:
        decisions_of_runs = of_runs(cat["policy_decisions"]).select("decision_id")
        ledger = prefilter(ledger, decisions_of_runs, decision)
    l_decision, l_logged = heavy_keys(ledger, decision, logged)

    requests = of_runs(numbered(cat["tool_requests"]), q_run).select(
        "__lrow",
        F.col("time").alias("request_time"), "run_id", "trace_id", "agent_instance_id",
        "tool_name", "tool_category", "request_hash",
    )
    decisions = of_runs(numbered(cat["policy_decisions"]), p_run).select(
        F.col("__lrow").alias(RIGHT_ROW),
        "run_id", "request_hash", "decision_id", "decision", "reason_codes", "policy_bundle_hash"
    )
    responses = of_runs(numbered(cat["tool_responses"]), r_run).select(
        F.col("__lrow").alias(RIGHT_ROW),
        "run_id", "trace_id", "response_hash", F.col("status").alias("tool_status"), "snapshot_uri"
    )
    steps = of_runs(numbered(cat["replay_steps"]), z_run).select(
        F.col("__lrow").alias(RIGHT_ROW),
        "run_id", "request_hash", F.col("step_index").alias("replay_step"), "step_type"
    )
    traces = of_runs(numbered(semantic), s_run).select(
        F.col("__lrow").alias(RIGHT_ROW),
        "run_id",
        "ledger_event_id",
        F.col("intent").alias("semantic_intent"),
        F.col("audit_ref").alias("semantic_audit_ref"),
    )
    # Both joins on the request hash first, so its rows are shuffled once for them.
    out = skew_join(requests, decisions, hashed, "left", q_hashed, p_hashed)
    out = skew_join(out, steps, hashed, "left", q_hashed, z_hashed)
    out = skew_join(out, responses, traced, "left", q_traced, r_traced)
    # Keys from the right of a left join are null wherever nothing matched.
    out = skew_join(
        out, numbered(ledger.drop("run_id"), RIGHT_ROW), decision, "left", with_nulls(p_decision), l_decision
    )
    out = skew_join(out, traces, logged, "left", with_nulls(l_logged), s_logged)
    return out.select(
        "request_time", "agent_instance_id", "tool_name", "tool_category", "request_hash",
        "decision_id", "decision", "reason_codes", "policy_bundle_hash", "response_hash",
        "tool_status", "snapshot_uri", "ledger_event_id", "ledger_event_hash", "prev_ledger_hash",
        "worm_uri", "replay_step", "step_type", "semantic_intent", "semantic_audit_ref",
    ).orderBy("request_time", "replay_step")


def ledger_integrity(cat, environment: str = "prod") -> DataFrame:
    """Ledger rows with a torn link or a sequence gap, in sequence order."""
    rows = (
        cat["ledger_events"]
        .where(F.col("environment") == environment)
        .select("tenant_id", "ledger_event_id", "sequence_number", "event_hash", "prev_event_hash")
    )
    return integrity_rows(linked(rows, ["tenant_id"])).orderBy("sequence_number")


def risk_distribution(
    cat, as_of, days: int = 30, hitl: float = 0.65, block: float = 0.85, exact: bool = False,
    environment: str = "prod",
) -> DataFrame:
    """Risk-score distribution per tool category.

    Quantiles come from a mergeable sketch; ``exact`` computes them precisely.
    """
    score = F.col("orm_risk_score")
    rows = _since(cat["policy_decisions"], environment, as_of, days=days)
    sketch = {
        name: F.round(F.percentile_approx(score, p, 10_000), 3) for name, p in QUANTILES.items()
    }
    stats = rows.groupBy("tool_category").agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.round(F.avg(score), 3).alias("avg_orm_score"),
        *([] if exact else [c.alias(n) for n, c in sketch.items()]),
        n_if(score >= hitl).alias("hitl_threshold_breaches"),
        n_if(score >= block).alias("block_threshold_breaches"),
    )
    if exact:
        # A null category is a group too.
        q = selected_quantiles(rows.select("tool_category", score), "tool_category", "orm_risk_score", QUANTILES)
        q = q.withColumnRenamed("tool_category", "of")
        stats = stats.join(q, F.expr("tool_category <=> of"), "left").drop("of")
        stats = stats.withColumns({n: F.round(n, 3) for n in QUANTILES})
    return stats.select(
        "tool_category", "total_decisions", "avg_orm_score", *QUANTILES,
        "hitl_threshold_breaches", "block_threshold_breaches",
    ).orderBy(F.desc("avg_orm_score"))


def _approval_pairs(cat, as_of, days: int, environment: str) -> DataFrame:
    approvals = _since(cat["hitl_decisions"], environment, as_of, days=days).select(
        F.col("policy_decision_id").alias("decision_id"), "approval_id", "run_id", "tool_name",
        "orm_risk_score", "approver_id", "action", "justification", "ledger_event_id",
        "signature_ref", F.col("time").alias("decision_time"),
    )
    decided = cat["policy_decisions"].select("decision_id", F.col("time").alias("asked_at"))
    decided = prefilter(decided, approvals, ["decision_id"])
    pairs = skew_join(
        numbered(approvals), numbered(decided, RIGHT_ROW), ["decision_id"], "left"
    )
    return pairs.withColumn(
        "seconds_to_approve", whole_units("SECOND", F.col("asked_at"), F.col("decision_time"))
    )


def hitl_audit(cat, as_of, days: int = 30, environment: str = "prod") -> DataFrame:
    """Human decisions with the time taken and whether they are signed."""
    return (
        _approval_pairs(cat, as_of, days, environment)
        .select(
            "approval_id", "run_id", "tool_name", "orm_risk_score", "approver_id", "action",
            "justification", "decision_time", "seconds_to_approve", "ledger_event_id",
            F.col("signature_ref").isNotNull().alias("is_signed"),
        )
        .orderBy(F.desc("decision_time"))
    )


def approval_fatigue(
    cat, as_of, days: int = 30, min_rate_pct: float = 95, max_avg_s: float = 30,
    environment: str = "prod",
) -> DataFrame:
    """Approvers who approve nearly all and fast; figures are rounded before the test."""
    approved = n_if(F.col("action") == "approve")
    total = F.count(F.lit(1))
    return (
        _approval_pairs(cat, as_of, days, environment)
        .groupBy("approver_id")
        .agg(
            total.alias("total_decisions"),
            approved.alias("approvals"),
            n_if(F.col("action") == "deny").alias("denials"),
            F.round(approved.cast("double") / total.cast("double") * 100, 1).alias(
                "approval_rate_pct"
            ),
            F.round(F.avg("seconds_to_approve"), 0).alias("avg_seconds_to_decide"),
        )
        .where(
            (F.col("approval_rate_pct") > min_rate_pct)
            & (F.col("avg_seconds_to_decide") < max_avg_s)
        )
        .orderBy(F.desc("approval_rate_pct"))
    )


def breaker_history(cat, as_of, days: int = 90, environment: str = "prod") -> DataFrame:
    return (
        _since(cat["breaker_events"], environment, as_of, days=days)
        .select(
            F.col("time").alias("triggered_at"), "agent_instance_id", "trigger_cause",
            "threshold_value", "actual_value", "containment_outcome",
            "time_to_effective_stop_ms", "affected_run_ids",
        )
        .orderBy(F.desc("triggered_at"))
    )


def quarantine_review(
    cat, max_hours: float | None = None, environment: str = "prod"
) -> DataFrame:
    """Quarantines with whole hours to review; ``max_hours`` keeps the late or open ones."""
    rows = cat["memory_quarantine"].where(F.col("environment") == environment).select(
        F.col("time").alias("quarantined_at"), "memory_partition", "document_ref", "cause_codes",
        "provenance_refs", "detection_confidence", "reviewed_by", "review_outcome",
        whole_units("HOUR", F.col("time"), F.col("reviewed_at")).alias("hours_to_review"),
    )
    if max_hours is not None:
        late = F.col("hours_to_review").isNull() | (F.col("hours_to_review") >= max_hours)
        rows = rows.where(late)
    return rows.orderBy(F.desc("quarantined_at"))


def spend_anomalies(
    cat, as_of, days: int = 7, max_cost: float = 5.0, max_calls: int = 100,
    max_high_impact: int = 5, environment: str = "prod",
) -> DataFrame:
    """Runs that cost much, call much or touch high-impact tools often."""
    return (
        _since(cat["tool_requests"], environment, as_of, days=days)
        .groupBy("run_id", "agent_instance_id")
        .agg(
            F.sum("cost_usd").alias("total_cost_usd"),
            F.count(F.lit(1)).alias("total_tool_calls"),
            n_if(F.col("tool_category").isin(*vocab.HIGH_IMPACT)).alias("high_impact_calls"),
            F.min("time").alias("run_start"),
            F.max("time").alias("run_end"),
        )
        .withColumn(
            "run_duration_seconds", whole_units("SECOND", F.col("run_start"), F.col("run_end"))
        )
        .where(
            (F.col("total_cost_usd") > max_cost)
            | (F.col("total_tool_calls") > max_calls)
            | (F.col("high_impact_calls") > max_high_impact)
        )
        .orderBy(F.desc("total_cost_usd"))
    )


def unenrolled(
    cat, as_of, hours: int = 24, match_on: str = "workload_identity", environment: str = "prod"
) -> DataFrame:
    """Recent callers with no inventory record and no live exception.

    ``match_on`` is the exception column compared with the caller:
    ``workload_identity`` or ``owner_identity``.
    """
    callers = (
        _since(cat["tool_requests"], environment, as_of, hours=hours)
        .select(F.col("agent_instance_id").alias("workload_identity"))
        .distinct()
    )
    enrolled = (
        cat["c04_inventory"].select(F.col("agent_instance_id").alias("workload_identity")).distinct()
    )
    excused = (
        cat["remediation_outcomes"]
        .where((F.col("outcome") == "exception") & (F.col("exception_ttl_expires_at") > ts(as_of)))
        .select(F.col(match_on).alias("workload_identity"))
        .distinct()
    )
    return (
        callers.join(enrolled, "workload_identity", "left_anti")
        .join(excused, "workload_identity", "left_anti")
        .withColumn("finding", F.lit(vocab.UNENROLLED_FINDING))
    )


def classifier_coverage(
    cat, as_of, hours: int = 24, min_pct: float | None = None, environment: str = "prod"
) -> DataFrame:
    """Governed identities that the classifier scanned; ``min_pct`` adds a verdict column."""
    governed = (
        _since(cat["tool_requests"], environment, as_of, hours=hours)
        .select(F.col("agent_instance_id").alias("identity"))
        .where(F.col("identity").isNotNull())
        .distinct()
    )
    found = cat["discovery_events"]
    identity = (
        F.get_json_object("candidate_payload", "$.workload_identity")
        if "candidate_payload" in found.columns
        else F.col("workload_identity")
    )
    scanned = (
        _since(found, environment, as_of, hours=hours)
        .select(identity.alias("identity"))
        .distinct()
        .withColumn("seen", F.lit(True))
    )
    # Both sides are distinct by now, so plain counts suffice.
    total, hit = F.count(F.lit(1)), n_if(F.col("seen"))
    out = governed.join(scanned, "identity", "left").agg(
        total.alias("total_governed"),
        hit.alias("scanned"),
        F.try_divide(hit.cast("double") * 100.0, total.cast("double")).alias("coverage_pct"),
    )
    if min_pct is not None:
        out = out.withColumn("met", F.coalesce(F.col("coverage_pct") >= min_pct, F.lit(True)))
    return out


def quality_coverage(cat, as_of, days: int = 30, environment: str = "prod") -> DataFrame:
    reads = _since(cat["memory_responses"], environment, as_of, days=days).where(
        F.col("request_type") == "read"
    )
    total, gated = F.count(F.lit(1)), F.count("quality_decision_id")
    return reads.agg(
        total.alias("total_retrievals"),
        gated.alias("retrievals_with_quality_decision"),
        (total - gated).alias("retrievals_without_quality_decision"),
        F.try_divide(gated.cast("double") * 100.0, total.cast("double")).alias("coverage_pct"),
    )


def unknown_quality_bundles(cat, as_of, days: int = 30, environment: str = "prod") -> DataFrame:
    """Quality decisions per bundle hash that no registry entry has."""
    known = cat["quality_bundles"].select(F.col("bundle_hash").alias("quality_bundle_hash"))
    return (
        _since(cat["quality_decisions"], environment, as_of, days=days)
        .groupBy("quality_bundle_hash")
        .agg(F.count(F.lit(1)).alias("decisions_referencing_unknown_bundle"))
        .join(known, "quality_bundle_hash", "left_anti")
    )


def baseline_currency(cat, as_of, max_age_days: int = 90) -> DataFrame:
    """Running agents at the raised tiers whose baseline is missing or old."""
    agents = (
        cat["agent_state"]
        .where(F.col("autonomy_tier").isin("bounded", "high_privilege") & (F.col("state") == "Run"))
        .select("agent_instance_id", "autonomy_tier")
    )
    current = cat["abom"].where(F.col("is_current")).select(
        "agent_instance_id", F.col("current_baseline_hash").alias("baseline_hash")
    )
    made = cat["baselines"].select("baseline_hash", "created_at", F.lit(True).alias("known"))
    age = whole_units("DAY", F.col("created_at"), ts(as_of))
    (shared,) = heavy_keys(current, ["baseline_hash"])
    out = skew_join(
        numbered(agents), numbered(current, RIGHT_ROW), ["agent_instance_id"], "left"
    )
    out = skew_join(
        out, numbered(made, RIGHT_ROW), ["baseline_hash"], "left", with_nulls(shared)
    ).withColumn("baseline_age_days", age)
    return out.where(F.col("known").isNull() | (F.col("baseline_age_days") > max_age_days)).select(
        "agent_instance_id",
        "autonomy_tier",
        F.when(F.col("created_at").isNull(), "no_baseline")
        .when(F.col("baseline_age_days") > max_age_days, "baseline_stale")
        .otherwise("ok")
        .alias("finding"),
        "baseline_age_days",
    )


def cadence_gaps(
    cat, as_of, days: int = 30, cadence_hours: int = 24, environment: str = "prod"
) -> DataFrame:
    """Pauses longer than the cadence, in whole hours, per agent and dimension."""
    drift = cat["drift_decisions"]
    agent = (
        F.get_json_object("payload", "$.agent_instance_id")
        if "payload" in drift.columns
        else F.col("agent_instance_id")
    )
    rows = _since(drift, environment, as_of, days=days).select(
        agent.alias("agent_instance_id"), "dimension", "time"
    )
    width = F.lit(max(cadence_hours, 0) * 3600 * 1_000_000)
    gap = whole_units("HOUR", F.col("previous_time"), F.col("time"))
    return (
        spans(rows, ["agent_instance_id", "dimension"], width)
        .select(
            "agent_instance_id", "dimension", "previous_time",
            F.col("time").alias("current_time"), gap.alias("gap_hours"),
        )
        .where(F.col("gap_hours") > cadence_hours)
    )


def agent_silence(
    cat, as_of, since, dimensions, cadence_hours: int = 24
) -> DataFrame:
    """Agents that owed a drift decision in a dimension, per silence up to ``as_of``.

    Every running agent is watched from ``since`` on, also one that never made a
    decision; others from their first decision. A silence is longer than the cadence and
    ends with the next decision or is open at ``as_of``. ``silent_since`` is the last
    decision, or ``since`` where ``ever_reported`` is false.
    """
    keys = ["tenant_id", "environment", "agent_instance_id", "dimension"]
    width = F.lit(cadence_hours * 3600 * 1_000_000)
    made = cat["drift_decisions"].where((F.col("time") >= ts(since)) & (F.col("time") < ts(as_of)))
    made = made.select(*keys, "time", F.lit(True).alias("made"))
    each = F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension")
    roster = cat["agent_state"].where("state = 'Run'").select(*keys[:3], each).distinct()
    rows = made.unionByName(roster.select(*keys, ts(since).alias("time"), F.lit(False).alias("made")))
    ends = rows.groupBy(*keys).agg(
        F.max("time").alias("silent_since"), F.min(F.when(F.col("made"), F.col("time"))).alias("first_made")
    )
    open_ = ends.where(micros(ts(as_of)) - micros(F.col("silent_since")) > width).drop("first_made")
    gaps = spans(rows, keys, width).where(micros(F.col("time")) - micros(F.col("previous_time")) > width)
    silent = open_.unionByName(gaps.select(*keys, F.col("previous_time").alias("silent_since")))
    first = ends.select(*[F.col(k).alias(f"of_{k}") for k in keys], "first_made")
    same = " and ".join(f"{k} <=> of_{k}" for k in keys)
    told = F.coalesce(F.col("first_made") <= F.col("silent_since"), F.lit(False)).alias("ever_reported")
    return silent.join(first, F.expr(same)).select(*keys, "silent_since", told)


def event_type_distinction(cat, as_of, days: int = 30, environment: str = "prod") -> DataFrame:
    """Drift and adversarial counts, and rows filed in the other's table.

    Crossover ignores environment and window. One pass over each table.
    """
    recent = (F.col("environment") == environment) & (F.col("time") >= ago(as_of, days=days)) & (
        F.col("time") < ts(as_of)
    )
    drift = cat["drift_decisions"].select(
        recent.alias("in_drift"), F.lit(False).alias("in_adversarial"),
        (F.col("event_type") == vocab.ADVERSARIAL_EVENT).alias("crossed"),
    )
    adversarial = cat["adversarial_outcomes"].select(
        F.lit(False).alias("in_drift"), recent.alias("in_adversarial"),
        (F.col("event_type") == vocab.DRIFT_EVENT).alias("crossed"),
    )
    return drift.unionByName(adversarial).agg(
        n_if(F.col("in_drift")).alias("c19_drift_count"),
        n_if(F.col("in_adversarial")).alias("c16_adversarial_count"),
        n_if(F.col("crossed")).alias("crossover_count"),
    )

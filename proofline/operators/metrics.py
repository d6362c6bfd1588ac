"""Metrics behind the nineteen checks, for all assessments at once.

Two kinds: conditional counts, where one pass over a table yields every count
any check wants from it, and shaped metrics that need a join or an order. The
shaped ones count per key on both sides before joining, so a key holding a
large share of the rows is one row by the time it is shuffled, and products of
the counts give the number of joined pairs without building them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import vocab
from proofline.functions.exprs import micros, n_if, needs_approval
from proofline.functions.refs import reference, sampled
from proofline.functions.running import running, time_bucket
from proofline.functions.skew import prefilter
from proofline.operators.ledger import broken_copies, linked
from proofline.plans.assessments import Assessments
from proofline.sources.catalog import EvidenceCatalog

KEY = Assessments.KEY
HOUR_US = 3600 * 1_000_000
DAY_US = 24 * HOUR_US


def _c(name: str) -> Column:
    return F.col(name)


HIGH_IMPACT_ALLOW = (
    "tool_category in (" + ", ".join(map(repr, vocab.HIGH_IMPACT)) + ") and decision = 'allow'"
)
DOUBLE_TAG = (
    "lower(event_type) like '%adversarial_outcome%drift_decision%' "
    "or lower(event_type) like '%drift_decision%adversarial_outcome%'"
)

# table -> count name -> condition a scoped row must meet
COUNTS: dict[str, dict[str, str]] = {
    "tool_requests": {
        "requests": "true",
        "requests_verified": "identity_verified",
        "requests_without_schema": "tool_schema_hash is null or tool_schema_hash = ''",
    },
    "policy_decisions": {
        "schema_rejects": "decision = 'deny' and reason = 'schema_validation_failed'",
        "high_impact_allows": HIGH_IMPACT_ALLOW,
        "high_impact_signed": f"{HIGH_IMPACT_ALLOW} and signature_ref is not null "
        "and signing_key_id is not null",
        "decisions_without_bundle": "policy_bundle_hash is null or policy_bundle_hash = ''",
    },
    "ledger_events": {"ledger_rows": "true"},
    "replay_traces": {
        "replay_traces": "true",
        "replay_traces_complete": "model_id is not null and prompt_bundle_hash is not null "
        "and tool_schema_hash is not null and snapshot_uri is not null",
    },
    "breaker_events": {
        "breaker_triggers": f"event_type = '{vocab.BREAKER_TRIGGER}'",
        "stop_activations": f"event_type = '{vocab.STOP_ACTIVATION}'",
    },
    "budget_events": {
        "budget_enforcing": "event_type in ("
        + ", ".join(map(repr, vocab.BUDGET_ENFORCING)) + ")",
        "budget_decrements": f"event_type = '{vocab.BUDGET_DECREMENT}'",
    },
    "memory_responses": {
        "memory_reads": "request_type = 'read'",
        "memory_reads_decided": "request_type = 'read' and memory_decision_id is not null",
        "memory_reads_gated": "request_type = 'read' and quality_decision_id is not null",
    },
    "memory_decisions": {
        "cross_tenant_denies": "decision = 'deny' and reason = 'cross_tenant_read'",
    },
    "memory_quarantine": {"quarantines": "true"},
    "agent_messages": {
        "rejects": "validation_status = 'reject'",
        "spoofed_rejects": "validation_status = 'reject' and reason = 'spoofed_sender'",
        "nonce_rejects": "validation_status = 'reject' and reason = 'nonce_replay'",
    },
    "discovery_events": {"discoveries": "true"},
    "drift_decisions": {
        "drift_rows": "true",
        "drift_typed": f"event_type = '{vocab.DRIFT_EVENT}'",
        "drift_crossed": f"event_type = '{vocab.ADVERSARIAL_EVENT}'",
        "drift_double": DOUBLE_TAG,
    },
    "adversarial_outcomes": {
        "adversarial_typed": f"event_type = '{vocab.ADVERSARIAL_EVENT}'",
        "adversarial_crossed": f"event_type = '{vocab.DRIFT_EVENT}'",
        "adversarial_double": DOUBLE_TAG,
    },
}

# table -> name -> (condition of a scoped row that counts against a check, its key)
OFFENDERS: dict[str, dict[str, tuple[str, str]]] = {
    "tool_requests": {
        "requests_unverified": ("not coalesce(identity_verified, false)", "request_hash"),
        "requests_without_schema": (COUNTS["tool_requests"]["requests_without_schema"], "request_hash"),
    },
    "policy_decisions": {
        "high_impact_unsigned": (
            f"{HIGH_IMPACT_ALLOW} and (signature_ref is null or signing_key_id is null)", "decision_id",
        ),
        "decisions_without_bundle": (COUNTS["policy_decisions"]["decisions_without_bundle"], "decision_id"),
    },
    "replay_traces": {
        "replay_traces_incomplete": (
            f"not ({COUNTS['replay_traces']['replay_traces_complete']})", "trace_id",
        ),
    },
    "memory_responses": {
        "memory_reads_undecided": ("request_type = 'read' and memory_decision_id is null", "response_id"),
        "memory_reads_ungated": ("request_type = 'read' and quality_decision_id is null", "response_id"),
    },
    "agent_messages": {"rejects": ("validation_status = 'reject'", "message_id")},
    "drift_decisions": {
        "drift_apart": (f"event_type = '{vocab.ADVERSARIAL_EVENT}' or {DOUBLE_TAG}", "event_id"),
    },
    "adversarial_outcomes": {
        "adversarial_apart": (f"event_type = '{vocab.DRIFT_EVENT}' or {DOUBLE_TAG}", "event_id"),
    },
}


def ref_column(name: str) -> str:
    """The column with the sample of references behind ``name``."""
    return f"refs_{name}"


def table_counts(
    cat: EvidenceCatalog, assessments: Assessments, table: str, names: Iterable[str], refs: Iterable[str] = ()
) -> DataFrame:
    """The named counts of one table, and samples of keys for ``refs``, in one pass."""
    spec, told = COUNTS[table], OFFENDERS.get(table, {})
    samples = [
        sampled(F.coalesce(F.expr(told[n][0]), F.lit(False)), reference(table, told[n][1])).alias(ref_column(n))
        for n in refs
    ]
    return (
        assessments.scope(cat[table])
        .groupBy(KEY)
        .agg(
            *[F.expr(f"count_if({spec[n]}) as {n}") for n in names],
            *samples,
        )
    )


def _total(rows: DataFrame, *counts: Column, **refs: tuple[Column, Column]) -> DataFrame:
    """Counts per assessment with samples ``refs_<name>``; those that nobody selects cost nothing."""
    samples = [sampled(F.coalesce(hit, F.lit(False)), ref).alias(ref_column(n)) for n, (hit, ref) in refs.items()]
    return rows.groupBy(KEY).agg(*counts, *samples)


def _right_keys(key: str, scope_right: bool) -> list[str]:
    return [key, "tenant_id", "environment"] if scope_right else [key]


def unmatched_requests(cat, assessments, scope_right: bool = False) -> DataFrame:
    """Requests no decision answers. A decision without an id answers nothing,
    and every such decision counts its request once more."""
    on = _right_keys("request_hash", scope_right)
    asked = (
        assessments.scope(cat["tool_requests"])
        .groupBy(KEY, *on)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    answered = (
        cat["policy_decisions"]
        .where(_c("request_hash").isNotNull())
        .groupBy(*on)
        .agg(n_if(_c("decision_id").isNull()).alias("void"))
    )
    void = F.coalesce("void", F.lit(1))
    return _total(
        asked.join(answered, on, "left"),
        F.sum(_c("n") * void).alias("unmatched_requests"),
        unmatched_requests=(void > 0, reference("tool_requests", "request_hash")),
    )


def foreign_callers(cat, assessments) -> DataFrame:
    """Requests from identities NOT IN the gateway list, with SQL's null rules:
    a null in the list lets nothing through, an empty list lets all."""
    gateways = cat["gateway_identities"]
    size = gateways.agg(F.count(F.lit(1))).scalar()
    holes = gateways.agg(n_if(_c("identity").isNull())).scalar()
    callers = (
        assessments.scope(cat["tool_requests"])
        .groupBy(KEY, F.coalesce("originating_identity", "agent_instance_id").alias("identity"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    strangers = callers.join(gateways.distinct(), "identity", "left_anti").where(
        (_c("identity").isNotNull() | (size == 0)) & (holes == 0)
    )
    return _total(
        strangers, F.sum("n").alias("foreign_callers"),
        foreign_callers=(F.lit(True), reference("identity", "identity")),
    )


def ledger_breaks(cat, assessments) -> DataFrame:
    """Broken links per assessment; the window bound applies before the order."""
    rows = assessments.scope(cat["ledger_events"]).select(
        KEY, "sink_uri", "sequence_number", "event_hash", "prev_event_hash"
    )
    # One assessment is one (tenant, environment).
    links = linked(rows, [KEY, "sink_uri"])
    broken = broken_copies()
    return _total(
        links, F.sum(broken).alias("chain_breaks"),
        chain_breaks=(broken > 0, reference("ledger_events", "sink_uri", "sequence_number")),
    )


def quarantine_leaks(cat, assessments, scope_right: bool = False) -> DataFrame:
    """(response, quarantine) pairs on one item where the response is not earlier."""
    on = _right_keys("item_id", scope_right)
    held = cat["memory_quarantine"].where(_c("time").isNotNull())
    reads = assessments.scope(cat["memory_responses"])
    reads = prefilter(reads, held, ["item_id"])
    reads = reads.groupBy(KEY, *on, "time").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy(*on, "time").agg(F.count(F.lit(1)).alias("n"))
    both = held.select(
        F.lit(None).cast("string").alias(KEY), *on, "time", "n", F.lit(0).alias("side")
    ).unionByName(reads.withColumn("side", F.lit(1)))
    seen = running(
        both, on, "time", F.when(_c("side") == 0, _c("n")).otherwise(0), "sum", "held", "side"
    )
    return _total(
        seen.where(_c("side") == 1), F.sum(_c("n") * _c("held")).alias("quarantine_leaks"),
        quarantine_leaks=(_c("held") > 0, reference("memory_responses", "item_id")),
    )


def correlated_runs(cat, assessments, scope_right: bool = False) -> DataFrame:
    """Semantic runs, and those with both a decision and a ledger event."""
    on = _right_keys("run_id", scope_right)
    runs = assessments.scope(cat["semantic_traces"]).select(KEY, *on).distinct()
    for table, flag in (("policy_decisions", "decided"), ("ledger_events", "recorded")):
        known = cat[table].where(_c("run_id").isNotNull()).select(*on).distinct()
        runs = runs.join(known.withColumn(flag, F.lit(True)), on, "left")
    tied = F.coalesce(_c("decided") & _c("recorded"), F.lit(False))
    return _total(
        runs,
        F.count(F.lit(1)).alias("semantic_runs"),
        n_if(tied).alias("semantic_runs_correlated"),
        semantic_runs=(~tied, reference("semantic_traces", "run_id")),
    )


def _unregistered(rows: DataFrame, column: str, registry: DataFrame, out: str) -> DataFrame:
    known = registry.select(_c("bundle_hash").alias(column)).distinct()
    strange = rows.groupBy(KEY, column).agg(F.count(F.lit(1)).alias("n")).join(known, column, "left_anti")
    return _total(strange, F.sum("n").alias(out), **{out: (F.lit(True), reference(column, column))})


def unknown_policy_bundles(cat, assessments) -> DataFrame:
    rows = assessments.scope(cat["policy_decisions"])
    return _unregistered(rows, "policy_bundle_hash", cat["policy_bundles"], "unknown_bundles")


def unknown_classifiers(cat, assessments) -> DataFrame:
    rows = assessments.scope(cat["discovery_events"])
    return _unregistered(
        rows, "classifier_bundle_hash", cat["classifier_bundles"], "unknown_classifiers"
    )


def _approvals(cat, scope_right: bool) -> DataFrame:
    """Per decision: approval rows, and those with both an id and a signature."""
    return (
        cat["hitl_decisions"]
        .where(_c("policy_decision_id").isNotNull())
        .withColumn("decision_id", _c("policy_decision_id"))
        .groupBy(*_right_keys("decision_id", scope_right))
        .agg(
            F.count(F.lit(1)).alias("approvals"),
            n_if(_c("approval_id").isNotNull() & _c("signature_ref").isNotNull()).alias("signed"),
        )
    )


def approvals_present(cat, assessments, scope_right: bool = False) -> DataFrame:
    """Decision-approval rows for decisions that need one, and the signed ones."""
    on = _right_keys("decision_id", scope_right)
    needed = (
        assessments.scope(cat["policy_decisions"])
        .where(needs_approval(_c("obligations")))
        .groupBy(KEY, *on)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    approvals, signed = F.coalesce("approvals", F.lit(1)), F.coalesce("signed", F.lit(0))
    return _total(
        needed.join(_approvals(cat, scope_right), on, "left"),
        F.sum(_c("n") * approvals).alias("approvals_needed"),
        F.sum(_c("n") * signed).alias("approvals_signed"),
        approvals_needed=(approvals > signed, reference("policy_decisions", "decision_id")),
    )


def executed_unapproved(cat, assessments, scope_right: bool = False) -> DataFrame:
    """Responses to decisions whose approval is missing or unsigned, per approval row."""
    on = _right_keys("request_hash", scope_right)
    open_ = F.coalesce(_c("approvals") - _c("signed"), F.lit(1))
    bad = (
        cat["policy_decisions"]
        .where(needs_approval(_c("obligations")) & _c("request_hash").isNotNull())
        .groupBy(*on, "decision_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(_approvals(cat, scope_right), _right_keys("decision_id", scope_right), "left")
        .groupBy(*on)
        .agg(F.sum(_c("n") * open_).alias("open"))
        .where(_c("open") > 0)
    )
    ran = (
        assessments.scope(cat["tool_responses"])
        .groupBy(KEY, *on)
        .agg(F.count(F.lit(1)).alias("ran"))
    )
    return _total(
        ran.join(bad, on), F.sum(_c("ran") * _c("open")).alias("executed_unapproved"),
        executed_unapproved=(F.lit(True), reference("tool_responses", "request_hash")),
    )


def unenrolled_agents(
    cat, assessments, exact_hours: bool = False, scope_right: bool = False
) -> DataFrame:
    """Agents in the request stream with no inventory record and no live exception,
    first seen before the remediation cutoff (whole days unless ``exact_hours``)."""
    ttl = _c("c17_remediation_ttl_hours")
    days = (F.floor(ttl / 24) + 1).cast("int")
    allowed = (
        F.make_dt_interval(secs=ttl * 3600) if exact_hours else F.make_dt_interval(days)
    )
    on = _right_keys("agent_instance_id", scope_right)
    seen = (
        assessments.scope(cat["tool_requests"])
        .groupBy(KEY, *on)
        .agg(F.min("time").alias("first_seen"))
        .join(assessments.side("as_of", "c17_remediation_ttl_hours"), [KEY, *on[1:]])
        .where(_c("first_seen") < _c("as_of") - allowed)
    )
    enrolled = cat["c04_inventory"].select(*on).distinct()
    excused = (
        assessments.scope_registry(cat["remediation_outcomes"], "as_of")
        .where((_c("outcome") == "exception") & (_c("exception_ttl_expires_at") > _c("as_of")))
        .select(KEY, _c("owner_identity").alias("agent_instance_id"))
        .distinct()
    )
    return _total(
        seen.join(enrolled, on, "left_anti").join(excused, [KEY, "agent_instance_id"], "left_anti"),
        F.count(F.lit(1)).alias("unenrolled_agents"),
        unenrolled_agents=(F.lit(True), reference("agent_instance_id", "agent_instance_id")),
    )


def enforced_dimensions(cat, assessments) -> DataFrame:
    """Quality dimensions some active bundle of the tenant denies on at the tier.

    The matrix is JSON: tier -> content class -> dimension -> action. Text that
    is not JSON and classes that are not objects count for nothing; a tier that
    is present but not an object makes the check an error.
    """
    side = assessments.frame.select(KEY, "tenant_id", "tier")
    matrix = F.try_parse_json("action_matrix")

    def at_tier(kind: str) -> Column:
        chosen = F.lit(None)
        for tier in vocab.TIERS:
            chosen = F.when(
                _c("tier") == tier, F.try_variant_get(matrix, f"$.{tier}", kind)
            ).otherwise(chosen)
        return chosen

    bundles = (
        cat["quality_bundles"]
        .where(_c("is_active"))
        .join(side, "tenant_id")
        .withColumn("classes", at_tier("map<string,variant>"))
        .withColumn("shape", F.schema_of_variant(at_tier("variant")))
    )

    def denied(dimension: str) -> Column:
        return F.coalesce(
            F.exists(
                F.map_values("classes"),
                lambda v: F.coalesce(
                    F.try_variant_get(v, f"$.{dimension}", "string") == "deny", F.lit(False)
                ),
            ),
            F.lit(False),
        )

    return bundles.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("active_bundles"),
        n_if(~_c("shape").startswith("OBJECT")).alias("bad_matrices"),
        *[n_if(denied(d)).alias(f"denies_{d}") for d in vocab.QUALITY_DIMENSIONS],
    )


def stale_baselines(cat, assessments, scope_right: bool = False) -> DataFrame:
    """Running agents of the assessed tier whose current baseline is missing or too old."""
    # The bill of materials names a tenant, but no environment.
    on = ["agent_instance_id", "tenant_id"] if scope_right else ["agent_instance_id"]
    agents = (
        assessments.scope_registry(cat["agent_state"], "tier")
        .where((_c("autonomy_tier") == _c("tier")) & (_c("state") == "Run"))
        .groupBy(KEY, *on)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    current = (
        cat["abom"]
        .where(_c("is_current"))
        .groupBy(*on, "current_baseline_hash")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    made = (
        cat["baselines"]
        .groupBy(_c("baseline_hash").alias("current_baseline_hash"), "created_at")
        .agg(F.count(F.lit(1)).alias("made"))
    )
    age = micros(_c("as_of")) - micros(_c("created_at"))
    faulty = _c("made").isNull() | (age > _c("c19_baseline_max_age_days") * DAY_US)
    stale = (
        agents.join(current, on, "left")
        .groupBy(KEY, "current_baseline_hash")
        .agg(F.sum(_c("n") * F.coalesce("m", F.lit(1))).alias("n"))
        .join(made, "current_baseline_hash", "left")
        .join(assessments.side("as_of", "c19_baseline_max_age_days"), KEY)
        .where(faulty)
    )
    # Agents without a current baseline are one reference with an empty key.
    return _total(
        stale, F.sum(_c("n") * F.coalesce("made", F.lit(1))).alias("stale_baselines"),
        stale_baselines=(F.lit(True), reference("baseline_hash", "current_baseline_hash")),
    )


def spans(rows: DataFrame, keys: list[str], width_us: Column) -> DataFrame:
    """Silent spans between consecutive rows of a key that may exceed ``width_us``.

    Inside a bucket no wider than the span looked for, no gap can exceed it, so
    first and last time per bucket are all that is needed: one small row per
    (key, bucket), however many events the key has. Gives ``previous_time`` and
    ``time`` at each pair of neighbouring buckets.
    """
    ends = (
        rows.where(_c("time").isNotNull())
        .groupBy(*keys, time_bucket(_c("time"), F.greatest(width_us, F.lit(1))).alias("slot"))
        .agg(F.min("time").alias("time"), F.max("time").alias("last"))
    )
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("slot"))
    return ends.withColumn("previous_time", before).where(_c("previous_time").isNotNull())


def cadence_gaps(cat, assessments) -> DataFrame:
    """Pauses between consecutive drift decisions longer than the cadence."""
    hours = "c19_drift_decision_cadence_hours"
    limit = (_c(hours) * HOUR_US).cast("bigint")
    rows = assessments.scope(cat["drift_decisions"], hours)
    pairs = spans(rows, [KEY, hours, "agent_instance_id", "dimension"], limit)
    return _total(
        pairs.where(micros(_c("time")) - micros(_c("previous_time")) > _c(hours) * HOUR_US),
        F.count(F.lit(1)).alias("cadence_gaps"),
        cadence_gaps=(F.lit(True), reference("drift_decisions", "agent_instance_id", "dimension")),
    )


def enforced_responses(
    cat, assessments, only_detected: bool = False, scope_right: bool = False
) -> DataFrame:
    """Enforcing response actions tied to a drift decision, per matching decision."""
    on = _right_keys("event_id", scope_right)
    acted = (
        assessments.scope(cat["response_actions"])
        .where(_c("action").isin(*vocab.ENFORCING_RESPONSES))
        .withColumn("event_id", _c("drift_decision_id"))
        .groupBy(KEY, *on)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    drift = cat["drift_decisions"]
    if only_detected:
        drift = drift.where(_c("decision") == "drift_detected")
    known = (
        prefilter(drift, acted, on)
        .where(_c("event_id").isNotNull())
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("m"))
    )
    return (
        acted.join(known, on)
        .groupBy(KEY)
        .agg(F.sum(_c("n") * _c("m")).alias("enforced_responses"))
    )


# name -> (function, columns it yields)
SHAPED: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "unmatched_requests": (unmatched_requests, ("unmatched_requests",)),
    "foreign_callers": (foreign_callers, ("foreign_callers",)),
    "ledger_breaks": (ledger_breaks, ("chain_breaks",)),
    "quarantine_leaks": (quarantine_leaks, ("quarantine_leaks",)),
    "correlated_runs": (correlated_runs, ("semantic_runs", "semantic_runs_correlated")),
    "unknown_policy_bundles": (unknown_policy_bundles, ("unknown_bundles",)),
    "unknown_classifiers": (unknown_classifiers, ("unknown_classifiers",)),
    "approvals_present": (approvals_present, ("approvals_needed", "approvals_signed")),
    "executed_unapproved": (executed_unapproved, ("executed_unapproved",)),
    "unenrolled_agents": (unenrolled_agents, ("unenrolled_agents",)),
    "enforced_dimensions": (
        enforced_dimensions,
        ("active_bundles", "bad_matrices", *[f"denies_{d}" for d in vocab.QUALITY_DIMENSIONS]),
    ),
    "stale_baselines": (stale_baselines, ("stale_baselines",)),
    "cadence_gaps": (cadence_gaps, ("cadence_gaps",)),
    "enforced_responses": (enforced_responses, ("enforced_responses",)),
}

# kind -> names of the samples it can give
REFS: dict[str, tuple[str, ...]] = {table: tuple(told) for table, told in OFFENDERS.items()} | {
    kind: (kind,) for kind in (
        "unmatched_requests", "foreign_callers", "quarantine_leaks", "executed_unapproved",
        "unenrolled_agents", "stale_baselines", "cadence_gaps",
    )
} | {
    "ledger_breaks": ("chain_breaks",), "correlated_runs": ("semantic_runs",),
    "unknown_policy_bundles": ("unknown_bundles",), "unknown_classifiers": ("unknown_classifiers",),
    "approvals_present": ("approvals_needed",),
}

# Metrics that take ``scope_right``: their right-hand tables are then limited to
# the tenant and environment as well.
RIGHT_SCOPED = (
    "unmatched_requests", "quarantine_leaks", "correlated_runs", "approvals_present",
    "executed_unapproved", "unenrolled_agents", "stale_baselines", "enforced_responses",
)

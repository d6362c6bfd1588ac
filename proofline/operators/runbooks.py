"""Data jobs of operational runbooks: incidents, replay, remediation, retirement."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from proofline.functions import vocab
from proofline.functions.exprs import ago, micros, n_if, pct, to_datetime, ts, whole_units
from proofline.functions.running import running
from proofline.functions.skew import (
    NOTHING,
    RIGHT_ROW,
    heavy_keys,
    is_short,
    keep_matching,
    numbered,
    prefilter,
    repeat_rows,
    settled,
    skew_join,
    with_nulls,
)

# Tool categories whose calls change something outside the agent.
SIDE_EFFECTS = ("reversible_write", *vocab.HIGH_IMPACT)
INCIDENT_TABLES = (
    "policy_decisions", "ledger_events", "replay_traces", "semantic_traces", "breaker_events",
)


def _env(df: DataFrame, environment: str | None) -> DataFrame:
    return df if environment is None else df.where(F.col("environment") == environment)


def bundle_onset(cat, as_of, hours: int = 2, n: int = 5, environment: str = "prod") -> DataFrame:
    """The newest policy bundles by first use."""
    return (
        _env(cat["policy_decisions"], environment)
        .where((F.col("time") >= ago(as_of, hours=hours)) & (F.col("time") < ts(as_of)))
        .groupBy("policy_bundle_hash")
        .agg(F.min("time").alias("first_seen"), F.count(F.lit(1)).alias("decisions"))
        .orderBy(F.desc("first_seen"))
        .limit(n)
    )


def locate_runs(cat, as_of, hours: int = 24, n: int = 20, environment: str = "prod") -> DataFrame:
    """The newest runs that used high-impact tools or were halted."""
    return (
        _env(cat["tool_requests"], environment)
        .where(
            (F.col("time") >= ago(as_of, hours=hours)) & (F.col("time") < ts(as_of))
            & (
                F.col("tool_category").isin(*vocab.HIGH_IMPACT)
                | (F.col("decision") == "invariant_halt")
            )
        )
        .groupBy("run_id", "trace_id", "agent_instance_id")
        .agg(F.min("time").alias("run_start"))
        .orderBy(F.desc("run_start"))
        .limit(n)
    )


def hitl_denied(cat, start, end, environment: str = "prod") -> DataFrame:
    """Calls denied for want of an approval in an interval, bounds included."""
    return (
        _env(cat["policy_decisions"], environment)
        .where(
            F.array_contains("reason_codes", "HITL_REQUIRED")
            & (F.col("decision") == "deny")
            & F.col("time").between(ts(start), ts(end))
        )
        .select("run_id", "tool_name", "time", "reason_codes")
    )


def active_runs(cat, as_of, prefix: str, hours: int = 1, environment: str = "prod") -> DataFrame:
    """Runs of agents whose identity starts with ``prefix``, seen lately."""
    return (
        _env(cat["tool_requests"], environment)
        .where(F.col("agent_instance_id").startswith(prefix) & (F.col("time") > ago(as_of, hours=hours))
               & (F.col("time") < ts(as_of)))
        .groupBy("run_id")
        .agg(F.min("time").alias("run_start"), F.max("time").alias("last_activity"))
    )


def last_good_bundle(cat, onset, environment: str | None = None) -> DataFrame:
    """Per tenant and environment, the bundle in force just before the onset."""
    return (
        _env(cat["policy_decisions"], environment)
        .where((F.col("time") < ts(onset)) & F.col("policy_bundle_hash").isNotNull())
        .groupBy("tenant_id", "environment", "policy_bundle_hash")
        .agg(F.max("time").alias("last_used"))
        .groupBy("tenant_id", "environment")
        .agg(
            F.max_by("policy_bundle_hash", F.struct("last_used", "policy_bundle_hash")).alias(
                "policy_bundle_hash"
            ),
            F.max("last_used").alias("last_used"),
        )
    )


def incident_evidence(cat, run_ids: DataFrame) -> dict[str, DataFrame]:
    """The five record kinds of an incident, for the given runs."""
    on = ["run_id"]
    run_ids = run_ids.select(*on).distinct()
    if is_short(run_ids):
        run_ids = settled(run_ids)
    kinds = {
        t: keep_matching(cat[t], run_ids, on) for t in INCIDENT_TABLES if t != "breaker_events"
    }
    # Breakers name several runs per event; keep each event once.
    breaker = cat["breaker_events"]
    affected = breaker.select("event_id", F.explode("affected_run_ids").alias("run_id"))
    hit = keep_matching(affected, run_ids, on)
    kinds["breaker_events"] = keep_matching(breaker, hit, ["event_id"])
    return kinds


def export_incident(cat, run_ids: DataFrame, path: str) -> DataFrame:
    """Write the incident bundle, one directory per kind; returns rows per kind."""
    spark = cat.spark
    counts = None
    for kind, rows in incident_evidence(cat, run_ids).items():
        rows.write.mode("errorifexists").partitionBy("environment").parquet(f"{path}/{kind}")
        written = spark.read.parquet(f"{path}/{kind}").agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows")
        )
        counts = written if counts is None else counts.unionByName(written)
    return counts


def incident_counts(cat, run_ids: DataFrame) -> DataFrame:
    """What an export of these runs would hold."""
    out = None
    for kind, rows in incident_evidence(cat, run_ids).items():
        n = rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


def replay_completeness(cat) -> DataFrame:
    """Per trace, what its steps and its record lack for a replay.

    A trace is listed if it has a step or a record; without a record its model and
    bundle hashes are not known, so it is not complete. Every record of a trace
    counts. Model version, temperature, seed and policy hash, which the runbook also
    names, are not columns of the evidence. One aggregation of both tables, no join.
    """
    call = F.col("step_type") == "tool_call"
    halt = F.col("step_type") == "invariant_halt"
    record = ~F.col("is_step")
    step_columns = ("step_type", "request_hash", "response_hash", "snapshot_uri", "invariant_rule_id")
    record_columns = ("model_id", "prompt_bundle_hash", "tool_schema_hash")

    def lacks(kind, column):
        return n_if(kind & F.col(column).isNull())

    steps = cat["replay_steps"].select("trace_id", F.lit(True).alias("is_step"), *step_columns)
    records = cat["replay_traces"].select("trace_id", F.lit(False).alias("is_step"), *record_columns)
    out = steps.unionByName(records, allowMissingColumns=True).groupBy("trace_id").agg(
        n_if(F.col("is_step")).alias("steps"),
        lacks(call, "request_hash").alias("calls_without_request_hash"),
        lacks(call, "response_hash").alias("calls_without_response_hash"),
        lacks(call, "snapshot_uri").alias("calls_without_snapshot"),
        lacks(halt, "invariant_rule_id").alias("halts_without_rule"),
        n_if(record).alias("records"),
        *[lacks(record, c).alias(f"records_without_{c}") for c in record_columns],
    )
    faults = (
        F.col("calls_without_request_hash") + F.col("calls_without_response_hash")
        + F.col("calls_without_snapshot") + F.col("halts_without_rule")
    )
    for c in record_columns:
        faults = faults + F.col(f"records_without_{c}")
    return out.withColumn("is_complete", (F.col("records") > 0) & (faults == 0))


def replay_compare(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Per run: steps in total, matched and mismatched; PASS iff all match.

    A step matches when both sides have it and all its hashes agree (null
    agrees with null). One aggregation of both sides, no join.
    """
    hashes = F.struct(
        F.coalesce("request_hash", F.lit("")), F.col("request_hash").isNull(),
        F.coalesce("response_hash", F.lit("")), F.col("response_hash").isNull(),
    )
    sides = recorded.select("run_id", "step_index", hashes.alias("h"), F.lit(0).alias("side"))
    sides = sides.unionByName(
        replayed.select("run_id", "step_index", hashes.alias("h"), F.lit(1).alias("side"))
    )
    steps = sides.groupBy("run_id", "step_index").agg(
        F.min("side").alias("lo"), F.max("side").alias("hi"),
        F.min("h").alias("least"), F.max("h").alias("most"),
    )
    same = (F.col("lo") != F.col("hi")) & (F.col("least") == F.col("most"))
    return steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps_total"),
        n_if(same).alias("steps_matched"),
        n_if(~same).alias("steps_mismatched"),
        F.when(n_if(~same) == 0, "PASS").otherwise("FAIL").alias("replay_status"),
    )


def replay_success(compared: DataFrame, min_pct: float = 95) -> DataFrame:
    """Success rate over all replayed runs."""
    total, good = F.count(F.lit(1)), n_if(F.col("replay_status") == "PASS")
    return compared.agg(
        total.alias("runs"), good.alias("runs_passed"), pct(good, total).alias("success_rate_pct")
    ).withColumn("met", F.col("success_rate_pct") >= min_pct)


def containment(cat, slo_s: float = 5, horizon_s: float | None = None) -> DataFrame:
    """Per trigger, seconds to the agent's last side-effecting call that follows.

    A call belongs to the latest trigger of its agent, in its tenant and
    environment, at or before it; ``horizon_s`` bounds how long after it counts.
    No such call means contained at once.
    """
    keys = ["tenant_id", "environment", "agent_instance_id"]
    triggers = (
        cat["breaker_events"]
        .where((F.col("event_type") == vocab.BREAKER_TRIGGER) & F.col("time").isNotNull())
        .select(*keys, "time")
        .distinct()
    )
    calls = cat["tool_requests"].where(
        F.col("tool_category").isin(*SIDE_EFFECTS) & ~F.col("decision").eqNullSafe(F.lit("deny"))
    )
    # Calls at one moment are counted before anything is ordered.
    calls = prefilter(calls, triggers, keys).groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("n"))
    both = triggers.withColumns({"kind": F.lit(0), "n": F.lit(0).cast("bigint")}).unionByName(
        calls.withColumn("kind", F.lit(1))
    )
    placed = running(
        both, keys, "time", F.when(F.col("kind") == 0, F.col("time")), "max", "triggered_at", "kind"
    )
    after = (micros(F.col("time")) - micros(F.col("triggered_at"))) / 1_000_000
    late = F.col("kind") == 1
    if horizon_s is not None:
        late = late & (after <= horizon_s)
    return (
        placed.where(F.col("triggered_at").isNotNull())
        .groupBy(*keys, "triggered_at")
        .agg(
            F.coalesce(F.sum(F.when(late, F.col("n"))), F.lit(0)).alias("calls_after"),
            F.max(F.when(late, F.col("time"))).alias("last_call_at"),
            F.coalesce(F.max(F.when(late, after)), F.lit(0.0)).alias("containment_seconds"),
        )
        .withColumn("met_slo", F.col("containment_seconds") <= slo_s)
    )


def containment_rate(contained: DataFrame) -> DataFrame:
    total, met = F.count(F.lit(1)), n_if(F.col("met_slo"))
    return contained.agg(
        total.alias("triggers"), met.alias("met"), pct(met, total).alias("met_pct")
    )


def _candidates(cat) -> DataFrame:
    """Per candidate: first seen, whether it touches finance or infrastructure."""
    access = F.get_json_object("candidate_payload", "$.access")
    return (
        cat["discovery_events"]
        .where(F.col("candidate_hash").isNotNull())
        .groupBy("tenant_id", "environment", "candidate_hash")
        .agg(
            F.min("time").alias("first_seen"),
            F.coalesce(F.bool_or(access.isin("financial", "infrastructure")), F.lit(False)).alias(
                "high_access"
            ),
        )
    )


def _first_outcomes(cat) -> DataFrame:
    return (
        cat["remediation_outcomes"]
        .where(F.col("candidate_hash").isNotNull())
        .groupBy("tenant_id", "environment", "candidate_hash", "outcome")
        .agg(F.min("time").alias("time"))
        .groupBy("tenant_id", "environment", "candidate_hash")
        .agg(
            F.min("time").alias("resolved_at"),
            F.min_by("outcome", F.struct("time", "outcome")).alias("outcome"),
        )
    )


def ttl_ladder(cat, as_of, ttl_h: float = 72, high_ttl_h: float = 24) -> DataFrame:
    """Where each open candidate stands: alert at half its time, escalate at
    three quarters, terminate when it is up."""
    ttl = F.when(F.col("high_access"), float(high_ttl_h)).otherwise(float(ttl_h))
    keys = ["tenant_id", "environment", "candidate_hash"]
    # An outcome still to come has not resolved anything yet.
    done = _first_outcomes(cat).where(F.col("resolved_at") <= ts(as_of)).select(*keys)
    hours = (micros(ts(as_of)) - micros(F.col("first_seen"))) / (3600 * 1_000_000)
    return (
        _candidates(cat)
        .where(F.col("first_seen") <= ts(as_of))
        .join(done, keys, "left_anti")
        .withColumn("ttl_hours", ttl)
        .withColumn("elapsed_ratio", F.round(hours / F.col("ttl_hours"), 4))
        .withColumn(
            "ladder",
            F.when(hours >= F.col("ttl_hours"), "terminate")
            .when(hours >= F.col("ttl_hours") * 0.75, "escalate")
            .when(hours >= F.col("ttl_hours") * 0.5, "alert")
            .otherwise("wait"),
        )
        .select(*keys, "first_seen", "ttl_hours", "elapsed_ratio", "ladder")
    )


def time_to_remediation(cat) -> DataFrame:
    """Seconds from first discovery to first outcome, per candidate."""
    keys = ["tenant_id", "environment", "candidate_hash"]
    return (
        _candidates(cat)
        .join(_first_outcomes(cat), keys)
        .select(
            *keys, "outcome",
            whole_units("SECOND", F.col("first_seen"), F.col("resolved_at")).alias(
                "time_to_remediation_seconds"
            ),
        )
    )


def quality_timeline(
    cat, start, end, width: str = "1 hour", environment: str | None = None
) -> DataFrame:
    """Quality coverage of memory reads per time slot of an interval."""
    total, gated = F.count(F.lit(1)), F.count("quality_decision_id")
    return (
        _env(cat["memory_responses"], environment)
        .where(
            (F.col("request_type") == "read")
            & (F.col("time") >= ts(start))
            & (F.col("time") < ts(end))
        )
        .groupBy(F.window("time", width).alias("w"))
        .agg(
            total.alias("reads"),
            (total - gated).alias("unevaluated"),
            pct(gated, total).alias("coverage_pct"),
        )
        .select(F.col("w.start").alias("slot_start"), "reads", "unevaluated", "coverage_pct")
    )


def unevaluated_reads(cat, start, end) -> DataFrame:
    return cat["memory_responses"].where(
        (F.col("request_type") == "read")
        & F.col("quality_decision_id").isNull()
        & (F.col("time") >= ts(start))
        & (F.col("time") < ts(end))
    )


def downstream_calls(cat, start, end, within_s: float = 3600) -> DataFrame:
    """Tool calls of a run up to ``within_s`` after a read nobody evaluated."""
    reach = int(within_s * 1_000_000)
    reads = unevaluated_reads(cat, start, end).select("run_id", "time").distinct()
    calls = cat["tool_requests"].where(
        (F.col("time") >= ts(start)) & (F.col("time") <= ts(to_datetime(end) + timedelta(seconds=within_s)))
    ).select("run_id", "time", "request_hash", "tool_name")
    calls = prefilter(calls, reads, ["run_id"])
    # One row per run and moment, however many calls share it.
    moments = calls.select("run_id", "time").distinct().withColumn("kind", F.lit(1))
    placed = running(
        reads.withColumn("kind", F.lit(0)).unionByName(moments),
        ["run_id"], "time", F.when(F.col("kind") == 0, F.col("time")), "max", "read_at", "kind",
    )
    gap = micros(F.col("time")) - micros(F.col("read_at"))
    hits = placed.where((F.col("kind") == 1) & (gap <= reach)).select("run_id", "time", "read_at")
    return skew_join(numbered(calls), hits, ["run_id", "time"], "inner", right_heavy=NOTHING).select(
        "run_id", "request_hash", "tool_name", F.col("time").alias("call_time"), "read_at"
    )


def abom_mismatch(cat) -> DataFrame:
    """Agents whose current bill of materials is not the one their baseline was made for."""
    agents = cat["c04_inventory"].select(
        "agent_instance_id", "tenant_id", "environment", "current_abom_hash"
    )
    current = cat["abom"].where(F.col("is_current")).select(
        "agent_instance_id", F.col("current_baseline_hash").alias("baseline_hash")
    )
    made = cat["baselines"].select("baseline_hash", F.col("abom_hash").alias("baseline_abom_hash"))
    (shared,) = heavy_keys(current, ["baseline_hash"])
    pairs = skew_join(
        numbered(agents), numbered(current, RIGHT_ROW), ["agent_instance_id"], "inner"
    )
    both = skew_join(pairs, numbered(made, RIGHT_ROW), ["baseline_hash"], "inner", shared)
    differ = F.col("current_abom_hash") != F.col("baseline_abom_hash")
    return both.where(differ).drop("__lrow")


def retrieval_shift(cat, first: tuple, second: tuple) -> DataFrame:
    """Share of reads and flag rate per content class in two windows, and the change."""
    def inside(w):
        return (F.col("time") >= ts(w[0])) & (F.col("time") < ts(w[1]))

    flag = F.coalesce(F.col("freshness_flag"), F.lit(False))
    a, b = inside(first), inside(second)
    per_class = (
        cat["memory_responses"]
        .where((F.col("request_type") == "read") & (a | b))
        .groupBy("tenant_id", "environment", "content_class")
        .agg(
            n_if(a).alias("reads_1"), n_if(b).alias("reads_2"),
            n_if(a & flag).alias("flagged_1"), n_if(b & flag).alias("flagged_2"),
        )
    )
    # One row per content class by now; the window groups stay small.
    whole = Window.partitionBy("tenant_id", "environment")

    def ratio(x, y):
        return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))

    out = per_class
    for i in ("1", "2"):
        out = out.withColumn(
            f"share_{i}", ratio(F.col(f"reads_{i}"), F.sum(f"reads_{i}").over(whole))
        ).withColumn(f"flag_rate_{i}", ratio(F.col(f"flagged_{i}"), F.col(f"reads_{i}")))
    return out.select(
        "tenant_id", "environment", "content_class", "reads_1", "reads_2",
        F.round("share_1", 6).alias("share_1"),
        F.round("share_2", 6).alias("share_2"),
        F.round(F.col("share_2") - F.col("share_1"), 6).alias("share_change"),
        F.round(F.col("flag_rate_2") - F.col("flag_rate_1"), 6).alias("flag_rate_change"),
    )


def chain_links(cat, run_ids: DataFrame) -> DataFrame:
    """Per run, how many semantic traces reach each of the five links.

    Goes from the given runs outwards: what a step reached names the rows the
    next one reads, as long as that list is short enough to broadcast.
    """
    cited = cat["semantic_traces"].select("run_id", "audit_ref")
    traces = keep_matching(cited, run_ids, ["run_id"])
    events = cat["ledger_events"].select(
        F.col("ledger_event_id").alias("audit_ref"), F.col("policy_decision_id").alias("decision_id")
    ).where(F.col("audit_ref").isNotNull())
    ledger = settled(
        prefilter(events, traces, ["audit_ref"]).groupBy("audit_ref").agg(F.max("decision_id").alias("decision_id"))
    )
    decisions = settled(
        prefilter(cat["policy_decisions"].where(F.col("decision_id").isNotNull()), ledger, ["decision_id"])
        .groupBy("decision_id").agg(F.max("request_hash").alias("request_hash"))
    )

    def reached(table: str, flag: str) -> DataFrame:
        rows = cat[table].where(F.col("request_hash").isNotNull()).select("request_hash")
        return prefilter(rows, decisions, ["request_hash"]).distinct().withColumn(flag, F.lit(True))

    requests, steps = reached("tool_requests", "requested"), reached("replay_steps", "replayed")
    # Each ledger event is resolved once, however many traces cite it.
    (by_decision,) = heavy_keys(ledger, ["decision_id"])
    (by_hash,) = heavy_keys(decisions, ["request_hash"])
    by_hash = with_nulls(by_hash)
    links = skew_join(
        ledger.withColumn("logged", F.lit(True)),
        decisions.withColumn("decided", F.lit(True)),
        ["decision_id"], "left", by_decision, NOTHING,
    )
    links = skew_join(links, requests, ["request_hash"], "left", by_hash, NOTHING)
    links = skew_join(links, steps, ["request_hash"], "left", by_hash, NOTHING)
    links = links.drop("decision_id", "request_hash")
    (by_ref,) = heavy_keys(cited, ["audit_ref"])
    out = skew_join(traces, links, ["audit_ref"], "left", by_ref, NOTHING)
    flags = ["logged", "decided", "requested", "replayed"]
    per_run = out.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("traces"), *[n_if(F.col(f)).alias(f) for f in flags]
    )
    resolved = F.col("traces") > 0
    for f in flags:
        resolved = resolved & (F.col(f) == F.col("traces"))
    return per_run.withColumn("chain_resolved", resolved)


def envelope_audit(cat, as_of=None) -> DataFrame:
    """Per tenant and environment: messages that reuse a sender's nonce, and
    messages that had expired when sent. The first use of a nonce stands, so a
    group of n uses holds n - 1 faults and nothing needs ranking."""
    rows = cat["agent_messages"]
    if as_of is not None:
        rows = rows.where(F.col("time") < ts(as_of))
    uses = rows.groupBy("tenant_id", "environment", "sender_id", "nonce").agg(
        F.count(F.lit(1)).alias("n"),
        n_if(F.col("expires_at") < F.col("time")).alias("expired"),
    )
    named = F.col("sender_id").isNotNull() & F.col("nonce").isNotNull()
    return uses.groupBy("tenant_id", "environment").agg(
        F.sum("n").alias("messages"),
        F.sum(F.when(named, F.col("n") - 1).otherwise(0)).alias("nonce_reused"),
        F.sum("expired").alias("expired_when_sent"),
    )


def envelope_offences(cat, as_of=None) -> DataFrame:
    """The messages behind ``envelope_audit``: a row per message and reason.

    Of the uses of a sender's nonce the earliest stands (of equal times that with the
    smallest id), the others are ``nonce_reused``; a message past its expiry when sent is
    ``expired_when_sent``. Identical rows are counted together and told apart at the end.
    The earliest use is a minimum, so no group is put in order, and the messages meet it
    in a join whose large side can be split where one nonce is hot.
    """
    keys = ["tenant_id", "environment", "sender_id", "nonce"]
    rows = cat["agent_messages"].select(*keys, "message_id", "time", "expires_at")
    if as_of is not None:
        rows = rows.where(F.col("time") < ts(as_of))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    use = F.struct("time", "message_id", "expires_at")
    named = rows.where("sender_id is not null and nonce is not null")
    firsts = named.groupBy(*keys).agg(F.min(use).alias("earliest"), F.sum("copies").alias("uses"))
    firsts = firsts.where("uses > 1").drop("uses")
    same = F.lit(True)
    for k in keys:
        same = same & named[k].eqNullSafe(F.col(f"of_{k}"))
    firsts = firsts.select(*[F.col(k).alias(f"of_{k}") for k in keys], "earliest")
    reused = named.join(firsts, same).withColumn(
        "copies", F.col("copies") - F.when(use.eqNullSafe(F.col("earliest")), 1).otherwise(0)
    )
    kept = [*keys, "message_id", "time", "copies"]
    told = reused.select(*kept, F.lit("nonce_reused").alias("reason")).unionByName(
        rows.where("expires_at < time").select(*kept, F.lit("expired_when_sent").alias("reason"))
    )
    return repeat_rows(told.where("copies > 0"), "copies")


# How evidence names an agent where it has no agent column.
_SENDER = {
    "agent_messages": "sender_id",
    "discovery_events": "workload_identity",
    "remediation_outcomes": "workload_identity",
}


def agent_evidence(cat, agent: str) -> dict[str, DataFrame]:
    """An agent's rows of every evidence table that can be told to be about it.

    By agent, sender or workload; where a table has none of these, by the runs of
    the agent's requests.
    """
    asked = cat["tool_requests"].where(F.col("agent_instance_id") == agent)
    runs = settled(asked.select("run_id").dropna().distinct())
    found = {}
    for t in sorted(cat):
        rows = cat[t]
        name = "agent_instance_id" if "agent_instance_id" in rows.columns else _SENDER.get(t)
        if name in rows.columns:
            found[t] = rows.where(F.col(name) == agent)
        elif "run_id" in rows.columns:
            found[t] = keep_matching(rows, runs, ["run_id"])
    return found


def archive_agent(cat, agent: str, path: str) -> DataFrame:
    """Copy an agent's evidence, a folder per table; returns rows per table.

    Rows are counted as they are written, and compared with what is read back.
    """
    out = None
    for table, mine in agent_evidence(cat, agent).items():
        seen = Observation(f"archive-{table}")
        counted = mine.observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.mode("errorifexists").parquet(f"{path}/{table}")
        checked = cat.spark.read.parquet(f"{path}/{table}").agg(
            F.lit(table).alias("kind"), F.count(F.lit(1)).alias("n_rows")
        ).withColumn("intact", F.col("n_rows") == seen.get["n"])
        out = checked if out is None else out.unionByName(checked)
    return out


def archive_rows(cat, agent: str) -> DataFrame:
    """What an archive of the agent holds: kind and the row as JSON, one per row."""
    out = None
    for table, mine in agent_evidence(cat, agent).items():
        rows = mine.select(F.lit(table).alias("kind"), F.to_json(F.struct(*sorted(mine.columns))).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def archive_counts(cat, agent: str) -> DataFrame:
    """How many rows of each table an archive of the agent would hold."""
    out = None
    for table, mine in agent_evidence(cat, agent).items():
        n = mine.agg(F.lit(table).alias("kind"), F.count(F.lit(1)).alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out

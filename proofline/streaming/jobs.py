"""Streaming forms of checks that matter while events arrive.

All but one are built-in stateful operators in append mode, so state is kept per
key and window and rows are combined before the shuffle where an aggregate
allows it. Rows later than the watermark go uncounted; the batch operators over the
stored tables are the authority.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from proofline.functions import vocab
from proofline.functions.exprs import micros, n_if, pct, ts


def _instant(time: Column) -> Column:
    return F.timestamp_micros(micros(time))


def _clocked(stream: DataFrame, delay: str) -> DataFrame:
    """The stream with ``time`` as an instant (UTC) under a watermark.

    Watermarks need an instant; evidence times are zone-less and mean UTC.
    """
    return stream.withColumn("time", _instant(F.col("time"))).withWatermark("time", delay)


def _plain(instant: Column) -> Column:
    """An instant back as a zone-less UTC time."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), ts("1970-01-01 00:00:00"))


def undecided_requests(
    requests: DataFrame, decisions: DataFrame, within: str = "10 minutes",
    delay: str = "10 minutes", slots: int = 1,
) -> DataFrame:
    """Requests that got no decision within ``within``, either way in time.

    Requests without a hash can match nothing and are reported at once. If one
    hash holds a large share of the requests, ``slots`` spreads its requests,
    and every decision is then copied that often.
    """
    asked = _clocked(requests, delay).select(
        "tenant_id", "environment", "request_hash", F.col("time").alias("request_time"),
        F.pmod(F.xxhash64("trace_id", "run_id", "time"), F.lit(slots)).cast("int").alias("slot"),
    )
    copies = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))) if slots > 1 else F.lit(0)
    decided = (
        _clocked(decisions, delay)
        .where(F.col("decision_id").isNotNull() & F.col("request_hash").isNotNull())
        .select(F.col("request_hash").alias("decided_hash"), F.col("time").alias("decided_at"),
                copies.alias("decided_slot"))
    )
    span = F.expr(f"INTERVAL {within}")
    same = (F.col("request_hash") == F.col("decided_hash")) & (
        F.col("slot") == F.col("decided_slot")
    )
    in_time = (F.col("decided_at") >= F.col("request_time") - span) & (
        F.col("decided_at") <= F.col("request_time") + span
    )
    late = (
        asked.where(F.col("request_hash").isNotNull())
        .join(decided, same & in_time, "left")
        .where(F.col("decided_hash").isNull())
        .select(*asked.columns)
    )
    missing = late.unionByName(asked.where(F.col("request_hash").isNull()))
    return missing.withColumn("request_time", _plain(F.col("request_time"))).drop("slot")


CHAIN = ("tenant_id", "environment", "sink_uri")


def ledger_faults(
    ledger: DataFrame, again: DataFrame, stored: DataFrame, within: str = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Ledger rows that do not continue their chain.

    A break: the row before by sequence number is there, but none with the hash
    the row names (GENESIS names none). A gap: the chain has earlier rows, but
    not the one before.

    The stream is joined with itself (``again``) on (chain, sequence - 1, hash),
    so arrival order does not matter and a long chain is spread over all tasks.
    What finds no predecessor within ``within`` is settled against ``stored``,
    the ledger as a table, so the age of a predecessor makes no fault. For rows
    that come in while the stream runs, ``stored`` must be a table whose new
    rows each micro-batch sees.
    """
    rows = _clocked(ledger, delay).select(
        *CHAIN, "sequence_number", "prev_event_hash", F.col("time").alias("row_time")
    )
    prior = _clocked(again, delay).select(
        *[F.col(c).alias(f"p_{c}") for c in CHAIN],
        (F.col("sequence_number") + 1).alias("p_next"),
        F.col("event_hash").alias("p_hash"),
        F.col("time").alias("p_time"),
    )
    span = F.expr(f"INTERVAL {within}")
    same = (
        (F.col("sequence_number") == F.col("p_next"))
        & (F.col("prev_event_hash") == F.col("p_hash"))
        & (F.col("p_time") >= F.col("row_time") - span)
        & (F.col("p_time") <= F.col("row_time") + span)
    )
    for c in CHAIN:
        same = same & (F.col(c) == F.col(f"p_{c}"))
    unsettled = rows.join(prior, same, "left").where("p_next is null").select(*rows.columns)

    there = stored.dropna(subset=[*CHAIN, "sequence_number"])
    hashes = there.select(
        *CHAIN, (F.col("sequence_number") + 1).alias("sequence_number"),
        F.col("event_hash").alias("prev_event_hash"),
    ).distinct()
    before = hashes.select(*CHAIN, "sequence_number").distinct().withColumn("has_before", F.lit(True))
    starts = there.groupBy(*CHAIN).agg(F.min("sequence_number").alias("starts_at"))
    left = (
        unsettled.join(hashes, [*CHAIN, "sequence_number", "prev_event_hash"], "left_anti")
        .join(before, [*CHAIN, "sequence_number"], "left")
        .join(starts, [*CHAIN], "left")
    )
    fault = F.when(
        F.col("has_before"),
        F.when(F.col("prev_event_hash") != "GENESIS", "HASH_CHAIN_BREAK"),
    ).when(F.col("sequence_number") > F.col("starts_at"), "SEQUENCE_GAP")
    return (
        left.withColumn("fault", fault)
        .where(F.col("fault").isNotNull())
        .select(*CHAIN, "sequence_number", _plain(F.col("row_time")).alias("row_time"), "fault")
    )


# Alert name and share of the time a candidate has.
RUNGS = (("alert", 0.5), ("escalate", 0.75), ("terminate", 1.0))
_CANDIDATE = ["tenant_id", "environment", "candidate_hash"]


def ttl_alerts(
    discoveries: DataFrame, outcomes: DataFrame, ttl_h: float = 72, high_ttl_h: float = 24,
    delay: str = "10 minutes", bundles: int = 4096,
) -> DataFrame:
    """One alert per candidate and rung reached before any outcome.

    A candidate is a tenant's, in an environment, and its time runs from its first
    discovery. Spark has no built-in operator with a timer per key, so this is
    a state per candidate: first discovery, first outcome, the time it has and
    the rungs reported. Once the watermark has passed a rung and no outcome has
    come up to then, the timer reports it. The candidates of a bundle, one of ``bundles``
    by hash, share a state and a timer, so Python is called per bundle and not per
    candidate; a running job keeps the number of bundles it began with.
    """
    access = F.get_json_object("candidate_payload", "$.access")
    high = F.coalesce(access.isin("financial", "infrastructure"), F.lit(False))
    seen = discoveries.select(*_CANDIDATE, "time", high.alias("high"), F.lit(False).alias("done"))
    done = outcomes.select(*_CANDIDATE, "time", F.lit(False).alias("high"), F.lit(True).alias("done"))
    events = _clocked(seen.unionByName(done), delay).where(F.col("time").isNotNull())
    events = events.dropna(subset=_CANDIDATE).withColumn("us", F.unix_micros("time"))

    def advance(key, frames, state):
        # Candidate -> first discovery, first outcome, whether its time is short, rungs reported.
        held = zip(*state.get) if state.exists else ()
        known = {(t, e, c): row for t, e, c, *row in held}
        if not state.hasTimedOut:
            for frame in frames:
                for *candidate, us, high, done in zip(*[frame[c].tolist() for c in (*_CANDIDATE, "us", "high", "done")]):
                    row = known.setdefault(tuple(candidate), [None, None, False, 0])
                    if done:
                        row[1] = us if row[1] is None else min(us, row[1])
                    else:
                        row[0] = us if row[0] is None else min(us, row[0])
                        row[2] = row[2] or high
        mark_us = state.getCurrentWatermarkMs() * 1000
        rows, next_us = [], None
        for candidate, row in known.items():
            first, resolved, risky, fired = row
            if first is None:
                continue
            hours = high_ttl_h if risky else ttl_h
            while fired < len(RUNGS):
                due = first + int(hours * RUNGS[fired][1] * 3_600_000_000)
                if resolved is not None and resolved <= due:
                    break
                if due >= mark_us:
                    next_us = due if next_us is None else min(due, next_us)
                    break
                rows.append((*candidate, RUNGS[fired][0], pd.Timestamp(due, unit="us")))
                fired += 1
            row[3] = fired
        state.update(tuple(list(c) for c in zip(*[(*candidate, *row) for candidate, row in known.items()])))
        if next_us is not None:
            state.setTimeoutTimestamp(max(next_us // 1000, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[*_CANDIDATE, "rung", "alert_at"])

    number = F.pmod(F.xxhash64(*_CANDIDATE), F.lit(bundles)).cast("int").alias("bundle")
    return events.select(number, *_CANDIDATE, "time", "us", "high", "done").groupBy("bundle").applyInPandasWithState(
        advance,
        "tenant_id string, environment string, candidate_hash string, rung string, alert_at timestamp_ntz",
        ", ".join(f"{c} array<string>" for c in _CANDIDATE)
        + ", first array<bigint>, resolved array<bigint>, risky array<boolean>, fired array<int>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def quality_timeline(
    reads: DataFrame, width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Quality coverage of memory reads per closed time slot."""
    total, gated = F.count(F.lit(1)), F.count("quality_decision_id")
    return (
        _clocked(reads, delay)
        .where(F.col("request_type") == "read")
        .groupBy(F.window("time", width).alias("w"))
        .agg(
            total.alias("reads"),
            (total - gated).alias("unevaluated"),
            pct(gated, total).alias("coverage_pct"),
        )
        .select(_plain(F.col("w.start")).alias("slot_start"), "reads", "unevaluated", "coverage_pct")
    )


def drift_silence(
    drift: DataFrame, cadence_hours: int = 24, delay: str = "10 minutes"
) -> DataFrame:
    """Agents and dimensions silent for longer than the cadence.

    Events no further apart than the cadence form a session; a session that
    closes means that nothing came in time after its last event. Unlike the
    batch check this also reports silence that has not ended yet.
    """
    gap = f"{cadence_hours * 3600} seconds 1 microseconds"
    return (
        _clocked(drift, delay)
        .groupBy(
            F.session_window("time", gap).alias("w"), "tenant_id", "environment",
            "agent_instance_id", "dimension",
        )
        .agg(F.max("time").alias("silent_since"), F.count(F.lit(1)).alias("decisions"))
        .withColumn("silent_since", _plain(F.col("silent_since")))
        .drop("w")
    )


def spend_anomalies(
    requests: DataFrame, width: str = "1 day", slide: str = "6 hours", max_cost: float = 5.0,
    max_calls: int = 100, max_high_impact: int = 5, delay: str = "10 minutes",
) -> DataFrame:
    """Runs over a limit within a sliding window."""
    return (
        _clocked(requests, delay)
        .groupBy(F.window("time", width, slide).alias("w"), "run_id", "agent_instance_id")
        .agg(
            F.sum("cost_usd").alias("total_cost_usd"),
            F.count(F.lit(1)).alias("total_tool_calls"),
            n_if(F.col("tool_category").isin(*vocab.HIGH_IMPACT)).alias("high_impact_calls"),
        )
        .where(
            (F.col("total_cost_usd") > max_cost)
            | (F.col("total_tool_calls") > max_calls)
            | (F.col("high_impact_calls") > max_high_impact)
        )
        .select(
            _plain(F.col("w.start")).alias("window_start"), "run_id", "agent_instance_id",
            "total_cost_usd", "total_tool_calls", "high_impact_calls",
        )
    )


def nonce_replays(
    messages: DataFrame, retention_hours: int = 24, delay: str = "10 minutes"
) -> DataFrame:
    """Nonces a sender used again within ``retention_hours`` of a use.

    Uses no further apart than that form a session, wherever the day begins; a
    session with two uses or more is a replay.
    """
    gap = f"{retention_hours * 3600} seconds 1 microseconds"
    return (
        _clocked(messages, delay)
        .where(F.col("nonce").isNotNull() & F.col("sender_id").isNotNull())
        .groupBy(F.session_window("time", gap).alias("w"), "tenant_id", "environment",
                 "sender_id", "nonce")
        .agg(F.min("time").alias("first_use"), F.max("time").alias("last_use"),
             F.count(F.lit(1)).alias("uses"))
        .where(F.col("uses") > 1)
        .select("tenant_id", "environment", "sender_id", "nonce",
                _plain(F.col("first_use")).alias("first_use"),
                _plain(F.col("last_use")).alias("last_use"), "uses")
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint directory the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # One machine is the whole cluster, as in tests.
        base = f"file://{tempfile.mkdtemp(prefix='proofline-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/proofline-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, store its rows, and read them back."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{folder}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

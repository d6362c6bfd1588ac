"""Alerts that come at once, and silence of agents that never reported."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.operators.correlate import agent_silence
from proofline.sources.catalog import EvidenceCatalog, normalise
from proofline.streaming import jobs
from proofline.streaming import stateful as st
from tests.conftest import frame

SCOPE = {"tenant_id": "acme", "environment": "prod"}


def at(day, clock="00:00:00"):
    return f"2024-02-{day:02d} {clock}"


@pytest.fixture
def feed(spark, tmp_path):
    """feed(table, batches): a stream that takes one file per micro-batch, in order."""

    def make(table, batches):
        folder = tmp_path / table
        for i, rows in enumerate(batches):
            df = normalise(frame(spark, table, rows), table)
            df.coalesce(1).write.mode("append").parquet(str(folder))
            (new,) = [p for p in folder.glob("part-*.parquet") if not p.name.startswith("part-b")]
            new.rename(folder / f"part-b{i}.parquet")
            for crc in folder.glob(".part-*.crc"):
                crc.unlink()
            stamp = 1_700_000_000 + i * 10
            os.utime(folder / f"part-b{i}.parquet", (stamp, stamp))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return stream, normalise(frame(spark, table, [r for rows in batches for r in rows]), table)

    return make


def use(nonce, time, sender="s"):
    return {**SCOPE, "message_id": "m", "sender_id": sender, "nonce": nonce, "time": time}


def told(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_sessions_merge_in_any_order_and_pieces():
    rng = np.random.default_rng(2)
    for _ in range(50):
        times = rng.integers(0, 400, rng.integers(1, 60))
        whole = st.sessions(times, 9)
        found = []
        for part in np.array_split(rng.permutation(times), rng.integers(1, 6)):
            found = st.merged([*found, *st.sessions(part, 9)], 9)
        assert found == whole
        ordered = np.sort(times)
        assert len(whole) == 1 + (np.diff(ordered) > 9).sum() and whole[0].first == ordered[0]


def test_a_replay_is_told_at_its_second_use(spark, feed):
    stream, _ = feed("agent_messages", [
        [use("a", at(1)), use("b", at(1)), use("c", at(1)), use("c", at(1)), use(None, at(1)), use(None, at(1))],
        [use("a", at(1, "20:00:00")), use("b", at(2, "00:00:00.000001"))],  # b: a microsecond after its day
        [use("a", at(1, "21:00:00")), use("a", at(1), "other"), use("b", at(2, "05:00:00"))],
        [use("z", at(20))],
        [use("a", at(20, "01:00:00"))],
    ])
    alerts = jobs.drain(st.nonce_alerts(stream))
    assert told(alerts) == sorted([
        ("acme", "prod", "s", "a", at(1), at(1, "20:00:00")),
        ("acme", "prod", "s", "c", at(1), at(1)),
        ("acme", "prod", "s", "b", at(2, "00:00:00.000001"), at(2, "05:00:00")),
    ])


def test_the_same_in_one_batch_or_many(spark, feed, tmp_path):
    rng = np.random.default_rng(5)
    rows = [use(f"n{rng.integers(6)}", f"2024-02-{1 + h // 24:02d} {h % 24:02d}:00:00") for h in sorted(rng.integers(0, 240, 60))]
    many, whole = feed("agent_messages", [rows[:20], rows[20:41], rows[41:]])
    once = normalise(whole, "agent_messages")
    path = str(tmp_path / "once")
    once.coalesce(1).write.parquet(path)
    single = spark.readStream.schema(once.schema).parquet(path)
    assert told(jobs.drain(st.nonce_alerts(many))) == told(jobs.drain(st.nonce_alerts(single)))


def test_a_nonce_is_forgotten_after_its_retention(spark, feed, tmp_path):
    stream, _ = feed("agent_messages", [[use("a", at(1)), use("b", at(9))], [use("b", at(9, "01:00:00"))], [use("c", at(9, "02:00:00"))]])
    folder = str(tmp_path / "run")
    jobs.drain(st.nonce_alerts(stream), folder)
    held = (
        spark.read.format("statestore").option("stateVarName", "session").load(f"{folder}/state")
        .select(F.col("key.nonce").alias("nonce"))
    )
    assert sorted(r.nonce for r in held.collect()) == ["b", "c"]


def drift(agent, time, dimension="tone"):
    return {**SCOPE, "event_id": "e", "event_type": "x", "agent_instance_id": agent, "dimension": dimension, "decision": "no_drift", "time": time}


def roster(spark):
    rows = [{**SCOPE, "agent_instance_id": a, "state": s, "autonomy_tier": "bounded"} for a, s in (("quiet", "Run"), ("works", "Run"), ("stopped", "Quiesce"))]
    return normalise(frame(spark, "agent_state", rows), "agent_state")


def test_an_agent_that_never_reported_is_told_of_in_stream_and_batch(spark, feed):
    since, dims = at(1), ("tone", "tools")
    batches = [
        [drift("works", at(1)), drift("works", at(1, "12:00:00")), drift("quiet", "2024-01-30 00:00:00")],
        [drift("works", at(2, "06:00:00")), drift("works", at(1, "20:00:00"), "tools")],
        [drift("works", at(4)), drift("new", at(4)), drift("stopped", at(4))],
        [drift("works", at(4, "23:00:00")), drift("last", at(7, "00:10:00"))],
    ]
    stream, stored = feed("drift_decisions", batches)
    alerts = jobs.drain(st.silence_alerts(stream, roster(spark), since, dims))
    cat = EvidenceCatalog(spark, {"drift_decisions": stored, "agent_state": roster(spark)})
    # The watermark ends ten minutes before the last event.
    batch = agent_silence(cat, at(7), since, dims)
    assert told(alerts) == told(batch.where("agent_instance_id <> 'last'"))
    assert ("acme", "prod", "quiet", "tone", at(1), "False") in told(batch)
    assert ("acme", "prod", "quiet", "tools", at(1), "False") in told(batch)
    assert ("acme", "prod", "works", "tone", at(2, "06:00:00"), "True") in told(batch)
    assert ("acme", "prod", "works", "tools", at(1, "20:00:00"), "True") in told(batch)
    assert not any(r[2] == "stopped" and r[5] == "False" for r in told(batch))


def test_silence_of_an_empty_store(spark, good):
    none = good.replaced(drift_decisions=frame(spark, "drift_decisions", []), agent_state=roster(spark))
    assert {r[2] for r in told(agent_silence(none, at(5), at(1), ("tone",)))} == {"quiet", "works"}
    assert told(agent_silence(none, at(2), at(1), ("tone",))) == []  # just the cadence

"""Alerts whose keys share states, so that Python is not called once per key."""

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from proofline.operators.correlate import agent_silence
from proofline.sources.catalog import EvidenceCatalog, normalise
from proofline.streaming import jobs
from proofline.streaming import stateful as st
from tests.conftest import frame
from tests.test_alerts import SCOPE, at, drift, feed, told  # noqa: F401


def test_silence_of_many_agents_takes_a_state_per_bundle(spark, feed, tmp_path):  # noqa: F811
    rng = np.random.default_rng(11)
    hours = sorted(rng.integers(0, 240, 120))
    rows = [drift(f"a{rng.integers(40)}", f"2024-02-{1 + h // 24:02d} {h % 24:02d}:00:00") for h in hours]
    rows = [{**drift("a1", at(1)), "agent_instance_id": None}, *rows, drift("last", at(13, "00:10:00"))]
    listed = [{**SCOPE, "agent_instance_id": f"a{i}", "state": "Run", "autonomy_tier": "bounded"} for i in range(60)]
    agents = normalise(frame(spark, "agent_state", listed), "agent_state")
    stream, stored = feed("drift_decisions", [rows[:50], rows[50:90], rows[90:]])
    folder = str(tmp_path / "run")
    alerts = jobs.drain(st.silence_alerts(stream, agents, at(1), ("tone",), bundles=3), folder)
    cat = EvidenceCatalog(spark, {"drift_decisions": stored, "agent_state": agents})
    batch = agent_silence(cat, at(13), at(1), ("tone",)).where("coalesce(agent_instance_id, '') <> 'last'")
    assert told(alerts) == told(batch) and len(told(batch)) > 60
    states = spark.read.format("statestore").option("stateVarName", "sessions").load(f"{folder}/state")
    assert 1 <= states.count() <= 3
    assert states.select(F.sum(F.size("value.first"))).first()[0] == 62


def test_candidates_take_a_state_per_bundle(spark, feed, tmp_path):  # noqa: F811
    def found(c, time, access="read_only"):
        return {**SCOPE, "event_id": "e", "candidate_hash": c, "workload_identity": "w", "time": time,
                "candidate_payload": f'{{"access": "{access}"}}'}

    def over(c, time):
        return {**SCOPE, "event_id": "o", "candidate_hash": c, "outcome": "enrolled", "time": time}

    seen = [[found(f"c{i}", at(1, f"{i:02d}:00:00")) for i in range(20)],
            [found("c3", at(2), "financial"), found("c4", at(2))],
            [found("end", at(9))]]
    done = [[over("c5", at(1, "00:00:00"))], [over("c6", at(3, "00:00:00"))], [over("far", at(9))]]
    folder = str(tmp_path / "run")
    alerts = jobs.drain(
        jobs.ttl_alerts(feed("discovery_events", seen)[0], feed("remediation_outcomes", done)[0], bundles=2), folder
    )
    want = []
    for i in range(20):
        for rung, share in jobs.RUNGS:
            due = i + 72 * share if i != 3 else None
            if i == 5 or (i == 6 and due >= 48) or due is None:
                continue
            want.append((f"c{i}", rung, f"2024-02-{1 + int(due) // 24:02d} {int(due) % 24:02d}:00:00"))
    got = [(r[2], r[3], r[4]) for r in told(alerts)]
    assert sorted(r for r in got if r[0] != "c3") == sorted(want)
    # Known as financial on the second day: a rung told of before is not told of again.
    assert [r[1] for r in sorted(got, key=lambda r: r[2]) if r[0] == "c3"] == [n for n, _ in jobs.RUNGS]
    states = spark.read.format("statestore").load(f"{folder}/state")
    assert 1 <= states.count() <= 2


class _Counted:
    """A state and its timers that count the calls to them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at_ms):
        self.calls.append("register")
        self.timers.add(at_ms)

    def deleteTimer(self, at_ms):
        self.calls.append("delete")
        self.timers.remove(at_ms)


def test_a_nonce_costs_few_calls_for_its_state():
    held, processor = _Counted(), st._Replays(10_000)
    processor.init(held)

    def uses(*times):
        held.calls = []
        return [(r.first_use.value, r.replayed_at.value) for r in processor.handleInputRows(("t", "e", "s", "n"), iter([Row(us=t) for t in times]), None)]

    assert uses(5_000) == [] and held.calls == ["get", "update", "register"] and held.timers == {16}
    assert uses(9_000) == [(5_000_000, 9_000_000)]  # nanoseconds
    assert held.calls == ["get", "update", "delete", "register"] and held.timers == {20}
    assert uses(8_000) == [] and "register" not in held.calls and held.timers == {20}
    assert uses(40_000, 30_001, 90_000) == [(30_001_000, 40_000_000)] and held.timers == {101}

"""The messages behind the envelope audit."""

from collections import Counter

from proofline.operators.runbooks import envelope_audit, envelope_offences
from tests.conftest import day, frame

SCOPE = {"tenant_id": "acme", "environment": "prod"}


def message(i, nonce, time, sender="s", expires=None):
    return {**SCOPE, "message_id": i, "sender_id": sender, "nonce": nonce, "time": time, "expires_at": expires or day(28)}


def test_every_offending_message_with_its_reason(spark, good):
    rows = [message(f"h{i:04d}", "hot", day(1 + i % 20, f"{i % 24:02d}:00:00")) for i in range(600)]  # half of all
    rows += [message(f"o{i}", f"n{i}", day(3)) for i in range(590)]
    rows += [message("twin", "t", day(4))] * 3  # identical rows
    rows += [message("b", "tie", day(5)), message("a", "tie", day(5)), message("x", None, day(6)), message("y", None, day(6), expires=day(2))]
    rows += [message("late", "n1", day(1), expires=day(1, "01:00:00"))]
    cat = good.replaced(agent_messages=frame(spark, "agent_messages", rows))
    got = envelope_offences(cat).collect()
    reused = Counter(r.message_id for r in got if r.reason == "nonce_reused")
    assert "h0000" not in reused and sum(n for m, n in reused.items() if m[0] == "h") == 599
    assert reused["twin"] == 2 and reused["b"] == 1 and reused["a"] == 0 and reused["o1"] == 1 and reused["late"] == 0
    assert {r.message_id for r in got if r.reason == "expired_when_sent"} == {"y", "late"}
    (total,) = envelope_audit(cat).collect()
    assert (total.nonce_reused, total.expired_when_sent) == (sum(reused.values()), 2)
    assert envelope_offences(cat, day(1, "00:00:00")).count() == 0

"""Streams that speak up at once: a state per key, kept by event-time timers.

Both jobs see a key's events as sessions, runs of events no further apart than a gap.
A session is three times, first, second and last, and sessions merge, so the events of
a key come in pieces of any size and in any order within a micro-batch, and what is
held of them is a few numbers per session and not the events. The state keeps the
latest session of a key; a timer drops it, or reports the silence, once the watermark
has passed its end. Timers run on event time, as the state's own time-to-live, which
Spark keeps by the wall clock, would drop nothing when stored events are replayed.

These jobs need the RocksDB state store: ``use_rocksdb(spark)`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from proofline.functions.exprs import micros, ts
from proofline.streaming.jobs import _clocked

HOUR_US = 3_600_000_000
BUNDLES = 4096
CHUNK = 10_000  # events of a key taken at once


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


class Session(NamedTuple):
    first: int
    second: int | None  # of its events in time order; null while there is one
    last: int


def sessions(times: np.ndarray, gap: int) -> list[Session]:
    """The sessions of some events, times in any order."""
    t = np.sort(times)
    cuts = np.flatnonzero(np.diff(t) > gap) + 1
    return [
        Session(int(t[a]), int(t[a + 1]) if b - a > 1 else None, int(t[b - 1]))
        for a, b in zip([0, *cuts], [*cuts, len(t)]) if b > a
    ]


def merged(found: Iterable[Session], gap: int) -> list[Session]:
    """Sessions in time order, those within the gap of each other as one."""
    out: list[Session] = []
    for s in sorted(found, key=lambda s: (s.first, s.last)):
        if out and s.first - out[-1].last <= gap:
            p = out.pop()
            first, second, *_ = sorted(x for x in (p.first, p.second, s.first, s.second) if x is not None)
            s = Session(first, second, max(p.last, s.last))
        out.append(s)
    return out


def bundle(columns: Iterable[str], bundles: int) -> Column:
    """One of ``bundles`` numbers for a key: the keys of a number share a state, so that
    Python is called once for all of them that a micro-batch brings."""
    return F.pmod(F.xxhash64(*columns), F.lit(bundles)).cast("int").alias("bundle")


def _rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """Tuples of some text columns, with None for nulls."""
    return list(zip(*[[v if isinstance(v, str) else None for v in frame[c]] for c in columns]))


def _plain_time(us: int | None) -> pd.Timestamp | None:
    return None if us is None else pd.Timestamp(us, unit="us")


_MESSAGE = ["tenant_id", "environment", "sender_id", "nonce"]


class _Replays(StatefulProcessor):
    """Keeps a key's latest session, told of if it has a second use.

    Every access to state and timers is a call out of Python, so there are no more of them
    than a get, an update and a timer: where the old timer stands follows from the session.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "first bigint, second bigint, last bigint")

    def _ends(self, s: Session) -> int:
        """The first millisecond at which nothing can join the session any more."""
        return (s.last + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        before = Session(*held) if held is not None else None
        found = [before] if before else []
        while times := [r.us for r in islice(rows, CHUNK)]:
            new = [Session(times[0], None, times[0])] if len(times) == 1 else sessions(np.array(times), self.gap)
            found = merged([*found, *new], self.gap)
        latest = found[-1]
        if latest != before:
            self.state.update(tuple(latest))
        if before is None or self._ends(latest) != self._ends(before):
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(latest))
        # A session told of before lives on in the one that holds it.
        told = before is not None and before.second is not None
        for s in found:
            if s.second is not None and not (told and s.first <= before.last <= s.last):
                times = {"first_use": _plain_time(s.first), "replayed_at": _plain_time(s.second)}
                yield Row(**dict(zip(_MESSAGE, key)), **times)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def nonce_alerts(messages: DataFrame, retention_hours: int = 24, delay: str = "10 minutes") -> DataFrame:
    """A nonce that a sender uses again within ``retention_hours``, told at its second use.

    One alert per run of uses no further apart than that: its first use and the second
    one. An alert names the earliest two uses that have come in by then, and a use that
    comes in later does not change it. A nonce is forgotten once the watermark is
    ``retention_hours`` past its last use.
    """
    use_rocksdb(messages.sparkSession)
    uses = (
        _clocked(messages, delay)
        .where(F.col("time").isNotNull() & F.col("nonce").isNotNull() & F.col("sender_id").isNotNull())
        .select(*_MESSAGE, "time", F.unix_micros("time").alias("us"))
    )
    # By rows: most nonces are used once, and a pandas frame for one row costs more than its work.
    return uses.groupBy(*_MESSAGE).transformWithState(
        _Replays(retention_hours * HOUR_US),
        "tenant_id string, environment string, sender_id string, nonce string, "
        "first_use timestamp_ntz, replayed_at timestamp_ntz",
        "append", "eventtime",
    )


_WATCHED = ["tenant_id", "environment", "agent_instance_id", "dimension"]


class _Silence(StatefulProcessor):
    """Keeps, for each key of a bundle, the latest session, whether it has been told of, and
    whether the key was in the initial state. One timer stands for the first of them to end."""

    def __init__(self, gap: int, since: int):
        self.gap, self.since = gap, since

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "sessions",
            ", ".join(f"{c} array<string>" for c in _WATCHED) + ", first array<bigint>, second array<bigint>, "
            "last array<bigint>, told array<boolean>, listed array<boolean>, timer bigint",
        )

    def _known(self) -> tuple[dict[tuple, tuple[Session, bool, bool]], int | None]:
        held = self.state.get()
        if held is None:
            return {}, None
        *columns, timer = held
        n = len(_WATCHED)
        return {row[:n]: (Session(*row[n : n + 3]), row[-2], row[-1]) for row in zip(*columns)}, timer

    def _ends(self, s: Session) -> int:
        """The first millisecond at which nothing can join the session any more."""
        return (s.last + self.gap) // 1000 + 1

    def _keep(self, known: dict[tuple, tuple[Session, bool, bool]], timer: int | None) -> None:
        due = min((self._ends(s) for s, told, _ in known.values() if not told), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        rows = [(*key, *s, told, listed) for key, (s, told, listed) in known.items()]
        self.state.update((*[list(c) for c in zip(*rows)], due))

    def _told(self, key: tuple, s: Session, listed: bool) -> tuple:
        # The first event of a listed key is that watching began.
        reported = not listed or s.first != self.since or s.second is not None
        return (*key, _plain_time(s.last), reported)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*_WATCHED, "silent_since", "ever_reported"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        known, timer = self._known()
        known |= {k: (Session(self.since, None, self.since), False, True) for k in _rows(initialState, _WATCHED)}
        if known:
            self._keep(known, timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self._known()
        found: dict[tuple, list[Session]] = {}
        for frame in rows:
            times: dict[tuple, list[int]] = {}
            for k, us in zip(_rows(frame, _WATCHED), frame["us"].tolist()):
                if us >= self.since:
                    times.setdefault(k, []).append(us)
            for k, each in times.items():
                before = found.get(k) or ([known[k][0]] if k in known else [])
                found[k] = merged([*before, *sessions(np.array(each), self.gap)], self.gap)
        out = []
        for k, now in found.items():
            before, told, listed = known.get(k, (None, False, False))
            out += [self._told(k, s, listed) for s in now[:-1] if not (told and s.last == before.last)]
            known[k] = now[-1], told and now[-1].last == before.last, listed
        if found:
            self._keep(known, timer)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, _ = self._known()
        mark = timerValues.getCurrentWatermarkInMs()
        out = []
        for k, (s, told, listed) in known.items():
            if not told and self._ends(s) < mark:
                out.append(self._told(k, s, listed))
                known[k] = s, True, listed
        self._keep(known, None)  # the timer that has expired is gone
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def watched(roster: DataFrame, dimensions: Iterable[str]) -> DataFrame:
    """(tenant, environment, agent, dimension) of the running agents of ``agent_state``."""
    each = F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension")
    return roster.where("state = 'Run'").select("tenant_id", "environment", "agent_instance_id", each).distinct()


def silence_alerts(
    drift: DataFrame, roster: DataFrame, since, dimensions: Iterable[str], cadence_hours: int = 24,
    delay: str = "10 minutes", bundles: int = BUNDLES,
) -> DataFrame:
    """Agents that owe a drift decision in a dimension, also such as have never made one.

    Every running agent of the ``roster`` is watched from ``since`` on, by an initial
    state with a timer; others from their first decision. ``silent_since`` is the last
    decision, or ``since`` where ``ever_reported`` is false. An alert comes once the
    watermark is more than the cadence past that. Decisions before ``since`` do not count.
    The state is held in ``bundles`` of keys; a running job keeps the number it began with.
    """
    use_rocksdb(drift.sparkSession)
    start = drift.sparkSession.range(1).select(micros(ts(since)).alias("us")).first()["us"]
    events = (
        _clocked(drift, delay)
        .where(F.col("time").isNotNull())
        .select(bundle(_WATCHED, bundles), *_WATCHED, "time", F.unix_micros("time").alias("us"))
    )
    listed = watched(roster, dimensions).select(bundle(_WATCHED, bundles), *_WATCHED)
    return events.groupBy("bundle").transformWithStateInPandas(
        _Silence(cadence_hours * HOUR_US, start),
        "tenant_id string, environment string, agent_instance_id string, dimension string, "
        "silent_since timestamp_ntz, ever_reported boolean",
        "append", "eventtime",
        initialState=listed.groupBy("bundle"),
    )

"""Leases held in stream state: granted, renewed, expired and passed on.

Events (key, request_id, kind, ts) ask for a key's one lease (``request``), renew it
(``beat``) or give it back (``done``). A stateful processor keeps, for each key, the
events that aren't due yet, the requests that wait and the lease that is held, and a
timer for each event and for the end of the lease. Events take effect in the order of
their times once the watermark has passed them, so the order of arrival doesn't matter:
late events count as long as they are within the lateness that the watermark allows.

A lease that isn't renewed for ``seconds`` expires just after, as ``reap_stale`` and
``expire_runs`` have it. With ``requeue`` its request waits again, in its old place;
otherwise it has failed. The oldest request that waits is granted next, by time and then
by id, as ``single_flight`` has it.

Defined results: a request that waits or holds isn't asked anew; a beat or done of a
request that doesn't hold only takes it from those that wait (done) or does nothing
(beat); events with a null key, request or time are left out; of equal times, requests
come before beats and beats before dones. The waiting requests of a key are bounded by
what was asked and isn't settled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusforge.session import ship

KINDS = ("request", "beat", "done")
OUT = "key string, request_id string, action string, at long"


@dataclass
class Lease:
    """The state of one key; times are milliseconds."""

    seconds: float
    requeue: bool
    holder: str | None = None
    asked: int = 0  # when the holder asked
    renewed: int = 0
    waiting: list[tuple[int, str]] = field(default_factory=list)

    def until(self) -> int | None:
        """The first moment at which the lease has expired."""
        return None if self.holder is None else self.renewed + int(self.seconds * 1000) + 1

    def pass_on(self, now: int) -> Iterator[tuple[str, str, int]]:
        if self.holder is None and self.waiting:
            self.waiting.sort()
            self.asked, self.holder = self.waiting.pop(0)
            self.renewed = now
            yield self.holder, "granted", now

    def expire(self, now: int) -> Iterator[tuple[str, str, int]]:
        """Leases that have run out by ``now``, each passed on at the moment it did."""
        while self.holder is not None and self.until() <= now:
            at, lost = self.until(), self.holder
            if self.requeue:
                self.waiting.append((self.asked, lost))
            self.holder = None
            yield lost, "expired" if self.requeue else "failed", at
            yield from self.pass_on(at)

    def take(self, at: int, kind: str, request: str) -> Iterator[tuple[str, str, int]]:
        if kind == "request" and request != self.holder and all(r != request for _, r in self.waiting):
            self.waiting.append((at, request))
        elif kind == "beat" and request == self.holder:
            self.renewed = at
        elif kind == "done" and request == self.holder:
            self.holder = None
            yield request, "released", at
        elif kind == "done":
            self.waiting = [w for w in self.waiting if w[1] != request]
        yield from self.pass_on(at)


class LeaseProcessor(StatefulProcessor):
    def __init__(self, seconds: float, requeue: bool):
        self.seconds, self.requeue = seconds, requeue

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "at long, kind string, request string")
        self.lease = handle.getValueState("lease", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for some in rows:
            events = [(int(a), str(k), str(r)) for a, k, r in zip(some["at"], some["kind"], some["request_id"], strict=True)]
            self.ahead.appendList(events)
            for at in {e[0] for e in events}:
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # no event of a time that the watermark has passed can still come
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        events = sorted((tuple(e) for e in self.ahead.get()), key=lambda e: (e[0], KINDS.index(e[1]), e[2]))
        due, left = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        state = json.loads(self.lease.get()[0]) if self.lease.exists() else {"seconds": self.seconds, "requeue": self.requeue}
        lease = Lease(**state)
        lease.waiting = [tuple(w) for w in lease.waiting]
        before, out = lease.until(), []
        for at, kind, request in due:
            out += lease.expire(at)
            out += lease.take(at, kind, request)
        out += lease.expire(now)
        if due:
            self.ahead.clear()
            if left:
                self.ahead.put(left)
        if lease.holder is None and not lease.waiting and not left:
            self.lease.clear()
        else:
            self.lease.update((json.dumps(asdict(lease)),))
        if lease.until() is not None and lease.until() != before:
            self.handle.registerTimer(lease.until())
        if out:
            yield pd.DataFrame([(key[0], r, a, at) for r, a, at in out], columns=["key", "request_id", "action", "at"])

    def close(self) -> None:
        pass


def events_of(df: DataFrame) -> DataFrame:
    """Events with ``at`` in milliseconds; those that name nothing are left out."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    known = F.col("key").isNotNull() & F.col("request_id").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*KINDS)
    return df.filter(known).select(F.col("key").cast("string").alias("key"), F.col("request_id").cast("string").alias("request_id"), "kind", F.col("ts").cast("timestamp").alias("ts"), at.alias("at"))


def lease_actions(events: DataFrame, seconds: float = 1800, lateness: str = "10 minutes", requeue: bool = False) -> DataFrame:
    """(key, request_id, action, at) of a stream of events, as the watermark passes them."""
    ship(events.sparkSession)
    stream = events_of(events).withWatermark("ts", lateness)
    return stream.groupBy("key").transformWithStateInPandas(LeaseProcessor(seconds, requeue), OUT, "Append", "EventTime")


def replay(events: DataFrame, seconds: float = 1800, requeue: bool = False, as_of: int | None = None) -> DataFrame:
    """What the stream gives once the watermark is at ``as_of`` (milliseconds), of a table of events.

    A key's events are replayed in one task, in order; a key is one file, run or lock, and
    its history is short.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lease, out = Lease(seconds, requeue), []
        order = sorted(zip(pdf["at"], pdf["kind"], pdf["request_id"], strict=True), key=lambda e: (e[0], KINDS.index(e[1]), e[2]))
        for at, kind, request in order:
            out += lease.expire(int(at))
            out += lease.take(int(at), kind, request)
        if as_of is not None:
            out += lease.expire(as_of)
        return pd.DataFrame([(pdf["key"].iloc[0], r, a, at) for r, a, at in out], columns=["key", "request_id", "action", "at"])

    ship(events.sparkSession)
    return events_of(events).groupBy("key").applyInPandas(run, OUT)

"""Streaming forms of the ordered rules: keyed state with timers, by ``transformWithStateInPandas``.

Each processor keeps the same few numbers as its batch form and handles a batch's rows of a key in the order of event
time. Timers run on processing time, as the rules they stand for do. The state store must be RocksDB
(``STATE_STORE``); ``configure`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..limits import LIMITS
from ..operators.folds import AnchoredWindow, Lockout
from ..operators.sessions import Membership
from ..shipping import ship

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ship(spark)


#: How long after its window could have ended a key's state is kept, for events that come late.
GRACE_MS = 3_600_000


class _Expiring(StatefulProcessor):
    """Keeps one timer a key: its state goes once no event has come for the length of its window and a time of grace."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def _renew(self, timer_values, after_ms: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timer_values.getCurrentProcessingTimeInMs() + after_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ordered(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame()


class RateLimiter(_Expiring):
    """Adds ``n`` and ``over`` to events (key, event_id, ms). A row without an event id tells when its key connects, which
    opens the first window unless the key has had one."""

    def __init__(self, most: int = LIMITS.frames_per_window, length_ms: int = LIMITS.frame_window_ms, grace_ms: int = GRACE_MS):
        self.most, self.length_ms, self.grace_ms = most, length_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window = AnchoredWindow(self.most, self.length_ms)
        if self.state.exists():
            window.opened, window.count = self.state.get()
        pdf = _ordered(rows, ["ms", "event_id"])
        connects = pdf["event_id"].isna()
        if window.opened is None and connects.any():
            window.opened = int(pdf["ms"][connects].min())
        pdf = pdf[~connects]
        told = [window.step(int(ms)) for ms in pdf["ms"]]
        self.state.update((window.opened, window.count))
        self._renew(timerValues, self.length_ms + self.grace_ms)
        yield pd.DataFrame({"key": [key[0]] * len(pdf), "event_id": pdf["event_id"].astype("int64").to_numpy(), "n": [n for n, _ in told], "over": [o for _, o in told]})


class LockoutKeeper(_Expiring):
    """Adds ``blocked`` and ``failures`` to failed attempts (key, event_id, ms)."""

    def __init__(self, failures: int = LIMITS.lockout_failures, length_ms: int = LIMITS.lockout_window_ms, grace_ms: int = GRACE_MS):
        self.failures, self.length_ms, self.grace_ms = failures, length_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("lockout", "n long, reset_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = Lockout(self.failures, self.length_ms)
        if self.state.exists():
            kept.count, kept.reset_at = self.state.get()
        pdf = _ordered(rows, ["ms", "event_id"])
        told = [kept.step(int(ms)) for ms in pdf["ms"]]
        self.state.update((kept.count, kept.reset_at))
        self._renew(timerValues, self.length_ms + self.grace_ms)
        yield pd.DataFrame({"key": [key[0]] * len(pdf), "event_id": pdf["event_id"].to_numpy(), "blocked": [b for b, _ in told], "failures": [n for _, n in told]})


class SessionKeeper(StatefulProcessor):
    """Live sessions over events (code, event_id, ms, kind create/join/leave, role, peer), with two timers each.

    A session ends after its TTL; it ends after the idle time too unless a publisher has joined. What it tells are rows
    (code, event_id, outcome, n_recipients); a timer's row has no event.
    """

    def __init__(self, ttl_ms: int = LIMITS.live_ttl_max_ms, idle_ms: int = LIMITS.idle_ms, most: int = LIMITS.recipients):
        self.ttl_ms, self.idle_ms, self.most = ttl_ms, idle_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "publisher string, ended boolean, expires long, idle long")
        self.peers = handle.getListState("recipients", "peer string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        member, expires, idle, told = Membership(self.most), 0, 0, []
        known = self.state.exists()
        if known:
            member.publisher, member.ended, expires, idle = self.state.get()
            member.recipients = dict.fromkeys(p[0] for p in self.peers.get())
        pdf = _ordered(rows, ["ms", "event_id"])
        for event, kind, role, peer in zip(pdf["event_id"], pdf["kind"], pdf["role"], pdf["peer"], strict=True):
            if kind == "create":
                if not known or member.ended:
                    member, known, expires, idle = Membership(self.most), True, now + self.ttl_ms, now + self.idle_ms
                    self.handle.registerTimer(expires)
                    self.handle.registerTimer(idle)
                told.append((event, "created", len(member.recipients)))
            elif not known:
                told.append((event, "session not found", 0))
            else:
                outcome = member.step(kind, role, peer)
                if outcome == "publisher joined" and idle:
                    self.handle.deleteTimer(idle)
                    idle = 0
                told.append((event, outcome, len(member.recipients)))
        if known:
            self._save(member, expires, idle)
        yield pd.DataFrame({"code": [key[0]] * len(told), "event_id": pd.array([t[0] for t in told], "Int64"), "outcome": [t[1] for t in told], "n_recipients": [t[2] for t in told]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.state.exists():
            publisher, ended, expires, idle = self.state.get()
            if not ended and (at == expires or (at == idle and publisher is None)):
                n = len(list(self.peers.get()))
                self.state.clear()
                self.peers.clear()
                yield pd.DataFrame({"code": [key[0]], "event_id": pd.array([None], "Int64"), "outcome": ["expired"], "n_recipients": [n]})

    def _save(self, member: Membership, expires: int, idle: int) -> None:
        self.state.update((member.publisher, member.ended, expires, idle))
        if member.recipients:
            self.peers.put([(p,) for p in member.recipients])
        else:
            self.peers.clear()

    def close(self) -> None:
        pass


class CandidateBuffer(StatefulProcessor):
    """Holds candidates (conn_id, seq, kind candidate/ready, value) back until their connection is ready, then lets them go in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ready = handle.getValueState("ready", "at long")
        self.held = handle.getListState("held", "seq long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _ordered(rows, ["seq"])
        ready, held = self.ready.exists(), [tuple(h) for h in self.held.get()]
        out = []
        for seq, kind, value in zip(pdf["seq"], pdf["kind"], pdf["value"], strict=True):
            if kind == "ready":
                ready = True
                out += held
                held = []
            elif ready:
                out.append((seq, value))
            else:
                held.append((seq, value))
        if ready:
            self.ready.update((1,))
        if held:
            self.held.put([(int(s), v) for s, v in held])
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame({"conn_id": [key[0]] * len(out), "seq": [int(s) for s, _ in out], "value": [v for _, v in out]})

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, *, most: int = LIMITS.frames_per_window, length_ms: int = LIMITS.frame_window_ms, grace_ms: int = GRACE_MS) -> DataFrame:
    """``key``, ``event_id``, ``n``, ``over`` of a stream (key string, event_id long, ms long)."""
    return events.groupBy("key").transformWithStateInPandas(RateLimiter(most, length_ms, grace_ms), "key string, event_id long, n long, over boolean", "Append", "ProcessingTime")


def lockout_stream(failures: DataFrame, *, limit: int = LIMITS.lockout_failures, length_ms: int = LIMITS.lockout_window_ms, grace_ms: int = GRACE_MS) -> DataFrame:
    return failures.groupBy("key").transformWithStateInPandas(LockoutKeeper(limit, length_ms, grace_ms), "key string, event_id long, blocked boolean, failures long", "Append", "ProcessingTime")


def session_stream(events: DataFrame, *, ttl_ms: int = LIMITS.live_ttl_max_ms, idle_ms: int = LIMITS.idle_ms, most: int = LIMITS.recipients) -> DataFrame:
    return events.groupBy("code").transformWithStateInPandas(SessionKeeper(ttl_ms, idle_ms, most), "code string, event_id long, outcome string, n_recipients long", "Append", "ProcessingTime")


def candidate_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("conn_id").transformWithStateInPandas(CandidateBuffer(), "conn_id string, seq long, value string", "Append", "None")


def inactivity_stream(chunks: DataFrame, *, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of a transfer's chunks without a gap, once the watermark has passed them."""
    from pyspark.sql import functions as F

    return chunks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "transfer_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))

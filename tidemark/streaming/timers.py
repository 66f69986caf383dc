"""Streaming forms of rules whose timers are set, moved and cleared: messages of live sessions, receivers that give up,
stored sessions that expire or burn, and reconnection.

Timers of receivers run on event time, so that a log gives the same however fast it is read; all others on processing time,
as the rules they stand for do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..limits import LIMITS
from ..operators.receiving import Run
from ..operators.sessions import Membership
from .processors import _ordered

MESSAGES = "code string, event_id long, at_ms long, n long, to string, type string, peer_id string"
LISTS = "transfer_id string, number long, state string, chunks_done long, chunks_total long, file_bytes array<long>"


class SessionMessenger(StatefulProcessor):
    """What live sessions send because of events (code, event_id, ms, kind create/join/leave, role, peer); peers are a map by
    name. A timer's message has no event."""

    def __init__(self, ttl_ms: int = LIMITS.live_ttl_max_ms, idle_ms: int = LIMITS.idle_ms, most: int = LIMITS.recipients):
        self.ttl_ms, self.idle_ms, self.most = ttl_ms, idle_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "publisher string, expires long, idle long, joined long")
        self.peers = handle.getMapState("recipients", "peer string", "place long")

    def _load(self) -> tuple[Membership, dict[str, int], int]:
        publisher, expires, idle, joined = self.state.get()
        places = {k[0]: v[0] for k, v in self.peers.iterator()}
        in_order = sorted(places, key=places.get)
        return Membership(self.most, 0, expires, idle, publisher, dict.fromkeys(in_order)), places, joined

    def _end(self, session: Membership) -> None:
        for timer in (session.expires_ms, session.idle_at_ms):
            if timer:
                self.handle.deleteTimer(timer)
        self.state.clear()
        self.peers.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        session, places, joined = self._load() if self.state.exists() else (None, {}, 0)
        told, kept = [], dict(places)
        pdf = _ordered(rows, ["ms", "event_id"])
        for event, ms, kind, role, peer in zip(pdf["event_id"], pdf["ms"], pdf["kind"], pdf["role"], pdf["peer"], strict=True):
            if kind == "create":
                if session is None:
                    session = Membership(self.most, 0, now + self.ttl_ms, now + self.idle_ms)
                    self.handle.registerTimer(session.expires_ms)
                    self.handle.registerTimer(session.idle_at_ms)
                continue
            if session is None:
                continue
            outcome = session.step(kind, role, peer)
            told += [(int(event), int(ms), n, *m) for n, m in enumerate(session.sent)]
            if outcome == "publisher joined" and session.idle_at_ms:
                self.handle.deleteTimer(session.idle_at_ms)
                session.idle_at_ms = None
            if outcome.startswith("recipient") and kind == "join" and peer not in kept:
                joined += 1
                kept[peer] = joined
            elif outcome == "recipient left":
                del kept[peer]
            if session.ended:
                self._end(session)
                session, places, kept, joined = None, {}, {}, 0
        if session is not None:
            self.state.update((session.publisher, session.expires_ms, session.idle_at_ms, joined))
            for peer in places.keys() - kept.keys():
                self.peers.removeKey((peer,))
            for peer, place in kept.items():
                if places.get(peer) != place:
                    self.peers.updateValue((peer,), (place,))
        if told:
            yield _messages(key[0], told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        session, _, _ = self._load()
        at = session.due(expiredTimerInfo.getExpiryTimeInMs())
        if at is not None:
            told = [(None, at, n, *m) for n, m in enumerate(session.sent)]
            self._end(session)
            if told:
                yield _messages(key[0], told)

    def close(self) -> None:
        pass


def _messages(code: str, told: list[tuple]) -> pd.DataFrame:
    events, at, n, to, kind, peer = zip(*told, strict=True)
    return pd.DataFrame({"code": [code] * len(told), "event_id": pd.array(events, "Int64"), "at_ms": at, "n": n, "to": to, "type": kind, "peer_id": pd.array(peer, "string")})


class ReceiverKeeper(StatefulProcessor):
    """How each list of files of a transfer ends, of messages (transfer_id, seq, ms, kind, json, byte_len). A list whose chunks
    are missing is given up once event time has passed the last chunk by the gap."""

    def __init__(self, gap_ms: int = LIMITS.inactivity_ms):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("list", "number long, live boolean, sizes array<long>, got array<long>, total long, last long, file int, done long, chunks long, timer long")

    def _load(self) -> tuple[int, Run | None, list[int], int]:
        if not self.state.exists():
            return -1, None, [], 0
        number, live, sizes, got, total, last, file, done, chunks, timer = self.state.get()
        if not live:
            return number, None, [], timer
        run = Run(np.array(sizes, dtype=np.int64), total, last)
        run.file, run.done, run.chunks = file, done, chunks
        return number, run, list(got), timer

    def _save(self, number: int, run: Run | None, got: list[int], timer: int) -> None:
        due = run.last + self.gap_ms + 1 if run is not None and run.chunks < run.total else 0
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if due and timer != due:
            self.handle.registerTimer(due)
        if run is None:
            self.state.update((number, False, [], [], 0, 0, 0, 0, 0, due))
        else:
            self.state.update((number, True, run.sizes.tolist(), got, run.total, run.last, run.file, run.done, run.chunks, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, run, got, timer = self._load()
        told = []

        def end(how: str) -> None:
            nonlocal run
            told.append((number, how, run.chunks, run.total, got))
            run = None

        pdf = _ordered(rows, ["seq"])
        frames = [_frame(kind, text) for kind, text in zip(pdf["kind"], pdf["json"], strict=True)]
        lengths, times = pdf["byte_len"].fillna(0).to_numpy(dtype=np.int64), pdf["ms"].to_numpy(dtype=np.int64)
        marks = [i for i, f in enumerate(frames) if f is not None]
        at = 0
        for i in [*marks, len(frames)]:  # chunks between two messages are taken at once
            if run is not None and i > at:
                files, gone, _ = run.take(lengths[at:i], np.zeros(i - at, dtype=bool), times[at:i], self.gap_ms)
                got = (np.array(got, dtype=np.int64) + np.bincount(files[files >= 0], weights=lengths[at:i][files >= 0], minlength=len(got)).astype(np.int64)).tolist()
                if gone is not None:
                    run.chunks += int((files >= 0).sum())
                    end("timed out")
            if i < len(frames):
                if run is not None and times[i] - run.last > self.gap_ms and run.chunks < run.total:
                    end("timed out")
                kind, sizes, total = frames[i]
                if kind == "meta":
                    if run is not None:
                        end("replaced")
                    number, run, got = number + 1, Run(np.array(sizes, dtype=np.int64), total, int(times[i])), [0] * len(sizes)
                elif run is not None and kind != "noise":
                    end("completed" if kind == "done" else "aborted")
            at = i + 1
        self._save(number, run, got, timer)
        if told:
            yield _lists(key[0], told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, run, got, timer = self._load()
        if run is not None and expiredTimerInfo.getExpiryTimeInMs() == timer:
            told = [(number, "timed out", run.chunks, run.total, got)]
            self._save(number, None, [], 0)
            yield _lists(key[0], told)

    def close(self) -> None:
        pass


def _lists(transfer: str, told: list[tuple]) -> pd.DataFrame:
    columns = zip(*told, strict=True)
    return pd.DataFrame(dict(zip(("number", "state", "chunks_done", "chunks_total", "file_bytes"), columns, strict=True))).assign(transfer_id=transfer)[["transfer_id", "number", "state", "chunks_done", "chunks_total", "file_bytes"]]


def _frame(kind: str, text: str | None) -> tuple[str, list[int], int] | None:
    """A list of files, an end or an abort; None for chunks and for what is none of these."""
    if kind == "binary":
        return None
    try:
        message = json.loads(text or "")
    except ValueError:
        return "noise", [], 0
    what = message.get("type") if isinstance(message, dict) else None
    if what in ("done", "abort"):
        return what, [], 0
    files = message.get("files") if what == "meta" else None
    if isinstance(files, list) and all(isinstance(f, dict) and isinstance(f.get("size"), (int, float)) for f in files):
        total = message.get("totalChunks")
        return "meta", [int(f["size"]) for f in files], int(total) if isinstance(total, (int, float)) else 0
    return "noise", [], 0


class StoredKeeper(StatefulProcessor):
    """Stored sessions (code, event_id, kind set/read/delete, expires_ms, burns): one timer a code, moved by each setting, and
    brought forward by the first reading of one that burns. Tells (code, reason expired/burned, at_ms).

    Initial state (code, expires_ms, burns) is the stored snapshot: timers of a process that went are armed again, and what
    is past goes at once.
    """

    def __init__(self, burn_ms: int = LIMITS.burn_delay_ms):
        self.burn_ms = burn_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stored", "timer long, burns boolean, read boolean")

    def _arm(self, timer: int | None, at: int, burns: bool, read: bool) -> None:
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if timer != at:
            self.handle.registerTimer(at)
        self.state.update((at, burns, read))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        now = timerValues.getCurrentProcessingTimeInMs()
        for expires, burns in zip(initialState["expires_ms"], initialState["burns"], strict=True):
            self._arm(self.state.get()[0] if self.state.exists() else None, max(int(expires), now + 1), bool(burns), False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        pdf = _ordered(rows, ["event_id"])
        for kind, expires, burns in zip(pdf["kind"], pdf["expires_ms"], pdf["burns"], strict=True):
            timer, was, read = self.state.get() if self.state.exists() else (None, False, False)
            if kind == "set":
                self._arm(timer, max(int(expires), now + 1), bool(burns), False)
            elif timer is not None and kind == "read" and was and not read:
                self._arm(timer, min(timer, now + self.burn_ms), was, True)
            elif timer is not None and kind == "delete":
                self.handle.deleteTimer(timer)
                self.state.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.state.exists() and self.state.get()[0] == at:
            read = self.state.get()[2]
            self.state.clear()
            yield pd.DataFrame({"code": [key[0]], "reason": ["burned" if read else "expired"], "at_ms": [at]})

    def close(self) -> None:
        pass


class Reconnector(StatefulProcessor):
    """Connections (conn_id, event_id, kind open/lost/closed): a loss arms a timer that waits twice as long after each attempt,
    an opening or an intended close clears it. Tells (conn_id, what attempt/gave up, attempt, at_ms)."""

    def __init__(self, attempts: int = LIMITS.reconnect_attempts, base_ms: int = LIMITS.reconnect_base_ms, most_ms: int = LIMITS.reconnect_max_ms):
        self.attempts, self.base_ms, self.most_ms = attempts, base_ms, most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tries", "made long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        gave_up = []
        for kind in _ordered(rows, ["event_id"])["kind"]:
            made, timer = self.state.get() if self.state.exists() else (0, 0)
            if timer:
                self.handle.deleteTimer(timer)
            if kind != "lost":
                self.state.clear()
            elif made >= self.attempts:
                gave_up.append(made)
                self.state.update((made, 0))
            else:
                at = now + min(self.base_ms * 2**made, self.most_ms)
                self.handle.registerTimer(at)
                self.state.update((made + 1, at))
        if gave_up:
            yield pd.DataFrame({"conn_id": [key[0]] * len(gave_up), "what": ["gave up"] * len(gave_up), "attempt": gave_up, "at_ms": [now] * len(gave_up)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.state.exists() and self.state.get()[1] == at:
            made = self.state.get()[0]
            self.state.update((made, 0))
            yield pd.DataFrame({"conn_id": [key[0]], "what": ["attempt"], "attempt": [made], "at_ms": [at]})

    def close(self) -> None:
        pass


def message_stream(events: DataFrame, *, ttl_ms: int = LIMITS.live_ttl_max_ms, idle_ms: int = LIMITS.idle_ms, most: int = LIMITS.recipients) -> DataFrame:
    return events.groupBy("code").transformWithStateInPandas(SessionMessenger(ttl_ms, idle_ms, most), MESSAGES, "Append", "ProcessingTime")


def receive_stream(events: DataFrame, *, gap_ms: int = LIMITS.inactivity_ms, late: str = "1 minute") -> DataFrame:
    """Ends of lists; ``ts`` of the events is their event time, ``ms`` the same in milliseconds."""
    return events.withWatermark("ts", late).groupBy("transfer_id").transformWithStateInPandas(ReceiverKeeper(gap_ms), LISTS, "Append", "EventTime")


def stored_stream(events: DataFrame, snapshot: DataFrame | None = None, *, burn_ms: int = LIMITS.burn_delay_ms) -> DataFrame:
    """``snapshot`` (code, expires_ms, burns) is what a restart finds stored."""
    initial = snapshot.groupBy("code") if snapshot is not None else None
    return events.groupBy("code").transformWithStateInPandas(StoredKeeper(burn_ms), "code string, reason string, at_ms long", "Append", "ProcessingTime", initial)


def reconnect_stream(events: DataFrame, *, attempts: int = LIMITS.reconnect_attempts, base_ms: int = LIMITS.reconnect_base_ms, most_ms: int = LIMITS.reconnect_max_ms) -> DataFrame:
    return events.groupBy("conn_id").transformWithStateInPandas(Reconnector(attempts, base_ms, most_ms), "conn_id string, what string, attempt long, at_ms long", "Append", "ProcessingTime")

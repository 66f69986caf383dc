"""Live sessions: who joins and leaves, what each event makes the server send to whom, and the guards of a join.

A session's events are folded in order by a state of its peers. Rows go through Python as Arrow batches of which only the
fold's inputs are looked at; all other columns, keys among them, stay as they are, and where a key begins is told by Spark.

The answer to a join depends on three states: the session's, the failed passwords of the caller's address, and by them each
other, as a locked-out caller doesn't join and a session that is over records no failure. Both only look back in time. So
the answers are found in rounds: a pass by code with the lockouts known so far, a pass by address over the failures that it
tells, until the lockouts stay the same. Each round settles at least the earliest event that the one before got wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..limits import LIMITS
from ..saved import save
from ..shipping import ship
from .anchors import key_of, placed

# What callers are told.
NO_FIELDS = "join requires { code, role }"
NO_ROLE = "role must be publisher or recipient"
NO_CODE = "code must be 6 digits"
NO_SESSION = "Session not found or expired"
LOCKED = "Too many failed attempts. Try again in 15 minutes."
WRONG = "invalid_password"
TAKEN = "A publisher is already in this session"
FULL = "Session is full — maximum recipients reached"
WAIT = "Waiting for publisher — please wait"

#: What each outcome of a join is answered with; those that aren't here get no answer of their own.
ANSWERS = {"session not found": NO_SESSION, "locked out": LOCKED, "wrong password": WRONG, "publisher refused": TAKEN, "session full": FULL, "recipient joined": WAIT}


@dataclass
class Membership:
    """A live session: one publisher, so many recipients, and what its end does to them. ``sent`` has the messages of the
    last event, each (to, type, peer id)."""

    most: int = LIMITS.recipients
    opens_ms: int | None = None
    expires_ms: int | None = None
    idle_at_ms: int | None = None
    publisher: str | None = None
    recipients: dict[str, None] = field(default_factory=dict)
    ended: bool = False
    sent: list[tuple[str, str, str | None]] = field(default_factory=list)

    def due(self, at_ms: int | None) -> int | None:
        """Ends the session if its time, or the time to wait for a publisher, is over; the moment at which it ended."""
        self.sent = []
        ends = [t for t in (self.expires_ms, self.idle_at_ms if self.publisher is None else None) if t is not None]
        if self.ended or not ends or (at_ms is not None and at_ms < min(ends)):
            return None
        self.ended = True
        self.sent = [(peer, "expired", None) for peer in ([self.publisher] if self.publisher is not None else []) + list(self.recipients)]
        return min(ends)

    def step(self, kind: str, role: str, peer: str) -> str:
        self.sent = []
        if self.ended:
            return "session not found"
        if kind == "join" and role == "publisher":
            if self.publisher is not None:
                return "publisher refused"
            self.publisher = peer
            self.sent = [(to, "ready", r) for r in self.recipients for to in (peer, r)]
            return "publisher joined"
        if kind == "join":
            if len(self.recipients) >= self.most:
                return "session full"
            self.recipients[peer] = None
            if self.publisher is None:
                return "recipient joined"
            self.sent = [(to, "ready", peer) for to in (self.publisher, peer)]
            return "recipient ready"
        if role == "publisher" and peer == self.publisher:
            self.ended = True
            self.sent = [(r, "peer_left", None) for r in self.recipients]
            return "session ended"
        if role != "publisher" and peer in self.recipients:
            del self.recipients[peer]
            if self.publisher is not None:
                self.sent = [(self.publisher, "peer_left", peer)]
            elif not self.recipients:
                self.ended = True
                return "session ended"
            return "recipient left"
        return "ignored"


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows of a key in one task and in order, with ``_first`` where a key begins."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(key_of(keys)).orderBy(*order)) == 1)


def fold(rows: DataFrame, inputs: list[str], schema: str, make: Callable, record: Callable) -> DataFrame:
    """Runs a state over each key's rows as ``in_order`` gives them; ``record(state, *inputs)`` gives the values of the new
    columns. The state is made of the inputs of a key's first row."""
    ship(rows.sparkSession)
    added = [x.split(" ") for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64()}[t] for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            values = []
            for first, *row in zip(*(batch.column(c).to_pylist() for c in ("_first", *inputs)), strict=True):
                if first:
                    state = make(*row)
                values.append(record(state, *row))
            new = [pa.array([v[i] for v in values], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(n for n, _ in added)])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{out}, {schema}")


def refuse(rows: DataFrame, *names: str) -> None:
    """New columns must not hide columns that are there."""
    taken = [n for n in names if n.lower() in {c.lower() for c in rows.columns}]
    if taken:
        raise ValueError(f"columns of the input have names that the result needs: {', '.join(taken)}")


def membership(events: DataFrame, *, key: str = "code", at: str = "ts", order: list[str], most: int = LIMITS.recipients) -> DataFrame:
    """Adds ``outcome`` and ``n_recipients`` after each event (code, ts, kind join/leave, role, peer); a peer is in a session
    once, however often it joins."""
    refuse(events, "outcome", "n_recipients", "_first", "_ms")

    def told(state: Membership, kind: str, role: str, peer: str) -> tuple[str, int]:
        return state.step(kind, role, peer), len(state.recipients)

    rows = in_order(events.withColumn("_ms", F.unix_millis(F.col(at).cast("timestamp"))), [key], ["_ms", *order])
    return fold(rows, ["kind", "role", "peer"], "outcome string, n_recipients long", lambda *_: Membership(most), told).drop("_first", "_ms")


def _known(events: DataFrame, sessions: DataFrame, key: str, at: str, idle_ms: int) -> DataFrame:
    """Events with their time and that of their session; of sessions that repeat a code the first counts."""
    spans = sessions.groupBy(F.col(key).alias("_code")).agg(F.min(F.struct("created_at_ms", "expires_at_ms")).alias("_s"))
    rows = events.withColumn("_ms", F.unix_millis(F.col(at).cast("timestamp"))).where("_ms IS NOT NULL")
    out = rows.join(spans, rows[key] == spans["_code"], "left").withColumns({"_opens": F.col("_s.created_at_ms"), "_expires": F.col("_s.expires_at_ms")})
    return out.withColumn("_idle", F.col("_opens") + idle_ms).drop("_code", "_s")


def _session(most: int, opens: int | None, expires: int | None, idle: int | None) -> Membership:
    return Membership(most, opens, expires, idle, ended=opens is None)


def session_messages(events: DataFrame, sessions: DataFrame, *, key: str = "code", at: str = "ts", order: list[str], most: int = LIMITS.recipients, idle_ms: int = LIMITS.idle_ms, until: Column | None = None) -> DataFrame:
    """A row for each message that sessions (code, created_at_ms, expires_at_ms) send because of events (code, ts, kind
    join/leave, role, peer), or because their time is over: code, the event's ``order`` columns (null for a timer), ``at_ms``,
    ``n`` (its place among the messages of its cause), ``to``, ``type`` (ready, peer_left, expired) and ``peer_id``.

    A session is there from its creation until its time is over, its publisher leaves, its last recipient leaves one that
    has no publisher, or no publisher has come for the idle time. ``until`` tells up to when timers run, without it all
    do. An event at the moment of a timer comes after it. Events without a time or a session send nothing.
    """
    ship(events.sparkSession)
    refuse(events, "_first", "_ms", "_opens", "_expires", "_idle", "_until", "_timer")
    rows = _known(events, sessions, key, at, idle_ms).where("_opens IS NOT NULL").withColumn("_until", F.unix_millis(until) if until is not None else F.lit(None).cast("long"))
    rows = in_order(rows, [key], ["_ms", *order]).select(key, *order, "kind", "role", "peer", "_first", "_ms", "_opens", "_expires", "_idle", "_until")
    passed = [key, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = until_ms = tail = None
        found: list[tuple] = []

        def timer(place: int) -> None:
            if state is not None and (ended := state.due(until_ms)) is not None:
                found.extend((place, True, ended, n, *m) for n, m in enumerate(state.sent))

        def told(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * 7
            found.clear()
            at_ = pa.array(columns[0], pa.int64())
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(at_) for c in passed), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names=[*passed, "_timer", "at_ms", "n", "to", "type", "peer_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_pylist() for c in ("_first", "_ms", "_opens", "_expires", "_idle", "_until", "kind", "role", "peer")]
            if columns[0][0] and tail is not None:
                timer(0)
                yield told(tail)
            for i, (first, ms, opens, expires, idle, until_here, kind, role, peer) in enumerate(zip(*columns, strict=True)):
                if first:
                    if i:
                        timer(i - 1)
                    state, until_ms = _session(most, opens, expires, idle), until_here
                if (ended := state.due(ms)) is not None:
                    found.extend((i, True, ended, n, *m) for n, m in enumerate(state.sent))
                if ms >= opens:
                    state.step(kind, role, peer)
                    found.extend((i, False, ms, n, *m) for n, m in enumerate(state.sent))
            tail = batch.slice(batch.num_rows - 1, 1)
            yield told(batch)
        if tail is not None:
            timer(0)
            yield told(tail)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed)
    out = rows.mapInArrow(run, f"{kinds}, _timer boolean, at_ms long, n long, to string, type string, peer_id string")
    return out.select(key, *[F.when(~F.col("_timer"), F.col(c)).alias(c) for c in order], "at_ms", "n", "to", "type", "peer_id")


def _guards(code: Column, role: Column) -> Column:
    """What a join is refused with before any state is asked; null if it passes."""
    absent = lambda c: c.isNull() | (c == "")
    return (
        F.when(absent(code) | absent(role), F.lit(NO_FIELDS))
        .when(~role.isin("publisher", "recipient"), F.lit(NO_ROLE))
        .when(~strings.is_code(code), F.lit(NO_CODE))
    )


def _locked(tries: DataFrame, order: list[str], failures: int, length_ms: int) -> DataFrame:
    """``_row`` of tries (ip, _at, _ms, _ok) made while their address is locked out by those of them that are wrong."""
    wrong = placed(tries.where("NOT _ok"), ["ip"], at="_at", order=order, length_ms=length_ms)
    # A lockout begins after the last failure that counts and lasts to the end of its window: two spans at most.
    begins = wrong.where(F.col("_n") == failures).select("ip", "_ms0", *order, (F.col("_opened") + length_ms).alias("_until"))
    span = lambda ms: F.floor(ms / length_ms).cast("long")
    begins = begins.withColumn("_span", F.explode(F.array_distinct(F.array(span(F.col("_ms0")), span(F.col("_until"))))))
    marked = tries.select("_row", "ip", "_ms0", *order, span(F.col("_ms0")).alias("_span"), F.lit(0).alias("_mark"))
    both = marked.unionByName(begins.withColumn("_mark", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(key_of(["ip"]), "_span").orderBy("_ms0", *order, "_mark").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_over", F.last("_until", ignorenulls=True).over(upto))
    return told.where((F.col("_mark") == 0) & (F.col("_ms0") <= F.col("_over"))).select("_row")


def join_answers(events: DataFrame, sessions: DataFrame, *, key: str = "code", at: str = "ts", order: list[str], most: int = LIMITS.recipients, idle_ms: int = LIMITS.idle_ms, failures: int = LIMITS.lockout_failures, length_ms: int = LIMITS.lockout_window_ms) -> DataFrame:
    """Adds ``outcome`` and ``answer`` to events (code, role, ip, peer, kind join/leave, password_ok, ts) of sessions (code,
    created_at_ms, expires_at_ms), by the guards in their order: fields, role, code, session, lockout of the address, password,
    place in the session. ``answer`` is what the caller is told at once, null if nothing.

    ``order`` breaks ties of time totally. A recipient whose ``password_ok`` isn't true has the wrong password; publishers
    need none. A null address is an address. An event without a time is left out; an empty table gives no rows.
    """
    refuse(events, "outcome", "answer", "_first", "_ms", "_opens", "_expires", "_idle", "_row", "_refused", "_ok", "_locked", "_ms0", "_at")
    rows = _known(events, sessions, key, at, idle_ms).withColumns({
        "_row": F.monotonically_increasing_id(),
        "_refused": F.when(F.col("kind") == "join", _guards(F.col(key).cast("string"), F.col("role"))),
        "_ok": (F.col("role") != "recipient") | F.coalesce("password_ok", F.lit(False)),
    })
    rows = save(rows, "joins")

    def told(state: Membership, ms: int, opens: int | None, expires: int | None, idle: int | None, kind: str, role: str, peer: str, ok: bool, locked: bool) -> tuple[str]:
        state.due(ms)
        if state.ended or ms < opens:
            return ("session not found",)
        if kind == "join" and role == "recipient" and (locked or not ok):
            return ("locked out" if locked else "wrong password",)
        return (state.step(kind, role, peer),)

    asked = rows.where("_refused IS NULL")
    inputs = ["_ms", "_opens", "_expires", "_idle", "kind", "role", "peer", "_ok", "_locked"]
    locked, known = None, asked.select("_row").limit(0)
    while True:
        marked = asked.join(known.withColumn("_l", F.lit(True)), "_row", "left").withColumn("_locked", F.coalesce("_l", F.lit(False))).drop("_l")
        folded = fold(in_order(marked, [key], ["_ms", *order]), inputs, "outcome string", lambda ms, opens, expires, idle, *_: _session(most, opens, expires, idle), told)
        folded = save(folded.select("_row", "outcome"), "joins-by-code")
        tries = asked.where("kind = 'join' AND role = 'recipient'").join(folded.where("outcome <> 'session not found'"), "_row")
        tries = tries.select("_row", "ip", *order, "_ok", F.timestamp_millis("_ms").alias("_at"), F.col("_ms").alias("_ms0"))
        locked = save(_locked(tries, order, failures, length_ms), "joins-locked")
        # Only a lockout of the right password changes who joins.
        right = asked.where("_ok").select("_row")
        now = locked.join(right, "_row", "left_semi")
        if now.exceptAll(known).isEmpty() and known.exceptAll(now).isEmpty():
            break
        known = now
    out = rows.join(folded, "_row", "left").join(locked.withColumn("_l", F.lit(True)), "_row", "left")
    outcome = F.when(F.col("_refused").isNotNull(), F.lit("refused")).when(F.col("_l"), F.lit("locked out")).otherwise(F.col("outcome"))
    out = out.withColumn("outcome", outcome)
    answers = F.create_map(*[F.lit(x) for p in ANSWERS.items() for x in p])
    said = F.coalesce("_refused", F.when(F.col("kind") == "join", F.try_element_at(answers, F.col("outcome"))))
    return out.withColumn("answer", said).select(*[F.col(f"`{c}`") for c in events.columns], "outcome", "answer")

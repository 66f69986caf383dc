"""Rules that depend on the order of a key's events, as deterministic batch queries over an event time.

Rate limits and lockouts number the events of anchored windows (``anchors``); the step functions serve the streaming forms.
Sessions and receivers have modules of their own. What has a closed form is a plain aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import HTTP_LIMITS, LIMITS
from .anchors import anchored
from .receiving import receive  # noqa: F401 - known here too
from .sessions import Membership, membership  # noqa: F401


@dataclass
class AnchoredWindow:
    """Counts events; a window opens at the first and anew at the first event later than its length."""

    most: int
    length_ms: int
    opened: int | None = None
    count: int = 0

    def step(self, at_ms: int) -> tuple[int, bool]:
        """The event's number in its window, and whether it is over the limit."""
        if self.opened is None or at_ms - self.opened > self.length_ms:
            self.opened, self.count = at_ms, 0
        self.count += 1
        return self.count, self.count > self.most


@dataclass
class Lockout:
    """Failures within a window from the first; at the limit a key is blocked until the window is over."""

    failures: int
    length_ms: int
    count: int = 0
    reset_at: int | None = None

    def step(self, at_ms: int) -> tuple[bool, int]:
        """Whether an attempt that would fail is blocked, and the failures counted by then."""
        if self.reset_at is not None and at_ms > self.reset_at:
            self.count, self.reset_at = 0, None
        if self.reset_at is not None and self.count >= self.failures:
            return True, self.count
        if self.reset_at is None:
            self.reset_at = at_ms + self.length_ms
        self.count += 1
        return False, self.count


def _free(rows: DataFrame, *names: str) -> None:
    """New columns must not hide columns that are there."""
    taken = [n for n in names if n.lower() in {c.lower() for c in rows.columns}]
    if taken:
        raise ValueError(f"columns of the input have names that the result needs: {', '.join(taken)}")


def rate_limit(events: DataFrame, keys: list[str], *, at: str = "ts", order: list[str], most: int = LIMITS.frames_per_window, length_ms: int = LIMITS.frame_window_ms, connects: DataFrame | None = None) -> DataFrame:
    """Adds ``n`` (the event's number in its window) and ``over``. ``connects`` (the keys, ``at``) tells when connections open,
    and with them their first window; without it, or for keys that it lacks, that is at the first event."""
    _free(events, "n", "over")
    return anchored(events, keys, at=at, order=order, length_ms=length_ms, connects=connects).withColumnRenamed("_n", "n").withColumn("over", F.col("n") > most)


def http_limits(requests: DataFrame, *, order: list[str], limits: dict[str, int] = HTTP_LIMITS, length_ms: int = LIMITS.http_window_ms) -> DataFrame:
    """Adds ``n`` and ``over`` to requests (route, ip, ts, status); for passwords only failures count."""
    _free(requests, "n", "over")
    counted = requests.where(F.col("route").isin(*limits) & ((F.col("route") != "password") | (F.col("status") >= 400)))
    most = F.create_map(*[x for r, n in limits.items() for x in (F.lit(r), F.lit(n))])[F.col("route")]
    return anchored(counted, ["route", "ip"], at="ts", order=order, length_ms=length_ms).withColumnRenamed("_n", "n").withColumn("over", F.col("n") > most)


def lockout(failures: DataFrame, keys: list[str], *, at: str = "ts", order: list[str], limit: int = LIMITS.lockout_failures, length_ms: int = LIMITS.lockout_window_ms) -> DataFrame:
    """Adds ``blocked`` and ``failures`` to attempts with a wrong password: in a window from the first, those after
    ``limit`` are blocked and count no more."""
    _free(failures, "blocked", "failures")
    out = anchored(failures, keys, at=at, order=order, length_ms=length_ms)
    return out.withColumn("blocked", F.col("_n") > limit).withColumn("failures", F.least("_n", F.lit(limit).cast("long"))).drop("_n")


# Rules with a closed form.


def inactivity(events: DataFrame, key: str, *, at: str = "ts", gap: str = "30 seconds") -> DataFrame:
    """Runs of a key's events with gaps of at most ``gap``, with their bounds and sizes."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ttl_ends(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``over`` to live sessions."""
    return sessions.withColumn("over", F.timestamp_millis("expires_at_ms") <= as_of)


def idle_ends(sessions: DataFrame, joins: DataFrame, *, idle_ms: int = LIMITS.idle_ms) -> DataFrame:
    """Live sessions (code, created_at_ms) that end because no publisher joined in time, with ``ended_at_ms``."""
    first = joins.where(F.col("role") == "publisher").groupBy("code").agg(F.min(F.unix_millis("ts")).alias("first_ms"))
    late = F.col("first_ms").isNull() | (F.col("first_ms") > F.col("created_at_ms") + idle_ms)
    out = sessions.join(first, "code", "left").where(late & (F.col("created_at_ms") + idle_ms < F.coalesce("expires_at_ms", F.lit((1 << 62)))))
    return out.withColumn("ended_at_ms", F.col("created_at_ms") + idle_ms).drop("first_ms")


def unresponsive(pongs: DataFrame, tick: Column, *, period_ms: int = LIMITS.heartbeat_ms) -> DataFrame:
    """Connections whose last answer is older than the tick before."""
    last = pongs.groupBy("conn_id").agg(F.max("ts").alias("last_pong"))
    return last.where(F.unix_millis("last_pong") < F.unix_millis(tick) - period_ms)


def flush_times(candidates: DataFrame, ready: DataFrame, key: str) -> DataFrame:
    """When each held-back candidate is applied: at once, or when its connection is ready; never if it isn't."""
    first = ready.groupBy(key).agg(F.min("ts").alias("ready_at"))
    return candidates.join(first, key, "left").withColumn("applied_at", F.when(F.col("ready_at").isNotNull(), F.greatest("ts", "ready_at"))).drop("ready_at")


def reconnects(connections: DataFrame, key: str, *, at: str = "ts", attempts: int = LIMITS.reconnect_attempts, base_ms: int = LIMITS.reconnect_base_ms, most_ms: int = LIMITS.reconnect_max_ms, order: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Adds ``attempt``, ``delay_ms`` and ``gave_up`` to events (key, ts, kind open/lost): the count restarts on opening.

    ``order`` breaks ties of time; it must do so totally for results to be the same on every run."""
    _free(connections, "attempt", "delay_ms", "gave_up")
    upto = Window.partitionBy(key).orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    runs = connections.withColumn("_run", F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(upto))
    within = Window.partitionBy(key, "_run").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = runs.withColumn("attempt", F.sum(F.when(F.col("kind") == "lost", 1).otherwise(0)).over(within))
    delay = F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.col("attempt") - 1), F.lit(float(most_ms))).cast("bigint")
    lost = F.col("kind") == "lost"
    return out.withColumn("delay_ms", F.when(lost & (F.col("attempt") <= attempts), delay)).withColumn("gave_up", lost & (F.col("attempt") > attempts)).drop("_run")


def burn_times(retrieves: DataFrame, sessions: DataFrame, *, delay_ms: int = LIMITS.burn_delay_ms) -> DataFrame:
    """``delete_at`` of sessions that burn on reading, from their first successful retrieval."""
    first = retrieves.where("status = 200").groupBy("code").agg(F.min("ts").alias("first"))
    burning = sessions.where("burn_on_read").select("code")
    return first.join(burning, "code").select("code", F.timestamp_micros(F.unix_micros("first") + delay_ms * 1000).alias("delete_at"))


def expiry_timers(updates: DataFrame, as_of: Column) -> DataFrame:
    """One timer for each code, the last set: ``fires_at``, at once if it is past."""
    last = updates.groupBy("code").agg(F.max_by("expires_at", "updated_at").alias("expires_at"))
    return last.withColumn("fires_at", F.greatest("expires_at", as_of))


def startup_recovery(sessions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """What a restart does with stored sessions (code, expires_at): those to delete, and ``fires_at`` of those armed again."""
    over = F.col("expires_at") <= as_of
    return sessions.where(over), sessions.where(~over).select("code", F.col("expires_at").alias("fires_at"))


def ever_joined(events: DataFrame, key: str = "code") -> DataFrame:
    """How many recipients ever joined each session, whether or not they left: its ``ready`` events, repeats included."""
    return events.where("type = 'ready'").groupBy(key).agg(F.count(F.lit(1)).alias("joined"))


def sent_when(chunks: DataFrame, drains: DataFrame, key: str, *, seq: str = "seq", size: str = "byte_len", limit: int = LIMITS.buffer_bytes) -> DataFrame:
    """Back-pressure of a channel that empties its buffer whenever it drains: adds ``flight``, the number of the drain before
    which a chunk is sent, and ``waits``, whether a chunk finds the buffer above its limit.

    ``drains`` (key, after_seq) tells after which chunk the buffer was found empty.
    """
    _free(chunks, "flight", "waits")
    marks = drains.select(key, F.col("after_seq").alias(seq), F.lit(1).alias("_drain"))
    joined = chunks.join(marks.groupBy(key, seq).agg(F.max("_drain").alias("_drain")), [key, seq], "left")
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    flown = joined.withColumn("flight", F.coalesce(F.sum(F.coalesce("_drain", F.lit(0))).over(before), F.lit(0)))
    held = Window.partitionBy(key, "flight").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return flown.withColumn("waits", F.coalesce(F.sum(size).over(held), F.lit(0)) > limit).drop("_drain")


def channel_state(events: DataFrame, key: str, *, seq: str = "seq") -> DataFrame:
    """The last state of each channel; failed and disconnected connections count as errors."""
    state = F.when(F.col("state").isin("failed", "disconnected"), F.lit("error")).otherwise(F.col("state"))
    return events.groupBy(key).agg(F.max_by(state, seq).alias("state"))


def first_end(events: DataFrame, key: str, *, seq: str = "seq") -> DataFrame:
    """The first message that ends a transfer; later ones change nothing."""
    return events.where(F.col("type").isin("done", "abort")).groupBy(key).agg(F.min_by("type", seq).alias("type"), F.min(seq).alias(seq))


def lifecycle(sessions: DataFrame, as_of: Column) -> DataFrame:
    """``state`` of stored sessions with ``expires_at``, ``delete_at`` (burning) and ``deleted_at``."""
    gone = F.col("deleted_at") <= as_of
    burned = F.col("delete_at") <= as_of
    return sessions.withColumn("state", F.when(gone, F.lit("deleted")).when(burned, F.lit("burned")).when(F.col("expires_at") <= as_of, F.lit("expired")).otherwise(F.lit("active")))

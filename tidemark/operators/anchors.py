"""Windows that open at a key's first event, or when it connects, and anew at the first event later than their length.

Where a window opens depends on where the one before did, so openings are a chain through a key's times. A key's times are
cut into spans, each of which is looked at by itself: for every time at which the window it is entered with may end, a
table tells the last opening in the span. One pass over a key's spans in order then tells with which opening each is
entered; it reads the tables only, in which times of equal outcome are one entry. Knowing that, a span finds its openings
and numbers its events. So a key's events are in as many tasks as it has spans; a span has no more distinct times than
milliseconds.

Keys go through Python as Arrow columns that nothing there looks at, so they stay what they are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Windows that a span has at least, and its longest length in milliseconds unless a window is longer.
WINDOWS, SPAN_MS = 64, 1 << 22
#: No opening; before all times.
NONE, NEVER = np.iinfo(np.int64).min, np.iinfo(np.int64).min


def span_length(length_ms: int) -> int:
    return max(length_ms, 1, min(WINDOWS * length_ms, SPAN_MS))


def outcomes(times: np.ndarray, counts: np.ndarray, start: int, length_ms: int, connected: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What entering a span does: ``upper`` bounds of the entering window's end, and for ends below each the last opening in
    the span and the events from it on. An end beyond all bounds leaves no opening.

    Times are distinct and ascending. A window is entered from before the span, unless its key connects in it or later.
    """
    n = len(times)
    after = np.cumsum(counts[::-1])[::-1]
    following = np.searchsorted(times, times + length_ms, side="right")
    last = np.where(following < n, following, np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    if connected is not None and connected >= start:
        at = int(np.searchsorted(times, connected + length_ms, side="right"))
        if at == n:
            return np.array([np.iinfo(np.int64).max]), np.array([NONE]), np.array([0])
        return np.array([np.iinfo(np.int64).max]), times[last[at : at + 1]], after[last[at : at + 1]]
    reached = min(int(np.searchsorted(times, start + length_ms - 1, side="right")) + 1, n)
    exits = last[:reached]
    ends = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
    return times[ends], times[exits[ends]], after[exits[ends]]


def _tables(length_ms: int, span_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for span, times, counts, connected in zip(batch.column("_span").to_pylist(), batch.column("_times"), batch.column("_counts"), batch.column("_connected").to_pylist(), strict=True):
                rows.append(outcomes(times.values.to_numpy(), counts.values.to_numpy(), span * span_ms, length_ms, connected))
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in range(3)]
            total = pa.array([int(c.values.to_numpy().sum()) for c in batch.column("_counts")], pa.int64())
            kept = [batch.column(c) for c in ("_key", "_span", "_connected")]
            yield pa.RecordBatch.from_arrays([*kept, total, *lists], names=["_key", "_span", "_connected", "_total", "_upper", "_exits", "_after"])

    return run


def _entered(length_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, n = None, 0
        for batch in batches:
            enter, had = [], []
            for first, connected, total, upper, exits, after in zip(*(batch.column(c) for c in ("_first", "_connected", "_total", "_upper", "_exits", "_after")), strict=True):
                if first.as_py():
                    opened, n = connected.as_py(), 0
                enter.append(opened)
                had.append(n)
                i = bisect_right(upper.values.to_numpy(), NEVER if opened is None else opened + length_ms)
                exit_ = exits.values[i].as_py() if i < len(exits.values) else NONE
                opened, n = (opened, n + total.as_py()) if exit_ == NONE else (exit_, after.values[i].as_py())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_span"), pa.array(enter, pa.int64()), pa.array(had, pa.int64())], names=["_key", "_span", "_enter", "_had"])

    return run


def key_of(names: list[str]) -> Column:
    """Keys as one column, of which nulls are equal."""
    return F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(names)])


def placed(events: DataFrame, keys: list[str], *, at: str, order: list[str], length_ms: int, connects: DataFrame | None = None, span_ms: int | None = None) -> DataFrame:
    """Adds ``_opened``, when an event's window opened, and ``_n``, its number there. Windows open at a key's first event and
    anew at the first event later than their length. ``order`` breaks ties of time totally.

    ``connects`` (the keys, ``at``) tells when keys connect, the first time if there are several: their first window opens
    then, and has what comes before as well. A key that it lacks opens at its first event. A null key is a key, of any
    type; an event without a time is left out, a connection without one doesn't count.
    """
    taken = {"_key", "_ms", "_span", "_enter", "_had", "_opens", "_opened", "_n"} & {c.lower() for c in events.columns}
    if taken:
        raise ValueError(f"columns of the input have names that are used here: {', '.join(sorted(taken))}")
    ship(events.sparkSession)
    span_ms = span_ms or span_length(length_ms)
    timed = events.withColumns({"_key": key_of(keys), "_ms": F.unix_millis(F.col(at).cast("timestamp"))})
    # The same filter that the joins would infer, so that all branches read one shuffle of times.
    timed = timed.withColumn("_span", F.floor(F.col("_ms") / span_ms).cast("long")).where("_span IS NOT NULL AND _key IS NOT NULL")
    times = timed.groupBy("_key", "_span", "_ms").agg(F.count(F.lit(1)).alias("_c"))
    listed = F.array_sort(F.collect_list(F.struct("_ms", "_c")))
    spans = times.groupBy("_key", "_span").agg(listed.alias("_l")).select("_key", "_span", F.col("_l._ms").alias("_times"), F.col("_l._c").alias("_counts"))
    if connects is None:
        known = spans.withColumn("_connected", F.lit(None).cast("long"))
    else:
        first = connects.groupBy(key_of(keys).alias("_key")).agg(F.min(F.unix_millis(F.col(at).cast("timestamp"))).alias("_connected"))
        known = spans.join(first, "_key", "left")
    key = spans.schema["_key"].dataType.simpleString()
    tables = known.mapInArrow(_tables(length_ms, span_ms), f"_key {key}, _span long, _connected long, _total long, _upper array<long>, _exits array<long>, _after array<long>")
    in_order = Window.partitionBy("_key").orderBy("_span")
    entered = tables.withColumn("_first", F.row_number().over(in_order) == 1).mapInArrow(_entered(length_ms), f"_key {key}, _span long, _enter long, _had long")
    begun = F.when(F.col("_enter").isNull(), F.array().cast("array<long>")).otherwise(F.array("_enter"))
    opens = F.aggregate("_times", begun, lambda o, t: F.when((F.size(o) == 0) | (t - F.try_element_at(o, F.lit(-1)) > length_ms), F.concat(o, F.array(t))).otherwise(o))
    opened = spans.join(entered, ["_key", "_span"]).select("_key", "_span", "_enter", "_had", opens.alias("_opens"))
    placed = timed.join(opened, ["_key", "_span"])
    last = F.array_max(F.filter("_opens", lambda o: o <= F.col("_ms")))
    placed = placed.withColumn("_opened", F.coalesce(last, F.col("_opens")[0]))
    within = Window.partitionBy("_key", "_span", "_opened").orderBy("_ms", *order)
    had = F.when(F.col("_opened") == F.col("_enter"), F.col("_had")).otherwise(0)
    numbered = placed.withColumn("_n", F.row_number().over(within) + had)
    return numbered.select(*[F.col(f"`{c}`") for c in events.columns], "_opened", "_n")


def anchored(events: DataFrame, keys: list[str], **how) -> DataFrame:
    """``placed`` without ``_opened``."""
    return placed(events, keys, **how).drop("_opened")

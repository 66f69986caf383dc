"""Numbers, durations and their display, with ECMAScript's rounding. All are Column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..limits import LIMITS
from .strings import js_trim


def js_round(x: Column) -> Column:
    """Ties go towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def div(a: Column, b: int) -> Column:
    """Integer division of non-negative integers."""
    return F.call_function("div", a, F.lit(b))


def clamp_stored_ttl_ms(ms: Column, low: int = LIMITS.stored_ttl_min_ms, high: int = LIMITS.stored_ttl_max_ms) -> Column:
    return clamp(ms, low, high)


def clamp_client_ttl_s(s: Column, low: int = LIMITS.client_ttl_min_s, high: int = LIMITS.client_ttl_max_s) -> Column:
    return clamp(s, low, high)


def parse_int(text: Column) -> Column:
    """The leading integer of a text after white space; null if there is none."""
    digits = F.regexp_extract(js_trim(text), r"^([+-]?[0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def stored_ttl_ms(text: Column, *, absent: int = LIMITS.stored_ttl_max_ms, low: int = LIMITS.stored_ttl_min_ms, high: int = LIMITS.stored_ttl_max_ms) -> Column:
    """A TTL as sent in a form: absent takes the default, what is no number the upper bound, and all are clamped."""
    return clamp(F.coalesce(parse_int(F.coalesce(text, F.lit(str(absent)))), F.lit(high)), low, high)


def live_ttl_ms(ms: Column, low: int = LIMITS.live_ttl_min_ms, high: int = LIMITS.live_ttl_max_ms) -> Column:
    """No number (null or NaN) takes the upper bound."""
    return clamp(F.coalesce(F.nanvl(ms.cast("double"), F.lit(float(high))), F.lit(float(high))), float(low), float(high)).cast("bigint")


def format_bytes(b: Column) -> Column:
    """Whole bytes, whole KB or MB with one decimal; for integers, which make half-up rounding exact."""
    kb = F.concat(div(b + 512, 1024).cast("string"), F.lit(" KB"))
    tenths = div(b * 10 + 524_288, 1_048_576)
    mb = F.concat(div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1_048_576, kb).otherwise(mb)


def format_speed(bps: Column) -> Column:
    """For whole bytes a second; the thresholds are strict, so 1024 stays in bytes."""
    tenths = lambda unit, half: div(bps * 10 + half, unit)
    shown = lambda t, unit: F.concat(div(t, 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(unit))
    mb, kb = shown(tenths(1_048_576, 524_288), " MB/s"), shown(tenths(1024, 512), " KB/s")
    return F.when(bps > 1_048_576, mb).when(bps > 1024, kb).otherwise(F.concat(bps.cast("string"), F.lit(" B/s")))


@F.pandas_udf(T.StringType())
def format_speed_exact(bps: pd.Series) -> pd.Series:
    """For fractions of bytes a second: decimals round half up on the exact binary value."""

    def one(x: float) -> str | None:
        if pd.isna(x):
            return None
        for unit, name in ((1_048_576, " MB/s"), (1024, " KB/s")):
            if x > unit:
                return f"{(Decimal(x / unit)).quantize(Decimal('0.1'), ROUND_HALF_UP)}{name}"
        return f"{Decimal(x).quantize(Decimal('1'), ROUND_HALF_UP)} B/s"

    return bps.map(one)


def format_remaining(s: Column) -> Column:
    """Seconds, minutes with seconds, or hours with minutes; strict thresholds, so 60 is ``60s`` and 119.7 ``1m 60s``."""
    whole = lambda x: x.cast("bigint").cast("string")
    hours = F.concat(whole(F.floor(s / 3600)), F.lit("h "), whole(F.floor((s % 3600) / 60)), F.lit("m"))
    minutes = F.concat(whole(F.floor(s / 60)), F.lit("m "), whole(js_round(s % 60)), F.lit("s"))
    return F.when(s > 3600, hours).when(s > 60, minutes).otherwise(F.concat(whole(js_round(s)), F.lit("s")))


def format_ttl(s: Column) -> Column:
    """Minutes below an hour; from there hours, with a decimal only if they aren't whole."""
    minutes = F.concat(js_round(s / 60).cast("bigint").cast("string"), F.lit(" min"))
    tenths = F.floor(s / 360 + F.lit(0.5)).cast("bigint")
    whole = s % 3600 == 0
    hours = F.when(whole, F.floor(s / 3600).cast("bigint").cast("string")).otherwise(F.concat(div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))
    return F.when(s < 3600, minutes).otherwise(F.concat(hours, F.lit(" hr")))


def format_countdown(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("bigint")
    h, m, rest = div(s, 3600), div(s % 3600, 60), s % 60
    text = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    return F.when(ms <= 0, F.lit("Expired")).when(h > 0, text(h, "h ", m, "m")).when(m > 0, text(m, "m ", rest, "s")).otherwise(text(rest, "s"))


def split_ttl(s: Column) -> Column:
    """Hours and rounded minutes of a clamped client TTL, as a struct; the minutes can be 60."""
    clamped = clamp_client_ttl_s(s)
    return F.struct(F.floor(clamped / 3600).cast("bigint").alias("hours"), js_round((clamped % 3600) / 60).cast("bigint").alias("minutes"))


def duration_part(x: Column, high: int) -> Column:
    """A typed number of hours or minutes: what is not finite counts as 0, the rest is truncated and clamped."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, clamp(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), 0, high)).otherwise(F.lit(0)).cast("bigint")


def stored_duration_s(hours: Column, minutes: Column) -> Column:
    return clamp_client_ttl_s(duration_part(hours, 10) * 3600 + duration_part(minutes, 59) * 60)


def route_mode(total_bytes: Column, *, published: Column | None = None, stored_enabled: Column | None = None, limit: int = LIMITS.stored_payload_bytes) -> Column:
    """A published mode sticks; without the store all is live; else small payloads are stored."""
    by_size = F.when(total_bytes <= limit, F.lit("stored")).otherwise(F.lit("live"))
    out = by_size if stored_enabled is None else F.when(~stored_enabled, F.lit("live")).otherwise(by_size)
    return out if published is None else F.coalesce(published, out)


def backoff_ms(attempt: Column, *, base: int = LIMITS.reconnect_base_ms, most: int = LIMITS.reconnect_max_ms, attempts: int = LIMITS.reconnect_attempts) -> Column:
    """The delay before a reconnect without its jitter; null once the attempts are used up."""
    return F.when(attempt < attempts, F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(float(most))).cast("bigint"))


def fraction(by: Column) -> Column:
    """A number in [0, 1) that looks random but depends on a value alone, so a retried task draws it again."""
    return F.conv(F.substring(F.md5(by.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def jittered_backoff_ms(attempt: Column, by: Column, *, jitter_ms: int = 500, base: int = LIMITS.reconnect_base_ms, most: int = LIMITS.reconnect_max_ms, attempts: int = LIMITS.reconnect_attempts) -> Column:
    """The delay before a reconnect with its jitter, drawn by a value of the row."""
    return js_round(backoff_ms(attempt, base=base, most=most, attempts=attempts) + fraction(by) * jitter_ms).cast("bigint")


def response_delay_ms(known: Column, by: Column, *, low: int = 500, high: int = 1500, unknown: int = 800) -> Column:
    """How long an answer about a code is held back: a drawn time, or a fixed one if there is no such code."""
    return F.when(known, F.floor(fraction(by) * (high - low)) + low).otherwise(F.lit(unknown)).cast("bigint")


def elapsed_ms(since: Column, until: Column) -> Column:
    """Latency or uptime between two times."""
    return F.unix_millis(until) - F.unix_millis(since)


def remaining_ms(expires_at: Column, as_of: Column) -> Column:
    return F.greatest(F.unix_millis(expires_at) - F.unix_millis(as_of), F.lit(0))


def add_ttl(at: Column, ttl_ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(at) + ttl_ms)

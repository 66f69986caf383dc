"""Filters and routes over sessions, uploads, frames and requests. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..limits import LIMITS
from .strings import js_trim


def active(expires_at: Column, as_of: Column) -> Column:
    """Not expired at a moment; the exact moment of expiry is expired."""
    return expires_at > as_of


def expired(expires_at: Column, as_of: Column) -> Column:
    return expires_at <= as_of


def past_retention(expires_at: Column, as_of: Column, retention_ms: int = LIMITS.retention_ms) -> Column:
    return F.unix_millis(expires_at) + retention_ms <= F.unix_millis(as_of)


def is_role(role: Column) -> Column:
    return F.coalesce(role.isin("publisher", "recipient"), F.lit(False))


def message_route(kind: Column, joined: Column) -> Column:
    """What a frame of a type comes to: ``join``, ``relay``, or the error that is sent back."""
    unknown = F.concat(F.lit("Unknown type: "), F.coalesce(kind, F.lit("undefined")))
    return F.when(kind == "join", F.lit("join")).when(~joined, F.lit("Send join first")).when(kind.isin("offer", "answer", "ice"), F.lit("relay")).otherwise(unknown)


def origin_listed(origin: Column, allowed: Column) -> Column:
    """An empty list or a star allows all origins; a missing one is on no list."""
    return (F.size(allowed) == 0) | F.array_contains(allowed, "*") | F.coalesce(F.array_contains(allowed, origin), F.lit(False))


def http_blocked(method: Column, origin: Column, allowed: Column) -> Column:
    """Only methods that change something are blocked, and only for an origin that is sent."""
    unsafe = ~F.upper(method).isin("GET", "HEAD", "OPTIONS")
    return unsafe & origin.isNotNull() & ~origin_listed(origin, allowed)


def socket_blocked(origin: Column, allowed: Column) -> Column:
    return ~origin_listed(F.coalesce(origin, F.lit("")), allowed)


def payload_too_big(total: Column, limit: int = LIMITS.stored_payload_bytes) -> Column:
    return total > limit


def live_file_too_big(size: Column, limit: int = LIMITS.live_file_bytes) -> Column:
    return size > limit


def frame_too_big(raw: Column, limit: int = LIMITS.frame_bytes) -> Column:
    return F.octet_length(raw) > limit


def has_payload(text: Column, files: Column) -> Column:
    return (F.length(js_trim(F.coalesce(text, F.lit("")))) > 0) | (F.coalesce(F.size(files), F.lit(0)) > 0)


def store_full(data_size: Column, limit: int = LIMITS.store_full_bytes) -> Column:
    return data_size > limit


#: Driver errors that a second attempt may cure.
_RETRY_NAMES = ("MongoNetworkError", "MongoServerSelectionError", "MongoNotConnectedError")
_RETRY_CODES = ("ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN", "EPIPE")
_RETRY_MESSAGE = r"(?i)tlsv1 alert internal error|SSL routines|socket hang up|buffering timed out|connection (?:closed|dropped|reset)|topology is closed"


def retryable(name: Column, code: Column, message: Column, *, names=_RETRY_NAMES, codes=_RETRY_CODES, pattern: str = _RETRY_MESSAGE) -> Column:
    return F.coalesce(name.isin(*names), F.lit(False)) | F.coalesce(code.isin(*codes), F.lit(False)) | F.coalesce(message.rlike(pattern), F.lit(False))


def duplicate_key(code: Column) -> Column:
    return F.coalesce(code == 11000, F.lit(False))


def limit_error(code: Column, message: Column) -> Column:
    return F.coalesce(message.contains("exceed"), F.lit(False)) | F.coalesce(code == "LIMIT_FILE_SIZE", F.lit(False))


def may_send(payload: Column, channel: Column) -> Column:
    return payload.isNotNull() & F.coalesce(channel == "open", F.lit(False))


def admin_allowed(given: Column, key: Column) -> Column:
    """Without a key nobody is let in."""
    return F.coalesce((F.length(key) > 0) & (given == key), F.lit(False))


def remove_key(items: Column, field: str, key: Column) -> Column:
    return F.filter(items, lambda x: x[field] != key)


def remove_at(items: Column, index: Column) -> Column:
    return F.filter(items, lambda _, i: i != index)

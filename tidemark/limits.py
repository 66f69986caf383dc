"""Default limits. Every operator takes those it needs as arguments."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024


@dataclass(frozen=True)
class Limits:
    # Fixed values.
    stored_payload_bytes: int = 10 * MIB
    live_file_bytes: int = 100 * MIB
    upload_files: int = 20
    field_bytes: int = MIB
    store_full_bytes: int = 450 * MIB
    frame_bytes: int = 65_536
    chunk_bytes: int = 64 * 1024
    buffer_bytes: int = 256 * 1024
    recipients: int = 50
    frames_per_window: int = 100
    frame_window_ms: int = 60_000
    lockout_failures: int = 10
    lockout_window_ms: int = 15 * 60_000
    http_window_ms: int = 15 * 60_000
    stored_ttl_min_ms: int = 60_000
    stored_ttl_max_ms: int = 3_600_000
    client_ttl_min_s: int = 60
    client_ttl_max_s: int = 36_000
    live_ttl_min_ms: int = 60_000
    live_ttl_max_ms: int = 86_400_000
    idle_ms: int = 5 * 60_000
    inactivity_ms: int = 30_000
    heartbeat_ms: int = 30_000
    burn_delay_ms: int = 3_000
    retention_ms: int = 2 * 3_600_000
    reconnect_base_ms: int = 1_000
    reconnect_max_ms: int = 30_000
    reconnect_attempts: int = 5
    pbkdf2_rounds: int = 100_000


LIMITS = Limits()

#: Requests that a client may make to a route in a window; for ``password`` only failures count.
HTTP_LIMITS = {"publish": 10, "update": 20, "session": 20, "password": 10, "retrieve": 15, "file": 60}

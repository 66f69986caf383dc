"""Schemas of the tables, as Spark DDL."""

FILES = "ARRAY<STRUCT<name: STRING, mimeType: STRING, size: BIGINT, gridfsId: STRING, token: STRING>>"

SCHEMAS = {
    "stored_session": f"code STRING, text STRING, files {FILES}, expires_at TIMESTAMP, created_at TIMESTAMP, password STRING, burn_on_read BOOLEAN",
    "gridfs_file": "_id STRING, filename STRING, length BIGINT, chunk_size INT, upload_date TIMESTAMP, metadata STRUCT<mimeType: STRING>",
    "gridfs_chunk": "_id STRING, files_id STRING, n INT, data BINARY",
    "live_session": (
        "code STRING, created_at_ms BIGINT, expires_at_ms BIGINT, password_hash STRING, "
        "publisher STRUCT<id: STRING, role: STRING, connected_at_ms: BIGINT>, "
        "recipients ARRAY<STRUCT<id: STRING, role: STRING, connected_at_ms: BIGINT>>"
    ),
    "signal_event": "ts TIMESTAMP, conn_id STRING, ip STRING, seq BIGINT, raw STRING",
    "transfer_event": "transfer_id STRING, seq BIGINT, ts TIMESTAMP, kind STRING, json STRING, data BINARY, byte_len BIGINT",
    "http_event": "ts TIMESTAMP, ip STRING, route STRING, status INT",
}

"""Boundary rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers as n
from tidemark.functions import predicates as p
from tidemark.functions import strings as s


def values(spark, inputs, build, kind="bigint"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("build", "kind", "cases"),
    [
        (n.format_bytes, "bigint", {1023: "1023 B", 1024: "1 KB", 1048575: "1024 KB", 1048576: "1.0 MB"}),
        (n.format_speed, "bigint", {1024: "1024 B/s", 1025: "1.0 KB/s", 1048576: "1024.0 KB/s", 1048577: "1.0 MB/s"}),
        (n.format_speed_exact, "double", {1024.0: "1024 B/s", 153.6: "154 B/s", 1126.4: "1.1 KB/s"}),
        (n.format_remaining, "double", {60.0: "60s", 61.0: "1m 1s", 119.7: "1m 60s", 3600.0: "60m 0s", 3601.0: "1h 0m"}),
        (n.format_ttl, "bigint", {3599: "60 min", 3600: "1 hr", 5400: "1.5 hr"}),
        (n.format_countdown, "bigint", {0: "Expired", 59999: "59s", 60000: "1m 0s", 3600000: "1h 0m"}),
        (n.stored_ttl_ms, "string", {"0": 60000, "36000000": 3600000, "abc": 3600000, None: 3600000, "120000ms": 120000}),
        (n.js_round, "double", {2.5: 3, -2.5: -2, 0.4999: 0}),
        (n.backoff_ms, "int", {0: 1000, 4: 16000, 5: None}),
        (lambda x: n.duration_part(x, 10), "double", {float("inf"): 0, float("nan"): 0, 11.9: 10, 2.9: 2, -0.5: 0}),
        (lambda x: n.split_ttl(x)["minutes"], "bigint", {3599: 60, 3600: 0, 90: 2}),
        (n.live_ttl_ms, "double", {1.0: 60000, None: 86400000, 120000.0: 120000}),
        (s.is_code, "string", {"123456": True, "12345": False, "123456\n": False, "१२३४५६": False}),
        (s.is_token, "string", {"a" * 32: True, "A" * 32: False, "123": False}),
        (s.sanitise_filename, "string", {"C:\\a\\b.txt": "b.txt", "../../x": "x", "a...b": "a.b", "..": "file", "": "file", "a/": "file", "n\0ul": "nul"}),
        (s.strip_scripts, "string", {"a<SCRIPT x=1>b\nc</script>d": "ad", "<scripted>": "<scripted>"}),
        (s.js_trim, "string", {"\t\u00a0\u3000a b\ufeff\n": "a b", "": ""}),
        (s.pad_code, "bigint", {7: "000007", 1234567: "1234567"}),
        (s.digits_only, "string", {"1a2-34 5678": "123456"}),
        (s.encode_component, "string", {"a b!'()*~é.txt": "a%20b!'()*~%C3%A9.txt"}),
        (s.socket_url, "string", {"https://x": "wss://x", "http://x": "ws://x"}),
        (s.code_of_path, "string", {"https://h/012345": "012345", "https://h/a": "", "https://h/1234567": ""}),
        (s.is_true, "string", {"true": True, "True": False, None: False}),
        (s.split_list, "string", {"a, b ,c": ["a", "b", "c"], None: []}),
        (s.mime_or_default, "string", {"": "application/octet-stream", "a/b": "a/b", None: "application/octet-stream"}),
        (s.mime_if_null, "string", {"": "", None: "application/octet-stream"}),
        (s.signal_label, "string", {"lost": "Session Lost", "reconnecting 2": "Reconnecting...", "x": "x"}),
        (s.signal_color, "string", {"failed": "error", "offline": "warning", "connected": "success", "x": "dim"}),
        (s.health_status, "int", {-2: "degraded", -1: "ok", 5: "ok"}),
    ],
)
def test_golden(spark, build, kind, cases):
    assert values(spark, list(cases), build, kind) == list(cases.values())


def test_expiry_is_split_without_overlap(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "s int").select(F.timestamp_seconds("s").alias("e"))
    at = F.timestamp_seconds(F.lit(2))
    assert [tuple(r) for r in rows.select(p.active(F.col("e"), at), p.expired(F.col("e"), at)).collect()] == [(False, True), (False, True), (True, False)]


def test_origins(spark):
    rows = spark.createDataFrame([("POST", "a", ["b"]), ("GET", "a", ["b"]), ("POST", None, ["b"]), ("POST", "a", []), ("POST", "a", ["*"])], "m string, o string, l array<string>")
    got = [tuple(r) for r in rows.select(p.http_blocked(F.col("m"), F.col("o"), F.col("l")), p.socket_blocked(F.col("o"), F.col("l"))).collect()]
    assert got == [(True, True), (False, True), (False, True), (False, False), (False, False)]


def test_errors(spark):
    rows = spark.createDataFrame([("MongoNetworkError", None, None), ("X", "EPIPE", ""), ("X", None, "Socket Hang Up"), ("X", "1", "no")], "n string, c string, m string")
    assert [r[0] for r in rows.select(p.retryable(F.col("n"), F.col("c"), F.col("m"))).collect()] == [True, True, True, False]


def test_lists(spark):
    row = spark.range(1).select(F.expr("array(named_struct('k', 1), named_struct('k', 2))").alias("a"))
    assert row.select(p.remove_key(F.col("a"), "k", F.lit(1)).alias("x"), p.remove_at(F.col("a"), F.lit(1)).alias("y")).first() == (([(2,)], [(1,)]))


def test_routes(spark):
    rows = spark.createDataFrame([("join", False), ("offer", False), ("ice", True), ("abort", True)], "t string, j boolean")
    assert [r[0] for r in rows.select(p.message_route(F.col("t"), F.col("j"))).collect()] == ["join", "Send join first", "relay", "Unknown type: abort"]
    mode = spark.createDataFrame([(1, None, True), (1, None, False), (1, "live", True), (11 << 20, None, True)], "b long, m string, e boolean")
    assert [r[0] for r in mode.select(n.route_mode(F.col("b"), published=F.col("m"), stored_enabled=F.col("e"))).collect()] == ["stored", "live", "live", "live"]

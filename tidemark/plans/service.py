"""Queries of the request, transfer and text rules, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crypto, numbers, predicates, strings
from ..operators import folds, integrity, lookup, mutations, transfer
from ..sources import readers, sinks
from .registry import query

# Requests


@query("""
SELECT 'any' AS asked, o_orderkey FROM orders WHERE o_orderkey = 7
UNION ALL SELECT 'then', o_orderkey FROM orders WHERE o_orderkey = 7 AND o_orderdate + INTERVAL 9 DAY > TIMESTAMP '1990-01-01'
UNION ALL SELECT 'now', o_orderkey FROM orders WHERE o_orderkey = 7 AND o_orderdate + INTERVAL 9 DAY > TIMESTAMP '2020-01-01'
""")
def find_session(orders):
    """An order as a session: asked for with no moment, with one at which it is active, and with one at which it is expired."""
    stored = orders.select(strings.pad_code(F.col("o_orderkey")).alias("code"), "o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 9 DAY")).alias("expires_at"))
    at = lambda x: F.lit(x).cast("timestamp")
    found = [("any", None), ("then", at("1990-01-01 00:00:00")), ("now", at("2020-01-01 00:00:00"))]
    parts = [lookup.find_session(stored, "000007", moment).select(F.lit(name).alias("asked"), "o_orderkey") for name, moment in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT doc_id, 'stored' AS mode, 200000 AS expires, CAST(doc_id AS VARCHAR) AS file_id, lang AS token, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS json FROM documents""")
def retrieved_view(documents):
    """Documents as sessions with one file: what a retrieval answers, and a row as JSON."""
    file = F.struct(F.lit("n").alias("name"), F.lit("m").alias("mimeType"), F.col("n_chars").alias("size"), F.col("doc_id").alias("gridfsId"), F.col("lang").alias("token"))
    stored = documents.select(F.col("doc_id").alias("code"), F.lit("").alias("text"), F.lit("secret").alias("password"), F.timestamp_seconds(F.lit(200)).alias("expires_at"), F.array(file).alias("files"))
    seen = lookup.retrieved(lookup.public_view(stored)).select("code", "mode", F.col("expiresAt").cast("int").alias("expires"), F.col("files")[0]["fileId"].alias("file_id"), F.col("files")[0]["token"].alias("token"))
    answers = sinks.json_answers(documents.select("doc_id", "lang")).select(F.col("value").alias("json"), F.get_json_object("value", "$.doc_id").cast("bigint").alias("code"))
    return seen.join(answers, "code").withColumnRenamed("code", "doc_id")


@query("""
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 400 WHEN doc_id % 7 = 0 THEN 400 WHEN coalesce(quality, 0) = 0 THEN 404 WHEN toxic = 1 AND doc_id % 2 = 0 THEN 401 ELSE 200 END AS status,
       CASE WHEN doc_id % 9 = 0 THEN 'Invalid token format' WHEN doc_id % 7 = 0 THEN 'Invalid fileId' WHEN coalesce(quality, 0) = 0 THEN 'File not found or session expired' WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'forbidden' END AS error
FROM documents LEFT JOIN labels USING (doc_id)
""")
def file_outcome(documents, labels):
    """Documents as requests for blobs, labels as sessions with one file: poor ones expired, toxic ones locked."""
    digest = lambda: F.md5(F.col("doc_id").cast("string"))
    token = F.when(F.col("doc_id") % 9 == 0, F.lit("bad")).otherwise(digest())
    file_id = F.when(F.col("doc_id") % 7 == 0, F.lit("bad")).otherwise(F.substring(digest(), 1, 24))
    asked = documents.select("doc_id", file_id.alias("file_id"), token.alias("token"), (F.col("doc_id") % 2 == 1).alias("password_ok"))
    file = F.struct(F.substring(digest(), 1, 24).alias("gridfsId"), digest().alias("token"))
    stored = labels.select(F.col("doc_id").alias("code"), F.when(F.col("toxic") == 1, F.lit("x")).alias("password"), F.timestamp_seconds(F.col("quality") * 200).alias("expires_at"), F.array(file).alias("files"))
    return lookup.file_outcome(asked, stored, F.timestamp_seconds(F.lit(100))).select("doc_id", "status", "error")


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 400 WHEN b + n_chars > 2000 THEN 400 WHEN doc_id % 11 = 0 THEN 503 WHEN b = 0 AND n_chars % 2 = 0 THEN 400 ELSE 200 END AS status,
       CASE WHEN doc_id % 5 = 0 THEN 'Password is required' WHEN b + n_chars > 2000 THEN 'Payload exceeds the limit' WHEN doc_id % 11 = 0 THEN 'storage_full' WHEN b = 0 AND n_chars % 2 = 0 THEN 'Nothing to publish' END AS error
FROM (SELECT doc_id, CASE WHEN n_chars % 2 = 1 THEN n_chars ELSE 0 END AS n_chars, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE strlen(lang) END AS b FROM documents)
""")
def publish_outcome(documents):
    """Documents as publications: the text is the language between blanks or only blanks; odd sizes come as a file."""
    text = F.when(F.col("doc_id") % 3 == 0, F.lit(" \n ")).otherwise(F.concat(F.lit("<script>x</script>  "), F.col("lang"), F.lit(" ")))
    none = F.array().cast("array<struct<size:bigint>>")
    files = F.when(F.col("n_chars") % 2 == 1, F.array(F.struct(F.col("n_chars").alias("size")))).otherwise(none)
    asked = documents.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.lit("p")).alias("password"), text.alias("text"), files.alias("files"))
    return lookup.publish_outcome(asked, limit=2000, full=F.col("doc_id") % 11 == 0).select("doc_id", "status", "error")


@query("""
SELECT doc_id, CASE s WHEN 0 THEN 'show' WHEN 1 THEN 'ask_password' WHEN 2 THEN 'expired' WHEN 3 THEN 'join_live' WHEN 4 THEN 'not_found' ELSE 'failed' END AS action FROM (SELECT doc_id, doc_id % 6 AS s FROM documents)
""")
def retrieve_action(documents):
    k = F.col("doc_id") % 6
    status = F.element_at(F.array(*map(F.lit, (200, 401, 410, 404, 404, 500))), (k + 1).cast("int"))
    return documents.select("doc_id", lookup.retrieve_action(status, F.when(k == 3, F.lit("live_session"))).alias("action"))


_LIMITS = """
WITH RECURSIVE q AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'publish' WHEN 'click' THEN 'retrieve' WHEN 'view' THEN 'file' ELSE 'password' END AS route, user_id % 5 AS ip, epoch_us(ts) // 1000 AS ms FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY route, ip ORDER BY ms, event_id) AS r FROM q WHERE route <> 'password' OR event_id % 2 = 0),
f AS (SELECT event_id, route, ip, r, ms AS opened, CAST(1 AS BIGINT) AS n FROM e WHERE r = 1
      UNION ALL SELECT e.event_id, e.route, e.ip, e.r, CASE WHEN e.ms - f.opened > 43200000 THEN e.ms ELSE f.opened END, CASE WHEN e.ms - f.opened > 43200000 THEN 1 ELSE f.n + 1 END
      FROM f JOIN e ON e.route = f.route AND e.ip = f.ip AND e.r = f.r + 1)
SELECT event_id, route, n, n > CASE route WHEN 'publish' THEN 3 WHEN 'retrieve' THEN 2 WHEN 'file' THEN 6 ELSE 1 END AS over FROM f
"""


@query(_LIMITS)
def http_limits(events):
    """Event types as routes; every other failed password counts."""
    kinds = {"purchase": "publish", "click": "retrieve", "view": "file"}
    route = F.coalesce(F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("event_type")], F.lit("password"))
    asked = events.select("event_id", route.alias("route"), (F.col("user_id") % 5).alias("ip"), "ts", F.when(F.col("event_id") % 2 == 0, F.lit(401)).otherwise(F.lit(200)).alias("status"))
    limits = {"publish": 3, "retrieve": 2, "file": 6, "password": 1}
    return folds.http_limits(asked, order=["event_id"], limits=limits, length_ms=12 * 3_600_000).select("event_id", "route", "n", "over")


@query("""
SELECT l_orderkey, arg_min(CASE WHEN f > 2 AND file THEN 'LIMIT_FILE_COUNT' WHEN file AND l_quantity > 40 THEN 'LIMIT_FILE_SIZE' WHEN NOT file AND l_quantity > 30 THEN 'LIMIT_FIELD_VALUE' END, spot) AS error
FROM (SELECT *, sum(CAST(file AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY spot ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT *, l_returnflag <> 'N' AS file, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS spot FROM lineitem)) GROUP BY 1
""")
def upload_errors(lineitem):
    """Orders as multipart requests, their lines as parts: returned ones are files."""
    at = F.col("l_linenumber").cast("bigint") * 1_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey")
    parts = lineitem.select("l_orderkey", at.alias("at"), F.when(F.col("l_returnflag") == "N", F.lit("field")).otherwise(F.lit("file")).alias("kind"), F.col("l_quantity").alias("length"))
    return readers.upload_errors(parts, "l_orderkey", files=2, file_bytes=40, field_bytes=30)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1009 WHEN event_id % 3 = 1 THEN 1003 END AS close_code, CASE WHEN event_id % 3 = 2 THEN event_type END AS type FROM events""")
def parse_frames(events):
    """Frames that are too big, no JSON, and right ones."""
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.rpad(F.lit("["), 70_000, "1")).when(k == 1, F.lit("{")).otherwise(F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('"}')))
    return readers.parse_frames(events.select("event_id", raw.alias("raw"))).select("event_id", "close_code", "type")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 1")
def client_frames(events):
    raw = F.when(F.col("event_id") % 3 == 1, F.lit("no json")).otherwise(F.col("props"))
    return readers.client_frames(events.select("event_id", raw.alias("raw"))).select("event_id")


@query("SELECT event_id, user_id FROM events WHERE user_id % 3 = 0 AND event_type <> 'error'")
def send_if_open(events):
    """Users as channels, open for every third; errors have no payload."""
    messages = events.select("event_id", F.col("user_id").alias("peer_id"), F.when(F.col("event_type") != "error", F.col("props")).alias("payload"))
    state = F.when(F.col("user_id") % 3 == 0, F.lit("open")).otherwise(F.lit("closing"))
    channels = events.select(F.col("user_id").alias("peer_id"), state.alias("state")).distinct()
    return sinks.send_if_open(messages, channels).select("event_id", F.col("peer_id").alias("user_id"))


@query("SELECT event_id FROM events WHERE user_id % 4 <> 0")
def deliverable(events):
    state = F.when(F.col("user_id") % 4 == 0, F.lit("closed")).otherwise(F.lit("open"))
    open_ = events.select(F.col("user_id").alias("conn_id"), state.alias("state")).distinct()
    return sinks.deliverable(events.select("event_id", F.col("user_id").alias("conn_id")), open_).select("event_id")


@query("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def peer_lookup(events, customer):
    connections = customer.select(F.col("c_custkey").alias("peer_id"), "c_mktsegment")
    return lookup.peers(connections, events.select("event_id", F.col("user_id").alias("peer_id"))).select("event_id", "c_mktsegment")


@query("""SELECT event_id, '{"level":"info","time":' || (epoch_us(ts) // 1000) || ',"event_id":' || event_id || ',"event_type":"' || event_type || '","msg":"seen"}' AS value FROM events""")
def log_lines(events):
    lines = sinks.log_lines(events.select("event_id", "event_type", "ts"), "info", "seen")
    return lines.select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), "value")


# Mutations


@query("""
SELECT doc_id, doc_id AS place, lang AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, doc_id + m, 'new' FROM labels, (SELECT max(doc_id) + 1 AS m FROM documents)
""")
def upsert_last(documents, labels):
    rows = documents.select("doc_id", F.col("doc_id").alias("place"), F.col("lang").alias("v"))
    return mutations.upsert_last(rows, labels.select("doc_id", F.col("doc_id").alias("place"), F.lit("new").alias("v")), "doc_id", "place")


@query("""
SELECT c_custkey, coalesce(e.t, c_mktsegment) AS text, coalesce(e.p, 'old') AS password, coalesce(e.b, true) AS burn
FROM customer LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS t, max_by(props, event_id) FILTER (event_type = 'click') AS p, max_by(event_id % 4 = 0, event_id) FILTER (event_type = 'view') AS b FROM events GROUP BY 1) e ON e.user_id = c_custkey
""")
def update_sessions(customer, events):
    """Customers as sessions, events as their changes: a click brings a password, a view says whether to burn."""
    none = F.array().cast("array<string>")
    stored = customer.select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("text"), none.alias("files"), F.timestamp_seconds(F.lit(0)).alias("expires_at"), F.lit("old").alias("password"), F.lit(True).alias("burn_on_read"))
    kind = F.col("event_type")
    changes = events.select(F.col("user_id").alias("code"), F.col("event_id").alias("updated_at"), none.alias("files"), kind.alias("text"), F.timestamp_seconds(F.lit(1)).alias("expires_at"), F.when(kind == "click", F.col("props")).alias("password"), F.when(kind == "view", F.col("event_id") % 4 == 0).alias("burn_on_read"))
    return mutations.update_sessions(stored, changes).select(F.col("code").alias("c_custkey"), "text", "password", F.col("burn_on_read").alias("burn"))


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT doc_id + 1000000 FROM labels WHERE doc_id IN (SELECT item_id FROM benchmark)")
def insert_with_retries(labels, benchmark):
    """New sessions under their id, or under another where that is taken."""
    new = labels.select(F.col("doc_id").alias("row"), F.lit(0).alias("created_at"), F.array("doc_id", F.col("doc_id") + 1_000_000).alias("candidates"))
    taken = benchmark.select(F.col("item_id").alias("code"))
    return mutations.insert_with_retries(taken, new, "candidates").select(F.col("code").alias("doc_id"))


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem")
def referenced_ids(lineitem):
    return integrity.referenced_ids(lineitem.select(F.array(F.struct(F.col("l_orderkey").alias("gridfsId"))).alias("files"))).withColumnRenamed("_id", "id")


@query("SELECT o_orderkey, o_orderdate + INTERVAL 9 DAY <= TIMESTAMP '1995-06-17' AS deleted FROM orders")
def startup_recovery(orders):
    sessions = orders.select(F.col("o_orderkey").alias("code"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 9 DAY")).alias("expires_at"))
    gone, armed = folds.startup_recovery(sessions, F.lit("1995-06-17 00:00:00").cast("timestamp"))
    told = lambda df, x: df.select(F.col("code").alias("o_orderkey"), F.lit(x).alias("deleted"))
    return told(gone, True).unionByName(told(armed, False))


# Transfers

_STREAM = """
WITH t AS (SELECT conv_id, turn, strlen(text) AS n, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto, sum(strlen(text)) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations),
"""


@query(
    _STREAM
    + """
c AS (SELECT conv_id, any_value(turns) AS turns, count(*) FILTER (upto - n < total // 2 + 1) AS done, sum(n) FILTER (upto - n < total // 2 + 1) AS b FROM t GROUP BY 1)
SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'aborted' ELSE CASE WHEN done >= turns THEN 'stalled' ELSE 'open' END END AS state, done AS chunks_done, turns AS chunks_total, done = turns AS count_matches, CAST(b AS BIGINT) AS bytes FROM c
"""
)
def receive(conversations):
    """Conversations as transfers of one file of half their bytes, turns as chunks: what comes once it is full is dropped."""
    rows = conversations.select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("n"))
    meta = rows.groupBy("conv_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("turns"))
    opening = F.concat(F.lit('{"type":"meta","files":[{"size":'), (numbers.div(F.col("total"), 2) + 1).cast("string"), F.lit('}],"totalChunks":'), F.col("turns").cast("string"), F.lit("}"))
    ending = F.when(F.col("conv_id") % 3 == 0, F.lit('{"type":"done"}')).when(F.col("conv_id") % 3 == 1, F.lit('{"type":"abort"}')).otherwise(F.lit("no message"))
    said = lambda seq, text: meta.select("conv_id", seq.alias("seq"), F.lit("json").alias("kind"), text.alias("json"), F.lit(None).cast("bigint").alias("byte_len"))
    chunks = rows.select("conv_id", F.col("turn").alias("seq"), F.lit("binary").alias("kind"), F.lit(None).cast("string").alias("json"), F.col("n").alias("byte_len"))
    events = said(F.lit(-1).cast("bigint"), opening).unionByName(chunks).unionByName(said(F.lit(1 << 40), ending))
    return folds.receive(events, key="conv_id").select("conv_id", "state", "chunks_done", "chunks_total", "count_matches", F.col("file_bytes")[0].alias("bytes"))


@query(
    _STREAM
    + """
x AS (SELECT conv_id, min(upto) FILTER (upto >= total // 3 + 1) AS x FROM t GROUP BY 1)
SELECT conv_id, turn, CASE WHEN upto - n < total // 3 + 1 THEN 0 ELSE 1 END AS file_index, CAST(n AS BIGINT) AS bytes, CAST(sum(n) OVER (PARTITION BY conv_id, upto - n < total // 3 + 1 ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS file_bytes
FROM t JOIN x USING (conv_id) WHERE upto - n < total // 3 + 1 OR upto - n - x < total
"""
)
def attribute_received(conversations):
    """Turns as chunks received for two files: the first has a third of the bytes, the second is longer than what comes."""
    chunks = conversations.select("conv_id", F.col("turn").alias("seq"), F.octet_length("text").cast("bigint").alias("byte_len"))
    total = chunks.groupBy("conv_id").agg(F.sum("byte_len").alias("total"))
    files = total.select("conv_id", F.posexplode(F.array(numbers.div(F.col("total"), 3) + 1, F.col("total"))).alias("file_index", "size"))
    told = transfer.file_progress(transfer.attribute(chunks, files, "conv_id", mode="receiver"), "conv_id")
    return told.select("conv_id", F.col("seq").alias("turn"), "file_index", F.col("byte_len").alias("bytes"), F.col("file_bytes_done").alias("file_bytes"))


@query("""
SELECT event_id, done AS bytes_done, CASE WHEN s > 0 THEN done / s ELSE 0.0 END AS speed, CASE WHEN s > 0 THEN (total - done) / (done / s) ELSE 0.0 END AS time_remaining
FROM (SELECT event_id, CAST(sum(event_id % 100 + 1) OVER w AS BIGINT) AS done, CAST(sum(event_id % 100 + 1) OVER (PARTITION BY user_id) AS BIGINT) AS total, (epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id)) / 1000 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
""")
def speed_and_eta(events):
    """Users as transfers, events as chunks; the first event's time is the start."""
    chunks = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 100 + 1).alias("byte_len"))
    totals = chunks.groupBy("user_id").agg(F.sum("byte_len").alias("bytes_total"), F.min("ts").alias("started"))
    return transfer.progress(chunks, totals, "user_id", seq="event_id", at="ts", started="started").select("event_id", "bytes_done", "speed", "time_remaining")


@query("""
SELECT event_id, flight, coalesce(sum(b) OVER (PARTITION BY user_id, flight ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 150 AS waits
FROM (SELECT event_id, user_id, event_id % 100 AS b, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS flight FROM events)
""")
def back_pressure(events):
    """Users as channels that are drained after each error; a chunk waits if over 150 bytes are ahead of it."""
    chunks = events.select("event_id", "user_id", (F.col("event_id") % 100).alias("byte_len"))
    drains = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("after_seq"))
    return folds.sent_when(chunks, drains, "user_id", seq="event_id", limit=150).select("event_id", "flight", "waits")


@query("SELECT user_id, count(*) AS joined FROM events WHERE event_type = 'click' GROUP BY 1")
def ever_joined(events):
    kind = F.when(F.col("event_type") == "click", F.lit("ready")).otherwise(F.col("event_type"))
    return folds.ever_joined(events.select("user_id", kind.alias("type")), "user_id")


@query("SELECT doc_id, CASE WHEN strlen(text) = 0 THEN md5('') ELSE md5(text) END AS digest, lang AS mime FROM documents")
def read_blobs(documents):
    """Texts stored as chunks of 2 KiB and read back as blobs."""
    files = documents.select(F.col("doc_id").alias("_id"), F.lit("f").alias("filename"), F.struct(F.col("lang").alias("mimeType")).alias("metadata"))
    chunks = readers.split_blobs(documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("data")), chunk_bytes=2048)
    return readers.read_blobs(files, chunks).select(F.col("_id").alias("doc_id"), F.md5("data").alias("digest"), F.col("mimeType").alias("mime"))


@query("""
SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(least(2048, strlen(text) - n * 2048) AS INTEGER) AS bytes, CASE WHEN n = 0 THEN 'attachment; filename="' || lang || '%20' || source || '"' END AS disposition
FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(strlen(text) / 2048) AS BIGINT)))) AS n FROM documents)
""")
def download_stream(documents):
    """Texts as blobs, sent piece by piece."""
    files = documents.select(F.col("doc_id").alias("_id"), F.concat_ws(" ", "lang", "source").alias("filename"), F.struct(F.col("lang").alias("mimeType")).alias("metadata"))
    chunks = readers.split_blobs(documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("data")), chunk_bytes=2048)
    return sinks.download_stream(files, chunks).select(F.col("_id").alias("doc_id"), "n", F.octet_length("data").alias("bytes"), F.col("content_disposition").alias("disposition"))


# Ordered rules


@query("""
SELECT user_id, 300000 AS ended_at_ms FROM (SELECT user_id, min(epoch_us(ts) // 1000 - 1704067200000) FILTER (event_type = 'purchase') AS f FROM events GROUP BY 1) WHERE f IS NULL OR f > 300000
""")
def idle_ends(events):
    """Users as sessions created at the start of 2024, purchases as publishers that join."""
    sessions = events.select(F.col("user_id").alias("code")).distinct().withColumn("created_at_ms", F.lit(0).cast("bigint")).withColumn("expires_at_ms", F.lit(None).cast("bigint"))
    shifted = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) - 1_704_067_200_000)
    joins = events.where("event_type = 'purchase'").select(F.col("user_id").alias("code"), F.lit("publisher").alias("role"), shifted.alias("ts"))
    return folds.idle_ends(sessions, joins).select(F.col("code").alias("user_id"), F.col("ended_at_ms").cast("int").alias("ended_at_ms"))


@query("SELECT user_id, max(epoch_us(ts) // 1000) + 1000 <= 1706000000000 AS over FROM events GROUP BY 1")
def ttl_ends(events):
    sessions = events.groupBy("user_id").agg((F.max(F.unix_millis(F.col("ts").cast("timestamp"))) + 1000).alias("expires_at_ms"))
    return folds.ttl_ends(sessions, F.timestamp_millis(F.lit(1_706_000_000_000))).select("user_id", "over")


# Texts, numbers and predicates


@query("""
SELECT page_id, CASE WHEN page_id < 10 THEN '0' || page_id ELSE CAST(page_id AS VARCHAR) END AS two, url AS trimmed, page_id % 2 = 0 AS yes, page_id % 3 < 2 AS flag, CAST(len(string_split(url, '/')) AS INTEGER) AS parts,
       CASE WHEN page_id % 3 = 0 THEN 'application/octet-stream' ELSE 'text/x' END AS mime, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'text/x' END AS kept, substr(url, 1, 8) AS prefix, 'https://h/' || page_id AS share,
       CASE page_id % 4 WHEN 0 THEN 'Live' WHEN 1 THEN 'Connected, waiting for sender...' WHEN 2 THEN 'Error' ELSE 'closed' END AS channel, CASE WHEN page_id % 3 = 0 THEN 'degraded' ELSE 'ok' END AS health
FROM pages
""")
def text_rules(pages):
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    mime = F.when(i % 3 == 0, F.lit("")).otherwise(F.lit("text/x"))
    state = F.element_at(F.array(*map(F.lit, ("open", "idle", "error", "closed"))), (i % 4 + 1).cast("int"))
    return pages.select(
        "page_id",
        strings.pad_two(i).alias("two"),
        strings.js_trim(F.concat(F.lit("\ufeff \t"), "url", F.lit("\u00a0\n"))).alias("trimmed"),
        strings.is_true(i % 2 == 0).alias("yes"),
        strings.is_flag(F.element_at(F.array(*map(F.lit, ("true", "1", "yes"))), (i % 3 + 1).cast("int"))).alias("flag"),
        F.size(strings.split_list(F.replace("url", F.lit("/"), F.lit(" , ")))).alias("parts"),
        strings.mime_or_default(mime).alias("mime"),
        strings.mime_if_null(mime).alias("kept"),
        strings.id_prefix(F.col("url")).alias("prefix"),
        strings.share_url(F.lit("https://h"), s).alias("share"),
        strings.channel_label(state, F.lit("connected")).alias("channel"),
        strings.health_status(F.when(i % 3 == 0, F.lit(-2)).otherwise(F.lit(-1))).alias("health"),
    )


@query("""
SELECT event_id, event_type <> 'error' AS token, event_type = 'click' AS object_id, event_type IN ('click', 'view') AS role, event_type <> 'error' OR event_id % 2 = 0 AS payload, event_id > 100 AS full_, event_id % 4 < 3 AS retry,
       event_id % 2 = 0 AS duplicate, event_id % 3 < 2 AS too_much, event_id % 4 = 0 AS send, event_id % 2 = 1 AS admin, CAST(2 AS INTEGER) AS left_by_key, CAST(2 AS INTEGER) AS left_by_place, event_id * 1000 + 7200000 <= 10000000 AS forgotten
FROM events
""")
def predicate_rules(events):
    i, kind = F.col("event_id"), F.col("event_type")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    items = F.array(*[F.struct(F.lit(k).alias("k")) for k in (1, 2, 3)])
    return events.select(
        "event_id",
        strings.is_token(F.when(kind == "error", F.lit("x")).otherwise(F.md5("props"))).alias("token"),
        strings.is_object_id(F.when(kind == "click", F.substring(F.upper(F.md5("props")), 1, 24)).otherwise(F.md5("props"))).alias("object_id"),
        predicates.is_role(F.when(kind == "click", F.lit("publisher")).when(kind == "view", F.lit("recipient"))).alias("role"),
        predicates.has_payload(F.when(kind == "error", F.lit(" \n")).otherwise(kind), F.when(i % 2 == 0, F.array(F.lit(1)))).alias("payload"),
        predicates.store_full(i, 100).alias("full_"),
        predicates.retryable(pick("MongoNetworkError", "x", "x", "x"), pick("x", "EPIPE", "x", "x"), pick("x", "x", "socket hang up now", "x")).alias("retry"),
        predicates.duplicate_key(F.when(i % 2 == 0, F.lit(11000))).alias("duplicate"),
        predicates.limit_error(pick("LIMIT_FILE_SIZE", "x", "x"), pick("x", "limits exceeded", None)).alias("too_much"),
        predicates.may_send(F.when(i % 2 == 0, F.lit("p")), pick("open", "open", "closed", "closed")).alias("send"),
        predicates.admin_allowed(F.when(i % 2 == 1, F.lit("k")), F.lit("k")).alias("admin"),
        F.size(predicates.remove_key(items, "k", F.lit(2))).alias("left_by_key"),
        F.size(predicates.remove_at(items, F.lit(0))).alias("left_by_place"),
        predicates.past_retention(F.timestamp_millis(i * 1000), F.timestamp_millis(F.lit(10_000_000))).alias("forgotten"),
    )


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 86400000 ELSE least(greatest(event_id * 100000, 60000), 86400000) END AS live_ms, CASE WHEN event_id % 4 = 0 THEN 0 ELSE least(event_id, 10) END AS hours,
       least(greatest(least(event_id, 10) * 3600 + least(event_id, 59) * 60, 60), 36000) AS seconds, greatest(event_id * 1000 - 50000, 0) AS left_ms, event_id * 1000 + 60000 AS later_ms, event_id * 1000 - 5000 AS took_ms,
       CASE WHEN event_id % 7 < 5 THEN CAST(floor(least(1000 * pow(2, event_id % 7), 30000) + f * 500 + 0.5) AS BIGINT) END AS backoff_ms, CASE WHEN event_id % 2 = 0 THEN CAST(floor(f * 1000) AS BIGINT) + 500 ELSE 800 END AS delay_ms
FROM (SELECT *, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296 AS f FROM events)
""")
def number_rules(events):
    i = F.col("event_id")
    at = F.timestamp_millis(i * 1000)
    hours = F.when(i % 4 == 0, F.lit(float("inf"))).otherwise(i.cast("double") + 0.9)
    return events.select(
        "event_id",
        numbers.live_ttl_ms(F.when(i % 3 != 0, i * 100_000)).alias("live_ms"),
        numbers.duration_part(hours, 10).alias("hours"),
        numbers.stored_duration_s(i.cast("double"), i.cast("double")).alias("seconds"),
        numbers.remaining_ms(at, F.timestamp_millis(F.lit(50_000))).alias("left_ms"),
        F.unix_millis(numbers.add_ttl(at, F.lit(60_000))).alias("later_ms"),
        numbers.elapsed_ms(F.timestamp_millis(F.lit(5000)), at).alias("took_ms"),
        numbers.jittered_backoff_ms(i % 7, i).alias("backoff_ms"),
        numbers.response_delay_ms(i % 2 == 0, i).alias("delay_ms"),
    )


@query("SELECT r_regionkey, true AS right_, false AS wrong, false AS broken, true AS code, true AS token, r_name AS text, 16 AS salt, 12 AS iv, 17 + strlen(r_name) - 1 AS rest FROM region")
def secrets(region):
    """Names as passwords and texts: hashed and verified, drawn codes and tokens, an envelope's parts, bytes read as text."""
    hashed = region.select("*", crypto.hash_password("r_name", F.md5("r_name")).alias("h"), crypto.seal(F.col("r_name").cast("binary"), F.lit(b"k" * 32), F.lit(b"s" * 16), F.lit(b"i" * 12)).alias("e"))
    parts = crypto.parts(F.col("e"))
    return hashed.select(
        "r_regionkey",
        crypto.verify_password("r_name", "h").alias("right_"),
        crypto.verify_password(F.lit("no"), "h").alias("wrong"),
        crypto.verify_password("r_name", "r_name").alias("broken"),
        strings.is_code(crypto.random_code("r_regionkey")).alias("code"),
        strings.is_token(crypto.random_token("r_regionkey")).alias("token"),
        crypto.decode_lenient(crypto.open_(F.col("e"), F.lit(b"k" * 32))).alias("text"),
        F.octet_length(parts["salt"]).alias("salt"),
        F.octet_length(parts["iv"]).alias("iv"),
        F.octet_length(parts["ciphertext"]).cast("bigint").alias("rest"),
    )

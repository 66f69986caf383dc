"""Queries of live sessions and receivers, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import receiving, sessions
from .registry import query

#: The first moment of the events, and the milliseconds of a period of six days, in which each code has one session.
T0, PERIOD = 1_704_067_200_000, 518_400_000
HOUR, DAY = 3_600_000, 86_400_000


def _periods(events: DataFrame, groups: int) -> DataFrame:
    """Events of so many groups of users, who use another code in each period."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % groups).alias("g"), F.floor((ms - T0) / PERIOD).alias("p"))
    return rows.withColumn("code", F.lpad((F.col("g") * 100 + F.col("p")).cast("string"), 6, "0"))


def _sessions(rows: DataFrame) -> DataFrame:
    """A session for most codes: from six hours after its period's start on, for five days at most."""
    made = rows.where("(g + p) % 5 <> 0").select("code", (F.lit(T0) + F.col("p") * PERIOD + 6 * HOUR).alias("created_at_ms")).distinct()
    return made.withColumn("expires_at_ms", F.col("created_at_ms") + 5 * DAY)


@query("""
WITH RECURSIVE x AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id % 40 AS g, (epoch_us(ts) // 1000 - 1704067200000) // 518400000 AS p, event_type = 'error' AS leaves, event_id % 2 AS a, event_id % 3 <> 0 AS pw,
    CASE WHEN event_id % 19 = 2 THEN NULL WHEN event_id % 17 = 1 THEN 'admin' WHEN event_id % 11 = 0 THEN 'publisher' ELSE 'recipient' END AS role, event_id % 23 = 3 AS bad FROM events),
y AS (SELECT *, CASE WHEN role = 'publisher' THEN 'p' || event_id % 2 ELSE 'r' || event_id % 6 END AS peer, CASE WHEN (g + p) % 5 <> 0 AND NOT bad THEN 1704067200000 + p * 518400000 + 21600000 END AS made,
    CASE WHEN leaves THEN NULL WHEN role IS NULL THEN 'join requires { code, role }' WHEN role = 'admin' THEN 'role must be publisher or recipient' WHEN bad THEN 'code must be 6 digits' END AS refused,
    row_number() OVER (PARTITION BY g ORDER BY ms, event_id) AS r FROM x),
s AS (SELECT g, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(-1 AS BIGINT) AS p, CAST(NULL AS VARCHAR) AS pub, CAST([] AS VARCHAR[]) AS rec, false AS over, [CAST(0 AS BIGINT), 0] AS n, [CAST(-1 AS BIGINT), -1] AS until, '' AS outcome, CAST(NULL AS VARCHAR) AS answer FROM (SELECT DISTINCT g FROM y)
  UNION ALL
  SELECT g, r, event_id, p, CASE WHEN outcome = 'publisher joined' THEN peer ELSE pub END,
    CASE WHEN outcome IN ('recipient joined', 'recipient ready') AND NOT list_contains(rec, peer) THEN list_append(rec, peer) WHEN (outcome = 'recipient left' OR outcome = 'session ended') AND NOT coalesce(role = 'publisher', false) THEN list_filter(rec, lambda z: z <> peer) ELSE rec END,
    over OR outcome = 'session ended',
    list_transform(n, lambda c, i: CASE WHEN i = a + 1 AND outcome = 'wrong password' THEN c0 + 1 ELSE c END), list_transform(until, lambda u, i: CASE WHEN i = a + 1 AND outcome = 'wrong password' AND c0 = 0 THEN ms + 86400000 ELSE u END), outcome,
    CASE WHEN leaves THEN NULL WHEN refused IS NOT NULL THEN refused ELSE CASE outcome WHEN 'session not found' THEN 'Session not found or expired' WHEN 'locked out' THEN 'Too many failed attempts. Try again in 15 minutes.' WHEN 'wrong password' THEN 'invalid_password'
      WHEN 'publisher refused' THEN 'A publisher is already in this session' WHEN 'session full' THEN 'Session is full — maximum recipients reached' WHEN 'recipient joined' THEN 'Waiting for publisher — please wait' END END
  FROM (SELECT *, CASE WHEN refused IS NOT NULL THEN 'refused' WHEN NOT alive THEN 'session not found' WHEN NOT leaves AND role = 'recipient' AND c0 >= 2 THEN 'locked out' WHEN NOT leaves AND role = 'recipient' AND NOT pw THEN 'wrong password'
        WHEN NOT leaves AND role = 'publisher' THEN CASE WHEN pub IS NULL THEN 'publisher joined' ELSE 'publisher refused' END
        WHEN NOT leaves THEN CASE WHEN len(rec) >= 3 THEN 'session full' WHEN pub IS NULL THEN 'recipient joined' ELSE 'recipient ready' END
        WHEN role = 'publisher' THEN CASE WHEN peer = pub THEN 'session ended' ELSE 'ignored' END
        WHEN NOT list_contains(rec, peer) THEN 'ignored' WHEN pub IS NULL AND len(rec) = 1 THEN 'session ended' ELSE 'recipient left' END AS outcome
    FROM (SELECT *, coalesce(made IS NOT NULL AND ms >= made AND ms < made + 432000000 AND NOT over AND NOT (pub IS NULL AND ms >= made + 86400000), false) AS alive
      FROM (SELECT y.* EXCLUDE (p), y.p, CASE WHEN y.p = s.p THEN s.pub END AS pub, CASE WHEN y.p = s.p THEN s.rec ELSE [] END AS rec, y.p = s.p AND s.over AS over, s.n, s.until,
              CASE WHEN y.ms > s.until[y.a + 1] THEN 0 ELSE s.n[y.a + 1] END AS c0 FROM s JOIN y ON y.g = s.g AND y.r = s.r + 1))))
SELECT event_id, outcome, answer FROM s WHERE r > 0
""")
def join_answers(events):
    """Events as joins, errors as leaves; even and odd events of a group of users come from two addresses."""
    k = lambda n: F.col("event_id") % n
    rows = _periods(events, 40)
    role = F.when(k(19) == 2, F.lit(None)).when(k(17) == 1, F.lit("admin")).when(k(11) == 0, F.lit("publisher")).otherwise(F.lit("recipient"))
    asked = rows.select(
        "event_id",
        "ts",
        F.when(k(23) == 3, F.lit("x1")).otherwise(F.col("code")).alias("code"),
        role.alias("role"),
        F.concat_ws("-", "g", k(2)).alias("ip"),
        F.when(role == "publisher", F.concat(F.lit("p"), k(2))).otherwise(F.concat(F.lit("r"), k(6))).alias("peer"),
        F.when(F.col("event_type") == "error", F.lit("leave")).otherwise(F.lit("join")).alias("kind"),
        (k(3) != 0).alias("password_ok"),
    )
    told = sessions.join_answers(asked, _sessions(rows), order=["event_id"], most=3, idle_ms=DAY, failures=2, length_ms=DAY)
    return told.select("event_id", "outcome", "answer")


@query("""
WITH RECURSIVE x AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id % 60 AS g, (epoch_us(ts) // 1000 - 1704067200000) // 518400000 AS p, event_type = 'error' AS leaves, event_id % 7 = 0 AS publishes FROM events),
y AS (SELECT *, g * 100 + p AS k, CASE WHEN publishes THEN 'p' || event_id % 2 ELSE 'r' || event_id % 6 END AS peer, 1704067200000 + p * 518400000 + 21600000 AS made, row_number() OVER (PARTITION BY g, p ORDER BY ms, event_id) AS r FROM x WHERE (g + p) % 5 <> 0),
s AS (SELECT k, any_value(made) AS made, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS ms, CAST(NULL AS VARCHAR) AS pub, CAST([] AS VARCHAR[]) AS rec, false AS over, CAST([] AS STRUCT(t VARCHAR, y VARCHAR, i VARCHAR)[]) AS sent, CAST([] AS VARCHAR[]) AS gone, CAST(NULL AS BIGINT) AS gone_at FROM y GROUP BY k
  UNION ALL
  SELECT k, made, r, event_id, ms, CASE WHEN outcome = 'publisher joined' THEN peer ELSE pub END,
    CASE WHEN outcome = 'joined' AND NOT list_contains(rec, peer) THEN list_append(rec, peer) WHEN outcome = 'left' THEN list_filter(rec, lambda z: z <> peer) ELSE rec END,
    over OR due OR outcome = 'ended' OR (outcome = 'left' AND pub IS NULL AND len(rec) = 1),
    CASE WHEN outcome = 'publisher joined' THEN flatten(list_transform(rec, lambda z: [{'t': peer, 'y': 'ready', 'i': z}, {'t': z, 'y': 'ready', 'i': z}])) WHEN outcome = 'joined' AND pub IS NOT NULL THEN [{'t': pub, 'y': 'ready', 'i': peer}, {'t': peer, 'y': 'ready', 'i': peer}]
         WHEN outcome = 'ended' THEN list_transform(rec, lambda z: {'t': z, 'y': 'peer_left', 'i': CAST(NULL AS VARCHAR)}) WHEN outcome = 'left' AND pub IS NOT NULL THEN [{'t': pub, 'y': 'peer_left', 'i': peer}] ELSE [] END,
    CASE WHEN due THEN CASE WHEN pub IS NULL THEN rec ELSE list_prepend(pub, rec) END ELSE [] END, CASE WHEN due THEN ends END
  FROM (SELECT *, CASE WHEN over OR due OR ms < made THEN 'none' WHEN NOT leaves AND publishes THEN CASE WHEN pub IS NULL THEN 'publisher joined' ELSE 'none' END WHEN NOT leaves THEN CASE WHEN len(rec) >= 4 THEN 'none' ELSE 'joined' END
        WHEN publishes THEN CASE WHEN peer = pub THEN 'ended' ELSE 'none' END WHEN list_contains(rec, peer) THEN 'left' ELSE 'none' END AS outcome
    FROM (SELECT *, NOT over AND ms >= ends AS due
      FROM (SELECT y.k, s.made, y.r, y.event_id, y.ms, y.leaves, y.publishes, y.peer, s.pub, s.rec, s.over, CASE WHEN s.pub IS NULL THEN s.made + 86400000 ELSE s.made + 432000000 END AS ends FROM s JOIN y ON y.k = s.k AND y.r = s.r + 1)))),
l AS (SELECT k, CASE WHEN pub IS NULL THEN rec ELSE list_prepend(pub, rec) END AS peers, CASE WHEN pub IS NULL THEN made + 86400000 ELSE made + 432000000 END AS ends FROM s WHERE r > 0 AND NOT over QUALIFY row_number() OVER (PARTITION BY k ORDER BY r DESC) = 1 AND r = (SELECT max(r) FROM y WHERE y.k = s.k)),
m AS (SELECT k, event_id, ms AS at_ms, unnest(range(len(sent))) AS n, unnest(sent) AS z FROM s
  UNION ALL SELECT k, NULL, gone_at, unnest(range(len(gone))), unnest(list_transform(gone, lambda x: {'t': x, 'y': 'expired', 'i': CAST(NULL AS VARCHAR)})) FROM s
  UNION ALL SELECT k, NULL, ends, unnest(range(len(peers))), unnest(list_transform(peers, lambda x: {'t': x, 'y': 'expired', 'i': CAST(NULL AS VARCHAR)})) FROM l WHERE ends <= 1706000000000)
SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS code, event_id, at_ms, n, z.t AS "to", z.y AS type, z.i AS peer_id FROM m
""")
def session_messages(events):
    """Events as joins, errors as leaves; timers run until 23 January."""
    k = lambda n: F.col("event_id") % n
    rows = _periods(events, 60)
    kind = F.when(F.col("event_type") == "error", F.lit("leave")).otherwise(F.lit("join"))
    role = F.when(k(7) == 0, F.lit("publisher")).otherwise(F.lit("recipient"))
    peer = F.when(k(7) == 0, F.concat(F.lit("p"), k(2))).otherwise(F.concat(F.lit("r"), k(6)))
    heard = rows.select("event_id", "ts", "code", kind.alias("kind"), role.alias("role"), peer.alias("peer"))
    return sessions.session_messages(heard, _sessions(rows), order=["event_id"], most=4, idle_ms=DAY, until=F.timestamp_millis(F.lit(1_706_000_000_000)))


@query("""
WITH RECURSIVE x AS (SELECT event_id, user_id AS k, epoch_us(ts) // 1000 AS ms, event_id % 4 AS q, CASE event_type WHEN 'signup' THEN 's' WHEN 'error' THEN 'e' ELSE 'b' END AS t, event_id % 50 AS b FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ms, event_id) AS r,
    CASE WHEN t = 'b' THEN 'chunk' WHEN t = 's' AND q < 2 THEN 'meta' WHEN t = 's' AND q = 2 THEN 'done' WHEN t = 'e' AND event_id % 3 = 0 THEN 'abort' ELSE 'noise' END AS what, [event_id % 5 * 12, 0, event_id % 3 * 40] AS sizes, event_id % 6 AS total FROM x),
s AS (SELECT k, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS number, false AS on_, CAST([] AS BIGINT[]) AS sizes, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS chunks, CAST(1 AS BIGINT) AS file, CAST([] AS BIGINT[]) AS got, CAST(0 AS BIGINT) AS last,
    CAST(NULL AS VARCHAR) AS how, CAST(0 AS BIGINT) AS how_n, CAST(0 AS BIGINT) AS how_c, CAST(0 AS BIGINT) AS how_t, CAST([] AS BIGINT[]) AS how_b FROM (SELECT DISTINCT k FROM m)
  UNION ALL
  SELECT k, r, number + CASE WHEN what = 'meta' THEN 1 ELSE 0 END, CASE WHEN what = 'meta' THEN true WHEN late OR what IN ('done', 'abort') THEN false ELSE on_ END, CASE WHEN what = 'meta' THEN new ELSE sizes END, CASE WHEN what = 'meta' THEN new_total ELSE total END,
    CASE WHEN what = 'meta' THEN 0 WHEN takes THEN chunks + 1 ELSE chunks END, CASE WHEN what = 'meta' THEN 1 WHEN takes AND got[file] + b >= sizes[file] THEN file + 1 ELSE file END,
    CASE WHEN what = 'meta' THEN [0, 0, 0] WHEN takes THEN list_transform(got, lambda g, i: CASE WHEN i = file THEN g + b ELSE g END) ELSE got END, CASE WHEN what = 'meta' OR takes THEN ms ELSE last END,
    CASE WHEN late THEN 'timed out' WHEN on_ AND what = 'meta' THEN 'replaced' WHEN on_ AND what = 'done' THEN 'completed' WHEN on_ AND what = 'abort' THEN 'aborted' END, number - 1, chunks, total, got
  FROM (SELECT *, on_ AND NOT late AND what = 'chunk' AND file <= len(sizes) AS takes
    FROM (SELECT s.* EXCLUDE (r, k), m.k, m.r, m.ms, m.what, m.b, m.sizes AS new, m.total AS new_total, s.on_ AND m.ms - s.last > 72000000 AND s.chunks < s.total AS late FROM s JOIN m ON m.k = s.k AND m.r = s.r + 1))),
z AS (SELECT how, k, how_n AS number, how_c AS c, how_t AS t, how_b AS b FROM s WHERE how IS NOT NULL
  UNION ALL SELECT CASE WHEN chunks >= total THEN 'stalled' WHEN 1706659200000 - last > 72000000 THEN 'timed out' ELSE 'open' END, k, number - 1, chunks, total, got FROM s WHERE on_ AND r = (SELECT max(r) FROM m WHERE m.k = s.k))
SELECT k AS user_id, number, how AS state, c AS chunks_done, t AS chunks_total, c = t AS count_matches, b[1] AS first, b[2] AS second, b[3] AS third FROM z
""")
def receive_lists(events):
    """Users as transfers of several lists of three files, the second empty: signups are lists, ends and lists that are none,
    errors aborts and noise, all else chunks. A silence of 20 hours ends a list that lacks chunks."""
    e = F.col("event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    size = lambda n: F.concat(F.lit('{"size":'), n.cast("string"), F.lit("}"))
    meta = F.concat(F.lit('{"type":"meta","files":['), F.concat_ws(",", size(e % 5 * 12), size(F.lit(0)), size(e % 3 * 40)), F.lit('],"totalChunks":'), (e % 6).cast("string"), F.lit("}"))
    broken = F.when(e % 8 == 3, F.lit('{"type":"meta","files":[1],"totalChunks":1}')).otherwise(F.lit('{"type":"meta","files":[{"size":"x"}],"totalChunks":1}'))
    signup = F.when(e % 4 < 2, meta).when(e % 4 == 2, F.lit('{"type":"done"}')).otherwise(broken)
    text = F.when(F.col("event_type") == "signup", signup).when(e % 3 == 0, F.lit('{"type":"abort"}')).otherwise(F.lit("no json"))
    kind = F.when(F.col("event_type").isin("signup", "error"), F.lit("json")).otherwise(F.lit("binary"))
    rows = events.select("user_id", ((ms - T0) * 100_000 + e % 100_000).alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.when(kind == "json", text).alias("json"), (e % 50).alias("byte_len"))
    told = receiving.receive(rows, key="user_id", at="ts", gap_ms=20 * HOUR, until=F.timestamp_millis(F.lit(1_706_659_200_000)))
    return told.select("user_id", "number", "state", "chunks_done", "chunks_total", "count_matches", *[F.col("file_bytes")[i].alias(n) for i, n in enumerate(("first", "second", "third"))])

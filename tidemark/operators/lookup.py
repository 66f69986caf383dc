"""Keyed lookups and routing between stored and live sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import active
from ..functions.strings import is_code, is_object_id, is_token


def find_session(stored: DataFrame, code: str, as_of: Column | None = None) -> DataFrame:
    """At most one row; with a moment only if it isn't expired then."""
    hit = stored.where(F.col("code") == code)
    return (hit if as_of is None else hit.where(active(F.col("expires_at"), as_of))).limit(1)


def find_by_file(stored: DataFrame, file_id: Column, token: Column, as_of: Column) -> DataFrame:
    """Sessions with such a file id and such a token; the two may be of different files."""
    has_id = F.exists("files", lambda f: f["gridfsId"] == file_id)
    has_token = F.exists("files", lambda f: f["token"] == token)
    return stored.where(has_id & has_token & active(F.col("expires_at"), as_of))


def public_view(stored: DataFrame) -> DataFrame:
    return stored.drop("password")


def retrieved(stored: DataFrame) -> DataFrame:
    """What a retrieval answers: files with their ids renamed, in their order, and the expiry in milliseconds."""
    file = lambda f: F.struct(f["name"].alias("name"), f["mimeType"].alias("mimeType"), f["size"].alias("size"), f["gridfsId"].cast("string").alias("fileId"), f["token"].alias("token"))
    return stored.select("code", F.lit("stored").alias("mode"), "text", F.unix_millis("expires_at").alias("expiresAt"), F.transform("files", file).alias("files"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def resolve(requests: DataFrame, stored: DataFrame, live: DataFrame) -> DataFrame:
    """``mode`` of each requested code: stored first, then live, else not found."""
    s, v = stored.select("code", F.lit(True).alias("_stored")), live.select("code", F.lit(True).alias("_live"))
    joined = requests.join(s, "code", "left").join(v, "code", "left")
    mode = F.when(F.col("_stored"), F.lit("stored")).when(F.col("_live"), F.lit("live_session")).otherwise(F.lit("not_found"))
    return joined.withColumn("mode", mode).drop("_stored", "_live")


def free_codes(candidates: DataFrame, stored: DataFrame, live: DataFrame) -> DataFrame:
    return candidates.join(stored.select("code").unionByName(live.select("code")), "code", "left_anti")


def retrieve_outcome(requests: DataFrame, stored: DataFrame, live: DataFrame, as_of: Column, *, store_enabled: bool = True) -> DataFrame:
    """``status`` and ``error`` of requests (code, password_ok), with the guards in their order.

    A wrong password on an expired session is refused for the password.
    """
    s = stored.select("code", F.lit(True).alias("_stored"), F.col("password").isNotNull().alias("_locked"), (F.col("expires_at") <= as_of).alias("_expired"))
    s = s.where(F.lit(store_enabled))
    joined = requests.join(s, "code", "left").join(live.select("code", F.lit(True).alias("_live")), "code", "left")
    steps = [
        (~is_code(F.col("code")), 400, F.lit("Invalid code format")),
        (F.col("_stored").isNull(), 404, F.when(F.col("_live"), F.lit("live_session")).otherwise(F.lit("not_found"))),
        (F.col("_locked") & ~F.coalesce("password_ok", F.lit(False)), 401, F.lit("password_required")),
        (F.col("_expired"), 410, F.lit("expired")),
    ]
    return _answered(joined, steps)


def file_outcome(requests: DataFrame, stored: DataFrame, as_of: Column, *, store_enabled: bool = True) -> DataFrame:
    """``status`` and ``error`` of requests (file_id, token, password_ok) for a blob; one answer for all that isn't found.

    A session has a file id and a token wherever among its files they are, so both are joined by session.
    """
    files = stored.where(active(F.col("expires_at"), as_of)).select("code", F.col("password").isNotNull().alias("_locked"), F.explode("files").alias("f"))
    ids = files.select("code", "_locked", F.col("f.gridfsId").alias("file_id")).distinct()
    tokens = files.select("code", F.col("f.token").alias("token")).distinct()
    found = ids.join(tokens, "code").groupBy("file_id", "token").agg(F.min_by("_locked", "code").alias("_locked"))
    joined = requests.join(found, ["file_id", "token"], "left")
    steps = [
        (F.lit(not store_enabled), 503, F.lit("stored_mode_disabled")),
        (~is_token(F.col("token")), 400, F.lit("Invalid token format")),
        (~is_object_id(F.col("file_id")), 400, F.lit("Invalid fileId")),
        (F.col("_locked").isNull(), 404, F.lit("File not found or session expired")),
        (F.col("_locked") & ~F.coalesce("password_ok", F.lit(False)), 401, F.lit("forbidden")),
    ]
    return _answered(joined, steps)


def _answered(rows: DataFrame, steps: list[tuple[Column, int, Column]]) -> DataFrame:
    status = error = None
    for test, code, text in steps:
        test = F.coalesce(test, F.lit(False))
        status = F.when(test, F.lit(code)) if status is None else status.when(test, F.lit(code))
        error = F.when(test, text) if error is None else error.when(test, text)
    out = rows.withColumn("status", status.otherwise(F.lit(200))).withColumn("error", error)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def publish_outcome(requests: DataFrame, *, limit: int, full: Column, enabled: bool = True, update: bool = False) -> DataFrame:
    """``status`` and ``error`` of publications (password, text, files) or updates, which need no password."""
    from ..functions.predicates import has_payload
    from ..functions.strings import posted_text

    text = F.coalesce("text", F.lit("")) if update else posted_text(F.col("text"))
    total = F.octet_length(text) + F.aggregate(F.coalesce("files", F.expr("array()").cast(requests.schema["files"].dataType)), F.lit(0).cast("bigint"), lambda a, f: a + f["size"])
    steps = [
        (F.lit(not enabled), 503, F.lit("stored_mode_disabled")),
        (F.lit(False) if update else (F.length(F.trim(F.coalesce("password", F.lit("")))) == 0), 400, F.lit("Password is required")),
        (total > limit, 400, F.lit("Payload exceeds the limit")),
        (full, 503, F.lit("storage_full")),
        (~has_payload(text, F.col("files")), 400, F.lit("Nothing to publish")),
    ]
    return _answered(requests, steps)


def retrieve_action(status: Column, error: Column) -> Column:
    """What a client does with an answer."""
    return (
        F.when(status == 200, F.lit("show"))
        .when(status == 401, F.lit("ask_password"))
        .when(status == 410, F.lit("expired"))
        .when((status == 404) & (error == "live_session"), F.lit("join_live"))
        .when(status == 404, F.lit("not_found"))
        .otherwise(F.lit("failed"))
    )


def ready_pairs(sessions: DataFrame) -> DataFrame:
    """The two messages for each waiting recipient once a publisher is there, of live sessions."""
    pairs = sessions.where("publisher IS NOT NULL").select("code", F.explode("recipients").alias("r"))
    to = F.explode(F.array(F.lit("publisher"), F.col("r.id").cast("string"))).alias("to")
    return pairs.select("code", to, F.lit("ready").alias("type"), F.col("r.id").alias("peerId"))


def suppress_duplicates(chosen: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen rows and those of a selection that aren't among them; repeats within a selection stay."""
    return chosen.unionByName(selection.join(chosen.select(*keys), keys, "left_anti").select(*chosen.columns))


def attach(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the new values of a key where there is an update for it; a new value may be null."""
    renamed = updates.select(key, F.struct(*columns).alias("_new"))
    joined = rows.join(renamed, key, "left")
    new = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[new(c) if c in columns else F.col(c) for c in rows.columns])


def peers(connections: DataFrame, asked: DataFrame) -> DataFrame:
    """The connection (peer_id, ...) of each peer asked for; peers without one are left out."""
    return asked.join(connections, "peer_id")


def route_frames(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """``target``, ``peer_id`` and ``error`` of relayed frames (code, role, sender, peer_id) over live sessions."""
    who = sessions.select("code", F.lit(True).alias("_there"), F.col("publisher").isNotNull().alias("_publisher"), F.col("recipients.id").alias("_ids"))
    joined = frames.join(who, "code", "left")
    publisher = F.col("role") == "publisher"
    error = (
        F.when(F.col("_there").isNull(), F.lit("Session not found"))
        .when(publisher & F.col("peer_id").isNull(), F.lit("peerId required from publisher"))
        .when(publisher & ~F.coalesce(F.array_contains("_ids", F.col("peer_id")), F.lit(False)), F.lit("Recipient not found"))
        .when(~publisher & ~F.col("_publisher"), F.lit("Publisher not connected"))
    )
    out = joined.withColumn("error", error)
    out = out.withColumn("target", F.when(F.col("error").isNull(), F.when(publisher, F.col("peer_id").cast("string")).otherwise(F.lit("publisher"))))
    return out.withColumn("peer_id", F.when(publisher, F.col("peer_id")).otherwise(F.col("sender"))).drop("_there", "_publisher", "_ids")


def ice_servers(static: DataFrame, fetched: DataFrame) -> DataFrame:
    """The static list, then what was fetched; a failed fetch is an empty table."""
    return static.unionAll(fetched.select(*static.columns))


def server_urls(urls: Column) -> Column:
    """A text or a list of texts, as a list; ``urls`` is a VARIANT."""
    return F.coalesce(F.try_variant_get(urls, "$", "array<string>"), F.array(F.try_variant_get(urls, "$", "string")))


def rewrite_files(sessions: DataFrame, field: str, make) -> DataFrame:
    """Sessions whose files have one field made anew from its old value, and the others as they were."""
    return sessions.withColumn("files", F.transform("files", lambda f: f.withField(field, make(f[field]))))


def live_counts(sessions: DataFrame) -> DataFrame:
    """Recipients of each live session, and whether its publisher is there."""
    return sessions.select("code", F.col("publisher").isNotNull().alias("has_publisher"), F.coalesce(F.size("recipients"), F.lit(0)).alias("n_recipients"))

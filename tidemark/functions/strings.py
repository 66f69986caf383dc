"""Text: trimming, codes, names, URLs and labels. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that ECMAScript trims, as a Java pattern.
_SPACE = r"[\s\x{FEFF}]"


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def is_code(x: Column) -> Column:
    """Six digits and nothing else, a final line end included."""
    return x.rlike(r"^[0-9]{6}\z")


def is_token(x: Column) -> Column:
    return x.rlike(r"^[0-9a-f]{32}\z")


def is_object_id(x: Column) -> Column:
    return x.rlike(r"^[0-9a-fA-F]{24}\z")


def pad_code(n: Column) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def pad_two(n: Column) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))


def digits_only(x: Column, most: int = 6) -> Column:
    return F.substring(F.regexp_replace(x, "[^0-9]", ""), 1, most)


def sanitise_filename(name: Column, most: int = 255) -> Column:
    """The last path part without NUL and double dots, trimmed and cut; ``file`` if nothing is left."""
    base = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.replace(F.replace(base, F.lit("\0"), F.lit("")), F.lit(".."), F.lit(""))
    return F.coalesce(F.nullif(F.substring(js_trim(clean), 1, most), F.lit("")), F.lit("file"))


def strip_scripts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)<script\b[^>]*>([\s\S]*?)</script>", "")


def posted_text(text: Column) -> Column:
    """The text of a first publication; an update keeps its text as sent."""
    return js_trim(strip_scripts(F.coalesce(text, F.lit(""))))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def is_true(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("")) == "true"


def is_flag(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).isin("true", "1")


def split_list(x: Column) -> Column:
    """The trimmed parts between commas; a missing variable is an empty list."""
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.split(x, ","), js_trim))


def encode_component(x: Column) -> Column:
    """Percent-encoding as for a URI component."""
    out = F.url_encode(x)
    for encoded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def socket_url(url: Column) -> Column:
    return F.when(url.startswith("https"), F.regexp_replace(url, "^https", "wss")).otherwise(F.regexp_replace(url, "^http", "ws"))


def share_url(origin: Column, code: Column) -> Column:
    return F.concat(origin, F.lit("/"), code)


def code_of_path(url: Column) -> Column:
    """The code that a page's path consists of; empty if it is none."""
    return F.regexp_extract(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), r"^/?([0-9]{6})\z", 1)


def id_prefix(x: Column, n: int = 8) -> Column:
    return F.substring(x, 1, n)


def _labelled(state: Column, labels: dict[str, str]) -> Column:
    out = None
    for key, label in labels.items():
        out = F.when(state == key, F.lit(label)) if out is None else out.when(state == key, F.lit(label))
    return out


#: Shown for states.
_SIGNAL = {"connected": "Connected", "disconnected": "Disconnected", "lost": "Session Lost", "offline": "Offline", "expired": "Expired"}
_CHANNEL = {"open": "Live", "connecting": "Connecting...", "error": "Error"}


def signal_label(state: Column) -> Column:
    return _labelled(state, _SIGNAL).when(state.startswith("reconnecting"), F.lit("Reconnecting...")).otherwise(state)


def signal_color(state: Column) -> Column:
    failing = state.isin("failed", "lost", "expired")
    waiting = state.startswith("reconnecting") | (state == "offline")
    return F.when(failing, F.lit("error")).when(waiting, F.lit("warning")).when(state == "connected", F.lit("success")).otherwise(F.lit("dim"))


def channel_label(channel: Column, signal: Column) -> Column:
    idle = F.when(signal == "connected", F.lit("Connected, waiting for sender...")).otherwise(F.lit("Waiting..."))
    return _labelled(channel, _CHANNEL).when(channel == "idle", idle).otherwise(channel)


def health_status(ping_ms: Column) -> Column:
    """-2 is a failed ping; -1, not known, still counts as well."""
    return F.when(ping_ms == -2, F.lit("degraded")).otherwise(F.lit("ok"))


def mime_or_default(mime: Column, default: str = "application/octet-stream") -> Column:
    """Empty counts as missing."""
    return F.coalesce(F.nullif(mime, F.lit("")), F.lit(default))


def mime_if_null(mime: Column, default: str = "application/octet-stream") -> Column:
    """Empty is kept."""
    return F.coalesce(mime, F.lit(default))


def base64_plain(b: Column) -> Column:
    """Base 64 on one line."""
    return F.regexp_replace(F.base64(b), r"[\r\n]", "")

"""Bodies of multipart/form-data requests as rows of parts.

A body is binary. It is taken as text of one character a byte, so that it can be cut with patterns where its boundary lies;
parts are turned back into bytes. A boundary counts at the beginning of a line and with nothing but spaces after it, so the
same characters elsewhere belong to the part they are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..limits import LIMITS
from .readers import upload_errors

BYTES = "ISO-8859-1"


def boundary_of(content_type: Column) -> Column:
    """The boundary that a request's content type names; null if it is no multipart/form-data."""
    named = F.regexp_extract(content_type, r"(?i)^\s*multipart/form-data\s*;(?:.*;)?\s*boundary=(?:\"([^\"]+)\"|([^;\s\"]+))", 1)
    bare = F.regexp_extract(content_type, r"(?i)^\s*multipart/form-data\s*;(?:.*;)?\s*boundary=(?:\"([^\"]+)\"|([^;\s\"]+))", 2)
    found = F.concat(named, bare)
    return F.when(found != "", found)


def _quoted(boundary: Column) -> Column:
    """The boundary as a pattern; a boundary holds no backslash."""
    return F.concat(F.lit(r"\Q"), boundary, F.lit(r"\E"))


def _parameter(headers: Column, name: str) -> Column:
    """A parameter of the content disposition, as UTF-8 text; null if it isn't there."""
    line = F.regexp_extract(headers, r"(?im)^content-disposition:([^\r\n]*)", 1)
    pattern = rf'(?i);\s*{name}="((?:[^"\\]|\\.)*)"'
    value = F.regexp_replace(F.regexp_extract(line, pattern, 1), r"\\(.)", "$1")
    return F.when(F.regexp_like(line, F.lit(pattern)), F.decode(F.encode(value, BYTES), "UTF-8"))


def parts(requests: DataFrame, *, key: str = "request_id", body: str = "body", content_type: str = "content_type") -> DataFrame:
    """A row for each part of requests (key, body, content type): ``at`` (its place), ``kind`` (file if it has a file name, else
    field), ``name``, ``filename``, ``mimeType`` (text/plain unless said otherwise), ``length`` and ``data``.

    What precedes the first boundary and what follows the last is no part, nor is one without a name. Requests of another
    type, with a null body or without any boundary have none.
    """
    asked = requests.select(F.col(key).alias("_key"), boundary_of(F.col(content_type)).alias("_b"), F.col(body).cast("binary").alias("_body")).where("_b IS NOT NULL AND _body IS NOT NULL")
    text = F.concat(F.lit("\r\n"), F.decode("_body", BYTES))
    until = F.split(text, F.concat(F.lit(r"\r\n--"), _quoted(F.col("_b")), F.lit(r"--[ \t]*(?:\r\n|\z)")), 2)[0]
    cut = F.split(until, F.concat(F.lit(r"\r\n--"), _quoted(F.col("_b")), F.lit(r"[ \t]*(?=\r\n)")), -1)
    rows = asked.select("_key", F.posexplode(cut).alias("at", "_part")).where("at > 0")
    # A part begins at the line end after its boundary; headers end at the first empty line.
    end = F.instr(F.col("_part"), "\r\n\r\n")
    rows = rows.where(end > 0).select("_key", (F.col("at") - 1).alias("at"), F.substring(F.col("_part"), F.lit(1), end - 1).alias("_headers"), F.encode(F.substring(F.col("_part"), end + 4, F.length("_part")), BYTES).alias("data"))
    said = rows.select("_key", "at", _parameter(F.col("_headers"), "name").alias("name"), _parameter(F.col("_headers"), "filename").alias("filename"), F.trim(F.regexp_extract("_headers", r"(?im)^content-type:([^\r\n]*)", 1)).alias("_type"), "data")
    kind = F.when(F.col("filename").isNotNull(), F.lit("file")).otherwise(F.lit("field"))
    mime = F.when(F.col("_type") != "", F.col("_type")).otherwise(F.lit("text/plain"))
    return said.where("name IS NOT NULL").select(F.col("_key").alias(key), "at", kind.alias("kind"), "name", "filename", mime.alias("mimeType"), F.octet_length("data").cast("long").alias("length"), "data")


def complete(body: Column, content_type: Column) -> Column:
    """Whether a body has the boundary that ends it."""
    text = F.concat(F.lit("\r\n"), F.decode(body.cast("binary"), BYTES))
    return F.coalesce(F.regexp_like(text, F.concat(F.lit(r"\r\n--"), _quoted(boundary_of(content_type)), F.lit(r"--[ \t]*(?:\r\n|\z)"))), F.lit(False))


def outcomes(requests: DataFrame, *, key: str = "request_id", body: str = "body", content_type: str = "content_type", files: int = LIMITS.upload_files, file_bytes: int = LIMITS.stored_payload_bytes, field_bytes: int = LIMITS.field_bytes) -> DataFrame:
    """``error`` of each request, one row a key: the first limit that a part breaks, ``Unexpected end of form`` for a body
    without its end, ``Not multipart`` for another type, or null."""
    # Parts go on without their bytes.
    broken = upload_errors(parts(requests, key=key, body=body, content_type=content_type).drop("data"), key, files=files, file_bytes=file_bytes, field_bytes=field_bytes)
    kind = boundary_of(F.col(content_type)).isNull()
    whole = requests.groupBy(key).agg(F.max(kind).alias("_other"), F.min(complete(F.col(body), F.col(content_type))).alias("_whole"))
    error = F.when(F.col("_other"), F.lit("Not multipart")).otherwise(F.coalesce("error", F.when(~F.col("_whole"), F.lit("Unexpected end of form"))))
    return whole.join(broken, key, "left").select(key, error.alias("error"))

"""Scalar functions on resources, timestamps, codes and lines, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ENDPOINT_LIMIT, EPOCH_1601_US, RESOURCE_HEAD, RESOURCE_LIMIT, RESOURCE_TAIL

#: Operation names by code.
VERBS = (
    "UNKNOWN", "GET", "POST", "PUT", "PATCH", "HEAD", "OPTIONS", "TRACE", "DELETE", "CONNECT", "PRI", "ACL", "COPY", "LOCK", "LINK", "MOVE",
    "BIND", "MERGE", "MKCOL", "LABEL", "REPORT", "SEARCH", "UNBIND", "UNLINK", "UNLOCK", "UPDATE", "CHECKIN", "PROPFIND", "CHECKOUT", "PROPPATCH",
    "MKACTIVITY", "MKCALENDAR", "ORDERPATCH", "UNCHECKOUT", "MKWORKSPACE", "MKREDIRECTREF", "VERSION-CONTROL", "BASELINE-CONTROL", "UPDATE-REDIRECT-REF",
)


def _bytes(c: Column, start: Column | int, length: Column | int) -> Column:
    """Bytes of a string; a character that the cut splits becomes U+FFFD."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.make_valid_utf8(F.substring(c.cast("binary"), lit(start), lit(length)).cast("string"))


def strip_params(resource: Column) -> Column:
    """Cuts what follows the first ``?``, which stays."""
    return F.regexp_replace(resource, r"(?s)\?.*$", "?")


def truncate_middle(resource: Column, unit: str = "byte") -> Column:
    """From 563 bytes on: the first 80, three dots, the last 479.  ``unit="char"`` cuts characters, not bytes."""
    if unit == "char":
        cut = F.concat(F.substring(resource, 1, RESOURCE_HEAD), F.lit("..."), F.right(resource, F.lit(RESOURCE_TAIL)))
    else:
        cut = F.concat(
            _bytes(resource, 1, RESOURCE_HEAD), F.lit("..."),
            _bytes(resource, F.octet_length(resource) - (RESOURCE_TAIL - 1), RESOURCE_TAIL),
        )
    return F.when(F.octet_length(resource) < RESOURCE_LIMIT, resource).otherwise(cut)


def null_resource(resource: Column) -> Column:
    return F.coalesce(F.nullif(resource, F.lit("")), F.lit("NULL"))


def clip_endpoint(endpoint: Column) -> Column:
    """The first 79 bytes; null is empty."""
    return F.coalesce(F.when(F.octet_length(endpoint) <= ENDPOINT_LIMIT, endpoint).otherwise(_bytes(endpoint, 1, ENDPOINT_LIMIT)), F.lit(""))


def normalize_resource(resource: Column, strip: bool = True, unit: str = "byte") -> Column:
    return truncate_middle(null_resource(strip_params(resource) if strip else resource), unit)


def narrow_u16(code: Column) -> Column:
    return F.pmod(code, F.lit(65536)).cast("int")


def format_ts(us: Column, epoch: str = "1601") -> Column:
    """ISO 8601 in UTC, whatever the session's time zone; before 1970 the text ``NULL``."""
    unix = us - F.lit(EPOCH_1601_US) if epoch == "1601" else us
    rest = F.pmod(unix, F.lit(86_400_000_000))
    day = F.round((unix - rest) / F.lit(86_400_000_000))  # a whole number of days
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    part = lambda unit, size: pad(F.floor(F.pmod(F.floor(rest / F.lit(unit)), F.lit(size))), 2)
    text = F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), part(3_600_000_000, 24), F.lit(":"),
        part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), F.lit("."), pad(F.pmod(rest, F.lit(1_000_000)), 6), F.lit("Z"),
    )
    return F.when(unix < 0, F.lit("NULL")).otherwise(text)


def verb_name(code: Column) -> Column:
    """The operation's name; its number where it has none."""
    names = F.array(*[F.lit(v) for v in VERBS])
    return F.coalesce(F.get(names, code.cast("int")), code.cast("string"))


def format_line(sequence: Column, ts: Column, resource: Column, endpoint: Column, code: Column, verb: Column, duration: Column, size: Column, flags: Column) -> Column:
    field = lambda c, end="]": F.concat(F.lit("["), c.cast("string"), F.lit(end))
    return F.concat_ws(
        " ", field(sequence), field(ts), field(resource), field(endpoint), field(code), field(verb), field(duration, "ms]"), field(size, "b]"), field(flags)
    )


def dotted_quad(ip: Column) -> Column:
    """A 32-bit number as four octets, the highest first."""
    return F.concat_ws(".", *[F.shiftright(ip.cast("bigint"), s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])

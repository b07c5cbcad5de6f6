"""Per-format parsers, each a struct-valued column expression over tokens.

A parser yields NULL when the reference would have dropped the line (D5); the
reject reason is a separate column (S11). Positions are zero-based token indexes.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.counts import MAX_LONG, byte_difference
from ..functions.ip import looks_like_ip
from ..functions.times import parse_epoch, parse_local_time
from ..functions.urls import request_page, request_query, url_host, url_path
from .tokens import token, with_shell_tokens

# Minimum token counts per format (D34) and the date patterns.
MIN_TOKENS = {"squid": 10, "bluecoat-a": 24, "bluecoat-b": 14, "apache": 9, "iis": 19, "iis-short": 12}
DATE_TIME_PATTERN = "yyyy-M-d H:m:s"
APACHE_TIME_PATTERN = "d/MMM/yyyy:H:m:s"
HTML_TYPE = "text/html"

# Positional maps (D31): field -> token index. The IIS short map is a parameter.
IIS_FULL_MAP = {"date": 0, "time": 1, "page": 5, "query": 6, "clientip": 9, "status": 14,
                "bytesOut": 17, "bytesIn": 18}
IIS_SHORT_MAP = {"date": 0, "time": 1, "page": 4, "query": 6, "clientip": 8, "status": 11}


_INTEGER = r"^[+-]?[0-9]+$"


def _is_int(tok: Column) -> Column:
    """Whether a token is an integer literal, of any length (M2)."""
    return F.coalesce(F.trim(tok).rlike(_INTEGER), F.lit(False))


def _int(tok: Column) -> Column:
    """Integer value of a token as a 64-bit number: 0 for blanks and junk, the largest (or
    smallest) 64-bit number for integers beyond it, as sums have it (D1)."""
    t = F.trim(tok)
    beyond = F.when(t.startswith("-"), F.lit(-MAX_LONG - 1)).otherwise(F.lit(MAX_LONG))
    return F.coalesce(F.when(t.rlike(_INTEGER), F.coalesce(t.try_cast("bigint"), beyond)), F.lit(0).cast("bigint"))


def _stored_bytes(tok: Column) -> Column:
    """Stored form of a byte field: never negative (D1, D2), otherwise as logged."""
    return F.greatest(_int(tok), F.lit(0).cast("bigint"))


def _html(tok: Column) -> Column:
    return F.when(tok == HTML_TYPE, 1).otherwise(0).cast("int")


def _proxy(clientip, destip, time, b_in, b_out, b_diff, direction, content, page) -> Column:
    return F.struct(clientip.cast("string").alias("clientip"), destip.cast("string").alias("destip"),
                    time.cast("bigint").alias("time"), b_in.cast("bigint").alias("bytesIn"),
                    b_out.cast("bigint").alias("bytesOut"), b_diff.cast("bigint").alias("bytesDiff"),
                    direction.cast("string").alias("direction"), content.cast("int").alias("contentType"),
                    page.cast("string").alias("page"))


def _web(clientip, time, b_in, b_out, page, query) -> Column:
    return F.struct(clientip.cast("string").alias("clientip"), time.cast("bigint").alias("time"),
                    b_in.cast("bigint").alias("bytesIn"), b_out.cast("bigint").alias("bytesOut"),
                    page.cast("string").alias("page"), query.cast("string").alias("query"))


def squid(t: Column, tz: str = "UTC") -> Column:
    """client=2, URL=6, bytes=4, epoch=0, type=9. CONNECT targets give ``Unknown``."""
    url = token(t, 6)
    epoch = parse_epoch(token(t, 0))
    size = token(t, 4)
    ok = (F.size(t) >= MIN_TOKENS["squid"]) & epoch.isNotNull() & _is_int(size)
    row = _proxy(token(t, 2), F.coalesce(url_host(url), F.lit("Unknown")), epoch,
                 _stored_bytes(size), F.lit(0), byte_difference(_int(size), F.lit(0)), F.lit(""),
                 _html(token(t, 9)), F.coalesce(url_path(url), F.lit("")))
    return F.when(ok, row)


def bluecoat(t: Column, tz: str = "UTC") -> Column:
    """S5 (address in token 3) or S6 (address in token 2); neither gives NULL."""
    a_in, a_out = _int(token(t, 22)), _int(token(t, 23))
    a_ints = _is_int(token(t, 22)) & _is_int(token(t, 23))
    a_time = parse_local_time(F.concat_ws(" ", token(t, 0), token(t, 1)), DATE_TIME_PATTERN, tz)
    a_ok = (F.size(t) >= MIN_TOKENS["bluecoat-a"]) & a_time.isNotNull() & a_ints
    direction = F.when(a_in > a_out, "in").when(a_in < a_out, "out").otherwise("unknown")
    layout_a = _proxy(token(t, 3), token(t, 15), a_time, _stored_bytes(token(t, 22)),
                      _stored_bytes(token(t, 23)), byte_difference(a_in, a_out), direction,
                      _html(token(t, 13)), token(t, 17))
    b_time = parse_epoch(token(t, 0))
    b_ok = (F.size(t) >= MIN_TOKENS["bluecoat-b"]) & b_time.isNotNull() & _is_int(token(t, 5))
    layout_b = _proxy(token(t, 2), token(t, 12), b_time, _stored_bytes(token(t, 5)), F.lit(0), F.lit(0),
                      F.lit(""), _html(token(t, 13)), F.coalesce(url_path(token(t, 7)), F.lit("")))
    is_a = looks_like_ip(token(t, 3))
    is_b = looks_like_ip(token(t, 2))
    return F.when(is_a, F.when(a_ok, layout_a)).when(is_b, F.when(b_ok, layout_b))


def apache(t: Column, tz: str = "UTC") -> Column:
    """S7 combined format: client=0, time=3, request=5, status=6, bytes=7 (404 excluded)."""
    stamp = token(t, 3)
    time = F.when(stamp.startswith("["),
                  parse_local_time(F.regexp_replace(stamp, r"^\[", ""), APACHE_TIME_PATTERN, tz))
    request = token(t, 5)
    page = request_page(request)
    ok = (F.size(t) >= MIN_TOKENS["apache"]) & (token(t, 6) != "404") & time.isNotNull() & page.isNotNull()
    return F.when(ok, _web(token(t, 0), time, F.lit(0), _stored_bytes(token(t, 7)), page,
                          request_query(request)))


def iis(t: Column, tz: str = "UTC", positions: dict | None = None) -> Column:
    """S8 W3C full layout."""
    p = {**IIS_FULL_MAP, **(positions or {})}
    time = parse_local_time(F.concat_ws(" ", token(t, p["date"]), token(t, p["time"])), DATE_TIME_PATTERN, tz)
    ok = (F.size(t) >= MIN_TOKENS["iis"]) & (token(t, p["status"]) != "404") & time.isNotNull()
    return F.when(ok, _web(token(t, p["clientip"]), time, _stored_bytes(token(t, p["bytesIn"])),
                          _stored_bytes(token(t, p["bytesOut"])), token(t, p["page"]), token(t, p["query"])))


def iis_short(t: Column, tz: str = "UTC", positions: dict | None = None) -> Column:
    """S9 W3C short layout; query taken from token 6 by default (D31); no byte counts."""
    p = {**IIS_SHORT_MAP, **(positions or {})}
    time = parse_local_time(F.concat_ws(" ", token(t, p["date"]), token(t, p["time"])), DATE_TIME_PATTERN, tz)
    ok = (F.size(t) >= MIN_TOKENS["iis-short"]) & (token(t, p["status"]) != "404") & time.isNotNull()
    return F.when(ok, _web(token(t, p["clientip"]), time, F.lit(0), F.lit(0), token(t, p["page"]),
                          token(t, p["query"])))


PROXY_PARSERS = {"squid": squid, "bluecoat": bluecoat}
WEB_PARSERS = {"apache": apache, "iis": iis, "iis-short": iis_short}
STATUS_INDEX = {"apache": 6, "iis": IIS_FULL_MAP["status"], "iis-short": IIS_SHORT_MAP["status"]}


def parse_for_type(tokens: Column, log_type, kind: str, tz: str = "UTC", positions: dict | None = None) -> Column:
    """Struct for one record. ``log_type`` is a type string or a column holding it (S10);
    ``positions`` replaces token positions of the IIS types, by type (D31)."""
    parsers = dict(PROXY_PARSERS if kind == "proxy" else WEB_PARSERS)
    for name, places in (positions or {}).items():
        if name not in ("iis", "iis-short"):
            raise ValueError(f"{name!r} has no token positions to replace")
        parsers[name] = lambda t, tz, parse=WEB_PARSERS[name], places=places: parse(t, tz, places)
    if isinstance(log_type, str):
        if log_type not in parsers:
            raise ValueError(f"{log_type!r} is not a {kind} log type")
        return parsers[log_type](tokens, tz)
    expr = None
    for name, fn in parsers.items():
        expr = (F.when(log_type == name, fn(tokens, tz)) if expr is None
                else expr.when(log_type == name, fn(tokens, tz)))
    return expr


def reject_reason(line: Column, tokens: Column, record: Column, log_type, kind: str) -> Column:
    """Why a line gave no record (NULL when it gave one)."""
    status = None
    if kind == "web":
        if isinstance(log_type, str):
            status = token(tokens, STATUS_INDEX[log_type])
        else:
            status = F.when(log_type == "apache", token(tokens, 6)) \
                .when(log_type == "iis", token(tokens, STATUS_INDEX["iis"])) \
                .when(log_type == "iis-short", token(tokens, STATUS_INDEX["iis-short"]))
    reason = F.when(record.isNotNull(), F.lit(None).cast("string")) \
        .when(~F.coalesce(line.rlike("^[0-9]"), F.lit(False)), "not_digit_first") \
        .when(tokens.isNull(), "unbalanced_quote")
    if status is not None:
        reason = reason.when(status == "404", "status_404")
    return reason.otherwise("unparsed")


def annotate(lines, kind: str, log_type="type", line_col: str = "line", tz: str = "UTC", positions: dict | None = None):
    """Add ``_rec`` (parsed struct or NULL) and ``_reason`` to a DataFrame of lines.

    Lines must start with a digit (D4, both importers call ``isdigit()``)."""
    line = F.col(line_col)
    type_expr = F.col(log_type) if isinstance(log_type, str) and log_type in lines.columns else log_type
    with_tokens = with_shell_tokens(lines, line_col, "_tokens", where=F.coalesce(line.rlike("^[0-9]"), F.lit(False)))
    t = F.col("_tokens")
    rec = F.when(t.isNotNull(), parse_for_type(t, type_expr, kind, tz, positions))
    out = with_tokens.withColumn("_rec", rec)
    out = out.withColumn("_reason", reject_reason(line, t, F.col("_rec"), type_expr, kind))
    return out.drop("_tokens")

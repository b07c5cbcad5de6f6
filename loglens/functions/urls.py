"""URL and request-line parts (U1), lenient like a generic URL splitter.

``parse_url`` in Spark rejects many real proxy URLs (``|``, ``^``, spaces), so the
parts are cut with anchored regular expressions instead: scheme, then ``//netloc``,
then path, ``?query`` and ``#fragment``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_host(col) -> Column:
    """Lower-cased host name of an absolute URL; NULL when there is no ``//netloc``."""
    netloc = F.regexp_extract(_c(col), _SPLIT, 3)
    has_netloc = F.regexp_extract(_c(col), _SPLIT, 2) != ""
    host = F.regexp_extract(netloc, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)
    host = F.lower(F.regexp_replace(host, r"^\[|\]$", ""))
    return F.when(has_netloc & (host != ""), host)


def url_path(col) -> Column:
    """Path without ``;params`` of its last segment (as a generic URL splitter does)."""
    path = F.regexp_extract(_c(col), _SPLIT, 4)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_query(col) -> Column:
    return F.regexp_extract(_c(col), _SPLIT, 5)


def request_page(request) -> Column:
    """Apache request line to its page: second word of the part before ``?``/``#``.

    NULL for a request with no target (D35)."""
    before = F.regexp_extract(_c(request), r"^[^?#]*", 0)
    before = F.regexp_replace(before, r";[^/]*$", "")
    words = F.split(F.trim(before), r"[ \t]+")
    return F.when(F.size(words) >= 2, F.get(words, 1))


def request_query(request, strip_protocol: bool = True) -> Column:
    """Query of a request line; the trailing `` HTTP/x.y`` is removed by default."""
    query = F.regexp_extract(_c(request), r"^[^?#]*\?([^#]*)", 1)
    if strip_protocol:
        query = F.regexp_replace(query, r"[ \t]+HTTP/[0-9.]*$", "")
    return query

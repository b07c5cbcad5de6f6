"""IP-address predicates and conversions (F4, F5, F7, J9 keys)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (the reference's own address patterns, verbatim).
# Importer/beacon test, applied as a match at the start of the text only (D26):
IP_PATTERN = r"\b(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
# Dashboard test, whole string after trimming:
STRICT_IP_PATTERN = r"^([1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}$"

IP_PREFIX_PATTERN = "^" + IP_PATTERN   # a match anchored at the start (search elsewhere would differ)

# The private/zero prefixes the map feed leaves out.
PRIVATE_PREFIXES = ("192.168.1.", "10.", "172.16.")
ZERO_ADDRESS = "0.0.0.0"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def looks_like_ip(col) -> Column:
    """prefix-anchored IPv4 test (``1.2.3.4.evil.com`` passes, as in the reference)."""
    return F.coalesce(_c(col).rlike(IP_PREFIX_PATTERN), F.lit(False))


def is_strict_ip(col) -> Column:
    """whole-string dotted quad after trimming."""
    return F.coalesce(F.trim(_c(col)).rlike(STRICT_IP_PATTERN), F.lit(False))


def is_public(col, full_rfc1918: bool = False) -> Column:
    """not one of the excluded private/zero addresses."""
    c = _c(col)
    cond = c != F.lit(ZERO_ADDRESS)
    for prefix in PRIVATE_PREFIXES:
        cond = cond & ~c.startswith(prefix)
    if full_rfc1918:
        cond = cond & ~c.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    return F.coalesce(cond, F.lit(False))


def ipv4_to_long(col) -> Column:
    """Dotted quad to its 32-bit number; NULL for anything that is not a strict address."""
    c = F.trim(_c(col))
    parts = F.split(c, r"\.")
    number = F.aggregate(F.transform(parts, lambda x: x.try_cast("bigint")),
                         F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)
    return F.when(is_strict_ip(c), number)


def client_or_dest(ip: str, client_col: str = "clientip", dest_col: str | None = "destip") -> Column:
    """client equals ip, or (proxy) client-or-destination equals ip."""
    cond = F.col(client_col) == F.lit(ip)
    if dest_col:
        cond = cond | (F.col(dest_col) == F.lit(ip))
    return cond

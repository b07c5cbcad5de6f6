"""SQL-injection and cross-site-scripting indicator patterns.

Fixed values: the four detector patterns are the reference's own, used verbatim
and applied case-insensitively as a search anywhere in the text. ``(?iU)`` makes
Java's case folding and ``\\w``/``\\s`` Unicode-aware like Python's ``re``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference detector patterns, in the reference's order).
SQL_KEYWORD_PATTERN = r"drop|delete|truncate|update|insert|select|declare|union|create|concat"
SQL_META_PATTERN = r"((\%3D)|(=))[^\n]*((\%27)|(\')|(\-\-)|(\%3B)|(;))|\w*((\%27)|(\'))((\%6F)|o|(\%4F))((\%72)|r|(\%52))"
MSSQL_EXEC_PATTERN = r"exec(\s|\+)+(s|x)p\w+"
XSS_PATTERN = r"((\%3C)|<)((\%2F)|\/)*[a-z0-9\%]+((\%3E)|>)|((\%3C)|<)((\%69)|i|(\%49))((\%6D)|m|(\%4D))((\%67)|g|(\%47))[^\n]+((\%3E)|>)"

# detector name -> (pattern, indicator type)
DETECTORS: list[tuple[str, str, str]] = [
    ("keyword", SQL_KEYWORD_PATTERN, "sqli"),
    ("meta", SQL_META_PATTERN, "sqli"),
    ("exec", MSSQL_EXEC_PATTERN, "sqli"),
    ("xss", XSS_PATTERN, "xss"),
]

# Necessary conditions (derived from the patterns): a text can only match if it
# holds one of these literal substrings, none of which has letters, so case does
# not matter. A cheap substring test skips the regular expression for all other
# texts; it never changes which texts match.
REQUIRED_ANY: dict[str, tuple[str, ...]] = {
    SQL_META_PATTERN: ("=", "%3", "'", "%27"),
    XSS_PATTERN: ("<", "%3"),
}


# Case-insensitive necessary conditions: the lower-cased text holds one of the
# words, or the text holds a non-ASCII letter that Unicode case folding maps onto
# an ASCII letter of the words (dotted capital I, dotless i, long s).
REQUIRED_ANY_FOLDED: dict[str, tuple[str, ...]] = {
    SQL_KEYWORD_PATTERN: tuple(SQL_KEYWORD_PATTERN.split("|")),
    MSSQL_EXEC_PATTERN: ("exec",),
}
FOLDING_LETTERS = ("\u0130", "\u0131", "\u017f")


def _any_contains(c: Column, literals) -> Column:
    out = None
    for lit in literals:
        out = c.contains(lit) if out is None else out | c.contains(lit)
    return out


def matches(col, pattern: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    test = c.rlike("(?iU)" + pattern)
    if pattern in REQUIRED_ANY:
        test = F.when(_any_contains(c, REQUIRED_ANY[pattern]), test).otherwise(F.lit(False))
    elif pattern in REQUIRED_ANY_FOLDED:
        pre = _any_contains(F.lower(c), REQUIRED_ANY_FOLDED[pattern]) | _any_contains(c, FOLDING_LETTERS)
        test = F.when(pre, test).otherwise(F.lit(False))
    return F.coalesce(test, F.lit(False))


def detector_hits(col) -> Column:
    """Array of structs (detector, xsstype), one per detector that fires on ``col``."""
    hits = [F.when(matches(col, pattern), F.struct(F.lit(name).alias("detector"), F.lit(kind).alias("xsstype")))
            for name, pattern, kind in DETECTORS]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())

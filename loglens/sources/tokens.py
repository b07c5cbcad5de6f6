"""S3: shell-style tokenising of a log line as native column expressions.

Rules (POSIX shell quoting, as the reference's ``shlex.split``): tokens are split on
space, tab, CR, LF; ``'...'`` is literal; inside ``"..."`` a backslash escapes only
``"`` and ``\\``; outside quotes a backslash escapes any character. An unbalanced
quote or a trailing lone backslash makes the whole line invalid (NULL).

Lines without any quote or backslash take the fast path (a plain ``split``). The
regular expressions are possessive and consume runs of plain characters in one
step, so hostile lines neither backtrack nor recurse per character.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r" \t\r\n"
TOKEN = rf"""(?:[^{_WS}"'\\]++|\\[\s\S]|"(?:[^"\\]++|\\[\s\S])*+"|'[^']*+')++"""
PIECE = r"""([^"'\\]++|\\[\s\S]|"(?:[^"\\]++|\\[\s\S])*+"|'[^']*+')"""


def _unquote_piece(p: Column) -> Column:
    body = F.substring(p, F.lit(2), F.length(p) - 2)
    return (F.when(p.startswith("'"), body)
             .when(p.startswith('"'), F.regexp_replace(body, r'\\(["\\])', "$1"))
             .when(p.startswith("\\"), F.substring(p, 2, 1))
             .otherwise(p))


def _has_quoting(c: Column) -> Column:
    return c.contains('"') | c.contains("'") | c.contains("\\")


def raw_tokens(s: Column) -> Column:
    """Quoted tokens as written, in one regex pass. A quote or backslash that cannot
    start a token (unbalanced) is captured as a one-character element; every other
    non-blank character is consumed by a token."""
    return F.regexp_extract_all(s, F.lit("(" + TOKEN + r"""|["'\\])"""), 1)


def tokens_from_raw(s: Column, raw: Column) -> Column:
    """Final tokens from the line and its raw tokens (NULL raw means: no quoting, plain split)."""
    plain = F.when(F.trim(s, F.lit(" \t\r\n")) == "", F.array().cast("array<string>")) \
        .otherwise(F.split(F.trim(s, F.lit(" \t\r\n")), r"[ \t\r\n]+"))
    valid = ~F.exists(raw, lambda x: x.isin('"', "'", "\\"))
    unquoted = F.transform(raw, lambda t: F.when(_has_quoting(t), F.array_join(
        F.transform(F.regexp_extract_all(t, F.lit(PIECE), 1), _unquote_piece), "")).otherwise(t))
    return F.when(s.isNull(), F.lit(None)).when(raw.isNull(), plain).when(valid, unquoted)


def shell_tokens(line) -> Column:
    """array<string> of tokens, or NULL when the quoting is unbalanced (one expression)."""
    s = F.col(line) if isinstance(line, str) else line
    return tokens_from_raw(s, F.when(_has_quoting(s), raw_tokens(s)))


def with_shell_tokens(df, line_col: str, out_col: str, where: Column | None = None):
    """Add ``out_col`` = tokens of ``line_col`` (NULL where ``where`` is false).

    The raw token array is projected as its own column first, so the validity test
    and the unquoting read it instead of each re-running the regex."""
    s = F.col(line_col)
    cond = _has_quoting(s) if where is None else (where & _has_quoting(s))
    staged = df.withColumn("_raw_tokens", F.when(cond, raw_tokens(s)))
    tokens = tokens_from_raw(s, F.col("_raw_tokens"))
    if where is not None:
        tokens = F.when(where, tokens)
    return staged.withColumn(out_col, tokens).drop("_raw_tokens")


def token(tokens: Column, i: int) -> Column:
    """Zero-based token ``i``; NULL when absent (no ANSI out-of-range error)."""
    return F.get(tokens, i)

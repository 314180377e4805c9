"""SQL text of a query log: comments out, literals redacted, fingerprints; all as regular expressions on a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_quoted = r"""'(?:\\.|[^'\\])*'?|"(?:\\.|[^"\\])*"?"""
_comments = rf"(?s)({_quoted}|`(?:\\.|[^`\\])*`?)|--[^\n]*\n?|/\*.*?(?:\*/|$)|#[^\n]*\n?"
_literals = rf"(?s){_quoted}|0[xX][0-9a-fA-F]*|(?<![A-Za-z0-9_])[0-9][0-9.]*|(?<![A-Za-z0-9_)])-[0-9][0-9.]*"


def strip_comments(sql: Column) -> Column:
    """Without `--`, `#` and `/* */` comments; what is quoted stays."""
    return F.regexp_replace(sql, _comments, "$1")


def redact(sql: Column) -> Column:
    """Quoted strings and numbers become `?`; digits of identifiers stay."""
    return F.regexp_replace(sql, _literals, "?")


def sanitize(sql: Column) -> Column:
    """Redacted text without comments, in single blanks."""
    return F.trim(F.regexp_replace(redact(strip_comments(sql)), r"\s+", " "))


def fingerprint(sql: Column) -> Column:
    """SHA-256 of the sanitized text: equal for statements that differ in literals, comments and blanks only."""
    return F.sha2(sanitize(sql).cast("binary"), 256)

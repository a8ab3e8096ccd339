"""Text Column functions: Python-compatible strip, whitespace token counts, hashes.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace()`` accepts, i.e. what
# ``str.strip()`` and ``str.split()`` (no argument) treat as whitespace:
# U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
# The same pattern text is valid in Java regex (Spark) and RE2 (DuckDB).
_WS_INNER = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_CLASS = f"[{_WS_INNER}]"
NON_WS_CLASS = f"[^{_WS_INNER}]"
# The same characters as a literal set, for ``trim(str, chars)`` (which only looks at the ends).
PY_WHITESPACE = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                         *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

# Truncation margin: an output is "possibly truncated" at max_gen_toks - 8 tokens.
TRUNCATION_MARGIN = 8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace.

    ``trim(str, chars)`` treats ``chars`` as a set and inspects only the two
    ends, so it is O(whitespace) rather than a regex scan of the whole text.
    """
    return F.trim(_c(x), F.lit(PY_WHITESPACE))


def is_blank(x) -> Column:
    """True when the text is empty after ``py_strip`` (NULL counts as blank).

    Trimmed at the left end only, which stops at the first other character: the right end would have every
    character of the text located first."""
    return F.coalesce(F.ltrim(_c(x), F.lit(PY_WHITESPACE)) == "", F.lit(True))


def whitespace_token_count(x) -> Column:
    """``len(text.split())``: number of maximal non-whitespace runs; 0 for NULL/empty.

    Every Python whitespace character is first mapped to a space (``translate``,
    a per-character table lookup), then token *starts* -- a non-space after a
    space -- are counted with a one-character-class regex; about twice as
    fast as counting runs of the full Unicode class.
    """
    spaced = F.translate(_c(x), PY_WHITESPACE, " " * len(PY_WHITESPACE))
    n = F.regexp_count(F.concat(F.lit(" "), spaced), F.lit(" [^ ]"))
    return F.coalesce(n, F.lit(0)).cast("bigint")


def content_hash(x) -> Column:
    """First 16 hex characters of SHA-256 over the UTF-8 bytes."""
    return F.substring(F.sha2(_c(x), 256), 1, 16)


def possibly_truncated(tokens, max_gen_toks) -> Column:
    mg = max_gen_toks if isinstance(max_gen_toks, Column) else F.lit(max_gen_toks)
    return _c(tokens) >= (mg - TRUNCATION_MARGIN)


def sql_ws_token_count(expr: str) -> str:
    """DuckDB spelling of :func:`whitespace_token_count` (for oracles)."""
    return f"CAST(coalesce(len(regexp_extract_all({expr}, '{NON_WS_CLASS}+')), 0) AS BIGINT)"


def sql_py_strip(expr: str) -> str:
    """DuckDB spelling of :func:`py_strip`."""
    return f"regexp_replace({expr}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"

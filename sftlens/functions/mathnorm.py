"""Maths answer normalisation as built-in Spark expressions (M1-M9).

The normaliser is applied to a DataFrame column with one ``withColumn`` per
step: each step uses its input several times, and nesting the steps as one
expression grows the tree exponentially.  NULL stands for "the reference
would raise here"; it propagates through the remaining steps, and
:func:`is_equiv` then falls back to raw equality, exactly like the reference's
``except Exception`` branch.

Step order is semantic and follows the reference: newlines, ``\\!``, ``\\\\``,
tfrac/dfrac, ``\\left``/``\\right``, degrees, ``\\$``, units, ``\\%``,
leading-zero fixes, ``k = v``, ``\\sqrt``, spaces, ``\\frac``, ``0.5``, ``a/b``.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Literal rewrites of the normaliser, in order (before the units step).
REPLACEMENTS_BEFORE_UNITS = [
    ("\n", ""),
    ("\\!", ""),
    ("\\\\", "\\"),
    ("tfrac", "frac"),
    ("dfrac", "frac"),
    ("\\left", ""),
    ("\\right", ""),
    ("^{\\circ}", ""),
    ("^\\circ", ""),
    ("\\$", ""),
]
# Literal rewrites after the units step.
REPLACEMENTS_AFTER_UNITS = [
    ("\\%", ""),
    (" .", " 0."),
    ("{.", "{0."),
]
UNITS_MARKER = "\\text{ "
HALF = "\\frac{1}{2}"
# a/b with canonical integers (what ``"{}/{}".format(int(a), int(b)) == s`` accepts).
A_SLASH_B = r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z"


def _lit(s: str) -> Column:
    return F.lit(s)


def _split_literal(col: Column, sep: str) -> Column:
    """Python ``s.split(sep)``: literal separator, empty pieces kept."""
    return F.split(col, re.escape(sep), -1)


def _fix_sqrt(s: Column) -> Column:
    """M6: ``\\sqrt3`` -> ``\\sqrt{3}``; an empty piece (``\\sqrt`` at the end) raises -> NULL."""
    parts = _split_literal(s, "\\sqrt")
    tail = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    mapped = F.transform(tail, lambda p: F.when(F.substring(p, 1, 1) != "{",
                                                F.concat(_lit("\\sqrt{"), F.substring(p, 1, 1), _lit("}"),
                                                         F.substring(p, 2, 1 << 30)))
                         .otherwise(F.concat(_lit("\\sqrt"), p)))
    built = F.concat(F.element_at(parts, 1), F.array_join(mapped, ""))
    return (F.when(F.size(parts) <= 1, s)
             .when(F.exists(tail, lambda p: F.length(p) == 0), F.lit(None).cast("string"))
             .otherwise(built))


def _fix_fracs(s: Column) -> Column:
    """M5: ``\\frac12`` -> ``\\frac{1}{2}``, ``\\frac1{72}`` -> ``\\frac{1}{72}``.

    The pieces after each ``\\frac`` are visited in order; the first one that
    is empty raises (NULL) and the first one-character piece other than ``{``
    returns the input unchanged -- whichever comes first.
    """
    parts = _split_literal(s, "\\frac")
    tail = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
    bad = F.get(F.filter(tail, lambda p: (F.length(p) == 0) | ((F.length(p) == 1) & (p != "{"))), 0)

    def fix(p):
        a, b = F.substring(p, 1, 1), F.substring(p, 2, 1)
        return (F.when(a == "{", p)
                 .when(b != "{", F.concat(_lit("{"), a, _lit("}{"), b, _lit("}"), F.substring(p, 3, 1 << 30)))
                 .otherwise(F.concat(_lit("{"), a, _lit("}"), F.substring(p, 2, 1 << 30))))

    built = F.array_join(F.concat(F.array(F.element_at(parts, 1)), F.transform(tail, fix)), "\\frac")
    return (F.when(F.size(parts) <= 1, s)
             .when(bad.isNull(), built)
             .when(bad == "", F.lit(None).cast("string"))
             .otherwise(s))


def normalize(df: DataFrame, in_col: str, out_col: str) -> DataFrame:
    """M4 ``strip_string``: add ``out_col`` (NULL where the reference raises)."""
    t = f"_{out_col}_n"
    c = F.col(t)
    df = df.withColumn(t, F.col(in_col))
    for old, new in REPLACEMENTS_BEFORE_UNITS:
        df = df.withColumn(t, F.replace(c, _lit(old), _lit(new)))
    # M8: cut at the units marker; two or more markers raise.
    n_units = F.size(_split_literal(c, UNITS_MARKER))
    df = df.withColumn(t, F.when(n_units == 1, c).when(n_units == 2, F.substring_index(c, UNITS_MARKER, 1)))
    for old, new in REPLACEMENTS_AFTER_UNITS:
        df = df.withColumn(t, F.replace(c, _lit(old), _lit(new)))
    df = df.withColumn(t, F.when(F.substring(c, 1, 1) == ".", F.concat(_lit("0"), c)).otherwise(c))
    eq = _split_literal(c, "=")
    df = df.withColumn(t, F.when((F.size(eq) == 2) & (F.length(F.element_at(eq, 1)) <= 2), F.element_at(eq, 2))
                       .otherwise(c))
    df = df.withColumn(t, _fix_sqrt(c))
    df = df.withColumn(t, F.replace(c, _lit(" "), _lit("")))
    df = df.withColumn(t, _fix_fracs(c))
    df = df.withColumn(t, F.when(c == "0.5", _lit(HALF)).otherwise(c))
    df = df.withColumn(t, F.regexp_replace(c, A_SLASH_B, r"\\frac{$1}{$2}"))
    return df.withColumnRenamed(t, out_col)


def _last_index(s: Column, pat: str) -> Column:
    """1-based position of the last occurrence of ``pat`` (0 when absent)."""
    r = F.instr(F.reverse(s), pat[::-1])
    return F.when(r == 0, F.lit(0)).otherwise(F.length(s) - r - F.lit(len(pat)) + 2)


def last_boxed(s: Column) -> Column:
    """M2 ``last_boxed_only_string``: ``\\boxed <text up to $>`` when ``\\boxed `` occurs;
    otherwise the last ``\\boxed`` (else ``\\fbox``) through its matching brace; NULL
    when there is none or the braces never balance."""
    idx_b = _last_index(s, "\\boxed")
    idx = F.when(idx_b > 0, idx_b).otherwise(_last_index(s, "\\fbox"))
    return _last_boxed_from(s, idx)


def remove_boxed(s: Column) -> Column:
    """M3: strip ``\\boxed{...}`` / ``\\boxed ``; anything else unchanged; malformed -> NULL."""
    return (F.when(s.isNull(), F.lit(None).cast("string"))
             .when(F.instr(s, "\\boxed ") > 0,
                   F.when(s.startswith("\\boxed "), F.substring(s, 8, 1 << 30)))
             .when(~s.startswith("\\boxed{"), s)
             .when(s.endswith("}"), F.substring(s, 8, F.length(s) - 8))
             .otherwise(F.lit(None).cast("string")))


def dollar_span(s: Column) -> Column:
    """M1: text between the first and last ``$`` when there are at least two, else all of it."""
    n = F.length(s) - F.length(F.replace(s, _lit("$"), _lit("")))
    first = F.instr(s, "$")
    last = _last_index(s, "$")
    return F.when(n <= 1, s).otherwise(F.substring(s, first + 1, last - first - 1))


def add_boxed_answer(df: DataFrame, src: str, dst: str) -> DataFrame:
    """``remove_boxed(last_boxed(src))`` materialised step by step (each intermediate is
    used several times by the next step; one column each keeps the plan small)."""
    lb, idx = f"_{dst}_lb", f"_{dst}_idx"
    s = F.col(src)
    df = df.withColumn(idx, F.when(_last_index(s, "\\boxed") > 0, _last_index(s, "\\boxed"))
                       .otherwise(_last_index(s, "\\fbox")))
    df = df.withColumn(lb, _last_boxed_from(s, F.col(idx)))
    return df.withColumn(dst, remove_boxed(F.col(lb))).drop(lb, idx)


def _last_boxed_from(s: Column, idx: Column) -> Column:
    tail = F.substring(s, idx, 1 << 30)
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(-1).alias("e"))

    def step(acc, ch):
        d = acc["d"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        closes = (ch == "}") & (d == 0)
        return F.when(acc["e"] >= 0, acc).otherwise(
            F.struct(d.alias("d"), (acc["i"] + 1).alias("i"),
                     F.when(closes, acc["i"]).otherwise(F.lit(-1)).alias("e")))

    end = F.when(idx > 0, F.aggregate(F.split(tail, ""), init, step)["e"])
    braced = F.when((idx > 0) & (end >= 0), F.substring(tail, 1, end + 1))
    spaced = F.concat(_lit("\\boxed "), F.substring_index(F.substring_index(s, "\\boxed ", -1), "$", 1))
    return F.when(s.isNull(), F.lit(None).cast("string")) \
            .when(F.instr(s, "\\boxed ") > 0, spaced).otherwise(braced)

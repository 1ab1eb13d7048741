"""Conditional and numeric expressions that keep a missing value missing.

SQL's ``CASE WHEN NULL`` falls through to ELSE; label arithmetic must not, or an
unanswered question would count as a "no". Everything here returns a ``Column``
made of built-in functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """A Column as it is, anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def na_if_else(cond: Column, yes, no) -> Column:
    """``yes`` / ``no`` by ``cond``, and NULL where ``cond`` is NULL."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, as_col(yes)).otherwise(as_col(no))


def indicators_to_scale(levels: Sequence[str], dont_know: str, dont_know_value: int | None = None) -> Column:
    """Collapse indicator columns (lowest level first) to 1..n; the highest ticked level wins.

    "Don't know" gives ``dont_know_value``: NULL for the plain scale, 0 for the extended one.
    """
    out = na_if_else(F.col(dont_know) == 1, F.lit(dont_know_value).cast("int"), F.lit(None).cast("int"))
    for value, name in enumerate(levels, start=1):
        out = na_if_else(F.col(name) == 1, F.lit(value), out)
    return out.cast("int")


def indicators_to_binary(levels: Sequence[str], dont_know: str, dont_know_value: int | None = None) -> Column:
    """Collapse indicator columns to 1 (any level above the lowest) or 0 (the lowest level)."""
    scale = indicators_to_scale(levels, dont_know, dont_know_value)
    return F.when(scale > 1, F.lit(1)).when(scale == 1, F.lit(0)).otherwise(scale).cast("int")


def flags_to_category(flags: Sequence[tuple[Column, int]], default: int = 0) -> Column:
    """First matching flag, in the order given, decides the category."""
    out = F.lit(default)
    for flag, value in reversed(list(flags)):
        out = na_if_else(flag == 1, F.lit(value), out)
    return out.cast("int")


def recode(col: Column, mapping: Mapping[int, int | None]) -> Column:
    """Replace listed values; a value that is not listed becomes NULL."""
    out = F.lit(None).cast("int")
    for old, new in mapping.items():
        out = F.when(col == old, F.lit(new).cast("int")).otherwise(out)
    return out


def intersect_flags(parts: Sequence[str]) -> Column:
    """1 where every flag is 1, 0 where one is 0, NULL where that cannot be known (Kleene AND)."""
    cond = F.col(parts[0]) == 1
    for name in parts[1:]:
        cond = cond & (F.col(name) == 1)
    return na_if_else(cond, F.lit(1), F.lit(0)).cast("int")


def cross_label(first: Column, second: Column, known: Sequence[tuple[str, str]]) -> Column:
    """Concatenate two attributes into one label for the pairs listed, else NULL."""
    ok = F.lit(False)
    for a, b in known:
        ok = ok | ((first == a) & (second == b))
    return F.when(ok, F.concat(F.lower(first), F.lower(second)))


def clamp(col: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (``greatest`` would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def half_even(col: Column, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(col, digits)


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL on an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def log10_positive(col: Column) -> Column:
    """log10, NULL for values that have none."""
    return F.when(col > 0, F.log10(col.cast("double")))


def strip_copy_suffix(doc_id: Column) -> Column:
    """Remove the first ``.digits`` that resampling appends to a repeated document id."""
    return F.regexp_replace(doc_id, r"^([^.]*)\.[0-9]*", "$1")

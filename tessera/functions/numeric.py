"""Numeric, conditional and aggregate rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percentage(n: Column, d: Column) -> Column:
    """100*n/d to two places, half to even; 0.0 over nothing."""
    return F.coalesce(F.bround(F.try_divide(100.0 * n, d.cast("double")), 2), F.lit(0.0))


def flag(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def same_money(a: Column, b: Column) -> Column:
    return F.bround(a, 2) == F.bround(b, 2)


def canonical(token: Column, meanings: dict[str, str]) -> Column:
    """Canonical value of a token, the token itself where it is unknown."""
    pairs = [F.lit(x) for value, words in meanings.items() for word in words.split() for x in (word, value)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), token), token)


def unmapped(token: Column, meanings: dict[str, str]) -> Column:
    known = [word for words in meanings.values() for word in words.split()]
    return F.coalesce(~token.isin(*known), F.lit(False))


def count_all() -> Column:
    return F.count(F.lit(1))


def bool_sum(col: Column) -> Column:
    return F.count_if(flag(col))


def not_valid(col: Column) -> Column:
    return F.count_if(~flag(col))


def _sum(col: Column) -> Column:
    """Sum as a double, null over no values.

    Added up as decimal(38,10), so exactly and in any order, where all values and their sum fit that
    type; as doubles where one doesn't (28 digits before the point, NaN, infinity).
    """
    exact = col.try_cast("decimal(38,10)")
    fits = F.count(exact) == F.count(col)
    return F.coalesce(F.when(fits, F.try_sum(exact).cast("double")), F.sum(col.cast("double")))


def total(col: Column) -> Column:
    """Sum, 0.0 for a group without values."""
    return F.coalesce(_sum(col), F.lit(0.0))


def average(col: Column) -> Column:
    return F.try_divide(_sum(col), F.count(col).cast("double"))


def quantile_or_zero(col: Column, q: float) -> Column:
    """Interpolated quantile within a group, 0.0 over no values.

    The buffer of a group holds its distinct values; ranks.exact_quantiles is for whole columns.
    """
    return F.coalesce(F.percentile(col, q), F.lit(0.0))


def stable_values(col: Column) -> Column:
    """Sorted distinct non-empty values, joined."""
    return F.array_join(F.array_sort(F.collect_set(F.when(col != "", col))), " | ")


def representative(col: Column) -> Column:
    """The one value, MULTIPLE_VALUES for several, null for none."""
    low, high = F.min(F.when(col != "", col)), F.max(F.when(col != "", col))
    return F.when(low == high, low).when(low.isNotNull(), F.lit("MULTIPLE_VALUES"))


def priority(signals: Column) -> Column:
    return F.when(signals <= 0, "LOW").when(signals <= 2, "WATCH").otherwise("ELEVATED_REVIEW")

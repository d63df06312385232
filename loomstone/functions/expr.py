"""Arithmetic, comparison and scalar functions, with the two-valued variants under compat names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Float division; a zero divisor gives null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder of the whole parts as a float; a zero divisor gives null."""
    return F.try_mod(a.cast("bigint"), b.cast("bigint")).cast("double")


def length_bytes(s: Column) -> Column:
    return F.octet_length(s)


def compat_eq(a: Column, b: Column) -> Column:
    """Two-valued equality: null equals null."""
    return a.eqNullSafe(b)


def compat_lt(a: Column, b: Column) -> Column:
    """Two-valued order: null is less than any value."""
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def compat_sum(x: Column) -> Column:
    """0.0 over no rows or only nulls."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def compat_avg(x: Column) -> Column:
    """Nulls count as 0; null over no rows."""
    return F.try_divide(F.coalesce(F.sum(x.cast("double")), F.lit(0.0)), F.count(F.lit(1)))


def compat_truth(x: Column, empty) -> Column:
    """Two-valued truth: null and the empty value of the column's kind ('', 0 or False) are false, all else is true."""
    return F.coalesce(x != F.lit(empty), F.lit(False))


def fold_key(s: Column) -> Column:
    """Index keys compare strings with A-Z folded."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def first_by(x: Column, key: Column) -> Column:
    return F.min_by(x, key)


def last_by(x: Column, key: Column) -> Column:
    return F.max_by(x, key)

"""Column functions with the dialect's own NULL, type and error rules.

Sums without a non-null value are 0; nulls sort last either way; division by zero raises even where the optimizer moves
a guard; text length counts UTF-16 units on request; comparisons of span fields are two-valued.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_or_zero(c: Column, distinct: bool = False) -> Column:
    """SUM as a double; 0.0 if nothing is non-null."""
    c = c.cast("double")
    return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0.0))


def count(c: Column | None = None, distinct: bool = False) -> Column:
    """COUNT(*) without a column, else of the non-null values."""
    if c is None:
        return F.count(F.lit(1))
    return F.count_distinct(c) if distinct else F.count(c)


def ascending(c: Column) -> Column:
    return c.asc_nulls_last()


def descending(c: Column) -> Column:
    return c.desc_nulls_last()


def divide(a: Column, b: Column) -> Column:
    """True division to a double; raises on zero unless a is null."""
    return F.when(a.isNotNull(), a.cast("double") / b.cast("double"))


def remainder(a: Column, b: Column) -> Column:
    """Sign of the dividend; raises on zero unless a is null."""
    return F.when(a.isNotNull(), a % b)


def both(guard: Column, test, divisor: Column) -> Column:
    """guard AND test(divisor), where test divides by it: the divisor is null wherever guard is false, so no evaluation
    order can raise for rows that guard excludes."""
    return guard & test(F.when(guard.isNull() | guard, divisor))


def either(guard: Column, test, divisor: Column) -> Column:
    """guard OR test(divisor), guarded alike."""
    return guard | test(F.when(guard.isNull() | ~guard, divisor))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units (characters beyond U+FFFF count two)."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def two_valued(leaf: Column) -> Column:
    """A missing value makes a test false, not unknown."""
    return F.coalesce(leaf, F.lit(False))


def nearest_rank(c: Column, p: float) -> Column:
    """Exact nearest-rank percentile; 0 of nothing."""
    return F.coalesce(F.percentile_approx(c, p, F.lit(2147483647)), F.lit(0))


def same_category(schema, *names: str) -> str:
    """The category that the columns share (number, text, boolean); raises if they differ or there are none."""
    kinds = {_category(schema[n].dataType.typeName()) for n in names}
    if len(kinds) != 1:
        raise TypeError(f"COALESCE needs arguments of one category, has {sorted(kinds) or 'none'}")
    return kinds.pop()


def _category(name: str) -> str:
    if name in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return "number"
    return {"string": "text", "boolean": "boolean"}.get(name, name)


def coalesce(df, *names: str) -> Column:
    """First non-null of columns of one category."""
    same_category(df.schema, *names)
    return F.coalesce(*names)


def text_only(df, name: str) -> Column:
    """The column, if it is text (UPPER, LOWER and LENGTH take nothing else)."""
    if _category(df.schema[name].dataType.typeName()) != "text":
        raise TypeError(f"{name} is no text column")
    return F.col(name)

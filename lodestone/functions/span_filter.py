"""Tests on span fields, as Spark columns.

    field("service") == "click"
    (field("duration") > 1_000_000) & ~field("status").is_("error")
    attribute("http.method") != "GET"

Tests are two-valued: a field or attribute that is missing, or has another type, passes no test but `!=` on another type;
ordering is for numbers alone.  They combine with &, | and ~ like any columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.semantics import two_valued

#: Field name -> span column.
_FIELDS = {"service": "service_name", "name": "name", "duration": "duration_ns", "status": "status_code"}


class Field:
    """A span's text (s), number (n) and truth (b) for one field or attribute; those it has not are null."""

    def __init__(self, s: Column | None, n: Column | None, b: Column | None, present: Column) -> None:
        self._slot, self._present = {str: s, float: n, bool: b}, present

    def _typed(self, value) -> tuple[Column | None, Column]:
        kind = bool if isinstance(value, bool) else float if isinstance(value, (int, float)) else str
        return self._slot[kind], F.lit(value)

    def is_(self, value) -> Column:
        slot, v = self._typed(value)
        return F.lit(False) if slot is None else two_valued(slot == v)

    def differs(self, value) -> Column:
        return two_valued(self._present) & ~self.is_(value)

    def __eq__(self, value) -> Column:  # type: ignore[override]
        return self.is_(value)

    def __ne__(self, value) -> Column:  # type: ignore[override]
        return self.differs(value)

    __hash__ = None  # type: ignore[assignment]

    def _ordered(self, value, test) -> Column:
        n = self._slot[float]
        if n is None or isinstance(value, (str, bool)):
            return F.lit(False)
        return two_valued(test(n, F.lit(value)))

    def __gt__(self, value) -> Column:
        return self._ordered(value, lambda a, b: a > b)

    def __ge__(self, value) -> Column:
        return self._ordered(value, lambda a, b: a >= b)

    def __lt__(self, value) -> Column:
        return self._ordered(value, lambda a, b: a < b)

    def __le__(self, value) -> Column:
        return self._ordered(value, lambda a, b: a <= b)


def field(name: str) -> Field:
    """service, name, status (text) or duration (nanoseconds)."""
    if name not in _FIELDS:
        raise ValueError(f"unknown field {name}: one of {', '.join(_FIELDS)}, or attribute()")
    c = F.col(_FIELDS[name])
    return Field(None, c, None, c.isNotNull()) if name == "duration" else Field(c, None, None, c.isNotNull())


def attribute(key: str) -> Field:
    """An attribute by its whole key, dots included."""
    c = F.try_element_at(F.col("attributes"), F.lit(key))
    return Field(c["s"], c["n"], c["b"], c.isNotNull())

"""Rounding and exact means, as native column expressions (no UDF).

Two roundings are in play for scores:

* ``py_round1``: correctly rounded from the binary value with exact ties to
  even, i.e. what Python's ``round(x, 1)`` returns. Spark's ``round`` (half
  up on the decimal string) and ``bround`` (half even on the decimal string)
  both differ from it on near-ties. The expression below decides the tie by
  the exact sign of ``20x - k``: ``16x`` is exact, ``16x - k`` is exact by
  Sterbenz when ``k`` is the nearest integer to ``20x``, and adding ``4x``
  gives the sign of ``20x - k`` without an intermediate rounding flip.
* ``sql_round1``: half away from zero on the decimal value, as a SQL
  ``ROUND(avg::numeric, 1)`` does.

Means are taken over integer units of 1e-4 so that the result does not depend
on the order Spark sums partitions in, and equals the same text in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 10_000  # scores carry at most four decimals


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_round1(x) -> Column:
    """Python ``round(x, 1)`` for a double column, exactly."""
    x = _c(x)
    k = F.rint(x * 20.0)
    d = (x * 16.0 - k) + x * 4.0
    tenths = (
        F.when(k % 2 == 0, k / 2.0)
        .when(d > 0, (k + 1.0) / 2.0)
        .when(d < 0, (k - 1.0) / 2.0)
        .otherwise(F.rint(k / 4.0) * 2.0)
    )
    return tenths / 10.0


def py_round0(x) -> Column:
    """Python ``round(x)`` to an integer: half to even (``rint``)."""
    return F.rint(_c(x)).cast("bigint")


def py_round1_sql(e: str, rint: str = "rint") -> str:
    """The same rule as SQL text: ``rint="rint"`` for Spark SQL, any other
    value (the oracle passes ``"round_even"``) for DuckDB's
    ``round_even(x, 0)``."""
    r = (lambda v: f"rint({v})") if rint == "rint" else (lambda v: f"round_even({v}, 0)")
    k = r(f"({e}) * 20.0")
    d = f"((({e}) * 16.0 - {k}) + ({e}) * 4.0)"
    return (
        f"((CASE WHEN {k} % 2 = 0 THEN {k} / 2.0 "
        f"WHEN {d} > 0 THEN ({k} + 1.0) / 2.0 "
        f"WHEN {d} < 0 THEN ({k} - 1.0) / 2.0 "
        f"ELSE {r(f'{k} / 4.0')} * 2.0 END) / 10.0)"
    )


def units(x) -> Column:
    """A score as a whole number of 1e-4 units (exact for <= 4 decimals)."""
    return F.round(_c(x) * float(UNITS)).cast("bigint")


def exact_mean(x) -> Column:
    """Mean of a score column, independent of summation order: an exact
    integer sum divided once. Null when the group has no non-null value."""
    return F.sum(units(x)) / (F.count(_c(x)) * float(UNITS))


def sql_round1_mean(x) -> Column:
    """``ROUND(AVG(x)::numeric, 1)``: the decimal mean rounded half away from
    zero to one decimal, computed in integers."""
    s = F.sum(units(x))
    n = F.count(_c(x))
    tenths = F.signum(s) * F.floor((F.abs(s) + n * 500) / (n * 1000))
    return F.when(n > 0, tenths / 10.0)

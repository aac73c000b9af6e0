"""Column builders: missing values, safe ratios, ranks, tiles and gap-aware lags.

NULL is the only missing value.  ``num`` brings NaN, infinities and unparsable text to NULL once, at
the boundary; everything after it may use plain arithmetic with ``ratio``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def num(df: DataFrame, name: str) -> Column:
    """The column as a finite double or NULL, whatever its type."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return finite(F.when(c.rlike(NUMBER), F.trim(c).try_cast("double")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def nothing() -> Column:
    return F.lit(None).cast("double")


def ratio(a: Column, b: Column, positive: bool = True) -> Column:
    """a / b where b is positive (or merely not zero); NULL elsewhere and on overflow."""
    ok = b > 0 if positive else b != 0
    return finite(F.when(ok, a / b))


def both(*flags: Column) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))


def any_of(flags: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def no_nulls(names: Sequence[str]) -> Column:
    return both(*[F.col(f"`{n}`").isNotNull() for n in names])


def lag(value: Column, firm: str, period: str, k: int = 1, consecutive: bool = True) -> Column:
    """The value ``k`` rows earlier of the same firm; across a calendar gap NULL.

    The rule is by rows: with k > 1 an absent year between also makes the lag NULL, which a join on
    period - k would not.
    """
    w = Window.partitionBy(firm).orderBy(period)
    back = F.lag(value, k).over(w)
    if not consecutive:
        return back
    now = F.col(f"`{period}`")
    return F.when(now - F.lag(now, k).over(w) == k, back)


def rank01(value: Column, keys: Sequence[Column]) -> Column:
    """(average rank - 1) / (n - 1) of the non-missing values; one value alone has 0.5."""
    missing = value.isNull()
    every = Window.partitionBy(*keys, missing)
    low = F.rank().over(every.orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, missing, value))
    n = F.count(F.lit(1)).over(every)
    scaled = (low - 1 + (ties - 1) / F.lit(2.0)) / F.nullif(n - 1, F.lit(0))
    return F.when(missing, None).when(n == 1, F.lit(0.5)).otherwise(scaled)


def tile01(scaled: Column, n: int) -> Column:
    """Equal-width tile of a 0-1 rank, itself on 0-1; ``least`` alone would give NULL the top tile."""
    return F.when(scaled.isNotNull(), F.least(F.floor(scaled * n), F.lit(n - 1)) / F.lit(n - 1.0))


def decile_cut(value: Column, keys: Sequence[Column], tie: Sequence[Column]) -> Column:
    """0..9 by ten equal parts of the ranks, ties in the order ``tie``; a single value has none.

    Parts are right-closed and their edges are linear quantiles of the ranks 1..n, found with the same
    interpolation as array libraries use, so ranks on an edge fall alike.
    """
    missing = value.isNull()
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, missing))
    rn = F.row_number().over(Window.partitionBy(*keys, missing).orderBy(value, *tie))

    def edge(k: int) -> Column:
        h = F.lit(k / 10.0) * (n - 1)
        lo = F.floor(h)
        frac = h - lo
        a, b = lo + F.lit(1.0), F.least(lo + 2, n).cast("double")
        return F.when(frac >= 0.5, b - (b - a) * (F.lit(1.0) - frac)).otherwise(a + (b - a) * frac)

    below = sum((F.when(rn > edge(k), 1).otherwise(0) for k in range(1, 10)), F.lit(0))
    return F.when(missing | (n < 2), None).otherwise(below.cast("double"))

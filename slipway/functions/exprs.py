"""ANSI-safe scalar expression helpers (all JVM-side, codegen friendly).

Spark 4 runs with ANSI mode on: ``x/0`` raises and bad casts raise. Every
ratio in the library goes through :func:`ratio`, every day difference
through :func:`frac_days`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86400e6


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """num / den with 0 or NULL denominator -> NULL (pandas replace(0, nan))."""
    return F.try_divide(col(num).cast("double"), F.nullif(col(den).cast("double"), F.lit(0.0)))


def epoch_us(ts) -> Column:
    """Microseconds since the epoch of a (ntz or ltz) timestamp, UTC session."""
    return F.unix_micros(col(ts).cast("timestamp"))


def frac_days(later, earlier) -> Column:
    """(later - earlier) in fractional days, NULL if either side is NULL."""
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(DAY_US)


def add_days(ts, n) -> Column:
    return col(ts) + F.make_dt_interval(col(n).cast("int") if not isinstance(n, int) else F.lit(n))


def add_seconds(ts, n) -> Column:
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col(n))


def day_no(d) -> Column:
    """Integer day number (days since 1970-01-01) of a date or timestamp."""
    return F.datediff(F.to_date(col(d)), F.lit("1970-01-01").cast("date"))


def weekday_mon0(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(col(ts))


def log1p_clip0(x) -> Column:
    """log1p(max(x, 0)) keeping NULL as NULL (``greatest`` skips NULLs)."""
    return F.when(col(x).isNotNull(), F.log1p(F.greatest(col(x).cast("double"), F.lit(0.0))))


def null_safe_flag(cond: Column) -> Column:
    """Boolean -> 0/1 int where NULL counts as 0 (pandas ``==`` on NaN)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def r6(c, digits: int = 6) -> Column:
    """Round a reported double (harness rule: same digits on both sides)."""
    return F.round(col(c).cast("double"), digits)

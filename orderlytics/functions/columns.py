"""Column helpers. All are native Spark expressions, so they stay inside
whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# A product price, as stored.
MONEY = DecimalType(12, 2)
# Any aggregated amount of money (daily sums, running sums, campaign totals).
# Keeping sums at (20, 2) instead of Spark's widening (22,2)/(32,2)/(38,2)
# leaves 18-20 fractional digits in a later division, so ROUND(x, 2) of a
# quotient is exact half-away-from-zero rounding of the true ratio.
MONEY_SUM = DecimalType(20, 2)
COUNT_DEC = DecimalType(20, 0)
# What the metrics return for money and ratios.
AMOUNT = DecimalType(38, 2)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(c: str | Column) -> Column:
    """`ts::DATE` on a zone-less timestamp."""
    return F.to_date(col(c))


def month_start(c: str | Column) -> Column:
    """`DATE_TRUNC('month', d)::DATE`."""
    return F.trunc(col(c), "month")


def day_number(end: str | Column, start: str | Column) -> Column:
    """`date - date` as a whole number of days (Spark's `-` yields an interval)."""
    return F.datediff(col(end), col(start)).cast("bigint")


def iso_dow(c: str | Column) -> Column:
    """ISO day of week, Monday = 1 ... Sunday = 7."""
    return (F.weekday(col(c)) + 1).cast("bigint")


def day_name(c: str | Column, padded: bool = True) -> Column:
    """English day name. ``padded`` reproduces `TO_CHAR(t, 'Day')`, which
    blank-pads to the longest name (9 characters)."""
    name = F.date_format(col(c), "EEEE")
    return F.rpad(name, 9, " ") if padded else name


def label(prefix: str, c: str | Column) -> Column:
    """`CONCAT(prefix, x)`: a NULL argument is treated as empty, as in SQL CONCAT."""
    return F.concat(F.lit(prefix), F.coalesce(col(c).cast("string"), F.lit("")))


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY_SUM)


def money_total(c: str | Column) -> Column:
    """SUM of money, returned as MONEY_SUM. A value with more than 2 decimals is an
    error: it would be cut off.

    The sum runs over exact integer cents in a BIGINT accumulator: Spark would
    sum DECIMAL(12,2) into DECIMAL(22,2), which is past 18 digits and leaves
    the long-backed fast path for BigDecimal arithmetic. ANSI mode turns an
    overflow (beyond 9.2e16 in currency units) into an error, never a wrap."""
    hundredfold = col(c) * F.lit(100)
    cents = hundredfold.cast("bigint")
    cents = F.when(cents == hundredfold, cents).when(hundredfold.isNotNull(), F.raise_error(
        F.concat(F.lit("money with more than 2 decimals: "), col(c).cast("string"))))
    return (F.sum(cents).cast(COUNT_DEC) / F.lit(100)).cast(MONEY_SUM)


def round2(c: str | Column) -> Column:
    """ROUND(x, 2) on a decimal: half away from zero, like SQL ROUND on numeric."""
    return F.round(col(c), 2)


def ratio(num: str | Column, den: str | Column, scale: int = 2) -> Column:
    """ROUND(num / den, scale) in exact decimal arithmetic. A zero or NULL
    denominator gives NULL instead of an error."""
    n = col(num).cast(MONEY_SUM)
    d = col(den).cast(MONEY_SUM)
    return F.round(F.try_divide(n, d), scale)


def percent(num: str | Column, den: str | Column) -> Column:
    """ROUND(num / den * 100, 2), multiplying before dividing so no digit is lost."""
    return ratio(col(num).cast(MONEY_SUM) * F.lit(100), den)


def amount(c: str | Column) -> Column:
    """Final type of money and ratios (applied after rounding): exact."""
    return col(c).cast(AMOUNT)


def out_num(c: str | Column) -> Column:
    """Money or a ratio as DOUBLE, for consumers without decimals."""
    return col(c).cast("double")

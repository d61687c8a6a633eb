"""Dates, months and the circular day-of-year."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOY_CYCLE = 366


def circular_doy(day_of_year: Column, shift, cycle: int = DOY_CYCLE) -> Column:
    """Day-of-year moved by ``shift`` days on a ring of 1..cycle."""
    return F.pmod(day_of_year - 1 + shift, F.lit(cycle)) + 1


def period(day: Column) -> Column:
    """'YYYY-MM' of a date."""
    return F.date_format(day, "yyyy-MM")


def period_start(p: Column) -> Column:
    """First day of a 'YYYY-MM' period."""
    return F.to_date(F.concat(p, F.lit("-01")), "yyyy-MM-dd")


def shift_period(p: Column, months: int) -> Column:
    return period(F.add_months(period_start(p), months))


def period_month(p: Column) -> Column:
    return F.substring(p, 6, 2).cast("int")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def plus_years(day: Column, years: int) -> Column:
    """Same calendar day ``years`` later; 29 February falls back to the 28th."""
    return F.add_months(day, 12 * years)


def doy_month(day_of_year: Column) -> Column:
    """Month of a day-of-year counted in a common year.

    Day 366 therefore lands in January, and days after February of a leap year
    are one off; the monthly climatology is defined this way.
    """
    return F.month(F.date_add(F.lit(date(2001, 1, 1)), day_of_year - 1))


def year_chunks(df: DataFrame, start: str, end: str, years: int) -> DataFrame:
    """Split each row's inclusive [start, end] into consecutive n-year chunks.

    Once the 29th of February has been clamped, later chunks keep the 28th.
    """
    step = F.make_interval(years=F.lit(years))
    second = plus_years(F.col(start), years)
    starts = F.when(
        second <= F.col(end),
        F.concat(F.array(F.col(start)), F.sequence(second, F.col(end), step)),
    ).otherwise(F.array(F.col(start)))
    return (
        df.filter(F.col(start) <= F.col(end))
        .withColumn("chunk_start", F.explode(starts))
        .withColumn(
            "chunk_end",
            F.least(F.date_sub(plus_years(F.col("chunk_start"), years), 1), F.col(end)),
        )
    )


# Days covered by the named look-back windows, both ends included.
LOOKBACK_DAYS = {"1m": 30, "3m": 90, "6m": 182, "1y": 365}
# Widest span, in days, that is still shown under each name.
SPAN_LIMITS = {"1m": 31, "3m": 95, "6m": 190, "1y": 370}


def lookback_start(key: Column, last: Column, data_start: date) -> Column:
    """First day of a named window that ends on ``last``."""
    out = F.lit(data_start)
    for name, days in LOOKBACK_DAYS.items():
        out = F.when(key == name, F.date_sub(last, days - 1)).otherwise(out)
    return out


def span_name(start: Column, end: Column) -> Column:
    """Name of the look-back window that best matches a span."""
    span = F.datediff(end, start)
    out = F.lit("all")
    for name, limit in sorted(SPAN_LIMITS.items(), key=lambda kv: -kv[1]):
        out = F.when(span <= limit, F.lit(name)).otherwise(out)
    return out

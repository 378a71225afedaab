"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jalali(date: Column) -> Column:
    """Year, month and day of the Solar Hijri calendar as 'y-mm-dd', by its 33-year cycle of 12,053 days."""
    day = F.date_diff(date, F.lit("0622-03-21").cast("date")).cast("long")  # days since the first of Farvardin, year 1
    cycle, rest = F.floor(day / 12053), F.pmod(day, F.lit(12053))
    # in a cycle, leap years are the 1st, 5th, 9th, 13th, 17th, 22nd, 26th and 30th
    starts, total = [], 0
    for y in range(33):
        starts.append(total)
        total += 366 if y + 1 in (1, 5, 9, 13, 17, 22, 26, 30) else 365
    year = F.lit(0)
    for y, s in enumerate(starts):
        year = F.when(rest >= s, F.lit(y)).otherwise(year)
    first = F.lit(0)
    for s in starts:
        first = F.when(rest >= s, F.lit(s)).otherwise(first)
    n = rest - first
    month = F.when(n < 186, F.floor(n / 31) + 1).otherwise(F.floor((n - 186) / 30) + 7)
    dom = F.when(n < 186, n % 31 + 1).otherwise((n - 186) % 30 + 1)
    return F.format_string("%d-%02d-%02d", (cycle * 33 + year + 1).cast("long"), month.cast("long"), dom.cast("long"))


def local_day(ts: Column, zone: str = "Asia/Tehran") -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))

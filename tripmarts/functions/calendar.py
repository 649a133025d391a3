"""Recurring-date rules over a table of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    """n-th given weekday of a month, e.g. the 4th Thursday of November."""
    first = F.make_date(year.cast("int"), F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))


def last_weekday(year: Column, month: int, weekday: str) -> Column:
    end = F.last_day(F.make_date(year.cast("int"), F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), weekday)


def recurring_dates(years: DataFrame, year: str = "year") -> DataFrame:
    """Recurring street closures and sports days of each year: (year, kind, start_hour, date), one row per day."""
    y = F.col(year).cast("int")

    def fixed(month: int, day: int) -> Column:
        return F.make_date(y, F.lit(month), F.lit(day))

    parade = nth_weekday(y, 11, "THU", 4)
    rules = [
        ("thanksgiving_parade", 9, F.array(parade)),
        ("balloon_inflation", 18, F.array(F.date_sub(parade, 1))),
        ("st_patricks_parade", 11, F.array(fixed(3, 17))),
        ("new_year_eve", 18, F.array(fixed(12, 31))),
        ("pride_march", 12, F.array(last_weekday(y, 6, "SUN"))),
        ("marathon", 8, F.array(nth_weekday(y, 11, "SUN", 1))),
        ("tennis_open", 11, F.sequence(fixed(8, 28), F.date_add(fixed(8, 28), 13), F.expr("interval 1 day"))),
    ]
    table = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(hour).alias("start_hour"), days.alias("days"))
                      for kind, hour, days in rules])
    return (years.select(y.alias("year"), F.explode(table).alias("r"))
            .select("year", "r.kind", "r.start_hour", F.explode("r.days").alias("date")))


def local_time(utc: Column, zone: str = "America/New_York") -> Column:
    """Wall-clock time (no zone) of a UTC wall-clock timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))

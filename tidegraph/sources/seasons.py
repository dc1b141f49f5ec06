"""Daily observations to seasons of a fixed number of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a season; position in the calendar year at which a season begins.
DAYS, START = 365, 212


def season_of(date: Column) -> tuple[Column, Column]:
    """(year, day): positional.  The first DAYS days of a calendar year count, those from START on open a season, earlier ones end the last; the 366th day is in none (null)."""
    at = F.dayofyear(date) - 1
    opens = at >= START
    year = F.when(at < DAYS, F.when(opens, F.year(date)).otherwise(F.year(date) - 1))
    return year, F.when(at < DAYS, F.when(opens, at - START).otherwise(at + DAYS - START))


def season_days(rows: DataFrame, key: str, date: str, value: str, first: int, years: int) -> DataFrame:
    """(pixel, year, day, v): sums of value by key and day in seasons first to first + years - 1, counted from 0.  Null keys and dates go; a null value is no observation."""
    year, day = season_of(F.col(date))
    rows = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("pixel"), (year - first).cast("int").alias("year"), day.cast("int").alias("day"), F.col(value).cast("double").alias("v"))
    return rows.filter(F.col("year").between(0, years - 1)).groupBy("pixel", "year", "day").agg(F.sum("v").alias("v"))


def curves(days: DataFrame, years: int, length: int = DAYS) -> DataFrame:
    """(pixel, year, s array<double>): a row for each pixel and year, days without a row 0.

    One shuffle: the spine of each pixel joins its days where they are, by (pixel, year).
    """
    spine = days.select("pixel").distinct().select("pixel", F.explode(F.sequence(F.lit(0), F.lit(years - 1))).alias("year"))
    spine = spine.select("pixel", "year", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("day"), F.lit(0.0).alias("v"))
    every = days.select("pixel", "year", "day", F.coalesce("v", F.lit(0.0)).alias("v")).unionByName(spine).repartition("pixel", "year")
    dense = every.groupBy("pixel", "year", "day").agg(F.sum("v").alias("v"))
    return dense.groupBy("pixel", "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda x: x["v"]).alias("s"))


def crop(cells: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Rows of ``cells(lat, lon, ...)`` inside inclusive bounds."""
    return cells.filter(F.col("lat").between(*lat) & F.col("lon").between(*lon))

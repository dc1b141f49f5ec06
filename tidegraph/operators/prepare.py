"""Selection and preparation of curves: masks, duplicate contraction, aggregates, subsets of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled


def active_days(days: DataFrame, years: int, threshold: float = 0.5) -> DataFrame:
    """(pixel, active_days): mean over all years of the days above threshold; a missing value is not above."""
    hits = days.groupBy("pixel").agg(F.count_if(F.coalesce(F.col("v") > threshold, F.lit(False))).alias("n"))
    return hits.select("pixel", (F.col("n") / years).alias("active_days"))


def mask(days: DataFrame, years: int, least: float = 60, threshold: float = 0.5) -> DataFrame:
    return active_days(days, years, threshold).filter(F.col("active_days") >= least)


def contract(curves: DataFrame) -> DataFrame:
    """(pixel, vertex, rep): pixels with equal curves in every year share a vertex, numbered in the order of its first pixel.

    Curves meet by a 256-bit digest of the whole series, not as arrays.
    """
    text = F.concat_ws(";", F.transform("s", lambda x: (x + 0.0).cast("string")))
    year = curves.select("pixel", F.struct("year", F.sha2(text, 256).alias("h")).alias("y"))
    whole = year.groupBy("pixel").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("y"))), 256).alias("h"))
    first = whole.groupBy("h").agg(F.min("pixel").alias("rep"))
    numbered = number(first.select("rep", "h"), "rep", "vertex")
    return whole.join(numbered, "h").select("pixel", "vertex", "rep")


def number(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with ranks 0, 1, ... of a distinct key in name: counts of ranges first, then positions inside each, so that no task holds all rows."""
    ranged = df.repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    ranged = settled(ranged)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.withColumn("_at", inside).join(F.broadcast(counts), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def vertex_mean(values: DataFrame, pix2v: DataFrame) -> DataFrame:
    """(vertex, v): mean of ``values(pixel, v)``; missing values don't count, all missing is null."""
    return values.join(pix2v.select("pixel", "vertex"), "pixel").groupBy("vertex").agg(F.avg("v").alias("v"))


def duplicate_columns(pix2v: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct smallest longitudes of vertices of several pixels."""
    many = pix2v.join(places, "pixel").groupBy("vertex").agg(F.count(F.lit(1)).alias("n"), F.min("lon").alias("lon"))
    return many.filter("n > 1").select("lon").distinct()


def climatology(curves: DataFrame) -> DataFrame:
    """(pixel, day, v): mean over years."""
    return curves.select("pixel", F.posexplode("s").alias("day", "x")).groupBy("pixel", "day").agg(F.avg("x").alias("v"))


def band(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return rows.filter(F.col(column).between(low, high) & ~F.isnan(F.col(column).cast("double")))


def season_name(first: int, year: str = "year") -> Column:
    y = F.col(year) + first
    return F.format_string("%d/%02d", y, F.pmod(y + 1, F.lit(100)))


#: First halves of the five random splits of 14 years.
SPLITS = ((0, 2, 3, 4, 5, 7, 13), (1, 2, 4, 5, 10, 11, 12), (4, 6, 7, 8, 9, 12, 13), (2, 3, 4, 6, 7, 8, 11), (0, 4, 5, 7, 8, 10, 11))


def year_subsets(years: DataFrame, n: int = 14, switch: int = 8) -> DataFrame:
    """(subset, year): all, pre and post the switch, and the halves a and b of each split, of ``years(year)``."""
    y = F.col("year")
    rules = {"all": F.lit(True), "pre": y < switch, "post": y >= switch}
    for i, half in enumerate(SPLITS):
        own = y.isin([k for k in half if k < n])
        rules |= {f"split{i}a": own, f"split{i}b": ~own}
    names = F.array(*(F.when(r, F.lit(k)) for k, r in rules.items()))
    return years.select("year").distinct().select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("subset"), "year")

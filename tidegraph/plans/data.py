"""The library's inputs, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distance
from ..sources import seasons
from ..sources.tables import table

FIRST, YEARS = 1995, 6


def days(spark: SparkSession, sf: str, key: str = "l_suppkey") -> DataFrame:
    """Daily delivered quantity of each supplier."""
    return seasons.season_days(table(spark, sf, "lineitem"), key, "l_shipdate", "l_quantity", FIRST, YEARS)


def curves(spark: SparkSession, sf: str) -> DataFrame:
    return seasons.curves(days(spark, sf), YEARS)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def shares(spark: SparkSession, sf: str) -> DataFrame:
    return distance.as_distributions(points(spark, sf))


def labels(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % k).cast("long").alias("lab"))


def places(ids: DataFrame) -> DataFrame:
    """A place on a grid of 25 columns for each of ids(id), with an elevation and a number of active days."""
    i = F.col("id")
    r, c = F.floor(i / 25), i % 25
    return ids.select("id", r.alias("r"), c.alias("c"), (40 - 0.25 * r).alias("lat"), (73 + 0.25 * c).alias("lon"), (3000.0 + i * 7919 % 3001).alias("elev"), (60.0 + i * 31 % 211).alias("active_days"))

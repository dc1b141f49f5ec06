"""Tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import features


def paint(values: DataFrame, pix2v: DataFrame, places: DataFrame) -> DataFrame:
    """(r, c, v): each pixel with its vertex's value."""
    return pix2v.join(values, "vertex").join(places, "pixel").select("r", "c", "v")


def mark_places(points: DataFrame) -> DataFrame:
    return points.groupBy("region").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def scaled_slopes(means: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """(pixel, lag, cell, bin, v): soft histograms of mean curves ``means(pixel, day, v)`` at each lag, over the greatest value of the lag."""
    curves = means.groupBy("pixel").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda x: x["v"]).alias("s"))
    h = features.soft_histogram(features.lag_rates(curves, lags), ["pixel", "lag"])
    most = F.max("h").over(Window.partitionBy("pixel", "lag"))
    return h.select("pixel", "lag", "cell", "bin", (F.col("h") / F.greatest(most, F.lit(1e-9))).alias("v"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins from low to high, both ends included; bins without rows are not there."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return rows.filter(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_between_ends(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n): equal bins from the least to the greatest value of column; bins without rows are not there, and equal values are all in bin 0."""
    ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    b = F.floor((F.col(column) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins)
    b = F.least(F.coalesce(b, F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of ends


def degree_histogram(degrees: DataFrame, step: int = 2) -> DataFrame:
    """(low, n): vertices of each step of degrees from the least one on."""
    least = degrees.agg(F.min("degree").alias("least"))
    low = F.col("degree") - F.pmod(F.col("degree") - F.col("least"), F.lit(step))
    return degrees.crossJoin(F.broadcast(least)).groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n"))


def clustering_summary(degrees: DataFrame) -> DataFrame:
    """One row of ``degrees(id, degree, cc)``: quantiles and mean of cc, and the clustering of a random graph of as many edges."""
    q = [F.percentile("cc", F.lit(p)).alias(name) for name, p in (("cc_q05", 0.05), ("cc_median", 0.5), ("cc_q95", 0.95))]
    return degrees.agg(*q, F.avg("cc").alias("cc_mean"), (F.avg("degree") / (F.count(F.lit(1)) - 1)).alias("random_graph_cc"))


def sample_pairs(pairs: DataFrame, vertices: DataFrame, step: int = 50) -> DataFrame:
    """Rows of ``pairs(i, j, d)``, i < j, at every step-th place in the order of (i, j), among all pairs of vertices(id): the place follows from the ends' numbers, without a sort of pairs."""
    from .prepare import number

    no = number(vertices.select("id"), "id", "no")
    n = no.agg(F.count(F.lit(1)).alias("n"))
    a, b = no.select(F.col("id").alias("i"), F.col("no").alias("p")), no.select(F.col("id").alias("j"), F.col("no").alias("q"))
    p, q = F.col("p"), F.col("q")
    place = p * F.col("n") - F.expr("p * (p + 1) div 2") + q - p - 1
    return pairs.join(a, "i").join(b, "j").crossJoin(F.broadcast(n)).withColumn("place", place.cast("long")).filter(F.col("place") % step == 0).select("i", "j", "d", "place")


def every_third(order: DataFrame, step: int = 3) -> DataFrame:
    """(id, place): vertices of ``order(id, lab, lon)`` by region and longitude, every step-th, numbered."""
    from .prepare import number

    keyed = order.select("id", F.struct("lab", "lon", "id").alias("k"))
    return number(keyed, "k", "n").filter(F.col("n") % step == 0).select("id", (F.col("n") / step).cast("long").alias("place"))


def ccdf(degrees: DataFrame) -> DataFrame:
    """(degree, share): share of vertices from the first of each degree on."""
    n = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("degree").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # a row for each degree
    return n.select("degree", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("share"))


def edge_darkness(edges: DataFrame) -> DataFrame:
    """edges(i, j, d) with dark: d over its 98 % quantile, 1 at most."""
    q = edges.agg(F.percentile("d", F.lit(0.98)).alias("q"))
    return edges.crossJoin(F.broadcast(q)).withColumn("dark", F.least(F.col("d") / F.col("q"), F.lit(1.0))).drop("q")


def colour_limits(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.percentile(column, F.lit(0.02)).alias("low"), F.percentile(column, F.lit(0.98)).alias("high"))

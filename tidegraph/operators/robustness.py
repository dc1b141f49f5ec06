"""Graphs by year and by variant, and the comparison of features: every graph is a value of the column ``run``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled
from . import cluster, distance, features, graph, spatial, spectral


def of_run(rows: DataFrame) -> DataFrame:
    """Rows of a feature of pixels of several runs, (pixel, f, v), as points (run, id, v)."""
    pts = features.vectors(rows.filter("v is not null"))
    return pts.select(F.shiftright("id", features.RUN_BITS).alias("run"), F.col("id").bitwiseAND(F.lit((1 << features.RUN_BITS) - 1)).alias("id"), "v")


class Partition:
    """Graphs and partitions of all runs of ``points(run, id, v, metric)`` side by side: neighbours, weights with fallback, Laplacian, spectral clusters named west to east.

    Runs of too few points for k_scale neighbours and the regions have no partition.
    """

    def __init__(self, points: DataFrame, places: DataFrame, k: int, regions: int, k_scale: int = 7):
        points = settled(points)
        sizes = points.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(k_scale, regions + 1))
        self.sizes = settled(sizes)
        points = points.join(F.broadcast(self.sizes.select("run")), "run")  # a row for each run
        self.nbrs = settled(distance.top_k_of_runs(points, max(k, k_scale)))
        self.edges = settled(graph.knn_edges(self.nbrs, k))
        weights = spectral.gaussian_weights(self.edges, self.nbrs, k_scale, fallback=True)
        self.vectors = settled(spectral.spectra(spectral.laplacian(weights), max(regions, 5)))
        lab = cluster.spectral_clusters(self.vectors, regions).select("run", "id", "lab")
        self.labels = settled(cluster.name_regions(lab, places))

    def eigenvalue(self, idx: int) -> DataFrame:
        return self.vectors.filter(F.col("idx") == idx).groupBy("run").agg(F.first("lambda").alias(f"lam{idx + 1}"))


def main_and_years(main: DataFrame, yearly: DataFrame, places: DataFrame, k: int, regions: int) -> tuple[DataFrame, DataFrame]:
    """((id, lab) of points main(id, v), (year, id, lab, lam2) of ``yearly(pixel, year, f, v, active)`` matched to it): a graph for each year, all at once; vertices not active in a year have no label in it."""
    rows = yearly.filter("active").select(features.in_run(F.col("year") + 1, F.col("pixel")).alias("pixel"), "f", "v")
    points = main.select(F.lit(0).cast("long").alias("run"), "id", "v").unionByName(of_run(rows)).withColumn("metric", F.lit("hellinger"))
    found = Partition(points, places, k, regions)
    ref = found.labels.filter("run = 0").select("id", F.col("lab").alias("ref"))
    new = cluster.match_labels(found.labels.filter("run > 0").join(ref, "id"), regions)
    years = new.join(found.eigenvalue(1), "run").select((F.col("run") - 1).cast("int").alias("year"), "id", "lab", "lam2")
    return ref.withColumnRenamed("ref", "lab"), years


def kept(yearly: DataFrame, main: DataFrame) -> DataFrame:
    """(id, kept): years with the main label; a year without a label isn't one."""
    hit = yearly.select("id", F.col("lab").alias("own")).join(main, "id").groupBy("id").agg(F.sum((F.col("own") == F.col("lab")).cast("long")).alias("kept"))
    return main.join(hit, "id", "left").select("id", "lab", F.coalesce("kept", F.lit(0)).alias("kept"))


def stability(kept_rows: DataFrame, core: int = 12, transition: int = 7) -> DataFrame:
    """(lab, core, transition), lab null for all: shares of vertices kept at least, and at most, so many years."""
    k = F.col("kept")
    return kept_rows.rollup("lab").agg(F.avg((k >= core).cast("double")).alias("core"), F.avg((k <= transition).cast("double")).alias("transition"))


def inactive_by_year(active: DataFrame) -> DataFrame:
    """(year, inactive) of ``active(pixel, year, active)``."""
    return active.groupBy("year").agg(F.count_if(~F.col("active")).alias("inactive"))


def before_after(by_year: DataFrame, columns: list[str], switch: int) -> DataFrame:
    """One row: means of columns before and from year switch on."""
    y = F.col("year")
    return by_year.agg(*(F.avg(F.when(y < switch, F.col(c))).alias(f"{c}_before") for c in columns), *(F.avg(F.when(y >= switch, F.col(c))).alias(f"{c}_after") for c in columns))


def variants(curves: DataFrame, places: DataFrame, k: int, regions: int, lags: tuple[int, ...], kinds: list[tuple[str, int, DataFrame | None]]) -> DataFrame:
    """(variant, cells, n, agreement, contiguity, lam2) of graphs rebuilt with other cells, or from some pixels only: kinds are (name, cells, pixels or None for all), the first one is the reference."""
    points = None
    for run, (_, cells, some) in enumerate(kinds):
        own = curves if some is None else curves.join(some, "pixel", "left_semi")
        one = features.vectors(features.multiscale_hog(own, lags, cells=cells)).select(F.lit(run).cast("long").alias("run"), "id", "v")
        points = one if points is None else points.unionByName(one)
    found = Partition(points.withColumn("metric", F.lit("hellinger")), places, k, regions)
    ref = found.labels.filter("run = 0").select("id", F.col("lab").alias("ref"))
    own = found.labels.filter("run > 0")
    out = cluster.agreement(own.join(ref, "id"), regions)
    out = out.join(spatial.contiguity(spatial.grid_edges(places.select("id", "r", "c")), own).drop("chance"), "run", "left").join(found.eigenvalue(1), "run").join(found.sizes, "run")
    names = curves.sparkSession.createDataFrame([(i, name, cells) for i, (name, cells, _) in enumerate(kinds)], "run long, variant string, cells int")
    return out.join(F.broadcast(names), "run").select("variant", "cells", "n", "agreement", "contiguity", "lam2")  # a row for each kind


def compare(curves: DataFrame, places: DataFrame, methods: list[str], subsets: DataFrame, k: int, regions: int, band: tuple[float, float], main: str = "hog_smoothed") -> DataFrame:
    """A row for each method: scores of its graph over all years, and how well partitions and neighbours of halves and of the two eras agree.

    Every method with every subset of ``subsets(subset, year)`` is a run, and all runs go
    through one set of jobs.  n, contiguity, climate, eta2, cc_median and lam2 are of subset all; split, split_sd and
    split_nn are of the halves, era and era_nn of pre and post; vs_main is the adjusted
    Rand index against the method main.
    """
    spark = curves.sparkSession
    names = sorted(r["subset"] for r in subsets.select("subset").distinct().collect())  # a few names
    runs = [(m * len(names) + n, method, name) for m, method in enumerate(methods) for n, name in enumerate(names)]
    table = spark.createDataFrame(runs, "run long, method string, subset string")
    of_subset = F.broadcast(subsets.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), "no long, subset string")), "subset"))  # years of a few subsets
    many = settled(curves.join(of_subset, "year").select(features.in_run(F.col("no"), F.col("pixel")).alias("pixel"), "year", "s"))
    points = None
    for m, method in enumerate(methods):
        fn, metric = features.METHODS[method]
        one = of_run(fn(many)).select((F.col("run") + m * len(names)).alias("run"), "id", "v", F.lit(metric).alias("metric"))
        points = one if points is None else points.unionByName(one)
    found = Partition(points, places, k, regions)
    whole = F.broadcast(table.filter("subset = 'all'"))
    lab = settled(found.labels.join(F.broadcast(table), "run"))
    own = lab.filter("subset = 'all'").select("run", "id", "lab")
    out = whole.join(found.sizes, "run")
    out = out.join(spatial.contiguity(spatial.grid_edges(places.select("id", "r", "c")), own).drop("chance"), "run", "left")
    out = out.join(spatial.eta_squared(own, places.select("id", F.col("elev").alias("x"))), "run", "left")
    vector = found.vectors.filter("idx = 1").join(whole.select("run"), "run").select("run", "id", "x")
    out = out.join(spatial.climate_score(vector, places, *band), "run", "left").join(found.eigenvalue(1), "run")
    inside = features.in_run(F.col("run"), F.col("id"))
    mine = found.edges.join(whole.select("run"), "run").select(features.in_run(F.col("run"), F.col("src")).alias("src"), features.in_run(F.col("run"), F.col("dst")).alias("dst"))
    cc = graph.degree_clustering(own.select(inside.alias("id")), mine)
    out = out.join(cc.groupBy(F.shiftright("id", features.RUN_BITS).alias("run")).agg(F.percentile("cc", F.lit(0.5)).alias("cc_median")), "run", "left")
    out = out.drop("subset", "run")

    def paired(rows: DataFrame, column: str, left: str, right: str, as_: tuple[str, str]) -> DataFrame:
        a, b = (rows.filter(F.col("subset") == x).select("method", "id", F.col(column).alias(y)) for x, y in zip((left, right), as_, strict=True))
        return a.join(b, ["method", "id"])

    halves = [(n, n[:-1] + "b") for n in names if n.startswith("split") and n.endswith("a")]
    both = [*halves, ("pre", "post")]
    of_method = spark.createDataFrame(list(enumerate(methods)), "m long, method string")
    labels_of, nbrs_of = None, None
    near = found.nbrs.join(F.broadcast(table), "run").join(F.broadcast(of_method), "method")
    for p, (x, y) in enumerate(both):
        pair = paired(lab, "lab", x, y, ("a", "b")).join(F.broadcast(of_method), "method").select((F.col("m") * len(both) + p).alias("run"), "a", "b")
        sides = [near.filter(F.col("subset") == z).select((F.col("m") * len(both) + p).alias("run"), "i", "j", "rank", F.lit(z == x).alias("left")) for z in (x, y)]
        labels_of = pair if labels_of is None else labels_of.unionByName(pair)
        nbrs_of = sides[0].unionByName(sides[1]) if nbrs_of is None else nbrs_of.unionByName(sides[0]).unionByName(sides[1])
    scores = cluster.ari(labels_of).join(graph.overlap(*(nbrs_of.filter(F.col("left") == side).drop("left") for side in (True, False)), k), "run")
    scores = scores.withColumn("m", F.expr(f"run div {len(both)}")).withColumn("era_pair", F.col("run") % len(both) == len(halves))
    e = F.col("era_pair")
    scores = scores.groupBy("m").agg(F.avg(F.when(~e, F.col("ari"))).alias("split"), F.stddev_pop(F.when(~e, F.col("ari"))).alias("split_sd"), F.avg(F.when(~e, F.col("overlap"))).alias("split_nn"), F.max(F.when(e, F.col("ari"))).alias("era"), F.max(F.when(e, F.col("overlap"))).alias("era_nn"))
    out = out.join(of_method, "method").join(scores, "m", "left")
    ref = own.join(whole, "run").filter(F.col("method") == main).select("id", F.col("lab").alias("b"))
    versus = cluster.ari(own.withColumnRenamed("lab", "a").join(ref, "id").select("run", "a", "b")).join(whole, "run").select("method", F.col("ari").alias("vs_main"))
    return out.join(versus, "method", "left").drop("m")

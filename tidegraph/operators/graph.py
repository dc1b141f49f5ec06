"""Neighbour graphs and their measures.  Neighbours are ``nbrs(i, j, d, rank)``; edges are (src, dst), both directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import haversine_km
from ..sources.tables import settled
from .prepare import number


def knn_edges(nbrs: DataFrame, k: int) -> DataFrame:
    """An edge if either end is among the other's k nearest; for each run if there is a column ``run``."""
    keys = ["run"] if "run" in nbrs.columns else []
    near = nbrs.filter(F.col("rank") <= k)
    return near.select(*keys, F.col("i").alias("src"), F.col("j").alias("dst")).union(near.select(*keys, "j", "i")).distinct()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest vertex that each one of ``vertices(id)`` reaches; grouped runs in parallel if both tables have a column ``run``.

    Contraction: in an order by hash every vertex takes the first one among itself and its
    neighbours, and what that took, three times over; edges are rewritten to these, and
    those inside one go.  A graph shrinks by a constant factor a round, whatever its ids.
    """
    keys = ["run"] if "run" in edges.columns and "run" in vertices.columns else []
    hashed = lambda c: F.struct(F.xxhash64(c), F.col(c))
    edges = edges.select(*keys, F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst")
    edges = settled(edges.union(edges.select(*keys, "dst", "src")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        first = edges.groupBy(*keys, F.col("src").alias("id")).agg(F.min(hashed("dst")).alias("x"))
        first = settled(first.select(*keys, "id", F.when(hashed("id") < F.col("x"), F.col("id")).otherwise(F.col("x.dst")).alias("up")))
        above = first.select(*keys, F.col("id").alias("up"), F.col("up").alias("top"))
        step = first
        for _ in range(3):
            step = step.join(above, [*keys, "up"]).select(*keys, "id", F.col("top").alias("up"))
        level = settled(step)
        levels.append(level)
        left, right = (level.select(*keys, F.col("id").alias(c), F.col("up").alias(f"r{c}")) for c in ("src", "dst"))
        edges = edges.join(left, [*keys, "src"]).join(right, [*keys, "dst"]).filter("rsrc <> rdst").select(*keys, F.col("rsrc").alias("src"), F.col("rdst").alias("dst"))
        edges = settled(edges.distinct())
    label = vertices.select(*keys, F.col("id").cast("long"), F.col("id").cast("long").alias("up"))
    for level in levels:
        further = level.select(*keys, F.col("id").alias("up"), F.col("up").alias("top"))
        label = label.join(further, [*keys, "up"], "left").select(*keys, "id", F.coalesce("top", "up").alias("up"))
    label = settled(label)
    least = label.groupBy(*keys, "up").agg(F.min("id").alias("comp"))
    return label.join(least, [*keys, "up"]).select(*keys, "id", "comp")


def component_numbers(label: DataFrame) -> DataFrame:
    """(id, label): components numbered from 0 by their smallest vertex."""
    roots = label.filter("id = comp").select("comp")
    return label.join(number(roots, "comp", "label"), "comp").select("id", "label")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, least), u < v, of ``edges(src, dst, least)``, both directions: a forest of least weights; for each k its edges up to k connect what all edges up to k connect.

    Boruvka's rounds: every tree picks its least edge to another one, ties by the ends, so
    that no circle closes; what is picked is contracted, and between two trees the least
    edge stays.  Trees at least halve in number each round.
    """
    live = settled(edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("least", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).alias("e")))
    picked: list[DataFrame] = []
    while True:
        pick = settled(live.groupBy("a").agg(F.min(F.struct("e", "b")).alias("x")).select(F.col("a").alias("id"), F.col("x.b").alias("up"), F.col("x.e").alias("e")))
        if pick.isEmpty():
            break
        picked.append(pick.select("e.u", "e.v", "e.least"))
        other = pick.select(F.col("id").alias("up"), F.col("up").alias("back"))
        # two that picked each other are a root: the smaller one
        root = settled(pick.join(other, "up").select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("up")), F.col("id")).otherwise(F.col("up")).alias("up")))
        while True:
            above = root.select(F.col("id").alias("up"), F.col("up").alias("top"))
            step = root.withColumn("was", F.col("up"))
            for _ in range(3):
                step = step.join(above, "up").select("id", F.col("up").alias("was"), F.col("top").alias("up"))
            step = settled(step)
            root = step.select("id", "up")
            if step.filter("was <> up").isEmpty():
                break
        left, right = root.select(F.col("id").alias("a"), F.col("up").alias("ra")), root.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        live = live.join(left, "a").join(right, "b").filter("ra <> rb").groupBy(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(F.min("e").alias("e"))
        live = settled(live)
    return settled(reduce(DataFrame.union, picked).distinct()) if picked else edges.limit(0).select(F.col("src").alias("u"), F.col("dst").alias("v"), "least")


def components_by_k(vertices: DataFrame, nbrs: DataFrame, ks: list[int]) -> DataFrame:
    """(run, id, comp) of the graphs of all k in ks: cuts of one spanning forest, with the least k of an edge as its weight.

    Components change at the weights of the forest only; those of another k are the ones
    of the last such weight before it.
    """
    forest = spanning_forest(least_k(nbrs).filter(F.col("least") <= max(ks)))
    levels = sorted(r["least"] for r in forest.select("least").distinct().collect())  # at most as many as there are k
    starts = sorted({0, *levels})
    each = F.explode(F.array(*(F.lit(k) for k in starts))).alias("run")
    own = forest.select(each, "u", "v", "least").filter("least <= run")
    label = components(vertices.select(each, "id"), own.select("run", F.col("u").alias("src"), F.col("v").alias("dst")).union(own.select("run", "v", "u")))
    of = [(k, max(x for x in starts if x <= k)) for k in ks]
    table = F.broadcast(vertices.sparkSession.createDataFrame(of, "k int, run int"))  # a row for each k
    return label.join(table, "run").select(F.col("k").alias("run"), "id", "comp")


def least_k(nbrs: DataFrame) -> DataFrame:
    """(src, dst, least): each edge, and the least k whose graph has it."""
    near = nbrs.select(F.col("i").alias("src"), F.col("j").alias("dst"), "rank")
    return near.union(near.select("dst", "src", "rank")).groupBy("src", "dst").agg(F.min("rank").alias("least"))


def component_counts(by_k: DataFrame) -> DataFrame:
    return by_k.groupBy(F.col("run").alias("k")).agg(F.countDistinct("comp").alias("n_comp"))


def first_connected(counts: DataFrame, strict: bool = False) -> int:
    """The least k with one component; without any the least k there is, or an error if strict."""
    row = counts.agg(F.min(F.when(F.col("n_comp") == 1, F.col("k"))).alias("k"), F.min("k").alias("least")).first()
    if row["k"] is None and strict:
        raise ValueError("no k connects the graph")
    return row["k"] if row["k"] is not None else row["least"]


def small_components(by_k: DataFrame, places: DataFrame, east: float = 90.0) -> DataFrame:
    """For each k with several components what lies outside the largest: counts, sizes, longitudes and medians of ``places(id, lon, elev, active_days)``."""
    by_k = settled(by_k)
    sizes = settled(by_k.groupBy("run", "comp").agg(F.count(F.lit(1)).alias("n")))
    giant = sizes.groupBy("run").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("giant"), F.max("n").alias("most"))
    # a row for each k; its list of sizes stays off the rows of vertices
    few = sizes.join(F.broadcast(giant), "run").groupBy("run").agg(F.array_sort(F.collect_list(F.when(F.col("n") < F.col("most"), F.col("n")))).alias("sizes"), (F.count(F.lit(1)) - 1).alias("n_comp"))
    rows = by_k.join(F.broadcast(giant.select("run", "giant")), "run").filter("comp <> giant").join(places, "id")
    out = rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_vertices"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.avg((F.col("lon") > east).cast("double")).alias("share_east"),
        F.percentile("elev", F.lit(0.5)).alias("elev_median"), F.percentile("active_days", F.lit(0.5)).alias("active_median"),
    )
    return out.join(few, "run").select(F.col("run").alias("k"), "n_comp", "n_vertices", "sizes", "lon_min", "lon_max", "share_east", "elev_median", "active_median")


def edge_lengths(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(src, dst, km) for src < dst of ``places(id, lat, lon)``."""
    a, b = places.select(F.col("id").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), places.select(F.col("id").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    out = edges.filter("src < dst").join(a, "src").join(b, "dst")
    return out.select("src", "dst", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))


def mutual_share(nbrs: DataFrame, k: int) -> DataFrame:
    near = nbrs.filter(F.col("rank") <= k).select("i", "j")
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1.0).alias("hit"))
    return near.join(back, ["i", "j"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("mutual_share"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Mean share of the k nearest that two neighbour tables have in common; for each run if they have a column ``run``."""
    keys = ["run"] if "run" in a.columns else []
    x, y = (t.filter(F.col("rank") <= k).select(*keys, "i", "j") for t in (a, b))
    both = y.withColumn("hit", F.lit(1.0))
    return x.join(both, [*keys, "i", "j"], "left").groupBy(*keys).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("overlap"))


def degree_clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, cc): triangles through a vertex over pairs of its neighbours, 0 below degree 2.

    Edges point from the end of smaller degree to the larger, so that a hub opens few pairs;
    each triangle is found once and counts at its three corners.
    """
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    rank = lambda x: F.struct(F.col(f"d{x}"), F.col(x))
    both = edges.join(deg.select(F.col("id").alias("src"), F.col("degree").alias("dsrc")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("ddst")), "dst")
    up = settled(both.filter(rank("src") < rank("dst")).select("src", "dst"))
    pair = up.select("src", F.col("dst").alias("a")).join(up.select("src", F.col("dst").alias("b")), "src").filter("a < b")
    close = up.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    tri = pair.join(close, ["a", "b"]).select(F.explode(F.array("src", "a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("tri"))
    out = vertices.select("id").join(deg, "id", "left").join(tri, "id", "left").fillna({"degree": 0, "tri": 0})
    return out.select("id", "degree", F.when(F.col("degree") > 1, F.col("tri") / (F.col("degree") * (F.col("degree") - 1) / 2)).otherwise(0.0).alias("cc"))


def degree_tail(degrees: DataFrame) -> DataFrame:
    """One row: least, median, mean, most, skewness of degrees; R2 of the log upper tail against degree and log degree, from the median on.

    Works on the counts of each degree: ties stand in order, so sums over ranks are sums over runs.
    """
    hist = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, -1)  # a row for each distinct degree
    hist = hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    stats = degrees.agg(F.min("degree").alias("deg_min"), F.percentile("degree", F.lit(0.5)).alias("deg_median"), F.avg("degree").alias("deg_mean"), F.max("degree").alias("deg_max"), F.skewness("degree").alias("deg_skew"), F.count(F.lit(1)).alias("total"))
    rows = hist.crossJoin(F.broadcast(stats)).filter("degree >= deg_median")  # one row of statistics
    rows = rows.select("*", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("at"))
    y = F.log(1 - F.col("at") / F.col("total"))
    fits = rows.agg(F.regr_r2(y, F.col("degree")).alias("r2_exponential"), F.regr_r2(y, F.log("degree")).alias("r2_power"))
    return stats.drop("total").crossJoin(F.broadcast(fits))


def uniform_points(spark, n: int, dim: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.array(*(F.rand(seed + 7919 * k) for k in range(dim))).alias("v"))


def random_graph_clustering(degrees: DataFrame) -> DataFrame:
    return degrees.agg((F.avg("degree") / (F.count(F.lit(1)) - 1)).alias("random_graph_cc"))

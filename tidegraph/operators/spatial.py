"""The map: neighbours on a grid, contiguity, borders, regions, outside points."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import haversine_km
from ..sources.tables import settled
from .prepare import number


def grid_edges(cells: DataFrame) -> DataFrame:
    """(i, j): 8-neighbours on the grid of ``cells(id, r, c)``, once each, from the upper or left one."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    out = cells.select(F.col("id").alias("i"), "r", "c", steps.alias("s")).select("i", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    return out.join(cells.select(F.col("id").alias("j"), "r", "c"), ["r", "c"]).select("i", "j")


def vertex_edges(pixels: DataFrame, pix2v: DataFrame) -> DataFrame:
    """(i, j), i < j: distinct pairs of vertices of neighbouring pixels."""
    a, b = pix2v.select(F.col("pixel").alias("i"), F.col("vertex").alias("a")), pix2v.select(F.col("pixel").alias("j"), F.col("vertex").alias("b"))
    e = pixels.join(a, "i").join(b, "j").filter("a <> b")
    return e.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges(i, j) with labels a and b of the ends; for each run if labels have a column ``run``."""
    keys = ["run"] if "run" in labels.columns else []
    return edges.join(labels.select(*keys, F.col("id").alias("i"), F.col("lab").alias("a")), "i").join(labels.select(*keys, F.col("id").alias("j"), F.col("lab").alias("b")), [*keys, "j"])


def contiguity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, or one for each run: share of neighbours with equal labels, and what shuffled labels give on average: sum n(n - 1) over N(N - 1)."""
    keys = ["run"] if "run" in labels.columns else []
    same = labelled(edges, labels).groupBy(*keys).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("contiguity"))
    n = labels.groupBy(*keys, "lab").agg(F.count(F.lit(1)).alias("n"))
    null = n.groupBy(*keys).agg((F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("chance"))
    return same.join(F.broadcast(null), keys) if keys else same.crossJoin(F.broadcast(null))  # a row for each run


def shuffled_place(place: Column, n: int, key: Column) -> Column:
    """Where a permutation of 0 to n - 1 that is chosen by key puts place: a bijection without a sort.

    Places are pairs of a number below a and one below b, a b being hardly more than n, and
    rounds add a hash of one half to the other.  A result beyond n goes through the rounds
    again until it is below: few do, and none more than the pairs beyond n allow.
    """
    a = max(1, math.isqrt(n))
    b = -(-n // a)

    def rounds(x: Column) -> Column:
        left, right = (x / b).cast("long"), x % b
        for r in range(4):
            left = F.pmod(left + F.pmod(F.xxhash64(key, F.lit(2 * r), right), F.lit(a)), F.lit(a))
            right = F.pmod(right + F.pmod(F.xxhash64(key, F.lit(2 * r + 1), left), F.lit(b)), F.lit(b))
        return left * b + right

    def walked(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n + 1)), x, lambda y, _: F.when(y < n, y).otherwise(rounds(y)))

    first = rounds(place.cast("long"))
    return F.when(first < n, first).otherwise(walked(first)) if a * b > n else first


def shuffled_contiguity(edges: DataFrame, labels: DataFrame, times: int = 200, seed: int = 0) -> DataFrame:
    """(shuffle, share): the share under seeded permutations of labels; places are permuted by arithmetic, so that a shuffle sorts nothing."""
    numbered = settled(number(labels.select("id", "lab"), "id", "place"))
    n = numbered.count()
    each = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("shuffle")
    moved = numbered.select(each, "id", "place").withColumn("place", shuffled_place(F.col("place"), n, F.xxhash64(F.lit(seed), F.col("shuffle"))))
    new = moved.join(numbered.select("place", "lab"), "place").select("shuffle", "id", "lab")
    e = edges.join(new.select("shuffle", F.col("id").alias("i"), F.col("lab").alias("a")), "i").join(new.select("shuffle", F.col("id").alias("j"), F.col("lab").alias("b")), ["shuffle", "j"])
    return e.groupBy("shuffle").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("share"))


def _cube(lat: Column, lon: Column) -> list[Column]:
    """Coordinates of a place on the unit sphere."""
    u, v = F.radians(lat), F.radians(lon)
    return [F.cos(u) * F.cos(v), F.cos(u) * F.sin(v), F.sin(u)]


def nearest(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(gid, id, km): the nearest of ``cells(id, lat, lon)`` for each of ``points(gid, lat, lon)``, ties to the smaller id.

    Places are points of the unit sphere in a grid of cubes, so that poles and date line are
    places like any other.  A point looks into its cube and those around it; it is done if
    what it finds is nearer than the edge of a cube, as nothing outside can be.  The others
    look again with cubes of twice the edge.
    """
    cells = settled(cells.select("id", "lat", "lon", F.array(*_cube(F.col("lat"), F.col("lon"))).alias("at")))
    n = cells.count()
    open_ = settled(points.filter("lat is not null and lon is not null").select("gid", F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.array(*_cube(F.col("lat"), F.col("lon"))).alias("own")).distinct())
    edge, found = 2 / max(1.0, math.sqrt(n)), []
    places = lambda at, far: F.array(*(F.floor(F.get(at, F.lit(k)) / edge) + far[k] for k in range(3)))
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(s, "xyz", strict=True))) for s in itertools.product((-1, 0, 1), repeat=3))))
    while n and not open_.isEmpty():
        grid = cells.select("id", "lat", "lon", "at", places("at", (0, 0, 0)).alias("cube"))
        look = open_.select("*", around.alias("s")).withColumn("cube", places("own", [F.col(f"s.{c}") for c in "xyz"])).drop("s")
        chord = F.sqrt(F.aggregate(F.zip_with("at", "own", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
        met = look.join(grid, "cube").select("gid", F.struct(haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")).alias("km"), "id").alias("x"), chord.alias("chord"))
        best = met.groupBy("gid").agg(F.min("x").alias("x"), F.min("chord").alias("chord"))
        done = settled(best.filter(F.col("chord") < edge * (1 - 1e-9)) if edge < 4 else best)
        found.append(done.select("gid", "x.id", "x.km"))
        open_, edge = settled(open_.join(done.select("gid"), "gid", "left_anti")), 2 * edge
    none = points.select("gid", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("km")).limit(0)
    return reduce(DataFrame.unionByName, found) if found else none


def group_check(points: DataFrame, labels: DataFrame, near: DataFrame) -> DataFrame:
    """(grp, lab, hits, n) of ``points(gid, grp)``: the majority label of each group's nearest cells, the smallest of equals; points without a group don't score."""
    rows = points.filter("grp is not null").join(near, "gid").join(labels, "id")
    n = rows.groupBy("grp", "lab").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("grp").agg(F.max_by("lab", F.struct("n", -F.col("lab"))).alias("lab"), F.max("n").alias("hits"), F.sum("n").alias("n"))


def check_scores(groups: DataFrame) -> DataFrame:
    return groups.agg((F.countDistinct("lab") == F.count(F.lit(1))).alias("recovered"), (F.sum("hits") / F.sum("n")).alias("purity"))


def border_distance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of ``edges(i, j, d)``: median d inside and across regions, share of crossings among the top tenth, and among all."""
    e = labelled(edges, labels).withColumn("cross", F.col("a") != F.col("b"))
    top = e.agg(F.percentile("d", F.lit(0.9)).alias("q"))
    e = e.crossJoin(F.broadcast(top))
    x = F.col("cross").cast("double")
    return e.agg(F.percentile(F.when(~F.col("cross"), F.col("d")), F.lit(0.5)).alias("within"), F.percentile(F.when(F.col("cross"), F.col("d")), F.lit(0.5)).alias("across"), F.avg(F.when(F.col("d") >= F.col("q"), x)).alias("top_on_border"), F.avg(x).alias("border_share"))


def long_edges(lengths: DataFrame, labels: DataFrame, km: float = 1000.0) -> DataFrame:
    """One row of ``lengths(src, dst, km)``: share of equal labels at the ends of long edges."""
    e = lengths.filter(F.col("km") > km).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    return labelled(e, labels).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("same_region"))


def region_profile(climate: DataFrame, labels: DataFrame, places: DataFrame, share: float = 0.3) -> DataFrame:
    """(lab, n, lon, lat, elev, active_days, start, end, peak, peak_day): start and end are medians of the first and last day above a share of the own greatest value."""
    c = climate.join(labels, climate.pixel == labels.id).select("lab", "pixel", "day", "v")
    top = F.max("v").over(Window.partitionBy("pixel"))
    last = F.max("day").over(Window.partitionBy("pixel"))
    on = c.withColumn("on", F.col("v") > share * top).withColumn("last", last).groupBy("lab", "pixel").agg(F.coalesce(F.min(F.when(F.col("on"), F.col("day"))), F.lit(0)).alias("a"), F.coalesce(F.max(F.when(F.col("on"), F.col("day"))), F.max("last")).alias("b"))
    when = on.groupBy("lab").agg(F.percentile("a", F.lit(0.5)).alias("start"), F.percentile("b", F.lit(0.5)).alias("end"))
    mean = c.groupBy("lab", "day").agg(F.avg("v").alias("v")).groupBy("lab").agg(F.max("v").alias("peak"), F.max_by("day", F.struct("v", -F.col("day"))).alias("peak_day"))
    size = labels.join(places, "id").groupBy("lab").agg(F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(x) for x in ("lon", "lat", "elev", "active_days")))
    return size.join(when, "lab").join(mean, "lab")


def border_sharpness(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(id, sharp) of ``cells(id, r, c, q array<double>)``: root of the summed squares of central differences of each q, one-sided at the grid's limits; a cell that lacks a neighbour it needs counts 0."""
    q = F.posexplode("q").alias("k", "x")
    g = cells.select("id", "r", "c", q)
    stats = g.groupBy("k").agg(F.stddev_pop("x").alias("sd"))
    g = g.join(F.broadcast(stats), "k").withColumn("x", F.col("x") / F.col("sd")).drop("sd")

    def side(dr: int, dc: int, name: str) -> DataFrame:
        return g.select("k", (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("x").alias(name))

    rows = g
    for dr, dc, name in ((1, 0, "dn"), (-1, 0, "up"), (0, 1, "rt"), (0, -1, "lf")):
        rows = rows.join(side(dr, dc, name), ["k", "r", "c"], "left")
    x = F.col("x")
    gr = F.when(F.col("r") == 0, F.col("dn") - x).when(F.col("r") == height - 1, x - F.col("up")).otherwise((F.col("dn") - F.col("up")) / 2)
    gc = F.when(F.col("c") == 0, F.col("rt") - x).when(F.col("c") == width - 1, x - F.col("lf")).otherwise((F.col("rt") - F.col("lf")) / 2)
    return rows.groupBy("id").agg(F.sqrt(F.sum(F.coalesce(gr * gr + gc * gc, F.lit(0.0)))).alias("sharp"))


def border_classes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, border): none, or each pair "a|b" of regions that the vertex touches with its own; a vertex may be in several."""
    e = labelled(edges, labels)
    touch = e.select(F.col("i").alias("id"), F.col("a").alias("own"), F.col("b").alias("other")).union(e.select("j", "b", "a")).filter("own <> other").distinct()
    on = touch.select("id", F.concat_ws("|", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")).alias("border"))
    off = labels.join(touch.select("id").distinct(), "id", "left_anti").select("id", F.lit("none").alias("border"))
    return on.union(off)


def border_stats(classes: DataFrame, values: DataFrame, transition: int = 7) -> DataFrame:
    """(border, n, sharp, switching, cc) with ``values(id, sharp, kept, cc)``."""
    r = classes.join(values, "id").groupBy("border")
    return r.agg(F.count(F.lit(1)).alias("n"), F.percentile("sharp", F.lit(0.5)).alias("sharp"), F.avg((F.col("kept") <= transition).cast("double")).alias("switching"), F.percentile("cc", F.lit(0.5)).alias("cc"))


def eta_squared(labels: DataFrame, values: DataFrame) -> DataFrame:
    """One row, or one for each run: sum of squares between regions over the total of ``values(id, x)``, missing ones left out."""
    keys = ["run"] if "run" in labels.columns else []
    r = labels.join(values, "id").filter("x is not null and not isnan(x)")
    by = r.groupBy(*keys, "lab").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    all_of = r.groupBy(*keys).agg(F.avg("x").alias("mean"), (F.var_pop("x") * F.count(F.lit(1))).alias("total"))
    both = by.join(F.broadcast(all_of), keys) if keys else by.crossJoin(F.broadcast(all_of))  # a row for each run
    return both.groupBy(*keys).agg((F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)) / F.first("total")).alias("eta2"))


def climate_score(vector: DataFrame, places: DataFrame, low: float, high: float) -> DataFrame:
    """One row, or one for each run: size of the correlation of ``vector(id, x)`` with longitude in a band of elevation."""
    keys = ["run"] if "run" in vector.columns else []
    r = vector.join(places, "id").filter(F.col("elev").between(low, high))
    return r.groupBy(*keys).agg(F.abs(F.corr("x", "lon")).alias("climate"))

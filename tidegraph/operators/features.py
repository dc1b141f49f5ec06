"""Time-shape features, in long form: a row for each pixel (and year) and index f of a feature.

Inputs are ``curves(pixel, year, s array<double>)``.  Votes are exploded and summed, so
that histograms are ordinary aggregates with partial sums; blocks of a histogram are
normalised inside one array, so that its bins are not shuffled one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

CELLS, BINS, SLOPE = 24, 6, 0.3
MAIN_LAGS = (1, 7, 15, 31, 61)


def _by_day(rates: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """(keys, t, rate, cell) of the array column rate."""
    out = rates.select(*keys, F.size("rate").alias("n"), F.posexplode("rate").alias("t", "rate"))
    return out.withColumn("cell", A.cell_of(F.col("t"), cells, F.col("n"))).drop("n")


def cell_votes(rates: DataFrame, keys: list[str], cells: int = CELLS, bins: int = BINS, c: float = SLOPE) -> DataFrame:
    """(keys, cell, h array): |rate| split between the two nearest bin centres; all cells are there."""
    pos = F.least(F.greatest(A.slope_position(F.col("rate"), bins, c), F.lit(0.0)), F.lit(bins - 1.0))
    days = _by_day(rates, keys, cells).withColumn("pos", pos).withColumn("lo", F.floor("pos").cast("int"))
    part = F.col("pos") - F.col("lo")
    votes = F.array(*(F.when(F.col("lo") == b, 1 - part).when(F.col("lo") == b - 1, part).otherwise(0.0) for b in range(bins)))
    days = days.select(*keys, "cell", *((F.abs("rate") * F.get(votes, F.lit(b))).alias(f"b{b}") for b in range(bins)))
    sums = days.groupBy(*keys, "cell").agg(*(F.sum(f"b{b}").alias(f"b{b}") for b in range(bins)))
    return sums.select(*keys, "cell", F.array(*(f"b{b}" for b in range(bins))).alias("h"))


def soft_histogram(rates: DataFrame, keys: list[str], cells: int = CELLS, bins: int = BINS, c: float = SLOPE) -> DataFrame:
    """(keys, cell, bin, h) of cell_votes."""
    return cell_votes(rates, keys, cells, bins, c).select(*keys, "cell", F.posexplode("h").alias("bin", "h"))


def block_arrays(votes: DataFrame, keys: list[str], cells: int = CELLS, clip: float = 0.2, eps: float = 1.0) -> DataFrame:
    """(keys, v array) of ``votes(keys, cell, h array)``: blocks of a cell and the next one (the last wraps), L2 with eps, clipped, L2 with eps again, end to end."""
    rows = votes.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "h"))), lambda x: x["h"]).alias("h"))

    def unit(x: Column) -> Column:
        return A.bound(F.sqrt(A.total(x, lambda y: y * y) + eps**2), lambda n: F.transform(x, lambda y: y / n))

    def block(b: Column) -> Column:
        both = F.concat(F.get("h", b), F.get("h", F.pmod(b + 1, F.lit(cells))))
        return A.bound(both, lambda x: A.bound(F.transform(unit(x), lambda y: F.least(y, F.lit(clip))), unit))

    return rows.select(*keys, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), block)).alias("v"))


def block_normalize(h: DataFrame, keys: list[str], cells: int = CELLS, bins: int = BINS, clip: float = 0.2, eps: float = 1.0) -> DataFrame:
    """(keys, f, v) of ``h(keys, cell, bin, h)``: block_arrays with f = (cell 2 + slot) bins + bin."""
    votes = h.groupBy(*keys, "cell").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("h"))), F.lit(0.0)) for b in range(bins))).alias("h"))
    return by_index(block_arrays(votes, keys, cells, clip, eps), keys)


def by_index(arrays: DataFrame, keys: list[str]) -> DataFrame:
    return arrays.select(*keys, F.posexplode("v").alias("f", "v"))


def shares(v: Column) -> Column:
    """An array divided by its sum, or by 1e-12 where that is less."""
    return A.bound(v, lambda x: A.bound(F.greatest(A.total(x), F.lit(1e-12)), lambda t: F.transform(x, lambda y: y / t)))


def distribution(rows: DataFrame, keys: list[str]) -> DataFrame:
    """v divided by its sum over keys, or by 1e-12 where that is less."""
    total = F.sum("v").over(Window.partitionBy(*keys))
    return rows.withColumn("v", F.col("v") / F.greatest(total, F.lit(1e-12)))


def over_years(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "f").agg(F.avg("v").alias("v"))


def mean_arrays(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v array): mean over years, place by place; a group holds one array a year."""
    rows = arrays.groupBy(*keys).agg(F.collect_list("v").alias("vs"))
    each = lambda x, i: F.aggregate("vs", F.lit(0.0), lambda a, v: a + F.get(v, i)) / F.size("vs")
    return rows.select(*keys, F.transform(F.get("vs", F.lit(0)), each).alias("v"))


def side_by_side(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v array) of ``arrays(keys, lag, v)``: arrays of all lags end to end, as one distribution."""
    rows = arrays.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lag", "v"))), lambda x: x["v"])).alias("v"))
    return rows.select(*keys, shares(F.col("v")).alias("v"))


def smooth_rates(curves: DataFrame, sigma: float = 2.0) -> DataFrame:
    return curves.select("pixel", "year", A.bound(A.smooth(F.col("s"), sigma), A.central_rate).alias("rate"))


def lag_rates(curves: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """(pixel, year, lag, rate array) and what else curves have: all lags in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("lag"), A.lag_rate(F.col("s"), lag).alias("rate")) for i, lag in enumerate(lags))))
    keys = [c for c in curves.columns if c != "s"]
    return curves.select(*keys, each.alias("x")).select(*keys, "x.lag", "x.rate")


def cell_histograms(curves: DataFrame, cells: int = CELLS, bins: int = BINS, c: float = SLOPE, sigma: float = 2.0) -> DataFrame:
    return soft_histogram(smooth_rates(curves, sigma), ["pixel", "year"], cells, bins, c)


def _year_blocks(curves: DataFrame, cells: int) -> DataFrame:
    keys = ["pixel", "year"]
    return block_arrays(cell_votes(smooth_rates(curves), keys, cells), keys, cells)


def temporal_hog(curves: DataFrame, cells: int = CELLS) -> DataFrame:
    rows = mean_arrays(_year_blocks(curves, cells), ["pixel"])
    return by_index(rows.select("pixel", shares(F.col("v")).alias("v")), ["pixel"])


def yearly_hog(curves: DataFrame, cells: int = CELLS) -> DataFrame:
    """(pixel, year, f, v, active): each year a distribution; active: the year's blocks aren't all but zero."""
    rows = _year_blocks(curves, cells).select("pixel", "year", shares(F.col("v")).alias("v"), (A.total(F.col("v")) > 1e-6).alias("active"))
    return rows.select("pixel", "year", "active", F.posexplode("v").alias("f", "v"))


def _lag_blocks(curves: DataFrame, lags: tuple[int, ...], cells: int) -> DataFrame:
    """(pixel, year, lag, v array) and what else curves have for a pixel and year."""
    keys = [*(c for c in curves.columns if c != "s"), "lag"]
    return block_arrays(cell_votes(lag_rates(curves, lags), keys, cells), keys, cells)


def multiscale_hog(curves: DataFrame, lags: tuple[int, ...] = (1, 3, 7, 15, 31), weights: tuple[float, ...] | None = None, cells: int = CELLS) -> DataFrame:
    """(pixel, f, v): weighted lag features side by side, f from lag index, cell, slot and bin."""
    weights = weights or (1.0,) * len(lags)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("lag") + 1)
    rows = mean_arrays(_lag_blocks(curves, lags, cells), ["pixel", "lag"])
    rows = rows.select("pixel", "lag", A.bound(w, lambda u: F.transform(shares(F.col("v")), lambda x: u * x)).alias("v"))
    return by_index(side_by_side(rows, ["pixel"]), ["pixel"])


def lag_hog(curves: DataFrame, lag: int = 1, cells: int = CELLS) -> DataFrame:
    rows = mean_arrays(_lag_blocks(curves, (lag,), cells), ["pixel"])
    return by_index(rows.select("pixel", shares(F.col("v")).alias("v")), ["pixel"])


def yearly_multiscale_hog(curves: DataFrame, lags: tuple[int, ...] = MAIN_LAGS, cells: int = CELLS) -> DataFrame:
    """(pixel, year, f, v, active): each lag of a year a distribution, then the year; active: its curve changes."""
    keys = ["pixel", "year", "active"]
    change = A.total(A.over_days(F.col("s"), lambda t: F.abs(A.at(F.col("s"), t + 1) - A.at(F.col("s"), t))))
    rows = _lag_blocks(curves.select("pixel", "year", "s", (change > 1e-6).alias("active")), lags, cells)
    rows = rows.select(*keys, "lag", shares(F.col("v")).alias("v"))
    return by_index(side_by_side(rows, keys), keys)


def raw_curve(curves: DataFrame, cells: int = CELLS) -> DataFrame:
    """(pixel, f, v): mean value of each cell, as a distribution."""
    days = _by_day(curves.withColumnRenamed("s", "rate"), ["pixel"], cells)
    rows = days.groupBy("pixel", "cell").agg(F.avg("rate").alias("v"))
    return distribution(rows.withColumnRenamed("cell", "f"), ["pixel"])


def occurrence(curves: DataFrame, cells: int = CELLS) -> DataFrame:
    """(pixel, f, v): share of days above 0 in each cell, years pooled."""
    days = _by_day(curves.withColumnRenamed("s", "rate"), ["pixel"], cells)
    return days.groupBy("pixel", F.col("cell").alias("f")).agg(F.avg((F.col("rate") > 0).cast("double")).alias("v"))


def _pairs(curves: DataFrame, cells: int, back: bool) -> DataFrame:
    """(pixel, year, t, cell, now, other): each day with the next one, or the one before."""
    s = F.col("s")
    both = A.over_days(s, lambda t: F.struct(F.get(s, t).alias("now"), A.at(s, t + (-1 if back else 1)).alias("other")))
    out = curves.select("pixel", "year", F.size("s").alias("n"), F.posexplode(both).alias("t", "x"))
    return out.select("pixel", "year", "t", A.cell_of(F.col("t"), cells, F.col("n")).alias("cell"), "x.now", "x.other")


def count_histogram(curves: DataFrame, cells: int = 12, bins: int = 9, c: float = SLOPE) -> DataFrame:
    """(pixel, f, v): hard slope bins (half to even) of days with a value above 0 on it or the next, as shares of each cell of a year, over years, as a distribution; to twelve digits, so that no order of sums decides how a share is rounded."""
    d = _pairs(curves, cells, False)
    bin_ = F.least(F.greatest(F.rint(A.slope_position(F.col("other") - F.col("now"), bins, c)), F.lit(0.0)), F.lit(bins - 1.0)).cast("int")
    live = (F.col("now") > 0) | (F.col("other") > 0)
    n = d.groupBy("pixel", "year", "cell").agg(*(F.count_if(live & (bin_ == b)).alias(f"b{b}") for b in range(bins)))
    total = F.greatest(sum((F.col(f"b{b}") for b in range(bins)), F.lit(0)), F.lit(1))
    rows = n.select("pixel", "year", "cell", F.posexplode(F.array(*(F.col(f"b{b}") / total for b in range(bins)))).alias("bin", "v"))
    means = distribution(over_years(rows.withColumn("f", (F.col("cell") * bins + F.col("bin")).cast("int")), ["pixel"]), ["pixel"])
    return means.withColumn("v", F.round("v", 12))


def occurrence_gradient(curves: DataFrame, weight: float = 0.5, cells: int = CELLS, bins: int = 9, scale: float = 1.0, sigma: float = 0.5) -> DataFrame:
    """(pixel, f, v): square roots of slope shares by cell, counts pooled over years and smoothed over cells, then shares of days above 0; each part weighted for a Euclidean distance."""
    d = _pairs(curves, cells, True)
    slope = F.floor((F.atan2(F.col("now") - F.col("other"), F.lit(scale)) + math.pi / 2) / math.pi * bins)
    bin_ = F.least(F.greatest(slope, F.lit(0)), F.lit(bins - 1)).cast("int")
    live = ((F.col("now") > 0) | (F.col("other") > 0)) & (F.col("t") > 0)
    n = d.groupBy("pixel", "cell").agg(*(F.count_if(live & (bin_ == b)).alias(f"b{b}") for b in range(bins)), F.avg((F.col("now") > 0).cast("double")).alias("share"))
    rows = n.select("pixel", "cell", F.posexplode(F.array(*(F.col(f"b{b}").cast("double") for b in range(bins)))).alias("bin", "h"))
    smoothed = gaussian_over_cells(rows, ["pixel", "bin"], cells, sigma)
    total = F.sum("h").over(Window.partitionBy("pixel", "cell"))
    part = smoothed.withColumn("v", F.sqrt(F.when(total > 0, F.col("h") / total).otherwise(0.0)) * math.sqrt((1 - weight) / (2 * cells)))
    part = part.select("pixel", (F.col("cell") * bins + F.col("bin")).cast("int").alias("f"), "v")
    occ = n.select("pixel", (F.col("cell") + cells * bins).cast("int").alias("f"), (F.col("share") * math.sqrt(weight / cells)).alias("v"))
    return part.unionByName(occ)


def gaussian_over_cells(rows: DataFrame, keys: list[str], cells: int, sigma: float) -> DataFrame:
    """h smoothed over cells to a radius of four sigma, ends repeated; sigma 0 leaves it."""
    if sigma <= 0:
        return rows
    radius = int(4 * sigma + 0.5)
    to = [F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in zip(range(-radius, radius + 1), A.gaussian(sigma, radius), strict=True)]
    # cell c gives to c - o; an end cell also gives what lies beyond it
    targets = F.filter(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda j: F.struct(j.alias("cell"), F.aggregate(F.array(*to), F.lit(0.0), lambda a, x: a + F.when(F.least(F.greatest(j + x["o"], F.lit(0)), F.lit(cells - 1)) == F.col("cell"), x["w"]).otherwise(0.0)).alias("w"))), lambda x: x["w"] != 0)
    given = rows.select(*keys, "h", F.explode(targets).alias("x"))
    return given.groupBy(*keys, F.col("x.cell").alias("cell")).agg(F.sum(F.col("h") * F.col("x.w")).alias("h"))


def haar_scalogram(curves: DataFrame, scales: tuple[int, ...] = (2, 4, 8, 16, 32, 64), cells: int = 12) -> DataFrame:
    """(pixel, f, v): energy of differences of neighbouring means, by cell, scale and sign; each year a distribution, then their mean."""
    top = max(scales) // 2
    s = F.col("s")
    padded = F.transform(F.sequence(F.lit(-top), F.size("s") - 1 + top), lambda t: A.at(s, t))
    rows = curves.select("pixel", "year", F.size("s").alias("n"), F.posexplode(padded).alias("p", "x"))
    w = Window.partitionBy("pixel", "year").orderBy("p")
    each = []
    for L in scales:
        h = L // 2
        ahead = F.sum("x").over(w.rowsBetween(0, h - 1))
        behind = F.sum("x").over(w.rowsBetween(-h, -1))
        each.append(((ahead - behind) / h).alias(f"d{L}"))
    d = rows.select("pixel", "year", "n", (F.col("p") - top).alias("t"), *each).filter("t >= 0 and t < n")
    d = d.withColumn("cell", A.cell_of(F.col("t"), cells, F.col("n")))
    energy = []
    for i, L in enumerate(scales):
        sq = F.col(f"d{L}") * F.col(f"d{L}")
        energy += [F.sum(F.when(F.col(f"d{L}") > 0, sq).otherwise(0.0)).alias(f"e{2 * i}"), F.sum(F.when(F.col(f"d{L}") < 0, sq).otherwise(0.0)).alias(f"e{2 * i + 1}")]
    e = d.groupBy("pixel", "year", "cell").agg(*energy)
    k = 2 * len(scales)
    e = e.select("pixel", "year", "cell", F.posexplode(F.array(*(f"e{i}" for i in range(k)))).alias("i", "v"))
    e = e.select("pixel", "year", (F.col("cell") * k + F.col("i")).cast("int").alias("f"), "v")
    return distribution(over_years(distribution(e, ["pixel", "year"]), ["pixel"]), ["pixel"])


def fourier(curves: DataFrame, harmonics: int = 6) -> DataFrame:
    """(pixel, f, v): real, then imaginary parts of harmonics 1 to n over the year's sum, years of no sum left out."""
    days = curves.select("pixel", "year", F.size("s").alias("n"), F.posexplode("s").alias("t", "x"))
    angle = lambda h: F.col("t") * (2 * math.pi * h) / F.col("n")
    sums = days.groupBy("pixel", "year").agg(F.sum("x").alias("dc"), *(F.sum(F.col("x") * F.cos(angle(h))).alias(f"r{h}") for h in range(1, harmonics + 1)), *((-F.sum(F.col("x") * F.sin(angle(h)))).alias(f"i{h}") for h in range(1, harmonics + 1)))
    names = [*(f"r{h}" for h in range(1, harmonics + 1)), *(f"i{h}" for h in range(1, harmonics + 1))]
    live = sums.filter("dc > 1e-6").select("pixel", F.posexplode(F.array(*(F.col(c) / F.col("dc") for c in names))).alias("f", "v"))
    return over_years(live, ["pixel"])


def seasons(curves: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(pixel, year, onset, melt, days, peak, episodes, rise, fall, flash) of years with a day above threshold."""
    s = F.col("s")
    both = A.over_days(s, lambda t: F.struct(F.get(s, t).alias("x"), F.get(s, t - 1).alias("was")))
    d = curves.select("pixel", "year", F.posexplode(both).alias("t", "y")).select("pixel", "year", "t", "y.x", "y.was")
    on, gain = F.col("x") > threshold, F.greatest(F.col("x") - F.col("was"), F.lit(0.0))
    starts = on & ~F.coalesce(F.col("was") > threshold, F.lit(False))
    out = d.groupBy("pixel", "year").agg(F.min(F.when(on, F.col("t"))).alias("onset"), F.max(F.when(on, F.col("t"))).alias("melt"), F.count_if(on).alias("days"), F.max_by("t", F.struct("x", -F.col("t"))).alias("peak"), F.count_if(starts).alias("episodes"), F.sum(gain).alias("gain"), F.sum(F.when(F.col("x") - F.col("was") > 1, gain).otherwise(0.0)).alias("fast"))
    out = out.filter("onset is not null")
    return out.select("pixel", "year", "onset", "melt", "days", "peak", "episodes", (F.col("peak") - F.col("onset")).alias("rise"), (F.col("melt") - F.col("peak")).alias("fall"), (F.col("fast") / F.greatest("gain", F.lit(1e-6))).alias("flash"))


STATS = ("onset", "melt", "days", "peak", "episodes", "rise", "fall", "flash")


#: Pixels of several runs share a table as run * 2 ** RUN_BITS + pixel.
RUN_BITS = 40


def in_run(run: Column, pixel: Column) -> Column:
    return F.shiftleft(run.cast("long"), RUN_BITS) + pixel


def phenology(curves: DataFrame, threshold: float = 0.5, by_run: bool = False) -> DataFrame:
    """(pixel, f, v): means over years with a season, z-scored over pixels (deviation 0 counts as 1), run by run if asked for.  If a pixel has no season at all, all v are null."""
    means = seasons(curves, threshold).groupBy("pixel").agg(*(F.avg(c).alias(c) for c in STATS))
    every = curves.select("pixel").distinct().join(means, "pixel", "left").withColumn("run", F.shiftright("pixel", RUN_BITS) if by_run else F.lit(0).cast("long"))
    spread = every.groupBy("run").agg(F.count_if(F.col("onset").isNull()).alias("gaps"), *(F.avg(c).alias(f"m_{c}") for c in STATS), *(F.stddev_pop(c).alias(f"s_{c}") for c in STATS))
    z = every.join(F.broadcast(spread), "run")  # a row of statistics for each run
    cols = [F.when(F.col("gaps") == 0, (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)) for c in STATS]
    return z.select("pixel", F.posexplode(F.array(*cols)).alias("f", "v"))


#: Name: (feature, distance).  Methods of the comparison; each takes curves and gives (pixel, f, v).
METHODS = {
    "raw": (raw_curve, "hellinger"),
    "occurrence": (occurrence, "euclidean"),
    "occurrence_gradient": (occurrence_gradient, "euclidean"),
    "gradient_only": (lambda c: occurrence_gradient(c, 0.0), "euclidean"),
    "hog_smoothed": (temporal_hog, "hellinger"),
    **{f"hog_lag_{k}": ((lambda k: lambda c: lag_hog(c, k))(k), "hellinger") for k in (1, 3, 7, 15, 31, 61)},
    "multiscale_1_31": (multiscale_hog, "hellinger"),
    "multiscale_7_61": (lambda c: multiscale_hog(c, (7, 15, 31, 61)), "hellinger"),
    "multiscale_main": (lambda c: multiscale_hog(c, MAIN_LAGS), "hellinger"),
    "multiscale_half_1": (lambda c: multiscale_hog(c, MAIN_LAGS, (0.5, 1, 1, 1, 1)), "hellinger"),
    "haar": (haar_scalogram, "hellinger"),
    "fourier": (fourier, "euclidean"),
    "phenology": (lambda c: phenology(c, by_run=True), "euclidean"),
}


def vectors(rows: DataFrame) -> DataFrame:
    """(id, v array<double>) of (pixel, f, v), by f."""
    pairs = F.array_sort(F.collect_list(F.struct("f", "v")))
    return rows.groupBy(F.col("pixel").alias("id")).agg(F.transform(pairs, lambda x: x["v"]).alias("v"))


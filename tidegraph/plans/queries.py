"""The registered queries: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import cluster, distance, embed, features, graph, layout, medoid, prepare, products, robustness, spatial, spectral
from ..sources import seasons
from ..sources.tables import settled, table
from . import data

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
K, SCAN, REGIONS, DIGITS = 21, 64, 3, 6


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), DIGITS) + 0.0 for n in names})


def feature(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: rounded(f(data.curves(s, d)), "v")


def nbrs(s: SparkSession, d: str, k: int, metric: str = "hellinger") -> DataFrame:
    pts = data.points(s, d) if metric == "euclidean" else data.shares(s, d)
    return settled(distance.top_k(settled(pts), k, metric))


# seasons and curves


@query
def season_days(s, d):
    y, t = seasons.season_of(F.col("l_shipdate"))
    rows = table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), y.cast("int").alias("season"), t.cast("int").alias("day"))
    return rows.groupBy("date", "season", "day").agg(F.count(F.lit(1)).alias("n"))


@query
def daily_curve(s, d):
    return data.curves(s, d).select("pixel", "year", F.posexplode("s").alias("day", "v"))


@query
def active_days_mask(s, d):
    a = prepare.active_days(data.days(s, d), data.YEARS)
    return rounded(a.withColumns({f"over_{k}": F.col("active_days") >= k for k in (30, 60, 90)}), "active_days")


def _planted(s, d):
    """Curves of suppliers, and a copy of every fifth one."""
    c = data.curves(s, d)
    return c.unionByName(c.filter("pixel % 5 = 0").withColumn("pixel", F.col("pixel") + 1_000_000))


@query
def contract_duplicates(s, d):
    return prepare.contract(_planted(s, d))


@query
def duplicate_columns(s, d):
    c = _planted(s, d)
    at = c.select("pixel").distinct().select("pixel", (73 + 0.25 * (F.col("pixel") % 25)).alias("lon"))
    return prepare.duplicate_columns(prepare.contract(c), at)


@query
def vertex_elevation(s, d):
    c = _planted(s, d)
    at = c.select("pixel").distinct().select("pixel", F.when(F.col("pixel") % 7 != 0, (F.col("pixel") % 97).cast("double")).alias("v"))
    return prepare.vertex_mean(at, prepare.contract(c))


@query
def climatology(s, d):
    return rounded(prepare.climatology(data.curves(s, d)), "v")


@query
def year_subsets(s, d):
    y = data.curves(s, d).select("year").distinct()
    return prepare.year_subsets(y, data.YEARS, 4).withColumn("season", prepare.season_name(data.FIRST))


@query
def lag_rate(s, d):
    r = features.lag_rates(data.curves(s, d), (7,))
    return rounded(r.select("pixel", "year", F.posexplode("rate").alias("day", "v")), "v")


@query
def smooth_rate(s, d):
    r = features.smooth_rates(data.curves(s, d))
    return rounded(r.select("pixel", "year", F.posexplode("rate").alias("day", "v")), "v")


@query
def cell_histogram(s, d):
    return rounded(features.cell_histograms(data.curves(s, d)), "h")


@query
def block_norm(s, d):
    return rounded(features.block_normalize(features.cell_histograms(data.curves(s, d)), ["pixel", "year"]), "v")


@query
def yearly_hog(s, d):
    return rounded(features.yearly_hog(data.curves(s, d)), "v")


@query
def yearly_multiscale_hog(s, d):
    return rounded(features.yearly_multiscale_hog(data.curves(s, d)), "v")


FOUND |= {
    "raw_curve": feature(features.raw_curve),
    "occurrence": feature(features.occurrence),
    "temporal_hog": feature(features.temporal_hog),
    "lag_hog": feature(lambda c: features.lag_hog(c, 7)),
    "multiscale_hog": feature(lambda c: features.multiscale_hog(c, features.MAIN_LAGS)),
    "count_histogram": feature(features.count_histogram),
    "occurrence_gradient": feature(features.occurrence_gradient),
    "haar_scalogram": feature(features.haar_scalogram),
    "fourier_harmonics": feature(features.fourier),
    "phenology": feature(features.phenology),
}


# distances and graphs


@query
def euclidean_pairs(s, d):
    return rounded(distance.pairs(data.points(s, d)), "d")


@query
def hellinger_pairs(s, d):
    return rounded(distance.pairs(data.shares(s, d), "hellinger"), "d")


@query
def js_pairs(s, d):
    return rounded(distance.pairs(data.shares(s, d), "js"), "d")


@query
def distance_summary(s, d):
    return rounded(distance.summary_of_pairs(settled(data.shares(s, d)), "hellinger"), "min", "q05", "median", "q95", "max")


@query
def pairs_within(s, d):
    return rounded(distance.within(settled(data.shares(s, d)), 0.3, "hellinger"), "d")


def _places(s, d):
    return data.places(data.points(s, d).select("id"))


@query
def haversine_edges(s, d):
    out = graph.edge_lengths(graph.knn_edges(nbrs(s, d, K), K), _places(s, d))
    return rounded(out, "km")


@query
def edge_length_stats(s, d):
    e = graph.edge_lengths(graph.knn_edges(nbrs(s, d, K), K), _places(s, d))
    return rounded(e.agg(F.count(F.lit(1)).alias("n"), F.percentile("km", F.lit(0.5)).alias("median_km"), F.avg((F.col("km") > 100).cast("double")).alias("long_share")), "median_km", "long_share")


@query
def knn_edges(s, d):
    return graph.knn_edges(nbrs(s, d, K), K)


@query
def knn_mutual_share(s, d):
    return rounded(graph.mutual_share(nbrs(s, d, K), K), "mutual_share")


@query
def nn_overlap(s, d):
    return rounded(graph.overlap(nbrs(s, d, K), nbrs(s, d, K, "js"), K), "overlap")


def _by_k(s, d):
    """Components for every k from 1 to SCAN, or to all other vertices if these are fewer."""
    pts = data.points(s, d)
    most = max(1, min(SCAN, pts.count() - 1))
    return graph.components_by_k(pts, nbrs(s, d, SCAN), list(range(1, most + 1)))


@query
def components_by_k(s, d):
    return _by_k(s, d).select(F.col("run").alias("k"), "id", "comp")


@query
def first_connected_k(s, d):
    n = graph.component_counts(_by_k(s, d))
    return n.withColumn("first", F.col("k") == graph.first_connected(n))


@query
def small_components(s, d):
    out = graph.small_components(_by_k(s, d), _places(s, d), 75.0).withColumn("sizes", F.array_join(F.transform("sizes", lambda n: n.cast("string")), ","))
    return rounded(out, "share_east", "elev_median", "active_median")


def _degrees(s, d):
    return graph.degree_clustering(data.points(s, d), graph.knn_edges(nbrs(s, d, K), K))


@query
def degree_clustering(s, d):
    return rounded(_degrees(s, d), "cc")


@query
def degree_tail(s, d):
    out = graph.degree_tail(settled(_degrees(s, d)))
    return rounded(out, "deg_median", "deg_mean", "deg_skew", "r2_exponential", "r2_power")


@query
def uniform_baseline(s, d):
    n = data.points(s, d).count()
    out = None
    for dim in (2, 3, 4, 6, 10):
        pts = settled(graph.uniform_points(s, n, dim))
        deg = graph.degree_clustering(pts, graph.knn_edges(settled(distance.top_k(pts, K)), K))
        one = deg.agg(F.lit(dim).alias("dim"), F.percentile("cc", F.lit(0.5)).alias("cc_median"), F.max("degree").alias("deg_max"), F.avg("degree").alias("deg_mean"))
        out = one if out is None else out.union(one)
    return out


# spectrum


def _weights(s, d, fallback=False):
    n = nbrs(s, d, K)
    return spectral.gaussian_weights(graph.knn_edges(n, K), n, fallback=fallback)


@query
def gaussian_weights(s, d):
    return rounded(_weights(s, d), "w")


@query
def gaussian_weights_fallback(s, d):
    return rounded(_weights(s, d, True), "w")


@query
def laplacian_entries(s, d):
    return rounded(spectral.laplacian(_weights(s, d)), "v")


def _laplacian(s, d):
    return spectral.laplacian(_weights(s, d)).withColumn("run", F.lit(0).cast("long"))


def _spectrum(s, d, q=25):
    """The first q eigenpairs: no more of them than the query reads."""
    return settled(spectral.spectra(_laplacian(s, d), q))


@query
def spectrum(s, d):
    return _spectrum(s, d).groupBy("idx").agg(F.first("lambda").alias("lambda"), (F.max("residual") < 1e-8).alias("holds"))


def _laplacians(s, d, ks):
    """Laplacian entries (run, src, dst, v) of the graphs of all k in ks: weights don't depend on k, only which edges there are."""
    n = nbrs(s, d, SCAN)
    w = spectral.gaussian_weights(graph.knn_edges(n, SCAN), n).join(graph.least_k(n), ["src", "dst"])
    run = F.explode(F.array(*(F.lit(k).cast("long") for k in ks))).alias("run")
    return spectral.laplacian(w.select(run, "src", "dst", "w", "least").filter("least <= run").drop("least"))


@query
def fiedler_by_k(s, d):
    """From the first k that connects the graph to 64, or to all other vertices."""
    counts = settled(graph.component_counts(_by_k(s, d)))
    ks = range(graph.first_connected(counts), max(r["k"] for r in counts.select("k").collect()) + 1)  # at most 64 rows
    return spectral.lowest_eigenvalues(_laplacians(s, d, ks), 2).filter("idx = 1").select(F.col("run").alias("k"), "lambda")


@query
def isolated_eigenvalue(s, d):
    return spectral.most_isolated(spectral.isolating_eigenvalues(_laplacian(s, d), 25).select("idx", "lambda"))


@query
def nodal_domains(s, d):
    v = _spectrum(s, d, 2).filter("idx = 1").select("id", "x")
    dom = spectral.nodal_domains(v, graph.knn_edges(nbrs(s, d, K), K))
    return spectral.domain_stats(dom, _places(s, d))


@query
def spectral_correlations(s, d):
    v = _spectrum(s, d, 2).filter("idx = 1").select("id", "x")
    return spectral.correlations(v, _places(s, d), 4400, 5000)


@query
def kmeans(s, d):
    pts = data.points(s, d).withColumn("run", F.lit(0).cast("long"))
    return cluster.kmeans(pts, 10).select("id", "lab", "cost")


@query
def spectral_clusters(s, d):
    lab = cluster.spectral_clusters(_spectrum(s, d, REGIONS), REGIONS).select("id", "lab")
    return cluster.name_regions(lab, _places(s, d))


@query
def k_robustness(s, d):
    """Agreement of the partitions at other k with that at 21."""
    vectors = spectral.spectra(_laplacians(s, d, (8, 16, K, 32, 64)), REGIONS)
    lab = settled(cluster.spectral_clusters(vectors, REGIONS).select("run", "id", "lab"))
    main = lab.filter(F.col("run") == K).select("id", F.col("lab").alias("a"))
    out = None
    for k in (8, 16, 32, 64):
        one = cluster.ari(main.join(lab.filter(F.col("run") == k).select("id", F.col("lab").alias("b")), "id")).select(F.lit(k).alias("k"), "ari")
        out = one if out is None else out.union(one)
    return out


@query
def louvain(s, d):
    return cluster.louvain(_weights(s, d).withColumn("run", F.lit(0).cast("long"))).select("id", "comm", "modularity")


# labels and the map


def _two(s, d):
    return data.labels(s, d).select("id", F.col("lab").alias("ref"), ((F.col("lab") + F.when(F.col("id") % 4 == 0, 2).otherwise(1)) % 3).alias("lab"))


@query
def match_labels(s, d):
    return cluster.match_labels(_two(s, d), REGIONS)


@query
def label_agreement(s, d):
    return rounded(cluster.agreement(_two(s, d), REGIONS), "agreement")


@query
def ari(s, d):
    return rounded(cluster.ari(_two(s, d).select(F.col("lab").alias("a"), F.col("ref").alias("b"))), "ari")


@query
def purity(s, d):
    return rounded(cluster.purity(_two(s, d).select(F.col("lab").alias("a"), F.col("ref").alias("b"))), "purity")


@query
def name_regions(s, d):
    return cluster.name_regions(data.labels(s, d), _places(s, d))


@query
def grid_edges(s, d):
    return spatial.grid_edges(_places(s, d))


def _pix2v(s, d):
    return data.points(s, d).select(F.col("id").alias("pixel"), F.floor(F.col("id") / 2).alias("vertex"))


@query
def vertex_edges(s, d):
    return spatial.vertex_edges(spatial.grid_edges(_places(s, d)), _pix2v(s, d))


@query
def contiguity(s, d):
    return rounded(spatial.contiguity(spatial.grid_edges(_places(s, d)), data.labels(s, d)), "contiguity", "chance")


@query
def shuffled_contiguity(s, d):
    return spatial.shuffled_contiguity(spatial.grid_edges(_places(s, d)), data.labels(s, d), 50)


def _outside(s, d):
    n = F.col("n_nationkey")
    return table(s, d, "nation").select(n.alias("gid"), F.when(F.col("n_regionkey") < 3, F.col("n_regionkey")).alias("grp"), (39.9 - 0.2 * n).alias("lat"), (73.1 + 0.2 * (n * 7 % 25)).alias("lon"))


@query
def nearest_group_check(s, d):
    # differences of degrees are exact: places a full turn apart are at one distance, as far as sine and cosine tell
    decimal = lambda df: df.withColumns({c: F.col(c).cast("decimal(20,2)") for c in ("lat", "lon")})
    p = decimal(_outside(s, d))
    near = spatial.nearest(p, decimal(_places(s, d)))
    return spatial.group_check(p, data.labels(s, d), near)


@query
def nearest_group_scores(s, d):
    return rounded(spatial.check_scores(nearest_group_check(s, d)), "purity")


def _map_distances(s, d):
    e = spatial.grid_edges(_places(s, d)).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return distance.edge_distances(e, data.shares(s, d))


@query
def border_distance(s, d):
    return rounded(spatial.border_distance(_map_distances(s, d), data.labels(s, d)), "within", "across", "top_on_border", "border_share")


@query
def edge_darkness(s, d):
    return rounded(products.edge_darkness(_map_distances(s, d)), "d", "dark")


@query
def long_edges(s, d):
    e = graph.edge_lengths(graph.knn_edges(nbrs(s, d, K), K), _places(s, d))
    return rounded(spatial.long_edges(e, data.labels(s, d), 100.0), "same_region")


@query
def border_sharpness(s, d):
    cells = _places(s, d).join(data.points(s, d).select("id", F.slice("v", 1, 3).alias("q")), "id")
    return rounded(spatial.border_sharpness(cells, 10_000, 25), "sharp")


@query
def border_classes(s, d):
    return spatial.border_classes(spatial.grid_edges(_places(s, d)), data.labels(s, d))


@query
def border_stats(s, d):
    values = border_sharpness(s, d).join(_degrees(s, d).select("id", "cc"), "id").withColumn("kept", F.col("id") % 15)
    return rounded(spatial.border_stats(border_classes(s, d), values), "sharp", "switching", "cc")


def _supplier_labels(c):
    return c.select(F.col("pixel").alias("id")).distinct().select("id", (F.col("id") % 3).alias("lab"))


@query
def region_profile(s, d):
    c = data.curves(s, d)
    lab = _supplier_labels(c)
    # whole months keep sums exact and days clear of ties
    return rounded(spatial.region_profile(prepare.climatology(c), lab, data.places(lab.select("id"))), "lon", "lat", "elev", "active_days", "peak")


@query
def elevation_eta2(s, d):
    v = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    lab = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).cast("long").alias("lab"))
    return rounded(spatial.eta_squared(lab, v), "eta2")


@query
def covariate_corr(s, d):
    v = data.points(s, d).select("id", F.get("v", F.lit(0)).alias("x"))
    return rounded(spatial.climate_score(v, _places(s, d), 3400, 5000), "climate")


# years and variants


def _nations(s, d):
    """Curves of the nations and their places."""
    rows = table(s, d, "lineitem").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    c = settled(seasons.curves(seasons.season_days(rows, "s_nationkey", "l_shipdate", "l_quantity", data.FIRST, data.YEARS), data.YEARS))
    ids = c.select(F.col("pixel").alias("id")).distinct()
    return c, settled(data.places(ids).withColumn("r", F.floor(F.col("id") / 5)).withColumn("c", F.col("id") % 5))


def _years(s, d):
    c, at = _nations(s, d)
    main = features.vectors(features.multiscale_hog(c, features.MAIN_LAGS))
    return robustness.main_and_years(main, features.yearly_multiscale_hog(c), at, 8, REGIONS)


@query
def yearly_partition(s, d):
    return _years(s, d)[1]


@query
def kept_core_transition(s, d):
    main, years = _years(s, d)
    return robustness.stability(robustness.kept(years, main), 5, 3)


@query
def eigenvalue_check(s, d):
    """lambda2 of the years before and after the switch."""
    return robustness.before_after(_years(s, d)[1].select("year", "lam2").distinct(), ["lam2"], 4)


@query
def kept_years(s, d):
    """Of given yearly labels: a vertex keeps its label in years that its id doesn't divide."""
    main = data.labels(s, d)
    y = main.select("id", "lab", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("year")).filter("(id + year) % 11 <> 0")
    y = y.withColumn("lab", F.when((F.col("id") * 3 + F.col("year")) % 4 == 0, (F.col("lab") + 1) % 3).otherwise(F.col("lab")))
    return rounded(robustness.stability(robustness.kept(y, main), 11, 9).filter("lab is not null"), "core", "transition")


@query
def inactive_years(s, d):
    c = data.curves(s, d).select("pixel", "year", (F.aggregate("s", F.lit(0.0), lambda a, x: a + x) > 300).alias("active"))
    return robustness.inactive_by_year(c)


@query
def sensor_check(s, d):
    return rounded(robustness.before_after(inactive_years(s, d), ["inactive"], 3), "inactive_before", "inactive_after")


@query
def variant_sweep(s, d):
    """The graph with other cells, and of vertices active on at least so many days a season."""
    c, at = _nations(s, d)
    active = F.size(F.filter("s", lambda x: x > 0.5))
    mean = settled(c.groupBy("pixel").agg(F.avg(active).alias("active_days")))
    over = lambda k: mean.filter(F.col("active_days") >= k).select("pixel")
    kinds = [("main", 24, None), ("12 cells", 12, None), ("48 cells", 48, None), ("30 days", 24, over(30)), ("90 days", 24, over(90))]
    return robustness.variants(c, at, 8, REGIONS, features.MAIN_LAGS, kinds)


@query
def feature_comparison(s, d):
    """All methods over all subsets of years, a row for each method."""
    c, at = _nations(s, d)
    return robustness.compare(c, at, list(features.METHODS), prepare.year_subsets(c.select("year").distinct(), data.YEARS, 4), 8, REGIONS, (3000, 6000))


# maps and products


RUNS = [("pca_30", 30.0, "pca"), ("pca_5", 5.0, "pca"), ("pca_100", 100.0, "pca"), ("random_30", 30.0, "random")]


def _maps(s, d):
    return settled(layout.maps(data.shares(s, d), s.createDataFrame(RUNS, "run string, perplexity double, start string")))


@query
def tsne_affinities(s, d):
    """The share of each neighbour of each point at perplexity 30."""
    return layout.affinities(nbrs(s, d, 90), {"pca_30": 30.0}).select("i", "j", "p")


@query
def tsne_map(s, d):
    """Four maps with what their panels are painted by: region and place."""
    at = _places(s, d).select("id", "lon", "elev").join(data.labels(s, d).withColumnRenamed("lab", "region"), "id", "left")
    return _maps(s, d).join(at, "id")


@query
def tsne_scores(s, d):
    """For each map, for the first two principal components and for the second and third eigenvector: neighbours kept, neighbours of one region, agreement of clusters with regions, and neighbours shared with the map from a random start."""
    roots = settled(data.shares(s, d).select("id", F.transform("v", F.sqrt).alias("v")))
    v = _spectrum(s, d, 3)
    eigen = v.filter("idx = 1").select("id", F.col("x").alias("x")).join(v.filter("idx = 2").select("id", F.col("x").alias("y")), "id")
    maps = _maps(s, d)
    kl = maps.groupBy("run").agg(F.first("kl").alias("kl"))
    both = maps.select("run", "id", "x", "y").unionByName(embed.pca_scores(roots).select(F.lit("components").alias("run"), "id", "x", "y"))
    both = settled(both.unionByName(eigen.select(F.lit("eigenvectors").alias("run"), "id", "x", "y")))
    return embed.scores(both, nbrs(s, d, K), data.labels(s, d), K, REGIONS, "random_30").join(kl, "run", "left")


@query
def pca_scores(s, d):
    return embed.pca_scores(data.points(s, d))


@query
def map_scores(s, d):
    pts = settled(embed.pca_scores(data.points(s, d)).select("id", F.array("x", "y").alias("v")))
    flat = settled(distance.top_k(pts, K))
    keep = graph.overlap(nbrs(s, d, K, "euclidean"), flat, K).withColumnRenamed("overlap", "nn_keep")
    e = graph.knn_edges(flat, K).select(F.col("src").alias("i"), F.col("dst").alias("j"))
    same = spatial.labelled(e, data.labels(s, d)).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("same_region"))
    return keep.crossJoin(same)


@query
def medoids(s, d):
    return rounded(medoid.medoids(data.shares(s, d), data.labels(s, d)), "d")


@query
def medoid_hog(s, d):
    """Slopes of the mean season of each region's medoid, lag by lag."""
    c = settled(data.curves(s, d))
    regions = c.select(F.col("pixel").alias("id"), (F.col("pixel") % REGIONS).alias("lab")).distinct()
    chosen = medoid.medoids(features.vectors(features.lag_hog(c, 7)), regions)
    return rounded(products.scaled_slopes(prepare.climatology(c.join(F.broadcast(chosen.select(F.col("id").alias("pixel"))), "pixel")), features.MAIN_LAGS), "v")  # a row for each region


@query
def distance_histogram(s, d):
    return distance.histogram(settled(data.shares(s, d)), 0.0, 1.0, 80, "hellinger", DIGITS)


@query
def degree_ccdf(s, d):
    return rounded(products.ccdf(_degrees(s, d)), "share")


@query
def distance_sample(s, d):
    return rounded(distance.every_pair(data.shares(s, d), 50, "hellinger"), "d")


@query
def degree_histogram(s, d):
    return products.degree_histogram(_degrees(s, d))


@query
def clustering_histogram(s, d):
    return products.histogram_between_ends(rounded(_degrees(s, d), "cc"), "cc", 50)


@query
def clustering_summary(s, d):
    return rounded(products.clustering_summary(_degrees(s, d)), "cc_q05", "cc_median", "cc_q95", "cc_mean", "random_graph_cc")


@query
def matrix_order(s, d):
    rows = data.labels(s, d).join(_places(s, d), "id")
    return products.every_third(rows)


@query
def colour_limits(s, d):
    return rounded(products.colour_limits(_degrees(s, d), "cc"), "low", "high")


@query
def painted_map(s, d):
    v = _pix2v(s, d).groupBy("vertex").agg(F.avg((F.col("pixel") % 9).cast("double")).alias("v"))
    return products.paint(v, _pix2v(s, d), _places(s, d).withColumnRenamed("id", "pixel"))


@query
def mark_places(s, d):
    return rounded(products.mark_places(_outside(s, d).withColumnRenamed("grp", "region").filter("region is not null")), "lon", "lat")


@query
def season_graph_degree(s, d):
    """Flagship: seasons of suppliers, slope histograms at lag 7, Hellinger neighbours, degrees."""
    pts = settled(features.vectors(features.lag_hog(data.curves(s, d), 7)))
    k = min(K, max(1, pts.count() - 1))
    near = settled(distance.top_k(pts, k, "hellinger"))
    return graph.knn_edges(near, k).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


@query
def example_rates(s, d):
    """Rates at two lags of the climatology of the first supplier of each label."""
    c = prepare.climatology(data.curves(s, d)).groupBy("pixel").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda x: x["v"]).alias("s"))
    first = F.row_number().over(Window.partitionBy(F.col("pixel") % 3).orderBy("pixel")) == 1
    c = c.withColumn("one", first).filter("one")
    return rounded(c.select("pixel", F.posexplode(F.arrays_zip(A.lag_rate(F.col("s"), 7).alias("lag7"), A.lag_rate(F.col("s"), 31).alias("lag31"))).alias("day", "x")).select("pixel", "day", F.col("x.lag7").alias("lag7"), F.col("x.lag31").alias("lag31")), "lag7", "lag31")

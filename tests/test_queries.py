"""Registered queries against their SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SOME = ["season_days", "contract_duplicates", "year_subsets", "lag_hog", "occurrence", "fourier_harmonics", "phenology", "hellinger_pairs", "knn_edges", "degree_clustering", "laplacian_entries", "match_labels", "ari", "contiguity", "nearest_group_check", "border_distance", "border_sharpness", "kept_years", "medoids", "medoid_hog", "components_by_k", "first_connected_k", "small_components", "border_stats", "region_profile", "edge_darkness", "block_norm", "yearly_hog", "multiscale_hog", "yearly_multiscale_hog", "distance_sample", "degree_histogram", "clustering_histogram", "clustering_summary"]


def cell(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else repr(float(v) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*cols).collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in res.fetchall())


def test_scan_goes_on_until_the_graph_connects(spark, tmp_path):
    # two groups of twelve near copies: each vertex has eleven neighbours in its own
    rows = [(i, [float(10 + i), 1.0, 500.0] if i < 12 else [1.0, 500.0, float(10 + i)], i % 3) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.k: (r.n_comp, r.first) for r in entry.queries()["first_connected_k"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1, 24))
    assert all(n > 1 for k, (n, _) in got.items() if k < 12) and all(n == 1 for k, (n, _) in got.items() if k >= 12)
    assert [k for k, (_, first) in got.items() if first] == [12]
    small = {r.k for r in entry.queries()["small_components"](spark, str(tmp_path)).collect()}
    assert small == set(range(1, 12))


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "degree"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_graphs_of_all_k(spark, sf):
    """Each k's Fiedler value is the one of a dense Laplacian of that k alone."""
    import numpy as np

    from tidegraph.operators import graph, spectral
    from tidegraph.plans import queries as q

    got = {r["k"]: r["lambda"] for r in entry.queries()["fiedler_by_k"](spark, sf).collect()}
    first = [r["k"] for r in entry.queries()["first_connected_k"](spark, sf).filter("first").collect()]
    assert sorted(got) == list(range(first[0], 65))
    n = q.nbrs(spark, sf, q.SCAN)
    for k in (first[0], 64):
        entries = spectral.laplacian(spectral.gaussian_weights(graph.knn_edges(n, k), n)).toPandas()
        ids = np.unique(entries["src"])
        m = np.zeros((len(ids), len(ids)))
        m[np.searchsorted(ids, entries["src"]), np.searchsorted(ids, entries["dst"])] = entries["v"]
        assert got[k] == pytest.approx(np.linalg.eigvalsh(m)[1], abs=1e-9)


def test_partitions_of_other_k(spark, sf):
    got = {r["k"]: r["ari"] for r in entry.queries()["k_robustness"](spark, sf).collect()}
    assert sorted(got) == [8, 16, 32, 64] and all(-1 <= x <= 1 for x in got.values())


def test_queries_take_the_eigenvectors_that_they_read(spark, sf, monkeypatch):
    from tidegraph.operators import spectral

    asked, spectra = [], spectral.spectra

    def few(entries, q=25):
        asked.append(q)
        return spectra(entries, q)

    monkeypatch.setattr(spectral, "spectra", few)
    for name in ("nodal_domains", "spectral_correlations", "spectral_clusters"):
        assert entry.queries()[name](spark, sf).count() > 0
    assert asked == [2, 2, 3]

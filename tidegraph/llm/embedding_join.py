"""Embedding near-dedup: an exact range join in the angular metric.

Vectors within the angle r = acos(threshold) of each other link.  Pivots, spread out by
farthest-first choice from a bounded sample, partition the vectors: each is core in the
cell of its nearest pivot and, by the triangle inequality, halo in every cell whose
pivot is no farther than its own by more than 2 r and no farther than the cell's radius
plus r; no other cell can hold a neighbour.  There are as many pivots, up to the root of
the number of vectors, as leave the sample's vectors in COPIES cells on average: many for
clustered vectors, few where all directions are alike and cells exclude nothing.

Each cell compares core with core and halo in blocks of bounded size, as many as its own
counts ask for, so neither a cell's size nor a group of near copies goes into one task.
A core vector meets all its neighbours in its own cell, so counts add up there, and a
block sends on a spanning forest of its links, not the links.

Products are screened in single precision with a margin far above its error and decided
in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import components, written

#: Vectors from which pivots are chosen; cells that a vector of the sample may be in on average; core and halo rows of a block.
SAMPLE, COPIES, CORE, HALO = 2048, 4.0, 8192, 32768
MARGIN = 1e-4


def usable(v: Column) -> Column:
    """Whether a vector has a direction: components all there and finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(x: np.ndarray, most: int, r: float) -> np.ndarray:
    """Rows of x, each the farthest from those before it: of 1, 2, 4, ... up to most of them the largest number that leaves a row of x in COPIES cells on average."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        i = int(near.argmin())
        if near[i] >= 1 - 1e-9:
            break
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    angle = np.arccos(np.clip(x @ x[chosen].T, -1, 1))
    tried = sorted({len(chosen), *(1 << i for i in range(len(chosen).bit_length()))})
    k = max(k for k in tried if k == 1 or _cells(angle[:, :k], None, r)[0].sum(1).mean() <= COPIES)
    return x[chosen[:k]]


def _cells(angle: np.ndarray, radius: np.ndarray | None, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(which cells each row is in, its own one) by its angles to the pivots; without radii, those of these rows."""
    home = angle.argmin(1)
    own = angle[np.arange(len(angle)), home]
    if radius is None:
        radius = np.full(angle.shape[1], -9.0)
        np.maximum.at(radius, home, own)
    into = (angle <= own[:, None] + 2 * r + 1e-7) & (angle <= radius + r + 1e-7)
    into[np.arange(len(angle)), home] = True
    return into, home


def _angles(batch: pa.RecordBatch, pivots: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        x = _units(batch.column("embedding").take(pa.array(rows)), int(dim))
        yield rows, int(dim), np.arccos(np.clip(x @ pivots[int(dim)].T, -1, 1))


def _tally(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate([np.full(len(r[1]), r[0]) for r in rows]), *(np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["dim", "cell", "angle", "n"])


def _radii(shared):
    """(dim, cell, angle, n) of each batch: the largest angle of a cell's own vectors, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, dim, angle in _angles(batch, shared.value):
                home, top = angle.argmin(1), np.zeros(angle.shape[1])
                np.maximum.at(top, home, angle.min(1))
                n = np.bincount(home, minlength=angle.shape[1])
                at = np.flatnonzero(n)
                rows.append((dim, at, top[at], n[at]))
            if rows:
                yield _tally(rows)

    return run


def _members(shared, radii, r: float):
    """(dim, cell, angle 0, n) of each batch: vectors in each cell, core and halo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, dim, angle in _angles(batch, shared.value):
                n = _cells(angle, radii.value[dim], r)[0].sum(0)
                at = np.flatnonzero(n)
                rows.append((dim, at, np.zeros(len(at)), n[at]))
            if rows:
                yield _tally(rows)

    return run


def _copies(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of each of count copies' original, number of the copy)."""
    at = np.repeat(np.arange(len(count)), count)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)


def _replicas(shared, radii, blocks, r: float):
    """Each vector in the blocks of its cells: (dim, cell, i, j, node, core, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.asarray(batch.column("node"))
            for rows, dim, angle in _angles(batch, shared.value):
                into, home = _cells(angle, radii.value[dim], r)
                n_core, n_halo = blocks.value[dim]
                row, cell = np.nonzero(into)
                spread = (W.mix(node[rows[row]].astype(W.U)) >> W.U(17)).astype(np.int64)
                # every vector of a cell meets each block of its core ...
                at, k = _copies(n_core[cell])
                parts = [(row[at], cell[at], k, spread[at] % n_halo[cell[at]], np.zeros(len(at), bool))]
                # ... and its core each block of all of them
                own = np.flatnonzero(cell == home[row])
                at, k = _copies(n_halo[cell[own]])
                at = own[at]
                parts.append((row[at], cell[at], spread[at] % n_core[cell[at]], k, np.ones(len(at), bool)))
                row, cell, i, j, core = (np.concatenate(x) for x in zip(*parts, strict=True))
                got = batch.take(pa.array(rows[row], pa.int64()))
                yield pa.record_batch([got.column("dim"), *(pa.array(x, pa.int64()) for x in (cell, i, j)), got.column("node"), pa.array(core), got.column("embedding"), got.column("copies")], names=["dim", "cell", "i", "j", "node", "core", "embedding", "copies"])

    return run


def _block(threshold: float):
    """Of a block: for each core vector the copies that it links with, and a forest of the links (a row with a and b)."""

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        core = t["core"].to_numpy(zero_copy_only=False)
        node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        x = _units(t["embedding"], dim)
        a, b = np.flatnonzero(core), np.flatnonzero(~core)
        label = np.unique(node, return_inverse=True)
        root, of = np.arange(len(label[0])), label[1]
        count = np.zeros(len(a), np.int64)
        small = x.astype(np.float32)
        for i in range(0, len(a), 1024):
            for j in range(0, len(b), 4096):
                p, q = a[i : i + 1024], b[j : j + 4096]
                u, v = np.nonzero(small[p] @ small[q].T >= threshold - MARGIN)
                if not len(u):
                    continue
                ok = np.concatenate([np.einsum("ij,ij->i", x[p[u[k : k + 65536]]], x[q[v[k : k + 65536]]]) >= threshold for k in range(0, len(u), 65536)])
                u, v = p[u[ok]], q[v[ok]]
                count += np.bincount(np.searchsorted(a, u), weights=copies[v], minlength=len(a)).astype(np.int64)
                u, v = of[u], of[v]
                while True:
                    m = np.minimum(root[u], root[v])
                    old = root.copy()
                    np.minimum.at(root, root[u], m)
                    np.minimum.at(root, root[v], m)
                    root = root[root]
                    if (root == old).all():
                        break
        while (root[root] != root).any():
            root = root[root]
        tree = np.flatnonzero(root != np.arange(len(root)))
        n, m = len(a), len(tree)
        none = lambda k: np.zeros(k, np.int64)
        return pa.table({"node": np.concatenate((node[a], none(m))), "links": np.concatenate((count, none(m))), "a": np.concatenate((none(n), label[0][tree])), "b": np.concatenate((none(n), label[0][root[tree]]))})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, ...)``.

    n_links: other rows of cosine >= threshold, in double precision; component_id: the
    smallest vec_id that links reach, itself included; kept: vec_id is that.  A null, empty or
    zero vector, or one with a null or non-finite component, links with nothing, as do
    vectors of different lengths.  A null vec_id counts as a link of others, has null
    component_id and isn't kept.  Equal vectors are compared once, and counted as often as they
    occur; they are known by 64-bit hashes, and two different ones of one hash end the job.
    Other columns are ignored, whatever their names; no rows give no rows.
    """
    spark = vectors.sparkSession
    r = math.acos(threshold)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    clean = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast("double"))
    keyed = rows.filter(usable(F.col("embedding"))).withColumn("embedding", clean).withColumn("node", F.xxhash64("embedding"))
    other = F.hash("embedding")
    copies = F.when(F.min(other) == F.max(other), F.count(F.lit(1))).otherwise(F.raise_error(F.lit("two vectors of one hash")).cast("long"))
    classes = keyed.groupBy("node").agg(F.first("embedding").alias("embedding"), copies.alias("copies")).withColumn("dim", F.size("embedding"))
    if dict(vectors.dtypes)["embedding"] == "array<float>":
        classes = classes.withColumn("embedding", F.col("embedding").cast("array<float>"))
    classes = written(classes)
    sizes = {x["dim"]: x["count"] for x in classes.groupBy("dim").count().collect()}  # a row for each length of vectors
    pivots = {}
    for dim, n in sizes.items():
        some = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow()
        pivots[dim] = choose_pivots(_units(some["embedding"], dim), math.ceil(math.sqrt(n)), r)
    # of each cell, SAMPLE at most: its radius and numbers, then the blocks these ask for
    share = spark.sparkContext.broadcast
    shared, kind = share(pivots), "dim int, cell long, angle double, n long"
    base = classes.select("node", "embedding", "dim")
    radii = {d: np.full(len(p), -9.0) for d, p in pivots.items()}
    blocks = {d: (np.ones(len(p), np.int64), np.ones(len(p), np.int64)) for d, p in pivots.items()}
    for x in base.mapInArrow(_radii(shared), kind).groupBy("dim", "cell").agg(F.max("angle").alias("radius"), F.sum("n").alias("n")).collect():
        radii[x["dim"]][x["cell"]], blocks[x["dim"]][0][x["cell"]] = x["radius"], math.ceil(x["n"] / CORE)
    near = share(radii)
    for x in base.mapInArrow(_members(shared, near, r), kind).groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect():
        blocks[x["dim"]][1][x["cell"]] = math.ceil(x["n"] / HALO)
    of = dict(classes.dtypes)["embedding"]
    dealt = classes.select("node", "embedding", "dim", "copies").mapInArrow(_replicas(shared, near, share(blocks), r), f"dim int, cell long, i long, j long, node long, core boolean, embedding {of}, copies long")
    found = written(dealt.groupBy("dim", "cell", "i", "j").applyInArrow(_block(threshold), "node long, links long, a long, b long"))
    whole = components(found.filter("a <> b").select("a", "b"))
    links = found.filter("a = b").groupBy("node").agg(F.sum("links").alias("links"))
    ids = keyed.groupBy("node").agg(F.min("vec_id").alias("first"))
    named = written(ids.join(whole, "node", "left").join(links, "node", "left").select("node", "first", "links", F.coalesce("component", "node").alias("component")))
    least = written(named.groupBy("component").agg(F.min("first").alias("component_id")))
    named = written(named.join(least, "component").select("node", "links", "component_id"))
    out = rows.withColumn("node", F.when(usable(F.col("embedding")), F.xxhash64(clean)))
    out = out.join(named, "node", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

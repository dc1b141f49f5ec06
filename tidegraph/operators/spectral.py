"""Edge weights, Laplacian and spectrum.

Weights and Laplacian entries are relational, and so are the eigenvectors: Chebyshev-filtered
subspace iteration.  Vertices are dealt into cells of about CELL, and the vectors of a block
into parts.  Entries are sorted once into arrays for each two cells and stay where a cell's
steps are taken.  To multiply a part by the Laplacian, the entries of each cell meet its
rows, and sums by vertex go to the cells of those vertices.  A round filters the block by
such steps, so that what belongs to large eigenvalues shrinks, and rotates it to its Ritz
vectors: Gram matrices of the block, summed over tasks, are all that comes back.  Graphs
(values of ``run``) go through the rounds together, each until its residuals are small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Settled, settled

#: Eigenvalues of a normalised Laplacian lie between 0 and this.
UPPER = 2.0
#: Vertices of a cell, about, of a small graph; of a larger one half of it up to LARGEST: a vertex has a sum from each cell at most.
CELL, LARGEST = 1 << 14, 1 << 17
#: Vertices of a row of the state, vectors of a part at least, and vertices up to which a block has one part.
PIECE, PART, FEW = 8192, 4, 2048
#: Vertices up to which graphs are taken whole: their blocks have a column for each.
SMALL = 64
#: Vectors besides the wanted ones, at least.
GUARD = 13
#: Room above the wanted values, as a share of what is left to UPPER, that every other cut leaves.
ROOM = 0.005
#: Entries that are multiplied side by side, steps whose messages are on disk at once, and the share of a cell's vertices from which on their sums go without positions.
ENTRIES, STEPS, DENSE = 1 << 15, 8, 0.7
#: Growth of the lowest against the unwanted part in a filter of the first block and of a later one, steps of it at most, in the first rounds and later, and the least cut.
FIRST_GROWTH, GROWTH, DEGREE, LONG, LEAST = 1e5, 1e9, 24, 48, 0.002


def gaussian_weights(edges: DataFrame, nbrs: DataFrame, k_scale: int = 7, fallback: bool = False) -> DataFrame:
    """(src, dst, w): exp(-d^2 / (s s')) with s the distance to the k_scale-th neighbour.

    A scale of 0 is an error; with fallback it becomes the smallest positive scale.  For
    each run if neighbours and edges have a column ``run``; there, without a positive scale,
    it becomes the smallest positive distance, or 1 where all points are equal.
    """
    keys = ["run"] if "run" in nbrs.columns else []
    scale = nbrs.filter(F.col("rank") == k_scale).select(*keys, "i", F.col("d").alias("s"))
    if fallback:
        least = scale.filter("s > 0").groupBy(*keys).agg(F.min("s").alias("m"))
        if keys:  # a run all of whose scales are 0 keeps its edges
            d = F.when(F.col("d") > 0, F.col("d"))
            least = nbrs.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("rank") == k_scale, d)), F.min(d), F.lit(1.0)).alias("m"))
        scale = scale.join(F.broadcast(least), keys) if keys else scale.crossJoin(F.broadcast(least))  # one row, or one for each run
        scale = scale.select(*keys, "i", F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("m")).alias("s"))
    else:
        scale = scale.withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(F.raise_error(F.lit("equal points: contract them first")).cast("double")))
    one = nbrs.select(*keys, F.col("i").alias("src"), F.col("j").alias("dst"), "d")
    d = one.union(one.select(*keys, "dst", "src", "d")).groupBy(*keys, "src", "dst").agg(F.min("d").alias("d"))
    rows = edges.select(*keys, "src", "dst").join(d, [*keys, "src", "dst"])
    rows = rows.join(scale.select(*keys, F.col("i").alias("src"), F.col("s").alias("s1")), [*keys, "src"]).join(scale.select(*keys, F.col("i").alias("dst"), F.col("s").alias("s2")), [*keys, "dst"])
    return rows.select(*keys, "src", "dst", F.exp(-F.col("d") * F.col("d") / (F.col("s1") * F.col("s2"))).alias("w"))


def laplacian(weights: DataFrame) -> DataFrame:
    """(src, dst, v): entries of I - D^-1/2 W D^-1/2 off 0; a vertex without edges has none.  For each run if weights have a column ``run``."""
    keys = ["run"] if "run" in weights.columns else []
    deg = weights.groupBy(*keys, "src").agg(F.sum("w").alias("deg"))
    other = deg.select(*keys, F.col("src").alias("dst"), F.col("deg").alias("deg2"))
    off = weights.join(deg, [*keys, "src"]).join(other, [*keys, "dst"]).select(*keys, "src", "dst", (-F.col("w") / F.sqrt(F.col("deg") * F.col("deg2"))).alias("v"))
    return off.unionByName(deg.select(*keys, "src", F.col("src").alias("dst"), F.lit(1.0).alias("v")))


#: Numbers side by side are bytes, which pass from step to step as they are.
#: Entries that lead from a cell to one of a run's cells, by row.
_BLOCK = "run long, cell long, to long, row binary, col binary, v binary"
#: A part of a cell's vectors x (own) with what the next ones take from them within the cell, y; or sums x for a cell's vertices, those at the positions if there are any.
_MESSAGE = "run long, cell long, part int, own boolean, at binary, x binary, y binary"
#: Rows of vectors p of a cell's vertices from place first on, and their products c with the Laplacian.
_STATE = "run long, cell long, first int, c binary, p binary"
_SHARE = "run long, cell long, part int, first int, c binary, p binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _flat(column: pa.ChunkedArray, row: int, m: int) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer()).reshape(-1, m)


def _places(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({name: pa.array([r[k].tobytes() if kind == "binary" and r[k] is not None else r[k] for r in rows], _TYPES[kind]) for k, (name, kind) in enumerate(fields)})


def _bounds(m: int, parts: int) -> list[tuple[int, int]]:
    """First and last column of each part."""
    cuts = [m * k // parts for k in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _assembled(t: pa.Table, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, what the next ones are) of one part of a cell, m wide, from its messages."""
    own = int(np.flatnonzero(t["own"].to_numpy(zero_copy_only=False))[0])
    sums = _flat(t["y"], own, m).copy()
    for r in range(t.num_rows):
        if r != own:
            at = t["at"][r]
            sums[_places(at) if at.is_valid else slice(None)] += _flat(t["x"], r, m)
    return _flat(t["x"], own, m), sums


class _Entries:
    """The blocks of a cell: products with vectors of its vertices, for each cell that entries lead to."""

    def __init__(self, t: pa.Table, own: int):
        self.own, self.blocks = own, []
        for r in range(t.num_rows):
            row, col, v = _places(t["row"][r]), _places(t["col"][r]), np.frombuffer(t["v"][r].as_buffer())
            # pieces end with a row, so that each row's sum is whole
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
            cuts = np.unique(np.searchsorted(starts, np.arange(0, len(row) + ENTRIES, ENTRIES)))
            self.blocks.append((t["to"][r].as_py(), row, col, v, starts, cuts))

    def sums(self, block: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, sums of entries times x)."""
        _, row, col, v, starts, cuts = block
        out = np.empty((len(starts), x.shape[1]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = starts[lo], starts[hi] if hi < len(starts) else len(row)
            out[lo:hi] = np.add.reduceat(v[a:b, None] * x[col[a:b]], starts[lo:hi] - a)
        return row[starts], out

    def inside(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for block in self.blocks:
            if block[0] == self.own:
                at, sums = self.sums(block, x)
                out[at] = sums
        return out


def _sent(entries: _Entries, key: tuple[int, int, int], sizes: dict, x: np.ndarray, before: np.ndarray | None, scale: float, mid: float) -> list[tuple]:
    """Messages of a part: its vectors x with scale (inside - mid) x - before, and for each other cell scale times the sums for its vertices."""
    run, cell, part = key
    own = scale * (entries.inside(x) - mid * x)
    rows: list[tuple] = [(run, cell, part, True, None, x.reshape(-1), (own if before is None else own - before).reshape(-1))]
    for block in entries.blocks:
        if block[0] != cell:
            at, sums = entries.sums(block, x)
            n = sizes[(run, block[0])]
            if len(at) < DENSE * n:
                rows.append((run, block[0], part, False, at, (scale * sums).reshape(-1), None))
            else:
                whole = np.zeros((n, x.shape[1]))
                whole[at] = scale * sums
                rows.append((run, block[0], part, False, None, whole.reshape(-1), None))
    return rows


def _key(t: pa.Table) -> tuple[int, int, int]:
    return t["run"][0].as_py(), t["cell"][0].as_py(), t["part"][0].as_py()


def _multiplied(blocks: DataFrame, messages: DataFrame, fn) -> DataFrame:
    """Messages of the next step: fn(entries of a cell, its messages) for each part of all cells."""

    def run(own: pa.Table, t: pa.Table) -> pa.Table:
        key = _key(t)
        return _table(_MESSAGE, fn(_Entries(own, key[1]), key, t))

    return blocks.groupBy("run", "cell", "part").cogroup(messages.groupBy("run", "cell", "part")).applyInArrow(run, _MESSAGE)


def _scattered(x: np.ndarray) -> np.ndarray:
    """Numbers from -1 to 1 that look random, one for each of x."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(shift))
        x = x * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / 2.0**52 - 1


def _begun(bounds: list[tuple[int, int]], whole: set[int], sizes: dict):
    """Cogroup of entries with ids: random vectors, and what their products need.  Runs in ``whole``, of one cell and as many vertices as vectors at most, begin with unit vectors, so that their first Ritz vectors are eigenvectors."""
    m = bounds[-1][1]

    def run(entries: _Entries, key: tuple, t: pa.Table) -> list[tuple]:
        own, (lo, hi) = np.asarray(t["id"][0].values), bounds[key[2]]
        x = np.eye(len(own), m)[:, lo:hi].copy() if key[0] in whole else _scattered(own.astype(np.uint64)[:, None] * np.uint64(m) + np.arange(lo, hi, dtype=np.uint64))
        return _sent(entries, key, sizes, x, None, 1.0, 0.0)

    return run


def _first_step(bounds: list[tuple[int, int]], coefficients: dict[int, tuple[float, float]], sizes: dict, degree: int, alone: bool):
    """Cogroup of entries with shares of the state: the first Chebyshev step is known from it, what the second needs is sent; a graph of one cell takes all steps."""

    def run(entries: _Entries, key: tuple, t: pa.Table) -> list[tuple]:
        (mid, half), (lo, hi) = coefficients[key[0]], bounds[key[2]]
        order = np.argsort(t["first"].to_numpy())
        c, p = (np.concatenate([_flat(t[name], r, hi - lo) for r in order]) for name in ("c", "p"))
        before, x = p, (c - mid * p) / half
        for _ in range(degree - 1 if alone else 0):
            before, x = x, 2 / half * (entries.inside(x) - mid * x) - before
        return _sent(entries, key, sizes, x, None, 1.0, 0.0) if alone else _sent(entries, key, sizes, x, before, 2 / half, mid)

    return run


def _next_step(bounds: list[tuple[int, int]], coefficients: dict[int, tuple[float, float]], sizes: dict, last: bool):
    """Cogroup of entries with messages: one Chebyshev step, and what the next needs is sent; after the last one, the plain product."""

    def run(entries: _Entries, key: tuple, t: pa.Table) -> list[tuple]:
        (mid, half), (lo, hi) = coefficients[key[0]], bounds[key[2]]
        before, x = _assembled(t, hi - lo)
        return _sent(entries, key, sizes, x, None, 1.0, 0.0) if last else _sent(entries, key, sizes, x, before, 2 / half, mid)

    return run


def _state(messages: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        part = t["part"].to_numpy()
        both = [_assembled(t.take(np.flatnonzero(part == k)), hi - lo) for k, (lo, hi) in enumerate(bounds)]
        p, c = (np.concatenate([x[k] for x in both], 1) for k in range(2))
        key = t["run"][0].as_py(), t["cell"][0].as_py()
        return _table(_STATE, [(*key, lo, c[lo : lo + PIECE].reshape(-1), p[lo : lo + PIECE].reshape(-1)) for lo in range(0, len(p), PIECE)])

    return messages.groupBy("run", "cell").applyInArrow(run, _STATE)


def _shares(state: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The state, part by part."""
    m = bounds[-1][1]
    return _each_cell(state, m, lambda r, cell, first, c, p: [(r, cell, k, first, c[:, lo:hi].reshape(-1), p[:, lo:hi].reshape(-1)) for k, (lo, hi) in enumerate(bounds)], _SHARE)


def _each_cell(state: DataFrame, m: int, fn, schema: str) -> DataFrame:
    """fn(run, cell, first, c, p), rows of schema, of all rows of the state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for r in range(t.num_rows):
                yield from _table(schema, fn(t["run"][r].as_py(), t["cell"][r].as_py(), t["first"][r].as_py(), _flat(t["c"], r, m), _flat(t["p"], r, m))).to_batches()

    return state.mapInArrow(run, schema)


def _summed(state: DataFrame, m: int, fn, size: int) -> dict[int, np.ndarray]:
    """{run: sums over its cells of fn(run, c, p)}, size numbers for each run."""
    rows = _each_cell(state, m, lambda r, cell, first, c, p: [(r, np.asarray(fn(r, c, p)).reshape(-1))], "run long, x array<double>")
    out: dict[int, np.ndarray] = {}
    for r in rows.select("run", F.posexplode("x").alias("k", "x")).groupBy("run", "k").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r["run"], np.zeros(size))[r["k"]] = r["x"]
    return out


def _ritz(gram: np.ndarray, product: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, values): Ritz values, ascending, of a block with Gram matrix P'P and P'LP; at most rank of them, fewer where the block has less rank, the other columns 0."""
    m = len(gram)
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    w, v = np.linalg.eigh(gram * np.outer(scale, scale))
    keep = np.argsort(-w)[:rank]
    keep = keep[w[keep] > 1e-13 * w.max()]
    half = scale[:, None] * v[:, keep] / np.sqrt(w[keep])
    values, turn = np.linalg.eigh(half.T @ (product + product.T) / 2 @ half)
    rotation = np.zeros((m, m))
    rotation[:, : len(values)] = half @ turn
    return rotation, values


def cell_count(n: int) -> int:
    return -(-n // max(CELL, min(LARGEST, -(-n // 2))))


def _positions(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks of ``entries(run, cell, to, src, dst, v)``: ends by their places among the sorted ids of their cells."""

    def rows(t: pa.Table, own: pa.Table) -> pa.Table:
        row = np.searchsorted(np.asarray(own["id"][0].values), t["src"].to_numpy())
        return pa.table({"run": t["run"], "cell": t["cell"], "to": t["to"], "row": pa.array(row, pa.int32()), "dst": t["dst"], "v": t["v"]})

    def block(t: pa.Table, own: pa.Table) -> pa.Table:
        to, row, v = (t[c].to_numpy() for c in ("to", "row", "v"))
        col = np.searchsorted(np.asarray(own["id"][0].values), t["dst"].to_numpy()).astype(np.int32)
        order = np.lexsort((col, row, to))
        to, row, col, v = to[order], row[order], col[order], v[order]
        cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
        key = t["run"][0].as_py(), t["cell"][0].as_py()
        return _table(_BLOCK, [(*key, int(to[a]), row[a:b], col[a:b], v[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    of_cell = lambda: ids.select(*(F.col(c).alias(c) for c in ids.columns)).groupBy("run", "cell")
    placed = entries.groupBy("run", "to").cogroup(of_cell()).applyInArrow(rows, "run long, cell long, to long, row int, dst long, v double")
    return placed.groupBy("run", "cell").cogroup(of_cell()).applyInArrow(block, _BLOCK)


def ritz_vectors(entries: DataFrame, q: int, guard: int, tolerance: float = 1e-9, rounds: int = 40, enough: Callable[[np.ndarray, np.ndarray], bool] | None = None) -> tuple[DataFrame, int, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(state, columns, values, residuals): the q lowest eigenpairs of each run of ``entries(run, src, dst, v)``, in p of the state(run, id, p), bytes.

    Every vertex has an entry on the diagonal.  The block has ``guard`` columns more than
    asked for; a run with fewer vertices than columns has only as many values.  A run that
    hasn't come below the tolerance after so many rounds, nor to values and residuals that are ``enough``, ends with an error.
    """
    entries = entries.select(F.col("run").cast("long"), "src", "dst", "v")
    of_run = {r["run"]: r["n"] for r in entries.filter("src = dst").groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each run
    most = max(of_run.values(), default=1)
    m = most if most <= SMALL else min(q + guard, most)
    spark = entries.sparkSession
    cells = F.broadcast(spark.createDataFrame([(int(r), cell_count(n)) for r, n in of_run.items()], "run long, cells long"))  # a row for each run
    cell = lambda c: F.pmod(F.xxhash64(c), F.col("cells"))
    entries = settled(entries.join(cells, "run").select("run", cell("dst").alias("cell"), cell("src").alias("to"), "src", "dst", "v"))
    ids = settled(entries.filter("src = dst").groupBy("run", "cell").agg(F.array_sort(F.collect_list("src")).alias("id")))  # a cell each
    sizes = {(r["run"], r["cell"]): r["n"] for r in ids.select("run", "cell", F.size("id").alias("n")).collect()}  # a row for each cell
    large = sum(of_run.values()) > LARGEST // 4  # what is no longer read goes at once
    alone = max((cell_count(n) for n in of_run.values()), default=1) == 1
    parts = max(1, min(m // PART, -(-2 * spark.sparkContext.defaultParallelism // max(1, len(sizes))))) if sum(of_run.values()) > FEW else 1
    bounds = _bounds(m, parts)
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    at = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = settled(_positions(entries, ids))
    if large:
        Settled.drop(entries)
    # a part's entries stay where its steps are taken
    blocks = blocks.select("run", "cell", each, "to", "row", "col", "v").repartition(at, "run", "cell", "part").persist(StorageLevel.DISK_ONLY)
    whole = {r for r, n in of_run.items() if n <= m and cell_count(n) == 1}
    state = last = settled(_state(_multiplied(blocks, ids.select("run", "cell", each, "id"), _begun(bounds, whole, sizes)), bounds))
    done: list[DataFrame] = []
    values, residuals = {}, {}
    for round in range(rounds):
        grams = _summed(state, m, lambda r, c, p: np.stack([p.T @ p, p.T @ c]), 2 * m * m)
        turns = {r: _ritz(*g.reshape(2, m, m), of_run[r]) for r, g in grams.items()}
        shared = spark.sparkContext.broadcast({r: turn for r, (turn, _) in turns.items()})  # m x m for each run
        now = {r: v for r, (_, v) in turns.items()}
        turned = settled(_each_cell(state, m, lambda r, cell, first, c, p: [(r, cell, first, (c @ shared.value[r]).reshape(-1), (p @ shared.value[r]).reshape(-1))], _STATE))  # noqa: B023
        if large:
            Settled.drop(last)
        state = last = turned
        padded = {r: np.append(v, np.zeros(m - len(v))) for r, v in now.items()}
        far = {r: np.sqrt(x) for r, x in _summed(state, m, lambda r, c, p: ((c - p * padded[r]) ** 2).sum(0), m).items()}  # noqa: B023
        good = [r for r in now if len(now[r]) == of_run[r] or len(now[r]) >= q and (far[r][:q].max() < tolerance or enough is not None and enough(now[r][:q], far[r][:q]))]
        values |= {r: now[r] for r in good}
        residuals |= {r: far[r] for r in good}
        left = [int(r) for r in now if r not in good]
        done.append(state.filter(F.col("run").isin([int(r) for r in good])))
        if not left:
            blocks.unpersist()
            # a row has 8 bytes for each vertex and column
            own = F.slice("id", F.col("first") + 1, F.expr(f"cast(length(p) div {8 * m} as int)")).alias("id")
            return reduce(DataFrame.unionByName, done).join(ids, ["run", "cell"]).select("run", own, "p"), m, values, residuals
        state, own = state.filter(F.col("run").isin(left)), blocks.filter(F.col("run").isin(left))
        # the cut may be low for a block that isn't settled: the filter still shrinks all above it
        # one value may fill the block and more: a cut just above it would stop the block short of it
        room = {r: ROOM * (UPPER - now[r][: q][-1]) if round % 2 else 0.0 for r in left}
        cuts = {r: min(max(float(now[r][-1]), float(now[r][: q][-1]) + room[r], LEAST), UPPER - 0.1) for r in left}
        coefficients = {r: ((UPPER + a) / 2, (UPPER - a) / 2) for r, a in cuts.items()}
        steps = max(math.acosh(1 + 2 * a / (UPPER - a)) for a in cuts.values())
        degree = max(2, min(DEGREE if round < 3 else LONG, int(math.log(2 * (FIRST_GROWTH if round == 0 else GROWTH)) / steps)))
        messages, between = _multiplied(own, _shares(state, bounds), _first_step(bounds, coefficients, sizes, degree, alone)), None
        for k in range(2, degree + 1) if not alone else ():
            messages = _multiplied(own, messages, _next_step(bounds, coefficients, sizes, k == degree))
            if large and k % STEPS == 0 and k < degree:
                messages = settled(messages)
                if between is not None:
                    Settled.drop(between)
                between = messages
        state = settled(_state(messages, bounds))
        for table in (between, None if good else last):
            if large and table is not None:
                Settled.drop(table)
        last = state
    raise ValueError(f"no {q} eigenvalues to {tolerance} after {rounds} rounds")


def spectra(entries: DataFrame, q: int = 25) -> DataFrame:
    """(run, idx, lambda, residual, id, x) of ``entries(run, src, dst, v)``: the first q eigenvalues, ascending from 0, with unit vectors, the entry of largest size positive (the smallest id of equals); residual: |Lx - lambda x|."""
    block, m, values, residuals = ritz_vectors(entries, q, max(GUARD, q))
    table = [(int(r), i, float(values[r][i]), float(residuals[r][i])) for r in values for i in range(min(q, len(values[r])))]
    table = F.broadcast(block.sparkSession.createDataFrame(table, "run long, idx int, `lambda` double, residual double"))  # q rows for each run

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, own = _flat(batch.column("p"), r, m)[:, :q], np.asarray(batch.column("id")[r].values)
                at = np.tile(np.arange(x.shape[1], dtype=np.int32), len(own))
                yield pa.record_batch([pa.array(np.full(x.size, batch.column("run")[r].as_py())), pa.array(np.repeat(own, x.shape[1])), pa.array(at), pa.array(x.ravel())], names=["run", "id", "idx", "x"])

    rows = block.mapInArrow(part, "run long, id long, idx int, x double").join(table, ["run", "idx"])
    size = F.round(F.abs("x"), 7)  # entries of one size in theory differ in the last digits
    sign = rows.groupBy("run", "idx").agg(F.signum(F.max_by("x", F.struct(size, -F.col("id")))).alias("sign"))
    return rows.join(F.broadcast(sign), ["run", "idx"]).select("run", "idx", "lambda", "residual", "id", (F.col("x") * F.col("sign")).alias("x"))


def lowest_eigenvalues(entries: DataFrame, q: int) -> DataFrame:
    """(run, idx, lambda, residual): the first q eigenvalues of each run; their errors are of the size of the squared residuals."""
    block, _, values, residuals = ritz_vectors(entries, q, 14, 1e-6)
    rows = [(int(r), i, float(values[r][i]), float(residuals[r][i])) for r in values for i in range(min(q, len(values[r])))]
    return block.sparkSession.createDataFrame(rows, "run long, idx int, `lambda` double, residual double")


def _isolates(tolerance: float) -> Callable[[np.ndarray, np.ndarray], bool]:
    """Whether values and residuals tell the most isolated value and its gap.

    There are as many eigenvalues that lie, one by one, within the root of the summed squares
    of residuals of the values, so that a gap is off by twice that at most; the winner and
    its nearer neighbour, which is its gap, must come below the tolerance themselves.
    """

    def enough(values: np.ndarray, residuals: np.ndarray) -> bool:
        if len(values) < 3:
            return False
        step, off = np.diff(values), 2 * float(np.sqrt((residuals**2).sum()))
        gaps = np.append(np.minimum(step[:-1], step[1:]), step[-1])  # of the values from 1 on; the last one has one neighbour
        at = int(gaps.argmax())
        others = np.delete(gaps, at)
        sides = step[at : at + 2]
        near = at + 1 + (-1 if len(sides) == 1 or sides[0] <= sides[1] else 1)
        # the other side must be the farther one for certain
        sure = len(sides) == 1 or abs(sides[0] - sides[1]) > 2 * off
        return bool(sure and gaps[at] - others.max() > 2 * off and max(residuals[at + 1], residuals[near]) < tolerance)

    return enough


def isolating_eigenvalues(entries: DataFrame, q: int, tolerance: float = 1e-9) -> DataFrame:
    """(run, idx, lambda, residual): the first q eigenvalues of each run, as near as it takes to tell the most isolated one and its gap."""
    block, _, values, residuals = ritz_vectors(entries, q, 8, tolerance, enough=_isolates(tolerance))
    rows = [(int(r), i, float(values[r][i]), float(residuals[r][i])) for r in values for i in range(min(q, len(values[r])))]
    return block.sparkSession.createDataFrame(rows, "run long, idx int, `lambda` double, residual double")


def most_isolated(values: DataFrame, first: int = 1, last: int = 25) -> DataFrame:
    """One row (idx, gap) of ``values(idx, lambda)``: the eigenvalue from first to last - 1 whose nearer neighbour is farthest, the first of equals."""
    w = Window.orderBy("idx")  # a few eigenvalues
    gap = F.least(F.col("lambda") - F.lag("lambda").over(w), F.lead("lambda").over(w) - F.col("lambda"))
    rows = values.withColumn("gap", gap).filter((F.col("idx") >= first) & (F.col("idx") < last) & F.col("gap").isNotNull())
    return rows.orderBy(F.desc("gap"), "idx").limit(1).select("idx", "gap")


def nodal_domains(vector: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, sign, comp): connected parts of equal sign of ``vector(id, x)``; zeros are in none."""
    from .graph import components

    s = vector.filter("x <> 0").select("id", F.signum("x").cast("int").alias("sign"))
    a, b = s.select(F.col("id").alias("src"), F.col("sign").alias("s1")), s.select(F.col("id").alias("dst"), F.col("sign").alias("s2"))
    same = edges.join(a, "src").join(b, "dst").filter("s1 = s2").select("src", "dst")
    return components(s.select("id"), same).join(s, "id").select("id", "sign", "comp")


def domain_stats(domains: DataFrame, places: DataFrame) -> DataFrame:
    return domains.join(places, "id").groupBy("sign", "comp").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("lon", "lat", "elev", "active_days")))


def correlations(vector: DataFrame, places: DataFrame, low: float, high: float) -> DataFrame:
    """One row: Pearson correlation of x with lon, lat, elev, active_days, and with lon and elev in a band of elevation."""
    r = vector.join(places, "id")
    inside = F.col("elev").between(low, high)
    cols = [F.corr("x", c).alias(c) for c in ("lon", "lat", "elev", "active_days")]
    cols += [F.corr(F.when(inside, F.col("x")), F.when(inside, F.col(c))).alias(f"{c}_in_band") for c in ("lon", "elev")]
    return r.agg(*cols, F.count_if(inside).alias("band_n"))

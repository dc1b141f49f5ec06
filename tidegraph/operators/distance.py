"""Distances and nearest neighbours of ``points(id, v array<double>)``, for metrics.

Neighbours and pairs within a radius are found in cells.  A sample gives pivots that lie
apart, each point belongs to its nearest one, and tasks sum up how far the points of each
cell lie from every pivot.  From the least distances around the pivots follows how far the
k-th neighbour of a cell's points can be at most; by the triangle inequality that leaves
some other cells.  Cells are packed into blocks of bounded size, blocks with cells that
may have neighbours in each other meet in a task, and there only those cells are compared.
Where the bounds exclude nothing this is a comparison of all blocks with all.

Statistics of all pairs go through pairs of blocks, too; a task returns counts of bins, so
that no pair is stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import as_distribution
from ..sources.tables import settled

#: Points of a block of a small table, and blocks that a table is dealt into: blocks grow with
#: the table, so that copies of a point stay few, up to LARGEST points.
BLOCK, FEWEST, LARGEST = 2048, 8, 1 << 16
#: Rows and columns of a tile of products, and pairs whose exact distances are taken at once.
TILE, EACH = (512, 4096), 1 << 15
#: Angle for a unit of the logarithm by which roots of shares turn, and what part of them does.
TURN, TURNED = 0.6, 2 / 7
#: Pivots at most, and rows of the sample for each of them.
PIVOTS, SAMPLE = 256, 4
#: Bins of a histogram of distances, and distances that come back at most when the last bin is looked into.
BINS, EXACT = 4096, 20_000
METRICS = ("euclidean", "hellinger", "js")


def matrix(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of x to rows of y, in products: good to about 1e-8 of the rows' size where rows are almost equal, else to the last digits."""
    if metric == "js":
        return np.sqrt(np.maximum(np.stack([_js(row, y) for row in x]), 0.0)) if len(x) else np.zeros((0, len(y)))
    if metric == "hellinger":
        x, y = np.sqrt(x), np.sqrt(y)
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0))
    return d / math.sqrt(2) if metric == "hellinger" else d


def exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of x to the same row of y, by differences."""
    if metric == "js":
        return np.sqrt(np.maximum(_entropy((x + y) / 2) - (_entropy(x) + _entropy(y)) / 2, 0.0))
    if metric == "hellinger":
        return np.sqrt(((np.sqrt(x) - np.sqrt(y)) ** 2).sum(-1)) / math.sqrt(2)
    return np.sqrt(((x - y) ** 2).sum(-1))


def _slack(x: np.ndarray, metric: str) -> float:
    """How far a distance in products may be off."""
    return 0.0 if metric == "js" else 1e-7 * (1.0 if metric == "hellinger" else max(1e-300, float(np.sqrt((x * x).sum(1).max(initial=0)))))


def _between(xa: np.ndarray, xb: np.ndarray, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Exact distances of rows p of xa to rows q of xb as a function of p and q, EACH at a time, so that memory is bounded."""
    if metric == "js":
        ea, eb = _entropy(xa), _entropy(xb)

    def some(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        if metric == "js":
            return np.sqrt(np.maximum(_entropy((xa[p] + xb[q]) / 2) - (ea[p] + eb[q]) / 2, 0.0))
        return exact(xa[p], xb[q], metric)

    return lambda p, q: np.concatenate([np.zeros(0), *(some(p[lo : lo + EACH], q[lo : lo + EACH]) for lo in range(0, len(p), EACH))])


def _entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)


def _js(row: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _entropy((row + y) / 2) - (_entropy(row) + _entropy(y)) / 2


@dataclass
class Cells:
    """Cells of points around pivots, which of them are compared, and the blocks that they are packed into."""

    pivots: np.ndarray
    metric: str
    size: np.ndarray  # points of each cell
    need: np.ndarray  # need[i, j]: points of cell i may have neighbours in cell j
    first: np.ndarray  # first block of each cell
    parts: np.ndarray  # blocks of each cell

    @property
    def compared(self) -> int:
        """Ordered pairs of points that are compared."""
        return int(self.size @ self.need @ self.size)

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distances to all pivots) of each row."""
        d = matrix(v, self.pivots, self.metric)
        return d.argmin(1), d

    def block(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A cell larger than a block is dealt over several by id."""
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[cell] + (mixed % self.parts[cell].astype(np.uint64)).astype(np.int64)

    def blocks_of(self, cells: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([np.arange(self.first[c], self.first[c] + self.parts[c]) for c in cells] or [np.zeros(0, np.int64)]))


def _vectors(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    n = pc.list_value_length(column)
    if pc.min_max(n) == pc.min_max(pa.array([n[0].as_py()], n.type)) and not column.null_count:  # equal lengths: one run of numbers
        return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float)


def _spread_out(x: np.ndarray, n: int, metric: str) -> np.ndarray:
    """n rows of x, each the farthest from those before it."""
    chosen, far = [0], matrix(x[:1], x, metric)[0]
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, matrix(x[chosen[-1] :][:1], x, metric)[0])
    return x[chosen]


def _packed(size: np.ndarray, pivots: np.ndarray, metric: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each cell: cells next to each other share blocks of so many rows, larger ones have several of their own."""
    left, at, order = set(range(len(size))), 0, []
    d = matrix(pivots, pivots, metric)
    while left:  # on to the nearest cell that is left
        left.discard(at)
        order.append(at)
        if left:
            rest = np.fromiter(left, int)
            at = int(rest[d[at, rest].argmin()])
    first, parts, block, held = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0, 0
    for c in order:
        if held and held + size[c] > rows:
            block, held = block + 1, 0
        first[c], parts[c] = block, max(1, -(-int(size[c]) // rows))
        if parts[c] > 1:
            block, held = block + int(parts[c]), 0
        else:
            held += int(size[c])
    return first, parts


def cells(points: DataFrame, metric: str, k: int = 0, radius: float | None = None) -> Cells | None:
    """The cells of a search for the k nearest others, or for all within a radius; None without points.

    The sample and its pivots, and the sums of each cell, are bounded by PIVOTS and SAMPLE.
    """
    n = points.count()
    if not n:
        return None
    most = max(1, min(PIVOTS, int(2 * math.sqrt(n))))
    sample = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * most).select("v").toArrow()
    pivots = _spread_out(_vectors(sample["v"].combine_chunks()), most, metric)
    found = Cells(pivots, metric, *(np.zeros(len(pivots), np.int64) for _ in range(4)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, d = found.of(_vectors(batch.column("v")))
                yield from _cell_sums(own, d, k).to_batches()

    def merge(t: pa.Table) -> pa.Table:
        near = np.sort(np.concatenate([np.asarray(x.values) for x in t["near"]]))[: k + 1]
        low, high = (fn(np.stack([np.asarray(x.values) for x in t[c]]), axis=0) for c, fn in (("low", np.min), ("high", np.max)))
        return pa.table({"cell": t["cell"][:1], "n": pa.array([int(t["n"].to_numpy().sum())]), "near": [near], "low": [low], "high": [high]})

    schema = "cell long, n long, near array<double>, low array<double>, high array<double>"
    p = len(pivots)
    low, high, near = np.full((p, p), np.inf), np.full((p, p), -np.inf), [np.zeros(0)] * p
    for r in points.select("v").mapInArrow(part, schema).groupBy("cell").applyInArrow(merge, schema).collect():  # a row for each cell
        found.size[r["cell"]], near[r["cell"]] = r["n"], np.array(r["near"])
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    used = found.size > 0
    between = matrix(pivots, pivots, metric)
    reach = np.full(p, radius if radius is not None else np.inf)
    if radius is None:
        for i in np.flatnonzero(used):
            upto = np.sort(np.concatenate([between[i, j] + near[j] for j in np.flatnonzero(used)]))
            if len(upto) > k:  # the point itself is one of them
                reach[i] = high[i, i] + upto[k]
    slack = 4 * _slack(pivots, metric) + 1e-9
    found.need = np.zeros((p, p), bool)
    for i in np.flatnonzero(used):
        found.need[i] = ((low <= high[i] + reach[i] + slack) & (high >= low[i] - reach[i] - slack)).all(1) & used
    found.first, found.parts = _packed(found.size, pivots, metric, max(1, min(LARGEST, -(-n // FEWEST))))
    return found


def _cell_sums(own: np.ndarray, d: np.ndarray, k: int) -> pa.Table:
    """For each cell its points, their k + 1 least distances to its pivot, and least and greatest ones to every pivot."""
    rows = []
    for c in np.unique(own):
        x = d[own == c]
        rows.append({"cell": int(c), "n": len(x), "near": np.sort(x[:, c])[: k + 1], "low": x.min(0), "high": x.max(0)})
    kinds = (("cell", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("near", "low", "high")))
    return pa.table({c: pa.array([r[c] for r in rows], t) for c, t in kinds})


def _met(points: DataFrame, found: Cells, fn: Callable, schema: str) -> DataFrame:
    """fn(ids, vectors of some points, ids, vectors of what they are compared with) for all cells of blocks that meet."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partners = [found.blocks_of(np.flatnonzero(row)) for row in found.need]
        # a block's points go to all blocks that one of its cells needs
        of_block: dict[int, np.ndarray] = {}
        for block in range(int((found.first + found.parts).max())):
            inside = np.flatnonzero((found.first <= block) & (block < found.first + found.parts))
            of_block[block] = np.unique(np.concatenate([partners[c] for c in inside] or [np.zeros(0, np.int64)]))
        wanted = [found.blocks_of(np.flatnonzero(col)) for col in found.need.T]
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, _ = found.of(_vectors(batch.column("v")))
            block = found.block(cell, np.asarray(batch.column("id")))
            left = [of_block[b] for b in block]
            right = [wanted[c] for c in cell]
            for own, sides in ((True, left), (False, right)):
                n = np.array([len(x) for x in sides])
                at = np.repeat(np.arange(len(n)), n)
                other = np.concatenate(sides)
                i, j = (block[at], other) if own else (other, block[at])
                for lo in range(0, len(at), 1 << 14):
                    some = slice(lo, lo + (1 << 14))
                    row = pa.array(at[some])
                    yield pa.record_batch([pa.array(i[some]), pa.array(j[some]), pa.array(np.full(len(at[some]), own)), pa.array(cell[at[some]]), batch.column("id").take(row), batch.column("v").take(row)], names=["i", "j", "left", "cell", "id", "v"])

    def run(t: pa.Table) -> pa.Table:
        left, cell, ids = t["left"].to_numpy(zero_copy_only=False), t["cell"].to_numpy(), t["id"].to_numpy()
        v = _vectors(t["v"].combine_chunks())
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(ids[a])], b[np.argsort(ids[b])]
        out = []
        for c in np.unique(cell[a]):
            x, y = a[cell[a] == c], b[found.need[c][cell[b]]]
            if len(x) and len(y):
                out.append(fn(ids[x], v[x], ids[y], v[y]))
        return pa.concat_tables(out) if out else fn(ids[:0], v[:0], ids[:0], v[:0])

    dealt = points.select(F.col("id").cast("long"), "v").mapInArrow(deal, "i long, j long, left boolean, cell long, id long, v array<double>")
    return dealt.groupBy("i", "j").applyInArrow(run, schema)


def _ijd(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "d": pa.array(d, pa.float64())})


def _embedded(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows whose Euclidean distance is that of x, or sqrt(2) times the Hellinger distance, or up to sqrt(2) times the Jensen-Shannon distance and at least 0.98 of that.

    The square of the latter is a sum over the mean m of both shares of 1 - h(t), h being the
    entropy of shares 1 : e^l with l the difference of their logarithms.  Roots turned by an
    angle of w times the logarithm give 1 - sech(l / 2) cos(w l) instead; so mixed, it is
    nowhere above, and less than 2.5 % below, 1 - h(t).
    """
    if metric == "euclidean":
        return x
    root = np.sqrt(x)
    if metric == "hellinger":
        return root
    turn = TURN * np.log(np.where(x > 0, x, 1.0))
    own = math.sqrt(1 - TURNED) * root
    root *= math.sqrt(TURNED)
    return np.concatenate([own, root * np.cos(turn), root * np.sin(turn)], 1)


class _Products:
    """Single-precision products that order the rows of b by their distance to a row of a, and how far they may be off.

    Of row i of a and row j of b the product is (d^2 - |a_i|^2) / 2, d being the Euclidean
    distance of the rows that _embedded gives.  Rows are shifted to the mean of b
    and divided by the largest size, which changes no order.
    """

    def __init__(self, xa: np.ndarray, xb: np.ndarray, metric: str):
        a, b = _embedded(xa, metric), _embedded(xb, metric)
        mid = b.mean(0)
        a, b = a - mid, b - mid
        self.scale = max(float(np.sqrt((x * x).sum(1).max())) for x in (a, b)) or 1.0
        a, b = a / self.scale, b / self.scale
        self.square = (a * a).sum(1)
        self.a = np.hstack((-a, np.ones((len(a), 1)))).astype(np.float32)
        self.b = np.hstack((b, (b * b).sum(1)[:, None] / 2)).astype(np.float32).T
        self.off = 2.0**-22 * (a.shape[1] + 8)  # sizes are 1 at most
        self.unit = 1.0 if metric == "euclidean" else math.sqrt(2)

    def tile(self, i: slice, j: slice) -> np.ndarray:
        return self.a[i] @ self.b[:, j]

    def upto(self, i: slice, d: np.ndarray) -> np.ndarray:
        """The largest product that a distance d can have."""
        far = d * self.unit / self.scale * (1 + 1e-9)
        return ((far * far - self.square[i]) / 2 + self.off).astype(np.float32)[:, None]


def _nearest(ia: np.ndarray, xa: np.ndarray, ib: np.ndarray, xb: np.ndarray, k: int, metric: str) -> pa.Table:
    """The k nearest rows of b for each row of a, itself left out: products find those that may be, exact distances decide."""
    left, right = (np.isfinite(x).all(1) for x in (xa, xb))
    ia, xa, ib, xb = ia[left], xa[left], ib[right], xb[right]
    if not len(ia) or not len(ib) or k < 1:
        return _ijd(*(np.zeros(0),) * 3)
    products = _Products(xa, xb, metric)
    out: list[tuple] = []
    for lo in range(0, len(ia), TILE[0]):
        rows = slice(lo, lo + TILE[0])
        ids, between = ia[rows], _between(xa[rows], xb, metric)
        best = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]

        def taken(p: np.ndarray, q: np.ndarray, best: list, ids=ids, between=between) -> tuple[list, np.ndarray]:
            """The k best of each row, (row, column, distance), and up to where others may still be among them."""
            for at in range(0, len(p), 8 * EACH):
                i, j = p[at : at + 8 * EACH], q[at : at + 8 * EACH]
                other = ids[i] != ib[j]
                i, j = i[other], j[other]
                p_, q_, d = (np.concatenate(c) for c in zip(best, (i, j, between(i, j)), strict=True))
                order = np.lexsort((ib[q_], d, p_))
                p_, q_, d = p_[order], q_[order], d[order]
                keep = np.arange(len(p_)) - np.searchsorted(p_, p_) < k
                best = [p_[keep], q_[keep], d[keep]]
            far = np.full(len(ids), np.inf)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) == k)
            far[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
            return best, far

        tile = products.tile(rows, slice(0, TILE[1]))
        most = min(k + 1, tile.shape[1])  # the row itself may be one of them
        first = np.argpartition(tile, most - 1, 1)[:, :most] if most < tile.shape[1] else np.tile(np.arange(most), (len(ids), 1))
        _, far = taken(np.repeat(np.arange(len(ids)), most), first.reshape(-1), best)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(ib), TILE[1]):
            if at:
                tile = products.tile(rows, slice(at, at + TILE[1]))
            p, q = np.nonzero(tile <= products.upto(rows, far))
            held.append((p, q + at))
            if sum(len(h[0]) for h in held) > 2 * k * len(ids) or at + TILE[1] >= len(ib):
                best, far = taken(*(np.concatenate(c) for c in zip(*held, strict=True)), best)
                held = []
        out.append((ids[best[0]], ib[best[1]], best[2]))
    return _ijd(*(np.concatenate([o[c] for o in out]) for c in range(3)))


def top_k(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(i, j, d, rank): the k nearest others of each point, ties to the smaller id; rank from 1."""
    found = cells(points, metric, k)
    if found is None:
        return points.sparkSession.createDataFrame([], "i long, j long, d double, rank int")

    def fn(*sides) -> pa.Table:
        near = _nearest(*sides, k, metric)
        i, at = near["i"].to_numpy(), np.zeros(1, np.int64)
        if len(i):
            at = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i))
        lists = {c: pa.ListArray.from_arrays(pa.array(at, pa.int32()), near[c].combine_chunks()) for c in ("j", "d")}
        return pa.table({"i": pa.array(i[at[:-1]], pa.int64()), **lists})

    # a row for each point and block that it is compared with
    near = _met(points, found, fn, "i long, j array<long>, d array<double>").groupBy("i").agg(F.collect_list(F.struct("d", "j")).alias("of"))
    near = near.select("i", F.slice(F.sort_array(F.flatten(F.transform("of", lambda x: F.arrays_zip(x["d"].alias("d"), x["j"].alias("j"))))), 1, k).alias("of"))
    return near.select("i", F.posexplode("of").alias("rank", "x")).select("i", "x.j", "x.d", (F.col("rank") + 1).alias("rank"))


def top_k_of_runs(points: DataFrame, k: int) -> DataFrame:
    """(run, i, j, d, rank): the k nearest others inside each run of ``points(run, id, v, metric)``, all blocks of a run with all."""
    sizes = F.broadcast(points.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))  # a row for each run
    own = points.join(sizes, "run").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = own.select("run", F.col("b").alias("bi"), F.explode(every).alias("bj"), F.lit(True).alias("left"), "id", "v", "metric")
    right = own.select("run", F.explode(every).alias("bi"), F.col("b").alias("bj"), F.lit(False).alias("left"), "id", "v", "metric")

    def run(t: pa.Table) -> pa.Table:
        left, ids, v = t["left"].to_numpy(zero_copy_only=False), t["id"].to_numpy(), _vectors(t["v"].combine_chunks())
        order = np.argsort(ids, kind="stable")
        a, b = order[left[order]], order[~left[order]]
        near = _nearest(ids[a], v[a], ids[b], v[b], k, t["metric"][0].as_py())
        return near.append_column("run", pa.array(np.full(near.num_rows, t["run"][0].as_py()), pa.int64()))

    near = left.unionByName(right).groupBy("run", "bi", "bj").applyInArrow(run, "i long, j long, d double, run long")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("run", "i").orderBy("d", "j"))).filter(F.col("rank") <= k)


def within(points: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """(i, j, d) for i < j with d at most radius."""
    found = cells(points, metric, radius=radius)
    if found is None:
        return points.sparkSession.createDataFrame([], "i long, j long, d double")

    def fn(ia, xa, ib, xb):
        out: list[tuple] = []
        for lo in range(0, len(ia), 512):
            d = matrix(xa[lo : lo + 512], xb, metric)
            p, q = np.nonzero((d <= radius + 2 * _slack(xb, metric)) & (ia[lo : lo + 512, None] < ib[None]))
            far = exact(xa[lo + p], xb[q], metric)
            keep = far <= radius
            out.append((ia[lo + p[keep]], ib[q[keep]], far[keep]))
        return _ijd(*(np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)))

    return _met(points, found, fn, "i long, j long, d double")


def _block_pairs(points: DataFrame, fn: Callable, schema: str, rows: int) -> DataFrame:
    """fn(ids, vectors, ids, vectors, same) for all pairs i <= j of blocks of about so many rows."""
    n = max(1, math.ceil(points.count() / rows))
    own = points.select(F.col("id").cast("long").alias("id"), "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    left = own.select(F.col("b").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("left"), "id", "v").filter("i <= j")
    right = own.select(F.explode(every).alias("i"), F.col("b").alias("j"), F.lit(False).alias("left"), "id", "v").filter("i < j")

    def run(t: pa.Table) -> pa.Table:
        left, ids, v = t["left"].to_numpy(zero_copy_only=False), t["id"].to_numpy(), _vectors(t["v"].combine_chunks())
        order = np.argsort(ids, kind="stable")
        a, b = order[left[order]], order[~left[order]]
        same = t["i"][0].as_py() == t["j"][0].as_py()
        return fn(ids[a], v[a], *((ids[a], v[a]) if same else (ids[b], v[b])), same)

    return left.unionByName(right).groupBy("i", "j").applyInArrow(run, schema)


def _tiles(x: np.ndarray, y: np.ndarray, same: bool, metric: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, distances) of tiles; of equal sides those from the diagonal on, the diagonal and what is below it not a number."""
    for i in range(0, len(x), 1024):
        for j in range(i if same else 0, len(y), 1024):
            d = matrix(x[i : i + 1024], y[j : j + 1024], metric)
            if same and i == j:
                d[np.tril_indices(len(d))] = np.nan
            yield i, j, d


def pairs(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(i, j, d) for i < j: all of them.  A task holds two blocks of points and gives their pairs away EACH at a time."""
    return _pairs(points.select("id", "v"), metric)


def every_pair(points: DataFrame, step: int, metric: str = "euclidean") -> DataFrame:
    """(i, j, d, place): of all pairs i < j in the order of (i, j) every step-th, by its place from 0.  Places follow from the ends' numbers, so that no other pair's distance is taken."""
    from .prepare import number

    numbered = settled(points.select(F.col("id").cast("long").alias("id"), "v").join(number(points.select(F.col("id").cast("long").alias("id")), "id", "no"), "id"))
    return _pairs(numbered, metric, step)


def _pairs(points: DataFrame, metric: str, step: int = 0) -> DataFrame:
    n, sampled = points.count(), "no" in points.columns
    blocks = max(1, math.ceil(n / max(min(BLOCK, 1024), min(LARGEST, -(-n // 16)))))
    own = points.select(F.col("id").cast("long").alias("id"), "v", *(["no"] if sampled else []), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = own.select(F.col("b").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("left"), *own.drop("b").columns).filter("i <= j")
    right = own.select(F.explode(every).alias("i"), F.col("b").alias("j"), F.lit(False).alias("left"), *own.drop("b").columns).filter("i < j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        left, ids, v = t["left"].to_numpy(zero_copy_only=False), t["id"].to_numpy(), _vectors(t["v"].combine_chunks())
        order = np.argsort(ids, kind="stable")
        same = t["i"][0].as_py() == t["j"][0].as_py()
        a, b = order[left[order]], order[left[order] if same else ~left[order]]
        no = t["no"].to_numpy() if sampled else None
        between = _between(v[a], v[b], metric)
        rows = max(1, EACH // max(1, len(b)))
        for lo in range(0, len(a), rows):
            p = np.repeat(np.arange(lo, min(lo + rows, len(a))), len(b))
            q = np.tile(np.arange(len(b)), len(p) // max(1, len(b)))
            if same:
                p, q = p[q > p], q[q > p]
            low, high = np.minimum(ids[a[p]], ids[b[q]]), np.maximum(ids[a[p]], ids[b[q]])
            more = {}
            if sampled:
                u, w = np.minimum(no[a[p]], no[b[q]]), np.maximum(no[a[p]], no[b[q]])
                place = u * n - u * (u + 1) // 2 + w - u - 1
                keep = place % step == 0
                p, q, low, high, more = p[keep], q[keep], low[keep], high[keep], {"place": pa.array(place[keep])}
            d = between(p, q)
            finite = np.isfinite(d)
            out = pa.RecordBatch.from_pydict({"i": pa.array(low), "j": pa.array(high), "d": pa.array(d), **more})
            yield out if finite.all() else out.filter(pa.array(finite))

    schema = "i long, j long, d double" + (", place long" if sampled else "")
    return left.unionByName(right).groupBy("i", "j").applyInArrow(run, schema)


def _wide(points: DataFrame) -> int:
    """Rows of a block whose pairs are only counted: copies of a point stay few, and a task's two blocks small."""
    return max(BLOCK, min(32 * BLOCK, points.count() // 16))


def histogram(points: DataFrame, low: float, high: float, bins: int, metric: str = "euclidean", digits: int = 6) -> DataFrame:
    """(bin, n): distances of all pairs, rounded, in equal bins from low to high, both ends included; bins without pairs are not there."""
    width, unit = (high - low) / bins, 10.0**digits

    def place(d: np.ndarray) -> np.ndarray:
        x = np.floor(d * unit + 0.5) / unit
        return np.where((x >= low) & (x <= high), np.minimum(np.floor((x - low) / width), bins - 1), bins).astype(int)

    def fn(ia, xa, ib, xb, same):
        n = np.zeros(bins + 1, np.int64)
        off = max(_slack(xa, metric), _slack(xb, metric)) + 0.51 / unit
        for i, j, d in _tiles(xa, xb, same, metric):
            p, q = np.nonzero(np.isfinite(d))
            d = d[p, q]
            at = place(d)
            edge = np.abs((d - low) / width - np.rint((d - low) / width)) * width <= off
            at[edge] = place(exact(xa[i + p[edge]], xb[j + q[edge]], metric))
            n += np.bincount(at, minlength=bins + 1)
        some = np.flatnonzero(n[:bins])
        return pa.table({"bin": pa.array(some, pa.int32()), "n": pa.array(n[some])})

    return _block_pairs(points, fn, "bin int, n long", _wide(points)).groupBy("bin").agg(F.sum("n").alias("n"))


def order_statistics(points: DataFrame, ranks: list[int], metric: str = "euclidean") -> dict[int, float]:
    """{rank: the distance of that rank, from 0, among all pairs i < j}.

    Tasks count distances in BINS of each open bracket, Spark sums the counts, and the bins
    that hold the ranks are the next brackets, until few enough distances lie in them to
    come back as they are: a pass is over pairs of blocks of points, and nothing but counts
    of bins is shuffled besides points.
    """
    size, bins = _wide(points), BINS

    def counted(brackets: list[tuple[float, float]]) -> list[np.ndarray]:
        def fn(ia, xa, ib, xb, same):
            n = [np.zeros(bins + 2, np.int64) for _ in brackets]
            for _, _, d in _tiles(xa, xb, same, metric):
                d = d[np.isfinite(d)]
                for k, (lo, hi) in enumerate(brackets):
                    n[k] += np.bincount(_bin_of(d, lo, hi, bins), minlength=bins + 2)
            some = np.flatnonzero(np.concatenate(n))
            return pa.table({"k": pa.array(some), "n": pa.array(np.concatenate(n)[some])})

        out = np.zeros(len(brackets) * (bins + 2), np.int64)
        for r in _block_pairs(points, fn, "k long, n long", size).groupBy("k").agg(F.sum("n").alias("n")).collect():  # bins of the brackets
            out[r["k"]] = r["n"]
        return np.split(out, len(brackets))

    def gathered(brackets: list[tuple[float, float]]) -> list[np.ndarray]:
        def fn(ia, xa, ib, xb, same):
            rows: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
            for i, j, d in _tiles(xa, xb, same, metric):
                for k, (lo, hi) in enumerate(brackets):
                    p, q = np.nonzero(np.isfinite(d) & (d >= lo) & (d <= hi))
                    rows.append((np.full(len(p), k), d[p, q], exact(xa[i + p], xb[j + q], metric)))
            return pa.table({c: np.concatenate([r[n] for r in rows]) for n, c in enumerate(("k", "near", "d"))})

        rows = _block_pairs(points, fn, "k long, near double, d double", size).groupBy("k", "near", "d").agg(F.count(F.lit(1)).alias("n")).collect()  # EXACT of them for each rank
        return [sorted((r["near"], r["d"], r["n"]) for r in rows if r["k"] == k) for k in range(len(brackets))]

    top = 1.0 + 1e-6
    if metric == "euclidean":
        far = points.select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("r")).agg(F.max("r")).first()[0] or 0.0
        top = 2 * far * (1 + 1e-6) + 1e-300
    open_ = {r: (0.0, top, 0) for r in ranks}  # bracket, distances below it
    found: dict[int, float] = {}
    for _ in range(6):
        brackets = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        ready = []
        for (lo, hi), n in zip(brackets, counted(brackets), strict=True):
            below = np.concatenate(([0], np.cumsum(n)))
            for r, (a, b, _) in list(open_.items()):
                if (a, b) == (lo, hi):
                    at = int(np.searchsorted(below, r, "right")) - 1
                    if at > bins:
                        raise ValueError(f"there is no rank {r}")
                    open_[r] = (*_edges_of(at, lo, hi, bins), int(below[at]))
                    if n[at] <= EXACT:
                        ready.append(r)
        brackets = sorted({open_[r][:2] for r in ready})
        for (lo, hi), rows in zip(brackets, gathered(brackets) if brackets else [], strict=True):
            for r in ready:
                if r in open_ and open_[r][:2] == (lo, hi):
                    ends = np.cumsum([n for _, _, n in rows])
                    found[r] = sorted(d for _, d, n in rows for _ in range(n))[r - open_.pop(r)[2]] if len(ends) else lo
        if not open_:
            break
    # more equal distances than come back: the bracket is as narrow as numbers are
    return found | {r: lo for r, (lo, _, _) in open_.items()}


def _edges_of(bin: int, lo: float, hi: float, bins: int) -> tuple[float, float]:
    """Least and greatest number of a bin, 0 being all below lo."""
    step = (hi - lo) / bins
    first = lo + (bin - 1) * step
    return first, float(np.nextafter(lo + bin * step, -np.inf)) if bin < bins else hi


def _bin_of(d: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    """0 below lo, 1 to bins inside, bins + 1 above hi, by the edges that _edges_of gives."""
    edges = np.concatenate((lo + np.arange(bins) * ((hi - lo) / bins), [np.nextafter(hi, np.inf)]))
    return np.searchsorted(edges, d, "right")


def summary_of_pairs(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """One row: min, q05, median, q95, max of the distances of all pairs, quantiles interpolated."""
    n = points.count()
    last = n * (n - 1) // 2 - 1
    names = (("min", 0.0), ("q05", 0.05), ("median", 0.5), ("q95", 0.95), ("max", 1.0))
    spark = points.sparkSession
    if last < 0:
        return spark.createDataFrame([(None,) * 5], ", ".join(f"{c} double" for c, _ in names))
    at = [q * last for _, q in names]
    found = order_statistics(points, sorted({f(x) for x in at for f in (math.floor, math.ceil)}), metric)
    row = [found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x)) for x in at]
    return spark.createDataFrame([tuple(map(float, row))], ", ".join(f"{c} double" for c, _ in names))


def as_distributions(points: DataFrame) -> DataFrame:
    """Squares of v over their sum."""
    return points.withColumn("v", as_distribution(F.transform("v", lambda x: x * x)))


def edge_distances(edges: DataFrame, points: DataFrame) -> DataFrame:
    """edges(i, j) with the Hellinger distance d of their ends in ``points(id, v)``: both ends' vectors join the edges, no other pair is looked at."""
    roots = points.select("id", F.transform("v", F.sqrt).alias("q"))
    both = edges.join(roots.select(F.col("id").alias("i"), F.col("q").alias("a")), "i").join(roots.select(F.col("id").alias("j"), F.col("q").alias("b")), "j")
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return both.select("i", "j", F.sqrt(square / 2).alias("d"))

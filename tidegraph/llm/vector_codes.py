"""Vector compression by codebooks: each part of a vector becomes the number of its nearest entry.

Components are whole numbers, floor(SCALE x), so that every distance and mean is exact and
each run gives the same codes.  Rounds of assignment and mean start from the vectors of
the smallest ids; a round sends the codebooks out (ENTRIES rows of a vector's size), each
task sums its parts by entry, and only these sums come back.

Assignment is memoised on a grid.  A part lies in a coarse cell, a box of the grid; an
entry whose least distance to the box is above some other entry's greatest distance to it
can be nearest to no point of it.  The entries that are left are found once for a cell,
kept under the hash of its coordinates, and only they are evaluated for the parts in it.
The width of cells follows the codebook's own distances and decides nothing but time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, maybe_broadcast, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Whole-number components are below this, so that squared distances of parts of 1,024 components and sums over 2 ** 31 vectors fit in 64 bits.
LIMIT = 1 << 25
#: Rows that are evaluated side by side, and cells that a task remembers for each part.
ROWS, CELLS = 512, 1 << 15
#: A cell's width is this share of the median distance between an entry and its nearest other one, divided by the root of the components.
WIDTH = 0.25


class Memo:
    """The entries of one codebook that can be nearest, by cell."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.width = cell_width(entries)
        self.known: dict[bytes, np.ndarray] = {}
        self.evaluated = self.asked = 0

    def _fill(self, cells: np.ndarray, keys: list[bytes]) -> None:
        """Candidates of new cells, from the least and greatest distances of boxes and entries."""
        if len(self.known) + len(keys) > CELLS:
            self.known.clear()
        low = cells * self.width
        high = low + self.width - 1  # whole numbers: a box ends before the next
        e = self.entries[None]
        below, above = low[:, None] - e, e - high[:, None]
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(-1)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(-1)
        stay = least <= most.min(1, keepdims=True)  # ties stay: the lower index wins them
        for key, row in zip(keys, stay, strict=True):
            self.known[key] = np.flatnonzero(row)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, ties to the lower index, squared distance to it) of each row."""
        code, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for lo in range(0, len(x), ROWS):
            part = x[lo : lo + ROWS]
            cells, of = np.unique(part // self.width, axis=0, return_inverse=True)
            of = of.reshape(-1)
            keys = [c.tobytes() for c in cells]
            new = [i for i, k in enumerate(keys) if k not in self.known]
            if len(new):
                held = {k: self.known[k] for k in keys if k in self.known}
                self._fill(cells[new], [keys[i] for i in new])
                self.known |= held
            lists = [self.known[k] for k in keys]
            size = np.array([len(c) for c in lists])
            first = np.cumsum(size) - size
            n = size[of]
            begin = np.cumsum(n) - n
            row = np.repeat(np.arange(len(part)), n)
            entry = np.concatenate(lists)[np.arange(n.sum()) - np.repeat(begin - first[of], n)]
            d = ((part[row] - self.entries[entry]) ** 2).sum(1)
            best = np.minimum.reduceat(d, begin)
            hit = np.where(d == np.repeat(best, n), entry, len(self.entries))
            code[lo : lo + ROWS], far[lo : lo + ROWS] = np.minimum.reduceat(hit, begin), best
            self.asked += len(part)
            self.evaluated += int(n.sum())
        return code, far


def cell_width(entries: np.ndarray) -> int:
    if len(entries) < 2 or not entries.shape[1]:
        return 1
    x = entries.astype(float)
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    return max(1, int(WIDTH * np.sqrt(np.median(d.min(1)) / x.shape[1])))


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE x) of each component, null for a vector that is null or holds null or non-finite components."""
    x = F.transform(vector.cast("array<double>"), lambda v: v * SCALE)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.when(F.exists(x, lambda v: F.abs(v) >= float(LIMIT)), F.raise_error(F.lit(f"a component is {LIMIT // SCALE} or more"))).otherwise(F.transform(x, lambda v: F.floor(v).cast("long")))
    return F.when(vector.isNotNull() & ~bad, x)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, PARTS, 1)]


def _sums(shared, dim: int):
    """Inside mapInArrow: (part, entry, n, total) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(c) for c in shared.value]
        n = [np.zeros(len(m.entries), np.int64) for m in memos]
        total = [np.zeros(m.entries.shape, np.int64) for m in memos]
        for batch in batches:
            for k, x in enumerate(_parts(_matrix(batch.column("x"), dim))):
                code, _ = memos[k].nearest(x)
                n[k] += np.bincount(code, minlength=len(n[k]))
                np.add.at(total[k], code, x)
        for k in range(PARTS):
            used = np.flatnonzero(n[k])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * (dim // PARTS), pa.int32()), pa.array(total[k][used].reshape(-1)))
            yield pa.record_batch([pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(n[k][used]), flat], names=["part", "entry", "n", "total"])

    return run


def fit_codebooks(rows: DataFrame, dim: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, from ``rows(id, x array<long>)`` with dim components each: the first ENTRIES rows by id, nulls last, then by x, moved for some rounds."""
    first = rows.orderBy(F.col("id").isNull(), "id", "x").limit(ENTRIES).collect()  # ENTRIES rows
    books = _parts(np.array([r["x"] for r in first], np.int64).reshape(len(first), dim))
    share = rows.sparkSession.sparkContext.broadcast
    width = dim // PARTS
    for _ in range(rounds if first and width else 0):
        found = rows.mapInArrow(_sums(share(books), dim), "part int, entry int, n long, total array<long>")
        total = F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(width)))
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect():  # PARTS ENTRIES rows
            books[r["part"]][r["entry"]] = [t // r["n"] for t in r["total"]]
    return books


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, column: str = "embedding", id: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vectors with code, error, label_error; the codebooks).

    Rows whose vector is null or holds null or non-finite components are left out.  code
    has two hex digits for each part, error is the squared distance to the entries, and
    label_error its sum over the rows of the same label, nulls being one label.  Ties go to
    the lower index; repeated rows get equal codes and count as often as they come; ids may
    be null or repeat.  No rows give no rows and empty codebooks.  Columns code, error and
    label_error are replaced, others stay, whatever their names.  Vectors of different
    lengths, of a length that the parts don't divide, or with a component of LIMIT / SCALE
    or more end with an error.
    """
    old = vectors.drop("code", "error", "label_error")
    x = free_name(old.columns, "x")
    rows = written(old.withColumn(x, whole_numbers(F.col(f"`{column}`"))).filter(F.col(x).isNotNull()))
    sizes = rows.agg(F.min(F.size(x)).alias("low"), F.max(F.size(x)).alias("high")).first()
    if sizes["low"] != sizes["high"] or (sizes["low"] or 0) % PARTS:
        raise ValueError(f"vectors have {sizes['low']} to {sizes['high']} components; they need one length, a multiple of {PARTS}")
    dim = sizes["low"] or 0
    books = fit_codebooks(rows.select(F.col(f"`{id}`").alias("id"), F.col(x).alias("x")), dim, rounds)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    names = old.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in shared.value]
        for batch in batches:
            codes, error = [], np.zeros(batch.num_rows, np.int64)
            for k, part in enumerate(_parts(_matrix(batch.column(x), dim))):
                code, far = memos[k].nearest(part)
                codes.append(code)
                error += far
            text = [bytes(c).hex() for c in np.stack(codes, 1).astype(np.uint8)]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(text, pa.string()), pa.array(error)], names=[*names, "code", "error"])

    schema = old.schema.add("code", "string").add("error", "long")
    out = written(rows.mapInArrow(run, schema))
    sums = written(out.groupBy(F.col(f"`{label}`").alias("label of sum")).agg(F.sum("error").alias("label_error")))
    sums = maybe_broadcast(sums, 40 * sums.count())
    out = out.join(sums, F.col(f"`{label}`").eqNullSafe(F.col("label of sum"))).drop("label of sum")
    return out, books

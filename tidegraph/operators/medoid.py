"""Medoids of regions without all pairs: bounds by the triangle inequality drop most candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled
from .distance import FEWEST, LARGEST, TILE, _slack, _vectors, exact, matrix

#: Candidates of each region in the first round, and of all regions together in a later one at most.
FIRST, MOST = 16, 1024
#: Candidates that bounds may leave after two rounds before all their sums are taken at once.
FEW = 4096


def _least(rows: DataFrame, m: int) -> DataFrame:
    """(lab, id) of the m rows of ``rows(lab, id, low)`` with the least bound in each region: m of each task meet in a group."""

    def pick(t: pa.Table) -> pa.Table:
        t = t.append_column("mixed", pa.array((t["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)))
        return t.sort_by([("low", "ascending"), ("mixed", "ascending"), ("id", "ascending")]).slice(0, m).select(["lab", "id", "low"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            labs = np.asarray(batch.column("lab"))
            for lab in np.unique(labs):
                own = t.filter(pa.array(labs == lab))
                held[lab] = pick(pa.concat_tables([held[lab], own]) if lab in held else own)
        for t in held.values():
            yield from t.to_batches()

    schema = "lab long, id long, low double"
    return rows.select("lab", "id", "low").mapInArrow(part, schema).groupBy("lab").applyInArrow(pick, schema).select("lab", "id")


def _all_sums(left: DataFrame, rows: DataFrame, size: dict[int, int], metric: str) -> DataFrame:
    """left(id, lab, v, low) with low raised to what its distances to its region's rows(id, lab, v) sum up to at least: blocks of both meet in tasks, FEWEST of a region or more."""
    spark = left.sparkSession
    table = [(int(lab), max(FEWEST, -(-n // LARGEST))) for lab, n in size.items()]
    blocks = F.broadcast(spark.createDataFrame(table, "lab long, blocks int"))  # a row for each region
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    one = left.join(blocks, "lab").select("lab", block.alias("i"), every.alias("j"), F.lit(True).alias("own"), "id", "v")
    two = rows.join(blocks, "lab").select("lab", every.alias("i"), block.alias("j"), F.lit(False).alias("own"), "id", "v")

    def run(t: pa.Table) -> pa.Table:
        own, v = t["own"].to_numpy(zero_copy_only=False), _vectors(t["v"].combine_chunks())
        a, b = v[own], v[~own]
        s = np.zeros(len(a))
        off = _slack(v, metric) * len(b)
        for i in range(0, len(a), TILE[0]):
            for j in range(0, len(b), TILE[1]):
                s[i : i + TILE[0]] += matrix(a[i : i + TILE[0]], b[j : j + TILE[1]], metric).sum(1)
        ids = t["id"].to_numpy()[own]
        return pa.table({"lab": pa.array(np.full(len(ids), t["lab"][0].as_py()), pa.int64()), "id": pa.array(ids), "s": pa.array(s * (1 - 1e-12) - off)})

    s = one.unionByName(two).groupBy("lab", "i", "j").applyInArrow(run, "lab long, id long, s double").groupBy("lab", "id").agg(F.sum("s").alias("s"))
    return left.join(s, ["lab", "id"]).select("id", "lab", "v", F.greatest("low", "s").alias("low"))


def search(points: DataFrame, labels: DataFrame, metric: str = "hellinger") -> tuple[DataFrame, int]:
    """((lab, id, d), compared): in each region of ``labels(id, lab)`` the point of ``points(id, v)`` with the least mean distance to the others, the smallest id of equals, and how many distances it took.

    The distances of a round's candidates to their whole region give their sums S exactly,
    and from |S(p) - n d(i, p)| <= S(i) a bound for every other point i; points whose bound
    exceeds the region's best sum are done with.  The next candidates are those with the
    least bounds, twice as many.  Where the bounds leave more than FEW after two rounds, the
    sums of all that are left are taken at once, block by block, in products; what these may
    be off is in the bounds, and the rounds go on with the few that may still win.  Regions are few: some hundreds.  A
    region of one point has no mean and no row; points without a region, null vectors and
    null labels are left out.
    """
    spark = points.sparkSession
    rows = points.filter("v is not null").join(labels.filter("lab is not null"), "id")
    rows = settled(rows.select(F.col("id").cast("long").alias("id"), F.col("lab").cast("long").alias("lab"), F.col("v").cast("array<double>").alias("v")))
    size = {r["lab"]: r["n"] for r in rows.groupBy("lab").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").collect()}  # a row for each region
    best: dict[int, tuple[float, int]] = {}
    left, m, compared = rows.filter(F.col("lab").isin(list(size))).withColumn("low", F.lit(0.0)), FIRST, 0
    rounds = 0
    while size:
        names = settled(_least(left, m))
        chosen: dict[int, list] = {}
        for r in left.join(names, ["lab", "id"]).orderBy("lab", "id").select("lab", "id", "v").collect():  # m for each region
            chosen.setdefault(r["lab"], []).append((r["id"], np.array(r["v"])))
        if not chosen:
            break
        sent = spark.sparkContext.broadcast({lab: (np.array([i for i, _ in c]), np.stack([v for _, v in c])) for lab, c in chosen.items()})

        def distances(batch: pa.RecordBatch, sent=sent) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            """(region, its places in the batch, candidates, distances) of each region of the batch that has candidates."""
            labs, v = np.asarray(batch.column("lab")), _vectors(batch.column("v"))
            for lab in np.unique(labs):
                if int(lab) in sent.value:
                    ids, c = sent.value[int(lab)]
                    at = np.flatnonzero(labs == lab)
                    yield int(lab), at, ids, np.stack([exact(v[at], one[None], metric) for one in c], 1)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for lab, _, _, d in distances(batch):
                    total[lab] = total.get(lab, 0.0) + d.sum(0)
            for lab, s in total.items():
                ids = sent.value[lab][0]
                yield pa.record_batch([pa.array(np.full(len(ids), lab)), pa.array(ids), pa.array(s)], names=["lab", "id", "s"])

        whole: dict[int, dict[int, float]] = {}
        for r in rows.select("lab", "v").mapInArrow(sums, "lab long, id long, s double").groupBy("lab", "id").agg(F.sum("s").alias("s")).collect():  # a row for each candidate
            whole.setdefault(r["lab"], {})[r["id"]] = r["s"]
        for lab, found in whole.items():
            compared += len(found) * size[lab]
            top = min([*found.values(), *([best[lab][0]] if lab in best else [])])
            same = [i for i, s in found.items() if s <= top * (1 + 1e-12)]
            if lab in best and best[lab][0] <= top * (1 + 1e-12):
                same.append(best[lab][1])
            best[lab] = (top, min(same))
        known = spark.sparkContext.broadcast((whole, dict(best), dict(size)))

        def bounded(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            whole, best, size = known.value
            for batch in batches:
                low, keep = np.asarray(batch.column("low")).copy(), np.zeros(batch.num_rows, bool)
                ids = np.asarray(batch.column("id"))
                for lab, at, c, d in distances(batch):
                    s = np.array([whole[lab][int(i)] for i in c])
                    low[at] = np.maximum(low[at], np.abs(s - size[lab] * d).max(1))
                    keep[at] = (low[at] <= best[lab][0] * (1 + 1e-9)) & ~np.isin(ids[at], c)
                yield pa.record_batch([batch.column("id"), batch.column("lab"), batch.column("v"), pa.array(low)], names=["id", "lab", "v", "low"]).filter(pa.array(keep))

        left = settled(left.mapInArrow(bounded, "id long, lab long, v array<double>, low double"))
        m, rounds = max(1, min(2 * m, MOST // len(size))), rounds + 1
        if rounds == 2:
            many = {r["lab"]: r["n"] for r in left.groupBy("lab").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each region
            if sum(many.values()) > FEW:
                compared += sum(n * size[lab] for lab, n in many.items())
                left, m = settled(_all_sums(left, rows, size, metric)), max(1, min(FIRST, MOST // len(size)))
    return spark.createDataFrame([(lab, i, s / (size[lab] - 1)) for lab, (s, i) in sorted(best.items())], "lab long, id long, d double"), compared


def medoids(points: DataFrame, labels: DataFrame, metric: str = "hellinger") -> DataFrame:
    """(lab, id, d) as ``search`` finds them."""
    return search(points, labels, metric)[0]

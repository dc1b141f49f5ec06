"""What several operators need of Spark: tables in the shared folder, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.tables import table

__all__ = ["all_rows", "components", "free_name", "labelled_sample", "maybe_broadcast", "numbered", "table", "whole_groups", "words_of", "written"]
#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def written(df: DataFrame) -> DataFrame:
    """The same rows, as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing before it."""
    return tables.settled(df)


def free_name(taken: list[str], stem: str) -> str:
    """stem, with as many dashes behind it as it takes to differ from the names taken, in any case of letters."""
    low = {c.lower() for c in taken}
    while stem.lower() in low:
        stem += "-"
    return stem


def maybe_broadcast(df: DataFrame, size: int) -> DataFrame:
    """df to be broadcast if its size in bytes, measured by the caller, is within BROADCAST_BYTES; else Spark decides how to join it."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with places 0, 1, ... in the order of a distinct key: counts of ranges first, then places inside each, so that no task holds all rows."""
    part = free_name(df.columns, "range no")
    ranged = written(df.repartitionByRange(key).withColumn(part, F.spark_partition_id()))
    ahead = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = ranged.groupBy(F.col(f"`{part}`").alias("of")).agg(F.count(F.lit(1)).alias("n")).select(F.struct("of", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")).alias("range count"))
    place = F.row_number().over(Window.partitionBy(f"`{part}`").orderBy(key)) - 1 + F.col("`range count`.before")
    both = ranged.join(F.broadcast(counts), F.col(f"`{part}`") == F.col("`range count`.of"))
    return both.withColumn(name, place.cast("long")).drop(part, "range count")


def all_rows(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A partition's rows as one table, None if it has none."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of a partition in order of an integer key, each key whole in one of them: memory is bounded by that and the largest group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= rows:
            last = held[-1].column(key)[-1].as_py()
            here = np.asarray(batch.column(key))
            end = int(np.argmax(here != last)) if here[-1] != last else len(here)
            held.append(batch.slice(0, end))
            if end == len(here):
                size += end
                continue
            yield pa.Table.from_batches(held)
            held, size, batch = [], 0, batch.slice(end)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, max_chars: int) -> DataFrame:
    """(text, quality, h): for each quality, 0 and 1, at most ``sample`` rows of docs, first by hash, of at most max_chars characters.

    First so many labelled ids are chosen by their hash, then so many of their rows by a
    hash of id and text: neither many ids nor one that repeats very often makes it larger.
    """
    pick = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = None
    for q in (0, 1):
        some = pick.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = some if ids is None else ids.union(some)
    rows = docs.filter("text is not null").filter(F.length("text") <= max_chars).select("doc_id", "text")
    rows = rows.join(F.broadcast(ids), "doc_id").select("text", "quality", F.xxhash64("doc_id", "text").alias("h"))  # 2 sample ids
    place = F.row_number().over(Window.partitionBy("quality").orderBy("h", "text"))  # limited in each task, before the shuffle
    return rows.withColumn("place", place).filter(F.col("place") <= sample).drop("place")


def words_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges(a, b)`` reaches.

    Min-neighbour contraction.  Every node takes the smallest label among itself and
    its neighbours, edges are rewritten to labels, and edges inside one label go; the
    graph shrinks by a constant factor a round for nodes in random order.  Labels are
    minima (partial aggregates), and each join has two plain tables, so that Spark can
    split a hub's rows.  Nulls and loops count as no edge; without edges it is empty.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    edges = written(edges.union(edges.select("b", "a")).distinct())
    levels: list[DataFrame] = []
    while True:
        level = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
        levels.append(level)
        one = edges.join(level, edges.a == level.node).select(F.col("label").alias("a"), "b")
        two = one.join(level, one.b == level.node).select("a", F.col("label").alias("b"))
        edges = written(two.filter("a <> b").distinct())
        if edges.isEmpty():
            break
    whole = levels.pop()
    while levels:
        up = whole.select(F.col("node").alias("label"), F.col("label").alias("top"))
        whole = written(levels.pop().join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
    return whole.select("node", F.col("label").alias("component"))

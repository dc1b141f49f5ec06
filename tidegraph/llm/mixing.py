"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target in words.  Whole passes over the source use up what they can;
for the rest, documents are counted by exact length, a proportional number of each
length is taken whole until the budget left fits the table of a bounded-knapsack dynamic
program, which then comes as near to it as any set of the documents still there.  Only
(source, length, count) rows enter it.  Which documents of a length are taken is decided
by a seeded hash: those up to a limit, which counts by hash bucket and a rank inside one
bucket find.  Texts don't move: each row looks up the limit of its source and length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, maybe_broadcast, numbered, written

WEIGHTS = (3.0, 1.0, 2.0)
#: Hash buckets are the top bits of the hash: 1024 of them.
BUCKET_BITS = 10
#: Words that the dynamic program's table covers at least; it always covers twice the longest document.
TABLE = 65_536


def level_of(sources: DataFrame, total: float, most: float) -> float:
    """The level at which least(level * weight, most * words) sums to total over ``sources(words, weight)``: shares by weight, the excess of full sources reshared until none is above.  If all are full, infinity.

    Each round reads one row: what full sources hold, and the weight of the others.
    """
    level, before = 0.0, -1
    while True:
        full = F.col("weight") * level > most * F.col("words")
        row = sources.agg(F.count_if(full).alias("full"), F.sum(F.when(full, most * F.col("words")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if row["full"] == before or not row["free"]:
            return level if row["free"] else float("inf")
        before, level = row["full"], (total - row["held"]) / row["free"]


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, at most counts: their words come to budget, or as near below as the program can.

    Up to a budget of TABLE words (or twice the longest document) no set of documents comes
    nearer.  Above it documents are taken in proportion first and the program fits the rest.
    """
    size, have = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(n * c for n, c in zip(size, have, strict=True))
    if budget >= total:
        return np.array(have, np.int64)
    table = max(TABLE, 2 * max(size, default=0))
    ahead = max(0, budget - table)
    take = [c * ahead // total for c in have]
    gap = budget - sum(k * n for k, n in zip(take, size, strict=True))
    for i in sorted(range(len(size)), key=lambda i: -size[i]):  # long ones first, down to what the table covers
        if gap > table:
            k = min(have[i] - take[i], -(-(gap - table) // size[i]))
            take[i] += k
            gap -= k * size[i]
    for i, k in _closest(size, [h - t for h, t in zip(have, take, strict=True)], gap):
        take[i] += k
    return np.array(take, np.int64)


def _closest(size: list[int], have: list[int], gap: int) -> list[tuple[int, int]]:
    """(position, copies) of documents whose words come nearest below gap.

    Bit s of ``reached`` says that some set has s words; copies of a length enter as 1, 2,
    4, ... and the rest, and each s remembers the step that first reached it.
    """
    full, reached = (1 << gap + 1) - 1, 1
    step_of, steps = np.full(gap + 1, -1, np.int32), []
    for i in sorted(range(len(size)), key=lambda i: size[i]):
        left, part = min(have[i], gap // size[i]) if size[i] else 0, 1
        while left and not reached >> gap & 1:
            part = min(part, left)
            new = reached << size[i] * part & full & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(gap // 8 + 1, "little"), np.uint8)
                step_of[np.flatnonzero(np.unpackbits(bits, count=gap + 1, bitorder="little"))] = len(steps)
                steps.append((i, part))
                reached |= new
            left -= part
            part *= 2
    at, out = reached.bit_length() - 1, []
    while at:
        i, part = steps[step_of[at]]
        out.append((i, part))
        at -= part * size[i]
    return out


def _fit(t: pa.Table) -> pa.Table:
    extra = fit_budget(t["size"].to_numpy(), t["docs"].to_numpy(), t["budget"][0].as_py())
    return pa.table({"source_no": t["source_no"], "size": t["size"], "extra": pa.array(extra)})


def word_count(text: Column) -> Column:
    """The number of words of a column, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.xxhash64("text"))


def source_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_no, words, weight, target, passes, budget) of ``sizes(source, words)``, a row for each source.

    Sources in order of code points, null last, get the weights in turn and share ``share``
    times all words, none above ``most`` times its own.  passes: how often all of the source
    is taken; budget: the words still to take.
    """
    order = F.struct(F.col("source").isNull().alias("last"), F.col("source").alias("name"))
    rows = numbered(sizes.withColumn("order", order), "order", "source_no").drop("order")
    rows = written(rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))))
    total = rows.agg(F.sum("words")).first()[0] or 0
    level = level_of(rows, share * total, most)
    rows = rows.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.lit(float(most)) * F.col("words")))
    passes = F.when(F.col("words") > 0, F.least(F.floor(F.col("target") / F.col("words")), F.lit(int(most)))).otherwise(0).cast("long")
    rows = rows.withColumn("passes", passes)
    budget = F.when((F.col("words") > 0) & (F.col("passes") < most), F.round(F.col("target") - F.col("passes") * F.col("words"))).otherwise(0).cast("long")
    return rows.withColumn("budget", budget)


def _limits(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, size, words, target, passes, limit, ties, some) for each source and size of ``narrow(source, size, h)``.

    A document with h < limit is taken once more; of the ``ties`` ones with h = limit, equal
    in doc_id and text, ``some`` are.
    """
    bucket = F.shiftright("h", 64 - BUCKET_BITS)
    cells = written(narrow.groupBy("source", "size", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("docs")))
    cells = cells.join(plan, cells["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    pairs = cells.groupBy("source_no", "size").agg(F.first("source").alias("source"), F.first("words").alias("words"), F.first("target").alias("target"), F.first("passes").alias("passes"), F.first("budget").alias("budget"), F.sum("docs").alias("docs"))
    extra = written(pairs.filter("size > 0").select("source_no", "size", "docs", "budget").groupBy("source_no").applyInArrow(_fit, "source_no long, size long, extra long"))
    pairs = pairs.join(extra, ["source_no", "size"], "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    # the bucket in which the number of documents to take is reached, and how many of it that are
    order = Window.partitionBy("source_no", "size").orderBy("bucket")
    reach = cells.select("source_no", "size", "bucket", F.sum("docs").over(order).alias("upto"), "docs").join(extra.filter("extra > 0"), ["source_no", "size"])
    cut = reach.filter("upto >= extra and upto - docs < extra").select("source_no", "size", "bucket", (F.col("extra") - F.col("upto") + F.col("docs")).alias("rest"))
    cut = cut.join(plan.select("source_no", F.col("source").alias("of")), "source_no")
    inside = narrow.withColumn("bucket", bucket).join(cut.withColumnRenamed("size", "of_size").withColumnRenamed("bucket", "of_bucket"), F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("bucket") == F.col("of_bucket")))
    equal = inside.groupBy("source_no", "size", "h").agg(F.first("rest").alias("rest"), F.count(F.lit(1)).alias("ties"))
    upto = F.sum("ties").over(Window.partitionBy("source_no", "size").orderBy("h"))
    limit = equal.withColumn("upto", upto).filter("upto >= rest and upto - ties < rest").select("source_no", "size", F.col("h").alias("limit"), "ties", (F.col("rest") - F.col("upto") + F.col("ties")).alias("some"))
    return written(pairs.join(limit, ["source_no", "size"], "left").select("source", "size", "words", "target", "passes", "limit", "ties", "some"))


def _mixed(docs: DataFrame, name: str, weights: tuple[float, ...], share: float, most: float, seed: str) -> DataFrame:
    """docs with a struct ``name`` of size, source_size, target and copies."""
    key, limit = free_name([*docs.columns, name], "mix key"), free_name([*docs.columns, name], "mix limit")
    narrow = written(docs.select("source", word_count(F.col("text")).alias("size"), _hash(seed).alias("h")))
    plan = source_plan(narrow.groupBy("source").agg(F.sum("size").alias("words")), weights, share, most)
    limits = _limits(narrow, plan)
    keyed = docs.withColumn(key, F.struct(F.col("source"), word_count(F.col("text")).alias("size"), _hash(seed).alias("h")))
    extent = limits.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 100).alias("bytes"), F.count_if(F.col("some") < F.col("ties")).alias("tied")).first()
    side = maybe_broadcast(limits.select(F.struct("*").alias(limit)), extent["bytes"] or 0)
    k, m = (lambda f: F.col(f"`{key}`.{f}")), (lambda f: F.col(f"`{limit}`.{f}"))
    found = keyed.join(side, k("source").eqNullSafe(m("source")) & (k("size") == m("size")))
    tied = (k("h") == m("limit")) & (m("some") < m("ties"))
    more = F.when((k("h") < m("limit")) | ((k("h") == m("limit")) & ~tied), 1).otherwise(0)
    result = lambda more: F.struct(k("size").alias("size"), m("words").alias("source_size"), m("target").alias("target"), (m("passes") + more).alias("copies"))
    if not extent["tied"]:
        return found.withColumn(name, result(more)).select(*docs.columns, name)
    # rows equal in doc_id and text of which only some are taken: by their place in a written table, counted by its parts
    place = free_name([*docs.columns, name, key, limit], "mix place")
    some = written(found.filter(tied).withColumn(place, F.struct(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))))
    p = lambda f: F.col(f"`{place}`.{f}")
    group = [k("source"), k("size"), p("part")]
    parts = some.groupBy(k("source").alias("source"), k("size").alias("size"), p("part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    ahead = free_name([*docs.columns, name, key, limit, place], "mix ahead")
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.struct("source", "size", "part", "before").alias(ahead))
    a = lambda f: F.col(f"`{ahead}`.{f}")
    ranked = some.join(parts, k("source").eqNullSafe(a("source")) & (k("size") == a("size")) & (p("part") == a("part")))
    rank = a("before") + F.row_number().over(Window.partitionBy(*group).orderBy(p("at")))
    ranked = ranked.withColumn(place, rank).withColumn(name, result(F.when(F.col(f"`{place}`") <= m("some"), 1).otherwise(0)))
    return found.filter(~F.coalesce(tied, F.lit(False))).withColumn(name, result(more)).select(*docs.columns, name).union(ranked.select(*docs.columns, name))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes, repeats counted).

    Sources in order of code points, null last, get the weights in turn and share
    ``share`` times all words, none above ``most`` times its own.  A document's size is its
    number of words, of the whole text however long (null: 0); it is taken whole 0 or more
    times, size 0 never counts.  Columns of docs with these four names are replaced, others
    stay whatever their names.  Repeated rows are documents of their own; of rows equal in
    doc_id and text some may be taken more often.  No rows give no rows.
    """
    new = ("size", "source_size", "target", "taken")
    old = docs.drop(*new)
    name = free_name(old.columns, "mix result")
    rows = _mixed(old, name, weights, share, most, seed)
    r = lambda f: F.col(f"`{name}`.{f}")
    return rows.select(*(F.col(f"`{c}`") for c in old.columns), r("size").alias("size"), r("source_size").alias("source_size"), r("target").alias("target"), (r("copies") * r("size")).cast("long").alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """docs as often as the mix takes them, in their own columns, all of which stay; documents without words go.  Nulls, ties and repeated rows as in mix; no rows give no rows."""
    name = free_name(docs.columns, "mix result")
    rows = _mixed(docs, name, WEIGHTS, 1.5, 2.0, "mix").filter(F.col(f"`{name}`.size") > 0)
    again = free_name([*docs.columns, name], "mix copy")
    return rows.withColumn(again, F.explode(F.array_repeat(F.lit(True), F.col(f"`{name}`.copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))

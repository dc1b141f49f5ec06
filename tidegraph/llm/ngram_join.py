"""N-gram Jaccard join: an exact metric-space join of shingle sets.

The Jaccard distance of sets and the size of their symmetric difference are both
metrics; every step is an instance of "assign to a pivot's region, replicate what
the triangle inequality cannot exclude, join regions on their own".

1. *Shingle regions.*  With the one-element sets {s} as pivots, a document's nearest
   pivots are its own shingles; ties go to the first in one global order.  Two sets of
   distance <= r differ in few enough elements that their first common shingle is among
   the first n - ceil(t n) + 1 of each, t = 1 - r: these are the regions a set is
   replicated to.  The order puts rare shingles first, by the number of sets that hold
   them, as counted for the share POOL of all shingles of smallest hash; the others
   follow by hash.  A set with enough shingles of its own needs no region at all.
   Shingles that are frequent batch by batch stand last, by the counts of these batches,
   so that their rows can be dealt over many tasks.
2. *Windows inside a region.*  Where the region's shingle is the first that two sets have
   in common, they share no more than what lies behind it in the order of each; that
   leaves a set a window of partner sizes, often an empty one.  CLASSES hash classes of
   shingles act as further pivots: the parities of a set in them differ in at most as many
   classes as the symmetric difference has elements, so two sets whose parities are further
   apart than sets of distance r can be are no pair.  The remaining candidates only say
   which sets share a *block*, a linear number.  A region of more than REGION_ROWS sets is
   not searched: its sets share a block for now.
3. *Regions within blocks.*  Blocks of more than max_rows sets are taken apart by the same
   two steps on their own: all shingles of their sets are counted within the block, so that
   those of one set come first and those of many come last, and a set is replicated to the
   regions of its first ones in this order.  Large regions of this level fall into parts by
   size and hash, and parts whose sizes allow a link meet two by two, each pair in a task
   of its own.  What candidates connect now are the blocks that are joined.
4. *Document pivots.*  A block is joined exactly.  Sets within r of a pivot document
   are linked to it, and sets of one component need no comparing.  What is outside the
   main component meets the rest by Voronoi regions of the pivots, in parts of bounded
   size: two parts are joined only if the triangle inequality leaves it for every pivot,
   and so are two sets in them.  Large blocks do this as Spark jobs, small ones in a
   task, by recursion on what lies outside the pivot's ball.

Nothing is sampled or capped: links between different sets are all found, or implied
by a chain of found ones.  Sets are identified by a 64-bit digest and compared as
64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import components, free_name, maybe_broadcast, whole_groups, written

CLASSES = 1024
OFTEN_TYPE = pa.list_(pa.struct([("shingle", pa.int64()), ("sets", pa.int64())]))
#: The share of all shingles, those of smallest hash, that are counted.
POOL = 0.3
_POOL_END = W.U(int(POOL * 2**64))
#: A shingle is frequent in a batch if it is in this share of its sets, and in OFTEN_LEAST of them.
OFTEN, OFTEN_LEAST = 0.01, 16
#: Rows of a frequent shingle that one task sees when regions are found.
DEAL_ROWS = 1024
#: Frequent shingles stand after all others in the order, by the counts they have in batches above this.
LAST = 1 << 40
#: Sets of a region that meet in one task.
REGION_ROWS = 4096
#: What a text with words holds: a character that is no ASCII space.
WORD = "[^\\x20\\x09-\\x0D]"


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    buf, offs, _ = W.text_buffers(batch.column("text"))
    for lo, hi in W.groups(offs):
        part, o = W.lower(buf[offs[lo] : offs[hi]]), offs[lo : hi + 1] - offs[lo]
        starts, ends, first = W.find_words(part, o)
        for k, s in enumerate(W.shingle_sets(W.hash_words(part, starts, ends), first, n)):
            yield lo + k, s


def _digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(s: np.ndarray) -> bytes:
    """A bit for each class: whether the set has an odd number of shingles in it."""
    return np.packbits(np.bincount((s >> W.U(54)).astype(np.int64), minlength=CLASSES).astype(np.uint8) & 1).tobytes()


def _reach(size: int, percent: int) -> int:
    """Of a set's first so many shingles one is in every set that it links with."""
    return size - -(-percent * size // 100) + 1


def _sign(n: int, percent: int):
    """A row for each document: its key, shingles, those that are counted, digest of the set (null without shingles), class counts; a batch's first row also has the shingles that are frequent in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, pool, node, sketch, heads = [], [], [], [], {}
            for _, s in _sets(batch, n):
                size.append(len(s))
                pool.append(int(np.searchsorted(s, _POOL_END)))
                node.append(_digest(s) if len(s) else None)
                sketch.append(_sketch(s) if len(s) else None)
                if len(s):
                    heads[node[-1]] = s[: _head(s, percent)]
            often: list = [None] * len(size)
            if heads:
                often[0] = _often(list(heads.values()))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("key"), *(pa.array(x, pa.int64()) for x in (size, pool, node)), pa.array(sketch, pa.binary()), pa.array(often, OFTEN_TYPE)], names=["doc_id", "key", "n", "pool", "node", "sketch", "often"])

    return run


def _head(s: np.ndarray, percent: int) -> int:
    """So many of a set's shingles, by hash, are regions it may be replicated to."""
    return max(int(np.searchsorted(s, _POOL_END)), _reach(len(s), percent))


def _often(heads: list[np.ndarray]) -> list[dict]:
    """Shingles in many of the sets, and in how many."""
    found, count = np.unique(np.concatenate(heads), return_counts=True)
    many = count >= max(OFTEN_LEAST, OFTEN * len(heads))
    return [{"shingle": int(x), "sets": int(c)} for x, c in zip(W.signed(found[many]), count[many], strict=True)]


def _frequent(rows: DataFrame) -> DataFrame:
    """(shingle, often, deals) of frequent shingles: their counts, and over so many tasks their rows are dealt.

    Counts of whole batches are summed over all documents, a set once a batch.  A shingle that is frequent in
    no batch is in less than the share OFTEN of all sets; there are at most as many
    frequent ones as a set has shingles on average, over OFTEN.  The list only decides the
    order and the dealing of rows, never which links are found.
    """
    seen = rows.filter("often is not null").select(F.explode("often").alias("o")).groupBy("o.shingle").agg(F.sum("o.sets").alias("sets"))
    return seen.filter(F.col("sets") > DEAL_ROWS).select("shingle", (LAST + F.col("sets")).alias("often"), F.ceil(F.col("sets") / DEAL_ROWS).cast("int").alias("deals"))


def _regions_of(n: int, percent: int):
    """(shingle, node) for each region that a set may be replicated to; the same set counts once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            heads, nodes = [], []
            for _, s in _sets(batch, n):
                if not len(s) or (d := _digest(s)) in seen:
                    continue
                seen.add(d)
                heads.append(s[: _head(s, percent)])
                nodes.append(np.full(len(heads[-1]), d, np.int64))
            if heads:
                yield pa.record_batch([pa.array(W.signed(np.concatenate(heads))), pa.array(np.concatenate(nodes))], names=["shingle", "node"])

    return run


def _shared_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition in order of shingles, the members of regions with two different sets, and how many these have; of dealt regions each member once."""
    for t in whole_groups(batches, "shingle"):
        s, d, often = t["shingle"].to_numpy(), t["node"].to_numpy(), t["often"].to_numpy()
        order = np.lexsort((d, s))
        s, d, often = s[order], d[order], often[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        s, d, often = s[new], d[new], often[new]
        same = s[1:] == s[:-1]
        size = np.diff(np.append(np.flatnonzero(np.append(True, ~same)), len(s)))
        size = np.where(often > 0, often, np.repeat(size, size))
        keep = size > 1
        if keep.any():
            yield pa.record_batch([pa.array(s[keep]), pa.array(d[keep]), pa.array(size[keep])], names=["shingle", "node", "sets"])


def _shared(base: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(shingle, node, sets) of regions with more than one set; rows of frequent shingles are dealt over tasks by their nodes."""
    regions = base.mapInArrow(_regions_of(n, percent), "shingle long, node long")
    frequent = written(_frequent(rows))
    frequent = maybe_broadcast(frequent, 20 * frequent.count())
    deal = F.coalesce(F.pmod(F.xxhash64("node"), "deals"), F.lit(0))
    regions = regions.join(frequent, "shingle", "left").select("shingle", "node", F.coalesce("often", F.lit(0)).alias("often"), deal.alias("deal"))
    ordered = regions.repartition("shingle", "deal").sortWithinPartitions("shingle")
    return ordered.mapInArrow(_shared_regions, "shingle long, node long, sets long")


def _first_regions(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (shingle, node, rest) among the first of the set in the global order: rarest first, and what is in no other set before that; rest is how many of its shingles stand there or later."""
    reach = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    pooled = F.col("shingle").between(0, int(_POOL_END) - 1)
    ordered = Window.partitionBy("node").orderBy(~pooled, "sets", "shingle")
    rows = shared.withColumn("place", F.row_number().over(ordered)).withColumn("met", F.count_if(pooled).over(Window.partitionBy("node")))
    rows = rows.join(nodes.select("node", "n", "pool"), "node")
    # of the pool, met are in other sets; what isn't counted comes behind the whole pool
    place = F.col("pool") - F.col("met") + F.col("place")
    rest = F.when(pooled, F.col("n") - place + 1).otherwise(F.col("n") - F.col("pool"))
    return rows.filter((F.col("pool") < reach) | (place <= reach)).select("shingle", "node", rest.alias("rest"))


def _window_edges(percent: int):
    """Candidate edges of whole regions: enough of them to connect all pairs that places and class counts leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "shingle"):
            s, d, n, behind = (t[c].to_numpy() for c in ("shingle", "node", "n", "rest"))
            sk = _bits(t["sketch"])
            order = np.lexsort((d, n, s))
            s, d, n, behind = s[order], d[order], n[order], behind[order]
            most = (100 + percent) * behind // percent - n  # a partner isn't larger: both hold min(rest) common elements at most
            cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))), [len(s)]))
            left, right = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                size, upto, bits = n[a:b], most[a:b], sk[order[a:b]]
                rest = np.arange(b - a)
                while len(rest):  # breadth first from a new pivot
                    queue, rest = [rest[0]], rest[1:]
                    while queue and len(rest):
                        p = queue.pop()
                        # sizes are in order: only a slice can be within the windows
                        lo = np.searchsorted(size[rest], -(-percent * size[p] // 100))
                        hi = np.searchsorted(size[rest], min(100 * size[p] // percent, upto[p]), "right")
                        some = rest[lo:hi][upto[rest[lo:hi]] >= size[p]]
                        if not len(some):
                            continue
                        hit = some[_near(bits[p], size[p], bits[some], size[some], percent)]
                        if len(hit):
                            rest = np.setdiff1d(rest, hit, assume_unique=True)
                            left.append(np.full(len(hit), d[a + p]))
                            right.append(d[a + hit])
                            queue.extend(hit)
            if left:
                x = np.unique(np.sort(np.stack([np.concatenate(left), np.concatenate(right)]), axis=0), axis=1)
                yield pa.record_batch([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])

    return run


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _region_edges(seen: DataFrame, percent: int) -> DataFrame:
    """Candidate edges (a, b) of the regions of ``seen(shingle, node, n, rest, sketch)``; the sets of regions of more than REGION_ROWS are all connected with their first one."""
    counts = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("b"))
    large = written(counts.filter(F.col("sets") > REGION_ROWS).select("shingle", "b"))
    stars = seen.join(large, "shingle").select(F.col("node").alias("a"), "b").filter("a <> b")
    met = seen.join(large, "shingle", "left_anti").repartition("shingle").sortWithinPartitions("shingle")
    return met.mapInArrow(_window_edges(percent), "a long, b long").unionByName(stars)


def _taken_apart(sets: DataFrame, sketches: DataFrame, percent: int, max_rows: int) -> DataFrame:
    """``sets(block, node, set)`` with blocks of more than max_rows sets replaced by those that regions within them leave; sets without a candidate are gone."""
    big = sets.groupBy("block").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > max_rows)
    big = written(big.select("block"))
    if big.isEmpty():
        return sets
    own = sets.join(big, "block")
    flat = own.select("block", "node", F.size("set").cast("long").alias("n"), F.explode("set").alias("shingle"))
    counts = flat.groupBy("block", "shingle").agg(F.count(F.lit(1)).alias("sets"))
    ranked = flat.join(counts, ["block", "shingle"]).groupBy("block", "node", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("all"))  # a set each
    reach = F.expr(f"int(n - ({percent} * n + 99) div 100 + 1)")
    rows = ranked.select("block", "node", "n", F.posexplode(F.slice("all", F.lit(1), reach)).alias("ahead", "own")).filter("own.sets > 1")
    rows = rows.select(F.xxhash64("block", "own.shingle").alias("shingle"), "node", "n", (F.col("n") - F.col("ahead")).alias("rest"))
    seen = written(rows.join(sketches.select("node", "sketch"), "node"))
    met = _paired_parts(seen, percent).repartition("shingle").sortWithinPartitions("shingle")
    blocks = components(met.mapInArrow(_window_edges(percent), "a long, b long"))
    apart = own.drop("block").join(blocks.withColumnRenamed("component", "block"), "node").select(*sets.columns)
    return written(sets.join(big, "block", "left_anti").unionByName(apart))


def _paired_parts(seen: DataFrame, percent: int) -> DataFrame:
    """Rows of ``seen(shingle, node, n, rest, sketch)`` with regions of more than REGION_ROWS cut into parts, a copy of a part for each other part that it may link with; shingle then names a pair of parts.

    Sets that link have sizes within a factor 100 / percent, so they are in one stratum of
    that ratio or in two next to each other; strata are dealt into parts by hash.
    """
    # strata are a little wider than the ratio, so that rounding can't put a link two apart
    stratum = F.floor(F.log(F.col("n").cast("double")) / (np.log(100 / percent) * (1 + 1e-6)) if percent < 100 else F.col("n")).cast("long")
    counts = seen.groupBy("shingle", stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("sets"))
    large = counts.groupBy("shingle").agg(F.sum("sets").alias("all"), F.collect_list(F.struct("stratum", F.ceil(F.col("sets") / REGION_ROWS).alias("parts"))).alias("strata"))
    large = written(large.filter(F.col("all") > REGION_ROWS).select("shingle", "strata"))
    if large.isEmpty():
        return seen
    rows = seen.withColumn("stratum", stratum).join(large, "shingle")
    parts_of = lambda g: F.coalesce(F.get(F.filter("strata", lambda x: x["stratum"] == g), F.lit(0))["parts"], F.lit(0))
    rows = rows.withColumn("own", parts_of(F.col("stratum"))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("own")))
    pair = lambda g, low, h, high: F.xxhash64("shingle", g, low, h, high)
    g, upto = F.col("stratum"), lambda m: F.filter(F.sequence(F.lit(0).cast("long"), m), lambda x: x < m)
    inside = F.transform(upto(F.col("own")), lambda x: pair(g, F.least("part", x), g, F.greatest("part", x)))
    above = F.transform(upto(parts_of(g + 1)), lambda x: pair(g, F.col("part"), g + 1, x))
    below = F.transform(upto(parts_of(g - 1)), lambda x: pair(g - 1, x, g, F.col("part")))
    rows = rows.select(F.explode(F.concat(inside, above, below)).alias("shingle"), *(c for c in seen.columns if c != "shingle"))
    return seen.join(large.select("shingle"), "shingle", "left_anti").unionByName(rows)


def _near(one: np.ndarray, n: int, many: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Whether the class parities allow 100 |A and B| >= percent |A or B|, that is (100 + percent) D <= (100 - percent) (|A| + |B|)."""
    return (100 + percent) * np.bitwise_count(many ^ one).sum(1, dtype=np.int64) <= (100 - percent) * (size + n)


def _node_sets(n: int):
    """(block, node, set) of documents that carry a block; a text whose set is not the node's gives nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, block = batch.column("node").to_pylist(), batch.column("block").to_pylist()
            rows, sets, size = [], [], 0
            for i, s in _sets(batch, n):
                if len(s) and _digest(s) == want[i]:
                    rows.append(i)
                    sets.append(W.signed(s))
                    size += len(s)
                if size >= W.BLOCK:
                    yield _set_batch(block, want, rows, sets)
                    rows, sets, size = [], [], 0
            if rows:
                yield _set_batch(block, want, rows, sets)

    return run


def _set_batch(block: list, node: list, rows: list, sets: list) -> pa.RecordBatch:
    offs = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.record_batch([pa.array([block[i] for i in rows], pa.int64()), pa.array([node[i] for i in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets)))], names=["block", "node", "set"])


def set_arrays(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs, flat = np.asarray(column.offsets), W.unsigned(np.asarray(column.values))
    return [flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]


def common_counts(one: np.ndarray, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """|one and set| for each of the sets that lie end to end in flat."""
    at = np.searchsorted(one, flat)
    hit = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(one[np.minimum(at, len(one) - 1)] == flat, out=hit[1:])
    return hit[offs[1:]] - hit[offs[:-1]]


def _links(one: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether linked with each set, Jaccard distance to it)."""
    offs = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    both = common_counts(one, np.concatenate(sets), offs)
    either = len(one) + np.diff(offs) - both
    return 100 * both >= percent * either, 1 - both / either


def join_block(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the position of the first one that it reaches by links: exact, by pivots and windows, for a small block."""
    n, r = len(sets), 1 - percent / 100
    root = np.arange(n)

    def union(i: int, j: int) -> None:
        a, b = root[i], root[j]
        if a != b:
            root[root == max(a, b)] = min(a, b)

    def solve(rows: np.ndarray) -> None:
        while len(rows) > 1:
            p, others = rows[0], rows[1:]
            link, d = _links(sets[p], [sets[i] for i in others], percent)
            for i in others[link]:
                union(p, i)
            inner, din, outer, dout = others[link], d[link], others[~link], d[~link]
            # a far set can only reach those of the ball that the triangle inequality leaves
            for i, x in zip(outer, dout, strict=True):
                if x <= 2 * r + 1e-9:
                    near = inner[(din >= x - r - 1e-9) & (root[inner] != root[i])]
                    if len(near) and (hit := near[_links(sets[i], [sets[j] for j in near], percent)[0]]).size:
                        for j in hit:
                            union(i, j)
            rows = outer

    solve(root.copy())
    return root


def _join_small(percent: int):
    def run(t: pa.Table) -> pa.Table:
        node, sets = t["node"].to_numpy(), set_arrays(t["set"])
        order = np.argsort(node, kind="stable")
        root = join_block([sets[i] for i in order], percent)
        return pa.table({"a": pa.array(node[order]), "b": pa.array(node[order][root])})

    return run


def _pivot_distances(percent: int):
    """Cogroup of a block's part with the block's pivots: (block, node, pivot, linked, d)."""

    def run(part: pa.Table, pivots: pa.Table) -> pa.Table:
        cols: dict[str, list] = {k: [] for k in ("block", "node", "pivot", "linked", "d")}
        if part.num_rows and pivots.num_rows:
            node, sets = part["node"].to_numpy(), set_arrays(part["set"])
            for p, s in zip(pivots["pivot"].to_pylist(), set_arrays(pivots["pset"]), strict=True):
                link, d = _links(s, sets, percent)
                for k, v in zip(cols, (part["block"].to_numpy(), node, np.full(len(node), p), link, d), strict=True):
                    cols[k].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64())
        return pa.table({k: pa.array(np.concatenate(v) if v else [], t) for (k, v), t in zip(cols.items(), types, strict=True)})

    return run


def _part_links(percent: int):
    """Links between two parts of a block, or inside one: sets of different components whose distances to all pivots are near enough.  A component that a link reaches is joined at once."""
    r = 1 - percent / 100

    def run(t: pa.Table) -> pa.Table:
        left, node, sets = t["left"].to_numpy(zero_copy_only=False), t["node"].to_numpy(), set_arrays(t["set"])
        d = np.stack(t["ds"].to_numpy(zero_copy_only=False))
        comp = np.unique(t["comp"].to_numpy(), return_inverse=True)[1]
        same = t["part"][0].as_py() == t["other"][0].as_py()
        order = np.argsort(node, kind="stable")
        a = order[left[order]]
        b = a if same else order[~left[order]]
        out: list[tuple[int, int]] = []
        for k, i in enumerate(a):
            rest = b[k + 1 :] if same else b
            rest = rest[comp[rest] != comp[i]]
            rest = rest[np.abs(d[rest] - d[i]).max(1) <= r + 1e-9] if len(rest) else rest
            while len(rest):
                some, rest = rest[:64], rest[64:]
                for j in some[_links(sets[i], [sets[x] for x in some], percent)[0]]:
                    if comp[j] != comp[i]:
                        out.append((node[i], node[j]))
                        comp[comp == comp[j]] = comp[i]
                rest = rest[comp[rest] != comp[i]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def _salted_pivots(state: DataFrame, big: DataFrame, pivots: int, part: int) -> tuple[DataFrame, DataFrame]:
    """A block's rows dealt over salts, and its pivots copied to each salt: about ``pivots`` of them, chosen by their random ids."""
    rows = state.join(big, "block").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    chosen = rows.filter((F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("rows") / pivots))) == 0) | (F.col("node") == F.col("first")))
    copies = chosen.select(F.col("block").alias("of"), F.col("node").alias("pivot"), F.col("set").alias("pset"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return rows.select("block", "node", "set", "salt"), copies.select("of", "pivot", "pset", F.col("salt").cast("long").alias("at"))


def join_blocks(sets: DataFrame, percent: int = 85, max_rows: int = 128, pivots: int = 8) -> DataFrame:
    """Links (a, b) that connect all linked nodes of each block of ``sets(block, node, set array<long>)``; blocks of more than max_rows as Spark jobs."""
    sizes = sets.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("first"))
    big = written(sizes.filter(F.col("rows") > max_rows).withColumn("salts", F.ceil(F.col("rows") / max_rows)))
    small = sets.join(big.select("block"), "block", "left_anti")
    links = written(small.groupBy("block").applyInArrow(_join_small(percent), "a long, b long").filter("a <> b"))
    return links if big.isEmpty() else links.union(_join_large(sets, big, percent, max_rows, pivots))


def _join_large(sets: DataFrame, big: DataFrame, percent: int, max_rows: int, pivots: int) -> DataFrame:
    parts, chosen = _salted_pivots(sets, big, pivots, max_rows)
    near = written(parts.groupBy("block", "salt").cogroup(chosen.groupBy("of", "at")).applyInArrow(_pivot_distances(percent), "block long, node long, pivot long, linked boolean, d double"))
    links = near.filter("linked and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    nodes = near.groupBy("block", "node").agg(F.min_by("pivot", F.struct("d", "pivot")).alias("home"), F.transform(F.array_sort(F.collect_list(F.struct("pivot", "d"))), lambda x: x["d"]).alias("ds"))
    nodes = written(nodes.join(components(links), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))
    main = nodes.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    nodes = written(nodes.join(written(main), "block").withColumn("outside", F.col("comp") != F.col("main")).drop("main"))
    # regions of the pivots, inside and outside the main component, in parts of max_rows
    kinds = ["block", "outside", "home"]
    size = nodes.groupBy(*kinds).agg(F.ceil(F.count(F.lit(1)) / max_rows).alias("salts"))
    nodes = written(nodes.join(written(size), kinds).withColumn("part", F.xxhash64("outside", "home", F.pmod(F.xxhash64("node"), F.col("salts")))).drop("salts", "home"))
    spread = nodes.select("block", "outside", "part", F.posexplode("ds").alias("k", "d")).groupBy("block", "outside", "part", "k").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    sums = F.transform(F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))
    spread = written(spread.groupBy("block", "outside", "part").agg(sums.alias("ds")))
    other = spread.select("block", F.col("outside").alias("too"), F.col("part").alias("other"), F.col("ds").alias("es"))
    r = 1 - percent / 100 + 1e-9
    met = F.forall(F.arrays_zip("ds", "es"), lambda z: (z["ds"]["lo"] <= z["es"]["hi"] + r) & (z["es"]["lo"] <= z["ds"]["hi"] + r))
    twos = spread.filter("outside").join(other, "block").filter(~F.col("too") | (F.col("part") <= F.col("other"))).filter(met)
    twos = written(twos.select("block", "part", "other"))
    full = nodes.drop("outside").join(sets.select("node", "set"), "node")
    left = full.join(twos, ["block", "part"]).withColumn("left", F.lit(True))
    right = full.withColumnRenamed("part", "other").join(twos.filter("part <> other"), ["block", "other"]).withColumn("left", F.lit(False))
    names = ["block", "part", "other", "left", "node", "comp", "ds", "set"]
    joined = left.select(*names).union(right.select(*names)).groupBy("block", "part", "other").applyInArrow(_part_links(percent), "a long, b long")
    return links.union(written(joined))


def _named(docs: DataFrame, n: int, percent: int, max_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of docs without their texts (doc_id, key, n, node, ...), and (node, component, component_id) of each set.

    key is a hash of the text: a set's text is found by the doc_id, null or not, and key
    of its first row.
    """
    base = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    rows = written(base.mapInArrow(_sign(n, percent), "doc_id long, key long, n long, pool long, node long, sketch binary, often array<struct<shingle: long, sets: long>>"))

    shared = written(_shared(base, rows, n, percent))
    nodes = rows.filter("node is not null").groupBy("node").agg(_first_row(), F.first("n").alias("n"), F.first("pool").alias("pool"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.select("node", "row.doc_id", "row.key", "n", "pool", "sketch"))
    seen = written(_first_regions(shared, nodes, percent)).join(nodes.select("node", "n", "sketch"), "node")
    edges = _region_edges(written(seen.select("shingle", "node", "n", "rest", "sketch")), percent)
    blocks = components(edges).select("node", F.col("component").alias("block"))

    wanted = blocks.join(nodes.select("node", F.col("doc_id").alias("id"), F.col("key").alias("text_key")), "node")
    sets = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")))
    sets = sets.select("text", "node", "block").mapInArrow(_node_sets(n), "block long, node long, set array<long>")
    sets = written(sets.dropDuplicates(["block", "node"]) if _repeats(rows) else sets)
    whole = components(join_blocks(_taken_apart(sets, nodes, percent, max_rows), percent, max_rows))
    named = written(nodes.select("node", "doc_id").join(whole, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")))
    least_id = written(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return rows, written(named.join(least_id, "component").select("node", "component", "component_id"))


def _first_row() -> Column:
    """Of a group the row of the smallest doc_id, nulls last, and of these the smallest key."""
    return F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("row")


def _repeats(rows: DataFrame) -> bool:
    """Whether a text comes twice under one doc_id."""
    return not rows.groupBy("doc_id", "key").count().filter("count > 1").isEmpty()


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, max_rows: int = 128) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text, ...)``.

    Words are lower-cased in A-Z only.  Two documents link when 100 |A and B| >=
    percent |A or B| of their shingle sets; component_id is the smallest doc_id that
    links reach, itself included.  A document without words or text has no shingles
    and its own id; a null doc_id stays null and names no component, but its text links
    others.  Rows that repeat a doc_id are one document for links if their texts' sets
    agree, and each keeps its own component otherwise.  Other columns of docs are
    ignored; no rows give no rows.
    """
    rows, named = _named(docs, n, percent, max_rows)
    return rows.select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 4, percent: int = 85, max_rows: int = 128) -> DataFrame:
    """One row of each component of docs, and every row without words or text.

    Components are of texts, whatever their doc_id: a null one takes part, and different
    texts under one doc_id are each in their own.  Kept is the row of the smallest doc_id,
    nulls last, then of the smallest text hash; of rows that agree in both, the one whose
    other columns have the smallest hash.  Columns of any name stay; whole texts count,
    however long; no rows give no rows.
    """
    rows, named = _named(docs, n, percent, max_rows)
    rows = rows.filter("node is not null")
    first = rows.join(named, "node").groupBy("component").agg(_first_row())
    first = written(first.select(F.col("row.doc_id").alias("id"), F.col("row.key").alias("text_key")))
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    of = [docs["doc_id"].cast("long"), F.xxhash64(docs["text"])]
    kept = docs.filter(worded).join(first, of[0].eqNullSafe(first["id"]) & (of[1] == first["text_key"]), "left_semi")
    if _repeats(rows):
        number = free_name(docs.columns, "row number")
        rest = F.xxhash64(F.to_json(F.struct(F.lit(0), *(c for c in docs.columns if c not in ("doc_id", "text")))))
        place = F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long"), F.xxhash64("text")).orderBy(rest))
        kept = kept.withColumn(number, place).filter(F.col(f"`{number}`") == 1).drop(number)
    return kept.unionByName(docs.filter(~worded))

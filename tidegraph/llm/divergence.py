"""Source divergence audit: how far the terms of one source lie from another's, language by language.

1. *Partial counts.*  Inside mapInArrow a text is lower-cased (ascii_lower), split at what
   is no term (split_pattern_regex), its terms dictionary-encoded and counted with a hash
   group_by by (lang, source, term), and so are the documents that hold each term.  A task
   folds its counts together until they pass FLUSH_ROWS, so that a frequent term leaves it
   a few times, not once a document.
2. *Counts.*  One shuffle by (lang, term) sums them; a window of the same keys has the
   documents of the language that hold a term, and terms in fewer than ``least`` go.
3. *Columnar shards.*  The kept counts of a language are dealt by the terms' hash into
   shards of about SHARD_ROWS counts.  A shard gets the totals of all sources of its
   language, lays its terms out as columns of counts, one for each source, in tiles of
   bounded size, and computes the divergences of all pairs of sources over its terms as
   exact integers, and the best terms of each source.  Sums over shards are the result.

Where p and q are the parts of two groups in 1,000,000,000, each with one occurrence more
than counted, a term's divergence is floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import maybe_broadcast, written

#: What is no term, byte by byte the complement of letters A-Z, a-z and of all beyond ASCII.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts of the whole.
UNIT = 1_000_000_000
#: Counts that a task holds before it passes them on, and that a shard has, about.
FLUSH_ROWS, SHARD_ROWS = 1 << 19, 1 << 16
#: Sources whose columns meet in one tile, and terms of it.
TILE, TILE_TERMS = 64, 2048
#: Counts beyond this would leave 64 bits in the division.
MOST = (1 << 63) // 1000
_KEYS = ["lang", "source", "term"]
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _term_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """Counts of some documents: (lang, source, term, n, docs), and a row with a null term for each (lang, source)."""
    split = pc.split_pattern_regex(pc.ascii_lower(text), APART)
    doc, term = pc.list_parent_indices(split).cast(pa.int64()), pc.list_flatten(split)
    some = pc.greater(pc.binary_length(term), 0)
    doc, coded = doc.filter(some), term.filter(some).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    both = pc.add(pc.multiply(doc, size), coded.indices.cast(pa.int64()))
    once = pa.table({"both": both}).group_by("both").aggregate([([], "count_all")])
    of_doc = pc.divide(once["both"], size).combine_chunks()
    code = pc.subtract(once["both"], pc.multiply(of_doc, size)).combine_chunks()
    rows = pa.table({"lang": lang.take(of_doc), "source": source.take(of_doc), "term": coded.dictionary.take(code), "n": once["count_all"]})
    rows = rows.group_by(_KEYS).aggregate([("n", "sum"), ([], "count_all")]).rename_columns(_COUNTS.names)
    zero = pa.nulls(len(lang), pa.string()), *(pa.array(np.zeros(len(lang), np.int64)),) * 2
    groups = pa.table([lang, source, *zero], schema=_COUNTS)
    return pa.concat_tables([rows.cast(_COUNTS), _folded(groups)])


def _folded(t: pa.Table) -> pa.Table:
    return t.group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_COUNTS.names).cast(_COUNTS)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts, folded whenever they pass FLUSH_ROWS and passed on if they stay above half of it."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        lang, source, text = (pc.fill_null(batch.column(c).cast(pa.string()), "") for c in ("lang", "source", "text"))
        offs = W.text_buffers(text)[1]
        for lo, hi in W.groups(offs):
            held.append(_term_counts(lang.slice(lo, hi - lo), source.slice(lo, hi - lo), text.slice(lo, hi - lo)))
            size += held[-1].num_rows
            if size > FLUSH_ROWS:
                held = [_folded(pa.concat_tables(held))]
                size = held[0].num_rows
                if size > FLUSH_ROWS // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from _folded(pa.concat_tables(held)).to_batches()


def parts_of(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT (count + 1) / total), by long division, three digits at a time."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _best(term: np.ndarray, value: np.ndarray, top: int) -> np.ndarray:
    """Places of the top largest values, all ties of the last among them."""
    if len(value) <= top:
        return np.arange(len(value))
    return np.flatnonzero(value >= np.partition(value, len(value) - top)[len(value) - top])


def _shard(top: int):
    """Cogroup of a shard's counts with its language's sources: (lang, source, part, item, value), pairs as sums over the shard's terms, terms the top ones of each source."""

    def run(rows: pa.Table, sources: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("lang", "source", "part", "item", "value")}
        if not sources.num_rows:
            return _result(out)
        lang = sources["of"][0].as_py()
        order = pc.sort_indices(sources, [("name", "ascending")])
        name, total = sources["name"].take(order).to_pylist(), sources["total"].take(order).to_numpy()
        vocabulary, everywhere = sources["vocabulary"][0].as_py(), sources["everywhere"][0].as_py()
        if max(int(total.max()), everywhere, vocabulary) >= MOST:
            raise ValueError(f"counts beyond {MOST} can't be divided exactly in 64 bits")
        n_of = {s: i for i, s in enumerate(name)}
        sums = {}
        if rows.num_rows:
            coded = rows["term"].combine_chunks().dictionary_encode()
            at, col, n = coded.indices.to_numpy(), np.array([n_of[s] for s in rows["source"].to_pylist()]), rows["n"].to_numpy()
            whole = rows["in_lang"].to_numpy()
            p, q = parts_of(n, total[col] + vocabulary), parts_of(whole, everywhere + vocabulary)
            value = divergence(p, q)
            terms = np.array(coded.dictionary.to_pylist(), object)
            for c in np.unique(col):
                own = np.flatnonzero((col == c) & (p > q))
                best = own[_best(at[own], value[own], top)]
                _add(out, lang, name[c], "term", terms[at[best]].tolist(), value[best].tolist())
            sums = _pair_sums(at, col, n, total + vocabulary, len(terms))
        for (i, j), block in sums.items() or [((0, 0), np.zeros((len(name), len(name)), np.int64))]:
            for a in range(block.shape[0]):
                others = [b for b in range(block.shape[1]) if j + b != i + a]
                _add(out, lang, name[i + a], "pair", [name[j + b] for b in others], block[a, others].tolist())
        return _result(out)

    return run


def _pair_sums(at: np.ndarray, col: np.ndarray, n: np.ndarray, total: np.ndarray, terms: int) -> dict[tuple[int, int], np.ndarray]:
    """{(first row, first column): sums of divergences of sources from sources}, from counts n of term at in source col: tiles of TILE sources and TILE_TERMS terms."""
    sources = len(total)
    found: dict[tuple[int, int], np.ndarray] = {}
    order = np.argsort(at, kind="stable")
    at, col, n = at[order], col[order], n[order]
    for lo in range(0, terms, TILE_TERMS):
        hi = min(terms, lo + TILE_TERMS)
        a, b = np.searchsorted(at, (lo, hi))
        p = np.zeros((hi - lo, sources), np.int64)
        p[at[a:b] - lo, col[a:b]] = n[a:b]
        p = np.ascontiguousarray(parts_of(p, total[None]).T)
        for i in range(0, sources, TILE):
            for j in range(0, sources, TILE):
                tile = found.setdefault((i, j), np.zeros((min(TILE, sources - i), min(TILE, sources - j)), np.int64))
                for k in range(len(tile)):
                    tile[k] += divergence(p[i + k][None], p[j : j + TILE]).sum(1)
    return found


def _add(out: dict[str, list], lang: str, source: str, part: str, items: list[str], values: list[int]) -> None:
    for key, v in (("lang", [lang] * len(items)), ("source", [source] * len(items)), ("part", [part] * len(items)), ("item", items), ("value", values)):
        out[key].extend(v)


def _result(out: dict[str, list]) -> pa.Table:
    return pa.table({c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in out.items()})


def term_counts(docs: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """((lang, source, term, n, in_lang) of kept terms, (lang, source) of all groups), for ``docs(text, lang, source)``."""
    found = docs.select("lang", "source", "text").mapInArrow(_partial, "lang string, source string, term string, n long, docs long")
    counts = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a term's sources, in the partitions of the sums
    counts = counts.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("in_lang", F.sum("n").over(of_term))
    counts = written(counts.filter((F.col("in_docs") >= least) | F.col("term").isNull()).select("lang", "source", "term", "n", "in_lang"))
    return counts.filter("term is not null"), counts.filter("term is null").select("lang", "source")


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs(text, lang, source, ...)``.

    Null text, lang and source count as ''.  Terms are runs of letters of ASCII and of
    characters beyond it, lower-cased in A-Z; a language keeps those in at least ``least``
    of its rows.  Part pair has a row for each other source of the language, term the
    ``top`` kept terms that a source has more of than its language; ranks go by value,
    descending, then by item.  A source without terms is compared like any other, and in a
    language that keeps no term all values are 0.  Repeated rows count as often as they
    come, whole texts count however long; other columns are ignored; no rows give no rows.
    Counts of 9e15 and more end with an error.
    """
    counts, groups = term_counts(docs, least)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    words = counts.groupBy("lang").agg(F.countDistinct("term").alias("vocabulary"))
    groups = groups.join(sums, ["lang", "source"], "left").fillna(0, ["total", "rows"])
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("everywhere"), F.ceil(F.sum("rows") / SHARD_ROWS).alias("shards"))
    of_lang = of_lang.join(words, "lang", "left").select("lang", "everywhere", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), F.greatest("shards", F.lit(1)).cast("long").alias("shards"))
    of_lang = written(of_lang)
    size = of_lang.agg(F.sum(F.octet_length("lang") + 100)).first()[0] or 0
    sources = groups.join(maybe_broadcast(of_lang, size), "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    rows = counts.join(maybe_broadcast(of_lang.select("lang", "shards"), size), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    rows = rows.select("lang", "shard", "source", "term", "n", "in_lang")
    sources = sources.select(F.col("lang").alias("of"), F.col("shard").alias("at"), F.col("source").alias("name"), "total", "everywhere", "vocabulary")
    schema = "lang string, source string, part string, item string, value long"
    found = rows.groupBy("lang", "shard").cogroup(sources.groupBy("of", "at")).applyInArrow(_shard(top), schema)
    # terms lie in one shard each, pairs in all
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", place).filter((F.col("part") == "pair") | (F.col("rank") <= top))

"""Substring dedup by difference-cover anchors.

A window of ``window`` words is removed where the same words also start in a document
with a smaller doc_id.  Hashing every window would shuffle a row for each word, so:

1. *Anchors.*  A difference cover of the residues modulo PERIOD holds, for any two
   positions i and j, a shift l < PERIOD with (i + l) and (j + l) both in it.  Hence two
   equal windows share an anchor: the window - PERIOD + 1 words that start at a cover
   position of both.  Only these (a fifth of all positions) are hashed and shuffled.
2. *Extension.*  Around the anchors that another document shares, and only there, the
   full windows are hashed and grouped; each document but the smallest loses its own.

A passage of very many documents doesn't meet in one task: in each Arrow batch one
witness stands for all its occurrences, whose fate is clear already.  Windows are
compared as 64-bit hashes of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import all_rows, written

#: A perfect difference set modulo 31 (every residue but 0 is one difference).
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, first word of each row) for parts of the batch."""
    buf, offs, _ = W.text_buffers(batch.column("text"))
    for lo, hi in W.groups(offs):
        part, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, first = W.find_words(part, o)
        yield lo, hi, W.hash_words(part, starts, ends), first


def _is_anchor(n: int, width: int) -> np.ndarray:
    at = np.arange(max(0, n - width + 1))
    return np.isin(at % PERIOD, COVER)


def _rows(key: np.ndarray, doc: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(W.signed(key)), pa.array(doc), pa.array(sure)], names=["key", "doc_id", "sure"])


def _distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, doc) in order, and where a key begins."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[keep], doc[keep]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    return key, doc, head


def _combine(key: np.ndarray, doc: np.ndarray, extend: bool) -> pa.RecordBatch | None:
    """What a batch knows: keys of several documents are shared (anchors), or shared with a smaller one (windows).  The first document's row goes on as a witness."""
    if not len(key):
        return None
    key, doc, head = _distinct(key, doc)
    if extend:
        return _rows(key, doc, ~head)
    many = np.zeros(len(key), bool)
    many[1:] |= ~head[1:]
    many[:-1] |= ~head[1:]
    return _rows(np.concatenate((key, key[many & head])), np.concatenate((doc, doc[many & head])), np.concatenate((many & ~head, np.ones(int((many & head).sum()), bool))))


def _anchors(window: int):
    width = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").cast(pa.int64()))
            keys, docs = [], []
            for lo, hi, h, first in _hashed(batch):
                all_of = W.window_sums(h, width)
                for d in range(lo, hi):
                    a, b = int(first[d - lo]), int(first[d - lo + 1])
                    if b - a >= window:
                        keys.append(all_of[a : b - width + 1][_is_anchor(b - a, width)])
                        docs.append(np.full(len(keys[-1]), ids[d]))
            if keys and (out := _combine(np.concatenate(keys), np.concatenate(docs), False)) is not None:
                yield out

    return run


def _met(extend: bool):
    """(doc_id, key) that another document shares, or a smaller one; a key's undecided rows are all in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := all_rows(batches)) is None:
            return
        key, doc, sure = (t[c].to_numpy(zero_copy_only=False) for c in ("key", "doc_id", "sure"))
        open_key, open_doc, head = _distinct(key[~sure], doc[~sure])
        hit = ~head
        if not extend and len(head):
            hit[:-1] |= ~head[1:]
        yield pa.record_batch([pa.array(np.concatenate((doc[sure], open_doc[hit]))), pa.array(np.concatenate((key[sure], open_key[hit])))], names=["doc_id", "key"])

    return run


def _shared(rows: DataFrame, extend: bool) -> DataFrame:
    """Each document's shared keys."""
    dealt = rows.repartition(F.when(F.col("sure"), F.col("doc_id")).otherwise(F.col("key")))
    return dealt.mapInArrow(_met(extend), "doc_id long, key long").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _key_sets(column: pa.Array) -> list[np.ndarray]:
    offs, flat = np.asarray(column.offsets), W.unsigned(np.asarray(column.values))
    return [np.sort(flat[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]


def _within(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(values), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)] == values


def _cover(marked: np.ndarray, n: int, before: int, after: int) -> np.ndarray:
    """Which of n places lie from ``before`` ahead of a marked one to ``after`` behind it, itself included."""
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(marked)
    np.add.at(edge, np.maximum(at - before, 0), 1)
    np.add.at(edge, np.minimum(at + after + 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _extended(window: int):
    width = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = np.asarray(batch.column("doc_id")), _key_sets(batch.column("keys"))
            keys, docs = [], []
            for lo, hi, h, first in _hashed(batch):
                anchors, full = W.window_sums(h, width), W.window_sums(h, window)
                for d in range(lo, hi):
                    a, b = int(first[d - lo]), int(first[d - lo + 1])
                    n = b - a - window + 1
                    if n > 0:
                        hit = _is_anchor(b - a, width) & _within(known[d], anchors[a : b - width + 1])
                        start = _cover(hit, len(hit), PERIOD - 1, 0)[:n]
                        keys.append(full[a : a + n][start])
                        docs.append(np.full(len(keys[-1]), ids[d]))
            if keys and (out := _combine(np.concatenate(keys), np.concatenate(docs), True)) is not None:
                yield out

    return run


_OUT = "doc_id long, text_hash long, n_words long, n_removed long, kept string"


def _kept(window: int, digest: bool, flagged: bool):
    """The result of each text, with the keys of its removed windows if flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs, _ = W.text_buffers(batch.column("text"))
            known = _key_sets(batch.column("keys")) if flagged else None
            n_words, n_removed, kept = [], [], []
            for lo, hi in W.groups(offs):
                full = first = None
                if flagged:
                    part, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                    starts, ends, first = W.find_words(part, o)
                    full = W.window_sums(W.hash_words(part, starts, ends), window)
                for d in range(lo, hi):
                    words = bytes(buf[offs[d] : offs[d + 1]]).split()
                    n = len(words)
                    if flagged and n >= window:
                        a = int(first[d - lo])
                        gone = np.zeros(n, bool)
                        gone[: n - window + 1] = _within(known[d], full[a : a + n - window + 1])
                        gone = _cover(gone, n, 0, window - 1)
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    whole = b" ".join(words)
                    kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode("utf-8", "replace"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "text_hash", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs(doc_id, text, ...)``.

    Each word in a window of ``window`` words whose sequence also starts in a document
    of smaller doc_id goes; windows are judged on the input.  kept: the other words,
    joined by one space, or their SHA-256 in hex (digest).  A null text has no words; a
    null doc_id loses nothing and takes nothing from others; rows that repeat a doc_id
    take nothing from each other.  Other columns are ignored; no rows give no rows.
    """
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} at least")
    base = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_hash", F.xxhash64("text"))
    named = base.filter("doc_id is not null and text is not null")
    found = _shared(named.select("doc_id", "text").mapInArrow(_anchors(window), "key long, doc_id long, sure boolean"), False)
    near = written(named.join(found, "doc_id"))
    gone = _shared(near.select("doc_id", "text", "keys").mapInArrow(_extended(window), "key long, doc_id long, sure boolean"), True)
    less = near.drop("keys").join(gone, "doc_id").mapInArrow(_kept(window, digest, True), _OUT)
    less = written(less.dropDuplicates(["doc_id", "text_hash"]))
    whole = base.mapInArrow(_kept(window, digest, False), _OUT)
    out = whole.alias("w").join(less.alias("l"), ["doc_id", "text_hash"], "left")
    return out.select("doc_id", "w.n_words", F.coalesce("l.n_removed", "w.n_removed").alias("n_removed"), F.coalesce("l.kept", "w.kept").alias("kept"))

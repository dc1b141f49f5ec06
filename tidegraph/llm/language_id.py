"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are the character n-grams (2 to 4 bytes) of its words, lower-cased in
A-Z and hashed to BUCKETS; the mean of their embeddings goes through a linear layer.
Both are trained here by stochastic gradient descent in numpy, in small batches, in one
Spark task, on a bounded sample: SAMPLE labelled rows shared out evenly among the
languages (LEAST rows of each at least), by hash, of at most max_chars characters.

On a part of the sample held back a temperature is set for the scores, and a margin for
rejection: how far the best language's sum lies above the mean of all.  N-grams that
training never saw add next to nothing, so that texts in a language that isn't known have
small margins.  Prediction covers whole texts: at that point embedding and layer are one
table, and a text costs a lookup for each n-gram.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from . import words as W
from .shared import free_name, maybe_broadcast, written

BUCKETS, DIM, ORDERS = 1 << 15, 16, (2, 3, 4)
SAMPLE, LEAST, MAX_CHARS = 3000, 60, 4000
#: Texts of a batch; passes over the sample, and batches at least: a small sample is gone through more often.
BATCH, EPOCHS, STEPS = 16, 6, 600
#: Of right answers held back this share has a smaller margin than the one below which a text is rejected.
STRAY = 0.005
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): what an n-gram adds, before the mean
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # margin below which a text is rejected


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, first one of each text): orders lie one after another for each byte position, white space excluded at the ends."""
    b = W.lower(buf).astype(np.uint32)
    n = len(b)
    solid = ~W._IS_SPACE[buf]
    owner_end = np.repeat(offs[1:], np.diff(offs)) if n else np.zeros(0, np.int64)
    at, keys = [], []
    h = np.zeros(n, np.uint32)
    for k in range(max(ORDERS)):
        if n <= k:
            break
        h = h[: n - k] * np.uint32(16777619) ^ b[k:] if k else b * np.uint32(2166136261)
        if k + 1 in ORDERS:
            i = np.flatnonzero((np.arange(n - k) + k < owner_end[: n - k]) & solid[: n - k])
            x = h[i] * np.uint32(2654435761)
            at.append(i)
            keys.append((x >> np.uint32(17)).astype(np.int64) % BUCKETS)
    if not at:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    at, keys = np.concatenate(at), np.concatenate(keys)
    order = np.argsort(at, kind="stable")
    return keys[order], np.searchsorted(at[order], offs)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _margin(z: np.ndarray) -> np.ndarray:
    return z.max(1) - z.mean(1)


def _bags(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, share of the text's n-grams, first entry of each text): a text's distinct buckets."""
    n = np.diff(first)
    both = np.repeat(np.arange(len(n)), n) * BUCKETS + keys
    u, count = np.unique(both, return_counts=True)
    doc = u // BUCKETS
    return u % BUCKETS, (count / n[doc]).astype(np.float32), np.searchsorted(doc, np.arange(len(n) + 1))


def train(texts: pa.Array, labels: list[str], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """A model of the labels; without any, one that knows no language."""
    known = sorted(set(labels))
    if not known:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    buf, offs, _ = W.text_buffers(texts)
    bucket, share, first = _bags(*ngrams(buf, offs))
    y = np.array([known.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    emb = (rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM).astype(np.float32)
    lin, bias = np.zeros((DIM, len(known)), np.float32), np.zeros(len(known), np.float32)
    rows = np.flatnonzero(np.diff(first))
    held = rows[W.mix(rows.astype(W.U)) % W.U(5) == 0]
    rows = np.setdiff1d(rows, held) if len(rows) > 50 else rows
    held = held if len(held) else rows
    weight = len(rows) / (len(known) * np.maximum(np.bincount(y[rows], minlength=len(known)), 1))  # languages weigh the same

    def means(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.diff(first)[docs]
        at = np.repeat(first[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return at, size, np.add.reduceat(emb[bucket[at]] * share[at, None], np.cumsum(size) - size)

    epochs = max(epochs, -(-STEPS * BATCH // max(len(rows), 1)))
    for epoch in range(epochs):
        step = 4.0 * (1 - epoch / epochs)
        order = rng.permutation(rows)
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            at, size, mean = means(docs)
            g = -_softmax(mean @ lin + bias)
            g[np.arange(len(docs)), y[docs]] += 1
            g *= np.minimum(weight[y[docs]], 4)[:, None] / len(docs)
            back = g @ lin.T
            lin += step * (mean.T @ g).astype(np.float32)
            bias += step * 0.1 * g.sum(0).astype(np.float32)
            order_at = np.argsort(bucket[at], kind="stable")
            own, begins = np.unique(bucket[at][order_at], return_index=True)
            change = (step * share[at, None] * np.repeat(back.astype(np.float32), size, 0))[order_at]
            emb[own] += np.add.reduceat(change, begins)
    model = Model(known, (emb @ lin).astype(np.float64), bias.astype(np.float64))
    z = np.concatenate([means(held[i : i + 256])[2] @ lin + bias for i in range(0, len(held), 256)]).astype(np.float64)
    right = np.arange(len(held)), y[held]
    model.temperature = min((0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0), key=lambda t: -np.log(_softmax(z / t)[right] + 1e-12).mean())
    good = z.argmax(1) == y[held]
    model.least = float(np.quantile(_margin(z)[good], STRAY)) * 0.5 if good.any() and len(known) > 1 else 0.0
    return model


def _sampled(docs: DataFrame, sample: int, max_chars: int) -> DataFrame:
    """(lang, text): the sample, at most sample // languages rows of each language, or LEAST if that is more, first by hash of doc_id and text.

    Rows are thinned by hash before any language's meet in a task, so that none holds more
    than a few times its part.
    """
    rows = docs.filter("text is not null and lang is not null").filter(F.length("text") <= max_chars)
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = F.greatest(F.lit(LEAST), F.floor(F.lit(sample) / F.count(F.lit(1)).over(Window.partitionBy())))  # a row for each language
    sizes = written(sizes.withColumn("each", each))
    known = sizes.agg(F.sum(F.octet_length("lang") + 100)).first()[0] or 0
    thin = F.shiftrightunsigned("h", 11) / float(1 << 53) * F.col("n") < 2 * F.col("each") + 50
    kept = rows.join(maybe_broadcast(sizes, known), "lang").filter(thin)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return kept.withColumn("place", place).filter("place <= each").select("lang", "text", "h")


def fit(docs: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> Model:
    """A model from ``docs(doc_id, text, lang)``: a bounded sample of rows with text and language, trained on in one task."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("lang", "ascending"), ("text", "ascending")]).combine_chunks()
        return pa.table({"model": pa.array([pickle.dumps(train(t["text"].chunk(0), t["lang"].to_pylist()))], pa.binary())})

    found = _sampled(docs, sample, max_chars).groupBy().applyInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else train(pa.array([], pa.string()), [])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the calibrated probability; columns of these names are replaced.

    lang_pred is und, score 0, for a text that is null or has no letter, and und with its
    score if the margin is below the model's: the method's rejection.  Whole texts count,
    however long; repeated rows get equal results; other columns stay, whatever their
    names.  No rows give no rows.
    """
    old = docs.drop("lang_pred", "score")
    names, letters = old.columns, free_name(old.columns, "has letters")
    old = old.withColumn(letters, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = np.ascontiguousarray(m.table.T.astype(np.float32))
        for batch in batches:
            buf, offs, _ = W.text_buffers(batch.column(text))
            z = np.zeros((batch.num_rows, len(m.languages)))
            some = np.zeros(batch.num_rows, bool)
            for lo, hi in W.groups(offs, W.BLOCK):
                keys, first = ngrams(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                n = np.diff(first)
                rows = np.flatnonzero(n)
                if not len(rows):
                    continue
                some[lo + rows] = True
                for c in range(len(table)):
                    z[lo + rows, c] = np.add.reduceat(table[c][keys], first[rows], dtype=np.float64) / n[rows]
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            usable = np.flatnonzero(some & np.asarray(batch.column(letters)))
            if len(m.languages) and len(usable):
                own = z[usable] + m.bias
                p = _softmax(own / m.temperature)
                score[usable] = np.clip(p.max(1), 0, 1)
                for i, k, far in zip(usable.tolist(), p.argmax(1).tolist(), (_margin(own) >= m.least).tolist(), strict=True):
                    if far:
                        lang[i] = m.languages[k]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = StructType([f for f in old.schema.fields if f.name != letters]).add("lang_pred", StringType()).add("score", DoubleType())
    return old.mapInArrow(run, schema)

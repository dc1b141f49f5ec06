"""Quality classifier: supervised subword embeddings.

A text's features are its words, pairs of words next to each other, one feature for all
pairs of equal words, and character n-grams (ORDERS bytes, as they are: capitals and signs
tell junk from prose), hashed to BUCKETS.
Each has a learned vector; their mean goes through a linear layer and a softmax over the
labels.  Vectors and layer are trained by stochastic gradient descent in numpy, in small
batches, in one Spark task, on a bounded sample: SAMPLE labelled rows of each label, first
by hash, of at most MAX_CHARS characters.  Both labels weigh the same.  On a part of the
sample held back a temperature is set, so that scores are calibrated.

Scoring covers whole texts: vectors and layer are one table by then, and a feature costs a
lookup.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import free_name, labelled_sample

BUCKETS, DIM, ORDERS = 1 << 16, 8, (2, 3, 4)
SAMPLE, MAX_CHARS = 1200, 20_000
#: Bucket of a pair of equal words.
TWICE = 4021
BATCH, EPOCHS, STEPS, RATE = 16, 5, 600, 8.0
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0)
#: Score from which a text is predicted to be good.
LEAST = 0.3


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))  # what a feature adds for label 1 against 0, before the mean
    bias: float = 0.0
    temperature: float = 1.0

    def score(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((mean + self.bias) / self.temperature, -700, 700)))


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, first one of each text) of texts that lie end to end in buf."""
    n = len(buf)
    ends = np.repeat(offs[1:], np.diff(offs)) if n else np.zeros(0, np.int64)
    solid = ~W._IS_SPACE[buf]
    raw = buf.astype(np.uint32)
    at, keys = [], []
    h = raw * np.uint32(2166136261)
    for k in range(max(ORDERS)):
        if n <= k:
            break
        h = h[: n - k] * np.uint32(16777619) ^ raw[k:] if k else h
        if k + 1 in ORDERS:
            i = np.flatnonzero((np.arange(n - k) + k < ends[: n - k]) & solid[: n - k])
            at.append(i)
            keys.append((h[i] * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64))
    starts, stops, first = W.find_words(buf, offs)
    words = W.hash_words(buf, starts, stops)
    at.append(starts)
    keys.append((words >> W.U(48)).astype(np.int64))
    if len(words) > 1:
        own = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        pair = np.flatnonzero(own[1:] == own[:-1])
        at.append(starts[pair])
        keys.append((W.windows(words, 2)[pair] >> W.U(48)).astype(np.int64))
        twice = pair[words[pair] == words[pair + 1]]
        at.append(starts[twice])
        keys.append(np.full(len(twice), TWICE))
    at, keys = np.concatenate(at), np.concatenate(keys) % BUCKETS
    order = np.argsort(at, kind="stable")
    return keys[order], np.searchsorted(at[order], offs)


def _bags(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, share of the text's features, first entry of each text): a text's distinct buckets."""
    n = np.diff(first)
    u, count = np.unique(np.repeat(np.arange(len(n)), n) * BUCKETS + keys, return_counts=True)
    doc = u // BUCKETS
    return u % BUCKETS, (count / n[doc]).astype(np.float32), np.searchsorted(doc, np.arange(len(n) + 1))


def train(texts: pa.Array, label: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """A model of labels 0 and 1; where one of them is missing, one that scores 0.5."""
    if len(np.unique(label)) < 2:
        return Model()
    buf, offs, _ = W.text_buffers(texts)
    parts = [_bags(*features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])) for lo, hi in W.groups(offs)]
    bucket, share = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    size = np.concatenate([np.diff(p[2]) for p in parts])
    first = np.concatenate(([0], np.cumsum(size)))
    rng = np.random.default_rng(seed)
    emb = (rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM).astype(np.float32)
    lin, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    rows = np.flatnonzero(size)
    held = rows[W.mix(rows.astype(W.U)) % W.U(6) == 0]
    rows = np.setdiff1d(rows, held) if len(rows) > 60 else rows
    weight = len(rows) / (2 * np.maximum(np.bincount(label[rows], minlength=2), 1))

    def means(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = size[docs]
        begin = np.cumsum(n) - n
        at = np.repeat(first[docs] - begin, n) + np.arange(n.sum())
        return at, n, np.add.reduceat(emb[bucket[at]] * share[at, None], begin)

    epochs = max(epochs, -(-STEPS * BATCH // max(len(rows), 1))) if len(rows) else 0
    for epoch in range(epochs):
        step = RATE * (1 - epoch / epochs)
        order = rng.permutation(rows)
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            at, n, mean = means(docs)
            z = mean @ lin + bias
            p = np.exp(z - z.max(1, keepdims=True))
            g = np.eye(2, dtype=np.float32)[label[docs]] - p / p.sum(1, keepdims=True)
            g *= (weight[label[docs]] / len(docs))[:, None]
            back = (g @ lin.T).astype(np.float32)
            lin += step * (mean.T @ g).astype(np.float32)
            bias += step * 0.1 * g.sum(0).astype(np.float32)
            by = np.argsort(bucket[at], kind="stable")
            own, begins = np.unique(bucket[at][by], return_index=True)
            emb[own] += np.add.reduceat((step * share[at, None] * np.repeat(back, n, 0))[by], begins)
    way = lin[:, 1] - lin[:, 0]
    model = Model((emb @ way).astype(np.float32), float(bias[1] - bias[0]))
    if len(held) and len(np.unique(label[held])) == 2:
        mean = np.concatenate([means(held[i : i + 256])[2] @ way for i in range(0, len(held), 256)]).astype(float)
        of = weight[label[held]]

        def loss(t: float) -> float:
            p = np.clip(Model(bias=model.bias, temperature=t).score(mean), 1e-9, 1 - 1e-9)
            return float(-(of * np.log(np.where(label[held] == 1, p, 1 - p))).sum())

        model.temperature = min(TEMPERATURES, key=loss)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``: at most sample rows of each quality, of at most max_chars, trained on in one task.

    Labels other than 0 and 1 don't count, and of several for one doc_id the smaller one
    does.  The sample is one of hashes of doc_id and text, so that the order of rows and
    their repeats don't matter.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("text", "ascending"), ("quality", "ascending")]).combine_chunks()
        return pa.table({"model": pa.array([pickle.dumps(train(t["text"].chunk(0), t["quality"].to_numpy()))], pa.binary())})

    found = labelled_sample(docs, labels, sample, max_chars).groupBy().applyInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else Model()


def score(docs: DataFrame, model: Model, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with score, the probability of label 1, and predicted, 1 from least on; columns of these names are replaced.

    Whole texts count, however long.  A text that is null or holds no word has no features:
    its score is the layer's own.  Repeated rows get equal scores, other columns stay,
    whatever their names; no rows give no rows.
    """
    old = docs.drop("score", "predicted")
    names, shared = old.columns, docs.sparkSession.sparkContext.broadcast(model)
    held = free_name(names, "text of score")
    old = old.withColumn(held, F.col(f"`{text}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, offs, _ = W.text_buffers(batch.column(held))
            mean = np.zeros(batch.num_rows)
            for lo, hi in W.groups(offs, W.BLOCK):
                keys, first = features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                n = np.diff(first)
                rows = np.flatnonzero(n)
                if len(rows):
                    mean[lo + rows] = np.add.reduceat(m.table[keys], first[rows], dtype=np.float64) / n[rows]
            p = m.score(mean)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(p), pa.array((p >= least).astype(np.int32))], names=[*names, "score", "predicted"])

    return old.mapInArrow(run, docs.drop("score", "predicted").schema.add("score", "double").add("predicted", "integer"))

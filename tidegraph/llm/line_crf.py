"""Quality rules by line sequence labelling.

Each line of a text with a word in it is content or boilerplate.  A linear-chain
conditional random field scores line features and neighbouring labels; Viterbi decoding
gives the best labelling of a whole text, and the share of its words that lie in content
lines decides.  The field is trained here, by stochastic gradient steps on the exact
likelihood (forward and backward passes in numpy), from documents with a quality label:
all lines of a good one count as content, of a bad one as boilerplate.

Training reads a bounded sample (``sample`` rows of each label and at most ``max_chars``
long, first by hashes of doc_id and text); statistics and decoding cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from . import words as W
from .shared import labelled_sample

SAMPLE, MAX_CHARS, EPOCHS = 600, 20_000, 12
FEATURES = 18
#: Fixed characters of the base rule.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?,;:")] = True


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs elsewhere in its document, occurs earlier in it) for keys in reading order."""
    k = W.mix(keys ^ (owner.astype(W.U) * W.U(0x9E3779B97F4A7C15)))
    order = np.argsort(k, kind="stable")
    same = np.zeros(len(k), bool)
    same[1:] = k[order][1:] == k[order][:-1]
    both = same.copy()
    both[:-1] |= same[1:]
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order], later[order] = both, same
    return twice, later


class Scan:
    """Counts of some texts and features of their lines."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        n = len(offs) - 1
        starts, ends, first = W.find_words(buf, offs)
        h = W.hash_words(buf, starts, ends)
        owner = np.repeat(np.arange(n), np.diff(first))
        head, symbol = _sums((buf & 0xC0) != 0x80), _sums(_SYMBOL[buf])
        solid = _sums(~W._IS_SPACE[buf] & ((buf & 0xC0) != 0x80))
        self.n_words = np.diff(first)
        self.word_chars, self.n_symbols = np.diff(solid[offs]), np.diff(symbol[offs])
        w = W.windows(h, 3)
        inside = owner[: len(w)] == owner[2:] if len(w) else np.zeros(0, bool)
        twice = np.zeros(len(w), bool)
        twice[inside] = _repeated(w[inside], owner[: len(w)][inside])[0]
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[k : k + len(w)] |= twice
        rep = _sums(covered)
        self.n_repeat_words = rep[first[1:]] - rep[first[:-1]]
        # lines: documents end lines, too
        breaks = np.flatnonzero(buf == 10) if len(buf) else np.zeros(0, np.int64)
        lo = np.unique(np.concatenate((offs[:-1][np.diff(offs) > 0], breaks + 1)))
        lo = lo[lo < len(buf)]
        hi = np.concatenate((lo[1:], [len(buf)])) if len(lo) else lo
        hi = np.where((hi > lo) & (hi > 0) & (buf[np.maximum(hi - 1, 0)] == 10), hi - 1, hi) if len(lo) else hi
        wa, wb = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        keep = wb > wa
        lo, hi, wa, wb = lo[keep], hi[keep], wa[keep], wb[keep]
        self.line_doc = np.searchsorted(offs, lo, "right") - 1
        self.line_words = wb - wa
        twin, later = _repeated(W.hash_words(buf, lo, hi), self.line_doc) if len(lo) else (np.zeros(0, bool),) * 2
        self.n_dup_lines = np.bincount(self.line_doc[later], minlength=n)
        self.line_first = np.searchsorted(self.line_doc, np.arange(n + 1))
        chars = np.maximum(head[hi] - head[lo], 1)
        letters = np.maximum((c := _sums(_ALPHA[buf]))[hi] - c[lo], 1)
        share = lambda table, of: (np.diff(np.stack((_sums(table[buf])[lo], _sums(table[buf])[hi])), axis=0)[0]) / of
        sym, up, dig, stop = share(_SYMBOL, chars), share(_UPPER, letters), share(_DIGIT, chars), share(_STOP, chars)
        again = (rep[wb] - rep[wa]) / self.line_words
        size, n_w = chars / self.line_words, self.line_words
        last = _STOP[buf[np.maximum(ends[wb - 1] - 1, 0)]] if len(lo) else np.zeros(0, bool)
        self.x = np.stack([np.ones(len(lo)), n_w <= 2, (n_w > 2) & (n_w <= 5), (n_w > 5) & (n_w <= 12), n_w > 40, sym > 0.01, sym > 0.04, sym > 0.12, up > 0.3, up > 0.7, dig > 0.15, stop > 0.08, last, twin, again > 0.2, again > 0.6, size > 12, size < 4], 1).astype(np.float64) if len(lo) else np.zeros((0, FEATURES))


def _padded(x: np.ndarray, first: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[docs]
    out = np.zeros((len(docs), int(n.max(initial=1)), x.shape[1]))
    for k, d in enumerate(docs):
        out[k, : n[k]] = x[first[d] : first[d + 1]]
    return out, n


def train(scans: list[tuple[Scan, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.2, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights of content against boilerplate, 2 x 2 transitions) from scans and a label for each text."""
    weight, trans = np.zeros(FEATURES), np.zeros((2, 2))
    pieces: list[tuple[np.ndarray, int]] = []
    for scan, label in scans:
        for d in np.flatnonzero(np.diff(scan.line_first)):
            rows = scan.x[scan.line_first[d] : scan.line_first[d + 1]]
            pieces += [(rows[i : i + 64], int(label[d])) for i in range(0, len(rows), 64)]
    if len({y for _, y in pieces}) < 2:
        return weight, trans
    share = np.mean([y for _, y in pieces])
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + epoch / 4)
        order = rng.permutation(len(pieces))
        for at in range(0, len(order), 64):
            batch = [pieces[i] for i in order[at : at + 64]]
            first = np.concatenate(([0], np.cumsum([len(x) for x, _ in batch])))
            x, n = _padded(np.concatenate([x for x, _ in batch]), first, np.arange(len(batch)))
            y = np.array([v for _, v in batch])
            c = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(batch)  # both labels weigh the same
            gw, gt = _gradient(x, n, y, c, weight, trans)
            weight += step * (gw - 1e-4 * weight)
            trans += step * (gt - 1e-4 * trans)
    return weight, trans


def _gradient(x, n, y, c, weight, trans):
    b, t, _ = x.shape
    live = np.arange(t) < n[:, None]
    score = np.zeros((b, t, 2))
    score[..., 1] = x @ weight
    fwd, bwd = np.zeros((b, t, 2)), np.zeros((b, t, 2))
    fwd[:, 0] = score[:, 0]
    for k in range(1, t):
        nxt = np.logaddexp(fwd[:, k - 1, :1] + trans[0], fwd[:, k - 1, 1:] + trans[1]) + score[:, k]
        fwd[:, k] = np.where(live[:, k, None], nxt, fwd[:, k - 1])
    for k in range(t - 2, -1, -1):
        s = bwd[:, k + 1] + score[:, k + 1]
        prv = np.logaddexp(s[:, :1] + trans[:, 0], s[:, 1:] + trans[:, 1])
        bwd[:, k] = np.where(live[:, k + 1, None], prv, 0)
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    p1 = np.exp(np.minimum(fwd[..., 1] + bwd[..., 1] - z[:, None], 0)) * live
    gw = (((y[:, None] * live - p1) * c[:, None])[..., None] * x).sum((0, 1)) / 4
    gt = np.zeros((2, 2))
    pair = live[:, 1:]
    for i in range(2):
        for j in range(2):
            e = fwd[:, :-1, i] + trans[i, j] + score[:, 1:, j] + bwd[:, 1:, j] - z[:, None]
            p = np.exp(np.minimum(e, 0)) * pair
            gt[i, j] = ((((y == i) & (y == j))[:, None] * pair - p) * c[:, None]).sum() / 4
    return gw, gt


def viterbi(scan: Scan, weight: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """1 for the content lines of the best labelling of each text, ties to content; texts are decoded side by side."""
    score, first = scan.x @ weight, scan.line_first
    n = np.diff(first)
    label = np.ones(len(score), np.int8)
    docs = np.argsort(-n, kind="stable")
    docs = docs[n[docs] > 0]
    if not len(docs):
        return label
    start, size = first[docs], n[docs]
    top = np.stack((np.zeros(len(docs)), score[start]), 1)
    back: list[np.ndarray] = []
    for k in range(1, int(size[0])):
        m = int(np.searchsorted(-size, -k, "left"))  # texts of more than k lines come first
        a, b = top[:m, :1] + trans[0], top[:m, 1:] + trans[1]
        back.append((b >= a).astype(np.int8))
        best = np.maximum(a, b)
        best[:, 1] += score[start[:m] + k]
        top[:m] = best
    state = (top[:, 1] >= top[:, 0]).astype(np.int8)
    label[start + size - 1] = state
    for k in range(int(size[0]) - 1, 0, -1):
        m = len(back[k - 1])
        state[:m] = back[k - 1][np.arange(m), state[:m]]
        label[start[:m] + k - 1] = state[:m]
    return label


def _scans(text: pa.Array) -> Iterator[tuple[int, int, Scan]]:
    buf, offs, _ = W.text_buffers(text)
    for lo, hi in W.groups(offs):
        yield lo, hi, Scan(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_chars: int = MAX_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from ``labels(doc_id, quality)``: at most sample rows of each quality, of at most max_chars; without both, no weights (all content).

    The sample is one of hashes of doc_id and text, so that the order of rows doesn't matter.
    """
    rows = labelled_sample(docs, labels, sample, max_chars).toArrow()
    rows = rows.sort_by([("h", "ascending"), ("text", "ascending"), ("quality", "ascending")]).combine_chunks()
    if not rows.num_rows:
        return train([])
    y = rows["quality"].to_numpy()
    return train([(scan, y[lo:hi]) for lo, hi, scan in _scans(rows["text"])])


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    Columns of docs with these names are replaced.  A null or empty text has counts 0, a
    share of 1 and base_failed; lines without a word have no label.  kept: base_failed is
    false and at least ``least`` of the words are in content lines.  Repeated rows are
    judged alike; no rows give no rows.
    """
    new = [*_STATS, "base_failed", "content_share", "kept"]
    old = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = old.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, trans = shared.value
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in (*_STATS, "content_share")}
            for _, _, scan in _scans(batch.column("text")):
                content = _sums(viterbi(scan, weight, trans) * scan.line_words)
                inside = content[scan.line_first[1:]] - content[scan.line_first[:-1]]
                for k in _STATS:
                    cols[k].append(getattr(scan, k))
                cols["content_share"].append(np.where(scan.n_words > 0, inside / np.maximum(scan.n_words, 1), 1.0))
            done = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in cols.items()}
            failed = (done["n_words"] < 50) | (100 * done["n_repeat_words"] > 50 * done["n_words"])
            arrays = [*(batch.column(c) for c in names), *(pa.array(done[k].astype(np.int64)) for k in _STATS), pa.array(failed), pa.array(done["content_share"].astype(float)), pa.array(~failed & (done["content_share"] >= least))]
            yield pa.record_batch(arrays, names=[*names, *new])

    kinds = [*[LongType()] * 5, BooleanType(), DoubleType(), BooleanType()]
    return old.mapInArrow(run, StructType([*old.schema.fields, *(StructField(k, t) for k, t in zip(new, kinds, strict=True))]))

"""Packing by Karmarkar-Karp multiway differencing.

Documents become token ids, an end id behind each, cut into pieces of ``capacity`` ids,
which are sequences already, and the rest into pieces of at most GRAIN.  These are
dealt by place into groups of about GROUP pieces; a group is split into k windows by
multiway differencing: partial partitions, each a list of window sums, are merged
largest spread first, large sums of one against small sums of the other, so that
imbalances cancel and windows end nearly equal.  k starts at the least count that can
hold the group and rises while a window exceeds the capacity.

Only lengths move between tasks; a piece's ids stay in its row if asked for.
"""

from __future__ import annotations

import heapq
import itertools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from . import words as W
from .shared import written

CAPACITY, END_ID, GROUP = 2048, 1, 2048
#: The last ids of a document, fewer than a whole sequence, are cut into pieces of so many: small parts balance well.
GRAIN = 256
#: Distinct words whose ids a worker holds; then it starts anew.
HELD = 600_000
TOGETHER = 100


#: Letters up to U+024F but the dotted I, whose lower case is two characters, then ASCII punctuation without the apostrophe.
_PLAIN = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u01BA]*)([!-&(-/:-@\\[-`{-~]*)")
_SAMPLES = ("a", "The", "reinhe,", "Éçole", "über!!", "SS.***", "groß", "$$", "Ñandú;", "x|")


def _visible_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordIds:
    """Token ids of words by their hash.  The tokenizer drops white space and never joins across it, so a text's ids are its words' ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # words are held here, and each is asked for once
        self.table = dict(enumerate(_visible_bytes()))
        self.direct = False
        self.direct = all(self._plain(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in _SAMPLES)
        self.clear()

    def _plain(self, text: str) -> list[int] | None:
        """Ids of Latin letters with punctuation behind them, by the model alone: its other steps only lower-case and split such a word.  None for other words."""
        m = _PLAIN.fullmatch(text)
        if m is None:
            return None
        ids = []
        for part in m.groups():
            if part:
                ids += [x.id for x in self.tokenizer.model.tokenize(part.lower().encode().decode("latin-1").translate(self.table))]
        return ids

    def clear(self) -> None:
        self.keys = np.zeros(0, W.U)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text by the whole tokenizer, many in a line."""
        out: list[list[int]] = []
        lines = [texts[i : i + TOGETHER] for i in range(0, len(texts), TOGETHER)]
        for line, enc in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in line])))
            got = enc.offsets
            word = np.searchsorted(begins, np.fromiter((a for a, _ in got), np.int64, len(got)), "right") - 1
            cuts = np.searchsorted(word, np.arange(len(line) + 1))
            ids = enc.ids
            out += [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        found = [self._plain(x) for x in texts] if self.direct else [None] * len(texts)
        other = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(other, self._encoded([texts[i] for i in other]), strict=True):
            found[i] = ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))))
        keys, at, size = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.size, size)))
        order = np.argsort(keys)
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, count of each word)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        u, one, back = np.unique(W.hash_words(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > HELD:
            self.clear()
        new = np.ones(len(u), bool) if not len(self.keys) else self.keys[np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)] != u
        if new.any():
            raw = buf.tobytes()
            self._learn(u[new], [raw[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
        k = np.searchsorted(self.keys, u)[back]
        size = self.size[k]
        total = np.cumsum(size)
        return self.pool[np.repeat(self.at[k] - (total - size), size) + np.arange(total[-1])], size


_known: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _known:
            _known[path] = WordIds(path)
        find = _known[path]
        for batch in batches:
            doc = batch.column("doc_id").cast(pa.int64())
            buf, offs, _ = W.text_buffers(batch.column("text"))
            for lo, hi in W.groups(offs, W.BLOCK):
                part, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, first = W.find_words(part, o)
                ids, size = find(part, starts, ends)
                at = np.concatenate(([0], np.cumsum(size)))[first]
                row, begin, length, crc, total, kept = [], [], [], [], [], []
                for d in range(hi - lo):
                    own = np.append(ids[at[d] : at[d + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(own) // capacity * capacity
                    for a in (*range(0, whole, capacity), *range(whole, len(own), GRAIN)):
                        piece = own[a : a + (capacity if a < whole else GRAIN)]
                        row.append(lo + d)
                        begin.append(a)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(own))
                        if with_ids:
                            kept.append(piece)
                cols = [doc.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (begin, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(np.concatenate(kept).astype(np.int64) if kept else [], pa.int64())))
                    names.append("ids")
                yield pa.record_batch(cols, names=names)

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each row of ``docs(doc_id, text, ...)``: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids.

    A null text is empty: its only id is end_id.  Rows are taken one by one, also with
    null or repeated doc_id; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), PIECE + (", ids array<long>" if with_ids else ""))


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k windows of positions of sizes, by largest differencing: exactly k, some empty if sizes are fewer."""
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)  # windows that both fill: the small ones of each, largest to smallest
        both = zip(a[len(a) - over :], b[len(b) - over :][::-1], strict=True)
        new = a[: len(a) - over] + [(x + y, (m, n)) for (x, m), (y, n) in both] + b[: len(b) - over]
        new.sort(key=lambda x: -x[0])
        heapq.heappush(heap, ((new[-1][0] if len(new) == k else 0) - new[0][0], tick, new))
        tick += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        stack, own = [tree], []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                own.append(x)
        out.append(sorted(own))
    return out + [[] for _ in range(k - len(out))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length, group = t["length"].to_pylist(), t["bin"][0].as_py()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        full = sum(x == capacity for x in length)
        sequence[:full] = np.arange(full)
        for k, w in enumerate(windows_of(length[full:], capacity)):
            at = 0
            for i in w:
                sequence[full + i], offset[full + i] = full + k, at
                at += length[full + i]
        out = t.drop_columns(["bin"])
        return out.append_column("sequence_id", pa.array((group << 24) + sequence)).append_column("offset", pa.array(offset))

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``cut(doc_id, start, length, ...)`` with sequence_id and offset: sequences of at most capacity, gapless, near equal in each group.

    Rows are dealt into groups by their place in a written table, so that equal rows,
    however many, don't meet.  No rows give no rows.
    """
    cut = written(cut)
    bins = max(1, math.ceil(cut.count() / group))
    dealt = cut.withColumn("bin", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(bins)))
    schema = StructType([*cut.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return dealt.groupBy("bin").applyInArrow(_pack(capacity), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of docs, packed.

    A null text is empty and has its end id only, a very long one is cut like any other;
    null, equal and repeated doc_ids are documents of their own; other columns are ignored.
    Words are known by 64-bit hashes within a task: among HELD words two agree by chance
    with odds of one in a hundred million.  No rows give no rows.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)

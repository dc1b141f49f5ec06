"""Source divergence, vector codes and the quality classifier against brute force and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import divergence, line_crf, quality_classifier, queries, vector_codes
from tidegraph.llm.shared import labelled_sample

DOCS = "doc_id long, text string, lang string, source string"


# 11


def brute_divergence(rows, least=3, top=200):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, terms in own for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= least)
        names = sorted({s for _, s, _ in own})
        count = {s: Counter(t for _, of, terms in own if of == s for t in terms if held[t] >= least) for s in names}
        count[None] = sum(count.values(), Counter())
        part = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        far = lambda p, q: (p - q) * (p - q) // q
        for s in names:
            pairs = [(o, sum(far(part[s][t], part[o][t]) for t in kept)) for o in names if o != s]
            terms = [(t, far(part[s][t], part[None][t])) for t in kept if count[s][t] and part[s][t] > part[None][t]]
            for kind, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, kind, item, value, k + 1) for k, (item, value) in enumerate(found) if kind == "pair" or k < top]
    return sorted(out)


def test_tiles_and_folding(monkeypatch):
    """Sums don't depend on the tiles, nor counts on when a task folds them."""
    rng = np.random.default_rng(4)
    cells = np.unique(rng.integers(0, 60 * 7, 150))
    at, col, n, total = cells // 7, cells % 7, rng.integers(1, 9, len(cells)), rng.integers(200, 300, 7)

    def whole():
        out = np.zeros((7, 7), np.int64)
        for (i, j), block in divergence._pair_sums(at, col, n, total, 60).items():
            out[i : i + block.shape[0], j : j + block.shape[1]] = block
        return out

    one = whole()
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "TILE_TERMS", 11)
    assert (whole() == one).all() and (one[~np.eye(7, dtype=bool)] > 0).all()
    text = pa.array([" ".join(f"w{chr(97 + k % 19)}" for k in range(i % 30)) for i in range(200)])
    batch = pa.record_batch([pa.array(["en", "de"] * 100), pa.array(["s", None] * 100), text], names=["lang", "source", "text"])

    def counts():
        sums = Counter()
        for b in divergence._partial(iter([batch.slice(0, 90), batch.slice(90)])):
            for r in b.to_pylist():
                sums[(r["lang"], r["source"], r["term"], "n")] += r["n"]
                sums[(r["lang"], r["source"], r["term"], "docs")] += r["docs"]
        return sums

    few = counts()
    monkeypatch.setattr(divergence, "FLUSH_ROWS", 10)
    assert counts() == few


@pytest.mark.parametrize("shard", [1 << 16, 20])
def test_divergence_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(divergence, "SHARD_ROWS", shard)
    rng = random.Random(8)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)] + ["Éa", "éA", "naïve", "Ünder", "中文", "a b"]
    say = lambda n, k: rng.choice([" ", "-", "_9", "\n"]).join(rng.choice(vocab[k : k + 40]) for _ in range(n))
    rows = [(say(rng.randint(1, 40), 9 * (i % 4)), "en" if i % 3 else "de", f"s{i % 4}") for i in range(90)]
    rows += [("same text here", "en", "s0")] * 3 + [(None, "en", "empty"), ("", "de", None), ("12 !?", None, None), ("solo words", "xx", "a"), (None, "xx", "b"), ("A" * 5000 + " a" * 9000, "en", "long")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    got = divergence.source_divergence(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows)
    assert sorted(tuple(r) for r in divergence.source_divergence(df, 2, 5).collect()) == brute_divergence(rows, 2, 5)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_long_division_is_exact():
    rng = random.Random(1)
    pairs = [(c, c + 1 + rng.randrange(1 << k)) for k in range(1, 50) for c in (0, 1, rng.randrange(1 << 52))]
    got = divergence.parts_of(np.array([c for c, _ in pairs]), np.array([t for _, t in pairs]))
    assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in pairs]


# 12


def brute_codes(rows, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // 4
    cut = lambda x, p: x[p * d : (p + 1) * d]
    books = [[cut(x, p) for _, x, _ in kept[:256]] for p in range(4)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(x, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        codes = [[nearest(x, p)[1] for p in range(4)] for _, x, _ in kept]
        for p in range(4):
            for e in range(len(books[p])):
                own = [cut(x, p) for (_, x, _), c in zip(kept, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(v) // len(own) for v in zip(*own)]
    out = [(i, "".join(f"{nearest(x, p)[1]:02x}" for p in range(4)), sum(nearest(x, p)[0] for p in range(4)), label) for i, x, label in kept]
    total = Counter()
    for _, _, e, label in out:
        total[label] += e
    text = ",".join(str(v) for b in books for e in b for v in e)
    return sorted(((i, c, e, total[label]) for i, c, e, label in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def test_vector_codes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ROWS", 37)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(330, 12)).astype(np.float32) * 0.2
    x[50:90] = x[7]  # repeated vectors
    x[90:120] = np.round(x[90:120] * 8) / 8  # ties
    rows = [(i, x[i].tolist(), i % 5 if i % 9 else None) for i in rng.permutation(330).tolist()]
    rows += [(900, None, 1), (901, [math.nan] + [0.0] * 11, 1), (902, [math.inf] + [0.0] * 11, 2), (903, [None] + [0.0] * 11, None), (904, [0.0] * 12, 1), (5, x[5].tolist(), 0), (None, x[3].tolist(), 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit("clash")).withColumn("code", F.lit("clash")).repartition(4)
    out, books = vector_codes.encode(df)
    want, digest = brute_codes(rows)
    assert sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=str) == want
    assert vector_codes.codebook_digest(books) == digest
    assert set(out.columns) == {"vec_id", "embedding", "label", "x", "code", "error", "label_error"}
    few, _ = vector_codes.encode(df.filter("vec_id < 3"))
    assert sorted(r.code for r in few.collect()) == ["00000000", "01010101", "02020202"]
    none, empty = vector_codes.encode(df.limit(0))
    assert none.count() == 0 and sum(map(len, empty)) == 0
    with pytest.raises(ValueError, match="one length"):
        vector_codes.encode(spark.createDataFrame([(1, [0.0] * 8, 0), (2, [0.0] * 4, 0)], "vec_id long, embedding array<float>, label int"))


@pytest.mark.parametrize("width", [1, 7, 60, 4000])
def test_cells_leave_out_no_nearest_entry(width):
    rng = np.random.default_rng(width)
    book = rng.integers(-200, 200, (64, 6))
    book[40] = book[3]
    x = rng.integers(-300, 300, (900, 6))
    memo = vector_codes.Memo(book)
    memo.width = width
    code, far = memo.nearest(x)
    d = ((x[:, None] - book[None]) ** 2).sum(-1)
    assert (code == d.argmin(1)).all() and (far == d.min(1)).all()
    again = memo.evaluated
    assert (memo.nearest(x)[0] == code).all() and len(memo.known) <= 900 and memo.evaluated == 2 * again
    assert width > 60 or memo.evaluated < 2 * 900 * 64


# 13


def test_quality_is_learned(spark, sf):
    got = queries.op13_quality_classifier(spark, sf).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert len(held) > 10 and np.mean([a == b for a, b in held]) > 0.85


def test_scores_of_odd_texts(spark):
    rows = [(i, ("a sound sentence about the sea " if i % 2 else "$$ ## !! click %% ") * (1 + i % 4), i % 2) for i in range(160)]
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, 1), (3, 7), (None, 1)], "doc_id long, quality int")
    odd = [(500, None), (501, ""), (502, " \n\t"), (503, "the sea " * 30_000), (504, "x"), (None, "$$ ## !!"), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("text of score", F.lit(1))
    m = quality_classifier.fit(docs, labels)
    got = quality_classifier.score(docs, m).collect()
    assert len(got) == len(rows) + len(odd) and "text of score" in got[0].asDict()
    by = {r.doc_id: r for r in got}
    assert [by[i].predicted for i in range(160)] == [i % 2 for i in range(160)]
    assert by[500].score == by[501].score == by[502].score and by[503].predicted == 1 and by[None].predicted == 0
    again = quality_classifier.fit(docs.orderBy(F.desc("text")).repartition(3), labels)
    assert (again.table == m.table).all() and again.bias == m.bias
    assert quality_classifier.score(docs.limit(0), m).count() == 0
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels.filter("quality = 1"))).collect()} == {0.5}


def test_a_score_is_the_mean_of_features(spark):
    """Each score again, feature by feature, through the parts of the operator that don't use offsets."""
    m = quality_classifier.Model(np.random.default_rng(3).normal(size=quality_classifier.BUCKETS).astype(np.float32) * 20, 0.3, 0.7)
    texts = ["one two two  three", "é#x", "", "A", "a b\na b", "zz zz zz"]
    got = {r.doc_id: r.score for r in quality_classifier.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), m).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        keys, _ = quality_classifier.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        grams = sum(raw[a : a + 1] not in b" \n" for k in quality_classifier.ORDERS for a in range(len(raw) - k + 1))
        pairs = list(zip(words, words[1:]))
        assert len(keys) == grams + len(words) + len(pairs) + sum(a == b for a, b in pairs)
        mean = float(m.table[keys].astype(float).mean()) if len(keys) else 0.0
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(mean + 0.3) / 0.7)), abs=1e-6)


def test_the_sample_is_bounded_by_rows(spark):
    """An id that repeats very often doesn't make the sample larger, and the order of rows doesn't matter."""
    rows = [(1, f"again and again {i}") for i in range(3000)] + [(i, f"text of {i}") for i in range(2, 40)] + [(50, None), (51, "x" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    one, two = (sorted(map(tuple, labelled_sample(d, labels, 100, 300).collect())) for d in (docs, docs.orderBy(F.desc("text")).repartition(7)))
    assert one == two and Counter(q for _, q, _ in one)[1] == 100 and Counter(q for _, q, _ in one)[0] == 19
    a, b = line_crf.fit(docs, labels, 100, 300), line_crf.fit(docs.orderBy(F.desc("text")), labels, 100, 300)
    assert all((x == y).all() for x, y in zip(a, b))
    assert not line_crf.fit(docs.limit(0), labels)[0].any()

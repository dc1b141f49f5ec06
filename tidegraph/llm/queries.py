"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, quality_classifier, vector_codes
from .divergence import source_divergence
from .embedding_join import near_vectors
from .line_crf import fit, judge
from .mixing import mix
from .ngram_join import ngram_components
from .packing import pack_documents
from .secrets import digest_spans, find_secrets
from .shared import table
from .span_dedup import remove_repeats
from .url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The public vocabulary of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; odd vectors link with nothing, no rows give no rows."""
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and taken words of all documents; a null text has size 0, a null source is a source of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what stays of all documents; a null text has no words."""
    out = remove_repeats(table(spark, sf_dir, "documents"), window=50, digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; a null url has empty host and path."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, by a field trained on a bounded sample of the labels; a null text has no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).drop("text", "content_share")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, thousand, document; a row for each document.

    A document without an id has its text's hash in the place of its name.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.xxhash64(text).cast("string")))
    folder = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), folder, name)
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    found = license_scan.scan(docs.select("path", "text"))
    out = docs.select("doc_id", "path").join(found, "path")
    return out.select("doc_id", "path", "own_licence", F.round("score", 6).alias("score"), "is_licence_file", "licence", "inherited_from")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and components of all documents; without words a document links with nothing."""
    return ngram_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; labels of held-out rows aren't read, and rows without a doc_id are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)))
    model = language_id.fit(docs.filter("not held_out"))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null text is empty and has its end mark only."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans in all documents; a null text is empty."""
    return digest_spans(find_secrets(table(spark, sf_dir, "documents")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources and terms of documents, as the operator returns them."""
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, with the digest of the codebooks in each row."""
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebook_digest(books)).alias("codebooks_sha256"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows without a doc_id count as held out, and labels of held-out ids aren't read."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out)
    model = quality_classifier.fit(docs.filter("not held_out"), table(spark, sf_dir, "labels").filter(~held_out))
    return quality_classifier.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: sizes and targets."""
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: host, path, rule and the rule's verdict."""
    return op4_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: the base counts."""
    return op5_quality_rules(spark, sf_dir).drop("kept")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: how many base spans there are of each kind."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict[str, Query]:
    found = (
        op1_embedding_near_dedup,
        op2_mixing,
        op3_substring_dedup,
        op4_url_filter,
        op5_quality_rules,
        op6_license_scan,
        op7_ngram_jaccard_join,
        op8_language_id,
        op9_packing,
        op10_secret_scan,
        op11_source_divergence,
        op12_vector_codes,
        op13_quality_classifier,
        mix_targets,
        url_rules,
        quality_counts,
        secret_counts,
    )
    return {f.__name__: f for f in found}


OP1 = """WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS comp FROM embeddings UNION SELECT l.b, r.comp FROM reach r JOIN link l ON l.a = r.id WHERE r.comp < l.b),
best AS (SELECT id, min(comp) AS comp FROM reach GROUP BY 1),
n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, b.comp AS component_id, e.vec_id = b.comp AS kept
FROM embeddings e JOIN best b ON b.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id"""

OP3 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""


OP7 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
few AS (SELECT k FROM sh GROUP BY 1 HAVING count(*) > 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM few JOIN sh a USING (k) JOIN sh b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT met.a, met.b FROM met JOIN n x ON x.doc_id = met.a JOIN n y ON y.doc_id = met.b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS id, doc_id AS comp FROM documents WHERE doc_id NOT IN (SELECT a FROM link WHERE b < a) UNION SELECT l.b, r.comp FROM reach r JOIN link l ON l.a = r.id),
best AS (SELECT id, min(comp) AS comp FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, best.comp AS component_id FROM w JOIN best ON best.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

MIX = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS words FROM d GROUP BY 1),
o AS (SELECT source, words, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS INT) + 1] AS weight FROM s),
t AS (SELECT *, row_number() OVER (ORDER BY 2 * words / weight, source) AS place FROM o),
f AS (SELECT t.place, 2 * words / weight AS full_at, (1.5 * (SELECT sum(words) FROM t) - 2 * coalesce((SELECT sum(words) FROM t b WHERE b.place < t.place), 0)) / (SELECT sum(weight) FROM t b WHERE b.place >= t.place) AS level FROM t),
l AS (SELECT coalesce((SELECT level FROM f WHERE level <= full_at ORDER BY place LIMIT 1), 1e300) AS level)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(t.words AS BIGINT) AS source_size, round(least(CAST(l.level * t.weight AS DOUBLE), 2 * t.words), 6) AS target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source, l"""

RULES = r"""WITH u AS (SELECT page_id, coalesce(CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM r"""

QUALITY = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 3], chr(10)) AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT doc_id, k FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o.range) AS n FROM win JOIN twice USING (doc_id, k), range(3) o GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""

SECRETS = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex FROM t"""


OP11 = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + 1000000000 * (x.n + 1) // (s.total + v.v) AS p, 1 + 1000000000 * (x.n_lang + 1) // (v.n + v.v) AS q FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum((p.p - o.p) * (p.p - o.p) // o.p), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p ON p.lang = a.lang AND p.source = a.source LEFT JOIN p o ON o.lang = b.lang AND o.source = b.source AND o.term = p.term GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


def op12_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Rounds of assignment and floor of means, one after another."""
    out = ["""WITH q AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT rn, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM q, range(4) t(p)),
b0 AS (SELECT p, rn - 1 AS e, v FROM s WHERE rn <= 256)"""]
    for k in range(rounds + 1):
        out.append(f"a{k} AS (SELECT s.rn, s.p, min(list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + b.e) AS best FROM s JOIN b{k} b USING (p) GROUP BY ALL)")
        if k < rounds:
            out.append(f"""c{k} AS (SELECT s.p, a.best % 256 AS e, i, sum(s.v[i]) AS total, count(*) AS n FROM a{k} a JOIN s USING (rn, p), range(1, len(s.v) + 1) t(i) GROUP BY ALL),
m{k} AS (SELECT p, e, list((total - (total % n + n) % n) // n ORDER BY i) AS v FROM c{k} GROUP BY ALL),
b{k + 1} AS (SELECT b.p, b.e, coalesce(CAST(m.v AS BIGINT[]), b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, e))""")
    out.append(f"""done AS (SELECT rn, string_agg(printf('%02x', CAST(best % 256 AS INT)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT q.vec_id, done.code, done.error, CAST(sum(done.error) OVER (PARTITION BY q.label) AS BIGINT) AS label_error, h.h AS codebooks_sha256 FROM q JOIN done USING (rn), h""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]


def oracle_sql() -> dict[str, str]:
    """Of the others SQL has no Viterbi decoding, training, packing, linking or template trees; what it can say of these has queries of its own."""
    return {"op1_embedding_near_dedup": OP1, "op3_substring_dedup": OP3, "op7_ngram_jaccard_join": OP7, "op11_source_divergence": OP11, "op12_vector_codes": op12_sql(), "mix_targets": MIX, "url_rules": RULES, "quality_counts": QUALITY, "secret_counts": SECRETS}

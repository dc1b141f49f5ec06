"""Secret scans: base patterns, and multipart credential linking, in built-in functions only.

A credential often comes in parts that look harmless alone: an account name, a random
string, a service address.  Such weak candidates are reported only where complementary
parts stand within one scope: the interval join of their positions in a document.  Cells
of SCOPE characters make it an equi-join of the candidate's cell with the part's cell and
its neighbours, and a left-semi join, so that parts never multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound
from .shared import free_name, written

SCOPE = 400
#: Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts: a 40-character random string, an account name, a service address.
LOOSE_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
LOOSE_NAME = r"(?i:client_?id|account_?id|access_?id|user_?name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
LOOSE_PLACE = r"(?i:https?)://[A-Za-z0-9.-]+[A-Za-z0-9/:?&=%._-]*"
KINDS = ("assign", "access", "hex", "secret", "name", "endpoint")
#: Characters of a text that redact cuts together.
PIECE = 4096
SPANS = "array<struct<start:int,kind:int,stop:int>>"


def running(x: Column) -> Column:
    """The sum of the elements ahead of each one of a non-empty int array.

    Arrays are cut into runs of about the root of their length, and runs get their starts
    first: nothing grows one by one over the whole length.
    """

    def sums(y: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(y, first, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def by_runs(z: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(z["x"]), z["n"]), lambda k: F.slice(z["x"], k, z["n"]))
        total = lambda r: F.aggregate(r, F.lit(0), lambda a, v: a + v)
        return bound(runs, lambda r: F.flatten(F.zip_with(r, sums(F.transform(r, total), F.lit(0)), sums)))

    return bound(F.struct(x.alias("x"), F.ceil(F.sqrt(F.size(x))).cast("int").alias("n")), by_runs)


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, stop) of the leftmost non-overlapping matches, in code points; with a group, only of those where it has ``least`` characters."""
    lengths = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), F.length)
    part = lambda n: lengths(group) if group else n

    def spans(n: Column) -> Column:
        # what lies before each match, and behind the last
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(n))
        rows = bound(F.struct(n.alias("n"), gaps.alias("gap"), part(n).alias("part")), lambda z: F.arrays_zip(running(F.zip_with(z["gap"], z["n"], lambda g, m: g + m)).alias("at"), z["gap"].alias("gap"), z["n"].alias("n"), z["part"].alias("part")))
        span = lambda r: F.struct((r["at"] + r["gap"]).alias("start"), F.lit(kind).alias("kind"), (r["at"] + r["gap"] + r["n"]).alias("stop"))
        return F.transform(F.filter(rows, lambda r: r["part"] >= least) if least else rows, span).cast(SPANS)

    return bound(lengths(0), lambda n: F.when(F.size(n) > 0, spans(n)).otherwise(F.array().cast(SPANS)))


def written_as(spans: Column) -> Column:
    """kind:start:stop of sorted spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _linked(found: DataFrame) -> DataFrame:
    """Weak spans that lie in no base span, with their complements in scope: (doc_id, text_hash, more).

    Rows of equal doc_id and text take part once, so that a scope holds few parts.
    """
    keys = ["doc_id", "text_hash"]
    spans = found.filter(F.size("weak") > 0).dropDuplicates(keys).select(*keys, F.explode(F.concat("base", "weak")).alias("s")).select(*keys, "s.*")
    before = Window.partitionBy(*keys).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.col("kind") < 3
    reach = F.max(F.when(base, F.col("stop"))).over(before)  # of base spans that start no later
    parts = written(spans.withColumn("reach", reach).filter(base | F.col("reach").isNull() | (F.col("reach") < F.col("stop"))).drop("reach"))
    role = F.when(F.col("kind").isin(1, 4), "name").when(F.col("kind").isin(0, 2, 3), "secret")
    cells = parts.withColumn("role", role).filter("role is not null").withColumn("cell", F.explode(F.array(*(F.floor(F.col("start") / SCOPE) + k for k in (-1, 0, 1)))))
    cells = cells.select(*(F.col(k).alias(f"p_{k}") for k in (*keys, "role", "cell", "start")))
    weak = parts.filter(~base).withColumn("cell", F.floor(F.col("start") / SCOPE))

    def near(rows: DataFrame, want: str) -> DataFrame:
        side = cells.filter(F.col("p_role") == want)
        on = [rows.doc_id.eqNullSafe(side.p_doc_id), rows.text_hash == side.p_text_hash, rows.cell == side.p_cell, F.abs(rows.start - side.p_start) <= SCOPE]
        return rows.join(side, on, "left_semi")

    both = near(weak.filter("kind = 3"), "name").unionByName(near(weak.filter("kind = 4"), "secret")).unionByName(near(near(weak.filter("kind = 5"), "name"), "secret"))
    return both.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "kind", "stop"))).alias("more"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, spans): sorted arrays of (start, kind, stop) for each row of ``docs(doc_id, text, ...)``.

    base: assignments, access ids and long hex runs; spans: these and the linked weak
    parts that lie in none of them.  Positions are code points, stop exclusive.  A null
    text is empty, a very long one is searched whole.  Rows of equal doc_id and text have
    equal results, each its own row, a null doc_id like any other; other columns are
    ignored, whatever their names; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(matches(text, ASSIGN, 0, 2, 8), matches(text, ACCESS, 1), matches(text, HEX, 2)))
    weak = F.concat(matches(text, LOOSE_SECRET, 3), matches(text, LOOSE_NAME, 4), matches(text, LOOSE_PLACE, 5))
    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), base.alias("base"), weak.alias("weak")))
    more = _linked(found)
    out = found.alias("f").join(more.alias("m"), F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_hash") == F.col("m.text_hash")), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select("f.doc_id", "f.text_hash", "base", spans.alias("spans"))


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written_as(F.col("base")), 256).alias("base_sha256"), written_as(F.col("spans")).alias("spans"))


def _cuts(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, cuts): for each piece of PIECE characters with spans in it an array of (start, stop, marked) in the piece; overlapping spans are one cut, marked where it starts."""
    keys = ["doc_id", "text_hash"]
    spans = found.filter(F.size("spans") > 0).dropDuplicates(keys).select(*keys, F.explode("spans").alias("s")).select(*keys, "s.*")
    order = Window.partitionBy(*keys).orderBy("start", "kind", "stop")
    ahead = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (ahead.isNull() | (F.col("start") >= ahead)).cast("int")
    merged = spans.withColumn("fresh", fresh).withColumn("cut", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = merged.groupBy(*keys, "cut").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    pieces = merged.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("stop") - 1) / PIECE))))
    at = F.col("piece") * PIECE
    cut = F.struct(F.greatest(F.col("start") - at, F.lit(0)).cast("int").alias("start"), F.least(F.col("stop") - at, F.lit(PIECE)).cast("int").alias("stop"), (F.col("start") >= at).alias("marked"))
    by = pieces.groupBy(*keys, F.col("piece").cast("int").alias("piece")).agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    return by.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("piece", "cuts"))).alias("cuts"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of find_secrets replaced by mark, overlapping ones by one; n_chars, where there, follows the text.

    All rows and columns stay, whatever their names; a null text stays null.  Very long
    texts are cut piece by piece.
    """
    key, side = free_name(docs.columns, "secret key"), free_name(docs.columns, "secret cuts")
    cuts = _cuts(find_secrets(docs)).select(F.struct("*").alias(side))
    k, c = (lambda f: F.col(f"`{key}`.{f}")), (lambda f: F.col(f"`{side}`.{f}"))
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash")))
    rows = keyed.join(cuts, k("id").eqNullSafe(c("doc_id")) & (k("hash") == c("text_hash")), "left")

    def clean(p: Column, own: Column) -> Column:
        last = lambda i: F.when(i > 0, F.get(own, i - 1)["stop"]).otherwise(0)
        parts = F.transform(own, lambda x, i: F.concat(F.substring(p, last(i) + 1, x["start"] - last(i)), F.when(x["marked"], F.lit(mark)).otherwise("")))
        return F.concat(F.array_join(parts, ""), F.substring(p, F.element_at(own, -1)["stop"] + 1, F.lit(PIECE)))

    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    one = lambda p, i: bound(F.try_element_at(c("cuts"), i), lambda own: F.when(own.isNull(), p).otherwise(clean(p, own)))
    some = c("cuts").isNotNull()
    new = {"text": F.when(some, F.array_join(F.transform(pieces, one), "")).otherwise(F.col("text"))}
    rows = rows.withColumns(new)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(some, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(f"`{x}`") for x in docs.columns))

"""URL filters by a path-template tree.

Pages are counted by host and path shape, the runs of digits in segments made wildcards
first.  A host's shapes form a tree, which grows from the root by branching points: what
the shapes below a node have in common needs no decision, and where they part, the node
has children.  Many different children are a variable segment and become one wildcard.
Of few children those merge that don't differ statistically, in the depths of the pages
below and, where they have labelled pages, in their shares; children without labelled
pages merge with their like only.  The subtrees of merged children go on as one.

A page that an explicit rule judges is a labelled one, and a template is judged on
labelled pages of its own, by their share of blocked ones, smoothed towards what its
surroundings say.  These speak only where two or more branches of a node, as the urls
spell them, are labelled: each counts once, however many pages it has, beside what the
node has from above.  A template without labelled pages takes that; one labelled branch
says nothing about the others.  A template is rejected if its share is high; pages that no
rule fits follow their template.

Trees of up to GROW segments grow in one task each.  The nodes of larger ones are counted
by partial aggregates, a level of branching points at a time, until what is below them is
small; only the few children of a node that isn't wide meet in one task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Fixed rules: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Segments of all shapes below a node up to which the rest of its tree grows in one task: about 2,900 urls nested in each other.
GROW = 1 << 22
#: Children of a node beyond which they are variable; weight and share of the prior; share from which a template is rejected; z of the tests; depths that are told apart.
FAN_OUT, PRIOR_WEIGHT, PRIOR_SHARE, REJECT, Z, DEPTHS = 40, 4.0, 0.25, 0.8, 1.96, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, rest = rule.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + rest), F.lit(rule)).otherwise(out)
    return out


def _shape(path: Column) -> Column:
    """Segments, runs of digits as wildcards."""
    return F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "*"), "/"), lambda s: s != "")


def smoothed(blocked, labelled, prior):
    """Share of blocked pages among labelled ones, with PRIOR_WEIGHT pages of the prior share: of numbers or of columns."""
    return (blocked + PRIOR_WEIGHT * prior) / (labelled + PRIOR_WEIGHT)


def handed_down(shares: float, branches: int, above: float):
    """What a node's branches without labelled pages take: the mean of its labelled branches' shares, each once, and of what the node has from above; that alone below two branches."""
    return (shares + above) / (branches + 1) if branches > 1 else above


def _same(a: int, m: int, b: int, n: int) -> bool:
    """Two-proportion test of a of m against b of n; none is the same as none only."""
    if not m or not n:
        return m == n
    p = (a + b) / (m + n)
    return abs(a / m - b / n) <= Z * math.sqrt(p * (1 - p) * (1 / m + 1 / n)) + 1e-12


def merged(children: list[tuple]) -> list[list[int]]:
    """Classes of positions of ``children (segment, blocked, labelled, pages by depth)``: largest first, each joins the first class that it doesn't differ from in any test.  The empty segment, where paths end, stays alone."""
    order = sorted(range(len(children)), key=lambda i: (-sum(children[i][3]), children[i][0]))
    classes: list[list] = []
    for i in order:
        name, blocked, labelled, depths = children[i]
        pages = sum(depths)
        for c in classes if name else ():
            if c[0] and _same(blocked, labelled, c[1], c[2]) and all(_same(x, pages, y, sum(c[3])) for x, y in zip(depths, c[3], strict=True)):
                c[1:4] = c[1] + blocked, c[2] + labelled, [x + y for x, y in zip(depths, c[3], strict=True)]
                c[4].append(i)
                break
        else:
            classes.append([bool(name), blocked, labelled, list(depths), [i]])
    return [c[4] for c in classes]


def _merge(t: pa.Table) -> pa.Table:
    """The children of a node with the name of their class, the sorted segments of it."""
    rows = t.to_pylist()
    names = [""] * len(rows)
    for own in merged([(r["segment"], r["blocked"], r["labelled"], r["depths"]) for r in rows]):
        for i in own:
            names[i] = "|".join(sorted(rows[k]["segment"] for k in own))
    return pa.table({"node": t["node"], "segment": t["segment"], "branch": pa.array(names, pa.string())})


def _step(names: list[str]) -> str:
    return "".join("/" + n for n in names if n)


def _spelt_out(node: tuple | None) -> str:
    """A template of its pieces, the last one first."""
    out = []
    while node:
        node, piece = node
        out.append(piece)
    return "".join(reversed(out))


def grown(rows: list[tuple], template: str, share: float, hand: float) -> list[tuple[str, float]]:
    """(template, share) of each of ``rows (shape, depth of the node in it, blocked, labelled, pages)``, all below one node with that template, share and part from above."""
    out: list = [None] * len(rows)
    known_as: dict[tuple, int] = {}
    spelling = [known_as.setdefault(tuple(r[0][: r[1]]), len(known_as)) for r in rows]  # equal for shapes that are equal down to the node
    spellings = len(known_as)
    open_ = [(list(range(len(rows))), [r[1] for r in rows], (None, template), share, hand)]
    while open_:
        own, at, node, share, hand = open_.pop()
        tails = [(rows[i][0], k) for i, k in zip(own, at, strict=True)]
        lead, begin = tails[0]
        common = min(len(s) - k for s, k in tails)
        while common and any(s[k : k + common] != lead[begin : begin + common] for s, k in tails):
            common = next(c for c in range(common) if any(s[k + c] != lead[begin + c] for s, k in tails))
        if common:
            node = (node, _step(lead[begin : begin + common]))
            at = [k + common for k in at]
        if all(len(s) == k for (s, _), k in zip(tails, at, strict=True)):
            text = _spelt_out(node)
            for i in own:
                out[i] = (text, share)
            continue
        by: dict[str, list[int]] = {}
        branches: dict[tuple[int, str], list[int]] = {}
        for x, i in enumerate(own):
            shape, k = rows[i][0], at[x]
            name = shape[k] if k < len(shape) else ""
            by.setdefault(name, []).append(x)
            c = branches.setdefault((spelling[i], name), [spellings + len(branches), 0, 0])
            spelling[i] = c[0]
            c[1] += rows[i][2]
            c[2] += rows[i][3]
        spellings += len(branches)
        shares = [b / n for _, b, n in branches.values() if n]
        hand = handed_down(math.fsum(shares), len(shares), hand)
        names = sorted(by)
        if sum(n != "" for n in names) > FAN_OUT:
            classes = [("*", [n for n in names if n]), *([("", [""])] if "" in by else [])]
        else:
            children = []
            for n in names:
                depths = [0] * (DEPTHS + 1)
                for x in by[n]:
                    depths[min(max(len(rows[own[x]][0]) - at[x] - 1, 0), DEPTHS)] += rows[own[x]][4]
                children.append((n, sum(rows[own[x]][2] for x in by[n]), sum(rows[own[x]][3] for x in by[n]), depths))
            classes = [("|".join(sorted(names[i] for i in c)), [names[i] for i in c]) for c in merged(children)]
        for name, parts in classes:
            below = [x for n in parts for x in by[n]]
            known = sum(rows[own[x]][3] for x in below)
            of = smoothed(sum(rows[own[x]][2] for x in below), known, hand) if known else hand
            open_.append(([own[x] for x in below], [at[x] + (name != "") for x in below], (node, _step([name])), of, hand))
    return out


def _grow(t: pa.Table) -> pa.Table:
    """The rest of a node's tree; equal segments are one string in memory."""
    shapes = t["shape"].combine_chunks()
    coded = shapes.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    flat = [names[i] for i in coded.indices.to_numpy().tolist()]
    ends = np.concatenate(([0], np.cumsum(np.asarray(shapes.value_lengths())))).tolist()
    rows = [(flat[a:b], b - a - left, *of) for a, b, left, *of in zip(ends[:-1], ends[1:], *(t[c].to_pylist() for c in ("left", "blocked", "labelled", "pages")), strict=True)]
    found = grown(rows, *(t[c][0].as_py() for c in ("template", "share", "hand")))
    return pa.table({"host": t["host"], "shape": t["shape"], "template": pa.array([x for x, _ in found], pa.string()), "share": pa.array([x for _, x in found], pa.float64())})


def _branched(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step down from the nodes of ``open_(host, shape, node, left, template, share, hand, blocked, labelled, pages)``, left being how many segments of the shape are below the node: rows that are finished, (host, shape, template, share), and rows below the next branching point."""
    keep = ["host", "shape", "blocked", "labelled", "pages"]
    tail = F.slice("shape", F.size("shape") - F.col("left") + 1, F.col("left"))
    open_ = open_.withColumn("tail", tail)
    ends = open_.groupBy("node").agg(F.min("tail").alias("low"), F.max("tail").alias("high"))
    equal = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    rows = written(open_.join(ends.select("node", F.when(equal > 0, equal - 1).alias("common")), "node"))
    done = rows.filter("common is null").select("host", "shape", F.concat("template", F.array_join(F.transform("tail", lambda x: F.concat(F.lit("/"), x)), "")).alias("template"), "share")
    rows, c = rows.filter("common is not null"), F.col("common").cast("int")
    shared = F.array_join(F.transform(F.slice("tail", F.lit(1), c), lambda x: F.concat(F.lit("/"), x)), "")
    left = F.greatest(F.size("tail") - c - 1, F.lit(0))
    rows = rows.select(*keep, "node", "hand", F.concat("template", shared).alias("template"), F.coalesce(F.get("tail", c), F.lit("")).alias("segment"), left.alias("left"))
    rows = written(rows)
    deep = F.least("left", F.lit(DEPTHS))
    child = rows.groupBy("node", "segment").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.array(*(F.sum(F.when(deep == k, F.col("pages")).otherwise(0)) for k in range(DEPTHS + 1))).alias("depths"))
    child = written(child)
    wide = written(child.filter("segment <> ''").groupBy("node").agg(F.count(F.lit(1)).alias("children")).filter(F.col("children") > FAN_OUT).select("node", F.lit(True).alias("wide")))
    few = child.join(wide, "node", "left_anti").groupBy("node").applyInArrow(_merge, "node long, segment string, branch string")
    many = child.join(wide, "node").select("node", "segment", F.when(F.col("segment") == "", "").otherwise("*").alias("branch"))
    named = written(few.union(many))
    sums = child.join(named, ["node", "segment"]).groupBy("node", "branch").agg(F.sum("blocked").alias("of_branch"), F.sum("labelled").alias("known"))
    literal = F.xxhash64(F.slice("shape", F.lit(1), F.size("shape") - F.col("left")), F.col("segment") == "")
    spelt = rows.filter("labelled > 0").groupBy("node", literal.alias("literal")).agg((F.sum("blocked") / F.sum("labelled")).alias("part"))
    spelt = spelt.groupBy("node").agg(F.sum("part").alias("shares"), F.count(F.lit(1)).alias("branches"))
    rows = rows.join(named, ["node", "segment"]).join(written(sums), ["node", "branch"]).join(written(spelt), "node", "left")
    rows = rows.withColumn("hand", F.when(F.col("branches") > 1, (F.col("shares") + F.col("hand")) / (F.col("branches") + 1)).otherwise(F.col("hand")))
    step = F.when(F.col("branch") == "", "").otherwise(F.concat(F.lit("/"), F.col("branch")))
    share = F.when(F.col("known") > 0, smoothed(F.col("of_branch"), F.col("known"), F.col("hand"))).otherwise(F.col("hand"))
    return done, written(rows.select("host", "shape", F.xxhash64("node", "branch").alias("node"), "left", F.concat("template", step).alias("template"), share.alias("share"), "hand", "blocked", "labelled", "pages"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, share) for each row of ``pages(page_id, url, ...)``.

    verdict: the rule's; else block if the template's smoothed share of blocked pages
    reaches REJECT, else allow.  A null url, or one without ://, has empty host and path.
    Repeated rows and null ids are judged like any other; a url of thousands of segments
    counts whole, and so do urls nested in each other; nodes are known by 64-bit hashes.
    Other columns are ignored; no rows give no rows.
    """
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", _shape(F.col("path")))
    blocks = [r for v, r in rules if v == "block"]
    counts = base.groupBy("host", "shape").agg(F.count_if(F.col("rule").isin(blocks)).alias("blocked"), F.count("rule").alias("labelled"), F.count(F.lit(1)).alias("pages"))
    counts = written(counts)
    known = F.sum("labelled")
    roots = counts.groupBy("host").agg(F.when(known > 0, smoothed(F.sum("blocked"), known, PRIOR_SHARE)).otherwise(PRIOR_SHARE).alias("share"))
    rest = counts.join(roots, "host").select("host", "shape", F.xxhash64("host").alias("node"), F.size("shape").alias("left"), F.lit("").alias("template"), "share", F.lit(PRIOR_SHARE).alias("hand"), "blocked", "labelled", "pages")
    rest, found = written(rest), []
    while True:
        sizes = rest.groupBy("node").agg(F.sum(F.col("left") + 1).alias("segments"))
        large = written(sizes.filter(F.col("segments") > GROW).select("node"))
        small = rest.join(large, "node", "left_anti")
        found.append(small.groupBy("node").applyInArrow(_grow, "host string, shape array<string>, template string, share double"))
        if large.isEmpty():
            break
        done, rest = _branched(rest.join(large, "node", "left_semi"))
        found.append(done)
    named = written(reduce(DataFrame.union, found))
    out = base.join(named, ["host", "shape"])
    own = F.when(F.col("rule").isin(blocks), "block").when(F.col("rule").isNotNull(), "allow")
    verdict = F.coalesce(own, F.when(F.col("share") >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"), "share")

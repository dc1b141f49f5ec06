"""License scans: sparse TF-IDF cosine to templates, then inheritance by directory, in built-in functions only.

Headers are lines of a file, or two or three lines on end where a header is wrapped; they
are compared with one-line templates.  Whole files are compared with whole licence texts,
in which term counts are damped to 1 + log(count).  Both are vectors of terms, weighted by
inverse document frequency among the templates; terms that no template has count only in
the length.

What reaches the threshold must hold some of a template's terms: one of a set without
which the rest of the template is shorter than the threshold (Cauchy-Schwarz).  Rows
without any are left out first, which loses nothing.  Sets are chosen from long words,
which ordinary prose lacks; where these don't suffice, a row without any must hold all
short ones that the threshold can't be reached without.

A licence file speaks for its directory: one whose whole text matches, one whose licence
lines hold at least half of its words, or one with a header that is named like a licence.
Files without a licence of their own inherit from the nearest ancestor directory with one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .shared import written

#: The usual header of each licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
THRESHOLD, FILE_SHARE = 0.75, 0.5
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Lines that a header may be wrapped over; letters that a word of the first filter has.
WRAPPED, SHORT = 3, 5
NAMED = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying)[^/]*$"


def terms_of(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in re.findall(TERM, text.lower()):
        out[t] = out.get(t, 0) + 1
    return out


def damped(n: int) -> float:
    return 1 + math.log(n)


def weigh(templates: tuple[tuple[str, str], ...], tf: Callable[[int], float] = float) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(rows (licence, template, term, unit weight), idf of each term, idf of any other term)."""
    bags = [(name, terms_of(text)) for name, text in templates]
    df: dict[str, int] = {}
    for _, bag in bags:
        for t in bag:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for i, (name, bag) in enumerate(bags):
        norm = math.sqrt(sum((tf(n) * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(name, i, t, tf(n) * idf[t] / norm) for t, n in bag.items()]
    return rows, idf, math.log(1 + len(bags)) + 1


def first_filter(rows: list[tuple[str, int, str, float]], threshold: float) -> tuple[list[str], list[list[str]]]:
    """(some, every): a text that reaches the threshold with any template holds one of some, or all terms of one list of every."""
    some: set[str] = set()
    every: list[list[str]] = []
    for i in sorted({r[1] for r in rows}):
        own = sorted(((t, w * w) for _, k, t, w in rows if k == i), key=lambda x: (-min(len(x[0]), 8), -x[1], x[0]))
        left, rest = 1.0, []
        for t, share in own:
            if left >= threshold**2 and len(t) >= SHORT:
                some.add(t)
                left -= share
            else:
                rest.append((t, share))
        if left >= threshold**2:
            need = [t for t, share in rest if left - share < threshold**2]
            if need:
                every.append(need)
            else:
                some.update(t for t, _ in rest)
    return sorted(some), every


def _pattern(terms: list[str]) -> str:
    """Pattern of a text that holds one of the terms, alternatives grouped by first letter."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(x)})" for c, x in sorted(by.items())) + ")(?![a-z0-9])"


def _may_match(x: Column, rows: list[tuple[str, int, str, float]], threshold: float) -> Column:
    some, every = first_filter(rows, threshold)
    out = x.rlike(_pattern(some))
    for terms in every:
        out = out | reduce(lambda a, b: a & b, (x.rlike(_pattern([t])) for t in terms))
    return out


def _scores(units: DataFrame, keys: list[str], templates: tuple[tuple[str, str], ...], threshold: float, damp: bool) -> DataFrame:
    """(keys, score, licence, words): the best licence of each of ``units(keys, words string)`` that reaches the threshold; words: how many terms it has."""
    spark = units.sparkSession
    rows, idf, other = weigh(templates, damped if damp else float)
    # both tables have a row for each template term, a fixed number
    side = F.broadcast(spark.createDataFrame(rows, "licence string, template int, term string, weight double"))
    rare = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    terms = units.select(*keys, F.explode(F.regexp_extract_all(F.lower("words"), F.lit(TERM), F.lit(0))).alias("term"))
    bag = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n")).join(rare, "term", "left")
    bag = bag.withColumn("w", (1 + F.log("n") if damp else F.col("n")) * F.coalesce("idf", F.lit(other)))
    # the terms are taken and counted once: norms and template terms, of which there are few, leave in one row
    unit = bag.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("words"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("of"))
    held = unit.select(*keys, "norm", "words", F.explode("of").alias("t")).select(*keys, "norm", "words", "t.term", "t.w").join(side, "term")
    dot = held.groupBy(*keys, "licence", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"), F.first("words").alias("words"))
    near = dot.withColumn("score", F.col("dot") / F.col("norm")).filter(F.col("score") >= threshold - 1e-12)
    return near.groupBy(*keys).agg(F.max(F.struct("score", "licence", "words")).alias("b")).select(*keys, "b.score", "b.licence", "b.words")


def _headers(files: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """(path, score, licence, words): each file's best header, and the terms in its licence lines."""
    rows = weigh(templates)[0]
    lines = files.filter(_may_match(F.col("text"), rows, threshold)).select("path", F.split("text", "\n").alias("lines"))
    size, step = F.size("lines"), lambda k: F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.struct(i.alias("line"), F.lit(k).alias("width"), F.array_join(F.slice("lines", i, F.lit(k)), " ").alias("words")))
    spans = F.flatten(F.array(*(F.when(size >= k, F.slice(step(k), F.lit(1), size - k + 1)).otherwise(F.slice(step(k), F.lit(1), F.lit(0))) for k in range(1, WRAPPED + 1))))
    units = lines.select("path", F.explode(F.filter(spans, lambda x: _may_match(x["words"], rows, threshold))).alias("u")).select("path", "u.line", "u.width", "u.words")
    found = _scores(units, ["path", "line", "width"], templates, threshold, False)
    words = F.greatest(F.coalesce(F.sum(F.when(F.col("width") == 1, F.col("words"))), F.lit(0)), F.max("words"))
    return found.groupBy("path").agg(F.max(F.struct("score", "licence")).alias("b"), words.alias("words")).select("path", "b.score", "b.licence", "words")


def _wholes(files: DataFrame, texts: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """(path, score, licence) of files whose whole text matches a licence's."""
    units = files.filter(_may_match(F.col("text"), weigh(texts, damped)[0], threshold)).select("path", F.col("text").alias("words"))
    return _scores(units, ["path"], texts, threshold, True).drop("words")


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, texts: tuple[tuple[str, str], ...] = TEXTS) -> DataFrame:
    """(path, own_licence, score, is_licence_file, licence, inherited_from) for each distinct path of ``files(path, text, ...)``.

    own_licence: of the best header or whole text, ties to the later name.  licence: the own
    one, else that of the nearest ancestor directory with a licence file (of several files
    the licence of most, ties to the earlier name), inherited_from that directory; null if
    there is none.  Null and empty texts have no header, very long ones count whole; rows
    with a null path have no place in the tree and go; rows of one path count together.
    Other columns are ignored, whatever their names; no rows give no rows.
    """
    files = files.select("path", "text").filter("path is not null")
    head = _headers(files, templates, threshold).withColumn("whole", F.lit(False))
    whole = _wholes(files, texts, threshold).select("path", "score", "licence", F.lit(0).cast("long").alias("words"), F.lit(True).alias("whole"))
    own = head.select("path", "score", "licence", "words", "whole").union(whole).groupBy("path").agg(F.max(F.struct("score", "licence")).alias("b"), F.max("words").alias("words"), F.max("whole").alias("whole"))
    own = own.select("path", "b.licence", "b.score", "words", "whole")
    size = files.select("path", F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).alias("all")).groupBy("path").agg(F.sum("all").alias("all"))
    speaks = F.col("whole") | (F.col("words") >= FILE_SHARE * F.col("all")) | F.col("path").rlike(NAMED)
    found = size.join(own, "path", "left").withColumn("is_licence_file", F.coalesce(F.col("licence").isNotNull() & speaks, F.lit(False)))
    found = written(found.withColumn("parts", F.split("path", "/")))
    folder = F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/")
    votes = found.filter("is_licence_file").groupBy(folder.alias("dir"), "licence").agg(F.count(F.lit(1)).alias("n"))
    dirs = written(votes.groupBy("dir").agg(F.max_by(F.struct("licence"), F.struct("n", _descending(F.col("licence")))).alias("x")).select("dir", F.col("x.licence").alias("given")))
    up = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("parts", 1, k), "/").alias("dir")))
    open_files = found.filter("licence is null and size(parts) > 1").select("path", F.explode(up).alias("u")).select("path", "u.depth", "u.dir")
    nearest = open_files.join(dirs, "dir").groupBy("path").agg(F.max(F.struct("depth", "dir", "given")).alias("g")).select("path", "g.dir", "g.given")
    out = found.join(nearest, "path", "left")
    return out.select("path", F.col("licence").alias("own_licence"), "score", "is_licence_file", F.coalesce("licence", "given").alias("licence"), F.col("dir").alias("inherited_from"))


def _descending(name: Column) -> Column:
    """Orders names backwards under max."""
    return F.transform(F.split(name, ""), lambda c: -F.ascii(c))

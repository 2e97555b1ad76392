"""Licence scans: a trained paragraph classifier, applied in DataFrame operations only.

Sparse logistic regression over word 1- and 2-grams tells licence families apart.
It is trained in numpy on the driver, on notices made from the templates below
(words dropped, doubled and surrounded by filler) and on filler alone as the
class ``unknown``.  The threshold of that class is set on held-out notices.  A
predicted family stands if the lines cover enough of one of its templates.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence families and notices that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "licensed under the GNU Affero General Public License version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License 2.0",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "GPL-3.0-or-later",
    ),
    "lgpl": ("licensed under the GNU Lesser General Public License version 2.1", "under the terms of the GNU Lesser General Public License"),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The software is provided \"as is\", without warranty of any kind, express or implied",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License 2.0"),
    "proprietary": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "This document is proprietary and confidential. Unauthorized copying is strictly prohibited."),
}
UNKNOWN = "unknown"

# Everyday words from which filler is made.
FILLER = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she "
    "there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could "
    "these two may first then do any like my now over such our man me even most made after also did many off before must well back through years "
    "much where your way down should because long each just state people those too mr how little good world make very year still see own work men "
    "day get here old life both between being under three never know same last another while us might great go come since against right came take "
    "public general version free copy software program terms rights source code conditions notice license person author write read letter driver"
).split()

_WORD = re.compile(r"[a-z0-9]+")


def _grams(text: str) -> set[str]:
    words = _WORD.findall(text.lower())
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def _notices(rng: random.Random, copies: int) -> tuple[list[set[str]], list[int], list[str]]:
    names = [UNKNOWN, *sorted(TEMPLATES)]
    rows, labels = [], []
    filler = lambda n: " ".join(rng.choice(FILLER) for _ in range(n))
    for y, name in enumerate(names):
        for _ in range(copies * (3 if y == 0 else 1)):
            if y == 0:
                text = filler(rng.randint(1, 30))
            else:
                words = [w for w in rng.choice(TEMPLATES[name]).split() if rng.random() > 0.06]
                text = f"{filler(rng.choice((0, 0, 0, 3, 8)))} {' '.join(words)} {filler(rng.choice((0, 0, 0, 3, 8)))}"
            rows.append(_grams(text))
            labels.append(y)
    return rows, labels, names


@lru_cache(maxsize=4)
def train(seed: int = 0, copies: int = 120, steps: int = 300, least: float = 0.02) -> tuple[tuple[str, ...], dict[str, tuple[float, ...]], tuple[float, ...], float]:
    """(classes, weights by gram, biases, threshold): grams of small weight are left out."""
    rng = random.Random(seed)
    rows, labels, names = _notices(rng, copies)
    seen = sorted({g for t in TEMPLATES.values() for x in t for g in _grams(x)})
    index = {g: i for i, g in enumerate(seen)}

    def matrix(rows: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(seen)), np.float32)
        for i, r in enumerate(rows):
            x[i, [index[g] for g in r if g in index]] = 1
        return x

    x, y = matrix(rows), np.eye(len(names), dtype=np.float32)[labels]
    w, b = np.zeros((len(seen), len(names)), np.float32), np.zeros(len(names), np.float32)

    def soft(x: np.ndarray) -> np.ndarray:
        z = np.exp((z := x @ w + b) - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    for _ in range(steps):
        g = (soft(x) - y) / len(y)
        w -= 8.0 * (x.T @ g + 1e-5 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - 8.0 * 2e-6, 0)  # keeps it sparse
        b -= 8.0 * g.sum(0)
    w[np.abs(w) < least] = 0
    held, truth, _ = _notices(random.Random(seed + 1), copies // 2)
    p = soft(matrix(held))
    right = p[np.arange(len(p)), truth]
    wrong = p[np.array(truth) == 0][:, 1:].max()
    threshold = float(min(0.9, max(0.5, (wrong + np.quantile(right[np.array(truth) > 0], 0.02)) / 2)))
    weights = {g: tuple(float(v) for v in w[i]) for g, i in index.items() if w[i].any()}
    return tuple(names), weights, tuple(float(v) for v in b), threshold


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


@lru_cache(maxsize=4)
def _anchors(coverage: float) -> tuple[str, ...]:
    """Words of which every text has one that covers enough of any template.

    Besides the words that only notices have, each template gives its rarest words
    until what is left of it cannot reach the coverage.
    """
    anchors = {w for t in TEMPLATES.values() for x in t for w in _WORD.findall(x.lower()) if len(w) > 2} - set(FILLER) | {"license", "licensed", "rights"}
    for t in sorted(x for t in TEMPLATES.values() for x in t):
        words = set(_WORD.findall(t.lower()))
        rest = sorted(words - anchors, key=lambda w: (w in FILLER, w.isdigit(), len(w) < 2, w))
        while rest and len(rest) >= coverage * len(words):
            anchors.add(rest.pop(0))
    return tuple(sorted(anchors))


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is read in lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _hits(docs: DataFrame, id_col: str, text_col: str, gate: tuple[str, ...] | None, longest: int) -> DataFrame:
    """``row, doc_id, i, lo, by, words, here``: lines that hold a word of the gate, and ``by`` them those that a window of theirs can reach."""
    reach = longest + 1
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    passes = F.lit(True) if gate is None else low.rlike("(?<![a-z0-9])(?:" + "|".join(gate) + ")(?![a-z0-9])")
    hit = (lambda ws: F.size(ws) > 0) if gate is None else (lambda ws: F.arrays_overlap(ws, F.array(*map(F.lit, gate))))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.when(passes, F.split(low, "\n")).alias("text"))
    base = _once(base, F.transform("text", _tokens), "lines").drop("text")
    line = lambda ws: F.struct(F.size(ws).alias("n"), hit(ws).alias("hit"), F.slice(ws, 1, longest).alias("head"), F.slice(ws, F.greatest(F.size(ws) - longest + 1, F.lit(1)), longest).alias("tail"))
    base = _once(base, F.transform("lines", line), "all")
    places = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: F.element_at("all", i)["hit"])
    # lines that a window can reach from one: those between have no more words than the longest template (a line without words: too many)
    step = lambda acc, x: F.struct((acc["k"] + 1).alias("k"), (acc["s"] + F.when(x["n"] > 0, F.least(x["n"], F.lit(longest + 1))).otherwise(longest + 1)).alias("s"))
    reached = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("k"), F.lit(0).alias("s")), lambda acc, x: F.when(acc["s"] <= longest, step(acc, x)).otherwise(acc))["k"]
    first = lambda i: F.greatest(i - reach, F.lit(1))
    back = lambda i: reached(F.reverse(F.slice("all", first(i), i - first(i))))
    base = _once(base, F.transform(places, lambda i: F.struct(i.alias("i"), (i - back(i)).alias("lo"), (i + reached(F.slice("all", i + 1, F.lit(reach)))).alias("hi"))), "places")
    near = F.transform("places", lambda x: F.struct(x["i"].alias("i"), x["lo"].alias("lo"), F.slice("all", x["lo"], x["hi"] - x["lo"] + 1).alias("by"), F.element_at("lines", x["i"]).alias("words")))
    return base.select("row", "doc_id", F.explode_outer(near).alias("h")).select("row", "doc_id", "h.*").withColumn("here", F.col("i") - F.col("lo") + 1)


def _units(docs: DataFrame, id_col: str, text_col: str, gate: tuple[str, ...] | None) -> DataFrame:
    """``row, doc_id, at, last, words``: lines, and windows of lines of a paragraph, that hold a word of the gate.

    A window may be any run of lines whose inner lines have no more words than
    the longest template; of its first and last line so many words count.  Lines
    without a word end paragraphs.  Documents without units have one row of nulls.
    """
    longest = max(len(_WORD.findall(x.lower())) for t in TEMPLATES.values() for x in t)
    hits = _hits(docs, id_col, text_col, gate, longest)
    # words up to each line; a line without words counts as too many
    sizes = F.transform("by", lambda x: F.when(x["n"] > 0, x["n"]).otherwise(longest + 1).cast("long"))
    hits = _once(hits, F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), "upto")
    at = lambda k: F.element_at("upto", k + 1)  # words up to line k
    inner = lambda a, b: F.when(b > a + 1, at(b - 1) - at(a)).otherwise(0) <= longest
    wordy = lambda k: F.element_at("by", k)["n"] > 0
    # a window belongs to the first of its lines that holds a word of the gate
    starts = F.filter(F.sequence(F.lit(1), "here"), lambda a: wordy(a) & inner(a, F.col("here")) & ~F.exists(F.slice("by", a, F.col("here") - a), lambda x: x["hit"]))
    hits = _once(hits, starts, "starts")
    ends = F.sequence(F.col("here"), F.size("by"))
    spans = F.flatten(F.transform("starts", lambda a: F.transform(F.filter(ends, lambda b: wordy(b) & inner(a, b) & (b > a)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    spans = F.concat(F.array(F.struct(F.col("here").alias("a"), F.col("here").alias("b"))), spans)
    units = hits.select("*", F.explode_outer(spans).alias("s"))
    a, b = F.col("s.a"), F.col("s.b")
    middle = F.flatten(F.transform(F.slice("by", a + 1, F.greatest(b - a - 1, F.lit(0))), lambda x: x["head"]))
    words = F.when(a == b, F.col("words")).otherwise(F.concat(F.element_at("by", a)["tail"], middle, F.element_at("by", b)["head"]))
    return units.select("row", "doc_id", (a + F.col("lo") - 1).alias("at"), (b + F.col("lo") - 1).alias("last"), F.when(a.isNotNull(), words).alias("words"))


def _weighted(words: str, grams: tuple[str, ...]) -> Column:
    """The distinct words, and pairs of neighbours, of a column that are among the given ones; others have no weight."""
    ones, pairs = sorted(g for g in grams if " " not in g), sorted(g for g in grams if " " in g)
    firsts, seconds = ({p.split(" ")[k] for p in pairs} for k in (0, 1))
    less = F.greatest(F.size(words) - 1, F.lit(0))
    # only what both halves allow is put together
    both = F.zip_with(F.slice(words, 1, less), F.slice(words, 2, less), lambda a, b: F.when(a.isin(*sorted(firsts)) & b.isin(*sorted(seconds)), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.concat(F.filter(words, lambda w: w.isin(*ones)), F.filter(both, lambda g: g.isin(*pairs))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.6, gated: bool = True) -> DataFrame:
    """One row a document: ``doc_id, license, probability, coverage, confirmed, n_notices, families``.

    ``license`` is the confirmed family of the highest probability (ties: by
    name), or ``unknown``; ``families`` are all confirmed ones, sorted.  Lines
    are classified alone and in windows of consecutive lines, as a notice may be
    wrapped anywhere; of those that overlap the one of the best coverage counts
    (ties: the shortest, then the likeliest).  A line or window without any of
    the words that every confirmed one has is of the unknown class; ``gated``
    skips such text early.  Null and empty texts have no lines; repeated rows
    each have a row; an empty table gives none; only the two named columns are
    read.  The weights (a few thousand, fixed by the templates) are broadcast.
    """
    spark = docs.sparkSession
    names, weights, bias, threshold = train()
    units = _units(docs, id_col, text_col, _anchors(coverage) if gated else None)
    vocabulary = sorted({w for t in TEMPLATES.values() for x in t for w in _WORD.findall(x.lower())})
    among = lambda words: (lambda w: w.isin(*sorted(words)))  # a set that is made once, not once a unit
    units = _once(units, F.array_distinct(F.filter("words", among(vocabulary))), "known")
    # coverage: the largest part of a template's words that the unit has, by family
    cover = F.array(*[
        F.greatest(F.lit(0.0), F.lit(0.0), *[F.size(F.filter("known", among(ws))) / F.lit(len(ws)) for ws in (set(_WORD.findall(t.lower())) for t in TEMPLATES.get(n, ()))])
        for n in names
    ])
    # a window that covers no template enough cannot count
    units = _once(units, F.when(F.col("at").isNotNull(), cover), "cover").where(F.col("at").isNull() | (F.col("at") == F.col("last")) | (F.array_max("cover") >= coverage))
    words = units.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    grams = _once(words, _weighted("words", tuple(weights)), "grams")
    table = spark.createDataFrame([(g, *w) for g, w in weights.items()], "gram string, " + ", ".join(f"w{i} double" for i in range(len(names))))
    covers = [F.element_at("cover", i + 1).alias(f"c{i}") for i in range(len(names))]  # numbers, not an array: hashed without a sort
    exploded = grams.select("row", "doc_id", "at", "last", *covers, F.explode_outer("grams").alias("gram"))
    met = exploded.join(F.broadcast(table), "gram", "left")
    logits = met.groupBy("row", "doc_id", "at", "last").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(names))], *[(F.round(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)), 9) + F.lit(bias[i])).alias(f"z{i}") for i in range(len(names))])
    top = F.greatest(*[F.col(f"z{i}") for i in range(len(names))])
    total = sum((F.exp(F.col(f"z{i}") - F.col("top")) for i in range(1, len(names))), F.exp(F.col("z0") - F.col("top")))
    classes = [F.struct((F.exp(F.col(f"z{i}") - F.col("top")) / F.col("total")).alias("p"), F.lit(-i).alias("order"), F.lit(names[i]).alias("name"), F.col(f"c{i}").alias("cover")) for i in range(1, len(names))]
    best = logits.withColumn("top", top).withColumn("total", total).withColumn("best", F.array_max(F.array(*classes)))
    stands = F.col("best.cover") >= coverage
    sure = F.col("at").isNotNull() & (F.col("best.p") >= threshold) & (stands | (F.col("at") == F.col("last")))
    ranked = F.struct((~stands).alias("open"), (-F.col("best.cover")).alias("c"), (F.col("last") - F.col("at")).alias("n"), (-F.col("best.p")).alias("q"), "at", "last", "best")
    found = best.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(sure, ranked))).alias("found"))
    kind = found.schema["found"].dataType.simpleString()
    kept = F.aggregate("found", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: (y["at"] <= x["last"]) & (x["at"] <= y["last"])), acc).otherwise(F.concat(acc, F.array(x))))
    found = _once(found, kept, "kept")
    found = _once(found, F.transform(F.filter("kept", lambda x: ~x["open"]), lambda x: x["best"]), "standing")
    out = found.select("doc_id", F.array_max("standing").alias("best"), F.size("kept").cast("long").alias("n_notices"), F.array_sort(F.array_distinct(F.transform("standing", lambda x: x["name"]))).alias("families"))
    return out.select(
        "doc_id", F.coalesce("best.name", F.lit(UNKNOWN)).alias("license"), F.round(F.coalesce("best.p", F.lit(0.0)), 6).alias("probability"),
        F.round(F.coalesce("best.cover", F.lit(0.0)), 6).alias("coverage"), F.col("best").isNotNull().alias("confirmed"), "n_notices", F.concat_ws(",", "families").alias("families"),
    )

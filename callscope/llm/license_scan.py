"""Licence scan: Dice coefficient over word bigrams against licence templates.

A document's units (lines, paragraphs, the whole text, and windows of words in
what no other unit of a licence matches) are normalised to lower case words and compared with each template that could reach the threshold: a
Dice coefficient of t or more needs the smaller bigram set to have at least
t / (2 - t) times the larger one's size, and as many of the template's bigrams
in the text.  Texts without any of the bigrams that a match must hold are left
out before their words are counted, and licences with too few bigrams in a text
before it is cut into units.  DataFrame functions only.
"""

from __future__ import annotations

import math
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import stage
from callscope.session import BROADCAST_MAX_BYTES

# Notices as licences ask for them to be written, then whole licences (licenses/<SPDX id>.txt).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation, either version 3 of the License, or "
                         "(at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation; either version 2 of the License, or "
                         "(at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                          "Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                          "(at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                          "Public License as published by the Free Software Foundation, either version 3 of the License, or "
                          "(at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                          "Public License as published by the Free Software Foundation, either version 3 of the License, or "
                          "(at your option) any later version."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
]
THRESHOLD = 0.8


def whole_licenses() -> list[tuple[str, str]]:
    """The texts that come with this package, also out of an archive; without any the scan would miss licences unseen, so that is an error."""
    texts = sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in (files(__package__) / "licenses").iterdir() if f.name.endswith(".txt"))
    if not texts:
        raise FileNotFoundError(f"no licence texts in {__package__}")
    return texts


TEMPLATES += whole_licenses()


def normalised(text: Column) -> Column:
    """Lower case; runs of anything but letters, digits and line ends become one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def word_list(unit: Column) -> Column:
    return F.split(F.trim(F.translate(unit, "\n", " ")), " +")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbours."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(2), last), lambda a, b: F.concat_ws(" ", a, b)))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    ratio = threshold / (2 - threshold)
    return max(1, math.ceil(n * ratio - 1e-9)), math.floor(n / ratio + 1e-9)


def _alternatives(anchors: list[str]) -> str:
    """A pattern of sorted anchors that shares their beginnings."""
    out, at = [], 0
    while at < len(anchors):
        head = anchors[at][:1]
        end = at
        while end < len(anchors) and anchors[end][:1] == head:
            end += 1
        if head:
            rest = [a[1:] for a in anchors[at:end]]
            out.append(("[ \\n]+" if head == " " else head) + (_alternatives(rest) if any(rest) else ""))
        at = end
    return ("(?:" + "|".join(out) + ")" + ("?" if not anchors[0] else "")) if len(out) > 1 or not anchors[0] else out[0]


def anchor_pattern(notices: list[list[str]], threshold: float) -> str:
    """A pattern that every matching text contains.

    A match shares at least ratio * n of a notice's n bigrams, so it holds one
    of any n - ceil(ratio * n) + 1 of them; the longest, as the rarest, are taken.
    """
    anchors = set()
    for grams in notices:
        needed = max(1, size_bounds(len(grams), threshold)[0])
        anchors.update(sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - needed + 1])
    return r"(?:^|[ \n])" + _alternatives(sorted(anchors)) + r"(?:$|[ \n])"


def holds_anchor(text: Column, notices: list[list[str]], threshold: float) -> Column:
    """Whether a text can match: notices of like size share a pattern, and a text must be as long as their bigrams need."""
    held = F.lit(False)
    for low, high in ((0, 64), (64, 512), (512, math.inf)):
        some = [g for g in notices if low <= len(g) < high]
        if some:
            words = min(size_bounds(len(g), threshold)[0] for g in some) + 1
            held = held | ((F.length(text) >= 2 * words - 1) & text.rlike(anchor_pattern(some, threshold)))
    return held


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def rest_words(text: Column, is_match) -> Column:
    """The text's words in order, with an empty word for each line or paragraph that matches as such."""
    gap = F.array(F.lit(""))
    line = lambda x: let(word_list(x), lambda w: F.when(is_match(w), gap).otherwise(w))
    block = lambda x: F.when(is_match(word_list(x)), gap).otherwise(F.flatten(F.transform(F.split(x, "\n"), line)))
    words = F.flatten(F.transform(F.split(text, "\n(?: ?\n)+"), block))
    return F.when(is_match(word_list(text)), F.array().cast("array<string>")).otherwise(words)


def hit_windows(hits: Column, n: Column, threshold: float) -> Column:
    """begin, end (of pairs, from 0) and dice of the windows that match a notice of n bigrams.

    ``hits`` are the text's pairs that the notice has, in order: pos, seen (the
    same pair's place before, or -1) and gram (its place in the notice).  One
    running score is carried over them: a bigram that the window lacks adds
    2 - threshold, one that it has adds nothing, each pair that the notice lacks
    takes off the threshold; a score of threshold * n is a Dice coefficient of
    threshold.  A window begins at the hit after the score fell to zero and ends
    where it was highest, so the work is linear in the hits.  After a match, a
    bigram that comes again once the score has dropped begins the next window.

    The window's size are its distinct bigrams of the notice and every other
    pair.  One that lacks the notice's first or last bigram counts as at least
    as long as the notice, so words changed at the ends aren't cut off.
    """
    t = threshold
    kind = "struct<begin:int,last:int,score:double,held:int,hits:int,gram:int,best:double,end:int,best_held:int,best_hits:int,end_gram:int,out:array<struct<begin:int,end:int,dice:double>>>"
    need = t * n - 1e-9
    zero = F.struct(
        F.lit(-1), F.lit(0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), F.lit(0),
        F.array().cast("array<struct<begin:int,end:int,dice:double>>")).cast(kind)

    def with_match(acc: Column) -> Column:
        span = acc["end"] - acc["begin"] + 1
        size = acc["best_held"] + span - acc["best_hits"]
        ends = F.array(F.least(acc["gram"], acc["end_gram"]), F.greatest(acc["gram"], acc["end_gram"]))  # in either direction
        complete = ends == F.array(F.lit(0), n - 1)
        dice = 2 * acc["best_held"] / (F.when(complete, size).otherwise(F.greatest(size, n)) + n)
        found = F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end"), dice.alias("dice")))
        return F.when((acc["best"] >= need) & (dice >= t - 1e-9), F.concat(acc["out"], found)).otherwise(acc["out"])

    def step(acc: Column, h: Column) -> Column:
        score = acc["score"] - t * (h["pos"] - acc["last"] - 1)
        again = h["seen"] >= acc["begin"]
        next_copy = (acc["best"] >= need) & again & (acc["best"] - score >= F.greatest(F.lit(3 * t), 0.1 * t * n))
        fresh = (acc["begin"] < 0) | (score <= 0) | next_copy
        score = F.when(fresh, 2 - t).when(again, score).otherwise(score + (2 - t))
        held = F.when(fresh, 1).when(again, acc["held"]).otherwise(acc["held"] + 1)
        hits = F.when(fresh, 1).otherwise(acc["hits"] + 1)
        better = fresh | (score > acc["best"])
        keep = lambda new, old: F.when(better, new).otherwise(acc[old])
        return F.struct(
            F.when(fresh, h["pos"]).otherwise(acc["begin"]), h["pos"], score, held, hits, F.when(fresh, h["gram"]).otherwise(acc["gram"]),
            keep(score, "best"), keep(h["pos"], "end"), keep(held, "best_held"), keep(hits, "best_hits"), keep(h["gram"], "end_gram"),
            F.when(fresh, with_match(acc)).otherwise(acc["out"])).cast(kind)

    return F.aggregate(hits, zero, step, with_match)


def text_windows(texts: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """row, windows: the windows of each text (row, license, words) that match a notice of its licence; of those that overlap, the best.

    ``grams`` (license, template, n, gram, pair) are the notices' bigrams.  Pairs
    meet them by an equal join, and each notice's hits are scanned from both
    ends: a part of a notice shortly before a whole one spoils that only for one
    of the directions.
    """
    last = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), last), F.slice("words", F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b))
    placed = texts.select("row", "license", F.posexplode(pairs).alias("pos", "pair"))
    hits = placed.join(grams, ["license", "pair"]).select("row", "template", "n", "pos", "gram")
    found = hits.groupBy("row", "template", "n").agg(F.sort_array(F.collect_list(F.struct("gram", "pos"))).alias("by_gram"))
    least = F.ceil(F.col("n") * (threshold / (2 - threshold)) - 1e-9)
    found = found.filter(F.size("by_gram") >= least)

    def neighbour(step: int) -> Column:
        """Hits with the place of the same pair before (or behind, counted down from 0)."""
        def of(x: Column, i: Column) -> Column:
            other = F.get(F.col("by_gram"), i - step)
            sign = F.lit(step)
            seen = F.when((i - step >= 0) & (other["gram"] == x["gram"]), sign * other["pos"] + (0 if step > 0 else F.col("top"))).otherwise(-1)
            pos = sign * x["pos"] + (0 if step > 0 else F.col("top"))
            return F.struct(pos.alias("pos"), seen.alias("seen"), x["gram"].alias("gram"))

        return F.array_sort(F.transform("by_gram", of))

    found = found.withColumn("top", F.array_max(F.transform("by_gram", lambda x: x["pos"])))
    found = found.withColumns({"ahead": neighbour(1), "back": neighbour(-1)})
    turned = F.transform(hit_windows(F.col("back"), F.col("n"), threshold), lambda w: F.struct(
        (F.col("top") - w["end"]).alias("begin"), (F.col("top") - w["begin"]).alias("end"), w["dice"].alias("dice")))
    both = found.select("row", F.concat(hit_windows(F.col("ahead"), F.col("n"), threshold), turned).alias("windows"))
    # the outer form: else a filter on the arrays' sizes is derived that works all of this out once more, within its own loops
    every = both.select("row", F.explode_outer("windows").alias("w")).filter("w is not null").groupBy("row").agg(F.array_sort(F.collect_set("w")).alias("windows"))
    return every.select("row", best_apart(F.col("windows")).alias("windows"))


def best_apart(windows: Column) -> Column:
    """Of sorted windows that overlap, the best one, the first of equals."""

    def step(kept: Column, w: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        apart = (F.size(kept) == 0) | (last["end"] + 1 < w["begin"])
        better = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(w))
        return F.when(apart, F.concat(kept, F.array(w))).when(w["dice"] > last["dice"], better).otherwise(kept)

    return F.aggregate(windows, F.array().cast("array<struct<begin:int,end:int,dice:double>>"), step)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, best_dice and n_units (distinct units that match) of each document and licence found.

    Units are lines, paragraphs, the whole text and, apart from lines and
    paragraphs that match the licence, windows of words of any place
    (``hit_windows``); of windows that overlap, the best one.

    A unit matches a template if their bigram sets' Dice coefficient is at least
    ``threshold``; texts and templates of one word have no bigrams and match
    nothing.  Null and empty texts give no rows, nor does an empty table; rows
    with the same id (null is one) are counted together; other columns are
    ignored.  Texts that may match are written once, with their units' matches.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, notice string")
    known = known.select("template", "license", bigrams(word_list(normalised(F.col("notice")))).alias("notice_bigrams"))
    notices = {r["template"]: r["notice_bigrams"] for r in known.collect() if r["notice_bigrams"]}
    least = {t: size_bounds(len(grams), threshold)[0] for t, grams in notices.items()}
    # the notices are in hand: their size is known
    small = sum(64 + sum(len(g) + 40 for g in grams) for grams in notices.values()) <= BROADCAST_MAX_BYTES
    listed = F.broadcast(known) if small else known

    text = normalised(F.col(text_col).cast("string"))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    docs = docs.filter(let(F.col("text"), lambda t: holds_anchor(t, list(notices.values()), threshold)))
    docs = docs.withColumn("text_bigrams", bigrams(word_list(F.col("text"))))
    needs = F.array(*(F.struct(F.lit(t).alias("template"), F.lit(n).alias("least")) for t, n in least.items()))
    fits = F.explode(F.filter(needs, lambda t: t["least"] <= F.size("text_bigrams")))
    docs = docs.select("doc_id", "text", "text_bigrams", fits.alias("t")).select("doc_id", "text", "text_bigrams", "t.template", "t.least")
    found = docs.join(listed, "template").filter(F.size(F.array_intersect("text_bigrams", "notice_bigrams")) >= F.col("least"))

    # row-local from here: the templates of a licence found in a text are compared together, so that windows know what units match
    key = F.xxhash64("text")
    found = found.groupBy("doc_id", "license", key.alias("key")).agg(
        F.first("text").alias("text"), F.collect_set("notice_bigrams").alias("notices"))

    def dice(words: Column) -> Column:
        def against(grams: Column) -> Column:
            shares = F.transform("notices", lambda n: 2 * F.size(F.array_intersect(grams, n)) / (F.size(grams) + F.size(n)))
            return F.when(F.size(grams) > 0, F.array_max(shares)).otherwise(0.0)
        return let(bigrams(words), against)

    unit = F.array_distinct(F.transform(
        F.concat(F.split("text", "\n"), F.split("text", "\n(?: ?\n)+"), F.array("text")), word_list))
    scored = F.transform(unit, lambda w: F.struct(F.concat_ws(" ", w).alias("unit"), dice(w).alias("dice")))
    matched = F.filter(scored, lambda u: u["dice"] >= threshold)
    found = found.select("doc_id", "license", "text", matched.alias("matched"))
    known_units = F.transform("matched", lambda u: u["unit"])
    rest = rest_words(F.col("text"), lambda w: F.array_contains(known_units, F.concat_ws(" ", w)))
    found = stage(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "license", "matched", rest.alias("words")), "license-texts")

    grams = known.select("license", "template", F.size("notice_bigrams").alias("n"), F.posexplode("notice_bigrams").alias("gram", "pair"))
    windows = text_windows(found, F.broadcast(grams) if small else grams, threshold)
    in_windows = found.join(windows, "row").select("doc_id", "license", F.explode("windows").alias("w"), "words").select(
        "doc_id", "license", F.struct(
            F.concat_ws(" ", F.slice("words", F.col("w.begin") + 1, F.col("w.end") - F.col("w.begin") + 2)).alias("unit"), F.col("w.dice").alias("dice")).alias("u"))
    units = found.select("doc_id", "license", F.explode("matched").alias("u")).unionByName(in_windows)
    return (
        units.groupBy("doc_id", "license", "u.unit").agg(F.max("u.dice").alias("dice"))
        .groupBy("doc_id", "license").agg(F.max("dice").alias("best_dice"), F.count(F.lit(1)).alias("n_units"))
    )

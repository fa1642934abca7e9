"""Licence notices: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of the text, or, where a notice is wrapped, its words over the neighbouring
lines: lines with words, from the one in which a template's run first begins, for at most
``LONGEST`` words behind it. A notice is reported at its first line, or at a line that passes by
itself. Features are the words and pairs of words of the templates and near misses below, present
or not; a multinomial logistic regression with an elastic-net penalty, which leaves few weights,
tells licence families and *unknown* apart.

Training rows are the templates, whole and with words missing at either end or anywhere between,
but for the words that decide on the family. For *unknown* there are templates with their words
backwards and lines made of their halves; near misses, which are notices of other licences and
templates with a deciding word replaced; and all lines of the corpus that stay below the overlap,
counted by their features, so that a row stands for all lines alike. Those that share three words with
a template, and those that do not, are scaled to a fixed weight each. About half of the unknown rows are put aside, and the
probability that a family needs is calibrated on them: at most ``false_share`` of them pass, of
near misses and other rows each. A near miss counts for the families that its overlap would confirm.

A prediction stands if the paragraph has at least ``overlap`` of the three-word runs of one of
the family's templates. The opening of BSD-2-Clause is that of BSD-3-Clause: in a text that has the
condition on binary forms but not the third one it is not reported.

Everything runs as DataFrame expressions and the library's own transformers. All lines of all texts
are read; those where no run of a template begins could not be confirmed and are not scored.

Defined results: null and empty texts have no notices. Repeated rows are reported each. Rows are
numbered by line from 0. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.frames import settled
from lorebase.session import materialize

UNKNOWN = "unknown"
# Notices of licence families.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    ],
}


# Notices of other licences, which come near those above.
NEAR = [
    "Licensed under the BSD 2-Clause License.",
    "Licensed under the BSD 4-Clause License.",
    "Licensed under the Apache License, Version 1.1.",
    "Licensed under the Apache License, Version 1.0.",
    "Licensed under the Academic Free License, Version 3.0.",
    "Licensed under the Educational Community License, Version 2.0.",
    "Licensed under CC BY-SA 4.0.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    "You should have received a copy of the GNU Lesser General Public License along with this program.",
    "You should have received a copy of the GNU Affero General Public License along with this program.",
    "Released under the ISC License.",
    "Released under the Zlib License.",
    "This Source Code Form is subject to the terms of the Eclipse Public License, version 2.0.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, version 1.1.",
]
# The words that tell a family, without which a part of a template is none of it.
DECIDING = ["apache", "bsd", "3-clause", "cc", "by", "by-nc", "attribution", "attribution-noncommercial", "gnu", "general", "mit", "mozilla", "2.0", "3", "4.0"]
OTHERS = ["affero", "lesser", "eclipse", "2-clause", "by-sa", "attribution-sharealike", "other", "1.0", "1.1", "2"]
TELLING = 6
"""Letters of a word that is rare enough in other texts to look for it alone."""
OVERLAP = 0.6
ROWS_PER_PART = 50_000
"""Training rows that one task reads again and again."""
# The opening of BSD-2-Clause is that of BSD-3-Clause; a text with the second condition and no third is BSD-2-Clause.
BSD_BINARY = r"(?i)redistributions[^\p{L}\p{N}]+in[^\p{L}\p{N}]+binary[^\p{L}\p{N}]+form[^\p{L}\p{N}]+must"
BSD_THIRD = r"(?i)endorse[^\p{L}\p{N}]+or[^\p{L}\p{N}]+promote"
LONGEST = 2 * max(len(text.split()) for texts in TEMPLATES.values() for text in texts)


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and inner dots or hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++(?:[.-][\p{L}\p{N}]++)*+"), F.lit(0))


def runs(of: Column, n: int) -> Column:
    """Distinct runs of n words, joined by spaces."""
    starts = F.sequence(F.lit(1), F.size(of) - n + 1)
    made = F.transform(starts, lambda i: F.array_join(F.slice(of, i, F.lit(n)), " "))
    return F.when(F.size(of) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def features(of: Column) -> Column:
    return F.concat(F.array_distinct(of), runs(of, 2))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    frame = spark.createDataFrame(rows, "family string, text string")
    return settled(settled(frame, words=words(F.col("text"))), runs=runs(F.col("words"), 3)).drop("text")


def near_misses(known: DataFrame) -> DataFrame:
    """(words, aside): notices of other licences, and templates with a deciding word replaced; every other one is put aside."""
    spark = known.sparkSession
    notes = spark.createDataFrame([(text, k % 2 == 1) for k, text in enumerate(NEAR)], "text string, aside boolean")
    notes = notes.select(words(F.col("text")).alias("words"), "aside")
    swaps = known.select("words", F.explode(F.array_intersect("words", F.array(*map(F.lit, DECIDING)))).alias("old"))
    swaps = swaps.withColumn("new", F.explode(F.array(*map(F.lit, OTHERS))))
    swaps = settled(swaps, swapped=F.transform("words", lambda w: F.when(w == F.col("old"), F.col("new")).otherwise(w)))
    return notes.unionByName(swaps.select(F.col("swapped").alias("words"), (F.pmod(F.xxhash64("swapped"), F.lit(2)) == 0).alias("aside")))


def corpus_lines(docs: DataFrame, known: DataFrame, vocabulary: list[str], weight: float) -> DataFrame:
    """(tokens, has, aside, near, weight): all lines with words of all texts, by what the classifier sees of them.

    ``tokens`` has a line's features in the vocabulary and ``has`` its runs that a template has; lines alike
    in both are one row. Lines that reach the overlap are left out. All lines with a run of a template, and
    all without, weigh at most ``weight`` together.
    """
    told = [r["run"] for r in known.select(F.explode("runs").alias("run")).distinct().orderBy("run").collect()]
    single, double = (F.array(*[F.lit(t) for t in vocabulary if (" " in t) == two]) for two in (False, True))
    none = F.array().cast("array<string>")
    lines = settled(docs.select(F.explode(F.split("text", "\n", -1)).alias("line")), words=words(F.col("line"))).filter(F.size("words") > 0)
    lines = settled(lines.select("words"), alone=F.array_intersect("words", single))
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))  # null behind the last word
    lines = settled(lines, pairs=F.when(F.size("alone") > 1, F.array_intersect(pairs, double)).otherwise(none))
    has = F.when(F.size("pairs") > 1, F.array_intersect(runs(F.col("words"), 3), F.array(*map(F.lit, told)))).otherwise(none)
    aside = F.pmod(F.xxhash64("words"), F.lit(2)) == 0
    seen = lines.select(F.sort_array(F.concat("alone", "pairs")).alias("tokens"), F.sort_array(has).alias("has"), aside.alias("aside"))
    seen = materialize(seen.groupBy("tokens", "has", "aside").agg(F.count("*").alias("n")), "licence-lines")
    seen = seen.withColumn("near", F.size("has") > 0)
    templates_ = F.array(*[F.array(*map(F.lit, r["runs"])) for r in known.select("runs").collect()])
    below = seen.filter(~F.exists(templates_, lambda t: share(F.col("has"), t) >= OVERLAP))
    totals = {r["near"]: r["n"] for r in below.groupBy("near").agg(F.sum("n").alias("n")).collect()}  # two rows
    of = F.when(F.col("near"), F.lit(min(1.0, weight / totals.get(True, 1)))).otherwise(F.lit(min(1.0, weight / totals.get(False, 1))))
    return below.withColumn("weight", F.col("n") * of).drop("n")


def made_rows(known: DataFrame) -> DataFrame:
    """(family, words, aside, near): ``aside`` marks the rows kept for calibration, ``near`` those that look like a notice but are none."""
    decides = F.array_intersect("words", F.array(*map(F.lit, DECIDING))).alias("decides")
    kept = known.select("family", "words", decides)
    ends = kept.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(2))))
    ends = ends.select("family", "decides", F.slice("words", F.col("a") + 1, F.greatest(F.size("words") - F.col("a") - F.col("b"), F.lit(1))).alias("part"), "words")
    holes = kept.select("family", "decides", "words", F.posexplode("words").alias("i", "_w")).select(
        "family", "decides", F.filter("words", lambda w, j: j != F.col("i")).alias("part"), "words")
    whole = kept.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("_k")
    part = F.when(F.size(F.array_except("decides", "part")) == 0, F.col("part")).otherwise(F.col("words"))  # whole, rather than without a deciding word
    yes = whole.unionByName(ends.unionByName(holes).withColumn("words", part).drop("part")).select("family", "words", F.lit(False).alias("aside"), F.lit(False).alias("near"))

    back = known.select(F.reverse("words").alias("words"))
    half = known.select(F.explode(F.array(F.slice("words", F.lit(1), F.lit(3)), F.slice("words", F.size("words") - 1, F.lit(2)))).alias("words"))
    no = back.unionByName(half).select("words", (F.pmod(F.xxhash64("words"), F.lit(2)) == 0).alias("aside"), F.lit(False).alias("near"))
    near = near_misses(known).withColumn("near", F.lit(True)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("_k")
    no = no.unionByName(near)
    return yes.unionByName(no.withColumn("family", F.lit(UNKNOWN)))


@dataclass(frozen=True)
class Classifier:
    counts: CountVectorizerModel
    model: LogisticRegressionModel
    families: list[str]
    threshold: float
    known: DataFrame


def fit(docs: DataFrame, text_col: str = "text", weight: float = 4000, false_share: float = 0.001) -> Classifier:
    """``weight``: what the corpus lines with a run of a template, and those without, weigh in all, a made row being 1."""
    spark = docs.sparkSession
    known = templates(spark)
    said = known.select("words").unionByName(near_misses(known).filter("NOT aside").select("words"))
    vocabulary = [r["t"] for r in said.select(F.explode(features(F.col("words"))).alias("t")).distinct().orderBy("t").collect()]
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="tokens", outputCol="features")
    counts = counts.setBinary(True)
    families = [UNKNOWN, *TEMPLATES]
    texts = docs.select(docs[f"`{text_col}`"].alias("text")).filter("text IS NOT NULL")
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    made = made_rows(known).select(label.cast("double").alias("label"), features(F.col("words")).alias("tokens"), runs(F.col("words"), 3).alias("has"), "aside", "near")
    lines = corpus_lines(texts, known, vocabulary, weight).withColumn("label", F.lit(0.0))
    rows = materialize(made.withColumn("weight", F.lit(1.0)).unionByName(lines), "licence-rows")
    rows = counts.transform(rows.coalesce(max(1, -(-rows.count() // ROWS_PER_PART))))
    lr = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=50, standardization=False, weightCol="weight")
    model = lr.fit(rows.filter("NOT aside"))
    # A near miss counts for the families with which the overlap would confirm it, any other row for all.
    of = F.array(*[F.array(*[F.array(*map(F.lit, r["runs"])) for r in known.filter(F.col("family") == f).collect()]) for f in families[1:]])
    p = F.slice(vector_to_array("probability"), F.lit(2), F.lit(len(TEMPLATES)))
    could = F.zip_with("p", of, lambda x, ts: F.when(~F.col("near") | F.exists(ts, lambda t: share(F.col("has"), t) >= OVERLAP), x).otherwise(0.0))
    put_aside = settled(model.transform(rows.filter("aside")).select("near", "has", "weight", "probability"), p=p)
    # Rounded up to a millionth, and counted by thousandths of a row: as many values as there are millionths at most.
    put_aside = put_aside.select("near", (F.ceil(F.array_max(could) * 1e6) / 1e6).alias("p"), F.greatest(F.round(F.col("weight") * 1000), F.lit(1)).cast("long").alias("n"))
    at = put_aside.groupBy("near").agg(F.percentile("p", F.lit(1 - false_share), F.col("n")).alias("t")).collect()  # two rows
    return Classifier(counts, model, families, max(0.5, *[r["t"] for r in at]), known)


def share(has: Column, of: Column) -> Column:
    return F.size(F.array_intersect(has, of)) / F.greatest(F.size(of), F.lit(1))


def hints(known: DataFrame) -> list[str]:
    """Words or runs of words of which every run of three words of a template holds one.

    A run with a word of ``TELLING`` letters or more is told by its longest word, any other by itself.
    """
    rows = known.select(F.explode("runs").alias("run")).distinct().orderBy("run").collect()
    left, chosen = [r["run"].split(" ") for r in rows], []
    for word in sorted({w for run in left for w in run if len(w) >= TELLING}, key=lambda w: (-len(w), w)):
        if any(word in run for run in left):
            chosen.append(word)
            left = [run for run in left if word not in run]
    return chosen + [" ".join(run) for run in left]


def may_hold(text: Column, said: list[str]) -> Column:
    """Whether a whole text has one of the hints anywhere; without one, no run of a template can begin in it."""
    by_letter: dict[str, list[str]] = {}
    for hint in said:
        parts = [re.escape(word) for word in hint.split(" ")]
        parts[0] = re.escape(hint.split(" ")[0][1:])
        by_letter.setdefault(hint[0], []).append(r"[^\p{L}\p{N}]++".join(parts))
    first = "|".join(f"{re.escape(letter)}(?:{'|'.join(rest)})" for letter, rest in sorted(by_letter.items()))
    return F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{first})(?![\p{{L}}\p{{N}}])")


def candidates(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, hinted: bool = True) -> DataFrame:
    """(doc_id, line, own, prev, nxt, bsd_2): the lines where a run of a template begins, also one that ends on a later line.

    ``own`` has the line's words, ``prev`` those of the line before and ``nxt`` those of the lines
    behind it, both only as far as the paragraph goes and a notice can reach. Texts and lines
    without a hint are left early, which changes nothing (``hinted=False`` tells).
    """
    said = hints(known)
    told = known.select(F.explode("runs").alias("run")).agg(F.collect_set("run").alias("told"))
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    rows = rows.filter(may_hold(F.col("text"), said)) if hinted else rows
    rows = settled(rows, all=F.transform(F.split("text", "\n", -1), words)).filter("all IS NOT NULL")
    rows = rows.crossJoin(F.broadcast(told))  # a single row of templates

    def begins(i: Column) -> Column:
        here = F.concat(F.get("all", i), F.slice(F.flatten(F.slice("all", i + 2, F.lit(2))), 1, 2))
        begun = F.arrays_overlap(runs(here, 3), "told")
        some = F.array(*map(F.lit, sorted({hint.split(" ")[0] for hint in said})))  # a word of each hint
        return F.when(F.arrays_overlap(here, some), begun).otherwise(False) if hinted else begun

    def around(i: Column) -> Column:
        behind = F.slice("all", i + 2, F.lit(LONGEST))
        blank = F.array_position(F.transform(behind, F.size), F.lit(0)).cast("int")
        nxt = F.when(blank > 0, F.slice(behind, F.lit(1), blank - 1)).otherwise(behind)
        prev = F.when(i > 0, F.get("all", i - 1)).otherwise(F.array().cast("array<string>"))
        return F.struct(i.alias("line"), F.get("all", i).alias("own"), prev.alias("prev"), nxt.alias("nxt"))

    lines = F.filter(F.sequence(F.lit(0), F.size("all") - 1), begins)
    rows = settled(rows, lines=lines).filter(F.size("lines") > 0)
    rows = settled(rows, at=F.transform("lines", around), bsd_2=F.col("text").rlike(BSD_BINARY) & ~F.col("text").rlike(BSD_THIRD))
    return rows.select("doc_id", "bsd_2", F.explode("at").alias("at")).select("doc_id", "bsd_2", "at.*")


def wrapped(rows: DataFrame, of_family: DataFrame, overlap: float) -> DataFrame:
    """(doc_id, line, bsd_2, words, of): stretches of words, from a line on over later ones of its paragraph, that look like family ``of``."""
    rows = rows.crossJoin(F.broadcast(of_family))  # as many rows as families
    rest = F.slice(F.flatten("nxt"), 1, LONGEST)
    rows = settled(rows, rest=rest, every=F.concat("own", rest), alone=runs(F.col("own"), 3))
    rows = settled(rows, window=runs(F.col("every"), 3))
    best = F.array_max(F.transform("templates", lambda t, k: F.struct(share(F.col("window"), t).alias("share"), k.alias("k"))))
    rows = settled(rows, best=best, whole=F.exists("templates", lambda t: share(F.col("alone"), t) >= overlap))
    rows = rows.filter((F.col("best.share") >= overlap) & ~F.col("whole"))
    rows = settled(rows, t=F.get("templates", F.col("best.k")))
    begun = F.array_intersect(runs(F.concat("own", F.slice("rest", 1, 2)), 3), "t")
    before = F.array_intersect(runs(F.concat("prev", F.slice("every", 1, 2)), 3), "t")
    first = (F.size(F.array_except(begun, runs(F.col("rest"), 3))) > 0) & ((F.size("prev") == 0) | (F.size(F.array_except(before, "window")) == 0))
    rows = rows.filter(first & ~F.exists("nxt", lambda w: share(runs(w, 3), F.col("t")) >= overlap))
    places = F.filter(F.sequence(F.lit(1), F.size("every") - 2), lambda i: F.array_contains("t", F.array_join(F.slice("every", i, F.lit(3)), " ")))
    rows = settled(rows, places=places)
    stretch = F.slice("every", F.array_min("places"), F.array_max("places") - F.array_min("places") + 3)
    return rows.select("doc_id", "line", "bsd_2", stretch.alias("words"), F.col("family").alias("of"))


def notices(docs: DataFrame, how: Classifier, id_col: str = "doc_id", text_col: str = "text", overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, line, family, probability, overlap) of every confirmed notice."""
    rows = materialize(candidates(docs, how.known, id_col, text_col), "licence-candidates")  # two ways below
    of_family = how.known.groupBy("family").agg(F.collect_list("runs").alias("templates"))  # as many rows as families
    single = rows.select("doc_id", "line", "bsd_2", F.col("own").alias("words"), F.lit(None).cast("string").alias("of"))
    rows = single.unionByName(wrapped(rows, of_family, overlap))
    scored = how.model.transform(how.counts.transform(settled(rows, tokens=features(F.col("words")))))
    p = F.slice(vector_to_array("probability"), F.lit(2), F.lit(len(how.families) - 1))
    scored = settled(scored.select("doc_id", "line", "bsd_2", "words", "of", "probability"), p=p).drop("probability")
    scored = scored.withColumn("probability", F.array_max("p")).filter(F.col("probability") >= how.threshold)
    family = F.element_at(F.array(*map(F.lit, how.families[1:])), F.array_position("p", F.col("probability")).cast("int"))
    said = scored.select("doc_id", "line", "bsd_2", "of", family.alias("family"), "probability", runs(F.col("words"), 3).alias("has"))
    said = said.filter(F.col("of").isNull() | (F.col("of") == F.col("family")))
    best = said.join(F.broadcast(of_family), "family")
    best = best.withColumn("overlap", F.array_max(F.transform("templates", lambda t: share(F.col("has"), t))))
    named = F.array_contains("has", "bsd 3-clause license")
    best = best.filter(~((F.col("family") == "bsd-3-clause") & F.col("bsd_2") & ~named))
    return best.filter(F.col("overlap") >= overlap).select("doc_id", "line", "family", "probability", "overlap")

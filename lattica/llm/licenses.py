"""Licence scans: a trained paragraph classifier, an unknown class, and comparison with templates.

Every line of a text is read as a paragraph, and neighbouring lines that are accepted are one notice. Word uni-,
bi- and trigrams, in buckets that each belong to one of the examples' n-grams, feed a sparse multinomial logistic regression over licence families, other licences
("unknown") and ordinary prose. It is trained on the wordings below: notices and pieces of them, the same notices
with other names in place of what tells their family (unknown), and prose, some of it about licences. A third of
the prose and the notices' pieces at other places are set aside and calibrate the licence probability from which a line is accepted; the texts that are
scanned take no part in the training, so a text's result depends on nothing else. A notice whose likeliest family
has a template that confirms it gets the family; any other accepted notice is unknown.
DataFrame functions and the JVM's learners alone; no shuffle carries a text.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: families and wordings of their usual notices
TEMPLATES = {
    "all-rights-reserved": ["All rights reserved.", "Copyright the authors. All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD License.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU GPL v3.",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
    "public-domain": ["This work is dedicated to the public domain.", "Released under CC0 1.0 Universal."],
}
PROSE, UNKNOWN = "none", "unknown"
# fixed values: names that stand for licences of no family, and wordings that belong to none
NAMES = ["Example", "Harbor", "Meridian", "Foo", "Orchid", "Community", "Vendor", "Granite", "Tundra", "Acme"]
OTHERS = [
    "Licensed under the Artistic License 2.0.", "Released under the Unlicense.", "Distributed under the terms of the ISC License.",
    "This file is licensed under the Eclipse Public License, version 2.0.", "Use of this source code is governed by a license that can be found in the LICENSE file.",
    "This software is provided under a commercial license.", "See the license file for the terms of use.", "Licensed under the European Union Public Licence, version 1.2.",
    "Permission to use, copy, modify and distribute this software for any purpose with or without fee is hereby granted",
]
SENTENCES = [
    "The driver lost his license on the way home.", "All of the rights of way were closed for the winter.", "Copyright law is a subject with a long history.",
    "The village pond is open to the public and free of charge.", "She was granted permission to leave the room.", "The work of the year was done by the end of March.",
    "A version of the story appeared in the local paper.", "The following conditions were cold and wet, with little sun.", "He released the bird under the old oak.",
    "The sources of the river are in the hills to the north.", "In general the public was pleased with the play.", "The common room is reserved for members and their guests.",
    "This is a list of the people who came to dinner.", "The two forms of the word differ in one letter.", "Please see the notes at the end of the chapter.",
    "It was hereby clear to all that the plan would not work.", "The library has many books and a quiet garden.", "With or without rain the market opens at nine.",
    "The software on his machine was old and slow.", "The state of the art changes from year to year.", "An attribution of the painting to her is in doubt.",
    "The commons were fenced in by the new owner of the land.", "You may not use the lift in case of fire.", "Terms of trade got worse for the farmers.", "The license plate of the car was hidden by mud.",
    "The source of the code was a book of puzzles.", "No rights were harmed, said the lawyer, and all laughed.", "The domain of the function is the set of real numbers.", "He read the file to the end and put it away.",
    "Creative work takes time and a common purpose.",
]
BUCKETS = 1 << 15
#: The least share of a template's distinct words that a confirmed notice holds.
CONFIRM = 0.75
#: What a sentence of prose counts beside a notice.
PROSE_WEIGHT = 6.0
#: Words of a piece of a notice that is trained on, and the places between pieces.
PIECE, STEP = 8, 4
_CLASSES = [PROSE, UNKNOWN, *TEMPLATES]


def words(text: Column) -> Column:
    """The words of a paragraph: letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]++"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grams(words_: Column) -> Column:
    """Hashes of the distinct uni-, bi- and trigrams."""
    rest = lambda a, k: F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0)))

    def grams(w: Column, two: Column) -> Column:
        # two holds a null for the last word, as zip_with fills up the shorter side
        three = F.zip_with(two, rest(w, 2), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(F.lit(3), a, b)))
        every = F.concat(F.transform(w, lambda x: F.xxhash64(x)), two, three)
        return F.array_distinct(F.filter(every, lambda x: x.isNotNull()))

    return _let(words_, lambda w: _let(F.zip_with(w, rest(w, 1), lambda a, b: F.when(b.isNotNull(), F.xxhash64(F.lit(2), a, b))), lambda two: grams(w, two)))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, paragraph, w) for each line of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, r"\R")).alias("paragraph", "line"))
    return lines.select("doc_id", "text_key", "paragraph", words(F.col("line")).alias("w"))


def _bag(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def _pieces(w: list[str], shift: int = 0) -> list[list[str]]:
    """Runs of a notice, its end among them: what a line of a wrapped notice may hold."""
    if len(w) <= PIECE:
        return []
    return [*[w[k : k + PIECE] for k in range(shift, len(w) - PIECE + 1, STEP)], w[-PIECE - shift :]]


def examples() -> list[tuple[str, list[str], bool]]:
    """(class, words, whether set aside to calibrate) of all examples: a third of the prose, and pieces at other places."""
    own = {f: {x for t in texts for x in _bag(t)} for f, texts in TEMPLATES.items()}
    telling = {f: {x for x in bag if sum(x in o for o in own.values()) == 1} for f, bag in own.items()}
    out = []

    def add(family: str, w: list[str]) -> None:
        out.append((family, w, False))
        out.extend((family, p, False) for p in _pieces(w))
        out.extend((family, p, True) for p in _pieces(w, STEP // 2))

    for family, texts in TEMPLATES.items():
        for t in texts:
            w = _bag(t)
            add(family, w)
            if len(w) <= 2 * PIECE and set(w) & telling[family] and family not in ("all-rights-reserved", "public-domain"):
                for name in NAMES:
                    add(UNKNOWN, [name.lower() if x in telling[family] else x for x in w])
    for t in OTHERS:
        add(UNKNOWN, _bag(t))
    for k, t in enumerate(SENTENCES):
        out.append((PROSE, _bag(t), k % 3 == 0))
    return out


def _similarity(w: Column, texts: list[str]) -> Column:
    """The largest share of a template's distinct words that w holds."""
    shares = [F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in b]))) / float(len(b)) for b in (sorted(set(_bag(t))) for t in texts)]
    return reduce(F.greatest, shares) if len(shares) > 1 else shares[0]


def _confirmed(w: Column, family: Column) -> Column:
    out = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        out = F.when(family == name, _similarity(w, texts)).otherwise(out)
    return out


def _constant(x, kind: str = "double") -> Column:
    """Numbers as one array, which the optimizer folds into a literal."""
    return F.split(F.lit(",".join(f"{v:.9g}" if kind == "double" else str(v) for v in x)), ",").cast(f"array<{kind}>")


def _summed(grams: Column, values: Column, start: float) -> Column:
    return F.aggregate(grams, F.lit(start), lambda acc, k: acc + F.get(values, k))


class LicenceModel:
    """Weights (classes, buckets) and intercepts of the regression, and the probability from which a line is accepted.

    table holds the hash of the n-gram that owns each bucket (0: none); other n-grams count for nothing.
    """

    def __init__(self, table: list[int], weights: np.ndarray, intercepts: np.ndarray, threshold: float = 0.5):
        self.table = table
        # differences to prose, whose logit is then zero
        self.weights, self.intercepts, self.threshold = weights - weights[:1], intercepts - intercepts[0], threshold

    def features(self, w: Column) -> Column:
        """Buckets of the known n-grams of words w."""
        own = _constant(self.table, "bigint")
        return F.transform(F.filter(_grams(w), lambda h: F.get(own, _bucket(h)) == h), _bucket)

    def probabilities(self, w: Column, every: bool = False) -> Column:
        """The classes' probabilities of words w, in the order of _CLASSES.

        Null, unless every row is asked for, where the threshold is out of reach: the odds of a licence are those
        without n-grams times the exponential of the sum of every n-gram's largest weight, at most.
        """
        least = math.log(max(self.threshold, 1e-9) / max(1 - self.threshold, 1e-9) / np.exp(self.intercepts[1:]).sum()) - 1e-6
        top = _constant(self.weights[1:].max(0))
        total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y)

        def told(grams: Column) -> Column:
            odds = F.array(F.lit(1.0), *[F.exp(_summed(grams, _constant(w), float(b))) for w, b in zip(self.weights[1:], self.intercepts[1:])])
            p = _let(odds, lambda e: _let(total(e), lambda t: F.transform(e, lambda x: x / t)))
            return p if every else F.when(_summed(grams, top, 0.0) >= least, p)

        return _let(self.features(w), told)


def fit(spark: SparkSession) -> LicenceModel:
    """Trains on the examples and calibrates on those set aside.

    The threshold is the licence probability that errs least on the examples set aside, in the middle of the
    gap between them where there is one.
    """
    rows = [(float(_CLASSES.index(c)), w, aside) for c, w, aside in examples()]
    every = spark.createDataFrame(rows, "label double, w array<string>, aside boolean").coalesce(1).select("label", "aside", _grams(F.col("w")).alias("grams")).collect()
    table = [0] * BUCKETS
    for r in every:
        for h in r.grams if not r.aside else ():
            if not table[h % BUCKETS]:
                table[h % BUCKETS] = h
    known = lambda r: sorted(h % BUCKETS for h in r.grams if table[h % BUCKETS] == h)
    vectors = [(r.label, PROSE_WEIGHT if r.label == 0 else 1.0, Vectors.sparse(BUCKETS, known(r), [1.0] * len(known(r)))) for r in every if not r.aside]
    learner = LogisticRegression(maxIter=60, regParam=1e-3, elasticNetParam=0.0, family="multinomial", standardization=False, weightCol="weight")
    fitted = learner.fit(spark.createDataFrame(vectors, ["label", "weight", "features"]).coalesce(1))
    model = LicenceModel(table, fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray())
    held = []
    for r in every:
        if r.aside:
            e = np.exp(np.concatenate([[0.0], model.weights[1:][:, known(r)].sum(1) + model.intercepts[1:]]))
            held.append((1 - e[0] / e.sum(), r.label > 0))
    held.sort()
    marks = [0.0, *[p for p, _ in held], 1.0]
    errors = lambda x: sum((p >= x) != y for p, y in held)
    model.threshold = float(min(((errors((a + b) / 2), a - b, (a + b) / 2) for a, b in zip(marks, marks[1:])))[2])
    return model


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Licence notices of docs: doc_id, text_key, paragraph (its first line from 0), lines, family, probability, similarity.

    A notice is a run of accepted lines of one likeliest class. family is unknown where no template of the likeliest
    family confirms it. Null and empty texts have none; other columns are ignored; rows of one id and text, of which
    text_key is a hash, are scanned as one.
    """
    # one evaluation tells a line's words and probabilities, and keeps it or not
    read = _let(F.col("w"), lambda w: F.struct(w.alias("w"), model.probabilities(w).alias("p")))
    kept = F.filter(F.array(read), lambda x: x["p"].isNotNull() & (F.get(x["p"], F.lit(0)) <= 1 - model.threshold))
    p = paragraphs(docs).select("doc_id", "text_key", "paragraph", F.inline(kept))
    best = F.array_max(F.slice("p", 2, len(_CLASSES)))
    likeliest = F.get(F.array(*[F.lit(x) for x in _CLASSES]), F.array_position(F.slice("p", 2, len(_CLASSES)), best).cast("int"))
    lines = p.select("doc_id", "text_key", F.struct("paragraph", likeliest.alias("likeliest"), (1 - F.get("p", F.lit(0))).alias("probability"), "w").alias("line"))
    held = lines.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    # a line starts a notice unless the line before it is of the same class
    starts = F.filter("lines", lambda x, i: ~F.coalesce((F.get("lines", i - 1)["paragraph"] == x["paragraph"] - 1) & (F.get("lines", i - 1)["likeliest"] == x["likeliest"]), F.lit(False)))
    runs = held.select("doc_id", "text_key", "lines", F.posexplode(starts).alias("at", "start"), F.transform(starts, lambda x: x["paragraph"]).alias("heads"))
    until = F.coalesce(F.get("heads", F.col("at") + 1), F.lit(2147483647))
    own = F.filter("lines", lambda x: (x["paragraph"] >= F.col("start")["paragraph"]) & (x["paragraph"] < until))
    notices = runs.select("doc_id", "text_key", F.col("start.paragraph").alias("paragraph"), F.col("start.likeliest").alias("likeliest"), own.alias("own"))
    notices = notices.select(
        "doc_id", "text_key", "paragraph", "likeliest", F.size("own").alias("lines"), F.array_max(F.transform("own", lambda x: x["probability"])).alias("probability"),
        F.flatten(F.transform("own", lambda x: x["w"])).alias("w"),
    ).withColumn("similarity", _confirmed(F.col("w"), F.col("likeliest")))
    family = F.when(F.col("similarity") >= CONFIRM, F.col("likeliest")).otherwise(F.lit(UNKNOWN))
    return notices.select("doc_id", "text_key", "paragraph", "lines", family.alias("family"), "probability", "similarity")


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_paragraphs (notices), n_unknown, families (sorted, comma-joined, without unknown).

    Repeated rows repeat their result, a null id keeps its text's; no rows give no rows.
    """
    found = scan(docs, fit(docs.sparkSession)).groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).agg(
        F.count("*").alias("n_paragraphs"), F.sum((F.col("family") == UNKNOWN).cast("long")).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))), ",").alias("families"),
    )
    ids = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_key"))
    out = ids.join(found, ids["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("n_paragraphs", zero).alias("n_paragraphs"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))

"""Licence scans with a trained paragraph classifier (operator 9), in DataFrame functions and Spark ML only.

Paragraphs end at blank lines; lines within one are joined, and windows of WINDOW words, half a window apart, go over it. A
window becomes sparse word n-grams of the training texts; a multinomial logistic regression, trained on notices of each
family, on texts that aren't notices and on all windows of the documents that are to be classified and hold no notice, bare
and with a notice put in, gives the families' probabilities. `unknown` is one of its classes, and a family counts only above
what a third of those windows, kept aside for it, reach. A prediction is confirmed by the share of a notice's word pairs that
the window holds.

All windows of all documents are classified. Windows with a cue, a word of any training notice that is rare in the windows of
all documents, are learned from first; of the others, which are many, the model then learns from those that it takes for a
notice, and is calibrated on all of a third. Cues choose neither what is classified nor what is named, only which paragraphs
without a likely family are listed as unknown.

Words that no training text has count for nothing, so that windows are stored without them once and read for each step.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources.shared import materialise, release

UNKNOWN = "unknown"
CONFIRMED = 0.5
WINDOW = 48  # words
#: What the documents' windows weigh together, bare and with a notice in them, when they are many (a notice in one of its
#: surroundings weighs 1).
BARE, FILLED = 400, 360
FEW, RARE = 3, 0.005  # a cue is in at most so many of the documents' windows, or in this share of them
LIKELY = 0.1  # a window without a cue is learned from if the first model gives a family this chance
LEAST, MOST, MARGIN = 0.25, 0.9, 0.02  # bounds of the threshold, and how far it lies above what windows without a notice reach
#: Notices, by family; the first words of the long texts and the short forms that stand for them.
TEMPLATES = {
    "apache-2.0": ["Apache-2.0", "Apache License 2.0", "Lizenziert unter der Apache-Lizenz, Version 2.0.", "Sous licence Apache, version 2.0.", "Bajo la licencia Apache, versión 2.0.", 
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied.",
    ],
    "mit": ["MIT License", "Lizenziert unter der MIT-Lizenz.", "Distribué sous licence MIT.", "Publicado bajo la licencia MIT.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.", 
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    ],
    "gpl": ["GPLv3", "GPLv2 or later", "Distributed under GPLv3.", "GPL-3.0", "Sous licence GPL version 3.", "Bajo la licencia pública general GNU versión 3.", "Unter der GNU General Public License Version 3 veröffentlicht.", 
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under the GPL version 2 or later.",
        "Distributed under the GNU General Public License.",
        "You can redistribute this under the terms of the GNU General Public License.",
    ],
    "lgpl": ["LGPLv3", "LGPL-2.1", 
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "agpl": ["AGPLv3", "AGPL-3.0", 
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "bsd": ["BSD-3-Clause", "BSD License", 
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "mpl": ["MPL-2.0", "Mozilla Public License 2.0", 
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."],
    "cc0": ["CC0", "CC0 1.0 Universal", "Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal public domain dedication."],
    "proprietary": ["All rights reserved.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Tous droits réservés.", "Copyright, all rights reserved. No part may be reproduced without written permission.", "Proprietary and confidential. Unauthorised copying is prohibited; all rights reserved."],
}
#: Texts in which words of notices mean something else.
OTHER = [
    "She lost her driver's license on the way to the city.",
    "The licence plate of the car could not be read.",
    "He asked for permission to leave the room early.",
    "The warranty on the phone ends after two years.",
    "A fishing license costs ten dollars at the counter.",
    "The court spoke about copyright in books of the last century.",
    "They were licensed to sell food at the market.",
    "A poetic licence was taken with the dates in this story.",
    "Money was redistributed to the poor by the king.",
    "Without a warrant the police may not enter the house.",
    "The park is in the public domain of the town.",
    "Please read the license before you install the program.",
]
#: What stands before and after a notice in the training set.
AROUND = ["{}", "Some words before. {}", "{} And more text after it.", "Copyright 2020 the authors. {}", "Notice: {} See the file for details.", "The text of the page goes on here. {} It ends here."]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))


def pairs(found: Column) -> Column:
    """Word pairs; of fewer than two words these themselves."""
    return F.when(F.size(found) > 1, F.transform(F.sequence(F.lit(0), F.size(found) - 2), lambda i: F.concat_ws(" ", found[i], found[i + 1]))).otherwise(found)


def with_ngrams(rows: DataFrame) -> DataFrame:
    """Adds `pairs` and `ngrams` (words and pairs of them) of `words`."""
    return rows.withColumn("pairs", pairs(F.col("words"))).withColumn("ngrams", F.array_union("words", "pairs"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, t_, paragraph_no, all_): the words of each paragraph; t_ is a hash of the whole text."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t_"), F.posexplode(F.split("text", r"\r?\n[ \t\r]*\n\s*")).alias("paragraph_no", "paragraph"))
    return rows.select("doc_id", "t_", "paragraph_no", words(F.col("paragraph")).alias("all_"))


#: What windowed() returns.
ROWS = ["doc_id", "t_", "paragraph_no", "single", "words", "ngrams"]


def known_words(spark: SparkSession) -> list[str]:
    """The words of all training texts, sorted."""
    texts = [n for own in TEMPLATES.values() for n in own] + [a.format("") for a in AROUND] + OTHER
    return sorted({x for w in _split(spark, texts) for x in w})


def windowed(docs: DataFrame, known: list[str]) -> DataFrame:
    """ROWS of all windows of all paragraphs with a word: words, those that aren't known empty, and ngrams (words and pairs of
    them, each once) without these; single tells windows of one word."""
    joined = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit(" "), b)).otherwise("")
    rows = paragraphs(docs).withColumn("all_", F.transform("all_", lambda w: F.when(w.isin(known), w).otherwise("")))
    rows = rows.withColumn("two_", F.zip_with("all_", F.slice("all_", F.lit(2), F.size("all_")), joined))  # the last is empty
    last = F.greatest(F.lit(0), F.ceil((F.size("all_") - WINDOW) / (WINDOW // 2)).cast("int"))
    begin = lambda i: i * (WINDOW // 2) + 1
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.slice("all_", begin(i), F.lit(WINDOW)).alias("words"), F.slice("two_", begin(i), F.lit(WINDOW - 1)).alias("two")))
    rows = rows.select("doc_id", "t_", "paragraph_no", F.explode(F.when(F.size("all_") > 0, each)).alias("w"))
    ngrams = F.array_distinct(F.array_remove(F.concat("w.words", "w.two"), ""))
    return rows.select("doc_id", "t_", "paragraph_no", (F.size("w.words") < 2).alias("single"), "w.words", ngrams.alias("ngrams"))


def any_of(ngrams: str, wanted: list[str]) -> Column:
    return F.exists(ngrams, lambda g: g.isin(wanted))


def holds(ngrams: Column, notices: list[list[str]], share: float) -> Column:
    """Whether a window (its ngrams) has this share of the pairs of one of the notices (their words); of one word, that word."""
    own = F.array(*(F.array(*map(F.lit, sorted({f"{a} {b}" for a, b in zip(w, w[1:])} or set(w)))) for w in notices))
    return F.exists(own, lambda n: F.size(F.array_intersect(ngrams, n)) >= share * F.size(n))


def window_counts(docs: DataFrame, notices: list[list[str]]) -> tuple[dict[str, int], int]:
    """In how many windows of all documents each word of the notices is (none: absent), and how many windows there are.

    A window with a whole notice is no example of how words are used without one, and isn't counted.
    """
    return _window_counts(windowed(docs, sorted({x for w in notices for x in w})), notices)


def _window_counts(rows: DataFrame, notices: list[list[str]]) -> tuple[dict[str, int], int]:
    known = sorted({x for w in notices for x in w})
    noted = any_of("ngrams", sorted({max(w, key=len) for w in notices})) & holds(F.col("ngrams"), notices, 1.0)  # each notice has one of these words, most windows none
    each = F.array_append(F.filter("ngrams", lambda g: g.isin(known)), "")  # "" for the window itself
    counted = rows.where(~noted).select(F.explode(each).alias("word")).groupBy("word").count()
    found = {r.word: r["count"] for r in counted.collect()}  # at most a row a word asked for
    return found, found.pop("", 0)


def _split(spark: SparkSession, texts: list[str]) -> list[list[str]]:
    return [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", words(F.col("t")).alias("w")).orderBy("i").collect()]


def dealt() -> Column:
    """A hash of a window of ROWS; windows where it is 0 modulo 3 are kept aside."""
    return F.xxhash64("doc_id", "t_", "paragraph_no", F.concat_ws(" ", "words"))


def examples(docs: DataFrame, cues: list[str], notices: list[tuple[int, list[str]]]) -> DataFrame:
    """(label, words, part, own): all windows of docs with a cue and less than half of any notice, bare, labelled unknown, and
    with one of the notices (label, words) put in their middle. `part` deals bare windows: two to learn from, the third (9) to
    calibrate; `own` tells them from filled ones.
    """
    return _examples(windowed(docs, sorted({*cues, *(x for _, w in notices for x in w)})), cues, notices)


def _examples(rows: DataFrame, cues: list[str], notices: list[tuple[int, list[str]]]) -> DataFrame:
    rows = rows.where(any_of("ngrams", cues)).where(~holds(F.col("ngrams"), [w for _, w in notices], CONFIRMED)).withColumn("h", dealt())
    given = F.element_at(F.array(*(F.struct(F.lit(float(k)).alias("label"), F.array(*map(F.lit, w)).alias("notice")) for k, w in notices)), (F.pmod(F.shiftright("h", 8), F.lit(len(notices))) + 1).cast("int"))
    bare = F.struct(F.lit(0.0).alias("label"), F.col("words").alias("words"), F.when(F.pmod("h", F.lit(3)) == 0, 9).otherwise(0).alias("part"), F.lit(True).alias("own"))
    half = F.concat(F.slice("words", 1, 20), given["notice"], F.slice("words", 21, 20))
    filled = F.struct(given["label"].alias("label"), half.alias("words"), F.lit(0).alias("part"), F.lit(False).alias("own"))
    return rows.select(F.explode(F.array(bare, filled)).alias("e")).select("e.*")


def with_chances(rows: DataFrame, model: PipelineModel, families: list[str]) -> DataFrame:
    """Adds `chances`, those of the families but unknown, and `best`, the highest."""
    found = model.transform(rows).withColumn("chances", F.slice(vector_to_array("probability"), 2, len(families) - 1))
    return found.select(*rows.columns, "chances", F.array_max("chances").alias("best"))


def train(docs: DataFrame) -> tuple[PipelineModel, float, list[str], list[str]]:
    """(model, threshold, families, cues) from docs, or from the ROWS of their windows. Fitted on the notices in all surroundings
    but the last, all cued windows, and those of the others that a first fit takes for likely; calibrated on all windows kept
    aside. The driver sees counts and the model only."""
    spark = docs.sparkSession
    rows = docs if docs.columns == ROWS else materialise(windowed(docs, known_words(spark)), "windows")
    families = [UNKNOWN, *sorted(TEMPLATES)]
    notices = [(f, n) for f, own in TEMPLATES.items() for n in own]
    split = _split(spark, [n for _, n in notices])
    seen, total = _window_counts(rows, split)
    cues = {word for found in split for word in found if len(word) > 1 and not word.isdigit() and seen.get(word, 0) <= max(FEW, RARE * total)}
    for found in split:
        if not cues & set(found):
            cues.add(min(found, key=lambda x: (seen.get(x, 0), -len(x), x)))
    cues = sorted(cues)
    texts = [(around.format(n), float(families.index(f)), k) for f, n in notices for k, around in enumerate(AROUND)]
    texts += [(around.format(text), 0.0, 0 if n % 4 else 9) for n, text in enumerate(OTHER) for around in AROUND[:3]]
    fixed = spark.createDataFrame(texts, "paragraph string, label double, part int").coalesce(1).select("label", words(F.col("paragraph")).alias("words"), "part", F.lit(None).cast("boolean").alias("own"))
    vocabulary = CountVectorizer(inputCol="ngrams", outputCol="features", binary=True, minDF=1.0).fit(with_ngrams(fixed.where("part < 5")))
    drawn = materialise(_examples(rows, cues, [(families.index(f), w) for (f, _), w in zip(notices, split)]), "examples")
    many = {r.own: r["count"] for r in drawn.where("part < 5").groupBy("own").count().collect()}
    weight = F.when(F.col("own"), min(1.0, BARE / max(1, many.get(True, 0)))).when(~F.col("own"), min(1.0, FILLED / max(1, many.get(False, 0)))).otherwise(1.0)
    data = with_ngrams(fixed.unionByName(drawn).withColumn("weight", weight)).select("ngrams", "label", "weight", "part")

    def fitted(data: DataFrame) -> PipelineModel:
        estimator = LogisticRegression(maxIter=40, regParam=0.0003, family="multinomial", standardization=False, weightCol="weight")
        return PipelineModel([vocabulary, estimator.fit(vocabulary.transform(data).select("features", "label", "weight").coalesce(max(1, spark.sparkContext.defaultParallelism)))])

    # windows without a cue are scored all, and compared with the notices only if that matters
    others = rows.where(~any_of("ngrams", cues)).select("ngrams", (F.pmod(dealt(), F.lit(3)) == 0).alias("aside"))
    bare = ~holds(F.col("ngrams"), split, CONFIRMED)
    model = fitted(data.where("part < 5"))
    likely = materialise(with_chances(others.where("not aside"), model, families).where(F.col("best") >= LIKELY).where(bare).select("ngrams"), "likely")
    if count := likely.count():
        more = likely.select("ngrams", F.lit(0.0).alias("label"), F.lit(min(1.0, BARE / count)).alias("weight"))
        model = fitted(data.where("part < 5").select("ngrams", "label", "weight").unionByName(more))
    aside = with_chances(data.where("part = 9").select("ngrams"), model, families).unionByName(with_chances(others.where("aside").select("ngrams"), model, families).where(F.col("best") > LEAST - MARGIN).where(bare))
    highest = aside.agg(F.max("best")).first()[0] or 0.0
    for used in (drawn, likely, *([rows] if rows is not docs else [])):
        release(used)
    return model, min(MOST, max(LEAST, highest + MARGIN)), families, cues


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, family, probability, similarity, confirmed): each family that a window of a paragraph names.

    Every window of every paragraph is classified, and names its likeliest family if that is likely enough. Paragraphs end at
    blank lines and are numbered from 0. A paragraph with cues but no likely family has one row, `unknown`; one with neither has
    none. similarity is the largest share of a family's notice's word pairs that a window holds, 0 for unknown ones. Null and
    empty texts have no paragraphs; rows that agree in doc_id and text give the same rows once, a null doc_id stays null, other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialise(windowed(docs, known_words(spark)), "windows")
    model, threshold, families, cues = train(rows)
    found = with_chances(rows.select("doc_id", "t_", "paragraph_no", "single", "ngrams"), model, families)
    found = found.where((F.col("best") >= threshold) | any_of("ngrams", cues))
    name = F.element_at(F.array(*map(F.lit, families[1:])), F.array_position("chances", F.col("best")).cast("int"))
    pairs_ = F.when(F.col("single"), F.col("ngrams")).otherwise(F.filter("ngrams", lambda g: F.contains(g, F.lit(" "))))
    found = found.withColumn("pairs", pairs_).withColumn("family", F.when(F.col("best") >= threshold, name).otherwise(UNKNOWN))
    notices = spark.createDataFrame([(f, n) for f, own in TEMPLATES.items() for n in own], "family string, paragraph string").withColumn("words", words(F.col("paragraph")))
    notices = with_ngrams(notices).groupBy("family").agg(F.collect_list("pairs").alias("notices"))  # a row a family
    joined = found.join(F.broadcast(notices), "family", "left")
    shares = F.transform("notices", lambda n: F.size(F.array_intersect("pairs", n)) / F.size(F.array_distinct(n)))
    joined = joined.withColumn("similarity", F.coalesce(F.array_max(shares), F.lit(0.0)))
    told = joined.groupBy("doc_id", "t_", "paragraph_no", "family").agg(F.max("best").alias("probability"), F.max("similarity").alias("similarity"))
    named = told.groupBy("doc_id", "t_", "paragraph_no").agg(
        F.collect_list(F.when(F.col("family") != UNKNOWN, F.struct("family", "probability", "similarity"))).alias("named"), F.max(F.when(F.col("family") == UNKNOWN, F.struct("family", "probability", "similarity"))).alias("none")
    )  # at most a row a family
    each = F.when(F.size("named") > 0, F.col("named")).otherwise(F.array("none"))
    out = named.select("doc_id", "paragraph_no", F.explode(each).alias("r"))
    out = materialise(out.select("doc_id", "paragraph_no", "r.family", "r.probability", "r.similarity", (F.col("r.similarity") >= CONFIRMED).alias("confirmed")), "licenses")
    release(rows)
    return out

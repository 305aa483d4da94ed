"""License scans: a trained paragraph classifier, in DataFrame and ML operations of Spark only.

A paragraph (line) is turned into its distinct words and word pairs. A multinomial logistic regression with sparse
weights, trained on the notices below against an unknown class of other sentences and of paragraphs of the corpus,
gives each family a probability. A paragraph is a notice if the probability that it isn't unknown exceeds a threshold,
which is calibrated on unknown paragraphs that the training didn't see: at most FALSE_SHARE of them exceed it. The
templates then confirm: the family must have a sentence that covers enough of the paragraph, or the paragraph enough
of it, and no version that the paragraph names may be foreign to the family; of several such families the most probable
is taken.

Every distinct paragraph that could pass is scored. Which could is read off the weights: NEEDED words are chosen such
that all weights of paragraphs without any of them, taken together, leave the unknown class ahead of all families. So
looking for these words first loses nothing, whatever the weights. Equal paragraphs are scored once, so a line that a
third of all texts repeat is one row.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import stored

#: Sentences of the notices of each family, in their usual wordings.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This software is released under the Apache License 2.0.",
        "Licensed under Apache 2.0.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL v3.",
        "Licensed under the GPLv3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "Released under the GPL v2.",
        "Licensed under the GPLv2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under CC-BY 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Available under CC-BY-NC for non-commercial use.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal license.",
    ],
}
#: Sentences with words of notices that are no notice of these families. Every other one is held out.
OTHERS = [
    "All rights reserved.", "Copyright protects the works of authors.", "The driver showed his license at the gate.", "She asked for permission to leave early.",
    "The warranty covers repairs for two years.", "A license to teach takes two years to get.", "The apache is a people of the southwest.", "The public domain is a rich source of stories.",
    "He is a student at MIT and works on software.", "The fishing licence costs ten pounds.", "This software is sold without a copy of the manual.", "The version of the story that you may obtain is free.",
    "Copyright 2020 by the authors.", "No part of this work may be copied without permission.", "The general asked for the public to modify the terms.", "The mozilla project and the gnu project make programs.",
    "This product is licensed to one user only and may not be shared.", "Copyright 2019 all rights reserved by the publisher.", "The licensor grants you a personal, non-transferable licence to this program.", "You may not redistribute this material without written permission.",
    "Use of this service is subject to the terms and conditions of the provider.", "This software is provided as a service without any guarantee.", "The software was distributed under a commercial license agreement.", "By opening this package you agree to the terms of the license.",
    "The authors gave notice of version 3 of the plan.", "An apache helicopter of version 2 is in the hangar.", "The creative commons room is open to the public.", "The foundation published a general report on public works.",
    "Reproduced with the kind permission of the copyright holders.", "The warranty is void where prohibited by law.", "Modification of the source and binary terms needs approval.", "Under the license of the city the market may open at 8.0.",
]
#: Bounds of the training data: paragraphs of the corpus drawn for the unknown class, of which half are held out for
#: the calibration, and features.
UNKNOWN_ROWS, FEATURES = 800, 5000
#: How many times the draw the scan lets through, since copies count once.
DRAW = 10
#: A gram in more than this share of the drawn paragraphs is no feature.
USUAL = 0.005
#: The share of unknown paragraphs that may exceed the threshold, the least threshold, the cover that confirms a
#: family, and the cover by any notice below which a paragraph of the corpus counts as unknown for the calibration.
FALSE_SHARE, LEAST, COVER, FOREIGN = 0.005, 0.8, 0.6, 0.3
UNKNOWN = "unknown"
#: Numbers of versions, alone or behind a v or the short name of the GPL.
VERSION = "^(?:v|gpl|lgpl|agpl|gplv|lgplv|agplv)?([0-9]+)(?:[.]([0-9]+))?$"


def words(paragraph: Column) -> Column:
    """Words in lower case."""
    return F.regexp_extract_all(F.lower(paragraph), F.lit("[\\p{L}\\p{N}]+(?:[.-][\\p{L}\\p{N}]+)*+"), F.lit(0))


def grams(paragraph: Column) -> Column:
    """Distinct words and word pairs in lower case."""
    w = words(paragraph)
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, pairs))


def versions(paragraph: Column) -> Column:
    """Distinct major versions that a paragraph names behind words of licensing: 3 of "v3", "version 3" and "gplv3.0"."""
    w = F.split(F.regexp_replace(F.lower(paragraph), "[^\\p{L}\\p{N}.]+", " "), " ")
    clean = F.transform(w, lambda x: F.regexp_replace(x, "[.]+$", ""))
    near = F.transform(clean, lambda x, i: F.when(x.rlike(VERSION) & (F.length(F.regexp_extract(x, VERSION, 1)) == 1), F.regexp_extract(x, VERSION, 1)))
    return F.array_distinct(F.array_compact(near))


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def notices(spark: SparkSession) -> DataFrame:
    """(family, sentence, paragraph) of the fixed sentences."""
    return literal(spark, [{"family": f, "sentence": i, "paragraph": p} for f, ps in [*NOTICES.items(), (UNKNOWN, OTHERS)] for i, p in enumerate(ps)], "family: string, sentence: int, paragraph: string")


def covers(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(pid, family, cover) of found(pid, g): the best share of a notice's grams in the paragraph's, or of the
    paragraph's in a notice's, whichever is greater; families that share no gram are left out.

    Grams count by how few families have them (ln of families + 1 over those with it), so what all notices say confirms
    none, and a gram that no notice has, such as another licence's name, counts most.
    """
    most = math.log(len(NOTICES) + 1)
    sentences = notices(spark).where(F.col("family") != UNKNOWN).select("family", "sentence", F.explode(grams(F.col("paragraph"))).alias("gram"))
    weight = sentences.groupBy("gram").agg((most - F.log(F.count_distinct("family"))).alias("wt"))
    flat = sentences.join(weight, "gram")
    flat = stored(flat.join(flat.groupBy("family", "sentence").agg(F.sum("wt").alias("ws")), ["family", "sentence"]).coalesce(1), "templates")
    mine = found.select("pid", F.size("g").alias("np"), F.explode("g").alias("gram"))
    hit = mine.join(F.broadcast(flat.groupBy("gram").agg(F.first("wt").alias("wt"), F.collect_list(F.struct("family", "sentence", "ws")).alias("in"))), "gram")  # the notices' grams
    own = hit.groupBy("pid").agg((F.first("np") * most - F.sum(most - F.col("wt"))).alias("wp"), F.flatten(F.collect_list(F.transform("in", lambda x: F.struct(x["family"].alias("family"), x["sentence"].alias("sentence"), x["ws"].alias("ws"), F.col("wt").alias("wt"))))).alias("all"))
    each = own.select("pid", "wp", F.explode("all").alias("x")).groupBy("pid", "wp", "x.family", "x.sentence", "x.ws").agg(F.sum("x.wt").alias("k"))
    return each.groupBy("pid", "family").agg(F.max(F.col("k") / F.least("ws", "wp")).alias("cover"))


class Model:
    """Weights by gram, each family's and last the unknown class's, with the biases."""

    def __init__(self, weights: dict[str, list[float]], bias: list[float]):
        self.weights, self.bias = weights, bias

    def leads(self) -> dict[str, list[float]]:
        """What each gram can add to each family over the unknown class, where that is anything."""
        n = len(self.bias) - 1
        lead = {g: [max(0.0, w[i] - w[n]) for i in range(n)] for g, w in self.weights.items()}
        return {g: x for g, x in lead.items() if max(x) > 0}

    def needed(self, common: dict[str, float]) -> list[str]:
        """Words of which a paragraph must have one for the families together to come up to the unknown class.

        Without the words, what all grams that have none of them add can't make up for the biases: the sum of exp over
        the families stays below the odds of LEAST. Any such choice is right; common, the share of paragraphs that
        have a word, is for a choice that few paragraphs meet.
        """
        lead, n = self.leads(), len(self.bias) - 1
        price = lambda w: (common.get(w, 0.0), w)
        chosen = {w for g in lead for w in g.split(" ")}

        def enough(some: set[str]) -> bool:
            rest = [self.bias[i] - self.bias[n] + sum(x[i] for g, x in lead.items() if not some.intersection(g.split(" "))) for i in range(n)]
            return sum(math.exp(min(r, 50.0)) for r in rest) < LEAST / (1 - LEAST)

        for w in sorted(chosen, key=price, reverse=True):
            if enough(chosen - {w}):
                chosen.remove(w)
        return sorted(chosen, key=price)

    def predicted(self, found: DataFrame) -> DataFrame:
        """found(pid, g) with known, the probability of not being unknown, and ps, that of each family."""
        rows = stored(literal(found.sparkSession, [{"gram": g, "w": w} for g, w in self.weights.items()], "gram: string, w: array<double>"), "weights")
        sums = found.select("pid", F.explode("g").alias("gram")).join(F.broadcast(rows), "gram").groupBy("pid").agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(self.bias))))  # FEATURES rows at most
        z = F.array(*(F.col(f"s{i}") + F.lit(b) for i, b in enumerate(self.bias)))
        top = F.array_max("z")
        e = sums.select("pid", z.alias("z")).select("pid", F.transform("z", lambda x: F.exp(x - top)).alias("e"))
        total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
        return e.select("pid", F.transform("e", lambda x: x / total).alias("ps")).select("pid", (1 - F.element_at("ps", -1)).alias("known"), "ps")


def drawn(rows: DataFrame) -> DataFrame:
    """(pid, low, g, train) of a bounded draw of distinct paragraphs of rows(text) that no notice resembles.

    The least hashes of all are drawn. Hashes above what DRAW times the draw should have are left out in the scan, so
    few rows meet, and copies of one paragraph share a hash, so they count once.
    """
    spark = rows.sparkSession
    lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    below = -(1 << 63) + int(2**64 * min(1.0, DRAW * UNKNOWN_ROWS / max(1, lines))) - 1
    keyed = rows.select(F.explode(F.split(F.lower("text"), "\n")).alias("low")).where(F.length("low") > 0).withColumn("h", F.xxhash64("low")).where(F.col("h") <= below)
    draw = keyed.groupBy("h").agg(F.first("low").alias("low")).orderBy("h").limit(UNKNOWN_ROWS)
    found = stored(draw.select(F.concat(F.lit("d"), F.col("h").cast("string")).alias("pid"), "low", grams(F.col("low")).alias("g"), (F.pmod("h", F.lit(2)) == 0).alias("train")), "draw")
    close = covers(spark, found).where(F.col("cover") >= FOREIGN).select("pid").distinct()
    return found.join(F.broadcast(close), "pid", "left_anti")


def trained(spark: SparkSession, unknown: DataFrame) -> Model:
    """unknown(g) and the notices, and of the OTHERS every second one, make the training data."""
    own = notices(spark).where((F.col("family") != UNKNOWN) | (F.col("sentence") % 2 == 0)).select("family", grams(F.col("paragraph")).alias("g"))
    rows = stored(own.unionByName(unknown.select(F.lit(UNKNOWN).alias("family"), "g")).coalesce(1), "train")
    families = [*NOTICES, UNKNOWN]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    # a gram that unknown paragraphs have now and then tells nothing, nor does a number by itself
    share = rows.where(F.col("family") == UNKNOWN).agg(F.count("*").alias("n")).first()["n"]
    usual = [r["gram"] for r in rows.where(F.col("family") == UNKNOWN).select(F.explode("g").alias("gram")).groupBy("gram").count().where(F.col("count") > max(2, USUAL * share)).limit(FEATURES).collect()]
    fit = rows.select("family", F.filter(F.array_except("g", F.array(*map(F.lit, usual)).cast("array<string>")), lambda g: g.rlike("\\p{L}{2}")).alias("g"))
    vectors = CountVectorizer(inputCol="g", outputCol="x", binary=True, vocabSize=FEATURES).fit(fit)
    model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.0005, elasticNetParam=0.5, maxIter=50, tol=1e-5, standardization=False).fit(vectors.transform(fit).select("x", number.alias("y")))
    coefficients, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = {g: [float(v) for v in coefficients[:, i]] for i, g in enumerate(vectors.vocabulary) if abs(coefficients[:, i]).max() > 1e-9}
    return Model(weights, [float(b) for b in bias])


def confirmed(spark: SparkSession, paragraphs: DataFrame, guesses: DataFrame) -> DataFrame:
    """(pid, family, p): of the families whose templates confirm a guess the most probable, ties by name.

    paragraphs(pid, g, vs) has the versions that a paragraph names. A family without versions in its notices takes any.
    """
    families = F.array(*map(F.lit, NOTICES))
    own = notices(spark).where(F.col("family") != UNKNOWN).select("family", F.explode(versions(F.col("paragraph"))).alias("v")).groupBy("family").agg(F.collect_set("v").alias("allowed"))
    found = paragraphs.join(guesses, "pid")
    both = covers(spark, found.select("pid", "g")).where(F.col("cover") >= COVER).join(F.broadcast(own), "family", "left")
    fits = both.join(found.select("pid", "vs", "known", "ps"), "pid").where(F.col("allowed").isNull() | (F.size(F.array_except("vs", "allowed")) == 0))
    p = F.element_at("ps", F.array_position(families, F.col("family")).cast("int"))
    best = fits.groupBy("pid").agg(F.min(F.struct((-p).alias("p"), "family", "known")).alias("b"))
    return best.select("pid", "b.family", F.col("b.known").alias("p"))


def threshold(unknown: DataFrame) -> float:
    """From unknown(known) the threshold that FALSE_SHARE of them exceed at most, LEAST at least."""
    got = unknown.agg(F.percentile_approx("known", 1 - FALSE_SHARE, 10_000)).first()[0]
    return max(LEAST, got if got is not None else LEAST)


def scan(docs: DataFrame, id_col: str, text_col: str) -> dict:
    """All that licenses() and its tests need: own(uid, doc_id, lines), of all rows, keyed(uid, pid), paragraphs, model,
    needed, predicted, calibration, least."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    unknown = stored(drawn(rows), "unknown")
    model = trained(spark, unknown.where("train"))
    every = sorted({w for g in model.leads() for w in g.split(" ")})
    pairs = unknown.select("low", F.explode(F.array(*map(F.lit, every)).cast("array<string>")).alias("w"))  # the draw's rows by the model's words
    shares = pairs.groupBy("w").agg(F.avg(F.col("low").contains(F.col("w")).cast("double")).alias("share")).collect()
    found = model.needed({r["w"]: r["share"] for r in shares})
    has = lambda x: reduce(lambda a, b: a | b, (x.contains(w) for w in found), F.lit(False))
    # lower case once for each text: the generated row keeps the optimizer from writing it out at each word
    low = rows.select("doc_id", F.explode(F.array(F.lower("text"))).alias("low"))
    own = stored(low.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.when(has(F.col("low")), F.filter(F.split("low", "\n"), has)).alias("lines")), "found")
    keyed = own.select("uid", F.explode("lines").alias("paragraph")).withColumn("pid", F.sha2("paragraph", 256))
    paragraphs = stored(keyed.groupBy("pid").agg(F.first("paragraph").alias("paragraph")).select("pid", grams(F.col("paragraph")).alias("g"), versions(F.col("paragraph")).alias("vs")), "paragraphs")
    predicted = stored(model.predicted(paragraphs.select("pid", "g")), "predicted")
    # unknown paragraphs for the calibration: those held out, and all of the corpus that no notice resembles
    others = notices(spark).where((F.col("family") == UNKNOWN) & (F.col("sentence") % 2 == 1)).select(F.concat(F.lit("o"), F.col("sentence").cast("string")).alias("pid"), grams(F.col("paragraph")).alias("g"))
    held = stored(unknown.where("not train").select("pid", "g").unionByName(others), "held")
    # a paragraph with no weighted gram is as unknown as can be
    held = held.join(model.predicted(held), "pid", "left").select("pid", F.coalesce("known", F.lit(0.0)).alias("known"))
    like = covers(spark, paragraphs.select("pid", "g")).groupBy("pid").agg(F.max("cover").alias("cover"))
    far = predicted.join(like.where(F.col("cover") >= FOREIGN), "pid", "left_anti").select("pid", "known")
    calibration = stored(held.unionByName(far), "calibration")
    return {"own": own, "keyed": keyed, "paragraphs": paragraphs, "model": model, "needed": found, "predicted": predicted, "calibration": calibration, "least": threshold(calibration)}


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_notices, families (in order of name, comma-joined), p (the surest notice's).

    A null or empty text has no notice: 0, an empty string and null. Lines end at \\n; case and punctuation between
    words don't count. Repeated rows are each answered; an empty table gives no rows.
    """
    s = scan(docs, id_col, text_col)
    guesses = s["predicted"].where(F.col("known") > s["least"])
    sure = stored(confirmed(docs.sparkSession, s["paragraphs"], guesses), "sure")
    per = s["keyed"].select("uid", "pid").join(sure, "pid").groupBy("uid").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("p").alias("p"))
    some, none = s["own"].where("lines is not null"), s["own"].where("lines is null")
    with_any = some.select("uid", "doc_id").join(per, "uid", "left").select("doc_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"), "p")
    return none.select("doc_id", F.lit(0).cast("long").alias("n_notices"), F.lit("").alias("families"), F.lit(None).cast("double").alias("p")).unionByName(with_any)

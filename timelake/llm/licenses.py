"""License scans by diagonal voting.

Words are runs of letters, digits and all that is not ASCII, with A-Z in lower case. Every rolling k-gram of a document's words is
hashed and joined in Spark with the positions that the same hash has in the license templates (a table of fixed size,
broadcast). A hit at word p of the document and word t of a template votes for the diagonal p - t: votes are counted for
each document, template and diagonal. Neighbouring diagonals merge into a band, since an inserted or a lost word shifts what
follows it; a band with enough of the template's k-grams is a candidate. Candidates meet their text again and are verified
on the words themselves: the share of the template's words that stand on one of the band's diagonals is the span's score.

Short templates (phrases) vote with 2-grams and count only where all of them agree on one diagonal and all words are equal,
so each place is a span of score 1. Long ones vote with 5-grams and need GATE of them, and VERIFIED of the words.

Only hits are shuffled. Candidates are joined with the texts by broadcast while there are few (BROADCAST spans, counted first), else
by a merge join; the result is the same. A document's rows are told apart by its id and a hash of its text, so a hot copy is
pre-aggregated before the shuffle.

Edge cases: null texts have no words; rows with equal or null doc_id are scanned one by one and each gets its row; texts without
licenses have no spans and score 0; an empty table gives no rows. Texts may be of any length: hashes travel in runs of RUN words.
Extra columns pass through; those that have an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, saved, text_of
from .hashing import pieces, window_hashes, word_hashes

#: Phrases whose places are base spans, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Other phrases that name a license.
NAMES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "zlib license": "zlib",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "creative commons attribution": "cc-by",
    "under cc by 4 0": "cc-by",
    "under cc by sa 4 0": "cc-by-sa",
    "under cc by nc 4 0": "cc-by-nc",
    "under cc by nd 4 0": "cc-by-nd",
    "under cc0 1 0": "cc0",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2 0": "apache",
    "spdx license identifier gpl": "gpl",
}
#: The wording of public license notices.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
#: Words of a gram in phrases and in notices; the longest phrase.
SHORT, LONG, PHRASE = 2, 5, 8
#: Diagonals this close are one band; the share of a notice's grams that makes a candidate, and of its words that makes a span.
NEAR, GATE, VERIFIED = 6, 0.25, 0.8
#: Words whose hashes travel in one row, and candidate spans that are broadcast at most.
RUN, BROADCAST = 32_768, 50_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


class Template(NamedTuple):
    label: str
    base: bool
    words: list[bytes]

    @property
    def k(self) -> int:
        return SHORT if len(self.words) <= PHRASE else LONG


def folded(text: bytes) -> bytes:
    """The text with A-Z in lower case and all that separates words as spaces."""
    return text.translate(_TABLE)


def words_of(text: str | bytes) -> list[bytes]:
    return folded(text.encode() if isinstance(text, str) else text).split()


def templates() -> list[Template]:
    named = [(x, y, base) for table, base in ((BASE, True), (NAMES, False)) for x, y in table.items()]
    return [Template(y, base, words_of(x)) for x, y, base in named] + [Template(y, False, words_of(x)) for y, x in NOTICES.items()]


def positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(gram, template, at): where each hashed gram stands in the templates."""
    rows = []
    for number, t in enumerate(known):
        grams, _ = window_hashes(*word_hashes([b" ".join(t.words)]), t.k)
        rows += [(g, t.k, number, at) for at, g in enumerate(grams.view(np.int64).tolist())]
    return spark.createDataFrame(rows, "gram long, k int, template int, at int")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) to (k1, k2, k, start, grams): all rolling grams of both lengths, in runs."""
    for b in batches:
        texts = [folded(t) for t in b.column(2).to_pylist()]
        for x, y in pieces(texts):
            words, counts = word_hashes(texts[x:y])
            for k in (SHORT, LONG):
                hashes, windows = window_hashes(words, counts, k)
                runs = -(-windows // RUN)
                row = np.repeat(np.arange(x, y), runs)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
                ends = np.r_[0, np.cumsum(np.minimum(RUN, windows[row - x] - start))]
                for a in range(0, len(row), 64):
                    z = min(a + 64, len(row))
                    at = pa.array(row[a:z])
                    part = pa.ListArray.from_arrays(pa.array((ends[a : z + 1] - ends[a]).astype(np.int32)), pa.array(hashes[ends[a] : ends[z]].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.full(z - a, k, np.int32)), pa.array(start[a:z].astype(np.int32)), part], ["k1", "k2", "k", "start", "grams"])


def bands(texts: DataFrame, known: list[Template]) -> DataFrame:
    """(k1, k2, template, low, high): bands of diagonals of texts (k1, k2, text) that may hold a template."""
    spark = texts.sparkSession
    place = positions(spark, known)
    grams = texts.mapInArrow(_grams, "k1 long, k2 long, k int, start int, grams array<long>")
    each = grams.select("k1", "k2", "k", "start", F.posexplode("grams").alias("p", "gram"))
    hits = each.join(F.broadcast(place), ["gram", "k"]).select("k1", "k2", "template", (F.col("start") + F.col("p") - F.col("at")).alias("diagonal"), "at")
    # rows that repeat whole cast the same votes twice; a set holds each once, and no more than the template has
    voted = hits.groupBy("k1", "k2", "template", "diagonal").agg(F.collect_set("at").alias("at"))
    needs = spark.createDataFrame([(i, len(t.words) - t.k + 1, t.k == SHORT) for i, t in enumerate(known)], "template int, grams int, whole boolean")
    voted = voted.join(F.broadcast(needs), "template")
    phrases = voted.where(F.col("whole") & (F.size("at") == F.col("grams"))).select("k1", "k2", "template", F.col("diagonal").alias("low"), F.col("diagonal").alias("high"))
    one = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(one) > NEAR).cast("int"), F.lit(1))
    merged = voted.where(~F.col("whole")).withColumn("new", new).withColumn("band", F.sum("new").over(one))
    wide = merged.groupBy("k1", "k2", "template", "band").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum(F.size("at")).alias("votes"), F.first("grams").alias("grams"))
    return phrases.union(wide.where(F.col("votes") >= GATE * F.col("grams")).select("k1", "k2", "template", "low", "high"))


def verify(words: np.ndarray, t: np.ndarray, low: int, high: int) -> tuple[float, int, int]:
    """(share of the template's words on a diagonal of the band, first and end of what stands there)."""
    met, first, end = np.zeros(len(t), bool), len(words), 0
    for d in range(max(low, 1 - len(t)), min(high, len(words) - 1) + 1):
        a, b = max(0, -d), min(len(t), len(words) - d)
        same = words[a + d : b + d] == t[a:b]
        if same.any():
            at = np.flatnonzero(same)
            met[a:b] |= same
            first, end = min(first, int(at[0]) + a + d), max(end, int(at[-1]) + a + d + 1)
    return float(met.mean()), first, end


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: list[Template] | None = None) -> DataFrame:
    """The rows of `docs` with n_words, spans (label, base, start, end, score; in words, by start) and the highest score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = templates() if known is None else known
    k1, k2, spans, held = (free_name(docs, x) for x in ("k1", "k2", "candidates", "held_text"))
    named = docs.withColumn(held, text_of(docs, text)).withColumn(k2, F.xxhash64(held))
    named = named.withColumn(k1, F.coalesce(docs[doc_id].cast("long"), F.xxhash64(held, F.lit(1))))
    found = bands(named.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(held).cast("binary").alias("text")), known)
    by_text = saved(found.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("template", "low", "high"))).alias("c")), "candidates")
    many = by_text.agg(F.sum(F.size("c"))).first()[0] or 0
    by_text = F.broadcast(by_text) if many <= BROADCAST else by_text.hint("merge")
    joined = named.join(by_text.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("c").alias(spans)), [k1, k2], "left")
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "score")]
    numbers = {w: n for n, w in enumerate(sorted({w for t in known for w in t.words}))}
    coded = [np.array([numbers[w] for w in t.words]) for t in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, out, score = [], [], []
            for t, c in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                words = folded(t).split()
                count.append(len(words))
                mine = []
                if c:
                    own = np.array([numbers.get(w, -1) for w in words])
                    for x in c:
                        template = known[x["template"]]
                        share, first, end = verify(own, coded[x["template"]], x["low"], x["high"])
                        if share >= (1 if template.k == SHORT else VERIFIED):
                            mine.append({"label": template.label, "base": template.base, "start": first, "end": end, "score": share})
                out.append(sorted(mine, key=lambda s: (s["start"], s["end"], s["label"])))
                score.append(max((s["score"] for s in mine), default=0.0))
            kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(count, pa.int64()), pa.array(out, kind), pa.array(score, pa.float64())], [*keep, "n_words", "spans", "score"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("score", T.DoubleType())])
    return joined.select(*keep, F.col(held).cast("binary"), spans).mapInArrow(run, schema)

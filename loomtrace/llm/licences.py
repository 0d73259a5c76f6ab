"""License scan by diagonal voting.

All rolling word k-gram hashes of a text are joined in Spark to the positions that they have in the templates. A hit at
word p of the text and word t of a template votes for the diagonal p - t. Votes are summed by diagonal, and
neighbouring diagonals (a few words inserted or left out) are merged to a span. Spans are then verified in the text,
word by word: a short phrase has to be exact; a notice's words are aligned to the span's (longest common subsequence),
and enough of them must be there in their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import materialise, session, utf8, words_of

K = 3
#: Above so many texts with spans they are joined by shuffle.
BROADCAST_ROWS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Fixed phrases, counted wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed texts: notices and characteristic passages of public licences, in words of lower case.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-rights": "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-license": "released under the mit license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-conditions": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache": "licensed under the apache license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "lgpl": "gnu lesser general public license",
    "agpl": "gnu affero general public license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl": "subject to the terms of the mozilla public license",
    "cc-by-text": "this work is licensed under a creative commons attribution license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-rights": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-conditions": "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    exact: bool

    @property
    def k(self) -> int:
        return min(K, len(self.words))

    def grams(self) -> list[bytes]:
        return [b" ".join(self.words[i : i + self.k]) for i in range(len(self.words) - self.k + 1)]


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[Template]:
    made = [Template(label, tuple(words_of(t.encode())), True) for t, label in phrases.items()]
    return made + [Template(label, tuple(words_of(t.encode())), False) for label, t in notices.items()]


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes."""
    out = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        out = (out * _ODD) ^ h[i : len(h) - k + 1 + i]
    return out


def _gram_hash(gram: bytes) -> int:
    h = np.array([xxhash.xxh64_intdigest(w) for w in gram.split(b" ")], np.uint64)
    return int(_rolled(h, len(h)).view(np.int64)[0])


def template_positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(gram, k, template, tpos): a bounded table, a row for each gram of each template."""
    rows = [(_gram_hash(g), own.k, i, t) for i, own in enumerate(known) for t, g in enumerate(own.grams())]
    return spark.createDataFrame(rows, "gram bigint, k int, template int, tpos int")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tie, text): equal rows have equal keys (doc_id, tie), by a hash of the text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))


def rolling_grams(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, tie, n_words, grams): the hashes of all rolling k-grams of each text, those of the first size first."""
    session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = 0, utf8(b.column(2))
            while at < len(texts):  # a few MB of text at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size < 2 << 20):
                    size += len(texts[to])
                    to += 1
                words = [words_of(t) for t in texts[at:to]]
                n = np.array([len(w) for w in words], np.int64)
                coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
                h = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
                whole = [_rolled(h, k).view(np.int64) for k in sizes]  # of all texts on end; those across texts are left out
                start = (np.cumsum(n) - n).tolist()
                parts = [g[s : s + max(0, m - k + 1)] for s, m in zip(start, n.tolist()) for g, k in zip(whole, sizes)]
                ends = np.cumsum(sum(np.maximum(0, n - k + 1) for k in sizes))
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.concatenate(parts)))
                own = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n), grams], names=["doc_id", "tie", "n_words", "grams"])
                at = to

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie bigint, n_words bigint, grams array<bigint>")


def gram_hits(docs: DataFrame, known: list[Template]) -> DataFrame:
    """(doc_id, tie, n_words, pos, template, tpos): each place of a text's gram in a template; and a row with a null template for each text.

    Every gram is joined. Grams without a partner end at the join, in the task that made them.
    """
    sizes = sorted({t.k for t in known})
    grams = rolling_grams(docs, sizes).select("doc_id", "tie", "n_words", F.posexplode_outer(F.concat(F.array(F.lit(None).cast("bigint")), "grams")).alias("at", "gram"))
    # the first entry, of no gram, is the text's own row
    hits = grams.join(F.broadcast(template_positions(docs.sparkSession, known)), "gram", "left").where("template is not null or at = 0")
    before, pos = F.lit(1).cast("bigint"), F.lit(None).cast("bigint")
    for k in sizes:
        pos = F.when(F.col("k") == k, F.col("at") - before).otherwise(pos)
        before = before + F.greatest(F.lit(0), F.col("n_words") - (k - 1))
    return hits.select("doc_id", "tie", "n_words", pos.alias("pos"), "template", "tpos")


def spans(hits: DataFrame, known: list[Template], slack: int = 8, coverage: float = 0.6) -> DataFrame:
    """(doc_id, tie, template, first, last): merged diagonals with enough of a template's different grams, by words of the text."""
    of = hits.sparkSession.createDataFrame([(i, len(t.grams()), t.k, t.exact) for i, t in enumerate(known)], "template int, grams int, size int, exact boolean")
    votes = hits.where("template is not null").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    lines = votes.groupBy("doc_id", "tie", "template", "diagonal").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("seen"))
    lines = lines.join(F.broadcast(of), "template")  # bounded: one row per template
    by = W.partitionBy("doc_id", "tie", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > slack) | F.col("exact")
    lines = lines.withColumn("cut", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("group", F.sum("cut").over(by))
    merged = lines.groupBy("doc_id", "tie", "template", "group").agg(
        F.min("first").alias("first"), (F.max("last") + F.first("size")).alias("last"), F.first("exact").alias("exact"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("seen")))) / F.first("grams")).alias("share"),
    )
    return merged.where((F.col("share") >= coverage) & (~F.col("exact") | (F.col("share") == 1))).select("doc_id", "tie", "template", "first", "last")


def aligned(span: list[bytes], words: tuple[bytes, ...]) -> int:
    """Words of a template that the span has in the same order: the longest common subsequence, a bit for each word."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(words):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(words)) - 1
    rows = full
    for w in span:
        met = rows & where.get(w, 0)
        rows = ((rows + met) | (rows - met)) & full
    return len(words) - rows.bit_count()


def verified(docs: DataFrame, found: DataFrame, known: list[Template], coverage: float = 0.6) -> DataFrame:
    """(doc_id, tie, template, first, last, share): the spans whose words hold the template; share is that of its words."""
    spans_of = found.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))
    spans_of = spans_of.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "spans")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(spans_of) if few else spans_of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    rows = rows.select("doc_id", "tie", "text", "spans")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for r, (text, own) in enumerate(zip(utf8(b.column(2)), b.column(3).to_pylist())):
                words = words_of(text)
                for s in own:
                    template, span = known[s["template"]], words[s["first"] : s["last"]]
                    share = float(tuple(span) == template.words) if template.exact else aligned(span, template.words) / len(template.words)
                    if share >= (1 if template.exact else coverage):
                        row.append(r)
                        out.append((s["template"], s["first"], s["last"] - 1, share))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.float64()))]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *columns], names=["doc_id", "tie", "template", "first", "last", "share"])

    return rows.mapInArrow(run, f"doc_id {kind}, tie bigint, template int, first bigint, last bigint, share double").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found): one row per input row.

    found: the verified spans (first and last word, label, share of the template's words). Null and empty texts have no
    words and no label; equal rows are scanned as one and given out as often as they came; one id on different texts
    gives a row for each. Null ids are kept. An empty table gives an empty result; other columns are ignored. What is
    grouped by text is bounded by that text's own hits.
    """
    known = templates(phrases, notices)
    rows = keyed(docs, id_col, text_col)
    hits = materialise(gram_hits(rows, known), "gram-hits")
    once = hits.where("template is null").groupBy("doc_id", "tie").agg(F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    of = docs.sparkSession.createDataFrame([(i, t.label, t.exact) for i, t in enumerate(known)], "template int, label string, base boolean")
    merged = materialise(spans(hits, known), "spans")
    found = verified(rows, merged, known).join(F.broadcast(of), "template")  # bounded: one row per template
    base = F.when(F.col("base"), F.col("first"))
    best = found.groupBy("doc_id", "tie").agg(
        F.count_if("base").alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "share"))).alias("found"),
    ).select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")
    out = once.join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "found",
    )

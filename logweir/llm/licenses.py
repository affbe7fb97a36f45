"""License scans: exact phrases, and an exact set-similarity join of text blocks with licence templates.

DataFrame operations only. A block is a run of consecutive words of a text, wherever its lines end: of SHORT[0]
words at every SHORT[1]-th word for templates of up to SHORT[1] words, and of LONG[0] at every LONG[1]-th for longer
ones. So a notice that is wrapped, indented or set as a comment lies within a block as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of lower-cased text.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a block and words from block to block.
SHORT, LONG = (64, 32), (512, 256)
#: Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label -> words of a notice or licence, as published. Fixed values.
TEMPLATES = {
    "all-rights-reserved": "all rights reserved",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-2-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
    "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
    "materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-3.0-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option "
    "any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
    "public license for more details you should have received a copy of the gnu general public license along with this program",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including "
    "but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether "
    "in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
    "for any purpose commercial or non commercial and by any means",
}
#: Least share of a template's words that a block must hold.
THRESHOLD = 0.8
#: Score of a text with a phrase but no template.
PHRASE_SCORE = 0.5


def template_sets(templates: dict[str, str], threshold: float) -> list[tuple[str, list[str], int, bool]]:
    """(label, distinct tokens, tokens that a block must hold, whether the template needs long blocks)."""
    found = []
    for label, text in templates.items():
        words = text.split()
        if len(words) > LONG[1]:
            raise ValueError(f"template {label} is longer than {LONG[1]} words")
        tokens = sorted(set(words))
        found.append((label, tokens, math.ceil(threshold * len(tokens)), len(words) > SHORT[1]))
    return found


def containment_join(blocks: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(rid, label, containment) of every block (rid, long, hits: distinct template tokens) that holds `threshold` of a template of its length class.

    Tokens of both sides are put in one order: by how many blocks hold them, rarest first. A block can reach
    the threshold only if it holds one of a template's first size - need + 1 tokens (prefix filter) and at
    least `need` template tokens (length filter). Where the first token that both share stands at place p of
    the template and q of the block, they share at most min(size - p, hits - q) (positional filter). What is
    left is verified on the whole sets. The template side is a constant of the code: its size is bounded.
    """
    spark = blocks.sparkSession
    sets = template_sets(templates, threshold)
    counts = blocks.select(F.explode("hits").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    seen = {r["token"]: r["n"] for r in counts.collect()}  # at most one row a template token
    ranks = {t: i for i, t in enumerate(sorted({t for _, own, _, _ in sets for t in own}, key=lambda t: (seen.get(t, 0), t)))}
    prefix = []
    for label, tokens, need, far in sets:
        own = sorted(tokens, key=ranks.__getitem__)
        prefix += [(label, t, len(own), need, place, own, far) for place, t in enumerate(own[: len(own) - need + 1])]
    prefix = spark.createDataFrame(prefix, "label string, token string, size int, need int, place int, tokens array<string>, far boolean")
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    in_order = F.transform(F.array_sort(F.transform("hits", lambda t: F.struct(rank[t].alias("rank"), t.alias("token")))), lambda x: x["token"])
    ordered = blocks.withColumn("hits", in_order)
    each = ordered.select("rid", "long", "hits", F.posexplode("hits").alias("at", "token"))
    found = each.join(F.broadcast(prefix), "token").filter(F.col("long") == F.col("far"))
    found = found.filter(F.least(F.col("size") - F.col("place"), F.size("hits") - F.col("at")) >= F.col("need"))
    found = found.withColumn("overlap", F.size(F.array_intersect("hits", "tokens"))).filter(F.col("overlap") >= F.col("need"))
    return found.groupBy("rid", "label").agg(F.max(F.col("overlap") / F.col("size")).alias("containment"))


def _starts(phrase: str) -> "F.Column":
    """Places where the phrase's words stand consecutively in `words`."""
    parts = phrase.split()

    def at(i):
        test = F.lit(True)
        for k, p in enumerate(parts):
            test = test & (F.get("words", i + k) == p)
        return F.coalesce(test, F.lit(False))

    return F.when(F.size("words") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), at))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text counts as empty: no words, no labels, score 0. Repeated rows are scanned each on their own, and
    ties cannot arise as all matches count. Very long texts are cut into blocks that overlap by half; all are
    compared. An empty table gives no rows. Further columns of docs are left out and may have any names. Texts
    are split once; of those that hold enough words of some template anywhere, the template words of each
    block are written once.
    """
    sets = template_sets(templates, threshold)
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for _, tokens, _, _ in sets for t in tokens})])
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(key).alias("doc_id"), F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)).alias("words"))
    rows = rows.select("doc_id", "words", F.array_intersect("words", vocabulary).alias("seen"))
    enough = {far: F.lit(False) for far in (False, True)}
    for _, tokens, need, far in sets:
        enough[far] = enough[far] | (F.size(F.array_intersect("seen", F.array(*[F.lit(t) for t in tokens]))) >= need)

    def windows(size: int, step: int) -> "F.Column":
        parts = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(step)), lambda i: F.array_intersect(F.slice(F.col("words"), i + 1, F.lit(size)), vocabulary))
        return F.filter(parts, lambda h: F.size(h) > 0)

    phrase = {label: F.when(F.array_contains("seen", F.lit("license")), _starts(p)) for p, label in PHRASES.items()}
    rows = rows.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        *[c.alias(f"at_{label}") for label, c in phrase.items()],
        F.when(enough[False], windows(*SHORT)).alias("short"),
        F.when(enough[True], windows(*LONG)).alias("long"),
    )
    rows = written(rows, "license")
    blocks = rows.select("rid", F.lit(False).alias("long"), F.explode("short").alias("hits")).unionByName(rows.select("rid", F.lit(True).alias("long"), F.explode("long").alias("hits")))
    matches = containment_join(blocks, templates, threshold)
    matches = matches.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    places = F.array_sort(F.concat(*[F.coalesce(F.col(f"at_{label}"), F.array().cast("array<int>")) for label in PHRASES.values()]))
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in PHRASES.values()]))
    rows = rows.drop("short", "long").withColumn("places", places).withColumn("base", F.array_sort(base))
    rows = rows.join(matches, "rid", "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0)).cast("long").alias("first_word"),
        F.when(F.size("places") > 0, F.element_at("places", -1)).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("best", F.when(F.size("base") > 0, F.lit(PHRASE_SCORE)), F.lit(0.0)).alias("score"),
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    sets = template_sets(TEMPLATES, THRESHOLD)
    listed = lambda tokens: "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
    rows = ", ".join(f"('{label}', {listed(tokens)}, {need}, {'true' if far else 'false'})" for label, tokens, need, far in sets)
    block = lambda size, step, far: f"SELECT rid, {far} AS long, list_distinct(words[i + 1 : i + {size}]) AS block FROM (SELECT rid, words, unnest(range(0, len(words), {step})) AS i FROM w)"
    return rf"""
WITH t(label, tokens, need, long) AS (VALUES {rows}),
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words FROM documents),
p AS (SELECT rid, unnest(list_transform(range(1, len(words) + 1), lambda i: CASE
    WHEN words[i] IN ('mit', 'apache') AND words[i + 1] = 'license' THEN struct_pack(at := i - 1, label := words[i])
    WHEN words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license' THEN struct_pack(at := i - 1, label := 'gpl') END)) AS x FROM w WHERE list_contains(words, 'license')),
b AS (SELECT rid, count(*) AS n, min(x.at) AS lo, max(x.at) AS hi, list_sort(list(DISTINCT x.label)) AS base FROM p WHERE x IS NOT NULL GROUP BY rid),
k AS ({block(*SHORT, "false")} UNION ALL {block(*LONG, "true")}),
m AS (SELECT rid, list(DISTINCT label) AS found, max(len(list_intersect(tokens, block)) / CAST(len(tokens) AS DOUBLE)) AS best
      FROM k JOIN t ON k.long = t.long AND len(list_intersect(tokens, block)) >= need GROUP BY rid)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word,
  coalesce(array_to_string(b.base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(m.found, [])))), ','), '') AS labels,
  CAST(coalesce(m.best, CASE WHEN b.n > 0 THEN {PHRASE_SCORE} END, 0) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""


OP10_SQL = _sql()

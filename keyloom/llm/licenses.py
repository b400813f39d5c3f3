"""Licence scans by an exact set-similarity join (native: DataFrame functions only).

A text block is a window of as many words as a template has. It meets a template when it holds at
least ``threshold`` of the template's distinct words, those that name the licence among them. Tokens are the words of the templates, ordered by how many
documents hold them (counted over the whole table), rarest first.

1. A text is cut into tiles that overlap by the longest template, so that every window lies whole in
   the tile in which it starts. Of a tile its tokens are kept, in the global order.
2. Prefix filter: of a template with m tokens and need n = ceil(threshold * m) only the m - n + 1
   rarest are in the index. Tokens of tiles are exploded and equi-joined with the index.
3. Length filter: a tile with fewer than n tokens is no candidate. Positional filter: neither is one with fewer than
   n tokens left, itself included, from the common token on, in the template's order and the tile's, where no earlier one is common.
4. Windows of what is left are verified word by word.

The templates are a parameter with at most MAX_TEMPLATE_WORDS words in all, so the index
that is broadcast has a proven bound.

Rows: one for each input row. Null text counts as empty: no words, score 0. Empty
texts: the same. Very long texts are read whole. Rows that repeat get equal results.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import ascii_lower

MAX_TEMPLATE_WORDS = 20_000
THRESHOLD = 0.8

#: Separators of lower-case words, and words before A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are reported, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licence templates: label, text, and the words that a block must hold as they name the licence.
TEMPLATES = (
    ("mit", "Released under the MIT License", "mit"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "sublicense",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache"),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http www apache org licenses LICENSE 2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License",
        "apache",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "commons noncommercial"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu public"),
    (
        "gpl",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or at your option any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "gnu public",
    ),
    ("bsd", "Licensed under the BSD License", "bsd"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions",
    ),
    ("all-rights-reserved", "Copyright. All rights reserved", "copyright reserved"),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def need_of(tokens: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(threshold * tokens - 1e-9))


def scan(
    documents: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    templates: Sequence[tuple[str, str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment of a template that matches, else 0)."""
    whole = F.coalesce(documents[text], F.lit(""))
    own = documents.select(F.struct(*[documents[c] for c in keep]).alias("k"), whole.alias("t"))
    # the words are looked at by several columns below; lower and split stay one column
    lead = F.arrays_overlap("w", F.array(*[F.lit(p.split(" ")[-1]) for p, _ in phrases])) if phrases else F.lit(False)
    counted = own.select("k", "t", F.regexp_count("t", F.lit(RAW_WORD)).cast("bigint").alias("n_words"), F.split(F.lower("t"), SEPARATORS).alias("w"))
    marked = counted.select("k", *_key(), "n_words", F.when(lead, _exact_words("t")).alias("w"))
    places = F.flatten(F.array(*[_places("w", p, label) for p, label in phrases])) if phrases else F.array().cast("array<struct<at:int,label:string>>")
    found = marked.select("k", "key", "digest", "n_words", F.when(F.col("w").isNotNull(), places).alias("p"))
    at = F.transform("p", lambda x: x["at"])
    base = F.coalesce(F.transform("p", lambda x: x["label"]), F.array().cast("array<string>"))
    met = matches(own, templates, threshold).groupBy("key", "digest").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    met = met.select(F.col("key").alias("m_key"), F.col("digest").alias("m_digest"), "more", "score")
    joined = found.join(met, (F.col("key") == F.col("m_key")) & (F.col("digest") == F.col("m_digest")), "left")
    return joined.select(
        *[F.col("k").getField(c).alias(c) for c in keep],
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _key() -> list[Column]:
    """What tells rows apart: a hash of the kept columns, by which groups of copies spread over tasks, and the text's digest."""
    return [F.xxhash64("k").alias("key"), F.sha2("t", 256).alias("digest")]


def matches(own: DataFrame, templates: Sequence[tuple[str, str, str]], threshold: float) -> DataFrame:
    """(key, digest, label, score) of the windows that meet a template, over ``own`` (k, t)."""
    spark = own.sparkSession
    lists = [words_of(t) for _, t, _ in templates]
    if sum(map(len, lists)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have over {MAX_TEMPLATE_WORDS} words")
    order = token_order(own, sorted({w for words in lists for w in words}))
    rank = sorted(order, key=lambda w: (order[w], w))
    place = {w: i for i, w in enumerate(rank)}
    span = max(map(len, lists), default=1)
    index = []
    for (label, _, names), words in zip(templates, lists, strict=True):
        tokens = sorted(set(words), key=place.__getitem__)
        need = need_of(len(tokens), threshold)
        for i, w in enumerate(tokens[: len(tokens) - need + 1]):
            index.append((w, i, label, len(words), need, tokens, words_of(names)))
    known = spark.createDataFrame(index, "token string, i int, label string, length int, need int, tokens array<string>, names array<string>")
    vocabulary = F.array(*[F.lit(w) for w in rank]).cast("array<string>")
    prefix = F.array(*[F.lit(w) for w in sorted({x[0] for x in index})]).cast("array<string>")

    words = own.select("k", "t", F.split(F.lower("t"), SEPARATORS).alias("w")).where(F.arrays_overlap("w", prefix))
    words = words.select(*_key(), _exact_words("t").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(span))
    tiles = words.select("key", "digest", F.explode(F.transform(starts, lambda a: F.slice("w", a + 1, F.lit(2 * span)))).alias("tile"))
    tiles = tiles.select("key", "digest", "tile", F.array_intersect(vocabulary, "tile").alias("b"))
    tokens = tiles.select("key", "digest", "tile", "b", F.posexplode("b").alias("j", "tile_token"))
    met = tokens.join(F.broadcast(known), F.col("tile_token") == F.col("token"))
    candidates = met.where(F.size("b") >= F.col("need")).where(
        F.least(F.size("tokens") - F.col("i"), F.size("b") - F.col("j")) >= F.col("need")
    )
    # a tile meets a template by its first common token only
    candidates = candidates.where(F.element_at(F.array_intersect("tokens", "b"), 1) == F.col("token"))
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(span), F.size("tile") - F.col("length") + 1))), lambda a: F.slice("tile", a, F.col("length"))
    )
    common = F.transform(
        windows, lambda w: F.when(F.size(F.array_except("names", w)) == 0, F.size(F.array_intersect("tokens", w))).otherwise(0)
    )
    held = candidates.select("key", "digest", "label", "need", F.size("tokens").alias("m"), F.array_max(common).alias("c"))
    return held.where("c >= need").select("key", "digest", "label", (F.col("c") / F.col("m")).alias("score"))


def _exact_words(text: str) -> Column:
    return F.filter(F.split(ascii_lower(F.col(text)), SEPARATORS), lambda w: w != "")


def token_order(own: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Documents that hold each word of the vocabulary: one row of counts, summed before it is sent."""
    if not vocabulary:
        return {}
    held = F.array_intersect(F.split(F.lower("t"), SEPARATORS), F.array(*[F.lit(w) for w in vocabulary]))
    counts = {r["w"]: r["n"] for r in own.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _places(words: str, phrase: str, label: str) -> Column:
    """Starts of the phrase, words from 0."""
    parts = phrase.split(" ")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - len(parts) + 1))

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, p in enumerate(parts):
            ok = ok & F.coalesce(F.get(F.col(words), i - 1 + k) == p, F.lit(False))
        return ok

    return F.transform(F.filter(starts, here), lambda i: F.struct((i - 1).alias("at"), F.lit(label).alias("label")))

"""Operator 7: license scan, in DataFrame functions alone.

Words are lower-cased runs of letters and digits. Around each anchor word the
text is cut into overlapping windows, of each size that a template is indexed
by, clamped to the text's end; a shorter text is one window. Windows have MinHash signatures; 12 bands of 2 samples retrieve templates
that share a band with one of their own windows. A pair of windows of
similarity 0.75 is found with probability 0.99995, of 0.5 with 0.968, and each
match has many windows. Retrieved pairs are verified exactly: a stretch of
the text as long as the template matches if it holds 0.75 or more of the
template's distinct 5-word shingles. All stretches are found: from the first
that matches, the best that starts within it is taken (ties: the first), then
the search goes on behind that one.

Anchors are the longest words of so many of a template's shingles that every
match holds one: text without anchors can't hold a match.

Null, empty and short texts give no rows; repeated rows give theirs each, told
apart by nothing but the row. Very long texts: a window each few words around
anchors, and verification in time of the hits times the template's length. An
empty table gives no rows. Templates are a parameter of bounded size
(MAX_TEMPLATE_WORDS words in all, checked), and so may be broadcast; by default
they are the notices below and the texts of license_texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwalk.llm.common import staged
from driftwalk.llm.license_texts import TEXTS

SHINGLE, BANDS, ROWS, PERCENT = 5, 12, 2, 75
SCALES = (5, 8, 12, 20, 40)
MAX_TEMPLATE_WORDS = 200_000

# Public license notices and their SPDX identifiers.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-long", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT-long", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-long", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

TEMPLATES = (*NOTICES, *TEXTS)

_WORD = re.compile(r"[^\W_]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def anchors_of(templates) -> list[str]:
    """Words of which every match holds one.

    Each shingle has its longest word as an anchor. A match holds at least
    PERCENT of a template's shingles, so fewer than that may go without: those
    whose anchors are shortest, as short words are common.
    """
    found = set()
    for _, text in templates:
        words = template_words(text)
        own = {tuple(words[at : at + SHINGLE]): max(words[at : at + SHINGLE], key=len) for at in range(len(words) - SHINGLE + 1)}
        needed = -(-PERCENT * len(own) // 100)
        longest = sorted(own.values(), key=lambda w: (-len(w), w))
        found.update(longest[: len(own) - needed + 1])
    return sorted(found)


def _shingles(words: Column) -> Column:
    """Hashes of a word array's shingles."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, SHINGLE), " ")))


def _seeded(seed: int):
    return lambda h: F.xxhash64(h, F.lit(seed))


def _bands(shingles: Column) -> Column:
    def band(sh: Column, b: int) -> Column:
        rows = [F.array_min(F.transform(sh, _seeded(b * ROWS + r))) for r in range(ROWS)]
        return F.xxhash64(F.lit(b), *rows)

    # The lambda holds the shingles, which are else computed for each sample.
    return F.transform(F.array(shingles), lambda sh: F.array(*(band(sh, b) for b in range(BANDS))))[0]


def _window_bands(df: DataFrame) -> DataFrame:
    """df(words, start, scale, ...) with band keys of the window of `scale` words at start."""
    return df.withColumn("key", F.explode(F.array_distinct(_bands(_shingles(F.slice("words", F.col("start") + 1, F.col("scale")))))))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_shingles, n_found, start_word, end_word): the stretches of each license in a document.

    start_word and end_word bound what was found, in words, end exclusive.
    """
    usable = [(name, text) for name, text in templates if len(template_words(text)) >= SHINGLE]
    if sum(len(template_words(t)) for _, t in usable) > MAX_TEMPLATE_WORDS:
        raise ValueError("templates are too large to broadcast")
    spark, anchors = docs.sparkSession, anchors_of(usable)
    schema = "license string, words array<string>, scale int, start int"
    rows = []
    for name, text in usable:
        words = template_words(text)
        scale = max(s for s in SCALES if s <= len(words))
        rows += [(name, words, scale, at) for at in range(len(words) - scale + 1)]
    windows = spark.createDataFrame(rows, schema)
    scales = sorted({r[2] for r in rows})
    indexed = _window_bands(windows).select("license", "scale", "key").distinct()
    full = spark.createDataFrame([(name, template_words(text)) for name, text in usable], "license string, t_words array<string>").select("license", F.size("t_words").alias("t_size"), F.array_distinct(_shingles(F.col("t_words"))).alias("t_shingles"))

    hint = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, anchors)) + r")(?![\p{L}\p{N}])"
    text = F.col(text_col).cast("string")
    worded = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body")).where(F.rlike("body", F.lit(hint))).select("doc_id", words_of(F.col("body")).alias("words")).where(F.size("words") >= SHINGLE)
    # Written once: both branches below read the same row numbers, whatever is retried.
    worded = staged(worded.withColumn("row", F.monotonically_increasing_id()), "license-words")
    near = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(anchors), i)))

    def begins(scale: int) -> Column:
        """Windows around the anchors: each start, on the stride or the last, from which a window holds one."""
        last = F.greatest(F.size("words") - scale, F.lit(0))
        starts = F.array_distinct(F.flatten(F.transform(near, lambda i: F.sequence(F.least(F.greatest(i - scale + 1, F.lit(0)), last), F.least(i, last)))))
        on_stride = F.filter(starts, lambda at: (at % max(1, scale // 8) == 0) | (at == last))
        return F.transform(on_stride, lambda at: F.struct(at.alias("start"), F.lit(scale).alias("scale")))

    cut = worded.withColumn("near", near).where(F.size("near") > 0)
    near = F.col("near")
    cut = cut.select("row", "words", F.explode(F.concat(*(begins(s) for s in scales))).alias("at")).select("row", "words", "at.start", "at.scale")
    found = _window_bands(cut).select("row", "scale", "key").join(F.broadcast(indexed), ["scale", "key"]).select("row", "license")
    pairs = worded.join(found.distinct(), "row").join(F.broadcast(full), "license")
    return _verified(pairs)


def _verified(pairs: DataFrame) -> DataFrame:
    marked = F.transform(_shingles(F.col("words")), lambda h, i: F.when(F.array_contains("t_shingles", h), F.struct(i.alias("i"), h.alias("h"))))
    held = pairs.withColumn("hit", F.array_compact(marked)).drop("words")
    held = held.where(F.size("hit") * 100 >= F.size("t_shingles") * PERCENT)
    reach = F.col("t_size") - SHINGLE

    def stretch(x: Column, k: Column) -> Column:
        # No more hits than places fit into a stretch.
        inside = F.filter(F.slice("hit", k + 1, reach + 1), lambda y: y["i"] <= x["i"] + reach)
        return F.struct(x["i"].alias("at"), F.size(F.array_distinct(F.transform(inside, lambda y: y["h"]))).alias("n"), (F.element_at(inside, -1)["i"] + SHINGLE).alias("to"))

    fits = F.filter(F.transform("hit", stretch), lambda x: x["n"] * 100 >= F.size("t_shingles") * PERCENT)
    # first: where the present search began; best: (n, -start, end) of the best stretch that starts within it.
    empty = F.expr("cast(named_struct('first', -1, 'best', null, 'out', array()) as struct<first:int,best:struct<n:int,back:int,to:int>,out:array<struct<n:int,back:int,to:int>>>)")

    def step(acc: Column, x: Column) -> Column:
        own = F.struct(x["n"].alias("n"), (-x["at"]).alias("back"), x["to"].alias("to"))
        none = acc["best"].isNull()
        within = ~none & (x["at"] < acc["first"] + F.col("t_size"))
        behind = ~none & ~within & (x["at"] >= F.col("t_size") - acc["best"]["back"])
        first = F.when(none | behind, x["at"]).otherwise(acc["first"])
        best = F.when(none | behind, own).when(within, F.greatest(acc["best"], own)).otherwise(acc["best"])
        return F.struct(first.alias("first"), best.alias("best"), F.when(behind, F.concat(acc["out"], F.array(acc["best"]))).otherwise(acc["out"]).alias("out"))

    picked = F.aggregate(fits, empty, step, lambda acc: F.array_compact(F.concat(acc["out"], F.array(acc["best"]))))
    out = held.select("doc_id", "license", F.size("t_shingles").cast("long").alias("n_shingles"), F.explode(picked).alias("p"))
    return out.select("doc_id", "license", "n_shingles", F.col("p.n").cast("long").alias("n_found"), (-F.col("p.back")).cast("long").alias("start_word"), F.col("p.to").cast("long").alias("end_word"))


def scan_sql(templates=TEMPLATES) -> str:
    """The same by comparing all shingles, as SQL over documents."""
    rows = ", ".join(f"('{name}', {len(template_words(t))}, [{', '.join(repr(w) for w in template_words(t))}])" for name, t in templates)
    return rf"""
WITH RECURSIVE t(license, size, ws) AS (VALUES {rows}),
ts AS (SELECT DISTINCT license, size, array_to_string(ws[i:i + 4], ' ') sh FROM (SELECT license, size, ws, unnest(range(1, size - 3)) i FROM t)),
tn AS (SELECT license, count(*) n_shingles FROM ts GROUP BY 1),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') ws FROM documents),
ds AS (SELECT doc_id, i - 1 i, array_to_string(ws[i:i + 4], ' ') sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) i FROM d)),
h AS (SELECT doc_id, license, size, i, sh FROM ds JOIN ts USING (sh)),
s AS (SELECT a.doc_id, a.license, a.i start_word, count(DISTINCT b.sh) n_found, max(b.i) + 5 end_word FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.license = b.license AND b.i BETWEEN a.i AND a.i + a.size - 5 GROUP BY 1, 2, 3),
q AS (SELECT s.doc_id, s.license, h.size, n_shingles, n_found, s.start_word, s.end_word FROM s JOIN (SELECT DISTINCT license, size FROM ts) h ON h.license = s.license JOIN tn ON tn.license = s.license WHERE 100 * n_found >= {PERCENT} * n_shingles),
p AS (SELECT doc_id, license, size, n_shingles, arg_max({{'f': n_found, 's': start_word, 'e': end_word}}, n_found * 1000000000 - start_word) b FROM (SELECT *, min(start_word) OVER (PARTITION BY doc_id, license) f FROM q) WHERE start_word < f + size GROUP BY ALL
UNION ALL SELECT doc_id, license, size, n_shingles, arg_max({{'f': n_found, 's': start_word, 'e': end_word}}, n_found * 1000000000 - start_word) b FROM (SELECT q.*, min(q.start_word) OVER (PARTITION BY q.doc_id, q.license) f FROM q JOIN p ON p.doc_id = q.doc_id AND p.license = q.license AND q.start_word >= p.b.s + p.size) WHERE start_word < f + size GROUP BY ALL)
SELECT doc_id, license, n_shingles, b.f n_found, b.s start_word, b.e end_word FROM p"""

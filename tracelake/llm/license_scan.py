"""Licence scan by a positional index of rare tokens, with DataFrame functions alone.

Licence words get their inverse document frequency from all documents. A file is looked at if it holds the rarest word of a
licence's mandatory phrase. Of each template whose mandatory phrase it holds, the words of that phrase and those of the highest
IDF in the file then meet the postings of the template; those that agree on one relative position vote for it, weighted by IDF. A label needs an alignment of two words or more and a
mandatory phrase, word by word.

Null and empty texts have no words, no label and the score 0. Texts of any length are one row. Repeated rows get the same
result each; documents are told apart by id and text hash. Equal votes resolve to the same label set. An empty table
gives no rows. Other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.llm.decontaminate import count_words, words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: str


#: Phrases and labels of the plain rule.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Usual notices, lower-cased and without punctuation.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "this project is licensed under the terms of the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person obtaining a copy"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("bsd", "released under the bsd 3 clause license", "bsd 3 clause"),
    Template("cc", "this work is licensed under a creative commons attribution license", "creative commons"),
    Template("cc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc", "licensed under cc by sa 4 0", "cc by sa"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()} | {w for p in PHRASES for w in p.split()})


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def idf(docs: DataFrame, vocab: list[str]) -> dict[str, float]:
    """ln((1 + N) / (1 + documents with the word)) for each word of a fixed small vocabulary, from all documents."""
    held = F.array_intersect(words(F.col("text")), _strings(vocab))
    # one row for each word and for the number of documents: their size is that of the vocabulary
    seen = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r.word: r.n for r in seen.collect()}
    from math import log

    return {w: log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) for w in vocab}


def _places(text: Column, phrase: str, label: str) -> Column:
    """Starts of a phrase in an array of words, with its label; ``said`` has the words as text."""
    said = phrase.split()
    last = F.size(text) - len(said)

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, w in enumerate(said):
            out = out & (F.get(text, i + k) == w)
        return out

    held = F.contains("said", F.lit(f" {phrase} "))
    at = F.when(held, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, looked_up: int = 6) -> DataFrame:
    """Every document with n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted) and score.

    The score is the share of a template's ``looked_up`` highest IDF weights that the best accepted alignment explains. A
    template's votes depend on no other template of the file.
    """
    weight = idf(docs, vocabulary(templates))
    spark = docs.sparkSession
    rarest = {max(p.split(), key=lambda w: (weight[w], w)) for p in [*PHRASES, *(t.mandatory for t in templates)]}
    # a text without all the letters of some phrase's words needs no look; lower() only ever adds texts here
    low, whole_phrase = F.lower("text"), F.lit(False)
    for phrase in sorted({*PHRASES, *(t.mandatory for t in templates)}):
        each = F.lit(True)
        for word in phrase.split():
            each = each & F.contains(low, F.lit(word))
        whole_phrase = whole_phrase | each
    cut = docs.where(whole_phrase).select("doc_id", F.xxhash64("text").alias("twin"), words(F.col("text")).alias("words"))
    files = cut.where(F.arrays_overlap("words", _strings(sorted(rarest))))
    files = files.select("doc_id", "twin", "words", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("said"))

    present = F.array_intersect("words", _strings(sorted(weight)))
    ranks = [sorted(set(t.text.split()), key=lambda w: (-weight[w], w)) for t in templates]
    base = F.concat(*[_places(F.col("words"), p, label) for p, label in PHRASES.items()])
    any_phrase = F.lit(False)
    for phrase in {*PHRASES, *(t.mandatory for t in templates)}:
        any_phrase = any_phrase | F.contains("said", F.lit(f" {phrase} "))

    def asked(here: Column) -> Column:
        """Of each template held, the words of its phrase and the first by rank of those in the file, as numbered words."""
        each = []
        for k, t in enumerate(templates):
            first = F.slice(F.filter(_strings(ranks[k]), lambda w: F.array_contains(here, w)), 1, looked_up)
            own = F.array_union(first, _strings(t.mandatory.split()))
            numbered = F.transform(own, lambda w: F.concat(F.lit(f"{k} "), w))  # noqa: B023
            each.append(F.when(F.contains("said", F.lit(f" {t.mandatory} ")), numbered).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.array(*each))

    files = files.where(any_phrase).withColumn("asked", F.element_at(F.transform(F.array(present), asked), 1))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    # the words asked for are bound once for a text, not worked out again for each of its words
    any_asked = F.array_distinct(F.transform("asked", lambda x: F.substring_index(x, " ", -1)))
    postings = F.element_at(F.transform(F.array(any_asked), lambda some: F.filter(placed, lambda x: F.array_contains(some, x["word"]))), 1)
    files = files.select("doc_id", "twin", base.alias("base"), "asked", postings.alias("postings"))
    # one row for each text, however often it occurs
    files = stored(files.dropDuplicates(["doc_id", "twin"]), "licence-files")

    rows = []
    for k, t in enumerate(templates):
        own = t.text.split()
        best = sorted({(weight[w], w) for w in own}, reverse=True)[:looked_up]
        whole = sum(v for v, _ in best) or 1.0
        rows += [(k, t.label, w, i, weight[w], whole) for i, w in enumerate(own)]
    index = spark.createDataFrame(rows, "template int, label string, word string, at int, v double, whole double")
    met = files.select("doc_id", "twin", "asked", F.explode("postings").alias("p")).join(F.broadcast(index), F.col("p.word") == F.col("word"))
    met = met.where(F.array_contains("asked", F.concat_ws(" ", F.col("template").cast("string"), F.col("word"))))
    lined = met.groupBy("doc_id", "twin", "template", "label", (F.col("p.pos") - F.col("at")).alias("shift"))
    lined = lined.agg(F.count("*").alias("votes"), F.sum(F.round("v", 9)).alias("v"), F.max("whole").alias("whole")).where("votes >= 2")
    found = lined.groupBy("doc_id", "twin").agg(F.collect_set("label").alias("added"), F.least(F.max(F.col("v") / F.col("whole")), F.lit(1.0)).alias("score"))
    found = found.select(F.col("doc_id").alias("d1"), F.col("twin").alias("t1"), "added", "score")

    none = F.array().cast("array<string>")
    spots = F.transform("base", lambda b: b["at"])
    plain = files.join(found, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("twin") == F.col("t1")), "left")
    plain = plain.select(
        F.col("doc_id").alias("d"),
        F.col("twin").alias("t"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(spots).cast("long").alias("first_word"),
        F.array_max(spots).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))).alias("base_labels"),
        F.coalesce("added", none).alias("added"),
        "score",
    )
    every = docs.select("doc_id", F.xxhash64("text").alias("twin"), count_words(F.col("text")).alias("n_words"))
    joined = every.join(plain, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left")
    labels = F.array_sort(F.array_union(F.coalesce("base_labels", none), F.coalesce("added", none)))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        labels.alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

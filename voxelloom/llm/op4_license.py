"""Licence scans with a positional rare-token index.

Licence templates are indexed by (word, template, position). Of each template
the positions of the words with the highest inverse document frequency, taken
over the whole corpus, are looked up in all documents, as many as no accepted
place can miss; every posting votes for the place where its template would
begin, and votes for one place add up. Every place with enough
votes is aligned with the document word by word, and the template's mandatory
phrases must stand there. Base phrases are found by patterns.

DataFrame functions only. What is broadcast is the template index (some hundred
rows) and the frequencies of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, settled, table

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label, words of a notice, and phrases that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "license 2 0")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("lesser general public license", "version 3")),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("affero general public license", "version 3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "provided that the following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("attribution 4 0",)),
    ("cc0", "creative commons zero v1 0 universal public domain dedication", ("creative commons zero",)),
)
#: Words of templates that are not indexed.
COMMON = frozenset("a and any are as at by can copy file files following for form forms free in is it may met not obtain of or org person purpose terms that the this to under use with www you either either http 0 2 3 4 v code".split())

#: Characters outside words, and in words.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Rarest positions of a template that are looked up, at least; votes, and share of equal words, that a place needs.
RARE, VOTES, AGREE = 8, 2, 0.7


def _phrase(words: str) -> str:
    """A pattern that matches nothing long, where the words stand one after another."""
    body = f"{_GAP}+".join(f"(?i:{w})" for w in words.split())
    return f"(?<!{_WORD})(?={body}(?!{_WORD}))"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _looked_up(notice: list[str], rare: int) -> int:
    """Positions of a notice that suffice: of these, an accepted place misses all but VOTES at most."""
    missed = max(k for k in range(len(notice) + 1) if (len(notice) - k) / len(notice) >= AGREE)
    return max(rare, missed + VOTES)


def licence_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=BASE_PHRASES, templates=TEMPLATES, rare: int = RARE) -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Words are runs of digits, letters and non-ASCII characters, A-Z as a-z. n_base
    counts the places of the base phrases, first_word and last_word are the first
    and last of them in words from 0 (null without any). labels adds those of the
    aligned templates. score is the highest share of equal words of an accepted
    alignment, 1 with a base phrase, else 0. A null text has no words. Rows that
    share an id keep a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()} - COMMON)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Lower-casing never makes or unmakes a separator; what it maps to ASCII besides A-Z only adds candidates.
    d = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.array_remove(F.split(F.lower(text), f"{_GAP}+", -1), "").alias("w"))
    needed = sorted({w for p, _ in phrases for w in p.split()} | set(vocabulary))
    d = d.select("id", "t", "w", F.array_intersect("w", F.array(*[F.lit(w) for w in needed])).alias("seen"))
    holds = lambda p: F.size(F.array_intersect("seen", F.array(*[F.lit(w) for w in sorted(set(p.split()))]))) == len(set(p.split()))
    places = [F.when(holds(p), _count(F.col("t"), _phrase(p))).otherwise(F.lit(0).cast("long")).alias(f"b{i}") for i, (p, _) in enumerate(phrases)]
    d = d.select("id", "t", "w", F.array_intersect("seen", F.array(*[F.lit(w) for w in vocabulary])).alias("hits"), *places)
    n_base = sum((F.col(f"b{i}") for i in range(1, len(phrases))), F.col("b0"))
    any_phrase = "|".join(_phrase(p) for p, _ in phrases)
    before = lambda much: _count(F.regexp_extract("t", f"(?s)^({much})(?:{any_phrase})", 1), f"{_WORD}+")
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.col(f"b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())))
    seen = d.select(
        F.monotonically_increasing_id().alias("row"), "id", F.size("w").cast("long").alias("n_words"), n_base.alias("n_base"), F.when(n_base > 0, before(".*?")).alias("first_word"), F.when(n_base > 0, before(".*")).alias("last_word"),
        base.alias("base"), "hits", F.when(F.size("hits") > 0, F.col("w")).alias("words"),
    )
    seen = materialize(seen, "seen", compression="zstd")
    cand = seen.where(F.size("hits") > 0)
    n_docs = seen.count()
    frequency = cand.select(F.explode("hits").alias("word")).groupBy("word").count()
    idf = frequency.select("word", F.round(F.log((F.lit(n_docs) + 1) / (F.col("count") + F.lit(0.5))) * 1000).cast("long").alias("idf"))
    index = [(w, k, j, _looked_up(t.split(), rare)) for k, (_, t, _) in enumerate(templates) for j, w in enumerate(t.split()) if w not in COMMON]
    index = spark.createDataFrame(index, "word string, template int, place int, places int")
    # A word that no document holds is the rarest.
    order = Window.partitionBy("template").orderBy(F.col("idf").desc_nulls_first(), "place")
    index = materialize(index.join(idf, "word", "left").withColumn("nth", F.row_number().over(order)).where("nth <= places").select("word", "template", "place"), "index")
    top = F.array(*[F.lit(r["word"]) for r in index.select("word").distinct().orderBy("word").collect()])
    at = cand.select("row", F.explode(F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(top, w), F.struct(w.alias("word"), i.alias("pos")))), lambda x: x.isNotNull())).alias("x")).select("row", "x.word", "x.pos")
    votes = at.join(F.broadcast(index), "word").groupBy("row", "template", (F.col("pos") - F.col("place")).alias("begin")).agg(F.count("*").alias("votes"))
    able = votes.where(F.col("votes") >= VOTES).select("row", "template", "begin")
    notices = spark.createDataFrame([(k, label, t.split(), [f" {p} " for p in must]) for k, (label, t, must) in enumerate(templates)], "template int, label string, notice array<string>, must array<string>")
    there = able.join(cand.select("row", "words"), "row").join(notices, "template")
    size = F.size("notice")
    equal = F.size(F.filter(F.sequence(F.lit(0), size - 1), lambda j: F.when((F.col("begin") + j) >= 0, F.get("words", F.col("begin") + j)) == F.get("notice", j)))
    near = F.concat(F.lit(" "), F.array_join(F.slice("words", F.greatest(F.col("begin"), F.lit(0)) + 1, size + 4), " "), F.lit(" "))
    there = there.select("row", "label", (equal / size).alias("share"), F.forall("must", lambda m: F.contains(near, m)).alias("whole"))
    found = there.where((F.col("share") >= AGREE) & F.col("whole")).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    out = seen.select("row", "id", "n_words", "n_base", "first_word", "last_word", "base").join(found, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: licence_labels(table(spark, sf_dir, "documents")), "labels")

"""License statements in text, in Spark columns only.

Phrases are found word by word. Beyond them, an exact set-similarity join finds every text block that holds
at least a share of a license template's distinct words; a block is a line with those after it, up to three in
all and to the end of the paragraph, so that wrapped statements are met whole. Words are ordered by their frequency
in the corpus, rarest first; a block and a template that share enough words share one within the first
few of each (prefix filter), the block has enough words of the templates (length filter), and what
follows the shared word on either side suffices (positional filter).
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.hosts import let
from weftline.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 0.8
LINES = 3
NO_WORD = "".join(chr(c) for c in range(128) if not chr(c).isalnum() or chr(c).isupper())

# Phrases and labels of the base rule.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Opening statements of public licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(lower: Column) -> Column:
    """Words of a lower-cased text in order."""
    bare = F.regexp_replace(lower, f"^{GAP}|{GAP}$", "")
    return F.when(F.length(bare) > 0, F.split(bare, GAP)).otherwise(F.array().cast("array<string>"))


def _strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def phrase_places(lower: Column, phrases: tuple[tuple[str, str], ...] = PHRASES) -> Column:
    """Array of (at, label): where the words of a phrase stand one after the other, from word 0."""
    typed = F.array().cast("array<struct<at:int,label:string>>")

    def one(w: Column, words: list[str], label: str) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _stand(w, i, words))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    def found(w: Column) -> Column:
        return F.concat(*(one(w, phrase.split(" "), label) for phrase, label in phrases))

    maybe = "|".join(GAP.join(phrase.split(" ")) for phrase, _ in phrases)
    return F.when(lower.rlike(maybe), let(words_of(lower), found)).otherwise(typed)


def _stand(words: Column, at: Column, phrase: list[str]) -> Column:
    """Whether the phrase's words stand from a place on."""
    tests = (F.coalesce(F.get(words, at + k) == word, F.lit(False)) for k, word in enumerate(phrase))
    return functools.reduce(operator.and_, tests)


class Index:
    """Templates as word lists in the corpus' order, with what the filters need."""

    def __init__(self, templates: tuple[tuple[str, str], ...], share: float = SHARE):
        lower = str.maketrans(UPPER, LOWER)
        word = lambda c: c.isascii() and (c.isdigit() or c.islower()) or not c.isascii()
        self.sets = [
            (label, frozenset("".join(c if word(c) else " " for c in text.translate(lower)).split()))
            for label, text in templates
        ]
        self.vocabulary = sorted(frozenset().union(*(s for _, s in self.sets)))
        self.needs = [max(1, math.ceil(share * len(s) - 1e-9)) for _, s in self.sets]

    def order(self, counts: dict[str, int]) -> None:
        self.vocabulary = sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.vocabulary)}
        self.lists = [sorted(s, key=rank.__getitem__) for _, s in self.sets]
        self.prefixes = [words[: len(words) - need + 1] for words, need in zip(self.lists, self.needs, strict=True)]

    def rows(self, spark: SparkSession) -> DataFrame:
        """(word, template_at, label, words, need): one row for each prefix word of each template."""
        made = [
            F.struct(
                F.lit(word).alias("word"), F.lit(at).alias("template_at"), F.lit(label).alias("label"),
                F.lit(i).alias("template"), _strings(words).alias("words"), F.lit(need).alias("need"),
            )
            for i, ((label, _), words, prefix, need) in enumerate(
                zip(self.sets, self.lists, self.prefixes, self.needs, strict=True)
            )
            for at, word in enumerate(prefix)
        ]
        return spark.range(1).select(F.inline(F.array(*made)))


def _lines(lower: Column) -> Column:
    return F.split(lower, "\n")


def _blocks(lower: Column, ordered: Column, least: int, lines: int) -> Column:
    """(block, held): by first line, the template words of a line and of those after it, up to a line without a word.

    Only blocks with ``least`` words, in the given order.
    """
    none = F.array().cast("array<string>")

    def reach(x: Column, i: Column, on: int) -> Column:
        line = F.get(x, i + on)
        after = reach(x, i, on + 1) if on + 1 < lines else none
        return F.when(line["worded"], F.concat(line["held"], after)).otherwise(none)

    def joined(x: Column) -> Column:
        rows = F.transform(x, lambda y, i: F.struct(i.alias("block"), F.concat(y["held"], reach(x, i, 1)).alias("held")))
        return F.transform(
            F.filter(rows, lambda r: F.size(r["held"]) >= least),
            lambda r: F.struct(r["block"].alias("block"), F.array_intersect(ordered, r["held"]).alias("held")),
        )

    each = F.transform(_lines(lower), lambda b: F.struct(
        F.array_intersect(F.split(b, GAP), ordered).alias("held"), (F.length(F.btrim(b, F.lit(NO_WORD))) > 0).alias("worded")
    ))
    return let(each, joined)


def template_words(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many lines of the corpus each word of the templates stands: one row for each such word."""
    known = _strings(vocabulary)
    held = F.transform(_lines(lowered(F.col(text))), lambda b: F.array_intersect(F.split(b, GAP), known))
    found = docs.select(F.explode(F.flatten(held)).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan(
    docs: DataFrame, text: str = "text", key: str = "doc_id",
    phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES,
    share: float = SHARE, lines: int = LINES,
) -> DataFrame:
    """(key, n_words, places, matches) for each row of ``docs``.

    ``places`` are the phrases as (at, label); ``matches`` the template hits as (block, label, contained),
    one for each block that holds a template, which may share lines.
    Null and empty texts have neither. Repeated rows, also with equal or null keys, are scanned each; an
    empty table gives no row; other columns are ignored. Gathered at the driver: one count for each
    distinct template word. Texts are read twice, once for those counts.
    """
    index = Index(templates, share)
    index.order(template_words(docs, text, index.vocabulary))
    ordered, rare = _strings(index.vocabulary), _strings(sorted({w for p in index.prefixes for w in p}))
    least = min(index.needs)
    lower = lowered(F.col(text))
    kept = F.filter(_blocks(lower, ordered, least, lines), lambda b: (F.size(b["held"]) >= least) & F.arrays_overlap(b["held"], rare))
    scanned = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        F.regexp_count(lower, F.lit(WORD)).cast("long").alias("n_words"),
        phrase_places(lower, phrases).alias("places"), kept.alias("blocks"),
    ))
    found = scanned.select("row", F.inline("blocks")).select(
        "row", "block", "held", F.size("held").alias("size"), F.posexplode("held").alias("at", "word")
    )
    # A few words for each template: the broadcast is bounded by the templates.
    met = found.join(F.broadcast(index.rows(docs.sparkSession)), "word").where(
        (F.col("size") >= F.col("need"))
        & (F.col("at") <= F.col("size") - F.col("need"))
        & (F.least(F.col("size") - F.col("at"), F.size("words") - F.col("template_at")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("held", "words"))
    exact = met.where(shared >= F.col("need")).select(
        "row", F.struct("block", "label", (shared / F.size("words")).alias("contained")).alias("hit")
    )
    hits = exact.groupBy("row").agg(F.sort_array(F.collect_set("hit")).alias("matches"))
    none = F.array().cast("array<struct<block:int,label:string,contained:double>>")
    return scanned.join(hits, "row", "left").select(
        F.col("key").alias(key), "n_words", "places", F.coalesce("matches", none).alias("matches")
    )

"""Licence scans by a positional rare-token index, in DataFrame functions only.

A template is a row of words with mandatory key phrases at fixed places. Document frequencies of the
licence vocabulary are counted over the whole corpus. The index is one inverted list for all templates: each
word that is among the rarest of some template's key phrases has its postings, (template, place in it). A file's
own indexed words, those with the highest IDF it has, are looked up where they stand; a posting turns a
place into a possible start of a template, and the starts that all postings of a template agree on are the
intersection by relative position. There the mandatory phrases are compared word for word. As indexed words come from
key phrases, no placement is missed.

All of it happens inside a row: no shuffle but the count of the vocabulary, and no hot key. The plan doesn't grow
with the number of templates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of these characters separates words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """keys: (place, number of words) of the mandatory phrases; a placement also needs the share cover of
    all its words in place. Base templates are phrases that are mandatory as a whole."""

    label: str
    text: str
    keys: tuple[tuple[int, int], ...] = ()
    cover: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrases(self) -> tuple[tuple[int, int], ...]:
        return self.keys or ((0, len(self.words)),)


# Base phrases and their labels, then names, tags, addresses and wording of public licences.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    *(Template(label, f"spdx license identifier {tag}") for label, tag in (
        ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl", "lgpl"), ("agpl", "agpl 3 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"),
        ("isc", "isc"), ("mpl-2", "mpl 2 0"), ("cc0", "cc0 1 0"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("bsl", "bsl 1 0"), ("epl-2", "epl 2 0"),
    )),
    Template("mit", "mit license"), Template("mit", "opensource org licenses mit"),
    Template("apache-2", "apache 2 0 license"), Template("apache-2", "apache license 2 0"), Template("apache-2", "apache org licenses license 2 0"),
    Template("gpl", "gnu general public license"), Template("gpl", "gnu org licenses gpl"), Template("gpl-2", "gplv2"), Template("gpl-2", "gpl version 2"), Template("gpl-3", "gplv3"), Template("gpl-3", "gpl version 3"),
    Template("lgpl", "gnu lesser general public license"), Template("lgpl", "gnu org licenses lgpl"), Template("agpl", "gnu affero general public license"), Template("agpl", "agplv3"),
    Template("mpl-2", "mozilla public license version 2"), Template("mpl-2", "mozilla org mpl 2 0"), Template("bsd", "bsd 2 clause license"), Template("bsd", "bsd 3 clause license"), Template("isc", "isc license"),
    Template("bsl", "boost software license version 1 0"), Template("epl-2", "eclipse public license v 2 0"), Template("cc0", "cc0 1 0 universal"), Template("cc0", "creativecommons org publicdomain zero 1 0"),
    Template("cc-by", "creativecommons org licenses by 4 0"), Template("cc-by-nc", "creativecommons org licenses by nc"), Template("cc-by-sa", "cc by sa"), Template("cc-by-sa", "creativecommons org licenses by sa"), Template("cc-by-nd", "creativecommons org licenses by nd"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ((2, 5), (10, 3)), 0.7),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ((1, 5), (21, 3)), 0.7),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ((3, 4), (10, 6)), 0.7),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ((2, 3), (18, 4)), 0.7),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ((2, 3), (18, 5)), 0.7),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ((1, 3), (11, 6)), 0.7),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ((0, 3), (4, 4)), 0.7),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ((2, 5), (17, 3)), 0.7),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ((0, 5), (13, 4)), 0.7),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ((2, 4),), 0.7),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", ((1, 5), (13, 3)), 0.7),
    Template("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ((8, 4), (18, 3)), 0.7),
)


def license_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; null counts as empty. lower() turns one character outside
    ASCII into an ASCII letter (the Kelvin sign), so that is replaced by another letter first."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def document_frequencies(words: DataFrame, column: str, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many documents each word of the templates occurs; "" has the number of documents.
    The result has a row for each word of the fixed templates, no more."""
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = F.array_intersect(F.col(column), F.array(*map(F.lit, vocabulary)))
    counts = words.select(F.explode(F.array_append(seen, F.lit(""))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


def rare_words(template: Template, frequency: dict[str, int], most: int = 3) -> list[tuple[int, str]]:
    """The places and words of the template's postings: the highest IDF in its key phrases, first the rarest."""
    total = frequency.get("", 0)
    idf = lambda w: math.log((1 + total) / (1 + frequency.get(w, 0)))
    at = [i for start, n in template.phrases for i in range(start, start + n)]
    return [(i, template.words[i]) for i in sorted(at, key=lambda i: (-idf(template.words[i]), i))[:most]]


@dataclass(frozen=True)
class Index:
    """The templates and their inverted list as literal columns: postings by word; by template their number, and its
    words, key phrases, least cover and label."""

    words: tuple[str, ...]
    postings: Column
    counts: Column
    templates: Column

    @staticmethod
    def of(templates: tuple[Template, ...], frequency: dict[str, int]) -> Index:
        by_word: dict[str, list[tuple[int, int]]] = {}
        rare = [rare_words(t, frequency) for t in templates]
        for number, mine in enumerate(rare):
            for place, word in mine:
                by_word.setdefault(word, []).append((number, place))
        posting = lambda t, p: F.struct(F.lit(t).alias("template"), F.lit(p).alias("place"))
        postings = F.create_map(*(x for w in sorted(by_word) for x in (F.lit(w), F.array(*(posting(t, p) for t, p in by_word[w])))))
        phrase = lambda at, n: F.struct(F.lit(at).alias("at"), F.lit(n).alias("n"))
        rows = [
            F.struct(
                F.array(*map(F.lit, t.words)).alias("words"), F.array(*(phrase(at, n) for at, n in t.phrases)).alias("phrases"),
                F.lit(float(t.cover)).alias("cover"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
            )
            for t in templates
        ]
        return Index(tuple(sorted(by_word)), postings, F.array(*(F.lit(len(r)) for r in rare)), F.array(*rows))

    def candidates(self, words: str, hits: str) -> Column:
        """The distinct (template, start) that all postings of the template agree on: the postings at the places in
        hits are turned to starts and sorted, and a start counts if it comes as often as the template has postings."""
        voted = F.flatten(F.transform(hits, lambda at: F.transform(F.element_at(self.postings, F.get(words, at)), lambda p: F.struct(p["template"].alias("template"), (at - p["place"]).alias("start")))))
        votes = F.array_sort(F.filter(voted, lambda v: v["start"] >= 0))
        fits = lambda v, i: (F.get(votes, i + F.element_at(self.counts, v["template"] + 1) - 1) == v) & F.coalesce(F.get(votes, i - 1) != v, F.lit(True))
        return F.filter(votes, lambda v, i: F.coalesce(fits(v, i), F.lit(False)))

    def placed(self, words: str, candidates: str) -> Column:
        """The candidates whose key phrases, and the share cover of all words, are in place, by template and start."""

        def described(x: Column) -> Column:
            c, t = x["candidate"], x["of"]
            there = F.slice(words, c["start"] + 1, F.size(t["words"]))
            keys = F.forall(t["phrases"], lambda p: F.slice(there, p["at"] + 1, p["n"]) == F.slice(t["words"], p["at"] + 1, p["n"]))
            same = F.zip_with(there, t["words"], lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
            matched = F.aggregate(same, F.lit(0), lambda s, x: s + x)
            share = matched / F.size(t["words"])
            return F.struct(
                c["template"].alias("template"), t["label"].alias("label"), t["base"].alias("base"), c["start"].cast("long").alias("start"), share.alias("cover"),
                (matched / (F.size(t["words"]) + 1)).alias("weight"), (keys & (share >= t["cover"])).alias("holds"),
            )

        whole = F.transform(candidates, lambda c: F.struct(c.alias("candidate"), F.element_at(self.templates, c["template"] + 1).alias("of")))
        holding = F.filter(F.transform(whole, described), lambda x: F.coalesce(x["holds"], F.lit(False)))
        return F.transform(holding, lambda x: x.dropFields("holds"))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Rows (key, n_words, placements array<struct<template, label, base, start, cover, weight>>) for each row: every
    place of a template in the whole text, by template and start, counted in words from 0. cover is the share
    of the template's words in place; weight is that of long wordings more than of short names: words in place
    by one more than the template has.

    Null and empty texts have no words. Repeated rows each give a row, a null key is kept, other columns
    are left out. An empty table gives no rows.
    """
    words = docs.select(F.col(key), license_words(F.col(text)).alias("words"))
    index = Index.of(templates, document_frequencies(words, "words", templates))
    known = F.array(*map(F.lit, index.words))
    at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(*index.words), i)))
    located = words.select(key, "words", F.when(F.arrays_overlap("words", known), at).alias("hits"))
    found = located.select(key, "words", F.when(F.size("hits") > 0, index.candidates("words", "hits")).alias("candidates"))
    kind = "array<struct<template:int,label:string,base:boolean,start:bigint,cover:double,weight:double>>"
    places = F.when(F.size("candidates") > 0, index.placed("words", "candidates")).otherwise(F.array().cast(kind))
    return found.select(key, F.size("words").cast("long").alias("n_words"), places.cast(kind).alias("placements"))


def label_list(places: Column) -> Column:
    """The distinct labels of placements, sorted and comma-joined."""
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))))

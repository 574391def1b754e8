"""License scan by a positional index of rare words, in SQL functions only.

Templates (notices and phrases) have a posting, template and position, for each of their words. Words
are ranked by their document frequency over the corpus. For every template, a file's rarest words
that have postings in it are looked up; each of their places in the file minus a place in the
template is a relative position, and where two different words agree on one the template may lie.
Such a place counts if the template's mandatory key phrases stand there, up to ``slack`` words off.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 4
AGREEING = 2


@dataclass(frozen=True)
class Template:
    """A text to find. ``phrases`` are parts of it that have to be there; all of it, unless given."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    slack: int = 0
    base: bool = False
    words: list[str] = field(init=False, compare=False)
    keys: list[tuple[int, list[str]]] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        words = template_words(self.text)
        if len(set(words)) < AGREEING:
            raise ValueError(f"a template needs {AGREEING} different words: {self.text}")
        keys = []
        for phrase in map(template_words, self.phrases or (self.text,)):
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            keys.append((at, phrase))
        object.__setattr__(self, "words", words)
        object.__setattr__(self, "keys", keys)


def template_words(text: str) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.split(NOT_A_WORD, lower) if w]


# Phrases of the base labels, and the wording of public license notices.
BASE = [
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
]
NOTICES = [
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
        slack=8,
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        ("you may not use this file except in compliance with the license",),
        slack=8,
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    Template(
        "gpl",
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation",
        ("you can redistribute it and or modify it", "general public license as published by"),
        slack=8,
    ),
    Template("gpl-2.0", "GNU General Public License, version 2"),
    Template("gpl-3.0", "GNU General Public License, version 3"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
        slack=8,
    ),
    Template(
        "bsd-3-clause",
        "may be used to endorse or promote products derived from this software without specific "
        "prior written permission",
        ("endorse or promote products derived from", "prior written permission"),
        slack=8,
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ("for any purpose with or without fee is hereby granted",),
        slack=4,
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license v 2 0",),
    ),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("mit", "SPDX-License-Identifier: MIT"),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
]
TEMPLATES = BASE + NOTICES


def words_of(text: str) -> Column:
    """The words of a column of texts in order; none for null."""
    text = F.coalesce(F.col(text), F.lit(""))
    other = F.translate(text, ascii_uppercase, ascii_lowercase)
    # Of ASCII texts the cheaper lower() gives the same.
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(other)
    return F.array_remove(F.split(lower, NOT_A_WORD), "")


def _list(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _once(words: list[str]) -> list[str]:
    return sorted(set(words))


def frequencies(docs: DataFrame, templates: list[Template] = TEMPLATES) -> dict[str, int]:
    """In how many texts of ``docs`` each word of the templates occurs; as many rows as words."""
    index = _list(_once([w for t in templates for w in t.words]))
    found = docs.select(F.explode(F.array_intersect(index, words_of("text"))).alias("word"))
    return {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _anchored(t: Template, ranked: list[str], words: Column, present: Column) -> Column:
    """Relative positions in order on which two of the file's rarest words of a template agree."""
    own = [w for w in ranked if w in set(t.words)]
    anchors = F.slice(F.array_intersect(_list(own), present), 1, ANCHORS)
    places = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    postings = F.array(
        *(
            F.struct(F.lit(w).alias("w"), F.array(*(F.lit(i) for i, x in enumerate(t.words) if x == w)).alias("at"))
            for w in own
        )
    )

    def of(anchor: Column, found: Column) -> Column:
        at = F.filter(postings, lambda x: x["w"] == anchor)[0]["at"]
        mine = F.filter(found, lambda p: p["w"] == anchor)
        each = F.transform(mine, lambda p: F.transform(at, lambda q: p["i"] - q))
        return F.array_distinct(F.flatten(each))

    def agreeing(every: Column) -> Column:
        before = AGREEING - 1  # each anchor brings a position once, so equal ones are of several
        twice = F.filter(every, lambda p, i: (i >= before) & (F.get(every, i - before) == p))
        return F.array_distinct(twice)

    def positions(looked_up: Column) -> Column:
        found = F.filter(places, lambda p: F.array_contains(looked_up, p["w"]))
        every = _let(found, lambda f: F.flatten(F.transform(looked_up, lambda w: of(w, f))))
        return _let(F.array_sort(every), agreeing)

    return _let(anchors, positions)


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    inside = (at >= 0) & (at + len(phrase) <= F.size(words))
    return F.when(inside, F.slice(words, at + 1, F.lit(len(phrase))) == _list(phrase)).otherwise(False)


def _verified(t: Template, words: Column, position: Column) -> Column:
    """Whether all key phrases stand at a relative position, each up to ``slack`` words off."""
    shifts = F.array(*(F.lit(d) for d in range(-t.slack, t.slack + 1)))

    def found(at: int, phrase: list[str]) -> Column:
        if not t.slack:
            return _stands(words, position + at, phrase)
        return F.exists(shifts, lambda d: _stands(words, position + d + at, phrase))

    return reduce(and_, (found(at, phrase) for at, phrase in t.keys))


def _in_place(t: Template, words: Column, position: Column) -> Column:
    """How many of a template's words stand in their place."""
    own = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(t.words)))
    return F.size(F.filter(own, lambda x: F.get(words, position + x["i"]) == x["w"]))


_MATCH = "array<struct<label:string,base:boolean,at:array<int>,share:double>>"


def _match(t: Template, ranked: list[str], words: Column, present: Column) -> Column:
    """One template's label, its places in a file, and the largest share of it found in place."""
    needed = _once([w for _, phrase in t.keys for w in phrase])
    all_there = F.size(F.array_intersect(_list(needed), present)) == len(needed)
    places = _let(
        _anchored(t, ranked, words, present),
        lambda found: F.filter(found, lambda p: _verified(t, words, p)),
    )
    whole = float(len(t.words)) * (2 if t.base else 1)
    return F.when(
        all_there,
        _let(
            places,
            lambda at: F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                at.alias("at"),
                (F.array_max(F.transform(at, lambda p: _in_place(t, words, p))) / whole).alias("share"),
            ),
        ),
    )


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Return doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score per row.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts have no words:
    counts of 0, null places, empty labels, score 0. n_base counts all places of the base templates, and
    first_word and last_word are the smallest and largest. labels are those of all templates found.
    score is the largest share of a notice's words in their places, or 0.5 for a base phrase alone.
    Equal rows have equal results, each its own. An empty table gives an empty result. One scan counts the
    words' documents, a second one matches; nothing but the counts is shuffled.
    """
    n = frequencies(docs, templates)
    ranked = sorted(n, key=lambda w: (n[w], w))
    rows = docs.select("doc_id", words_of("text").alias("words"))
    possible = [t for t in templates if all(w in n for _, phrase in t.keys for w in phrase)]
    found = F.array().cast(_MATCH)
    if possible:

        def matches(words: Column, present: Column) -> Column:
            return F.array(*(_match(t, ranked, words, present) for t in possible))

        present = F.array_intersect(_list(ranked), "words")
        found = _let(present, lambda there: matches(F.col("words"), there))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.filter(found, lambda m: F.size(m["at"]) > 0).alias("found"),
    )
    base = F.filter("found", lambda m: m["base"])
    at = F.flatten(F.transform(base, lambda m: m["at"]))

    def listed(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")

    return rows.select(
        "doc_id",
        "n_words",
        F.size(at).cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


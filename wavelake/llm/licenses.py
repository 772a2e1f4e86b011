"""Licence notices by a positional index of rare words, in DataFrame expressions alone.

A template is a notice's words; its postings are their positions. The number of documents that hold each word of any
template is counted over all documents (one row a word reaches the driver), which ranks the words by inverse document frequency.
For each template a file's highest-ranked words of it are looked up: where most of them stand at one relative position
(up to SLACK words apart), the template is placed, and a placement counts once its mandatory phrases stand inside it.
As few of them may be missing, the first one or two name all positions that can do; one pass over a file's words finds these for all templates.

All of that happens within a row: the count of words is the only shuffle, of a row for each word and task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that give a label wherever their words stand consecutively.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: label, words of the notice, mandatory phrases. The opening sentences of public licence notices.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     ("redistribution and use", "source and binary forms")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     ("gnu general public license", "free software foundation")),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
     ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "v 2")),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("any purpose with or without fee",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Words of a template that are looked up in a file, the hundredths of them that must stand in place, and the words they may be off.
RARE, SHARE, SLACK = 6, 80, 2


def text_words(text: Column) -> Column:
    """Words of a whole text: A-Z in lower case, runs of other characters than GAP; none of a null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)  # else lower() would change other letters too, the Kelvin sign into a k
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, GAP), "")  # before a first and after a last gap


def _words(values) -> Column:
    return F.expr(f"cast({_array(values)} as array<string>)")


def _array(values) -> str:
    """A literal array of plain words in SQL."""
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def starts(phrase: str) -> str:
    """Positions in ``words``, from 0, at which those of a phrase stand consecutively (SQL)."""
    parts = phrase.split()
    stands = " AND ".join(f"words[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return f"if(size(words) >= {len(parts)}, filter(sequence(0, size(words) - {len(parts)}), i -> {stands}), cast(array() as array<int>))"


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def document_counts(df: DataFrame, text: str, templates=TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the templates occurs; words that occur in none are left out."""
    held = df.select(F.explode(F.array_intersect(text_words(F.col(text)), _words(vocabulary(templates)))).alias("w"))
    return {r.w: r.n for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # the vocabulary at most


WIDTH = 2 * SLACK + 1


def anchors(rare: str, looked_up: int, least: int) -> str:
    """The first of a file's ``rare`` words, so many that ``least`` of them cannot stand in place without one of these (SQL)."""
    return f"if(size({rare}) = {looked_up}, slice({rare}, 1, {looked_up - least + 1}), cast(array() as array<string>))"


def postings(words: str, notice: str) -> str:
    """Some words of a notice with their positions in it: array of (w, at) in SQL."""
    own = notice.split()
    held = "map(" + ", ".join(f"'{w}', array({', '.join(str(p) for p, v in enumerate(own) if v == w)})" for w in sorted(set(own))) + ")"
    return f"transform({words}, w -> struct(w, {held}[w] AS at))"


def placements(known: str, looked_up: int, least: int) -> str:
    """Cells of offsets at which ``least`` of a file's ``looked_up`` rare words stand as in the template: array of (lo, n) in SQL.

    A word at i that the template has at p votes for the offset i - p; offsets fall into cells of WIDTH, from lo on, in two layouts that are
    SLACK apart, so near offsets share a cell of one of them. Cells are named by the votes of the anchors, whose positions
    ``near`` holds; in each, the rare words (``known``, with their postings) are looked up where the template has them."""
    named = looked_up - least + 1
    cells = f"array(i - p - pmod(i - p, {WIDTH}), i - p - pmod(i - p + {SLACK}, {WIDTH}))"
    votes = f"transform(slice({known}, 1, {named}), v -> flatten(transform(filter(near, i -> words[i] = v.w), i -> flatten(transform(v.at, p -> {cells})))))"
    place = f"if(lo + p >= 0, slice(words, lo + p + 1, {WIDTH}), slice(words, 1, greatest({WIDTH} + lo + p, 0)))"
    stands = f"exists(v.at, p -> array_contains({place}, v.w))"
    # of the anchors and one more word at least two stand in place (of one word one)
    likely = f"filter(array_distinct(flatten({votes})), lo -> size(filter({known}, (v, k) -> k <= {named} AND {stands})) >= {min(2, least)})"
    return f"filter(transform({likely}, lo -> struct(lo, size(filter({known}, v -> {stands})) AS n)), a -> a.n >= {least})"


def judged(cells: str, notice: str, phrases: tuple[str, ...], looked_up: int) -> str:
    """ok and share of each placement (SQL): whether all phrases stand among the words that a template of the cell's offsets
    can cover, and the share of the looked-up words that stand in place."""
    span = f"concat(' ', array_join(slice(words, greatest(a.lo - {SLACK}, 0) + 1, {len(notice.split()) + WIDTH + 2 * SLACK}), ' '), ' ')"
    ok = " AND ".join(f"contains({span}, ' {p} ')" for p in phrases)
    return f"transform({cells}, a -> struct({ok} AS ok, a.n / {float(looked_up)}D AS share))"


def scan_licenses(df: DataFrame, text: str = "text", templates=TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """All rows and columns of df with n_words, n_base, first_word, last_word, base_labels, labels, score (columns of these names are replaced).

    n_base counts the places of the base phrases, first_word and last_word are their smallest and largest start (null without any).
    base_labels are theirs, labels also those of the templates placed and verified; distinct, sorted, joined by commas, empty
    if there are none. score is 1 with a base label, else the largest share of looked-up words in place over the templates, halved for
    those whose phrases are missing, 0 without a placement. A null text is an empty one; repeated rows are rows, an empty table stays empty.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in df.columns if c not in added]
    counts = document_counts(df, text, templates)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text_words(F.col(f"`{text}`")).alias("words"))
    held = packed.withColumn("present", F.array_intersect("words", _words(vocabulary(templates))))
    places, rare, named, known, at, found = {}, {}, {}, {}, {}, {}
    for i, phrase in enumerate(base):
        parts = sorted(set(phrase.split()))
        places[f"base{i}"] = F.expr(f"if(size(array_intersect(present, {_array(parts)})) = {len(parts)}, {starts(phrase)}, cast(array() as array<int>))")
    for i, (_, notice, phrases) in enumerate(templates):
        ranked = sorted(set(notice.split()), key=lambda w: (counts.get(w, 0), w))  # fewest documents first: the highest inverse frequency
        looked_up = min(RARE, len(ranked))
        least = -(-looked_up * SHARE // 100)
        enough = (F.size("present") >= looked_up) & (F.array_contains("present", ranked[0]) if looked_up == len(ranked) else F.lit(True))
        rare[f"rare{i}"] = F.when(enough, F.slice(F.array_intersect(_words(ranked), F.col("present")), 1, looked_up)).otherwise(_words(()))
        named[f"named{i}"] = F.expr(anchors(f"rare{i}", looked_up, least))
        known[f"known{i}"] = F.expr(postings(f"if(size(rare{i}) = {looked_up}, rare{i}, cast(array() as array<string>))", notice))
        spots = placements(f"known{i}", looked_up, least)
        at[f"at{i}"] = F.expr(f"if(size(known{i}) > 0, {spots}, cast(array() as array<struct<lo:int,n:int>>))")
        found[f"found{i}"] = F.expr(judged(f"at{i}", notice, phrases, looked_up))
    held = held.withColumns(places | rare).withColumns(named | known).withColumn("sought", F.array_distinct(F.flatten(F.array(*[F.col(c) for c in named]))))
    # one pass over the words for all templates
    near = f"array_remove(transform(words, (w, i) -> if(w IN ({', '.join(repr(w) for w in vocabulary(templates))}) AND array_contains(sought, w), i, -1)), -1)"
    held = held.withColumn("near", F.expr(f"if(size(sought) > 0, {near}, cast(array() as array<int>))")).withColumns(at).withColumns(found)

    every = F.concat(*[F.col(c) for c in places])
    based = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(v)) for c, v in zip(places, base.values(), strict=True)]))
    more = F.array_compact(F.array(*[F.when(F.exists(c, lambda f: f.ok), F.lit(t[0])) for c, t in zip(found, templates, strict=True)]))
    best = F.greatest(F.lit(0.0), *[F.coalesce(F.array_max(F.transform(c, lambda f: F.when(f.ok, f.share).otherwise(f.share / 2))), F.lit(0.0)) for c in found])
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    out = held.select("row", F.size("words").cast("bigint").alias("n_words"), F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"),
                      F.array_max(every).cast("bigint").alias("last_word"), text_of(based).alias("base_labels"), text_of(F.concat(based, more)).alias("labels"),
                      F.when(F.size(every) > 0, F.lit(1.0)).otherwise(best).alias("score"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *added)

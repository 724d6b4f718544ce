"""Licence scans over a positional index of rare words, in DataFrame functions only.

Licence notices are templates of words. Every document keeps the places of words
that occur in templates; how many documents hold a word, counted over all of them,
says how rare it is. The index has the places of each template's rarest words.
A document looks up its own rarest licence words there: each of their places votes
for where a template would have to start, and a start on which several agree is a
candidate. It counts if the template's mandatory phrase stands in its place; its
score is the share of the template's words that do.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernmill.llm.quality import let
from fernmill.llm.scratch import written

#: Rare words that a document looks up, rare words that the index has of a template, places that must agree on a start.
LOOKED_UP, INDEXED, MIN_AGREED = 16, 8, 2
#: Share of a template's words in place that gives its label.
MIN_SHARE = 0.6

# Phrases and their labels; wording of licence notices as (label, mandatory phrase, text).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "permission is hereby granted free of charge", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("gpl", "general public license", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gnu general public license as published", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "lesser general public license", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "free and unencumbered software", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "cc by nc 4 0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "creative commons attribution 4 0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

#: What separates words once A-Z is lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one other letter whose lower case is ASCII, and a letter of the same kind to stand for it.
KELVIN, PLAIN = "K", "é"
#: Words have fewer codes than this; a place is CODES * position + code.
CODES = 1_024


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


@dataclass(frozen=True)
class Template:
    """A notice: its label, its words, and where its mandatory phrase is."""

    label: str
    words: tuple[str, ...]
    phrase: range


def template(label: str, phrase: str, text: str) -> Template:
    words, key = words_of(text), words_of(phrase)
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return Template(label, tuple(words), range(at, at + len(key)))


def vocabulary(templates: list[Template]) -> list[str]:
    """Words of all templates and phrases; a word's code is its place here."""
    return sorted({w for t in templates for w in t.words} | {w for p in PHRASES for w in p.split()})


def places(text: Column, words: list[str]) -> Column:
    """The number of words of a text, and the places of those of a vocabulary."""
    body = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(PLAIN)))
    own = F.filter(F.split(body, SEPARATOR), lambda w: w != "")
    known = F.array(*map(F.lit, words))
    code = lambda w, i: F.when(w.isin(words), i.cast("long") * CODES + F.array_position(known, w) - 1)
    return let(own, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.array_compact(F.transform(ws, code)).alias("hits")))


def phrase_starts(hits: Column, words: list[str]) -> Column:
    """Places of the first words of phrases whose words stand consecutively."""

    def starts(h: Column, j: Column) -> Column:
        found = F.lit(False)
        for phrase in PHRASES:
            codes = [words.index(w) for w in phrase.split()]
            own = h % CODES == codes[0]
            for k, code in enumerate(codes[1:], 1):
                own &= F.coalesce(F.get(hits, j + k) == h + k * CODES - codes[0] + code, F.lit(False))
            found |= own
        return found

    return F.filter(hits, starts)


def rarest_first(marked: DataFrame, words: list[str]) -> list[int]:
    """Codes of the vocabulary by how few documents hold them, ties by code. One row a word comes to the driver."""
    held = marked.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h % CODES))).alias("code")).groupBy("code").count().collect()
    count = {r["code"]: r["count"] for r in held}
    return sorted(range(len(words)), key=lambda c: (count.get(c, 0), c))


def _literal(rows: list[list[int]]) -> Column:
    """Rows of numbers as an array of arrays."""
    return F.expr("array(" + ", ".join("cast(array(" + ", ".join(map(str, r)) + ") as array<bigint>)" for r in rows) + ")")


#: A vote is 4 * ((template << START_BITS) + start + SHIFT), with 2 added for words of the mandatory phrase and 1 for looked-up words.
START_BITS, SHIFT = 40, CODES


def _postings(templates: list[Template], words: list[str], chosen: Callable[[int, str], bool]) -> Column:
    """For each code, votes of a word at position 0."""
    votes: list[list[int]] = [[] for _ in words]
    for t, x in enumerate(templates):
        for p, w in enumerate(x.words):
            if chosen(t, w):
                votes[words.index(w)].append(4 * ((t << START_BITS) + SHIFT - p) + 2 * (p in x.phrase))
    return _literal(votes)


def _votes(hits: Column, postings: Column) -> Column:
    return F.flatten(F.transform(hits, lambda h: F.transform(F.get(postings, (h % CODES).cast("int")), lambda v: v + 4 * F.shiftright(h, 10))))


def _found(votes: Column, templates: list[Template]) -> Column:
    """Over sorted votes: a bit for each template found, and the best share of words in place."""
    size, phrase = (F.array(*map(F.lit, x)) for x in ([len(t.words) for t in templates], [len(t.phrase) for t in templates]))
    need = F.array(*(F.lit(-(-int(100 * MIN_SHARE) * len(t.words) // 100)) for t in templates))
    start = F.struct(F.lit(-1).cast("long").alias("k"), *(F.lit(0).alias(c) for c in ("n", "agreed", "said")), F.lit(0).cast("long").alias("bits"), F.lit(0.0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        k, same = F.shiftright(v, 2), a["k"] == F.shiftright(v, 2)
        more = lambda c, x: (F.when(same, a[c]).otherwise(F.lit(0)) + x).cast("int").alias(c)
        now = F.struct(k.alias("k"), more("n", F.lit(1)), more("agreed", v % 2), more("said", F.shiftright(v, 1) % 2), F.shiftright(k, START_BITS).cast("int").alias("t"))

        def judged(x: Column) -> Column:
            holds = (x["agreed"] >= MIN_AGREED) & (x["said"] == F.get(phrase, x["t"]))
            bit = F.when(holds & (x["n"] >= F.get(need, x["t"])), F.call_function("shiftleft", F.lit(1).cast("long"), x["t"])).otherwise(F.lit(0))
            share = F.when(holds, x["n"] / F.get(size, x["t"])).otherwise(F.lit(0.0))
            return F.struct(x["k"].alias("k"), x["n"].alias("n"), x["agreed"].alias("agreed"), x["said"].alias("said"), a["bits"].bitwiseOR(bit).alias("bits"), F.greatest(a["best"], share).alias("best"))

        return let(now, judged)

    return F.aggregate(votes, start, step, lambda a: F.struct(a["bits"].alias("bits"), a["best"].alias("best")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one for each row of ``docs``.

    Words are runs of digits, letters and all beyond ASCII, A-Z lower-cased.
    n_base counts the places of the phrases, first_word and last_word are the
    least and greatest word that one starts at (null without). labels has
    base_labels and those of templates of which ``MIN_SHARE`` of the words are in
    place around the mandatory phrase; score is the greatest such share, 0 without
    a candidate. A null text is empty; ids may be null or repeat, each row is
    judged by itself; other columns are ignored; an empty table gives no rows.
    At most 60 templates of fewer than 1,024 different words are taken.
    """
    known = [template(*x) for x in templates]
    words = vocabulary(known)
    if len(words) >= CODES or len(known) > 60 or max(len(t.words) for t in known) > SHIFT:
        raise ValueError("too many licence words or templates")
    read = docs.select(F.col(doc_id).alias("doc_id"), places(F.col(text), words).alias("x"))
    marked = written(read.select("doc_id", "x.n_words", "x.hits"), "licence-words")

    order = rarest_first(marked, words)
    rank = {words[c]: i for i, c in enumerate(order)}
    index = [set(sorted(set(t.words), key=rank.__getitem__)[:INDEXED]) for t in known]
    rare = _postings(known, words, lambda t, w: w in index[t])
    every = _postings(known, words, lambda t, w: True)
    indexed = _literal([[t for t, own in enumerate(index) if w in own] for w in words])

    own = F.slice(F.array_intersect(F.array(*(F.lit(c).cast("long") for c in order)), F.transform("hits", lambda h: h % CODES)), 1, LOOKED_UP)
    looked = marked.withColumn("own", own)
    is_own = lambda h: F.array_contains("own", h % CODES)
    starts = F.transform(_votes(F.filter("hits", is_own), rare), lambda v: F.shiftright(v, 2))
    agree = let(F.sort_array(starts), lambda s: F.exists(F.zip_with(s, F.slice(s, MIN_AGREED, F.greatest(F.size(s), F.lit(1))), lambda a, b: a == b), lambda x: x))
    # A looked-up word counts as agreeing with the templates that the index has it for.
    marked_votes = lambda h: F.transform(F.get(every, (h % CODES).cast("int")), lambda v: v + 4 * F.shiftright(h, 10) + F.when(is_own(h) & F.array_contains(F.get(indexed, (h % CODES).cast("int")), F.shiftright(v, START_BITS + 2)), 1).otherwise(0))
    found = F.when(agree, _found(F.sort_array(F.flatten(F.transform("hits", marked_votes))), known))
    base = let(F.col("hits"), lambda h: phrase_starts(h, words))
    out = looked.withColumn("found", found).withColumn("base", base)

    names = F.create_map(*(F.lit(x) for p, label in PHRASES.items() for x in (words.index(p.split()[0]), label)))
    base_labels = F.array_distinct(F.transform("base", lambda h: F.element_at(names, (h % CODES).cast("int"))))
    bits = F.coalesce(F.col("found.bits"), F.lit(0))
    own_labels = F.array_compact(F.array(*(F.when(bits.bitwiseAND(F.lit(1 << t)) != 0, F.lit(x.label)) for t, x in enumerate(known))))
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    at = lambda k: F.shiftright(F.try_element_at("base", F.lit(k)), 10).alias("first_word" if k == 1 else "last_word")
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), at(1), at(-1), joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, own_labels)).alias("labels"), F.coalesce("found.best", F.lit(0.0)).alias("score"))


def _sql() -> str:
    """The query in DuckDB's SQL: every place of a word joined with every place of a template."""
    known = [template(*x) for x in TEMPLATES]
    words = vocabulary(known)
    rows = lambda xs: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in x) + ")" for x in xs)
    notices = rows((t, x.label, len(x.words), -(-int(100 * MIN_SHARE) * len(x.words) // 100), len(x.phrase)) for t, x in enumerate(known))
    spots = rows((t, p, w, str(p in x.phrase).upper()) for t, x in enumerate(known) for p, w in enumerate(x.words)).replace("'TRUE'", "TRUE").replace("'FALSE'", "FALSE")
    pair = lambda label, *ws: f"SELECT h0.rid, h0.i, '{label}' AS label FROM hits h0 " + " ".join(f"JOIN hits h{k} ON h{k}.rid = h0.rid AND h{k}.i = h0.i + {k} AND h{k}.w = '{w}'" for k, w in enumerate(ws) if k) + f" WHERE h0.w = '{ws[0]}'"
    phrases = " UNION ALL ".join(pair(label, *p.split()) for p, label in PHRASES.items())
    return rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
notices(t, label, size, need, phrase) AS (VALUES {notices}),
spots(t, p, w, said) AS (VALUES {spots}),
vocabulary(code, w) AS (VALUES {rows(enumerate(words))}),
hits AS MATERIALIZED (
  SELECT rid, i, w FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM texts) WHERE w IN (SELECT w FROM vocabulary)),
ranks AS (
  SELECT v.w, row_number() OVER (ORDER BY coalesce(n, 0), code) AS r
  FROM vocabulary v LEFT JOIN (SELECT w, count(DISTINCT rid) AS n FROM hits GROUP BY w) c USING (w)),
indexed AS (SELECT t, w FROM (SELECT DISTINCT t, w FROM spots) JOIN ranks USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY r) <= {INDEXED}),
own AS (SELECT rid, w FROM (SELECT DISTINCT rid, w FROM hits) JOIN ranks USING (w) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY r) <= {LOOKED_UP}),
starts AS (
  SELECT h.rid, s.t, h.i - s.p AS at, count(*) AS n, count(*) FILTER (WHERE o.w IS NOT NULL AND x.w IS NOT NULL) AS agreed, count(*) FILTER (WHERE s.said) AS said
  FROM hits h JOIN spots s USING (w) LEFT JOIN own o ON o.rid = h.rid AND o.w = h.w LEFT JOIN indexed x ON x.t = s.t AND x.w = h.w
  GROUP BY ALL),
found AS (SELECT rid, label, n >= need AS enough, n / size AS share FROM starts JOIN notices USING (t) WHERE agreed >= {MIN_AGREED} AND said = phrase),
base AS ({phrases}),
labels AS (SELECT rid, label FROM base UNION SELECT rid, label FROM found WHERE enough)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(all_labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts
LEFT JOIN (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY rid) USING (rid)
LEFT JOIN (SELECT rid, string_agg(label, ',' ORDER BY label) AS all_labels FROM labels GROUP BY rid) USING (rid)
LEFT JOIN (SELECT rid, max(share) AS score FROM found GROUP BY rid) USING (rid)
"""


SQL = _sql()

"""Licence scans by a positional rare-token index (native).

A template is a licence notice with mandatory key phrases at their offsets. The document frequency of every template
word is counted over all documents. For each document, the key phrases of which it has all words are in question; the
document's words to look up are their words of highest IDF, two a phrase. Each place of such a word is turned, by the
posting (word, phrase, offset), into the start that the phrase would have; the starts of a phrase's two postings are
intersected, and on those where both agree the phrase is verified word for word. Every place of a phrase holds both
its postings, so the search loses none. A template is found where its first key phrase stands and all others stand at
their relative positions, give or take ``SLACK`` words; its share of words that stand at their own place is the
place's score.

Everything happens inside the document's row; the only exchange is the count of template words, which has as
many groups as the templates have words. The bound of what reaches the driver is the templates' size.

Defined results: null or empty text gives no words, no places, empty labels and score 0; a document that names no
template but speaks of licences has score ``MENTIONED``; repeated rows are scanned each for itself; words are numbered
from 0 over the whole text; an empty table gives no rows; the input's columns come back in a struct, so extra ones
can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_GAP, clean_columns, read

#: Words by which a key phrase may be shifted against the template's first one.
SLACK = 10
MENTIONED = 0.25


@dataclass(frozen=True)
class Template:
    """``keys``: (offset in ``words``, words) of the mandatory phrases, the first one first."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool = False


def _t(label: str, text: str, *keys: str, base: bool = False) -> Template:
    words = tuple(text.split())
    phrases = [tuple(k.split()) for k in keys or (text,)]
    at = [next(i for i in range(len(words)) if words[i : i + len(k)] == k) for k in phrases]
    return Template(label, words, tuple(zip(at, phrases)), base)


_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_GNU_KEYS = ("it under the terms of the gnu {}", "either version {} of the license")


def _gnu(label: str, name: str, version: str) -> Template:
    return _t(label, _GNU.format(name, version), *[k.format(name if "{}" in k and "gnu" in k else version) for k in _GNU_KEYS])


TEMPLATES = (
    _t("mit", "under the mit license", base=True),
    _t("apache-2", "apache license version 2", base=True),
    _t("cc-by-nc", "cc by nc", base=True),
    _t(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge", "to use copy modify merge publish distribute sublicense",
    ),
    _t(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "licensed under the apache license", "you may not use this file except in compliance with the license",
    ),
    _gnu("gpl-3", "general public license", "3"),
    _gnu("gpl-2", "general public license", "2"),
    _gnu("lgpl-3", "lesser general public license", "3"),
    _gnu("lgpl-2", "lesser general public license", "2"),
    _gnu("agpl-3", "affero general public license", "3"),
    _t("gpl-3", "gnu general public license version 3"),
    _t("gpl-2", "gnu general public license version 2"),
    _t("lgpl", "gnu lesser general public license"),
    _t("agpl-3", "gnu affero general public license"),
    _t(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms", "provided that the following conditions are met",
    ),
    _t(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "nor the names of its contributors", "may be used to endorse or promote products derived from this software",
    ),
    _t("bsd", "under the bsd license"),
    _t(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file",
    ),
    _t("mpl-2", "mozilla public license version 2"),
    _t(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software for any purpose", "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    _t(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        "free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
    _t("cc0", "cc0 1 0 universal"),
    _t("cc-by", "creative commons attribution"),
    _t("cc-by-sa", "cc by sa"),
    _t("cc-by-nd", "cc by nd"),
    _t("epl", "eclipse public license"),
    _t("proprietary", "all rights reserved"),
)
#: Words that speak of a licence without naming one.
MENTIONS = ("license", "licensed", "licence", "licenced", "copyright")


def license_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (a struct of the input's columns), ``words`` (may begin and end with an empty string), ``lead`` and
    ``n_words``.

    Only A-Z must be lowered. ``lower`` turns just one other character into ASCII, the Kelvin sign, which is
    replaced by another letter first; other letters' case has no effect on where ASCII words stand.
    """
    low = F.lower(F.replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("\u212a"), F.lit("ĸ")))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.split(low, ALNUM_GAP).alias("words"))
    w = F.col("words")
    blank = lambda x: F.when(x == "", 1).otherwise(0)
    df = df.withColumn("lead", blank(F.get(w, F.lit(0))))
    n = F.size(w) - F.col("lead") - F.when(F.size(w) > 1, blank(F.get(w, F.size(w) - 1))).otherwise(0)
    return df.withColumn("n_words", n.cast("long"))


def lexicon(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for _, k in t.keys for w in k})


def _lits(words) -> Column:
    return F.array(*map(F.lit, words))


def document_frequencies(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Over all documents: their number, and for each word of a key phrase how many of them hold it."""
    known = lexicon(templates)
    held = F.array_intersect(_lits(known), F.col("words"))
    rows = words.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("c")).collect()
    got = {r["w"]: r["c"] for r in rows}
    return got.get("", 0), {w: got.get(w, 0) for w in known}


def postings(phrase: tuple[str, ...], n: int, df: dict[str, int], per_phrase: int = 2) -> list[tuple[str, int]]:
    """The phrase's ``per_phrase`` words of highest IDF, with their offsets (first occurrence)."""
    idf = {w: math.log((n + 1) / (df[w] + 1)) for w in phrase}
    return [(w, phrase.index(w)) for w in sorted(dict.fromkeys(phrase), key=lambda w: (-idf[w], w))[:per_phrase]]


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """``row``, ``n_words``, ``places`` (array of label, base, start, share), and the columns of ``op1``."""
    words = license_words(docs, text)
    n, df = document_frequencies(words, templates)
    index = {k: postings(k, n, df) for t in templates for _, k in t.keys}
    w = F.col("words")
    words = words.withColumn("held", F.array_intersect(_lits(lexicon(templates)), w))
    none = F.array().cast("array<string>")
    asked = F.concat(*[F.when(F.size(F.array_except(_lits(dict.fromkeys(k)), "held")) == 0, _lits(x for x, _ in ps)).otherwise(none) for k, ps in index.items()])
    words = words.withColumn("rare", F.array_distinct(asked))
    spots = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains("rare", x), F.struct(x.alias("w"), i.alias("i")))), lambda s: s.isNotNull())
    words = words.withColumn("spots", F.when(F.size("rare") > 0, spots))

    def found(phrase: tuple[str, ...]) -> Column:
        """Where the phrase stands, as indexes of ``words``."""
        at = None
        for word, offset in index[phrase]:
            starts = F.transform(F.filter("spots", lambda s: s["w"] == word), lambda s: s["i"] - offset)  # noqa: B023
            # A posted word that stands at several offsets of its phrase is aligned by its first; no place is lost,
            # because each place of the phrase has that first occurrence too.
            at = starts if at is None else F.array_intersect(at, starts)
        return F.filter(F.array_distinct(at), lambda s: (s >= 0) & (F.slice(w, F.greatest(s, F.lit(0)) + 1, len(phrase)) == _lits(phrase)))

    def places(t: Template) -> Column:
        offset, first = t.keys[0]
        at = F.transform(found(first), lambda s: s - offset)
        for other, phrase in t.keys[1:]:
            there = F.transform(found(phrase), lambda s: s - other)  # noqa: B023
            at = F.filter(at, lambda s: F.exists(there, lambda x: F.abs(x - s) <= SLACK))  # noqa: B023
        same = lambda s: F.size(F.filter(F.sequence(F.lit(0), F.lit(len(t.words) - 1)), lambda k: F.get(w, s + k) == F.get(_lits(t.words), k)))
        share = lambda s: F.lit(1.0) if t.keys == ((0, t.words),) else same(s) / F.lit(len(t.words))
        start = lambda s: (s - F.col("lead")).cast("long")
        return F.transform(at, lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), start(s).alias("start"), share(s).cast("double").alias("share")))

    nothing = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    out = words.withColumn("places", F.when(F.col("spots").isNull(), nothing).otherwise(F.concat(*map(places, templates))))
    out = out.withColumn("of_base", F.filter("places", lambda x: x["base"]))
    mention = F.arrays_overlap(w, _lits(MENTIONS))
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return out.select(
        "row",
        "n_words",
        "places",
        F.size("of_base").cast("long").alias("n_base"),
        F.array_min(F.transform("of_base", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("of_base", lambda x: x["start"])).alias("last_word"),
        joined("of_base").alias("base_labels"),
        joined("places").alias("labels"),
        F.when(F.size("places") > 0, F.array_max(F.transform("places", lambda x: x["share"]))).when(mention, MENTIONED).otherwise(0.0).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_columns(read(spark, sf_dir, "documents"), "doc_id", "text")
    return license_scan(docs).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _op1_sql() -> str:
    """All places of all key phrases, without an index; templates by joining those of their other phrases."""
    words = lambda ws: "[" + ", ".join(map(repr, ws)) + "]"
    hits = " union all ".join(
        f"select rowid_, {i} t, {j} k, p - 1 - {at} s from (select rowid_, ws, unnest(range(1, len(ws) + 1)) p from w where list_contains(ws, '{max(key, key=len)}')) where ws[p:p+{len(key) - 1}] = {words(key)}"
        for i, t in enumerate(TEMPLATES)
        for j, (at, key) in enumerate(t.keys)
    )
    table = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {len(t.keys)}, {words(t.words)})" for i, t in enumerate(TEMPLATES))
    return rf"""
with w as (
  select rowid_, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from (select row_number() over () rowid_, doc_id, text from documents)),
h as ({hits}),
t as (select * from (values {table}) v(t, label, base, n_keys, tw)),
f as (
  select a.rowid_, a.t, a.s from h a join t on t.t = a.t left join h b on a.rowid_ = b.rowid_ and a.t = b.t and b.k > 0 and abs(b.s - a.s) <= {SLACK}
  where a.k = 0 group by a.rowid_, a.t, a.s, n_keys having 1 + count(distinct b.k) = n_keys),
p as (
  select rowid_, label, base, s start, len(list_filter(range(0, len(tw)), lambda k: s + k >= 0 and ws[s + k + 1] = tw[k + 1]))::double / len(tw) share
  from f join t using (t) join w using (rowid_)),
a as (
  select rowid_, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word, max(share) share,
    coalesce(string_agg(distinct label, ',' order by label) filter (base), '') base_labels, string_agg(distinct label, ',' order by label) labels
  from p group by rowid_)
select doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
  case when labels is not null then share when list_has_any(ws, {words(MENTIONS)}) then {MENTIONED} else 0.0 end::double score
from w left join a using (rowid_)
"""


OP1_SQL = _op1_sql()

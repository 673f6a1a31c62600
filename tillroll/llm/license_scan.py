"""Licence scan by a positional index of rare words, in native expressions only.

Templates are short licence texts, each with the label it proves and the key
phrases it must hold. Every key phrase is indexed under its rarest words, by
their inverse document frequency over the whole corpus, with the words' places in it. A
file's words that are in the index are looked up with their places; the
postings of one phrase meet where file place less phrase place is the same for
each of its rare words. There the phrase is verified word by
word.

A base template is its own key phrase, so it is found at exactly the places where
its words stand consecutively. A longer template stands where its first phrase does, if each other one begins
at most ``SLACK`` words from where the template has it; the words between them may be
others. Its score is the part of the template, by the words' rarity, that stands in place, phrase by phrase.

Defined results: a null or empty text has no words, no place, no label and
score 0. Rows are scored one by one, so repeated rows repeat.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import body

# What stands between words once A-Z are in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()  # empty: the whole text is the key phrase

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrases(self) -> list[tuple[int, list[str]]]:
        """Key phrases as (place in the template, words)."""
        found = []
        for key in self.keys or (self.text,):
            words = key.split()
            places = range(len(self.words) - len(words) + 1)
            found.append((next(p for p in places if self.words[p:][: len(words)] == words), words))
        return found


# The phrases that count as base, with their labels.
BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)

# Openings of published licences, as their texts have them.
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files",
        ("permission is hereby granted free of charge", "software and associated documentation"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template("gpl", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("cc-by", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal"),
    Template("isc", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "free and unencumbered software released into the public domain"),
)

RARE = 3
"""Index words per key phrase."""

SLACK = 8
"""Words more or less that may stand between two key phrases."""


def words_of(text: Column) -> Column:
    """A text's words in order, A-Z in lower case.

    Other letters change case too, which moves no word boundary and makes no template word:
    the Kelvin sign, whose lower case is a plain k, is replaced first.
    """
    lower = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))
    parts = F.split(lower, GAP)
    return F.filter(parts, lambda w: w != "")


def document_frequency(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many documents each template word stands; one entry per
    template word at most, so its size is the templates', not the corpus's."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(words_of(body()), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in rows.collect()}


def rare_words(
    templates: tuple[Template, ...], frequency: dict[str, int], total: int, rare: int = RARE
) -> tuple[dict[str, float], dict[Template, list[list[str]]]]:
    """Every template word's IDF, and per key phrase its words of highest IDF."""
    idf = {
        w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1.0
        for t in templates
        for w in t.words
    }

    def chosen(phrase: list[str]) -> list[str]:
        # a word is indexed at one place of its phrase, so it stands there once
        once = [w for w in set(phrase) if phrase.count(w) == 1]
        return sorted(once, key=lambda w: (-idf[w], w))[:rare]

    return idf, {t: [chosen(phrase) for _, phrase in t.phrases] for t in templates}


def _phrase_starts(words: Column, hits: Column, phrase: list[str], rare: list[str]) -> Column:
    """Where a phrase's rare words agree on a start, from a file's hits, and the phrase stands."""

    def posting(word: str) -> Column:
        place = phrase.index(word)
        own = F.filter(hits, lambda h: h["word"] == F.lit(word))
        return F.transform(own, lambda h: h["pos"] - F.lit(place))

    def stands(start: Column) -> Column:
        held = F.slice(words, F.greatest(start, F.lit(0)) + 1, F.lit(len(phrase)))
        return (start >= 0) & (held == F.array(*map(F.lit, phrase)))

    return F.filter(reduce(F.array_intersect, map(posting, rare)), stands)


def _starts(words: Column, hits: Column, template: Template, rare: list[list[str]]) -> Column:
    """``start`` of the first phrase, and in ``others`` those of the other phrases that belong to it."""
    found = [
        _phrase_starts(words, hits, phrase, own)
        for (_, phrase), own in zip(template.phrases, rare, strict=True)
    ]
    first, *others = found
    behind = [place - template.phrases[0][0] for place, _ in template.phrases[1:]]

    def near(starts: Column, wanted: Column) -> Column:
        return F.array_min(F.filter(starts, lambda x: F.abs(x - wanted) <= SLACK))

    def with_place(start: Column) -> Column:
        held = [near(b, start + F.lit(d)) for b, d in zip(others, behind, strict=True)]
        return F.struct(start.alias("start"), F.array(*held).cast("array<int>").alias("others"))

    with_others = F.transform(first, with_place)
    return F.filter(with_others, lambda s: ~F.exists(s["others"], lambda o: o.isNull()))


def _coverage(words: Column, found: Column, template: Template, idf: dict[str, float]) -> Column:
    """The template's part, by IDF, whose words stand in place behind the start of the phrase before them."""
    whole = sum(idf[w] for w in template.words)
    places = [place for place, _ in template.phrases]
    held = []
    for p, w in enumerate(template.words):
        k = max(0, sum(place <= p for place in places) - 1)
        start = found["start"] if k == 0 else found["others"][k - 1]
        at = start + F.lit(p - places[k] + 1)
        stands = F.when(at > 0, F.try_element_at(words, at)) == F.lit(w)
        held.append(F.when(stands, F.lit(idf[w] / whole)).otherwise(F.lit(0.0)))
    return F.least(reduce(Column.__add__, held), F.lit(1.0))


def license_scan(
    docs: DataFrame,
    base: tuple[Template, ...] = BASE,
    notices: tuple[Template, ...] = NOTICES,
    rare: int = RARE,
) -> DataFrame:
    """Per document its licence places, labels and score.

    The index is a few dozen words, written into the plan. A text without the rarest
    word of any template can hold none, so its words are only counted.
    """
    templates = (*base, *notices)
    frequency = document_frequency(docs, templates)
    idf, chosen = rare_words(templates, frequency, docs.count(), rare)
    index = sorted({w for phrases in chosen.values() for words in phrases for w in words})
    rarest = F.array(*[F.lit(w) for w in sorted({phrases[0][0] for phrases in chosen.values()})])
    indexed = F.array(*map(F.lit, index))
    words = F.col("words")
    placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    hits = F.filter(placed, lambda h: F.array_contains(indexed, h["word"]))
    found = (
        docs.select("doc_id", words_of(body()).alias("words"))
        .withColumn("hits", F.when(F.arrays_overlap(words, rarest), hits))
        .select(
            "doc_id",
            "words",
            *[
                _starts(words, F.col("hits"), t, chosen[t]).alias(f"t{i}")
                for i, t in enumerate(templates)
            ],
        )
    )
    none = F.array().cast("array<struct<start:int,others:array<int>>>")
    at = [F.coalesce(F.col(f"t{i}"), none) for i in range(len(templates))]
    base_at = F.concat(*at[: len(base)])["start"]

    def labels(chosen_at: list[Column], own: tuple[Template, ...]) -> Column:
        names = [F.when(F.size(a) > 0, F.lit(t.label)) for a, t in zip(chosen_at, own, strict=True)]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), ",")

    def best(starts: Column, template: Template) -> Column:
        if not template.keys:  # found, it stands there word by word
            return F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        scores = F.transform(starts, lambda found: _coverage(words, found, template, idf))
        return F.coalesce(F.array_max(scores), F.lit(0.0))

    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(base_at).cast("long").alias("n_base"),
        F.array_min(base_at).cast("long").alias("first_word"),
        F.array_max(base_at).cast("long").alias("last_word"),
        labels(at[: len(base)], base).alias("base_labels"),
        labels(at, templates).alias("labels"),
        F.greatest(*map(best, at, templates)).alias("score"),
    )

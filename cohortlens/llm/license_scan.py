"""op1: licence scan with a positional index of the templates' rarest words.

Document frequencies of all licence words come from one pass over the corpus.
Every mandatory phrase of a template is posted under its ``rare`` words of
highest IDF with their places in the phrase.  A file looks up its occurrences
of these words; each posting proposes a start (place in file - place in
phrase), and only starts that all rare words of a phrase agree on are verified
word by word.  A template's label needs all its mandatory phrases.  Everything
happens inside the row, so no text, word or hit is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import words


class Template(NamedTuple):
    """A licence: label, mandatory phrases (all must occur), further words that count for the score."""

    label: str
    phrases: tuple[str, ...]
    body: str = ""


#: Phrases and labels of the contract.
BASE = (
    Template("cc-by", ("cc by",)),
    Template("gpl", ("general public license",)),
    Template("reserved", ("all rights reserved",)),
)
#: Well-known public licence notices.
TEMPLATES = BASE + (
    Template("apache-2.0", ("apache license version 2 0",), "licensed under the apache license version 2 0"),
    Template("mit", ("mit license",), "released under the mit license"),
    Template("mit-text", ("permission is hereby granted free of charge",),
             "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", ("redistribution and use in source and binary forms",),
             "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("gpl-3", ("gnu general public license version 3",),
             "this work is licensed under the gnu general public license version 3"),
    Template("lgpl", ("gnu lesser general public license",)),
    Template("agpl", ("gnu affero general public license",)),
    Template("mpl-2.0", ("mozilla public license",), "subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-nc", ("cc by nc",), "licensed under cc by nc 4 0"),
    Template("cc-by-sa", ("cc by sa",), "licensed under cc by sa 4 0"),
    Template("unlicense", ("free and unencumbered software", "public domain"),
             "this is free and unencumbered software released into the public domain"),
)
#: IDF is carried as whole thousandths, so that sums do not depend on their order.
IDF_UNIT = 1000


def _template_words(t: Template) -> list[str]:
    return sorted({w for text in (*t.phrases, t.body) for w in text.split()})


def corpus_idf(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """IDF of each word over all rows of ``docs``, in thousandths; one row per word reaches the driver."""
    present = F.array_intersect(words(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), present)).alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in found}
    n = df.get("", 0)
    return {w: int(round(IDF_UNIT * math.log((n + 2) / (df.get(w, 0) + 1)))) for w in vocabulary}


def _map_of(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])


def license_scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: Sequence[str] = tuple(t.label for t in BASE),
                 rare: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels per row of ``docs``.

    Returns id, n_words, n_base (places of phrases of ``base`` labels),
    first_word, last_word (their smallest and largest start), base_labels,
    labels (distinct, sorted, comma-joined), score (largest share, by IDF, of a
    found template's words that occur in the text; 0 without a label) and
    places (label, start of every verified phrase).  Null or empty texts have
    no words, no labels and score 0; repeated rows are judged one by one;
    input columns other than the two named are not read.
    """
    vocabulary = sorted({w for t in templates for w in _template_words(t)})
    idf = corpus_idf(docs, vocabulary, text_col)
    phrases = [(t.label, p.split()) for t in templates for p in t.phrases]
    postings: dict[str, list[tuple[int, int]]] = {}
    n_keys = []
    for k, (_, phrase) in enumerate(phrases):
        chosen = sorted(set(phrase), key=lambda w: (-idf[w], w))[:rare]
        places = [(w, q) for q, w in enumerate(phrase) if w in chosen]
        n_keys.append(len(places))
        for w, q in places:
            postings.setdefault(w, []).append((k, q))
    index = _map_of({w: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).alias("q")) for k, q in ps]) for w, ps in postings.items()})
    phrase_words = F.array(*[F.array(*map(F.lit, p)) for _, p in phrases])
    phrase_label = F.array(*[F.lit(label) for label, _ in phrases])
    phrase_keys = F.array(*map(F.lit, n_keys))

    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    # places of rare words
    rows = rows.select("*", F.filter(F.transform("w", lambda w, i: F.when(w.isin(*postings), i)), lambda i: i.isNotNull()).alias("at"))
    # what each proposes, sorted, so that agreeing proposals are neighbours
    proposed = F.flatten(F.transform("at", lambda i: F.transform(
        F.element_at(index, F.element_at(F.col("w"), i + 1)),
        lambda p: F.struct(p["k"].alias("k"), (i - p["q"]).alias("start")))))
    rows = rows.select("*", F.array_sort(proposed).alias("proposed"))
    agreed = F.filter("proposed", lambda p, j: F.get(F.col("proposed"), j + F.get(phrase_keys, p["k"]) - 1) == p)
    agreed = F.filter(agreed, lambda p: (p["start"] >= 0) & (
        F.slice(F.col("w"), p["start"] + 1, F.size(F.get(phrase_words, p["k"]))) == F.get(phrase_words, p["k"])))
    rows = rows.select("id", "w", agreed.alias("found"))
    rows = rows.select("*", F.transform("found", lambda p: F.struct(
        F.get(phrase_label, p["k"]).alias("label"), p["start"].cast("long").alias("start"), p["k"].alias("k"))).alias("places"))

    def has_all(t: Template) -> Column:
        ks = [k for k, (label, _) in enumerate(phrases) if label == t.label]
        return F.forall(F.array(*map(F.lit, ks)), lambda k: F.exists("found", lambda p: p["k"] == k))

    def share(t: Template) -> Column:
        own = _template_words(t)
        weights = _map_of({w: F.lit(idf[w]) for w in own})
        got = F.aggregate(F.array_intersect(F.col("w"), F.array(*map(F.lit, own))), F.lit(0), lambda a, w: a + F.element_at(weights, w))
        return got / F.lit(max(1, sum(idf[w] for w in own)))

    scored = F.array(*[F.when(has_all(t), F.struct(F.lit(t.label).alias("label"), share(t).alias("share"))) for t in templates])
    rows = rows.select("*", F.when(F.size("found") > 0, F.filter(scored, lambda s: s.isNotNull())).alias("scored"))
    starts = F.transform(F.filter("places", lambda p: p["label"].isin(*base)), lambda p: p["start"])
    rows = rows.select("*", starts.alias("starts"), F.coalesce(F.transform("scored", lambda s: s["label"]), F.array()).alias("names"))
    named = F.array_sort(F.array_distinct("names"))
    return rows.select(
        F.col("id").alias(id_col), F.size("w").cast("long").alias("n_words"), F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join(F.filter(named, lambda x: x.isin(*base)), ",").alias("base_labels"), F.array_join(named, ",").alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("scored", lambda s: s["share"])), F.lit(0.0)), 6).alias("score"),
        F.transform("places", lambda p: F.struct(p["label"], p["start"])).alias("places"))

"""License notices by an exact set-similarity join against templates.

The templates' tokens are ordered by how many documents hold them, rarest first.
A text block (a line) that holds at least `threshold` of a template's tokens
must hold one of the template's n - need + 1 rarest (the prefix), have at least
`need` tokens of templates (length), and have enough tokens left behind the
place where both meet (position); what passes is counted exactly. Documents that
don't hold enough of a template as a whole are not cut into blocks.

Beside it the base finds places where a phrase's words stand consecutively.

Defined cases: a null text counts as empty; a text without words has no labels
and score 0; repeated rows are scanned one by one; an empty table gives an empty
result; columns that clash with result columns are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, small_side
from plumbline.session import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
MAX_BROADCAST = 500_000

# Phrases and labels of the base.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Openings of well-known notices and their labels.
TEMPLATES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("cc0", "to the extent possible under law all copyright and related rights are waived"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    """Words of a lower-cased text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _places(words: Column, phrases: dict[str, str]) -> Column:
    """(place, label) of every place where a phrase's words stand consecutively."""
    none = F.array().cast("array<struct<place:int,label:string>>")

    def of(phrase: str, label: str) -> Column:
        first, *rest = re.findall(WORD, phrase)

        def here(w: Column, i: Column) -> Column:
            ok = w == first
            for k, word in enumerate(rest, 1):
                ok = ok & F.coalesce(F.get(words, i + k) == word, F.lit(False))
            return F.when(ok, F.struct(i.alias("place"), F.lit(label).alias("label")))

        # Most texts lack one of the words and are not gone through place by place.
        some = F.array_contains(words, first) & F.array_contains(words, max(rest, key=len))
        return F.when(some, F.array_compact(F.transform(words, here))).otherwise(none)

    return F.concat(*[of(phrase, label) for phrase, label in phrases.items()])


def _tokens(templates: list[tuple[str, str]]) -> list[set[str]]:
    return [set(re.findall(WORD, text)) for _, text in templates]


def _ranks(read: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """The templates' tokens by the number of documents that hold them, rarest first."""
    known = sorted(set().union(*_tokens(templates)))
    counted = read.select(F.explode("_held").alias("token")).groupBy("token").count().collect()
    counts = {r["token"]: r["count"] for r in counted}
    return {t: i for i, t in enumerate(sorted(known, key=lambda t: (counts.get(t, 0), t)))}


def _matches(ranks: Column, sets: list[tuple[str, list[int]]], threshold: float) -> Column:
    """(label, containment) of the templates that a block with these sorted ranks contains."""
    found = []
    for label, tokens in sets:
        n = len(tokens)
        need = math.ceil(round(threshold * n, 9))
        prefix = tokens[: n - need + 1]
        mine = F.array(*[F.lit(t) for t in tokens])
        # The rarest token that both have; behind it both must have need - 1 more.
        first = F.get(F.array_intersect(F.array(*[F.lit(t) for t in prefix]), ranks), F.lit(0))
        left = F.least(
            F.lit(n) - F.array_position(mine, first), F.size(ranks) - F.array_position(ranks, first)
        )
        passes = (F.size(ranks) >= need) & first.isNotNull() & (left >= need - 1)
        both = F.when(passes, F.size(F.array_intersect(ranks, mine))).otherwise(F.lit(0))
        found.append(F.struct(F.lit(label).alias("label"), (both / n).alias("held"), (both >= need).alias("ok")))
    return F.filter(F.array(*found), lambda m: m["ok"])


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: doc_id, n_words, places (of base phrases), matches (line, label, held)."""
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = sorted(set().union(*_tokens(templates)))
    lowered = rows.select("doc_id", F.xxhash64("text").alias("_text_key"), ascii_lower(F.col("text")).alias("_low"))
    worded = lowered.select("doc_id", "_text_key", words_of(F.col("_low")).alias("_words"))
    read = stored(
        worded.select(
            "doc_id",
            "_text_key",
            F.size("_words").cast("bigint").alias("n_words"),
            _places(F.col("_words"), PHRASES).alias("places"),
            F.array_intersect("_words", F.array(*[F.lit(t) for t in known])).alias("_held"),
        ),
        "words",
    )
    order = _ranks(read, templates)
    sets = [(label, sorted(order[t] for t in tokens)) for (label, _), tokens in zip(templates, _tokens(templates))]
    number = F.create_map(*[F.lit(x) for item in order.items() for x in item])

    def ranked(tokens: Column) -> Column:
        return F.sort_array(F.transform(tokens, lambda t: number[t]))

    whole = read.filter(F.size("_held") > 0).select("_text_key", ranked(F.col("_held")).alias("_ranks"))
    # A block's tokens are among its document's, so the document must pass first.
    likely = stored(
        whole.filter(F.size(_matches(F.col("_ranks"), sets, threshold)) > 0).select("_text_key").distinct(), "likely"
    )
    texts = rows.select(F.xxhash64("text").alias("_text_key"), "text")
    held = F.array(*[F.lit(t) for t in known])
    lines = (
        texts.join(small_side(likely, MAX_BROADCAST), "_text_key")
        .select("_text_key", F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("line", "_block"))
        .distinct()
        .select("_text_key", "line", F.array_intersect(words_of(F.col("_block")), held).alias("_held"))
        .filter(F.size("_held") > 0)
        .select("_text_key", "line", ranked(F.col("_held")).alias("_ranks"))
        .select("_text_key", "line", F.explode(_matches(F.col("_ranks"), sets, threshold)).alias("m"))
    )
    # A document has at most as many matches as lines times templates.
    matches = lines.groupBy("_text_key").agg(
        F.array_sort(F.collect_list(F.struct("line", "m.label", "m.held"))).alias("matches")
    )
    matched = read.join(small_side(stored(matches, "matches"), MAX_BROADCAST), "_text_key", "left")
    none = F.array().cast("array<struct<line:int,label:string,held:double>>")
    return matched.select("doc_id", "n_words", "places", F.coalesce("matches", none).alias("matches"))


def summary(scanned: DataFrame) -> DataFrame:
    """Per row of `scan`: counts, first and last place, labels and score."""
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    method = F.transform("matches", lambda m: m["label"])
    held = F.coalesce(F.array_max(F.transform("matches", lambda m: m["held"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["place"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["place"])).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, method))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(held).alias("score"),
    )

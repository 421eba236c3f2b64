"""Spelling variants by pivotal grams.

Two words are near if one code point was inserted, deleted or replaced. Bigrams
have one order over all words, rarest first; a word's prefix holds its three
rarest bigrams by place (and those that equal the third). One edit spoils no two
bigrams that share no code point, so of two disjoint bigrams of a word, its
pivots, one is found in every near word, and in its prefix if that word's prefix
ends later in the order. A dynamic programme takes the rarest pair out of each prefix.

The places must fit: the edit lies behind a kept bigram or before it, so either
all up to the bigram is equal, at equal places from the start, or all from it on,
at equal places from the end. Of the rest one half is equal as well. The index is
keyed by hashes of both, and what meets there is verified by its edit distance.

Every word then takes its near word with the most occurrences as its form, if
those are `ratio` times its own. Occurrences at least double from form to form,
so roots are found by a few rounds of doubling the steps.

Defined cases: null and empty texts have no words; very long texts are read
whole, by one task each; a null id is hashed as the text 'null'; repeated rows
count again; of near words with equally many occurrences the smallest in
code-point order is the form; an empty table gives an empty result; other
columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower
from plumbline.session import stored

RUN = r"[A-Za-zÀ-ÿ]+"
MODULUS = 97
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
EDITS = 1
Q = 2
# Parts below this length are shared by many words and are made longer by half of the rest.
SHORT = 8


def varied(doc_id: Column, run: Column, modulus: int = MODULUS) -> Column:
    """The run without one code point where `modulus` divides the hash of id and run."""
    mark = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run)
    h = F.crc32(mark.cast("binary"))
    at = (h % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % modulus == 0, less).otherwise(run)


def vocabulary(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    modulus: int = MODULUS,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """word, n of the distinct words that are long and frequent enough; counted in each task before the shuffle."""
    runs = F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUN), F.lit(0))
    # A run gets no longer by losing a code point.
    long = F.filter(runs, lambda r: F.length(r) >= min_length)
    found = docs.select(F.col(doc_id).alias("_id"), F.explode(long).alias("_run"))
    words = found.select(varied(F.col("_id"), F.col("_run"), modulus).alias("word"))
    counted = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def gram_order(words: DataFrame) -> dict[str, int]:
    """Number of words that hold each bigram.

    At most the square of the alphabet (90 code points of RUN without A-Z: 4,096
    at 64, 8,100 in all), whatever the corpus, so every task may hold it.
    """
    places = F.sequence(F.lit(1), F.length("word") - (Q - 1))
    grams = words.select(F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(Q))))).alias("gram"))
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def prefix(word: str, counts: dict[str, int]) -> tuple[list[int], tuple[int, str]]:
    """Places of the word's rarest bigrams in ascending order, and the last of them in the order of bigrams."""
    ranked = sorted((counts[word[i : i + Q]], word[i : i + Q], i) for i in range(len(word) - Q + 1))
    last = ranked[min(Q * EDITS, len(ranked) - 1)][:2]
    return sorted(i for n, gram, i in ranked if (n, gram) <= last), last


def pivots(word: str, places: list[int], counts: dict[str, int]) -> list[int]:
    """EDITS + 1 of the places, no two of which share a code point, with the fewest words in sum.

    best[j] is the cheapest choice of j places among those gone through, kept
    for every place so that the next one may look back to those that end before it.
    """
    best: list[list[tuple[int, list[int]]]] = [[(0, [])] + [(-1, [])] * (EDITS + 1)]
    for at, place in enumerate(places):
        before = at
        while before and places[before - 1] > place - Q:
            before -= 1
        row = list(best[at])
        for j in range(1, EDITS + 2):
            cost, chosen = best[before][j - 1]
            if cost < 0:
                continue
            taken = cost + counts[word[place : place + Q]]
            if row[j][0] < 0 or taken < row[j][0]:
                row[j] = (taken, [*chosen, place])
        best.append(row)
    return best[-1][EDITS + 1][1]


def marked(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """word, n, end (rank of its prefix's last bigram), places (of the prefix) and pivots (two of them)."""
    ranks = {gram: rank for rank, (_, gram) in enumerate(sorted((n, gram) for gram, n in counts.items()))}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [prefix(word, counts) for word in batch["word"]]
            places = [p for p, _ in found]
            chosen = [pivots(word, p, counts) for word, p in zip(batch["word"], places)]
            yield batch.assign(end=[ranks[last] for _, (_, last) in found], places=places, pivots=chosen)

    return words.mapInPandas(rows, "word string, n bigint, end int, places array<int>, pivots array<int>")


def _sides(place: Column) -> list[tuple[str, Column, Column]]:
    """Name, part and rest of a word for a kept bigram: all up to it, or all from it on, must be equal."""
    word, size = F.col("word"), F.length("word")
    upto, behind = F.substring(word, F.lit(1), place + Q), F.substring(word, place + 1 + Q, size)
    onward, ahead = F.substring(word, place + 1, size), F.substring(word, F.lit(1), place)
    return [("<", upto, behind), (">", onward, ahead)]


def _keys(name: str, part: Column, rest: Column, size: Column) -> Column:
    """Two keys from a part and a rest, of which a near word's rest has `size` code points.

    One edit leaves one half of that word's rest as it is: the front half, with
    which both rests begin, or the back half, with which both end. A key is a
    hash; what meets by chance is verified like everything else.
    """
    front = (size / 2).cast("int")
    back = size - front
    begins = F.substring(rest, F.lit(1), front)
    ends = F.substring(rest, F.length(rest) - back + 1, back)
    first = F.xxhash64(F.lit(name + "f"), size, part, begins)
    second = F.when(F.length(rest) >= back, F.xxhash64(F.lit(name + "b"), size, part, ends))
    return F.array(first, second)


def _short(part: Column) -> Column:
    return F.length(part) < SHORT


def held_keys(place: Column) -> Column:
    """Keys under which a word is found by the bigram at a place of its prefix."""

    def of(name: str, part: Column, rest: Column) -> Column:
        return F.when(_short(part), _keys(name, part, rest, F.length(rest))).otherwise(F.array(F.xxhash64(F.lit(name), part)))

    return F.concat(*[of(*side) for side in _sides(place)])


def asked_keys(place: Column) -> Column:
    """Keys that a word looks up for a pivot, for all sizes that a near word may have."""

    def of(name: str, part: Column, rest: Column) -> Column:
        sizes = F.sequence(F.greatest(F.length(rest) - EDITS, F.lit(0)), F.length(rest) + EDITS)
        halves = F.flatten(F.transform(sizes, lambda size: _keys(name, part, rest, size)))
        return F.when(_short(part), halves).otherwise(F.array(F.xxhash64(F.lit(name), part)))

    return F.concat(*[of(*side) for side in _sides(place)])


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n of every ordered pair of near words, both ways; `words` has word, n and is read twice."""
    grams = stored(marked(words, gram_order(words)), "grams")

    def keyed(places: str, keys: Callable[[Column], Column]) -> Column:
        return F.explode(F.array_compact(F.array_distinct(F.flatten(F.transform(places, keys)))))

    asks = grams.select("word", "n", "end", keyed("pivots", asked_keys).alias("key"))
    holds = grams.select(
        F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("end").alias("other_end"), keyed("places", held_keys).alias("key")
    )
    # The word whose prefix ends first asks; where both end alike, either finds the other.
    met = asks.join(holds, "key").filter((F.col("end") <= F.col("other_end")) & (F.col("word") != F.col("other")))
    near = met.filter(F.levenshtein("word", "other", EDITS) == EDITS)
    pair = F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    both = near.select(F.explode(pair).alias("pair")).select("pair.*")
    # Partitioned by word alone, which serves the grouping behind as well.
    return both.repartition("word").dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """word and root of all words that have a form, by doubling the steps until no pointer has a form any more."""
    now = stored(forms, "pointers")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "pointers")
        now = moved.select("word", "root")
        if moved.filter("_moved").limit(1).count() == 0:
            return now


def variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    modulus: int = MODULUS,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = stored(vocabulary(docs, doc_id, text, modulus, min_length, min_count), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    most = -F.col("best.minus")
    wins = most >= F.col("n") * ratio
    formed = stored(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(wins, F.col("best.word")).alias("form"),
            F.when(wins, most).alias("form_n"),
        ),
        "forms",
    )
    led = roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))

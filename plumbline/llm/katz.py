"""Katz backoff bigrams with Good-Turing discounts.

All words and all their bigrams are counted and stored in tables partitioned by
key. The NUMBERED most frequent words get numbers, whose counts and weights every
task holds; what belongs to any other word lies in the tables alone, by the
word's hash, and is joined or asked for there.

    P(w|h) = d(r) r / c(h)              if r = c(h, w) > 0
             alpha(h) P(w)              otherwise

d is the Good-Turing discount for counts up to 5. P(w) is discounted likewise;
what it leaves is the share of all unknown words together. alpha makes the
probabilities of all words sum to 1 for every history; it is 1 for a history
that never occurs.

Only if a `vocabulary` is asked for do the words beyond it share the class 0
inside bigrams, each with its own unigram share of it:

    P(word|h) = P(0|h) P(word) / P(0)   for a word of class 0

Bigrams of numbered words that make up more than 1 / HELD of all tokens, hence
fewer than HELD, are known to every task as well. Scoring deals the other
distinct (document, bigram) rows of a block of documents out by key, as sorted
compressed arrays, to where the table's part lies. A request names the rows that
ask it and no others, so what is sent grows with the tokens alone. What comes
back for each document is the sum of the differences to the backed-off score,
which the block itself knows. Words without a number are looked up the same way
in the partitioned word table, with their weights as histories. A bigram or word
of most documents adds one row for each document to its part, no more.

Words stand for themselves as 64-bit hashes.

Defined cases: a null text counts as empty and has the one token end; a null id
trains; rows that repeat an id are scored one by one and all train; without
training rows every word is unknown with probability 1; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import id_hash
from plumbline.llm.shingles import blocks, mix, word_hashes
from plumbline.session import stored

NUMBERED = 200_000
HELD = 2_000_000
DISCOUNTED = 5
CHUNK_TOKENS = 3_000_000
SLICE = 250_000
PART_TOKENS = 6_000_000
TABLE_ROWS = 1_000_000
LEAST_PARTS = 24
OWN, PAIR, WORD = 0, 1, 2
# Types of a row's sums: id, hash, tokens, known, base and backed-off score, whether it lacks an id (-1: not its own).
FORM = "qiqdddq"
START, END = 1, 2
FIRST_WORD = 3
_U = np.uint64
# Numbers lie below, hashes of words do not.
CODES = np.uint64(1 << 32)
TOP = np.uint64(1 << 63)
END_HASH = np.uint64(0x9E3779B97F4A7C15)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(other columns of the rows, word hashes, first word of every row) of about CHUNK_TOKENS words; text comes last."""
    ids: list = []
    words: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0
    for batch in batches:
        own = list(zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 1))))
        for first, raw, offsets in blocks(batch.column(batch.num_columns - 1)):
            hashes, bounds = word_hashes(raw, offsets)
            hashes = np.where(hashes < CODES, hashes | TOP, hashes)
            ids.extend(own[first : first + len(offsets) - 1])
            words.append(hashes)
            sizes.append(np.diff(bounds))
            held += len(hashes)
            if held >= CHUNK_TOKENS:
                yield _whole(ids, words, sizes)
                ids, held = [], 0
    if ids:
        yield _whole(ids, words, sizes)


def _whole(ids: list, words: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
    """The chunk of these pieces, which are let go."""
    found = ids, np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    words.clear()
    sizes.clear()
    return found


def _slices(n: int) -> Iterator[slice]:
    """Steps over long arrays, so that what is made in between stays small."""
    for at in range(0, n, SLICE):
        yield slice(at, at + SLICE)


def _pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=values[:1] * 0)
    planes = steps.view(np.uint8).reshape(len(values), -1).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(packed: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    width = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)
    return np.cumsum(steps, dtype=kind)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (word, c), combined by chunk."""
    for ids, words, _ in _chunks(batches):
        found, counts = np.unique(words, return_counts=True)
        found, counts = np.append(found, END_HASH), np.append(counts, len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["word", "c"])


@dataclass(frozen=True)
class Unigrams:
    """Numbered words with their probabilities, and what the rest is made from."""

    hashes: np.ndarray  # sorted
    numbers: np.ndarray
    counts: np.ndarray  # by number
    probability: np.ndarray  # by number; 0 is the class of all other words, 1 if they stand for themselves
    discounts: np.ndarray  # by count up to DISCOUNTED
    tokens: int
    types: int
    unknown: float  # the share of all unknown words
    scale: float  # makes room for it where discounts leave too little
    whole: bool  # words without a number stand for themselves

    @property
    def log_p(self) -> np.ndarray:
        return np.log10(np.maximum(self.probability, 1e-300))

    def codes(self, words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """What stands for a word in a bigram: its number, else its hash if there are no classes."""
        codes = numbers.astype(np.uint64)
        if self.whole:
            np.copyto(codes, words, where=numbers == 0)
        return codes

    def share(self, c: Column) -> Column:
        """The probability of a word of this count."""
        return by_count(self.discounts[1:], c) * c * F.lit(float(self.scale)) / F.lit(float(max(self.tokens, 1)))

    def number(self, words: np.ndarray) -> np.ndarray:
        found = np.zeros(len(words), np.int32)
        for s in _slices(len(words) if len(self.hashes) else 0):
            at = np.minimum(np.searchsorted(self.hashes, words[s]), len(self.hashes) - 1)
            found[s] = np.where(self.hashes[at] == words[s], self.numbers[at], 0)
        return found

    def log_share(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of words with these counts, 0 for an unknown one."""
        small = np.minimum(counts, DISCOUNTED + 1)
        known = np.append(self.discounts, 1.0)[small] * counts * self.scale / max(self.tokens, 1)
        return np.log10(np.where(counts > 0, known, self.unknown))


def good_turing(classes: dict[int, int]) -> np.ndarray:
    """Discounts of the counts 0 to DISCOUNTED from the numbers of n-grams by count.

    Where a class is too small for the estimate to lie between 0 and 1, half a
    count is taken off instead.
    """
    n = [classes.get(r, 0) for r in range(DISCOUNTED + 2)]
    found = [1.0]
    rest = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        found.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(found)


def by_count(discounts: np.ndarray, c: Column) -> Column:
    """The discount of a count from those of 1 to DISCOUNTED."""
    steps = F.array(*[F.lit(float(d)) for d in discounts], F.lit(1.0))
    return F.element_at(steps, F.least(c, F.lit(DISCOUNTED + 1)).cast("int"))


def _classes(table: DataFrame) -> dict[int, int]:
    low = table.filter(F.col("c") <= DISCOUNTED + 1).groupBy("c").count().collect()
    return {r["c"]: r["count"] for r in low}


def unigrams(words: DataFrame, vocabulary: int | None = None) -> Unigrams:
    """From the stored word table (word, c); reads its totals and at most NUMBERED or `vocabulary` rows."""
    whole = vocabulary is None
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("types")).first()
    tokens, types = total["n"] or 0, total["types"]
    discounts = good_turing(_classes(words))
    end = int(END_HASH.view(np.int64))
    top = words.filter(F.col("word") != end).orderBy(F.col("c").desc(), "word").limit(NUMBERED if whole else vocabulary).toArrow()
    ends = words.filter(F.col("word") == end).agg(F.sum("c")).first()[0] or 0
    counts = np.concatenate([[0, 0, ends], top.column("c").to_numpy()]).astype(np.int64)
    if not tokens:
        return Unigrams(np.zeros(0, np.uint64), np.zeros(0, np.int64), counts, np.ones(3), discounts, 0, 0, 1.0, 1.0, whole)
    # Everything that the discounts take off goes to unknown words.
    low = words.filter(F.col("c") <= DISCOUNTED).groupBy("c").count().collect()
    left = sum((1 - discounts[r["c"]]) * r["c"] * r["count"] for r in low) / tokens
    unknown = max(left, 0.5 / tokens)
    scale = (1 - unknown) / (1 - left) if left < 1 else 0.0
    share = np.append(discounts, 1.0)[np.minimum(counts, DISCOUNTED + 1)] * counts * scale / tokens
    share[0] = 1.0 if whole else max(1.0 - share[1:].sum(), unknown)
    hashes = top.column("word").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Unigrams(
        hashes[order], order + FIRST_WORD, counts, share, discounts, tokens, types, unknown, scale, whole
    )


def _pairs(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history and word of every bigram, its row): start before the first word of a row, end behind the last."""
    rows = len(bounds) - 1
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(rows, dtype=np.uint32), sizes + 1)
    first = bounds[:-1] + np.arange(rows)
    right = np.full(len(numbers) + rows, END, np.uint64)
    left = np.full(len(numbers) + rows, START, np.uint64)
    inside = np.ones(len(right), bool)
    inside[first + sizes] = False
    right[inside] = numbers
    inside[:] = True
    inside[first] = False
    left[inside] = numbers
    return left, right, row


def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Both numbers, or a hash with the top bit set if either word has none."""
    keys = np.empty(len(left), np.uint64)
    for s in _slices(len(left)):
        h, w = left[s], right[s]
        hashed = mix(mix(h) + w * _U(0x9E3779B97F4A7C15)) | TOP
        keys[s] = np.where((h < CODES) & (w < CODES), (h << _U(32)) | w, hashed)
    return keys


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    found = np.empty(len(keys), np.uint16 if parts <= 1 << 16 else np.uint32)
    for s in _slices(len(keys)):
        found[s] = (mix(keys[s]) >> _U(32)) % _U(parts)
    return found


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every part that has keys, and their places in order."""
    part = _part(keys, parts)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts)).tolist()
    for p, (a, b) in enumerate(zip([0, *ends], ends)):
        if a < b:
            yield p, order[a:b]


def _counted_pairs(model: Unigrams, parts: int):
    """mapInArrow: (doc_id, text) to (part, keys, words, counts), combined by chunk.

    Bigrams of numbers have their keys; others have the parts from `parts` on, histories as keys, and words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, bounds in _chunks(batches):
            left, right, _ = _pairs(model.codes(words, model.number(words)), bounds)
            del words
            rare = (left >= CODES) | (right >= CODES)
            out: list[tuple] = []
            found = (left[~rare] << _U(32)) | right[~rare]
            left, right = left[rare], right[rare]
            found.sort()
            first = np.flatnonzero(_firsts(found))
            counts, found = np.diff(np.append(first, len(found))).astype(np.uint32), found[first]
            for p, mine in _by_part(found, parts):
                out.append((p, _pack(found[mine]), None, _raw(counts[mine])))
            del found, counts, first
            left, right, counts = _combined(left, right, np.ones(len(left), np.int64))
            for p, mine in _by_part(_key(left, right), parts):
                out.append((parts + p, _pack(left[mine]), _raw(right[mine]), _raw(counts[mine].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3)]],
                names=["part", "keys", "words", "counts"],
            )

    return run


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns differ from the row before."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def _combined(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams in order, with the sums of their counts."""
    if not len(left):
        return left, right, counts
    order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    first = np.flatnonzero(_firsts(left, right))
    return left[first], right[first], np.add.reduceat(counts, first)


def _summed_pairs(table: pa.Table) -> pa.Table:
    """One part of the bigram table from its chunks: numbers as h and w, hashes as hh and ww."""
    keys = np.concatenate([_unpack(k, np.uint64) for k in table.column("keys").to_pylist()])
    counts = np.concatenate([_read(c, np.uint32) for c in table.column("counts").to_pylist()]).astype(np.int64)
    words = table.column("words").to_pylist()
    if words[0] is None:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(_firsts(keys))
        keys, sums = keys[first], np.add.reduceat(counts, first)
        left, right = keys >> _U(32), keys & _U(0xFFFFFFFF)
    else:
        left, right, sums = _combined(keys, np.concatenate([_read(w, np.uint64) for w in words]), counts)
    columns = {"part": pa.array(np.full(len(left), table.column("part")[0].as_py(), np.int32))}
    for number, code, values in (("h", "hh", left), ("w", "ww", right)):
        hashed = values >= CODES
        columns[number] = pa.array(np.where(hashed, 0, values).astype(np.int32), mask=hashed)
        columns[code] = pa.array(values.view(np.int64), mask=~hashed)
    return pa.table(columns | {"c": pa.array(sums)}).select(["part", "h", "w", "hh", "ww", "c"])


@dataclass(frozen=True)
class Bigrams:
    """By numbered history: count and backoff weight; discounts by count; sorted keys of held bigrams, their gains."""

    counts: np.ndarray
    log_alpha: np.ndarray
    discounts: np.ndarray
    held: np.ndarray
    gains: np.ndarray

    def gain(self, keys: np.ndarray, counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """What numbered bigrams with these counts add to their backed-off scores."""
        h, w = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
        steps = np.append(self.discounts, 1.0)
        direct = steps[np.minimum(counts, DISCOUNTED + 1)] * np.maximum(counts, 1) / np.maximum(self.counts[h], 1)
        return np.log10(direct) - self.log_alpha[h] - log_p[w]

    def held_gain(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether these keys are held, and the gains of those that are."""
        if not len(self.held):
            return np.zeros(len(keys), bool), np.zeros(0)
        known, gains = np.zeros(len(keys), bool), []
        for s in _slices(len(keys)):
            at = np.minimum(np.searchsorted(self.held, keys[s]), len(self.held) - 1)
            known[s] = self.held[at] == keys[s]
            gains.append(self.gains[at[known[s]]])
        return known, np.concatenate(gains) if gains else np.zeros(0)


def backoff(table: DataFrame, words: DataFrame, model: Unigrams) -> tuple[Bigrams, DataFrame, DataFrame]:
    """Exactly normalised weights: of numbered histories, of the others (hh, log_alpha), and gains.

    The gains (h, hh, w, ww, gain) are those of bigrams with a word without a
    number. Such a word is too rare for its bigrams to crowd a join; numbered
    ones are broadcast, at most NUMBERED + 3 rows.
    """
    discounts = good_turing(_classes(table))
    spark = table.sparkSession
    numbers = np.arange(len(model.probability), dtype=np.int32)
    shares = F.broadcast(spark.createDataFrame(pa.table({"w": numbers, "p": model.probability})))
    rest = words.select(F.col("word").alias("ww"), model.share(F.col("c")).alias("p"))
    columns = ["h", "hh", "w", "ww", "c", "p"]
    has_number = table.filter("w is not null").join(shares, "w").select(columns)
    rare = stored(
        has_number.filter("hh is not null").unionByName(table.filter("ww is not null").join(rest, "ww").select(columns)),
        "rare",
    )
    each = by_count(discounts[1:], F.col("c")) * F.col("c")
    least = F.lit(1e-12)

    def weight(n: Column, kept: Column, p: Column) -> Column:
        left, open_share = F.lit(1.0) - kept / n, F.lit(1.0) - p
        return F.log10(F.greatest(left, least) / F.greatest(open_share, least)).alias("log_alpha")

    def gain(n: Column, log_alpha: Column) -> Column:
        return (F.log10(each / n) - log_alpha - F.log10("p")).alias("gain")

    of_numbers = rare.filter("h is not null")
    n, kept, p = F.sum("c"), F.sum(each), F.sum("p")
    own = has_number.filter("h is not null").unionByName(of_numbers).groupBy("h").agg(n.alias("n"), weight(n, kept, p)).toArrow()
    counts, alphas = np.zeros(len(numbers), np.int64), np.zeros(len(numbers))
    counts[own.column("h").to_numpy()] = own.column("n").to_numpy()
    alphas[own.column("h").to_numpy()] = own.column("log_alpha").to_numpy()
    numbered = F.broadcast(spark.createDataFrame(pa.table({"h": numbers, "n": counts, "log_alpha": alphas})))
    # Other histories are rare: their bigrams move once and get sums and gains side by side.
    sides = W.partitionBy("hh").orderBy("w", "ww")
    whole = sides.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = rare.filter("hh is not null").select(
        "hh", "w", "ww", "c", "p", F.row_number().over(sides).alias("at"),
        n.over(whole).alias("n"), kept.over(whole).alias("kept"), p.over(whole).alias("all_p"),
    )
    weighed = sums.withColumn("log_alpha", weight(F.col("n"), F.col("kept"), F.col("all_p")))
    of_others = stored(
        weighed.select("hh", "w", "ww", gain(F.col("n"), F.col("log_alpha")), F.when(F.col("at") == 1, F.col("log_alpha")).alias("log_alpha")),
        "histories",
    )
    others = of_others.filter("log_alpha is not null").select("hh", "log_alpha")
    met = of_numbers.join(numbered, "h").select("h", "hh", "w", "ww", gain(F.col("n"), F.col("log_alpha")))
    gains = met.unionByName(of_others.select(F.lit(None).cast("int").alias("h"), "hh", "w", "ww", "gain"))
    # Fewer than HELD by their share of all tokens.
    often = table.filter("h is not null and w is not null").filter(F.col("c") > F.lit(model.tokens / HELD))
    often = often.select("h", "w", "c").toArrow()
    h, w = (often.column(x).to_numpy().astype(np.uint64) for x in ("h", "w"))
    keys = (h << _U(32)) | w
    order = np.argsort(keys)
    pairs = Bigrams(counts, alphas, discounts, keys[order], np.zeros(len(keys)))
    held = pairs.gain(keys[order], often.column("c").to_numpy().astype(np.int64)[order], model.log_p)
    return replace(pairs, gains=held), others, gains


def _message(kind: int, part: int, values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([values], pa.list_(pa.binary()))],
        names=["kind", "part", "values"],
    )


def _raw(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _read(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


def _joined(values: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(values) if values else np.zeros(0, kind)


def _asked(model: Unigrams, pairs: Bigrams, pair_parts: int, word_parts: int):
    """mapInArrow: (row, doc_id, text) to messages.

    OWN: what a block of rows knows itself: tokens, known, base and backed-off score. PAIR and
    WORD: sorted keys asked of one part of a table, with the rows that ask and how often.
    A row is its id and 32 bits of its content's hash; without an id, the whole hash stands for it.
    """
    log_p = model.log_p
    base = np.log10(model.counts + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, bounds in _chunks(batches):
            n, every = len(ids), np.array([r for r, _ in ids], np.int64)
            named = np.array([r if i is None else i for r, i in ids], np.int64)
            nameless = np.array([i is None for _, i in ids], np.int64)
            numbers = model.number(words)
            row = np.repeat(np.arange(n, dtype=np.uint32), np.diff(bounds))
            left, right, key_row = _pairs(model.codes(words, numbers), bounds)
            keys = _key(left, right)
            # What words without a number add comes from the word table.
            score = np.zeros(n)
            for s in _slices(len(keys)):
                h, w = (np.where(x[s] < CODES, x[s], 0).astype(np.int64) for x in (left, right))
                np.add.at(score, key_row[s], pairs.log_alpha[h] + log_p[w])
            del left, right
            held, gain = pairs.held_gain(keys)
            score += np.bincount(key_row[held], gain, n)
            rare = numbers == 0
            known = np.bincount(row[~rare], minlength=n) + int(model.counts[END] > 0)
            based = np.bincount(row[~rare], base[numbers[~rare]], n) + base[END]
            keys, key_row = keys[~held], key_row[~held]
            words, row = words[rare], row[rare]
            del numbers, rare, held, gain
            tokens = np.diff(bounds) + 1
            own_part, every = int(every[0] % pair_parts), every.astype(np.int32)
            own = (named, every, tokens, known, based, score, nameless)
            yield _message(OWN, own_part, [_raw(c.astype(k)) for c, k in zip(own, FORM)])
            yield from _requests(PAIR, keys, key_row, pair_parts, named, every)
            yield from _requests(WORD, words, row, word_parts, named, every)
            del keys, key_row, words, row

    return run


def _requests(
    kind: int, keys: np.ndarray, rows: np.ndarray, parts: int, named: np.ndarray, every: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """One message for each part: keys, numbers of the rows that ask them, how often, ids and hashes of these rows.

    `rows` come in order, and equal keys of a part keep it.
    """
    for p, mine in _by_part(keys, parts):
        asked, asking = keys[mine], rows[mine]
        order = np.argsort(asked, kind="stable")
        asked, asking = asked[order], asking[order]
        first = np.flatnonzero(_firsts(asked, asking))
        times = np.diff(np.append(first, len(asked))).astype(np.uint32)
        asking, number = _numbered(asking[first], len(named))
        values = (number.astype(np.uint32), times, named[asking], every[asking])
        yield _message(kind, p, [_pack(asked[first]), *map(_raw, values)])


def _numbered(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of these row numbers below n, and where each stands among them."""
    if len(rows) < n:
        return np.unique(rows, return_inverse=True)
    met = np.zeros(n, bool)
    met[rows] = True
    return np.flatnonzero(met), (np.cumsum(met) - 1)[rows]


def _answering(model: Unigrams, pairs: Bigrams):
    """cogroup: the messages to one part and the part's packed rows to sums by row.

    Weights are the gains of bigrams that aren't made of numbers, and those of words as histories.
    """
    log_p = model.log_p

    def of_pairs(keys: np.ndarray, found: np.ndarray, v: np.ndarray) -> tuple:
        hashed = keys >= TOP
        gain = pairs.gain(np.where(hashed, 0, keys), found, log_p)
        return 0.0 * found, 0.0 * found, np.where(found > 0, np.where(hashed, v, gain), 0.0)

    def of_words(keys: np.ndarray, found: np.ndarray, v: np.ndarray) -> tuple:
        return (found > 0) * 1.0, np.log10(found + 1.0), model.log_share(found) - log_p[0] + v

    def run(key: tuple, asked: pa.Table, table: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        out: list[tuple] = []
        if kind == OWN:
            for values in asked.column("values").to_pylist():
                out.append(tuple(_read(v, k) for v, k in zip(values, FORM)))
        else:
            known = _joined([_unpack(k, np.uint64) for k in table.column("keys").to_pylist()], np.uint64)
            counts = _joined([_read(c, np.int64) for c in table.column("counts").to_pylist()], np.int64)
            extra = _joined([_read(v, np.float64) for v in table.column("weights").to_pylist()], np.float64)
            order = np.argsort(known, kind="stable")
            known, counts, extra = known[order], counts[order], extra[order]
            for values in asked.column("values").to_pylist():
                keys, rows, times = _unpack(values[0], np.uint64), _read(values[1], np.uint32), _read(values[2], np.uint32)
                named, every = _read(values[3], "q"), _read(values[4], "i")
                found, v = np.zeros(len(keys), np.int64), np.zeros(len(keys))
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    found, v = (np.where(known[at] == keys, x[at], 0) for x in (counts, extra))
                sums = [np.bincount(rows, v * times, len(every)) for v in (of_pairs if kind == PAIR else of_words)(keys, found, v)]
                none = np.zeros(len(every), np.int64)
                out.append((named, every, none, *sums, none - 1))
        names = ["doc_id", "row", "tokens", "known", "base", "score", "nameless"]
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, k) for i, k in enumerate(FORM)]
        return pa.table(dict(zip(names, columns)))

    return run


def _packed(kind: int, parts: int):
    """mapInArrow: (word, c, v) or (h, w, c, v) to (kind, part, keys, counts, weights), some TABLE_ROWS at a time."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        *words, c, v = (rows.column(i).to_numpy() for i in range(rows.num_columns))
        words = [x.view(np.uint64) for x in words]
        keys = _key(*words) if len(words) == 2 else words[0]
        part = _part(keys, parts)
        order = np.lexsort((keys, part))
        keys, c, v = keys[order], c[order], v[order]
        found, first = np.unique(part[order], return_index=True)
        cuts = [*first.tolist(), len(keys)]
        out = [(_pack(keys[a:b]), _raw(c[a:b]), _raw(v[a:b])) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(found), kind, np.int32)),
                pa.array(found.astype(np.int32)),
                *[pa.array([o[i] for o in out], pa.binary()) for i in range(3)],
            ],
            names=["kind", "part", "keys", "counts", "weights"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= TABLE_ROWS:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def train(docs: DataFrame, vocabulary: int | None = None) -> tuple[Unigrams, Bigrams, DataFrame, int, int]:
    """From rows (doc_id, text): the models, the packed tables (kind, part, keys, counts, weights), and their parts."""
    counted = docs.mapInArrow(_counted_words, "word bigint, c bigint")
    words = stored(counted.groupBy("word").agg(F.sum("c").alias("c")), "words")
    model = unigrams(words, vocabulary)
    pair_parts = max(LEAST_PARTS, math.ceil(model.tokens / PART_TOKENS))
    word_parts = max(LEAST_PARTS, math.ceil(4 * model.types / PART_TOKENS))
    chunks = docs.mapInArrow(_counted_pairs(model, pair_parts), "part int, keys binary, words binary, counts binary")
    summed = chunks.groupBy("part").applyInArrow(_summed_pairs, "part int, h int, w int, hh bigint, ww bigint, c bigint")
    table = stored(summed, "pairs")
    pairs, others, gains = backoff(table, words, model)

    weighed = words.join(others, words["word"] == others["hh"], "left").select(
        "word", "c", F.coalesce("log_alpha", F.lit(0.0)).alias("v")
    )
    h, w = F.col("h").cast("bigint"), F.col("w").cast("bigint")
    numbered = table.filter("h is not null and w is not null").select(h.alias("h"), w.alias("w"), "c", F.lit(0.0).alias("v"))
    hashed = gains.select(F.coalesce("hh", h).alias("h"), F.coalesce("ww", w).alias("w"), F.lit(1).cast("bigint"), "gain")
    form = "kind int, part int, keys binary, counts binary, weights binary"
    tables = weighed.mapInArrow(_packed(WORD, word_parts), form).unionByName(
        numbered.union(hashed).mapInArrow(_packed(PAIR, pair_parts), form)
    )
    return model, pairs, tables, pair_parts, word_parts


def score(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 7,
    held_out_fold: int = 2,
    vocabulary: int | None = None,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held_out = F.coalesce(id_hash(F.col("doc_id")) % folds == held_out_fold, F.lit(False))
    model, pairs, tables, pair_parts, word_parts = train(rows.filter(~held_out), vocabulary)
    # A row is told by its id and content, so that it stays the same if a task runs again; equal rows share one sum.
    asked = rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").mapInArrow(
        _asked(model, pairs, pair_parts, word_parts), "kind int, part int, values array<binary>"
    )
    answered = (
        asked.groupBy("kind", "part")
        .cogroup(tables.groupBy("kind", "part"))
        .applyInArrow(
            _answering(model, pairs),
            "doc_id bigint, row int, tokens bigint, known double, base double, score double, nameless bigint",
        )
    )
    own = F.col("nameless") >= 0
    summed = answered.groupBy(F.col("doc_id").alias("id"), "row").agg(
        F.count(F.when(own, 1)).alias("copies"),
        F.max(F.when(F.col("nameless") == 0, F.col("doc_id"))).alias("doc_id"),
        *[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")],
    )
    each = math.log10(model.tokens + model.types + 1)
    tokens = (F.col("tokens") / F.col("copies")).cast("bigint")
    return (
        summed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id",
            held_out.alias("held_out"),
            tokens.alias("n_tokens"),
            F.round(F.col("known") / F.col("copies")).cast("bigint").alias("n_known"),
            F.lit(model.tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") / F.col("copies") - tokens * F.lit(each)).alias("base_score"),
            (F.col("score") / F.col("copies")).alias("score"),
        )
    )

"""Exact Jaccard self-join on word shingles by partitioning the universe.

Shingle hashes are split into equal ranges, the segments; how many depends on
the band of set sizes [2^b, 2^(b+1)). Two sets that link differ in at most H
shingles, so of m segments at least m - H hold the same subset in both. Every
set is indexed by its subsets of the first slack * (H + 1) segments (and by
those of the band below, where a partner may lie). Subsets are summed hashes, so
the subset less one shingle is a subtraction.

What to look for is weighed by set, after counting how many sets hold each
subset. A set looks in its H + 1 rarest subsets only (of two sets that link the
rarest common subset is among them on both sides); it skips the others, and
those that nobody else holds cost nothing. Where even these include dear
subsets, held by more than DEAR sets, its cheap segments may count twice: it is
also indexed by their subsets less one shingle, which finds a difference of one,
and gives up the dear ones if they cost more than these neighbours.

Candidates meet in buckets of equal subsets. Every set carries a sketch: the
parities of how many of its shingles fall on each of 256 places. A shingle more
or less flips one parity, so sets whose sketches differ in more places than
linked sets may differ in shingles don't link; that leaves out most pairs while
they are joined, before a text is read.

Buckets are worked off by stars: every set is compared with one representative,
whole and exactly; what still lies in different components is compared with
further representatives, and at last pair by pair. Pairs inside one component
need no proof, so a group of n near copies costs about n comparisons, not n^2,
and no link between different components is lost.

Sets with equal shingles form one class from the start (64-bit hashes of
shingles and of sets stand for them).

Defined cases: a null text counts as empty; a text without words has no
shingles and is its own component; rows that repeat an id are told apart by
their texts; rows of a null id link as others do, and the component of nothing
but such rows is null; a very long text is one set, held by one task; an empty
table gives an empty result; further columns of the input are not read.

Written steps are deleted once what follows from them has been written too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import discard, kept, small_side
from plumbline.llm.components import components
from plumbline.llm.shingles import mix, sets_of

WORDS = 4
PERCENT = 85
SLACK = 1.25
# More choice of rare subsets, at twice the index.
WIDE_SLACK = 2.5
DEAR = 64
NEIGHBOUR_COST = 1_000
MAX_BROADCAST_IDS = 1_000_000
BITMAP_BITS = 27
PAIRS_PER_CLASS = 500
STAR_ROUNDS = 6
SLOTTED = 16
PAIRS_HELD = 500
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
EARLIER = 8
SKETCH = ("s0", "s1", "s2", "s3")
# Unlike sets flip about 128 of the 256 parities; up to here sketches tell them from sets that link.
SKETCH_TELLS = 96
_U = np.uint64

# A row stands for a document (band -1), for the shape of its index in a band, or for one subset.
SUBSETS = (
    "doc_id bigint, key bigint, n int, class bigint, band int, subset bigint, dropped boolean, emitted int, asked int, reach int, "
    + ", ".join(f"{s} bigint" for s in SKETCH)
)


def differences(r: int, s: int, percent: int) -> int:
    """The most shingles in which linked sets of these sizes can differ."""
    return (100 - percent) * (r + s) // (100 + percent)


def own_differences(n: int, percent: int) -> int:
    """The same for a set of n and its largest partner."""
    return differences(n, n * 100 // percent, percent)


def emitted(worst: int, slack: float = SLACK) -> int:
    """How many segments a set is indexed by if it can differ in `worst` shingles."""
    return math.ceil(slack * (worst + 1))


def worst_of(sizes: np.ndarray, band: int, percent: int) -> np.ndarray:
    """How many shingles sets of these sizes can differ in from partners that meet them in the band."""
    above = (2 << band) - 1
    return differences(sizes, np.where(sizes <= above, sizes * 100 // percent, above), percent)


def segments_of(sizes: np.ndarray, band: int, percent: int, slack: float = SLACK) -> np.ndarray:
    """How many segments sets of these sizes are indexed by in the band.

    Empty segments are equal in unlike sets. Where sketches are too narrow to tell those apart, a set
    is indexed by as many segments as it takes to ask in filled ones only, in all but about 1 of 1,000 cases.
    """
    worst = worst_of(sizes, band, percent)
    least = np.ceil(slack * (worst + 1)).astype(np.int64)
    total = emitted(own_differences((2 << band) - 1, percent), slack)
    # The share of empty segments, exp(-n / total), by steps that round alike for one size and many.
    empty = np.maximum(0.0, 1 - sizes / (1024 * total))
    for _ in range(10):
        empty = empty * empty
    # filled * m - spread * sqrt(m) = worst + 1
    filled, spread = 1 - empty, 3 * np.sqrt(empty * (1 - empty))
    root = (spread + np.sqrt(spread * spread + 4 * filled * (worst + 1))) / (2 * filled)
    enough = np.minimum(total, np.ceil(root * root).astype(np.int64))
    return np.where(differences(sizes, sizes, percent) < SKETCH_TELLS, least, np.maximum(least, enough))


@lru_cache(maxsize=20_000)
def bands_of(n: int, percent: int, slack: float = SLACK) -> tuple[tuple[int, int, int, int], ...]:
    """(band, segments to index, segments to ask, cheap segments that make do with neighbours) of a set of n.

    A smaller partner is indexed by fewer segments. Those it lacks count as
    different, hence the set asks in that many more: as many as the worst of
    the partner sizes of the band needs, and no more.
    """
    band, least, most = n.bit_length() - 1, -(-n * percent // 100), n * 100 // percent
    bands = [band]
    if band and least < 1 << band:
        bands.append(band - 1)
    # Partners of the next band are indexed in this one as well, by what they can differ in from its sets.
    sizes = np.arange(least, most + 1)
    found = []
    for b in bands:
        own = np.array([n])
        mine, worst = int(segments_of(own, b, percent, slack)[0]), int(worst_of(own, b, percent)[0])
        partners = sizes[sizes >= 1 << b] if b == band else sizes[sizes <= (2 << b) - 1]
        lacking = np.maximum(0, mine - segments_of(partners, b, percent, slack))
        missed = int((differences(n, partners, percent) + lacking).max())
        found.append((b, mine, min(mine, missed + 1), int(lacking.max()) + worst // 2 + 1))
    return tuple(found)


def segment_ends(tokens: np.ndarray, band: int, segments: int, percent: int, slack: float = SLACK) -> np.ndarray:
    """Where each of the first `segments` ranges of the universe ends in the sorted tokens."""
    total = emitted(own_differences((2 << band) - 1, percent), slack)
    cuts = np.arange(1, segments + 1, dtype=np.uint64) * _U(((1 << 64) - 1) // total)
    ends = np.searchsorted(tokens, cuts, "left")
    if segments >= total:
        ends[-1] = len(tokens)
    return np.concatenate([[0], ends])


def set_class(tokens: np.ndarray) -> np.ndarray:
    return mix(np.array([np.sum(mix(tokens), dtype=np.uint64) + _U(len(tokens))], np.uint64))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall on each of 256 places, modulo 2, as four 64-bit numbers."""
    places = np.bincount((mix(tokens) & _U(255)).astype(np.int64), minlength=256)
    return np.packbits((places & 1).astype(np.uint8)).view(np.int64)


def may_link(x: str, y: str, percent: int) -> str:
    """SQL for whether two sets can link by their sizes and sketches; x, y: the prefixes of their columns."""
    most = f"({100 - percent} * ({x}n + {y}n)) div {100 + percent}"
    flips = " + ".join(f"bit_count({x}{s} ^ {y}{s})" for s in SKETCH)
    return f"abs({x}n - {y}n) <= {most} and {flips} <= {most}"


def _code(sums: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    return mix(sums + mix(segment.astype(np.uint64) + _U((band + 1) << 40)))


def subsets(
    tokens: np.ndarray, band: int, segments: int, percent: int, drops: bool, slack: float = SLACK
) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsets, and of those less one token if `drops`; the latter are marked."""
    ends = segment_ends(tokens, band, segments, percent, slack)
    mixed = mix(tokens)
    running = np.concatenate([[_U(0)], np.cumsum(mixed, dtype=np.uint64)])
    sums = running[ends[1:]] - running[ends[:-1]]
    nth = np.arange(segments)
    whole = _code(sums, nth, band)
    if not drops:
        return whole, np.zeros(segments, bool)
    of = np.repeat(nth, np.diff(ends))
    less = _code(sums[of] - mixed[: len(of)], of, band)
    return np.concatenate([whole, less]), np.arange(segments + len(less)) >= segments


def _index(words: int, percent: int, drops: bool, slack: float):
    """mapInArrow: (doc_id, text, key) to the rows of SUBSETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for row, tokens in enumerate(sets_of(batch.column(1), words)):
                n, cls, sketched = len(tokens), set_class(tokens)[0], sketch(tokens)
                parts.append((row, n, cls, -1, None, None, 0, 0, 0, sketched))
                for band, segments, asked, reach in bands_of(n, percent, slack) if n else []:
                    codes, less = subsets(tokens, band, segments, percent, drops, slack)
                    parts.append((row, n, cls, band, None, None, segments, asked, reach, sketched))
                    parts.append((row, n, cls, band, codes, less, 0, 0, 0, sketched))
                    held += len(codes)
                if held > 200_000:
                    yield _rows(batch, parts)
                    parts, held = [], 0
            if parts:
                yield _rows(batch, parts)

    return run


def _rows(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
    times = np.array([1 if p[4] is None else len(p[4]) for p in parts])
    none = np.repeat([p[4] is None for p in parts], times)
    codes = np.concatenate([np.zeros(1, np.uint64) if p[4] is None else p[4] for p in parts])
    less = np.concatenate([np.zeros(1, bool) if p[5] is None else p[5] for p in parts])
    spread = lambda i, kind: np.repeat(np.array([p[i] for p in parts], dtype=kind), times)
    # Subset rows keep their class and band only.
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(spread(0, np.int64), mask=~none)),
            batch.column(2).take(pa.array(spread(0, np.int64), mask=~none)),
            pa.array(spread(1, np.int32), mask=~none),
            pa.array(spread(2, np.uint64).view(np.int64)),
            pa.array(spread(3, np.int32)),
            pa.array(codes.view(np.int64), mask=none),
            pa.array(less, mask=none),
            *[pa.array(spread(i, np.int32), mask=~none) for i in (6, 7, 8)],
            *[pa.array(column, mask=~none) for column in np.repeat(np.stack([p[9] for p in parts]), times, axis=0).T],
        ],
        names=["doc_id", "key", "n", "class", "band", "subset", "dropped", "emitted", "asked", "reach", *SKETCH],
    )


def with_place(codes: DataFrame) -> DataFrame:
    """Add place, the bit of a bitmap of 2^BITMAP_BITS that stands for a subset, and region, its 16 words."""
    placed = codes.withColumn("place", F.shiftrightunsigned("subset", 64 - BITMAP_BITS))
    return placed.withColumn("region", F.shiftright("place", 10))


def bitmap(codes: DataFrame) -> DataFrame:
    """(region, words) of the bitmap with the bits of these subsets set: at most 2^(BITMAP_BITS - 10) rows, 23 MB."""
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = [F.bit_or(F.when(F.expr(f"(shiftright(place, 6) & 15) = {i}"), bit)) for i in range(16)]
    return with_place(codes).groupBy("region").agg(F.array(*[F.coalesce(w, F.lit(0).cast("bigint")) for w in words]).alias("words"))


def _linked(words: int, percent: int):
    """mapInArrow: (a, b, text of a, text of b) to the pairs that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            ends = batch.column(0).to_pylist()
            keep = np.zeros(len(ends), bool)
            right = sets_of(batch.column(3), words)
            for i, (a, y) in enumerate(zip(ends, right)):
                if a != known[0]:
                    known = (a, next(sets_of(batch.column(2).slice(i, 1), words)))
                x = known[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep)
            )

    return run


class _Join:
    """The steps of one run, with their parameters."""

    def __init__(self, docs: DataFrame, words: int, percent: int, dear: int, neighbour_cost: int, slack: float):
        self.docs, self.words, self.percent, self.slack = docs, words, percent, slack
        self.dear, self.neighbour_cost = dear, neighbour_cost

    def index(self) -> DataFrame:
        """Every document and its subsets."""
        return kept(self.docs.mapInArrow(_index(self.words, self.percent, False, self.slack), SUBSETS), "subsets")

    def shared(self, index: DataFrame) -> DataFrame:
        """Subsets that several classes hold: class, band, subset, held."""
        rows = index.filter("subset is not null").select("class", "band", "subset")
        repeated = rows.groupBy("subset").agg(F.count("*").alias("times")).filter("times > 1").select("subset")
        # The bitmap lets all repeated subsets through and few others, which `held` drops.
        likely = with_place(rows).join(F.broadcast(bitmap(repeated)), "region").filter(
            "getbit(get(words, cast(shiftright(place, 6) & 15 as int)), cast(place & 63 as int)) = 1"
        )
        several = kept(likely.select("class", "band", "subset").distinct(), "several")
        held = several.groupBy("subset").agg(F.count("*").alias("held")).filter("held > 1")
        shared = kept(several.join(held, "subset"), "shared")
        discard(several)
        return shared

    @staticmethod
    def shapes(index: DataFrame) -> DataFrame:
        """How each class is indexed in its bands."""
        shapes = index.filter("emitted > 0").groupBy("class", "band")
        return kept(shapes.agg(*[F.max(c).alias(c) for c in ("n", "emitted", "asked", "reach", *SKETCH)]), "shapes")

    def texts_of(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """class, text: one text for each of the classes.

        A class is found by the id and the text's hash of one of its rows, of one that isn't repeated if it can.
        """
        rows = members.groupBy("class", "doc_id", "key").agg(F.count("*").alias("times"))
        one = F.min(F.struct("times", F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
        wanted = kept(
            rows.join(classes.select("class").distinct(), "class").groupBy("class").agg(one.alias("row"))
            .select("class", "row.times", F.col("row.doc_id").alias("_id"), F.col("row.key").alias("_key")),
            "wanted",
        )
        asked = small_side(wanted, MAX_BROADCAST_IDS)
        same = self.docs["doc_id"].eqNullSafe(F.col("_id")) & (self.docs["key"] == F.col("_key"))
        met = self.docs.join(asked, same).select("class", "text", "times")
        if wanted.filter("times > 1").limit(1).count() == 0:
            return met.drop("times")
        repeated = met.filter("times > 1").dropDuplicates(["class"])
        return met.filter("times = 1").unionByName(repeated).drop("times")

    def allocate(self, shapes: DataFrame, shared: DataFrame, texts: DataFrame) -> DataFrame:
        """Bucket rows (subset, class, n, sketch, large, asks): where each set looks for partners, or is only found."""
        one = W.partitionBy("class", "band")
        dear = F.col("held") > self.dear
        weighed = (
            shared.join(shapes, ["class", "band"])
            .withColumn("alone", F.col("emitted") - F.count("*").over(one))
            .withColumn("nth", F.row_number().over(one.orderBy("held", "subset")))
            .withColumn("chosen", F.col("nth") <= F.col("asked") - F.col("alone"))
            .withColumn("dear_cost", F.sum(F.when(dear & F.col("chosen"), F.col("held")).otherwise(0)).over(one))
            .withColumn("cheap", F.col("emitted") - F.sum(dear.cast("int")).over(one))
            .withColumn(
                "near", (F.col("cheap") >= F.col("reach")) & (F.col("dear_cost") > self.neighbour_cost * F.col("n"))
            )
        )
        weighed = kept(
            weighed.filter("chosen or near").select(
                "subset", "class", "n", *SKETCH, "near", dear.alias("dear"), (F.col("held") > SLOTTED).alias("large")
            ),
            "allocation",
        )
        plain = weighed.filter("not near or not dear").select(
            "subset", "class", "n", *SKETCH, "large", F.lit(True).alias("asks")
        )
        given_up = weighed.filter("near and dear").select("subset").distinct()
        if given_up.limit(1).count() == 0:
            return plain
        # A partner that only a neighbour can find shares a subset that was given up.
        holders = shared.join(given_up, "subset", "left_semi").select("class").distinct()
        near = (
            texts.join(holders, "class", "left_semi")
            .select(F.col("class").alias("doc_id"), "text", F.col("class").alias("key"))
            .mapInArrow(_index(self.words, self.percent, True, self.slack), SUBSETS)
            .filter("subset is not null")
            .select("subset", "class", "dropped")
        )
        met = near.groupBy("subset").agg(
            F.min("class").alias("low"), F.max("class").alias("high"), F.min("dropped").alias("whole"), F.max("dropped").alias("less")
        )
        near = near.join(met.filter("low <> high and not whole and less").select("subset"), "subset")
        sizes = shapes.groupBy("class").agg(*[F.max(c).alias(c) for c in ("n", *SKETCH)])
        near = near.join(sizes, "class").select(
            "subset", "class", "n", *SKETCH, F.lit(True).alias("large"), (~F.col("dropped")).alias("asks")
        )
        return plain.unionByName(near)

    def verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        ends = kept(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "ends")
        texts = texts.join(small_side(ends, MAX_BROADCAST_IDS), "class", "left_semi")
        a = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
        spark = pairs.sparkSession
        usual = spark.conf.get(_BATCH_ROWS)
        # Rows of two texts: a usual batch of them takes much memory beside the heap, and again in Python.
        spark.conf.set(_BATCH_ROWS, str(PAIRS_HELD))
        try:
            linked = kept(both.mapInArrow(_linked(self.words, self.percent), "a bigint, b bigint"), "links")
        finally:
            spark.conf.set(_BATCH_ROWS, usual)
        discard(ends)
        return linked

    def roots(self, open_rows: DataFrame, texts: DataFrame) -> DataFrame | None:
        """(node, root) of the classes that link, by verified links that connect everything that is connected."""
        found: DataFrame | None = None
        tried: DataFrame | None = None
        for turn in range(STAR_ROUNDS + 1):
            if found is None:
                rows = open_rows.withColumn("root", F.col("class"))
            else:
                rows = open_rows.drop("root").join(
                    found.withColumnRenamed("node", "class"), "class", "left"
                ).withColumn("root", F.coalesce("root", "class"))
            parts = rows.groupBy("subset", "root").agg(F.count("*").alias("n"), F.max("asks").alias("asks"))
            whole = parts.groupBy("subset").agg(
                F.sum("n").alias("n"),
                F.sum(F.col("n").cast("double") * F.col("n")).alias("inside"),
                F.min("root").alias("low"),
                F.max("root").alias("high"),
                F.max("asks").alias("asks"),
            )
            undecided = kept(whole.filter("low <> high and asks"), "undecided")
            work = undecided.agg(
                F.sum((F.col("n").cast("double") * F.col("n") - F.col("inside")) / 2).alias("pairs"),
                F.sum("n").alias("rows"),
            ).first()
            if not work["rows"]:
                return found
            decided, open_rows = open_rows, kept(rows.join(undecided.select("subset"), "subset"), "buckets")
            discard(decided, undecided)
            last = turn == STAR_ROUNDS or turn > 1 and work["pairs"] <= PAIRS_PER_CLASS * work["rows"]
            pairs = self._all_pairs(open_rows) if last else self._star(open_rows, turn)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = kept(pairs, "pairs")
            linked = self.verify(pairs, texts)
            found, before = self._merged(found, linked), found
            discard(linked, *([] if before is None else [before]))
            if last:
                return found
            tried = pairs if tried is None else tried.unionByName(pairs)
        return found

    @staticmethod
    def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
        """The roots after further links; only the links' ends and roots are looked at again."""
        if roots is None:
            return components(links)
        at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
        moved = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
        further = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        old = roots.join(further, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
        merged = kept(old.unionByName(moved.join(roots, "node", "left_anti")), "roots")
        discard(moved)
        return merged

    def by_size(self, buckets: DataFrame) -> DataFrame:
        """Large buckets split into slots of sizes that can link: a set lies in its own slot and the next."""
        slot = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / self.percent) * 1.000001))
        once = buckets.groupBy("subset", "class").agg(*[F.max(c).alias(c) for c in ("asks", "large", "n", *SKETCH)])
        return once.withColumn("slot", F.explode(F.when(F.col("large"), F.array(slot, slot + 1)).otherwise(F.array(F.lit(0))))).select(
            F.xxhash64("subset", "slot").alias("subset"), "class", "asks", "n", *SKETCH
        )

    def _star(self, rows: DataFrame, turn: int) -> DataFrame:
        """Every member with one representative of its bucket, if the two may link.

        In the first turn a member meets only the representative it shares most
        buckets with; later turns draw other representatives from the bucket.
        """
        order = F.col("class") if turn == 0 else F.xxhash64("class", F.lit(turn))
        lead = rows.groupBy("subset").agg(F.min_by(F.struct("class", "root", "n", *SKETCH), order).alias("lead"))
        met = rows.alias("y").join(lead.select("subset", "lead.*").alias("x"), "subset").filter(self._open_pair())
        votes = met.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(F.count("*").alias("votes"))
        if turn == 0:
            best = votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a"))
            return best.select("a", "b")
        return votes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _all_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of different components that meet in a bucket where one of them asks, and may link.

        Sets that are much alike meet in many buckets; a pair that met in one of
        the last few before isn't listed again.
        """
        before = W.partitionBy("class").orderBy("subset").rowsBetween(-EARLIER, -1)
        rows = rows.withColumn("earlier", F.collect_list(F.when(F.col("asks"), F.col("subset"))).over(before))
        first = f"{self._open_pair()} and not arrays_overlap(x.earlier, y.earlier)"
        met = rows.filter("asks").alias("x").join(rows.alias("y"), "subset").filter(first)
        a, b = F.least("x.class", "y.class"), F.greatest("x.class", "y.class")
        return met.select(a.alias("a"), b.alias("b")).distinct()

    def _open_pair(self) -> str:
        return f"x.root <> y.root and {may_link('x.', 'y.', self.percent)}"


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    dear: int = DEAR,
    neighbour_cost: int = NEIGHBOUR_COST,
    slack: float = SLACK,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. `slack`, dear and neighbour_cost decide the cost only."""
    return _grouped(docs, doc_id, text, words, percent, dear, neighbour_cost, slack).drop("key")


def _grouped(
    docs: DataFrame, doc_id: str, text: str, words: int, percent: int, dear: int, neighbour_cost: int, slack: float
) -> DataFrame:
    """The result of near_duplicates with key, a hash of the row's text."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), key.alias("key"))
    join = _Join(picked, words, percent, dear, neighbour_cost, slack)
    index = join.index()
    listed = index.filter("band = -1").select("doc_id", "key", F.col("n").cast("bigint").alias("n_shingles"), "class")
    members, shapes = kept(listed, "members"), join.shapes(index)
    shared = join.shared(index)
    discard(index)
    texts = kept(join.texts_of(members, shared), "texts")
    buckets = kept(join.by_size(join.allocate(shapes, shared, texts)), "buckets")
    discard(shared, shapes)
    found = join.roots(buckets, texts)
    discard(texts)
    heads = members.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("head"))
    if found is not None:
        rooted = heads.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn(
            "root", F.coalesce("root", "class")
        )
        heads = rooted.join(
            rooted.groupBy("root").agg(F.min("head").alias("least")), "root"
        ).select("class", F.col("least").alias("head"))
    return members.join(heads, "class", "left").select(
        "doc_id",
        "key",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of `docs` less those with a smaller id in their group; rows of a null id stay."""
    found = _grouped(docs, doc_id, text, words, percent, DEAR, NEIGHBOUR_COST, SLACK)
    # By id and text: another text of the same id may stay.
    losers = kept(
        found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_loser"), F.col("key").alias("_key")).distinct(),
        "losers",
    )
    same = (docs[doc_id].cast("bigint") == F.col("_loser")) & (
        F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_key")
    )
    return docs.join(small_side(losers, MAX_BROADCAST_IDS), same, "left_anti")

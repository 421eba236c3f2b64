"""Text vectors and nearest neighbours by cosine distance.

A question's nearest items are found block by block: every task multiplies a
block of questions with a block of items and passes on only the nearest few
per question. Pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import stored

CANDIDATES = 30
# Distances are compared after rounding, so equal ones tie and ids decide.
DISTANCE_DIGITS = 9
BROADCAST_BYTES = 64 * 2**20
# Of one side, as doubles; a task holds both sides, their copies from Arrow and a few distances.
BLOCK_BYTES = 16 * 2**20
QUESTIONS_AT_ONCE = 512
DISTANCES_AT_ONCE = 2**21
EXACT_AT_ONCE = 2**16
SCAN_TASKS_PER_CORE = 4


# --- feature vectors -------------------------------------------------------


def hashed_terms(terms: DataFrame, dim: int = 256) -> DataFrame:
    """(id, bucket, tf): term frequencies (id, term, tf) folded into `dim` buckets."""
    bucket = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % dim
    return terms.groupBy("id", bucket.cast("int").alias("bucket")).agg(F.sum("tf").alias("tf"))


def fit_idf(hashed: DataFrame, n_items: Column | None = None) -> DataFrame:
    """(bucket, idf): smoothed inverse document frequency; at most one row per bucket.

    `n_items` saves counting the items again where an index already knows.
    """
    total = hashed.agg(F.count_distinct("id").alias("n")).scalar() if n_items is None else n_items
    return hashed.groupBy("bucket").agg(F.count("*").alias("df")).select(
        "bucket", F.log((total + 1) / (F.col("df") + 1)).alias("idf")
    )


def text_vectors(hashed: DataFrame, idf: DataFrame, dim: int = 256) -> DataFrame:
    """(id, embedding array<double>): unit vectors of tf * idf.

    Questions and items use the idf of the items, which puts both in one space.
    A text without a known term gets the zero vector. `hashed` is read more than
    once by callers, so it should be stored.
    """
    weighted = hashed.join(F.broadcast(idf), "bucket", "left").select(
        "id", "bucket", (F.col("tf") * F.coalesce("idf", F.lit(0.0))).alias("w")
    )

    # At most `dim` entries per text; the other places are filled up with zeros.
    entries = weighted.groupBy("id").agg(F.collect_list(F.struct("bucket", "w")).alias("e"))
    other = F.array_except(F.sequence(F.lit(0), F.lit(dim - 1)), F.col("e.bucket"))
    zeros = F.transform(other, lambda at: F.struct(at.alias("bucket"), F.lit(0.0).alias("w")))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda total, x: total + x["w"] * x["w"]))
    whole = F.transform("all", lambda x: F.when(F.col("norm") > 0, x["w"] / F.col("norm")).otherwise(F.lit(0.0)))
    return entries.select("id", F.array_sort(F.concat("e", zeros)).alias("all"), norm.alias("norm")).select("id", whole.alias("embedding"))


# --- nearest neighbours ----------------------------------------------------


def _unit(rows: pd.Series) -> np.ndarray:
    """Rows as unit vectors; a zero vector becomes NaN, and so do its distances."""
    matrix = np.asarray(rows.tolist(), dtype=np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / norms


def _sortable(ids: np.ndarray) -> np.ndarray:
    """Ids in a form numpy can sort; text sorts by code point."""
    return ids.astype(str) if ids.dtype == object else ids


class _Nearest:
    """The nearest items seen so far for a block of questions."""

    def __init__(self, questions: np.ndarray, limit: int) -> None:
        self.questions = questions
        self.coarse = questions.astype(np.float32)
        self.limit = limit
        self.bound = np.full(len(questions), np.inf)
        self.row = np.empty(0, dtype=np.int64)
        self.item: np.ndarray | None = None
        self.dist = np.empty(0)

    def _likely(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows and columns of all pairs that can be among the nearest, and few others; None if they are many or unknown.

        Found by products of floats, less the error they can have: half an eps
        for every factor and sum.
        """
        if not np.isfinite(self.bound).all():
            return None
        near = self.coarse @ vectors.astype(np.float32).T
        error = (vectors.shape[1] + 8) * np.finfo(np.float32).eps
        least = (1.0 - self.bound - 10.0**-DISTANCE_DIGITS - error).astype(np.float32)
        at = np.flatnonzero(near >= least[:, None])
        if len(at) > EXACT_AT_ONCE or np.isnan(near.sum()):
            return None
        return np.divmod(at, near.shape[1])

    def add(self, items: np.ndarray, vectors: np.ndarray) -> None:
        likely = self._likely(vectors)
        if likely is None:
            dist = np.round(1.0 - self.questions @ vectors.T, DISTANCE_DIGITS)
            dist[np.isnan(dist)] = np.inf  # sorts last
            if dist.shape[1] > self.limit:
                kth = np.partition(dist, self.limit - 1, axis=1)[:, self.limit - 1]
                self.bound = np.minimum(self.bound, kth)
            row, col = np.nonzero(dist <= self.bound[:, None])
            found = dist[row, col]
        else:
            row, col = likely
            found = np.round(1.0 - np.einsum("ij,ij->i", self.questions[row], vectors[col]), DISTANCE_DIGITS)
            kept = found <= self.bound[row]
            row, col, found = row[kept], col[kept], found[kept]
        row = np.concatenate([self.row, row])
        item = items[col] if self.item is None else np.concatenate([self.item, items[col]])
        value = np.concatenate([self.dist, found])
        order = np.lexsort((_sortable(item), value, row))
        row, item, value = row[order], item[order], value[order]
        first = np.searchsorted(row, row, side="left")
        nth = np.arange(len(row)) - first
        kept = nth < self.limit
        self.row, self.item, self.dist = row[kept], item[kept], value[kept]
        full = nth[kept] == self.limit - 1
        self.bound[self.row[full]] = np.minimum(self.bound[self.row[full]], self.dist[full])

    def frame(self, question_ids: np.ndarray) -> pd.DataFrame:
        value = np.where(np.isinf(self.dist), np.nan, self.dist + 0.0)
        items = [] if self.item is None else self.item
        return pd.DataFrame({"question_id": question_ids[self.row], "id": items, "dist": value})


def _schema(questions: DataFrame, corpus: DataFrame) -> str:
    return f"question_id {questions.schema['question_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, dist double"


def _final(partial: DataFrame, limit: int) -> DataFrame:
    # The rank limit applies before the exchange as well as after it.
    nearest = W.partitionBy("question_id").orderBy(F.asc_nulls_last("dist"), "id")
    return (
        partial.withColumn("dist", F.col("dist") + F.lit(0.0))
        .withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= limit)
    )


def _local(df: DataFrame, key: str, budget: int) -> pd.DataFrame | None:
    """The rows of `df` if they fit `budget` bytes; never fetches more than that."""
    head = df.select(key, "embedding").limit(1).toPandas()
    width = len(head["embedding"][0]) if len(head) else 1
    room = max(1, budget // (8 * width))
    rows = df.select(key, "embedding").limit(room + 1).toPandas()
    return rows if len(rows) <= room else None


def dense_topk(
    questions: DataFrame, corpus: DataFrame, limit: int = CANDIDATES, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(question_id, id, dist, rank): per question the `limit` nearest items, exactly.

    questions: (question_id, embedding); corpus: (id, embedding). The side that
    fits `broadcast_bytes` goes to every task and the other is scanned in place;
    when neither fits, the blocked form is used. The driver never holds more
    than that.
    """
    context = questions.sparkSession.sparkContext
    schema = _schema(questions, corpus)
    items = _local(corpus, "id", broadcast_bytes)
    if items is not None:
        if items.empty:
            return questions.sparkSession.createDataFrame([], schema + ", rank int")
        known = context.broadcast((items["id"].to_numpy(), _unit(items["embedding"])))

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = known.value
            for batch in batches:
                if len(batch):
                    yield _product(batch, ids, matrix, limit)

        return _final(questions.select("question_id", "embedding").mapInPandas(answer, schema), limit)

    asked = _local(questions, "question_id", broadcast_bytes)
    if asked is None:
        return dense_topk_blocked(questions, corpus, limit)
    if asked.empty:
        return questions.sparkSession.createDataFrame([], schema + ", rank int")
    shared = context.broadcast((asked["question_id"].to_numpy(), _unit(asked["embedding"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        best = _Nearest(matrix, limit)
        for batch in batches:
            if len(batch):
                best.add(batch["id"].to_numpy(), _unit(batch["embedding"]))
        yield best.frame(ids)

    # Fewer, longer tasks pass on fewer partial results; files are still read as a stream.
    tasks = SCAN_TASKS_PER_CORE * context.defaultParallelism
    return _final(corpus.select("id", "embedding").coalesce(tasks).mapInPandas(scan, schema), limit)


def _product(left: pd.DataFrame, ids: np.ndarray, matrix: np.ndarray, limit: int) -> pd.DataFrame:
    """The nearest items of a block, taken in steps that bound the distances held at once.

    Few questions at a time meet many items a step: every step sorts what its
    questions have found so far.
    """
    found = []
    for first in range(0, len(left), QUESTIONS_AT_ONCE):
        some = left.iloc[first : first + QUESTIONS_AT_ONCE]
        best = _Nearest(_unit(some["embedding"]), limit)
        step = max(1, DISTANCES_AT_ONCE // len(some))
        for start in range(0, len(ids), step):
            best.add(ids[start : start + step], matrix[start : start + step])
        found.append(best.frame(some["question_id"].to_numpy()))
    return pd.concat(found)


def _block_product(limit: int):
    def product(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"question_id": [], "id": [], "dist": []})
        return _product(left, right["id"].to_numpy(), _unit(right["embedding"]), limit)

    return product


def _parts(rows: int, width: int, block_bytes: int) -> int:
    return max(1, -(-rows * 8 * width // block_bytes))


def dense_topk_blocked(
    questions: DataFrame,
    corpus: DataFrame,
    limit: int = CANDIDATES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The same result when neither side may be broadcast: a grid of blocks.

    Ids are hashed into as many blocks per side as keep one block within
    `block_bytes`; each grid cell yields its nearest few per question.
    """
    # Fresh column identities: both sides may come from the same table.
    q = questions.select("question_id", F.col("embedding").alias("embedding"))
    c = corpus.select("id", F.col("embedding").alias("embedding"))
    first = q.filter(F.col("embedding").isNotNull()).select(F.size("embedding").alias("n")).head()
    width = first["n"] if first else 1
    parallel = q.sparkSession.sparkContext.defaultParallelism
    n_q = _parts(q.count(), width, block_bytes)
    n_c = max(_parts(c.count(), width, block_bytes), -(-parallel // n_q))
    left = q.select(
        "*",
        F.pmod(F.xxhash64("question_id"), F.lit(n_q)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"),
    )
    right = c.select(
        "*",
        F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"),
        F.pmod(F.xxhash64("id"), F.lit(n_c)).cast("int").alias("cb"),
    )
    cells = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))
    return _final(cells.applyInPandas(_block_product(limit), _schema(questions, corpus)), limit)


def fit_cells(corpus: DataFrame, n_cells: int = 16, seed: int = 42):
    """K-means cells over unit vectors, for `dense_topk_approx`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = _unit_rows(corpus, "id").select(array_to_vector("embedding").alias("features"))
    return KMeans(k=n_cells, seed=seed, maxIter=10).fit(points)


def _unit_rows(df: DataFrame, key: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return df.select(key, F.transform("embedding", lambda x: x.cast("double") / norm).alias("embedding"))


def dense_topk_approx(
    questions: DataFrame,
    corpus: DataFrame,
    limit: int = CANDIDATES,
    model=None,
    n_probe: int = 4,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Approximate nearest items: only the `n_probe` cells nearest to a question are searched.

    Searching all cells gives the exact result. Items and questions of large cells
    are split by salts into a grid of blocks, so that no task holds more than a
    block of each, however crowded a cell is.
    """
    from pyspark.ml.functions import array_to_vector

    model = model or fit_cells(corpus)
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    placed = (
        model.transform(_unit_rows(corpus, "id").withColumn("features", array_to_vector("embedding")))
        .select("id", "embedding", F.col("prediction").alias("cell"))
    )
    width = len(centers[0])

    def salts(rows: DataFrame, name: str) -> DataFrame:
        # One row per cell.
        n = F.ceil(F.count("*") * F.lit(8.0 * width / block_bytes)).cast("int")
        return rows.groupBy("cell").agg(n.alias(name))

    def dealt(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    unit = _unit_rows(questions, "question_id")
    dots = F.array(
        *[
            F.struct(
                F.aggregate(
                    F.zip_with("embedding", F.array(*[F.lit(x) for x in c]), lambda a, b: a * b),
                    F.lit(0.0),
                    lambda a, x: a + x,
                ).alias("dot"),
                F.lit(i).alias("cell"),
            )
            for i, c in enumerate(centers)
        ]
    )
    near = F.slice(F.reverse(F.array_sort(dots)), 1, n_probe)
    probed = unit.select("question_id", "embedding", F.explode(near).alias("p")).select("question_id", "embedding", "p.cell")
    # Cells that no question asks for or that have no items drop out.
    grid = F.broadcast(stored(salts(placed, "n_items").join(salts(probed, "n_asked"), "cell"), "cell-sizes"))
    left = probed.join(grid, "cell").select("question_id", "embedding", "cell", dealt("question_id", "n_asked").alias("qb"), each("n_items").alias("cb"))
    right = placed.join(grid, "cell").select("id", "embedding", "cell", each("n_asked").alias("qb"), dealt("id", "n_items").alias("cb"))
    place = ["cell", "qb", "cb"]
    cells = left.groupBy(*place).cogroup(right.groupBy(*place))
    return _final(cells.applyInPandas(_block_product(limit), _schema(questions, corpus)), limit)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(question_id, recall): share of the exact neighbours that were found."""
    found = approx.select("question_id", "id", F.lit(1).alias("hit"))
    return (
        exact.join(found, ["question_id", "id"], "left")
        .groupBy("question_id")
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )

"""Quality scores from zstandard dictionaries.

Two dictionaries are built, one from good and one from bad labelled texts. A
text is cut into pieces of about `piece_bytes`; every piece is compressed with
both. Its normalised difference, (bad size - good size) / length, says which
class explains it better; the piece that speaks loudest for the bad class
counts, so junk inside a good page is seen. A piece that repeats itself shrinks
to nothing under either dictionary, hence the smallest compressed share goes
into the calibration too. A logistic curve, fitted on labelled rows that the
dictionaries have not seen, turns both into a probability.

The fit uses at most `max_rows` labelled rows a class, chosen by a hash of the
id, and at most `max_bytes` of their pieces for each dictionary. Scoring reads
every text whole.

Defined cases: a null text counts as empty and gets a score as any other; where
a class has no labelled rows, the score is the share of good ones among those
given (1 without any); labels of null are ignored and a repeated label counts
as its smallest value; an empty table gives an empty result; columns that clash
with result columns are replaced by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_hash, without

MAX_ROWS = 3_000
MAX_BYTES = 8_000_000
DICTIONARY_BYTES = 400_000
PIECE_BYTES = 300
LEVEL = 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Dictionaries, and means, scales and weights of the calibration; without dictionaries a constant."""

    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float = 1.0
    piece_bytes: int = PIECE_BYTES


def pieces(text: str, size: int) -> list[bytes]:
    """The whole text in pieces of nearly equal length, one at least."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw) // size)
    ends = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def features(text: str, good, bad, size: int) -> tuple[float, float]:
    """The smallest normalised difference of a piece, and the log of its smallest compressed share."""
    least, share = math.inf, math.inf
    for piece in pieces(text, size):
        g, b = len(good.compress(piece)), len(bad.compress(piece))
        length = max(len(piece), 20)
        least, share = min(least, (b - g) / length), min(share, g / length)
    return least, math.log(max(share, 0.01))


def _dictionary(texts: list[str], size: int, max_bytes: int) -> bytes:
    samples = [p for t in texts for p in pieces(t, size) if p]
    step = max(1, math.ceil(sum(map(len, samples)) / max_bytes))
    samples = samples[::step]
    content = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, len(content) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        # Too few samples to train on: the texts themselves serve as the dictionary.
        return content[:DICTIONARY_BYTES] or b" " * 8


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    wide = np.column_stack([x[:, 0], x[:, 1], x[:, 0] ** 2])
    return np.column_stack([(wide - mean) / scale, np.ones(len(x))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * ridge
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def fit_texts(rows: list[tuple[str, int, bool]], piece_bytes: int = PIECE_BYTES, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on (text, label, whether the row is for the dictionaries)."""
    labels = [label for _, label, _ in rows]
    if len(set(labels)) < 2:
        return Model(constant=float(np.mean(labels)) if labels else 1.0)
    own = {
        label: [t for t, y, d in rows if y == label and d] or [t for t, y, _ in rows if y == label] for label in (0, 1)
    }
    good, bad = (_dictionary(own[label], piece_bytes, max_bytes) for label in (1, 0))
    rest = [(t, y) for t, y, d in rows if not d]
    if len({y for _, y in rest}) < 2:
        rest = [(t, y) for t, y, _ in rows]
    cg, cb = _compressor(good), _compressor(bad)
    x = np.array([features(t, cg, cb, piece_bytes) for t, _ in rest])
    wide = np.column_stack([x[:, 0], x[:, 1], x[:, 0] ** 2])
    mean, scale = wide.mean(0), wide.std(0) + 1e-9
    w = _logistic(_design(x, mean, scale), np.array([y for _, y in rest], dtype=float))
    return Model(good, bad, tuple(mean), tuple(scale), tuple(w), piece_bytes=piece_bytes)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_rows: int = MAX_ROWS,
) -> Model:
    """Fit on at most `max_rows` rows a class, all of them outside the held-out quarter."""
    given = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("_id").isNotNull() & F.col("_label").isNotNull())
        .filter(id_hash(F.col("_id")) % 4 != 2)
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
        .withColumn("_order", F.xxhash64(F.col("_id").cast("string")))
    )
    chosen = None
    for value in (0, 1):
        part = given.filter(F.col("_label") == value).orderBy("_order", "_id").limit(max_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most two times max_rows ids.
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .select("_text", "_label", (F.pmod("_order", F.lit(2)) == 0).alias("_own"), "_order")
        .orderBy("_order", "_text")
        .limit(2 * max_rows)
    )
    return fit_texts([(r["_text"], r["_label"], r["_own"]) for r in rows.toLocalIterator()])


def score_column(model: Model, text):
    """The probability that a text is good, as a column."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not model.good:
            for batch in batches:
                yield pd.Series(np.full(len(batch), model.constant))
            return
        good, bad = _compressor(model.good), _compressor(model.bad)
        for batch in batches:
            x = np.array([features(t, good, bad, model.piece_bytes) for t in batch]).reshape(-1, 2)
            z = _design(x, np.array(model.mean), np.array(model.scale)) @ np.array(model.weights)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return scored(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns of `docs` with score and predicted."""
    scored = without(docs, "score", "predicted").withColumn("score", score_column(model, F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

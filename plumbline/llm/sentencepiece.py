"""SentencePiece encoding and decoding with a streaming dynamic programme.

The vocabulary given here is of the BPE kind, so the best path is the one its
merges take, not the one of the largest sum of scores. A sequence of pieces is
what the merges make of a text exactly if each piece is made of itself and each
pair of neighbours is made of its own text; so every prefix has one surviving
path, and its last piece follows from the paths of the at most `longest`
prefixes before it. That window is all the encoder keeps. Whenever the
backpointers of all prefixes in it meet in one boundary, the ids up to there are
committed and forgotten.

A character outside the vocabulary is written as its bytes; no path spans it.
Nor does any path span the start of a word where no piece has a space behind
another character (the vocabulary is asked). Units between such points recur,
so their ids are kept in a bounded table.

U+2581, which stands for a space inside the vocabulary, is written as bytes when
it occurs in a text, so that decoding gives back every text exactly; this is the
one difference from the library.

Defined cases: a null text counts as empty and gives no ids; unpaired
surrogates can't occur in a Spark string; repeated rows are encoded alike; an
empty table gives an empty result; columns that clash with result columns are
replaced by them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import without

SPACE = "▁"
UNITS_KEPT = 400_000
PAIRS_KEPT = 600_000
LONG_UNIT = 256
HEAD = 5
HEADS_KEPT = 50_000
ROWS_HELD = 256


@dataclass
class Vocabulary:
    """Pieces by id with their scores; bytes that stand for characters outside it."""

    pieces: list[str]
    scores: list[float]
    byte_ids: dict[int, int]
    normal: dict[str, int]
    longest: int = 0
    joined: bool = False
    texts: list[bytes] = field(default_factory=list)
    standing: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.normal), default=1)
        # Whether some piece has a space behind another character.
        self.joined = any(SPACE in p.lstrip(SPACE) for p in self.normal)
        of_byte = {i: b for b, i in self.byte_ids.items()}
        self.texts = [
            bytes([of_byte[i]]) if i in of_byte else p.replace(SPACE, " ").encode() if p in self.normal else b""
            for i, p in enumerate(self.pieces)
        ]
        # Pieces that the merges make of their own text; the others never occur.
        self.standing = {p: i for p, i in self.normal.items() if len(merges(self, p)) == 1}


def merges(vocabulary: Vocabulary, text: str) -> list[str]:
    """What the merges make of a short text: the best scored neighbours first, from the left."""
    parts = list(text)
    ids, scores = vocabulary.normal, vocabulary.scores
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            found = ids.get(parts[i] + parts[i + 1])
            if found is not None and (best is None or scores[found] > best):
                best, at = scores[found], i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def load_vocabulary(model_file: str) -> Vocabulary:
    """Read a model file in the driver; the vocabulary goes to the tasks with the function."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    return Vocabulary(
        pieces,
        [model.get_score(i) for i in range(n)],
        {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)},
        {p: i for i, p in enumerate(pieces) if i not in special},
    )


class Encoder:
    """Encodes streams of text; the tables of units and pairs serve all tasks of a worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids, self.longest = vocabulary.standing, vocabulary.longest
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # The last pieces of all prefixes of the first HEAD characters of a unit: many units begin alike.
        self.heads: dict[str, list[int]] = {}
        self.line_break = self._bytes("\n")
        # Where no piece joins words, a word with the spaces before it is a unit.
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not vocabulary.joined else "(?s).+")
        self.outside = re.compile("([^" + "".join(map(re.escape, (p for p in vocabulary.normal if len(p) == 1))) + "])")

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave the two pieces as they are when they stand side by side."""
        key = left * len(self.v.pieces) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            a, b = self.v.pieces[left], self.v.pieces[right]
            known = self.pairs[key] = merges(self.v, a + b) == [a, b]
        return known

    def stream(self, characters: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters, each as soon as it is certain."""
        text = ""  # the window: what is not committed yet
        last = [-1]  # for each prefix of the window its last piece; -1 at the very start
        for c in characters:
            if c not in self.ids:
                yield from self._path(last, len(text))
                text, last = "", [-1]
                yield from (self.v.byte_ids[b] for b in c.encode())
                continue
            text += c
            self._extend(text, last, len(text))
            if len(text) >= 4 * self.longest:
                meet = self._meeting(last)
                if meet:
                    yield from self._path(last, meet)
                    # The piece before the boundary stays: the next one must fit it.
                    text, last = text[meet:], last[meet:]
        yield from self._path(last, len(text))

    def _extend(self, text: str, last: list[int], end: int) -> None:
        """Append the last piece of the surviving path of the window up to `end`."""
        ids, pairs, size = self.ids, self.pairs, len(self.v.pieces)
        for at in range(max(0, end - self.longest), end):
            piece = ids.get(text[at:end])
            if piece is None:
                continue
            before = last[at]
            if before >= 0:
                fit = pairs.get(before * size + piece)
                if fit is None:
                    fit = self.fits(before, piece)
                if not fit:
                    continue
            last.append(piece)
            return

    def _meeting(self, last: list[int]) -> int:
        """The boundary in which the paths of all prefixes that a later piece can follow meet."""
        n = len(last) - 1
        ends = set(range(n - self.longest + 1, n + 1))
        while len(ends) > 1:
            latest = max(ends)
            ends.discard(latest)
            ends.add(latest - len(self.v.pieces[last[latest]]))
        return max(ends.pop(), 0)

    def _path(self, last: list[int], end: int) -> list[int]:
        ids: list[int] = []
        while end > 0:
            ids.append(last[end])
            end -= len(self.v.pieces[last[end]])
        return ids[::-1]

    def unit(self, text: str) -> bytes:
        """Ids of one unit as 32-bit integers; units of ordinary length are remembered."""
        found = self.units.get(text)
        if found is None:
            found = self._made(text)
            if len(text) <= LONG_UNIT:
                if len(self.units) >= UNITS_KEPT // 4:
                    self.units.clear()
                self.units[text] = found
        return found

    def _made(self, text: str) -> bytes:
        if len(text) > LONG_UNIT:
            return np.fromiter(self.stream(text), np.int32).tobytes()
        ids, pairs, size, longest = self.ids.get, self.pairs.get, len(self.v.pieces), self.longest
        head = text[:HEAD]
        known = self.heads.get(head)
        last = [-1] if known is None else known.copy()
        for end in range(len(last), len(text) + 1):
            for at in range(end - longest if end > longest else 0, end):
                piece = ids(text[at:end])
                if piece is not None:
                    before = last[at]
                    if before < 0:
                        break
                    fit = pairs(before * size + piece)
                    if fit or fit is None and self.fits(before, piece):
                        break
            else:
                # A character outside the vocabulary stands between its neighbours.
                parts = self.outside.split(text)
                return b"".join(self._bytes(p) if i % 2 else self._made(p) for i, p in enumerate(parts) if p)
            last.append(piece)
        if known is None:
            if len(self.heads) >= HEADS_KEPT:
                self.heads.clear()
            self.heads[head] = last[: len(head) + 1]
        return array("i", self._path(last, len(text))).tobytes()

    def _bytes(self, text: str) -> bytes:
        return np.array([self.v.byte_ids[b] for b in text.encode()], np.int32).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word behind one space."""
        found = self._made(SPACE + word)
        if len(word) <= LONG_UNIT:
            if len(self.words) >= UNITS_KEPT:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, to which the model puts a space in front."""
        if not text:
            return np.zeros(0, np.int32)
        if text[0] == " " or "  " in text or SPACE in text or self.v.joined or "\n" in self.v.normal:
            return np.frombuffer(self._general(text), np.int32)
        parts: list[bytes] = []
        for nth, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if nth:
                # Nothing spans a line break; the word behind it has no space in front.
                parts += (self.line_break, self.unit(words[0]))
                words = words[1:]
            known = self.words.get
            found = list(map(known, words))
            # A word that comes again in the line is asked for again, so it's made once.
            parts += [p or known(w) or self._word(w) for w, p in zip(words, found)] if None in found else found
        return np.frombuffer(b"".join(parts), np.int32)

    def _general(self, text: str) -> bytes:
        """The same where spaces stand in runs, or U+2581 itself occurs, which is written as bytes."""
        parts: list[bytes] = []
        for nth, stretch in enumerate(text.split(SPACE)):
            if nth:
                parts.append(self._bytes(SPACE))
            parts.extend(map(self.unit, self.cut.findall(("" if nth else SPACE) + stretch.replace(" ", SPACE))))
        return b"".join(parts)


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this worker process for the vocabulary."""
    key = hash((tuple(vocabulary.pieces), tuple(vocabulary.scores)))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The text of the ids, less the space put before the first word."""
    text = b"".join(map(vocabulary.texts.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The batches in pieces, so that a worker holds the texts and ids of few rows beside a batch."""
    for batch in batches:
        for at in range(0, len(batch), ROWS_HELD):
            yield batch.slice(at, ROWS_HELD)


def _numbers(ids: pa.Array) -> list[int]:
    """The ids as Python numbers, without an Arrow scalar for each."""
    return ids.to_numpy(zero_copy_only=False).tolist()


def _encoding(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(vocabulary)
        for batch in _parts(batches):
            rows = [encoder.encode(t or "") for t in batch.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    return run


def _decoding(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in _parts(batches):
            # Row by row, so that only one text's ids are Python numbers at a time.
            rows = (batch[i].values for i in range(len(batch)))
            yield pa.array([decode(vocabulary, _numbers(r) if r is not None else []) for r in rows], pa.string())

    return run


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """The columns of `docs` with ids (array of int) and n_tokens."""
    encode = F.arrow_udf(_typed(_encoding(vocabulary)), "array<int>")
    encoded = without(docs, "ids", "n_tokens").withColumn("ids", encode(F.coalesce(F.col(text), F.lit(""))))
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint"))


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """The columns of `encoded` with decoded, the text of the ids; null ids give the empty text."""
    back = F.arrow_udf(_typed(_decoding(vocabulary)), "string")
    return without(encoded, "decoded").withColumn("decoded", back(F.col(ids)))


def _typed(run):
    def typed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return typed

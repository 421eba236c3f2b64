"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds to them.

The base finds e-mail addresses, IPv4 addresses, card and phone numbers by
pattern. The field scores whole segments of up to MAX_ATOMS atoms (runs of
digits, runs of letters, single other characters) by what the segment is like
as a whole: how many digits in how many groups, which separators, the checksum,
what stands beside it. A dynamic programme over boundaries and types together
picks the best segmentation. Atoms far from any digit, '@' or spelt-out 'at' can
only be outside; so a text falls into islands that are decided on their own
without changing the result.

It is trained here by maximum likelihood on a bounded sample of islands, whose
labels are the base spans, partly rewritten the way people hide them (spaces,
'[at]', no plus sign, other separators). So it finds such forms as well. What it
finds is added where no base span lies; base spans always stay.

Spans are in code points, the end exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows are
scanned one by one; an empty table gives an empty result, and an empty sample a
field that adds nothing; columns that clash with result columns are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import without

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["outside", *KINDS]
SAMPLE_ROWS = 2_000
SAMPLE_ISLANDS = 250
MAX_ATOMS = 24
REACH = 64

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|[\[(]\s?at\s?[\])]", re.I)
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
_SPACE = re.compile(r"\s")
_BLOCK = 256

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free = 0
    at = text.find("@")
    while at >= 0:
        # The longest run of local characters before the sign, from the end of the last match.
        start = at
        while start > free:
            block = text[max(free, start - _BLOCK) : start]
            run = _LOCAL.search(block)
            if run is None:
                break
            start -= len(block) - run.start()
            if run.start():
                break
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind as listed, then start; failing matches are dropped without retry."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, '@' and spelt-out 'at', to white space or REACH characters further."""
    found: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        left, right = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if found and m.end() <= found[-1][1]:
            continue
        back = [s.end() for s in _SPACE.finditer(text, left, m.start())]
        # Where 'at' is spelt out, the words beside it belong to the island.
        spelt = not m[0][0].isdigit() and m[0][0] != "@"
        if spelt and back and back[-1] == m.start():
            back.pop()
        start = back[-1] if back else left
        ahead = [s.start() for s in _SPACE.finditer(text, m.end(), right)]
        if spelt and ahead and ahead[0] == m.end():
            ahead.pop(0)
        end = ahead[0] if ahead else right
        if found and start - found[-1][1] <= 1:
            found[-1][1] = max(end, found[-1][1])
        else:
            found.append([start, end])
    return [(a, b) for a, b in found if b > a]


def _bucket(n: int, *edges: int) -> int:
    return sum(n > e for e in edges)


# Whole-span features: name and the number of values each can take.
_SIZES = [11, 7, 6, 4, 4, 4, 4, 4, 3, 3, 7, 7, 6, 6, 3]
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])
WIDTH = int(_OFFSETS[-1])


def _sort(atom: str) -> int:
    if not atom:
        return 0
    if atom[0].isdigit():
        return 1
    if atom.isalpha():
        return 2
    return 3 if atom.isspace() else 4 if atom in "@" else 5 if atom in ".-_+%" else 6


def features(atoms: list[str], i: int, j: int) -> list[int]:
    """Numbers of the features that hold for atoms[i:j] as a whole."""
    span = atoms[i:j]
    text = "".join(span)
    groups = [a for a in span if a[0].isdigit()]
    digits = "".join(groups)
    letters = sum(a.isalpha() for a in span)
    dots, low = text.count("."), text.lower()
    spelt = "@" in text or " at " in low or "(at)" in low or "[at]" in low
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    values = [
        _bucket(len(digits), 0, 1, 3, 6, 7, 9, 11, 12, 15, 19),
        min(len(groups), 6),
        min(letters, 5),
        min(dots, 3),
        min(text.count("-"), 3),
        min(sum(c.isspace() for c in text), 3),
        2 * (text[0] == "+") + (len(text) > 1 and text[1].isdigit()),
        2 * ("(" in text) + (")" in text),
        0 if not 13 <= len(digits) <= 19 else 1 + luhn(digits),
        0 if not spelt else 1 + bool(re.search(r"[.]|\bdot\b", low[low.find("at") if "@" not in low else low.find("@") :])),
        _sort(span[0]),
        _sort(span[-1]),
        1 + _bucket(j - i, 1, 3, 6, 12) if j - i > 1 else 0,
        _sort(atoms[i - 1]) % 6 if i else 0,
        octets + (octets and dots == 3),
    ]
    values[13] = min(values[13], 5)
    return [int(o + v) for o, v in zip(_OFFSETS, values)]


@dataclass(frozen=True)
class Field:
    """Weights by feature and label, and of a label after another; None adds nothing."""

    weights: np.ndarray | None = None
    steps: np.ndarray | None = None


def _segments(atoms: list[str]) -> tuple[np.ndarray, list[list[int]]]:
    """(features by segment, numbers of the segments that end at each boundary); the start is kept beside."""
    rows, ends = [], [[] for _ in range(len(atoms) + 1)]
    for j in range(1, len(atoms) + 1):
        for i in range(max(0, j - MAX_ATOMS), j):
            # An entity neither starts nor ends with white space; alone, white space is outside.
            if j - i > 1 and (atoms[i].isspace() or atoms[j - 1].isspace()):
                continue
            ends[j].append((i, len(rows)))
            rows.append(features(atoms, i, j))
    return np.array(rows), ends


def _scores(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[rows].sum(1)


def _allowed(scores: np.ndarray, n: int, i: int, j: int) -> np.ndarray:
    """Outside segments hold one atom, so that there is one way to leave a stretch alone."""
    if j - i > 1:
        scores = scores.copy()
        scores[0] = -np.inf
    return scores


def decode(field: Field, atoms: list[str]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the best segmentation's entities, in atoms."""
    if not atoms:
        return []
    rows, ends = _segments(atoms)
    scores = _scores(rows, field.weights)
    best = np.full((len(atoms) + 1, len(LABELS)), -np.inf)
    best[0, 0] = 0.0
    back: list[list] = [[None] * len(LABELS) for _ in range(len(atoms) + 1)]
    for j in range(1, len(atoms) + 1):
        for i, at in ends[j]:
            into = best[i][:, None] + field.steps
            before = into.argmax(0)
            value = into.max(0) + _allowed(scores[at], len(atoms), i, j)
            for label in np.flatnonzero(value > best[j]):
                best[j, label] = value[label]
                back[j][label] = (i, int(before[label]))
    found, j, label = [], len(atoms), int(best[-1].argmax())
    while j > 0:
        i, before = back[j][label]
        if label:
            found.append((i, j, label))
        j, label = i, before
    return found[::-1]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis), -1e300)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def _gradient(field: Field, rows, ends, gold: list[tuple[int, int, int]], n: int, gw: np.ndarray, gs: np.ndarray) -> None:
    """Add the gradient of the log-likelihood of one island: observed less expected counts."""
    scores = _scores(rows, field.weights)
    forward = np.full((n + 1, len(LABELS)), -np.inf)
    forward[0, 0] = 0.0
    entry = {}
    for j in range(1, n + 1):
        parts = []
        for i, at in ends[j]:
            if (i, "in") not in entry:
                entry[i, "in"] = _sum_exp(forward[i][:, None] + field.steps, 0)
            parts.append(entry[i, "in"] + _allowed(scores[at], n, i, j))
        forward[j] = _sum_exp(np.array(parts), 0)
    total = _sum_exp(forward[n], 0)
    backward = np.full((n + 1, len(LABELS)), -np.inf)
    backward[n] = 0.0
    starts: list[list] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i, at in ends[j]:
            starts[i].append((j, at))
    with np.errstate(invalid="ignore"):
        for i in range(n - 1, -1, -1):
            leaving = np.array([_allowed(scores[at], n, i, j) + backward[j] for j, at in starts[i]])
            out = _sum_exp(leaving, 0)
            backward[i] = _sum_exp(field.steps + out[None, :], 1)
            share = np.exp(entry[i, "in"][None, :] + leaving - total)
            for (_, at), p in zip(starts[i], share):
                gw[rows[at]] -= p
            gs -= np.exp(forward[i][:, None] + field.steps + out[None, :] - total)
    at_of = {(i, j): at for j in range(1, n + 1) for i, at in ends[j]}
    before = 0
    for i, j, label in gold:
        gw[rows[at_of[i, j]], label] += 1
        gs[before, label] += 1
        before = label


def hide(kind: str, text: str, rng: random.Random) -> str:
    """A base span the way people write it to be overlooked."""
    if kind == "email":
        return text.replace("@", rng.choice([" [at] ", "(at)", " (at) ", " @ "])).replace(".", rng.choice([".", " . "]))
    if kind == "ip":
        return text.replace(".", rng.choice(["[.]", " . "]))
    if kind == "card":
        digits = re.sub("[^0-9]", "", text)
        return rng.choice([".", "/", "  "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = re.sub("[^0-9]", "", text)
    tail = digits[-10:]
    return rng.choice([f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}"])


def _examples(texts: list[str], max_islands: int, seed: int = 5) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """(atoms, gold segments) of islands; every second entity is rewritten."""
    rng = random.Random(seed)
    count = 0
    for text in texts:
        spans = base_spans(text)
        for a, b in islands(text):
            inside = sorted((s, e, k) for k, s, e in spans if a <= s and e <= b)
            atoms: list[str] = []
            gold: list[tuple[int, int, int]] = []
            at = a
            for s, e, k in [*inside, (b, b, "")]:
                if s < at:
                    continue
                for atom in _ATOM.findall(text[at:s]):
                    gold.append((len(atoms), len(atoms) + 1, 0))
                    atoms.append(atom)
                if k:
                    own = _ATOM.findall(hide(k, text[s:e], rng) if rng.random() < 0.5 else text[s:e])
                    if len(own) > MAX_ATOMS:
                        own = _ATOM.findall(text[s:e])[:MAX_ATOMS]
                    gold.append((len(atoms), len(atoms) + len(own), LABELS.index(k)))
                    atoms.extend(own)
                at = e
            if 0 < len(atoms) <= 60:
                yield atoms, gold
                count += 1
                if count >= max_islands:
                    return


def train(texts: list[str], max_islands: int = SAMPLE_ISLANDS, rounds: int = 8) -> Field:
    """Maximum likelihood by AdaGrad over whole passes."""
    data = [(_segments(atoms), gold, len(atoms)) for atoms, gold in _examples(texts, max_islands)]
    if not any(label for _, gold, _ in data for _, _, label in gold):
        return Field()
    weights, steps = np.zeros((WIDTH, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    seen_w, seen_s = np.full_like(weights, 1e-6), np.full_like(steps, 1e-6)
    for _ in range(rounds):
        for k in range(0, len(data), 30):
            gw, gs = -0.01 * weights, -0.01 * steps
            for (rows, ends), gold, n in data[k : k + 30]:
                _gradient(Field(weights, steps), rows, ends, gold, n, gw, gs)
            seen_w += gw**2
            seen_s += gs**2
            weights, steps = weights + 0.5 * gw / np.sqrt(seen_w), steps + 0.5 * gs / np.sqrt(seen_s)
    return Field(weights, steps)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Train on the islands of at most `sample_rows` texts that have some, chosen by a hash of the id."""
    order = F.xxhash64(F.col(doc_id).cast("string"))
    rows = (
        docs.select(order.alias("_order"), F.col(text).alias("_text"))
        .filter(F.col("_text").rlike("[0-9@]"))
        .orderBy("_order", "_text")
        .limit(sample_rows)
    )
    return train([r["_text"] for r in rows.toLocalIterator()])


def find(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether of the base) by kind as listed, then start."""
    base = base_spans(text)
    found = [(k, s, e, True) for k, s, e in base]
    if field.weights is not None:
        taken = sorted((s, e) for _, s, e in base)
        for a, b in islands(text):
            held = [(s, e) for s, e in taken if s < b and e > a]
            # What the base holds is settled; the rest of the island is decided around it.
            for left, right in zip([a, *[e for _, e in held]], [*[s for s, _ in held], b]):
                piece = text[left:right]
                if not _TRIGGER.search(piece):
                    continue
                atoms = _ATOM.findall(piece)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in atoms])]) + left
                for i, j, label in decode(field, atoms):
                    if not any(s < ends[j] and e > ends[i] for s, e in held):
                        found.append((LABELS[label], int(ends[i]), int(ends[j]), False))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def spans_column(field: Field, text: Column) -> Column:
    """The spans of a text, as an array of (kind, start, end, base)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find(t, field)] for t in batch.to_pylist()]
            yield pa.array(rows, _ARROW)

    return F.arrow_udf(run, _SPANS)(F.coalesce(text, F.lit("")))


def find_spans(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The columns of `docs` with spans."""
    return without(docs, "spans").withColumn("spans", spans_column(field, F.col(text)))


def mask(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The columns of `docs` with masked: the text with [kind] in place of every span."""
    found = find_spans(docs, field, text)
    ordered = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    whole = F.coalesce(F.col(text), F.lit(""))

    def put(state: Column, s: Column) -> Column:
        between = F.substring(whole, state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(state["done"], between, F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(mark.alias("done"), s["end"].alias("at")))

    masked = F.aggregate(ordered, start, put, lambda state: F.concat(state["done"], F.substring(whole, state["at"] + 1, F.length(whole))))
    return without(found, "masked").withColumn("masked", masked)

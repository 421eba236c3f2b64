import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from plumbline.llm import katz


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute_force(rows, vocabulary):
    """Katz bigrams with dictionaries; None is the end, 0 the class of words outside the vocabulary."""
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    texts = [tokens(t) for i, t in rows if i not in held]
    c = Counter(w for t in texts for w in t)
    n = sum(c.values())
    d = katz.good_turing(Counter(c.values()))
    disc = lambda r, table: table[r] if r <= 5 else 1.0
    left = sum((1 - disc(r, d)) * r for r in c.values()) / n
    unknown = max(left, 0.5 / n)
    p = {w: disc(r, d) * r / n * (1 - unknown) / (1 - left) for w, r in c.items()}
    hashes = {w: int(katz.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0].view(np.int64)[0]) for w in c if w}
    top = set(sorted((w for w in c if w), key=lambda w: (-c[w], hashes[w]))[:vocabulary])
    cls = lambda w: w if w is None or w in top else 0
    p1 = {w: p[w] for w in [*top, None]}
    p1[0] = max(1 - sum(p1.values()), unknown)
    pairs = Counter()
    for t in texts:
        pairs.update(zip(["<s>", *map(cls, t)], map(cls, t)))
    heads = Counter()
    for (h, _), r in pairs.items():
        heads[h] += r
    d2 = katz.good_turing(Counter(pairs.values()))
    kept, seen = Counter(), Counter()
    for (h, w), r in pairs.items():
        kept[h] += disc(r, d2) * r / heads[h]
        seen[h] += p1[w]
    alpha = {h: max(1 - kept[h], 1e-12) / max(1 - seen[h], 1e-12) for h in heads}

    def prob(h, w):
        r = pairs.get((h, w), 0)
        return disc(r, d2) * r / heads[h] if r else alpha.get(h, 1.0) * p1[w]

    for h in [*heads, "never"]:
        if 1 - seen[h] > 1e-9:
            assert math.isclose(sum(prob(h, w) for w in p1), 1.0, rel_tol=1e-9)
    found = []
    for i, text in rows:
        t = tokens(text)
        total = 0.0
        for h, w in zip(["<s>", *map(cls, t)], t):
            total += math.log10(prob(h, cls(w)))
            if cls(w) == 0:
                total += math.log10(p.get(w, unknown) / p1[0])
        base = sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t)
        found.append((i, i in held, len(t), sum(c[w] > 0 for w in t), n, base, total))
    return found


def check(rows, found, vocabulary):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    want = sorted(brute_force(rows, vocabulary), key=key)
    got = sorted(map(tuple, found), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], abs_tol=1e-8) and math.isclose(g[6], w[6], abs_tol=1e-8), (g, w)


def test_against_dictionaries(make, edited, monkeypatch):
    monkeypatch.setattr(katz, "PART_TOKENS", 700)
    texts = edited(5, [1] * 30 + [3] * 20 + [40], words=("a", "B", "c", "é", "x1", "y,"))
    rows = [*enumerate(texts), (500, None), (501, "   "), (7, "a twice"), (7, "a twice"), (None, "no id"), (600, "never seen " * 900)]
    check(rows, katz.score(make(rows), vocabulary=12).collect(), 12)


def test_all_words_have_their_bigrams(make, edited, monkeypatch):
    """More words than any task holds numbers for; none of them shares a class."""
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2]
    free = [i for i in range(1000) if i not in held]
    rare = [f"rare{i}" for i in range(12)]
    many = [(i, " ".join(f"w{k}" for k in range(1000 * n, 1000 * n + 1000)) + "\n") for n, i in enumerate(free[:70])]
    many += [(i, text) for i, (_, text) in zip(free[70:], many)]
    many += [(free[200], " ".join(rare)), (held[0], " ".join(rare)), (held[1], " ".join(rare[::-1]))]
    got = {r.doc_id: r.score for r in katz.score(make(many)).collect()}
    assert got[held[0]] > got[held[1]] + 1
    monkeypatch.setattr(katz, "PART_TOKENS", 700)
    texts = edited(5, [1] * 30 + [3] * 20 + [40], words=("a", "B", "c", "é", "x1", "y,"))
    rows = [*enumerate(texts), (500, None), (501, "   "), (7, "a twice"), (7, "a twice"), (None, "no id"), (600, "never seen " * 900)]
    for numbered, held in ((0, 1), (7, 1), (7, 30), (7, 10**6)):
        monkeypatch.setattr(katz, "NUMBERED", numbered)
        monkeypatch.setattr(katz, "HELD", held)
        check(rows, katz.score(make(rows)).collect(), 10**9)


def test_empty_and_untrained(make):
    assert katz.score(make([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = katz.score(make([(held, "some words")])).collect()
    assert [tuple(r) for r in only] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_packing():
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    assert (katz._unpack(katz._pack(values), np.uint64) == values).all()


def test_requests_name_the_rows_that_ask_and_no_others():
    """Parts without end add no ids beyond the distinct (row, key) pairs."""
    rng = np.random.default_rng(2)
    keys, rows = rng.integers(1, 2**40, 4000).astype(np.uint64), np.sort(rng.integers(0, 300, 4000))
    ids = np.arange(300) + 10
    for parts in (1, 64, 100_000):
        pairs, named = [], 0
        for message in katz._requests(katz.PAIR, keys, rows, parts, ids, (ids * 7).astype(np.int32)):
            values = message.column(2)[0].as_py()
            asked = katz._unpack(values[0], np.uint64)
            number, times = katz._read(values[1], np.uint32), katz._read(values[2], np.uint32)
            named_here, hashes = katz._read(values[3], "q"), katz._read(values[4], "i")
            assert (hashes == named_here * 7).all()
            named += len(named_here)
            pairs += [(k, i) for k, i, t in zip(asked, named_here[number], times) for _ in range(t)]
        assert sorted(pairs) == sorted(zip(keys, ids[rows]))
        assert named <= len(set(zip(keys, rows)))


def test_a_chunk_is_worked_off_in_little_memory(monkeypatch):
    n, per = 400_000, 200
    rng = np.random.default_rng(3)
    words = rng.integers(2**40, 2**40 + 30_000, n).astype(np.uint64)
    bounds = np.arange(0, n + 1, per)
    rows = [(i, i) for i in range(n // per)]
    monkeypatch.setattr(katz, "_chunks", lambda batches: iter([(rows, words.copy(), bounds)]))
    monkeypatch.setattr(katz, "SLICE", 10_000, raising=False)
    hashes = np.arange(2**40, 2**40 + 20_000).astype(np.uint64)
    counts = np.full(20_003, 7)
    share = np.full(20_003, 1e-5)
    model = katz.Unigrams(hashes, np.arange(20_000) + 3, counts, share, katz.good_turing({}), n, 30_000, 0.1, 1.0, True)
    pairs = katz.Bigrams(counts, share, katz.good_turing({}), np.zeros(0, np.uint64), np.zeros(0))
    for run in (katz._asked(model, pairs, 30, 24), katz._counted_pairs(model, 30)):
        # The first run imports modules as well.
        assert list(run(iter(())))
        tracemalloc.start()
        for _ in run(iter(())):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 75 * n, peak / n

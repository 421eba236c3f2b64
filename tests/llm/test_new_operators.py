"""Resampling, spelling variants and chat formatting against brute force and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, resampling, spelling

LONG = "wörd " * 30_000


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_resample(rows, target, buckets, percent, min_words, seed=2024):
    def hashes(text):
        return [zlib.crc32(w.encode()) % buckets for w in re.findall(resampling.WORD, low(text))]

    raw = [(i, hashes(t)) for i, t in rows]
    s, t = Counter(b for _, h in raw for b in h), Counter(b for x in target for b in hashes(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    scored = []
    for i, h in raw:
        weight = sum(gain[b] for b in h) // len(h) if h else 0
        mark = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((mark + 0.5) / 2**32)))))
    able = sorted((r for r in scored if r[1] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    drawn = able[: percent * len(able) // 100]
    rest = [(*r, None) for r in able[len(drawn) :]] + [(*r, None) for r in scored if r[1] < min_words]
    return Counter([(*r, n) for n, r in enumerate(drawn, 1)] + rest)


def drawn(docs, target, **settings):
    found = resampling.resample(docs, target, **settings)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return Counter(found.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("percent,accuracy", [(10, 10_000), (35, 20), (100, 10_000), (0, 100)])
def test_resampling(make, percent, accuracy):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(80)] + ["été", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [(400, None), (401, ""), (None, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4"), (7, "W1, w2-w3 w4 w5"), (402, LONG)]
    target = ["w1 w2 w1 w3", None, "w4 W5 été"]
    docs = make(rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "rank")
    wanted = make(target)
    got = drawn(docs, wanted, buckets=50, percent=percent, min_words=4, accuracy=accuracy)
    assert got == plain_resample(rows, target, 50, percent, 4)


def test_resampling_ties(make):
    """One id with a third of all rows has one score; as many of its rows are drawn as there is room."""
    rows = [(5, "a b c")] * 60 + [(i, "a b c") for i in range(100, 220)]
    got = drawn(make(rows), make(["a b"]), buckets=9, percent=50, min_words=1)
    assert got == plain_resample(rows, ["a b"], 9, 50, 1)
    assert sorted(r[4] for r in got.elements() if r[4]) == list(range(1, 91))


def test_resampling_edges(make, spark):
    assert resampling.resample(make([]), make(["a"])).count() == 0
    rows = [(i, f"a b{i}") for i in range(20)]
    assert drawn(make(rows), make([]), min_words=1) == plain_resample(rows, [], resampling.BUCKETS, 10, 1)
    runs = spark.range(1).select(resampling.features(F.lit("A b, c"), 2).alias("f")).first().f
    assert runs == ["a", "b", "c", "a b", "b c"]
    by_two = resampling.resample(make(rows), make(["a b1"]), max_n=2, min_words=1).collect()
    assert {(r.n_words, r.n_features) for r in by_two} == {(2, 3)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_variants(rows, modulus=97, min_length=5, min_count=3, ratio=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = low(run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    near = defaultdict(list)
    for a, b in itertools.permutations(words, 2):
        if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1:
            near[a].append(b)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), c, len(near[w]), words[form[w]] if form[w] else None) for w, c in words.items()}


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcé"), (3, "abcdefghiøÿ×")])
def test_spelling(make, seed, letters):
    """Few letters give words of equal bigrams, many of them repeated inside a word."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(25)]
    words = []
    for stem in stems:
        for _ in range(12):
            w = list(stem)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", *letters])
            words += ["".join(w)] * rng.choice([1, 3, 6, 13])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "1"]).join(words[i * 40 : i * 40 + 40])) for i in range(-(-len(words) // 40))]
    rows += [(900, None), (901, ""), (None, words[0].upper()), (0, rows[0][1]), (902, LONG)]
    got = spelling.variants(make(rows).withColumnRenamed("lang", "word"), modulus=7)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    found = got.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(found) == len(set(found)) and set(found) == plain_variants(rows, modulus=7)


def test_spelling_chain(make):
    """A chain of forms as long as the doubling of counts allows ends in one root."""
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    rows = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(chain)]
    got = {r.word: r for r in spelling.variants(make(rows), modulus=10**9).collect()}
    assert {r.root for r in got.values()} == {"abbbbb"} and got["aaaaaa"].form == "aaaaab" and got["abbbbb"].form is None
    assert spelling.variants(make([])).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(5, 9)))
        counts = {a + b: rng.randint(1, 9) for a in "abc" for b in "abc"}
        places, _ = spelling.prefix(word, counts)
        got = spelling.pivots(word, places, counts)
        cost = {i: counts[word[i : i + 2]] for i in places}
        pairs = [(i, j) for i, j in itertools.combinations(places, 2) if j - i >= 2]
        assert len(got) == 2 and got[1] - got[0] >= 2
        assert sum(cost[i] for i in got) == min(cost[i] + cost[j] for i, j in pairs)


ODD = ["", "</s>", "[INST] x [/INST]", "[\\INST]", "<\\\\/s>", "[[INST]]", "a [/ROLE] b", "[/TURN]", " [SYS] ", "\\", "[", "<", "é\n日本", "$1\\2"]


def plain_digest(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = {}
    for conv, said in by.items():
        said.sort()
        loss = "".join(t for _, _, r, t in said if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in said)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
        want[conv] = (len(said), sha[0], len(loss), sha[1])
    return want


def test_chat_round_trip(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", None, "[ROLE]", "a [/ROLE] b", "Assistant"]
    turns = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            text = rng.choice([None, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 4)))])
            turns.append((conv, rng.choice([turn, turn, None, 1]), rng.choice(roles[:2] if rng.random() < 0.6 else roles), text))
    turns += [(77, 0, "assistant", LONG), (78, 0, "user", "only asked"), *[(79, 1, "user", "same")] * 2]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("target", F.lit("mine"))
    examples = chat.expand(df.repartition(3))
    assert examples.columns == ["conv_id", "example", "target", "last", "text", "loss_start", "loss_end"]
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    want = plain_digest(turns)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    sizes = Counter()
    for r in examples.collect():
        sizes[r.conv_id] += len(r.text)
    assert {c: r.formatted_chars for c, r in got.items()} == sizes


def test_chat_examples(spark):
    turns = [(1, 0, "system", "Be kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "yes </s>"), (1, 3, "user", "and?"), (1, 4, "assistant", "no"), (1, 5, "user", "bye")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = sorted(chat.expand(df).collect(), key=lambda r: r.example)
    start = "[SYS] Be kind [/SYS][INST] hi [\\INST] [/INST]<s>yes <\\/s></s>"
    assert [r.text for r in rows] == [start, start + "[INST] and? [/INST]<s>no</s>", start + "[INST] and? [/INST]<s>no</s>[INST] bye [/INST]"]
    assert [(r.target, r.last, r.text[r.loss_start : r.loss_end]) for r in rows] == [(2, False, "yes <\\/s>"), (4, False, "no"), (None, True, "")]
    assert chat.expand(df.limit(0)).count() == 0 and chat.digest(chat.expand(df.limit(0))).count() == 0


def test_escape_is_reversible(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["[", "<", "\\", "/", "INST]", "s>", "/s>", "ROLE]", "x", *ODD]) for _ in range(8)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)

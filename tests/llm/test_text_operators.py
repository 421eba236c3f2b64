import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from plumbline.llm import exact_dedup, licenses, line_templates, mixing, pii, quality, registry, sentencepiece, syncmers
from plumbline.plans.tables import load

LONG = "wörd " * 30_000


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_groups(make):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, LONG), (7, LONG), (None, "a b"), (9, "x")]
    rows += [(100 + i, "Hot") for i in range(40)]
    got = exact_dedup.exact_groups(make(rows), support=0.1).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    want = []
    for text, ids in groups.items():
        keep = max(i for i in ids if i is not None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = True
        for i in sorted(ids, key=lambda i: -1 if i is None else i, reverse=True):
            want.append((i, keep, len(ids), kept, digest))
            kept = False
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    left = exact_dedup.drop_copies(make(rows).withColumnRenamed("lang", "_digest"), support=0.1)
    assert Counter(r.doc_id for r in left.collect()) == Counter([2, 4, 5, 6, 7, 9, 139])
    assert left.columns == ["doc_id", "text", "_digest", "source", "n_chars"]
    assert exact_dedup.exact_groups(make([])).count() == 0


def test_mixing(make):
    rows = [(i, f"t{i}") for i in range(300)] + [(3, "t3"), (None, None)]
    docs = make(rows).withColumnRenamed("lang", "copies")
    mixed = mixing.mix(docs, weights={"src0": 1.0, "src1": 3.0})
    found = mixed.collect()
    assert {r.source for r in found} == {"src0", "src1"}
    assert mixed.columns == ["doc_id", "text", "source", "n_chars", "copies", "copy", "shuffle_key"]
    per = Counter((r.doc_id, r.copy) for r in found)
    assert per[(3, 1)] in (0, 2) and all(r.copy <= r.copies for r in found)
    assert abs(sum(r.source == "src1" for r in found) / len(found) - 0.75) < 0.1
    again = mixing.mix(docs.repartition(7), weights={"src0": 1.0, "src1": 3.0}).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix(make([])).count() == 0


def test_steps_are_a_distribution(spark):
    from pyspark.sql import functions as F

    for rate in (0.0, 0.3, 2.0, 900.0):
        steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s")).first().s
        assert abs(steps[-1] - 1) < 1e-9 and all(a <= b for a, b in zip(steps, steps[1:]))


def test_quality(spark, sf_dir, make):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    scored = quality.classify(docs.withColumnRenamed("lang", "score"), model)
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(rows[i].predicted == q for i, q in truth.items()) / len(truth) > 0.85
    odd = quality.classify(make([(1, None), (2, ""), (3, LONG)]), model).collect()
    assert len(odd) == 3 and len({r.score for r in odd if not r.text}) == 1
    none = quality.fit(docs, labels.limit(0))
    assert {r.predicted for r in quality.classify(docs.limit(5), none).collect()} == {1}
    assert quality.fit_texts([("good text", 1, True), ("b@d", 0, False)]).good


def test_pieces_against_the_library(make):
    import sentencepiece as library

    vocabulary = sentencepiece.load_vocabulary(registry.VOCABULARY)
    model = library.SentencePieceProcessor(model_file=registry.VOCABULARY)
    texts = ["", None, " a  b ", "The é日本\n\n c\t<s> x", "ab" * 4000, "no" + "space" * 900, "  \n ", "🔴 and ①", "\nline\n"]
    encoded = sentencepiece.encode_texts(make(texts).withColumnRenamed("lang", "ids"), vocabulary)
    back = sentencepiece.decode_ids(encoded, vocabulary).collect()
    assert len(back) == len(texts)
    for r in back:
        assert list(r.ids) == model.encode(r.text or "") and r.decoded == (r.text or "") and r.n_tokens == len(r.ids)
    encoder = sentencepiece.Encoder(vocabulary)
    mark = "a ▁ b▁"
    assert sentencepiece.decode(vocabulary, encoder.encode(mark)) == mark
    assert list(encoder.stream("▁" + "ab" * 4000)) == model.encode("ab" * 4000)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


def test_sentencepiece_words_that_begin_alike_start_from_what_is_known(monkeypatch):
    import sentencepiece as library

    vocabulary = sentencepiece.load_vocabulary(registry.VOCABULARY)
    model = library.SentencePieceProcessor(model_file=registry.VOCABULARY)
    words = ["thin" + a + b for a in ("", "g", "tion", "日", "\x07", "é") for b in ("", "er", "ing", "xq", "日本", "k\x07k")]
    words += ["a", "th", "thi", "the", "ther"] + [w[1:] for w in words]
    for most in (50_000, 2):
        monkeypatch.setattr(sentencepiece, "HEADS_KEPT", most)
        encoder = sentencepiece.Encoder(vocabulary)
        for text in words * 2 + [" ".join(words)]:
            assert encoder.encode(text).tolist() == model.encode(text)
        assert 0 < len(encoder.heads) <= min(most, len(words) // 2)


def test_sentencepiece_makes_a_word_once_and_holds_few_rows():
    import pyarrow as pa

    vocabulary = sentencepiece.load_vocabulary(registry.VOCABULARY)
    encoder, made = sentencepiece.Encoder(vocabulary), []
    real, encoder._made = encoder._made, lambda t: made.append(t) or real(t)
    ids = encoder.encode("in qzxvk a qzxvk line qzxvk")
    assert sentencepiece.decode(vocabulary, ids.tolist()) == "in qzxvk a qzxvk line qzxvk"
    assert made.count("\u2581qzxvk") == 1
    texts = [f"row {i} é" if i % 7 else None for i in range(1000)]
    encoded = list(sentencepiece._encoding(vocabulary)(iter([pa.array(texts)])))
    assert max(map(len, encoded)) <= sentencepiece.ROWS_HELD
    decoded = list(sentencepiece._decoding(vocabulary)(iter([pa.concat_arrays(encoded), pa.array([None], pa.list_(pa.int32()))])))
    assert max(map(len, decoded)) <= sentencepiece.ROWS_HELD
    assert [t for d in decoded for t in d.to_pylist()] == [t or "" for t in texts] + [""]


def test_base_spans():
    import random

    rng = random.Random(2)
    parts = ["a@b.c", "x@y", "@", ".", "d@e.f_g@h.i", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "+1 (386) 555-3733", "+", "-", " ", "12", "é", "(", "007.0.0.1"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_field(make):
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} or mail user{i}@mail{i % 7}.example.com, build {i}.{i % 9} of 2024" for i in range(120)]
    field = pii.train(texts)
    found = pii.find("please dial (386) 555-3733 today", field)
    assert [(k, s, e) for k, s, e, _ in found] == [("phone", 12, 26)]
    assert pii.find("in 2024 there were 17 of them", field) == []
    rows = [(1, None), (2, ""), (3, texts[0] + " " + LONG), (4, "x")]
    marked = pii.find_spans(make(rows).withColumnRenamed("lang", "spans"), field).collect()
    assert {r.doc_id: len(r.spans) for r in marked} == {1: 0, 2: 0, 3: 2, 4: 0}
    hidden = pii.mask(make([(1, texts[5])]), field).first().masked
    assert hidden.startswith("call [phone] or mail [email], build")
    assert pii.train([]).weights is None


def test_line_templates(make):
    template = "Order {} was shipped on day {} to the main store"
    rows = [(i, f"own line number of document x{i}y\n{template.format(i, 2 * i)}\n\nshared short") for i in range(5)]
    rows += [(50, None), (51, ""), (52, "shared short\nshared short"), (None, "alone"), (4, "alone again"), (60, LONG)]
    rows += [(70 + i, f"the quick brown fox jumps over the lazy {w} today again") for i, w in enumerate(["dog", "cat", "cow"])]
    got = line_templates.drop_recurring_lines(make(rows).withColumnRenamed("lang", "n_lines")).collect()
    clean = {r.doc_id: r.clean_text for r in got if r.doc_id not in (4, None)}
    assert clean[0] == rows[0][1] and clean[1] == ""
    assert clean[50] is None and clean[51] == "" and clean[52] == "" and clean[60] == LONG
    assert clean[70] == rows[-3][1] and clean[71] == "" and clean[72] == ""
    assert line_templates.drop_recurring_lines(make([])).count() == 0


def test_rows_that_share_or_lack_an_id_lose_their_own_lines_only(make):
    rows = [(1, "own text A\nfooter"), (2, "footer\nown text B"), (3, "footer"), (7, "footer\nown text C"), (7, "own text D\nfooter")]
    rows += [(None, "own text E\nfooter"), (None, "footer\nown text F"), (None, "footer\nown text F")]
    got = line_templates.drop_recurring_lines(make(rows).withColumnRenamed("lang", "_text")).collect()
    want = [(1, "own text A\nfooter"), (2, "own text B"), (3, ""), (7, "own text C"), (7, "own text D")]
    want += [(None, "own text E"), (None, "own text F"), (None, "own text F")]
    assert Counter((r.doc_id, r.clean_text) for r in got) == Counter(want)


def test_lines_that_differ_in_digits(make):
    """Digits open a position only where enough tokens stay fixed; equal lines still recur."""
    table = [" ".join(str(100 * i + k) for k in range(8)) for i in range(5)]
    same = "10 20 30 40 50 60 70 80"
    rows = [(i, f"{17 * i}\nTotal {i}\n{table[i]}\n{same}\nThe report of day {i} was sent to all\n2024") for i in range(5)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(make(rows)).collect()}
    assert got[0].clean_text == rows[0][1]
    for i in range(1, 5):
        assert got[i].clean_text == f"{17 * i}\nTotal {i}\n{table[i]}" and got[i].n_dropped == 3


@pytest.mark.parametrize("rows_per_bucket", [4_000, 3])
def test_fingerprints(make, rows_per_bucket):
    body = " ".join(f"w{i}" for i in range(400))
    rows = [(i, f"{i} {body} {i}") for i in range(6)] + [(10, body), (11, body), (12, None), (13, "one two"), (14, "é"), (None, "last"), (15, LONG)]
    got = {r.doc_id: r for r in syncmers.fingerprints(make(rows), rows_per_bucket=rows_per_bucket).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[11].fingerprint == got[10].fingerprint and got[11].near_next == 1.0
    assert got[12].fingerprint == "" and got[5].near_next > 0.9 and got[13].near_next == 0.0
    assert syncmers.fingerprints(make([])).count() == 0


def plain_anchors(text):
    """All anchors (code, place) of a text, word by word."""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text.lower()) if w]
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def code(values):
        h = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, seed=h)
        return signed(h)

    hashed = [code([w]) for w in words]
    found = []
    for i in range(len(words) - 4):
        inner = [code(hashed[k : k + 2]) for k in range(i, i + 4)]
        if min(inner) in (inner[0], inner[3]):
            found.append((code([inner[0], inner[2], inner[3]]), i))
    return found or ([(tuple(words), 0)] if words else [])


def plain_likeness(a, b):
    a, b = plain_anchors(a), plain_anchors(b)
    if not a or not b:
        return float(a == b), float(a == b)
    if len(a) == 1 or len(b) == 1:
        x, y = {c for c, _ in a}, {c for c, _ in b}
    else:
        x, y = ({(c, d, j - i) for (c, i), (d, j) in zip(t, t[1:])} for t in (a, b))
    return len(x & y) / min(len(x), len(y)), 2 * len(x & y) / (len(x) + len(y))


def test_likeness_against_brute_force(make, edited):
    part = " ".join(f"p{i}" for i in range(100))
    long = " ".join(f"l{i}" for i in range(10_000))
    texts = edited(6, [1, 2, 5, 9, 4, 1]) + [None, "", part, f"{long} {part} {long[:50_000]}", "a b c", "a b c", part[:40], "x " * 300]
    got = {r.doc_id: r for r in syncmers.fingerprints(make(texts), rows_per_bucket=7).collect()}
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert (got[i].near_next, got[i].alike_next) == pytest.approx(plain_likeness(text, after))
        assert (got[i].near_edited, got[i].alike_edited) == pytest.approx(plain_likeness(text, changed))
        codes = [c for c, _ in plain_anchors(text)]
        if codes and not isinstance(codes[0], tuple):
            assert got[i].fingerprint == "-".join(f"{(c >> 32) & 0xFFFFFFFF:08x}" for c in codes)
    held = texts.index(part) + 1
    assert got[held].near_next == 1.0 and got[held].alike_next < 0.05


def test_anchors_do_not_depend_on_place(make):
    passage = " ".join(f"p{i}" for i in range(50))
    found = {r.doc_id: r.anchors for r in syncmers.with_anchors(make([passage, "x y z " + passage + " end"])).collect()}
    assert {(a.code, a.place + 3) for a in found[0]} <= {(a.code, a.place) for a in found[1]}


def plain_licenses(text):
    words = re.findall(licenses.WORD, low(text))
    places = [
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    labels = {label for _, label in places}
    held = 0.0
    for line in (text or "").split("\n"):
        have = set(re.findall(licenses.WORD, low(line)))
        for label, template in licenses.TEMPLATES:
            need = set(re.findall(licenses.WORD, template))
            share = len(have & need) / len(need)
            if share >= licenses.THRESHOLD:
                labels.add(label)
                held = max(held, share)
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if at else held)


def test_licenses(make):
    rows = [
        None, "", "Under the MIT License. under THE mit license", "Licensed under the Apache License, Version 2.0.",
        "All rights reserved", "rights all\nreserved", "cc-by-nc CC by NC nc", "GNU General Public License version 3 under licensed",
        "a GNU Public\nLicense version 3 under licensed", "Permission is granted free of charge to any person obtaining copy of this software",
        "été Under the MIT licenses", LONG + " under the mit license", "apache license version 2", "apache license version 20",
    ]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.summary(licenses.scan(make(rows))).collect()}
    assert got == {i: plain_licenses(t) for i, t in enumerate(rows)}
    assert licenses.scan(make([])).count() == 0

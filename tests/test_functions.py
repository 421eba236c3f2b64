"""Rounding, ranks, quotas, salted joins, text expressions."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cells, text
from plumbline.functions.ranking import dense_positions, running_sum, smallest_by_hash
from plumbline.functions.rounding import decimal_text, round_half_even
from plumbline.functions.skew import hot_keys, salted_join


def test_rounding_agrees_with_the_binary_value(spark):
    values = [p / q for q in (32, 64, 96, 160, 320, 148, 500, 7) for p in range(q + 1)] + [1.4995, 0.12345, 2.6755]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 4):
        got = [r["r"] for r in df.select(round_half_even(F.col("v"), digits).alias("r")).collect()]
        assert got == [round(v, digits) for v in values]


def test_decimal_text(spark):
    df = spark.createDataFrame([(0.436,), (1.0,), (0.0,), (0.0004,), (2510.0,)], "v double")
    got = [r["t"] for r in df.select(decimal_text(F.col("v"), 4).alias("t")).collect()]
    assert got == ["0.436", "1.0", "0.0", "0.0004", "2510.0"]


def _skewed(n=600):
    rng = random.Random(1)
    keys = ["hot" if rng.random() < 0.5 else f"k{rng.randrange(30)}" for _ in range(n)]
    return [(k, i * 3 - 100, rng.randrange(9)) for i, k in enumerate(keys)]


def test_positions_and_running_sums(spark):
    rows = _skewed()
    df = spark.createDataFrame(rows, "k string, at long, v int")
    got = running_sum(dense_positions(df, ["k"], "at", "pos", width=11), ["k"], "at", {"total": F.col("v")}, width=11)
    want, seen, total = {}, Counter(), Counter()
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        total[k] += v
        want[(k, at)] = (seen[k], total[k])
        seen[k] += 1
    assert {(r["k"], r["at"]): (r["pos"], r["total"]) for r in got.collect()} == want


def test_smallest_by_hash(spark):
    rows = [(k, i, hashlib.md5(f"{i}".encode()).hexdigest()) for i, (k, _, _) in enumerate(_skewed())]
    quotas = {"hot": 57, "k1": 3, "k2": 10_000}
    df = spark.createDataFrame(rows, "k string, i int, d string")
    wanted = spark.createDataFrame(list(quotas.items()), "k string, quota long")
    got = defaultdict(set)
    for r in smallest_by_hash(df, ["k"], "d", wanted, ["i"]).collect():
        got[r["k"]].add(r["i"])
    by_key = defaultdict(list)
    for k, i, d in rows:
        by_key[k].append((d, i))
    for k, q in quotas.items():
        assert got[k] == {i for _, i in sorted(by_key[k])[:q]}
    assert set(got) == {k for k in quotas if by_key[k]}


def test_salted_join_is_a_join(spark):
    many = spark.createDataFrame([(k, i) for i, (k, _, _) in enumerate(_skewed())], "term string, id int")
    few = spark.createDataFrame([(k, q) for q in range(5) for k in ("hot", "k1", "absent")], "term string, q int")
    counts = many.groupBy("term").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "term", rows_per_salt=20, max_hot=10)
    assert {r["term"] for r in hot.collect()} == {"hot"}
    want = sorted(map(tuple, many.join(few, "term").select("term", "id", "q").collect()))
    got = sorted(map(tuple, salted_join(many, few, "term", hot, "id").select("term", "id", "q").collect()))
    assert got == want and len(got) > 1000


def _apply(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_quote_identifier(spark):
    names = ["abc", "a_1", "First Date", "aCL IgG", "_", "1", "été", "a-b", "A", "order"]
    want = [n if n.islower() and n.replace("_", "").isalnum() else f'"{n}"' for n in names]
    assert _apply(spark, text.quote_identifier, names) == want


def test_extract_sql(spark):
    texts = ["  SELECT 1;; \n", "```sql\nSELECT 2;\n```", "so: ```SQL SELECT 3 ``` then ```SELECT 4```", "```\nSELECT 5\n```", ""]
    assert _apply(spark, text.extract_sql, texts) == ["SELECT 1", "SELECT 2", "SELECT 3", "SELECT 5", ""]


def test_tokens_and_stems(spark):
    assert _apply(spark, text.estimate_tokens, ["", "abc", "abcd", "ééééé"]) == [0, 0, 1, 1]
    words = ["ponies", "prices", "cats", "glass", "status", "shoes", "trees", "by", "movies"]
    assert _apply(spark, text.stem, words) == ["pony", "price", "cat", "glass", "status", "shoe", "tree", "by", "movy"]


def test_whole_numbers_are_equal_at_any_size(spark):
    """A double, a bigint and a JSON number of one value have one encoding; neighbours have different ones."""
    wholes = [0, -7, 2**53 - 1, 2**53, 2**53 + 2, -(2**60) - 2**10, 2**62, 2**63, -(2**63), -(2**64) - 2**13, 2**100 + 2**60]
    df = spark.createDataFrame([(str(n), float(n)) for n in wholes], "j string, d double")
    got = df.select("j", cells.encode_cell(F.col("d"), T.DoubleType()), cells.encode_variant(F.parse_json("j"))).collect()
    assert [tuple(r) for r in got] == [(str(n), f"D:{n}", f"D:{n}") for n in wholes]
    odd = [("9007199254740993",), ("9007199254740992",), ("20000000000000000001",), ("20000000000000000000",), ("0.5",), ("1e300",)]
    text = spark.createDataFrame(odd, "j string").select(cells.encode_variant(F.parse_json("j"))).collect()
    assert [r[0] for r in text] == [*[f"D:{n}" for (n,) in odd[:4]], "D:0.5", "D:1.0E300"]
    assert spark.range(1).select(cells.encode_cell(F.lit(1e300), T.DoubleType())).first()[0] == "D:1.0E300"
    special = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-0.0,), (0.1,)], "d double")
    assert [r[0] for r in special.select(cells.encode_cell(F.col("d"), T.DoubleType())).collect()] == ["D:NaN", "D:Infinity", "N", "D:0", "D:0.1"]

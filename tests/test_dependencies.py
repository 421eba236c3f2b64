"""Key and inclusion discovery against trying every set of columns."""

import datetime
import itertools
import random

import pytest

from plumbline.operators import dependencies as dp


def plain_keys(rows, columns, max_size):
    found = []
    for size in range(1, max_size + 1):
        for s in itertools.combinations(range(len(columns)), size):
            if any(set(f) <= set(s) for f in found) or not rows:
                continue
            values = [tuple(r[i] for i in s) for r in rows]
            if all(v is not None for t in values for v in t) and len(set(values)) == len(values):
                found.append(s)
    return {tuple(columns[i] for i in s) for s in found}


def keys(df):
    return {(r["table"], tuple(r["columns"])) for r in df.collect()}


def test_a_pair_is_found(spark):
    """Neither column is a key, both are; a null, a repeat or a hot value elsewhere doesn't hide it."""
    rows = [(i // 20, i % 20, i if i % 3 else None, "x", float(i % 2) * -0.0) for i in range(800)]
    lines = spark.createDataFrame(rows, "a int, b long, holed int, same string, zero double").repartition(3)
    empty = spark.createDataFrame([], "k int, l int")
    nested = spark.createDataFrame([([1],), ([2],)], "only array<int>")
    got = keys(dp.unique_sets({"lines": lines, "empty": empty, "nested": nested}))
    assert got == {("lines", ("a", "b"))}


@pytest.mark.parametrize("seed", range(3))
def test_all_minimal_sets(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    kinds = "a int, b string, c double, d bigint, e string"
    tables, want = {}, set()
    for t in range(3):
        n = rng.choice([30, 400])
        spread = [rng.choice([2, 7, 60, n - 1, 10 * n]) for _ in names]
        rows = []
        for i in range(n):
            v = [rng.randrange(s) for s in spread]
            rows.append((v[0], f"{v[1]}:", float(v[2]), v[3], None if rng.random() < 0.01 else f"{v[4]}"))
        # Sets that repeat once only: the smaller ones are known to, and few rows are left to look at.
        rows.append((*rows[0][:3], -1, "z"))
        rows.append((rows[1][0], "new", *rows[1][2:4], "y"))
        tables[f"t{t}"] = spark.createDataFrame(rows, kinds)
        want |= {(f"t{t}", s) for s in plain_keys(rows, names, 3)}
    assert keys(dp.unique_sets(tables, max_size=3)) == want


def test_known_repeats_are_refined(spark):
    """A column with one repeat: only its two rows are looked at for the sets that hold it, also when it is hot."""
    rows = [(i, i % 5, i % 7, i % 11) for i in range(3000)] + [(5, 0, 6, 0)]
    df = spark.createDataFrame(rows, "near_key int, x int, y int, z int")
    got = keys(dp.unique_sets({"t": df}, max_size=3))
    assert got == {("t", s) for s in plain_keys(rows, ["near_key", "x", "y", "z"], 3)}
    assert ("t", ("near_key", "y")) in got and ("t", ("near_key", "x")) not in got


def test_inclusions(spark):
    day = datetime.date(2024, 1, 1)
    a = spark.createDataFrame([(i % 4, f"{i % 4}", float(i % 2), None, day) for i in range(50)], "n int, s string, d double, nothing string, day date")
    b = spark.createDataFrame([(i, f"{i}", -0.0 if i else 1.0) for i in range(6)] + [(None, None, None)], "key bigint, code string, real double")
    got = {
        (r["table"], r["column"], r.references_table, r.references_column): (r.n_values, r.n_shared, r.coverage)
        for r in dp.inclusions({"a": a, "b": b}).collect()
    }
    assert got == {
        ("a", "n", "b", "key"): (4, 4, 1.0),
        ("a", "s", "b", "code"): (4, 4, 1.0),
        ("a", "d", "b", "real"): (2, 2, 1.0),
        ("b", "real", "a", "d"): (2, 2, 1.0),
    }
    partial = {(r["column"], r.references_column): r.coverage for r in dp.inclusions({"a": a, "b": b}, 0.5).collect()}
    assert partial[("key", "n")] == 0.666667 and partial[("code", "s")] == 0.666667
    assert dp.inclusions({"a": a.limit(0), "b": b.limit(0)}).count() == 0

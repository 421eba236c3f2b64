"""Keys and references that are not declared, found in the data.

Values are compared by digests of 128 bits, two hashes with different seeds, so
that long texts are never shuffled. Whole numbers of any width are one class;
other types only meet their own. Nested columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.frames import union_all
from plumbline.functions.skew import hot_keys, salted_join
from plumbline.operators.profile import Tables
from plumbline.session import stored

MAX_SIZE = 2
# Estimates of distinct counts are good to 5 %, so half leaves ten standard deviations.
SURELY_REPEATED = 0.5
# One value in so many is looked at first; a repeat among them settles the set.
SAMPLED = 256

ColumnSet = tuple[str, ...]


@dataclass(frozen=True)
class Measured:
    """What one scan tells about the columns of a table."""

    rows: int
    distinct: dict[str, int]


def atomic(field: T.StructField) -> bool:
    return not isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def type_class(dtype: T.DataType) -> str:
    """Types whose values may be equal."""
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return dtype.simpleString()


def comparable(field: T.StructField) -> Column:
    """The value in the form in which equal values have equal hashes."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.IntegralType):
        return value.cast("bigint")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        # Both zeros are equal.
        return value + F.lit(0).cast(field.dataType)
    return value


def digest(*values: Column) -> Column:
    """One digest of some values: struct<h, g>."""
    return F.struct(F.xxhash64(*values).alias("h"), F.xxhash64(F.lit("second"), *values).alias("g"))


def _row_digest(fields: dict[str, T.StructField], columns: ColumnSet) -> Column:
    return digest(*[comparable(fields[c]) for c in columns])


def _measure(tables: Tables) -> dict[str, Measured]:
    """Rows, and the estimated distinct values of columns without nulls; one number per column goes to the driver."""
    parts = []
    for name, df in sorted(tables.items()):
        fields = [f for f in df.schema.fields if atomic(f)]
        if not fields:
            continue
        both = [F.struct(F.count(F.col(f"`{f.name}`")).alias("filled"), F.approx_count_distinct(comparable(f)).alias("near")).alias(f"c{i}") for i, f in enumerate(fields)]
        one = df.agg(F.count("*").alias("_rows"), *both)
        pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}.filled"), F.col(f"c{i}.near")) for i, f in enumerate(fields)])
        parts.append(one.select(F.lit(name).alias("table"), "_rows", F.inline(pairs)))
    found: dict[str, Measured] = {}
    for r in union_all(parts).collect() if parts else []:
        kept = found.setdefault(r["table"], Measured(r["_rows"], {}))
        if r["filled"] == r["_rows"]:
            kept.distinct[r["column"]] = r["near"]
    return found


def _next_level(refuted: set[ColumnSet], columns: list[str], size: int) -> list[ColumnSet]:
    """Sets of `size` columns whose subsets one smaller have all been refuted."""
    return [s for s in combinations(columns, size) if all(sub in refuted for sub in combinations(s, size - 1))]


def _sketched(df: DataFrame, name: str, sets: list[ColumnSet]) -> DataFrame:
    """(table, set, near): the estimated distinct rows of all sets from one scan."""
    fields = {f.name: f for f in df.schema.fields}
    near = [F.approx_count_distinct(F.xxhash64(*[comparable(fields[c]) for c in s])).alias(f"s{i}") for i, s in enumerate(sets)]
    one = df.agg(*near)
    pairs = F.array(*[F.struct(F.lit(i).alias("set"), F.col(f"s{i}").alias("near")) for i in range(len(sets))])
    return one.select(F.lit(name).alias("table"), F.inline(pairs))


def _digests(df: DataFrame, name: str, sets: list[tuple[int, ColumnSet, str | None, ColumnSet]]) -> list[DataFrame]:
    """Per set (table, set, digest, parent, upper): each row's digest, and that of a smaller set inside it.

    Few sets are left by now, and each reads its own columns only.
    """
    fields = {f.name: f for f in df.schema.fields}
    none = F.lit(None).cast("struct<h:bigint,g:bigint>")
    return [
        df.select(
            F.lit(name).alias("table"),
            F.lit(i).alias("set"),
            _row_digest(fields, s).alias("digest"),
            F.lit(parent).cast("string").alias("parent"),
            (_row_digest(fields, upper) if parent else none).alias("upper"),
        )
        for i, s, parent, upper in sets
    ]


def _repeats(digests: DataFrame) -> DataFrame:
    """Digests that occur more than once; equal ones combine in each task before the shuffle."""
    return digests.groupBy("table", "set", "digest").agg(F.count("*").alias("n")).filter("n > 1")


def _group(name: str, of: str) -> Column:
    """The key of a group of repeated rows: table, set and digest."""
    return F.concat_ws("/", "table", name, F.col(f"{of}.h").cast("string"), F.col(f"{of}.g").cast("string"))


def unique_sets(tables: Tables, max_size: int = MAX_SIZE) -> DataFrame:
    """(table, columns array<string>): minimal sets of at most max_size columns without nulls and without a repeated row.

    Level by level: a set is tried if all its subsets have been refuted. What
    can't be unique is dropped before any row is shuffled, by the product of the
    distinct counts of its columns and by a sketch of its own distinct rows. Of
    the rest one value in 256 is grouped first, where a repeat refutes the set;
    those that pass are grouped in full. If all repeated rows of a smaller set
    inside are known, only these rows are grouped, since splitting a group of
    one cannot bring a repeat.
    """
    spark = next(iter(tables.values())).sparkSession
    measured = _measure(tables)
    unique: list[tuple[str, list[str]]] = []
    refuted: dict[str, set[ColumnSet]] = {t: {()} for t in measured}
    # Sets whose repeated digests are all known, and those digests.
    known: dict[tuple[str, ColumnSet], str] = {}
    kept: DataFrame | None = None
    for size in range(1, max_size + 1):
        level: dict[str, list[ColumnSet]] = {}
        for t, m in measured.items():
            order = [f.name for f in tables[t].schema.fields if f.name in m.distinct]
            tried = _next_level(refuted[t], order, size) if m.rows else []
            refuted[t] = set()
            for s in tried:
                # Not more rows than the product of the columns' values can differ.
                possible = reduce(mul, (max(m.distinct[c], 1) for c in s)) >= m.rows * SURELY_REPEATED**size
                (level.setdefault(t, []).append(s) if possible else refuted[t].add(s))
        if size > 1 and level:
            near = {(r["table"], r["set"]): r["near"] for r in union_all([_sketched(tables[t], t, s) for t, s in level.items()]).collect()}
            for t, sets in level.items():
                low = {s for i, s in enumerate(sets) if near[(t, i)] < measured[t].rows * SURELY_REPEATED}
                refuted[t] |= low
                level[t] = [s for s in sets if s not in low]
        plans: dict[str, list[tuple[int, ColumnSet, str | None, ColumnSet]]] = {}
        for t, sets in level.items():
            for i, s in enumerate(sets):
                uppers = [u for u in combinations(s, size - 1) if (t, u) in known]
                upper = max(uppers, key=lambda u: reduce(mul, (measured[t].distinct[c] for c in u))) if uppers else ()
                plans.setdefault(t, []).append((i, s, known.get((t, upper)), upper))
        if not plans:
            continue
        few = union_all([d for t, p in sorted(plans.items()) for d in _digests(tables[t], t, p)]).filter(
            F.pmod("digest.h", F.lit(SAMPLED)) == 0
        )
        settled = {(r["table"], r["set"]) for r in _repeats(few).select("table", "set").distinct().collect()}
        left = {t: [p for p in ps if (t, p[0]) not in settled] for t, ps in plans.items()}
        found: set[tuple[str, int]] = set()
        if any(left.values()):
            every = union_all([d for t, p in sorted(left.items()) for d in _digests(tables[t], t, p)])
            whole = every.filter("parent IS NULL")
            if kept is not None and any(p[2] for ps in left.values() for p in ps):
                refine = every.filter("parent IS NOT NULL").withColumn("key", _group("parent", "upper"))
                groups = kept.select(_group("name", "digest").alias("key"), "n")
                inside = salted_join(refine, groups.drop("n"), "key", hot_keys(groups, "key"), "digest.h")
                whole = whole.unionByName(inside.select(*whole.columns))
            repeats = stored(_repeats(whole), "repeated-rows")
            found = {(r["table"], r["set"]) for r in repeats.select("table", "set").distinct().collect()}
            names = spark.createDataFrame(
                [(t, p[0], ", ".join(p[1])) for t, ps in left.items() for p in ps if (t, p[0]) in found] or [("", -1, "")],
                "table string, set int, name string",
            )
            kept = stored(repeats.join(F.broadcast(names), ["table", "set"]), "repeated-named")
        known = {}
        for t, ps in plans.items():
            for i, s, _, _ in ps:
                if (t, i) in settled:
                    refuted[t].add(s)
                elif (t, i) in found:
                    refuted[t].add(s)
                    known[(t, s)] = ", ".join(s)
                else:
                    unique.append((t, list(s)))
    return spark.createDataFrame(unique, "table string, columns array<string>")


def inclusions(tables: Tables, min_coverage: float = 1.0) -> DataFrame:
    """(table, column, references_table, references_column, n_values, n_shared, coverage) of all pairs of columns.

    Whatever the names, a column is included in another if its distinct
    non-null values all occur there; with a smaller `min_coverage`, so many of
    them. Values of all columns meet in one shuffle, where each becomes the set
    of columns that hold it; equal sets are counted, and a pair shares what the
    sets with both hold. No column is compared with another one by one, and no
    group is larger than the number of columns.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = [(t, f) for t, df in sorted(tables.items()) for f in df.schema.fields if atomic(f)]
    number = {(t, f.name): i for i, (t, f) in enumerate(columns)}
    parts = []
    for t, df in sorted(tables.items()):
        fields = [f for f in df.schema.fields if atomic(f)]
        if fields:
            held = F.array(
                *[
                    F.struct(
                        F.lit(number[(t, f.name)]).alias("column"),
                        F.when(F.col(f"`{f.name}`").isNotNull(), digest(F.lit(type_class(f.dataType)), comparable(f))).alias("value"),
                    )
                    for f in fields
                ]
            )
            parts.append(df.select(F.inline(held)).filter("value IS NOT NULL"))
    # Repeated values of a column combine in each task before the shuffle.
    by_value = union_all(parts).groupBy("value").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    sets = stored(by_value.groupBy("columns").agg(F.count("*").alias("n")), "column-sets")
    sizes = sets.select(F.explode("columns").alias("a"), "n").groupBy("a").agg(F.sum("n").alias("n_values"))
    both = (
        sets.select("columns", F.explode("columns").alias("a"), "n")
        .select("a", F.explode("columns").alias("b"), "n")
        .filter("a <> b")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n_shared"))
    )
    names = spark.createDataFrame([(i, t, f.name) for i, (t, f) in enumerate(columns)], "i int, t string, c string")
    left = F.broadcast(names.select(F.col("i").alias("a"), F.col("t").alias("table"), F.col("c").alias("column")))
    right = F.broadcast(names.select(F.col("i").alias("b"), F.col("t").alias("references_table"), F.col("c").alias("references_column")))
    return (
        both.join(sizes, "a")
        .filter(F.col("n_shared") >= F.col("n_values") * min_coverage)
        .join(left, "a")
        .join(right, "b")
        .select("table", "column", "references_table", "references_column", "n_values", "n_shared", F.round(F.col("n_shared") / F.col("n_values"), 6).alias("coverage"))
    )

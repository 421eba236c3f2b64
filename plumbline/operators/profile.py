"""Profiles of a set of tables: columns, row counts, keys, sample values.

Types carry their PostgreSQL names, since profiles end up in DDL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.frames import union_all

# Type names, the types worth sampling, and the sampling limits.
TYPE_NAMES = {
    "bigint": "bigint",
    "int": "integer",
    "smallint": "smallint",
    "tinyint": "smallint",
    "double": "double precision",
    "float": "real",
    "string": "text",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp with time zone",
    "timestamp_ntz": "timestamp without time zone",
    "binary": "bytea",
}
SAMPLED_TYPES = ["text", "character varying", "character", "date", "boolean"]
MAX_DISTINCT = 50
PER_COLUMN = 3
SAMPLE_WIDTH = 40

Tables = dict[str, DataFrame]
Keys = dict[str, list[str]]
Reference = tuple[str, list[str], str, list[str]]

# Estimated distinct share below which a column is surely not unique. The
# estimate is good to 5 %, so half leaves ten standard deviations.
_SURELY_REPEATED = 0.5


def _spark(tables: Tables) -> SparkSession:
    return next(iter(tables.values())).sparkSession


def type_name(dtype: T.DataType) -> str:
    simple = dtype.simpleString()
    if simple.startswith("varchar("):
        return "character varying"
    if simple.startswith("char("):
        return "character"
    if simple.startswith("decimal("):
        return "numeric"
    if isinstance(dtype, T.ArrayType):
        return "ARRAY"
    return TYPE_NAMES.get(simple, simple)


def _sampled(field: T.StructField) -> bool:
    return type_name(field.dataType) in SAMPLED_TYPES


def profile_columns(tables: Tables, measure_nulls: bool = False) -> DataFrame:
    """(table, column, ordinal, data_type, nullable[, n_nulls]) for every column.

    Without `measure_nulls` this reads schemas only; with it, one aggregate per
    table counts the nulls of all its columns.
    """
    if not measure_nulls:
        rows = [
            (name, f.name, i, type_name(f.dataType), f.nullable)
            for name in sorted(tables)
            for i, f in enumerate(tables[name].schema.fields, start=1)
        ]
        return _spark(tables).createDataFrame(
            rows, "table string, column string, ordinal int, data_type string, nullable boolean"
        )
    return union_all([_measured(name, tables[name]) for name in sorted(tables)])


def _measured(name: str, df: DataFrame) -> DataFrame:
    nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    described = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(i).alias("ordinal"),
                F.lit(type_name(f.dataType)).alias("data_type"),
                F.lit(f.nullable).alias("nullable"),
                F.col(f"`{f.name}`").alias("n_nulls"),
            )
            for i, f in enumerate(df.schema.fields, start=1)
        ]
    )
    return nulls.select(F.lit(name).alias("table"), F.explode(described).alias("c")).select("table", "c.*")


def row_counts(tables: Tables) -> DataFrame:
    """(table, n_rows); counting reads file footers only."""
    return union_all(
        [
            tables[name].agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
            for name in sorted(tables)
        ]
    )


def _distinct_floor(value: Column) -> Column:
    """A lower bound of the distinct count: hash values seen, out of 32,768.

    Two values may share a hash but one value never has two, so a bound above
    the limit proves that the limit is exceeded. The state is a 4 KB bitmap,
    merged map-side.
    """
    position = F.when(value.isNotNull(), F.bitmap_bit_position(F.xxhash64(value)))
    return F.bitmap_count(F.bitmap_construct_agg(position))


def _few_valued(tables: Tables, keys: Keys, limit: int) -> dict[str, list[str]]:
    """Sampled columns not proven to exceed `limit` distinct values, per table.

    The only data sent to the driver is one number per column.
    """
    bounds = []
    for name, df in sorted(tables.items()):
        names = [f.name for f in df.schema.fields if _sampled(f) and f.name not in keys.get(name, [])]
        if names:
            one = df.agg(*[_distinct_floor(F.col(f"`{c}`")).alias(c) for c in names])
            pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("floor")) for c in names])
            bounds.append(one.select(F.lit(name).alias("table"), F.inline(pairs)))
    kept: dict[str, list[str]] = {}
    if bounds:
        for row in union_all(bounds).filter(F.col("floor").between(1, limit)).collect():
            kept.setdefault(row["table"], []).append(row["column"])
    return kept


def sample_values(
    tables: Tables,
    keys: Keys | None = None,
    per_column: int = PER_COLUMN,
    max_distinct: int = MAX_DISTINCT,
    width: int = SAMPLE_WIDTH,
) -> DataFrame:
    """(table, column, sample_values) of text, date and boolean non-key columns.

    Columns with more than `max_distinct` distinct non-null values have none.
    The others give their first distinct values in ascending order, after
    truncation to `width` characters.
    """
    candidates = _few_valued(tables, keys or {}, max_distinct)
    parts = []
    for name, columns in sorted(candidates.items()):
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
        )
        parts.append(tables[name].select(F.lit(name).alias("table"), F.inline(pairs)))
    if not parts:
        return _spark(tables).createDataFrame([], "table string, column string, sample_values array<string>")
    # Few distinct values per column are left, so the map-side combine leaves little to shuffle.
    values = union_all(parts).filter(F.col("value").isNotNull()).distinct()
    # The bound can miss a column just above the limit: count what is there.
    known = values.groupBy("table", "column").agg(F.count("*").alias("n")).filter(F.col("n") <= max_distinct)
    shown = values.join(known.select("table", "column"), ["table", "column"], "left_semi").select(
        "table", "column", F.left("value", F.lit(width)).alias("value")
    )
    nth = F.row_number().over(W.partitionBy("table", "column").orderBy("value"))
    first = shown.distinct().withColumn("_nth", nth).filter(F.col("_nth") <= per_column)
    return first.groupBy("table", "column").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))


def primary_keys(tables: Tables, declared: Keys | None = None) -> DataFrame:
    """(table, column, is_primary_key) for every column.

    With `declared` keys nothing is read. Otherwise a column is a key if it has
    no nulls and no value occurs twice; each such column is marked on its own.
    """
    if declared is not None:
        rows = [(t, c, c in declared.get(t, [])) for t in sorted(tables) for c in tables[t].columns]
        return _spark(tables).createDataFrame(rows, "table string, column string, is_primary_key boolean")
    return _discovered(tables)


def _atomic(field: T.StructField) -> bool:
    return not isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def _unique_candidates(tables: Tables) -> dict[str, list[str]]:
    """Columns without nulls whose distinct estimate does not rule out uniqueness."""
    bounds = []
    for name, df in sorted(tables.items()):
        names = [f.name for f in df.schema.fields if _atomic(f)]
        one = df.agg(
            F.count("*").alias("_n"),
            *[
                F.struct(F.count(F.col(f"`{c}`")).alias("filled"), F.approx_count_distinct(F.col(f"`{c}`")).alias("near")).alias(c)
                for c in names
            ],
        )
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.filled").alias("filled"), F.col(f"`{c}`.near").alias("near")) for c in names]
        )
        bounds.append(one.select(F.lit(name).alias("table"), "_n", F.inline(pairs)))
    may_be = (F.col("filled") == F.col("_n")) & (F.col("near") >= F.col("_n") * _SURELY_REPEATED)
    kept: dict[str, list[str]] = {}
    for row in union_all(bounds).filter(may_be).collect():
        kept.setdefault(row["table"], []).append(row["column"])
    return kept


def _discovered(tables: Tables) -> DataFrame:
    everything = profile_columns(tables).select("table", "column")
    candidates = _unique_candidates(tables)
    parts = []
    for name, columns in sorted(candidates.items()):
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
        )
        parts.append(tables[name].select(F.lit(name).alias("table"), F.inline(pairs)))
    if not parts:
        return everything.withColumn("is_primary_key", F.lit(False))
    # A repeated value combines map-side before the exchange.
    repeated = (
        union_all(parts)
        .groupBy("table", "column", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("table", "column")
        .agg(F.max("n").alias("most"))
    )
    return everything.join(repeated, ["table", "column"], "left").select(
        "table", "column", F.coalesce(F.col("most") == 1, F.lit(False)).alias("is_primary_key")
    )


def foreign_keys(spark: SparkSession, declared: list[Reference]) -> DataFrame:
    """(table, column, references_table, references_column); composite keys pair by position."""
    rows = spark.createDataFrame(
        declared,
        "table string, columns array<string>, references_table string, references_columns array<string>",
    )
    paired = F.inline(F.arrays_zip("columns", "references_columns"))
    return rows.select("table", "references_table", paired).select(
        "table",
        F.col("columns").alias("column"),
        "references_table",
        F.col("references_columns").alias("references_column"),
    )


def fk_discovery(tables: Tables, candidates: list[Reference]) -> DataFrame:
    """Inclusion test per candidate: rows, orphans and coverage of the child columns."""
    parts = []
    for child, columns, parent, targets in candidates:
        keys = [f"k{i}" for i in range(len(columns))]
        # Counting per value first turns a hot key into one row.
        values = (
            tables[child]
            .select(*[F.col(f"`{c}`").alias(k) for c, k in zip(columns, keys)])
            .dropna()
            .groupBy(*keys)
            .agg(F.count("*").alias("n"))
        )
        known = (
            tables[parent]
            .select(*[F.col(f"`{c}`").alias(k) for c, k in zip(targets, keys)])
            .distinct()
            .withColumn("found", F.lit(True))
        )
        parts.append(
            values.join(known, keys, "left")
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
            )
            .select(
                F.lit(child).alias("table"),
                F.lit(", ".join(columns)).alias("columns"),
                F.lit(parent).alias("references_table"),
                "n_rows",
                "orphans",
                F.when(F.col("n_rows") > 0, F.round(1 - F.col("orphans") / F.col("n_rows"), 6)).alias("coverage"),
            )
        )
    return union_all(parts)


def fk_candidates(tables: Tables, declared: Keys) -> list[Reference]:
    """Columns of the same type as another table's one-column key, with the same name,
    or the same name after a table prefix (o_custkey, c_custkey); a bare id says too little."""
    found: list[Reference] = []
    for parent, key in sorted(declared.items()):
        if len(key) != 1:
            continue
        target = next(f for f in tables[parent].schema.fields if f.name == key[0])
        stem = key[0].split("_", 1)[-1]
        for child, df in sorted(tables.items()):
            for field in df.schema.fields:
                same = field.name == key[0] or (stem != "id" and field.name.split("_", 1)[-1] == stem)
                if child != parent and same and field.dataType == target.dataType:
                    found.append((child, [field.name], parent, key))
    return found


def catalog_profile(
    tables: Tables, declared: Keys, references: list[Reference], with_samples: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole profile: (column_profile, table_profile, fk)."""
    columns = profile_columns(tables).join(primary_keys(tables, declared), ["table", "column"], "left")
    if with_samples:
        columns = columns.join(sample_values(tables, declared), ["table", "column"], "left")
        samples = F.coalesce("sample_values", F.array().cast("array<string>"))
    else:
        samples = F.array().cast("array<string>")
    profile = columns.select(
        "table",
        "column",
        "ordinal",
        "data_type",
        "nullable",
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"),
        samples.alias("sample_values"),
    )
    return profile, row_counts(tables), foreign_keys(_spark(tables), references)


def catalog_summary(column_profile: DataFrame, table_profile: DataFrame, fk: DataFrame) -> DataFrame:
    """One row of counts over a profile."""
    per_table = column_profile.groupBy("table").agg(
        F.count("*").alias("n_columns"),
        F.count_if(F.size("sample_values") > 0).alias("n_sampled"),
        F.bool_or("is_primary_key").alias("has_key"),
    )
    linked = fk.groupBy("table").agg(F.count("*").alias("n_fks"))
    return (
        table_profile.join(per_table, "table", "left")
        .join(linked, "table", "left")
        .agg(
            F.count("*").alias("n_tables"),
            F.coalesce(F.sum("n_columns"), F.lit(0)).alias("n_columns"),
            F.coalesce(F.sum("n_fks"), F.lit(0)).alias("n_foreign_keys"),
            F.coalesce(F.sum("n_sampled"), F.lit(0)).alias("n_sampled_columns"),
            F.count_if(~F.coalesce("has_key", F.lit(False))).alias("n_without_primary_key"),
            F.count_if(F.col("n_fks").isNull()).alias("n_without_foreign_key"),
        )
    )


def largest_tables(table_profile: DataFrame, k: int = 10) -> DataFrame:
    """The k tables with most rows; names break ties."""
    return table_profile.orderBy(F.desc("n_rows"), "table").limit(k)


def table_detail(
    column_profile: DataFrame, table_profile: DataFrame, fk: DataFrame, name: str | None = None
) -> DataFrame:
    """(table, ordinal, line): one line per column with flags and samples, then its
    foreign keys; of one table, or of all."""
    flags = F.concat_ws(
        ", ", F.when(F.col("is_primary_key"), "PK"), F.when(~F.col("nullable"), "NOT NULL")
    )
    line = F.concat(
        F.lit("  "),
        F.when(F.length("column") < 22, F.rpad("column", 22, " ")).otherwise(F.col("column")),
        F.lit(" "),
        F.col("data_type"),
        F.when(flags != "", F.concat(F.lit("  ["), flags, F.lit("]"))).otherwise(""),
        F.when(
            F.size("sample_values") > 0, F.concat(F.lit("   ex: "), F.array_join("sample_values", ", "))
        ).otherwise(""),
    )
    columns = column_profile.select("table", "ordinal", line.alias("line"))
    links = fk.select(
        "table",
        F.lit(1_000_000).alias("ordinal"),
        F.concat(F.lit("  FK: "), "column", F.lit(" -> "), "references_table", F.lit("."), "references_column").alias("line"),
    )
    every = columns.unionByName(links)
    return every if name is None else every.filter(F.col("table") == name)

"""Profiles of a data set: missing values, statistics, duplicates, correlations.

All columns of a frame share one pass; the single row it returns is then
turned into one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.coerce import as_number
from ..functions.roles import numeric_columns, quoted, text_columns
from ..session import new_folder
from .quantiles import exact_quantiles

PAIRS_PER_PASS = 400  # correlations computed by one aggregation
FEW_HASHES = 2_000_000  # of repeated rows, 16 bytes each, that are broadcast


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or not a number."""
    null = quoted(name).isNull()
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return null | F.isnan(quoted(name))
    return null


def column_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    return "categorical" if isinstance(kind, T.StringType) else "other"


def column_types(df: DataFrame) -> DataFrame:
    """Each column with its type, kind and number of values."""
    counted = df.agg(*[F.count_if(~is_missing(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(column_kind(f.dataType)).alias("kind"),
            F.col(f"n{i}").alias("present"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select(F.inline(F.array(*rows)))


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percentage of the columns that have any."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("missing_count"),
            F.round(F.try_divide(F.col(f"n{i}"), F.col("rows")) * 100, 1).alias("missing_pct"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*rows))).filter("missing_count > 0")


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numeric and categorical columns, missing cells."""
    missing = [F.count_if(is_missing(df, c)) for c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric_columns(df))).alias("numeric"),
        F.lit(len(text_columns(df))).alias("categorical"),
        sum(missing[1:], missing[0]).alias("missing"),
    )


def duplicate_rows(df: DataFrame, few: int = FEW_HASHES) -> DataFrame:
    """One row: how many rows repeat an earlier one; nulls are alike.

    Rows meet by a hash of 128 bits, so what travels does not depend on their width; copies are merged before the
    shuffle. Only rows whose hashes meet are compared whole, and of those each task sends one of a kind. They are picked out where
    they lie if there are at most ``few`` such hashes, which are broadcast, and by a shuffled join beyond.
    """
    marks = [quoted(c).isNull() for c in df.columns]  # a hash skips nulls
    keys = [F.xxhash64(F.lit(salt), *marks, *[quoted(c) for c in df.columns]).alias(f"_h{salt}") for salt in (1, 2)]
    hashed = df.select(*keys, F.struct("*").alias("_row"))
    counts = hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_copies"))
    folder = new_folder(df.sparkSession, "row-hashes")
    counts.filter("_copies > 1").write.parquet(folder)
    met = df.sparkSession.read.schema("_h1 long, _h2 long, _copies long").parquet(folder)
    keyed = met.select("_h1", "_h2")
    picked = hashed.join(F.broadcast(keyed) if keyed.limit(few + 1).count() <= few else keyed, ["_h1", "_h2"], "left_semi")
    kinds = picked.groupBy("_row").agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("n"))
    copies = met.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n"))
    # Both are one row by construction: aggregates without a group.
    repeated = copies.select("n").scalar() - kinds.select("n").scalar()
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", repeated.alias("duplicates"))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each numeric column."""
    columns = list(columns or numeric_columns(df))
    if not columns:
        raise ValueError("There is no numeric column to profile.")
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    values = df.select(*[as_number(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    aggregates = []
    for i in range(len(columns)):
        c = f"c{i}"
        aggregates.append(F.struct(
            F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"), F.max(c).alias("max"),
        ).alias(c))
    rows = []
    for i, name in enumerate(columns):
        q25, q50, q75 = [F.lit(q).cast("double") for q in quartiles[name]]
        rows.append(F.struct(
            F.lit(name).alias("column"),
            F.col(f"c{i}.count").alias("count"),
            *[F.round(v, 2).alias(n) for n, v in (
                ("mean", F.col(f"c{i}.mean")), ("std", F.col(f"c{i}.std")), ("min", F.col(f"c{i}.min")),
                ("p25", q25), ("p50", q50), ("p75", q75), ("max", F.col(f"c{i}.max")),
            )],
        ))
    return values.agg(*aggregates).select(F.inline(F.array(*rows)))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, as (col_x, col_y, corr).

    Each pair uses the rows where both have values; a constant column has none.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        raise ValueError("A correlation needs at least two numeric columns.")
    values = df.select(*[as_number(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = list(combinations(range(len(columns)), 2)) + [(i, i) for i in range(len(columns))]
    parts = []
    for first in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[first:first + PAIRS_PER_PASS]
        matrix = values.agg(*[_correlation(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i, j in chunk])
        cells = [
            F.struct(F.lit(columns[x]).alias("col_x"), F.lit(columns[y]).alias("col_y"), F.col(f"r{i}_{j}").alias("corr"))
            for i, j in chunk
            for x, y in ({(i, j), (j, i)})
        ]
        parts.append(matrix.select(F.inline(F.array(*cells))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("corr", F.round("corr", 4))


def _correlation(x: str, y: str) -> Column:
    # The built-in corr() divides by zero on a constant column.
    if x == y:
        return F.when(F.var_samp(x) > 0, F.lit(1.0))
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.sqrt(F.var_samp(F.when(both, F.col(x))) * F.var_samp(F.when(both, F.col(y))))
    return F.try_divide(F.covar_samp(x, y), spread)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers become the column's exact median; columns without values are dropped.

    One pass tells which columns have gaps: no other median is needed.
    """
    numbers = {c: as_number(df, c).cast("double") for c in columns}
    rows, *missing = df.agg(F.count(F.lit(1)), *[F.count_if(n.isNull()) for n in numbers.values()]).first()
    gaps = [c for c, n in zip(columns, missing) if n or not rows]
    fill = {**dict.fromkeys(columns, 0.0), **medians(df, gaps)}
    kept = [c for c in df.columns if c not in fill or fill[c] is not None]
    return df.select(*[
        F.coalesce(as_number(df, c).cast("double"), F.lit(fill[c])).alias(c) if c in fill else quoted(c)
        for c in kept
    ])


def varied_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """For each column whether it has more than two distinct values.

    A third value lies strictly between the extremes, so two cheap passes
    decide it without counting distinct values.
    """
    columns = list(columns or numeric_columns(df))
    values = df.select(*[F.when(~is_missing(df, c), quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    ends = values.agg(F.struct(*[
        F.struct(F.min(n).alias("low"), F.max(n).alias("high")).alias(n) for n in values.columns
    ]).alias("ends")).scalar()
    third = values.agg(*[
        F.coalesce(F.bool_or((F.col(n) > ends[n]["low"]) & (F.col(n) < ends[n]["high"])), F.lit(False)).alias(n)
        for n in values.columns
    ])
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(n).alias("varied")) for c, n in zip(columns, values.columns)
    ]
    return third.select(F.inline(F.array(*cells)))

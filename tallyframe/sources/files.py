"""Files as DataFrames, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.roles import normalise_columns, quoted

# Spellings of a missing cell.
NULL_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
WHOLE_PATTERN = r"^\s*[+-]?\d+\s*$"
# Longer whole numbers than this many digits stay text: no type holds them exactly.
MOST_DIGITS = 38
DECIMAL_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
BOOLEAN_PATTERN = r"^(True|TRUE|true|False|FALSE|false)$"
# Files of at most this many bytes are one task's work in any case.
ONE_TASK = 128 << 20


class UnsupportedSource(ValueError):
    """The file is of a kind that cannot be read, or holds no rows."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool | None = None) -> DataFrame:
    """A CSV with a header row.

    Every cell is read as text and the spellings of a missing cell become null.
    With a schema, columns are taken by position and cast, cells that don't fit
    becoming null. Without one a pass finds the narrowest type that fits all
    cells of each column: long, decimal(38,0) for whole numbers beyond it,
    double, boolean, else text. Dates stay text, and so do whole numbers of more
    than 38 digits.

    Quoted cells may hold line breaks, for which one task has to read the whole file. Large files are looked at first,
    and are shared by many tasks if no cell of theirs goes on in the next line; ``multi_line`` decides for all without looking.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
    groups = _by_breaks(spark, path) if multi_line is None else [(multi_line, [path])]
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names = [f.name for f in wanted]
    else:
        names = reader.option("multiLine", groups[-1][0]).csv(path).columns
    text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    parts = [_known(reader.option("multiLine", multi).schema(text).csv(paths)) for multi, paths in groups]
    known = reduce(DataFrame.unionAll, parts)
    if schema is not None:
        return known.select(*[_cast(F.col(c), f.dataType).alias(f.name) for c, f in zip(known.columns, wanted)])
    digits = {c: F.length(F.regexp_replace(c, r"^\s*[+-]?0*|\s", "")) for c in known.columns}
    fits = known.agg(*[
        F.struct(
            F.bool_and(F.col(c).rlike(WHOLE_PATTERN)).alias("whole"),
            F.bool_and(F.when(F.col(c).isNotNull(), F.trim(c).try_cast("long").isNotNull())).alias("long"),
            F.max(digits[c]).alias("digits"),
            F.bool_and(F.col(c).rlike(DECIMAL_PATTERN)).alias("double"),
            F.bool_and(F.col(c).rlike(BOOLEAN_PATTERN)).alias("boolean"),
        ).alias(c)
        for c in known.columns
    ]).first()
    return known.select(*[_typed(c, fits[c]).alias(name) for c, name in zip(known.columns, names)])


def _by_breaks(spark: SparkSession, path: str) -> list[tuple[bool, list[str]]]:
    """(whether cells may hold line breaks, files): the files of ``path``, those that can be split first.

    A line that ends inside a quoted cell has an odd number of quotes, so a file whose lines all have an even number
    holds one record a line. The driver gets names of files, as it does for any read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("uri"), "length")
    large = {r["uri"]: r["path"] for r in files.filter(F.col("length") > ONE_TASK).collect()}
    if not large or any(mark in name for name in large.values() for mark in "*?[]{}\\"):  # names that would be read as patterns
        return [(True, [path])]
    lines = spark.read.text(list(large.values())).select("value", F.col("_metadata.file_path").alias("uri"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = {r["uri"] for r in lines.filter(quotes % 2 == 1).select("uri").distinct().collect()}
    plain = [name for uri, name in large.items() if uri not in broken]
    if not plain:
        return [(True, [path])]
    small = [r["path"] for r in files.filter(F.col("length") <= ONE_TASK).collect()]
    others = [*small, *[large[uri] for uri in broken]]
    return [(False, plain), (True, others)] if others else [(False, plain)]


def _known(cells: DataFrame) -> DataFrame:
    return cells.select(*[F.when(~quoted(c).isin(NULL_SPELLINGS), quoted(c)).alias(c) for c in cells.columns])


def _cast(text: Column, kind: T.DataType) -> Column:
    return text if isinstance(kind, T.StringType) else F.trim(text).try_cast(kind)


def _typed(name: str, fits) -> Column:
    column = F.col(name)
    if fits["double"] is None:  # no cell at all: numbers that are all missing
        return column.cast("double")
    if fits["whole"]:
        # null cells are left out by the aggregates, so all others fit
        if fits["long"]:
            return F.trim(column).cast("long")
        return F.trim(column).cast("decimal(38,0)") if fits["digits"] <= MOST_DIGITS else column
    for kind in ("double", "boolean"):
        if fits[kind]:
            return F.trim(column).cast(kind)
    return column


def load(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, Parquet or JSON source with normalised column names."""
    kind = path.rstrip("/").lower().rsplit(".", 1)[-1]
    if kind == "csv":
        df = read_csv(spark, path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("json", "jsonl"):
        df = spark.read.json(path)
    else:
        raise UnsupportedSource(f"Only .csv, .parquet and .json sources can be read, not {path}")
    if df.isEmpty():
        raise UnsupportedSource(f"{path} holds no rows.")
    return normalise_columns(df)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, each with a header row.

    A missing cell is empty; so is an empty text, which reading takes for missing.
    """
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, escape='"', emptyValue="", **spaces).mode("overwrite").csv(path)



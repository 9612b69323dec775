"""Typed columns out of untidy ones, and sums that do not depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F, types as T

from .roles import quoted

# What counts as a number in text. A bare cast would also take '5d'.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"

# Date formats tried in this order after the ISO spellings.
DATE_FORMATS = ["MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd", "dd-MMM-yyyy", "MMM d, yyyy", "yyyyMMdd"]

# How many of each unit make a second.
EPOCH_UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def as_number(df: DataFrame, name: str) -> Column:
    """The column as long or double; what is not a number becomes null."""
    kind, column = df.schema[name].dataType, quoted(name)
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("long")
    if isinstance(kind, T.NumericType):
        value = column.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.StringType):
        return F.when(column.rlike(NUMBER_PATTERN), F.trim(column).try_cast("double"))
    return F.lit(None).cast("double")


def number_or_zero(df: DataFrame, name: str) -> Column:
    number = as_number(df, name)
    return F.coalesce(number, F.lit(0).cast("long" if is_whole(df, name) else "double"))


def is_whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.IntegralType, T.BooleanType))


def drop_non_numbers(df: DataFrame, name: str) -> DataFrame:
    """The column as a number; rows where it is none are left out."""
    return df.withColumn(name, as_number(df, name)).filter(quoted(name).isNotNull())


def as_timestamp(
    df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS, unit: str | None = None
) -> Column:
    """The column as a timestamp; what is not a date becomes null.

    Whole numbers need a ``unit`` ('s', 'ms', 'us' or 'ns' since 1970).
    """
    kind, column = df.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return column
    if isinstance(kind, T.DateType):
        return column.cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        text = F.trim(column)
        readings = [text.try_cast("timestamp_ntz")]
        readings += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
        return F.coalesce(*readings)
    if isinstance(kind, T.NumericType) and unit:
        micros = F.floor(column.cast("decimal(28,6)") * F.lit(1_000_000) / F.lit(EPOCH_UNITS[unit]))
        return F.timestamp_micros(micros.cast("long")).cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        raise ValueError(f"Column {name} holds numbers: name their unit to read them as dates.")
    return F.lit(None).cast("timestamp_ntz")


def coerce_dates(df: DataFrame, name: str, **options) -> DataFrame:
    """The column as a timestamp; rows where it is no date are left out."""
    return df.withColumn(name, as_timestamp(df, name, **options)).filter(quoted(name).isNotNull())


def date_quality(df: DataFrame, name: str, **options) -> DataFrame:
    """One row: how many rows there are, and how many ``coerce_dates`` keeps and drops."""
    parsed = F.count(as_timestamp(df, name, **options))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        parsed.alias("kept"),
        (F.count(F.lit(1)) - parsed).alias("dropped"),
    )


def total(value: Column, whole: bool = False, over: WindowSpec | None = None) -> Column:
    """The sum as a double (long if ``whole``), 0 over no rows; running if ``over`` a window.

    Amounts of at most two decimals are added as whole cents: the result is
    exact and the same however rows are spread. Otherwise values are rounded to nine
    decimals and added exactly; only where they are too large for that, as they are.
    """
    def placed(aggregate: Column) -> Column:
        return aggregate.over(over) if over is not None else aggregate

    if whole:
        return F.coalesce(placed(F.sum(value)), F.lit(0).cast("long"))
    cents = F.rint(value * 100).try_cast("long")
    fits = value.isNull() | F.coalesce(cents / 100.0 == value, F.lit(False))
    exact = F.when(placed(F.bool_and(fits)), placed(F.try_sum(cents)) / 100.0)
    fine = value.try_cast("decimal(29,9)")
    rounded = F.when(placed(F.bool_and(value.isNull() | fine.isNotNull())), placed(F.try_sum(fine)).try_cast("double"))
    return F.coalesce(exact, rounded, placed(F.sum(value)), F.lit(0.0))

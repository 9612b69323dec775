"""What is kept of rows so that they need not be read again: sets of users per day, and sketches of columns per file.

Both are merged for any union of days or files, by aggregates whose tasks combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import as_number, as_timestamp
from ..functions.roles import quoted
from ..session import new_folder
from .encode import label_codes
from .joins import attach

# -- exact sets of users -----------------------------------------------------------------


def user_numbers(activity: DataFrame, user: str) -> DataFrame:
    """(user, number): the users as text, numbered from 1, so that the sets of dense numbers are small."""
    named = activity.filter(quoted(user).isNotNull())
    folder = new_folder(activity.sparkSession, "user-numbers")
    label_codes(named, user).write.parquet(folder)
    numbers = activity.sparkSession.read.schema("label string, code long").parquet(folder)
    return numbers.select(F.col("label").alias("user"), (F.col("code") + 1).alias("number"))


def daily_sets(activity: DataFrame, user: str, moment: str, numbers: DataFrame) -> DataFrame:
    """(day, range, users): for each day and range of 32,768 numbers a bitmap of the active users.

    A set takes one bit for each user of a range that has any. Rows without a user or a moment count nowhere; a user
    that ``numbers`` lacks is an error. Rows shrink to one per user and day before they are numbered.
    """
    stamp = as_timestamp(activity, moment)
    seen = activity.select(quoted(user).cast("string").alias("user"), stamp.cast("date").alias("day"))
    seen = attach(seen.filter("user IS NOT NULL AND day IS NOT NULL").distinct(), numbers, "user", "left")
    number = F.coalesce("number", F.raise_error(F.concat(F.lit("No number for user "), "user")).cast("long"))
    placed = seen.select("day", number.alias("number"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users")
    return placed.groupBy("day", F.bitmap_bucket_number("number").alias("range")).agg(bits)


def active_users(sets: DataFrame, *span: Column) -> DataFrame:
    """(span, users): the distinct users of each span of days, out of the sets alone."""
    merged = sets.groupBy(*span, "range").agg(F.bitmap_or_agg("users").alias("users"))
    names = [c for c in merged.columns if c not in ("range", "users")]
    return merged.groupBy(*map(quoted, names)).agg(F.sum(F.bitmap_count("users")).alias("users"))


def rolling_users(sets: DataFrame, days: int) -> DataFrame:
    """(day, users): the distinct users of the ``days`` days that end with each day from the first to the last one."""
    ends = F.explode(F.sequence("day", F.least(F.date_add("day", days - 1), F.col("_last"))))
    # One row by construction: an aggregate without a group.
    last = sets.agg(F.max("day").alias("last")).select("last").scalar()
    spread = sets.withColumn("_last", last).select(ends.alias("end"), "range", "users")
    return active_users(spread, F.col("end").alias("day"))


# -- quantile sketches --------------------------------------------------------------------

#: Size of a sketch: the rank of a quantile that it tells is off by about 2 / ACCURACY of the rows, rarely by more.
ACCURACY = 2048
KEPT_FACTS = ["present", "least", "most", "total", "sketch"]


def column_sketches(df: DataFrame, columns: Sequence[str], part: Column, accuracy: int = ACCURACY) -> DataFrame:
    """(part, column, rows, present, least, most, total, sketch): what is kept of numeric columns for each part, as of a file.

    One pass whatever the number of columns; no task holds the values of one. Missing cells count in rows alone.
    """
    values = df.select(part.alias("part"), *[as_number(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    kept = [F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")) for i in range(len(columns))]
    found = values.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(
            F.count(x).alias("present"), F.min(x).alias("least"), F.max(x).alias("most"), F.sum(x).alias("total"),
            F.kll_sketch_agg_double(x, accuracy).alias("sketch"),
        ).alias(f"c{i}")
        for i, x in enumerate(kept)
    ])
    rows = [F.struct(F.lit(name).alias("column"), "rows", *[f"c{i}.{x}" for x in KEPT_FACTS]) for i, name in enumerate(columns)]
    return found.select("part", F.inline(F.array(*rows)))


def sketched_profile(sketches: DataFrame, points: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, rows, present, mean, min, max, quantiles): of the union of the parts, out of their sketches.

    ``quantiles`` are values that occur, null for a column without values.
    """
    merged = sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.sum("total").alias("total"),
        F.min("least").alias("min"), F.max("most").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    wanted = F.array(*[F.lit(float(p)) for p in points])
    quantiles = F.when(F.col("present") > 0, F.kll_sketch_get_quantile_double("sketch", wanted))
    return merged.select(
        "column", "rows", "present", F.try_divide("total", "present").alias("mean"), "min", "max", quantiles.alias("quantiles")
    )

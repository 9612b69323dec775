"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.roles import quoted
from ..operators.joins import attach
from ..session import new_folder, ship  # noqa: F401

#: A word of a text: everything between white space of one byte.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a narrow table up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 50_000


def give_back() -> None:
    """In a Python worker, which lives on after a task: return to the system what Arrow holds for its next batches."""
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What is used more than once is computed once, its rows keep their partition,
    and a lost executor costs a read instead of a recomputation.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def key60(text: Column) -> Column:
    """A number of 60 bits from a text, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def joined(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``small``, one narrow row per ``key``.

    Broadcast up to ``BROADCAST_ROWS`` rows, which are counted; beyond that a
    join that leaves the rows of hot keys where they are.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    return attach(rows, small, key, how)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in the given order, sorted across the cluster."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row per part
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    starts = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop(
        "_part", "_at", "_before"
    )


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but those that an operator is about to write; names compare as Spark compares them."""
    taken = {n.lower() for n in names}
    return [quoted(c) for c in df.columns if c.lower() not in taken]

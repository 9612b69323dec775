"""Shards from a lookup table that they fill by turns.

Each shard has its own order of the slots of a table whose size is a prime: a
start and a step, drawn from its name. The shards take turns, each claiming the
next free slot in its order, so all get nearly the same number, and when a shard
comes or goes few slots change hands. The table is small, has a size of its own
whatever the data, and is broadcast; a row finds its shard by one hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.roles import quoted
from .common import key60

#: A prime some hundred times the number of shards keeps their shares within a percent.
SLOTS = 65_537
MOST_SLOTS = 1 << 21


def _draw(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the place of its shard in ``shards``."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("Name each shard once, and at least one.")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"The number of slots is a prime from the number of shards to {MOST_SLOTS}.")
    at = [_draw(s, "start") % slots for s in shards]
    step = [_draw(s, "step") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The table as a frame (slot, shard), one row per slot."""
    filled = fill(shards, slots)
    names = F.array(*[F.lit(s) for s in shards])
    # As one string of numbers: a frame from a list would start Python workers.
    numbers = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    packed = spark.range(1).select(F.split(F.lit(",".join(map(str, filled))), ",").alias("owners")).select("owners", numbers.alias("slot"))
    owner = F.element_at("owners", F.col("slot") + 1).cast("int")
    return packed.select("slot", F.element_at(names, owner + 1).alias("shard"))


def slot_of(ident: Column, text: Column, slots: int = SLOTS) -> Column:
    """By the id, or where that is null by the text, so that the rows without id don't meet in one shard."""
    return F.pmod(key60(F.coalesce(ident.cast("string"), F.concat(F.lit("t"), F.coalesce(text, F.lit(""))))), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: Sequence[str], id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``docs`` with slot and shard.

    A row's shard depends on its id and the shards' names only: rows of one id stay
    together. Columns of ``docs`` with the names that are added give way.
    """
    kept = [quoted(c) for c in docs.columns if c.lower() not in ("slot", "shard")]
    slotted = docs.select(*kept, slot_of(quoted(id_col), quoted(text_col).cast("string"), slots).alias("slot"))
    table = lookup(docs.sparkSession, shards, slots)
    return slotted.join(F.broadcast(table), "slot").select(*[quoted(c) for c in slotted.columns], "shard")  # MOST_SLOTS rows at most


def write(placed: DataFrame, folder: str) -> None:
    """One folder per shard below ``folder``; each task writes to the shards that it has rows of, so none is gathered anywhere."""
    placed.drop("slot").write.partitionBy("shard").parquet(folder)

"""Logged conversations: snapshots that a longer one continues are left out, the rest is rendered.

A conversation that is logged after every turn leaves a trail of snapshots, each
the beginning of the next. A rolling hash over the turns has a value for each
beginning; a conversation whose last value is one of the inner values of another
is a snapshot of it. Turns are hashed where they lie, and only hashes are placed and
compared; the texts of the conversations that stay move once, those of very long ones twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.roles import quoted
from .common import BROADCAST_ROWS, joined, stored

#: Turns in a rendered part; longer conversations come in several.
PART = 512
#: Turns up to which one task puts a conversation in order; longer ones are sorted across the cluster.
LONG = 1_000_000
START, END = "<|im_start|>", "<|im_end|>"
#: The order of turns, in columns of ``_turns``: by number, role and hash, missing ones last.
ORDER = ["_unnumbered", "_turn", "_unnamed", "_role", "_p", "_q"]


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(_conv, the columns of ORDER, _text): _p and _q make a hash of 128 bits of role and text."""
    names = {conv_col: "_conv", turn_col: "_turn", role_col: "_role", text_col: "_text"}
    rows = conversations.select(*[quoted(c).alias(n) for c, n in names.items()])
    rows = rows.filter(F.col("_conv").isNotNull()).withColumns({"_role": F.col("_role").cast("string"), "_text": F.col("_text").cast("string")})
    # A missing role or text differs from an empty one.
    told = [x for c in ("_role", "_text") for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return rows.withColumns({
        "_unnumbered": F.col("_turn").isNull(), "_unnamed": F.col("_role").isNull(),
        "_p": F.xxhash64(F.lit("a"), *told), "_q": F.xxhash64(F.lit("b"), *told),
    })


def _long(turns: DataFrame) -> DataFrame | None:
    """(_conv, _n) of conversations of more than LONG turns: one for LONG rows at most; None if there are none."""
    counts = turns.groupBy("_conv").agg(F.count(F.lit(1)).alias("_n"))
    long = stored(counts.filter(F.col("_n") > LONG), "chat-long")
    return None if long.isEmpty() else long


def _in_order(turns: DataFrame) -> DataFrame:
    """``turns`` of conversations that fit into a task, with _at: their place, from 1."""
    return turns.withColumn("_at", F.row_number().over(Window.partitionBy("_conv").orderBy(*ORDER)).cast("long"))


def _in_ranges(turns: DataFrame) -> DataFrame:
    """``turns`` of long conversations with _slice and _at, sorted across the cluster.

    A conversation lies in several slices; equal turns are told apart by a number drawn at random, so they do too.
    """
    order = ["_conv", *ORDER, "_salt"]
    ranged = turns.withColumn("_salt", F.rand(0)).repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    placed = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "chat-ranges")
    placed = placed.withColumns({"_slice": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    slices = placed.groupBy("_conv", "_slice").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy("_conv").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_conv", "_slice", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return _with_slices(placed, slices).withColumn("_at", F.col("_place") + F.col("_shift")).drop("_place", "_shift")


def _with_slices(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """The join with a narrow row per conversation and slice, of which there are as many as tasks and long conversations."""
    slices = stored(slices, "chat-slices")
    few = slices.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(slices) if few else slices, ["_conv", "_slice"])


def _rolling(placed: DataFrame, *group: str) -> DataFrame:
    """``placed`` with _a and _b: the exclusive-or of the turns' own hashes up to each, within a group."""
    upto = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    # Two hashes of 64 bits, so that no two beginnings are taken for one by chance.
    return placed.withColumns({"_a": F.bit_xor(F.xxhash64("_p", "_at")).over(upto), "_b": F.bit_xor(F.xxhash64("_q", "_at")).over(upto)})


def prefixes(turns: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """(_conv, _at, _n, _a, _b): the hash of each conversation of _n turns up to each of its turns.

    Conversations of ``long`` are hashed slice by slice, each slice starting from what those before it add up to.
    """
    slim = turns.select("_conv", *ORDER)
    columns = ["_conv", "_at", "_n", "_a", "_b"]
    short = slim if long is None else slim.join(F.broadcast(long.select("_conv")), "_conv", "left_anti")
    whole = F.count(F.lit(1)).over(Window.partitionBy("_conv"))
    found = _rolling(_in_order(short), "_conv").withColumn("_n", whole).select(*columns)
    if long is None:
        return found
    placed = _in_ranges(slim.join(F.broadcast(long.select("_conv")), "_conv", "left_semi"))
    sliced = stored(_rolling(placed, "_conv", "_slice").select("_conv", "_slice", "_at", "_a", "_b"), "chat-sliced")
    ends = sliced.groupBy("_conv", "_slice").agg(F.max(F.struct("_at", "_a", "_b")).alias("e"))
    earlier = Window.partitionBy("_conv").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_conv", "_slice", *[F.coalesce(F.bit_xor(f"e.{c}").over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_a", "_b")])
    whole = _with_slices(sliced, before).join(F.broadcast(long), "_conv")
    whole = whole.withColumns({c: F.col(c).bitwiseXOR(F.col(f"{c}0")) for c in ("_a", "_b")})
    return found.unionByName(whole.select(*columns))


def maximal(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conversation, turns) of those that no other one continues; of equal ones the least id.

    Turns go by number, those without one last, equal numbers by role and a hash of the text. Rows
    without a conversation id belong to none and are left out.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    return _maximal(turns, _long(turns)).select(F.col("_conv").alias(conv_col), F.col("_n").alias("turns"))


def _maximal(turns: DataFrame, long: DataFrame | None) -> DataFrame:
    hashed = stored(prefixes(turns, long), "chat-prefixes")
    # One row per content, and per beginning: a conversation or first turn that very many share is one row.
    whole = hashed.filter("_at = _n").groupBy("_n", "_a", "_b").agg(F.min("_conv").alias("_conv"))
    inner = hashed.filter("_at < _n").select(F.col("_at").alias("_n"), "_a", "_b").distinct()
    return stored(whole.join(inner, ["_n", "_a", "_b"], "left_anti").select("_conv", "_n"), "chat-maximal")


def render(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conversation, part, turns, text): the maximal conversations as one text for each ``PART`` turns.

    A turn is ``START`` role, a new line, the text, ``END`` and a new line; a missing role is
    ``unknown`` and a missing text empty. ``turns`` counts those of the part. No rows in, no rows out.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    long = _long(turns)
    staying = _maximal(turns, long)
    rows = turns.select("_conv", *ORDER, "_text")
    placed = _in_order(joined(rows, staying.filter(F.col("_n") <= LONG).select("_conv"), "_conv"))
    if long is not None:
        sliced = _in_ranges(joined(rows, staying.filter(F.col("_n") > LONG).select("_conv"), "_conv"))
        placed = placed.unionByName(sliced.drop("_slice"))
    told = F.concat(F.lit(START), F.coalesce("_role", F.lit("unknown")), F.lit("\n"), F.coalesce("_text", F.lit("")), F.lit(END), F.lit("\n"))
    part = F.floor((F.col("_at") - 1) / PART).cast("int").alias("part")
    # At most PART turns meet in a group.
    grouped = placed.groupBy("_conv", part).agg(F.sort_array(F.collect_list(F.struct("_at", told.alias("t")))).alias("told"))
    return grouped.select(F.col("_conv").alias(conv_col), "part", F.size("told").cast("long").alias("turns"), F.array_join("told.t", "").alias("text"))

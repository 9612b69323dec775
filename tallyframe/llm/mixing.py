"""Mixing sources to target weights by thresholds on a hash.

The words of each source are summed by bucket of a hash of the document. The
sums tell in which bucket the budget of a source ends; only that bucket is cut
finer, until it holds one hash value. Nothing is sorted, and the texts are read
twice: once to count and once to hand out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.roles import quoted
from .common import WORD, joined, key60, numbered, others, stored

#: The hash has 60 bits and is looked at in steps of so many.
STEP, BITS = 12, 60
ADDED = ("size", "source_size", "target", "full", "cut", "_mix_key", "_mix_source")


def words(text: Column) -> Column:
    """The number of words; 0 for a missing text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with the number of words, the hash and the source as a key that is never null."""
    ident = F.coalesce(quoted(id_col).cast("string"), F.concat(F.lit("t"), F.coalesce(quoted(text_col), F.lit(""))))
    source = F.concat(F.lit("="), quoted(source_col).cast("string"))
    return docs.select(
        *others(docs, *ADDED),
        words(quoted(text_col)).alias("size"),
        key60(ident).alias("_mix_key"),
        F.coalesce(source, F.lit("")).alias("_mix_source"),
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sizes`` (_mix_source, source_size) with each source's target.

    Sources by code point, null last, take the weights in turn. A target above
    ``most`` times the size stops there and its excess is shared among the
    others by weight, until none is above; each round is one small aggregate.
    """
    ordered = sizes.withColumn("_last", F.col("_mix_source") == "")
    ranked = numbered(ordered, ["_last", "_mix_source"], "_rank").drop("_last")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("_mix_source", "source_size", turn.alias("_w")), "mix-sources")
    cap = F.lit(float(most)) * F.col("source_size")
    whole = ranked.agg(F.sum("source_size").alias("s"), F.sum("_w").alias("w")).first()
    budget, weight, stopped = share * (whole["s"] or 0), whole["w"] or 0.0, 0
    rate = budget / weight if weight else 0.0
    while True:
        above = cap < F.lit(rate) * F.col("_w")
        found = ranked.agg(F.sum(F.when(above, F.col("source_size"))).alias("s"), F.sum(F.when(~above, F.col("_w"))).alias("w"))
        at_cap, left = found.first()
        if left is None:
            break  # every source is at its cap
        step = (budget - most * (at_cap or 0)) / left
        if (at_cap or 0, left) == (stopped, weight):
            break
        stopped, weight, rate = at_cap or 0, left, step
    return ranked.select("_mix_source", "source_size", F.least(cap, F.lit(rate) * F.col("_w")).alias("target"))


def cuts(slim: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """For each source its size, its target, how often all of it is taken, and below which hash once more.

    ``slim``: _mix_source, size, _mix_key of every document. The rows below the
    cut are the first in the order of the hash whose words stay within the rest
    of the target; the next hash value is in if that comes nearer.
    """

    def histogram(rows: DataFrame, shift: int, label: str) -> DataFrame:
        bucket = F.shiftright("_mix_key", shift).alias("_bucket")
        sums = [F.sum("size").alias("_n"), F.min("_mix_key").alias("_low"), F.max("_mix_key").alias("_high")]
        return stored(rows.groupBy("_mix_source", bucket).agg(*sums), label)

    shift = BITS - STEP
    counts = histogram(slim, shift, "mix-histogram")
    goal = targets(counts.groupBy("_mix_source").agg(F.sum("_n").alias("source_size")), weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("full", full)
    goal = stored(goal.withColumn("_rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-targets")
    open_ = goal.filter("_rest > 0").select("_mix_source", "_rest", F.lit(0).cast("long").alias("_before"))
    done = []
    upto = Window.partitionBy("_mix_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        sums = counts.withColumn("_sum", F.sum("_n").over(upto))  # at most 2 ** STEP rows a source
        ends = joined(sums, open_, "_mix_source").filter(F.col("_before") + F.col("_sum") > F.col("_rest"))
        first = ends.groupBy("_mix_source").agg(
            F.min_by(F.struct("_bucket", "_n", "_low", "_high", "_rest", (F.col("_before") + F.col("_sum") - F.col("_n")).alias("_before")), "_bucket").alias("b")
        )
        first = stored(first.select("_mix_source", "b.*"), "mix-boundary")
        one = F.col("_low") == F.col("_high")
        nearer = F.col("_before") + F.col("_n") - F.col("_rest") < F.col("_rest") - F.col("_before")
        done.append(first.filter(one).select("_mix_source", F.when(nearer, F.col("_low") + 1).otherwise(F.col("_low")).alias("cut")))
        open_ = first.filter(~one).select("_mix_source", "_rest", "_before", F.col("_bucket").alias("_in"))
        if open_.isEmpty():
            break
        inside = joined(slim, open_.select("_mix_source", "_in"), "_mix_source").filter(F.shiftright("_mix_key", shift) == F.col("_in"))
        shift -= STEP
        counts = histogram(inside.drop("_in"), shift, "mix-histogram")
        open_ = open_.drop("_in")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    cut = F.coalesce(F.col("cut"), F.lit(0).cast("long")).alias("cut")
    return stored(goal.join(found, "_mix_source", "left").select("_mix_source", "source_size", "target", "full", cut), "mix-cuts")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """``docs`` with size, source_size, target, times: how often the mix takes the document.

    The sources share ``share`` times all words by their weights, none beyond
    ``most`` times its own. A missing text has no words. Documents go by a hash
    of their id (of the text where the id is null), so reruns agree; rows of
    the same id are taken or left together. Columns of ``docs`` with the names
    that are added give way. No rows in, no rows out.
    """
    rows = measured(docs, id_col, text_col, source_col)
    slim = stored(rows.select("_mix_source", "size", "_mix_key"), "mix-sizes")
    placed = joined(rows.drop("times"), cuts(slim, weights, share, most), "_mix_source")
    times = F.col("full") + (F.col("_mix_key") < F.col("cut")).cast("long")
    return placed.withColumn("times", times).drop("full", "cut", "_mix_key", "_mix_source")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix`` as often as the mix takes it."""
    return mixed.filter("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_copy")

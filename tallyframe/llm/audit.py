"""How filters act together: what each removes after any others, from sorted posting lists.

For each part of the corpus and each filter there is a list of the rows that fail it, by
ascending number. The lists are cut by ranges of numbers. Within a range the union of
any filters' lists and the difference of a list to such a union come from merges that
gallop over the lists; their sizes add up over the ranges to what every order of the filters needs.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.roles import quoted
from .common import give_back, joined, ship, stored

#: Rows of one part in a block of lists, at most, and of a task on average.
BLOCK = 1 << 15
#: Bytes of a text whose words are looked at together.
AT_ONCE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: The filters of ``failures``, in the order of their bits, and the one of texts that were there before.
OWN_FILTERS, SEEN_BEFORE = "ABCD", "E"


# --- filters of a text -----------------------------------------------------------------------

def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while at < len(data):
        gap = SPACE.search(data, at + AT_ONCE) if len(data) - at > AT_ONCE else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def failures(text: str | None) -> int:
    """Bits of the filters that a text fails. A: fewer than 200 words; B: fewer than half of them distinct; C: more than
    2 percent capitals; D: one of ``SYMBOLS``. A missing text is empty: it fails A alone."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n, seen = 0, set()
    for some in words(data):
        n += len(some)
        seen.update(some)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    symbols = len(data) != len(data.translate(None, SYMBOLS))
    return (n < 200) | (100 * len(seen) < 50 * n) << 1 | (100 * capitals > 2 * len(text or "")) << 2 | symbols << 3


def failed(texts: Column) -> Column:
    @F.arrow_udf("int")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = pa.array([failures(t.as_py()) for t in batch], pa.int32())
            del batch
            give_back()
            yield found

    return of(texts)


# --- posting lists ---------------------------------------------------------------------------

def gallop(ids: Sequence[int], at: int, key: int) -> int:
    """The first place from ``at`` on whose id is no less than ``key``: in doubling steps, then between the last two."""
    step, n = 1, len(ids)
    while at + step <= n and ids[at + step - 1] < key:
        at += step
        step *= 2
    return bisect_left(ids, key, at, min(at + step, n))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """All ids of sorted lists, once each: the list with the least head gives what comes before the other heads."""
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapq.heapify(heads)
    merged: list[int] = []
    while heads:
        head, k, at = heapq.heappop(heads)
        ids = lists[k]
        if not heads:
            merged.extend(ids[at:])
        else:
            end = gallop(ids, at, heads[0][0])
            merged.extend(ids[at:end])
            end += head == heads[0][0]  # another list gives this one
            if end < len(ids):
                heapq.heappush(heads, (ids[end], k, end))
    return merged


def difference(ids: Sequence[int], without: Sequence[int]) -> list[int]:
    """The ``ids`` that aren't in ``without``; both sorted."""
    left: list[int] = []
    at, i = 0, 0
    while i < len(ids):
        at = gallop(without, at, ids[i])
        if at == len(without):
            left.extend(ids[i:])
            break
        if without[at] == ids[i]:
            i += 1
            continue
        end = gallop(ids, i, without[at])
        left.extend(ids[i:end])
        i = end
    return left


def counted(ids: np.ndarray, bits: np.ndarray, filters: int, losses: int) -> list[tuple[int, ...]]:
    """(filter, before, count, count of each loss) of a block: what each filter removes after those in ``before``.

    With filter -1, what all of ``before`` remove. ``ids`` ascend; the loss bits follow the filter bits.
    """
    lists = [ids[(bits >> f) & 1 == 1].tolist() for f in range(filters)]
    kinds = [[lists[f], *(ids[(bits >> f) & (bits >> (filters + k)) & 1 == 1].tolist() for k in range(losses))] for f in range(filters)]
    rows = []
    for before in range(1 << filters):
        inside = [f for f in range(filters) if before >> f & 1]
        rows.append((-1, before, *[len(union([kinds[f][k] for f in inside])) for k in range(1 + losses)]))
    for f in range(filters):
        # What is left after some filters, and after one more, is a difference to that one's list.
        left = {0: kinds[f]}
        for before in range(1 << filters):
            if before >> f & 1 or not lists[f]:
                continue
            if before:
                last = before.bit_length() - 1
                left[before] = [difference(ids, lists[last]) for ids in left[before ^ 1 << last]]
            rows.append((f, before, *map(len, left[before])))
    return rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Rows (part, id, bits), sorted by part and id, in blocks of one part."""
    part, ids, bits, held = None, [], [], 0
    for batch in batches:
        parts, numbers, flags = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        coded = parts.dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        at = 0
        while at < len(codes):
            name = names[codes[at]]
            if ids and (name != part or held >= BLOCK):
                yield part, np.concatenate(ids), np.concatenate(bits)
                ids, bits, held = [], [], 0
            other = np.flatnonzero(codes[at : at + BLOCK - held] != codes[at])
            end = at + int(other[0]) if len(other) else min(at + BLOCK - held, len(codes))
            part = name
            ids.append(numbers[at:end].copy())
            bits.append(flags[at:end].copy())
            held += end - at
            at = end
    if ids:
        yield part, np.concatenate(ids), np.concatenate(bits)


def posted(failing: DataFrame, filters: int, losses: int) -> DataFrame:
    """(part, filter, before, count, loss_0, ...): ``counted`` over all of ``failing`` (part, id, bits), ids being unique.

    Rows are dealt by ranges of part and id, so a part that holds most rows is spread over tasks.
    """
    lost = ", ".join(f"loss_{k} long" for k in range(losses))
    schema = "part string, filter int, before int, count long" + (f", {lost}" if losses else "")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * (1 + losses)]
        for part, ids, bits in _blocks(batches):
            rows = [(part, *row) for row in counted(ids, bits, filters, losses)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # Merging takes far more time than its few bytes tell, so the ranges follow from the rows.
    ranges = failing.count() // BLOCK + 1
    ranged = failing.select("part", "id", "bits").repartitionByRange(ranges, "part", "id").sortWithinPartitions("part", "id")
    sums = [F.sum(c).alias(c) for c in ("count", *[f"loss_{k}" for k in range(losses)])]
    return ranged.mapInArrow(merge, schema).groupBy("part", "filter", "before").agg(*sums)


# --- orders ----------------------------------------------------------------------------------

def interactions(flags: DataFrame, part_col: str, filters: Sequence[str], losses: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``flags`` has a boolean column for each filter (its name is a letter), true where a row
    fails it, and one for each loss, true for rows that shouldn't go. The result has part, filter_order, step,
    kept, removed, redundant, unique_fails, a count of removed rows for each loss, and shapley: what
    the step's filter removes summed over all orders. A missing flag is false, a missing part the empty one. Rows count
    as often as they are there. No rows in, no rows out.
    """
    ship(flags.sparkSession)
    n = len(filters)
    set_bits = [F.when(quoted(c), 1 << k).otherwise(0) for k, c in enumerate([*filters, *losses])]
    rows = flags.select(F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), sum(set_bits, F.lit(0)).cast("int").alias("bits"))
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()), "audit-rows")
    sums = posted(rows.filter(F.col("bits").bitwiseAND((1 << n) - 1) != 0), n, len(losses))
    counts = ["count", *[f"loss_{k}" for k in range(len(losses))]]
    # What a filter removes after each set of others, times the orders in which just these come before it.
    weights = F.array(*[F.lit(factorial(size) * factorial(n - 1 - size)) for size in range(n)])
    weighed = F.col("count") * F.element_at(weights, F.least(F.bit_count("before") + 1, F.lit(n)))
    # A part has at most (n + 1) * 2 ** n sums.
    key = (F.col("filter") * (1 << n) + F.col("before")).alias("k")
    cells = sums.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.struct(*counts).alias("v")))).alias("cells"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("filter") == f, weighed)), F.lit(0)) for f in range(n)]).alias("values"),
    )
    whole = rows.groupBy("part").agg(F.count("*").alias("rows")).join(cells, "part", "left")
    orders = F.split(F.lit(" ".join("".join(order) for order in permutations(filters))), " ")
    places = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.instr(F.lit("".join(filters)), F.substring("filter_order", i, F.lit(1))) - 1)
    each = whole.withColumn("filter_order", F.explode(orders)).withColumn("_places", places)
    each = each.select("*", F.posexplode("_places").alias("_i", "f"))
    own = F.call_function("shiftleft", F.lit(1), F.col("f"))
    earlier = F.slice("_places", F.lit(1), F.col("_i"))
    each = each.withColumn("before", F.aggregate(earlier, F.lit(0), lambda s, f: s + F.call_function("shiftleft", F.lit(1), f)))

    def cell(f: Column, before: Column, name: str = "count") -> Column:
        return F.coalesce(F.col("cells")[(f * (1 << n) + before).cast("int")][name], F.lit(0).cast("long"))

    removed = cell(F.col("f"), F.col("before"))
    return each.select(
        "part", "filter_order", (F.col("_i") + 1).alias("step"),
        (F.col("rows") - cell(F.lit(-1), F.col("before").bitwiseOR(own))).alias("kept"),
        removed.alias("removed"),
        (cell(F.col("f"), F.lit(0)) - removed).alias("redundant"),
        cell(F.col("f"), F.lit((1 << n) - 1) - own).alias("unique_fails"),
        *[cell(F.col("f"), F.col("before"), f"loss_{k}").alias(f"{name}_lost") for k, name in enumerate(losses)],
        F.coalesce(F.element_at("values", F.col("f") + 1), F.lit(0).cast("long")).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """``interactions`` of the filters A to E in ``docs``: those of ``failures``, and E, a text that a smaller id has anywhere.

    ``good`` rows have an id with a label of quality 1, ``toxic`` ones with one of toxic 1. Rows without an id have
    no label and fail E never; a missing text equals an empty one. Rows that repeat share their id, so E lets
    all of them through or none; each counts.
    """
    ship(docs.sparkSession)
    text = quoted(text_col).cast("string")
    rows = docs.select(
        quoted(id_col).alias("_id"), quoted(part_col).alias("_part"), failed(text).alias("_bits"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("_digest"),
    )
    rows = stored(rows, "audit-texts")
    first = rows.groupBy("_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    # Only texts that several ids have; a text that very many rows have is one row here.
    first = stored(first.filter("_first < _last").select("_digest", "_first"), "audit-copies")
    marked = joined(rows, first, "_digest", "left")
    good, toxic = (F.coalesce(F.max(quoted(c) == 1), F.lit(False)).alias(n) for c, n in ((quality_col, "good"), (toxic_col, "toxic")))
    told = labels.filter(quoted(id_col).isNotNull()).groupBy(quoted(id_col).alias("_id")).agg(good, toxic)
    told = stored(told.filter("good or toxic"), "audit-labels")
    marked = marked.withColumn(SEEN_BEFORE, F.col("_id") > F.col("_first"))
    marked = marked.withColumns({f: F.col("_bits").bitwiseAND(1 << k) != 0 for k, f in enumerate(OWN_FILTERS)})
    flags = marked.select("_id", "_part", *OWN_FILTERS, SEEN_BEFORE)
    return interactions(joined(flags, told, "_id", "left"), "_part", [*OWN_FILTERS, SEEN_BEFORE], ["good", "toxic"])

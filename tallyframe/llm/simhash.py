"""Near copies by SimHash: exact comparison of all fingerprints, tile by tile.

Equal fingerprints are one class. Classes are dealt into cells by the population
counts of the quarters of the fingerprint, or of smaller parts where there are very
many: one bit that differs changes these counts by one in all, so fingerprints
within the radius lie in cells whose counts differ by no more than the radius. Only
such cells meet; a cell of many classes is cut into tiles of bounded size. A task
compares its own tile with each visiting tile by exclusive-or and bit counts, and
reports a forest of what it linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.roles import quoted
from .common import give_back, ship, stored

BITS, SEED = 64, 42
#: Parts whose population counts make a cell, by the number of classes that they are meant for: more parts leave
#: fewer pairs to compare (a twentieth, a five-hundredth, a hundred-thousandth of all) but more cells to visit.
#: The links are the same.
PARTS = ((4, 50_000_000), (8, 2_000_000_000), (16, None))
#: Cells up to which their table is broadcast; four parts have at most 17 ** 4.
FEW_CELLS = 100_000
#: Classes in a tile, on average at most; what a task holds.
TILE = 4096
#: Comparisons in one numpy call, and shingles counted at once.
BLOCK, COUNTED = 1 << 18, 1 << 14


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The SimHash of a text as a signed number; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, COUNTED):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + COUNTED], ends[i : i + COUNTED])]
        octets = np.array(some, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(texts: F.Column, words_in_shingle: int = 3):
    @F.pandas_udf("long")
    def of(column: pd.Series) -> pd.Series:
        found = pd.Series([fingerprint(t, words_in_shingle) for t in column], dtype="int64")
        give_back()
        return found

    return of(texts)


# --- links -----------------------------------------------------------------------------------

def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining what each u and v are in; a label is the least index in its group."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, further := label[label]):
            label = further


def forest(own: np.ndarray, others: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): links among ``own`` and ``others`` across the two, or within ``own``, without the rest of the pairs."""
    there = own if others is None else others
    a, b = own.view(np.uint64), there.view(np.uint64)  # of signed numbers, numpy counts the bits of the absolute value
    shift = 0 if others is None else len(own)
    every = own if others is None else np.concatenate((own, others))
    label = np.arange(len(every))
    rows = max(1, BLOCK // max(1, len(there)))
    for i in range(0, len(own), rows):
        near = np.bitwise_count(a[i : i + rows, None] ^ b[None, :]) <= radius
        u, v = np.nonzero(near)
        if len(u):
            label = unite(label, u + i, v + shift)
    node = np.nonzero(label != np.arange(len(every)))[0]
    return every[node], every[label[node]]


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, tile, visits, prints), sorted: for each tile its own prints first, then its visitors'."""
    here, own = None, None
    for batch in batches:
        cells, tiles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        visits = batch.column(2).to_numpy(zero_copy_only=False)
        lists = batch.column(3)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        changes = np.nonzero((np.diff(cells) != 0) | (np.diff(tiles) != 0))[0] + 1
        bounds = [0, *changes.tolist(), len(cells)]
        found = []
        for i, j in zip(bounds, bounds[1:]):
            if i == j:
                continue
            if (cells[i], tiles[i]) != here:
                here, own = (cells[i], tiles[i]), None
            if not visits[i]:
                own = values[offsets[i] : offsets[i + 1]].copy()
                found.append(forest(own, None, radius))
                i += 1
            if own is None:
                continue  # by chance no class of the cell fell into this tile
            coming = values[offsets[i] : offsets[j]].copy()
            for k in range(0, len(coming), 16 * TILE):
                found.append(forest(own, coming[k : k + 16 * TILE], radius))
        if found:
            node, root = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def parts_for(classes: int) -> int:
    return next(parts for parts, most in PARTS if most is None or classes <= most)


def links(classes: DataFrame, radius: int, parts: int | None = None) -> DataFrame:
    """(node, root) of the fingerprints in ``classes`` (column fp, distinct): enough links to connect all that are near.

    A cell is a number with a digit for each part, the part's population count;
    the base leaves room for steps beyond the ends, where no cells are.
    """
    ship(classes.sparkSession)
    parts = parts or parts_for(classes.count())
    width = BITS // parts
    base = width + 1 + 2 * radius
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1)) + radius for i in range(parts)]
    cell = sum((c * base**i for i, c in enumerate(counts)), F.lit(0).cast("long"))
    celled = classes.select("fp", cell.alias("cell"))
    cells = celled.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    cells = stored(cells, "simhash-cells")
    cells = F.broadcast(cells) if (width + 1) ** parts <= FEW_CELLS else cells
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile")
    tiles = celled.join(cells, "cell").select("cell", tile, "fp")
    tiles = stored(tiles.groupBy("cell", "tile").agg(F.collect_list("fp").alias("prints")), "simhash-tiles")
    # Each pair of cells meets once: steps whose number is above 0.
    steps = sorted(n for n in _steps(parts, radius, base) if n > 0)
    travelling = tiles.select(F.col("cell").alias("_from"), F.col("tile").alias("_tile"), F.explode(F.array(*map(F.lit, steps))).alias("_step"))
    travelling = travelling.select("_from", "_tile", (F.col("_from") + F.col("_step")).alias("cell"))
    visits = travelling.join(cells, "cell").select("_from", "_tile", "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    # Tiles of the same cell: the earlier visits the later.
    same = tiles.join(cells, "cell").filter(F.col("tile") + 1 < F.col("tiles")).select(
        F.col("cell").alias("_from"), F.col("tile").alias("_tile"), "cell",
        F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"),
    )
    roads = visits.unionByName(same).groupBy("_from", "_tile").agg(F.collect_list(F.struct("cell", "tile")).alias("to"))
    own = tiles.select("cell", "tile", F.lit(False).alias("visits"), "prints")
    coming = (
        tiles.join(roads, (F.col("cell") == F.col("_from")) & (F.col("tile") == F.col("_tile")))
        .select("prints", F.explode("to").alias("to"))
        .select("to.cell", "to.tile", F.lit(True).alias("visits"), "prints")
    )
    dealt = own.unionByName(coming).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "visits")
    return dealt.mapInArrow(lambda batches: compare(batches, radius), "node long, root long").distinct()


def _steps(parts: int, radius: int, base: int) -> set[int]:
    """The differences between the numbers of cells whose counts differ by at most ``radius`` in all."""
    reached = {(0, 0)}  # number, and how far it is
    for i in range(parts):
        reached |= {(n + d * base**i, far + abs(d)) for n, far in reached for d in range(-radius, radius + 1) if far + abs(d) <= radius}
    return {n for n, _ in reached}


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges``, root being the least node that it is connected to.

    Alternating large and small stars: each pass is two aggregations and joins,
    and its result is written to the shared folder. It ends when a pass changes nothing.
    """
    now = stored(edges.filter("node != root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct(), "stars")
    state = None
    while True:
        here = now.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()
        if here == state:
            return now
        state = here
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(now.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "stars-least")
        # Rows with v > u are those of ``now`` turned round; both sides come straight from tables, so hot roots are split.
        large = now.select(F.col("root").alias("u"), "node").join(least, "u").select("node", F.col("m").alias("root"))
        large = stored(large.filter("node != root").distinct(), "stars-large")
        lowest = stored(large.groupBy("node").agg(F.min("root").alias("m")), "stars-lowest")
        small = large.join(lowest, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).filter("node != root")
        now = stored(small.unionByName(lowest.select("node", F.col("m").alias("root"))).distinct(), "stars")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): one row per row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; component_id is the
    smallest id that can be reached, null where all of those are null. A missing
    text, or one without a word, has fingerprint zero, and is linked like any other.
    """
    ship(docs.sparkSession)
    name = docs.select(quoted(id_col)).columns[0]
    rows = stored(docs.select(quoted(id_col).alias("id"), fingerprints(quoted(text_col).cast("string"), words_in_shingle).alias("fp")), "simhash")
    return _joined(rows, radius).select(F.col("id").alias(name), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (id, fp, ...), a table, with component_id and root, which tells components of one id apart."""
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    stars = components(links(classes, radius)).select(F.col("node").alias("fp"), "root")
    rooted = stored(classes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    ends = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-ends")
    named = stored(rooted.join(ends, "root").select("fp", "root", "component_id"), "simhash-components")
    return rows.join(named, "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one with the smallest id.

    Rows are told apart by id and a hash of the text, so of rows that repeat one
    stays, and of one id with several texts the smaller hash. Groups of which no row
    has an id stay whole.
    """
    ship(docs.sparkSession)
    text = quoted(text_col).cast("string")
    ident = F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
    rows = stored(docs.select(quoted(id_col).alias("id"), ident.alias("th"), fingerprints(text, words_in_shingle).alias("fp")), "simhash")
    placed = _joined(rows, radius)
    first = placed.filter(F.col("id") == F.col("component_id")).groupBy("root", "id", "th").agg(F.count("*").alias("n"))
    chosen = first.groupBy("root").agg(F.min(F.struct("id", "th", "n")).alias("c"))
    chosen = stored(chosen.select(F.col("c.id").alias("_id"), F.col("c.th").alias("_th"), F.col("c.n").alias("_n")), "simhash-chosen")
    found = docs.join(chosen.hint("shuffle_hash"), (quoted(id_col) == F.col("_id")) & (ident == F.col("_th")))
    kept = found
    if not chosen.filter("_n > 1").isEmpty():
        kept = found.filter("_n = 1").unionByName(found.filter("_n > 1").dropDuplicates(["_id", "_th"]))
    kept = kept.select(*[quoted(c) for c in docs.columns])
    nameless = placed.filter(F.col("component_id").isNull())
    if nameless.isEmpty():
        return kept
    without = stored(nameless.select(F.col("th").alias("_th")).distinct(), "simhash-nameless")
    return kept.unionByName(docs.filter(quoted(id_col).isNull()).join(without, ident == F.col("_th"), "left_semi"))

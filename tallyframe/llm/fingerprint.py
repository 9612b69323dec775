"""Document fingerprints by content-defined chunking.

A rolling gear hash of the last 32 bytes ends a chunk where its highest bits are
zero: eight bits up to the normal length, four beyond it, so that lengths stay
close to normal. Text that is inserted or cut moves the ends near it and no
others. The fingerprint of a text is the set of its chunks' digests with their
lengths; what part of it is found in another measures containment.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.roles import quoted
from .common import ship, stored

#: Bytes in a chunk: at least, normally, at most. The hash looks back 32 bytes, so no chunk is shorter, but for the last.
LEAST, NORMAL, MOST = 32, 64, 256
STRICT, LOOSE = 1 << 24, 1 << 28
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
#: Bytes that are hashed together.
AT_ONCE = 1 << 20
#: Text in a stretch of neighbouring documents, and keys looked at for each stretch to find where it begins.
STRETCH, LOOKED_AT = 16 << 20, 50
#: Beyond so many stretches they get longer, so the driver looks at no more than a million keys, whatever the input.
MOST_STRETCHES = 20_000
#: What a row counts beside its text.
ROW = 64

Print = dict[str, int]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, of that byte and the 31 before it."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        further = h.copy()
        further[s:] += h[:-s] << np.uint32(s)
        h = further
    return h


def chunk_ends(texts: list[bytes]) -> Iterator[list[int]]:
    """For each text the ends of its chunks."""
    h = gear(np.frombuffer(b"".join(texts), np.uint8))
    ends = np.nonzero(h < LOOSE)[0]
    loose, strict = (ends + 1).tolist(), (ends[h[ends] < STRICT] + 1).tolist()
    loose.append(1 << 62)
    strict.append(1 << 62)
    begin = 0
    find = bisect.bisect_left
    for text in texts:
        end, at, found = begin + len(text), begin, []
        while at < end:
            cut = at + MOST
            if end - at > LEAST:
                first = strict[find(strict, at + LEAST)]
                if first >= at + NORMAL:
                    first = loose[find(loose, at + NORMAL)]
                cut = min(cut, first)
            at = min(cut, end)
            found.append(at - begin)
        yield found
        begin = end


def prints(texts: list[str]) -> list[Print]:
    """The digest and length of each distinct chunk, in order of appearance; none for an empty text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    digest, result = xxhash.xxh64_hexdigest, []
    for text, ends in zip(data, chunk_ends(data)):
        found, at = {}, 0
        for end in ends:
            found[digest(text[at:end])] = end - at
            at = end
        result.append(found)
    return result


def contained(a: Print, b: Print) -> float:
    """The part of ``a``, by length, that ``b`` has too; two empty ones are alike."""
    if a == b:
        return 1.0
    whole = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / whole if whole else 0.0


def written(a: Print) -> str:
    return " ".join([f"{d}:{n}" for d, n in a.items()])


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column fingerprint, empty for a missing or empty text."""

    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        result: list[str] = []
        for some in _portions([t or "" for t in texts]):
            result += [written(p) for p in prints(some)]
        return pd.Series(result, dtype=object)

    return docs.select(*[quoted(c) for c in docs.columns if c.lower() != "fingerprint"], of(quoted(text_col).cast("string")).alias("fingerprint"))


def _portions(texts: Iterable[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


# --- each document and the next --------------------------------------------------------------

def _order(ident: int | None, digest: int) -> int:
    """Documents by id, null first, those of one id by a hash of the text, as one number."""
    return ((ident + (1 << 63) + 1 if ident is not None else 0) << 64) + digest + (1 << 63)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def crowd_size(slim: DataFrame) -> tuple[int, int]:
    """How many stretches ``slim`` (id, h, n) makes, and the size that the copies of one row may have without being a crowd."""
    size = slim.agg(F.sum("n")).first()[0] or 0
    stretches = min(size // STRETCH + 1, MOST_STRETCHES)
    return stretches, max(STRETCH, size // stretches) // 4


def in_stretches(docs: DataFrame, slim: DataFrame, stretches: int) -> DataFrame:
    """``docs`` (id, text) with _stretch and _ends, sorted within partitions by stretch and, in it, by id and text.

    A stretch holds neighbouring documents and, with _ends set, the first of the
    next stretch; the last one has the very first document there. The texts are
    shuffled once. Where stretches begin is found from a sample of the distinct keys in
    ``slim``, about ``LOOKED_AT`` for each; it changes how the work is split, and nothing else.
    """
    keys = slim.groupBy("id", "h").agg(F.count("*").alias("copies"))
    whole = keys.agg(F.count("*").alias("keys"), F.min(F.struct("id", "h")).alias("first")).first()
    starts = []
    if whole["keys"]:
        share = min(1.0, stretches * LOOKED_AT / whole["keys"])
        seen = keys.filter(F.pmod(F.xxhash64("h", "id"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).select("id", "h")
        seen = sorted(_order(*r) for r in seen.collect())
        starts = sorted({_order(*whole["first"]), *seen[LOOKED_AT::LOOKED_AT]})

    @F.pandas_udf("array<long>")
    def places(ident: pd.Series, digest: pd.Series) -> pd.Series:
        result = []
        for i, h in zip(ident.array, digest):
            key = _order(None if pd.isna(i) else int(i), int(h))
            at = bisect.bisect_right(starts, key) - 1
            result.append([2 * at, 2 * ((at - 1) % len(starts)) + 1] if starts[at] == key else [2 * at])
        return pd.Series(result)

    # Ids as text on the way, as numbers beside nulls would become floats.
    dealt = docs.withColumn("_h", _text_hash()).withColumn("_to", F.explode(places(F.col("id").cast("string"), "_h")))
    dealt = dealt.withColumn("_stretch", F.shiftright("_to", 1)).withColumn("_ends", F.col("_to").bitwiseAND(1) == 1).drop("_to")
    return dealt.repartition("_stretch").sortWithinPartitions("_stretch", "_ends", F.col("id").asc_nulls_first(), "_h")


SCHEMA = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Documents in portions, each with what follows it: (stretch, ends, id, text) in order."""
    some, size = [], 0
    for batch in batches:
        stretch, ends, ident, text = (batch.column(batch.schema.get_field_index(c)) for c in ("_stretch", "_ends", "id", "text"))
        for i in range(batch.num_rows):
            row = (stretch[i].as_py(), ends[i].as_py(), ident[i].as_py(), text[i].as_py() or "")
            some.append(row)
            size += len(row[3])
            if size >= AT_ONCE:
                yield some
                some, size = [], 0
    if some:
        yield some


def _likened(pairs: list[tuple]) -> list[tuple]:
    """(id, text, print, the next text and its print) to the columns of ``SCHEMA``."""
    edited = [t[: len(t) - len(t) // 2] + then[: len(t) // 2] for _, t, _, then, _ in pairs]
    rows = []
    for (ident, text, own, _, after), new, changed in zip(pairs, edited, prints(edited)):
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        rows.append((ident, len(text), sha, written(own), written(changed), contained(own, changed), contained(own, after)))
    return rows


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as ``in_stretches`` sorts them, to ``SCHEMA``."""
    last = None  # (stretch, id, text, print) that waits for the next
    for some in _pairs(batches):
        pairs = []
        for (stretch, ends, ident, text), own in zip(some, prints([r[3] for r in some])):
            if last is not None and last[0] == stretch:
                pairs.append((last, text, own))
            last = None if ends else (stretch, ident, text, own)
        rows = _likened([(ident, text, own, then, after) for (_, ident, text, own), then, after in pairs])
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and how much of it these two hold.

    Edited: the last half (rounded down) of the code points replaced by the
    first as many, or all, of the next document's by ascending id; after the last
    comes the first. Ids are whole numbers; null comes first, and rows of one id go
    by a hash of their texts. A missing text is empty.

    Equal rows follow each other, so all copies but one have their own text as the next one. Where copies of
    one row are many (a quarter of a stretch) they are counted before the shuffle and travel as one.
    Other columns, whatever their names, are not looked at; texts are read whole, however long. No rows in, no rows out.
    """
    ship(docs.sparkSession)
    name = docs.select(quoted(id_col)).columns[0]
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    slim = stored(rows.select("id", _text_hash().alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW).alias("n")), "print-ids")
    stretches, crowd = crowd_size(slim)
    # At most four crowds fill a stretch, so their keys are few.
    crowds = stored(slim.groupBy("id", "h").agg(F.sum("n").alias("n"), F.count("*").alias("c")).filter((F.col("n") > crowd) & (F.col("c") > 1)), "print-crowds")
    if not crowds.limit(1).count():
        found = in_stretches(rows, slim, stretches).select("_stretch", "_ends", "id", "text").mapInArrow(compare, SCHEMA)
        return found.withColumnRenamed("id", name)
    hashed = rows.withColumn("h", _text_hash())
    keys = F.broadcast(crowds.select(F.col("id").alias("_id"), F.col("h").alias("_h")))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    merged = hashed.join(keys, same, "left_semi").groupBy("id", F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    merged = stored(merged, "print-copies")
    single = hashed.join(keys, same, "left_anti").select("id", "text").unionByName(merged.select("id", "text"))
    found = in_stretches(single, slim, stretches).select("_stretch", "_ends", "id", "text").mapInArrow(compare, SCHEMA)
    ahead = ", ".join(SCHEMA.split(", ")[1:])

    @F.pandas_udf(ahead)
    def with_itself(texts: pd.Series) -> pd.DataFrame:
        result: list[tuple] = []
        for some in _portions(texts):
            result += [r[1:] for r in _likened([(None, t, own, t, own) for t, own in zip(some, prints(some))])]
        return pd.DataFrame(result, columns=[c.split()[0] for c in ahead.split(", ")])

    # The places of all copies but the last are alike: worked out once, then repeated.
    own = merged.filter("copies > 1").select("id", with_itself("text").alias("r"), F.explode(F.sequence(F.lit(2), F.col("copies"))))
    return found.unionByName(own.select("id", "r.*")).withColumnRenamed("id", name)

"""Documents as token sequences of a fixed length, packed by length patterns.

Tokens are counted once. The histogram of piece lengths, at most one row per
length, goes to the driver; there patterns of up to three lengths are fitted to
it by non-negative least squares, rounded down and laid out, and what is left is
packed by best fit, still as counts per length. The result says where the n-th
piece of a length goes. The pieces get their number among those of the same
length from counts per partition, so no task sees all pieces of a length.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.roles import quoted
from .common import give_back, ship, stored

#: Bins of length that patterns are made of, and lengths in a pattern.
BINS, FEW = 128, 3
#: Runs and words whose ids a task remembers; twice as many are held at most.
REMEMBERED = 200_000
#: Characters that are tokenized together.
AT_ONCE = 1 << 20
#: Rows of the table of starts (a row per partition and length) up to which it is broadcast.
STARTS = 500_000
KEY = 1 << 44  # above any number of pieces of one length


# --- tokens ----------------------------------------------------------------------------------

class Remembered(dict):
    """The ids of runs and words, worked out when they are first asked for; held in two generations."""

    def __init__(self, fresh: Callable[[bytes | str], bytes]) -> None:
        super().__init__()
        self.fresh, self.old = fresh, {}

    def __missing__(self, word: bytes | str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.fresh(word)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class Words:
    """Token ids of texts, run by run.

    The tokenizer splits at white space and works on each word alone, and within a
    word on contractions, runs of letters, single digits and runs of other signs. So
    the ids of a text are those of its runs, which go straight to the subword model.
    Words with characters whose kind isn't certain are encoded by the tokenizer.
    Whether all this holds for a tokenizer is tried out on a few texts first; if not,
    texts are encoded whole.
    """

    PROBE = (
        "Don't  stop:\tl'été, ÀÉ 12 a1b2\n\n(x)'s it's o'clock ... naïve\x0bßa ÿ's", "a.b,c. d., 'll <|x|>-- cafés",
        "end.&&& é99x $$$ 555-8178 key=Ab3_c% \"ÀÉ!?\" ¿[ª]{µ}º/÷×~ «x²» É° 1½", "Aa AA12.5% #A_b-C; <|É|> we're I'm I'd you've 'stop ''s .'s 'T 'é 'vet",
    )
    #: A byte of Latin-1 in lower case.
    LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
    LETTERS = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
    SIGNS = rb"!-/:-@\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7"
    RUN = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[" + LETTERS + rb"]+|[0-9]|[" + SIGNS + rb"]+")
    #: Bytes that runs are made of, and white space.
    CERTAIN = b"".join(re.findall(rb"[0-9\s" + LETTERS + SIGNS + rb"]", bytes(range(256))))

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.remembered = Remembered(self.fresh)
        # Bytes as the letters that byte-level vocabularies are written in: printable ones stand for themselves.
        itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(itself)]
        self.letters = {b: b for b in itself} | {b: 256 + i for i, b in enumerate(others)}
        # Tokens that the tokenizer looks for in the text as it is written.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [t.encode("latin-1").translate(self.LOWER) for t in added if t and max(t) <= "\xff"]
        self.by_word = all(self.whole([t])[0] == self.text(t) for t in self.PROBE)
        self.remembered.clear()

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[bytes] | list[str]:
        """Runs in Latin-1 and lower case, or words if a kind isn't certain; words as they are if there are other characters or an added token."""
        try:
            lower = text.encode("latin-1").translate(self.LOWER)
        except UnicodeEncodeError:
            lower = None
        if lower is None or any(t in lower for t in self.added):
            return [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        return lower.split() if lower.translate(None, self.CERTAIN) else self.RUN.findall(lower)

    def fresh(self, word: bytes | str) -> bytes:
        """The ids of a run, or of a word by its runs if it has no others."""
        if isinstance(word, bytes) and self.RUN.fullmatch(word):
            spelled = word.decode("latin-1").encode().decode("latin-1").translate(self.letters)
            return self.pack([t.id for t in self.tokenizer.model.tokenize(spelled)])
        text = word if isinstance(word, str) else word.decode("latin-1")
        parts = self.split(text)
        return self.whole([text])[0] if parts == [word] else b"".join([self.remembered[p] for p in parts])

    def ids(self, texts: list[str]) -> list[bytes]:
        return [self.text(t) for t in texts] if self.by_word else self.whole(texts)

    def text(self, text: str) -> bytes:
        return b"".join(map(self.remembered.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def _words(content: str) -> Words:
    return Words(content)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids, part, nth): the tokens of each document and ``end_id``, cut every ``limit`` ids.

    ``tokenizer`` is the path of a file for the tokenizers library, read here and
    sent to the tasks. ``ids`` holds little-endian unsigned 32-bit numbers. A
    missing or empty text has ``end_id`` alone. Each row of ``docs`` counts, be its
    id null or repeated. ``part`` and ``nth`` (the number among the pieces of the same
    length in this partition) are for ``place``.
    """
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())
    ident = docs.select(quoted(id_col)).schema[0]
    names = [ident.name, "piece", "start", "length", "ids", "part", "nth"]
    kinds = [ident.dataType, T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType(), T.IntegerType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _words(content.value), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            first = 0
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            while first < batch.num_rows:
                before = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, before + AT_ONCE, "right")))
                yield from cut_some(words, part, seen, batch.slice(first, last - first))
                first = last
            del batch
            give_back()

    def cut_some(words, part, seen, batch):
        rows = {n: [] for n in names[1:]}
        which = []
        for i, ids in enumerate(words.ids([t or "" for t in batch.column(1).to_pylist()])):
            ids += end
            for k in range(0, len(ids), 4 * limit):
                some = ids[k : k + 4 * limit]
                n = len(some) // 4
                which.append(i)
                for name, value in zip(names[1:], (k // (4 * limit), k // 4, n, some, part, int(seen[n]))):
                    rows[name].append(value)
                seen[n] += 1
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        columns = [pa.array(rows[n], t) for n, t in zip(names[1:], types)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *columns], names=names)

    return docs.select(quoted(id_col), quoted(text_col).cast("string")).mapInArrow(cut, schema)


# --- patterns, on counts per length ----------------------------------------------------------

def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:  # patterns that make each other up
        return np.linalg.lstsq(a, b, rcond=None)[0]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with no negative part: the active-set method of Lawson and Hanson, on the normal equations."""
    square, right = a.T @ a, a.T @ b
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    near = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(6 * a.shape[0] + 10):
        slope = right - square @ x
        slope[inside] = -np.inf
        if not len(slope) or slope.max() <= near:
            break
        inside[int(slope.argmax())] = True
        while inside.any():
            s = np.zeros_like(x)
            s[inside] = _solved(square[np.ix_(inside, inside)], right[inside])
            if s[inside].min() > 0:
                break
            low = inside & (s <= 0)
            share = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x += share * (s - x)
            inside &= x > near * 1e-9
            x[~inside] = 0
        x = s
    return x


def patterns(present: list[int], full: int) -> list[tuple[int, ...]]:
    """One to three of the bins, in descending order, that together are ``full``."""
    have, found = set(present), [(full,)] if full in set(present) else []
    for a in present:
        if 2 * a >= full and full - a in have:
            found.append((a, full - a))
        for b in present:
            c = full - a - b
            if a >= b >= c and c in have:
                found.append((a, b, c))
    return found


class Stock:
    """What is left of each length."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = Counter({k: n for k, n in counts.items() if n})
        self.lengths = sorted(self.left)

    def upto(self, most: int, least: int = 1, taken: tuple[int, ...] = ()) -> int | None:
        """The largest length in a range of which a piece is left besides those taken."""
        i = bisect.bisect_right(self.lengths, most) - 1
        while i >= 0 and self.lengths[i] >= least:
            k = self.lengths[i]
            if self.left[k] > taken.count(k):
                return k
            i -= 1
        return None

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for k in lengths:
            self.left[k] -= times
            if not self.left[k]:
                del self.lengths[bisect.bisect_left(self.lengths, k)]


def lay_out(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): sequences that hold all pieces, each of at most ``limit`` tokens."""
    stock, groups = Stock(counts), []
    width = -(-limit // BINS)
    full, bins = limit // width, Counter()
    for k, n in stock.left.items():
        bins[-(-k // width)] += n
    present = sorted(b for b in bins if b <= full)
    found = patterns(present, full)
    if found:
        place = {b: i for i, b in enumerate(present)}
        a = np.zeros((len(present), len(found)))
        for j, pattern in enumerate(found):
            for b in pattern:
                a[place[b], j] += 1
        weight = np.array(present, float)  # a piece counts as its tokens
        fit = nnls(a * weight[:, None], np.array([bins[b] for b in present], float) * weight)
        for j in np.argsort(-fit, kind="stable"):
            left = int(fit[j] + 1e-6)
            while left > 0:
                chosen: tuple[int, ...] = ()
                for i, b in enumerate(found[j]):
                    room = limit - sum(chosen)
                    # The last one fills what the others leave, from a longer bin if that fits.
                    last = i == len(found[j]) - 1
                    k = stock.upto(room if last else min(room, b * width), (b - 1) * width + 1, chosen)
                    if k is None:
                        break
                    chosen += (k,)
                if len(chosen) < len(found[j]):
                    break
                times = min([left, *(stock.left[k] // chosen.count(k) for k in chosen)])
                stock.take(chosen, times)
                groups.append((chosen, times))
                left -= times
    # Best fit, longest first; groups of equal sequences are filled together.
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for lengths, times in groups:
        by_room.setdefault(limit - sum(lengths), []).append((lengths, times))
    rooms = sorted(by_room)
    for k in sorted(stock.left, reverse=True):
        n = stock.left[k]
        while n:
            i = bisect.bisect_left(rooms, k)
            if i == len(rooms):
                each = limit // k
                for lengths, times in (((k,) * each, n // each), ((k,) * (n % each), 1)):
                    if lengths and times:
                        _add(by_room, rooms, limit - sum(lengths), (lengths, times))
                break
            room = rooms[i]
            lengths, times = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[i]
            now = min(times, n)
            if times > now:
                _add(by_room, rooms, room, (lengths, times - now))
            _add(by_room, rooms, room - k, (lengths + (k,), now))
            n -= now
    return [g for room in sorted(by_room) for g in by_room[room]]


def _add(by_room: dict, rooms: list[int], room: int, group: tuple[tuple[int, ...], int]) -> None:
    if room not in by_room:
        by_room[room] = []
        bisect.insort(rooms, room)
    by_room[room].append(group)


def slots(groups: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """(key, sequence, offset): from which number on the pieces of a length go to which sequences; key is length * KEY + number."""
    used, sequence, rows = Counter(), 0, []
    for lengths, times in groups:
        at = 0
        for k in lengths:
            rows.append((k * KEY + used[k], sequence, at))
            used[k] += times
            at += k
        sequence += times
    return pd.DataFrame(sorted(rows), columns=["key", "sequence", "offset"]).astype(np.int64)


def place(cut: DataFrame, limit: int = 2048) -> DataFrame:
    """``cut``, as ``pieces`` made it, with the sequence_id and offset of each piece; part and nth go."""
    rows = stored(cut, "pieces")
    counts = stored(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limit rows
    where = slots(lay_out(total, limit))
    keys, sequences, offsets = (where[c].to_numpy() for c in where.columns)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    starts = stored(starts, "piece-starts")
    starts = F.broadcast(starts) if starts.count() <= STARTS else starts

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        wanted = length.to_numpy() * KEY + number.to_numpy()
        i = np.searchsorted(keys, wanted, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[i] + (wanted - keys[i]), "offset": offsets[i]})

    placed = rows.join(starts, ["part", "length"]).withColumn("_at", find("length", F.col("_before") + F.col("nth")))
    return placed.select(*[quoted(c) for c in cut.columns if c not in ("part", "nth")], "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset): all documents in sequences of at most ``limit`` tokens.

    No rows in, no rows out.
    """
    return place(pieces(docs, tokenizer, id_col, text_col, limit, end_id), limit)

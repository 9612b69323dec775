"""Byte-level BPE: texts to token ids with their places, and back.

Ranks of byte strings become a model of the tokenizers library: each byte is written
as a printable character, every way to put a token together is a merge, and merges go
by the rank of what they make. Texts come in Arrow batches and are cut by a pattern;
each piece is encoded by itself and remembered. A token's place in bytes is turned into
characters, so tokens that share a split character share its place. Decoding turns
the characters of tokens back into bytes, which become text once they are complete.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.roles import quoted
from .common import give_back, others, ship

#: Pieces that a task remembers; twice as many are held at most. Longer ones aren't remembered.
REMEMBERED, LONGEST = 150_000, 64
#: Characters of texts that become one batch, and pieces of one text that are worked on together.
AT_ONCE, PIECES = 1 << 20, 1 << 17
NONE = 1 << 62


def byte_letters() -> dict[int, str]:
    """Bytes as the characters that byte-level vocabularies are written in: printable ones stand for themselves, others come after 255."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in itself)
    return {b: chr(b) for b in itself} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()
BYTES = {ord(c): b for b, c in LETTERS.items()}


def spelled(data: bytes) -> str:
    return data.decode("latin-1").translate(LETTERS)


def unspelled(letters: str) -> bytes:
    return letters.translate(BYTES).encode("latin-1")


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A file of lines with a token in base 64 and its rank, which is also its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Decoder:
    """Ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes_of = {i: unspelled(spelled(token)) for token, i in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, in which characters that tokens split are whole again."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Codec(Decoder):
    """Encodes and decodes by ``ranks``; pieces of a text are the matches of ``pattern``, what it doesn't match is left out."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        from tokenizers import models

        super().__init__(ranks)
        self.ranks, self.split = ranks, regex.compile(pattern)
        letters, merges = {token: spelled(token) for token in ranks}, []
        for token in sorted(ranks, key=ranks.__getitem__):
            cuts = ((token[:i], token[i:]) for i in range(len(token) - 1, 0, -1))
            merges += [(letters[a], letters[b]) for a, b in cuts if a in ranks and b in ranks]
        vocabulary = {letters[token]: i for token, i in ranks.items()}
        # A piece that is a token is that token, as with the ranks alone.
        self.model = models.BPE(vocabulary, merges, ignore_merges=True)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit numbers."""
        found = self.new.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self.fresh(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= LONGEST:
                self.new[piece] = found
        return found

    def fresh(self, data: bytes) -> bytes:
        ids = [t.id for t in self.model.tokenize(spelled(data))]
        if doubtful(data):
            ids = self.leftmost(data, ids)
        return np.asarray(ids, "<u4").tobytes()

    def leftmost(self, data: bytes, ids: list[int]) -> list[int]:
        """``ids`` checked: of equal ranks the leftmost pair merges first.

        The library goes by pairs, and one token may come of several. That can matter
        only in a piece that holds three bytes twice; those are merged again by rank and place.
        """
        ranks, n = self.ranks, len(data)
        if data in ranks:
            return ids
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[data[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)

        def offer(left: int) -> None:
            middle = ends[left]
            if middle < n:
                rank = ranks.get(data[left : ends[middle]])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, middle, ends[middle]))

        while heap:
            _, left, middle, right = heapq.heappop(heap)
            if ends[left] != middle or middle == n or ends[middle] != right:
                continue  # one of the two has grown since
            ends[left], ends[middle] = right, -1
            if right < n:
                before[right] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        merged, at = [], 0
        while at < n:
            merged.append(ranks[data[at : ends[at]]])
            at = ends[at]
        return merged

    def encode(self, text: str) -> bytes:
        if len(text) <= AT_ONCE:
            return self.joined(self.split.findall(text))
        found = (m.group() for m in self.split.finditer(text))
        parts = []
        while some := list(islice(found, PIECES)):
            parts.append(self.joined(some))
        return b"".join(parts)

    def joined(self, pieces: list[str]) -> bytes:
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {}
        try:
            return b"".join(map(self.new.__getitem__, pieces))
        except KeyError:
            return b"".join(map(self.piece, pieces))

    def places(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins and ends in ``text``, in characters; a character that is split belongs to all tokens that hold a part.

        Only for a pattern that matches all of ``text``.
        """
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        sizes = np.fromiter((len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()), np.int64)
        ends = np.cumsum(sizes)
        if len(data) != (ends[-1] if len(ends) else 0):
            raise ValueError("The pattern leaves out a part of the text.")
        return character[ends - sizes].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


def doubtful(data: bytes) -> bool:
    """Whether three bytes in a row are found twice, so that one token could be made in two places."""
    n = len(data) - 2
    return n > 1 and len(set(zip(data, data[1:], data[2:]))) < n


def readable(data: bytes) -> str:
    """Bytes as text; what isn't a whole character, as at the ends of a cut list of ids, becomes U+FFFD."""
    return data.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _decoder(content: bytes) -> Decoder:
    return Decoder(read_ranks(content))


@lru_cache(maxsize=1)
def _codec(content: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(content), pattern)


def _sent(df: DataFrame, ranks_path: str):
    """The content of the file that the driver reads, for the tasks."""
    ship(df.sparkSession)
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", places: bool = False) -> DataFrame:
    """``docs`` with n_tokens and ids (little-endian unsigned 32-bit numbers) and, if asked for, starts and ends in characters.

    The ids are those of merging by the lowest rank, leftmost first, in each match of
    ``pattern`` by itself; there are no special tokens. A missing or empty text has none.
    Every row stays, whatever its id, also where rows repeat; an empty table stays empty.
    Very long texts are cut into pieces a part at a time. Columns of ``docs`` with the names that are added give way.
    """
    content = _sent(docs, ranks_path)
    names = ["n_tokens", "ids", *(["starts", "ends"] if places else [])]

    @F.arrow_udf("n_tokens long, ids binary" + (", starts array<int>, ends array<int>" if places else ""))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(content.value, pattern)
        for batch in batches:
            found = []
            for value in batch:
                found.append(codec.encode(value.as_py() or ""))
            columns = [pa.array([len(ids) // 4 for ids in found], pa.int64()), pa.array(found, pa.binary())]
            if places:
                both = [codec.places(value.as_py() or "", ids) for value, ids in zip(batch, found)]
                columns += [pa.array([p[k] for p in both], pa.list_(pa.int32())) for k in (0, 1)]
            del batch, found
            give_back()
            yield pa.StructArray.from_arrays(columns, names=names)

    told = docs.select(*others(docs, *names), of(quoted(text_col).cast("string")).alias("_encoded"))
    return told.select(*others(told, "_encoded"), "_encoded.*")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with decoded, the bytes of its ids; missing ids give missing bytes, none empty ones.

    ``decoded_text`` makes them readable. An id outside the vocabulary is an error.
    """
    content = _sent(encoded, ranks_path)

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _decoder(content.value)
        for batch in batches:
            found = pa.array([decoder.decode(v.as_py()) if v.is_valid else None for v in batch], pa.binary())
            del batch
            give_back()
            yield found

    return encoded.select(*others(encoded, "decoded"), of(quoted(ids_col)).alias("decoded"))


def decoded_text(data: Column) -> Column:
    """Decoded bytes as text, with U+FFFD for characters that aren't whole."""

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([readable(v.as_py()) if v.is_valid else None for v in column], pa.string())

    return of(data)

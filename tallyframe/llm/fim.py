"""Fill-in-middle: texts with their middle moved to the end, by rotating blocks in place.

A text is cut into prefix, middle and suffix at two token ends that a hash of the id
draws. Sentinels are inserted before each, which leaves prefix, middle, suffix in one
byte array; the order that is wanted differs from that by exchanging two neighbouring blocks,
which is done in place by three reversals. The same rotation by the other length takes
it back, and the sentinels out of it, to the very text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.roles import quoted
from .common import give_back, others, ship

#: Sentinels before prefix, suffix and middle. Texts that hold one stay plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

Cut = tuple[int, int, int]  # tokens, and the bytes before the middle and before the suffix


def draws(ident: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that follow from an id."""
    digest = hashlib.sha256(f"{seed}:{ident}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def token_ends(data: np.ndarray) -> np.ndarray:
    """The ends of the tokens of a text's bytes: words with the white space before them, and what white space is left."""
    space = SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data)) if len(data) else ends


def reverse(part: np.ndarray) -> None:
    half = len(part) // 2
    left, right = part[:half], part[len(part) - half :]
    kept = left.copy()
    left[:] = right[::-1]
    right[:] = kept[::-1]


def exchange(buffer: bytearray, begin: int, middle: int, end: int) -> None:
    """The blocks begin..middle and middle..end of ``buffer`` change places."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((begin, middle), (middle, end), (begin, end)):
        reverse(view[a:b])


def moved(data: bytes, cut_a: int, cut_b: int, form: str) -> bytearray:
    """The text in the order of ``form``; the cuts are where its middle and its suffix begin."""
    buffer = bytearray(data)
    for at, mark in ((cut_b, SUFFIX), (cut_a, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    suffix = cut_b + len(PREFIX) + len(MIDDLE)
    exchange(buffer, cut_a + len(PREFIX) if form == PSM else 0, suffix, len(buffer))
    return buffer


def moved_back(data: bytes, form: str) -> bytes:
    """The text that ``moved`` made ``data`` of."""
    if form == PLAIN:
        return bytes(data)
    buffer = bytearray(data)
    first, second = (SUFFIX, MIDDLE) if form == PSM else (PREFIX, MIDDLE)
    here = buffer.index(first, len(PREFIX))
    there = buffer.index(second, here + len(first))
    if form == PSM:  # prefix, suffix, middle
        exchange(buffer, here, there, len(buffer))
        middle, suffix = here, here + len(buffer) - there
    else:  # suffix, prefix, middle
        exchange(buffer, 0, here, len(buffer))
        middle, suffix = there - here, len(buffer) - here
    for at, mark in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def characters(data: np.ndarray) -> int:
    """Code points in UTF-8 bytes."""
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


def transformed(data: bytes, ident: str, rate: int, spm: int, seed: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, characters of prefix and middle, output) of a text."""
    h1, h2, h3, h4 = draws(ident, seed)
    view = np.frombuffer(data, np.uint8)
    ends = token_ends(view)
    n = len(ends)
    if not data or h3 % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, data
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = SPM if h4 % 100 < spm else PSM
    return n, form, characters(view[:a]), characters(view[a:b]), bytes(moved(data, a, b, form))


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm: int = 80, seed: int = 42
) -> DataFrame:
    """``docs`` with n (tokens), form, prefix_chars, middle_chars and output, the text in its form.

    ``rate`` percent of the texts change their order, ``spm`` percent of them to suffix,
    prefix, middle, the others to prefix, suffix, middle. A text that is empty or holds a sentinel
    stays plain, with no prefix_chars and middle_chars. A missing text is empty; a missing id draws as an
    empty one. Rows that repeat are treated alike; an empty table stays empty. A text of any length is held once,
    and once more while it is put out. Columns of ``docs`` with the names that are added give way.
    """
    ship(docs.sparkSession)
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for idents, texts in batches:
            rows = [
                transformed((t.as_py() or "").encode("utf-8", "surrogatepass"), i.as_py() or "", rate, spm, seed) for i, t in zip(idents, texts)
            ]
            columns = list(zip(*rows)) or [()] * len(names)
            done = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            del idents, texts, rows, columns
            give_back()
            yield done

    told = docs.select(*others(docs, *names), of(quoted(id_col).cast("string"), quoted(text_col).cast("string")).alias("_fim"))
    return told.select(*others(told, "_fim"), "_fim.*")


def restore(made: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """``made`` with restored, the text that each output was made of, from output and form alone; missing where one of them is."""
    ship(made.sparkSession)

    @F.arrow_udf("string")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for forms, outputs in batches:
            rows = [
                moved_back(o.as_py().encode("utf-8", "surrogatepass"), f.as_py()) if f.is_valid and o.is_valid else None
                for f, o in zip(forms, outputs)
            ]
            done = pa.array(rows, pa.string())
            del forms, outputs, rows
            give_back()
            yield done

    return made.select(*others(made, "restored"), of(quoted(form_col), quoted(output_col)).alias("restored"))

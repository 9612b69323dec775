"""Ids against the tiktoken library, bytes against the texts, places against a plain count."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import bpe

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks_path():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec(ranks_path):
    return bpe.Codec(bpe.read_ranks(open(ranks_path, "rb").read()), PATTERN)


@pytest.fixture(scope="module")
def plain(ranks_path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_every_byte_has_a_letter_of_its_own():
    assert len(set(bpe.LETTERS.values())) == 256 and not any(c.isspace() for c in bpe.LETTERS.values())
    every = bytes(range(256))
    assert bpe.unspelled(bpe.spelled(every)) == every


def test_query_equals_the_library(spark, documents, plain):
    import hashlib

    from tallyframe.llm.queries import QUERIES
    from tests.conftest import SMALL

    got = {tuple(r) for r in QUERIES["op13_byte_bpe"](spark, SMALL).collect()}
    want = set()
    for row in documents.collect():
        text = row["text"] or ""
        ids = plain.encode_ordinary(text)
        packed = np.asarray(ids, "<u4").tobytes()
        want.add((row["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, plain, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode(text)
    assert numbers(ids) == plain.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_pieces_that_repeat_themselves(codec, plain):
    draw = random.Random(5)
    tokens = list(codec.ranks)
    for _ in range(4000):
        some = draw.choice(tokens)
        data = some * draw.randint(1, 9) + draw.choice(tokens) + some
        assert numbers(codec.fresh(data)) == plain._encode_single_piece(data), data
    for text in ("a" * 3000, "ab" * 2500, "оно" * 900, "\n" * 2000, "日本" * 700):
        assert numbers(codec.encode(text)) == plain.encode_ordinary(text)


def test_the_check_alone_merges_leftmost_first(codec, plain):
    draw = random.Random(6)
    for _ in range(2000):
        data = "".join(draw.choice("abcnoe") for _ in range(draw.randint(2, 30))).encode()
        assert codec.leftmost(data, numbers(codec.fresh(data))) == plain._encode_single_piece(data)


def test_equal_ranks_go_from_the_left():
    # "aba" comes of ab + a and of a + ba; the pair on the left merges first, whatever the order of pairs.
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"ba": 257, b"aba": 258, b"abaaba": 400}
    codec = bpe.Codec(ranks, r"\S+|\s+")
    encoding = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(7)
    for _ in range(3000):
        text = "".join(draw.choice("ab") for _ in range(draw.randint(1, 24)))
        assert numbers(codec.encode(text)) == encoding.encode_ordinary(text), text


def test_places_share_split_characters(codec):
    text = "né 日本語の🙂🙂 x"
    ids = codec.encode(text)
    starts, ends = codec.places(text, ids)
    data, at = text.encode(), 0
    for i, a, b in zip(numbers(ids), starts, ends):
        token = codec.bytes_of[i]
        whole = text[a:b].encode()
        assert token in whole and len(whole) - len(token) < 8
        before = data[: at + 1].decode("utf-8", "ignore")
        assert a == len(data[:at].decode("utf-8", "ignore")) and len(before) >= a
        at += len(token)
    assert ends[-1] == len(text) and any(s < e for s, e in zip(starts[1:], ends))  # characters are split here


def test_cut_lists_of_ids_stay_readable(spark, codec, ranks_path):
    text = "日本語🙂"
    ids = codec.encode(text)
    assert codec.decode(ids).decode() == text
    cut = spark.createDataFrame([(bytearray(ids[:k]),) for k in range(0, len(ids) + 1, 4)] + [(None,)], "ids binary")
    rows = bpe.decode(cut, ranks_path).withColumn("t", bpe.decoded_text(F.col("decoded"))).collect()
    assert rows[-1]["decoded"] is None and rows[-1]["t"] is None
    for k, row in enumerate(rows[:-1]):
        assert text.encode().startswith(bytes(row["decoded"])) and text.startswith(row["t"].rstrip("�")), k
    assert rows[-2]["t"] == text


def test_long_texts_are_cut_alike(codec, plain, monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    monkeypatch.setattr(bpe, "PIECES", 7)
    text = "Some words, and   spaces \n\n at 123 places; l'été won't end " * 40
    assert numbers(codec.encode(text)) == plain.encode_ordinary(text)


def test_memory_of_pieces_is_bounded(ranks_path, plain, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    codec = bpe.Codec(bpe.read_ranks(open(ranks_path, "rb").read()), PATTERN)
    for i in range(200):
        text = f"word{i} other{i * 7} again word{i - 3}"
        assert numbers(codec.encode(text)) == plain.encode_ordinary(text)
        assert len(codec.new) + len(codec.old) < 80


def test_awkward_rows(spark, awkward, nothing, ranks_path, plain):
    clashing = awkward.withColumns({"ids": F.lit("x"), "N_tokens": F.lit(0), "decoded": F.lit(None)})
    told = bpe.decode(bpe.encode(clashing, ranks_path, PATTERN, places=True), ranks_path)
    rows = told.collect()
    assert len(rows) == awkward.count() and sorted(c.lower() for c in told.columns) == sorted({c.lower() for c in told.columns})
    for row in rows:
        text = row["text"] or ""
        assert numbers(row["ids"]) == plain.encode_ordinary(text) and row["n_tokens"] == len(row["starts"]) == len(row["ends"])
        assert bytes(row["decoded"]) == text.encode()
    assert bpe.decode(bpe.encode(nothing, ranks_path, PATTERN), ranks_path).count() == 0

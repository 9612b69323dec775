"""Packing: every token in its place, ids as the tokenizer gives them, few sequences."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import packing


def check(docs, tokenizer, limit=2048):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    plain = Tokenizer.from_file(tokenizer)
    want = Counter()
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), limit):
            some = np.array(ids[k : k + limit], "<u4").tobytes()
            want[(i, k // limit, k, len(some) // 4, zlib.crc32(some))] += 1
    got = packing.pack(docs, tokenizer, limit=limit)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = got.collect()
    assert Counter((r[0], r[1], r[2], r[3], zlib.crc32(r["ids"])) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)  # gapless from 0
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= limit for e in ends.values())
    tokens = sum(r["length"] for r in got)
    return len(ends), -(-tokens // limit)


def test_given_documents(documents, tokenizer):
    used, least = check(documents, tokenizer)
    assert used <= 1.02 * least + 1


def test_awkward_rows(awkward, tokenizer):
    check(awkward, tokenizer)
    check(awkward, tokenizer, limit=7)


def test_no_rows(nothing, tokenizer):
    assert packing.pack(nothing, tokenizer).count() == 0


@pytest.mark.parametrize("text", [
    "It's we'll DON'T 'tis", "ÀÉÎ çà İstanbul ΣΑΣ ß ẞ", "a\x0bb\x0cc\rd\x1ce\x85f\xa0g", "é café ́x", "x² ½ ④ 1,000.50 ...",
    "word. word, word.. .word ,", "<|endoftext|> a<|startoftext|>b", "日本語 テキスト 👍🏽 कुछ", "tab\tnew\nline", "\0nul \0", "µªº ñandú",
])
def test_words_alone_give_the_ids_of_the_text(tokenizer, text):
    words = packing.Words(open(tokenizer, encoding="utf-8").read())
    assert words.by_word
    assert words.ids([text]) == words.whole([text])


def test_ids_stay_right_when_words_are_forgotten(tokenizer, documents, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    words = packing.Words(open(tokenizer, encoding="utf-8").read())
    texts = [r["text"] or "" for r in documents.limit(40).collect()]
    assert words.ids(texts) == words.whole(texts)


def test_a_tokenizer_that_does_not_split_at_words():
    import public_tokenizers

    words = packing.Words(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert not words.by_word
    assert words.ids(["two  words"]) == words.whole(["two  words"])


@pytest.mark.parametrize("text", [
    "<|ENDOFTEXT|> a<|StartOfText|>b", "<|ENDOFTEXT|> x <|endoftext|>É", "¿Qué? «oui» 1½x² ©®× ÷a", "we're I'M you've he'd ''s .'s 'é", "curly “word.” it’s A.B,c",
])
def test_runs_alone_give_the_ids_of_the_text(tokenizer, text):
    words = packing.Words(open(tokenizer, encoding="utf-8").read())
    assert words.by_word
    assert words.ids([text]) == words.whole([text])


def test_every_two_characters_of_latin_1(tokenizer):
    words = packing.Words(open(tokenizer, encoding="utf-8").read())
    latin = [chr(i) for i in range(256)]
    texts = [f"x{a}{b}y {b}'{a}" for a in latin for b in latin]
    assert words.ids(texts) == words.whole(texts)


def test_words_with_signs_and_digits_need_no_whole_encoding(tokenizer, monkeypatch):
    words = packing.Words(open(tokenizer, encoding="utf-8").read())
    texts = ["one.&&& two*** (three) 555-8178 key=ab3c it's", "Été, Écrit: «ÀÉ»!"]
    want = words.whole(texts)
    monkeypatch.setattr(words, "whole", None)
    assert words.ids(texts) == want


def test_a_run_is_worked_out_once(tokenizer, monkeypatch):
    words, asked, fresh = packing.Words(open(tokenizer, encoding="utf-8").read()), [], packing.Words.fresh
    monkeypatch.setattr(words.remembered, "fresh", lambda w: (asked.append(w), fresh(words, w))[1])
    words.ids(["word word. word, (word) Word!", "word? 'word'"])
    assert Counter(asked) == Counter([b"word", b".", b",", b"(", b")", b"!", b"?", b"'"])


def test_one_long_text_does_not_outgrow_what_is_remembered(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    words = packing.Words(open(tokenizer, encoding="utf-8").read())
    text = " ".join(chr(97 + a) + chr(97 + b) for a in range(26) for b in range(26)) + " aa bb. aa"
    assert words.ids([text]) == words.whole([text])
    assert len(words.remembered) <= 50 and len(words.remembered.old) <= 50


@pytest.mark.parametrize("limit, counts", [
    (2048, {2048: 7, 1024: 5, 1: 3}), (10, {3: 1000, 4: 500, 10: 2}), (16, {k: 17 * k % 23 for k in range(1, 17)}),
    (300, {k: 1 + k * k % 91 for k in range(1, 301)}), (2048, {700: 3_000_000_000, 680: 2_999_999_999, 668: 3_000_000_001, 5: 11}), (5, {}),
])
def test_lay_out(limit, counts):
    groups = packing.lay_out(counts, limit)
    got = Counter()
    for lengths, times in groups:
        assert times > 0 and sum(lengths) <= limit
        for k in lengths:
            got[k] += times
    assert got == Counter({k: n for k, n in counts.items() if n})
    tokens = sum(k * n for k, n in counts.items())
    assert sum(t for _, t in groups) <= 1.15 * -(-tokens // limit) + 1
    where = packing.slots(groups)
    assert where["key"].is_monotonic_increasing and where["key"].is_unique


def test_nnls():
    draw = np.random.default_rng(3)
    a, x = draw.random((30, 12)), np.maximum(draw.normal(size=12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    fit = packing.nnls(a, draw.normal(size=30))
    assert (fit >= 0).all()

"""Fill-in-middle against plain slices, and back."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_slices(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output), by the wording of the rule."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(part) for part in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_documents(spark, documents):
    rows = fim.restore(fim.transform(documents)).collect()
    assert len(rows) == documents.count()
    forms = set()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_slices(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab <PSM>\t\n\x0bé日🙂  "), max_size=40), st.integers(-5, 400))
def test_any_text_and_back(text, ident):
    n, form, prefix, middle, output = fim.transformed(text.encode(), str(ident), 50, 80, 42)
    assert (n, form, prefix, middle, bytes(output).decode()) == by_slices(ident, text)
    assert fim.moved_back(bytes(output), form) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(0, 60))
def test_exchange_is_its_own_inverse_by_the_other_length(data, a, b, c):
    a, b, c = sorted(min(x, len(data)) for x in (a, b, c))
    buffer = bytearray(data)
    fim.exchange(buffer, a, b, c)
    assert bytes(buffer) == data[:a] + data[b:c] + data[a:b] + data[c:]
    fim.exchange(buffer, a, a + c - b, c)
    assert bytes(buffer) == data


def test_reverse():
    for n in range(9):
        part = np.arange(n, dtype=np.uint8)
        fim.reverse(part)
        assert part.tolist() == list(range(n))[::-1]


def test_sentinels_stay_apart_from_text_that_looks_like_them():
    for text in ("<<P <S <M", "P> S> M>", "< <P<S M>", "<<<", "a<S b<M c<P d"):
        data = text.encode()
        ends = [0, *fim.token_ends(np.frombuffer(data, np.uint8)).tolist()]
        for i, a in enumerate(ends):
            for b in ends[i:]:
                for form in (fim.PSM, fim.SPM):
                    assert fim.moved_back(bytes(fim.moved(data, a, b, form)), form) == data


def test_awkward_rows(spark, awkward, nothing):
    clashing = awkward.withColumns({"N": F.lit(-1), "form": F.lit("x"), "output": F.lit(None), "RESTORED": F.lit(0)})
    made = fim.restore(fim.transform(clashing))
    assert len({c.lower() for c in made.columns}) == len(made.columns)
    rows = made.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_slices(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert fim.restore(fim.transform(nothing)).count() == 0
    missing = spark.createDataFrame([(None, "x"), ("psm", None)], "form string, output string")
    assert [r["restored"] for r in fim.restore(missing).collect()] == [None, None]


def test_a_text_of_millions_of_characters(spark):
    long = "wort für wort " * 300_000
    rows = spark.range(6).select(F.col("id").alias("doc_id"), F.lit(long).alias("text"))
    same = fim.restore(fim.transform(rows)).filter(F.col("restored") == F.col("text"))
    assert same.count() == 6

"""Filter interactions against a plain walk through all orders."""

import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import audit


def by_walking(rows, filters, losses):
    """(part, order, step) -> counts; ``rows`` are (part, set of failed filters, set of losses)."""
    result = {}
    for part in {p or "" for p, _, _ in rows}:
        mine = [(f, lost) for p, f, lost in rows if (p or "") == part]
        gone = {f: 0 for f in filters}
        for order in permutations(filters):
            here = mine
            for step, x in enumerate(order, 1):
                out = [r for r in here if x in r[0]]
                here = [r for r in here if x not in r[0]]
                failing = sum(x in f for f, _ in mine)
                gone[x] += len(out)
                result[part, "".join(order), step] = [
                    len(here), len(out), failing - len(out), sum(f == {x} for f, _ in mine), *[sum(k in lost for _, lost in out) for k in losses], x,
                ]
        for key, counts in result.items():
            if key[0] == part:
                counts[-1] = gone[counts[-1]]
    return {k: tuple(v) for k, v in result.items()}


def told(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def plain_flags(docs, labels):
    """The rows of ``by_walking``, by the wording of the rules."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        fails |= {"D"} if set("#$%&*|") & set(text) else set()
        fails |= {"E"} if i is not None and least[text] < i else set()
        rows.append((part, fails, {k for k, s in (("good", good), ("toxic", toxic)) if i is not None and i in s}))
    return rows


sorted_ids = st.lists(st.integers(0, 80), unique=True, max_size=40).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(sorted_ids, max_size=5), sorted_ids)
def test_merges(lists, ids):
    gone = audit.union(lists)
    assert gone == sorted(set().union(*lists))
    assert audit.difference(ids, gone) == sorted(set(ids) - set(gone))


def test_gallop():
    ids = list(range(0, 3000, 3))
    for at in (0, 5, 998, 1000):
        for key in (-1, 0, 7, 1500, 2997, 2998, 9999):
            want = next((i for i in range(at, len(ids)) if ids[i] >= key), len(ids))
            assert audit.gallop(ids, at, key) == want


@pytest.mark.parametrize("seed", [1, 7])
def test_any_flags(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["x", "y", None, ""]), {f for f in "KLM" if draw.random() < 0.4}, {k for k in ("bad",) if draw.random() < 0.3}) for _ in range(300)]
    rows += [("clean", set(), {"bad"})] * 5 + [("x", {"K", "M"}, set())] * 100
    flat = [(p, *[True if f in fails else draw.choice([False, None]) for f in "KLM"], "bad" in lost) for p, fails, lost in rows]
    df = spark.createDataFrame(flat, "p string, K boolean, L boolean, M boolean, bad boolean").repartition(5)
    assert told(audit.interactions(df, "p", ["K", "L", "M"], ["bad"])) == by_walking(rows, "KLM", ["bad"])


def test_blocks_are_bounded_and_of_one_part(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(audit, "BLOCK", 10)
    parts = ["a"] * 25 + ["b"] * 3 + ["c"] * 12
    batches = [
        pa.RecordBatch.from_arrays([pa.array(parts[i : i + 7]), pa.array(range(i, min(i + 7, 40)), pa.int64()), pa.array([1] * len(parts[i : i + 7]), pa.int32())], names=["part", "id", "bits"])
        for i in range(0, 40, 7)
    ]
    found = [(p, ids.tolist()) for p, ids, _ in audit._blocks(iter(batches))]
    assert [p for p, _ in found] == ["a", "a", "a", "b", "c", "c"] and all(len(i) <= 10 for _, i in found)
    assert [i for _, ids in found for i in ids] == list(range(40))
    assert list(audit._blocks(iter([]))) == []


def test_counts_of_a_block():
    bits = np.random.default_rng(3).integers(0, 128, 500).astype(np.int32)
    rows = {(f, b): rest for f, b, *rest in audit.counted(np.arange(500), bits, 5, 2)}
    for before in range(32):
        for f in range(5):
            if not before >> f & 1:
                out = [x for x in bits.tolist() if x >> f & 1 and not x & before]
                assert rows[f, before] == [len(out), sum(x >> 5 & 1 for x in out), sum(x >> 6 & 1 for x in out)]


def test_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    rows = plain_flags(docs, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert told(audit.audit(documents, labels)) == by_walking(rows, "ABCDE", ["good", "toxic"])


def test_awkward_rows(spark, awkward, nothing):
    labels = [(1, 1, 0), (1, 0, 1), (6, 1, None), (9, 1, 1), (None, 1, 1), (99, 1, 1), (None, None, None)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clashing = awkward.withColumns({"good": F.lit(True), "A": F.lit("x"), "bits": F.lit(1), "_ID": F.lit(5)})
    docs = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    rows = plain_flags(docs, [tuple(r) for r in labels if r[0] is not None])
    assert told(audit.audit(clashing, frame)) == by_walking(rows, "ABCDE", ["good", "toxic"])
    none = audit.audit(nothing, frame)
    assert none.count() == 0 and none.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    ]
    assert told(audit.audit(awkward, frame.limit(0))) == by_walking([(p, f, set()) for p, f, _ in rows], "ABCDE", ["good", "toxic"])


def test_words_of_long_texts_are_cut_alike(monkeypatch):
    text = "some Words and  more\tWords " * 30
    whole = audit.failures(text)
    monkeypatch.setattr(audit, "AT_ONCE", 10)
    assert [w for some in audit.words(text.encode()) for w in some] == text.encode().split()
    assert audit.failures(text) == whole

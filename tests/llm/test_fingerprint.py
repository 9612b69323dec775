"""Fingerprints against a byte-by-byte chunker, and the pairing with the next document."""

import hashlib
import random

import xxhash

from tallyframe.llm import fingerprint as fp

GEAR = [xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)]


def plain_print(text):
    """Chunks found one byte at a time."""
    data, found, start = text.encode(), {}, 0
    while start < len(data):
        h, end = 0, len(data)
        for i in range(start, len(data)):
            h = ((h << 1) + GEAR[data[i]]) % (1 << 32)
            n = i + 1 - start
            if n >= fp.LEAST and h >> (24 if n < fp.NORMAL else 28) == 0 or n == fp.MOST:
                end = i + 1
                break
        found[xxhash.xxh64_hexdigest(data[start:end])] = end - start
        start = end
    return found


def plain_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    result = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = plain_print(text), plain_print(new), plain_print(after)

        def share(x, y):
            return 1.0 if x == y else sum(n for d, n in x.items() if d in y) / max(1, sum(x.values()))

        result.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.written(a), fp.written(b), share(a, b), share(a, c)))
    return sorted(result, key=repr)


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = fp.with_next(docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_rows(rows)


def test_given_documents_in_one_and_in_many_stretches(documents, monkeypatch):
    check(documents)
    monkeypatch.setattr(fp, "STRETCH", 20_000)
    monkeypatch.setattr(fp, "LOOKED_AT", 3)
    check(documents)


def test_awkward_rows(spark, awkward):
    # Rows of one id go by a hash of their texts, which the plain version doesn't know: leave one of them.
    check(awkward.filter("doc_id is not null or text is not null"))
    got = fp.with_next(awkward)
    assert got.count() == awkward.count()
    check(spark.createDataFrame([(5, "only one document, a little longer than one chunk " * 3)], "doc_id long, text string"))


def test_a_row_that_makes_up_a_third_of_the_table(spark, documents, monkeypatch):
    monkeypatch.setattr(fp, "STRETCH", 20_000)
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").limit(120).collect()]
    rows += [(7, "the same row, " * 30)] * 60 + [(None, None)] * 900 + [(10_000, "last")]
    docs = spark.createDataFrame([r for r in rows if r[0] != 7 or r[1].startswith("the same")], "doc_id long, text string").repartition(5)
    check(docs)
    slim = docs.select(docs.doc_id.alias("id"), fp._text_hash().alias("h"), fp.F.coalesce(fp.F.octet_length("text"), fp.F.lit(0)).alias("n"))
    assert fp.crowd_size(slim.withColumn("n", slim.n + fp.ROW))[1] < 60 * 420  # so the copies did travel as one


def test_the_driver_looks_at_a_bounded_number_of_keys(documents, monkeypatch):
    """Longer stretches instead of more of them, and copies are one key; the rows stay the same."""
    monkeypatch.setattr(fp, "STRETCH", 2_000)
    monkeypatch.setattr(fp, "MOST_STRETCHES", 4)
    check(documents)


def test_no_rows(nothing):
    assert fp.with_next(nothing).count() == 0


def test_column_of_fingerprints(awkward):
    rows = fp.fingerprint(awkward).select("text", "fingerprint").collect()
    assert all(r["fingerprint"] == fp.written(plain_print(r["text"] or "")) for r in rows)


def test_inserted_text_changes_little():
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(900)]
    text = " ".join(words)
    moved = " ".join(words[:300] + ["something", "new"] + words[300:])
    a, b, other = fp.prints([text, moved, " ".join(sorted(words))])
    assert fp.contained(a, b) > 0.9
    assert fp.contained(a, other) < 0.05
    assert sum(a.values()) == len(text)

"""The byte network: what it learns from, what its look-ups compute, and how often it is right on held-out ids."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import language


def test_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs)
    assert got.columns == [*docs.columns, "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) >= 0.97 * len(unseen)


def test_labels_of_held_out_rows_and_other_columns_are_not_used(documents):
    changed = documents.withColumn("lang", F.when(language.is_held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    labels, x, y = language.training_windows(documents, "doc_id", "text", "lang")
    again = language.training_windows(changed, "doc_id", "text", "lang")
    assert labels == again[0] == ["de", "en", "es", "fr"]
    assert (x == again[1]).all() and (y == again[2]).all()


def test_awkward_rows(awkward):
    got = {(r["doc_id"], r["text"]): r for r in language.identify(awkward).collect()}
    assert awkward.count() == 14 and len(got) == 13  # one row repeats
    for text in (None, "", "   \n\t ", "1234 5678 --- !!!"):
        assert all(r["lang_pred"] == "und" and r["score"] == 0 for (_, t), r in got.items() if t == text)
    assert {r["lang_pred"] for r in got.values()} <= {"und", "en", "fr", "de", "ja"}
    assert not got[(None, None)]["held_out"]


def test_no_rows_and_nothing_to_learn_from(nothing, awkward):
    assert language.identify(nothing).count() == 0
    told = language.identify(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in told.collect()} == {"und"}


def test_look_ups_equal_products():
    """At all places of a window, the last ones of the narrower filters among them."""
    network = language.Network(["a", "b", "c"])
    x = np.random.default_rng(2).integers(0, 256, (70, language.WINDOW), dtype=np.uint8)
    at = network._forward(x)[1]
    assert any((best > language.WINDOW - max(language.WIDTHS)).any() for best in at)
    assert np.allclose(network.probabilities(x, network.tables()), network._forward(x)[3], atol=1e-5)
    # A window whose only high place for width 2 is its very end.
    network.w["emb"][:] = 0
    network.w["emb"][7] = 1
    network.w["conv2"][:] = 1
    x = np.zeros((2, language.WINDOW), np.uint8)
    x[1, -2:] = 7
    assert np.allclose(network.probabilities(x, network.tables()), network._forward(x)[3], atol=1e-5)


def plain_scores(network, text):
    """The mean over all windows, weighed by bytes, of the outputs by plain products."""
    data = text.encode()
    total = np.zeros(len(network.labels))
    for i in range(0, max(1, len(data)), language.WINDOW):
        some = data[i : i + language.WINDOW]
        x = np.frombuffer(some.ljust(language.WINDOW, b"\0"), np.uint8)
        pooled = []
        for k in language.WIDTHS:
            values = [network.w["emb"][x[p : p + k]].ravel() @ network.w[f"conv{k}"] for p in range(language.WINDOW - k + 1)]
            pooled.append(np.maximum(np.max(values, axis=0) + network.w[f"bias{k}"], 0))
        out = np.concatenate(pooled) @ network.w["out"] + network.w["out_bias"]
        total += max(1, len(some)) * np.exp(out - out.max()) / np.exp(out - out.max()).sum()
    return total / total.sum()


def test_predictions_equal_plain_convolution(documents, awkward):
    network = language.fit(documents)
    some = documents.select("doc_id", "text", "lang").filter("length(text) < 3000").limit(60)
    rows = language.identify(some.unionByName(awkward.select("doc_id", "text", "lang").filter("length(text) < 3000")), network=network).collect()
    assert len(rows) > 60
    for r in rows:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        want = plain_scores(network, r["text"])
        assert r["lang_pred"] == network.labels[want.argmax()] and abs(r["score"] - want.max()) < 1e-4


def test_copies_of_a_row_are_learned_from_once(spark, documents):
    one = documents.filter(~language.is_held_out(F.col("doc_id")) & F.col("lang").isNotNull()).limit(1)
    hot = one.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(30_000)))).drop("_n")
    labels, x, y = language.training_windows(documents.unionByName(hot), "doc_id", "text", "lang", rows=200)
    assert len(np.unique(x, axis=0)) == len(x) <= 2 * 200 * language.WINDOWS_EACH
    assert language.training_windows(hot, "doc_id", "text", "lang")[1].shape[0] <= language.WINDOWS_EACH


def test_gradients():
    network = language.Network(["a", "b"])
    network.w = {n: v.astype(np.float64) for n, v in network.w.items()}
    draw = np.random.default_rng(4)
    x, y = draw.integers(0, 256, (5, 40), dtype=np.uint8), np.array([0, 1, 1, 0, 1])
    found = network._gradients(x, y)

    def loss():
        return -np.log(network._forward(x)[3][np.arange(5), y]).mean()

    for name in ("conv2", "bias3", "conv4", "out", "out_bias", "emb"):
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        was = network.w[name][at]
        network.w[name][at] = was + 1e-6
        more = loss()
        network.w[name][at] = was - 1e-6
        less = loss()
        network.w[name][at] = was
        assert np.isclose((more - less) / 2e-6, found[name][at], rtol=1e-3, atol=1e-7)


def test_windows_cover_the_whole_text():
    texts = [b"", b"a", b"b" * language.WINDOW, b"c" * (2 * language.WINDOW + 5)]
    x, whose, size = language.windows(texts)
    assert whose.tolist() == [0, 1, 2, 3, 3, 3]
    assert size.tolist() == [1, 1, language.WINDOW, language.WINDOW, language.WINDOW, 5]
    assert b"".join(x[whose == 3].tobytes().rstrip(b"\0") for _ in [0]) == texts[3]


def test_noise_holds_no_script_that_is_learned():
    greek = "Αυτό είναι ένα κείμενο".encode()
    x, _, _ = language.windows([greek * 5, b"plain text " * 20])
    made = language.noise_windows(x, 400)
    assert made.shape == (400, language.WINDOW) and (made == language.noise_windows(x, 400)).all()
    letters = "".join(row.tobytes().decode("utf-8", "ignore") for row in made[3::4])
    assert any("А" <= c <= "р" for c in letters) and not any("Ͱ" <= c < "Π" for c in letters)


def test_few_beginnings_of_texts_are_noise(documents):
    network = language.fit(documents, noise=True)
    _, x, _ = language.training_windows(documents, "doc_id", "text", "lang")
    assert 0.5 <= network.limit < 1
    short = np.where(np.arange(language.WINDOW) < 40, x, 0).astype(np.uint8)
    assert (network.probabilities(short, network.tables())[:, -1] > network.limit).mean() <= 0.01

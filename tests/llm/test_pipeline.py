"""Every stage of the pipeline on what the one before it kept, and the rows at its end."""

import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import language, mixing
from tallyframe.llm.common import stored
from tests.conftest import SMALL
from tests.llm.test_packing import check as check_packing
from tests.llm.test_simhash import expected


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), name)
        seen[name] = docs
    return seen


def test_columns(stages):
    want = ["doc_id", "text", "lang", "source", "n_chars"]
    assert list(stages) == ["documents", "language", "near_copies", "personal_data", "mix", "packing"]
    assert all(stages[n].columns == want and stages[n].dtypes == stages["documents"].dtypes for n in list(stages)[:-1])


def test_language_keeps_what_has_a_language(stages):
    before, after = stages["documents"].count(), stages["language"].count()
    assert 0.98 * before <= after <= before
    gone = stages["documents"].join(stages["language"], "doc_id", "left_anti")
    told = gone.select(language.predicted(gone["text"], language.fit(stages["documents"], noise=True)).alias("t")).collect()
    assert all(r["t"]["lang_pred"] == "und" for r in told)


def test_language_rejects_noise_and_unlearned_scripts(spark, stages):
    draw = random.Random(3)
    letters = string.ascii_letters + string.digits + "+/"
    bad = ["".join(draw.choices(letters, k=draw.randint(60, 900))) for _ in range(40)]
    bad += [" ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(2, 9))) for _ in range(60)) for _ in range(40)]
    bad += [x * 5 for x in (
        "Это пример текста на русском языке, которого никто не учил. ", "Αυτό είναι ένα κείμενο στα ελληνικά. ", "זהו טקסט בעברית שאיש לא למד ",
        "これは日本語の文章です。学習されていない。", "这是一个没有学过的语言的文本。",
    )]
    docs = stages["documents"]
    more = spark.createDataFrame([(10**9 + i, x) for i, x in enumerate(bad)], "doc_id long, text string")
    kept = corpus_pipeline.known_language(spark, docs.unionByName(more, allowMissingColumns=True), SMALL)
    assert kept.filter(f"doc_id >= {10**9}").count() <= 0.05 * len(bad)
    assert kept.filter(f"doc_id < {10**9}").count() >= 0.99 * docs.filter("text rlike '\\\\p{L}'").count()


def test_language_without_labels_keeps_texts(stages):
    docs = stages["documents"].withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.known_language(docs.sparkSession, docs, SMALL)
    assert kept.count() == stages["documents"].filter("text rlike '\\\\p{L}'").count()


def test_one_of_each_group(stages):
    rows = [tuple(r) for r in stages["language"].select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in stages["near_copies"].collect()} == {c for _, _, c in expected(rows)}


def test_personal_data_goes_and_nothing_else(stages):
    old = {r["doc_id"]: r["text"] for r in stages["near_copies"].collect()}
    new = stages["personal_data"].collect()
    assert {r["doc_id"] for r in new} == set(old)
    assert all(r["n_chars"] == len(r["text"]) for r in new)
    assert not any("@mail" in r["text"] and ".example.com" in r["text"] for r in new)
    assert sum(r["text"] != old[r["doc_id"]] for r in new) < 0.2 * len(new)


def test_mix(stages):
    times = {r["doc_id"]: r["times"] for r in mixing.mix(stages["personal_data"]).collect()}
    assert Counter(r["doc_id"] for r in stages["mix"].collect()) == Counter({i: n for i, n in times.items() if n})


def test_packing(stages, tokenizer):
    check_packing(stages["mix"], tokenizer)
    assert stages["packing"].select("doc_id").distinct().count() == stages["mix"].select("doc_id").distinct().count()


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.drop("sequence_id", "offset").collect())) == sorted(map(tuple, stages["packing"].drop("sequence_id", "offset").collect()))

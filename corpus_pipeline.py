"""From raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it to the shared folder and
reads it back for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.functions.roles import quoted
from tallyframe.llm import language, mixing, packing, pii, simhash
from tallyframe.llm.common import stored

#: What the surrogates are drawn with; a secret of whoever runs it.
PII_KEY = "an example key"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those that are more like noise than like a language of ``docs``; without any label, only the first."""
    network = language.fit(docs, noise=True)
    if not network.labels:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    return docs.withColumn("_told", language.predicted(F.col("text").cast("string"), network)).filter(F.col("_told.lang_pred") != language.UNKNOWN).drop("_told")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, words_in_shingle=3, radius=3)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = pii.replace(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long"))
    return replaced.select(*[quoted(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.repeated(mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)).select(*[quoted(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("personal_data", without_personal_data),
    ("mix", mixed),
    ("packing", packed),
]

#: SQL can say neither the network nor the tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

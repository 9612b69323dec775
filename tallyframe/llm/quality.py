"""Quality rules whose thresholds come from the data: quantile sketches per language and source.

A sketch counts values in bins that keep the first seven binary digits, so a
quantile is known to within 1/64 of itself. Sketches are merged by adding their
counts, whatever the order, and rerunning gives the same thresholds. A group that
is too small takes the thresholds of its language, and a small language those of all.

No threshold is a constant: how far a group's texts spread is the distance of its
quartiles, or what a single occurrence makes in its median text where that is more,
so that a measure that most texts have none of tolerates a few in a text of usual size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.roles import quoted
from .common import joined, ship, stored

SPACE, SYMBOLS, CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_echoes")
#: Measures of a text, as whole numbers: numerator, denominator, factor. Repeated words have their own fixed rule.
MEASURES = {
    "word_length": ("word_chars", "n_words", 100),
    "symbols": ("n_symbols", "n_words", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "capitals": ("n_capitals", "word_chars", 1000),
    "echoes": ("n_echoes", "n_words", 1000),
}
#: What measures are shares of; their medians tell the size of a group's usual text.
SIZES = ("n_words", "n_lines", "word_chars")
DIGITS = 7


def counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a text; all 0 for a missing one."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    bare = data.translate(None, SPACE)
    lines = [line for line in data.split(b"\n") if line.strip()]
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    return (
        n,
        len(text) - (len(data) - len(bare)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(bare) - len(bare.translate(None, CAPITALS)),
        int((ids[1:] == ids[:-1]).sum()),
    )


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window of words that is found twice or more; words by 64-bit hashes."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    ordered = np.sort(rolled)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    starts = np.isin(rolled, again).astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(np.concatenate((starts, np.zeros(window - 1, np.int64))))))
    at = np.arange(len(ids))
    return int((upto[at + 1] > upto[np.maximum(at - window + 1, 0)]).sum())


def counted(texts: Column) -> Column:
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in column], columns=list(COUNTS), dtype="int64")

    return count(texts)


def binned(value: Column) -> Column:
    """The least number with the same first binary digits, for whole numbers from 0."""
    drop = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, measure, bin, n): the sketch of each value in each group. Tasks count before the shuffle."""
    measured = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), binned(F.col(v)).alias("bin")) for v in values])).alias("m"))
    return measured.groupBy(*keys, "m.measure", "m.bin").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, measure, rows, q1, q2, q3). A group has as many rows as bins, which are some hundreds."""
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketches.withColumn("_upto", upto).withColumn("_rows", F.sum("n").over(group))
    at = [F.min(F.when(F.col("_upto") * 4 >= F.col("_rows") * k, F.col("bin"))).alias(f"q{k}") for k in (1, 2, 3)]
    return ranked.groupBy(*keys, "measure").agg(F.max("_rows").alias("rows"), *at)


def fences(rows: DataFrame, least_rows: int, reach: int) -> DataFrame:
    """(_group, and low_/high_ of each measure) for each pair of ``_lang`` and ``_source`` in ``rows``."""
    by_source = stored(sketch(rows, ["_lang", "_source"], [*MEASURES, *SIZES]), "quality-sketches")
    levels = []
    for keys in (["_lang", "_source"], ["_lang"], []):
        found = quartiles(merged(by_source, keys), keys).groupBy(*keys).agg(
            F.max("rows").alias("_rows"),
            *[F.max(F.when(F.col("measure") == v, F.col(q))).alias(f"{q}_{v}") for v in (*MEASURES, *SIZES) for q in ("q1", "q2", "q3")],
        )
        ends = []
        for m, (_, size, factor) in MEASURES.items():
            once = F.ceil(F.lit(factor) / F.greatest(F.col(f"q2_{size}"), F.lit(1)))
            spread = F.greatest(F.col(f"q3_{m}") - F.col(f"q1_{m}"), once)
            ends += [(F.col(f"q1_{m}") - reach * spread).alias(f"low_{m}"), (F.col(f"q3_{m}") + reach * spread).alias(f"high_{m}")]
        levels.append(found.select(*keys, "_rows", *ends))
    own, lang, every = levels
    limits = [f"{side}_{m}" for m in MEASURES for side in ("low", "high")]
    lang = lang.filter(F.col("_rows") >= least_rows).select("_lang", F.struct(*limits).alias("_of_lang"))
    every = every.select(F.struct(*limits).alias("_of_all"))
    found = own.join(lang, "_lang", "left")
    of_all = every.first()  # one row
    of_all = F.struct(*[F.lit(None if of_all is None else of_all["_of_all"][c]).cast("long").alias(c) for c in limits])
    best = F.when(F.col("_rows") >= least_rows, F.struct(*limits)).otherwise(F.coalesce(F.col("_of_lang"), of_all))
    found = found.select(F.concat_ws("\0", "_lang", "_source").alias("_group"), best.alias("_b"))
    return stored(found.select("_group", "_b.*"), "quality-fences")


def rate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_words: int = 20,
    most_repeats: int = 30,
    least_rows: int = 30,
    reach: int = 5,
) -> DataFrame:
    """(id, counts, base_failed, kept): one row per row of ``docs``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeats``
    percent of them repeated. Of the others those are kept whose measures all lie
    within the quartiles of their language and source, widened by ``reach`` times their
    distance, or times what one occurrence makes in a text of the group's median size if
    that is more. Groups of fewer than ``least_rows`` rows look to their language, and that to
    all. A missing language or source is a group of its own; a missing text has no words.
    Texts are counted whole, however long; repeated rows count as often as they come; other
    columns of ``docs``, whatever their names, are not looked at. No rows in, no rows out.
    """
    ship(docs.sparkSession)
    name = docs.select(quoted(id_col)).columns[0]
    # Prefixed, so that a missing value differs from any text.
    group = [F.coalesce(F.concat(F.lit("="), quoted(c).cast("string")), F.lit("")).alias(a) for c, a in ((lang_col, "_lang"), (source_col, "_source"))]
    found = docs.select(quoted(id_col).alias("_id"), *group, counted(quoted(text_col).cast("string")).alias("_c"))
    rows = found.select("_id", "_lang", "_source", "_c.*")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    measures = [F.floor(k * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long").alias(m) for m, (a, b, k) in MEASURES.items()]
    rows = stored(rows.select("*", failed.alias("base_failed"), *measures), "quality-counts")
    limits = fences(rows.filter("not base_failed"), least_rows, reach)
    placed = joined(rows.withColumn("_group", F.concat_ws("\0", "_lang", "_source")), limits, "_group", "left")
    within = F.lit(True)
    for m in MEASURES:
        within = within & F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    return placed.select(F.col("_id").alias(name), *COUNTS, "base_failed", kept.alias("kept"))

"""The forest learns from all rows, and grows alike however its rows are spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import forest, models
from tallyframe.session import new_folder


@pytest.fixture(scope="module")
def many(spark):
    """12,000 rows; one in 400 churns by itself, all others by the stripe of ``a``."""
    i = F.col("id")
    a, b = F.pmod(i * 7919, F.lit(12_000)) / 10, F.pmod(i * i * 31 + i * 17, F.lit(997))
    churn = F.when(i % 400 == 7, 1).otherwise((F.floor(a / 150) % 2).cast("int"))
    return spark.range(12_000).select(i.alias("row_id"), a.alias("a"), b.cast("double").alias("b"), (i % 5).cast("double").alias("c"), churn.alias("churn")).cache()


@pytest.fixture(scope="module")
def cells(many):
    n = [F.sum(((F.col("row_id") % 5 < 4) & (F.col("churn") == c)).cast("long")).alias(f"_n{c}") for c in (0, 1)]
    return many.groupBy(F.col("a").alias("_x0"), F.col("b").alias("_x1"), F.col("c").alias("_x2")).agg(*n).cache()


def roots(spark, model):
    """How many rows each tree drew, from the two counts of its root."""
    top = spark.read.parquet(f"{model.folder}/nodes").filter("node = 1").collect()
    return [int(np.frombuffer(r["n0"], np.uint32)[0]) + int(np.frombuffer(r["n1"], np.uint32)[0]) for r in top]


def test_every_row_that_is_not_held_out_is_learned_from(spark, many):
    model = models.predict_churn(many, exclude=["row_id"], trees=8, keep=new_folder(spark, "kept"))
    held_out = sum(r["support"] for r in model.report.collect())
    assert held_out == pytest.approx(2_400, abs=2)
    learned = 12_000 - held_out
    drawn = roots(spark, model)
    assert len(drawn) == 8 and len(set(drawn)) > 1
    assert all(abs(n - learned) < 6 * learned ** 0.5 for n in drawn)  # a sample of 4,000 rows would be far off
    assert model.scores.count() == 12_000


def test_report_comes_from_all_rows(spark, many):
    """Stripes whose edges are where cuts of all rows are; all held-out rows are tested."""
    model = models.predict_churn(many, exclude=["row_id"], trees=20)
    report = {r["class"]: r for r in model.report.collect()}
    truth = many.agg(F.sum("churn")).first()[0]
    assert report["Churned"]["support"] == pytest.approx(truth / 5, abs=1)
    assert model.accuracy > 97


def test_cuts_are_those_of_all_training_rows(spark, cells, monkeypatch):
    """As sorting all values gives them, in however many parts they are sorted; a feature of few values has a cut between any two."""
    found = forest.cut_points(cells, 3)
    monkeypatch.setattr(forest, "ROWS_PER_SORTED_PART", 700)
    assert forest.cut_points(cells, 3) == found
    rows = cells.filter("_n0 + _n1 > 0").toPandas()
    assert found[2] == [0.5, 1.5, 2.5]  # no training row has 4
    for i in (0, 1):
        values = np.sort(np.repeat(rows[f"_x{i}"].to_numpy(), (rows["_n0"] + rows["_n1"]).to_numpy()))
        kinds, first, n = np.unique(values, return_index=True, return_counts=True)
        bins = np.floor((first + n / 2) * forest.BINS / len(values))
        edges = np.flatnonzero(np.diff(bins))
        assert found[i] == pytest.approx(list((kinds[edges] + kinds[edges + 1]) / 2))
        assert len(found[i]) == forest.BINS - 1


def test_tops_grown_across_the_cluster_are_those_of_one_task(spark, cells, monkeypatch):
    """Groups of 700 rows and a batch per tree, against each tree in one task: the same nodes, scores and gains."""

    def grown(**limits):
        folder = new_folder(spark, "forest")
        gains = forest.grow(cells, 3, 6, 30, 42, folder, **limits)
        nodes = forest.nodes(spark, folder).collect()
        return gains, sorted(map(tuple, nodes), key=str), {tuple(r) for r in forest.scores(spark, folder, 3).collect()}

    gains, nodes, scores = grown()
    monkeypatch.setattr(forest, "PAIRS_PER_BATCH", 1)
    monkeypatch.setattr(forest, "ROWS_PER_BLOCK", 900)
    again = grown(group_rows=700)
    assert again[1] == nodes and again[2] == scores
    assert again[0] == pytest.approx(gains, rel=1e-12) and sum(gains) == pytest.approx(1)
    assert len(scores) == cells.count()


def test_trees_end_in_pure_leaves_or_where_no_cut_is_left(spark, cells):
    """Walked by hand: a leaf's share is that of the rows drawn, and rows of both classes in it lie in the same bins."""
    folder = new_folder(spark, "forest")
    forest.grow(cells, 3, 3, 30, 42, folder)
    known = spark.read.parquet(f"{folder}/cuts").first()
    rows = cells.withColumn("hash", F.xxhash64("_x0", "_x1", "_x2")).toPandas()
    bins = np.stack([np.searchsorted(c, rows[f"_x{i}"]) for i, c in enumerate(known["cuts"])])
    nodes = {(r["tree"], r["id"]): r for r in forest.nodes(spark, folder).collect()}
    for tree in range(3):
        drawn = [forest.drawn(rows["hash"].to_numpy().astype(np.uint64), rows[f"_n{c}"].to_numpy(), 42, tree, c) for c in (0, 1)]
        ends: dict = {}
        for k in range(len(rows)):
            at = 1
            while nodes[tree, at]["feature"] is not None:
                at = 2 * at + int(rows[f"_x{int(nodes[tree, at]['feature'])}"][k] > nodes[tree, at]["cut"])
            ends.setdefault(at, []).append(k)
        for at, inside in ends.items():
            n0, n1 = [d[inside].sum() * w for d, w in zip(drawn, known["weights"])]
            assert nodes[tree, at]["churned"] == pytest.approx(n1 / (n0 + n1))
            bagged = [k for k in inside if drawn[0][k] + drawn[1][k]]
            assert n0 == 0 or n1 == 0 or len({tuple(bins[:, k]) for k in bagged}) == 1
        assert len(ends) > 40


def test_draws_are_a_bootstrap(spark):
    """Mean and variance of the draws are the copies, also of many; trees and classes draw by themselves."""
    hashes = np.random.default_rng(3).integers(0, 2 ** 63, 40_000).astype(np.uint64)
    for copies in (1, 5, 12, 13, 400):
        n = np.full(len(hashes), copies)
        one, other = [forest.drawn(hashes, n, 42, tree, 0).astype(float) for tree in (0, 1)]
        assert one.mean() == pytest.approx(copies, abs=6 * (copies / len(n)) ** 0.5 + 0.01)
        assert one.var() == pytest.approx(copies, rel=0.05)
        assert abs(np.corrcoef(one, other)[0, 1]) < 0.03
    assert not forest.drawn(hashes, np.zeros(len(hashes), int), 42, 0, 0).any()
    assert (forest.drawn(hashes[::-1], np.ones(len(hashes), int), 42, 0, 0)[::-1] == forest.drawn(hashes, np.ones(len(hashes), int), 42, 0, 0)).all()


def test_prediction_rows_read_the_same_forest(spark, many):
    dated = many.select("*", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("row_id") % 700).cast("int")), "yyyy-MM-dd").alias("date"), (F.col("a") + 1).alias("revenue"))
    folder = new_folder(spark, "kept")
    model = models.predict_churn(dated, exclude=["row_id"], keep=folder)
    assert all(abs(n - 9_600) < 6 * 98 for n in roots(spark, model))
    rows = {r["prediction_type"]: r for r in models.all_prediction_rows(dated, "now", exclude=["row_id"], keep=folder).collect()}
    high = model.scores.filter("risk_level = 'High'").count()
    assert f"High Risk: {high}" in rows["Churn Prediction"]["summary"] and rows["Churn Prediction"]["accuracy"] == model.accuracy

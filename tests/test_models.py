"""Models have no exact counterpart: their properties are checked, and simple cases by hand."""

import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.roles import MissingRole
from tallyframe.operators import models
from tallyframe.session import new_folder


@pytest.fixture(scope="module")
def customers(spark):
    """Churn follows from low engagement; gaps and text columns included."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        engagement = float(rng.integers(0, 100))
        churn = int(engagement < 30)
        plan = [None, "Pro", "Starter"][int(rng.integers(0, 3))]
        revenue = 10 * engagement + float(rng.normal(0, 5))
        rows.append((i, plan, None if i % 50 == 0 else engagement, revenue, churn, 3 * revenue + 7))
    return spark.createDataFrame(
        rows, "row_id int, plan string, engagement double, revenue double, churn int, ltv double"
    ).cache()


@pytest.fixture(scope="module")
def churn(customers):
    return models.predict_churn(customers, exclude=["row_id"], trees=20)


def test_churn_scores(customers, churn):
    rows = churn.scores.collect()
    assert len(rows) == 400 and len({r["row_id"] for r in rows}) == 400
    for r in rows:
        p = r["churn_probability"]
        assert 0 <= p <= 1 and round(p, 3) == p
        assert r["predicted_churn"] == int(p >= 0.5)
        expected = None if p == 0 else "Low" if p <= 0.3 else "Medium" if p <= 0.6 else "High"
        assert r["risk_level"] == expected
    truth = {r["row_id"]: r["churn"] for r in customers.collect()}
    assert np.mean([truth[r["row_id"]] == r["predicted_churn"] for r in rows]) > 0.95
    assert churn.accuracy > 90


def test_churn_importance_and_report(churn):
    importance = [tuple(r) for r in churn.importance.collect()]
    assert {name for name, _ in importance} == {"plan", "engagement", "revenue", "ltv"}
    assert sum(v for _, v in importance) == pytest.approx(1)
    assert importance == sorted(importance, key=lambda r: -r[1])
    report = {r["class"]: r for r in churn.report.collect()}
    assert sum(r["support"] for r in report.values()) == 80  # a fifth of 400
    assert report["Churned"]["accuracy"] == churn.accuracy


def test_same_seed_same_scores(customers, churn):
    again = models.predict_churn(customers, exclude=["row_id"], trees=20)
    assert again.accuracy == churn.accuracy
    assert {tuple(r) for r in again.scores.collect()} == {tuple(r) for r in churn.scores.collect()}


SEEDED = """
import json, sys
from tallyframe.session import build_session
from tallyframe.operators import models
from tallyframe.plans.models import KEYS, modelled
spark = build_session("seeded", sys.argv[1], **{"spark.sql.shuffle.partitions": sys.argv[2], "spark.ui.enabled": "false"})
df = modelled(spark, "/root/testdata/sf0.001")
churn = models.predict_churn(df, exclude=KEYS, trees=10, training_rows=700)
found = models.segment_users(df, exclude=KEYS, restarts=3)
print("RESULT" + json.dumps([
    churn.accuracy, sorted(map(list, churn.importance.collect())), found.passes,
    sorted([r["row_id"], r["churn_probability"]] for r in churn.scores.collect()),
    sorted([r["row_id"], r["segment"]] for r in found.rows.collect()),
]))
"""


def test_same_model_on_any_number_of_cores():
    results = []
    for master, parts in (("local[2]", "3"), ("local[5]", "8")):
        run = subprocess.run([sys.executable, "-c", SEEDED, master, parts], capture_output=True, text=True, timeout=600)
        results.append(json.loads(run.stdout.split("RESULT")[1]))
    assert results[0] == results[1]
    passes = results[0][2]
    assert len(passes) == 3 and all(1 < n < models.ITERATIONS for n in passes)


def test_weights_come_from_training_rows(customers):
    """Scores cover all rows however few are learned from."""
    few = models.predict_churn(customers, exclude=["row_id"], trees=5, training_rows=60)
    assert few.scores.count() == 400
    assert sum(r["support"] for r in few.report.collect()) == 80


def test_a_rare_class_is_learned_from_and_copies_are_dealt(spark):
    """One churned row in 10,000, and copies of one row that are a third of the others."""
    rows = spark.range(100_000).select(
        F.array(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double"))).alias("v"), (F.col("id") % 10_000 == 1).cast("int").alias("_label"))
    rows = rows.select(models.array_to_vector("v").alias("_features"), "_label", models.value_hash(["v", "_label"]).alias("_hash"))
    learned = models.training_sample(rows, 4000).collect()
    assert sum(r["_label"] for r in learned) == rows.filter("_label = 1").count() == 10
    assert 3000 < len(learned) < 8500
    copies = [r for r in learned if r["_features"][0] == 0.0 and r["_label"] == 0]
    assert len(copies) < 4100 and len({r["_hash"] for r in copies}) == len(copies)


def test_churn_guards(spark, customers):
    with pytest.raises(MissingRole):
        models.predict_churn(customers.drop("churn"))
    with pytest.raises(models.NotReady, match="one class"):
        models.predict_churn(customers.withColumn("churn", F.lit(0)))
    with pytest.raises(models.NotReady, match="20 rows"):
        models.predict_churn(customers.orderBy("engagement").filter("row_id < 15"))
    with pytest.raises(models.NotReady, match="2 numeric"):
        models.predict_churn(customers.select("churn", "revenue"))
    assert [models.test_share(n) for n in (20, 60, 80, 1000)] == [0.4, 1 / 3, 0.25, 0.2]


def test_nothing_but_copies(spark):
    """Copies stay together, so there may be no test row: then no accuracy was measured."""
    rows = [(1, 1.0, 2.0, 3.0)] * 30 + [(0, 5.0, 6.0, 7.0)] * 30
    df = spark.createDataFrame(rows, "churn int, a double, b double, ltv double")
    model = models.predict_churn(df, trees=5)
    assert model.scores.count() == 60 and model.accuracy is None
    assert {(r["churn"], r["predicted_churn"]) for r in df.join(model.scores, ["a", "b", "ltv"]).select(
        df["churn"], "predicted_churn").collect()} == {(0, 0), (1, 1)}
    assert models.predict_clv(df).metrics.first()["mae"] is None


def test_clv_finds_the_line(customers):
    model = models.predict_clv(customers.select("row_id", "revenue", "ltv"), exclude=["row_id"])
    rows = model.scores.collect()
    assert len(rows) == 400
    for r in rows:
        assert r["predicted_clv"] == pytest.approx(max(0, r["actual_clv"]), abs=0.02)
    top, low = max(r["predicted_clv"] for r in rows), min(r["predicted_clv"] for r in rows)
    step = (top - low) / 3
    assert all(
        r["clv_segment"] == ("Low Value" if r["predicted_clv"] <= low + step
                             else "Mid Value" if r["predicted_clv"] <= low + 2 * step else "High Value")
        for r in rows
    )
    metrics = model.metrics.first()
    assert (metrics["mae"], metrics["r2"]) == (pytest.approx(0, abs=0.01), 100.0)


def test_clv_equals_least_squares(customers):
    """All rows, several features: as the normal equations on the training rows give it."""
    from tallyframe.operators.split import stratified_holdout, value_hash

    df = customers.select("row_id", "engagement", "churn", "revenue").fillna(50.0, ["engagement"])
    model = models.predict_clv(df, exclude=["row_id"])
    typed = df.select(F.col("engagement"), F.col("churn").cast("double"), F.col("revenue"), F.lit(0).alias("all"), "row_id")
    row = value_hash(["engagement", "churn", "revenue"])
    marked = stratified_holdout(typed, row, "all", models.CLV_TEST_SHARE).toPandas()
    train = marked[~marked["is_test"]]
    design = lambda f: np.column_stack([np.ones(len(f)), f["engagement"], f["churn"]])
    solution, *_ = np.linalg.lstsq(design(train), train["revenue"].to_numpy(), rcond=None)
    expected = dict(zip(marked["row_id"], np.maximum(0, design(marked) @ solution)))
    for r in model.scores.collect():
        assert r["predicted_clv"] == pytest.approx(expected[r["row_id"]], abs=0.006)


def test_normal_equations_of_dependent_and_far_apart_columns(spark):
    """To 1e-9 of a plain solution; a column that others explain, or that never changes, gets no weight."""
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(1e6, 30, 500), rng.normal(0, 1e-3, 500), rng.integers(0, 5, 500).astype(float)
    y = 3 * a - 2e4 * b + 7 * c + rng.normal(0, 0.5, 500)
    rows = [tuple(map(float, r)) for r in zip(a, b, a + c, c, np.full(500, 4.0), y)]
    df = spark.createDataFrame(rows, "a double, b double, sum double, c double, same double, y double").repartition(7)
    got = models.least_squares(df, ["a", "b", "sum", "c", "same"], "y").first()
    assert got["weights"][3:] == [0.0, 0.0]
    x = np.column_stack([a, b, a + c])
    centred = x - x.mean(0)
    plain = np.linalg.lstsq(centred / centred.std(0), y - y.mean(), rcond=None)[0] / centred.std(0)
    assert got["weights"][:3] == pytest.approx(list(plain), rel=1e-9)
    assert got["base"] == pytest.approx(y.mean() - plain @ x.mean(0), rel=1e-7)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        centre = (i % 3) * 100.0
        rows.append((i, f"g{i % 3}", centre + float(rng.normal()), -centre + float(rng.normal()), 1))
    return spark.createDataFrame(rows, "row_id int, name string, revenue double, visits double, same int").cache()


def test_segments_find_the_groups(blobs):
    found = models.segment_users(blobs, 3, exclude=["row_id", "name"], restarts=3)
    rows = found.rows.collect()
    assert found.rows.columns == [*blobs.columns, "cluster", "segment"]
    assert {(r["name"], r["segment"]) for r in rows} == {("g2", "Champions"), ("g1", "Loyal Customers"), ("g0", "At Risk")}
    assert {(r["segment"], r["rows"]) for r in found.counts.collect()} == {
        ("Champions", 100), ("Loyal Customers", 100), ("At Risk", 100),
    }
    means = {r["segment"]: r["revenue"] for r in found.summary.collect()}
    assert means["Champions"] > means["Loyal Customers"] > means["At Risk"]
    assert found.summary.columns == ["segment", "revenue", "visits"]  # 'same' does not vary


def test_segment_limits(spark, blobs):
    many = models.segment_users(blobs, 20, exclude=["row_id"], restarts=1)
    assert many.k == 8 and many.counts.agg(F.sum("rows")).first()[0] == 300
    labels = {r["segment"] for r in many.counts.collect()}
    assert "Cluster 8" in labels and "Dormant / Lost" in labels
    with pytest.raises(models.NotReady, match="2 numeric"):
        models.segment_users(blobs.select("row_id", "same"))
    few = spark.createDataFrame([(1.0, 5.0), (2.0, 7.0), (3.0, 6.0)], "a double, b double")
    assert models.segment_users(few, 4, restarts=1).k == 2


def test_prediction_rows(customers):
    dated = customers.withColumn("date", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("row_id")), "yyyy-MM-dd"))
    rows = {r["prediction_type"]: r for r in models.all_prediction_rows(dated.drop("plan"), "now", exclude=["row_id"]).collect()}
    assert set(rows) == {
        "Churn Prediction", "Revenue Forecast", "Customer Lifetime Value", "Trend Analysis", "User Segmentation",
    }
    assert rows["Churn Prediction"]["summary"].startswith("Type     : Churn Prediction\nDataset  : 400 rows × 5 columns")
    assert "Segments: " in rows["User Segmentation"]["summary"]
    lines = rows["Trend Analysis"]["summary"].split("\n")
    assert [line.split(":")[0] for line in lines] == ["engagement", "revenue", "churn", "ltv"]
    assert all(line.endswith("%/day)") for line in lines)


# -- kept models ----------------------------------------------------------------------


def test_a_forest_is_fitted_once_and_scores_alike(spark, customers, monkeypatch):
    folder = new_folder(spark, "kept")
    first = models.predict_churn(customers, exclude=["row_id"], trees=5, keep=folder)
    scores = sorted(map(tuple, first.scores.collect()))

    def no_fit(*_):
        raise AssertionError("fitted again")

    monkeypatch.setattr(models, "fit_forest", no_fit)
    # The same rows in another order and with a column that isn't a feature.
    again = models.predict_churn(customers.repartition(3).withColumn("day", F.current_date()), exclude=["row_id"], trees=5, keep=folder)
    assert again.importance.collect() == first.importance.collect() and again.report.collect() == first.report.collect()
    assert again.accuracy == first.accuracy
    assert sorted(map(tuple, again.scores.select(*first.scores.columns).collect())) == scores
    for other in (customers.withColumn("revenue", F.col("revenue") + (F.col("row_id") == 3).cast("int")), customers.drop("engagement")):
        with pytest.raises(AssertionError, match="fitted again"):
            models.predict_churn(other, exclude=["row_id"], trees=5, keep=folder)
    with pytest.raises(AssertionError, match="fitted again"):
        models.predict_churn(customers, exclude=["row_id"], trees=6, keep=folder)


def test_a_forest_as_a_table_scores_as_the_library(spark, customers):
    model = models.predict_churn(customers, exclude=["row_id"], trees=7, keep=new_folder(spark, "kept"))
    nodes = models.forest_table(spark, model.folder)
    inner = nodes.filter("feature is not null")
    assert nodes.select("tree").distinct().count() == 7 and inner.count() + 7 == nodes.count() - inner.count()
    known = models.drop_non_numbers(customers, "churn")
    features = models.feature_frame(known, "churn", ["row_id"], 2, "churn_features")
    rows = models.walked(features.frame, features.names, nodes).select("row_id", F.round("probability", 3).alias("p"))
    assert {tuple(r) for r in rows.collect()} == {(r["row_id"], r["churn_probability"]) for r in model.scores.collect()}


def test_centres_are_a_fixed_point(spark, customers, monkeypatch):
    """Each row has the nearest centre, and each centre is the mean of its rows, worked out with numpy."""
    import numpy as np

    folder = new_folder(spark, "kept")
    names = ["revenue", "engagement", "ltv"]
    df = customers.select("row_id", *names).dropna()
    found = models.segment_users(df, 3, exclude=["row_id"], restarts=2, keep=folder)
    rows = found.rows.select("cluster", *names).collect()
    x = np.array([[float(r[n]) for n in names] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    cluster, centres = np.array([r["cluster"] for r in rows]), np.array(found.centres)
    assert (((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == cluster).all()
    for k in range(3):
        assert np.abs(x[cluster == k].mean(axis=0) - centres[k]).max() < 0.02
    monkeypatch.setattr(models, "_best_clusters", None)
    again = models.segment_users(df, 3, exclude=["row_id"], restarts=2, keep=folder)
    assert sorted(map(tuple, again.rows.collect())) == sorted(map(tuple, found.rows.collect())) and again.passes == found.passes


# -- work that is done once ---------------------------------------------------------------


def test_starts_share_their_passes_and_end_as_the_library_does(spark, customers, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=["engagement", "revenue"], outputCol="_features").transform(
        customers.dropna().select(F.col("engagement") / 50, (F.col("revenue") / 500).alias("revenue")).toDF("engagement", "revenue")
    ).select("_features").persist()
    rows, shared, one = vectors.count(), [], models._shared_pass
    monkeypatch.setattr(models, "_shared_pass", lambda blocks, starts: shared.append(list(starts)) or one(blocks, starts))
    centres, passes = models._best_clusters(vectors, rows, 3, 4, models.ITERATIONS)
    assert len(shared) == max(passes) < sum(passes) and shared[0] == [0, 1, 2, 3]
    fits = [
        KMeans(featuresCol="_features", k=3, seed=models.SEED + s, maxIter=models.ITERATIONS, tol=(models.TOLERANCE / 3) ** 0.5).fit(vectors)
        for s in range(4)
    ]
    assert passes == [f.summary.numIter for f in fits]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    assert np.abs(np.array(centres) - np.array(best.clusterCenters())).max() < 1e-9


@pytest.mark.parametrize("use", [
    lambda df: models.predict_churn(df, exclude=["row_id"], trees=3).scores.collect(),
    lambda df: [f.collect() for f in models.segment_users(df, 3, exclude=["row_id"], restarts=2)[:3]],
    lambda df: models.all_prediction_rows(df, "now", exclude=["row_id"]).collect(),
], ids=["churn", "segments", "prediction_rows"])
def test_rows_are_worked_out_once(spark, customers, use):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        made.add(1)
        return value

    dated = customers.withColumn("date", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("row_id")), "yyyy-MM-dd"))
    use(dated.withColumn("revenue", counted("revenue")))
    assert made.value == 400


def test_no_median_for_a_column_without_gaps(spark, monkeypatch):
    from tallyframe.operators import profile

    asked, quantiles = [], profile.exact_quantiles
    monkeypatch.setattr(profile, "exact_quantiles", lambda df, columns, points: asked.append(list(columns)) or quantiles(df, columns, points))
    df = spark.createDataFrame([(1.0, 2.0, None), (None, 4.0, None), (3.0, 6.0, None)], "gaps double, full double, none double")
    assert sorted(map(tuple, profile.impute_median(df, ["gaps", "full", "none"]).collect())) == [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]
    assert asked == [["gaps", "none"]]
    assert profile.impute_median(df.limit(0), ["gaps", "full"]).columns == ["none"]

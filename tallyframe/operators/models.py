"""Models: churn, lifetime value and user segments, trained and applied on Spark."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.coerce import as_number, drop_non_numbers
from ..functions.kpi import fmt_currency, risk_level
from ..functions.roles import MissingRole, find_role, need_role, numeric_columns, quoted, text_columns
from ..session import new_folder, ship
from . import forest, store
from .encode import label_encode
from .profile import impute_median, varied_columns
from .reports import MESSAGES, MIN_CHURN_ROWS, MIN_CLV_ROWS, report_head
from .split import HASHES, binary_holdout, text_hash, value_hash
from .stats import (
    classification_metrics,
    column_trends,
    forecast_fit,
    regression_metrics,
    revenue_direction,
    with_value_segments,
)

Roles = dict[str, str] | None

# Settings of the models.
SEED = 42
TREES = 100
RESTARTS = 10
ITERATIONS = 300  # the limit; a start ends when the squared shifts of its centres add up to no more than
TOLERANCE = 1e-4  # this, in units of a feature's variance
STARTS_AT_ONCE, FEW_ROWS = 10, 5_000_000
MAX_CLUSTERS = 8
SEGMENT_LABELS = ["Champions", "Loyal Customers", "At Risk", "Dormant / Lost"]
SUMMARY_COLUMNS = 5
TREND_LINES = 10
NAMED_SEGMENTS = 4
CLV_TEST_SHARE = 0.2
# What is left of a feature's variance when the features before it explain it.
DEPENDENT = 1e-10

# Trees grow until their leaves are pure, or to this depth.
TREE_DEPTH = forest.DEEPEST
ROWS_PER_PASS_PART = 50_000
ROWS_PER_BLOCK_PART = 250_000
WEIGHT_STEPS = 1024
# Part of a kept forest's name: one that was kept in another layout is not found.
FOREST_LAYOUT = "nodes and scores of all rows"
KEPT = StorageLevel.MEMORY_AND_DISK


class NotReady(ValueError):
    """The data cannot carry the model; the message says why."""


class Features(NamedTuple):
    frame: DataFrame
    names: list[str]


def feature_frame(df: DataFrame, target: str | None, exclude: Sequence[str], at_least: int, problem: str) -> Features:
    """Text encoded, gaps filled with medians; all other columns stay as they are.

    A column named in ``exclude`` is carried along but is no feature.
    """
    skip = [*exclude, *([target] if target else [])]
    encoded = label_encode(df, text_columns(df, skip))
    names = numeric_columns(encoded, skip)
    if len(names) < at_least:
        raise NotReady(MESSAGES[problem])
    filled = impute_median(encoded, names)
    return Features(filled, [n for n in names if n in filled.columns])


def assembled(features: Features) -> DataFrame:
    return VectorAssembler(inputCols=features.names, outputCol="_features").transform(features.frame)


def arranged(df: DataFrame, rows: int, per_part: int, key: str) -> DataFrame:
    """``df`` in partitions that its rows decide: dealt by a hash, sorted inside.

    Bagging and starting points follow the partitions, so the same rows give the
    same model on any number of cores.
    """
    return df.repartition(rows // per_part + 1, key).sortWithinPartitions(key)


def stored(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` as a table in the shared folder, so that the many passes over it don't work it out again."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written(features: Features) -> Features:
    return features._replace(frame=stored(features.frame, "features"))


# -- kept models ---------------------------------------------------------------------


def content_key(df: DataFrame, exclude: Sequence[str], *settings) -> str:
    """A name for what a model is made of: the numbers and texts of ``df`` in any order, and its settings."""
    names = sorted({*numeric_columns(df, exclude), *text_columns(df, exclude)})
    columns = [quoted(c) for c in names]
    # Two sums of independent hashes, so that swapping values between rows can't go unseen.
    hashes = [F.xxhash64(F.lit(salt), *columns).cast("decimal(38)") for salt in (1, 2)]
    whole = df.agg(F.count(F.lit(1)), *[F.sum(h) for h in hashes]).first()
    kinds = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name in names]
    return hashlib.md5(json.dumps([kinds, list(map(str, whole)), settings]).encode()).hexdigest()


def kept(spark: SparkSession, folder: str | None, name: Callable[[], str], fit: Callable[[str | None], dict]) -> dict:
    """What ``fit`` found out, once for each name below ``folder``; anew without a folder.

    ``fit`` gets a folder of its own for what is large. The file that names it comes last and whole, so a
    model that is found is complete; of two jobs that fit at once, one's counts.
    """
    if folder is None:
        return fit(None)
    path = f"{folder}/models/{name()}.json"
    text = store.read_text(spark, path)
    if text is None:
        store.publish(spark, json.dumps(fit(f"{folder}/models/{uuid.uuid4().hex}")), path)
        text = store.read_text(spark, path)
    return json.loads(text)


# -- churn ---------------------------------------------------------------------------


class ChurnModel:
    """A fitted forest: what is known of it, and the scores of all rows once they are asked for."""

    def __init__(self, spark: SparkSession, facts: dict, score: Callable[[], DataFrame]) -> None:
        self._spark, self._facts, self._score = spark, facts, score
        self.folder = facts["forest"]  # where it is kept; None if it isn't

    @cached_property
    def scores(self) -> DataFrame:
        """Every row with churn_probability, predicted_churn, risk_level."""
        return self._score()

    @property
    def importance(self) -> DataFrame:
        """(feature, importance), most important first."""
        return self._spark.createDataFrame([tuple(r) for r in self._facts["importance"]], "feature string, importance double")

    @property
    def report(self) -> DataFrame:
        """Precision, recall, F1, support per class on the test rows."""
        schema = "class string, precision double, recall double, f1 double, support long, accuracy double"
        return self._spark.createDataFrame([tuple(r) for r in self._facts["report"]], schema)

    @property
    def accuracy(self) -> float | None:
        """Percent on the test rows; None if there are none."""
        return self._facts["report"][0][-1]


def test_share(rows: int) -> float:
    """Fixed rule: 20 rows, but between 20 and 40 percent."""
    return max(0.2, min(0.4, 20 / rows))


def training_sample(rows: DataFrame, training_rows: int) -> DataFrame:
    """About ``training_rows`` of ``rows`` (_features, _label, _hash) with a _weight, chosen by their hash.

    Only for callers who ask for a bound. Each class gets half, and what the other one leaves of its half, so a rare
    class is learned from whole. Distinct rows are chosen; copies count, but of
    more rows than a class may have, several are one row of more weight.
    """
    found = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.approx_count_distinct("_hash", 0.01).alias("n")).collect()}  # two rows
    quotas = {c: max(training_rows // 2, training_rows - found.get(1 - c, 0)) for c in (0, 1)}
    # Estimates are one or a few percent off; a class that fits is taken whole.
    shares = {c: HASHES if n <= 1.05 * quotas[c] else int(HASHES * quotas[c] / n) + 1 for c, n in found.items()}

    def by_class(values: dict[int, int]) -> Column:
        return F.when(F.col("_label") == 1, values.get(1, 0)).otherwise(values.get(0, 0))

    chosen = F.shiftrightunsigned(F.xxhash64("_hash", F.lit("training")), 32) < by_class(shares)
    values = vector_to_array("_features").alias("_values")
    distinct = rows.filter(chosen).groupBy("_label", "_hash", values).agg(F.count("*").alias("_copies"))
    copies = {r["_label"]: r["n"] for r in distinct.groupBy("_label").agg(F.sum("_copies").alias("n")).collect()}  # two rows
    pieces = F.greatest(F.lit(1), F.floor(F.least(F.lit(1.0), by_class(quotas) / by_class(copies)) * F.col("_copies"))).cast("int")
    dealt = distinct.withColumn("_pieces", pieces).withColumn("_piece", F.explode(F.sequence(F.lit(1), F.col("_pieces"))))
    weight = F.round(F.col("_copies") / F.col("_pieces") * WEIGHT_STEPS) / WEIGHT_STEPS
    return dealt.select(
        array_to_vector("_values").alias("_features"), "_label", F.xxhash64("_hash", "_piece").alias("_hash"), weight.alias("_weight")
    )


def predict_churn(
    df: DataFrame,
    roles: Roles = None,
    exclude: Sequence[str] = (),
    trees: int = TREES,
    depth: int = TREE_DEPTH,
    training_rows: int | None = None,
    keep: str | None = None,
    is_stored: bool = False,
) -> ChurnModel:
    """A random forest for 'churn is above 0', with both classes weighing the same.

    The forest learns from all rows that aren't held out, or from about ``training_rows`` of them where a caller
    gives that number; the held-out ones are all tested, and all rows are scored.
    With ``keep``, a shared folder, it is fitted once for the same data and settings and loaded from then on.
    The rows are stored first, unless ``is_stored`` says that they are.
    """
    spark, target = df.sparkSession, need_role(df, "churn", roles)
    known = drop_non_numbers(df if is_stored else stored(df), target)
    made: dict = {}

    def features() -> Features:
        if "features" not in made:
            made["features"] = written(feature_frame(known, target, exclude, 2, "churn_features"))
        return made["features"]

    def fit(folder: str | None) -> dict:
        rows, churned = known.agg(F.count(F.lit(1)), F.count_if(quoted(target) > 0)).first()
        ready = features()
        if churned in (0, rows):
            raise NotReady(MESSAGES["churn_classes"])
        if rows < MIN_CHURN_ROWS:
            raise NotReady(MESSAGES["churn_rows"])
        made["forest"] = folder or new_folder(spark, "forest")
        importance, measured = fit_forest(ready, target, rows, trees, depth, training_rows, made["forest"])
        weights = zip(ready.names, importance)
        return {"forest": folder, "importance": sorted(weights, key=lambda r: -r[1]), "report": [list(r) for r in measured]}

    def name() -> str:
        return "churn-" + content_key(known, exclude, target, trees, depth, training_rows, FOREST_LAYOUT)

    facts = kept(spark, keep, name, fit)

    def score() -> DataFrame:
        # A model that another job fitted at the same time counts for all of its results.
        folder = facts["forest"] or made["forest"]
        return forest_scores(features(), folder, [c for c in df.columns if c in features().frame.columns])

    return ChurnModel(spark, facts, score)


def fit_forest(
    features: Features, target: str, rows: int, trees: int, depth: int, training_rows: int | None, folder: str
) -> tuple[list[float], list]:
    """The importance of each feature, and the rows of the report on the held-out rows; the forest is below ``folder``."""
    names, columns = features.names, forest.columns(len(features.names))
    label = (quoted(target) > 0).cast("int")
    held = features.frame.withColumn("_label", label).withColumn("_hash", value_hash([*names, target]))
    is_test = binary_holdout(held, F.col("_hash"), "_label", test_share(rows))
    numbers = [quoted(n).cast("double").alias(c) for n, c in zip(names, columns)]
    learned = F.lit(0) if training_rows else (~is_test).cast("int")
    drawn = held.select(*numbers, "_label", learned.cast("double").alias("_copies"))
    if training_rows:
        known = assembled(features._replace(frame=held)).filter(~is_test).select("_features", "_label", "_hash")
        sample = training_sample(known, training_rows).withColumn("_values", vector_to_array("_features"))
        values = [F.get("_values", F.lit(i)).alias(c) for i, c in enumerate(columns)]
        drawn = drawn.unionByName(sample.select(*values, "_label", F.col("_weight").alias("_copies")))
    of_class = [F.round(F.sum(F.when(F.col("_label") == c, F.col("_copies")).otherwise(0.0))).cast("long") for c in (0, 1)]
    cells = stored(drawn.groupBy(*columns).agg(of_class[0].alias("_n0"), of_class[1].alias("_n1")), "cells")
    importance = forest.grow(cells, len(names), trees, depth, SEED, folder)
    found = forest.scores(features.frame.sparkSession, folder, len(names))
    tested = held.filter(is_test).join(found, forest.same_numbers(names))
    tested = tested.select("_label", (F.col("_probability") > 0.5).cast("int").alias("_predicted"))
    return importance, classification_metrics(tested, "_label", "_predicted").collect()  # two rows


def forest_scores(features: Features, folder: str, columns: Sequence[str]) -> DataFrame:
    """Every row with what the forest below ``folder`` found out for its numbers when it was fitted."""
    scores = forest.scores(features.frame.sparkSession, folder, len(features.names))
    # Rounded first, then compared, so that what is shown decides.
    scored = features.frame.join(scores, forest.same_numbers(features.names))
    return scored.withColumn("churn_probability", F.round("_probability", 3)).select(
        *[quoted(c) for c in columns],
        "churn_probability",
        (F.col("churn_probability") >= 0.5).cast("int").alias("predicted_churn"),
        risk_level(F.col("churn_probability")).alias("risk_level"),
    )


def forest_table(spark: SparkSession, folder: str) -> DataFrame:
    """(tree, node, feature, cut, left, right, churned): a kept forest as rows, a leaf having no feature.

    A row goes left where its feature is at most the cut; churned is the weighted share of churned training
    rows at the node. Nodes are numbered from 0 in each tree.
    """
    number = F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1
    nodes = forest.nodes(spark, folder).withColumn("node", number)
    inner = F.col("feature").isNotNull()
    # The node of an even id is its parent's left one, and the right one comes next.
    lefts = nodes.filter("id % 2 = 0").select("tree", (F.col("id") / 2).cast("long").alias("id"), F.col("node").alias("left"))
    return nodes.join(lefts, ["tree", "id"], "left").select(
        "tree", "node", "feature", "cut", "left", F.when(inner, F.col("left") + 1).alias("right"), "churned"
    )


def walked(rows: DataFrame, names: Sequence[str], nodes: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """``rows`` with probability: the mean over the trees of a ``forest_table`` of churned where the row ends.

    The table goes to the tasks as one value, so this is for forests that a task can hold, to look at them; rows
    aren't moved. ``forest_scores`` has no such bound.
    """
    fields = ["node", "feature", "cut", "left", "right", "churned"]
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("nodes"))
    forest = trees.agg(F.collect_list("nodes").alias("forest")).scalar()
    x = F.array(*[quoted(c).cast("double") for c in names])

    def end(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            side = F.when(F.get(x, tree[at]["feature"]) <= tree[at]["cut"], tree[at]["left"]).otherwise(tree[at]["right"])
            return F.when(tree[at]["feature"].isNull(), at).otherwise(side)

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step, lambda at: tree[at]["churned"])

    shares = F.aggregate(F.transform("_forest", end), F.lit(0.0), lambda s, p: s + p)
    return rows.withColumn("_forest", forest).withColumn("probability", shares / F.size("_forest")).drop("_forest")


# -- lifetime value --------------------------------------------------------------------


class ValueModel(NamedTuple):
    scores: DataFrame  # every row with actual_clv, predicted_clv, clv_segment
    metrics: DataFrame  # one row: mae, r2, avg_predicted_clv


def value_target(df: DataFrame, roles: Roles = None) -> str:
    name = find_role(df, "ltv", roles) or find_role(df, "revenue", roles)
    if name is None:
        raise MissingRole(MESSAGES["ltv"])
    return name


def eliminated(matrix: Column, size: int) -> Column:
    """The solution of a symmetric system of equations, one array per row with the right-hand side at its end.

    Gauss and Jordan's way with the diagonal as pivots. A column that those before it explain (its pivot is
    below ``DEPENDENT``; the matrix is one of correlations) gets 0.
    """

    def step(m: Column, p: Column) -> Column:
        top, pivot = F.get(m, p), F.get(F.get(m, p), p)
        first = F.when(pivot > DEPENDENT, F.transform(top, lambda v: v / pivot)).otherwise(F.transform(top, lambda v: F.lit(0.0)))
        # In an array of one, so that it is worked out once a step.
        return F.flatten(F.transform(F.array(first), lambda f: F.transform(
            m, lambda row, i: F.when(i == p, f).otherwise(F.zip_with(row, f, lambda x, y: x - F.get(row, p) * y))
        )))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)
    return F.transform(done, lambda row: F.element_at(row, -1))


def least_squares(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """One row: (base, weights), of the plane through ``target`` over the columns ``names`` with the least squares.

    All means and covariances come from one aggregate, whose sums are merged without losing digits.
    """
    x, y = [quoted(n).cast("double") for n in names], quoted(target).cast("double")
    places = range(len(x))
    found = df.agg(
        *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(x)], F.avg(y).alias("mean"),
        *[F.covar_pop(x[i], x[j]).alias(f"c_{i}_{j}") for i in places for j in places if i <= j],
        *[F.covar_pop(c, y).alias(f"y_{i}") for i, c in enumerate(x)],
    )
    spread = [F.sqrt(F.col(f"c_{i}_{i}")) for i in places]

    def share(value: Column, by: Column) -> Column:
        return F.coalesce(F.try_divide(value, by), F.lit(0.0))

    rows = [
        F.array(
            *[share(F.col(f"c_{min(i, j)}_{max(i, j)}"), spread[i] * spread[j]) for j in places], share(F.col(f"y_{i}"), spread[i])
        )
        for i in places
    ]
    solved = found.withColumn("solved", eliminated(F.array(*rows), len(x)))
    weights = F.array(*[share(F.get("solved", F.lit(i)), spread[i]) for i in places])
    explained = sum((F.get("weights", F.lit(i)) * F.col(f"mean_{i}") for i in places), F.lit(0.0))
    return solved.withColumn("weights", weights).select((F.col("mean") - explained).alias("base"), "weights")


def predict_clv(
    df: DataFrame, roles: Roles = None, exclude: Sequence[str] = (), held_by: Sequence[str] = (), is_stored: bool = False
) -> ValueModel:
    """Least squares for the lifetime value (or revenue) on all other columns.

    The normal equations take one pass over the rows that aren't held out, and stay in the plan as one row. Rows are held out by
    a hash of their values, or of the columns ``held_by`` as text, which other engines can repeat.
    """
    target = value_target(df, roles)
    known = drop_non_numbers(df if is_stored else stored(df), target)
    features = written(feature_frame(known, target, exclude, 1, "clv_features"))
    if features.frame.count() < MIN_CLV_ROWS:
        raise NotReady(MESSAGES["clv_rows"])
    row = text_hash(held_by) if held_by else value_hash([*features.names, target])
    ready = features.frame.withColumns({"_actual": quoted(target).cast("double"), "_all": F.lit(0), "_hash": row})
    is_test = binary_holdout(ready, F.col("_hash"), "_all", CLV_TEST_SHARE)
    plane = least_squares(ready.filter(~is_test), features.names, "_actual").select(F.struct("base", "weights").alias("plane")).scalar()
    parts = [quoted(n).cast("double") * F.get(F.col("_plane.weights"), F.lit(i)) for i, n in enumerate(features.names)]
    scored = ready.withColumn("_plane", plane).withColumn("_predicted", sum(parts, F.col("_plane.base")))
    scored = scored.withColumn("predicted_clv", F.round(F.greatest(F.lit(0.0), F.col("_predicted")), 2))
    scores = scored.select(
        *[quoted(c) for c in df.columns if c in features.frame.columns and c != target],
        F.col("_actual").alias("actual_clv"),
        "predicted_clv",
    )
    # One row by construction: both are aggregates without a group.
    fit = regression_metrics(scored.filter(is_test), "_actual", "_predicted").select(F.struct("mae", "r2").alias("fit")).scalar()
    metrics = scored.agg(F.round(F.avg("predicted_clv"), 2).alias("avg_predicted_clv")).withColumn("_fit", fit)
    metrics = metrics.select(F.col("_fit.mae").alias("mae"), F.col("_fit.r2").alias("r2"), "avg_predicted_clv")
    return ValueModel(with_value_segments(scores, "predicted_clv"), metrics)


# -- segments ---------------------------------------------------------------------------


class Segments(NamedTuple):
    rows: DataFrame  # every row with cluster and segment
    summary: DataFrame  # means of the first features per segment
    counts: DataFrame  # rows per segment
    k: int
    passes: list[int]  # of each start
    centres: list[list[float]]  # of the clusters, in standard units of the features


def segment_label(rank: Column) -> Column:
    """The label of the rank-th cluster, from 1; ranks beyond the labels get a number."""
    label = F.concat(F.lit("Cluster "), rank.cast("string"))
    for place, name in enumerate(SEGMENT_LABELS, start=1):
        label = F.when(rank == place, name).otherwise(label)
    return label


def cluster_labels(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """(cluster, mean_value, rank, segment), highest mean first.

    Only the grouped frame is ranked: a row per cluster.
    """
    means = df.groupBy(quoted(cluster).alias("cluster")).agg(F.avg(quoted(value)).alias("mean_value"))
    rank = F.row_number().over(Window.orderBy(F.col("mean_value").desc_nulls_last(), "cluster"))
    return means.select("cluster", "mean_value", rank.alias("rank")).withColumn("segment", segment_label(F.col("rank")))


def segment_users(
    df: DataFrame,
    n_clusters: int = 4,
    roles: Roles = None,
    exclude: Sequence[str] = (),
    restarts: int = RESTARTS,
    iterations: int = ITERATIONS,
    keep: str | None = None,
    is_stored: bool = False,
) -> Segments:
    """K-means on standardised features; the best of several starts is kept.

    The result holds the rows as they came, with cluster and segment. With ``keep``, a shared folder, centres are
    looked for once for the same data and settings. The rows are stored first, unless ``is_stored`` says that they are.
    """
    spark = df.sparkSession
    df = df if is_stored else stored(df)
    # The original row rides along, because features are encoded and filled in place.
    known = df.withColumn("_row", F.struct("*"))
    encoded = label_encode(known, text_columns(df, exclude))
    candidates = numeric_columns(encoded, exclude)
    varied = {r["column"] for r in varied_columns(encoded, candidates).collect() if r["varied"]} if candidates else set()
    names = [c for c in candidates if c in varied]
    if len(names) < 2:
        raise NotReady(MESSAGES["segment_features"])
    filled = impute_median(encoded, names)
    rows = known.count()
    k = min(n_clusters, rows - 1, MAX_CLUSTERS)
    if k < 2:
        raise NotReady(MESSAGES["segment_rows"])

    def fit(folder: str | None) -> dict:
        vectors = VectorAssembler(inputCols=names, outputCol="_raw").transform(filled)
        scaler = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True).fit(vectors)
        scaled = scaler.transform(vectors)
        scaled = arranged(scaled.select("_features", value_hash(names).alias("_hash")), rows, ROWS_PER_PASS_PART, "_hash")
        scaled = scaled.select("_features").persist(KEPT)
        scaled.count()
        centres, passes = _best_clusters(scaled, rows, k, restarts, iterations)
        scaled.unpersist()
        return {"mean": list(map(float, scaler.mean)), "spread": list(map(float, scaler.std)), "centres": centres, "passes": passes}

    def name() -> str:
        return "segments-" + content_key(df, exclude, names, k, restarts, iterations)

    facts = kept(spark, keep, name, fit)
    clustered = filled.withColumn("cluster", nearest(names, facts["mean"], facts["spread"], facts["centres"]))
    # Clusters are ranked by revenue as it came; revenue as text by its codes.
    reference = find_role(df, "revenue", roles)
    reference = reference if reference in encoded.columns else names[0]
    value = as_number(df, reference) if reference in numeric_columns(df) else None
    named = clustered.withColumn("_value", F.col("_row")[reference] if value is not None else quoted(reference))
    labels = cluster_labels(named, "cluster", "_value")
    # At most eight rows.
    placed = clustered.join(F.broadcast(labels.select("cluster", "segment")), "cluster")
    placed = placed.select("_row.*", "cluster", "segment")
    means = [F.round(F.avg(as_number(df, c)), 2).alias(c) for c in names[:SUMMARY_COLUMNS]]
    return Segments(
        placed,
        placed.groupBy("segment").agg(*means),
        placed.groupBy("segment").agg(F.count(F.lit(1)).alias("rows")),
        k,
        facts["passes"],
        facts["centres"],
    )


def nearest(names: Sequence[str], mean: Sequence[float], spread: Sequence[float], centres: Sequence[Sequence[float]]) -> Column:
    """The number of the nearest centre, the first of equal ones; there are at most eight."""

    def distance(centre: Sequence[float]) -> Column:
        parts = [F.pow((quoted(n).cast("double") - m) / (s or 1.0) - c, F.lit(2)) for n, m, s, c in zip(names, mean, spread, centre)]
        return sum(parts[1:], parts[0])

    ways = F.array(*[distance(c) for c in centres])
    return F.transform(F.array(ways), lambda w: (F.array_position(w, F.array_min(w)) - 1).cast("int"))[0]


def _best_clusters(scaled: DataFrame, rows: int, k: int, restarts: int, iterations: int) -> tuple[list[list[float]], list[int]]:
    """The centres with the least squared distance, the first of equal ones, and the passes of each start.

    The library picks where the starts begin. From there they share each pass over the rows, until the last of them has ended.
    """
    ship(scaled.sparkSession)
    starts = _beginnings(scaled, rows, k, restarts)
    values = scaled.select(vector_to_array("_features").alias("values")).coalesce(rows // ROWS_PER_BLOCK_PART + 1)
    blocks = values.mapInArrow(_packed, "block binary").persist(KEPT)
    costs, passes = [float("inf")] * restarts, [0] * restarts
    going = list(range(restarts)) if iterations else []
    while going:
        found = _shared_pass(blocks, {s: starts[s] for s in going})
        still = []
        for s in going:
            costs[s], shift = sum(cost for cost, _ in found[s].values()), 0.0
            for c, (_, mean) in found[s].items():
                shift = max(shift, float(((mean - starts[s][c]) ** 2).sum()))
                starts[s][c] = mean
            passes[s] += 1
            # Each centre is looked at by itself.
            if shift > TOLERANCE / k and passes[s] < iterations:
                still.append(s)
        going = still
    blocks.unpersist()
    best = min(range(restarts), key=lambda s: (costs[s], s))
    return [list(map(float, c)) for c in starts[best]], passes


def _beginnings(scaled: DataFrame, rows: int, k: int, restarts: int) -> list[np.ndarray]:
    """The centres that each start begins with, at most ``k``.

    The starts do not depend on each other: on few rows, where a pass is mostly waiting, several run at once.
    """

    def pick(start: int) -> np.ndarray:
        kmeans = KMeans(featuresCol="_features", predictionCol="cluster", k=k, seed=SEED + start, maxIter=0, solver="block")
        return np.array(kmeans.fit(scaled).clusterCenters())

    with ThreadPoolExecutor(STARTS_AT_ONCE if rows <= FEW_ROWS else 1) as pool:
        return list(pool.map(inheritable_thread_target(scaled.sparkSession)(pick), range(restarts)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of each batch of rows as one value."""
    for batch in batches:
        if batch.num_rows:
            numbers = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"block": pa.array([numbers.tobytes()], pa.binary())})


def _shared_pass(blocks: DataFrame, starts: dict[int, np.ndarray]) -> dict[int, dict[int, tuple[float, np.ndarray]]]:
    """For each start and cluster that has rows: their squared distance from its centre, and their mean."""
    size = len(next(iter(starts.values()))[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = np.vstack(list(starts.values()))
        lengths = (centres ** 2).sum(axis=1)[:, None]
        whole = np.zeros((len(centres), size + 2))  # rows, squared distance, sums of the features
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer()).reshape(-1, size)
                far, own = lengths - 2 * (centres @ x.T), (x ** 2).sum(axis=1)
                first = 0
                for of_start in starts.values():
                    after = first + len(of_start)
                    least, at = far[first].copy(), np.zeros(len(x), dtype=np.int8)
                    for c in range(1, len(of_start)):
                        at[far[first + c] < least] = c
                        np.minimum(least, far[first + c], out=least)
                    member = (at == np.arange(len(of_start), dtype=np.int8)[:, None]).astype(float)
                    whole[first:after, 0] += member.sum(axis=1)
                    whole[first:after, 1] += member @ np.maximum(least + own, 0.0)
                    whole[first:after, 2:] += member @ x
                    first = after
        keys = [(s, c) for s, of_start in starts.items() for c in range(len(of_start))]
        columns = [[s for s, _ in keys], [c for _, c in keys], *whole.T]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, kind) for v, kind in zip(columns, [pa.int32(), pa.int32(), *[pa.float64()] * (size + 2)])],
            names=["start", "cluster", "n", "cost", *[f"s{i}" for i in range(size)]],
        )

    numbers = ["n", "cost", *[f"s{i}" for i in range(size)]]
    parts = blocks.mapInArrow(sums, "start int, cluster int, " + ", ".join(f"{n} double" for n in numbers))
    # A row per centre.
    whole = parts.groupBy("start", "cluster").agg(*[F.sum(n).alias(n) for n in numbers]).filter("n > 0").collect()
    found: dict = {s: {} for s in starts}
    for r in whole:
        found[r["start"]][r["cluster"]] = (r["cost"], np.array(r[4:]) / r["n"])
    return found


# -- rows for the predictions table --------------------------------------------------------


def prediction_row(frame: DataFrame, kind: str, model_name: str, accuracy: Column, *lines: Column) -> DataFrame:
    """A row for the predictions table out of the one row of ``frame``."""
    return frame.select(
        F.lit(kind).alias("prediction_type"),
        F.lit(model_name).alias("model_name"),
        F.round(accuracy.cast("double"), 4).alias("accuracy"),
        F.left(F.concat_ws("\n", *lines), F.lit(3000)).alias("summary"),
    )


def _line(label: str, value: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(f"{label}: "), value.cast("string"), F.lit(suffix))


def _in_order(row: Column, first: int) -> Column:
    """The texts of the first (place, text) structs of a few rows."""
    return F.slice(F.array_sort(F.collect_list(row)), 1, first)["text"]


def all_prediction_rows(
    df: DataFrame, generated: str, exclude: Sequence[str] = (), periods: int = 6, keep: str | None = None, held_by: Sequence[str] = ()
) -> DataFrame:
    """One row per model, with its score and main findings below the head of a report; for ``keep`` and ``held_by`` see the models."""
    head = F.col("head")

    def headed(kind: str, facts: DataFrame) -> DataFrame:
        # Both sides are one row by construction: aggregates without a group.
        text = report_head(df.drop(*exclude), kind, generated).select("head").scalar()
        return facts.withColumn("head", text)

    # All models and lines read the same table.
    df = stored(df)
    churn = predict_churn(df, exclude=exclude, keep=keep, is_stored=True)
    clv = predict_clv(df, exclude=exclude, held_by=held_by, is_stored=True)
    segments = segment_users(df, exclude=exclude, keep=keep, is_stored=True)
    high = churn.scores.agg(F.count_if(F.col("risk_level") == "High").alias("high"))
    forecast = forecast_fit(df).select("r2_pct", revenue_direction(df).select("trend").scalar().alias("trend"))
    score = F.round("r2_pct", 1)
    # The first ten columns, and the four largest segments: a handful of rows each.
    columns = numeric_columns(df, exclude)
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column"))
    insights = _in_order(F.struct(place.alias("place"), F.col("insight").alias("text")), TREND_LINES)
    trends = column_trends(df.drop(*exclude)).agg(F.array_join(insights, "\n").alias("insights"))
    by_size = _in_order(F.struct((-F.col("rows")).alias("place"), F.col("segment").alias("text")), NAMED_SEGMENTS)
    names = F.array_join(by_size, ", ")
    parts = [
        prediction_row(
            headed("Churn Prediction", high), "Churn Prediction", "Random Forest Classifier", F.lit(churn.accuracy),
            head, F.lit("Accuracy: not measured" if churn.accuracy is None else f"Accuracy: {churn.accuracy}%"),
            _line("High Risk", F.col("high")),
        ),
        prediction_row(
            headed("Revenue Forecast", forecast), "Revenue Forecast", "Polynomial Regression (deg 2)", score,
            head, _line("Trend", F.col("trend")), _line("R² Score", score, "%"), F.lit(f"Periods: {periods}"),
        ),
        prediction_row(
            headed("CLV Prediction", clv.metrics), "Customer Lifetime Value", "Linear Regression", F.col("r2"),
            head, _line("Avg CLV", fmt_currency(F.col("avg_predicted_clv"))), _line("MAE", fmt_currency(F.col("mae"))),
            _line("R²", F.col("r2"), "%"),
        ),
        prediction_row(trends, "Trend Analysis", "Linear Regression", F.lit(0), F.col("insights")),
        prediction_row(
            headed("User Segmentation", segments.counts.agg(names.alias("names"))), "User Segmentation",
            f"K-Means (k={segments.k})", F.lit(0), head, F.lit(f"k={segments.k}"), _line("Segments", F.col("names")),
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result

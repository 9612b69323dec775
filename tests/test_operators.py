import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.coerce import total
from tallyframe.functions.roles import MissingRole
from tallyframe.operators import breakdown, encode, history, metrics, profile, quantiles, reports, split, stats
from tallyframe.session import new_folder
from tallyframe.sources import files
from tallyframe.sources.files import UnsupportedSource, load, read_csv, write_csv
from tallyframe.sources.sample import sample_metrics
from tests.test_scale import settings


# -- quantiles -------------------------------------------------------------------------

RANDOM = random.Random(7)
COLUMNS = {
    "uniform": [RANDOM.random() for _ in range(5000)],
    "heavy": [7.0] * 3000 + [RANDOM.gauss(0, 1) for _ in range(2000)],
    "wide": [math.exp(RANDOM.uniform(-300, 300)) for _ in range(5000)],
    "two": [float(i % 2) for i in range(5000)],
    "gaps": [None if i % 3 else float(i) for i in range(5000)],
    "nothing": [None] * 5000,
}


@pytest.mark.parametrize("limits", [{}, {"few_values": 1, "few_rows": 1}, {"few_values": 50, "few_rows": 40}])
def test_quantiles_are_exact(spark, limits):
    rows = list(zip(*COLUMNS.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLUMNS)).repartition(7)
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.exact_quantiles(df, list(COLUMNS), points, **limits)
    for name, values in COLUMNS.items():
        known = [v for v in values if v is not None]
        if not known:
            assert found[name] == [None] * len(points)
            continue
        assert found[name] == pytest.approx(list(np.quantile(known, points)), rel=1e-12), name


# -- encoding --------------------------------------------------------------------------


@pytest.mark.parametrize("few", [10_000, 3])
def test_label_codes(spark, few):
    words = [None if i % 11 == 0 else RANDOM.choice(["b", "Z", "ä", "a b", "nb"]) + str(i % 97) for i in range(3000)]
    texts = ["nan" if w is None else w for w in words]
    expected = {w: i for i, w in enumerate(sorted(set(texts)))}
    df = spark.createDataFrame([(i, w, 1.5) for i, w in enumerate(words)], "i int, w string, x double")
    codes = {r["label"]: r["code"] for r in encode.label_codes(df, "w", few).collect()}
    assert codes == expected
    rows = encode.label_encode(df, ["w"], few)
    assert rows.columns == df.columns
    assert {r["i"]: r["w"] for r in rows.collect()} == {i: expected[t] for i, t in enumerate(texts)}


# -- split -------------------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.2, 0.4, 0.0, 1.0])
@pytest.mark.parametrize("few_classes", [None, False])
@pytest.mark.parametrize("hashed", [split.text_hash, split.value_hash])
def test_stratified_shares_are_exact(spark, share, few_classes, hashed):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    marked = split.stratified_holdout(df, hashed(["id"]), "y", share, few_classes)
    counts = {r["y"]: (r["n"], r["t"]) for r in marked.groupBy("y").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert counts == {y: (n, math.floor(n * share + 0.5)) for y, n in (("a", 667), ("b", 1333))}


def test_rows_without_label_train(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "a")], "id int, y string")
    marked = split.stratified_holdout(df, split.value_hash(["id"]), "y", 1.0)
    assert {r["id"]: r["is_test"] for r in marked.collect()} == {1: False, 2: True, 3: True}


# -- metrics on edges ----------------------------------------------------------------------


def test_churn_branches(spark):
    rates = spark.createDataFrame([("2024-01-01", "0.5"), ("bad", "x"), ("2024-02-01", "1")], "date string, churn string")
    head = metrics.churn_headline(rates).first()
    assert (head["overall_rate"], head["churned_count"]) == (50.0, 0)  # the undated row counts here ...
    assert [tuple(r) for r in metrics.churn_monthly(rates).collect()] == [("2024-01", 50.0), ("2024-02", 100.0)]
    counts = rates.union(spark.createDataFrame([("worse", "8")], rates.schema))
    head = metrics.churn_headline(counts).first()  # ... and so does its scale
    assert (head["overall_rate"], head["churned_count"], head["Churned Users"]) == (225.0, 9, "9")
    assert [r["churn"] for r in metrics.churn_monthly(counts).collect()] == [0.5, 1.0]


def test_retention_scale(spark):
    ratios = spark.createDataFrame([("2024-01-01", 0.5), ("2024-01-02", 1.0)], "date string, retention double")
    assert metrics.retention_headline(ratios).first()["avg_retention"] == 75.0
    percents = ratios.union(spark.createDataFrame([("2024-01-03", 60.0)], ratios.schema))
    assert metrics.retention_headline(percents).first()["avg_retention"] == 20.5


def test_growth_edges(spark):
    single = spark.createDataFrame([("2024-01-01", 5.0)], "date string, revenue double")
    assert metrics.revenue_headline(single).first()["growth_rate"] == 0.0
    from_zero = spark.createDataFrame([("2024-01-01", 0.0), ("2024-03-01", 5.0)], single.schema)
    head = metrics.revenue_headline(from_zero).first()
    assert (head["growth_rate"], head["mrr_value"], head["total"]) == (0.0, 5.0, 5.0)
    empty = metrics.revenue_headline(single.limit(0)).first()
    assert (empty["total"], empty["mrr_value"], empty["growth_rate"]) == (0.0, 0.0, 0.0)


def test_without_roles(spark):
    df = spark.createDataFrame([("a", 1.0)], "name string, x double")
    with pytest.raises(MissingRole):
        metrics.users_monthly(df)
    with pytest.raises(MissingRole):
        breakdown.plan_counts(df)
    assert metrics.revenue_by_month(df, {"revenue": "x"}).first()["period"] == "All Time"
    assert metrics.churn_monthly(df, {"churn": "x"}).count() == 0


def test_plan_ties_go_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "plan string")
    assert breakdown.plan_headline(df).first()["Top Plan"] == "a"
    assert [r["plan"] for r in breakdown.plan_counts(df).collect()] == ["a", "b"]
    assert breakdown.plan_headline(df.limit(0)).first()["Top Plan"] == "N/A"


def test_funnel_with_absent_stage(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "s string")
    assert [tuple(r) for r in breakdown.funnel(df, "s", ["a", "b", "c"]).collect()] == [
        (1, "a", 2, 100.0), (2, "b", 1, 50.0), (3, "c", 0, 0.0),
    ]


# -- profile -----------------------------------------------------------------------------------


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (float("nan"), None), (None, None), (None, None)], "x double, s string")
    assert {tuple(r) for r in profile.missing_values(df).collect()} == {("x", 3, 60.0), ("s", 3, 60.0)}
    assert tuple(profile.duplicate_rows(df).first()) == (5, 2)
    summary = profile.dataset_summary(df).first()
    assert tuple(summary) == (5, 2, 1, 1, 6)


def test_correlation_on_gaps_and_constants(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 7.0, 5.0), (4.0, 8.0, 5.0), (None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    found = {(r["col_x"], r["col_y"]): r["corr"] for r in profile.correlation_matrix(df).collect()}
    expected = df.toPandas().corr()
    assert len(found) == 9
    assert found["x", "y"] == found["y", "x"] == pytest.approx(expected.loc["x", "y"], abs=1e-4)
    assert found["x", "c"] is None and found["c", "c"] is None and found["x", "x"] == 1.0


def test_correlation_in_chunks(spark, monkeypatch):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"))
    whole = {tuple(r) for r in profile.correlation_matrix(df).collect()}
    monkeypatch.setattr(profile, "PAIRS_PER_PASS", 2)
    assert {tuple(r) for r in profile.correlation_matrix(df).collect()} == whole


def test_impute_and_varied(spark):
    df = spark.createDataFrame([(1.0, "1", None), (None, "x", None), (4.0, "3", None)], "a double, b string, c double")
    filled = profile.impute_median(df, ["a", "b", "c"])
    assert filled.columns == ["a", "b"]  # nothing to fill c with
    assert sorted(tuple(r) for r in filled.collect()) == [(1.0, 1.0), (2.5, 2.0), (4.0, 3.0)]
    wide = spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", None), (3, 2, None, None)], "a int, b int, s string, n int")
    found = {r["column"]: r["varied"] for r in profile.varied_columns(wide, ["a", "b", "s", "n"]).collect()}
    assert found == {"a": True, "b": False, "s": False, "n": False}


# -- statistics ------------------------------------------------------------------------------------


def months(spark, values):
    rows = [(datetime.datetime(2024 + i // 12, i % 12 + 1, 3), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date timestamp_ntz, revenue double")


@pytest.mark.parametrize("values", [[1, 4, 2], [5, 5, 5], [3, 9, 1, 7], [1, 4, 9, 16, 25, 36], [9, 2, 7, 1, 8, 3, 6], [4] * 6])
def test_forecast_equals_least_squares(spark, values):
    n, degree = len(values), 2 if len(values) >= 5 else 1
    t = np.arange(1, n + 1)
    curve = np.polyfit(t, values, degree)
    ahead = [max(0.0, np.polyval(curve, n + i)) for i in range(1, 5)]
    rows = stats.revenue_forecast(months(spark, values), 4).orderBy("t").collect()
    assert [r["revenue"] for r in rows] == pytest.approx(ahead, abs=0.0051)
    assert [r["t"] for r in rows] == [n + i for i in range(1, 5)]
    spread = np.sum((np.array(values) - np.mean(values)) ** 2)
    r2 = 1.0 if spread == 0 else 1 - np.sum((np.array(values) - np.polyval(curve, t)) ** 2) / spread
    assert stats.forecast_fit(months(spark, values)).first()["r2_pct"] == pytest.approx(r2 * 100, abs=1e-6)


def test_too_few_months(spark):
    assert stats.revenue_forecast(months(spark, [1, 2])).count() == 0
    readiness = {r["analysis"]: r["status"] for r in reports.analysis_readiness(months(spark, [1, 2])).collect()}
    assert readiness["revenue_forecast"] == "warn" and readiness["revenue"] == "ok"


def test_middle_month_is_late(spark):
    half = stats.revenue_direction(months(spark, [10, 20, 30])).first()
    assert (half["earlier_mean"], half["later_mean"], half["trend"]) == (10.0, 25.0, "Increasing")


def test_trends_on_edges(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 1.0, 3.0, None), ("2024-01-01", 2.0, 3.0, 1.0), ("2024-01-01", 3.0, 3.0, 2.0)],
        "date string, one_day double, same double, short double",
    )
    found = {r["column"]: tuple(r)[1:5] for r in stats.column_trends(df).collect()}
    assert found == {"one_day": ("Stable", 0.0, 0.0, 0.0), "same": ("Stable", 0.0, 0.0, 100.0)}


def test_value_segments(spark):
    same = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [r["clv_segment"] for r in stats.with_value_segments(same, "v").collect()] == ["Mid Value", "Mid Value", None]
    spread = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (2.0,), (3.0,)], "v double")
    assert [r["clv_segment"][0] for r in stats.with_value_segments(spread, "v").collect()] == list("LLMMH")


def test_standardise_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert sorted(tuple(r) for r in stats.standardise(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_report_of_one_sided_predictions(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 0)], "y int, p int")
    rows = [tuple(r) for r in stats.classification_metrics(df, "y", "p").collect()]
    assert rows == [("Retained", 0.6667, 1.0, 0.8, 2, 66.67), ("Churned", 0.0, 0.0, 0.0, 1, 66.67)]


# -- files --------------------------------------------------------------------------------------------


def test_csv_types(spark):
    path = new_folder(spark, "csv")
    text = ["A b,num,whole,flag,empty,say", '1,1.5,3,True,,"a ""quoted"", b"', "NA,NA,4,False,NA,n/a", "x,2,5,true,,c"]
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.text(path)
    df = read_csv(spark, path)
    assert df.dtypes == [
        ("A b", "string"), ("num", "double"), ("whole", "bigint"), ("flag", "boolean"), ("empty", "double"), ("say", "string"),
    ]
    assert [tuple(r) for r in df.collect()] == [
        ("1", 1.5, 3, True, None, 'a "quoted", b'), (None, None, 4, False, None, None), ("x", 2.0, 5, True, None, "c"),
    ]


def test_load_gate(spark):
    with pytest.raises(UnsupportedSource):
        load(spark, "/nowhere/file.pdf")
    path = new_folder(spark, "loaded") + ".csv"
    df = spark.createDataFrame([(1, "a,b")], "`My Id` long, `the-text` string")
    write_csv(df, path)
    loaded = load(spark, path)
    assert loaded.columns == ["my_id", "the_text"] and tuple(loaded.first()) == (1, "a,b")
    write_csv(df.limit(0), path)
    with pytest.raises(UnsupportedSource):
        load(spark, path)


AWKWARD_CSV = '''id,long,longest,text,empty,flag
1,1234567890123456789,12345678901234567890123456789012345678,"two
lines, ""quoted""",,True
2,-1234567890123456788,+1,NA,"",false
3,null,,"  kept  ",None,
'''


def test_awkward_cells_with_and_without_a_schema(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(AWKWARD_CSV)
    found = read_csv(spark, str(path))
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "decimal(38,0)", "string", "double", "boolean"]
    rows = [tuple(r) for r in found.collect()]
    assert rows[0] == (1, 1234567890123456789, 12345678901234567890123456789012345678, 'two\nlines, "quoted"', None, True)
    assert rows[1] == (2, -1234567890123456788, 1, None, None, False)
    assert rows[2] == (3, None, None, "  kept  ", None, None)
    schema = "id long, long long, longest decimal(38,0), text string, empty double, flag boolean"
    assert [tuple(r) for r in read_csv(spark, str(path), schema).collect()] == rows


def test_whole_numbers_beyond_every_type_stay_text(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n" + "9" * 39 + ",007\n1,9223372036854775808\n")
    found = read_csv(spark, str(path))
    assert [t for _, t in found.dtypes] == ["string", "decimal(38,0)"]
    assert [tuple(map(str, r)) for r in found.collect()] == [("9" * 39, "7"), ("1", "9223372036854775808")]


def test_line_breaks_survive_a_round_trip(spark, tmp_path):
    rows = [(1, 'a\nb "c", d'), (2, None), (3, "\n\n"), (4, " x ")]
    write_csv(spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "out"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), "id long, text string").collect())) == rows
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out")).collect())) == rows


def test_sample_has_every_role(spark):
    df = sample_metrics(spark, 500)
    assert df.count() == 500
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in sample_metrics(spark, 500).collect()}
    bounds = df.agg(F.min("users"), F.max("users"), F.min("retention"), F.max("retention"), F.count_distinct("plan")).first()
    assert bounds[0] >= 5 and bounds[1] < 120 and bounds[2] >= 0.8 and bounds[3] <= 1.0 and bounds[4] == 4
    assert {r["status"] for r in reports.analysis_readiness(df).collect()} == {"ok"}


# -- history ---------------------------------------------------------------------------------------------


def test_defaults_and_limits(spark):
    store = new_folder(spark, "store")
    rows = spark.createDataFrame([("u", "x" * 500)], "user_id string, user_agent string")
    history.append(rows, "login_history", store)
    history.append(rows.drop("user_agent"), "login_history", store)
    stored = history.read_table(spark, "login_history", store)
    assert stored.schema == history.table_schema("login_history")
    found = stored.collect()
    assert sorted(len(r["user_agent"]) for r in found) == [0, 200]
    assert len({r["id"] for r in found}) == 2 and all(r["created_at"] for r in found)
    prediction = spark.createDataFrame([("u", "churn", 0.123456)], "user_id string, prediction_type string, accuracy double")
    row = history.new_rows(prediction, "predictions").first()
    assert (row["accuracy"], row["model_name"], row["summary"]) == (0.1235, "", "")
    note = history.new_rows(spark.createDataFrame([("u", "t")], "user_id string, title string"), "notifications").first()
    assert (note["type"], note["read"]) == ("info", False)


def test_replace_and_append_make_versions(spark):
    store = new_folder(spark, "store")
    assert history.read_table(spark, "notifications", store).count() == 0
    rows = spark.createDataFrame([("1", "u", "a", False), ("2", "u", "b", False), ("3", "v", "c", False)], "id string, user_id string, title string, read boolean")
    history.append(rows, "notifications", store)
    stored = history.read_table(spark, "notifications", store)
    history.replace(history.mark_read(stored, "u"), "notifications", store)
    requests = spark.createDataFrame([("1", "u"), ("3", "u")], "id string, user_id string")
    history.replace(history.owner_delete(history.read_table(spark, "notifications", store), requests), "notifications", store)
    history.append(rows.filter("id = '1'").withColumn("title", F.lit("again")), "notifications", store)
    found = history.read_table(spark, "notifications", store)
    assert {(r["id"], r["title"], r["read"]) for r in found.collect()} == {("1", "again", False), ("2", "b", True), ("3", "c", False)}
    assert history.current_version(spark, "notifications", store) == 2
    # A job that fails leaves the version before it current.
    with pytest.raises(Exception, match="user_id must not be null"):
        history.replace(found.withColumn("user_id", F.lit(None).cast("string")), "notifications", store)
    assert history.read_table(spark, "notifications", store).count() == 3
    history.replace(found.limit(0), "notifications", store)
    assert history.read_table(spark, "notifications", store).count() == 0


def test_catalogue_is_appended_once(spark, sample):
    store = new_folder(spark, "store")
    row = history.catalogue_row(sample, "sample.csv", F.lit("u"))
    for _ in range(2):
        history.append_catalogue(row, store)
    assert history.read_table(spark, "datasets", store).count() == 1


def test_other_notifications(spark):
    saved = spark.createDataFrame([("u", "Revenue Report")], "user_id string, title string")
    assert tuple(history.saved_notifications(saved).first()) == ("u", "Report Saved", "Revenue Report has been saved.", "info")
    runs = spark.createDataFrame([("u", "Churn Prediction", "Forest", 91.25), ("u", "Trend Analysis", "Line", None)], "user_id string, prediction_type string, model_name string, accuracy double")
    assert [(r["title"], r["message"]) for r in history.prediction_notifications(runs).collect()] == [
        ("Churn Prediction Complete", "Forest, score 91.2"), ("Trend Analysis Complete", "Line"),
    ]


def test_latest_unread_title_on_equal_times(spark):
    rows = [(i, "u", t, False, datetime.datetime(2024, 1, d)) for i, t, d in ((5, "x", 2), (3, "y", 2), (1, "z", 1), (4, "w", 2))]
    df = spark.createDataFrame(rows, "id long, user_id string, title string, read boolean, created_at timestamp_ntz")
    assert history.unread_summary(df).first()["latest_title"] == "y"


def test_sums_do_not_depend_on_order(spark):
    """Three decimals, and large beside small: exact in any order."""
    values = [0.125, 1e12 + 0.001, -1e12, 0.1, 0.2, 0.3, 1 / 3] * 30
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = {df.repartition(n).agg(total(F.col("v"))).first()[0] for n in (1, 3, 7)}
    assert len(found) == 1
    assert found.pop() == pytest.approx(30 * (0.126 + 0.6 + 1 / 3), abs=1e-6)


def test_an_order_without_customer_stays(spark, tmp_path):
    from tallyframe.plans.inputs import fact_orders

    for name in ("orders", "customer", "lineitem"):
        frame = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "customer":
            frame = frame.filter("c_custkey % 10 != 3")
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    folder = str(tmp_path)
    whole = spark.read.parquet(f"{folder}/orders.parquet").count()
    facts = fact_orders(spark, folder)
    assert facts.count() == whole and facts.filter("plan IS NULL").count() > 0
    assert fact_orders(spark, folder, "row_id", "plan").count() == whole
    narrow = metrics.revenue_headline(fact_orders(spark, folder, "date", "revenue")).first()
    assert metrics.revenue_headline(facts).first() == narrow
    summaries = [r["summary"] for r in reports.report_rows(facts, "now").collect()]
    assert any(narrow["Total Revenue"] in s for s in summaries)


def test_required_values(spark):
    rows = spark.createDataFrame([(None, "t")], "user_id string, title string")
    with pytest.raises(Exception, match="user_id must not be null"):
        history.new_rows(rows, "reports").collect()


def test_catalogue_is_idempotent(spark, sample):
    row = history.catalogue_row(sample, "sample.csv", F.lit("u"))
    assert row.first()["columns_json"] == '["date","users","revenue","churn","retention","plan","engagement","ltv"]'
    assert history.new_catalogue_rows(row.union(row), row.limit(0)).count() == 1
    assert history.new_catalogue_rows(row, row).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame(
        [(1, "a", "pic", 100, 100), (2, "b", None, 200, 200)],
        "id int, email string, avatar_url string, created_at int, updated_at int",
    )
    new = spark.createDataFrame([(1, "a2", 1), (1, "a3", 2), (3, "c", 1)], "id int, email string, seq int")
    rows = {tuple(r) for r in history.upsert_profiles(old, new, now=F.lit(900)).collect()}
    assert rows == {(1, "a3", "pic", 100, 900), (2, "b", None, 200, 200), (3, "c", None, 900, 900)}


def test_unique_lookup(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (1,)], "id int")
    assert {tuple(r) for r in history.lookup_unique(table, keys).collect()} == {(1, "a"), (2, None), (3, None)}
    assert history.get_row(table, "id", 1).count() == 1 and history.get_row(table, "id", 2).count() == 0


def test_alerts(spark):
    kpis = spark.createDataFrame([("MRR", 1234.5), ("Churn", 9.0)], "metric string, value double")
    limits = spark.createDataFrame([("MRR", 2000.0, False), ("Churn", 10.0, True)], "metric string, threshold double, warn_above boolean")
    rows = {r["metric"]: (r["status"], r["message"]) for r in reports.kpi_alerts(kpis, limits).collect()}
    assert rows == {
        "MRR": ("warning", "MRR is now 1,234.50 (threshold: 2,000.00)."),
        "Churn": ("target met", "Churn is now 9.00 (threshold: 10.00)."),
    }


def test_large_files_are_split_unless_a_cell_goes_on_in_the_next_line(spark, tmp_path, monkeypatch):
    plain = "id,text\n" + "".join(f'{i},"a, ""{i}"""\n' for i in range(300))
    broken = "id,text\n" + "".join(f'{i},"a\n{i}"\n' for i in range(300, 600))
    folder = tmp_path / "x y.csv"
    folder.mkdir()
    (folder / "plain 1.csv").write_text(plain)
    (folder / "broken.csv").write_text(broken)
    (folder / "small.csv").write_text('id,text\n600,"b\nc"\n')
    monkeypatch.setattr(files, "ONE_TASK", 1000)
    groups = files._by_breaks(spark, str(folder))
    assert [(multi, sorted(p.rsplit("/", 1)[1] for p in names)) for multi, names in groups] == [
        (False, ["plain 1.csv"]), (True, ["broken.csv", "small.csv"]),
    ]
    expected = [(i, f'a, "{i}"') for i in range(300)] + [(i, f"a\n{i}") for i in range(300, 600)] + [(600, "b\nc")]
    for schema in (None, "id long, text string"):
        assert sorted(map(tuple, read_csv(spark, str(folder), schema).collect())) == expected
    with settings(spark, spark__sql__files__maxPartitionBytes="1000", spark__sql__files__openCostInBytes="0"):
        assert read_csv(spark, str(folder / "plain 1.csv"), "id long, text string").rdd.getNumPartitions() > 2
        assert read_csv(spark, str(folder / "broken.csv"), "id long, text string").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("few", [0, 10])
def test_duplicate_rows_of_wide_and_awkward_tables(spark, few):
    nan = float("nan")
    rows = [(None, "a", 0.0), (None, "a", -0.0), ("a", None, 0.0), ("a", None, nan), ("a", None, nan), (None, None, None), (None, None, None), ("", "a", 0.0)]
    df = spark.createDataFrame(rows, "x string, y string, `z.1` double")
    assert tuple(profile.duplicate_rows(df, few).first()) == (8, 3)
    assert tuple(profile.duplicate_rows(df.limit(0), few).first()) == (0, 0)
    assert tuple(profile.duplicate_rows(df.select("x").limit(1), few).first()) == (1, 0)


def test_rows_whose_hashes_meet_are_compared_whole(spark, monkeypatch):
    df = spark.range(12).select((F.col("id") % 5).alias("a"), F.lit("w" * 100).alias("b"))
    monkeypatch.setattr(profile.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    assert tuple(profile.duplicate_rows(df).first()) == (12, 7)

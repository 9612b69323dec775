"""What must hold of the plans, so that they carry over to large and uneven data."""

import contextlib

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import encode, history, metrics, profile
from tallyframe.operators.joins import attach
from tallyframe.plans.inputs import fact_orders, logins, table
from tallyframe.session import new_folder, ready_for_checkpoints
from tests.conftest import SMALL


@contextlib.contextmanager
def settings(spark, **values):
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_only_needed_columns_are_read(spark):
    text = scans(metrics.revenue_headline(fact_orders(spark, SMALL, "date", "revenue")))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in text
    assert text.count("Scan parquet") == 2  # the node and its details: a single scan


def test_filters_reach_the_scan(spark):
    text = scans(history.get_row(logins(spark, SMALL), "user_id", 7))
    assert "EqualTo(user_id,7)" in text


def test_few_rows_per_user_are_shuffled(spark):
    text = plan(history.recent_per_user(logins(spark, SMALL), 5))
    assert text.index("5, Final") < text.index("Exchange hashpartitioning") < text.index("5, Partial")


@pytest.mark.parametrize("operator", [
    lambda s: metrics.churn_monthly(fact_orders(s, SMALL, "date", "churn")),
    lambda s: metrics.dau_mau(table(s, SMALL, "events"), "user_id", "ts"),
    lambda s: metrics.cohort_retention(table(s, SMALL, "orders"), "o_custkey", "o_orderdate"),
    lambda s: profile.duplicate_rows(table(s, SMALL, "orders")),
    lambda s: history.unread_summary(logins(s, SMALL).selectExpr("*", "false AS read", "provider AS title")),
])
def test_rows_are_merged_before_the_shuffle(spark, operator):
    """The first shuffle above a scan is fed by an aggregation."""
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        lines = [line for line in plan(operator(spark)).splitlines() if "Exchange" in line or "Aggregate" in line]
    lowest = max(i for i, line in enumerate(lines) if "Exchange" in line)
    assert "Aggregate" in lines[lowest + 1]


@pytest.fixture(scope="module")
def uneven(spark):
    """The small tables, with a third of all orders placed by one customer."""
    folder = new_folder(spark, "uneven")
    for name in ("customer", "lineitem"):
        table(spark, SMALL, name).write.parquet(f"{folder}/{name}.parquet")
    orders = table(spark, SMALL, "orders")
    hot = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(1)).otherwise(F.col("o_custkey"))
    copies = orders.withColumn("o_custkey", hot.cast("long")).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(19))))
    many = copies.withColumn("o_orderkey", F.col("o_orderkey") + F.col("n") * 1_000_000).drop("n")
    # A skewed partition is split between the map tasks that wrote it: there must be several.
    many.repartition(16).write.parquet(f"{folder}/orders.parquet")
    return folder


SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "4KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "4KB",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


def test_a_hot_customer_is_split(spark, uneven):
    with settings(spark, **SKEW):
        df = fact_orders(spark, uneven, "row_id", "plan")
        rows = df.collect()
        assert "skew=true" in plan(df)
    assert len(rows) == table(spark, uneven, "orders").count()


def test_a_hot_customer_stays_spread_out(spark, uneven):
    """Without help from adaptive execution no task gets the whole hot customer."""
    columns = ["row_id", "plan", "ltv"]
    expected = sorted(map(tuple, fact_orders(spark, uneven, *columns).collect()))
    plain = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__enabled": "false"}
    with settings(spark, **plain):
        df = fact_orders(spark, uneven, *columns)
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        rows = sorted(map(tuple, df.collect()))
    assert rows == expected and len(rows) == table(spark, uneven, "orders").count()
    assert max(sizes) < 0.2 * len(rows)  # eight tasks; the hot customer alone has 0.4


def test_attach_keeps_rows_without_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot")
                                    .otherwise(F.col("id").cast("string")).alias("k"))
    unique = spark.createDataFrame([("hot", 1), ("2", 2), ("none", 3)], "k string, v int")
    found = attach(rows, unique, "k", "left")
    assert found.count() == 3000
    assert {tuple(r) for r in found.groupBy("v").count().collect()} == {(None, 1999), (1, 1000), (2, 1)}
    assert attach(rows, unique, "k").count() == 1001


def test_a_hot_label_is_split(spark, uneven):
    named = table(spark, uneven, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("name"))
    expected = sorted(map(tuple, encode.label_encode(named, ["name"]).collect()))
    with settings(spark, **SKEW):
        df = encode.label_encode(named, ["name"], few=2)
        rows = sorted(map(tuple, df.collect()))
        assert "isSkew=true" in plan(df) or "skew=true" in plan(df)
    assert rows == expected


def test_long_labels_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([("x" * 1000,), ("y" * 1000,)], "name string")
    assert "BroadcastHashJoin" in plan(encode.label_encode(df, ["name"]))
    monkeypatch.setattr(encode, "SMALL_TABLE", 1000)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(encode.label_encode(df, ["name"]))
    assert "SortMergeJoin" in text


def test_checkpoints_go_to_the_named_folder(spark):
    ready_for_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir().startswith(("file:", "/")) and spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

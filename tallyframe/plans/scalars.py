"""Formatting, guarded division and bands, over every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kpi
from ..operators import stats
from . import sqltext as sql
from .inputs import NOTIFICATIONS_SQL, notifications, table
from .registry import query

LINE = "l_orderkey, l_linenumber, l_partkey"


def lines(spark, folder):
    return table(spark, folder, "lineitem")


@query(
    "safe_div",
    f"SELECT {LINE}, CASE WHEN l_tax = 0 THEN 0.0 ELSE l_extendedprice / l_tax END AS ratio FROM lineitem",
)
def safe_div(spark, folder):
    return lines(spark, folder).select(
        *LINE.split(", "), kpi.safe_div(F.col("l_extendedprice"), F.col("l_tax")).alias("ratio")
    )


@query(
    "format_kpis",
    f"""WITH v AS (SELECT c_acctbal AS x FROM customer UNION ALL SELECT c_acctbal / 10000 FROM customer
                  UNION ALL SELECT o_totalprice FROM orders UNION ALL SELECT o_totalprice * 37 FROM orders)
        SELECT x, {sql.number('x')} AS number_0, {sql.number('x', 1)} AS number_1, {sql.currency('x')} AS currency,
               {sql.pct('CASE WHEN x >= 0 AND x <= 1 THEN x * 100 ELSE x END')} AS pct, {sql.signed('x')} AS signed,
               format('{{:,}}', CAST(ROUND(x) AS BIGINT)) AS grouped FROM v""",
)
def format_kpis(spark, folder):
    balance = table(spark, folder, "customer").select(F.col("c_acctbal").alias("x"))
    price = table(spark, folder, "orders").select(F.col("o_totalprice").alias("x"))
    values = balance.union(balance.select(F.col("x") / 10000)).union(price).union(price.select(F.col("x") * 37))
    x = F.col("x")
    return values.select(
        "x",
        kpi.fmt_number(x).alias("number_0"),
        kpi.fmt_number(x, 1).alias("number_1"),
        kpi.fmt_currency(x).alias("currency"),
        kpi.fmt_pct(x).alias("pct"),
        kpi.signed_pct(x).alias("signed"),
        F.format_number(F.round(x).cast("long"), 0).alias("grouped"),
    )


@query(
    "delta_pct",
    f"""SELECT {LINE}, CASE WHEN l_tax = 0 THEN 'N/A' ELSE {sql.signed('(l_discount - l_tax) / ABS(l_tax) * 100')} END AS label,
               CASE WHEN l_tax = 0 THEN 'off' WHEN l_discount >= l_tax THEN 'normal' ELSE 'inverse' END AS tone FROM lineitem""",
)
def delta_pct(spark, folder):
    current, previous = F.col("l_discount"), F.col("l_tax")
    return lines(spark, folder).select(
        *LINE.split(", "),
        kpi.delta_label(current, previous).alias("label"),
        kpi.delta_tone(current, previous).alias("tone"),
    )


# Discounts run from 0 to 10 percent: ten times that serves as a probability.
PROBABILITY = "ROUND(l_discount * 10, 3)"
RISK = f"CASE WHEN {PROBABILITY} <= 0 THEN NULL WHEN {PROBABILITY} <= 0.3 THEN 'Low' WHEN {PROBABILITY} <= 0.6 THEN 'Medium' ELSE 'High' END"


def scored(spark, folder):
    return lines(spark, folder).select(*LINE.split(", "), F.round(F.col("l_discount") * 10, 3).alias("probability"))


@query("risk_levels", f"SELECT {LINE}, {PROBABILITY} AS probability, {RISK} AS risk_level FROM lineitem")
def risk_levels(spark, folder):
    return scored(spark, folder).withColumn("risk_level", kpi.risk_level(F.col("probability")))


@query(
    "risk_distribution",
    f"SELECT {RISK} AS level, COUNT(*) AS rows FROM lineitem WHERE {RISK} IS NOT NULL GROUP BY 1",
)
def risk_distribution(spark, folder):
    levels = scored(spark, folder).select(kpi.risk_level(F.col("probability")).alias("risk_level"))
    return stats.level_distribution(levels, "risk_level")


@query(
    "risk_summary",
    f"""WITH r AS (SELECT {RISK} AS level FROM lineitem)
        SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE level = 'High') AS high_risk,
               (SELECT level FROM r WHERE level IS NOT NULL GROUP BY level ORDER BY COUNT(*) DESC, level LIMIT 1) AS largest_level
        FROM r""",
)
def risk_summary(spark, folder):
    return stats.risk_summary(scored(spark, folder), "probability")


@query(
    "value_segments",
    """WITH e AS (SELECT MIN(o_totalprice) AS low, (MAX(o_totalprice) - MIN(o_totalprice)) / 3 AS step FROM orders)
       SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice <= low + step THEN 'Low Value'
              WHEN o_totalprice <= low + step * 2 THEN 'Mid Value' ELSE 'High Value' END AS segment FROM orders, e""",
)
def value_segments(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return stats.with_value_segments(orders, "o_totalprice", "segment")


@query(
    "accuracy_bands",
    """WITH a AS (SELECT o_custkey, ROUND(AVG(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) * 100, 2) AS accuracy
                  FROM orders GROUP BY 1)
       SELECT o_custkey, accuracy, CASE WHEN accuracy >= 80 THEN 'Excellent' WHEN accuracy >= 65 THEN 'Moderate' ELSE 'Low' END AS band,
              CASE WHEN accuracy >= 70 THEN 'ok' ELSE 'warn' END AS mail_band FROM a""",
)
def accuracy_bands(spark, folder):
    kept = F.avg(F.when(F.col("o_orderstatus") != "F", 1).otherwise(0)) * 100
    accuracy = table(spark, folder, "orders").groupBy("o_custkey").agg(F.round(kept, 2).alias("accuracy"))
    return accuracy.select(
        "*",
        kpi.accuracy_band(F.col("accuracy")).alias("band"),
        kpi.mail_band(F.col("accuracy")).alias("mail_band"),
    )


@query(
    "kpi_gauge",
    f"""WITH g AS (SELECT {LINE}, CASE WHEN l_tax > 0 THEN LEAST(l_discount / l_tax * 100, 150.0) ELSE 0.0 END AS pct FROM lineitem)
        SELECT *, CASE WHEN pct < 70 THEN 'success' WHEN pct < 90 THEN 'warning' ELSE 'danger' END AS band FROM g""",
)
def kpi_gauge(spark, folder):
    pct = kpi.gauge_pct(F.col("l_discount"), F.col("l_tax")).alias("pct")
    return lines(spark, folder).select(*LINE.split(", "), pct).withColumn("band", kpi.gauge_band(F.col("pct")))


@query(
    "notification_severity",
    f"""SELECT id, type, CASE type WHEN 'success' THEN '✅' WHEN 'warning' THEN '⚠️' WHEN 'error' THEN '❌' ELSE 'ℹ️' END AS icon
        FROM {NOTIFICATIONS_SQL}""",
)
def notification_severity(spark, folder):
    return notifications(spark, folder).select("id", "type", kpi.notification_icon(F.col("type")).alias("icon"))

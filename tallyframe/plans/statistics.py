"""Forecasts, trends, splits, and scores of given predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, split, stats
from .inputs import METRIC_COLUMNS, fact_orders, fact_orders_sql, table
from .metrics import REVENUE
from .registry import query

# The least-squares parabola through the months, on centred time.
FIT = f"""m AS ({REVENUE}),
    i AS (SELECT period, revenue AS y, ROW_NUMBER() OVER (ORDER BY period) AS t, COUNT(*) OVER () AS n FROM m),
    u AS (SELECT *, t - (n + 1) / 2.0 AS u FROM i),
    s AS (SELECT MAX(n) AS n, MAX(period) AS last, AVG(y) AS mean, SUM(u * u) AS s2, SUM(u * u * u * u) AS s4,
                 SUM(u * y) AS sy1, SUM(u * u * y) AS sy2, SUM(y) AS sy, VAR_POP(y) AS v FROM u),
    c AS (SELECT n, last, mean, s2 / n AS spread, sy1 / s2 AS linear,
                 CASE WHEN n >= 5 THEN (sy2 - s2 / n * sy) / (s4 - s2 * s2 / n) ELSE 0.0 END AS square, s2, s4, v FROM s)"""


@query(
    "forecast_fit",
    f"""WITH {FIT} SELECT n, last, CASE WHEN n >= 5 THEN 2 ELSE 1 END AS degree, ROUND(mean, 2) AS mean, ROUND(linear, 2) AS linear,
        ROUND(square, 2) AS square, ROUND(spread, 4) AS spread,
        ROUND((linear * linear * s2 + square * square * (s4 - s2 * s2 / n)) / (v * n) * 100, 1) AS r2_pct FROM c""",
)
def forecast_fit(spark, folder):
    fit = stats.forecast_fit(fact_orders(spark, folder, "date", "revenue"))
    places = {"mean": 2, "linear": 2, "square": 2, "spread": 4, "r2_pct": 1}
    return fit.withColumns({c: F.round(c, n) for c, n in places.items()})


AHEAD = """f AS (SELECT strftime(CAST(last || '-01' AS DATE) + to_months(CAST(a AS INTEGER)), '%Y-%m') AS period,
    ROUND(GREATEST(0.0, mean + linear * (a + (n - 1) / 2.0) + square * ((a + (n - 1) / 2.0) * (a + (n - 1) / 2.0) - spread)), 2)
    AS revenue, n + a AS t FROM c, (SELECT UNNEST(range(1, 7)) AS a))"""


@query("revenue_forecast", f"WITH {FIT}, {AHEAD} SELECT * FROM f")
def revenue_forecast(spark, folder):
    return stats.revenue_forecast(fact_orders(spark, folder, "date", "revenue"))


@query(
    "forecast_series",
    f"""WITH {FIT}, {AHEAD} SELECT period, y AS revenue, t, 'Historical' AS series FROM i
        UNION ALL SELECT period, y, t, 'Predicted' FROM i WHERE t = n UNION ALL SELECT period, revenue, t, 'Predicted' FROM f""",
)
def forecast_series(spark, folder):
    return stats.forecast_series(fact_orders(spark, folder, "date", "revenue"))


@query(
    "revenue_direction",
    f"""WITH {FIT}, h AS (SELECT AVG(y) FILTER (WHERE t <= n // 2) AS a, AVG(y) FILTER (WHERE t > n // 2) AS b FROM i)
        SELECT ROUND(a, 2) AS earlier_mean, ROUND(b, 2) AS later_mean, ROUND((b - a) / a * 100, 2) AS change_pct,
               CASE WHEN (b - a) / a * 100 > 5 THEN 'Increasing' WHEN (b - a) / a * 100 < -5 THEN 'Decreasing' ELSE 'Stable' END AS trend
        FROM h""",
)
def revenue_direction(spark, folder):
    return stats.revenue_direction(fact_orders(spark, folder, "date", "revenue"))


@query(
    "day_offset",
    "SELECT o_orderkey, date_sub('day', (SELECT MIN(o_orderdate) FROM orders), o_orderdate) AS day FROM orders",
)
def day_offset(spark, folder):
    return stats.day_offset(table(spark, folder, "orders")).select("o_orderkey", "day")


@query(
    "column_trends",
    f"""WITH f AS {fact_orders_sql('date', *METRIC_COLUMNS)},
             d AS (SELECT *, CAST(date_sub('day', (SELECT MIN(date) FROM f), date) AS DOUBLE) AS day FROM f),
             l AS ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", regr_slope({c}, day) AS slope, regr_r2({c}, day) AS r2,
            regr_slope({c}, day) / regr_avgy({c}, day) * 100 AS pct FROM d"""
        for c in METRIC_COLUMNS
    )
    + """), n AS (SELECT *, CASE WHEN pct > 0.01 THEN 'Increasing' WHEN pct < -0.01 THEN 'Decreasing' ELSE 'Stable' END AS trend FROM l)
        SELECT "column", trend, ROUND(slope, 4) AS slope_per_day, ROUND(pct, 4) AS pct_per_day, ROUND(r2 * 100, 1) AS r2_pct,
               "column" || ': ' || trend || ' (' || printf('%+.3f', pct) || '%/day)' AS insight FROM n""",
)
def column_trends(spark, folder):
    return stats.column_trends(fact_orders(spark, folder, "date", *METRIC_COLUMNS))


# -- splits and scores -------------------------------------------------------------------

HASH = "('0x' || left(md5(CAST(o_orderkey AS VARCHAR)), 8))::BIGINT"


@query("holdout_split", f"SELECT o_orderkey, {HASH} < {int(0.2 * split.HASHES)} AS is_test FROM orders")
def holdout_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return split.holdout(orders, split.text_hash(["o_orderkey"]), 0.2)


@query(
    "stratified_split",
    f"""WITH h AS (SELECT o_orderkey, o_orderstatus, {HASH} AS h FROM orders),
             r AS (SELECT *, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY h) AS place,
                          COUNT(*) OVER (PARTITION BY o_orderstatus) AS n FROM h)
        SELECT o_orderkey, o_orderstatus, place <= FLOOR(n * 0.25 + 0.5) AS is_test FROM r""",
)
def stratified_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_holdout(orders, split.text_hash(["o_orderkey"]), "o_orderstatus", 0.25)


@query(
    "class_weights",
    """SELECT label, rows, ROUND(SUM(rows) OVER () / CAST(COUNT(*) OVER () * rows AS DOUBLE), 6) AS weight FROM
       (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, COUNT(*) AS rows FROM orders GROUP BY 1)""",
)
def class_weights(spark, folder):
    return stats.class_weights(fact_orders(spark, folder, "churn"), "churn")


JUDGED = "(SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS p FROM orders)"


@query(
    "classification_metrics",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "class",
            ROUND(COUNT(*) FILTER (WHERE y = {c} AND p = {c}) / CAST(COUNT(*) FILTER (WHERE p = {c}) AS DOUBLE), 4) AS precision,
            ROUND(COUNT(*) FILTER (WHERE y = {c} AND p = {c}) / CAST(COUNT(*) FILTER (WHERE y = {c}) AS DOUBLE), 4) AS recall,
            ROUND(2.0 * COUNT(*) FILTER (WHERE y = {c} AND p = {c})
                  / CAST(COUNT(*) FILTER (WHERE y = {c}) + COUNT(*) FILTER (WHERE p = {c}) AS DOUBLE), 4) AS f1,
            COUNT(*) FILTER (WHERE y = {c}) AS support, ROUND(AVG(CASE WHEN y = p THEN 1 ELSE 0 END) * 100, 2) AS accuracy
            FROM {JUDGED}"""
        for c, name in enumerate(stats.CLASS_NAMES)
    ),
)
def classification_metrics(spark, folder):
    judged = fact_orders(spark, folder, "churn", "revenue").withColumn("p", (F.col("revenue") > 250000).cast("int"))
    return stats.classification_metrics(judged, "churn", "p")


@query(
    "regression_metrics",
    """WITH j AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)
       SELECT ROUND(AVG(ABS(y - p)), 2) AS mae, ROUND((1 - SUM((y - p) * (y - p)) / (VAR_POP(y) * COUNT(*))) * 100, 1) AS r2,
              ROUND(AVG(p), 2) AS avg_prediction FROM j""",
)
def regression_metrics(spark, folder):
    judged = table(spark, folder, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 2000).alias("p"))
    return stats.regression_metrics(judged, "l_extendedprice", "p")


@query(
    "clv_single_feature",
    f"""WITH f AS {fact_orders_sql('row_id', 'revenue', 'ltv')},
             l AS (SELECT regr_slope(ltv, revenue) AS a, regr_intercept(ltv, revenue) AS b FROM f),
             p AS (SELECT row_id, ROUND(GREATEST(0.0, b + a * revenue), 2) AS predicted_clv FROM f, l),
             e AS (SELECT MIN(predicted_clv) AS low, (MAX(predicted_clv) - MIN(predicted_clv)) / 3 AS step FROM p)
        SELECT row_id, predicted_clv, CASE WHEN predicted_clv <= low + step THEN 'Low Value'
               WHEN predicted_clv <= low + step * 2 THEN 'Mid Value' ELSE 'High Value' END AS clv_segment FROM p, e""",
)
def clv_single_feature(spark, folder):
    facts = fact_orders(spark, folder, "row_id", "revenue", "ltv")
    return stats.single_feature_clv(facts, "revenue", "ltv").select("row_id", "predicted_clv", "clv_segment")


@query(
    "segment_labels",
    """WITH m AS (SELECT o_orderpriority AS cluster, AVG(o_totalprice) AS mean FROM orders GROUP BY 1),
            r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY mean DESC) AS rank FROM m)
       SELECT cluster, ROUND(mean, 2) AS mean_value, CAST(rank AS INTEGER) AS rank, CASE rank WHEN 1 THEN 'Champions'
              WHEN 2 THEN 'Loyal Customers' WHEN 3 THEN 'At Risk' WHEN 4 THEN 'Dormant / Lost' ELSE 'Cluster ' || rank END AS segment
       FROM r""",
)
def segment_labels(spark, folder):
    labels = models.cluster_labels(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")
    return labels.withColumn("mean_value", F.round("mean_value", 2))

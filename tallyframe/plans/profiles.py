"""Profiles of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import breakdown, profile, stats
from .inputs import METRIC_COLUMNS, fact_orders, fact_orders_dirty, fact_orders_dirty_sql, fact_orders_sql, table
from .registry import query

DIRTY = fact_orders_dirty_sql()

# Columns of the profiled tables: name, type, kind.
TYPED = {
    "orders": [
        ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"), ("o_orderstatus", "string", "categorical"),
        ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "other"),
        ("o_orderpriority", "string", "categorical"),
    ],
    "events": [
        ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "other"), ("user_id", "bigint", "numeric"),
        ("event_type", "string", "categorical"), ("value", "double", "numeric"), ("props", "string", "categorical"),
    ],
    "customer": [
        ("c_custkey", "bigint", "numeric"), ("c_name", "string", "categorical"), ("c_nationkey", "int", "numeric"),
        ("c_acctbal", "double", "numeric"), ("c_mktsegment", "string", "categorical"),
    ],
}


@query(
    "column_types",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", '{dtype}' AS dtype, '{kind}' AS kind, COUNT({c}) AS present FROM {t}"""
        for t, columns in TYPED.items()
        for c, dtype, kind in columns
    ),
)
def column_types(spark, folder):
    parts = [
        profile.column_types(table(spark, folder, name)).select(F.lit(name).alias("table"), "*") for name in TYPED
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "missing_values",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing_count,
            ROUND((COUNT(*) - COUNT({c})) / CAST(COUNT(*) AS DOUBLE) * 100, 1) AS missing_pct FROM {DIRTY}"""
        for c in ("row_id", "date", "revenue", "users", "plan", "engagement")
    )
    + ") WHERE missing_count > 0",
)
def missing_values(spark, folder):
    return profile.missing_values(fact_orders_dirty(spark, folder))


PROFILED = ["users", "revenue", "engagement", "ltv"]


@query(
    "numeric_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({c}), 2) AS mean, ROUND(STDDEV_SAMP({c}), 2) AS std,
            ROUND(CAST(MIN({c}) AS DOUBLE), 2) AS min, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 2) AS p25,
            ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS p50, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 2) AS p75,
            ROUND(CAST(MAX({c}) AS DOUBLE), 2) AS max FROM {fact_orders_sql(*PROFILED)}"""
        for c in PROFILED
    ),
)
def numeric_profile(spark, folder):
    return profile.numeric_profile(fact_orders(spark, folder, *PROFILED))


@query(
    "quartiles_closed_in",
    """SELECT quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50,
              quantile_cont(l_extendedprice, 0.75) AS p75 FROM lineitem""",
)
def quartiles_closed_in(spark, folder):
    """Quartiles of the largest table; tests bring about the way for very many distinct values."""
    lines = table(spark, folder, "lineitem")
    p25, p50, p75 = profile.exact_quantiles(lines, ["l_extendedprice"], [0.25, 0.5, 0.75])["l_extendedprice"]
    return lines.agg(*[F.any_value(F.lit(v)).alias(n) for v, n in ((p25, "p25"), (p50, "p50"), (p75, "p75"))])


@query(
    "dataset_summary",
    f"""SELECT COUNT(*) AS rows, 6 AS columns, 2 AS "numeric", 4 AS categorical,
               6 * COUNT(*) - COUNT(row_id) - COUNT(date) - COUNT(revenue) - COUNT(users) - COUNT(plan) - COUNT(engagement) AS missing
        FROM {DIRTY}""",
)
def dataset_summary(spark, folder):
    return profile.dataset_summary(fact_orders_dirty(spark, folder))


@query(
    "duplicate_rows",
    f"""SELECT COUNT(*) AS rows, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {DIRTY})) AS duplicates FROM {DIRTY}""",
)
def duplicate_rows(spark, folder):
    return profile.duplicate_rows(fact_orders_dirty(spark, folder))


@query(
    "correlation_matrix",
    f"""WITH f AS (SELECT *, 7 AS constant FROM {fact_orders_sql(*METRIC_COLUMNS)})
        SELECT col_x, col_y, CASE WHEN isnan(r) THEN NULL ELSE ROUND(r, 4) END AS corr FROM ("""
    + " UNION ALL ".join(
        f"SELECT '{x}' AS col_x, '{y}' AS col_y, CORR({x}, {y}) AS r FROM f"
        for x in [*METRIC_COLUMNS, "constant"]
        for y in [*METRIC_COLUMNS, "constant"]
    )
    + ")",
)
def correlation_matrix(spark, folder):
    return profile.correlation_matrix(fact_orders(spark, folder, *METRIC_COLUMNS).withColumn("constant", F.lit(7)))


@query(
    "standardise",
    f"""WITH f AS {fact_orders_sql('row_id', 'revenue', 'engagement')},
             m AS (SELECT AVG(revenue) AS a, STDDEV_POP(revenue) AS b, AVG(engagement) AS c, STDDEV_POP(engagement) AS d FROM f)
        SELECT row_id, ROUND((revenue - a) / b, 4) AS revenue, ROUND((engagement - c) / d, 4) AS engagement FROM f, m""",
)
def standardise(spark, folder):
    facts = fact_orders(spark, folder, "row_id", "revenue", "engagement")
    scaled = stats.standardise(facts, ["revenue", "engagement"])
    return scaled.selectExpr("row_id", "round(revenue, 4) AS revenue", "round(engagement, 4) AS engagement")


@query("scatter_points", "SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS category FROM lineitem")
def scatter_points(spark, folder):
    return breakdown.scatter_points(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("sample_rows", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def sample_rows(spark, folder):
    return breakdown.sample_rows(table(spark, folder, "orders"), 50, "o_orderdate", "o_orderkey")

"""Column names, roles, CSV files, and untidy columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, roles
from ..operators import encode, profile
from ..session import new_folder
from ..sources.files import read_csv, write_csv
from . import sqltext as sql
from .inputs import fact_orders_dirty, fact_orders_dirty_sql, fact_orders_sql, fact_orders, table
from .registry import query


@query(
    "normalise_columns",
    "SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_totalprice AS total_price_2, o_orderdate AS date FROM orders",
)
def normalise_columns(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_totalprice", "o_orderdate")
    return roles.normalise_columns(orders.toDF(" Order Key", "Total-Price", "total price", "DATE "))


@query("role_projection", "SELECT l_shipdate AS date, l_extendedprice AS revenue, l_discount AS users FROM lineitem")
def role_projection(spark, folder):
    return roles.project_roles(table(spark, folder, "lineitem"))


@query("column_search", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def column_search(spark, folder):
    return roles.search_columns(table(spark, folder, "orders"), "ORDER")


CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query(
    "csv_round_trip",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || 'c/o "' || c_mktsegment || '", floor ' || c_nationkey ELSE c_name END AS c_name,
        c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer""",
)
def csv_round_trip(spark, folder):
    """With line breaks, quotes, commas and missing cells."""
    path, name = new_folder(spark, "round-trip"), F.col("c_name")
    address = F.concat(name, F.lit('\nc/o "'), F.col("c_mktsegment"), F.lit('", floor '), F.col("c_nationkey").cast("string"))
    customer = table(spark, folder, "customer").withColumns({
        "c_name": F.when(F.col("c_custkey") % 3 == 0, address).otherwise(name),
        "c_acctbal": F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")),
    })
    write_csv(customer, path)
    return read_csv(spark, path, CUSTOMER_SCHEMA)


@query(
    "csv_source",
    f"""SELECT row_id, row_id + 1234567890123456789 AS long_id, CAST(CAST(row_id AS DECIMAL(38, 0)) + 12345678901234567890 AS VARCHAR) AS longer_id,
        date, TRY_CAST(NULLIF(revenue, 'n/a') AS DOUBLE) AS revenue, users, plan, engagement
        FROM {fact_orders_dirty_sql()}""",
)
def csv_source(spark, folder):
    """Types found from the cells; whole numbers of 19 and 20 digits keep them all."""
    path, dirty = new_folder(spark, "source"), fact_orders_dirty(spark, folder)
    longer = F.col("row_id").cast("decimal(38,0)") + F.lit("12345678901234567890").cast("decimal(38,0)")
    write_csv(dirty.withColumns({"long_id": F.col("row_id") + 1234567890123456789, "longer_id": longer}), path)
    return read_csv(spark, path).withColumn("longer_id", F.col("longer_id").cast("string"))


@query(
    "coerce_numeric_zero",
    f"""SELECT row_id, COALESCE({sql.to_number('revenue')}, 0.0) AS revenue, COALESCE({sql.to_number('users')}, 0.0) AS users
        FROM {fact_orders_dirty_sql('row_id', 'revenue', 'users')}""",
)
def coerce_numeric_zero(spark, folder):
    dirty = fact_orders_dirty(spark, folder, "row_id", "revenue", "users")
    return dirty.select(
        "row_id",
        coerce.number_or_zero(dirty, "revenue").alias("revenue"),
        coerce.number_or_zero(dirty, "users").alias("users"),
    )


@query(
    "coerce_numeric_drop",
    f"""SELECT row_id, v AS revenue FROM (SELECT row_id, {sql.to_number('revenue')} AS v
        FROM {fact_orders_dirty_sql('row_id', 'revenue')}) WHERE v IS NOT NULL""",
)
def coerce_numeric_drop(spark, folder):
    return coerce.drop_non_numbers(fact_orders_dirty(spark, folder, "row_id", "revenue"), "revenue")


@query(
    "coerce_datetime",
    f"""SELECT row_id, d AS date FROM (SELECT row_id, {sql.to_date('date')} AS d
        FROM {fact_orders_dirty_sql('row_id', 'date')}) WHERE d IS NOT NULL""",
)
def coerce_datetime(spark, folder):
    return coerce.coerce_dates(fact_orders_dirty(spark, folder, "row_id", "date"), "date")


@query(
    "datetime_quality",
    f"""SELECT COUNT(*) AS rows, COUNT({sql.to_date('date')}) AS kept, COUNT(*) - COUNT({sql.to_date('date')}) AS dropped
        FROM {fact_orders_dirty_sql('row_id', 'date')}""",
)
def datetime_quality(spark, folder):
    return coerce.date_quality(fact_orders_dirty(spark, folder, "row_id", "date"), "date")


@query(
    "impute_median",
    f"""WITH d AS (SELECT row_id, {sql.to_number('revenue')} AS revenue, engagement
                  FROM {fact_orders_dirty_sql('row_id', 'revenue', 'engagement')})
        SELECT row_id, ROUND(COALESCE(revenue, (SELECT quantile_cont(revenue, 0.5) FROM d)), 4) AS revenue,
               ROUND(COALESCE(engagement, (SELECT quantile_cont(engagement, 0.5) FROM d)), 4) AS engagement FROM d""",
)
def impute_median(spark, folder):
    dirty = fact_orders_dirty(spark, folder, "row_id", "revenue", "engagement")
    filled = profile.impute_median(dirty, ["revenue", "engagement"])
    return filled.selectExpr("row_id", "round(revenue, 4) AS revenue", "round(engagement, 4) AS engagement")


@query(
    "varied_features",
    " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", COUNT(DISTINCT {c}) > 2 AS varied FROM {fact_orders_sql("users", "revenue", "churn", "plan")}'
        for c in ("users", "revenue", "churn", "plan")
    ),
)
def varied_features(spark, folder):
    names = ["users", "revenue", "churn", "plan"]
    return profile.varied_columns(fact_orders(spark, folder, *names), names)


CODES = "SELECT label, ROW_NUMBER() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT {} AS label FROM {})"


@query(
    "label_encode",
    f"""WITH d AS (SELECT row_id, COALESCE(plan, 'nan') AS label FROM {fact_orders_dirty_sql('row_id', 'plan')}),
             c AS (SELECT label, ROW_NUMBER() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM d))
        SELECT row_id, code AS plan FROM d JOIN c USING (label)""",
)
def label_encode(spark, folder):
    return encode.label_encode(fact_orders_dirty(spark, folder, "row_id", "plan"), ["plan"])


@query("label_codes", CODES.format("c_name", "customer"))
def label_codes(spark, folder):
    return encode.label_codes(table(spark, folder, "customer"), "c_name")


@query("label_codes_sorted", CODES.format("CAST(o_orderdate AS DATE)::VARCHAR", "orders"))
def label_codes_sorted(spark, folder):
    orders = table(spark, folder, "orders").selectExpr("cast(cast(o_orderdate AS date) AS string) AS day")
    return encode.label_codes(orders, "day")

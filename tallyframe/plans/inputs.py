"""Inputs of the registered queries, as DataFrames and as SQL texts.

Each input is built from the given tables. A query names the columns it
wants, and only the joins that those columns need are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.coerce import total
from ..operators.joins import attach

ORDER_COLUMNS = ["row_id", "cust_id", "date", "users", "revenue", "churn", "retention", "plan", "engagement", "ltv"]
METRIC_COLUMNS = ["users", "revenue", "churn", "retention", "engagement", "ltv"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fact_orders(spark: SparkSession, folder: str, *wanted: str) -> DataFrame:
    """Orders with all eight roles.

    The two sides that are unique per customer are joined to each other first,
    so that the orders, of which one customer may have very many, are shuffled
    on the customer once. Every order stays, also one whose customer isn't known: it
    has no plan.
    """
    wanted = wanted or tuple(ORDER_COLUMNS)
    need = set(wanted)
    orders = table(spark, folder, "orders")
    facts = orders.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("cust_id"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("revenue"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("churn"),
        # Urgent open orders count twice where copies are wanted.
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), 2).otherwise(1).alias("copies"),
    )
    plans = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cust_id"), F.col("c_mktsegment").alias("plan")
    )
    if "ltv" in need:
        values = orders.groupBy(F.col("o_custkey").alias("cust_id")).agg(total(F.col("o_totalprice")).alias("ltv"))
        facts = attach(facts, values.join(plans, "cust_id", "left") if "plan" in need else values, "cust_id", "left")
    elif "plan" in need:
        # Two plain scans: adaptive execution splits a hot customer by itself.
        facts = facts.join(plans, "cust_id", "left")
    if need & {"users", "engagement", "retention"}:
        lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("n_lines"),
            total(F.col("l_quantity")).alias("quantity"),
            (total(F.col("l_discount")) / F.count("l_discount")).alias("discount"),
        )
        facts = facts.join(lines, F.col("row_id") == F.col("l_orderkey"), "left").withColumns({
            "users": F.coalesce("n_lines", F.lit(0)),
            "engagement": F.coalesce("quantity", F.lit(0.0)),
            "retention": 1.0 - F.round(F.coalesce("discount", F.lit(0.0)), 4),
        })
    return facts.select(*wanted)


def fact_orders_sql(*wanted: str) -> str:
    wanted = wanted or tuple(ORDER_COLUMNS)
    need = set(wanted)
    expressions = {
        "row_id": "o.o_orderkey",
        "cust_id": "o.o_custkey",
        "date": "o.o_orderdate",
        "revenue": "o.o_totalprice",
        "churn": "CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END",
        "plan": "c.c_mktsegment",
        "ltv": "CAST(v.total AS DOUBLE)",
        "users": "COALESCE(l.n_lines, 0)",
        "engagement": "CAST(COALESCE(l.qty, 0) AS DOUBLE)",
        # As decimals, so that halves are rounded as Spark rounds them.
        "retention": "1.0 - CAST(ROUND(CAST(COALESCE(l.disc, 0) AS DECIMAL(18,9)), 4) AS DOUBLE)",
    }
    joins = ""
    if "plan" in need:
        joins += " LEFT JOIN customer c ON o.o_custkey = c.c_custkey"
    if "ltv" in need:
        joins += (
            " LEFT JOIN (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey) v"
            " ON v.o_custkey = o.o_custkey"
        )
    if need & {"users", "engagement", "retention"}:
        joins += (
            " LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n_lines, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty,"
            " CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_discount) AS disc"
            " FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"
        )
    columns = ", ".join(f"{expressions[c]} AS {c}" for c in wanted)
    return f"(SELECT {columns} FROM orders o{joins})"


def fact_months(spark: SparkSession, folder: str) -> DataFrame:
    """One row per month with the number of churned orders: the count branch of churn."""
    orders = table(spark, folder, "orders")
    return (
        orders.groupBy(F.date_trunc("MONTH", "o_orderdate").alias("month"))
        .agg(
            F.min(F.col("o_orderdate").cast("date")).alias("date"),
            F.count(F.lit(1)).alias("n_orders"),
            F.count_if(F.col("o_orderstatus") == "F").alias("churn"),
        )
        .drop("month")
    )


FACT_MONTHS_SQL = (
    "(SELECT MIN(CAST(o_orderdate AS DATE)) AS date, COUNT(*) AS n_orders,"
    " CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS churn"
    " FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate), EXTRACT(MONTH FROM o_orderdate))"
)


def fact_signups(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").filter("event_type = 'signup'")
    return events.select(F.col("event_id").alias("row_id"), F.col("ts").alias("date"))


FACT_SIGNUPS_SQL = "(SELECT event_id AS row_id, ts AS date FROM events WHERE event_type = 'signup')"

DIRTY_COLUMNS = ["row_id", "date", "revenue", "users", "plan", "engagement"]


def fact_orders_dirty(spark: SparkSession, folder: str, *wanted: str) -> DataFrame:
    """Orders as text with bad dates, bad numbers, gaps, and urgent open orders twice."""
    wanted = wanted or tuple(DIRTY_COLUMNS)
    every = F.col("row_id")
    dirt = {
        "row_id": every,
        "date": F.when(every % 17 == 0, "not a date")
        .when(every % 13 == 0, F.date_format("date", "MM/dd/yyyy"))
        .otherwise(F.date_format("date", "yyyy-MM-dd")),
        "revenue": F.when(every % 23 == 0, "n/a").when(every % 29 != 0, F.col("revenue").cast("string")),
        "users": F.when(every % 37 == 0, "5d").otherwise(F.col("users").cast("string")),
        "plan": F.when(every % 19 != 0, F.col("plan")),
        "engagement": F.when(every % 41 != 0, F.col("engagement")),
    }
    source = fact_orders(spark, folder, *dict.fromkeys(["row_id", *wanted]), "copies")
    copied = source.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(*[dirt[c].alias(c) for c in wanted])


def fact_orders_dirty_sql(*wanted: str) -> str:
    wanted = wanted or tuple(DIRTY_COLUMNS)
    dirt = {
        "row_id": "f.row_id",
        "date": "CASE WHEN f.row_id % 17 = 0 THEN 'not a date' WHEN f.row_id % 13 = 0 THEN strftime(f.date, '%m/%d/%Y')"
        " ELSE strftime(f.date, '%Y-%m-%d') END",
        "revenue": "CASE WHEN f.row_id % 23 = 0 THEN 'n/a' WHEN f.row_id % 29 = 0 THEN NULL"
        " ELSE CAST(f.revenue AS VARCHAR) END",
        "users": "CASE WHEN f.row_id % 37 = 0 THEN '5d' ELSE CAST(f.users AS VARCHAR) END",
        "plan": "CASE WHEN f.row_id % 19 = 0 THEN NULL ELSE f.plan END",
        "engagement": "CASE WHEN f.row_id % 41 = 0 THEN NULL ELSE f.engagement END",
    }
    source = fact_orders_sql(*dict.fromkeys(["row_id", *wanted]))
    columns = ", ".join(f"{dirt[c]} AS {c}" for c in wanted)
    return (
        f"(SELECT {columns} FROM {source} f UNION ALL SELECT {columns} FROM {source} f"
        " JOIN orders x ON x.o_orderkey = f.row_id WHERE x.o_orderpriority = '1-URGENT' AND x.o_orderstatus = 'O')"
    )


# -- history tables -------------------------------------------------------------------


def profiles(spark: SparkSession, folder: str, absent: str | None = None) -> DataFrame:
    """Customers as profiles; those that fulfil ``absent`` have none, so their rows elsewhere are orphans."""
    customer = table(spark, folder, "customer")
    if absent:
        customer = customer.filter(f"NOT ({absent})")
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("  "), F.upper(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@Example.COM ")).alias("email"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("full_name"),
        F.when(F.col("c_custkey") % 2 == 0, "email").otherwise("google").alias("provider"),
    )


IN_DEBT = "c_acctbal < 0"
PROFILES_SQL = (
    "(SELECT c_custkey AS id, CONCAT('  ', UPPER(REPLACE(c_name, '#', '.')), '@Example.COM ') AS email,"
    " CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS full_name,"
    " CASE WHEN c_custkey % 2 = 0 THEN 'email' ELSE 'google' END AS provider"
    " FROM customer)"
)
SOLVENT_PROFILES_SQL = PROFILES_SQL.replace("FROM customer", f"FROM customer WHERE NOT ({IN_DEBT})")


def profile_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Later versions of the rich customers' profiles, and new ids for the machinery segment."""
    customer = table(spark, folder, "customer")
    provider = F.when(F.col("c_custkey") % 2 == 0, "google").otherwise("email").alias("provider")
    name = F.concat(F.col("c_name"), F.lit(" v2"))
    renamed = customer.filter("c_acctbal >= 5000").select(
        F.col("c_custkey").alias("id"), F.lower("c_name").alias("email"), name.alias("full_name"), provider,
        F.lit(1).alias("seq"),
    )
    again = customer.filter("c_acctbal >= 8000").select(
        F.col("c_custkey").alias("id"), F.lower("c_name").alias("email"), F.upper(name).alias("full_name"), provider,
        F.lit(2).alias("seq"),
    )
    added = customer.filter("c_mktsegment = 'MACHINERY'").select(
        (-1 - F.col("c_custkey")).alias("id"), F.lower("c_name").alias("email"), F.col("c_name").alias("full_name"),
        provider, F.lit(1).alias("seq"),
    )
    return renamed.unionByName(again).unionByName(added)


PROFILE_BATCH_SQL = (
    "(SELECT c_custkey AS id, LOWER(c_name) AS email, CONCAT(c_name, ' v2') AS full_name,"
    " CASE WHEN c_custkey % 2 = 0 THEN 'google' ELSE 'email' END AS provider, 1 AS seq FROM customer WHERE c_acctbal >= 5000"
    " UNION ALL SELECT c_custkey, LOWER(c_name), UPPER(CONCAT(c_name, ' v2')),"
    " CASE WHEN c_custkey % 2 = 0 THEN 'google' ELSE 'email' END, 2 FROM customer WHERE c_acctbal >= 8000"
    " UNION ALL SELECT -1 - c_custkey, LOWER(c_name), c_name,"
    " CASE WHEN c_custkey % 2 = 0 THEN 'google' ELSE 'email' END, 1 FROM customer WHERE c_mktsegment = 'MACHINERY')"
)


def logins(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as a login."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.when(F.col("user_id") % 2 == 0, "email").otherwise("google").alias("provider"),
        F.col("props").alias("user_agent"),
        F.col("ts").alias("created_at"),
    )


LOGINS_SQL = (
    "(SELECT event_id AS id, user_id, CASE WHEN user_id % 2 = 0 THEN 'email' ELSE 'google' END AS provider,"
    " props AS user_agent, ts AS created_at FROM events)"
)


def notifications(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "success")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("title"),
        F.col("props").alias("message"),
        kind.when(F.col("event_type") == "click", "warning").otherwise("info").alias("type"),
        (F.col("value") < 50).alias("read"),
        F.col("ts").alias("created_at"),
    )


NOTIFICATIONS_SQL = (
    "(SELECT event_id AS id, user_id, event_type AS title, props AS message,"
    " CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'success'"
    " WHEN 'click' THEN 'warning' ELSE 'info' END AS type,"
    " value < 50 AS read, ts AS created_at FROM events)"
)

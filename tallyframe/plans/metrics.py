"""Periodic metrics, plan breakdowns, cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import breakdown, metrics, sketches
from ..session import new_folder
from . import sqltext as sql
from .inputs import (
    FACT_MONTHS_SQL, FACT_SIGNUPS_SQL, fact_months, fact_orders, fact_orders_dirty, fact_orders_dirty_sql,
    fact_orders_sql, fact_signups, table,
)
from .registry import query

MONTH = "strftime(date, '%Y-%m')"

SIGNUPS = f"SELECT {MONTH} AS period, COUNT(*) AS users FROM {FACT_SIGNUPS_SQL} GROUP BY 1"
USERS = f"SELECT {MONTH} AS period, CAST(SUM(users) AS BIGINT) AS users FROM {fact_orders_sql('date', 'users')} GROUP BY 1"
REVENUE = f"SELECT {MONTH} AS period, {sql.money('revenue')} AS revenue FROM {fact_orders_sql('date', 'revenue')} GROUP BY 1"


def running(monthly: str) -> str:
    return f"""WITH m AS ({monthly})
        SELECT period, users, CAST(SUM(users) OVER (ORDER BY period) AS BIGINT) AS cumulative FROM m"""


def latest(monthly: str, value: str, cast: str) -> str:
    """CTE ``k``: total, latest, growth and periods of a monthly frame."""
    return f"""WITH m AS ({monthly}),
        p AS (SELECT period, {value} AS v, LAG({value}) OVER (ORDER BY period) AS prev,
                     ROW_NUMBER() OVER (ORDER BY period DESC) AS place FROM m),
        k AS (SELECT (SELECT CAST(SUM(CAST(v AS DECIMAL(18,2))) AS {cast}) FROM p) AS total, v AS latest,
                     {sql.growth('v', 'prev')} AS growth, (SELECT COUNT(*) FROM p) AS periods
              FROM p WHERE place = 1)"""


@query("signups_monthly", running(SIGNUPS))
def signups_monthly(spark, folder):
    return metrics.users_monthly(fact_signups(spark, folder))


@query("signups_weekly", f"SELECT {sql.week('date')} AS period, COUNT(*) AS users FROM {FACT_SIGNUPS_SQL} GROUP BY 1")
def signups_weekly(spark, folder):
    return metrics.users_by_period(fact_signups(spark, folder), "week")


@query("users_monthly", USERS)
def users_monthly(spark, folder):
    return metrics.users_by_period(fact_orders(spark, folder, "date", "users"))


@query("users_cumulative", running(USERS))
def users_cumulative(spark, folder):
    return metrics.users_monthly(fact_orders(spark, folder, "date", "users"))


@query(
    "users_weekly",
    f"""SELECT {sql.week('date')} AS period, CAST(SUM(users) AS BIGINT) AS users
        FROM {fact_orders_sql('date', 'users')} GROUP BY 1""",
)
def users_weekly(spark, folder):
    return metrics.users_by_period(fact_orders(spark, folder, "date", "users"), "week")


@query(
    "user_growth_kpis",
    f"""{latest(USERS, 'users', 'BIGINT')}
        SELECT total, latest AS new_this_month, ROUND(growth, 2) AS growth_rate, periods,
               {sql.number('total')} AS "Total Users", {sql.number('latest')} AS "New This Month",
               {sql.signed('growth')} AS "MoM Growth", CAST(periods AS VARCHAR) AS "Active Periods" FROM k""",
)
def user_growth_kpis(spark, folder):
    return metrics.user_growth_headline(fact_orders(spark, folder, "date", "users"))


@query(
    "signup_growth_kpis",
    f"""{latest(SIGNUPS, 'users', 'BIGINT')}
        SELECT total, latest AS new_this_month, ROUND(growth, 2) AS growth_rate, periods,
               {sql.number('total')} AS "Total Users", {sql.number('latest')} AS "New This Month",
               {sql.signed('growth')} AS "MoM Growth", CAST(periods AS VARCHAR) AS "Active Periods" FROM k""",
)
def signup_growth_kpis(spark, folder):
    return metrics.user_growth_headline(fact_signups(spark, folder))


@query(
    "revenue_monthly",
    f"""WITH m AS ({REVENUE})
        SELECT period, revenue, CAST(SUM(CAST(revenue AS DECIMAL(18,2))) OVER (ORDER BY period) AS DOUBLE) AS cumulative FROM m""",
)
def revenue_monthly(spark, folder):
    return metrics.revenue_monthly(fact_orders(spark, folder, "date", "revenue"))


@query("revenue_all_time", f"SELECT 'All Time' AS period, {sql.money('value')} AS revenue FROM events")
def revenue_all_time(spark, folder):
    return metrics.revenue_by_month(table(spark, folder, "events"))


@query(
    "revenue_dirty_monthly",
    f"""SELECT strftime(d, '%Y-%m') AS period, {sql.money('COALESCE(v, 0)')} AS revenue FROM
        (SELECT {sql.to_date('date')} AS d, {sql.to_number('revenue')} AS v
         FROM {fact_orders_dirty_sql('date', 'revenue')}) WHERE d IS NOT NULL GROUP BY 1""",
)
def revenue_dirty_monthly(spark, folder):
    return metrics.revenue_by_month(fact_orders_dirty(spark, folder, "date", "revenue"))


@query(
    "revenue_kpis",
    f"""{latest(REVENUE, 'revenue', 'DOUBLE')}
        SELECT total, latest AS mrr_value, latest * 12 AS arr_value, ROUND(growth, 2) AS growth_rate,
               {sql.currency('total')} AS "Total Revenue", {sql.currency('latest')} AS "MRR",
               {sql.currency('latest * 12')} AS "ARR", {sql.signed('growth')} AS "Revenue Growth" FROM k""",
)
def revenue_kpis(spark, folder):
    return metrics.revenue_headline(fact_orders(spark, folder, "date", "revenue"))


@query(
    "mom_growth",
    f"""WITH m AS ({REVENUE}), p AS (SELECT period, revenue, LAG(revenue) OVER (ORDER BY period) AS previous FROM m)
        SELECT period, revenue, previous, ROUND({sql.growth('revenue', 'previous')}, 2) AS growth_pct FROM p""",
)
def mom_growth(spark, folder):
    return metrics.period_changes(metrics.revenue_by_month(fact_orders(spark, folder, "date", "revenue")), "revenue")


CHURN = fact_orders_sql("date", "churn")


@query("churn_monthly", f"SELECT {MONTH} AS period, ROUND(SUM(churn) / COUNT(*) * 100, 2) AS churn FROM {CHURN} GROUP BY 1")
def churn_monthly(spark, folder):
    return metrics.churn_monthly(fact_orders(spark, folder, "date", "churn"))


def churn_columns(rate: str, churned: str) -> str:
    return f"""ROUND({rate}, 2) AS overall_rate, CAST({churned} AS BIGINT) AS churned_count,
               {sql.pct(rate, 2)} AS "Churn Rate",
               CASE WHEN {churned} = 0 THEN 'N/A' ELSE {sql.number(churned)} END AS "Churned Users",
               {sql.pct('100 - ' + rate, 2)} AS "Retention Rate" """


CHURN_KPIS = f"SELECT {churn_columns('rate', 'n')} FROM (SELECT SUM(churn) / COUNT(*) * 100 AS rate, 0 AS n FROM {CHURN})"


@query("churn_kpis", CHURN_KPIS)
def churn_kpis(spark, folder):
    return metrics.churn_headline(fact_orders(spark, folder, "date", "churn"))


@query("churn_count_monthly", f"SELECT {MONTH} AS period, CAST(SUM(churn) AS DOUBLE) AS churn FROM {FACT_MONTHS_SQL} GROUP BY 1")
def churn_count_monthly(spark, folder):
    return metrics.churn_monthly(fact_months(spark, folder))


@query(
    "churn_count_kpis",
    f"""SELECT {churn_columns('rate', 'n')} FROM
        (SELECT SUM(churn) / COUNT(*) * 100 AS rate, SUM(churn) AS n FROM {FACT_MONTHS_SQL})""",
)
def churn_count_kpis(spark, folder):
    return metrics.churn_headline(fact_months(spark, folder))


RETENTION = fact_orders_sql("date", "retention")


@query("retention_monthly", f"SELECT {MONTH} AS period, ROUND({sql.mean('retention')} * 100, 2) AS retention FROM {RETENTION} GROUP BY 1")
def retention_monthly(spark, folder):
    return metrics.retention_monthly(fact_orders(spark, folder, "date", "retention"))


RETENTION_KPIS = f"""SELECT ROUND(mean, 2) AS avg_retention, {sql.pct('mean')} AS "Avg Retention",
    {sql.pct('100 - mean')} AS "Churn (implied)" FROM (SELECT {sql.mean('retention')} * 100 AS mean FROM {RETENTION})"""


@query("retention_kpis", RETENTION_KPIS)
def retention_kpis(spark, folder):
    return metrics.retention_headline(fact_orders(spark, folder, "date", "retention"))


@query(
    "engagement_monthly",
    f"SELECT {MONTH} AS period, {sql.money('engagement')} AS engagement FROM {fact_orders_sql('date', 'engagement')} GROUP BY 1",
)
def engagement_monthly(spark, folder):
    return metrics.engagement_monthly(fact_orders(spark, folder, "date", "engagement"))


@query(
    "engagement_kpis",
    f"""SELECT total, ROUND(mean, 2) AS avg_engagement, {sql.number('total')} AS "Total Sessions",
               {sql.number('mean', 1)} AS "Avg per Record"
        FROM (SELECT {sql.money('engagement')} AS total, AVG(engagement) AS mean FROM {fact_orders_sql('engagement')})""",
)
def engagement_kpis(spark, folder):
    return metrics.engagement_headline(fact_orders(spark, folder, "date", "engagement"))


@query(
    "churn_retention_kpis",
    f"""WITH c AS ({CHURN_KPIS}), r AS ({RETENTION_KPIS})
        SELECT 1 AS position, 'Churn Rate' AS kpi, "Churn Rate" AS value FROM c
        UNION ALL SELECT 2, 'Churned Users', "Churned Users" FROM c
        UNION ALL SELECT 3, 'Retention Rate', "Retention Rate" FROM c
        UNION ALL SELECT 4, 'Avg Retention', "Avg Retention" FROM r
        UNION ALL SELECT 5, 'Churn (implied)', "Churn (implied)" FROM r""",
)
def churn_retention_kpis(spark, folder):
    return metrics.churn_retention_kpis(fact_orders(spark, folder, "date", "churn", "retention"))


# -- plans ---------------------------------------------------------------------------

PLANS = f"SELECT plan, COUNT(*) AS rows FROM {fact_orders_dirty_sql('plan')} WHERE plan IS NOT NULL GROUP BY plan"


@query("plan_counts", PLANS)
def plan_counts(spark, folder):
    return breakdown.plan_counts(fact_orders_dirty(spark, folder, "plan"))


@query(
    "plan_kpis",
    f"""WITH p AS ({PLANS})
        SELECT COUNT(*) AS plans, MAX(rows) AS top_plan_rows, CAST(COUNT(*) AS VARCHAR) AS "Total Plans",
               (SELECT plan FROM p ORDER BY rows DESC, plan LIMIT 1) AS "Top Plan",
               {sql.number('MAX(rows)')} AS "Top Plan Users" FROM p""",
)
def plan_kpis(spark, folder):
    return breakdown.plan_headline(fact_orders_dirty(spark, folder, "plan"))


@query(
    "plan_revenue",
    f"""SELECT plan, {sql.money(f"COALESCE({sql.to_number('revenue')}, 0)")} AS revenue
        FROM {fact_orders_dirty_sql('plan', 'revenue')} WHERE plan IS NOT NULL GROUP BY plan""",
)
def plan_revenue(spark, folder):
    return breakdown.plan_revenue(fact_orders_dirty(spark, folder, "plan", "revenue"))


@query(
    "product_performance",
    f"""SELECT plan AS "Plan", {sql.money('revenue')} AS "Revenue", CAST(SUM(users) AS BIGINT) AS "Users"
        FROM {fact_orders_sql('plan', 'revenue', 'users')} GROUP BY plan""",
)
def product_performance(spark, folder):
    return breakdown.product_performance(fact_orders(spark, folder, "plan", "revenue", "users"))


@query("product_counts", """SELECT c_mktsegment AS "Plan", COUNT(*) AS "Count" FROM customer GROUP BY 1""")
def product_counts(spark, folder):
    customer = table(spark, folder, "customer")
    return breakdown.product_performance(customer.select("c_name", "c_mktsegment"))


@query(
    "plan_share",
    f"""SELECT plan AS category, COUNT(*) AS rows, ROUND(COUNT(*) / SUM(COUNT(*)) OVER () * 100, 1) AS share_pct
        FROM {fact_orders_dirty_sql('plan')} WHERE plan IS NOT NULL GROUP BY plan""",
)
def plan_share(spark, folder):
    return breakdown.category_share(fact_orders_dirty(spark, folder, "plan"), "plan")


STAGES = ["view", "click", "signup", "purchase"]


@query(
    "event_funnel",
    f"""WITH s AS (SELECT event_type AS stage, COUNT(*) AS rows FROM events GROUP BY 1)
        SELECT CAST(list_position({STAGES}, stage) AS INTEGER) AS position, stage, rows,
               ROUND(rows / CAST((SELECT rows FROM s WHERE stage = 'view') AS DOUBLE) * 100, 2) AS pct_of_first
        FROM s WHERE stage IN {tuple(STAGES)}""",
)
def event_funnel(spark, folder):
    return breakdown.funnel(table(spark, folder, "events"), "event_type", STAGES)


# -- cohorts and active users ------------------------------------------------------------


@query(
    "cohort_retention",
    """WITH a AS (SELECT DISTINCT o_custkey AS u, date_trunc('month', o_orderdate) AS m FROM orders),
            f AS (SELECT u, MIN(m) AS c FROM a GROUP BY u),
            n AS (SELECT c, date_diff('month', c, m) AS age, COUNT(*) AS active FROM a JOIN f USING (u) GROUP BY 1, 2),
            s AS (SELECT c, COUNT(*) AS size FROM f GROUP BY c)
       SELECT strftime(c, '%Y-%m') AS cohort, CAST(age AS INTEGER) AS months_since, active AS active_users,
              size AS cohort_size, ROUND(active / CAST(size AS DOUBLE) * 100, 2) AS retention_pct
       FROM n JOIN s USING (c)""",
)
def cohort_retention(spark, folder):
    return metrics.cohort_retention(table(spark, folder, "orders"), "o_custkey", "o_orderdate")


@query(
    "dau_mau",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, COUNT(DISTINCT user_id) AS dau FROM events GROUP BY 1),
            m AS (SELECT date_trunc('month', ts) AS mon, COUNT(DISTINCT user_id) AS mau FROM events GROUP BY 1)
       SELECT day, dau, mau, ROUND(dau / CAST(mau AS DOUBLE) * 100, 2) AS stickiness_pct
       FROM d JOIN m ON date_trunc('month', d.day) = m.mon""",
)
def dau_mau(spark, folder):
    return metrics.dau_mau(table(spark, folder, "events"), "user_id", "ts")


# Spans of days whose users are counted from the sets of their days.
ROLLING = [7, 28]


@query(
    "active_users_by_span",
    """WITH seen AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
            days AS (SELECT UNNEST(range(MIN(day), MAX(day) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM seen)
       SELECT 'month' AS span, CAST(date_trunc('month', day) AS DATE) AS day, COUNT(DISTINCT user_id) AS users FROM seen GROUP BY ALL
       UNION ALL SELECT 'week', CAST(date_trunc('week', day) AS DATE), COUNT(DISTINCT user_id) FROM seen GROUP BY ALL"""
    + "".join(
        f""" UNION ALL SELECT '{n} days', d.day, COUNT(DISTINCT user_id) FROM days d JOIN seen s
             ON s.day BETWEEN d.day - {n - 1} AND d.day GROUP BY ALL"""
        for n in ROLLING
    ),
)
def active_users_by_span(spark, folder):
    """Months, weeks and rolling spans, all merged from one kept set per day and range of users, not from the events."""
    events = table(spark, folder, "events")
    path = new_folder(spark, "daily-sets")
    sketches.daily_sets(events, "user_id", "ts", sketches.user_numbers(events, "user_id")).write.parquet(path)
    sets = spark.read.schema("day date, range long, users binary").parquet(path)
    parts = [("month", sketches.active_users(sets, F.trunc("day", "MM").alias("day"))), ("week", sketches.active_users(sets, F.trunc("day", "week").alias("day")))]
    parts += [(f"{n} days", sketches.rolling_users(sets, n)) for n in ROLLING]
    return reduce(DataFrame.unionByName, [df.select(F.lit(span).alias("span"), "day", "users") for span, df in parts])

"""Monthly and weekly metrics with their headline figures.

Each metric reads its columns once and groups them on the period. Whatever
needs the whole data set (a maximum that decides the scale, the latest month,
running totals) is computed on that grouped frame, whose size is bounded by the
calendar, not by the data. Rows without a date form a group of their own, so
that headline figures over all rows need no second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.coerce import as_timestamp, is_whole, number_or_zero, total
from ..functions.kpi import fmt_currency, fmt_number, growth_pct, plain_pct, signed_pct
from ..functions.periods import period_label, period_start
from ..functions.roles import find_role, need_role

Roles = dict[str, str] | None


# The windows without a partition run over frames of one row per period.


def by_period() -> WindowSpec:
    return Window.orderBy("period")


def up_to_now() -> WindowSpec:
    return by_period().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def all_periods() -> WindowSpec:
    return Window.partitionBy()


def _start(df: DataFrame, roles: Roles, unit: str = "month") -> Column:
    date = find_role(df, "date", roles)
    return period_start(as_timestamp(df, date), unit) if date else F.lit(None).cast("date")


def _labelled(grouped: DataFrame, unit: str, *columns: Column | str) -> DataFrame:
    """Periods in no order: a window or headline that follows sorts or needs no order."""
    return grouped.select(period_label(F.col("start"), unit).alias("period"), *columns)


# -- change between periods ------------------------------------------------


def period_changes(series: DataFrame, value: str) -> DataFrame:
    """Each period beside the previous one that occurs, with the change in percent."""
    previous = F.lag(value).over(by_period())
    return series.select(
        "period",
        value,
        previous.alias("previous"),
        F.round(growth_pct(F.col(value), previous), 2).alias("growth_pct"),
    )


def _latest(series: DataFrame, value: str, whole: bool) -> DataFrame:
    """One row: sum, latest value, unrounded growth and number of periods."""
    paired = series.select("period", value, F.lag(value).over(by_period()).alias("previous"))
    return paired.agg(
        total(F.col(value), whole).alias("total"),
        F.coalesce(F.max_by(value, "period"), F.lit(0)).alias("latest"),
        growth_pct(F.max_by(value, "period"), F.max_by("previous", "period")).alias("growth"),
        F.count(F.lit(1)).alias("periods"),
    )


# -- user growth -----------------------------------------------------------


def users_by_period(df: DataFrame, unit: str = "month", roles: Roles = None) -> DataFrame:
    """Users per period: the users column added up, or rows counted without one."""
    return _users(df, unit, roles).orderBy("period")


def _users(df: DataFrame, unit: str, roles: Roles) -> DataFrame:
    need_role(df, "date", roles)
    users = find_role(df, "users", roles)
    if users:
        counted = total(F.col("value"), is_whole(df, users))
        rows = df.select(_start(df, roles, unit).alias("start"), number_or_zero(df, users).alias("value"))
    else:
        counted = F.count(F.lit(1))
        rows = df.select(_start(df, roles, unit).alias("start"))
    grouped = rows.filter("start IS NOT NULL").groupBy("start").agg(counted.alias("users"))
    return _labelled(grouped, unit, "users")


def users_monthly(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Users per month with their running total, in order."""
    return _users(df, "month", roles).withColumn("cumulative", F.sum("users").over(up_to_now()))


def user_growth_headline(df: DataFrame, roles: Roles = None) -> DataFrame:
    latest = _latest(_users(df, "month", roles), "users", whole=False)
    users, new = F.col("total").cast("long"), F.col("latest").cast("long")
    return latest.select(
        users.alias("total"),
        new.alias("new_this_month"),
        F.round("growth", 2).alias("growth_rate"),
        "periods",
        fmt_number(users).alias("Total Users"),
        fmt_number(new).alias("New This Month"),
        signed_pct(F.col("growth")).alias("MoM Growth"),
        F.col("periods").cast("string").alias("Active Periods"),
    )


# -- revenue ---------------------------------------------------------------


def revenue_by_month(df: DataFrame, roles: Roles = None) -> DataFrame:
    """(period, revenue) in no order; a single 'All Time' row without a date column."""
    value = number_or_zero(df, need_role(df, "revenue", roles)).cast("double").alias("value")
    if not find_role(df, "date", roles):
        return df.select(value).agg(total(F.col("value")).alias("revenue")).select(
            F.lit("All Time").alias("period"), "revenue"
        )
    rows = df.select(_start(df, roles).alias("start"), value).filter("start IS NOT NULL")
    return _labelled(rows.groupBy("start").agg(total(F.col("value")).alias("revenue")), "month", "revenue")


def revenue_monthly(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Revenue per month with its running total, in order."""
    return revenue_by_month(df, roles).withColumn("cumulative", total(F.col("revenue"), over=up_to_now()))


def revenue_headline(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Total, MRR (the latest month), ARR (twelve times that) and growth."""
    latest = _latest(revenue_by_month(df, roles), "revenue", whole=False)
    arr = F.col("latest") * 12
    return latest.select(
        "total",
        F.col("latest").alias("mrr_value"),
        arr.alias("arr_value"),
        F.round("growth", 2).alias("growth_rate"),
        fmt_currency(F.col("total")).alias("Total Revenue"),
        fmt_currency(F.col("latest")).alias("MRR"),
        fmt_currency(arr).alias("ARR"),
        signed_pct(F.col("growth")).alias("Revenue Growth"),
    )


# -- churn, retention, engagement -------------------------------------------


def _period_sums(df: DataFrame, role: str, roles: Roles) -> DataFrame:
    """(start, total, rows, top): one row per month and one for undated rows."""
    name = need_role(df, role, roles)
    rows = df.select(_start(df, roles).alias("start"), number_or_zero(df, name).cast("double").alias("value"))
    return rows.groupBy("start").agg(
        total(F.col("value")).alias("total"),
        F.count(F.lit(1)).alias("rows"),
        F.max("value").alias("top"),
    )


def churn_monthly(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Mean churn in percent if no value exceeds 1, else churned users per month."""
    sums = _period_sums(df, "churn", roles).withColumn("is_rate", F.max("top").over(all_periods()) <= 1)
    rate = F.round(F.col("total") / F.col("rows") * 100, 2)
    churn = F.when(F.col("is_rate"), rate).otherwise(F.col("total")).alias("churn")
    return _labelled(sums.filter("start IS NOT NULL"), "month", churn).orderBy("period")


def churn_headline(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Rates have no count of churned users: it is 0 and shown as 'N/A'."""
    whole = _period_sums(df, "churn", roles).agg(
        total(F.col("total")).alias("total"), F.sum("rows").alias("rows"), (F.max("top") <= 1).alias("is_rate")
    )
    is_rate = F.coalesce(F.col("is_rate"), F.lit(False))
    churned = F.when(is_rate, F.lit(0)).otherwise(F.coalesce(F.col("total"), F.lit(0))).cast("long")
    counted = F.coalesce(F.try_divide(churned.cast("double"), F.col("rows")) * 100, F.lit(0.0))
    facts = whole.select(
        F.when(is_rate, F.col("total") / F.col("rows") * 100).otherwise(counted).alias("rate"),
        churned.alias("churned"),
    )
    rate = F.col("rate")
    return facts.select(
        F.round(rate, 2).alias("overall_rate"),
        F.col("churned").alias("churned_count"),
        plain_pct(rate, 2).alias("Churn Rate"),
        F.when(F.col("churned") == 0, "N/A").otherwise(fmt_number(F.col("churned"))).alias("Churned Users"),
        plain_pct(100 - rate, 2).alias("Retention Rate"),
    )


def retention_monthly(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Mean retention in percent; ratios up to 1 are rescaled."""
    sums = _period_sums(df, "retention", roles)
    scale = F.when(F.max("top").over(all_periods()) <= 1, 100.0).otherwise(1.0)
    scaled = sums.withColumn("scale", scale).filter("start IS NOT NULL")
    mean = F.round(F.col("total") / F.col("rows") * F.col("scale"), 2)
    return _labelled(scaled, "month", mean.alias("retention")).orderBy("period")


def retention_headline(df: DataFrame, roles: Roles = None) -> DataFrame:
    scale = F.when(F.max("top") <= 1, 100.0).otherwise(1.0)
    mean = _period_sums(df, "retention", roles).agg(
        (F.try_divide(total(F.col("total")), F.sum("rows")) * scale).alias("mean")
    )
    return mean.select(
        F.round("mean", 2).alias("avg_retention"),
        plain_pct(F.col("mean")).alias("Avg Retention"),
        plain_pct(100 - F.col("mean")).alias("Churn (implied)"),
    )


def engagement_monthly(df: DataFrame, roles: Roles = None) -> DataFrame:
    sums = _period_sums(df, "engagement", roles).filter("start IS NOT NULL")
    return _labelled(sums, "month", F.col("total").alias("engagement")).orderBy("period")


def engagement_headline(df: DataFrame, roles: Roles = None) -> DataFrame:
    whole = _period_sums(df, "engagement", roles).agg(
        total(F.col("total")).alias("total"),
        F.try_divide(total(F.col("total")), F.sum("rows")).alias("mean"),
    )
    return whole.select(
        "total",
        F.round("mean", 2).alias("avg_engagement"),
        fmt_number(F.col("total")).alias("Total Sessions"),
        fmt_number(F.col("mean"), 1).alias("Avg per Record"),
    )


# -- headline rows as (kpi, value) -------------------------------------------

# The display columns of each headline, in their order on the page.
KPI_NAMES = {
    "User Growth": ["Total Users", "New This Month", "MoM Growth", "Active Periods"],
    "Revenue Analysis": ["Total Revenue", "MRR", "ARR", "Revenue Growth"],
    "Churn": ["Churn Rate", "Churned Users", "Retention Rate"],
    "Retention": ["Avg Retention", "Churn (implied)"],
    "Engagement": ["Total Sessions", "Avg per Record"],
}


def kpi_rows(headline: DataFrame, names: list[str], first: int = 1) -> DataFrame:
    """(position, kpi, value) rows out of the one row of a headline."""
    cells = [
        F.struct(F.lit(first + i).alias("position"), F.lit(n).alias("kpi"), F.col(f"`{n}`").alias("value"))
        for i, n in enumerate(names)
    ]
    return headline.select(F.inline(F.array(*cells)))


def churn_retention_kpis(df: DataFrame, roles: Roles = None) -> DataFrame:
    churn, retention = KPI_NAMES["Churn"], KPI_NAMES["Retention"]
    return kpi_rows(churn_headline(df, roles), churn).unionByName(
        kpi_rows(retention_headline(df, roles), retention, first=len(churn) + 1)
    )


# -- advertised by name: cohorts and active users ------------------------------


def cohort_retention(activity: DataFrame, user: str, moment: str) -> DataFrame:
    """Users of each first-activity month still active n months later.

    Rows shrink to one per user and month before anything is joined.
    """
    months = (
        activity.select(F.col(user).alias("user"), period_start(as_timestamp(activity, moment), "month").alias("month"))
        .filter("user IS NOT NULL AND month IS NOT NULL")
        .distinct()
    )
    first = F.min("month").over(Window.partitionBy("user"))
    placed = months.select(first.alias("cohort"), F.months_between("month", first).cast("int").alias("age"))
    counts = placed.groupBy("cohort", "age").agg(F.count(F.lit(1)).alias("active_users"))
    size = F.max(F.when(F.col("age") == 0, F.col("active_users"))).over(Window.partitionBy("cohort"))
    return counts.select(
        period_label(F.col("cohort"), "month").alias("cohort"),
        F.col("age").alias("months_since"),
        "active_users",
        size.alias("cohort_size"),
        F.round(F.col("active_users") / size * 100, 2).alias("retention_pct"),
    )


def dau_mau(activity: DataFrame, user: str, moment: str) -> DataFrame:
    """Active users of each day and of its month, and the ratio in percent.

    Both counts come out of one pass over distinct (day, user) pairs.
    """
    stamp = as_timestamp(activity, moment)
    days = (
        activity.select(F.col(user).alias("user"), stamp.cast("date").alias("day"))
        .filter("user IS NOT NULL AND day IS NOT NULL")
        .distinct()
    )
    daily = days.groupBy("day").agg(F.count(F.lit(1)).alias("dau"))
    month = F.trunc("day", "MM").alias("month")
    monthly = days.select(month, "user").distinct().groupBy("month").agg(F.count(F.lit(1)).alias("mau"))
    # One row per day on either side: the join is bounded by the calendar.
    joined = daily.withColumn("month", F.trunc("day", "MM")).join(monthly, "month")
    return joined.select("day", "dau", "mau", F.round(F.col("dau") / F.col("mau") * 100, 2).alias("stickiness_pct"))

"""Breakdowns by plan, category shares and funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.coerce import is_whole, number_or_zero, total
from ..functions.kpi import fmt_number
from ..functions.roles import find_role, need_role, quoted

Roles = dict[str, str] | None


def plan_counts(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Rows per plan, largest first, ties by name; rows without a plan are left out."""
    plan = quoted(need_role(df, "plan", roles)).alias("plan")
    counts = df.select(plan).filter("plan IS NOT NULL").groupBy("plan").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), "plan")


def plan_headline(df: DataFrame, roles: Roles = None) -> DataFrame:
    # The smallest (-rows, name) is the largest plan, first by name among equals.
    top = F.min(F.struct((-F.col("rows")).alias("minus_rows"), "plan"))
    best = plan_counts(df, roles).agg(F.count(F.lit(1)).alias("plans"), top.alias("top"))
    size = F.coalesce(-F.col("top.minus_rows"), F.lit(0))
    return best.select(
        "plans",
        size.alias("top_plan_rows"),
        F.col("plans").cast("string").alias("Total Plans"),
        F.coalesce(F.col("top.plan").cast("string"), F.lit("N/A")).alias("Top Plan"),
        fmt_number(size).alias("Top Plan Users"),
    )


def plan_revenue(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Revenue per plan, largest first."""
    plan = quoted(need_role(df, "plan", roles)).alias("plan")
    value = number_or_zero(df, need_role(df, "revenue", roles)).cast("double").alias("value")
    rows = df.select(plan, value).filter("plan IS NOT NULL")
    return rows.groupBy("plan").agg(total(F.col("value")).alias("revenue")).orderBy(F.desc("revenue"), "plan")


def product_performance(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Revenue and users per plan, as far as there are such columns, else row counts."""
    plan = need_role(df, "plan", roles)
    columns, sums = [quoted(plan).alias("Plan")], []
    for label, role in (("Revenue", "revenue"), ("Users", "users")):
        name = find_role(df, role, roles)
        if name:
            columns.append(number_or_zero(df, name).alias(label))
            sums.append(total(F.col(label), is_whole(df, name)).alias(label))
    rows = df.select(*columns).filter("Plan IS NOT NULL")
    pivot = rows.groupBy("Plan").agg(*(sums or [F.count(F.lit(1)).alias("Count")]))
    return pivot.orderBy(F.desc(pivot.columns[1]), "Plan")


def category_share(df: DataFrame, category: str) -> DataFrame:
    """Rows per category and their share of all categorised rows.

    The whole is a scalar subquery, so any number of categories stays spread out.
    """
    named = df.select(quoted(category).alias("category"))
    whole = named.agg(F.count("category")).scalar()
    counts = named.filter("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share_pct", F.round(F.col("rows") / whole * 100, 1))


def funnel(df: DataFrame, stage: str, stages: Sequence[str]) -> DataFrame:
    """Rows at each of the given stages, in percent of the first one.

    One pass fills one counter per stage; nothing is shuffled but those counters.
    """
    counters = [F.count_if(quoted(stage) == name).alias(f"s{i}") for i, name in enumerate(stages)]
    counted = df.filter(quoted(stage).isin(*stages)).agg(*counters)
    share = [F.round(F.try_divide(F.col(f"s{i}"), F.col("s0")) * 100, 2) for i in range(len(stages))]
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(name).alias("stage"),
            F.col(f"s{i}").alias("rows"),
            share[i].alias("pct_of_first"),
        )
        for i, name in enumerate(stages)
    ]
    return counted.select(F.inline(F.array(*rows)))


def scatter_points(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """The points of a scatter plot, with their category as text if one is named."""
    category = [quoted(colour).cast("string").alias("category")] if colour else []
    return df.select(quoted(x).alias("x"), quoted(y).alias("y"), *category)


def sample_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a given order."""
    return df.orderBy(*[quoted(c) for c in order]).limit(n)

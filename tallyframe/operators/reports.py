"""Report texts, KPI alerts, and which analyses a data set is ready for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import as_number, as_timestamp
from ..functions.kpi import fixed
from ..functions.periods import period_start
from ..functions.roles import find_role, numeric_columns, quoted, text_columns
from .encode import label_text
from .metrics import (
    KPI_NAMES,
    churn_retention_kpis,
    engagement_headline,
    kpi_rows,
    revenue_headline,
    user_growth_headline,
)
from .profile import varied_columns

Roles = dict[str, str] | None

FIRST_NUMERIC = 6  # fixed value: numeric columns named in a report


def report_head(df: DataFrame, kind: str, generated: str) -> DataFrame:
    """One row (title, report_type, head): what was analysed, its shape, and when."""
    names = ", ".join(numeric_columns(df)[:FIRST_NUMERIC])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(f"{kind} Report").alias("title"),
        F.lit(kind).alias("report_type"),
        F.concat_ws(
            "\n",
            F.lit(f"Type     : {kind}"),
            F.concat(F.lit("Dataset  : "), F.col("rows"), F.lit(f" rows × {len(df.columns)} columns")),
            F.lit(f"Numeric  : {names}"),
            F.lit(f"Generated: {generated}"),
        ).alias("head"),
    )


def report_text(df: DataFrame, kind: str, generated: str, lines: Sequence[str] = ()) -> DataFrame:
    """A plain-text summary with further lines below the head."""
    head = report_head(df, kind, generated)
    return head.select("title", "report_type", F.concat_ws("\n", "head", *map(F.lit, lines)).alias("summary"))


def report_row(df: DataFrame, kind: str, kpis: DataFrame, generated: str) -> DataFrame:
    """A row for the reports table out of (position, kpi, value) rows.

    The KPI rows are a handful per report; they are gathered in their order.
    """
    pairs = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(": ", "kpi", "value").alias("text"))))
    text = kpis.agg(pairs.alias("pairs")).select(F.concat_ws("\n", F.col("pairs.text"))).scalar()
    row = report_head(df, kind, generated).withColumn("lines", text)
    return row.select(
        "title",
        "report_type",
        F.concat_ws("\n", "head", "lines").alias("summary"),
        F.when(F.lower("lines").contains("growth"), "ok").otherwise("warn").alias("status"),
    )


def report_rows(df: DataFrame, generated: str, roles: Roles = None) -> DataFrame:
    """The reports on user growth, revenue, and churn with retention."""
    parts = {
        "User Growth": kpi_rows(user_growth_headline(df, roles), KPI_NAMES["User Growth"]),
        "Revenue Analysis": kpi_rows(revenue_headline(df, roles), KPI_NAMES["Revenue Analysis"]),
        "Churn & Retention": churn_retention_kpis(df, roles),
    }
    rows = [report_row(df, kind, kpis, generated) for kind, kpis in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def all_kpis(df: DataFrame, roles: Roles = None) -> DataFrame:
    """(position, kpi, value) rows of every headline."""
    return (
        kpi_rows(user_growth_headline(df, roles), KPI_NAMES["User Growth"])
        .unionByName(kpi_rows(revenue_headline(df, roles), KPI_NAMES["Revenue Analysis"]))
        .unionByName(churn_retention_kpis(df, roles))
        .unionByName(kpi_rows(engagement_headline(df, roles), KPI_NAMES["Engagement"]))
    )


# -- KPI alerts ------------------------------------------------------------------


def kpi_alerts(kpis: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value) rows against (metric, threshold, warn_above) rows.

    A metric beyond its threshold on the bad side is a warning, else its target
    is met. There is one threshold per metric name, whatever the data size.
    """
    joined = kpis.join(thresholds, "metric")
    bad = F.when(F.col("warn_above"), F.col("value") > F.col("threshold")).otherwise(
        F.col("value") < F.col("threshold")
    )
    shown = fixed(F.col("value"), 2, grouped=True)
    limit = fixed(F.col("threshold"), 2, grouped=True)
    return joined.select(
        *[c for c in kpis.columns if c not in ("metric", "value")],
        "metric",
        F.when(bad, "warning").otherwise("target met").alias("status"),
        F.concat(F.when(bad, "KPI Alert").otherwise("KPI Target Met"), F.lit(" — "), "metric").alias("subject"),
        F.concat("metric", F.lit(" is now "), shown, F.lit(" (threshold: "), limit, F.lit(").")).alias("message"),
    )


# -- readiness ---------------------------------------------------------------------

# The least rows, months, features and classes of the models.
MIN_CHURN_ROWS, MIN_CLV_ROWS, MIN_MONTHS, MIN_SEGMENT_ROWS = 20, 10, 3, 3

# What the analyses say when they cannot run.
MESSAGES = {
    "date": "No date column detected.",
    "bad_dates": "Date column could not be parsed.",
    "revenue": "No revenue column found.",
    "churn": "No churn column found.",
    "retention": "No retention column found.",
    "plan": "No plan/tier column found.",
    "engagement": "No engagement column found.",
    "forecast": "Need both a date column and a revenue column.",
    "ltv": "No LTV/revenue column found.",
    "months": "Need at least 3 months of data for revenue forecasting.",
    "churn_features": "Need at least 2 numeric feature columns besides the churn column.",
    "churn_classes": "Target column has only one class.",
    "churn_rows": "Need at least 20 rows for churn prediction.",
    "clv_features": "Need at least 1 numeric feature column besides the target.",
    "clv_rows": "Need at least 10 rows for CLV prediction.",
    "trend_columns": "No numeric columns to analyse.",
    "segment_features": "Need at least 2 numeric columns for segmentation.",
    "segment_rows": "Need at least 3 rows for segmentation.",
}


def analysis_readiness(df: DataFrame, roles: Roles = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(analysis, status, message) for every analysis, from the names and one pass of counts.

    Text columns count as features of the models, since they are encoded. For
    segments only columns with more than two values count, as the segmentation itself counts them.
    """
    named = {r: find_role(df, r, roles) for r in ("date", "revenue", "churn", "retention", "plan", "engagement", "ltv")}
    target = named["ltv"] or named["revenue"]
    features = numeric_columns(df, exclude) + text_columns(df, exclude)
    nothing = F.lit(0).cast("long")

    dates, months = nothing, nothing
    if named["date"]:
        moment = as_timestamp(df, named["date"])
        dates, months = F.count(moment), F.count_distinct(period_start(moment, "month"))
    churn_rows, positive = nothing, nothing
    if named["churn"]:
        churn = as_number(df, named["churn"])
        churn_rows, positive = F.count(churn), F.count_if(churn > 0)
    clv_rows = F.count(as_number(df, target)) if target else nothing
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        dates.alias("dates"),
        months.alias("months"),
        churn_rows.alias("churn_rows"),
        positive.alias("positive"),
        clv_rows.alias("clv_rows"),
    )
    # A missing text is a category of its own, as in the encoding.
    texts = set(text_columns(df, exclude))
    coded = df.select(*[label_text(c).alias(c) if c in texts else quoted(c) for c in features])
    varied = varied_columns(coded, features).agg(F.count_if("varied")).scalar() if features else nothing
    counts = counts.withColumn("varied", varied)

    def first_problem(*checks: tuple[bool | Column, str, str]) -> tuple[Column, Column]:
        status, message = F.lit("ok"), F.lit("")
        for failed, kind, key in reversed(checks):
            condition = failed if isinstance(failed, Column) else F.lit(failed)
            status = F.when(condition, kind).otherwise(status)
            message = F.when(condition, MESSAGES[key]).otherwise(message)
        return status, message

    missing = {role: name is None for role, name in named.items()}
    others = [c for c in features if c != named["churn"]]
    clv_features = [c for c in features if c != target]
    checks = {
        "user_growth": [(missing["date"], "warn", "date"), (F.col("dates") == 0, "error", "bad_dates")],
        "revenue": [(missing["revenue"], "warn", "revenue")],
        "churn": [(missing["churn"], "warn", "churn")],
        "retention": [(missing["retention"], "warn", "retention")],
        "subscriptions": [(missing["plan"], "warn", "plan")],
        "engagement": [(missing["engagement"], "warn", "engagement")],
        "product_performance": [(missing["plan"], "warn", "plan")],
        "churn_prediction": [
            (missing["churn"], "error", "churn"),
            (len(others) < 2, "warn", "churn_features"),
            ((F.col("positive") == 0) | (F.col("positive") == F.col("churn_rows")), "warn", "churn_classes"),
            (F.col("churn_rows") < MIN_CHURN_ROWS, "warn", "churn_rows"),
        ],
        "revenue_forecast": [
            (missing["date"] or missing["revenue"], "error", "forecast"),
            (F.col("months") < MIN_MONTHS, "warn", "months"),
        ],
        "clv": [
            (target is None, "error", "ltv"),
            (len(clv_features) < 1, "warn", "clv_features"),
            (F.col("clv_rows") < MIN_CLV_ROWS, "warn", "clv_rows"),
        ],
        "trends": [(missing["date"], "warn", "date"), (not numeric_columns(df, exclude), "warn", "trend_columns")],
        "segmentation": [
            (F.col("varied") < 2, "warn", "segment_features"),
            (F.col("rows") < MIN_SEGMENT_ROWS, "warn", "segment_rows"),
        ],
    }
    rows = []
    for analysis, found in checks.items():
        status, message = first_problem(*found)
        rows.append(F.struct(F.lit(analysis).alias("analysis"), status.alias("status"), message.alias("message")))
    return counts.select(F.inline(F.array(*rows)))

"""Closed-form statistics: forecasts, trends, value bands, offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import as_number, as_timestamp
from ..functions.kpi import direction, risk_level, safe_div, signed_fixed, value_band
from ..functions.periods import period_label, whole_days
from ..functions.roles import need_role, numeric_columns, quoted
from .metrics import all_periods, by_period, revenue_by_month

Roles = dict[str, str] | None

MIN_MONTHS = 3  # fixed value: a forecast needs that many
CURVED_FROM = 5  # fixed value: from so many months on the curve is quadratic
CLV_SEGMENTS = ["Low Value", "Mid Value", "High Value"]


# -- revenue forecast ---------------------------------------------------------


def _indexed_months(df: DataFrame, roles: Roles) -> DataFrame:
    """(period, revenue, t): t counts the months that occur, from 1."""
    need_role(df, "date", roles)
    return revenue_by_month(df, roles).withColumn("t", F.row_number().over(by_period()).cast("long"))


def forecast_fit(df: DataFrame, roles: Roles = None) -> DataFrame:
    """One row: the least-squares curve through the monthly revenue.

    With u = t - mean(t) the polynomials 1, u and u² - mean(u²) are orthogonal
    on t = 1..n, so each coefficient is a quotient of two sums and the fit is
    one aggregation: revenue(u) = mean + linear * u + square * (u² - spread).
    Frames of fewer than three months give no row.
    """
    months = _indexed_months(df, roles).withColumn("n", F.count(F.lit(1)).over(all_periods()))
    u, y = F.col("t") - (F.col("n") + 1) / 2, F.col("revenue")
    sums = months.select("period", "n", y.alias("y"), u.alias("u")).agg(
        F.max("n").alias("n"),
        F.max("period").alias("last"),
        F.avg("y").alias("mean"),
        F.sum(F.pow("u", F.lit(2))).alias("s2"),
        F.sum(F.pow("u", F.lit(4))).alias("s4"),
        F.sum(F.col("u") * F.col("y")).alias("sy1"),
        F.sum(F.col("u") * F.col("u") * F.col("y")).alias("sy2"),
        F.sum("y").alias("sy"),
        F.var_pop("y").alias("variance"),
    ).filter(F.col("n") >= MIN_MONTHS)
    n, s2 = F.col("n"), F.col("s2")
    spread = s2 / n
    weight = F.col("s4") - s2 * s2 / n
    square = F.when(n >= CURVED_FROM, (F.col("sy2") - spread * F.col("sy")) / weight).otherwise(0.0)
    fitted = sums.select(
        "n", "last", "mean", spread.alias("spread"), "variance", weight.alias("weight"), "s2",
        F.when(n >= CURVED_FROM, 2).otherwise(1).alias("degree"),
        (F.col("sy1") / s2).alias("linear"), square.alias("square"),
    )
    explained = F.col("linear") * F.col("linear") * s2 + F.col("square") * F.col("square") * F.col("weight")
    r2 = F.when(F.col("variance") == 0, 1.0).otherwise(F.try_divide(explained, F.col("variance") * n))
    return fitted.select("n", "last", "degree", "mean", "linear", "square", "spread", (r2 * 100).alias("r2_pct"))


def revenue_forecast(df: DataFrame, periods: int = 6, roles: Roles = None) -> DataFrame:
    """The next months after the last one, never below 0."""
    ahead = forecast_fit(df, roles).withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    u = F.col("ahead") + (F.col("n") - 1) / 2
    value = F.col("mean") + F.col("linear") * u + F.col("square") * (u * u - F.col("spread"))
    month = F.add_months(F.to_date(F.concat("last", F.lit("-01"))), F.col("ahead"))
    return ahead.select(
        period_label(month, "month").alias("period"),
        F.round(F.greatest(F.lit(0.0), value), 2).alias("revenue"),
        (F.col("n") + F.col("ahead")).alias("t"),
    )


def forecast_series(df: DataFrame, periods: int = 6, roles: Roles = None) -> DataFrame:
    """Actual months, then the predicted line, which starts at the last actual point."""
    actual = _indexed_months(df, roles)
    last = actual.agg(F.max_by(F.struct("period", "revenue", "t"), "t").alias("row")).select("row.*")
    predicted = last.filter("period IS NOT NULL").unionByName(revenue_forecast(df, periods, roles))
    return actual.withColumn("series", F.lit("Historical")).unionByName(
        predicted.withColumn("series", F.lit("Predicted"))
    )


def revenue_direction(df: DataFrame, roles: Roles = None) -> DataFrame:
    """One row: mean of the later half of the months against the earlier half.

    The middle month of an odd number belongs to the later half; a change of
    5 percent or less is 'Stable'.
    """
    months = _indexed_months(df, roles).withColumn("n", F.count(F.lit(1)).over(all_periods()))
    early = F.col("t") <= F.floor(F.col("n") / 2)
    halves = months.agg(
        F.avg(F.when(early, F.col("revenue"))).alias("first"),
        F.avg(F.when(~early, F.col("revenue"))).alias("second"),
    )
    change = F.coalesce(safe_div(F.col("second") - F.col("first"), F.col("first")) * 100, F.lit(0.0))
    return halves.select(
        F.round("first", 2).alias("earlier_mean"),
        F.round("second", 2).alias("later_mean"),
        F.round(change, 2).alias("change_pct"),
        direction(change, 5).alias("trend"),
    )


# -- trends over days ----------------------------------------------------------


def day_offset(df: DataFrame, roles: Roles = None) -> DataFrame:
    """Full days since the earliest date, in a column ``day``; undated rows are left out."""
    moment = as_timestamp(df, need_role(df, "date", roles))
    first = df.select(moment.alias("moment")).agg(F.min("moment")).scalar()
    days = whole_days(first, moment)
    return df.withColumn("day", days).filter(F.col("day").isNotNull())


def column_trends(df: DataFrame, columns: Sequence[str] | None = None, roles: Roles = None) -> DataFrame:
    """Straight line through each numeric column over the days since the first date.

    One pass for all columns. Columns with fewer than three values are left out.
    """
    moment = as_timestamp(df, need_role(df, "date", roles))
    columns = list(columns or numeric_columns(df))
    first = df.select(moment.alias("moment")).agg(F.min("moment")).scalar()
    values = df.select(
        whole_days(first, moment).cast("double").alias("day"),
        *[as_number(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)],
    ).filter("day IS NOT NULL")
    lines = values.agg(*[_line(f"c{i}").alias(f"c{i}") for i in range(len(columns))])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("line")) for i, c in enumerate(columns)]
    rows = lines.select(F.inline(F.array(*cells))).select("column", "line.*").filter("n >= 3")
    pct = F.coalesce(safe_div(F.col("slope"), F.col("mean")) * 100, F.lit(0.0))
    trend = direction(pct, 0.01)
    return rows.select(
        "column",
        trend.alias("trend"),
        F.round("slope", 4).alias("slope_per_day"),
        F.round(pct, 4).alias("pct_per_day"),
        F.round(F.col("r2") * 100, 1).alias("r2_pct"),
        F.concat(F.col("column"), F.lit(": "), trend, F.lit(" ("), signed_fixed(pct, 3), F.lit("%/day)")).alias("insight"),
    )


def _line(name: str) -> Column:
    y, x = F.col(name), F.col("day")
    # A single day gives no slope: the line is then the mean.
    fit = F.when(F.var_pop(y) == 0, 1.0).otherwise(F.coalesce(F.regr_r2(y, x), F.lit(0.0)))
    return F.struct(
        F.regr_count(y, x).alias("n"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.regr_avgy(y, x).alias("mean"),
        fit.alias("r2"),
    )


# -- bands over a column ---------------------------------------------------------


def with_value_segments(df: DataFrame, column: str, out: str = "clv_segment") -> DataFrame:
    """Low, mid and high thirds of the range of a column."""
    ends = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("ends")).scalar()
    return df.withColumn(out, value_band(quoted(column), ends["low"], ends["high"], CLV_SEGMENTS))


def level_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per level of a banded column; rows without a level are left out."""
    return df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("level")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def risk_summary(df: DataFrame, probability: str) -> DataFrame:
    """One row: scored rows, those at high risk, and the largest level."""
    level = risk_level(quoted(probability)).alias("level")
    return df.select(level).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("level") == "High").alias("high_risk"),
        F.mode("level", True).alias("largest_level"),
    )


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with mean 0 and population deviation 1; a constant column becomes 0."""
    moments = df.agg(F.struct(*[
        F.struct(F.avg(quoted(c)).alias("mean"), F.stddev_pop(quoted(c)).alias("std")).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]).alias("moments")).scalar()
    result = df
    for i, c in enumerate(columns):
        spread, centred = moments[f"c{i}"]["std"], quoted(c) - moments[f"c{i}"]["mean"]
        result = result.withColumn(c, F.when(spread == 0, centred).otherwise(F.try_divide(centred, spread)))
    return result


# -- single-feature regression and scores of given predictions ----------------------


def single_feature_clv(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Straight-line prediction of ``target`` for every row, with value segments."""
    y, x = as_number(df, target).cast("double"), as_number(df, feature).cast("double")
    line = df.agg(F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base")).alias("line")).scalar()
    predicted = F.round(F.greatest(F.lit(0.0), line["base"] + line["slope"] * x), 2)
    return with_value_segments(df.withColumn("predicted_clv", predicted), "predicted_clv")


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: mean absolute error, R² in percent and mean prediction."""
    y, p = quoted(label), quoted(prediction)
    sums = df.agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg(p).alias("mean"),
        F.sum((y - p) * (y - p)).alias("residual"),
        (F.var_pop(y) * F.count(y)).alias("spread"),
    )
    perfect = F.when(F.col("residual") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("spread") == 0, perfect).otherwise(1 - F.try_divide(F.col("residual"), F.col("spread")))
    return sums.select(
        F.round("mae", 2).alias("mae"), F.round(r2 * 100, 1).alias("r2"), F.round("mean", 2).alias("avg_prediction")
    )


CLASS_NAMES = ["Retained", "Churned"]


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class (0 and 1), and the accuracy in percent.

    The four cells of the confusion table are counted in one pass.
    """
    y, p = quoted(label), quoted(prediction)
    cells = df.agg(
        *[F.count_if((y == a) & (p == b)).cast("double").alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    )
    right, rows = F.col("n00") + F.col("n11"), F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    accuracy = F.round(F.try_divide(right, rows) * 100, 2)
    lines = []
    for c in (0, 1):
        hit, said, real = F.col(f"n{c}{c}"), F.col(f"n0{c}") + F.col(f"n1{c}"), F.col(f"n{c}0") + F.col(f"n{c}1")
        lines.append(F.struct(
            F.lit(CLASS_NAMES[c]).alias("class"),
            F.round(F.coalesce(F.try_divide(hit, said), F.lit(0.0)), 4).alias("precision"),
            F.round(F.coalesce(F.try_divide(hit, real), F.lit(0.0)), 4).alias("recall"),
            F.round(F.coalesce(F.try_divide(2 * hit, said + real), F.lit(0.0)), 4).alias("f1"),
            real.cast("long").alias("support"),
            accuracy.alias("accuracy"),
        ))
    return cells.select(F.inline(F.array(*lines)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class n / (classes * n_class), so that classes weigh the same in total."""
    y = quoted(label)
    counts = df.filter(y.isNotNull()).groupBy(y.alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    whole = counts.agg(F.struct(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("w")).scalar()
    return counts.withColumn("weight", F.round(whole["rows"] / (whole["classes"] * F.col("rows")), 6))

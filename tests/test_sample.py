"""Results on the sample of a hundred days, against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import breakdown, metrics, profile, stats

from tests.conftest import sample_days

NAMES = ["date", "users", "revenue", "churn", "retention", "plan", "engagement", "ltv"]
DAYS = pd.DataFrame(sample_days(), columns=NAMES)
DAYS["month"] = DAYS["date"].str[:7]
MONTHS = DAYS.groupby("month")


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize("function, name, expected", [
    (metrics.users_monthly, "users", MONTHS["users"].sum()),
    (metrics.users_monthly, "cumulative", MONTHS["users"].sum().cumsum()),
    (metrics.revenue_monthly, "revenue", MONTHS["revenue"].sum()),
    (metrics.churn_monthly, "churn", 100 * MONTHS["churn"].mean()),
    (metrics.retention_monthly, "retention", 100 * MONTHS["retention"].mean()),
    (metrics.engagement_monthly, "engagement", MONTHS["engagement"].sum()),
])
def test_months(sample, function, name, expected):
    rows = function(sample)
    assert column(rows, "period") == list(expected.index) == ["2024-02", "2024-03", "2024-04", "2024-05"]
    assert column(rows, name) == pytest.approx(list(expected), abs=0.0051)


def test_weeks(sample):
    day = pd.to_datetime(DAYS["date"])
    monday = day - pd.to_timedelta(day.dt.weekday, unit="D")
    expected = DAYS.groupby(monday)["users"].sum()
    weeks = metrics.users_by_period(sample, "week").collect()
    assert [(r["period"], r["users"]) for r in weeks] == [
        (f"{m:%Y-%m-%d}/{m + pd.Timedelta(days=6):%Y-%m-%d}", n) for m, n in expected.items()
    ]


def test_headlines(sample):
    by_month = MONTHS[["revenue", "users"]].sum()
    last, before = by_month.iloc[-1], by_month.iloc[-2]
    revenue = metrics.revenue_headline(sample).first()
    assert (revenue["total"], revenue["mrr_value"]) == (DAYS["revenue"].sum(), last["revenue"])
    growth = 100 * (last["revenue"] - before["revenue"]) / before["revenue"]
    assert revenue["growth_rate"] == pytest.approx(growth, abs=0.0051)
    assert revenue["arr_value"] == pytest.approx(12 * last["revenue"])
    assert revenue["Total Revenue"] == f"${DAYS['revenue'].sum() / 1000:.1f}K"
    assert revenue["Revenue Growth"] == f"{growth:+.1f}%"
    users = metrics.user_growth_headline(sample).first()
    assert users["total"] == DAYS["users"].sum()
    assert users["growth_rate"] == pytest.approx(100 * (last["users"] - before["users"]) / before["users"], abs=0.0051)
    churn = metrics.churn_headline(sample).first()
    assert (churn["overall_rate"], churn["churned_count"], churn["Churned Users"]) == (14.0, 0, "N/A")
    assert metrics.retention_headline(sample).first()["avg_retention"] == pytest.approx(100 * DAYS["retention"].mean(), abs=0.0051)
    engagement = metrics.engagement_headline(sample).first()
    assert engagement["total"] == DAYS["engagement"].sum()
    assert engagement["avg_engagement"] == pytest.approx(DAYS["engagement"].mean(), abs=0.0051)


def test_plans(sample):
    counts = DAYS["plan"].value_counts()
    assert dict(tuple(r) for r in breakdown.plan_counts(sample).collect()) == dict(counts)
    sums = DAYS.groupby("plan")[["revenue", "users"]].sum().sort_values("revenue", ascending=False)
    assert [tuple(r) for r in breakdown.product_performance(sample).collect()] == list(sums.itertuples(name=None))
    assert breakdown.plan_headline(sample).first()["Top Plan"] == counts.idxmax()


def test_forecast(sample):
    y = MONTHS["revenue"].sum().to_numpy()
    t = np.arange(1, len(y) + 1)
    line = np.polyfit(t, y, 1)  # a straight one for fewer than five months
    found = stats.revenue_forecast(sample)
    assert column(found, "revenue") == pytest.approx(list(np.maximum(0, np.polyval(line, t[-1] + np.arange(1, 7)))), abs=0.011)
    assert column(found, "period")[0] == "2024-06"
    fit = stats.forecast_fit(sample).first()
    rest = ((y - np.polyval(line, t)) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert fit["degree"] == 1 and fit["r2_pct"] == pytest.approx(100 * (1 - rest), abs=1e-6)
    change = 100 * (y[2:].mean() - y[:2].mean()) / y[:2].mean()
    half = stats.revenue_direction(sample).first()
    assert half["change_pct"] == pytest.approx(change, abs=0.0051)
    assert half["trend"] == ("Increasing" if change > 5 else "Decreasing" if change < -5 else "Stable")


def test_trends(sample):
    day = np.arange(len(DAYS))
    rows = {r["column"]: tuple(r)[1:5] for r in stats.column_trends(sample).collect()}
    assert set(rows) == {"users", "revenue", "churn", "retention", "engagement", "ltv"}
    for name, (direction, slope, daily, r2) in rows.items():
        y = DAYS[name].to_numpy(float)
        a = np.polyfit(day, y, 1)[0]
        assert slope == pytest.approx(a, abs=5.1e-5)
        assert daily == pytest.approx(100 * a / y.mean(), abs=5.1e-5)
        assert r2 == pytest.approx(100 * np.corrcoef(day, y)[0, 1] ** 2, abs=0.051)
        assert direction == ("Increasing" if daily > 0.01 else "Decreasing" if daily < -0.01 else "Stable")


def test_profile(sample):
    assert profile.duplicate_rows(sample).first()["duplicates"] == 0
    assert profile.missing_values(sample).count() == 0
    pandas = DAYS.describe().T.round(2)
    for row in profile.numeric_profile(sample).collect():
        expected = pandas.loc[row["column"]]
        assert row["mean"] == pytest.approx(expected["mean"], abs=0.011)
        assert [row["p25"], row["p50"], row["p75"]] == pytest.approx(list(expected[["25%", "50%", "75%"]]), abs=0.011)
        assert row["std"] == pytest.approx(expected["std"], abs=0.011)

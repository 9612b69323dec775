import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import coerce, kpi, periods, roles


def test_role_rules():
    find = roles.resolve_role
    assert find(["l_discount", "l_tax"], "users") == "l_discount"  # 'count' within 'discount'
    assert find(["monthly_revenue", "timestamp"], "date") == "monthly_revenue"  # 'month' before 'timestamp'
    assert find(["price", "mrr"], "revenue") == "mrr"  # better keyword, later column
    assert find(["a_price", "b_price"], "revenue") == "a_price"
    assert find(["Plan", "PLAN"], "plan") == "PLAN"  # one column, last spelling
    assert find(["x"], "plan") is None


def test_names_stay_apart():
    assert roles.normalised_names([" Total Price", "total-price", "TOTAL_PRICE_2", "a"]) == [
        "total_price", "total_price_2", "total_price_2_2", "a",
    ]


def test_project_roles_with_override(spark):
    df = spark.createDataFrame([(1, 2.0)], "user_id long, strange double")
    assert roles.project_roles(df, {"revenue": "strange"}).columns == ["revenue", "users"]
    assert roles.search_columns(df, "nothing").columns == df.columns


TEXTS = ["1", " 2.5 ", "5d", "n/a", None, "", "1e3", "-.5", "7.", "0x10", "NaN", "inf", "1,000", "+4"]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, v string")
    values = [r[0] for r in df.orderBy("i").select(coerce.as_number(df, "v")).collect()]
    assert values == [1, 2.5, None, None, None, None, 1000, -0.5, 7, None, None, float("inf"), None, 4]
    assert coerce.drop_non_numbers(df, "v").count() == 7
    assert df.select(F.sum(F.when(F.col("i") < 7, coerce.number_or_zero(df, "v")))).first()[0] == 1003.5 


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert sorted(r[0] for r in df.select(coerce.number_or_zero(df, "v")).collect()) == [0, 0, 1]
    flags = spark.createDataFrame([(True,), (False,)], "v boolean")
    assert sorted(r[0] for r in flags.select(coerce.as_number(flags, "v")).collect()) == [0, 1]


def test_dates(spark):
    texts = ["2024-01-05", "01/05/2024", "2024-01-05T10:00:00", "05-Jan-2024", "soon", None, "20240105", "2024/01/05"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    days = [r["v"].date() for r in coerce.coerce_dates(df, "v").collect()]
    assert days == [datetime.date(2024, 1, 5)] * 6
    assert tuple(coerce.date_quality(df, "v").first()) == (8, 6, 2)


def test_whole_number_dates_need_a_unit(spark):
    df = spark.createDataFrame([(1704067200,)], "v long")
    with pytest.raises(ValueError):
        coerce.as_timestamp(df, "v")
    assert df.select(coerce.as_timestamp(df, "v", unit="s").cast("date")).first()[0] == datetime.date(2024, 1, 1)


def test_totals_are_exact(spark):
    df = spark.range(0, 100_000, 1, 16).select((F.col("id") % 1000 / 100).alias("v"))
    expected = sum(i % 1000 for i in range(100_000)) / 100
    assert df.agg(coerce.total(F.col("v"))).first()[0] == expected
    assert df.repartition(3).agg(coerce.total(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize("values, expected", [
    ([0.001, 0.002], 0.003), ([1e300, 1.0], 1e300), ([], 0.0), ([None, 1.25], 1.25), ([None], 0.0), ([1e17, 0.5], 1e17),
])
def test_other_totals(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.agg(coerce.total(F.col("v"))).first()[0] == pytest.approx(expected)


def python_number(n, decimals=0):
    if n >= 1_000_000:
        return f"{n / 1_000_000:.1f}M"
    return f"{n / 1_000:.1f}K" if n >= 1_000 else f"{n:,.{decimals}f}"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e7, 1e9, allow_nan=False), min_size=40, max_size=40))
def test_formats_equal_python(spark, values):
    values = values + [0.0, 0.5, 1.5, 2.5, 999.95, 1250.0, 1350.0, -1234.5, 1e6, 0.25]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    v = F.col("v")
    rows = df.select("v", kpi.fmt_number(v), kpi.fmt_number(v, 1), kpi.signed_pct(v), kpi.plain_pct(v, 2)).collect()
    for n, whole, one, signed, plain in rows:
        assert (whole, one) == (python_number(n), python_number(n, 1))
        assert (signed, plain) == (f"{n:+.1f}%", f"{n:.2f}%")


def test_division_and_change(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 0.0), (1.0, None), (6.0, -4.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(kpi.safe_div(a, b), kpi.delta_label(a, b), kpi.delta_tone(a, b)).collect()
    assert [tuple(r) for r in rows] == [
        (0.0, "N/A", "off"), (None, "N/A", "off"), (None, "N/A", "off"), (-1.5, "+250.0%", "normal"),
    ]


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.31, 0.6, 0.61, 1.0, 1.1, None)], "p double")
    levels = [r[0] for r in df.select(kpi.risk_level(F.col("p"))).collect()]
    assert levels == [None, "Low", "Medium", "Medium", "High", "High", None, None]
    scores = spark.createDataFrame([(80.0,), (65.0,), (64.9,), (None,)], "s double")
    assert [r[0] for r in scores.select(kpi.accuracy_band(F.col("s"))).collect()] == ["Excellent", "Moderate", "Low", None]
    gauges = spark.createDataFrame([(1.0, 0.0), (9.0, 10.0), (99.0, 10.0)], "v double, m double")
    assert [r[0] for r in gauges.select(kpi.gauge_pct(F.col("v"), F.col("m"))).collect()] == [0.0, 90.0, 150.0]


def test_weeks_and_days(spark):
    row = spark.sql("""SELECT timestamp_ntz'2023-01-01 23:59' AS a, timestamp_ntz'2023-01-03 22:59' AS b""")
    label = periods.period_label(periods.period_start(F.col("a"), "week"), "week")
    assert row.select(label).first()[0] == "2022-12-26/2023-01-01"
    assert row.select(periods.whole_days(F.col("a"), F.col("b"))).first()[0] == 1


def test_profile_names(spark):
    df = spark.createDataFrame([("\t Ann@X.com\n", None), ("b@y", "Bo")], "email string, name string")
    email = kpi.clean_email(F.col("email"))
    rows = df.select(email, kpi.display_name(F.col("name"), email)).collect()
    assert [tuple(r) for r in rows] == [("ann@x.com", "ann"), ("b@y", "Bo")]

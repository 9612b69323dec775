"""Sets and sketches that are merged instead of reading rows again."""

import bisect
import datetime
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.operators import sketches

DAY = datetime.date(2024, 2, 20)
RANDOM = random.Random(11)
SEEN = [(RANDOM.choice(["ann", "", None]) if i % 9 == 0 else f"u{RANDOM.randrange(40) ** 2}", DAY + datetime.timedelta(days=RANDOM.randrange(30) * 2)) for i in range(500)]


@pytest.fixture(scope="module")
def activity(spark):
    hot = [("ann", DAY)] * 250 + [("bob", None), (None, None)]
    return spark.createDataFrame(SEEN + hot, "user string, moment date")


@pytest.fixture(scope="module")
def sets(activity):
    return sketches.daily_sets(activity, "user", "moment", sketches.user_numbers(activity, "user"))


def pairs():
    return {(u, d) for u, d in [*SEEN, ("ann", DAY)] if u is not None}


def test_months_and_all_days(sets):
    found = {r["month"]: r["users"] for r in sketches.active_users(sets, F.trunc("day", "MM").alias("month")).collect()}
    months = {d.replace(day=1) for _, d in pairs()}
    assert found == {m: len({u for u, d in pairs() if d.replace(day=1) == m}) for m in months}
    assert sketches.active_users(sets, F.lit("all").alias("span")).first()["users"] == len({u for u, _ in pairs()})


@pytest.mark.parametrize("days", [1, 7])
def test_rolling_spans(sets, days):
    last = max(d for _, d in pairs())
    expected = {}
    for n in range((last - DAY).days + 1):
        end = DAY + datetime.timedelta(days=n)
        users = {u for u, d in pairs() if 0 <= (end - d).days < days}
        if users:
            expected[end] = len(users)
    assert {r["day"]: r["users"] for r in sketches.rolling_users(sets, days).collect()} == expected


def test_sets_of_nothing_and_of_unknown_users(spark, activity, sets):
    none = activity.limit(0)
    empty = sketches.daily_sets(none, "user", "moment", sketches.user_numbers(none, "user"))
    assert empty.count() == 0 and sketches.rolling_users(empty, 7).count() == 0
    with pytest.raises(PySparkException, match="No number for user"):
        sketches.daily_sets(activity, "user", "moment", sketches.user_numbers(none, "user")).collect()


def test_users_of_several_ranges(spark):
    rows = spark.range(100_000).select(F.col("id").alias("user"), F.lit(DAY).alias("moment"))
    sets = sketches.daily_sets(rows, "user", "moment", sketches.user_numbers(rows, "user"))
    assert sets.count() == 4
    assert sketches.active_users(sets, "day").first()["users"] == 100_000


def test_sketches_of_files_merge_within_their_error(spark):
    rows = 200_000
    i = F.col("id")
    df = spark.range(rows).select(
        (i % 7).alias("file"),
        F.pow(F.lit(1.0001), (i * 7919) % rows).alias("skewed"),
        F.when(i % 3 == 0, F.lit(5)).otherwise((i * 31) % 11).alias("tied"),
        F.when(i % 2 == 0, F.lit(float("nan"))).otherwise(-i).alias("gaps"),
        F.lit(None).cast("double").alias("none"),
    )
    names, points = ["skewed", "tied", "gaps", "none"], [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    kept = sketches.column_sketches(df, names, F.col("file"))
    assert kept.count() == 7 * len(names)
    found = {r["column"]: r for r in sketches.sketched_profile(kept, points).collect()}
    assert found["none"]["quantiles"] is None and found["none"]["present"] == 0 and found["none"]["mean"] is None
    for name in names[:3]:
        values = sorted(r[0] for r in df.select(F.col(name).cast("double")).filter(~F.isnan(name)).collect())
        row = found[name]
        assert (row["rows"], row["present"], row["min"], row["max"]) == (rows, len(values), values[0], values[-1])
        assert row["mean"] == pytest.approx(sum(values) / len(values))
        for point, value in zip(points, row["quantiles"]):
            low, high = bisect.bisect_left(values, value), bisect.bisect_right(values, value)
            assert low < high and low / len(values) - 2 / sketches.ACCURACY <= point <= high / len(values) + 2 / sketches.ACCURACY

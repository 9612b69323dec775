"""A made-up data set with one column per role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PLANS = ["Basic", "Team", "Scale", "Group"]


def sample_metrics(spark: SparkSession, rows: int = 365, seed: int = 7) -> DataFrame:
    """A row a day from the start of 2024; the values follow from the day and the seed, however rows are spread."""

    def share(salt: int):
        """Evenly from 0 below 1."""
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 20)) / (1 << 20)

    users = F.floor(share(1) * 115 + 5)
    price = F.element_at(F.array(*[F.lit(p) for p in (9.5, 24.0, 79.0, 190.0)]), (F.floor(share(2) * 4) + 1).cast("int"))
    plan = F.element_at(F.array(*map(F.lit, PLANS)), (F.floor(share(2) * 4) + 1).cast("int"))
    return spark.range(rows).select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"),
        users.alias("users"),
        F.round(users * price, 2).alias("revenue"),
        (share(3) < 0.1).cast("int").alias("churn"),
        F.round(0.8 + share(4) / 5, 2).alias("retention"),
        plan.alias("plan"),
        F.floor(share(5) * 200).alias("engagement"),
        F.round(price * (3 + share(6) * 33), 2).alias("ltv"),
    )

"""Calendar months and Monday-to-Sunday weeks.

Rows are grouped on the first day of their period, a plain date; the text
label is made afterwards, on the few grouped rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def period_start(moment: Column, unit: str) -> Column:
    return F.date_trunc({"month": "MONTH", "week": "WEEK"}[unit], moment).cast("date")


def period_label(start: Column, unit: str) -> Column:
    """'2024-01' for a month, '2024-01-01/2024-01-07' for a week."""
    if unit == "month":
        return F.date_format(start, "yyyy-MM")
    return F.concat_ws("/", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))


def whole_days(first: Column, moment: Column) -> Column:
    """Full days between two moments: 47 hours are one day."""
    return F.timestamp_diff("DAY", first, moment)

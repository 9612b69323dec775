"""Numbers as dashboard text, guarded division, and threshold bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or ``default`` where b is 0; unknown inputs stay unknown."""
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(default))).otherwise(F.try_divide(a, b))


def growth_pct(current: Column, previous: Column) -> Column:
    """Change in percent; 0 where there is nothing to compare with."""
    return F.coalesce(safe_div((current - previous).cast("double"), previous.cast("double")) * 100, F.lit(0.0))


def fixed(value: Column, decimals: int = 1, grouped: bool = False) -> Column:
    whole = "#,##0" if grouped else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(whole + ("." + "0" * decimals if decimals else "")))


def fmt_number(value: Column, decimals: int = 0) -> Column:
    """1500 is '1.5K', 2500000 is '2.5M', smaller ones are written out."""
    return (
        F.when(value >= 1_000_000, F.concat(fixed(value / 1_000_000), F.lit("M")))
        .when(value >= 1_000, F.concat(fixed(value / 1_000), F.lit("K")))
        .otherwise(fixed(value, decimals, grouped=True))
    )


def fmt_currency(value: Column, symbol: str = "$") -> Column:
    """2500 is '$2.5K', 2500000 is '$2.50M', smaller ones show cents."""
    text = (
        F.when(value >= 1_000_000, F.concat(fixed(value / 1_000_000, 2), F.lit("M")))
        .when(value >= 1_000, F.concat(fixed(value / 1_000), F.lit("K")))
        .otherwise(fixed(value, 2, grouped=True))
    )
    return F.concat(F.lit(symbol), text)


def fmt_pct(value: Column, decimals: int = 1) -> Column:
    """A percentage; values from 0 to 1 are taken as ratios."""
    return plain_pct(F.when(value.between(0, 1), value * 100).otherwise(value), decimals)


def plain_pct(value: Column, decimals: int = 1) -> Column:
    return F.concat(fixed(value, decimals), F.lit("%"))


def signed_fixed(value: Column, decimals: int = 1) -> Column:
    digits = "0." + "0" * decimals
    return F.call_function("format_number", value.cast("double"), F.lit(f"+{digits};-{digits}"))


def signed_pct(value: Column, decimals: int = 1) -> Column:
    return F.concat(signed_fixed(value, decimals), F.lit("%"))


def _change(current: Column, previous: Column) -> Column:
    return F.try_divide(current - previous, F.abs(previous)) * 100


def delta_label(current: Column, previous: Column) -> Column:
    """'+12.3%', or 'N/A' where there is nothing to compare with."""
    return F.coalesce(signed_pct(_change(current, previous)), F.lit("N/A"))


def delta_tone(current: Column, previous: Column) -> Column:
    change = _change(current, previous)
    return F.when(change.isNull(), "off").when(change >= 0, "normal").otherwise("inverse")


def accuracy_band(score: Column) -> Column:
    """Fixed limits: 80 and 65 percent."""
    return F.when(score >= 80, "Excellent").when(score >= 65, "Moderate").when(score.isNotNull(), "Low")


def mail_band(score: Column) -> Column:
    """Fixed limit: 70 percent."""
    return F.when(score >= 70, "ok").when(score.isNotNull(), "warn")


def gauge_pct(value: Column, maximum: Column) -> Column:
    """Share of the maximum in percent, at most 150, 0 without a maximum."""
    return F.when(maximum > 0, F.least(value / maximum * 100, F.lit(150.0))).otherwise(F.lit(0.0))


def gauge_band(pct: Column) -> Column:
    """Fixed limits: 70 and 90 percent."""
    return F.when(pct < 70, "success").when(pct < 90, "warning").otherwise("danger")


def risk_level(probability: Column) -> Column:
    """Right-closed bands up to 0.3, 0.6 and 1; exactly 0 belongs to none."""
    return (
        F.when((probability > 0) & (probability <= 0.3), "Low")
        .when((probability > 0.3) & (probability <= 0.6), "Medium")
        .when((probability > 0.6) & (probability <= 1), "High")
    )


def value_band(value: Column, low: Column, high: Column, labels: Sequence[str]) -> Column:
    """Three right-closed bands of equal width between ``low`` and ``high``."""
    step = (high - low) / 3
    banded = (
        F.when(low == high, labels[1])
        .when(value <= low + step, labels[0])
        .when(value <= low + step * 2, labels[1])
        .otherwise(labels[2])
    )
    return F.when(value.isNotNull(), banded)


def direction(pct: Column, limit: float) -> Column:
    return F.when(pct > limit, "Increasing").when(pct < -limit, "Decreasing").otherwise("Stable")


# The sign shown for each notification type, and for any other.
NOTIFICATION_ICONS = {"success": "✅", "warning": "⚠️", "error": "❌"}
DEFAULT_ICON = "ℹ️"


def notification_icon(kind: Column) -> Column:
    icon = F.lit(DEFAULT_ICON)
    for name, sign in NOTIFICATION_ICONS.items():
        icon = F.when(kind == name, sign).otherwise(icon)
    return icon


def clean_email(email: Column) -> Column:
    return F.lower(F.regexp_replace(email, r"^\s+|\s+$", ""))


def display_name(name: Column, email: Column) -> Column:
    """The name, or what stands before the @ of the address."""
    return F.coalesce(name, F.split_part(email, F.lit("@"), F.lit(1)))

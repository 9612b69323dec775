"""Column names: normalising, searching, and finding the role a column plays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The keywords of each role, best first.
ROLE_KEYWORDS = {
    "date": ["date", "created_at", "signup", "month", "week", "period", "timestamp", "time", "day"],
    "revenue": ["revenue", "mrr", "arr", "amount", "sales", "income", "gmv", "payment", "price", "value"],
    "users": ["user", "customer", "account", "subscriber", "client", "member", "count"],
    "churn": ["churn", "cancel", "attrition", "left", "quit"],
    "retention": ["retention", "retained", "keep", "renew"],
    "plan": ["plan", "tier", "subscription", "product", "package", "segment", "category"],
    "engagement": ["engagement", "session", "login", "active", "dau", "mau", "visit", "pageview"],
    "ltv": ["ltv", "clv", "lifetime", "lv"],
}


class MissingRole(ValueError):
    """No column of the frame plays a role that an analysis needs."""


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalise_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def normalised_names(names: Iterable[str]) -> list[str]:
    """Normalised names; a repeated one gets a number so that all stay addressable."""
    taken: set[str] = set()
    result = []
    for name in map(normalise_name, names):
        candidate, n = name, 1
        while candidate in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        result.append(candidate)
    return result


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalised_names(df.columns))


def resolve_role(columns: Iterable[str], role: str) -> str | None:
    """The column for ``role``: best keyword first, then leftmost column.

    Names that differ only in case count as one column, at the place of the
    first spelling but returned in the last one.
    """
    spelling: dict[str, str] = {}
    for name in columns:
        spelling[name.lower()] = name
    hits = [
        (rank, place, name)
        for place, (lower, name) in enumerate(spelling.items())
        for rank, word in enumerate(ROLE_KEYWORDS[role])
        if word in lower
    ]
    return min(hits)[2] if hits else None


def find_role(df: DataFrame, role: str, roles: dict[str, str] | None = None) -> str | None:
    """The column for ``role``, where ``roles`` overrules the name search."""
    if roles and role in roles:
        return roles[role]
    return resolve_role(df.columns, role)


def need_role(df: DataFrame, role: str, roles: dict[str, str] | None = None) -> str:
    name = find_role(df, role, roles)
    if name is None:
        raise MissingRole(f"No {role} column among {', '.join(df.columns)}")
    return name


def project_roles(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """One column per role that was found, named after the role."""
    found = {role: find_role(df, role, roles) for role in ROLE_KEYWORDS}
    return df.select(*[quoted(name).alias(role) for role, name in found.items() if name])


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def search_columns(df: DataFrame, text: str) -> DataFrame:
    """The columns whose name contains ``text``; all of them when none does."""
    matches = [c for c in df.columns if text.lower() in c.lower()]
    return df.select(*[quoted(c) for c in matches or df.columns])

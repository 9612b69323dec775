"""History tables: profiles, logins, data sets, reports, predictions, notifications.

The tables are Parquet folders with fixed columns, named by snapshots (``store``). Appends add
a folder; updates and deletes give the new content of a table as a DataFrame, which
``change`` or ``replace`` puts in the place of the old one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.kpi import clean_email, display_name
from ..functions.roles import quoted
from . import store

# Columns, types and defaults of the tables.
TABLES = {
    "profiles": "id string, email string, full_name string, avatar_url string, provider string, "
    "created_at timestamp, updated_at timestamp",
    "login_history": "id string, user_id string, email string, provider string, user_agent string, created_at timestamp",
    "datasets": "id string, user_id string, name string, rows int, cols int, columns_json string, created_at timestamp",
    "reports": "id string, user_id string, title string, report_type string, summary string, created_at timestamp",
    "predictions": "id string, user_id string, prediction_type string, model_name string, accuracy double, "
    "summary string, created_at timestamp",
    "notifications": "id string, user_id string, title string, message string, type string, read boolean, "
    "created_at timestamp",
}
DEFAULTS = {
    "profiles": {"full_name": "", "avatar_url": "", "provider": "email"},
    "login_history": {"user_agent": ""},
    "datasets": {"rows": 0, "cols": 0, "columns_json": "[]"},
    "reports": {"report_type": "analytics", "summary": ""},
    "predictions": {"model_name": "", "accuracy": 0.0, "summary": ""},
    "notifications": {"message": "", "type": "info", "read": False},
}
REQUIRED = {
    "profiles": ["id", "email"],
    "login_history": ["user_id"],
    "datasets": ["user_id", "name"],
    "reports": ["user_id", "title"],
    "predictions": ["user_id", "prediction_type"],
    "notifications": ["user_id", "title"],
}
TEXT_LIMITS = {"user_agent": 200, "summary": 3000}
ACCURACY_DECIMALS = 4


def table_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def new_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows in the shape of a table: typed, cut to length, defaults filled in.

    A required value that is missing stops the job, as the database would.
    """
    given = set(df.columns)
    columns = []
    for field in table_schema(table).fields:
        name = field.name
        value = quoted(name) if name in given else F.lit(None)
        if name in TEXT_LIMITS:
            value = F.left(value.cast("string"), F.lit(TEXT_LIMITS[name]))
        if name == "accuracy":
            value = F.round(value.cast("double"), ACCURACY_DECIMALS)
        value = value.cast(field.dataType)
        if name in REQUIRED[table]:
            problem = F.raise_error(F.lit(f"{table}.{name} must not be null")).cast(field.dataType)
            value = F.coalesce(value, problem)
        elif name == "id":
            value = F.coalesce(value, F.uuid())
        elif name in ("created_at", "updated_at"):
            value = F.coalesce(value, F.current_timestamp())
        elif name in DEFAULTS[table]:
            value = F.coalesce(value, F.lit(DEFAULTS[table][name]).cast(field.dataType))
        columns.append(value.alias(name))
    return df.select(*columns)


def current_version(spark: SparkSession, table: str, folder: str) -> int | None:
    """How often the table was rewritten; None before the first rows."""
    state = store.latest(spark, folder)[1]
    return state[table]["version"] if table in state else None


def append(df: DataFrame, table: str, folder: str) -> None:
    """Add rows to the table below ``folder``; several jobs may do so at once."""
    store.append(new_rows(df, table), table, folder)


def replace(df: DataFrame, table: str, folder: str, since: int | None = None) -> None:
    """Make ``df``, which may be read from the table, its content; see ``store.replace`` for ``since``.

    Readers see the old content until the new one is whole, also if a job stops halfway.
    """
    store.replace(new_rows(df, table), table, folder, since)


def change(spark: SparkSession, table: str, folder: str, how: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrite the table by ``how``; what other jobs add meanwhile is worked on too."""
    store.rewrite(spark, folder, {table: (table_schema(table), lambda rows: new_rows(how(rows), table))})


def read_table(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """The table as of the last snapshot."""
    return store.frame(spark, store.latest(spark, folder)[1], table, table_schema(table), folder)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables as of one snapshot."""
    state = store.latest(spark, folder)[1]
    return {t: store.frame(spark, state, t, table_schema(t), folder) for t in TABLES}


def catalogue_row(df: DataFrame, name: str, user_id: Column | None = None) -> DataFrame:
    """One row that describes a data set: its shape and column names."""
    names = json.dumps(df.columns, ensure_ascii=False, separators=(",", ":"))
    columns = [] if user_id is None else [user_id.alias("user_id")]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        *columns,
        F.lit(name).alias("name"),
        F.col("rows"),
        F.lit(len(df.columns)).alias("cols"),
        F.lit(names).alias("columns_json"),
    )


def upload_notifications(catalogue: DataFrame) -> DataFrame:
    """A notification for each catalogue row."""
    return catalogue.select(
        *[c for c in ("user_id",) if c in catalogue.columns],
        F.lit("Dataset Uploaded").alias("title"),
        F.concat("name", F.lit(" loaded ("), F.format_number("rows", 0), F.lit(" rows)")).alias("message"),
        F.lit("success").alias("type"),
    )


def saved_notifications(reports: DataFrame) -> DataFrame:
    """A notification for each saved report."""
    return reports.select(
        *[c for c in ("user_id",) if c in reports.columns],
        F.lit("Report Saved").alias("title"),
        F.concat("title", F.lit(" has been saved.")).alias("message"),
        F.lit("info").alias("type"),
    )


def prediction_notifications(predictions: DataFrame) -> DataFrame:
    """A notification for each model that was run, with its score if it has one."""
    score = F.when(F.col("accuracy").isNotNull(), F.concat(F.lit(", score "), F.format_number("accuracy", 1))).otherwise("")
    return predictions.select(
        *[c for c in ("user_id",) if c in predictions.columns],
        F.concat("prediction_type", F.lit(" Complete")).alias("title"),
        F.concat("model_name", score).alias("message"),
        F.lit("success").alias("type"),
    )


def append_catalogue(batch: DataFrame, folder: str) -> None:
    """Add to the stored catalogue what isn't in it yet, so that a second run adds nothing."""
    existing = read_table(batch.sparkSession, "datasets", folder)
    append(new_catalogue_rows(batch, existing), "datasets", folder)


def new_catalogue_rows(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """The rows of a catalogue batch that are not in the catalogue yet."""
    key = ["user_id", "name", "rows", "cols", "columns_json"]
    return batch.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


# -- profiles -------------------------------------------------------------------


def clean_profiles(profiles: DataFrame) -> DataFrame:
    """Addresses trimmed and in lower case; a missing name is taken from the address."""
    email = clean_email(F.col("email"))
    return profiles.withColumn("full_name", display_name(F.col("full_name"), email)).withColumn("email", email)


def upsert_profiles(
    current: DataFrame, batch: DataFrame, order: str = "seq", now: Column | None = None
) -> DataFrame:
    """The profiles after a batch: known ids are updated, new ones added.

    The last version by ``order`` wins. Columns that the batch does not have
    keep their value; ``created_at`` is the first one and ``updated_at`` is
    refreshed, if the profiles have them. The best row per id is found by an
    aggregation, which keeps one candidate per id and task, so an id with very
    many versions does not pile up anywhere.
    """
    now = F.current_timestamp() if now is None else now
    stamps = [c for c in ("created_at", "updated_at") if c in current.columns]
    values = [c for c in batch.columns if c not in ("id", order, *stamps)]
    kept = [c for c in current.columns if c not in ("id", *values, *stamps)]
    both = current.withColumn(order, F.lit(None).cast(batch.schema[order].dataType)).unionByName(
        batch, allowMissingColumns=True
    )
    # Struct order puts the stored row (no order) before every row of the batch.
    is_new = F.col(order).isNotNull()
    newest = F.max_by(F.struct(*values), F.struct(is_new, F.col(order))).alias("row")
    # Only the stored row of an id has the columns that the batch lacks.
    stored = [F.max(F.when(~is_new, F.col(c))).alias(c) for c in kept]
    times = {
        "created_at": lambda: F.coalesce(F.min("created_at"), now),
        "updated_at": lambda: F.when(F.bool_or(is_new), now).otherwise(F.max(F.when(~is_new, F.col("updated_at")))),
    }
    result = both.groupBy("id").agg(newest, *stored, *[times[c]().alias(c) for c in stamps])
    return result.select("id", "row.*", *kept, *stamps)


def lookup_unique(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """For each key the row it has in the table, if it has exactly one.

    Rows of other keys are dropped before the table is shuffled.
    """
    values = [c for c in table.columns if c != key]
    wanted = keys.select(key).distinct()
    single = (
        table.join(wanted, key, "left_semi")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*values)).alias("row"))
        .filter("n = 1")
        .select(key, "row.*")
    )
    return wanted.join(single, key, "left")


def get_row(table: DataFrame, key: str, value) -> DataFrame:
    """The row where ``key`` is ``value``, or no row unless exactly one matches."""
    # Two rows tell as much as all of them.
    matches = table.filter(quoted(key) == value).limit(2)
    count = F.count(F.lit(1)).over(Window.partitionBy())
    return matches.withColumn("n", count).filter("n = 1").drop("n")


# -- references between tables -----------------------------------------------------


def valid_rows(child: DataFrame, profiles: DataFrame) -> DataFrame:
    return child.join(profiles.select(F.col("id").alias("user_id")), "user_id", "left_semi").select(*child.columns)


def orphan_rows(child: DataFrame, profiles: DataFrame) -> DataFrame:
    return child.join(profiles.select(F.col("id").alias("user_id")), "user_id", "left_anti").select(*child.columns)


def reference_summary(children: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """Rows and orphans of each child table.

    Each table is counted per user first, so the join sees one row per user.
    """
    ids = profiles.select(F.col("id").alias("user_id")).distinct().withColumn("known", F.lit(True))
    parts = []
    for name, child in children.items():
        per_user = child.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        joined = per_user.join(ids, "user_id", "left")
        orphans = F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0))
        parts.append(joined.agg(
            F.lit(name).alias("table"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(orphans, F.lit(0)).alias("orphans"),
        ))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def cascade_delete(child: DataFrame, deleted: DataFrame) -> DataFrame:
    """The rows of a child table that remain when profiles are deleted."""
    return child.join(deleted.select(F.col("id").alias("user_id")), "user_id", "left_anti").select(*child.columns)


#: The tables whose rows belong to a profile.
CHILDREN = ("login_history", "datasets", "reports", "predictions", "notifications")


def delete_profiles(spark: SparkSession, folder: str, deleted: DataFrame) -> None:
    """Delete profiles (column id) and all their rows in the stored tables, which change in one step."""
    gone = deleted.select(F.col("id").cast("string").alias("id")).distinct()
    changes = {t: (table_schema(t), lambda rows: cascade_delete(rows, gone)) for t in CHILDREN}
    changes["profiles"] = (table_schema("profiles"), lambda rows: rows.join(gone, "id", "left_anti"))
    store.rewrite(spark, folder, changes)


def owner_delete(table: DataFrame, requests: DataFrame) -> DataFrame:
    """The rows that remain; a request removes a row only if it names its owner."""
    return table.join(requests.select("id", "user_id"), ["id", "user_id"], "left_anti").select(*table.columns)


def mark_read(notifications: DataFrame, user_id) -> DataFrame:
    return notifications.withColumn("read", F.when(F.col("user_id") == user_id, True).otherwise(F.col("read")))


# -- recent rows ------------------------------------------------------------------


def recent_per_user(table: DataFrame, n: int) -> DataFrame:
    """The latest n rows of every user.

    Spark keeps only n rows per user and task before the shuffle (for n up to
    a thousand), so a user with very many rows is no heavier than another.
    """
    latest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    return table.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= n)


def recent(table: DataFrame, n: int) -> DataFrame:
    """The latest n rows of all."""
    return table.orderBy(F.desc("created_at"), "id").limit(n)


def unread_summary(notifications: DataFrame) -> DataFrame:
    """Unread notifications per user, with the title of the latest one; of several at that time the smallest id."""
    unread = notifications.filter(~F.col("read"))
    return unread.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("unread"),
        F.max("created_at").alias("latest_at"),
        F.min_by("title", F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), F.col("id").alias("i"))).alias("latest_title"),
    )


def login_lines(logins: DataFrame) -> DataFrame:
    """Each login as a line: minute, provider, start of the user agent."""
    line = F.concat_ws(
        " — ",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm"),
        F.initcap(F.coalesce("provider", F.lit(""))),
        F.left(F.coalesce("user_agent", F.lit("")), F.lit(80)),
    )
    return logins.select("id", "user_id", line.alias("line"))


def short_labels(table: DataFrame, name: str) -> DataFrame:
    """Names cut to 30 characters, with the date part of their time."""
    return table.select(
        "id",
        F.left(quoted(name), F.lit(30)).alias("label"),
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
    )


"""History tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import history
from ..session import new_folder
from .inputs import (
    IN_DEBT, LOGINS_SQL, NOTIFICATIONS_SQL, PROFILE_BATCH_SQL, PROFILES_SQL, SOLVENT_PROFILES_SQL, logins, notifications,
    profile_batch, profiles, table,
)
from .registry import query

CATALOGUED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def names_sql(columns: list[str]) -> str:
    return '["' + '","'.join(columns) + '"]'


@query(
    "dataset_catalogue",
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, COUNT(*) AS rows, {len(c)} AS cols, '{names_sql(c)}' AS columns_json FROM {t}"
        for t, c in CATALOGUED.items()
    ),
)
def dataset_catalogue(spark, folder):
    rows = [history.catalogue_row(table(spark, folder, name), name) for name in CATALOGUED]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(
    "upload_notifications",
    " UNION ALL ".join(
        f"""SELECT 'Dataset Uploaded' AS title, '{t} loaded (' || format('{{:,}}', COUNT(*)) || ' rows)' AS message,
            'success' AS type FROM {t}"""
        for t in CATALOGUED
    ),
)
def upload_notifications(spark, folder):
    return history.upload_notifications(dataset_catalogue(spark, folder))


@query(
    "history_append",
    f"SELECT CAST(user_id AS VARCHAR) AS user_id, provider, user_agent, created_at FROM {LOGINS_SQL}",
)
def history_append(spark, folder):
    store, rows = new_folder(spark, "history"), logins(spark, folder).drop("id")
    history.append(rows.filter("provider = 'email'"), "login_history", store)
    history.append(rows.filter("provider = 'google'"), "login_history", store)
    stored = history.read_table(spark, "login_history", store)
    moment = F.col("created_at").cast("timestamp_ntz").alias("created_at")
    return stored.select("user_id", "provider", "user_agent", moment)


@query(
    "profile_normalise",
    f"""SELECT id, LOWER(TRIM(email)) AS email, COALESCE(full_name, split_part(LOWER(TRIM(email)), '@', 1)) AS full_name, provider
        FROM {PROFILES_SQL}""",
)
def profile_normalise(spark, folder):
    return history.clean_profiles(profiles(spark, folder))


# When the profiles were made and when the batch came in.
MADE, CAME = "2024-01-01 08:00:00", "2024-06-01 09:30:00"


@query(
    "profile_upsert",
    f"""SELECT id, email, full_name, provider,
            CASE WHEN bool_or(seq = 0) THEN TIMESTAMP '{MADE}' ELSE TIMESTAMP '{CAME}' END AS created_at,
            CASE WHEN bool_or(seq > 0) THEN TIMESTAMP '{CAME}' ELSE TIMESTAMP '{MADE}' END AS updated_at
        FROM (SELECT id, seq,
                  LAST_VALUE(email) OVER w AS email, LAST_VALUE(full_name) OVER w AS full_name, LAST_VALUE(provider) OVER w AS provider
              FROM (SELECT *, 0 AS seq FROM {PROFILES_SQL} UNION ALL SELECT * FROM {PROFILE_BATCH_SQL})
              WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        GROUP BY id, email, full_name, provider""",
)
def profile_upsert(spark, folder):
    """Updated, written as the next version of the table, and read back."""
    store, made = new_folder(spark, "history"), F.lit(MADE).cast("timestamp")
    stamped = profiles(spark, folder).withColumns({"full_name": F.coalesce("full_name", F.lit("")), "created_at": made, "updated_at": made})
    history.append(stamped, "profiles", store)
    current = history.read_table(spark, "profiles", store)
    batch = profile_batch(spark, folder).withColumn("id", F.col("id").cast("string"))
    history.replace(history.upsert_profiles(current, batch, now=F.lit(CAME).cast("timestamp")), "profiles", store)
    stored = history.read_table(spark, "profiles", store)
    stamps = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")]
    name = F.when((F.col("full_name") != "") | (F.col("updated_at") > F.col("created_at")), F.col("full_name")).alias("full_name")
    return stored.select(F.col("id").cast("long").alias("id"), "email", name, "provider", *stamps)


@query("profile_by_id", f"SELECT * FROM {PROFILES_SQL} WHERE id = 42")
def profile_by_id(spark, folder):
    return history.get_row(profiles(spark, folder), "id", 42)


@query(
    "catalogue_append",
    " UNION ALL ".join(
        f"SELECT 'u1' AS user_id, '{t}' AS name, CAST(COUNT(*) AS INTEGER) AS rows, {len(c)} AS cols, '{names_sql(c)}' AS columns_json FROM {t}"
        for t, c in CATALOGUED.items()
    ),
)
def catalogue_append(spark, folder):
    """The same upload twice adds each data set once."""
    store, batch = new_folder(spark, "history"), dataset_catalogue(spark, folder).withColumn("user_id", F.lit("u1"))
    history.append_catalogue(batch, store)
    history.append_catalogue(batch, store)
    return history.read_table(spark, "datasets", store).select("user_id", "name", "rows", "cols", "columns_json")


@query(
    "point_lookup",
    f"""SELECT k.id, p.email, p.full_name, p.provider FROM (SELECT DISTINCT user_id AS id FROM events) k
        LEFT JOIN {SOLVENT_PROFILES_SQL} p ON p.id = k.id""",
)
def point_lookup(spark, folder):
    keys = table(spark, folder, "events").select(F.col("user_id").alias("id"))
    return history.lookup_unique(profiles(spark, folder, absent=IN_DEBT), keys)


@query(
    "referential_check",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", COUNT(*) AS rows, COUNT(*) FILTER (WHERE p.id IS NULL) AS orphans
            FROM {child} c LEFT JOIN {SOLVENT_PROFILES_SQL} p ON p.id = c.user_id"""
        for name, child in (("login_history", LOGINS_SQL), ("notifications", NOTIFICATIONS_SQL))
    ),
)
def referential_check(spark, folder):
    children = {"login_history": logins(spark, folder), "notifications": notifications(spark, folder)}
    return history.reference_summary(children, profiles(spark, folder, absent=IN_DEBT))


@query("referential_valid", f"SELECT * FROM {LOGINS_SQL} WHERE user_id IN (SELECT id FROM {SOLVENT_PROFILES_SQL})")
def referential_valid(spark, folder):
    return history.valid_rows(logins(spark, folder), profiles(spark, folder, absent=IN_DEBT))


@query("referential_orphans", f"SELECT * FROM {LOGINS_SQL} WHERE user_id NOT IN (SELECT id FROM {SOLVENT_PROFILES_SQL})")
def referential_orphans(spark, folder):
    return history.orphan_rows(logins(spark, folder), profiles(spark, folder, absent=IN_DEBT))


@query(
    "cascade_delete",
    f"SELECT * FROM {LOGINS_SQL} WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def cascade_delete(spark, folder):
    deleted = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'")
    return history.cascade_delete(logins(spark, folder), deleted.select(F.col("c_custkey").alias("id")))


ORDERED_SQL = {
    "datasets": "SELECT o_custkey AS user_id, 'orders-' || o_orderkey AS name FROM orders",
    "reports": "SELECT o_custkey AS user_id, 'Order ' || o_orderkey AS title FROM orders WHERE o_orderstatus = 'F'",
    "predictions": "SELECT o_custkey AS user_id, 'Churn Prediction' AS prediction_type, 'Random Forest Classifier' AS model_name, "
    "o_custkey % 1000 / 8 AS accuracy FROM orders WHERE o_orderstatus = 'O'",
}


def from_orders(spark, folder):
    """Rows of the tables that orders stand in for."""
    orders = table(spark, folder, "orders")
    user, key = F.col("o_custkey").alias("user_id"), F.col("o_orderkey").cast("string")
    return {
        "datasets": orders.select(user, F.concat(F.lit("orders-"), key).alias("name")),
        "reports": orders.filter("o_orderstatus = 'F'").select(user, F.concat(F.lit("Order "), key).alias("title")),
        "predictions": orders.filter("o_orderstatus = 'O'").select(
            user, F.lit("Churn Prediction").alias("prediction_type"), F.lit("Random Forest Classifier").alias("model_name"),
            (F.col("o_custkey") % 1000 / 8).alias("accuracy"),
        ),
    }


@query(
    "cascade_all_tables",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", COUNT(*) AS rows, COUNT(DISTINCT user_id) AS users FROM ({sql})
            WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""
        for name, sql in {
            **ORDERED_SQL, "login_history": f"SELECT user_id FROM {LOGINS_SQL}", "notifications": f"SELECT user_id FROM {NOTIFICATIONS_SQL}",
            "profiles": f"SELECT id AS user_id FROM {PROFILES_SQL}",
        }.items()
    ),
)
def cascade_all_tables(spark, folder):
    """Profiles deleted with all their rows in the stored tables, which are read back as of one snapshot."""
    store = new_folder(spark, "history")
    history.append(profiles(spark, folder), "profiles", store)
    for name, rows in {**from_orders(spark, folder), "login_history": logins(spark, folder), "notifications": notifications(spark, folder)}.items():
        history.append(rows, name, store)
    deleted = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'")
    history.delete_profiles(spark, store, deleted.select(F.col("c_custkey").alias("id")))
    counts = [
        rows.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_distinct("id" if name == "profiles" else "user_id").alias("users"))
        for name, rows in history.read_tables(spark, store).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query(
    "report_notifications",
    f"SELECT user_id, 'Report Saved' AS title, title || ' has been saved.' AS message, 'info' AS type FROM ({ORDERED_SQL['reports']})",
)
def report_notifications(spark, folder):
    return history.saved_notifications(from_orders(spark, folder)["reports"])


@query(
    "model_notifications",
    f"""SELECT user_id, prediction_type || ' Complete' AS title, model_name || ', score ' || format('{{:,.1f}}', accuracy) AS message, 'success' AS type
        FROM ({ORDERED_SQL['predictions']})""",
)
def model_notifications(spark, folder):
    return history.prediction_notifications(from_orders(spark, folder)["predictions"])


# Requests name an owner; where the value is high they name the wrong one.
REQUESTS_SQL = """(SELECT event_id AS id, CASE WHEN value > 50 THEN user_id + 1 ELSE user_id END AS user_id
    FROM events WHERE event_type = 'click')"""


@query(
    "owner_delete",
    f"""SELECT n.* FROM {NOTIFICATIONS_SQL} n
        WHERE NOT EXISTS (SELECT 1 FROM {REQUESTS_SQL} r WHERE r.id = n.id AND r.user_id = n.user_id)""",
)
def owner_delete(spark, folder):
    """Deleted in the stored table, and read back."""
    owner = F.when(F.col("value") > 50, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id")
    clicks = table(spark, folder, "events").filter("event_type = 'click'")
    requests = clicks.select(F.col("event_id").cast("string").alias("id"), owner.cast("string").alias("user_id"))
    return written_back(spark, folder, lambda stored: history.owner_delete(stored, requests))


def written_back(spark, folder, change):
    """The notifications after a change of the stored table, with ids as in the given one."""
    store = new_folder(spark, "history")
    history.append(notifications(spark, folder), "notifications", store)
    history.change(spark, "notifications", store, change)
    after = history.read_table(spark, "notifications", store)
    ids = {c: F.col(c).cast("long") for c in ("id", "user_id")}
    return after.withColumns({**ids, "created_at": F.col("created_at").cast("timestamp_ntz")})


@query("mark_read", f"SELECT * REPLACE (user_id = 7 OR read AS read) FROM {NOTIFICATIONS_SQL}")
def mark_read(spark, folder):
    return written_back(spark, folder, lambda stored: history.mark_read(stored, "7"))


@query(
    "unread_notifications",
    f"""SELECT user_id, COUNT(*) AS unread, MAX(created_at) AS latest_at, ARG_MIN(title, (-epoch_us(created_at), id)) AS latest_title
        FROM {NOTIFICATIONS_SQL} WHERE NOT read GROUP BY user_id""",
)
def unread_notifications(spark, folder):
    return history.unread_summary(notifications(spark, folder))


@query(
    "recent_unread",
    f"""SELECT id, user_id, title, created_at, CAST(place AS INTEGER) AS place FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place
            FROM {NOTIFICATIONS_SQL} WHERE NOT read) WHERE place <= 5""",
)
def recent_unread(spark, folder):
    unread = notifications(spark, folder).filter("NOT read")
    return history.recent_per_user(unread, 5).select("id", "user_id", "title", "created_at", "place")


@query(
    "recent_per_user",
    f"""SELECT id, user_id, provider, user_agent, created_at, CAST(place AS INTEGER) AS place FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM {LOGINS_SQL})
        WHERE place <= 10""",
)
def recent_per_user(spark, folder):
    return history.recent_per_user(logins(spark, folder), 10)


@query("recent_history", f"SELECT * FROM {NOTIFICATIONS_SQL} ORDER BY created_at DESC, id LIMIT 20")
def recent_history(spark, folder):
    return history.recent(notifications(spark, folder), 20)


@query(
    "login_lines",
    f"""SELECT id, user_id, strftime(created_at, '%Y-%m-%dT%H:%M') || ' — ' || upper(provider[1]) || provider[2:] || ' — '
               || left(user_agent, 80) AS line FROM {LOGINS_SQL}""",
)
def login_lines(spark, folder):
    return history.login_lines(logins(spark, folder))


@query("short_labels", f"SELECT id, left(message, 30) AS label, strftime(created_at, '%Y-%m-%d') AS day FROM {NOTIFICATIONS_SQL}")
def short_labels(spark, folder):
    return history.short_labels(notifications(spark, folder), "message")

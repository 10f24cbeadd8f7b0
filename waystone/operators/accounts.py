"""Users, keys and permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import endpoint_of, has_permission, key_hash
from .topk import spread_join


def authorize_requests(
    requests: DataFrame,
    keys: DataFrame,
    users: DataFrame,
    limits: DataFrame | None = None,
    enforce_expiry: bool = False,
) -> DataFrame:
    """Verdict per request (id, created_at, raw_key, path).

    In this order: invalid_key (unknown, or key or user inactive), over_limit,
    forbidden (permission missing or endpoint unknown), ok. ``limits`` is
    (user_id, within_limit). Works on a stream of requests as well; one key may
    send any share of them.
    """
    active_users = users.filter("is_active").select(F.col("id").alias("user_id"), "plan_type")
    wanted = ["key_hash", "id", "user_id", "permissions"]
    if enforce_expiry:
        wanted.append("expires_at")
    valid = (
        keys.filter("is_active")
        .select(*wanted)
        .withColumnRenamed("id", "api_key_id")
        .join(active_users, "user_id")
    )
    if limits is not None:
        valid = valid.join(limits.select("user_id", "within_limit"), "user_id", "left")
    else:
        valid = valid.withColumn("within_limit", F.lit(True))
    hashed = requests.withColumn("key_hash", key_hash(F.col("raw_key"))).drop("raw_key")
    if requests.isStreaming:
        rows = hashed.join(valid, "key_hash", "left")
    else:
        rows = spread_join(hashed, valid, ["key_hash"], "id", "left")
    rows = rows.withColumn("endpoint", endpoint_of(F.col("path")))
    known = F.col("user_id").isNotNull()
    if enforce_expiry:
        known = known & (F.col("expires_at").isNull() | (F.col("expires_at") > F.col("created_at")))
    verdict = (
        F.when(~known, "invalid_key")
        .when(~F.coalesce("within_limit", F.lit(True)), "over_limit")
        .when(~has_permission(F.col("permissions"), F.col("endpoint")), "forbidden")
        .otherwise("ok")
    )
    return rows.select("id", "created_at", "user_id", "api_key_id", "endpoint",
                       verdict.alias("verdict"))


def key_inventory(keys: DataFrame, users: DataFrame) -> DataFrame:
    """All keys with the owner's address, newest first."""
    owners = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    return keys.join(owners, "user_id").orderBy(F.col("created_at").desc(), "id")


def keys_of_users(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """Active keys of the asked users (user_id), newest first within a user."""
    found = keys.filter("is_active").join(asked.select("user_id").distinct(), "user_id", "left_semi")
    return found.orderBy("user_id", F.col("created_at").desc(), "id")


def sync_admins(users: DataFrame, emails: DataFrame) -> DataFrame:
    """Users to change: listed by e-mail and not yet admin on the top plan."""
    listed = emails.select(F.trim("email").alias("email")).filter("email <> ''").distinct()
    due = users.filter("not is_admin or plan_type <> 'enterprise'")
    return (
        due.join(listed, "email", "left_semi")
        .withColumn("is_admin", F.lit(True))
        .withColumn("plan_type", F.lit("enterprise"))
    )


def bootstrap_admin(users: DataFrame) -> DataFrame:
    """The first user, made admin, if there is no admin yet; otherwise no row."""
    first = users.agg(
        F.min("id").alias("id"), F.max(F.coalesce("is_admin", F.lit(False))).alias("any_admin")
    ).filter(~F.col("any_admin"))
    return users.join(first.select("id"), "id", "left_semi").withColumn("is_admin", F.lit(True))

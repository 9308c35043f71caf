"""Verdicts over the log of owner requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafmeter.functions import columns as C
from leafmeter.limits import LIMITS, MAX_VERSION, SYNC_KEY_BEARER, Limits


def audit_access(
    requests: DataFrame, shares: DataFrame, objects: DataFrame, limits: Limits = LIMITS
) -> DataFrame:
    """Status code per logged request.

    ``requests`` holds ``request_id, route, slug, bearer, token, version, size``.  The routes are
    versions, raw, restore, delete, edit, list and claim.  ``size`` is the body size of an edit,
    NULL where it has none.
    """
    route, token = F.col("route"), F.col("token")
    bearer = F.col("bearer")
    key_hash = C.bearer_key_hash(bearer, SYNC_KEY_BEARER)
    wanted = F.when(F.col("version").rlike(r"^[0-9]+\z"), F.col("version").try_cast("bigint"))
    wanted = F.when(wanted.between(1, MAX_VERSION), wanted)
    known = shares.select("slug", "status", "edit_token_hash", "owner_key_hash", "latest_version")
    stored = objects.select("key", F.lit(True).alias("found"))
    log = (
        requests.select(
            "request_id",
            "route",
            "slug",
            "size",
            bearer.isNotNull().alias("has_bearer"),
            key_hash.alias("key_hash"),
            C.sha256_hex(token).alias("token_hash"),
            F.when(route.isin("raw", "restore"), wanted).alias("wanted"),
        )
        .withColumn("key", F.when(F.col("wanted").isNotNull(), C.object_key(F.col("slug"), F.col("wanted"))))
        .join(known, "slug", "left")
    )
    # Most rows name no object; a key of their own, which no object has, keeps them from meeting under NULL.
    none = F.concat(F.lit("\0"), F.col("request_id").cast("string"))
    log = log.withColumn("key", F.coalesce("key", none)).join(stored, "key", "left")
    malformed = F.col("has_bearer") & F.col("key_hash").isNull()
    no_credential = F.col("key_hash").isNull() & F.col("token_hash").isNull()
    status = F.col("status")
    versioned = route.isin("raw", "restore")
    # The two credentials never stand in for each other.
    allowed = F.coalesce(
        F.when(F.col("key_hash").isNotNull(), F.col("key_hash") == F.col("owner_key_hash")).otherwise(
            F.col("token_hash") == F.col("edit_token_hash")
        ),
        F.lit(False),
    )
    registry = F.when(F.col("key_hash").isNull(), 401).otherwise(200)
    edit = (
        F.when(F.col("size").isNull() | F.col("token_hash").isNull(), 400)
        .when(F.col("size") > limits.max_html_bytes, 413)
        .when(status.isNull() | (status == "deleted"), 404)
        .when(status != "committed", 409)
        .when(F.col("token_hash") != F.col("edit_token_hash"), 403)
        .otherwise(200)
    )
    delete = (
        F.when(malformed, 401)
        .when(no_credential, 400)
        .when(status.isNull(), 404)
        .when(status == "deleted", 200)
        .when(~allowed, 403)
        .otherwise(200)
    )
    history = (
        F.when(malformed, 401)
        .when(versioned & F.col("wanted").isNull(), 404)
        .when(no_credential, 400)
        .when(status.isNull(), 404)
        .when(status == "deleted", 410)
        .when(status != "committed", 409)
        .when(~allowed, 403)
        .when(versioned & (F.col("wanted") > F.col("latest_version")), 404)
        .when((route == "restore") & (F.col("wanted") == F.col("latest_version")), 400)
        .when(versioned & F.col("found").isNull(), 404)
        .otherwise(200)
    )
    code = (
        F.when(route.isin("list", "claim"), registry)
        .when(route == "edit", edit)
        .when(route == "delete", delete)
        .otherwise(history)
    )
    return log.select("request_id", "route", code.cast("bigint").alias("code"))


def access_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("route", "code").agg(F.count("*").alias("n"))

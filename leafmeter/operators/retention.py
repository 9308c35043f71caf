"""Retention of viewer data and the life cycle of shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafmeter.functions import columns as C
from leafmeter.limits import LIMITS
from leafmeter.sources.tables import RAW_VIEW_FIELDS, read_log, read_parts, replace_parts


def raw_fields_set() -> Column:
    """Whether a view still has any raw field."""
    return F.coalesce(*[F.col(c) for c in RAW_VIEW_FIELDS]).isNotNull()


def cleared(views: DataFrame, changed: Column) -> DataFrame:
    """Views with the raw fields of ``changed`` rows NULL."""
    return views.withColumns(
        {c: F.when(~changed, F.col(c)).alias(c) for c in RAW_VIEW_FIELDS}
    )


def with_due(views: DataFrame, shares: DataFrame, now: int) -> DataFrame:
    """Mark rows whose raw fields must go: past the retention time, or of a deleted share."""
    gone = shares.filter("status = 'deleted'").select("slug", F.lit(True).alias("_gone"))
    old = F.col("viewed_at") < now - LIMITS.pii_retention_seconds
    return (
        views.join(gone, "slug", "left")
        .withColumn("changed", raw_fields_set() & (old | F.coalesce("_gone", F.lit(False))))
        .drop("_gone")
    )


def anonymize_views(views: DataFrame, shares: DataFrame, now: int) -> DataFrame:
    """All view rows with a flag ``changed``; the raw fields of changed rows are NULL."""
    return cleared(with_due(views, shares, now), F.col("changed"))


def anonymize_log(shares: DataFrame, now: int, path: str) -> int:
    """Rewrite only the parts of the view log at ``path`` that hold rows to clear; their number."""
    spark = shares.sparkSession
    due = with_due(read_log(spark, path), shares, now).filter("changed")
    # One row a part, as many as the log has folders.
    found = due.groupBy("day", "batch").agg(F.count("*").alias("n")).collect()
    if found:
        part = with_due(read_parts(spark, path, [(row.day, row.batch) for row in found]), shares, now)
        replace_parts(cleared(part, F.col("changed")).drop("changed"), path)
    return sum(row.n for row in found)


def stale_pending(shares: DataFrame, now: int) -> DataFrame:
    return shares.filter(
        (F.col("status") == "pending") & (F.col("created_at") < now - LIMITS.pending_age_seconds)
    )


def purge_stale_pending(
    shares: DataFrame, views: DataFrame, now: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop uploads that never finished: remaining shares, remaining views, keys to delete."""
    stale = stale_pending(shares, now).select("slug")
    kept = shares.filter(
        ~((F.col("status") == "pending") & (F.col("created_at") < now - LIMITS.pending_age_seconds))
    )
    keys = stale.select(C.object_key(F.col("slug"), F.lit(1)).alias("key"))
    return kept, views.join(stale, "slug", "left_anti"), keys


def apply_deletes(
    deletes: DataFrame, shares: DataFrame, views: DataFrame, objects: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply let-through deletes: shares, views and the keys to delete.

    The first delete of a share counts; deletes of shares already deleted do nothing.  Unlike the
    sweep a delete takes every object below the share's folder, recognised or not.
    """
    hit = (
        deletes.groupBy("slug")
        .agg(F.min("ts").alias("delete_ts"))
        .join(shares.filter("status <> 'deleted'").select("slug"), "slug", "left_semi")
    )
    now_deleted = F.col("delete_ts").isNotNull()
    new_shares = (
        shares.join(hit, "slug", "left")
        .withColumn("status", F.when(now_deleted, "deleted").otherwise(F.col("status")))
        .withColumn("deleted_at", F.when(now_deleted, F.col("delete_ts")).otherwise(F.col("deleted_at")))
        .drop("delete_ts")
    )
    new_views = cleared(views.join(hit, "slug", "left"), now_deleted).drop("delete_ts")
    folder = F.regexp_extract("key", r"^shares/([^/]+)/", 1)
    below = objects.select("key", folder.alias("slug")).join(hit.select("slug"), "slug", "left_semi")
    flat = hit.select("slug", C.object_key(F.col("slug"), F.lit(1)).alias("key"))
    return new_shares, new_views, flat.unionByName(below.select("slug", "key"))


def retention_ledger(views: DataFrame, shares: DataFrame, now: int) -> DataFrame:
    """Per UTC day: rows, rows still raw, raw rows past the retention time, raw rows of deleted shares."""
    return ledger_of(ledger_groups(views, now), shares)


def ledger_groups(views: DataFrame, now: int) -> DataFrame:
    """Rows, raw rows and overdue ones per slug and day."""
    raw = raw_fields_set()
    old = F.col("viewed_at") < now - LIMITS.pii_retention_seconds
    return views.groupBy("slug", C.day_of(F.col("viewed_at")).alias("day_number")).agg(
        F.count("*").alias("rows"),
        F.count_if(raw).alias("raw"),
        F.count_if(raw & old).alias("overdue"),
    )


def ledger_of(per_slug: DataFrame, shares: DataFrame) -> DataFrame:
    """The ledger from its ``ledger_groups``."""
    gone = shares.filter("status = 'deleted'").select("slug", F.lit(True).alias("gone"))
    return (
        per_slug.join(gone, "slug", "left")
        .groupBy(C.day_text(F.col("day_number")).alias("day"))
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("raw").alias("raw"),
            F.sum("overdue").alias("overdue"),
            F.sum(F.when(F.col("gone"), F.col("raw")).otherwise(0)).cast("bigint").alias("deleted_raw"),
        )
    )


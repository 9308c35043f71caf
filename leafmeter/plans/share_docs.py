"""One statistics document per share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafmeter.functions import columns as C
from leafmeter.limits import LIMITS, Limits
from leafmeter.operators import stats


def _ranked_list(rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """At most a handful of ranked rows per slug as one array in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", *fields)))
    return rows.groupBy("slug").agg(
        F.transform(ordered, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name)
    )


def share_stats(shares: DataFrame, views: DataFrame, now: int, limits: Limits = LIMITS) -> DataFrame:
    """Nested statistics of every share."""
    counts = stats.share_counts(shares, views)
    referrers = _ranked_list(
        stats.referrer_breakdown(views, now, limits.top_referrers), "referrers", ["source", "views"]
    )
    locations = _ranked_list(
        stats.location_breakdown(views, now, limits.top_locations),
        "locations",
        ["country", "city", "label", "views"],
    )
    days = (
        stats.daily_trend(shares, views, now, limits.trend_days)
        .groupBy("slug")
        .agg(F.sort_array(F.collect_list(F.struct("date", "views"))).alias("dailyViews"))
    )
    empty = F.array()
    return (
        counts.join(referrers, "slug", "left")
        .join(locations, "slug", "left")
        .join(days, "slug")
        .select(
            "slug",
            C.iso_time(F.col("created_at")).alias("createdAt"),
            "views",
            F.col("unique_viewers").alias("uniqueViewers"),
            F.col("bot_views").alias("botViews"),
            C.iso_time(F.col("last_viewed")).alias("lastViewedAt"),
            F.coalesce("referrers", empty.cast(referrers.schema["referrers"].dataType)).alias("referrers"),
            F.coalesce("locations", empty.cast(locations.schema["locations"].dataType)).alias("locations"),
            "dailyViews",
            "deleted",
        )
    )


def share_stats_json(shares: DataFrame, views: DataFrame, now: int) -> DataFrame:
    """The documents as JSON text, NULL fields kept."""
    doc = share_stats(shares, views, now)
    return doc.select(
        "slug", F.to_json(F.struct(*doc.columns), {"ignoreNullFields": "false"}).alias("document")
    )


def top_sources(shares: DataFrame, views: DataFrame, now: int) -> DataFrame:
    """Counts of every share with its strongest source in the retention window."""
    best = stats.referrer_breakdown(views, now).filter("rank = 1").select(
        "slug", F.col("source").alias("top_source"), F.col("views").alias("top_source_views")
    )
    return stats.share_counts(shares, views).join(best, "slug", "left")

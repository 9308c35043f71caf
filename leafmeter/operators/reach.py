"""Product-wide reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from leafmeter.functions import columns as C


def channel_reach(shares: DataFrame) -> DataFrame:
    """Committed shares and distinct senders per channel."""
    return (
        shares.filter("status = 'committed'")
        .groupBy("client", "sender_ip_hash")
        .agg(F.count("*").alias("c"))
        .groupBy("client")
        .agg(F.sum("c").alias("n"), F.count("*").alias("unique_ips"))
        .orderBy(F.desc("n"), "client")
    )


def view_totals(views: DataFrame) -> DataFrame:
    """All views, crawlers included, with distinct slugs and viewers."""
    pairs = views.groupBy("slug", "ip_hash").agg(F.count("*").alias("n"))
    slugs = pairs.groupBy("slug").agg(F.sum("n").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_views"), F.count("slug").alias("shares_with_views")
    )
    viewers = pairs.select("ip_hash").distinct().agg(F.count("ip_hash").alias("unique_viewer_ips"))
    return slugs.select("total_views", "shares_with_views", viewers.scalar().alias("unique_viewer_ips"))


def human_days(views: DataFrame) -> DataFrame:
    return (
        views.filter("is_bot = 0")
        .groupBy(C.day_of(F.col("viewed_at")).alias("day_number"))
        .agg(F.count("*").alias("n"))
        .select(C.day_text(F.col("day_number")).alias("day"), "n")
    )


def daily_activity(series: DataFrame) -> DataFrame:
    """Non-zero days of a ``(day, n)`` series with the total of the whole series."""
    per_day = series.groupBy("day").agg(F.sum("n").alias("n"))
    # One row per day at this point, so the single window is small.
    return per_day.withColumn("total", F.sum("n").over(Window.partitionBy())).filter("n > 0")

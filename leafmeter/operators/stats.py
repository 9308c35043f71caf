"""Per-share statistics for all shares at once.

Every job groups the view log before it joins the shares, so a hot share reaches the join as one row
(or as one row per referrer, place or day) whatever its share of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from leafmeter.functions import columns as C
from leafmeter.limits import DAY, LIMITS


def _since(views: DataFrame, start: int) -> DataFrame:
    """Rows from ``start`` on; names the day as well where the log is partitioned by it."""
    kept = views.filter(F.col("viewed_at") >= start)
    return kept.filter(F.col("day") >= start // DAY) if "day" in views.columns else kept


def human_window(views: DataFrame, now: int, seconds: int = LIMITS.pii_retention_seconds) -> DataFrame:
    return _since(views.filter("is_bot = 0"), now - seconds)


def view_counts(views: DataFrame, approximate: bool = False) -> DataFrame:
    """Human and bot views, distinct human viewers and last human view per slug with views."""
    human = F.col("is_bot") == 0
    if approximate:
        return views.groupBy("slug").agg(
            F.count_if(human).alias("views"),
            F.approx_count_distinct(F.when(human, F.col("ip_hash"))).alias("unique_viewers"),
            F.count_if(F.col("is_bot") == 1).alias("bot_views"),
            F.max(F.when(human, F.col("viewed_at"))).alias("last_viewed"),
        )
    # One row per (slug, viewer) first: the distinct count needs no second pass over the log and a
    # hot slug spreads over its viewers.
    per_viewer = views.groupBy("slug", "ip_hash").agg(
        F.count_if(human).alias("v"),
        F.count_if(F.col("is_bot") == 1).alias("b"),
        F.max(F.when(human, F.col("viewed_at"))).alias("last"),
    )
    return per_viewer.groupBy("slug").agg(
        F.sum("v").alias("views"),
        F.count_if(F.col("v") > 0).alias("unique_viewers"),
        F.sum("b").alias("bot_views"),
        F.max("last").alias("last_viewed"),
    )


def share_counts(shares: DataFrame, views: DataFrame, approximate: bool = False) -> DataFrame:
    """All-time counts of every share, zeros for shares without views."""
    return with_counts(shares, view_counts(views, approximate))


def with_counts(shares: DataFrame, counts: DataFrame) -> DataFrame:
    """Shares with their ``view_counts``, zeros where there are none."""

    def zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("bigint").alias(name)

    return (
        shares.select("slug", "created_at", (F.col("status") == "deleted").alias("deleted"))
        .join(counts, "slug", "left")
        .select(
            "slug",
            "created_at",
            zero("views"),
            zero("unique_viewers"),
            zero("bot_views"),
            "last_viewed",
            "deleted",
        )
    )


def _top(grouped: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """First ``keep`` groups per slug; the rank limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("n"), *order))
    return grouped.withColumn("place", rank).filter(F.col("place") <= keep)


def _fold(kept: DataFrame, grouped: DataFrame, label: Column, name: str, keep: list[Column]) -> DataFrame:
    """Sum the kept groups by label and put the rest of the window under 'other'.

    The window total counts for 'other' first, and every kept group moves its views from there to its
    label, so the rows sum to the total.  ``keep`` are columns taken from the best placed group of a
    label.
    """

    def row(to: Column, n: Column, place: Column, values: list[Column]) -> list[Column]:
        extra = [v.cast("string").alias(f"_{i}") for i, v in enumerate(values)]
        return [to.alias(name), n.alias("n"), place.cast("int").alias("place"), *extra]

    other, nothing = F.lit("other"), F.lit(None)
    blank = [nothing] * len(keep)
    totals = grouped.groupBy("slug").agg(F.sum("n").alias("n"))
    moves = F.array(
        F.struct(*row(other, -F.col("n"), nothing, blank)),
        F.struct(*row(label, F.col("n"), F.col("place"), keep)),
    )
    merged = (
        totals.select("slug", *row(other, F.col("n"), nothing, blank))
        .unionByName(kept.select("slug", F.inline(moves)))
        # A slug has a handful of rows by now; one shuffle serves the sums and the ranks.
        .repartition("slug")
        .groupBy("slug", name)
        .agg(
            F.sum("n").alias("views"),
            *[F.min_by(f"_{i}", "place").alias(f"_{i}") for i in range(len(keep))],
        )
        .filter("views > 0")
    )
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("views"), F.asc(name)))
    return merged.withColumn("rank", rank.cast("bigint"))


def referrer_breakdown(
    views: DataFrame, now: int, top: int = LIMITS.top_referrers
) -> DataFrame:
    """Top sources of human views in the retention window: ``(slug, source, views, rank)``.

    Ranked on the stored value and folded to labels afterwards, as the stored rows are; ties at the
    cut go to the smaller value, NULL first.
    """
    return top_referrers(human_window(views, now).groupBy("slug", "referrer").agg(F.count("*").alias("n")), top)


def top_referrers(grouped: DataFrame, top: int = LIMITS.top_referrers) -> DataFrame:
    """``referrer_breakdown`` from the views ``n`` of every (slug, referrer)."""
    kept = _top(grouped, [F.asc_nulls_first("referrer")], top)
    return _fold(kept, grouped, C.referrer_label(F.col("referrer")), "source", []).select(
        "slug", "source", "views", "rank"
    )


def location_breakdown(
    views: DataFrame, now: int, top: int = LIMITS.top_locations
) -> DataFrame:
    """Top places of human views: ``(slug, country, city, label, views, rank)``."""
    return top_locations(human_window(views, now).groupBy("slug", "country", "city").agg(F.count("*").alias("n")), top)


def top_locations(grouped: DataFrame, top: int = LIMITS.top_locations) -> DataFrame:
    """``location_breakdown`` from the views ``n`` of every (slug, country, city)."""
    kept = _top(grouped, [F.asc_nulls_first("country"), F.asc_nulls_first("city")], top)
    label = C.location_label(F.col("country"), F.col("city"))
    own = [C.text_or_null(F.col("country")), C.text_or_null(F.col("city"))]
    return _fold(kept, grouped, label, "label", own).select(
        "slug", F.col("_0").alias("country"), F.col("_1").alias("city"), "label", "views", "rank"
    )


def trend_start(now: int, days: int = LIMITS.trend_days) -> int:
    return (now // DAY - (days - 1)) * DAY


def daily_counts(views: DataFrame, now: int, days: int = LIMITS.trend_days) -> DataFrame:
    """Human views per slug and day from the first day of the trend on, days without views left out."""
    return (
        _since(views.filter("is_bot = 0"), trend_start(now, days))
        .groupBy("slug", C.day_of(F.col("viewed_at")).alias("day"))
        .agg(F.count("*").alias("n"))
    )


def daily_trend(
    shares: DataFrame, views: DataFrame, now: int, days: int = LIMITS.trend_days
) -> DataFrame:
    """Dense series per share, oldest day first: ``(slug, date, views)``."""
    return dense_trend(shares, daily_counts(views, now, days), now, days)


def dense_trend(shares: DataFrame, daily: DataFrame, now: int, days: int = LIMITS.trend_days) -> DataFrame:
    """``daily_trend`` from ``daily_counts``.

    The join moves one row per share; the days are spread out after it.
    """
    today = now // DAY
    per_slug = (
        daily.filter(F.col("day") <= today)
        .groupBy("slug")
        .agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("by_day"))
    )
    span = F.sequence(F.lit(today - days + 1).cast("bigint"), F.lit(today).cast("bigint"))
    return (
        shares.select("slug")
        .join(per_slug, "slug", "left")
        .select("slug", "by_day", F.explode(span).alias("day"))
        .select(
            "slug",
            C.day_text(F.col("day")).alias("date"),
            F.coalesce(F.try_element_at("by_day", F.col("day")), F.lit(0)).cast("bigint").alias("views"),
        )
    )


def trend_profile(trend: DataFrame, recent_days: int = 7) -> DataFrame:
    """Bar height per day in percent of the peak, and the views of the last days; quiet shares are left out."""
    whole = Window.partitionBy("slug")
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("date")))
    return (
        trend.withColumn("peak", F.max("views").over(whole))
        .filter("peak > 0")
        .withColumn("place", place)
        .withColumn("last7", F.sum(F.when(F.col("place") <= recent_days, F.col("views"))).over(whole))
        .select(
            "slug",
            "date",
            "views",
            "peak",
            "last7",
        )
        # round(100 * views / peak) with halves up, in whole numbers.
        .withColumn(
            "pct",
            F.call_function("div", F.col("views") * 200 + F.col("peak"), F.col("peak") * 2),
        )
        .select("slug", "date", "views", "pct", "peak", "last7")
    )

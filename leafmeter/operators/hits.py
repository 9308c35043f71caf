"""From raw page hits to the view log, and audits of what the log holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafmeter.functions import columns as C
from leafmeter.limits import BOT_PATTERNS, CLIENT_PREFIXES, SERVED_SLUG


def served(hits: DataFrame, shares: DataFrame) -> DataFrame:
    """Hits that reach a committed share."""
    live = shares.filter("status = 'committed'").select("slug")
    return hits.filter(F.col("slug").rlike(SERVED_SLUG)).join(live, "slug", "left_semi")


def enrich_hits(hits: DataFrame, shares: DataFrame, salt: str) -> DataFrame:
    """Raw hits to rows of the view log.  Stateless, so it runs on streams as well."""
    return served(hits, shares).select(
        F.col("hit_id").alias("id"),
        "slug",
        F.unix_seconds("ts").alias("viewed_at"),
        C.ip_hash(C.client_ip(F.col("cf_ip"), F.col("xff")), salt).alias("ip_hash"),
        C.is_bot(F.col("ua")).cast("bigint").alias("is_bot"),
        "ua",
        C.referrer_written(F.col("referer")).alias("referrer"),
        "country",
        "city",
    )


def bot_pattern_hits(views: DataFrame) -> DataFrame:
    """Views and distinct user agents each crawler pattern matches, zeros included.

    The patterns are tried once per distinct user agent, not once per view.
    """
    per_ua = views.filter("ua is not null").groupBy("ua").agg(F.count("*").alias("n"))
    matched = (
        per_ua.select("n", F.explode(C.bot_patterns_found(F.col("ua"))).alias("pattern"))
        .groupBy("pattern")
        .agg(F.sum("n").alias("views"), F.count("*").alias("uas"))
    )
    spark = views.sparkSession
    patterns = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in BOT_PATTERNS])).alias("pattern"))
    return patterns.join(matched, "pattern", "left").select(
        "pattern",
        F.coalesce("views", F.lit(0)).cast("bigint").alias("views"),
        F.coalesce("uas", F.lit(0)).cast("bigint").alias("uas"),
    )


def bot_flag_agreement(views: DataFrame) -> DataFrame:
    """Stored flag against today's rule: ``(stored, recomputed, n)``."""
    per_ua = views.groupBy("ua", "is_bot").agg(F.count("*").alias("n"))
    return (
        per_ua.groupBy(
            F.col("is_bot").alias("stored"),
            C.is_bot(F.col("ua")).cast("bigint").alias("recomputed"),
        )
        .agg(F.sum("n").alias("n"))
    )


def normalize_referrers(hits: DataFrame, column: str = "referer") -> DataFrame:
    """Bulk rewrite of a raw referrer column to the stored form, as ``referrer``."""
    return hits.withColumn("referrer", C.referrer_written(F.col(column)))


def referrer_shapes(views: DataFrame) -> DataFrame:
    """Stored referrers per slug by shape and by the label they read back as."""
    stored = F.col("referrer")
    shape = (
        F.when(stored.isNull() | (stored == ""), "null")
        .when(stored == "other", "other")
        .when(C.has_scheme(stored), "url")
        .when(C.is_bare_host(stored), "host")
        .otherwise("junk")
    )
    per_value = views.groupBy("slug", "referrer").agg(F.count("*").alias("n"))
    return (
        per_value.groupBy("slug", shape.alias("shape"), C.referrer_label(stored).alias("label"))
        .agg(F.sum("n").alias("n"))
    )


def resolve_requests(requests: DataFrame, shares: DataFrame, objects: DataFrame) -> DataFrame:
    """Status code of each page request, the version served, and whether a view was recorded."""
    live = shares.filter("status = 'committed'").select("slug", "latest_version")
    stored = objects.select("key").withColumn("found", F.lit(True))
    target = live.withColumn("key", C.object_key(F.col("slug"), F.col("latest_version"))).join(
        stored, "key", "left"
    )
    recorded = F.col("slug").rlike(SERVED_SLUG) & F.col("latest_version").isNotNull()
    return (
        requests.join(target, "slug", "left")
        .select(
            "request_id",
            F.when(~recorded, 404).when(F.col("found").isNull(), 500).otherwise(200).cast("bigint").alias("code"),
            F.when(recorded & F.col("found").isNotNull(), F.col("latest_version")).alias("version"),
            recorded.alias("recorded"),
        )
    )


REPORT_FOOTER = '\n<footer><a href="{url}" rel="noopener">Report this page</a></footer>\n'


def render_pages(
    shares: DataFrame, contents: DataFrame, host: str, footer: str = REPORT_FOOTER
) -> DataFrame:
    """Latest page of each committed share with the footer before its last ``</body>``.

    ``footer`` holds ``{url}`` where the report link goes.
    """
    live = shares.filter("status = 'committed'").select(
        "slug",
        F.col("latest_version").alias("version"),
        C.object_key(F.col("slug"), F.col("latest_version")).alias("key"),
    )
    before, after = footer.split("{url}")
    url = F.concat(F.lit(f"https://{host}/report?slug="), F.url_encode("slug"))
    mark = F.concat(F.lit(before), url, F.lit(after))
    html = F.col("html")
    tail = F.substring_index(html, "</body>", -1)
    split = F.length(html) - F.length(tail) - F.lit(len("</body>"))
    body = F.when(~html.contains("</body>"), F.concat(html, mark)).otherwise(
        F.concat(F.left(html, split), mark, F.lit("</body>"), tail)
    )
    return live.join(contents, "key").select("slug", "version", body.alias("html"))


def client_channels(uploads: DataFrame, prefixes=CLIENT_PREFIXES) -> DataFrame:
    """Channel each upload came through, from its user agent."""
    return uploads.withColumn("client", C.client_channel(F.col("ua"), prefixes))

"""Lists of shares per device and per owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from leafmeter.functions import columns as C
from leafmeter.functions.ordered import running_total
from leafmeter.limits import LIMITS


def merge_share_lists(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Union of both lists per device; the remote row wins, the title is only known locally."""
    r = remote.select("device", "slug", F.col("share_url").alias("r_url"), F.col("created_at").alias("r_at"), F.lit(True).alias("is_remote"))
    l = local.select("device", "slug", F.col("share_url").alias("l_url"), F.col("created_at").alias("l_at"), "title", F.lit(True).alias("is_local"))
    return (
        r.join(l, ["device", "slug"], "full_outer")
        .select(
            "device",
            "slug",
            F.coalesce("r_url", "l_url").alias("share_url"),
            F.coalesce("r_at", "l_at").alias("created_at"),
            C.text_or_null(F.col("title")).alias("title"),
            F.col("is_local").isNotNull().alias("local"),
            F.col("is_remote").isNotNull().alias("synced"),
        )
        .orderBy("device", F.desc("created_at"), "slug")
    )


def unsynced_local(local: DataFrame, listed: DataFrame) -> DataFrame:
    """Local shares the owner's list lacks."""
    return local.select("device", "slug").join(listed.select("device", "slug"), ["device", "slug"], "left_anti")


def unsynced_counts(local: DataFrame, listed: DataFrame) -> DataFrame:
    return unsynced_local(local, listed).groupBy("device").agg(F.count("*").alias("n"))


def recent_per_device(saves: DataFrame, cap: int = LIMITS.device_saves) -> DataFrame:
    """What a device's capped list holds after a log of saves, newest first."""
    last = saves.groupBy("device", "slug").agg(F.max("seq").alias("seq"))
    pos = F.row_number().over(Window.partitionBy("device").orderBy(F.desc("seq")))
    return (
        last.withColumn("pos", pos.cast("bigint"))
        .filter(F.col("pos") <= cap)
        .select("device", "slug", "pos")
    )


def _owned(shares: DataFrame) -> DataFrame:
    return shares.filter("status = 'committed' and owner_key_hash is not null").select(
        "owner_key_hash", "created_at", "slug"
    )


def _numbered(shares: DataFrame) -> DataFrame:
    """Owned shares with their place in the owner's list, newest first."""
    return running_total(
        _owned(shares).withColumn("_one", F.lit(1)),
        ["owner_key_hash"],
        [F.desc("created_at"), F.desc("slug")],
        {"_one": "pos"},
    ).drop("_one")


def owner_pages(shares: DataFrame, host: str, limit: int = LIMITS.page_default) -> DataFrame:
    """Each owner's committed shares cut into pages; a page's last row carries the next cursor."""
    if not 1 <= limit <= LIMITS.page_max:
        raise ValueError(f"limit must be 1-{LIMITS.page_max}")
    rows = _numbered(shares)
    sizes = _owned(shares).groupBy("owner_key_hash").agg(F.count("*").alias("size"))
    last_of_page = (F.col("pos") % limit == 0) & (F.col("pos") < F.col("size"))
    return rows.join(sizes, "owner_key_hash").select(
        "owner_key_hash",
        (C.whole_div(F.col("pos") - 1, limit) + 1).alias("page"),
        "pos",
        "slug",
        "created_at",
        F.concat(F.lit(f"https://{host}/"), "slug").alias("share_url"),
        F.when(last_of_page, C.encode_cursor(F.col("created_at"), F.col("slug"))).alias("next_cursor"),
    )


def owner_seek(requests: DataFrame, shares: DataFrame) -> DataFrame:
    """Answer list requests ``(request_id, owner_key_hash, cursor, limit)``.

    A cursor is turned into a place in the owner's list by one running total over shares and
    cursors together, and a page is then an equi-join on (owner, place).  No request is compared
    with all shares of its owner.  Bad requests and empty pages give one row without a slug.
    """
    limit = F.coalesce("limit", F.lit(LIMITS.page_default))
    after = C.decode_cursor(F.col("cursor"))
    good = limit.between(1, LIMITS.page_max) & (F.col("cursor").isNull() | after.isNotNull())
    asked = requests.select(
        "request_id",
        "owner_key_hash",
        F.when(good, "ok").otherwise("bad_request").alias("status"),
        limit.alias("limit"),
        F.col("cursor").isNotNull().alias("seeks"),
        after["created_at"].alias("created_at"),
        after["slug"].alias("slug"),
    )
    shared = _owned(shares).select(
        "owner_key_hash", "created_at", "slug", F.lit(1).alias("is_share"), F.lit(-1).cast("bigint").alias("request_id"), F.lit(0).cast("bigint").alias("limit")
    )
    seeks = asked.filter("status = 'ok' and seeks").select(
        "owner_key_hash", "created_at", "slug", F.lit(0).alias("is_share"), "request_id", "limit"
    )
    # Shares sort before a cursor at the same place, so the total at a cursor counts the shares
    # up to and including it.
    placed = running_total(
        shared.unionByName(seeks),
        ["owner_key_hash"],
        [F.desc("created_at"), F.desc("slug"), F.desc("is_share"), F.asc("request_id")],
        {"is_share": "place"},
    )
    numbered = placed.filter("is_share = 1").select("owner_key_hash", F.col("place").alias("pos"), "slug", "created_at")
    found = placed.filter("is_share = 0").select("request_id", "owner_key_hash", "limit", F.col("place").alias("start"))
    fresh = asked.filter("status = 'ok' and not seeks").select(
        "request_id", "owner_key_hash", "limit", F.lit(0).cast("bigint").alias("start")
    )
    wanted = (
        found.unionByName(fresh)
        .withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("limit"))))
        .withColumn("pos", F.col("start") + F.col("step"))
    )
    sizes = shared.groupBy("owner_key_hash").agg(F.count("*").alias("size"))
    page = (
        wanted.join(numbered, ["owner_key_hash", "pos"])
        .join(sizes, "owner_key_hash")
        .select(
            "request_id",
            F.col("step").alias("pos"),
            "slug",
            F.when(
                (F.col("step") == F.col("limit")) & (F.col("pos") < F.col("size")),
                C.encode_cursor(F.col("created_at"), F.col("slug")),
            ).alias("next_cursor"),
        )
    )
    return asked.select("request_id", "status").join(page, "request_id", "left").select(
        "request_id", "status", "pos", "slug", "next_cursor"
    )

"""The service's tables derived from the test parquet tables (rules in FIXTURES.md).

Everything is a pure function of the source rows, so a second engine can rebuild the same tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmeter.functions import columns as C
from leafmeter.limits import CLIENT_PREFIXES, DAY, KEY_PREFIX
from leafmeter.session import scratch

NOW = 1_706_659_199  # 2024-01-30T23:59:59Z
SALT = "test-salt"
HOST = "pages.test"
YEAR_2024 = 1_704_067_200

# Browsers and in-app browsers, link previews and crawlers, scripted clients, empty and missing.
USER_AGENTS = (
    "Mozilla/5.0 (Windows NT 11.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.6778.86 Safari/537.36",
    "Mozilla/5.0 (X11; Ubuntu; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0",
    "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.6 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 12; SM-A536B) AppleWebKit/537.36 Chrome/114.0.5735.196 [Reader/Android;v9]",
    "Discordbot/2.4 (link preview)",
    "Wget/1.25.0 (linux-gnu)",
    "Example-Search-Bot/3.1 (+https://search.example/about)",
    "python-urllib/3.13",
    "Mozilla/5.0 (Android 15; Mobile; rv:132.0) Gecko/132.0 Firefox/132.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_6) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.6 Safari/605.1.15",
    "",
    None,
)
UPLOAD_AGENTS = USER_AGENTS + (f"{CLIENT_PREFIXES[0][0]}0.3.1", f"{CLIENT_PREFIXES[1][0]}1.0")


def _pick(items: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (index + 1).cast("int"))


_div = C.whole_div


def slug_of(page: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("slug:"), page.cast("string")).cast("binary"), 256), 1, 12)


def key_letter(index: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), F.repeat(F.char(index % 5 + 65), 43))


def key_hash(index: Column) -> Column:
    return C.sha256_hex(key_letter(index))


def _salted(prefix: str, number: Column) -> Column:
    return C.sha256_hex(F.concat(F.lit(f"{SALT}:{prefix}"), number.cast("string")))


# Derived tables already stored by this application: (application, folder, table) -> path.
_STAGED: dict[tuple[str, str, str], str] = {}


class Fixtures:
    """Derived tables.  Those that stand for stored tables are written once per application, so jobs
    read files as they would in service; the rest are derived in place."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def staged_path(self, name: str) -> str:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STAGED:
            path = scratch(self.spark, name)
            getattr(self, f"_derive_{name}")().write.parquet(path)
            _STAGED[key] = path
        return _STAGED[key]

    def _staged(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.staged_path(name))

    @cached_property
    def n(self) -> int:
        """Number of pages, from the parquet footers."""
        return self.table("pages").count()

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def events(self) -> DataFrame:
        """Events with ``i``, ``u`` and whole seconds ``at``; a small file is spread over all cores."""
        events = self.table("events").select(
            F.col("event_id").alias("i"),
            F.col("user_id").alias("u"),
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
        )
        cores = self.spark.sparkContext.defaultParallelism
        return events if events.rdd.getNumPartitions() >= cores else events.repartition(cores, "i")

    @cached_property
    def shares(self) -> DataFrame:
        return self._staged("shares")

    @cached_property
    def views(self) -> DataFrame:
        return self._staged("views")

    @cached_property
    def hits(self) -> DataFrame:
        return self._staged("hits")

    @cached_property
    def objects(self) -> DataFrame:
        return self._staged("objects")

    def _derive_shares(self) -> DataFrame:
        return self.shares_by_page.drop("page_id", "html")

    @cached_property
    def shares_by_page(self) -> DataFrame:
        p = F.col("page_id")
        c0 = F.lit(NOW) - ((p * 7919) % 200) * DAY - (p % DAY)
        status = F.when(p % 10 == 0, "deleted").when(p % 10 == 1, "pending").otherwise("committed")
        latest = p % 14 + 1
        owned = p % 3 == 0
        return self.pages.select(
            "page_id",
            "html",
            slug_of(p).alias("slug"),
            status.alias("status"),
            C.sha256_hex(F.concat(F.lit("tok-"), p.cast("string"))).alias("edit_token_hash"),
            F.when(p % 10 == 1, F.lit(NOW) - (p % 40) * 20).otherwise(c0).alias("created_at"),
            _salted("10.0.0.", p % 50).alias("sender_ip_hash"),
            C.utf8_bytes(F.col("html")).alias("content_size"),
            F.element_at(
                F.array(*[F.lit(x) for x in ("mcp", "skill", "curl", "other", "web", "web")]),
                (p % 6 + 1).cast("int"),
            ).alias("client"),
            latest.alias("latest_version"),
            F.when(p % 2 == 0, F.greatest(F.lit(1), latest - 9)).otherwise(1).cast("bigint").alias("versions_pruned_below"),
            F.when(p % 10 != 1, c0).alias("committed_at"),
            F.when(p % 10 == 0, c0 + 3600).alias("deleted_at"),
            F.when(owned, key_hash(_div(p, 3))).alias("owner_key_hash"),
            F.when(owned, c0 + 60).alias("owner_claimed_at"),
            F.lit(None).cast("string").alias("vault_ciphertext"),
            F.lit(None).cast("bigint").alias("vault_updated_at"),
            F.when(p % 17 == 0, F.lit(NOW) - F.when(p % 2 == 0, 600).otherwise(60)).cast("bigint").alias("orphan_since"),
        )

    def _hits_base(self) -> DataFrame:
        i, u = F.col("i"), F.col("u")
        viewed = F.lit(self.n * 9 // 10)
        # What depends on the page or the agent alone is worked out before the join, not for every event.
        url, other = F.col("url"), F.lit("not a url at all")
        links = self.pages.select(F.col("page_id").alias("link"), url, C.referrer_written(url).alias("host"))
        nations = self.table("nation").select(F.col("n_nationkey").cast("bigint").alias("nk"), "n_name")
        ua = _pick(USER_AGENTS, F.col("id"))
        agents = self.spark.range(0, len(USER_AGENTS), 1, 1).select(
            F.col("id").alias("agent"), ua.alias("ua"), C.is_bot(ua).cast("bigint").alias("is_bot")
        )
        return (
            self.events.withColumn("link", (i * 17) % self.n)
            .withColumn("nk", u % 25)
            .withColumn("agent", i % len(USER_AGENTS))
            .join(links, "link")
            .join(nations, "nk")
            .join(F.broadcast(agents), "agent")
            .select(
                "i",
                "u",
                "at",
                slug_of((i * 31 + _div(i, 7)) % viewed).alias("slug"),
                "ua",
                "is_bot",
                F.when(i % 7 == 1, other).when(i % 7 != 0, url).alias("referer"),
                F.when(i % 7 == 1, C.referrer_written(other)).when(i % 7 != 0, F.col("host")).alias("written"),
                F.when(i % 13 == 0, None).when(i % 29 == 0, "").otherwise(F.col("n_name")).alias("country"),
                F.when(i % 3 == 0, None).when(i % 11 == 0, "")
                .otherwise(F.concat(F.lit("City"), (i % 23).cast("string"))).alias("city"),
            )
        )

    def _derive_views(self) -> DataFrame:
        i = F.col("i")
        return self._hits_base().select(
            i.alias("id"),
            "slug",
            (F.col("at") - (i % 5) * 2_592_000).alias("viewed_at"),
            _salted("203.0.113.", F.col("u") % 256).alias("ip_hash"),
            "is_bot",
            "ua",
            F.when(i % 5 <= 2, F.col("written")).otherwise(F.col("referer")).alias("referrer"),
            "country",
            "city",
        )

    def _derive_hits(self) -> DataFrame:
        i = F.col("i")
        return self._hits_base().select(
            i.alias("hit_id"),
            F.when(i % 97 == 0, "BAD!").when(i % 89 == 0, "nosuchslug00").otherwise(F.col("slug")).alias("slug"),
            F.timestamp_seconds("at").alias("ts"),
            F.when(i % 101 == 0, "").when(i % 4 != 0, F.concat(F.lit("203.0.113."), (F.col("u") % 256).cast("string"))).alias("cf_ip"),
            F.when(i % 8 != 0, " 198.51.100.7 , 10.0.0.1").alias("xff"),
            "ua",
            "referer",
            "country",
            "city",
        )

    def _derive_objects(self) -> DataFrame:
        p = F.col("page_id")
        stored = self.shares_by_page.filter("status <> 'pending'").drop("html")
        versions = (
            stored.withColumn("v", F.explode(F.sequence("versions_pruned_below", "latest_version")))
            .filter((p % 23 != 2) | (F.col("v") != F.col("latest_version")))
            .select(
                C.object_key(F.col("slug"), F.col("v")).alias("key"),
                (F.col("content_size") + F.col("v")).alias("size"),
                (F.col("created_at") + F.col("v") * 60).alias("uploaded"),
            )
        )
        strays = stored.filter("orphan_since is not null").select(
            C.object_key(F.col("slug"), F.col("latest_version") + 1).alias("key"),
            F.lit(7).cast("bigint").alias("size"),
            F.col("orphan_since").alias("uploaded"),
        )

        def extra(every: int, name: str) -> DataFrame:
            return stored.filter(p % every == 0).select(
                F.concat(F.lit("shares/"), "slug", F.lit(name)).alias("key"),
                F.lit(10).cast("bigint").alias("size"),
                F.col("created_at").alias("uploaded"),
            )

        ghosts = self.pages.filter(p % 37 == 0).select(
            F.concat(F.lit("shares/ghost"), p.cast("string"), F.lit("/v2.html")).alias("key"),
            F.lit(5).cast("bigint").alias("size"),
            F.lit(NOW).cast("bigint").alias("uploaded"),
        )
        return (
            versions.unionByName(strays)
            .unionByName(extra(9, "/notes.txt"))
            .unionByName(extra(19, "/v007.html"))
            .unionByName(ghosts)
        )

    @cached_property
    def contents(self) -> DataFrame:
        p = F.col("page_id")
        return self.shares_by_page.filter((p % 23 != 2) & (F.col("status") != "pending")).select(
            C.object_key(F.col("slug"), F.col("latest_version")).alias("key"), "html"
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.hits.select(F.col("hit_id").alias("request_id"), "slug")

    @cached_property
    def claims(self) -> DataFrame:
        c = F.col("c_custkey")
        request = _div(c, 7)
        rows = self.table("customer").select(
            request.alias("request_id"),
            F.struct(
                (c % 7).alias("pos"),
                F.when((request % 40 == 7) & (c % 7 == 3), "")
                .otherwise(F.concat(F.lit("tok-"), (c % (self.n * 5 // 4)).cast("string")))
                .alias("token"),
            ).alias("entry"),
        )
        tokens = F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["token"])
        rid = F.col("request_id")
        return (
            rows.groupBy("request_id")
            .agg(tokens.alias("tokens"))
            .select(
                "request_id",
                rid.alias("ts"),
                key_hash(rid).alias("owner_key_hash"),
                F.when(rid % 60 == 11, F.flatten(F.array_repeat("tokens", 8))).otherwise(F.col("tokens")).alias("tokens"),
            )
        )

    @cached_property
    def reports_raw(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("request_id"),
            slug_of(F.col("o_custkey") % (self.n + 5)).alias("slug"),
            F.when(o % 50 == 0, " \t ").when(o % 51 == 0, F.repeat(F.lit("x"), 2001))
            .when(o % 77 == 0, None)
            .otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("reason"),
            F.when(o % 2 == 0, "a@b.test").alias("email"),
            (o % 53 != 0).alias("email_is_text"),
            _salted("192.0.2.", o % 37).alias("reporter_ip_hash"),
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        """Reports already stored before ``reports_raw``."""
        p = F.col("page_id")
        return self.pages.filter(p % 8 == 0).select(
            p.alias("id"),
            slug_of(p).alias("slug"),
            F.lit("spam").alias("reason"),
            _salted("192.0.2.", p % 37).alias("reporter_ip_hash"),
            F.lit(YEAR_2024).cast("bigint").alias("reported_at"),
            F.lit("open").alias("status"),
            F.lit(None).cast("string").alias("reporter_email"),
        )

    @cached_property
    def uploads(self) -> DataFrame:
        i = F.col("i")
        docs = self.table("documents")
        n_docs = docs.count()
        kind = (
            F.when(i % 10 == 0, "application/json")
            .when(i % 10 == 1, "text/html; charset=utf-8")
            .when(i % 10 == 2, "text/plain")
            .when(i % 10 == 3, "image/png")
            .when(i % 10 == 4, None)
            .otherwise("text/html")
        )
        # A body meets its attempt in one join and is never shuffled again: every attempt has a page, every ninth takes
        # the text of a document in its place.
        attempts = self.events.withColumn("page_id", i % self.n).withColumn("doc_id", i % n_docs)
        texts = (
            attempts.filter(i % 9 == 0)
            .join(self.pages.select("page_id"), "page_id")
            .join(docs.select("doc_id", F.col("text").alias("body")), "doc_id", "left")
        )
        long = F.repeat(F.lit("<p>0123456789</p>"), 70_000)
        pages = attempts.filter(i % 9 != 0).join(
            self.pages.select("page_id", F.col("html").alias("body")), "page_id"
        ).withColumn("body", F.when(i % 4999 == 5, long).otherwise(F.col("body")))
        return texts.unionByName(pages).select(
            i.alias("attempt_id"),
            F.concat(F.lit("10.1.0."), F.col("u").cast("string")).alias("ip"),
            _div(F.col("at") - YEAR_2024, 1000).alias("ts"),
            kind.alias("content_type"),
            F.when(i % 41 == 0, "Bearer nope")
            .when(i % 5 == 1, F.concat(F.lit("Bearer "), key_letter(i)))
            .alias("bearer"),
            _pick(UPLOAD_AGENTS, i % 14).alias("ua"),
            F.when(i % 31 == 0, "").when(i % 70 != 0, F.col("body")).alias("html"),
        )

    @cached_property
    def api(self) -> DataFrame:
        i, u = F.col("i"), F.col("u")
        return self.events.select(
            i.alias("request_id"),
            _salted("10.2.0.", u % 23).alias("ip_hash"),
            F.when(i % 6 != 0, key_hash(u)).alias("key_hash"),
            _div(F.col("at") - YEAR_2024, 10_000).alias("ts"),
            _pick(("list", "claim", "write"), i % 3).alias("route"),
            (i % 53 == 0).alias("limiter_error"),
        )

    @cached_property
    def access(self) -> DataFrame:
        i = F.col("i")
        page = (i * 13) % (self.n + 10)
        right_bearer = F.concat(F.lit("Bearer "), key_letter(_div(page, 3)))
        wrong_bearer = F.concat(F.lit("Bearer "), key_letter(_div(page, 3) + 1))
        right_token = F.concat(F.lit("tok-"), page.cast("string"))
        return self.events.select(
            i.alias("request_id"),
            F.col("at").alias("ts"),
            _pick(("versions", "raw", "restore", "delete", "edit", "list", "claim"), i % 7).alias("route"),
            slug_of(page).alias("slug"),
            F.when(i % 43 == 0, "Bearer nope")
            .when((i % 5 == 1) | (i % 11 == 0), wrong_bearer)
            .when(i % 5 == 0, right_bearer)
            .alias("bearer"),
            F.when((i % 5 == 2) | (i % 11 == 0), right_token).when(i % 5 == 3, "tok-wrong").alias("token"),
            _pick(("1", "2", "5", "9", "0", "x", "007", "99999999999999999999"), _div(i, 7) % 8).alias("version"),
            F.when(i % 31 == 0, None).when(i % 29 == 0, 1_000_001).otherwise(1000).cast("bigint").alias("size"),
        )

    @cached_property
    def ops(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        restore = (F.col("role") == "system") | ((F.col("role") == "assistant") & (conv % 3 == 1))
        op_id = conv * 1000 + turn
        return self.table("conversations").select(
            op_id.alias("op_id"),
            slug_of(conv % max(1, self.n // 10)).alias("slug"),
            (turn + conv % 4).alias("ts"),
            F.when(restore, "restore").otherwise("edit").alias("op"),
            F.when(F.col("role") == "system", turn + 1).when(restore, (conv * 7 + turn * 5) % 20).alias("arg"),
            F.when(~restore, C.utf8_bytes(F.col("text"))).alias("size"),
        )

    @cached_property
    def saves(self) -> DataFrame:
        """Save log of the per-device share lists."""
        p = F.col("page_id")
        first = self.pages.filter(p % 4 != 3).select("page_id", p.alias("seq"))
        again = self.pages.filter((p % 4 != 3) & (p % 5 == 0)).select("page_id", (p + self.n).alias("seq"))
        return first.unionByName(again).select(
            (p % 6).alias("device"),
            slug_of(p).alias("slug"),
            F.concat(F.lit("https://old.test/"), slug_of(p)).alias("share_url"),
            (F.lit(NOW) - ((p * 7919) % 200) * DAY - (p % DAY)).alias("created_at"),
            F.when(p % 8 == 0, "").when(p % 2 == 0, F.concat(F.lit("Title "), p.cast("string"))).alias("title"),
            "seq",
        )

    @cached_property
    def grants(self) -> DataFrame:
        """Slugs that each upload would take, many of them taken or wanted by others, and whether its page was stored."""
        i = F.col("i")
        first = F.when(i % 11 == 0, i % self.n).when(i % 7 < 3, 1_000_000 + C.whole_div(i, 50)).otherwise(2_000_000 + i)
        later = [(1_000_000, 50, 1), (3_000_000, 300, 0), (3_000_000, 300, 1), (4_000_000, 1000, 0)]
        numbers = [first, *[C.whole_div(i, by) + base + more for base, by, more in later]]
        return self.events.select(
            i.alias("attempt_id"),
            F.array(*[slug_of(number.cast("bigint")) for number in numbers]).alias("slugs"),
            C.sha256_hex(F.concat(F.lit("new-token-"), i.cast("string"))).alias("edit_token_hash"),
            (i % 17 != 0).alias("stored"),
        )

    @cached_property
    def recent_saves(self) -> DataFrame:
        """A save log long enough for both caps of the recent lists; device 0 has a third of it."""
        i = F.col("i")
        return self.events.select(
            F.when(i % 3 == 0, 0).otherwise(1 + i % 40).cast("bigint").alias("device"),
            slug_of(i % (8 * self.n)).alias("slug"),
            i.alias("seq"),
        )

    @cached_property
    def local_shares(self) -> DataFrame:
        return self.saves.groupBy("device", "slug", "share_url", "created_at", "title").agg(
            F.max("seq").alias("seq")
        )

    @cached_property
    def remote_shares(self) -> DataFrame:
        """Listed shares as the device holding key number ``device`` sees them."""
        p = F.col("page_id")
        return self.pages.filter((p % 3 == 0) & ~(p % 10).isin(0, 1)).select(
            (_div(p, 3) % 5).alias("device"),
            slug_of(p).alias("slug"),
            F.concat(F.lit(f"https://{HOST}/"), slug_of(p)).alias("share_url"),
            (F.lit(NOW) - ((p * 7919) % 200) * DAY - (p % DAY)).alias("created_at"),
        )

    @cached_property
    def cursors(self) -> DataFrame:
        p = F.col("page_id")
        c0 = F.lit(NOW) - ((p * 7919) % 200) * DAY - (p % DAY)

        def b64(text: Column) -> Column:
            return F.base64(text.cast("binary"))

        odd = _pick(("++", "bm9jb2xvbg", "YWJjOnNsdWc=", "MTIzOg", "a", "OmFiYw==", "MS41OmFiYw"), _div(p, 7) % 7)
        return self.pages.select(
            p.alias("request_id"),
            key_hash(_div(p, 3)).alias("owner_key_hash"),
            F.when(p % 7 == 0, C.encode_cursor(c0, slug_of(p)))
            .when(p % 7 == 1, odd)
            .when(p % 7 == 5, b64(F.concat(c0.cast("string"), F.lit(":"), slug_of(p))))
            .alias("cursor"),
            F.when(p % 7 == 2, 0).when(p % 7 == 3, 101).when(p % 7 == 4, None)
            .otherwise(p % 9 + 1).cast("bigint").alias("limit"),
        )

    @cached_property
    def old_shares(self) -> DataFrame:
        return self.shares.drop(
            "client", "owner_key_hash", "owner_claimed_at", "vault_ciphertext", "vault_updated_at",
            "latest_version", "versions_pruned_below", "orphan_since",
        )

    @cached_property
    def old_views(self) -> DataFrame:
        return self.views.drop("is_bot", "country", "city")

    @cached_property
    def bad_shares(self) -> DataFrame:
        again = self.shares.filter(F.col("orphan_since").isNotNull())
        odd = self.shares.filter("latest_version = 5").withColumns(
            {"slug": F.concat(F.lit("odd"), "slug"), "status": F.lit("odd"), "sender_ip_hash": F.lit(None).cast("string")}
        )
        return self.shares.unionByName(again).unionByName(odd)

    @cached_property
    def bad_views(self) -> DataFrame:
        lost = self.views.filter("id % 100 = 3").withColumn("slug", F.lit("missingslug0"))
        blank = self.views.filter("id % 100 = 4").withColumn("viewed_at", F.lit(None).cast("bigint"))
        return self.views.unionByName(lost).unionByName(blank)

    @cached_property
    def bad_reports(self) -> DataFrame:
        again = self.reports.filter("id % 16 = 0").withColumn("status", F.lit("closed"))
        lost = self.reports.filter("id % 24 = 0").withColumn("slug", F.lit("missingslug0"))
        return self.reports.unionByName(again).unionByName(lost)

    @cached_property
    def sweep_flags(self) -> DataFrame:
        """Outcome of listing and deleting per share, as a sweep's storage client reports it."""
        p = F.col("page_id")
        return self.pages.select(
            slug_of(p).alias("slug"),
            (p % 13 != 0).alias("listing_complete"),
            (p % 11 != 0).alias("delete_ok"),
        )

    def deletes(self, verdicts: DataFrame) -> DataFrame:
        """Delete requests of the access log that were let through."""
        return (
            self.access.filter("route = 'delete'")
            .join(verdicts.filter("code = 200").select("request_id"), "request_id", "left_semi")
            .select("request_id", "slug", "ts")
        )


"""All registered queries: the jobs run over the tables derived from a test folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from leafmeter.limits import DAY
from leafmeter.operators import (
    access,
    claims,
    contract,
    hits,
    intake,
    lists,
    reach,
    retention,
    stats,
    versions,
)
from leafmeter.plans import maintenance, rollups, share_docs, stored_runs
from leafmeter.session import scratch
from leafmeter.sources import compaction, pages, tables
from leafmeter.sources.fixtures import HOST, NOW, SALT, Fixtures
from leafmeter.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Callable[[Fixtures], DataFrame]] = {}


def query(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    def bind(fn: Callable[[Fixtures], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Fixtures(spark, folder))

        return run

    return {name: bind(fn) for name, fn in REGISTRY.items()}


# ---- sources and sinks


def _stored(f: Fixtures, table: str, rows: DataFrame) -> DataFrame:
    folder = scratch(f.spark, "tables")
    tables.save_table(rows, folder, table)
    return tables.load_table(f.spark, folder, table)


@query
def a1_load_views(f):
    return _stored(f, "views", f.views)


@query
def a1_load_shares(f):
    return _stored(f, "shares", f.shares)


@query
def a1_load_reports(f):
    return _stored(f, "reports", f.reports)


@query
def a1_load_objects(f):
    return _stored(f, "objects", f.objects)


@query
def a2_contract_violations(f):
    return contract.contract_violations(f.bad_shares, f.bad_views, f.bad_reports)


@query
def a2_contract_kept(f):
    return contract.contract_violations(f.shares, f.views, f.reports)


@query
def a3_evolve_shares(f):
    return tables.evolve_schema(f.old_shares, "shares")


@query
def a3_evolve_views(f):
    """Rows of two eras in one table of the current shape."""
    old = tables.evolve_schema(f.old_views.filter("id % 2 = 0"), "views")
    return old.unionByName(tables.evolve_schema(f.views.filter("id % 2 = 1"), "views"))


@query
def a4_append_views(f):
    path = scratch(f.spark, "views")
    enriched = hits.enrich_hits(f.hits, f.shares, SALT)
    tables.append_views(enriched.filter("viewed_at < 1705000000"), path)
    tables.append_views(enriched.filter("viewed_at >= 1705000000"), path)
    return tables.read_views(f.spark, path)


@query
def a5_object_inventory(f):
    return versions.object_inventory(f.objects)


# ---- hits


@query
def b1_enrich_hits(f):
    return hits.enrich_hits(f.hits, f.shares, SALT)


@query
def b2_bot_pattern_hits(f):
    return hits.bot_pattern_hits(f.views)


@query
def b2_bot_flag_agreement(f):
    return hits.bot_flag_agreement(tables.evolve_schema(f.old_views, "views"))


@query
def b3_referrer_normalize(f):
    return hits.normalize_referrers(f.hits).select("hit_id", "referer", "referrer")


@query
def b4_referrer_shape_audit(f):
    return hits.referrer_shapes(f.views)


@query
def b5_resolve_requests(f):
    return hits.resolve_requests(f.requests, f.shares, f.objects)


@query
def b6_render_pages(f):
    return hits.render_pages(f.shares, f.contents, HOST)


@query
def b6_render_stored(f):
    """B6 over stored pages: laid out when the shares were a version back, a third added later and twice, then tidied."""
    older = pages.superseded(f.objects, f.shares).select("key", F.concat(F.lit("before "), "key").alias("html"))
    every = f.contents.unionByName(older)
    late = F.xxhash64("key") % 3 == 0
    back = f.shares.withColumn("latest_version", F.greatest(F.col("latest_version") - 1, F.lit(1)))
    store = pages.create(f.spark, scratch(f.spark, "pages"), every.filter(~late), back, buckets=16)
    store.add(every.filter(late))
    store.add(every.filter(late))
    store.tidy(f.shares, least_share=0.0)
    return hits.render_pages(f.shares, store.live(), HOST)


@query
def b7_client_channel(f):
    return hits.client_channels(f.uploads.select("attempt_id", "ua"))


# ---- statistics


@query
def c1_share_counts(f):
    return stats.share_counts(f.shares, f.views)


@query
def c2_referrer_breakdown(f):
    return stats.referrer_breakdown(f.views, NOW)


@query
def c3_location_breakdown(f):
    return stats.location_breakdown(f.views, NOW)


@query
def c4_daily_trend(f):
    return stats.daily_trend(f.shares, f.views, NOW)


@query
def c5_trend_profile(f):
    return stats.trend_profile(stats.daily_trend(f.shares, f.views, NOW))


@query
def c6_share_stats_doc(f):
    return share_docs.share_stats_json(f.shares, f.views, NOW)


@query
def c1_counts_with_top_source(f):
    return share_docs.top_sources(f.shares, f.views, NOW)


# ---- statistics from the stored roll-up

# Folder of the log below, by application and test folder.
_GROWN: dict[tuple[str, str], str] = {}


def _grown_log(f: Fixtures) -> str:
    """A folder whose log went on after its roll-up: an append and a refresh, a second append, closed days merged, a
    refresh, and a third append that the roll-up does not know."""
    key = (f.spark.sparkContext.applicationId, f.folder)
    if key not in _GROWN:
        folder = scratch(f.spark, "grown")
        log = rollups.Rollup(f.spark, f"{folder}/views")
        for part in range(3):
            tables.append_views(f.views.drop("day").filter(F.pmod("id", F.lit(3)) == part), f"{folder}/views")
            if part == 1:
                compaction.merge_closed_days(f.spark, folder, NOW // DAY)
            if part < 2:
                log.refresh()
        _GROWN[key] = folder
    return _GROWN[key]


def _rollup(f: Fixtures) -> rollups.Rollup:
    return rollups.Rollup(f.spark, f"{_grown_log(f)}/views")


@query
def a4_merged_days(f):
    """The log after its closed days were merged, with what came later."""
    return tables.load_table(f.spark, _grown_log(f), "views")


@query
def c1_rolled_counts(f):
    """Counts with a flag whether the estimated viewers are within five standard errors of the exact number."""
    exact = stats.view_counts(f.views).select("slug", F.col("unique_viewers").alias("exact"))
    near = F.abs(F.col("unique_viewers") - F.col("exact")) <= F.ceil(F.col("exact") * (5 * 1.04 / 2 ** (rollups.SKETCH / 2)))
    counts = _rollup(f).share_counts(f.shares).join(exact, "slug", "left")
    return counts.withColumn("viewers_near", F.coalesce(near, F.col("unique_viewers") == 0)).drop("unique_viewers", "exact")


@query
def c2_rolled_referrers(f):
    return _rollup(f).referrer_breakdown(NOW)


@query
def c3_rolled_locations(f):
    return _rollup(f).location_breakdown(NOW)


@query
def c4_rolled_trend(f):
    return _rollup(f).daily_trend(f.shares, NOW)


@query
def f5_rolled_ledger(f):
    return _rollup(f).retention_ledger(f.shares, NOW)


# ---- reach


@query
def d1_channel_reach(f):
    return reach.channel_reach(f.shares)


@query
def d2_view_totals(f):
    return reach.view_totals(f.views)


@query
def d3_daily_activity(f):
    return reach.daily_activity(reach.human_days(f.views))


# ---- lists


@query
def e1_merge_share_lists(f):
    return lists.merge_share_lists(f.remote_shares, f.local_shares)


@query
def e2_unsynced_local(f):
    return lists.unsynced_local(f.local_shares, f.remote_shares)


@query
def e2_unsynced_counts(f):
    return lists.unsynced_counts(f.local_shares, f.remote_shares)


@query
def e3_recent_per_device(f):
    return lists.recent_per_device(f.recent_saves)


@query
def e3_recent_per_browser(f):
    return lists.recent_per_device(f.recent_saves, lists.LIMITS.browser_saves)


@query
def e4_owner_pages(f):
    return lists.owner_pages(f.shares, HOST)


@query
def e4_owner_pages_of_7(f):
    return lists.owner_pages(f.shares, HOST, limit=7)


@query
def e5_owner_seek(f):
    return lists.owner_seek(f.cursors, f.shares)


# ---- request logs


@query
def g1_admit_uploads(f):
    return intake.admit_uploads(f.uploads, SALT)


@query
def g1_new_shares(f):
    return intake.new_shares(intake.admit_uploads(f.uploads, SALT), f.grants, f.shares)


@query
def g2_upload_limiter_summary(f):
    return intake.upload_limiter_summary(intake.admit_uploads(f.uploads, SALT))


@query
def g3_fixed_window_limits(f):
    return intake.fixed_window_limits(f.api)


@query
def g4_claim_shares(f):
    return claims.claim_shares(f.claims, f.shares)


@query
def g4_claimed_owners(f):
    return claims.claimed_owners(f.claims, f.shares)


@query
def g5_claim_tally(f):
    return claims.claim_tally(claims.claim_shares(f.claims, f.shares))


@query
def g6_audit_access(f):
    return access.audit_access(f.access, f.shares, f.objects)


@query
def g6_access_counts(f):
    return access.access_counts(access.audit_access(f.access, f.shares, f.objects))


@query
def g7_intake_reports(f):
    verdicts = intake.intake_reports(f.reports_raw, f.shares, f.reports)
    return verdicts.select("request_id", "code", "deduped")


@query
def g7_new_reports(f):
    return intake.new_reports(intake.intake_reports(f.reports_raw, f.shares, f.reports))


# ---- versions


@query
def h1_version_listing(f):
    return versions.version_listing(f.shares, f.objects)


@query
def h2_storage_audit(f):
    return versions.storage_audit(f.shares, f.objects)


@query
def h3_apply_version_log(f):
    return versions.apply_version_log(f.ops, f.shares, f.objects)


@query
def h3_versions_after(f):
    return versions.versions_after(versions.apply_version_log(f.ops, f.shares, f.objects), f.shares)


@query
def h4_sweep_plan(f):
    return versions.sweep_plan(f.shares, f.objects, NOW)


@query
def h4_sweep_counts(f):
    return versions.sweep_counts(f.shares, f.objects, NOW)


@query
def h5_sweep_markers(f):
    return versions.sweep_markers(
        versions.sweep_eligible(f.shares, NOW),
        versions.sweep_plan(f.shares, f.objects, NOW),
        f.sweep_flags,
    )


# ---- retention


@query
def f1_anonymize_views(f):
    return retention.anonymize_views(f.views, f.shares, NOW)


@query
def f1_anonymize_log(f):
    """The partitioned log after its overdue days were rewritten."""
    path = scratch(f.spark, "views")
    tables.append_views(f.views, path)
    retention.anonymize_log(f.shares, NOW, path)
    return tables.read_views(f.spark, path)


@query
def f1_log_after_all_writers(f):
    """The log after a stream, an append, a retention run, a second stream and a second run on one path."""
    path = scratch(f.spark, "views")
    late = F.pmod("id", F.lit(3))
    views = f.views.drop("day")
    for part in (0, 1):
        stream = _as_stream(f, views.filter(late == part), f"views{part}")
        tables.append_views_stream(stream, path, scratch(f.spark, "checkpoint"), f"stream{part}").awaitTermination()
        if not part:
            tables.append_views(views.filter(late == 2), path)
        retention.anonymize_log(f.shares, NOW, path)
    if retention.anonymize_log(f.shares, NOW, path):
        raise RuntimeError("a second retention run found rows to clear")
    return tables.read_views(f.spark, path)


@query
def f2_purged_shares(f):
    return retention.purge_stale_pending(f.shares, f.views, NOW)[0]


@query
def f2_purged_views(f):
    return retention.purge_stale_pending(f.shares, f.views, NOW)[1]


@query
def f2_purged_keys(f):
    return retention.purge_stale_pending(f.shares, f.views, NOW)[2]


def _deletes(f: Fixtures):
    verdicts = access.audit_access(f.access.filter("route = 'delete'"), f.shares, f.objects)
    return retention.apply_deletes(f.deletes(verdicts), f.shares, f.views, f.objects)


@query
def f3_deleted_shares(f):
    return _deletes(f)[0].select("slug", "status", "deleted_at")


@query
def f3_deleted_views(f):
    return _deletes(f)[1]


@query
def f3_deleted_keys(f):
    return _deletes(f)[2]


def _maintenance(f: Fixtures):
    return maintenance.maintenance_run(f.shares, f.views, f.objects, f.sweep_flags, NOW)


@query
def f4_maintenance_counters(f):
    return _maintenance(f).counters


@query
def f4_maintenance_shares(f):
    return _maintenance(f).shares


# ---- the same runs on stored tables, read back


def _store(f: Fixtures) -> str:
    """Shares, objects and the view log below a new folder."""
    folder = scratch(f.spark, "store")
    for table in ("shares", "objects", "views"):
        tables.save_table(getattr(f, table).drop("day"), folder, table)
    return folder


@query
def f2_stored_purge(f):
    folder = _store(f)
    stored_runs.purge(f.spark, folder, NOW)
    return tables.load_table(f.spark, folder, "views")


@query
def f3_stored_deletes(f):
    folder = _store(f)
    verdicts = access.audit_access(f.access.filter("route = 'delete'"), f.shares, f.objects)
    stored_runs.delete_shares(f.spark, folder, f.deletes(verdicts))
    return tables.load_table(f.spark, folder, "shares").select("slug", "status", "deleted_at")


@query
def f4_stored_shares(f):
    folder = _store(f)
    stored_runs.maintain(f.spark, folder, f.sweep_flags, NOW)
    return tables.load_table(f.spark, folder, "shares")


@query
def f4_stored_ledger(f):
    """The ledger of the tables as two runs leave them; the second one finds nothing to clear."""
    folder = _store(f)
    for _ in range(2):
        run = stored_runs.maintain(f.spark, folder, f.sweep_flags, NOW)
    if run.counters.filter("counter IN ('pending_cleaned', 'anonymised') AND n > 0").count():
        raise RuntimeError("a second maintenance run found rows to purge or clear")
    stored = [tables.load_table(f.spark, folder, t) for t in ("views", "shares")]
    return retention.retention_ledger(*stored, NOW)


@query
def f5_retention_ledger(f):
    return retention.retention_ledger(f.views, f.shares, NOW)


@query
def f5_ledger_after_run(f):
    run = _maintenance(f)
    return retention.retention_ledger(run.views, run.shares, NOW)


# ---- streams, over the same rows as their batch jobs


def _as_stream(f: Fixtures, df: DataFrame, name: str, files_per_batch: int | None = None) -> DataFrame:
    path = scratch(f.spark, name)
    df.write.parquet(path)
    return jobs.read_files(f.spark, path, df.schema, files_per_batch)


def _in_slices(f: Fixtures, start: Callable[..., StreamingQuery], batches: int, *inputs: tuple[DataFrame, Column]) -> None:
    """Run a stream in ``batches`` batches: ``inputs`` are its rows and the batch that each row comes with, from 0.

    The stream is started anew for every batch and takes all files that came since, so a batch has as many files as its
    rows need and no task holds a whole one.
    """
    paths = [scratch(f.spark, "slices") for _ in inputs]
    for i in range(batches):
        for path, (df, number) in zip(paths, inputs, strict=True):
            df.filter(number == i).write.mode("append").parquet(path)
        stream = start(*[jobs.read_files(f.spark, path, df.schema) for path, (df, _) in zip(paths, inputs, strict=True)])
        stream.awaitTermination()
        took = sum(p["numInputRows"] > 0 for p in stream.recentProgress)
        if took > 1:
            raise RuntimeError(f"the stream took a slice in {took} batches")


def _in_batches(f: Fixtures, df: DataFrame, start: Callable[[DataFrame], StreamingQuery], batches: int = 3) -> None:
    """Run a stream that gets the rows in ``batches`` batches, dealt by their content."""
    _in_slices(f, start, batches, (df, F.pmod(F.xxhash64(*df.columns), F.lit(batches))))


def _in_order(f: Fixtures, start: Callable[..., StreamingQuery], *inputs: tuple[DataFrame, str], batches: int = 4) -> None:
    """Run a stream that gets the rows of each input in ``batches`` batches by the time in the column named."""

    def by_time(df: DataFrame, at: str) -> Column:
        first, last = (x or 0 for x in df.agg(F.min(at), F.max(at)).first())
        return F.floor((F.col(at) - first) / ((last - first) // batches + 1))

    _in_slices(f, start, batches, *[(df, by_time(df, at)) for df, at in inputs])


def _folders(f: Fixtures, name: str) -> tuple[str, str]:
    return scratch(f.spark, name), scratch(f.spark, name + "-checkpoint")


@query
def s1_stream_enrich(f):
    out, checkpoint = _folders(f, "s1")
    _in_batches(
        f, f.hits, lambda hits: tables.append_views_stream(jobs.stream_enrich(hits, f.shares, SALT), out, checkpoint)
    )
    return tables.read_views(f.spark, out)


@query
def s2_stream_daily_views(f):
    out, checkpoint = _folders(f, "s2")
    _in_order(f, lambda views: jobs.stream_daily_views(views, "1 day", out, checkpoint), (f.views, "viewed_at"))
    return jobs.read_daily_views(f.spark, out)


@query
def s3_stream_counters(f):
    out, checkpoint = _folders(f, "s3")
    _in_batches(f, f.views, lambda views: jobs.stream_counters(views, out, checkpoint))
    return jobs.read_counters(f.spark, out)


@query
def s4_stream_unique_viewers(f):
    out, checkpoint = _folders(f, "s4")
    _in_batches(f, f.views, lambda views: jobs.stream_unique_viewers(views, out, checkpoint))
    return jobs.read_unique_viewers(f.spark, out)


@query
def s5_stream_upload_limiter(f):
    out, checkpoint = _folders(f, "s5")
    _in_order(f, lambda uploads: jobs.stream_upload_limiter(uploads, SALT, out, checkpoint), (f.uploads, "ts"))
    return jobs.read_upload_verdicts(f.spark, out)


@query
def s6_stream_reports(f):
    out, checkpoint = _folders(f, "s6")
    _in_batches(f, f.reports_raw, lambda raw: jobs.stream_reports(raw, f.shares, f.reports, out, checkpoint))
    return jobs.read_reports(f.spark, out)


@query
def s7_stream_stale_uploads(f):
    out, checkpoint = _folders(f, "s7")
    delay = 3600
    clock = F.lit(NOW + delay).cast("bigint")
    no_slug = F.lit("").alias("slug")
    tick = f.spark.range(1)
    begins = f.shares.select("slug", "created_at").unionByName(tick.select(no_slug, clock.alias("created_at")))
    ends = (
        f.shares.filter("committed_at is not null")
        .select("slug", F.col("committed_at").alias("ended_at"))
        .unionByName(tick.select(no_slug, clock.alias("ended_at")))
    )

    def start(begins: DataFrame, ends: DataFrame) -> StreamingQuery:
        return jobs.append_rows(jobs.stream_stale_uploads(begins, ends, f"{delay} seconds"), out, checkpoint)

    _in_order(f, start, (begins, "created_at"), (ends, "ended_at"))
    return f.spark.read.schema("slug string, created_at bigint").parquet(out)


@query
def s8_stream_write_limits(f):
    out, checkpoint = _folders(f, "s8")
    writes = f.api.filter("route = 'write'").select("ip_hash", "ts")
    _in_order(f, lambda writes: jobs.stream_write_limits(writes, "10 minutes", out, checkpoint), (writes, "ts"))
    return jobs.read_write_limits(f.spark, out)

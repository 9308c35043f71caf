"""Purges, deletes and the maintenance run on the stored tables: the same rules as over whole tables, written back.

A run marks the rows that it changes, rewrites the parts of the view log and of the shares that hold them, and
leaves all other files as they are.  Both tables change in one step (``tables.change_tables``): a run that broke off
is completed or dropped by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmeter.operators import retention
from leafmeter.plans import maintenance
from leafmeter.session import settled
from leafmeter.sources import tables


@dataclass(frozen=True)
class StoredRun:
    """Keys of the objects to delete, and the run's counters where it has some."""

    doomed_keys: DataFrame
    counters: DataFrame | None = None


def _touched(marked: DataFrame, leaves: Column, clears: Column) -> DataFrame:
    """The parts of the log that hold rows to change, with the number of rows to clear in each.  ``marked`` is the log with
    columns for ``leaves``, which marks rows that go, and ``clears``, which marks rows whose raw fields go."""
    return settled(
        marked.filter(leaves | clears).groupBy("day", "batch").agg(F.count_if(clears & ~leaves).alias("cleared"))
    )


def _write_back(
    spark: SparkSession, folder: str, shares: DataFrame, slugs: DataFrame, touched: DataFrame,
    mark: Callable[[DataFrame], DataFrame], leaves: Column, clears: Column,
) -> None:
    """Store ``shares``, of which those named in ``slugs`` changed or went, and the log without the rows that ``leaves``
    marks and without the raw fields of those that ``clears`` marks.  ``mark`` gives rows of the log the columns for these;
    of the log only the ``touched`` parts are read."""
    log = [*[f.name for f in tables.VIEWS.fields], "day", "batch"]
    changes = {}
    # One name a part, as many as the log has folders.
    names = [(row.day, row.batch) for row in touched.collect()]
    if names:
        views = mark(tables.read_parts(spark, f"{folder}/views", names))
        changes["views"] = tables.Change(retention.cleared(views.filter(~leaves), clears).select(*log), touched)
    part = tables.share_part(F.col("slug")).alias("part")
    parts = settled(slugs.select(part).distinct())
    changes["shares"] = tables.Change(shares.withColumn("part", part).join(parts, "part", "left_semi"), parts)
    tables.change_tables(spark, folder, changes)


def _open(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Shares and log, after a change that an earlier run left unfinished."""
    tables.finish_change(spark, folder)
    return tables.load_table(spark, folder, "shares"), tables.read_log(spark, f"{folder}/views")


def _flagged(log: DataFrame, slugs: DataFrame, name: str) -> DataFrame:
    marks = slugs.select("slug", F.lit(True).alias(name))
    return log.join(marks, "slug", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def purge(spark: SparkSession, folder: str, now: int) -> StoredRun:
    """Drop uploads that never finished, and their views, from the stored tables."""
    shares, log = _open(spark, folder)
    stale = settled(retention.stale_pending(shares, now).select("slug"))
    kept, _, keys = retention.purge_stale_pending(shares, log, now)
    keys = settled(keys)
    marks = F.col("_stale"), F.lit(False)

    def mark(rows: DataFrame) -> DataFrame:
        return _flagged(rows, stale, "_stale")

    _write_back(spark, folder, kept, stale, _touched(mark(log), *marks), mark, *marks)
    return StoredRun(keys)


def delete_shares(spark: SparkSession, folder: str, deletes: DataFrame) -> StoredRun:
    """Apply let-through deletes (``slug, ts``) to the stored tables."""
    shares, log = _open(spark, folder)
    objects = tables.load_table(spark, folder, "objects")
    after, _, keys = retention.apply_deletes(deletes, shares, log, objects)
    keys = settled(keys)
    # A delete that hits always names the share's first object.
    hit = settled(keys.select("slug").distinct())
    marks = F.lit(False), F.col("_hit") & retention.raw_fields_set()

    def mark(rows: DataFrame) -> DataFrame:
        return _flagged(rows, hit, "_hit")

    _write_back(spark, folder, after, hit, _touched(mark(log), *marks), mark, *marks)
    return StoredRun(keys)


def maintain(spark: SparkSession, folder: str, flags: DataFrame, now: int) -> StoredRun:
    """The maintenance run on the stored tables; ``flags`` as in ``maintenance_run``."""
    shares, log = _open(spark, folder)
    objects = tables.load_table(spark, folder, "objects")
    kept, _, pending_keys = retention.purge_stale_pending(shares, log, now)
    stale = settled(retention.stale_pending(shares, now).select("slug"))
    sweep = maintenance.sweep_shares(kept, objects, flags, now)
    marks = F.col("_stale"), F.col("changed")

    def mark(rows: DataFrame) -> DataFrame:
        return retention.with_due(_flagged(rows, stale, "_stale"), kept, now)

    touched = _touched(mark(log), *marks)
    # What the run returns is worked out before the files that it reads go.
    keys = settled(sweep.doomed_keys.unionByName(pending_keys))
    cleared = touched.agg(F.coalesce(F.sum("cleared"), F.lit(0)).alias("n"))
    counters = settled(
        maintenance.counter("pending_cleaned", stale.agg(F.count("*").alias("n")))
        .unionByName(maintenance.counter("anonymised", cleared))
        .unionByName(sweep.counters)
    )
    before = shares.select("slug", F.col("versions_pruned_below").alias("was_below"), F.col("orphan_since").alias("was_orphan"))
    same = F.col("was_below").eqNullSafe(F.col("versions_pruned_below")) & F.col("was_orphan").eqNullSafe(F.col("orphan_since"))
    moved = sweep.shares.join(before, "slug").filter(~same).select("slug")
    _write_back(spark, folder, sweep.shares, settled(moved.unionByName(stale)), touched, mark, *marks)
    return StoredRun(keys, counters)

"""The periodic maintenance run over all tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from leafmeter.operators import retention, versions
from leafmeter.session import settled


@dataclass(frozen=True)
class MaintenanceResult:
    shares: DataFrame
    views: DataFrame
    doomed_keys: DataFrame
    counters: DataFrame


@dataclass(frozen=True)
class Sweep:
    """Shares with the markers that the sweep leaves, the keys that go, and the counters ``pruned`` and ``skipped``."""

    shares: DataFrame
    doomed_keys: DataFrame
    counters: DataFrame


def counter(name: str, n: DataFrame) -> DataFrame:
    return n.select(F.lit(name).alias("counter"), "n")


def sweep_shares(shares: DataFrame, objects: DataFrame, flags: DataFrame, now: int) -> Sweep:
    """Sweep the versions of all eligible shares.

    Keys, markers and counters all come from the plan, which is stored: the listing of objects is read for it alone.
    """
    plan = settled(versions.sweep_plan(shares, objects, now))
    outcomes = settled(versions.sweep_outcomes(versions.sweep_eligible(shares, now), plan, flags))
    markers = outcomes.select(
        "slug",
        F.col("versions_pruned_below").alias("new_below"),
        F.col("orphan_since").alias("new_orphan"),
        F.lit(True).alias("swept"),
    )
    new_shares = (
        shares.join(markers, "slug", "left")
        .withColumn("versions_pruned_below", F.coalesce("new_below", "versions_pruned_below"))
        .withColumn("orphan_since", F.when(F.col("swept"), F.col("new_orphan")).otherwise(F.col("orphan_since")))
        .drop("new_below", "new_orphan", "swept")
    )
    doomed = plan.filter("why <> 'held_back'")
    failed = flags.filter("not delete_ok").select("slug")
    counters = counter("pruned", doomed.join(failed, "slug", "left_anti").agg(F.count("*").alias("n"))).unionByName(
        counter("skipped", outcomes.agg(F.count_if(~F.col("finished")).alias("n")))
    )
    return Sweep(new_shares, doomed.select("key"), counters)


def maintenance_run(
    shares: DataFrame,
    views: DataFrame,
    objects: DataFrame,
    flags: DataFrame,
    now: int,
) -> MaintenanceResult:
    """Purge stale uploads, clear old viewer data, then sweep versions.

    ``counters`` holds one row per counter.  ``skipped`` counts the eligible shares that the run could not finish: their
    listing was cut, a delete failed, or a young orphan was held back.
    """
    kept, kept_views, pending_keys = retention.purge_stale_pending(shares, views, now)
    cleared = retention.anonymize_views(kept_views, kept, now)
    sweep = sweep_shares(kept, objects, flags, now)
    counters = (
        counter("pending_cleaned", retention.stale_pending(shares, now).agg(F.count("*").alias("n")))
        .unionByName(counter("anonymised", cleared.filter("changed").agg(F.count("*").alias("n"))))
        .unionByName(sweep.counters)
    )
    return MaintenanceResult(
        shares=sweep.shares,
        views=cleared.drop("changed"),
        doomed_keys=sweep.doomed_keys.unionByName(pending_keys),
        counters=counters,
    )

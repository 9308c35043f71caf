"""Rules the stored tables must keep, checked over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from leafmeter.limits import REPORT_STATUSES, SHARE_STATUSES
from leafmeter.sources.tables import SCHEMAS


def _row_rules(df: DataFrame, table: str, statuses: tuple[str, ...] | None) -> DataFrame:
    """Counts of NULLs in required columns and of unknown statuses, in one scan."""
    rules = {
        f"{table}.null.{field.name}": F.col(field.name).isNull()
        for field in SCHEMAS[table].fields
        if not field.nullable
    }
    if statuses:
        rules[f"{table}.status"] = ~F.col("status").isin(*statuses)
    counts = df.agg(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.count_if(c).alias("n")) for r, c in rules.items()]).alias("all")
    )
    return counts.select(F.inline("all"))


def _duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Number of keys stored more than once."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
    return repeated.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")


def _unknown_slugs(df: DataFrame, shares: DataFrame, rule: str) -> DataFrame:
    """Rows whose slug has no share; counted per slug before the join."""
    per_slug = df.filter("slug is not null").groupBy("slug").agg(F.count("*").alias("rows"))
    lost = per_slug.join(shares.select("slug"), "slug", "left_anti")
    return lost.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).select(F.lit(rule).alias("rule"), "n")


def contract_violations(shares: DataFrame, views: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per broken rule: ``(rule, n)``."""
    found = [
        _row_rules(shares, "shares", SHARE_STATUSES),
        _row_rules(views, "views", None),
        _row_rules(reports, "reports", REPORT_STATUSES),
        _duplicates(shares, ["slug"], "shares.duplicate.slug"),
        _duplicates(reports, ["slug", "reporter_ip_hash"], "reports.duplicate.slug_reporter"),
        _unknown_slugs(views, shares, "views.unknown_slug"),
        _unknown_slugs(reports, shares, "reports.unknown_slug"),
    ]
    return reduce(DataFrame.unionByName, found).filter("n > 0")

"""Few large parts for the closed days of the view log."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import SparkSession, functions as F

from leafmeter.sources.tables import Change, Folder, change_tables, finish_change, finish_replacing, read_parts

#: Batch of the part that holds what was merged of a day.
MERGED = "merged"
_ID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def mergeable(batches: set[str]) -> set[str]:
    """The batches that no writer can write again.

    Appends without a name are written once.  A stream repeats its last micro-batch only, so all before the latest one
    in the log are final.  Batches and streams that were given a name may come again under it and stay as they are.
    """
    streams = {b: re.fullmatch(f"({_ID})-([0-9]+)", b) for b in batches}
    latest = defaultdict(int)
    for m in filter(None, streams.values()):
        latest[m[1]] = max(latest[m[1]], int(m[2]))
    final = {b for b, m in streams.items() if m and int(m[2]) < latest[m[1]]}
    return final | {b for b in batches if b == MERGED or re.fullmatch("[0-9a-f]{32}", b)}


def merge_closed_days(spark: SparkSession, folder: str, before: int) -> int:
    """Merge the small parts of every day of the log ``<folder>/views`` before day ``before`` into one; how many days.

    A day with fewer than two parts to merge keeps its files.  The merged parts take the old ones' places as one
    change, which the next run of any kind completes if it breaks off.  Rows that come late to a merged day are merged with it
    the next time.  Neither rows nor the order within files change for readers; appends may go on meanwhile.
    """
    path = f"{folder}/views"
    finish_change(spark, folder)
    finish_replacing(spark, path)
    # Names of folders, as many as the log has.
    parts = [re.fullmatch("day=(-?[0-9]+)/batch=(.+)", p) for p in Folder(spark, path).parts("", 2)]
    final = mergeable({m[2] for m in parts if m})
    days = defaultdict(list)
    for m in filter(None, parts):
        if int(m[1]) < before and m[2] in final:
            days[int(m[1])].append(m[2])
    small = [(day, batch) for day, batches in days.items() if len(batches) > 1 for batch in batches]
    if not small:
        return 0
    old = spark.createDataFrame(small, "day long, batch string")
    rows = read_parts(spark, path, small).withColumn("batch", F.lit(MERGED))
    change_tables(spark, folder, {"views": Change(rows, old)})
    return len({day for day, _ in small})

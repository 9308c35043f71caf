"""Statistics from a roll-up of the view log that is kept up to date part by part.

Beside the log lies one folder for each of its (day, batch) parts: the part's rows grouped by share, source and place (a group
may be several rows), and a sketch of every share's viewers.  The folder carries a stamp of the files that it was made from.  A part
that a stream, an append, a merge or a rewrite touched has other files and so another stamp; only such parts are read again.

Readers take the folders whose stamps are current and group the other parts from the log itself, so results are those of
the whole log at any time; ``refresh`` only makes them cheaper.  Counts are exact.  Distinct viewers are estimated
from the sketches; the exact number needs the viewers themselves (``stats.share_counts``).
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmeter.limits import DAY, LIMITS
from leafmeter.operators import retention, stats
from leafmeter.sources.tables import Folder, read_log, read_parts

#: Binary logarithm of a sketch's registers: a standard error of 1.04 / sqrt(2^12), or 1.6 %.
SKETCH = 12

_GROUP = ["slug", "referrer", "country", "city"]
_PARTS = "day bigint, batch string, stamp string"
_SCHEMAS = {
    "groups": "slug string, referrer string, country string, city string, rows bigint, views bigint, bot_views bigint, raw bigint, last_viewed bigint",
    "viewers": "slug string, viewers binary",
}


def log_parts(spark: SparkSession, path: str) -> dict[tuple[int, str], str]:
    """The (day, batch) parts of the log and their stamps: one entry a folder, from the names of its files."""
    files = defaultdict(list)
    for file in read_log(spark, path).inputFiles():
        m = re.search(r"/day=(-?[0-9]+)/batch=([^/]+)/([^/]+)$", file)
        files[int(m[1]), m[2]].append(m[3])
    return {part: hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:24] for part, names in files.items()}


def _slim(kind: str, log: DataFrame, *by: str) -> DataFrame:
    """What a roll-up of ``kind`` needs of each row of the log."""
    human = F.col("is_bot") == 0
    if kind == "viewers":
        return log.select(*by, "slug", F.when(human, F.col("ip_hash")).alias("viewer"))
    return log.select(*by, *_GROUP, "is_bot", retention.raw_fields_set().alias("is_raw"), "viewed_at")


def _rolled(kind: str, slim: DataFrame, *by: str) -> DataFrame:
    """Rows of ``_slim`` grouped as a roll-up of ``kind`` holds them, for each value of ``by``."""
    human = F.col("is_bot") == 0
    if kind == "viewers":
        # Shares with crawlers only hold an empty sketch, so that every part has its folder.
        return slim.groupBy(*by, "slug").agg(F.hll_sketch_agg("viewer", F.lit(SKETCH)).alias("viewers"))
    return slim.groupBy(*by, *_GROUP).agg(
        F.count("*").alias("rows"),
        F.count_if(human).alias("views"),
        F.count_if(F.col("is_bot") == 1).alias("bot_views"),
        F.count_if("is_raw").alias("raw"),
        F.max(F.when(human, F.col("viewed_at"))).alias("last_viewed"),
    )


def _laid_out(kind: str, log: DataFrame, parts: DataFrame) -> DataFrame:
    """The roll-up of ``kind`` of ``parts``, ranged by part and share for writing.

    Rows for the groups are ranged once and grouped where they then lie.  ``piece`` is the split of the log that a row was
    read from: a group that lies in many stays several rows, so a hot share is never one task's, and readers add them up as
    they add up parts.  Viewers become sketches first, which are smaller than they.
    """
    # Names of folders, which the driver holds.
    parts = F.broadcast(parts)
    slim = _slim(kind, log.join(parts, ["day", "batch"]), "part")
    if kind == "viewers":
        rolled = _rolled(kind, slim, "part").repartitionByRange("part", "slug")
    else:
        cut = slim.withColumn("piece", F.spark_partition_id()).repartitionByRange("part", *_GROUP, "piece")
        rolled = _rolled(kind, cut, "part", "piece").drop("piece")
    return rolled.join(parts, "part").drop("part")


class Rollup:
    """The roll-up beside the log at ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def _root(self, kind: str) -> str:
        return f"{self._path}.rollup/{kind}"

    def _held(self, kind: str) -> set[str]:
        return set(Folder(self._spark, self._root(kind)).parts("", 3))

    def _log(self, parts: list[tuple[int, str]]) -> DataFrame:
        """Only these parts of the log, without listing the others again."""
        return read_parts(self._spark, self._path, parts)

    def refresh(self) -> int:
        """Bring the roll-up up to date with the log; the number of parts that were read for it.

        A part's folder appears whole and under the stamp of its files, so a run that breaks off leaves nothing wrong and
        the next one goes on.  Folders of parts that changed or went are removed last.
        """
        read = set()
        now = log_parts(self._spark, self._path)
        current = {f"day={d}/batch={b}/stamp={s}": (d, b) for (d, b), s in now.items()}
        for kind in _SCHEMAS:
            held = self._held(kind)
            missing = [current[p] for p in sorted(current.keys() - held)]
            if missing:
                numbered = [(d, b, now[d, b], i) for i, (d, b) in enumerate(missing)]
                parts = self._spark.createDataFrame(numbered, f"{_PARTS}, part int")
                (
                    _laid_out(kind, self._log(missing), parts)
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("day", "batch", "stamp")
                    .parquet(self._root(kind))
                )
                read.update(missing)
            folder = Folder(self._spark, self._root(kind))
            for part in held - current.keys():
                folder.remove(part)
        return len(read)

    def rows(self, kind: str, first_day: int | None = None, but: int | None = None) -> DataFrame:
        """The roll-up of ``kind`` with ``day``, from ``first_day`` on and without the day ``but``."""
        held = self._held(kind)
        stored, changed = [], []
        for (day, batch), stamp in log_parts(self._spark, self._path).items():
            if (first_day is None or day >= first_day) and day != but:
                part = f"day={day}/batch={batch}/stamp={stamp}"
                stored.append(f"{self._root(kind)}/{part}") if part in held else changed.append((day, batch))
        schema = f"{_SCHEMAS[kind]}, {_PARTS}"
        out = self._spark.createDataFrame([], schema)
        if stored:
            out = self._spark.read.schema(schema).option("basePath", self._root(kind)).parquet(*stored)
        out = out.drop("batch", "stamp")
        return out.unionByName(_rolled(kind, _slim(kind, self._log(changed), "day"), "day")) if changed else out

    def since(self, start: int) -> DataFrame:
        """Groups of the views from ``start`` on; a day that it cuts is taken from the log."""
        whole = self.rows("groups", -(-start // DAY))
        if start % DAY == 0:
            return whole
        edge = read_log(self._spark, self._path).filter((F.col("day") == start // DAY) & (F.col("viewed_at") >= start))
        return whole.unionByName(_rolled("groups", _slim("groups", edge, "day"), "day"))

    def share_counts(self, shares: DataFrame) -> DataFrame:
        """As ``stats.share_counts`` with estimated ``unique_viewers``."""
        counts = self.rows("groups").groupBy("slug").agg(
            F.sum("views").alias("views"), F.sum("bot_views").alias("bot_views"), F.max("last_viewed").alias("last_viewed")
        )
        distinct = F.hll_sketch_estimate(F.hll_union_agg("viewers")).alias("unique_viewers")
        viewers = self.rows("viewers").groupBy("slug").agg(distinct)
        return stats.with_counts(shares, counts.join(viewers, "slug", "left"))

    def referrer_breakdown(self, now: int, top: int = LIMITS.top_referrers) -> DataFrame:
        groups = self.since(now - LIMITS.pii_retention_seconds).filter("views > 0")
        return stats.top_referrers(groups.groupBy("slug", "referrer").agg(F.sum("views").alias("n")), top)

    def location_breakdown(self, now: int, top: int = LIMITS.top_locations) -> DataFrame:
        groups = self.since(now - LIMITS.pii_retention_seconds).filter("views > 0")
        return stats.top_locations(groups.groupBy("slug", "country", "city").agg(F.sum("views").alias("n")), top)

    def daily_trend(self, shares: DataFrame, now: int, days: int = LIMITS.trend_days) -> DataFrame:
        groups = self.since(stats.trend_start(now, days)).filter("views > 0")
        return stats.dense_trend(shares, groups.groupBy("slug", "day").agg(F.sum("views").alias("n")), now, days)

    def retention_ledger(self, shares: DataFrame, now: int) -> DataFrame:
        """As ``retention.retention_ledger``; the day that the retention time cuts is taken from the log."""
        bound = now - LIMITS.pii_retention_seconds
        edge = bound // DAY
        overdue = F.when(F.col("day_number") < edge, F.col("raw")).otherwise(0).cast("bigint")
        whole = self.rows("groups", but=edge).groupBy("slug", F.col("day").alias("day_number"))
        per_slug = whole.agg(F.sum("rows").alias("rows"), F.sum("raw").alias("raw")).withColumn("overdue", overdue)
        cut = retention.ledger_groups(read_log(self._spark, self._path).filter(F.col("day") == edge), now)
        return retention.ledger_of(per_slug.unionByName(cut), shares)

"""Stored pages in buckets by object key, superseded versions apart.

Rendering joins the shares with the pages by key.  With the pages in buckets of that key only the shares are shuffled, never
a page; and since superseded versions lie in a table of their own, they are not read.  Keys and not slugs
are bucketed, so the versions of one share spread over all buckets.

Below the folder lie ``old-<buckets>`` and the generations ``live-<number>-<buckets>``.  A generation counts once it is
complete; the latest complete one is the current one.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmeter.functions import columns as C
from leafmeter.session import settled
from leafmeter.sources.tables import Folder

#: Buckets of a new store; about half a gigabyte of pages in each is a good size.
BUCKETS = 64
#: A store is tidied once this share of its live pages is superseded, so a page is rewritten a bounded number of times.
TIDY_SHARE = 0.2


def superseded(keys: DataFrame, shares: DataFrame) -> DataFrame:
    """``key`` of the objects below their share's latest version.

    Later versions (a write that is not through yet), keys that are not recognised and objects without a share are not
    superseded.  As the latest version only grows, a superseded page is never served again.
    """
    key = F.col("key")
    named = keys.select("key", C.key_slug(key).alias("slug"), C.key_version(key).alias("version"))
    latest = shares.select("slug", "latest_version")
    return named.join(latest, "slug").filter("version < latest_version").select("key").distinct()


@dataclass(frozen=True)
class PageStore:
    """The pages below ``path`` as rows ``key, html``; a key's page never changes."""

    spark: SparkSession
    path: str

    def live(self) -> DataFrame:
        """Every page that may still be served, in buckets."""
        return self._open("live", *self._current())

    def old(self) -> DataFrame:
        """Superseded pages, in buckets."""
        return self._open("old", self._latest("old")[0])

    def add(self, pages: DataFrame) -> None:
        """Store new pages; those with a NULL key or one that is there already are left out, so an addition that
        broke off can be repeated."""
        number, buckets = self._current()
        self._insert(_new(pages, self.live()), "live", number, buckets)

    def tidy(self, shares: DataFrame, least_share: float = TIDY_SHARE, buckets: int | None = None) -> bool:
        """Move superseded pages away, if they are ``least_share`` of the live ones or more; whether they were.

        Copies them first and then writes the others as the next generation, so a run that breaks off loses nothing and
        can be repeated.  The generation before stays for its readers until the next tidying.  No page may
        be added meanwhile.
        """
        number, size = self._current()
        live = self.live()
        gone = settled(superseded(live.select("key"), shares))
        n = gone.count()
        if not n or n < least_share * live.count():
            return False
        self._insert(_new(live.join(gone, "key", "left_semi"), self.old()), "old", self._latest("old")[0])
        self._generation(live.join(gone, "key", "left_anti"), number + 1, buckets or size)
        folder = Folder(self.spark, self.path)
        for earlier in self._numbers("live"):
            if earlier[0] < number:
                folder.remove(_name("live", *earlier))
        return True

    def _numbers(self, kind: str) -> list[tuple[int, ...]]:
        found = [re.fullmatch(rf"{kind}((?:-\d+)+)", name) for name in Folder(self.spark, self.path).names()]
        return sorted(tuple(map(int, m[1][1:].split("-"))) for m in found if m)

    def _latest(self, kind: str) -> tuple[int, ...]:
        folder = Folder(self.spark, self.path)
        done = [n for n in self._numbers(kind) if folder.has(f"{_name(kind, *n)}/_SUCCESS")]
        if not done:
            raise FileNotFoundError(f"no complete store of pages below {self.path}")
        return done[-1]

    def _current(self) -> tuple[int, int]:
        return self._latest("live")

    def _entry(self, kind: str, *numbers: int) -> str:
        """A folder's entry in the session's catalog, which names its buckets."""
        where = f"{self.path}/{_name(kind, *numbers)}"
        entry = f"pages_{hashlib.sha256(where.encode()).hexdigest()[:32]}"
        quoted = where.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {entry} (key STRING, html STRING) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {numbers[-1]} BUCKETS LOCATION '{quoted}'"
        )
        self.spark.catalog.refreshTable(entry)
        return entry

    def _open(self, kind: str, *numbers: int) -> DataFrame:
        return self.spark.table(self._entry(kind, *numbers))

    def _insert(self, pages: DataFrame, kind: str, *numbers: int) -> None:
        # The shuffle's hash is that of the buckets, so a task writes one file.
        rows = pages.select("key", "html").repartition(numbers[-1], "key")
        rows.write.insertInto(self._entry(kind, *numbers))

    def _generation(self, pages: DataFrame, number: int, buckets: int) -> None:
        # What a run that broke off left behind was never read.
        Folder(self.spark, self.path).remove(_name("live", number, buckets))
        self._insert(pages, "live", number, buckets)


def _name(kind: str, *numbers: int) -> str:
    return "-".join([kind, *map(str, numbers)])


def _new(pages: DataFrame, known: DataFrame) -> DataFrame:
    return pages.filter("key IS NOT NULL").join(known.select("key"), "key", "left_anti")


def create(spark: SparkSession, path: str, contents: DataFrame, shares: DataFrame, buckets: int = BUCKETS) -> PageStore:
    """A new store of ``contents`` (``key, html``, one row a key; without a key left out) below an unused folder."""
    store = PageStore(spark, path.rstrip("/"))
    rows = contents.filter("key IS NOT NULL")
    gone = settled(superseded(rows.select("key"), shares))
    store._insert(rows.join(gone, "key", "left_semi"), "old", buckets)
    store._generation(rows.join(gone, "key", "left_anti"), 0, buckets)
    return store

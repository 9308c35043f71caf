import shutil

import pytest
from helpers import DAY, NOW, rows, shares, views

from leafmeter.limits import LIMITS
from leafmeter.operators import retention, stats
from leafmeter.plans import rollups
from leafmeter.sources import compaction, tables

EDGE = NOW - LIMITS.pii_retention_seconds
TODAY = NOW // DAY


def some_views(spark, first, n):
    """Views over 40 days, on both sides of the retention time within its day too, a third of them of one share."""
    return views(
        spark,
        *[
            {
                "id": first + i, "slug": "a" if i % 3 == 0 else f"k{i % 7}", "ip_hash": f"v{i % 11}", "is_bot": int(i % 5 == 0),
                "viewed_at": EDGE - 30 + i if i % 4 == 0 else NOW - (i % 40) * DAY, "referrer": [None, "x.org", "y.org"][i % 3],
                "country": ["TW", None][i % 2], "ua": "U",
            }
            for i in range(n)
        ],
    )


def same(spark, path, s):
    """All statistics of the roll-up equal those of the whole log."""
    log, whole = rollups.Rollup(spark, path), tables.read_views(spark, path)
    for got, want in (
        (log.share_counts(s), stats.share_counts(s, whole)),
        (log.referrer_breakdown(NOW), stats.referrer_breakdown(whole, NOW)),
        (log.location_breakdown(NOW), stats.location_breakdown(whole, NOW)),
        (log.daily_trend(s, NOW), stats.daily_trend(s, whole, NOW)),
        (log.retention_ledger(s, NOW), retention.retention_ledger(whole, s, NOW)),
        (log.retention_ledger(s, NOW // DAY * DAY), retention.retention_ledger(whole, s, NOW // DAY * DAY)),
    ):
        assert sorted(map(str, rows(got, *want.columns))) == sorted(map(str, rows(want)))


def test_rollup_follows_appends_rewrites_and_merges(spark, tmp_path):
    folder, path = str(tmp_path), str(tmp_path / "views")
    s = shares(spark, {"slug": "a"}, {"slug": "k1", "status": "deleted"}, *[{"slug": f"k{i}"} for i in range(2, 9)])
    log = rollups.Rollup(spark, path)
    tables.append_views(some_views(spark, 0, 300), path)
    same(spark, path, s)  # without any roll-up
    assert log.refresh() == len(rollups.log_parts(spark, path)) > 30
    assert log.refresh() == 0
    same(spark, path, s)
    # One more day changes one part; a run over the deleted share and the overdue rows changes many.
    tables.append_views(views(spark, {"id": 1000, "slug": "zz"}, {"id": 1001, "is_bot": 1}), path)
    same(spark, path, s)
    assert log.refresh() == 1
    assert retention.anonymize_log(s, NOW, path) > 0
    same(spark, path, s)
    log.refresh()
    assert rows(log.retention_ledger(s, NOW).selectExpr("sum(overdue + deleted_raw)")) == [(0,)]
    tables.append_views(some_views(spark, 2000, 50), path)
    assert compaction.merge_closed_days(spark, folder, TODAY) > 10
    same(spark, path, s)
    log.refresh()
    same(spark, path, s)
    held = {p.parent for p in (tmp_path / "views.rollup" / "groups").glob("day=*/batch=*/stamp=*/*.parquet")}
    assert len(held) == len(rollups.log_parts(spark, path))


def test_a_refresh_that_broke_off_goes_on(spark, tmp_path):
    path = str(tmp_path / "views")
    s = shares(spark, {"slug": "a"})
    log = rollups.Rollup(spark, path)
    tables.append_views(some_views(spark, 0, 100), path)
    log.refresh()
    lost = sorted((tmp_path / "views.rollup" / "groups").glob("day=*"))[:3]
    for folder in lost:
        shutil.rmtree(folder)
    same(spark, path, s)
    assert log.refresh() == 3
    same(spark, path, s)


def test_only_changed_parts_are_read(spark, tmp_path):
    path = str(tmp_path / "views")
    tables.append_views(some_views(spark, 0, 100), path)
    log = rollups.Rollup(spark, path)
    log.refresh()
    tables.append_views(views(spark, {"id": 500, "slug": "a"}), path, "late")
    files = log.rows("groups").inputFiles()
    assert [f for f in files if "/views/" in f] == [f for f in files if "batch=late" in f] != []


def test_sketches_estimate_many_viewers(spark, tmp_path):
    path = str(tmp_path / "views")
    v = spark.range(60_000).selectExpr(
        "id", "'a' AS slug", f"{NOW} - (id % 3) * {DAY} AS viewed_at", "concat('v', id % 20000) AS ip_hash", "cast(0 as bigint) AS is_bot"
    )
    tables.append_views(tables.evolve_schema(v, "views"), path)
    log = rollups.Rollup(spark, path)
    log.refresh()
    n = rows(log.share_counts(shares(spark, {"slug": "a"})), "unique_viewers")[0][0]
    assert abs(n - 20_000) <= 20_000 * 5 * 1.04 / 2 ** (rollups.SKETCH / 2)


def test_merging_leaves_what_may_be_written_again(spark, tmp_path):
    folder, path = str(tmp_path), str(tmp_path / "views")
    day = lambda n: [{"id": n, "viewed_at": NOW - 2 * DAY}, {"id": n + 1, "viewed_at": NOW}]
    stream = "00000000-0000-0000-0000-00000000000"
    for i, name in enumerate([None, None, f"{stream}1-0", f"{stream}1-1", f"{stream}1-2", f"{stream}2-0", "mine-0", "mine-1"]):
        tables.append_views(views(spark, *day(10 * i)), path, name)
    before = sorted(map(str, rows(tables.read_views(spark, path))))
    assert compaction.merge_closed_days(spark, folder, TODAY) == 1
    assert sorted(map(str, rows(tables.read_views(spark, path)))) == before
    closed = {p.name for p in (tmp_path / "views" / f"day={TODAY - 2}").iterdir()}
    assert closed == {f"batch={b}" for b in (compaction.MERGED, f"{stream}1-2", f"{stream}2-0", "mine-0", "mine-1")}
    assert len(list((tmp_path / "views" / f"day={TODAY}").glob("batch=*"))) == 8
    # The last micro-batch of a stream comes again; nothing is doubled.
    tables.append_views(views(spark, *day(40)), path, f"{stream}1-2")
    assert sorted(map(str, rows(tables.read_views(spark, path)))) == before
    assert compaction.merge_closed_days(spark, folder, TODAY) == 0
    # A late append joins the merged part.
    tables.append_views(views(spark, {"id": 900, "viewed_at": NOW - 2 * DAY}), path)
    assert compaction.merge_closed_days(spark, folder, TODAY) == 1
    assert tables.read_views(spark, path).count() == len(before) + 1


def test_a_merge_that_broke_off_is_completed(spark, tmp_path, monkeypatch):
    folder, path = str(tmp_path), str(tmp_path / "views")
    for n in (0, 100):
        tables.append_views(some_views(spark, n, 60), path)
    before = sorted(map(str, rows(tables.read_views(spark, path))))
    left, move = [3], tables.Folder.move

    def tired(self, name, target):
        if not left[0]:
            raise OSError("lost")
        left[0] -= 1
        move(self, name, target)

    with monkeypatch.context() as m:
        m.setattr(tables.Folder, "move", tired)
        with pytest.raises(OSError):
            compaction.merge_closed_days(spark, folder, TODAY)
    # The day that is still open keeps its two parts; the merge that was completed leaves nothing to do.
    assert compaction.merge_closed_days(spark, folder, TODAY) == 0
    assert sorted(map(str, rows(tables.read_views(spark, path)))) == before


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_refresh_and_a_merge_shuffle_the_rows_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "views")
    for first in (0, 100):
        tables.append_views(some_views(spark, first, 100), path)
    log = rollups.Rollup(spark, path)
    parts = list(rollups.log_parts(spark, path))
    numbered = spark.createDataFrame([(d, b, "s", i) for i, (d, b) in enumerate(parts)], "day bigint, batch string, stamp string, part int")
    groups = rollups._laid_out("groups", log._log(parts), numbered)
    # One by range, and two of the names of the parts.
    assert shuffles(groups) - groups._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange ") == 1
    merged = []
    monkeypatch.setattr(compaction, "change_tables", lambda spark, folder, changes: merged.append(changes["views"].rows))
    assert compaction.merge_closed_days(spark, str(tmp_path), TODAY) > 0
    assert shuffles(merged[0]) == 0

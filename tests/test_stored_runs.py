import shutil

import pytest
from helpers import NOW, objects, rows, shares, views
from pyspark.sql import functions as F

from leafmeter.limits import LIMITS
from leafmeter.operators import retention
from leafmeter.plans import maintenance, stored_runs
from leafmeter.sources import tables

OLD = NOW - LIMITS.pii_retention_seconds
RAW = {"ua": "U", "referrer": "r", "country": "TW", "city": "Taipei"}
FLAGS = "slug string, listing_complete boolean, delete_ok boolean"


def store(spark, folder):
    """Shares in many parts, a log of two batches over five days, and objects."""
    s = shares(
        spark, {"slug": "a", "latest_version": 12}, {"slug": "gone", "status": "deleted"}, {"slug": "stuck", "latest_version": 14},
        {"slug": "p", "status": "pending", "created_at": 0}, *[{"slug": f"k{i}"} for i in range(60)],
    )
    old = {**RAW, "viewed_at": OLD - 1}
    v = views(
        spark, old, {**RAW, "slug": "k1", "viewed_at": NOW - 86_400}, {**RAW, "slug": "gone", "viewed_at": NOW - 2 * 86_400},
        {"slug": "p", "viewed_at": NOW - 3 * 86_400}, {**RAW, "slug": "k2", "viewed_at": NOW}, {"slug": "p", "viewed_at": NOW},
    )
    o = objects(spark, ["shares/a.html", "shares/a/v2.html", "shares/a/v3.html", "shares/stuck/v2.html", "shares/p.html"])
    tables.save_table(s, folder, "shares")
    tables.save_table(o, folder, "objects")
    tables.append_views(v.filter("id < 5"), f"{folder}/views", "one")
    tables.append_views(v.filter("id >= 5"), f"{folder}/views", "two")
    return s, v, o


def files(folder):
    return {str(p.relative_to(folder)) for t in ("shares", "views") for p in folder.glob(f"{t}/**/*.parquet")}


def stored(spark, folder):
    return [sorted(map(str, rows(tables.load_table(spark, str(folder), t)))) for t in ("shares", "views")]


def test_maintenance_writes_back_only_what_it_touches(spark, tmp_path):
    s, v, o = store(spark, str(tmp_path))
    flags = spark.createDataFrame([("stuck", True, False)], FLAGS)
    want = maintenance.maintenance_run(s, v, o, flags, NOW)
    want_rows = [sorted(map(str, rows(want.shares))), sorted(map(str, rows(tables.with_day(want.views).select("id", "slug", "ua", "day"))))]
    counters = dict(rows(want.counters))
    assert counters == {"pending_cleaned": 1, "anonymised": 2, "pruned": 3, "skipped": 1}
    before = files(tmp_path)
    run = stored_runs.maintain(spark, str(tmp_path), flags, NOW)
    assert dict(rows(run.counters)) == counters
    assert sorted(rows(run.doomed_keys)) == sorted(rows(want.doomed_keys))
    log = tables.load_table(spark, str(tmp_path), "views")
    assert sorted(map(str, rows(tables.load_table(spark, str(tmp_path), "shares").select(s.columns)))) == sorted(map(str, rows(want.shares.select(s.columns))))
    assert sorted(map(str, rows(log.select("id", "slug", "ua", "day")))) == want_rows[1]
    ledger = retention.retention_ledger(log, tables.load_table(spark, str(tmp_path), "shares"), NOW)
    assert sum(r.overdue + r.deleted_raw for r in ledger.collect()) == 0
    # The day without a change keeps its file, the day that held only a purged view is gone.
    kept = before & files(tmp_path)
    day = lambda t: t // 86_400
    assert any(f"day={day(NOW - 86_400)}/batch=one" in f for f in kept)
    assert any(f"day={day(NOW)}/batch=one" in f for f in kept)
    assert not any(f"day={day(NOW - 3 * 86_400)}/" in f for f in files(tmp_path))
    assert not any(f"day={day(NOW)}/batch=two" in f for f in files(tmp_path))
    shares_kept = [f for f in kept if f.startswith("shares/")]
    assert 0 < len([f for f in before if f.startswith("shares/")]) - len(shares_kept) <= 4
    # A second run changes nothing but tries the failed delete again.
    again = stored_runs.maintain(spark, str(tmp_path), flags, NOW)
    assert {c: n for c, n in rows(again.counters) if n} == {"skipped": 1}
    assert not (tmp_path / "_staged").exists()


def test_purge_and_deletes(spark, tmp_path):
    s, v, o = store(spark, str(tmp_path))
    keys = stored_runs.purge(spark, str(tmp_path), NOW).doomed_keys
    kept, kept_views, want_keys = retention.purge_stale_pending(s, v, NOW)
    assert rows(keys) == rows(want_keys) == [("shares/p.html",)]
    assert sorted(rows(tables.load_table(spark, str(tmp_path), "views"), "id")) == sorted(rows(kept_views, "id"))
    deletes = spark.createDataFrame([("k1", 20), ("k1", 10), ("gone", 5), ("zz", 1)], "slug string, ts bigint")
    keys = stored_runs.delete_shares(spark, str(tmp_path), deletes).doomed_keys
    after, after_views, want_keys = retention.apply_deletes(deletes, kept, kept_views, o)
    assert sorted(rows(keys)) == sorted(rows(want_keys))
    got = tables.load_table(spark, str(tmp_path), "shares")
    assert sorted(rows(got, "slug", "status", "deleted_at")) == sorted(rows(after, "slug", "status", "deleted_at"))
    assert sorted(rows(tables.load_table(spark, str(tmp_path), "views"), "id", "ua"), key=str) == sorted(rows(after_views, "id", "ua"), key=str)


@pytest.mark.parametrize("moved", [0, 1, 3])
def test_a_run_that_broke_off_is_completed_or_dropped(spark, tmp_path, monkeypatch, moved):
    whole, broken = tmp_path / "whole", tmp_path / "broken"
    none = spark.createDataFrame([], FLAGS)
    for folder in (whole, broken):
        store(spark, str(folder))
    stored_runs.maintain(spark, str(whole), none, NOW)
    before = stored(spark, broken)

    # Broken off before the change was final: nothing happened.
    def refuse(self, name, text):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables.Folder, "put", refuse)
        with pytest.raises(OSError):
            stored_runs.maintain(spark, str(broken), none, NOW)
    assert stored(spark, broken) == before

    # Broken off after it: some parts have moved, and the next run of any kind completes the rest.
    left, move = [moved], tables.Folder.move

    def tired(self, name, target):
        if not left[0]:
            # In the middle of a move: the old part is gone already.
            shutil.rmtree(target, ignore_errors=True)
            raise OSError("lost")
        left[0] -= 1
        move(self, name, target)

    with monkeypatch.context() as m:
        m.setattr(tables.Folder, "move", tired)
        with pytest.raises(OSError):
            stored_runs.maintain(spark, str(broken), none, NOW)
    assert tables.finish_change(spark, str(broken)) and not tables.finish_change(spark, str(broken))
    assert stored(spark, broken) == stored(spark, whole)


def test_streams_under_the_default_name_keep_their_rows(spark, tmp_path):
    path = str(tmp_path / "views")
    for i, n in enumerate((100, 30)):
        source = str(tmp_path / f"source{i}")
        v = views(spark, *[{"id": 1000 * i + k, "viewed_at": NOW + k} for k in range(n)])
        v.coalesce(1).write.parquet(source)
        stream = lambda: tables.append_views_stream(spark.readStream.schema(v.schema).parquet(source), path, str(tmp_path / f"c{i}"))  # noqa: B023, E731
        stream().awaitTermination()
        # The last micro-batch again, as after a failure.
        shutil.rmtree(tmp_path / f"c{i}" / "commits")
        stream().awaitTermination()
    assert tables.read_views(spark, path).count() == 130
    with pytest.raises(ValueError):
        tables.append_views(v, path, "a/b")


def test_the_listing_of_objects_is_read_for_the_plan_alone(spark, tmp_path):
    s, v, _ = store(spark, str(tmp_path))
    flags = spark.createDataFrame([("stuck", True, False)], FLAGS)
    listing = tables.load_table(spark, str(tmp_path), "objects")
    assert any("/objects/" in f for f in listing.inputFiles())
    run = maintenance.maintenance_run(s, v, listing, flags, NOW)
    for out in (run.shares, run.doomed_keys, run.counters):
        assert not any("/objects/" in f for f in out.inputFiles())


def test_a_run_reads_touched_parts_again_and_no_others(spark, tmp_path, monkeypatch):
    store(spark, str(tmp_path))
    none = spark.createDataFrame([], FLAGS)
    read, change = [], tables.change_tables

    def seen(spark, folder, changes):
        read.append({t: sorted(c.rows.inputFiles()) for t, c in changes.items()})
        change(spark, folder, changes)

    monkeypatch.setattr(tables, "change_tables", seen)
    stored_runs.maintain(spark, str(tmp_path), none, NOW)
    days = {int(f.split("/day=")[1].split("/")[0]) for f in read[0]["views"] if "/day=" in f}
    assert days == {(OLD - 1) // 86_400, *((NOW - k * 86_400) // 86_400 for k in (0, 2, 3))}
    assert not any(f"day={NOW // 86_400}/batch=one" in f for f in read[0]["views"])

    # The second run finds nothing to change and writes nothing.
    def refuse(views):
        raise AssertionError("the log is written again")

    before = files(tmp_path)
    monkeypatch.setattr(tables, "_laid_out", refuse)
    stored_runs.maintain(spark, str(tmp_path), none, NOW)
    assert not read[1].get("views") and files(tmp_path) == before


def test_rewritten_parts_keep_the_order_of_slugs(spark, tmp_path):
    store(spark, str(tmp_path))
    v = views(spark, *[{**RAW, "id": 100 + i, "slug": f"s{i * 7919 % 1000:03}", "viewed_at": OLD - 1} for i in range(300)])
    # A part of several files, as a large one is.
    part = tables.with_day(v).withColumn("batch", F.lit("three")).repartition(3)
    part.write.mode("append").partitionBy("day", "batch").parquet(f"{tmp_path}/views")
    run = stored_runs.maintain(spark, str(tmp_path), spark.createDataFrame([], FLAGS), NOW)
    assert dict(rows(run.counters))["anonymised"] == 302
    for f in (tmp_path / "views").glob("day=*/batch=three/*.parquet"):
        slugs = [r.slug for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert slugs == sorted(slugs)

from helpers import NOW, objects, rows, shares, views

from leafmeter.limits import LIMITS
from leafmeter.operators import contract, retention, stats
from leafmeter.plans import maintenance
from leafmeter.sources import tables

OLD = NOW - LIMITS.pii_retention_seconds
RAW = {"ua": "U", "referrer": "r", "country": "TW", "city": "Taipei"}


def log(spark):
    s = shares(spark, {"slug": "a"}, {"slug": "gone", "status": "deleted"})
    v = views(
        spark,
        {**RAW, "viewed_at": OLD}, {**RAW, "viewed_at": OLD - 1}, {"viewed_at": OLD - 1}, {"viewed_at": OLD - 1, "city": "X"},
        {**RAW, "slug": "gone"}, {**RAW, "slug": "nowhere", "viewed_at": NOW},
    )
    return s, v


def test_anonymise_edges_and_idempotence(spark):
    s, v = log(spark)
    once = retention.anonymize_views(v, s, NOW)
    assert sorted(rows(once.filter("changed"), "id")) == [(1,), (3,), (4,)]
    assert once.filter("changed and coalesce(ua, referrer, country, city) is not null").count() == 0
    again = retention.anonymize_views(once.drop("changed"), s, NOW)
    assert again.filter("changed").count() == 0
    assert sorted(rows(stats.share_counts(s, v))) == sorted(rows(stats.share_counts(s, once)))


def test_rewriting_touches_only_overdue_days(spark, tmp_path):
    s, v = log(spark)
    path = str(tmp_path / "views")
    tables.append_views(v, path)
    before = {p.name: sorted(x.name for x in p.rglob("*")) for p in (tmp_path / "views").iterdir() if p.is_dir()}
    assert retention.anonymize_log(s, NOW, path) == 3
    after = {p.name: sorted(x.name for x in p.rglob("*")) for p in (tmp_path / "views").iterdir() if p.is_dir()}
    touched = {f"day={(OLD - 1) // 86400}", f"day={NOW // 86400}"}
    assert {d for d in before if before[d] != after[d]} == touched
    got = tables.load_table(spark, str(tmp_path), "views")
    want = retention.anonymize_views(v, s, NOW).drop("changed")
    assert sorted(map(str, rows(got.select(want.columns)))) == sorted(map(str, rows(want)))
    assert retention.anonymize_log(s, NOW, path) == 0


def test_log_with_stream_append_and_rewrite(spark, tmp_path):
    s, v = log(spark)
    path, source = str(tmp_path / "views"), str(tmp_path / "source")
    v.filter("id < 3").write.parquet(source)
    for run in range(2):  # a repeated first batch replaces itself
        stream = spark.readStream.schema(v.schema).parquet(source)
        tables.append_views_stream(stream, path, str(tmp_path / f"checkpoint{run}"), "own").awaitTermination()
    tables.append_views(v.filter("id >= 3"), path)
    assert tables.read_views(spark, path).count() == v.count()
    assert retention.anonymize_log(s, NOW, path) == 3 and retention.anonymize_log(s, NOW, path) == 0
    want = retention.anonymize_views(v, s, NOW).drop("changed")
    got = tables.read_views(spark, path).select(want.columns)
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))


def test_a_rewrite_reads_touched_parts_alone(spark, tmp_path, monkeypatch):
    s, v = log(spark)
    v = v.unionByName(views(spark, {**RAW, "id": 9, "slug": "nowhere", "viewed_at": NOW - 5 * 86_400}))
    path = str(tmp_path / "views")
    tables.append_views(v, path)
    due = {r.day for r in tables.with_day(retention.anonymize_views(v, s, NOW)).filter("changed").collect()}
    read, replace = [], retention.replace_parts

    def seen(rows, path):
        read.extend(rows.inputFiles())
        replace(rows, path)

    monkeypatch.setattr(retention, "replace_parts", seen)
    assert retention.anonymize_log(s, NOW, path) == 3
    days = {int(p.name.removeprefix("day=")) for p in (tmp_path / "views").glob("day=*")}
    assert {int(f.split("/day=")[1].split("/")[0]) for f in read} == due < days


def test_broken_rewrite_is_finished_later(spark, tmp_path):
    _, v = log(spark)
    path = str(tmp_path / "views")
    tables.append_views(v, path, "one")
    # Staged in full, then broken off: the log's own part is gone.
    tables.read_log(spark, path).write.option("partitionOverwriteMode", "static").partitionBy("day", "batch").parquet(path + ".staged")
    import shutil

    day = sorted(p for p in (tmp_path / "views").iterdir() if p.name.startswith("day="))[0]
    shutil.rmtree(day)
    tables.finish_replacing(spark, path)
    assert tables.read_views(spark, path).count() == v.count()


def test_ledger_is_clean_after_a_run(spark):
    s, v = log(spark)
    before = retention.retention_ledger(v, s, NOW)
    assert sum(r.overdue for r in before.collect()) == 2 and sum(r.deleted_raw for r in before.collect()) == 1
    after = retention.retention_ledger(retention.anonymize_views(v, s, NOW), s, NOW)
    assert sum(r.overdue + r.deleted_raw for r in after.collect()) == 0


def test_stale_pending(spark):
    age = LIMITS.pending_age_seconds
    s = shares(
        spark,
        {"slug": "a", "status": "pending", "created_at": NOW - age}, {"slug": "b", "status": "pending", "created_at": NOW - age - 1},
        {"slug": "c", "created_at": 0},
    )
    kept, kept_views, keys = retention.purge_stale_pending(s, views(spark, {"slug": "a"}, {"slug": "b"}, {"slug": "z"}), NOW)
    assert sorted(rows(kept, "slug")) == [("a",), ("c",)]
    assert sorted(rows(kept_views, "slug")) == [("a",), ("z",)]
    assert rows(keys) == [("shares/b.html",)]


def test_deletes(spark):
    s = shares(spark, {"slug": "a"}, {"slug": "b", "status": "deleted", "deleted_at": 3}, {"slug": "p", "status": "pending"}, {"slug": "k"})
    v = views(spark, {**RAW, "slug": "a"}, {**RAW, "slug": "b"}, {**RAW, "slug": "k"})
    o = objects(spark, ["shares/a.html", "shares/a/v2.html", "shares/a/odd.txt", "shares/b/v2.html", "shares/ab/v2.html"])
    d = spark.createDataFrame([("a", 20), ("a", 10), ("b", 5), ("p", 7), ("zz", 1)], "slug string, ts bigint")
    ns, nv, keys = retention.apply_deletes(d, s, v, o)
    assert sorted(rows(ns, "slug", "status", "deleted_at")) == [
        ("a", "deleted", 10), ("b", "deleted", 3), ("k", "committed", None), ("p", "deleted", 7),
    ]
    assert sorted(rows(nv.filter("ua is null"), "slug")) == [("a",)]
    assert sorted(rows(keys, "key")) == [("shares/a.html",), ("shares/a/odd.txt",), ("shares/a/v2.html",), ("shares/p.html",)]


def test_maintenance_converges(spark):
    s = shares(
        spark,
        {"slug": "a", "latest_version": 12}, {"slug": "gone", "status": "deleted"},
        {"slug": "p", "status": "pending", "created_at": 0}, {"slug": "d2", "status": "deleted"},
    )
    _, v = log(spark)
    o = objects(spark, ["shares/a.html", "shares/a/v2.html", "shares/a/v3.html"])
    none = spark.createDataFrame([], "slug string, listing_complete boolean, delete_ok boolean")
    run = maintenance.maintenance_run(s, v, o, none, NOW)
    assert dict(rows(run.counters)) == {"pending_cleaned": 1, "anonymised": 3, "pruned": 4, "skipped": 0}
    left = o.join(run.doomed_keys, "key", "left_anti")
    second = maintenance.maintenance_run(run.shares, run.views, left, none, NOW)
    assert dict(rows(second.counters)) == {"pending_cleaned": 0, "anonymised": 0, "pruned": 0, "skipped": 0}


def test_contract(spark):
    s = shares(spark, {"slug": "a"}, {"slug": "a"}, {"slug": "b", "status": "odd"}, {"slug": "c", "client": None})
    v = views(spark, {"slug": "a"}, {"slug": "x"}, {"slug": "x"}, {"slug": None})
    schema = "id bigint, slug string, reason string, reporter_ip_hash string, reported_at bigint, status string, reporter_email string"
    r = spark.createDataFrame([(1, "a", "r", "h", 1, "open", None), (2, "a", "r", "h", 1, "odd", None)], schema)
    assert dict(rows(contract.contract_violations(s, v, r))) == {
        "shares.duplicate.slug": 1, "shares.status": 1, "shares.null.client": 1, "views.unknown_slug": 2, "views.null.slug": 1,
        "reports.duplicate.slug_reporter": 1, "reports.status": 1,
    }


def test_evolving_old_rows(spark):
    old = spark.createDataFrame([("a", "committed", "t", 1, "s", 5)], "slug string, status string, edit_token_hash string, created_at bigint, sender_ip_hash string, content_size bigint")
    got = tables.evolve_schema(old, "shares")
    assert got.columns == [f.name for f in tables.SHARES.fields]
    row = got.first()
    assert (row.client, row.latest_version, row.versions_pruned_below, row.owner_key_hash, row.orphan_since) == ("other", 1, 1, None, None)
    bots = spark.createDataFrame([(1, "a", 5, "v", "curl/8")], "id bigint, slug string, viewed_at bigint, ip_hash string, ua string")
    assert tables.evolve_schema(bots, "views").first().is_bot == 0

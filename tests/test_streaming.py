from helpers import DAY, rows, shares, views

from leafmeter.operators import intake, stats
from leafmeter.streaming import jobs


def files(spark, tmp_path, name, *batches):
    """A stream over one file per batch, one batch per trigger."""
    path = str(tmp_path / name)
    import os
    import time

    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(path)
        stamp = time.time() - 1000 + i
        for f in os.listdir(path):
            if f.endswith(".parquet") and os.path.getmtime(f"{path}/{f}") > time.time() - 500:
                os.utime(f"{path}/{f}", (stamp, stamp))
    return jobs.read_files(spark, path, batches[0].schema, 1)


def test_counters_and_viewers_over_batches(spark, tmp_path):
    one = views(spark, {"ip_hash": "x"}, {"ip_hash": "x"}, {"ip_hash": "y", "is_bot": 1, "viewed_at": 9})
    two = views(spark, {"ip_hash": "x", "viewed_at": 3}, {"ip_hash": "z"}, {"slug": "b", "ip_hash": "x"})
    out = {n: (str(tmp_path / n), str(tmp_path / f"{n}-c")) for n in ("counts", "viewers")}
    jobs.stream_counters(files(spark, tmp_path, "v", one, two), *out["counts"]).awaitTermination()
    jobs.stream_unique_viewers(files(spark, tmp_path, "w", one, two), *out["viewers"]).awaitTermination()
    want = stats.view_counts(one.unionByName(two))
    assert sorted(rows(jobs.read_counters(spark, out["counts"][0]))) == sorted(rows(want, "slug", "views", "bot_views", "last_viewed"))
    assert sorted(rows(jobs.read_unique_viewers(spark, out["viewers"][0]))) == sorted(rows(want, "slug", "unique_viewers"))


def test_daily_views_keep_open_days_and_drop_late_rows(spark, tmp_path):
    days = [
        views(spark, {"viewed_at": 10 * DAY}, {"viewed_at": 10 * DAY + 5}),
        views(spark, {"viewed_at": 13 * DAY}),
        # Rows count as late by the watermark of the batch before.
        views(spark, {"viewed_at": 13 * DAY + 1}),
        views(spark, {"viewed_at": 10 * DAY + 9}, {"viewed_at": 16 * DAY}),
    ]
    out = str(tmp_path / "out")
    query = jobs.stream_daily_views(files(spark, tmp_path, "v", *days), "1 day", out, str(tmp_path / "c"))
    query.awaitTermination()
    got = sorted(rows(jobs.read_daily_views(spark, out), "date", "views"))
    assert got == [("1970-01-11", 2), ("1970-01-14", 2), ("1970-01-17", 1)]
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert late == 1


def test_stale_uploads_over_batches_with_late_rows(spark, tmp_path):
    begin = lambda *r: spark.createDataFrame(list(r), "slug string, created_at bigint")
    end = lambda *r: spark.createDataFrame(list(r), "slug string, ended_at bigint")
    begins = [begin(("a", 1000)), begin(("late", 1399)), begin(("late2", 1390), ("done", 1395)), begin(("y", 2500)), begin(("", 9000))]
    ends = [end(("x", 1000)), end(("x", 1500)), end(("x", 1600)), end(("done", 1500), ("x", 2500)), end(("", 9000))]
    stale = jobs.stream_stale_uploads(files(spark, tmp_path, "b", *begins), files(spark, tmp_path, "e", *ends), "1200 seconds")
    out = str(tmp_path / "out")
    jobs.append_rows(stale, out, str(tmp_path / "c")).awaitTermination()
    assert sorted(rows(spark.read.schema(stale.schema).parquet(out), "slug")) == [("a",), ("late",), ("late2",), ("y",)]


def test_upload_limiter_carries_over_batches(spark, tmp_path):
    schema = "attempt_id bigint, ip string, ts bigint, content_type string, bearer string, ua string, html string"

    def batch(*items):
        return spark.createDataFrame([(i, ip, ts, "text/html", None, None, "<p>") for i, ip, ts in items], schema)

    parts = [batch((1, "a", 100), (2, "b", 100)), batch((3, "a", 129), (4, "a", 130), (5, "b", 200)), batch((6, "a", 159), (7, "a", 160))]
    out = str(tmp_path / "out")
    jobs.stream_upload_limiter(files(spark, tmp_path, "u", *parts), "s", out, str(tmp_path / "c")).awaitTermination()
    got = {r.attempt_id: r.code for r in jobs.read_upload_verdicts(spark, out).collect()}
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert got == {r.attempt_id: r.code for r in intake.admit_uploads(whole, "s").collect()}
    assert [got[i] for i in range(1, 8)] == [201, 201, 429, 201, 201, 429, 201]


def test_earlier_report_arriving_late_wins(spark, tmp_path):
    schema = "request_id bigint, slug string, reason string, email string, email_is_text boolean, reporter_ip_hash string, ts bigint"
    one = spark.createDataFrame([(1, "a", "later", None, True, "x", 50), (2, "a", "old", None, True, "z", 1)], schema)
    two = spark.createDataFrame([(3, "a", " first ", None, True, "x", 40), (4, "no", "r", None, True, "x", 1)], schema)
    s = shares(spark, {"slug": "a"})
    old = spark.createDataFrame([("a", "z")], "slug string, reporter_ip_hash string")
    out = str(tmp_path / "out")
    jobs.stream_reports(files(spark, tmp_path, "r", one, two), s, old, out, str(tmp_path / "c")).awaitTermination()
    batch = intake.new_reports(intake.intake_reports(one.unionByName(two), s, old))
    got = rows(jobs.read_reports(spark, out))
    assert got == rows(batch) and got[0][:3] == (3, "a", "first")


def test_stale_uploads(spark, tmp_path):
    begins = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 1000), ("d", 1699), ("e", 1700), ("", 2000)], "slug string, created_at bigint")
    ends = spark.createDataFrame([("a", 1300), ("b", 1301), ("", 2000)], "slug string, ended_at bigint")
    stale = jobs.stream_stale_uploads(files(spark, tmp_path, "b", begins), files(spark, tmp_path, "e", ends), "0 seconds")
    out = str(tmp_path / "out")
    jobs.append_rows(stale, out, str(tmp_path / "c")).awaitTermination()
    assert sorted(rows(spark.read.schema(stale.schema).parquet(out))) == [("b", 1000), ("c", 1000), ("d", 1699)]


def test_write_limits(spark, tmp_path):
    one = spark.createDataFrame([("x", t) for t in range(20)] + [("y", 5)], "ip_hash string, ts bigint")
    two = spark.createDataFrame([("x", t) for t in range(20, 75)], "ip_hash string, ts bigint")
    out = str(tmp_path / "out")
    jobs.stream_write_limits(files(spark, tmp_path, "w", one, two), "10 minutes", out, str(tmp_path / "c")).awaitTermination()
    assert sorted(rows(jobs.read_write_limits(spark, out))) == [("x", 0, 60, True), ("x", 60, 15, False), ("y", 0, 1, False)]


def _folders(path):
    return sorted(p.name for p in path.iterdir() if "=" in p.name)


def test_logs_fold_to_the_same_rows(spark, tmp_path):
    """Each log read before folding, after it, after one more, and with a batch and a folding repeated."""
    counts = spark.createDataFrame
    cases = {
        "counter": (jobs.counter_log, "slug string, views bigint, bot_views bigint, last_viewed bigint", lambda i: ("ab"[i % 2], i, 1, None if i == 3 else 10 * i)),
        "viewer": (jobs.viewer_log, "slug string, unique_viewers bigint", lambda i: ("ab"[i % 2], i)),
        "daily": (jobs.daily_log, "slug string, date string, views bigint", lambda i: ("a", f"2024-01-0{1 + i % 3}", i)),
        "window": (jobs.window_log, "ip_hash string, window_start bigint, n bigint", lambda i: ("x", 60 * (i % 2), i)),
        "report": (jobs.report_log, "slug string, reporter_ip_hash string, first struct<ts:bigint,id:bigint>", lambda i: ("a", "xyz"[i % 3], (100 - i, i))),
    }
    for name, (make, schema, row) in cases.items():
        path = tmp_path / name
        log = make(str(path))
        for i in range(5):
            log.write(counts([row(i), row(i + 1)], schema), i)
        want = sorted(map(str, log.read(spark).collect()))
        log.compact(spark, 3)
        assert sorted(map(str, log.read(spark).collect())) == want
        # The last batch again, and the folding again.
        log.write(counts([row(4), row(5)], schema), 4)
        log.compact(spark, 3)
        assert sorted(map(str, log.read(spark).collect())) == want
        # What the first folding replaced goes with the second.
        assert _folders(path) == [f"batch={i}" for i in range(5)] + ["upto=3"]
        log.compact(spark, 4)
        assert sorted(map(str, log.read(spark).collect())) == want
        assert _folders(path) == ["batch=4", "upto=3", "upto=4"]
        assert log.folders(spark) == [f"{path}/upto=4"]


def test_a_broken_folding_is_not_read(spark, tmp_path):
    log = jobs.viewer_log(str(tmp_path / "log"))
    for i in range(3):
        log.write(spark.createDataFrame([("a", 1)], "slug string, unique_viewers bigint"), i)
    log.compact(spark, 1)
    (tmp_path / "log" / "upto=1" / "_SUCCESS").unlink()
    assert rows(log.read(spark)) == [("a", 3)]
    log.compact(spark, 1)
    assert rows(log.read(spark)) == [("a", 3)] and len(log.folders(spark)) == 2


def test_streams_fold_as_they_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "FOLD_EVERY", 2)
    parts = [views(spark, {"ip_hash": str(i)}, {"slug": "b", "ip_hash": "x", "is_bot": i % 2}) for i in range(5)]
    out = tmp_path / "counts"
    jobs.stream_counters(files(spark, tmp_path, "v", *parts), str(out), str(tmp_path / "c")).awaitTermination()
    assert _folders(out) == ["batch=2", "batch=3", "batch=4", "upto=1", "upto=3"]
    assert sorted(rows(jobs.read_counters(spark, str(out)), "slug", "views", "bot_views")) == [("a", 5, 0), ("b", 3, 2)]


def test_limiter_state_does_not_grow_with_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "FOLD_EVERY", 2)
    schema = "attempt_id bigint, ip string, ts bigint, content_type string, bearer string, ua string, html string"
    # One sender tries every 10 seconds, a new one comes in each batch, and batches are short.
    parts = [
        spark.createDataFrame([(10 * i + k, ip, ts, "text/html", None, None, "<p>") for k, (ip, ts) in enumerate([("a", 20 * i), ("a", 20 * i + 10), (f"s{i}", 20 * i)])], schema)
        for i in range(7)
    ]
    out, checkpoint = str(tmp_path / "out"), tmp_path / "c"
    read = []
    folders = jobs.BatchLog.folders

    def counted(self, spark, before=None):
        found = folders(self, spark, before)
        read.append(len(found))
        return found

    monkeypatch.setattr(jobs.BatchLog, "folders", counted)
    run = lambda: jobs.stream_upload_limiter(files(spark, tmp_path, "u", *parts) if not read else again, "s", out, str(checkpoint))
    run().awaitTermination()
    assert max(read) <= 3 and len(read) == 7
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    want = {r.attempt_id: r.code for r in intake.admit_uploads(whole, "s").collect()}
    got = lambda: {r.attempt_id: r.code for r in jobs.read_upload_verdicts(spark, out).collect()}
    assert got() == want
    # The last batch again: its commit was lost.
    for name in ("6", ".6.crc"):
        (checkpoint / "commits" / name).unlink()
    again = jobs.read_files(spark, str(tmp_path / "u"), parts[0].schema, 1)
    run().awaitTermination()
    assert got() == want and len(read) == 8


def test_reports_are_reduced_before_they_meet_shares(spark):
    schema = "request_id bigint, slug string, reason string, email string, email_is_text boolean, reporter_ip_hash string, ts bigint"
    raw = spark.createDataFrame([(1, "a", "r", None, True, "x", 50)], schema)
    old = spark.createDataFrame([("a", "z")], "slug string, reporter_ip_hash string")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        plan = jobs.first_reports(raw, shares(spark, {"slug": "a"}), old)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # From the reports upwards: the partial aggregate comes before any exchange, and slug alone deals reduced pairs.
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Aggregate" in line]
    own = [i for i, line in enumerate(lines) if "Aggregate" in line]
    by_slug = [i for i, line in enumerate(lines) if "hashpartitioning(slug" in line and "reporter_ip_hash" not in line]
    assert by_slug and own and by_slug[0] < own[0]
    assert "hashpartitioning(slug" in lines[own[0] + 1] and "reporter_ip_hash" in lines[own[0] + 1]

import pytest
from helpers import shares

from leafmeter.operators import hits
from leafmeter.sources import pages
from leafmeter.sources.tables import Folder

PAGES = [
    ("shares/a.html", "a1"), ("shares/a/v2.html", "a2"), ("shares/a/v3.html", "a3"), ("shares/b.html", "b1</body>"),
    ("shares/gone/v2.html", "no share"), ("shares/a/notes.txt", "not recognised"),
]


def at(spark, a, b):
    return shares(spark, {"slug": "a", "latest_version": a}, {"slug": "b", "latest_version": b})


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, html string")


def keys(df):
    return sorted(r["key"] for r in df.collect())


def served(spark, store, s):
    return {r["slug"]: r["html"] for r in hits.render_pages(s, store.live(), "h", footer="{url}").collect()}


def test_pages_move_with_the_versions(spark, tmp_path):
    store = pages.create(spark, f"{tmp_path}/it's", frame(spark, [*PAGES, (None, "x")]), at(spark, 2, 1), buckets=4)
    assert keys(store.old()) == ["shares/a.html"]
    s = at(spark, 2, 1)
    assert served(spark, store, s)["a"].startswith("a2")
    # The next version of a is there already; it is served once the share says so, tidied or not.
    s = at(spark, 3, 2)
    added = frame(spark, [("shares/b/v2.html", "b2"), ("shares/a.html", "a1")])
    store.add(added.filter("html = 'b2'"))
    store.add(added.filter("html = 'b2'"))
    before = served(spark, store, s)
    assert before["a"].startswith("a3") and before["b"].startswith("b2")
    assert not store.tidy(s, least_share=0.9)
    assert store.tidy(s, least_share=0.1, buckets=2)
    assert served(spark, store, s) == before
    assert keys(store.old()) == ["shares/a.html", "shares/a/v2.html", "shares/b.html"]
    assert keys(store.live()) == ["shares/a/notes.txt", "shares/a/v3.html", "shares/b/v2.html", "shares/gone/v2.html"]
    assert not store.tidy(s, least_share=0.0)


def test_a_broken_tidying_is_repeated(spark, tmp_path, monkeypatch):
    store = pages.create(spark, str(tmp_path / "p"), frame(spark, PAGES), at(spark, 1, 1), buckets=4)
    s = at(spark, 3, 1)
    with monkeypatch.context() as patch:
        patch.setattr(pages.PageStore, "_generation", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.tidy(s)
    # Files of a generation that never became complete.
    frame(spark, [("shares/a/v9.html", "half")]).write.parquet(str(tmp_path / "p" / "live-1-4"))
    (tmp_path / "p" / "live-1-4" / "_SUCCESS").unlink()
    assert served(spark, store, s)["a"].startswith("a3")
    assert store.tidy(s)
    assert keys(store.old()) == ["shares/a.html", "shares/a/v2.html"] and len(keys(store.live())) == 4
    assert Folder(spark, store.path).names() == ["live-0-4", "live-1-4", "old-4"]


def test_rendering_shuffles_no_page_and_reads_no_old_one(spark, tmp_path):
    store = pages.create(spark, str(tmp_path / "p"), frame(spark, PAGES), at(spark, 3, 1), buckets=4)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = hits.render_pages(at(spark, 3, 1), store.live(), "h")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(out.collect()) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    # The join's first side, the shares, is the one shuffled; the pages are its second side, scanned in buckets.
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert ":" in exchanges[0].split("Exchange")[0] and ":" not in scan.split("FileScan")[0]
    assert all("/live-0-4/" in path for path in out.inputFiles())


def test_empty_store(spark, tmp_path):
    store = pages.create(spark, str(tmp_path / "p"), frame(spark, []), at(spark, 1, 1), buckets=2)
    assert store.live().collect() == [] and not store.tidy(at(spark, 1, 1))
    store.add(frame(spark, PAGES[:1]))
    assert keys(store.live()) == ["shares/a.html"]
    with pytest.raises(FileNotFoundError):
        pages.PageStore(spark, str(tmp_path / "none")).live()

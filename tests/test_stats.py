import json

from helpers import DAY, NOW, rows, shares, views

from leafmeter.limits import LIMITS
from leafmeter.operators import hits, reach, stats
from leafmeter.plans import share_docs

WINDOW = LIMITS.pii_retention_seconds


def refs(spark, *vs):
    got = stats.referrer_breakdown(views(spark, *vs), NOW).orderBy("slug", "rank")
    return rows(got, "source", "views")


def places(spark, *vs):
    got = stats.location_breakdown(views(spark, *vs), NOW).orderBy("slug", "rank")
    return rows(got, "country", "city", "label", "views")


def test_counts_of_all_shares(spark):
    s = shares(spark, {"slug": "a"}, {"slug": "b", "status": "deleted"}, {"slug": "c", "status": "pending"})
    v = views(
        spark,
        {"ip_hash": "x", "viewed_at": NOW - 9000},
        {"ip_hash": "x", "viewed_at": NOW - 10},
        {"ip_hash": "y"},
        {"ip_hash": "y", "is_bot": 1, "viewed_at": NOW + 5},
        {"ip_hash": "z", "is_bot": 1},
        {"slug": "b", "ip_hash": "x", "viewed_at": 5},
    )
    for approximate in (False, True):
        got = stats.share_counts(s, v, approximate).orderBy("slug")
        assert rows(got, "slug", "views", "unique_viewers", "bot_views", "last_viewed", "deleted") == [
            ("a", 3, 2, 2, NOW, False),
            ("b", 1, 1, 0, 5, True),
            ("c", 0, 0, 0, None, False),
        ]


def test_hosts_fold_and_tail_goes_to_other(spark):
    vs = [{"referrer": f"https://{h}.example/p"} for i, h in enumerate("abcdefg") for _ in range(7 - i)]
    got = refs(spark, *vs)
    assert got == [("a.example", 7), ("b.example", 6), ("c.example", 5), ("d.example", 4), ("e.example", 3), ("other", 3)]
    folded = refs(spark, {"referrer": "https://www.g.com/?q"}, {"referrer": "g.com"}, {"referrer": "h.com"})
    assert folded == [("g.com", 2), ("h.com", 1)]


def test_one_other_bucket(spark):
    junk = [{"referrer": "not a url at all"}] * 10
    got = refs(spark, *junk, *[{"referrer": f"https://{h}.example/"} for h in "abcdef"])
    assert [v for s, v in got if s == "other"] == [12]
    assert sum(v for _, v in got) == 16


def test_bounded_whatever_the_header(spark):
    got = refs(spark, *[{"referrer": f"https://host-{i}.example/{i}"} for i in range(60)], {"referrer": None})
    assert len(got) <= LIMITS.top_referrers + 1 and sum(v for _, v in got) == 61


def test_window_edges_and_bots(spark):
    got = refs(
        spark,
        {"referrer": "a.com", "viewed_at": NOW - WINDOW},
        {"referrer": "b.com", "viewed_at": NOW - WINDOW - 1},
        {"referrer": "c.com", "is_bot": 1},
    )
    assert got == [("a.com", 1)]


def test_locations(spark):
    got = places(
        spark,
        {"country": "TW", "city": "Taipei"}, {"country": "TW", "city": "Taipei"}, {"country": "TW", "city": "Taipei"},
        {"country": "TW", "city": ""}, {"country": "TW", "city": None}, {"country": "", "city": ""},
    )
    assert got == [("TW", "Taipei", "Taipei, TW", 3), ("TW", None, "TW", 2), (None, None, "unknown", 1)]
    tail = places(spark, *[{"country": "TW", "city": f"C{i}"} for i in range(10) for _ in range(10 - i)])
    assert len(tail) == LIMITS.top_locations + 1
    assert [r for r in tail if r[2] == "other"] == [(None, None, "other", 3)]
    assert sum(r[3] for r in tail) == 55


def test_country_named_other_keeps_its_columns(spark):
    vs = [{"country": "other"}] * 20 + [{"country": "TW", "city": f"C{i}"} for i in range(12)]
    got = places(spark, *vs)
    assert got[0] == ("other", None, "other", 20 + 5)


def test_trend_is_dense(spark):
    s = shares(spark, {"slug": "a"}, {"slug": "quiet"})
    v = views(
        spark,
        {"viewed_at": NOW}, {"viewed_at": NOW}, {"viewed_at": NOW - 2 * DAY}, {"viewed_at": NOW, "is_bot": 1},
        {"viewed_at": NOW - 60 * DAY}, {"viewed_at": NOW + DAY},
    )
    trend = stats.daily_trend(s, v, NOW)
    got = rows(trend.filter("slug = 'a'").orderBy("date"), "date", "views")
    assert len(got) == 30 and [n for _, n in got][-3:] == [1, 0, 2] and sum(n for _, n in got) == 3
    assert trend.filter("slug = 'quiet' and views = 0").count() == 30
    profile = rows(stats.trend_profile(trend).orderBy("date"), "views", "pct", "peak", "last7")
    assert len(profile) == 30 and profile[-3:] == [(1, 50, 2, 3), (0, 0, 2, 3), (2, 100, 2, 3)]
    assert stats.share_counts(s, v).filter("slug = 'a'").first()["views"] == 5


def test_percent_rounds_halves_up(spark):
    trend = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-02", 8)], "slug string, date string, views bigint")
    assert sorted(rows(stats.trend_profile(trend), "pct")) == [(13,), (100,)]


def test_document(spark):
    s = shares(spark, {"slug": "a", "created_at": 0}, {"slug": "b"})
    v = views(spark, {"referrer": "x.com", "viewed_at": NOW})
    docs = {r.slug: json.loads(r.document) for r in share_docs.share_stats_json(s, v, NOW).collect()}
    assert docs["a"]["createdAt"] == "1970-01-01T00:00:00.000Z"
    assert docs["a"]["referrers"] == [{"source": "x.com", "views": 1}]
    assert docs["a"]["locations"] == [{"country": None, "city": None, "label": "unknown", "views": 1}]
    assert docs["b"]["lastViewedAt"] is None and docs["b"]["referrers"] == []
    assert len(docs["b"]["dailyViews"]) == 30
    text = json.dumps(docs)
    assert "ip_hash" not in text and "token" not in text


def test_hot_slug_matches_plain_counting(spark):
    vs = [{"slug": "hot" if i % 3 else f"s{i % 50}", "ip_hash": f"v{i % 97}", "referrer": f"h{i % 11}.com"} for i in range(900)]
    counts = {r.slug: (r.views, r.unique_viewers) for r in stats.view_counts(views(spark, *vs)).collect()}
    for slug in counts:
        mine = [x for x in vs if x["slug"] == slug]
        assert counts[slug] == (len(mine), len({x["ip_hash"] for x in mine}))


def test_hits_to_views_round_trip(spark):
    h = spark.createDataFrame(
        [
            (1, "slugslug", 100, None, "198.51.100.7, 10.0.0.1", "Slackbot 1", None, None, None),
            (2, "slugslug", 200, "203.0.113.1", None, None, "https://www.reddit.com/r/x", "TW", ""),
            (3, "pendingg", 300, "203.0.113.1", None, None, None, None, None),
            (4, "BAD", 300, "203.0.113.1", None, None, None, None, None),
        ],
        "hit_id bigint, slug string, t bigint, cf_ip string, xff string, ua string, referer string, country string, city string",
    ).selectExpr("*", "timestamp_seconds(t) as ts")
    s = shares(spark, {"slug": "slugslug"}, {"slug": "pendingg", "status": "pending"}, {"slug": "BAD"})
    got = hits.enrich_hits(h, s, "salt").orderBy("id")
    assert rows(got, "id", "viewed_at", "is_bot", "referrer", "country", "city") == [
        (1, 100, 1, None, None, None),
        (2, 200, 0, "reddit.com", "TW", ""),
    ]
    import hashlib

    assert got.first()["ip_hash"] == hashlib.sha256(b"salt:198.51.100.7").hexdigest()
    assert refs(spark, *[r.asDict() | {"viewed_at": NOW} for r in got.collect()]) == [("reddit.com", 1)]


def test_render_pages(spark):
    s = shares(spark, {"slug": "a"}, {"slug": "b", "latest_version": 2}, {"slug": "c", "status": "deleted"})
    c = spark.createDataFrame(
        [("shares/a.html", "x</body>y</body>z</BODY>"), ("shares/b/v2.html", "plain"), ("shares/c.html", "q")], "key string, html string"
    )
    got = dict(rows(hits.render_pages(s, c, "h.test", footer="[{url}]"), "slug", "html"))
    assert got == {
        "a": "x</body>y[https://h.test/report?slug=a]</body>z</BODY>",
        "b": "plain[https://h.test/report?slug=b]",
    }


def test_resolve_requests(spark):
    s = shares(spark, {"slug": "aaaaaaaa"}, {"slug": "bbbbbbbb", "latest_version": 2}, {"slug": "cccccccc", "status": "pending"})
    o = spark.createDataFrame([("shares/aaaaaaaa.html",)], "key string")
    r = spark.createDataFrame([(1, "aaaaaaaa"), (2, "bbbbbbbb"), (3, "cccccccc"), (4, "nope"), (5, "unknown0")], "request_id bigint, slug string")
    got = rows(hits.resolve_requests(r, s, o).orderBy("request_id"))
    assert got == [(1, 200, 1, True), (2, 500, None, True), (3, 404, None, False), (4, 404, None, False), (5, 404, None, False)]


def test_reach(spark):
    s = shares(spark, {"slug": "a", "client": "mcp"}, {"slug": "b", "client": "mcp"}, {"slug": "c", "client": "web", "status": "pending"})
    assert rows(reach.channel_reach(s)) == [("mcp", 2, 1)]
    series = spark.createDataFrame([("d1", 3), ("d2", 0), ("d3", 4)], "day string, n bigint")
    assert sorted(rows(reach.daily_activity(series))) == [("d1", 3, 7), ("d3", 4, 7)]

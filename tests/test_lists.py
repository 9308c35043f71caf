import random

import pytest
from helpers import rows, shares
from pyspark.sql import functions as F

from leafmeter.functions.ordered import running_total
from leafmeter.operators import lists


def owned(spark, n, seed=0):
    rnd = random.Random(seed)
    # One owner holds most shares, many of them of the same second.
    data = [(f"s{i:04}", "hot" if i % 3 else f"o{i % 4}", rnd.randrange(12)) for i in range(n)]
    rows_ = [{"slug": s, "owner_key_hash": o, "created_at": c} for s, o, c in data]
    rows_ += [{"slug": "xx", "owner_key_hash": "hot", "status": "deleted"}, {"slug": "yy"}]
    return data, shares(spark, *rows_)


def test_running_total_equals_plain_sum(spark):
    rnd = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 5}", rnd.randrange(40), i, rnd.randrange(-3, 9)) for i in range(700)]
    df = spark.createDataFrame(data, "k string, a bigint, b bigint, v bigint")
    got = {r.b: r.t for r in running_total(df, ["k"], [F.desc("a"), F.asc("b")], {"v": "t"}).collect()}
    want, sums = {}, {}
    for k, _, b, v in sorted(data, key=lambda x: (x[0], -x[1], x[2])):
        want[b] = sums[k] = sums.get(k, 0) + v
    assert got == want


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_pages_neither_overlap_nor_drop(spark, limit):
    data, s = owned(spark, 120)
    got = lists.owner_pages(s, "h", limit).collect()
    for owner in {o for _, o, _ in data}:
        want = sorted(((c, x) for x, o, c in data if o == owner), reverse=True)
        mine = sorted((r for r in got if r.owner_key_hash == owner), key=lambda r: r.pos)
        assert [(r.created_at, r.slug) for r in mine] == want
        assert [r.page for r in mine] == [i // limit + 1 for i in range(len(want))]
        marked = [r.pos for r in mine if r.next_cursor]
        assert marked == [p for p in range(limit, len(want), limit)]


def test_seeking_through_all_pages_equals_the_list(spark):
    data, s = owned(spark, 40, seed=2)
    pages = lists.owner_pages(s, "h", 7).collect()
    starts = {(r.owner_key_hash, r.page + 1): r.next_cursor for r in pages if r.next_cursor}
    starts |= {(o, 1): None for o in {o for _, o, _ in data}}
    asked = [(i, o, c, 7) for i, ((o, _), c) in enumerate(starts.items())]
    df = spark.createDataFrame(asked, "request_id bigint, owner_key_hash string, cursor string, limit bigint")
    got = lists.owner_seek(df, s).collect()
    by_page = {i: key for i, key in enumerate(starts)}
    assert {(*by_page[r.request_id], r.slug) for r in got} == {(r.owner_key_hash, r.page, r.slug) for r in pages}
    want_cursor = {(r.owner_key_hash, r.page): r.next_cursor for r in pages if r.next_cursor}
    assert {by_page[r.request_id]: r.next_cursor for r in got if r.next_cursor} == want_cursor


def test_bad_list_requests(spark):
    _, s = owned(spark, 10)
    asked = [(1, "hot", "++", 5), (2, "hot", None, 0), (3, "hot", None, 101), (4, "nobody", None, 5), (5, "hot", None, None)]
    df = spark.createDataFrame(asked, "request_id bigint, owner_key_hash string, cursor string, limit bigint")
    got = lists.owner_seek(df, s)
    assert sorted(rows(got.filter("slug is null"), "request_id", "status")) == [(1, "bad_request"), (2, "bad_request"), (3, "bad_request"), (4, "ok")]
    assert got.filter("request_id = 5").count() == sum(1 for i in range(10) if i % 3)


def test_merge(spark):
    remote = spark.createDataFrame([(1, "both", "r/both", 5), (1, "far", "r/far", 9)], "device bigint, slug string, share_url string, created_at bigint")
    local = spark.createDataFrame(
        [(1, "both", "l/both", 4, "T"), (1, "near", "l/near", 9, ""), (2, "far", "l/far", 1, "U")],
        "device bigint, slug string, share_url string, created_at bigint, title string",
    )
    got = rows(lists.merge_share_lists(remote, local))
    assert got == [
        (1, "far", "r/far", 9, None, False, True), (1, "near", "l/near", 9, None, True, False), (1, "both", "r/both", 5, "T", True, True),
        (2, "far", "l/far", 1, "U", True, False),
    ]
    assert sorted(rows(lists.unsynced_local(local, remote))) == [(1, "near"), (2, "far")]


def test_recent_saves(spark):
    saves = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4), (2, "a", 5)], "device bigint, slug string, seq bigint")
    assert sorted(rows(lists.recent_per_device(saves, 2))) == [(1, "a", 2), (1, "c", 1), (2, "a", 1)]
